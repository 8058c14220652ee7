"""Small planted snapshots for the whole cascade, and what a run over them gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import waterfall

_LD = '<script type="application/ld+json">{}</script>'
#: id, name, website, city, email, phone, score.
RECORDS = [
    (1, "Un", "https://x.test/", "Nice", None, None, 50),
    (2, "Deux SARL", "deux.test", "Lyon", None, None, 50),
    (3, "Trois", "trois.test", "Nice", "known@trois.test", None, 50),
    (4, "Quatre", "quatre.test", "Nice", None, None, 50),
    (5, "Cinq", "cinq.test", "Nice", None, None, 50),
    (6, "Six", "six.test", "Nice", None, None, 50),
]
DNS = [(d, "MX", "10 aspmx.l.google.com") for d in ("x.test", "trois.test", "quatre.test", "cinq.test", "six.test")]
PAGES = [
    ("https://x.test", 200, "text/html; charset=utf-8", "<p>contact [at] x (dot) test</p>"),
    ("https://x.test/contact", 404, "text/html", "<p>no@x.test</p>"),
    ("https://quatre.test", 200, "text/html", _LD.format('[{"@graph":[{"@type":"Person","name":"no"},{"@type":["Thing","Dentist"],"name":"Quatre","contactPoint":[{"email":" "},{"email":"info@other.test"}],"address":{"streetAddress":"1 rue","addressLocality":"Nice"}}]},5]') + _LD.format("{bad")),
    ("https://quatre.test/equipe", 200, "text/html", "<h3>Anne Lune</h3><p>Gérante</p><p>Tel 04 93 00 00 01</p>"),
    ("https://cinq.test/equipe", 200, "application/xhtml+xml", "<div><b>Directeur</b><i></i><span>Jean Roc</span></div> SIRET : 123 456 789 00012"),
]
REGISTRY = [("Deux", "Lyon", 1, "s2", "t2", "DEUX", "96", [("Bec", "Ada", "Gerant", "personne physique")])]
SEARCHES = [('site:linkedin.com/in "Bad" "Six"', "captcha"), ('site:linkedin.com/in "Jean Roc" "Cinq"', "see https://fr.linkedin.com/in/jean-roc/ and JEAN@cinq.test, a@google.com"), ('"@six.test" email', "hello@six.test, Z@other.test")]
PROFILES = [("Ada", "Bec", "Deux", "https://www.linkedin.com/in/ada-b", "direct")]
_MAILS = "array<struct<email:string,isCurrent:boolean>>"
VENDOR = [("https://www.linkedin.com/in/ada-b", (None, ["a.b@deux.test"], "ada@home.test", [], [], None, [], "Ada Bec", "Ada", "Bec", "Gerant", "Deux", "ada-b")), ("https://www.linkedin.com/in/anne-lune", (None, [], None, [], [("old@quatre.test", False), ("anne@quatre.test", True)], None, [("0611",)], "Anne Lune", "Anne", "Lune", None, None, None))]
CHECKS = [("jean.roc@cinq.test", False, True, False, True), ("j.roc@cinq.test", True, True, False, False)]
NOT_NAMES = ["mentions", "legales", "gerant", "gerante", "fondatrice", "directeur"]
#: id, tried, confidences, confidence, best address, officer, registration, company's and officer's address, stopped.
RUN = [
    (1, "dns_intel,schema_org,deep_scrape", "30,85,70", 85, "contact@x.test", None, None, "contact@x.test", None, True),
    (2, "dns_intel,schema_org,deep_scrape,sirene,linkedin_search,kaspr", "30,85,65,100,40,100", 100, "a.b@deux.test", "Ada Bec", "t2", None, "a.b@deux.test", True),
    (3, "dns_intel,schema_org", "30,85", 85, None, None, None, None, None, True),
    (4, "dns_intel,schema_org,deep_scrape", "30,75,65", 95, "info@other.test", "Anne Lune", None, "info@other.test", None, True),
    (5, "dns_intel,schema_org,deep_scrape,sirene,google_dork", "30,85,75,90,70", 90, "jean@cinq.test", "Jean Roc", "12345678900012", "jean@cinq.test", None, True),
    (6, "dns_intel,schema_org,deep_scrape,sirene,google_dork", "30,85,65,90,70", 90, "hello@six.test", None, None, "hello@six.test", None, True),
]


def snapshots(spark: SparkSession) -> dict[str, DataFrame]:
    table = spark.createDataFrame
    profile = f"struct<professionalEmail:string,professionalEmails:array<string>,personalEmail:string,personalEmails:array<string>,emails:{_MAILS},phone:string,phones:array<struct<phone:string>>,name:string,firstName:string,lastName:string,title:string,companyName:string,id:string>"
    return {
        "dns": table(DNS, "domain string, record_type string, data string"),
        "pages": table(PAGES, "url string, status int, content_type string, html string"),
        "registry": table(REGISTRY, "query string, commune string, rank int, siren string, siret string, nom_complet string, activite_principale string, dirigeants array<struct<nom:string,prenoms:string,qualite:string,type_dirigeant:string>>"),
        "searches": table(SEARCHES, "query string, html string"),
        "profiles": table(PROFILES, "first_name string, last_name string, company string, url string, strategy string"),
        "vendor": table(VENDOR, f"url string, profile {profile}"),
        "checks": table(CHECKS, "email string, a_valid boolean, a_disposable boolean, b_valid boolean, b_disposable boolean"),
    }


def records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RECORDS, "id int, name string, website string, city string, email string, phone string, score int")


def ran(spark: SparkSession) -> DataFrame:
    """A run over the planted snapshots, a row per record with lists as text."""
    out = waterfall.run(records(spark), waterfall.on_snapshots(**snapshots(spark), not_names=NOT_NAMES))
    confidences = F.array_join(F.transform("used", lambda r: r["confidence"].cast("string")), ",")
    return out.select("id", F.array_join("tried", ",").alias("tried"), confidences.alias("confidences"), "confidence", "best_email", "officer", "registration", "company_email", "officer_email", "stopped")


#: id, website; url, html; and what the page reader's two phases and the single-page reader find.
SITES = [(1, "https://www.one.test/x"), (2, "https://two.test"), (3, "https://three.test"), (4, ""), (5, "https://five.test:80/")]
SITE_PAGES = [
    ("https://www.one.test/", "<a HREF='mailto:Ann@one.test?subject=x'>a</a> info@one.test no-reply@one.test x@example.com pic@2x.png"),
    ("https://www.one.test/contact", "direction@one.test"),
    ("https://www.one.test/about", "late@one.test"),
    ("https://two.test/", "abcdefghijklmnopqrstuvwxyzabcdefgh@two.test a..b@two.test"),
    ("https://two.test/team", "sales@two.test"),
]
CRAWLED = [(1, "direction@one.test,info@one.test,ann@one.test", "direction@one.test", 1), (2, "sales@two.test", "sales@two.test", 2), (3, "contact@three.test", "contact@three.test", 2), (4, "", None, 0), (5, "contact@five.test", "contact@five.test", 2)]
HOMES = [("https://www.one.test/x", "z@other.test contact@else.test Me@One.Test"), ("https://two.test", "z@other.test info@else.test"), ("https://three.test", "noreply@three.test a@sub.google.com")]
GUESSED = [
    (1, "website_scraping", "me@one.test", "enriched"), (2, "website_scraping", "info@else.test", "enriched"), (3, "website_scraping", None, "failed"), (4, "website_scraping", None, "failed"), (5, "website_scraping", None, "failed"),
    (1, "pattern_guess", "contact@one.test", "enriched"), (2, "pattern_guess", "contact@two.test", "enriched"), (3, "pattern_guess", "contact@three.test", "enriched"), (4, "pattern_guess", None, "failed"), (5, "pattern_guess", "contact@five.test", "enriched"),
]


def crawled(spark: SparkSession) -> DataFrame:
    from millrace.functions import records as r

    sites, pages = spark.createDataFrame(SITES, "id int, website string"), spark.createDataFrame(SITE_PAGES, "url string, html string")
    out = r.crawled_in_phases(sites, pages, ["/", "/contact", "/about"], ["/team", "/legal"])
    return out.select("id", F.array_join("emails", ",").alias("emails"), "best", "phase")


def guessed(spark: SparkSession) -> DataFrame:
    from millrace.functions import records as r

    sites, pages = spark.createDataFrame(SITES, "id int, website string"), spark.createDataFrame(HOMES, "url string, html string")
    each = [r.guessed_or_read(sites, pages, k) for k in ("website_scraping", "pattern_guess")]
    return each[0].unionByName(each[1]).select("id", F.col("source").alias("technique"), "email", "status")
