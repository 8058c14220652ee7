"""Sources of the cascade on snapshot tables: pages, search results, profiles, contact vendor, address checks.

A source takes the state of the records that it runs for (id, name, website, domain, and what is known so far: officer,
first_name, last_name, profile, people) and gives a result row for each of them: id, email, phone, officer, registration,
has_mx, metadata and people. Every look-up is a left join by key, and what is gathered per record is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import html
from millrace.functions.people import page_people
from millrace.functions.scoring import verification
from millrace.functions.values import col, filled, folded, permutations, profile_guess, valid_email, without_suffixes

# --- fixed values -------------------------------------------------------------------------------------------
PATHS = ["/contact", "/nous-contacter", "/contactez-nous", "/about", "/a-propos", "/qui-sommes-nous", "/mentions-legales", "/legal", "/equipe", "/notre-equipe", "/team", "/notre-team", "/l-equipe", "/lequipe"]
SEARCH_FORMS = ["sarl", "sas", "sa", "eurl", "sasu"]
PROFILE_FORMS = ["sarl", "sas", "sa", "eurl", "sasu", "sci", "snc"]
SEARCH_EXCLUDED = ["example.com", "sentry.io", "wixpress.com", "wordpress.org", "googleapis.com", "schema.org", "w3.org", "facebook.com", "twitter.com", "instagram.com", "youtube.com", "google.com", "brave.com", "search.brave.com"]
PROFILE_URL = r"(?i)https?://(?:[a-z]{2,3}\.)?linkedin\.com/in/[a-zA-Z0-9\-_%]+/?"
BLOCKED_PAGE = ["captcha", "are you a robot"]
MOST_PEOPLE = {"google_dork": 3, "linkedin_search": 3, "kaspr": 5, "email_permutation": 5}
PAGE_CONFIDENCE, VENDOR_CONFIDENCE, PERMUTATION_CONFIDENCE = 65, 88, 90
# ------------------------------------------------------------------------------------------------------------
PERSON = "struct<name:string,firstName:string,lastName:string,title:string,email:string,phone:string,linkedinUrl:string,source:string,confidence:int>"
PEOPLE = f"array<{PERSON}>"
FIELDS = {"email": "string", "phone": "string", "officer": "string", "registration": "string", "has_mx": "boolean", "metadata": "map<string,string>", "people": PEOPLE}


def result(df: DataFrame, **fields: Column) -> DataFrame:
    """Rows id and all FIELDS; those not given are null. Null metadata values are left out."""
    return df.select("id", *(fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()))


def present(**values: Column) -> Column:
    """A map of the values that are not null."""
    whole = F.create_map(*(x for name, v in values.items() for x in (F.lit(name), v.cast("string"))))
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def address_of(website: Column | str) -> Column:
    """A web address with a scheme and without slashes at its end."""
    c = F.regexp_replace(col(website), "/+$", "")
    return F.when(F.startswith(c, F.lit("http")), c).otherwise(F.concat(F.lit("https://"), c))


def page_of(pages: DataFrame) -> DataFrame:
    """Pages (url, status, content_type, html) that can be read, one for each url: _url, html. A good status and an HTML type; such a table stays."""
    if "_url" in pages.columns:
        return pages
    kind = F.coalesce("content_type", F.lit(""))
    good = F.col("status").between(200, 299) & (F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("xhtml")))
    return pages.where(good).groupBy(F.col("url").alias("_url")).agg(F.max("html").alias("html"))


# --- structured data ------------------------------------------------------------------------------------------


def schema_org(records: DataFrame, pages: DataFrame) -> DataFrame:
    """The first address, phone, founder, name and address of business entities in the home page's JSON-LD."""
    at = records.select("id", address_of("website").alias("_url")).join(page_of(pages), "_url", "left")
    blocks = at.select("id", html.json_ld("html").alias("blocks"))
    found = blocks.select("id", F.size("blocks").alias("n"), F.transform(html.business_entities("blocks"), html.entity).alias("e"))
    first = lambda f, good=lambda x: x.isNotNull(): F.get(F.filter(F.transform("e", lambda x: x[f]), good), F.lit(0))
    some = F.col("n") > 0
    about = F.when(some, present(json_ld_count=F.col("n"), business_name=first("name"), address=first("address"))).otherwise(present(json_ld_count=F.lit(None)))
    return result(found, email=first("email", html.is_published_email), phone=first("phone"), officer=first("founder"), metadata=about)


# --- pages and people -------------------------------------------------------------------------------------------


def distinct_people(found: Column) -> Column:
    """People as decision makers, one for each folded name, in order."""
    keys = F.transform(found, lambda p: folded(p["name"]))
    kept = F.filter(F.transform(found, lambda p, i: F.when(F.array_position(keys, folded(p["name"])) == i + 1, p)), lambda p: p.isNotNull())
    words = lambda p: F.split(F.trim(p["name"]), r"\s+")
    none = F.lit(None).cast("string")
    return F.transform(
        kept,
        lambda p: F.struct(
            p["name"].alias("name"), words(p)[0].alias("firstName"), F.array_join(F.slice(words(p), 2, F.size(words(p))), " ").alias("lastName"), p["title"].alias("title"), none.alias("email"), none.alias("phone"), none.alias("linkedinUrl"), F.lit("deep_scrape").alias("source"), F.lit(PAGE_CONFIDENCE).alias("confidence")
        ),
    )


def deep_scrape(records: DataFrame, pages: DataFrame, not_names: list[str] | DataFrame) -> DataFrame:
    """Addresses, phones, registration and people of the home page and its fourteen usual neighbours.

    People come from the other pages, and from the home page only where these have none. ``not_names`` are the words
    that no name has, a list or a table.
    """
    paths = F.array(F.lit(""), *map(F.lit, PATHS))
    asked = records.select("id", "domain", address_of("website").alias("_base")).select("id", "domain", "_base", F.posexplode(paths).alias("at", "_path")).withColumn("_url", F.concat("_base", "_path"))
    read = asked.join(page_of(pages), "_url").withColumn("page", html.decoded("html"))
    found = read.select("id", F.struct("at", html.emails("page").alias("emails"), html.phones("html").alias("phones"), html.registration("html").alias("registration"), page_people("html", not_names).alias("people")).alias("p"))
    per = found.groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("p"))  # fifteen pages at most
    whole = records.select("id", "domain").join(per, "id", "left").withColumn("p", F.coalesce("p", F.expr("array()").cast(per.schema["p"].dataType)))
    every = lambda f: F.array_distinct(F.flatten(F.transform("p", lambda x: x[f])))
    inner = F.flatten(F.transform(F.filter("p", lambda x: x["at"] > 0), lambda x: x["people"]))
    home = F.flatten(F.transform(F.filter("p", lambda x: x["at"] == 0), lambda x: x["people"]))
    out = whole.select("id", "domain", F.size("p").alias("n"), every("emails").alias("emails"), every("phones").alias("phones"), F.get(F.filter(F.transform("p", lambda x: x["registration"]), lambda x: x.isNotNull()), F.lit(0)).alias("registration"), F.when(F.size(inner) > 0, inner).otherwise(home).alias("people"))
    out = out.withColumns({"ranked": html.ranked_emails("emails", "domain"), "people": distinct_people(F.col("people"))})
    about = present(
        pages_scraped=F.col("n"),
        emails_found=F.size("emails"),
        phones_found=F.size("phones"),
        all_emails=F.when(F.size("emails") > 1, F.array_join(F.slice("emails", 1, 5), ", ")),
        dirigeant_title=F.get("people", F.lit(0))["title"],
        dirigeants_found=F.when(F.size("people") > 0, F.size("people")),
        siret_source=F.when(F.col("registration").isNotNull(), F.lit("mentions_legales")),
    )
    first = lambda c: F.get(c, F.lit(0))
    return result(out, email=first("ranked"), phone=first("phones"), officer=first("people")["name"], registration=F.col("registration"), metadata=about, people=F.col("people"))


# --- search, profiles, vendor, checks -----------------------------------------------------------------------------


def search_emails(page: Column | str) -> Column:
    """Lower-case addresses of a search page, without those of excluded domains."""
    found = F.transform(F.regexp_extract_all(col(page), F.lit(html.EMAIL), 0), F.lower)
    return F.filter(found, lambda e: ~F.split(e, "@")[1].isin(SEARCH_EXCLUDED))


def profile_urls(page: Column | str) -> Column:
    """Distinct profile addresses of a search page, without a slash at the end."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col(page), F.lit(PROFILE_URL), 0), lambda u: F.regexp_replace(u, "/$", "")))


def _ranked(people: Column) -> Column:
    """People from the registry first, then by confidence, else in order."""
    keyed = F.transform(people, lambda p, i: F.struct((p["source"] != "sirene").cast("int").alias("o"), (-F.coalesce(p["confidence"], F.lit(0))).alias("c"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: x["p"])


def _named(p: Column) -> Column:
    return filled(p["firstName"]) & filled(p["lastName"])


def results_by_query(searches: DataFrame) -> DataFrame:
    """Result pages (query, html) that aren't blocked, one for each query: _query, html. Such a table stays."""
    if "_query" in searches.columns:
        return searches
    blocked = F.exists(F.array(*map(F.lit, BLOCKED_PAGE)), lambda w: F.contains(F.col("html"), w))
    return searches.where(F.col("html").isNotNull() & ~blocked).groupBy(F.col("query").alias("_query")).agg(F.max("html").alias("html"))


def google_dork(records: DataFrame, searches: DataFrame) -> DataFrame:
    """Result pages (query, html) for up to three people without a profile, else the officer, else addresses of the domain."""
    company = F.trim(without_suffixes(F.coalesce("name", F.lit("")), SEARCH_FORMS))
    people = F.slice(F.filter("people", lambda p: ~filled(p["linkedinUrl"]) & filled(p["name"])), 1, MOST_PEOPLE["google_dork"])
    of = lambda who: F.concat(F.lit('site:linkedin.com/in "'), who, F.lit('" "'), F.col("company"), F.lit('"'))
    asked = records.select("id", "domain", "officer", company.alias("company"), people.alias("who"))
    single = F.when(filled("officer"), of(F.col("officer"))).otherwise(F.concat(F.lit('"@'), "domain", F.lit('" email')))
    asked = asked.withColumn("query", F.when(F.size("who") > 0, F.transform("who", lambda p: of(p["name"]))).otherwise(F.array(single)))
    rows = asked.select("id", F.posexplode("query").alias("at", "_query"))
    found = rows.join(results_by_query(searches), "_query").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", search_emails("html").alias("emails"), profile_urls("html").alias("urls")))).alias("r"))
    out = asked.join(found, "id", "left").withColumn("r", F.coalesce("r", F.expr("array()").cast(found.schema["r"].dataType)))
    url = lambda i: F.get(F.flatten(F.transform(F.filter("r", lambda x: x["at"] == i), lambda x: x["urls"])), F.lit(0))
    updated = F.transform("who", lambda p, i: p.withField("linkedinUrl", url(i)).withField("source", F.when(url(i).isNotNull(), F.lit("google_dork")).otherwise(p["source"])))
    out = out.select("id", "domain", "who", F.size("r").alias("n"), F.array_distinct(F.flatten(F.transform("r", lambda x: x["emails"]))).alias("emails"), F.array_distinct(F.flatten(F.transform("r", lambda x: x["urls"]))).alias("urls"), updated.alias("updated"))
    some = F.col("n") > 0
    about = present(
        pages_found=F.when(some, F.col("n")),
        emails_found=F.when(some, F.size("emails")),
        dm_queries=F.when(some, F.size("who")),
        search_engine=F.when(some, F.lit("brave")),
        linkedin_url=F.get("urls", F.lit(0)),
        linkedin_urls_count=F.when(F.size("urls") > 1, F.size("urls")),
    )
    own = F.get(F.filter("emails", lambda e: F.contains(e, F.col("domain"))), F.lit(0))
    return result(out, email=F.coalesce(own, F.get("emails", F.lit(0))), metadata=about, people=F.when(some & (F.size("updated") > 0), F.col("updated")))


def profiles_by_name(profiles: DataFrame) -> DataFrame:
    """Profiles (first_name, last_name, company, url, strategy), the first of each name at a company: _first, _last, _company, p. Such a table stays."""
    if "_first" in profiles.columns:
        return profiles
    keys = {"first_name": "_first", "last_name": "_last", "company": "_company"}
    return profiles.where(filled("url")).groupBy(*(F.col(c).alias(n) for c, n in keys.items())).agg(F.min(F.struct("url", "strategy")).alias("p"))


def linkedin_search(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles (first_name, last_name, company, url, strategy) of up to three people without one, else of the officer."""
    company = F.trim(without_suffixes(F.coalesce("name", F.lit("")), PROFILE_FORMS))
    people = F.slice(_ranked(F.filter("people", lambda p: ~filled(p["linkedinUrl"]) & _named(p))), 1, MOST_PEOPLE["linkedin_search"])
    asked = records.select("id", "profile", "first_name", "last_name", company.alias("company"), people.alias("who"))
    none = F.size("who") == 0
    alone = none & ~filled("profile") & filled("first_name") & filled("last_name")
    pair = lambda f, n: F.struct(f.alias("f"), n.alias("n"))
    asked = asked.withColumn("ask", F.when(~none, F.transform("who", lambda p: pair(p["firstName"], p["lastName"]))).when(alone, F.array(pair(F.col("first_name"), F.col("last_name")))))
    rows = asked.select("id", "company", F.posexplode("ask").alias("at", "a")).select("id", "at", F.col("company").alias("_company"), F.col("a.f").alias("_first"), F.col("a.n").alias("_last"))
    found = rows.join(profiles_by_name(profiles), ["_first", "_last", "_company"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("r"))
    out = asked.join(found, "id", "left").withColumn("r", F.coalesce("r", F.expr("array()").cast(found.schema["r"].dataType)))
    updated = F.when(~none, F.transform("r", lambda x: F.get("who", x["at"]).withField("linkedinUrl", x["p"]["url"]).withField("source", F.lit("linkedin_search"))))
    first = F.get("r", F.lit(0))["p"]
    problem = F.when(none & filled("profile"), F.lit(None)).when(none & ~alone, F.lit("No dirigeant name available for LinkedIn search")).when(none & first.isNull(), F.lit("LinkedIn profile not found"))
    about = present(
        dm_searched=F.when(~none, F.size("who")),
        linkedin_found=F.when(~none, F.size("r")),
        linkedin_url=first["url"],
        strategy=F.when(alone, first["strategy"]),
        existing_url=F.when(none & filled("profile"), F.col("profile")),
        error=problem,
    )
    return result(out, metadata=about, people=F.when(F.size(updated) > 0, updated))


def vendor_email(profile: Column) -> Column:
    """Struct email, type of a vendor profile: professional, its list, personal, its list, the current one of all, the first."""
    item = lambda c: F.get(c, F.lit(0))
    given = F.filter(profile["emails"], lambda e: filled(e["email"]))
    kinds = [
        (profile["professionalEmail"], "work"),
        (item(profile["professionalEmails"]), "work"),
        (profile["personalEmail"], "personal"),
        (item(profile["personalEmails"]), "personal"),
        (item(F.filter(given, lambda e: e["isCurrent"]))["email"], "unknown"),
        (item(given)["email"], "unknown"),
    ]
    return F.coalesce(*(F.when(filled(e), F.struct(e.alias("email"), F.lit(k).alias("type"))) for e, k in kinds))


def vendor_by_url(vendor: DataFrame) -> DataFrame:
    """Vendor profiles (url, profile), one for each url: _profile_url, profile. Such a table stays."""
    if "_profile_url" in vendor.columns:
        return vendor
    return vendor.where("profile is not null").groupBy(F.col("url").alias("_profile_url")).agg(F.min_by("profile", F.xxhash64("profile")).alias("profile"))


def kaspr(records: DataFrame, vendor: DataFrame) -> DataFrame:
    """Vendor profiles (url, profile) of up to five people without an address, or else of the officer; a missing url is guessed from the name."""
    with_url = lambda p: F.coalesce(F.nullif(p["linkedinUrl"], F.lit("")), profile_guess(p["firstName"], p["lastName"]))
    people = _ranked(F.filter("people", lambda p: ~filled(p["email"]) & _named(p)))
    people = F.slice(F.filter(F.transform(people, lambda p: p.withField("linkedinUrl", with_url(p))), lambda p: filled(p["linkedinUrl"])), 1, MOST_PEOPLE["kaspr"])
    asked = records.select("id", "officer", "first_name", "last_name", "profile", people.alias("who"))
    none = F.size("who") == 0
    alone = F.coalesce(F.nullif(F.col("profile"), F.lit("")), profile_guess("first_name", "last_name"))
    asked = asked.withColumn("ask", F.when(none, F.array(alone)).otherwise(F.transform("who", lambda p: p["linkedinUrl"])))
    rows = asked.select("id", F.posexplode("ask").alias("at", "_profile_url")).where("_profile_url is not null")
    read = rows.join(vendor_by_url(vendor), "_profile_url").select("id", "at", vendor_email(F.col("profile")).alias("mail"), F.coalesce(F.col("profile.phone"), F.get("profile.phones", F.lit(0))["phone"]).alias("phone"), "profile")
    found = read.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "mail", "phone", F.col("profile.name").alias("name"), F.col("profile.firstName").alias("f"), F.col("profile.lastName").alias("n"), F.col("profile.title").alias("title"), F.col("profile.companyName").alias("company"), F.col("profile.id").alias("url"), filled("profile.professionalEmail").alias("sure")))).alias("r"))
    out = asked.join(found, "id", "left").withColumn("r", F.coalesce("r", F.expr("array()").cast(found.schema["r"].dataType)))
    updated = F.transform("r", lambda x: F.get("who", x["at"]).withField("email", F.coalesce(x["mail"]["email"], F.get("who", x["at"])["email"])).withField("phone", F.coalesce(x["phone"], F.get("who", x["at"])["phone"])).withField("source", F.lit("kaspr")).withField("confidence", F.lit(VENDOR_CONFIDENCE)))
    first = lambda f: F.get(F.filter(F.transform("r", f), lambda x: x.isNotNull()), F.lit(0))
    one = F.get("r", F.lit(0))
    name = F.coalesce(one["name"], F.nullif(F.trim(F.concat_ws(" ", one["f"], one["n"])), F.lit("")))
    only = lambda c: F.when(none, c)
    about = present(
        dm_calls=F.when(~none, F.size("who")),
        kaspr_success=F.when(~none, F.size("r")),
        title=only(one["title"]),
        company=only(one["company"]),
        linkedin_url=only(one["url"]),
        email_type=only(one["mail"]["type"]),
        smtp_verified=only(F.when(one["sure"], F.lit("true"))),
        error=F.when(none & F.get("ask", F.lit(0)).isNull(), F.lit("No LinkedIn URL and no dirigeant name to build one")).when(none & (F.size("r") == 0), F.lit("No data returned")),
    )
    return result(out, email=first(lambda x: x["mail"]["email"]), phone=first(lambda x: x["phone"]), officer=only(name), metadata=about, people=F.when(~none & (F.size("r") > 0), updated))


def checked(checks: DataFrame) -> DataFrame:
    """Address checks by two services (email, a_valid, a_disposable, b_valid, b_disposable) as _email and verdict, one row each. Such a table stays."""
    if "_email" in checks.columns:
        return checks
    one = checks.groupBy("email").agg(*(F.max(c).alias(c) for c in ("a_valid", "a_disposable", "b_valid", "b_disposable")))
    return one.select(F.col("email").alias("_email"), verification(F.col("a_valid"), F.col("a_disposable"), F.col("b_valid"), F.col("b_disposable"), valid_email("email").isNotNull()).alias("verdict"))


def email_permutation(records: DataFrame, checks: DataFrame) -> DataFrame:
    """The first usable permutation for up to five people without an address, for the officer, or contact@ of the domain.

    Usable is an address that is not disposable and is verified or valid, the first in order; unchecked ones are none.
    """
    people = F.slice(F.filter("people", lambda p: ~filled(p["email"]) & _named(p)), 1, MOST_PEOPLE["email_permutation"])
    asked = records.select("id", "domain", "officer", "first_name", "last_name", people.alias("who"))
    none = F.size("who") == 0
    named = filled("first_name") & filled("last_name")
    generic = F.array(F.concat(F.lit("contact@"), "domain"))
    single = F.when(named, permutations("first_name", "last_name", "domain")).otherwise(generic)
    asked = asked.withColumn("ask", F.when(none, F.array(single)).otherwise(F.transform("who", lambda p: permutations(p["firstName"], p["lastName"], F.col("domain")))))
    rows = asked.select("id", F.posexplode("ask").alias("at", "list")).select("id", "at", F.posexplode("list").alias("place", "email"))
    good = checked(checks).where("not verdict.disposable and (verdict.verified or verdict.valid)")
    best = rows.join(good, rows["email"] == good["_email"]).groupBy("id", "at").agg(F.min_by(F.struct("email", "verdict.verified"), "place").alias("b"))
    found = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "b"))).alias("r"))
    out = asked.join(found, "id", "left").withColumn("r", F.coalesce("r", F.expr("array()").cast(found.schema["r"].dataType)))
    updated = F.transform("r", lambda x: F.get("who", x["at"]).withField("email", x["b"]["email"]).withField("source", F.lit("email_permutation")).withField("confidence", F.lit(PERMUTATION_CONFIDENCE)))
    first = F.get("r", F.lit(0))["b"]
    some = F.size("r") > 0
    about = present(
        strategy=F.when(~none, F.lit("multi_dm_permutation_strict")).when(named, F.lit("name_permutation_strict")).when(some, F.lit("generic_fallback")),
        dm_attempted=F.when(~none, F.size("who")),
        dm_success=F.when(~none, F.size("r")),
        smtp_verified=F.when(some, F.when(none & ~named, first["verified"].cast("string")).otherwise(F.lit("true"))),
    )
    return result(out, email=first["email"], officer=F.when(~none | named, F.col("officer")), metadata=about, people=F.when(~none & some, updated))
