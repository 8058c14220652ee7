"""The cascade and the page readers in bulk: records and snapshots by expressions from the tables, and SQL that computes the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import people, records
from millrace.operators import waterfall
from millrace.plans.base import query

NOT_NAMES = ["notre", "gerant", "directeur"]
_FIRST = "element_at(array('Ann', 'Jean', 'Zoe', 'Luc'), CAST((k + {}) % 4 AS INT) + 1)"
_FOUNDER, _MANAGER, _OFFICER = (_FIRST.format(i) for i in range(3))
_PERSON = "array<struct<nom:string,prenoms:string,qualite:string,type_dirigeant:string>>"
_PROFILE = "struct<professionalEmail:string,professionalEmails:array<string>,personalEmail:string,personalEmails:array<string>,emails:array<struct<email:string,isCurrent:boolean>>,phone:string,phones:array<struct<phone:string>>,name:string,firstName:string,lastName:string,title:string,companyName:string,id:string>"


def companies(t):
    """Customers as records of the cascade: every seventeenth has an address already."""
    both = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.selectExpr(
        "c_custkey AS id", "c_custkey AS k", "'Maison ' || c_custkey || IF(c_custkey % 2 = 0, ' SARL', '') AS name", "IF(c_custkey % 2 = 0, 'https://c' || c_custkey || '.test/', 'c' || c_custkey || '.test') AS website",
        "'c' || c_custkey || '.test' AS host", "n_name AS city", "IF(c_custkey % 17 = 0, 'Known@c' || c_custkey || '.test', NULL) AS email", "CAST(NULL AS STRING) AS phone", "CAST(floor(abs(c_acctbal) / 100) AS INT) AS score",
    )


def snapshots(t):
    """Snapshot tables in which what a source finds of a customer depends on its number; some rows repeat or can't be used."""
    c = companies(t)
    page = lambda test, path, status, html: c.where(test).selectExpr(f"'https://' || host || '{path}' AS url", f"{status} AS status", "'text/html; charset=utf-8' AS content_type", f"{html} AS html")
    structured = """'<script type="application/ld+json">{"@type":"Organization","name":"' || name || '"' || IF(k % 6 = 0, ',"email":"info@' || host || '"', '') || IF(k % 9 = 0, ',"telephone":"+1 555 0100"', '') || IF(k % 15 = 0, ',"founder":{"name":"' || """ + _FOUNDER + """ || ' Roc"}', '') || '}</script>'"""
    mail = f"IF(k % 10 = 2, 'contact', lower({_MANAGER}) || '.lune') || '@' || host"
    pages = (
        page("k % 3 = 0", "", "IF(k % 33 = 0, 404, 200)", structured)
        .unionByName(page("k % 4 = 1", "/equipe", "200", f"'<h3>' || {_MANAGER} || ' Lune</h3><p>Gérant</p>'"))
        .unionByName(page("k % 5 = 2", "/contact", "200", f"'<a href=\"mailto:' || {mail} || '\">x</a>' || IF(k % 10 = 7, '<p>Tel 04 93 00 00 01</p>', '')"))
        .unionByName(page("k % 8 = 3", "/legal", "200", "'<p>SIRET : 123 456 789 ' || lpad(CAST(k AS STRING), 5, '0') || '</p>'"))
    )
    officer = f"array(named_struct('nom', 'Bec', 'prenoms', {_OFFICER} || ' Marie', 'qualite', 'Gerant', 'type_dirigeant', 'personne physique'), named_struct('nom', 'Corp', 'prenoms', '', 'qualite', 'President', 'type_dirigeant', 'personne morale'))"
    registry = c.where("k % 5 = 1").selectExpr("'Maison ' || k AS query", "city AS commune", "explode(array(1, 2)) AS rank", "'s' || k AS siren", "'t' || k AS siret", "name AS nom_complet", "'96' AS activite_principale", f"CAST({officer} AS {_PERSON}) AS dirigeants")
    dork = lambda test, query, html: c.where(test).selectExpr(f"{query} AS query", f"{html} AS html")
    searches = dork("k % 4 = 2", "'\"@' || host || '\" email'", "'x Hello@' || host || ', a@google.com'").unionByName(
        dork("k % 8 = 1", f"'site:linkedin.com/in \"' || {_MANAGER} || ' Lune\" \"Maison ' || k || '\"'", "IF(k % 16 = 1, 'captcha ', '') || 'https://fr.linkedin.com/in/lune-' || k || '/'")
    )
    link = "'https://www.linkedin.com/in/bec-' || k"
    profiles = c.where("k % 10 = 1").selectExpr(f"{_OFFICER} AS first_name", "'Bec' AS last_name", "'Maison ' || k AS company", f"{link} AS url", "'direct' AS strategy")
    contact = f"named_struct('professionalEmail', lower({_OFFICER}) || '.bec@' || host, 'professionalEmails', array(), 'personalEmail', NULL, 'personalEmails', array(), 'emails', array(), 'phone', '0611', 'phones', array(), 'name', {_OFFICER} || ' Bec', 'firstName', {_OFFICER}, 'lastName', 'Bec', 'title', 'Gerant', 'companyName', name, 'id', CAST(k AS STRING))"
    vendor = c.where("k % 20 = 1").selectExpr(f"{link} AS url", f"CAST({contact} AS {_PROFILE}) AS profile")
    check = lambda test, email, thrown, b: c.where(test).selectExpr(f"{email} || '@' || host AS email", "true AS a_valid", f"{thrown} AS a_disposable", f"{b} AS b_valid", "false AS b_disposable")
    checks = (
        check("k % 8 = 5", f"lower({_MANAGER}) || '.lune'", "false", "true")
        .unionByName(check("k % 8 = 1", f"lower({_MANAGER}) || '.lune'", "true", "true"))
        .unionByName(check("k % 25 = 1", "'bec'", "false", "true"))
        .unionByName(check("k % 6 = 4", "'contact'", "false", "false"))
    )
    dns = c.where("k % 7 <> 0").selectExpr("host AS domain", "explode(array('MX', 'TXT')) AS record_type", "'10 aspmx.l.google.com' AS data")
    return {"dns": dns, "pages": pages, "registry": registry, "searches": searches, "profiles": profiles, "vendor": vendor, "checks": checks}


@query("""WITH c AS (SELECT c_custkey AS k, 'c' || c_custkey || '.test' AS host, CAST(floor(abs(c_acctbal) / 100) AS INT) AS score, ['ann', 'jean', 'zoe', 'luc'] AS f FROM customer JOIN nation ON c_nationkey = n_nationkey),
flags AS (SELECT *, k % 7 <> 0 AS mx, k % 17 = 0 AS known, k % 3 = 0 AND k % 33 <> 0 AS home, k % 4 = 1 AS manager, k % 5 = 1 AS officer, k % 5 = 2 AS wrote FROM c),
schema AS (SELECT *, home AND k % 6 = 0 AS s_mail, home AND k % 9 = 0 AS s_phone, home AND k % 15 = 0 AS founder FROM flags),
pages AS (SELECT *, known OR s_mail AS stop_schema, NOT (known OR s_mail) AS deep, 85 + CASE WHEN s_mail THEN 5 ELSE 0 END + CASE WHEN s_phone THEN 5 ELSE 0 END + CASE WHEN founder THEN 5 ELSE 0 END AS c_schema,
  65 + CASE WHEN k % 10 = 2 THEN 5 WHEN wrote THEN 15 ELSE 0 END + CASE WHEN k % 10 = 7 THEN 5 ELSE 0 END + CASE WHEN k % 8 = 3 THEN 5 ELSE 0 END + CASE WHEN manager THEN 5 ELSE 0 END AS c_deep FROM schema),
later AS (SELECT *, deep AND NOT wrote AS go, manager OR officer AS people, CASE WHEN officer THEN 100 ELSE 90 END AS c_registry FROM pages),
searched AS (SELECT *, go AND mx AS dork, go AND mx AND NOT people AND NOT founder AND k % 4 = 2 AS dork_mail FROM later),
vendor AS (SELECT *, go AND NOT dork_mail AS go2, go AND NOT dork_mail AND score >= 20 AND (people OR founder) AS paid, go AND NOT dork_mail AND score >= 20 AND k % 20 = 1 AS paid_mail FROM searched),
tried AS (SELECT *, go2 AND NOT paid_mail AND mx AS perm, CASE WHEN manager AND k % 8 = 5 THEN f[(k + 1) % 4 + 1] || '.lune@' WHEN officer AND k % 25 = 1 THEN 'bec@' WHEN officer AND k % 6 = 4 THEN 'contact@' WHEN NOT people AND NOT founder AND k % 6 = 4 THEN 'contact@' END || host AS perm_mail FROM vendor),
mails AS (SELECT *, CASE WHEN s_mail THEN 'info@' || host WHEN deep AND k % 10 = 2 THEN 'contact@' || host WHEN deep AND wrote THEN f[(k + 1) % 4 + 1] || '.lune@' || host WHEN dork_mail THEN 'hello@' || host WHEN paid_mail THEN f[(k + 2) % 4 + 1] || '.bec@' || host WHEN perm THEN perm_mail END AS mail,
  CASE WHEN perm THEN CASE WHEN perm_mail IS NULL THEN 90 + CASE WHEN people OR founder THEN 5 ELSE 0 END WHEN people THEN 100 ELSE 95 END END AS c_perm, CASE WHEN paid THEN CASE WHEN paid_mail THEN 100 ELSE 88 END END AS c_paid, CASE WHEN dork THEN CASE WHEN dork_mail THEN 70 ELSE 55 END END AS c_dork FROM tried),
named AS (SELECT *, mail IS NOT NULL AND (paid_mail OR perm OR (deep AND k % 10 = 7 AND manager AND NOT founder)) AND NOT starts_with(mail, 'contact@') AS personal FROM mails)
SELECT k AS id, concat_ws(',', 'dns_intel', 'schema_org', CASE WHEN deep THEN 'deep_scrape' END, CASE WHEN go THEN 'sirene' END, CASE WHEN dork THEN 'google_dork' END, CASE WHEN go2 THEN 'linkedin_search' END, CASE WHEN paid THEN 'kaspr' END, CASE WHEN perm THEN 'email_permutation' END) AS tried,
  concat_ws(',', 30, c_schema, CASE WHEN deep THEN c_deep END, CASE WHEN go THEN c_registry END, c_dork, CASE WHEN go2 THEN 40 END, c_paid, c_perm) AS confidences,
  CAST(greatest(c_schema, CASE WHEN deep THEN c_deep ELSE 0 END, CASE WHEN go THEN c_registry ELSE 0 END, coalesce(c_dork, 0), coalesce(c_paid, 0), coalesce(c_perm, 0)) AS INT) AS confidence, mail AS best_email,
  CASE WHEN founder THEN ['Ann', 'Jean', 'Zoe', 'Luc'][k % 4 + 1] || ' Roc' WHEN deep AND manager THEN ['Ann', 'Jean', 'Zoe', 'Luc'][(k + 1) % 4 + 1] || ' Lune' WHEN go AND officer THEN ['Ann', 'Jean', 'Zoe', 'Luc'][(k + 2) % 4 + 1] || ' Bec' END AS officer,
  CASE WHEN deep AND k % 8 = 3 THEN '123456789' || lpad(CAST(k AS VARCHAR), 5, '0') WHEN go AND officer THEN 't' || k END AS registration,
  CASE WHEN NOT personal THEN mail END AS company_email, CASE WHEN personal THEN mail END AS officer_email, stop_schema OR mail IS NOT NULL AS stopped, deep AND NOT wrote AND mx AND manager AND k % 16 = 9 AS profile_found FROM named""")
def cascade_run(t):
    """The whole cascade in bulk over the customers, on snapshots stored by their keys."""
    bound = waterfall.on_snapshots(**waterfall.stored(**snapshots(t)), not_names=NOT_NAMES)
    out = waterfall.run(companies(t).drop("k", "host"), bound, paid_score=20)
    confidences = F.array_join(F.transform("used", lambda r: r["confidence"].cast("string")), ",")
    profile = F.exists("people", lambda p: F.coalesce(F.startswith(p["linkedinUrl"], F.lit("https://fr.linkedin.com/in/lune-")), F.lit(False)))
    return out.select("id", F.array_join("tried", ",").alias("tried"), confidences.alias("confidences"), "confidence", "best_email", "officer", "registration", "company_email", "officer_email", "stopped", profile.alias("profile_found"))


def sites(t):
    """A site for each page, every sixth without an address; its pages have the page's text without the sign @."""
    return t("pages").selectExpr("page_id AS id", "'s' || page_id || '.test' AS host", "IF(page_id % 6 = 5, '', 'https://www.s' || page_id || '.test/x') AS website", "replace(html, '@', '') AS body")


@query("""WITH s AS (SELECT page_id AS id, 's' || page_id || '.test' AS host, page_id % 6 <> 5 AS has, CASE WHEN page_id % 8 = 0 THEN 2 WHEN page_id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN page_id % 9 = 0 THEN 2 WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS early FROM pages),
found AS (SELECT id, 10 AS p, 'zed@' || host AS e FROM s WHERE has AND id % 4 = 0 UNION ALL SELECT id, 10, 'ann@' || host FROM s WHERE has AND id % 8 = 0 UNION ALL SELECT id, 1, 'direction@' || host FROM s WHERE has AND id % 3 = 0
  UNION ALL SELECT id, 4, 'info@' || host FROM s WHERE has AND id % 9 = 0 UNION ALL SELECT id, 10, 'late@' || host FROM s WHERE has AND id % 5 = 0 AND early < 3),
listed AS (SELECT id, string_agg(e, ',' ORDER BY p, e) AS emails FROM found GROUP BY id)
SELECT id, coalesce(emails, CASE WHEN has AND id % 7 = 0 THEN 'sales@' || host WHEN has THEN 'contact@' || host ELSE '' END) AS emails, split_part(coalesce(emails, CASE WHEN has AND id % 7 = 0 THEN 'sales@' || host WHEN has THEN 'contact@' || host END), ',', 1) AS best,
  CASE WHEN NOT has THEN 0 WHEN emails IS NOT NULL THEN 1 ELSE 2 END AS phase FROM s LEFT JOIN listed USING (id)""")
def crawl_phases(t):
    """The two phases of the page reader over sites of five pages."""
    s = sites(t)
    page = lambda test, path, text: s.where(test).selectExpr(f"'https://www.' || host || '{path}' AS url", f"{text} || body AS html")
    pages = (
        page("id % 2 = 0", "/", "IF(id % 8 = 0, '<a HREF=\"mailto:Ann@' || host || '?subject=x\">a</a> ', '') || IF(id % 4 = 0, 'zed@' || host, '') || ' no-reply@' || host || ' x@example.com pic@2x.png '")
        .unionByName(page("id % 3 = 0", "/contact", "'direction@' || host || IF(id % 9 = 0, ' info@' || host, '') || ' a..b@' || host || ' '"))
        .unionByName(page("id % 5 = 0", "/about", "'late@' || host || ' '"))
        .unionByName(page("id % 7 = 0", "/team", "'sales@' || host || ' '"))
    )
    out = records.crawled_in_phases(s.select("id", "website"), pages, ["/", "/contact", "/about"], ["/team", "/legal"])
    return out.select("id", F.array_join("emails", ",").alias("emails"), "best", "phase")


@query("""WITH s AS (SELECT page_id AS id, 's' || page_id || '.test' AS host, page_id % 6 <> 5 AS has FROM pages),
pairs AS (SELECT id, 'website_scraping' AS technique, CASE WHEN has THEN CASE id % 4 WHEN 0 THEN 'me@' || host WHEN 1 THEN 'info@else.test' WHEN 2 THEN 'b@other.test' END END AS email FROM s UNION ALL SELECT id, 'pattern_guess', CASE WHEN has THEN 'contact@' || host END FROM s)
SELECT *, CASE WHEN email IS NULL THEN 'failed' ELSE 'enriched' END AS status FROM pairs""")
def single_page_emails(t):
    """One address for each record by its home page or by a guess."""
    s = sites(t)
    text = "CASE id % 4 WHEN 0 THEN 'z@other.test contact@else.test Me@S' || id || '.Test ' WHEN 1 THEN 'z@other.test info@else.test ' WHEN 2 THEN 'b@other.test a@more.test ' ELSE 'noreply@' || host || ' a@sub.google.com ' END"
    pages = s.selectExpr("website AS url", f"{text} || body AS html")
    each = [records.guessed_or_read(s.select("id", "website"), pages, k) for k in ("website_scraping", "pattern_guess")]
    return each[0].unionByName(each[1]).select("id", F.col("source").alias("technique"), "email", "status")


@query("""SELECT page_id, 0 AS nth, ['Ann', 'Jean', 'Zoe', 'Luc'][page_id % 4 + 1] || CASE page_id % 3 WHEN 0 THEN ' Lune' WHEN 1 THEN ' Petit' ELSE ' Blanc' END AS name, CASE page_id % 3 WHEN 0 THEN 'Gérant' WHEN 1 THEN 'directeur général' ELSE 'PDG' END AS title FROM pages WHERE page_id % 5 <> 4""")
def page_people(t):
    """People of pages by a table function: a planted team before each page's own text in small letters."""
    name = "element_at(array('Ann', 'Jean', 'Zoe', 'Luc'), CAST(page_id % 4 AS INT) + 1)"
    team = f"CASE WHEN page_id % 5 = 4 THEN '<h3>Notre Maison</h3><p>Directeur</p>' WHEN page_id % 3 = 0 THEN '<h3>' || {name} || ' Lune</h3>\n<br><p>Gérant</p>' WHEN page_id % 3 = 1 THEN '<li>' || {name} || ' Petit, directeur général</li>' ELSE '<p>Notre PDG depuis 2010 est ' || {name} || ' Blanc</p>' END"
    pages = t("pages").selectExpr("page_id", f"{team} || repeat('.', 250) || lower(html) AS html")
    found = people.people_table(NOT_NAMES)
    return pages.lateralJoin(found(F.col("html").outer())).select("page_id", "nth", "name", "title")


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents) SELECT strip_accents(lower(w)) AS word FROM w GROUP BY 1 HAVING count(*) >= 3 AND 2 * count(*) FILTER (WHERE left(w, 1) = lower(left(w, 1))) >= count(*)""")
def common_words(t):
    """Words that running text has mostly in small letters: a table of what no name is."""
    return people.common_words(t("documents"), "text")
