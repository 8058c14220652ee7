"""Queries over the driver tables, each an operator at work, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import html, records, scoring, values
from millrace.operators import cascade, filters, stats, tables
from millrace.plans.base import ORACLES, QUERIES, query
from millrace.sources import files
from millrace.streaming import jobs

SEGMENTS = {"rod": "metal", "plate": "metal", "gear": "machine"}
KIND = ["purchase", "click", "view", "signup", "error"]


# --- aggregates ----------------------------------------------------------------------------------------------


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS in_credit, count(*) FILTER (WHERE trim(c_name) <> '') AS named,
  coalesce(floor(avg(c_acctbal) * 10 + 0.5) / 10.0, 0) AS mean, count(*) FILTER (WHERE c_acctbal >= 5000) AS high, count(*) FILTER (WHERE c_acctbal >= 1000 AND c_acctbal < 5000) AS medium, count(*) FILTER (WHERE c_acctbal < 1000) AS low FROM customer""")
def stats_global(t):
    c = t("customer")
    return c.agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("in_credit"), F.count_if(values.has_text("c_name")).alias("named"), stats.average("c_acctbal").alias("mean"), *stats.buckets("c_acctbal", 5000, 1000))


@query("""SELECT n_name, count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS with_value, floor(count(*) FILTER (WHERE c_acctbal > 0) * 1000 / count(*) + 0.5) / 10.0 AS rate
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def stats_rate_by_group(t):
    both = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return stats.rates(both, "n_name", F.col("c_acctbal") > 0)


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name LIMIT 20")
def stats_topn(t):
    return stats.top(t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")), "n_name", 20)


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_brand <> '' GROUP BY p_brand")
def grouped_map_count(t):
    return stats.grouped_counts(t("part"), "p_brand")


@query("""SELECT CASE WHEN grouping(p_brand) = 0 THEN 'p_brand' WHEN grouping(p_type) = 0 THEN 'p_type' ELSE 'all' END AS dimension, coalesce(p_brand, p_type) AS value, count(*) AS n
  FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())""")
def counts_grouping_sets(t):
    return stats.counts_by(t("part"), ["p_brand", "p_type"])


@query("""SELECT 0 AS step, 'all' AS stage, count(*) AS n FROM orders UNION ALL SELECT 1, 'open', count(*) FILTER (WHERE o_orderstatus = 'O') FROM orders UNION ALL SELECT 2, 'large', count(*) FILTER (WHERE o_totalprice >= 100000) FROM orders""")
def funnel_rows(t):
    return stats.funnel(t("orders"), [("all", F.lit(True)), ("open", F.col("o_orderstatus") == "O"), ("large", F.col("o_totalprice") >= 100000)])


@query("""SELECT event_type AS source, count(*) AS tried, count(*) FILTER (WHERE value > 50) AS email_found, count(*) FILTER (WHERE value > 90) AS phone_found, count(*) FILTER (WHERE value > 98) AS registration_found FROM events GROUP BY event_type""")
def source_statistics(t):
    above = lambda x: F.when(F.col("value") > x, "x").otherwise("")
    return stats.source_stats(t("events").select(F.col("event_type").alias("source"), above(50).alias("email"), above(90).alias("phone"), above(98).alias("registration")))


@query("""SELECT count(*) FILTER (WHERE value > 50) AS total_email, count(*) FILTER (WHERE value > 90) AS total_phone, floor(avg(value) + 0.5) AS avg_value, floor(avg(user_id) + 0.5) AS avg_user_id FROM events""")
def run_summary(t):
    above = lambda x: F.when(F.col("value") > x, "x").otherwise("")
    out = stats.run_summary(t("events").select(above(50).alias("email"), above(90).alias("phone"), "value", "user_id"), ["email", "phone"], ["value", "user_id"])
    return out.withColumns({c: F.col(c).cast("double") for c in ("avg_value", "avg_user_id")})


# --- filters, order, pages -----------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name ILIKE '%gear%' OR p_type ILIKE '%gear%' OR p_brand ILIKE '%gear%'")
def search_multi_ilike(t):
    return t("part").where(filters.search(["p_name", "p_type", "p_brand"], "%gear,")).select("p_partkey", "p_name", "p_brand", "p_type")


@query("SELECT p_partkey FROM part WHERE (p_type ILIKE '%promo%' OR p_type ILIKE '%small%') AND p_size IN (1, 2, 3)")
def filter_like_any(t):
    return t("part").where(filters.like_any("p_type", ["promo", "small"]) & filters.among("p_size", [1, 2, 3])).select("p_partkey")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_sorted(t):
    orders = t("orders")
    rows = filters.page(orders, "o_totalprice", ["o_totalprice", "o_orderdate"], "o_orderkey", offset=100)
    return rows.select("o_orderkey", "o_totalprice").crossJoin(F.broadcast(orders.agg(F.count("*").alias("total"))))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50")
def page_by_cursor(t):
    return filters.after(t("orders"), "o_orderkey", 1000, 50).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, event_type FROM events ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 ELSE 5 END, ts DESC, event_id LIMIT 200")
def priority_sort(t):
    return filters.by_priority(t("events"), "event_type", KIND, F.desc("ts"), F.asc("event_id")).limit(200).select("event_id", "event_type")


@query(r"""SELECT conv_id AS thread, CAST(turn AS VARCHAR) AS id, CASE WHEN role = 'user' THEN 'received' ELSE 'sent' END AS type, '(sans objet)' AS subject,
  trim(regexp_replace(coalesce(text, ''), '<[^>]*>', '', 'g')) AS body, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * turn AS at FROM conversations""")
def thread_order(t):
    none = F.lit(None).cast("string")
    user = F.col("role") == "user"
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return records.thread(t("conversations").select(F.col("conv_id").alias("thread"), F.col("turn").cast("string").alias("id"), user.alias("is_reply"), F.when(user, F.col("text")).alias("reply_text"), none.alias("reply_html"), none.alias("reply_subject"), none.alias("subject"), F.when(~user, F.col("text")).alias("body"), at.alias("timestamp")))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'low' END AS level FROM orders")
def value_bands(t):
    return t("orders").select("o_orderkey", values.band("o_totalprice", [(200000, "high"), (100000, "medium")], "low").alias("level"))


# --- tables --------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def keep_first(t):
    return tables.keep_first(t("events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def keep_max(t):
    return tables.keep_best(t("orders"), ["o_custkey"], "o_totalprice", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def top_three(t):
    return tables.top_k(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 997 = 0)) WHERE n = 1""")
def anti_new_rows(t):
    e = t("events").select("user_id", "event_id", "value")
    return tables.new_rows(e, e.where("event_id % 997 = 0"), "user_id", ["event_id"]).select("user_id", "event_id")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 20 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def upsert_sparse(t):
    c = t("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    changes = c.where("c_custkey % 10 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(F.col("c_custkey") % 20 == 0, "NEW").alias("c_mktsegment"))
    return tables.update(c, changes, "c_custkey")


@query("SELECT n_name, p_type, row_number() OVER (ORDER BY n_name, p_type) - 1 AS combo FROM nation CROSS JOIN (SELECT DISTINCT p_type FROM part)")
def cross_combos(t):
    return tables.combinations(t("part").select("p_type").distinct(), t("nation").select("n_name"), ["n_name", "p_type"]).select("n_name", "p_type", "combo")


@query("""WITH k AS (SELECT *, (SELECT count(*) FROM lineitem) AS c, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS seq FROM lineitem)
  SELECT seq // 500 AS batch, count(*) AS size, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM k GROUP BY batch""")
def batch_numbering(t):
    rows = tables.batches(t("lineitem").select("l_orderkey", "l_linenumber"), 500, ["l_orderkey", "l_linenumber"])
    return rows.groupBy("batch").agg(F.count("*").alias("size"), F.sum("l_linenumber").alias("lines"))


@query("SELECT event_id, user_id, floor(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 100 / count(*) OVER (PARTITION BY user_id) + 0.5) AS percent FROM events")
def running_progress(t):
    return tables.running_percent(t("events"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", F.col("percent").cast("double"))


@query("SELECT s_suppkey, coalesce(n, 0) AS n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity >= 50 GROUP BY l_suppkey) ON l_suppkey = s_suppkey")
def left_zero_fill(t):
    n = t("lineitem").where("l_quantity >= 50").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return tables.zero_filled(t("supplier").select("s_suppkey"), n, "s_suppkey", ["n"])


@query("SELECT count(DISTINCT e) AS \"unique\", count(e) - count(DISTINCT e) AS duplicate, count(*) - count(e) AS invalid FROM (SELECT nullif(lower(unnest(CASE WHEN len(m) = 0 THEN [''] ELSE m END)), '') AS e FROM (SELECT regexp_extract_all(text, '[a-z0-9]+@[a-z0-9.]+[.][a-z]+') AS m FROM documents))")
def dedup_stats(t):
    found = t("documents").select(F.explode_outer(F.regexp_extract_all("text", F.lit("[a-z0-9]+@[a-z0-9.]+[.][a-z]+"), 0)).alias("e"))
    return tables.email_statistics(found, "e")


# --- text ----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%rod%' OR lower(p_name) LIKE '%plate%' THEN 'metal' WHEN lower(p_name) LIKE '%gear%' THEN 'machine' ELSE 'other' END AS segment FROM part")
def theta_classify(t):
    return t("part").select("p_partkey", values.first_match(F.lower("p_name"), SEGMENTS, "other").alias("segment"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\v\f\r]+', ' ', 'g')) AS text FROM pages")
def html_strip(t):
    return t("pages").select("page_id", html.without_tags("html").alias("text"))


@query(r"SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '(?i)^(?:https?://)?([^/?#:]+)', 1)), '^www\.', ''), '') AS host FROM pages")
def html_links_domain(t):
    return t("pages").select("page_id", values.domain("url").alias("host"))


@query(r"SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '(?:\+33|0033|0)\s?[1-9](?:[\s.\-]?\d{2}){4}'), lambda x: regexp_replace(x, '[^\d+]', '', 'g')))) AS phone FROM documents")
def extract_phones(t):
    return t("documents").select("doc_id", F.explode(html.phones("text")).alias("phone"))


#: Which addresses of a page count, as SQL of its own: patterns and lists are written out, so that a wrong one in the library shows.
_GOOD = r"""len(string_split(e, '@')) > 1 AND string_split(e, '@')[2] NOT IN ('example.com', 'sentry.io', 'wixpress.com', 'wordpress.org', 'wordpress.com', 'gravatar.com', 'schema.org', 'googleapis.com', 'googleusercontent.com', 'w3.org', 'facebook.com', 'twitter.com', 'instagram.com',
    'linkedin.com', 'youtube.com', 'google.com', 'apple.com', 'microsoft.com', 'amazon.com', 'cloudflare.com', 'gstatic.com', 'jquery.com', 'bootstrapcdn.com', 'unpkg.com', 'jsdelivr.net', 'cdnjs.cloudflare.com')
  AND NOT regexp_matches(e, '^(noreply|no-reply|donotreply|mailer-daemon|postmaster|webmaster|hostmaster|abuse|support@wordpress|support@wix)') AND NOT contains(e, '..') AND NOT starts_with(e, '.')
  AND NOT regexp_matches(e, '(?i)\.(png|jpg|jpeg|gif|svg|webp|css|js)$') AND len(string_split(string_split(e, '@')[2], '.')[-1]) BETWEEN 2 AND 10"""


def _addresses(key: str, text: str, table: str) -> str:
    """SQL for all addresses of a text: in links, written out or hidden, in meta and author tags."""
    shown = text
    for pattern, new in ((r"\s*\[at\]\s*", "@"), (r"\s*\(at\)\s*", "@"), (r"\s*\{at\}\s*", "@"), (r"\s*\[dot\]\s*", "."), (r"\s*\(dot\)\s*", "."), (r"\s*\{dot\}\s*", "."), (r"\s*\[point\]\s*", "."), (r"\s*\(point\)\s*", "."), (r"\s+arobase\s+", "@"), (r"\s+at\s+", "@")):
        shown = f"regexp_replace({shown}, '(?i){pattern}', '{new}', 'g')"
    every = rf"""regexp_extract_all({text}, '(?i)mailto:([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{{2,}})', 1), regexp_extract_all({shown}, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}'),
    regexp_extract_all({text}, '(?i)<meta[^>]*content\s*=\s*["'']([^"'']*@[^"'']*\.[a-zA-Z]{{2,}})["''][^>]*>', 1), regexp_extract_all({text}, '(?i)<link[^>]*href\s*=\s*["'']mailto:([^"'']+)["''][^>]*>', 1)"""
    cleaned = r"trim(lower(regexp_replace(regexp_replace(x, '^[<>;\s]+', ''), '[<>;\s]+$', '')))"
    return f"found AS (SELECT {key}, unnest(list_transform(list_concat({every}), lambda x: {cleaned})) AS e FROM {table})"


#: A part of each page that shows or hides an address in one of six ways, as SQL of both engines.
_PLANTED = """CASE page_id % 6 WHEN 0 THEN ' <meta name="x" content="meta' || page_id || '@a.test">' WHEN 1 THEN ' <LINK rel="author" href="mailto:link' || page_id || '@a.test">' WHEN 2 THEN ' bob' || page_id || ' [at] site (dot) fr ' WHEN 3 THEN ' eve' || page_id || ' AT site.fr ' WHEN 4 THEN ' zoe' || page_id || '&#64;site.fr ' ELSE ' <a href="MAILTO:Ann@Site.fr">x</a> lea arobase site(point)fr ' END"""


def _nested(inner: str, steps: list[tuple[str, str]]) -> str:
    """SQL of replacements one after another, whatever the case."""
    for pattern, new in steps:
        inner = f"regexp_replace({inner}, '(?i){pattern}', '{new}', 'g')"
    return inner


def _characters(inner: str, pattern: str, number: str) -> str:
    """SQL of numeric entities as characters."""
    return f"list_reduce(list_prepend({inner}, list_distinct(regexp_extract_all({inner}, '&#({pattern});', 1))), lambda a, m: replace(a, '&#' || m || ';', chr({number})))"


_NAMED_CHARACTERS = "replace(replace(replace(replace(replace(h, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', chr(39))"
_DECODED = f"""decimals AS (SELECT page_id, {_characters("html", "[0-9]+", "CAST(m AS INT)")} AS h FROM source),
hexed AS (SELECT page_id, {_characters("h", "x[0-9a-fA-F]+", "CAST('0' || m AS INT)")} AS h FROM decimals),
decoded AS (SELECT page_id, {_nested(_NAMED_CHARACTERS, [(r"\\u003e", ">"), (r"\\u003c", "<"), (r"\\u0026", "&")])} AS h FROM hexed)"""


@query(f"WITH {_addresses('doc_id', 'text', 'documents')} SELECT DISTINCT doc_id, e AS email FROM found WHERE {_GOOD}")
def extract_emails(t):
    return t("documents").select("doc_id", F.explode(html.emails("text")).alias("email"))


@query(f"WITH source AS (SELECT page_id, html || {_PLANTED} AS html FROM pages), {_DECODED}, {_addresses('page_id', 'h', 'decoded')} SELECT DISTINCT page_id, e AS email FROM found WHERE {_GOOD}")
def contact_emails(t):
    pages = t("pages").select("page_id", F.expr(f"html || {_PLANTED}").alias("html"))
    return pages.select("page_id", html.decoded("html").alias("page")).select("page_id", F.explode(html.emails("page")).alias("email"))


@query(f"WITH source AS (SELECT page_id, html FROM pages), {_DECODED} SELECT page_id, md5(h) AS page FROM decoded")
def entity_decode(t):
    return t("pages").select("page_id", F.md5(html.decoded("html")).alias("page"))


@query(r"""WITH found AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}'), lambda x: lower(x))) AS m FROM documents), each AS (SELECT doc_id, unnest(m) AS e FROM found),
  valid AS (SELECT doc_id, e, len(e) <= 254 AND regexp_matches(e, '^[a-z0-9._%+-]+@[a-z0-9]([a-z0-9-]*[a-z0-9])?([.][a-z0-9]([a-z0-9-]*[a-z0-9])?)*[.][a-z]{2,}$')
    AND regexp_extract(e, '@([^@]*)$', 1) NOT IN ('example.com', 'example.fr', 'test.com', 'test.fr', 'mailinator.com', 'guerrillamail.com', 'tempmail.com', 'throwaway.email', 'yopmail.com', 'yopmail.fr', 'trashmail.com', 'sharklasers.com', 'guerrillamailblock.com', 'grr.la', 'discard.email',
      'temp-mail.org', 'fakeinbox.com', 'mailnesia.com', 'noreply.com', 'no-reply.com', '10minutemail.com', 'guerrillamail.info', 'maildrop.cc', 'tempail.com', 'throwaway.com', 'mailcatch.com')
    AND string_split(e, '@')[1] NOT IN ('noreply', 'no-reply', 'no_reply', 'donotreply', 'do-not-reply', 'mailer-daemon', 'postmaster', 'webmaster', 'abuse', 'bounce', 'unsubscribe', 'root', 'admin') AS valid FROM each)
  SELECT doc_id, e AS email, valid, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN contains(string_split(e, '@')[2], 'example') THEN 0 ELSE 1 END, CASE WHEN e LIKE 'contact@%' OR e LIKE 'info@%' OR e LIKE 'accueil@%' THEN 1 ELSE 0 END, e) AS rank FROM valid""")
def email_validate_rank(t):
    found = t("documents").select("doc_id", F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(html.EMAIL), 0), F.lower))).alias("m"))
    each = found.select("doc_id", F.posexplode(html.ranked_emails("m", F.lit("example"))).alias("at", "email"))
    return each.select("doc_id", "email", values.valid_email("email").isNotNull().alias("valid"), (F.col("at") + 1).cast("long").alias("rank"))


# --- scores, cascade, jobs -----------------------------------------------------------------------------------


@query("SELECT s_suppkey, least(30 + 20 + CASE WHEN s_acctbal > 0 THEN 15 ELSE 0 END + CASE WHEN s_acctbal / 2000 >= 4 THEN 15 WHEN s_acctbal / 2000 >= 3 THEN 8 ELSE 0 END + CASE WHEN s_nationkey * 4 >= 50 THEN 10 WHEN s_nationkey * 4 >= 10 THEN 5 ELSE 0 END, 100) AS score FROM supplier")
def lead_score(t):
    s = t("supplier")
    score = scoring.place_score("s_name", F.when(F.col("s_acctbal") > 0, "x"), F.col("s_acctbal") / 2000, F.col("s_nationkey") * 4, F.lit(""))
    return s.select("s_suppkey", score.alias("score"))


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'replied' WHEN bool_or(event_type = 'click') THEN 'clicked' WHEN bool_or(event_type = 'view') THEN 'opened' ELSE 'sent' END AS status, count(*) AS n FROM events GROUP BY user_id""")
def activity_class(t):
    has = lambda k: F.max(F.when(F.col("event_type") == k, "x"))
    per = t("events").groupBy("user_id").agg(has("purchase").alias("a"), has("click").alias("b"), has("view").alias("c"), F.count("*").alias("n"))
    return per.select("user_id", scoring.activity("a", "b", "c").alias("status"), "n")


_STOPS = """WITH r AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, event_type, value FROM events),
  s AS (SELECT id, p, CASE event_type WHEN 'purchase' THEN 90 WHEN 'click' THEN 85 WHEN 'view' THEN 65 WHEN 'signup' THEN 55 ELSE 30 END + CASE WHEN event_type = 'click' THEN 15 ELSE 0 END AS c, event_type = 'click' AS mail FROM r),
  m AS (SELECT *, max(c) OVER w AS top, sum(mail::INT) OVER w AS mails FROM s WINDOW w AS (PARTITION BY id ORDER BY p)),
  e AS (SELECT id, min(p) AS stop FROM m WHERE mails > 0 AND top + CASE WHEN mails > 1 THEN 20 ELSE 0 END >= 80 GROUP BY id)
  SELECT m.id, count(*) AS tried, CAST(least(100, max(m.top) + CASE WHEN max(mails) > 1 THEN 20 ELSE 0 END) AS INT) AS confidence, bool_or(e.stop IS NOT NULL) AS stopped FROM m LEFT JOIN e USING (id) WHERE e.stop IS NULL OR p <= e.stop GROUP BY m.id"""
_NAMED = {"purchase": "sirene", "click": "schema_org", "view": "deep_scrape", "signup": "google_dork", "error": "dns_intel"}


def _source():
    return F.create_map(*(F.lit(x) for kv in _NAMED.items() for x in kv))[F.col("event_type")]


@query(_STOPS)
def cascade_early_stop(t):
    """Each user's events as the results of sources in order, run until they are confident and an address is known."""
    none = F.lit(None).cast("string")
    results = t("events").select(F.col("user_id").alias("id"), "event_id", _source().alias("source"), F.when(F.col("event_type") == "click", "a@x.test").alias("email"), F.lit("x.test").alias("domain"), none.alias("none"))
    scored = results.withColumn("confidence", scoring.confidence("source", "email", "domain", "none", "none", "none", F.lit(False)))
    return cascade.early_stops(scored, ["event_id"])


@query("""WITH s AS (SELECT l_suppkey AS id, l_orderkey, l_linenumber, 30 + CASE WHEN l_discount > 0.07 THEN 40 ELSE 0 END AS c, CASE WHEN l_quantity >= 40 THEN 'm' || l_linenumber || '@x.test' END AS e FROM lineitem),
  f AS (SELECT *, row_number() OVER w AS p, e IS NOT NULL AND row_number() OVER (PARTITION BY id, e ORDER BY l_orderkey, l_linenumber) > 1 AS again FROM s WINDOW w AS (PARTITION BY id ORDER BY l_orderkey, l_linenumber)),
  m AS (SELECT *, least(100, max(c) OVER w + CASE WHEN bool_or(again) OVER w THEN 20 ELSE 0 END) AS total, count(e) OVER w AS mails FROM f WINDOW w AS (PARTITION BY id ORDER BY p)),
  e AS (SELECT id, min(p) AS stop FROM m WHERE mails > 0 AND total >= 85 GROUP BY id)
  SELECT m.id, count(*) AS tried, CAST(max(total) AS INT) AS confidence, bool_or(stop IS NOT NULL) AS stopped FROM m LEFT JOIN e USING (id) WHERE stop IS NULL OR p <= stop GROUP BY m.id""")
def cascade_early_stop_all(t):
    """Each supplier's lines as results, hundreds of an id, run until two have the same address and enough confidence."""
    confidence = (F.lit(30) + F.when(F.col("l_discount") > 0.07, 40).otherwise(0)).cast("int")
    mail = F.when(F.col("l_quantity") >= 40, F.concat(F.lit("m"), F.col("l_linenumber").cast("string"), F.lit("@x.test")))
    rows = t("lineitem").select(F.col("l_suppkey").alias("id"), "l_orderkey", "l_linenumber", mail.alias("email"), confidence.alias("confidence"))
    return cascade.early_stops(rows, ["l_orderkey", "l_linenumber"], threshold=85)


_SOURCE_ROWS = """s AS (SELECT user_id AS id, event_type AS t, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS p, CASE WHEN event_type IN ('click', 'view') THEN 'u' || (user_id % 3) || '@x.test' END AS mail,
    CASE event_type WHEN 'purchase' THEN 90 WHEN 'click' THEN 85 WHEN 'view' THEN 65 WHEN 'signup' THEN 55 ELSE 30 END + CASE WHEN event_type IN ('click', 'view') THEN 15 ELSE 0 END AS c FROM events GROUP BY ALL)"""


def _results(t):
    """One result for each user and kind of event."""
    text = F.lit(None).cast("string")
    rank = {"error": 0, "click": 1, "view": 2, "purchase": 3, "signup": 4}
    mail = F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string"), F.lit("@x.test")))
    each = t("events").select("user_id", "event_type").distinct()
    return each.select(F.col("user_id").alias("id"), F.create_map(*(F.lit(x) for kv in rank.items() for x in kv))[F.col("event_type")].alias("priority"), _source().alias("source"), mail.alias("email"), *(text.alias(n) for n in ("phone", "registration", "officer")), F.lit(False).alias("verified"), F.lit(None).cast("boolean").alias("has_mx"))


@query(f"WITH {_SOURCE_ROWS} SELECT id, CAST(least(100, max(c) + CASE WHEN count(mail) > 1 THEN 20 ELSE 0 END) AS INT) AS confidence, count(*) AS results FROM s GROUP BY id")
def confidence_fold(t):
    scored = _results(t).withColumn("confidence", scoring.confidence("source", "email", F.lit("x.test"), "phone", "registration", "officer", F.col("verified")))
    gathered = scored.groupBy("id").agg(F.collect_list(F.struct("email", "confidence")).alias("r"))  # a result for each kind of event
    return gathered.select("id", cascade.aggregate_confidence(F.col("r")).alias("confidence"), F.size("r").cast("long").alias("results"))


@query(f"""WITH {_SOURCE_ROWS}, m AS (SELECT *, max(c) OVER w AS top, count(mail) OVER w AS mails FROM s WINDOW w AS (PARTITION BY id ORDER BY p)),
  e AS (SELECT id, min(p) AS stop FROM m WHERE mails > 0 AND least(100, top + CASE WHEN mails > 1 THEN 20 ELSE 0 END) >= 80 GROUP BY id),
  u AS (SELECT m.* FROM m LEFT JOIN e USING (id) WHERE stop IS NULL OR p <= stop)
  SELECT id, count(*) AS tried, CAST(least(100, max(c) + CASE WHEN count(mail) > 1 THEN 20 ELSE 0 END) AS INT) AS confidence, max(mail) AS best_email, bool_or(id IN (SELECT id FROM e)) AS stopped FROM u GROUP BY id""")
def cascade_sources(t):
    text = F.lit(None).cast("string")
    given = t("events").select(F.col("user_id").alias("id")).distinct().select("id", F.lit("x.test").alias("domain"), text.alias("email"), F.lit(0).alias("score"), F.lit("Ann").alias("first_name"), F.lit("Bee").alias("last_name"))
    return cascade.enrich(given, _results(t)).select("id", F.size("used").cast("long").alias("tried"), "confidence", "best_email", F.col("stopped"))


@query("""SELECT source, arg_max(lang, (n_chars, doc_id)) FILTER (WHERE lang <> '') AS lang, arg_max(md5(text), (n_chars, doc_id)) AS text, max(n_chars) AS n_chars FROM (SELECT lower(trim(source)) AS source, lang, text, n_chars, doc_id FROM documents WHERE trim(source) <> '') GROUP BY source""")
def merge_entities(t):
    docs = t("documents").select("source", "lang", F.md5("text").alias("text"), "n_chars", "doc_id")
    return tables.merged_rows(docs, "source", ["n_chars", "doc_id"], ["lang", "text"], "n_chars")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t):
    return t("events").select("event_id", F.explode(files.items("props")).alias("item")).select("event_id", F.try_variant_get("item", "$.k", "bigint").alias("k"))


@query("""SELECT user_id AS job, arg_max(props, event_id) FILTER (WHERE event_type = 'view') AS progress, count(*) FILTER (WHERE event_type = 'click') AS results,
  CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'error' ELSE 'running' END AS status, max(event_id) AS last_seq FROM events GROUP BY user_id""")
def event_reducer(t):
    name = F.when(F.col("event_type") == "view", "progress").when(F.col("event_type") == "click", "lead_done").otherwise(F.col("event_type"))
    return jobs.state(t("events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), name.alias("event"), F.col("props").alias("data"))).select("job", "progress", "results", "status", "last_seq")


@query("""SELECT user_id AS job, event_id AS seq, CASE WHEN event_type = 'error' THEN 'lead_error' ELSE 'lead_done' END AS event, event_type || '-' || event_id AS "leadId", CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'enriched' END AS status, value AS confidence, CASE WHEN event_type = 'error' THEN 'no' END AS error FROM events WHERE event_type <> 'view'""")
def appended_results(t):
    """The results that events append to their run, with the data of views broken."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "click", "enriched").otherwise("odd")
    data = F.to_json(F.struct(F.concat_ws("-", kind, "event_id").alias("leadId"), status.alias("status"), F.col("value").alias("confidence"), F.when(kind == "error", "no").alias("error")))
    log = t("events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.when(kind == "error", "lead_error").otherwise("lead_done").alias("event"), F.when(kind == "view", F.lit("{")).otherwise(data).alias("data"))
    return jobs.results(log).select("job", "seq", "event", "leadId", "status", "confidence", "error")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(t):
    return jobs.windowed_counts(t("events"))


from millrace.plans import cascades, lists  # noqa: E402, F401  (register more queries)
