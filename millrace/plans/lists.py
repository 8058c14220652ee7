"""Queries of record lists, campaigns, uploads and job logs."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import records, scoring, values
from millrace.operators import filters, keywords, stats, stored, tables
from millrace.plans.base import query
from millrace.sources import files, remote
from millrace.streaming import chunks, jobs, runs

def _leads(t):
    """Customers as stored records."""
    none = F.lit(None).cast("string")
    mail = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.test"))).otherwise("")
    status = F.when(F.col("c_custkey") % 5 == 0, "failed").when(F.col("c_custkey") % 7 == 0, "skipped").when(F.col("c_custkey") % 11 == 0, "odd")
    both = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"), F.col("n_name").alias("city"), none.alias("address"), none.alias("phone"), mail.alias("email"), none.alias("website"), F.lit(None).cast("double").alias("rating"), F.lit(None).cast("int").alias("reviews"), F.floor(F.abs("c_acctbal") / 100).cast("int").alias("score"), F.lit("").alias("source"), none.alias("enriched_at"), status.alias("enrichment_status"), F.lit(None).cast("int").alias("enrichment_attempts"))


_LEADS = """leads AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS category, n_name AS city, CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey || '@x.test' ELSE '' END AS email, CAST(floor(abs(c_acctbal) / 100) AS INT) AS score,
  CASE WHEN c_custkey % 5 = 0 THEN 'failed' WHEN c_custkey % 7 = 0 THEN 'skipped' WHEN c_custkey % 11 = 0 THEN 'odd' END AS db FROM customer JOIN nation ON c_nationkey = n_nationkey),
listed AS (SELECT *, CASE WHEN email <> '' THEN 'enriched' WHEN db IN ('failed', 'skipped') THEN db ELSE 'pending' END AS status FROM leads)"""


@query(f"WITH {_LEADS} SELECT CAST(id AS VARCHAR) AS id, name AS nom_entreprise, city AS ville, category AS verticale, email, score, 0.0 AS note_google, 'Google Maps Scraping' AS source, status AS enrichment_status, 0 AS enrichment_attempts FROM listed")
def record_list(t):
    return records.listed(_leads(t)).select("id", "nom_entreprise", "ville", "verticale", "email", "score", "note_google", "source", "enrichment_status", "enrichment_attempts")


@query(f"""WITH {_LEADS} SELECT CAST(id AS VARCHAR) AS id, score FROM listed WHERE (lower(name) LIKE '%a%' OR lower(city) LIKE '%a%' OR lower(category) LIKE '%a%' OR lower(email) LIKE '%a%') AND category IN (SELECT DISTINCT category FROM leads WHERE category < 'G') AND status IN ('failed', 'skipped') AND email = '' AND score >= 10 AND score <= 90""")
def record_filters(t):
    rows = records.listed(_leads(t))
    segments = [r[0] for r in t("customer").select("c_mktsegment").distinct().where("c_mktsegment < 'G'").collect()]  # a parameter of the list: its few segments
    return rows.where(records.matches(search="A", segments=segments, pipeline="nouveau", has_email=False, low=10, high=90, status="failed")).select("id", "score")


@query(f"WITH {_LEADS} SELECT CAST(id AS VARCHAR) AS id, score FROM listed ORDER BY score DESC, CAST(id AS VARCHAR) DESC LIMIT 100")
def record_order(t):
    return filters.sorted_list(records.listed(_leads(t)), "score", "id", True).limit(100).select("id", "score")


@query(f"WITH {_LEADS} SELECT id, email = '' AND coalesce(db, '') NOT IN ('failed', 'skipped') AND id % 13 <> 0 AS selectable, CASE WHEN email <> '' AND id % 2 = 0 THEN 'both' WHEN email <> '' THEN 'email' WHEN id % 13 = 0 OR db IN ('failed', 'skipped') THEN 'tried' ELSE 'untouched' END AS complete FROM listed")
def record_flags(t):
    error = F.when(F.col("id") % 13 == 0, "no")
    person = F.when(F.col("id") % 2 == 0, "p@x.test")
    return _leads(t).select("id", records.selectable("email", F.lit(None).cast("string"), error, "enrichment_status").alias("selectable"), records.completeness(["email"], [person], error, F.col("enrichment_status")).alias("complete"))


@query(f"WITH {_LEADS} SELECT id, name, email, score FROM leads WHERE email <> '' AND city ILIKE '%on_1%' AND (category ILIKE '%build%' OR category ILIKE '%auto%') ORDER BY id LIMIT 40")
def lead_query(t):
    return filters.leads(_leads(t), "on_1", ["build", "auto"], 40).select("id", "name", "email", "score")


@query(f"WITH {_LEADS} SELECT id, name, nullif(email, '') AS email, score FROM leads")
def cascade_inputs(t):
    return records.cascade_input(_leads(t)).select("id", "name", "email", "score")


@query(f"WITH {_LEADS} SELECT count(*) AS total, count(*) FILTER (WHERE email <> '') AS with_email, 0 AS with_phone, 0 AS with_website, floor(avg(score) + 0.5) AS avg_score FROM leads")
def page_figures(t):
    out = stats.page_stats(_leads(t))
    return out.select("total", "with_email", *(F.col(c).cast("int").alias(c) for c in ("with_phone", "with_website")), F.col("avg_score").cast("double").alias("avg_score"))


@query("""WITH a AS (SELECT s_suppkey AS id, count(l_suppkey) AS sent, count(*) FILTER (WHERE l_quantity > 25) AS opened, count(*) FILTER (WHERE l_quantity > 45) AS replied FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_discount > 0.05 GROUP BY s_suppkey)
  SELECT id, sent AS emails_sent, opened AS emails_read, replied, CASE WHEN sent > 0 THEN floor(opened * 1000 / sent + 0.5) / 10.0 ELSE 0.0 END AS open_rate, CASE WHEN sent > 0 THEN floor(replied * 1000 / sent + 0.5) / 10.0 ELSE 0.0 END AS reply_rate FROM a""")
def campaign_rates(t):
    per = t("lineitem").where("l_discount > 0.05").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("emails_sent"), F.count_if(F.col("l_quantity") > 25).alias("emails_read"), F.count_if(F.col("l_quantity") > 45).alias("replied"))
    return records.with_rates(t("supplier").select(F.col("s_suppkey").alias("id")), per, ["emails_sent", "emails_read", "replied"])


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber, CAST(sum(l_suppkey) AS BIGINT) AS l_suppkey FROM lineitem")
def campaign_totals(t):
    return records.totals(t("lineitem"), ["l_linenumber", "l_suppkey"])


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'view') AS \"view\", count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'none') AS \"none\" FROM events")
def status_counts(t):
    return stats.status_counts(t("events"), "event_type", ["view", "click", "none"])


@query("""WITH r AS (SELECT conv_id, min(turn) AS seq FROM conversations WHERE role = 'user' GROUP BY conv_id ORDER BY conv_id LIMIT 10), m AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id)
  SELECT CAST(conv_id AS VARCHAR) AS email, left(trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 120) AS snippet FROM r JOIN m USING (conv_id)""")
def latest_messages(t):
    c = t("conversations").withColumn("email", F.col("conv_id").cast("string"))
    replies = c.where("role = 'user'").select("email", F.col("conv_id").alias("seq"), F.lit("replied").alias("status")).distinct()
    return records.latest_messages(replies, c.select("email", F.lit("").alias("reply_text"), F.col("text").alias("body"), F.col("turn").alias("at"))).select("email", "snippet")


@query("""WITH n AS (SELECT count(*) AS a FROM part), g AS (SELECT p_brand, count(*) AS n FROM part WHERE p_brand <> '' GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 5) SELECT p_brand, g.n, CAST(floor(g.n * 100 / a + 0.5) AS BIGINT) AS share FROM g, n""")
def group_shares(t):
    return stats.shares(t("part"), "p_brand")


@query("""SELECT event_id, CASE WHEN m < 1 THEN 'a l''instant' WHEN m < 60 THEN 'il y a ' || m || 'min' WHEN m < 1440 THEN 'il y a ' || m // 60 || 'h' WHEN m < 10080 THEN 'il y a ' || m // 1440 || 'j' ELSE day(ts) || ' ' || ['janv.', 'févr.', 'mars', 'avr.', 'mai', 'juin', 'juil.', 'août', 'sept.', 'oct.', 'nov.', 'déc.'][month(ts)] END AS ago
  FROM (SELECT event_id, ts, CAST(floor((epoch(max(ts) OVER ()) - epoch(ts)) / 60) AS BIGINT) AS m FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events))""")
def time_ago(t):
    e = t("events").select("event_id", F.date_trunc("second", "ts").alias("ts"))
    return e.crossJoin(e.agg(F.max("ts").alias("now"))).select("event_id", records.time_ago("ts", "now").alias("ago"))  # one row


@query("SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 12 MONTH AS DATE) AS VARCHAR) AS start_date, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS end_date FROM orders")
def trailing_years(t):
    return t("orders").select("o_orderkey", records.trailing_year("o_orderdate").alias("w")).select("o_orderkey", F.col("w.start_date").cast("string").alias("start_date"), F.col("w.end_date").cast("string").alias("end_date"))


@query("""WITH c AS (SELECT c_custkey, c_acctbal, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey), k AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS seq FROM (SELECT *, row_number() OVER (PARTITION BY 'u' || c_custkey % 700 || '@x.test' ORDER BY c_custkey) AS n FROM c WHERE c_custkey % 4 <> 0) WHERE n = 1)
  SELECT seq // 50 AS batch, count(*) AS size, CAST(sum(c_custkey) AS BIGINT) AS keys FROM k GROUP BY batch""")
def upload_batches(t):
    mail = F.when(F.col("c_custkey") % 4 == 0, "bad@").otherwise(F.concat(F.lit("U"), (F.col("c_custkey") % 700).cast("string"), F.lit("@x.test")))
    rows = t("customer").select(F.col("c_custkey").alias("id"), mail.alias("email"), F.col("c_name").alias("name"))
    return tables.upload_batches(rows, 50, ["id"]).groupBy("batch").agg(F.count("*").alias("size"), F.sum("id").alias("keys"))


@query("""SELECT c_custkey // 50 AS batch, count(*) AS size FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS s, c_custkey FROM customer) q WHERE false GROUP BY 1 UNION ALL
  SELECT s // 50 AS batch, count(*) AS size FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS s, c_custkey FROM customer) WHERE c_custkey % 4 <> 0 GROUP BY 1""")
def upload_batches_cut_first(t):
    mail = F.when(F.col("c_custkey") % 4 == 0, "bad@").otherwise(F.concat(F.lit("U"), (F.col("c_custkey") % 700).cast("string"), F.lit("@x.test")))
    rows = t("customer").select(F.col("c_custkey").alias("id"), mail.alias("email"), F.col("c_name").alias("name"))
    return tables.upload_batches(rows, 50, ["id"], valid_first=False).groupBy("batch").agg(F.count("*").alias("size"))


@query(f"WITH {_LEADS} SELECT email, name AS company_name, city, category AS lt_category FROM leads WHERE email <> ''")
def single_uploads(t):
    out = tables.single_uploads(_leads(t))
    return out.select("email", "company_name", F.try_element_at("others", F.lit("city")).alias("city"), F.try_element_at("others", F.lit("lt_category")).alias("lt_category"))


@query("SELECT CAST(sum(CASE WHEN o_custkey % 3 = 0 THEN o_custkey ELSE 500 END) AS BIGINT) AS uploaded, CAST(sum(CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors, count(*) AS batches FROM orders")
def upload_totals(t):
    o = t("orders").select(F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).cast("long").alias("uploaded"), F.lit(500).cast("long").alias("size"), F.when(F.col("o_custkey") % 5 == 0, 1).cast("long").alias("errors"))
    return tables.upload_totals(o, "size")


@query("""WITH s AS (SELECT r_name AS segment, unnest(['small', 'large']) AS category FROM region) SELECT segment, category, n_name AS city, row_number() OVER (ORDER BY segment, category, n_name) - 1 AS combo FROM s CROSS JOIN nation""")
def exploded_combos(t):
    segments = t("region").select(F.col("r_name").alias("segment"), F.array(F.lit("small"), F.lit("large")).alias("category"))
    return tables.exploded(segments, "category", t("nation").select(F.col("n_name").alias("city")), ["segment", "category", "city"]).select("segment", "category", "city", "combo")


@query("""SELECT 'none' AS kind, n_name AS city, '' AS niche, row_number() OVER (ORDER BY n_name) - 1 AS combo FROM nation
  UNION ALL SELECT 'some', n_name, r_name, row_number() OVER (ORDER BY n_name, r_name) - 1 FROM nation CROSS JOIN region WHERE r_name > 'B' UNION ALL SELECT 'cities', '', r_name, row_number() OVER (ORDER BY r_name) - 1 FROM region""")
def default_combos(t):
    """Cities and niches where one side, the other, or none is empty and so counts as one default row."""
    cities, niches = t("nation").select(F.col("n_name").alias("city")), t("region").select(F.col("r_name").alias("niche"))
    sides = {"none": (cities, niches.where("niche is null")), "some": (cities, niches.where("niche > 'B'")), "cities": (cities.where("city is null"), niches)}
    each = [tables.combinations(*pair, ["city", "niche"], default="").select(F.lit(kind).alias("kind"), "city", "niche", "combo") for kind, pair in sides.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'N' || n_nationkey END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'own' ELSE 'custom' END AS kind FROM nation")
def overruled_names(t):
    own = t("nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.lit("own").alias("kind"))
    custom = own.withColumn("kind", F.lit("custom")).unionByName(t("nation").where("n_nationkey % 2 = 1").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name"), F.lit("custom").alias("kind")))
    return tables.overruled(own, custom, "name")


@query("""SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_partkey) AS n FROM part WHERE p_size <= 3 AND p_name <> '') WHERE n = 1""")
def searched_places(t):
    queries = t("part").select("p_brand").distinct().select(F.col("p_brand").alias("query"), F.col("p_brand").alias("seq"))
    results = t("part").select(F.col("p_brand").alias("query"), F.col("p_size").alias("page"), F.col("p_partkey").alias("rank"), F.col("p_name").alias("place_id"), "p_partkey")
    # each query's seq is its brand, so a name's first page and rank within the first brand count
    return tables.keep_first(tables.searched(queries, results.withColumn("page", F.when(F.col("page") <= 3, 1).otherwise(9))), ["place_id"], ["seq", "rank"]).select("p_partkey", F.col("place_id").alias("p_name"))


@query("""WITH j AS (SELECT user_id AS job, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS ok FROM events GROUP BY user_id)
  SELECT job, 3 * n + 2 AS events, ok AS done, n - ok AS failed, 3 * n + 1 AS last_seq, '{"total":' || n || ',"ok":' || ok || ',"found":' || ok || '}' AS summary FROM j""")
def enrichment_log(t):
    good = F.col("event_type") != "error"
    log = jobs.enrichment_log(t("events").select(F.col("user_id").alias("job"), F.col("event_id").alias("item"), good.alias("ok"), good.cast("int").alias("found"), F.lit("no").alias("error")))
    of = lambda e: F.count_if(F.col("event") == e)
    return log.groupBy("job").agg(F.count("*").alias("events"), of("lead_done").alias("done"), of("lead_error").alias("failed"), F.max("seq").alias("last_seq"), F.max(F.when(F.col("event") == "done", F.col("data"))).alias("summary"))


@query("""WITH k AS (SELECT user_id AS job, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS batch FROM events), n AS (SELECT job, count(*) AS total, count(*) FILTER (WHERE job % 3 = 0 OR batch < job % 4 + 1) AS processed FROM k GROUP BY job)
  SELECT job, CASE WHEN processed = total THEN 'completed' WHEN job % 3 = 1 THEN 'paused' ELSE 'stopped' END AS status, processed, total FROM n""")
def interrupted_runs(t):
    items = t("events").select(F.col("user_id").alias("job"), F.col("event_id").alias("item"))
    users = items.select("job").distinct().where("job % 3 <> 0")
    word = F.when(F.col("job") % 3 == 1, "pause").otherwise("stop")
    signals = users.select("job", (F.col("job") % 4 + 1).alias("batch"), word.alias("signal")).unionByName(users.select("job", F.lit(0).cast("long").alias("batch"), F.lit("odd").alias("signal")))
    return jobs.interrupted(items, signals, 10)[1].select("job", "status", "processed", "total")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'enriched' WHEN c_custkey % 5 = 0 THEN 'failed' ELSE 'pending' END AS enrichment_status FROM customer")
def guarded_batch(t):
    stored = t("customer").select(F.col("c_custkey").alias("id"), F.lit("pending").alias("enrichment_status"))
    return jobs.guarded(stored, stored.where("id % 5 = 0"), stored.where("id % 10 = 0").withColumn("enrichment_status", F.lit("enriched")))


@query("SELECT c_custkey AS id, c_custkey % 5 = 0 AS listed FROM customer")
def update_keys(t):
    c = t("customer").select(F.col("c_custkey").alias("id"), F.lit(False).alias("listed"))
    return tables.update_keys(c, "id", c.where("id % 5 = 0").select("id"), listed=True)


@query("SELECT c_custkey, CAST(floor(abs(c_acctbal)) % 40 * 0.3 * 22 * 100 AS BIGINT) AS missed, CAST(round(floor(abs(c_acctbal)) % 40 * 0.3 * 22 * 0.75 * 500 * 100) AS BIGINT) AS lost FROM customer")
def missed_calls(t):
    f = records.lost_calls(F.floor(F.abs("c_acctbal")) % 40, F.lit(0.3), F.lit(500.0), F.lit(99.0))
    return t("customer").select("c_custkey", f.alias("f")).select("c_custkey", F.floor(F.round(F.col("f.missed_month") * 100, 3)).cast("long").alias("missed"), F.round(F.col("f.lost_month") * 100).cast("long").alias("lost"))


@query("SELECT s_suppkey, CAST(least(100, 50 + 10 + CASE WHEN s_acctbal > 0 THEN 15 ELSE 0 END + CASE WHEN s_acctbal / 2000 >= 4 THEN 10 ELSE 0 END + CASE WHEN s_nationkey * 4 >= 50 THEN 5 WHEN s_nationkey * 4 >= 10 THEN 3 ELSE 0 END) AS INT) AS score, s_nationkey * 2 + 2.5 * 3 + 2 * 4 + 1.5 * 5 + 2 * 6 AS segment FROM supplier")
def record_scores(t):
    s = t("supplier")
    score = scoring.record_score(F.when(F.col("s_acctbal") > 0, "x"), "s_name", F.col("s_acctbal") / 2000, F.col("s_nationkey") * 4, F.lit(""))
    return s.select("s_suppkey", score.alias("score"), scoring.segment_score("s_nationkey", F.lit(3), F.lit(4), F.lit(5), F.lit(6)).cast("double").alias("segment"))


@query("SELECT n_name AS name, n_regionkey + 1 AS tier, n_nationkey AS score FROM nation WHERE n_regionkey + 1 <= 3 ORDER BY n_nationkey DESC, n_name LIMIT 7")
def dimension_tier(t):
    d = t("nation").select(F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).alias("tier"), F.col("n_nationkey").alias("score"))
    return filters.tier(d, 3, n=7)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Ann ' || c_name WHEN c_custkey % 3 = 0 THEN c_name ELSE 'mail' END AS name FROM customer")
def display_names(t):
    first, last = F.when(F.col("c_custkey") % 2 == 0, "Ann").otherwise(""), F.when((F.col("c_custkey") % 2 == 0) | (F.col("c_custkey") % 3 == 0), F.col("c_name"))
    return t("customer").select("c_custkey", records.display_name(first, last, F.lit("mail@x.test")).alias("name"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def overlaid_rows(t):
    c = t("customer").select("c_custkey", "c_mktsegment")
    session = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "new").otherwise("").alias("c_mktsegment"))
    return records.overlaid(c, session, "c_custkey", ["c_mktsegment"])


@query("SELECT p_partkey, lower(trim(regexp_replace(p_name, '(?i)[^a-z0-9]+', '_', 'g'), '_')) AS slug, lower(left(p_name, 1)) AS initial, len(string_split(p_type, ' ')) AS words FROM part")
def slugs(t):
    return t("part").select("p_partkey", values.slug("p_name").alias("slug"), F.substring(values.name_letters("p_name"), 1, 1).alias("initial"), F.size(values.listed("p_type", " ")).cast("long").alias("words"))


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS seq FROM customer JOIN nation ON c_nationkey = n_nationkey),
  p AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'Ann; Bo "B"' WHEN c_custkey % 3 = 1 THEN 'Cy' ELSE '' END AS names, CASE WHEN c_custkey % 3 = 0 THEN 'a@x.test' WHEN c_custkey % 3 = 1 THEN 'c@x.test' ELSE '' END AS mails,
    CASE WHEN c_custkey % 3 = 0 THEN 'Ann <a@x.test>; Bo "B"' WHEN c_custkey % 3 = 1 THEN 'Cy <c@x.test>' ELSE '' END AS whole FROM r)
  SELECT 0 AS seq, chr(65279) || 'Entreprise,Ville,Verticale,Email,Emails Dirigeants,Dirigeants,Dirigeants Detail,Telephone,Site Web,Score,Adresse' AS line UNION ALL
  SELECT seq, '"' || concat_ws('","', c_name, n_name, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey || '@x.test' ELSE '' END, mails, replace(names, '"', '""'), replace(whole, '"', '""'), '', '', CAST(floor(abs(c_acctbal) / 100) AS INT), '') || '"' FROM p""")
def csv_export(t):
    """An export of the list with its people: one mark and header, all values quoted."""
    none = F.lit(None).cast("string")
    several = F.array(F.struct(F.lit("Ann").alias("name"), F.lit("a@x.test").alias("email")), F.struct(F.lit('Bo "B"').alias("name"), none.alias("email")), F.struct(F.lit("").alias("name"), none.alias("email")))
    people = F.when(F.col("key") % 3 == 0, several)
    single = F.col("key") % 3 == 1
    leads = records.listed(_leads(t)).withColumn("key", F.col("id").cast("long"))
    rows = leads.withColumns(records.export_columns(people, F.when(single, "Cy"), F.when(single, "c@x.test")))
    columns = ["nom_entreprise", "ville", "verticale", "email", "emails_dirigeants", "dirigeants", "dirigeants_detail", "telephone", "site_web", "score", "adresse"]
    return files.csv_lines(rows, dict(zip(records.EXPORT, columns, strict=True)), ["key"])


@query("""SELECT event_id, CASE WHEN CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM events) THEN strftime(ts, '%H:%M') ELSE day(ts) || ' ' || ['janv.', 'févr.', 'mars', 'avr.', 'mai', 'juin', 'juil.', 'août', 'sept.', 'oct.', 'nov.', 'déc.'][month(ts)] || ', ' || strftime(ts, '%H:%M') END AS shown FROM events""")
def times_of_day(t):
    e = t("events").select("event_id", "ts")
    return e.crossJoin(e.agg(F.max("ts").alias("now"))).select("event_id", records.time_of_day("ts", "now").alias("shown"))  # one row


@query("""WITH p AS (SELECT p_brand, count(*) AS n, sum(p_size) AS u, count(*) FILTER (WHERE p_size = 1) AS e FROM part GROUP BY p_brand)
  SELECT '{"timestamp":"2024-01-01 00:00:00","total_uploaded":' || CAST(sum(u) AS BIGINT) || ',"total_errors":' || CAST(sum(e) AS BIGINT) || ',"by_verticale":{' || string_agg('"' || p_brand || '":' || n, ',' ORDER BY p_brand) || '},"campaign_id":"c","duration_seconds":1.3}' AS content FROM p""")
def upload_report(t):
    rows = t("part").withColumn("bad", (F.col("p_size") == 1).cast("int"))
    return stats.upload_report(rows, "p_brand", "p_size", "bad", "2024-01-01 00:00:00", "c", 1.25001)


@query("""SELECT conv_id || ':' || turn AS id, 'enriched' AS status, CAST(length(text) AS DOUBLE) AS confidence, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS people FROM conversations WHERE text IS NOT NULL""")
def stored_results(t):
    """Turns of conversations as the stored results of jobs, and what the reader makes of that JSON."""
    people = F.array(F.struct(F.when(F.col("role") == "user", F.col("role")).alias("name"), F.lit("x").alias("title"), F.lit(5).alias("email")))
    one = F.struct(F.concat_ws(":", "conv_id", "turn").alias("leadId"), F.lit("enriched").alias("status"), F.length("text").alias("confidence"), people.alias("decisionMakers"), F.col("text").alias("name"))
    jobs_ = t("conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.to_json(F.collect_list(one)).alias("results"))
    out = jobs_.select(F.explode(files.lead_results("results")).alias("r"))
    return out.select(F.col("r.leadId").alias("id"), "r.status", "r.confidence", F.size("r.decisionMakers").alias("people"))


@query("""WITH k AS (SELECT substr(text, 50, 7) AS w, min(doc_id) AS seq FROM documents WHERE length(text) > 56 GROUP BY 1) SELECT d.doc_id, min(k.seq) AS first FROM documents d LEFT JOIN k ON contains(d.text, k.w) GROUP BY d.doc_id""")
def many_keywords(t):
    """A few letters of each document as keywords, and the first of them that each document contains."""
    d = t("documents").select("doc_id", "text")
    words = d.where("length(text) > 56").select(F.col("doc_id").alias("seq"), F.substring("text", 50, 7).alias("keyword"))
    return keywords.first_keyword(d, "text", words).select("doc_id", "first")


@query("""SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%rod%' THEN 'metal' WHEN lower(p_name) LIKE '%plate%' THEN 'metal' WHEN lower(p_name) LIKE '%gear%' THEN 'machine' ELSE 'other' END AS segment FROM part""")
def segments_by_table(t):
    """theta_classify with its keywords in a table."""
    spark = t("part").sparkSession
    table = spark.createDataFrame([(0, "rod", "metal"), (1, "plate", "metal"), (2, "gear", "machine")], "seq long, keyword string, segment string")
    found = keywords.first_keyword(t("part").select("p_partkey", F.lower("p_name").alias("name")), "name", table)
    return found.join(table.withColumnRenamed("seq", "first"), "first", "left").select("p_partkey", F.coalesce("segment", F.lit("other")).alias("segment"))


@query("""WITH r AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part) SELECT p_brand AS query, CAST(n // 20 + 1 AS INT) AS page, CAST(n % 20 AS INT) AS rank, CAST(p_partkey AS VARCHAR) AS place_id FROM r WHERE n < 60 AND p_brand IN (SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 3)""")
def paged_search(t):
    """Three pages of twenty results for some brands, asked for page by page over a store of the parts; the other brands are not asked."""
    parts = t("part")
    spark = parts.sparkSession
    store = f"{tables.shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    parts.select(F.crc32("p_brand").alias("of"), place.alias("n"), F.col("p_partkey").cast("string").alias("place_id")).repartition("of").write.partitionBy("of").parquet(store)

    def fetch(query, token):
        import pyarrow.parquet as pq

        rows = pq.read_table(f"{store.removeprefix('file://')}/of={zlib.crc32(query.encode())}").sort_by("n").slice(int(token or 0), 20).to_pylist()
        return rows, str(int(token or 0) + 20) if len(rows) == 20 else None

    brands = [r[0] for r in parts.select("p_brand").distinct().orderBy("p_brand").collect()]  # the queries of the search: a few brands
    remote.register(spark, "parts_search", brands, {"place_id": "string"}, fetch)
    return spark.read.format("parts_search").load().where(F.col("query").isin(brands[:3])).select("query", "page", "rank", "place_id")


@query("""WITH n AS (SELECT c_custkey, c_name, c_acctbal, c_custkey % 7 = 0 AS changed FROM customer)
  SELECT c_custkey, CASE WHEN changed AND c_custkey % 2 = 0 THEN 'NEW' ELSE c_name END AS c_name, CASE WHEN changed THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, (SELECT count(*) FROM n WHERE changed) AS updated, (SELECT count(*) FROM n WHERE c_custkey % 100 = 0) AS inserted FROM n
  UNION ALL SELECT c_custkey + 1000000, 'Added', NULL, (SELECT count(*) FROM n WHERE changed), (SELECT count(*) FROM n WHERE c_custkey % 100 = 0) FROM n WHERE c_custkey % 100 = 0""")
def stored_merges(t):
    """A stored table after a sparse update and an insert of new keys, with what the two returned."""
    c = t("customer").select("c_custkey", "c_name", "c_acctbal")
    spark, path, schema = c.sparkSession, f"{tables.shared_folder(c.sparkSession)}/stored-{uuid.uuid4().hex}", "c_custkey long, c_name string, c_acctbal double"
    stored.create(c, path, "c_custkey", 8)
    changes = c.where("c_custkey % 7 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "NEW").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    updated = stored.merge(path, changes, "c_custkey", schema, "sparse")["updated"]
    more = c.where("c_custkey % 100 = 0").select(F.explode(F.array("c_custkey", F.col("c_custkey") + 1_000_000)).alias("c_custkey"), F.lit("Added").alias("c_name"))
    inserted = stored.merge(path, more, "c_custkey", schema, "ignore")["inserted"]
    return stored.read(spark, path, schema).withColumns({"updated": F.lit(updated).cast("long"), "inserted": F.lit(inserted).cast("long")})


@query("""WITH b AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 50 AS batch FROM customer), g AS (SELECT batch, count(*) AS rows, bool_and(c_custkey % 333 <> 0) AS good FROM b GROUP BY batch)
  SELECT batch, rows, CASE WHEN good THEN rows ELSE 0 END AS inserted, CASE WHEN good THEN 0 ELSE rows END AS failed, (SELECT CAST(sum(rows) AS BIGINT) FROM g WHERE good) AS stored FROM g""")
def appended_batches(t):
    """Batches appended to a stored table, those with a bad row not, and the same once more: nothing is added twice."""
    c = t("customer").select("c_custkey")
    spark, path = c.sparkSession, f"{tables.shared_folder(c.sparkSession)}/appended-{uuid.uuid4().hex}"
    stored.opened(spark, path)
    first = tables.kept(stored.append_once(c, path, "run", 50, ["c_custkey"], F.col("c_custkey") % 333 != 0))
    stored.append_once(c, path, "run", 50, ["c_custkey"], F.col("c_custkey") % 333 != 0)
    n = stored.appended_rows(spark, path, "c_custkey long").count()
    return first.withColumn("stored", F.lit(n).cast("long"))


@query("""SELECT user_id AS job, count(*) FILTER (WHERE event_type <> 'error') AS done, count(*) FILTER (WHERE event_type = 'error') AS failed, 3 * count(*) + 2 AS events, 3 * count(*) + 1 AS last_seq, 'done' AS status FROM events GROUP BY user_id""")
def chunked_log(t):
    """The logs of runs cut into chunks anywhere, decoded as a stream and reduced."""
    good = F.col("event_type") != "error"
    log = jobs.enrichment_log(t("events").select(F.col("user_id").alias("job"), F.col("event_id").alias("item"), good.alias("ok"), good.cast("int").alias("found"), F.lit("nö").alias("error")))
    whole = jobs.as_frames(log).groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "").alias("value"))
    spark, folder = log.sparkSession, f"{tables.shared_folder(log.sparkSession)}/stream-{uuid.uuid4().hex}"
    size, files = 1_009, max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = whole.withColumn("bytes", F.encode("value", "UTF-8")).select("job", "bytes", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("bytes") - 1) / size).cast("int"))).alias("chunk"))
    cut.select("job", F.col("chunk").cast("long").alias("chunk"), F.substring("bytes", F.col("chunk") * size + 1, F.lit(size)).alias("value")).repartition(files).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("job long, chunk long, value binary").option("maxFilesPerTrigger", -(-files // 2)).parquet(f"{folder}/in")
    events = chunks.decoded(stream)
    events.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(events.schema).parquet(f"{folder}/out")
    n = lambda e: F.count_if(F.col("event") == e)
    per = found.groupBy("job").agg(n("lead_done").alias("done"), n("lead_error").alias("failed"), F.count("*").alias("events"))
    return per.join(jobs.state(found).select("job", "last_seq", "status"), "job")


@query("""SELECT c_nationkey AS job, count(*) AS processed, count(*) FILTER (WHERE c_acctbal > 0) AS ok, 1 + 3 * count(*) + count(*) FILTER (WHERE c_custkey % 4 = 0) + 1 AS events, 'done' AS status, count(*) FILTER (WHERE c_custkey % 4 = 0) AS warnings FROM customer GROUP BY c_nationkey""")
def streamed_runs(t):
    """Runs over the customers of each nation as a stream of micro-batches that write their log."""
    c = t("customer").select(F.col("c_nationkey").cast("string").alias("job"), F.col("c_custkey").alias("item"), "c_acctbal")
    spark, folder = c.sparkSession, f"{tables.shared_folder(c.sparkSession)}/run-{uuid.uuid4().hex}"
    c.repartition(2).write.parquet(f"{folder}/in")
    items = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").select("job", "item")
    good = F.col("c_acctbal") > 0
    work = lambda rows: rows.join(c, ["job", "item"]).select("job", "item", good.alias("ok"), F.when(good, 1).alias("found"), F.when(~good, "no").alias("error"), F.when(F.col("item") % 4 == 0, "slow").alias("warning"))
    log = runs.run(items, c.groupBy("job").agg(F.count("*").alias("total")), f"{folder}/run", work)
    warned = log.groupBy("job").agg(F.count_if(F.col("event") == "db_warning").alias("warnings"), F.max(F.col("seq") + 1).alias("events"))
    return runs.jobs(spark, f"{folder}/run").drop("events").join(warned, "job").select(F.col("job").cast("int").alias("job"), "processed", "ok", "events", "status", "warnings")
