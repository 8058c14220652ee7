import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import html, scoring, values
from millrace.operators import cascade, stats, tables
from millrace.streaming import jobs


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "raw, out",
    [("  A.B@Firm.Fr ", "a.b@firm.fr"), ("x@example.com", None), ("noreply@firm.fr", None), ("a@b", None), ("", None), (None, None), ("a" * 250 + "@f.fr", None), ("a@sub.example.com", "a@sub.example.com")],
)
def test_valid_email(spark, raw, out):
    assert value(spark, values.valid_email(F.lit(raw).cast("string"))) == out


@pytest.mark.parametrize("raw, out", [("https://www.Firm.fr/x?y", "firm.fr"), ("firm.fr", "firm.fr"), ("http://m.firm.fr:80/", "m.firm.fr"), ("", None)])
def test_domain(spark, raw, out):
    assert value(spark, values.domain(F.lit(raw))) == out


@pytest.mark.parametrize("x, out", [(-2.5, -2), (2.5, 3), (2.4, 2)])
def test_halves_go_up(spark, x, out):
    assert value(spark, values.round_half_up(F.lit(x))) == out


def test_names_and_permutations(spark):
    assert value(spark, values.slug(F.lit("Élan & Cœur, SA"))) == "elan_c_ur_sa"
    assert value(spark, values.name_letters(F.lit("D'Été-Noël"))) == "detenoel"
    assert list(value(spark, values.permutations(F.lit("Jean"), F.lit("Dupont"), F.lit("x.test"))))[:3] == ["jean.dupont@x.test", "jean@x.test", "j.dupont@x.test"]
    assert list(value(spark, values.permutations(F.lit(""), F.lit("Dupont"), F.lit("x.test")))) == []
    assert value(spark, values.parsed_name(F.lit("  Salon  Belle Vie ")))["lastName"] == "Belle Vie"
    assert value(spark, values.first_name(F.lit(None).cast("string"))) == "Contact"


def test_page_extraction(spark):
    page = "<script>a@b.fr</script><a href='mailto:Jo@firm.fr'>x</a> info [at] firm (dot) fr &#64; <a href='tel:+33 1 02 03 04 05'> SIRET : 123 456 789 00012"
    assert list(value(spark, html.emails(html.decoded(F.lit(page))))) == ["jo@firm.fr", "a@b.fr", "info@firm.fr"]
    assert list(value(spark, html.phones(F.lit(page)))) == ["+33102030405"]
    assert value(spark, html.registration(F.lit(page))) == "12345678900012"
    assert value(spark, html.decoded(F.lit("a&#64;b &#x41; &amp;lt;"))) == "a@b A <"
    ld = """<script type="application/ld+json">{"@type":"Store","email":"a@x.test"}</script><script type="application/ld+json">{bad</script>"""
    assert value(spark, html.entity_field(html.json_ld(F.lit(ld))[0], "$.mail", "$.email")) == "a@x.test"


def results(spark, rows):
    return spark.createDataFrame(rows, "id int, priority int, source string, email string, phone string, registration string, officer string, verified boolean, has_mx boolean")


def records(spark, email=None):
    return spark.createDataFrame([(1, "x.test", email, 50, "Ann", "Bee")], "id int, domain string, email string, score int, first_name string, last_name string")


def row(priority, source, email=None, phone=None, reg=None, officer=None, mx=None):
    return (1, priority, source, email, phone, reg, officer, False, mx)


def test_cascade_stops_when_confident_and_known(spark):
    out = cascade.enrich(records(spark), results(spark, [row(0, "dns_intel", mx=True), row(1, "schema_org"), row(2, "deep_scrape", "contact@x.test"), row(3, "sirene", reg="1")])).first()
    assert (list(out["tried"]), out["confidence"], out["best_email"]) == (["dns_intel", "schema_org", "deep_scrape"], 85, "contact@x.test")


def test_cascade_without_mail_hosts(spark):
    rows = [row(0, "dns_intel", mx=False), row(1, "schema_org"), row(2, "deep_scrape"), row(3, "sirene", reg="1", officer="A"), row(4, "google_dork", "z@x.test"), row(5, "linkedin_search"), row(6, "kaspr", "a.b@x.test"), row(7, "email_permutation", "q@x.test")]
    out = cascade.enrich(records(spark), results(spark, rows)).first()
    assert (list(out["tried"]), out["confidence"], out["best_email"]) == (["dns_intel", "schema_org", "deep_scrape", "sirene", "linkedin_search", "kaspr"], 100, "a.b@x.test")


def test_cascade_with_a_known_address_and_no_results(spark):
    out = cascade.enrich(records(spark, "old@x.test"), results(spark, [row(0, "dns_intel"), row(1, "schema_org"), row(2, "deep_scrape", "n@x.test")])).first()
    assert (list(out["tried"]), out["best_email"]) == (["dns_intel", "schema_org"], None)
    assert cascade.enrich(records(spark), results(spark, [])).first()["tried"] == []


def test_early_stops_run_over_all_results(spark):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        mails = [None, "", "a@x.test", "A@x.test", "b@x.test"] if i % 4 else [None, ""]
        rows += [(i, k, rng.choice(mails[: 2 if k < 9 else 5]), rng.choice([None, 20, 55, 65, 70, 100])) for k in range(rng.randint(1, 60))]
    want = {}
    for i, k, e, c in rows:
        n, top, seen, again, over, at = want.get(i, (0, 0, (), False, False, 0))
        if not over:
            again = again or bool(e) and e.lower() in seen
            seen, top = seen + ((e.lower(),) if e else ()), max(top, c or 0)
            at = min(100, top + 20 * again)
            want[i] = (n + 1, top, seen, again, bool(seen) and at >= 80, at)
    shuffled = spark.createDataFrame(rng.sample(rows, len(rows)), "id int, k int, email string, confidence int")
    out = {r["id"]: (r["tried"], r["confidence"], r["stopped"]) for r in cascade.early_stops(shuffled, ["k"]).collect()}
    assert out == {i: (w[0], w[5], w[4]) for i, w in want.items()}
    assert any(n > 8 and stopped for n, _, stopped in out.values()) and cascade.early_stops(shuffled.limit(0), ["k"]).count() == 0


def test_early_stop_query_has_no_cap(spark):
    from millrace.plans import registry

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("event_id").collect()
    points, want = {"purchase": 90, "click": 100, "view": 65, "signup": 55}, {}
    for e in events:
        n, top, clicks, over = want.get(e["user_id"], (0, 0, 0, False))
        if not over:
            top, clicks = max(top, points.get(e["event_type"], 30)), clicks + (e["event_type"] == "click")
            want[e["user_id"]] = (n + 1, top, clicks, clicks > 0 and top + 20 * (clicks > 1) >= 80)
    out = {r["id"]: (r["tried"], r["confidence"], r["stopped"]) for r in registry.QUERIES["cascade_early_stop"](spark, "/root/testdata/sf0.001").collect()}
    assert out == {u: (n, min(100, top + 20 * (clicks > 1)), over) for u, (n, top, clicks, over) in want.items()}


def test_people_merge(spark):
    people = F.from_json(F.lit('[{"name":"Zoé A","source":"a","confidence":3},{"name":" zoe a","email":"z@x.test","source":"b","confidence":1},{"name":""}]'), "array<struct<name:string,email:string,phone:string,linkedin:string,source:string,confidence:int>>")
    out = value(spark, cascade.merged_people(people))
    assert [(p["email"], p["source"], p["confidence"]) for p in out] == [("z@x.test", "b", 3)]


def test_scores(spark):
    assert value(spark, scoring.place_score(F.lit("w"), F.lit(""), F.lit(3.9), F.lit(50), F.lit(None).cast("string"))) == 68
    assert value(spark, scoring.record_score(F.lit("p"), F.lit("w"), F.lit(4.0), F.lit(10), F.lit("e"))) == 98


def test_tables(spark):
    df = spark.createDataFrame([(1, "a", "x@f.fr"), (2, "a", "x@f.fr "), (3, "", "bad"), (4, "", None)], "seq int, k string, email string")
    assert {r["seq"] for r in tables.keep_first(df, ["k"], ["seq"], F.col("k") == "").collect()} == {1, 3, 4}
    assert tuple(tables.email_statistics(df, "email").first()) == (1, 1, 2)
    assert sorted((r["seq"], r["batch"]) for r in tables.batches(spark.range(7).withColumnRenamed("id", "x"), 3, ["x"]).collect()) == [(i, i // 3) for i in range(7)]
    assert stats.rates(df, "k", F.col("email").isNotNull()).first()["total"] == 2


def test_event_log_as_batch_and_stream(spark, tmp_path):
    log = "event: progress\ndata: 1\n\nevent: lead_done\ndata: x\n\nevent: done\ndata: {}\n\nevent: cut"
    src = str(tmp_path / "log")
    spark.createDataFrame([("j", log)], "job string, value string").write.parquet(src)
    batch = jobs.state(jobs.frames(spark.read.parquet(src))).collect()
    stream = jobs.state(jobs.frames(spark.readStream.schema("job string, value string").parquet(src)))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert batch == spark.table("states").collect() and batch[0]["status"] == "done" and batch[0]["results"] == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
