"""Files, filters, derived columns, job logs and updates on small tables, nulls and empty tables among them."""

import pytest
from millrace.functions import html, records, scoring, values
from millrace.operators import cascade, filters, stats, tables
from millrace.sources import files
from millrace.streaming import jobs
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_csv_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', ["x", "y"]), (2, None, [])], "id int, name string, tags array<string>")
    files.write_csv(df, f"{tmp_path}/out", {"tags": "|"})
    back = files.csv(spark, f"{tmp_path}/out", {"id": "int"}, {"tags": "|"}, line_breaks=True)
    assert [(r["id"], r["name"], r["tags"]) for r in back.orderBy("id").collect()][0] == (1, 'a "b", c', ["x", "y"])
    headers = {"Id": "id", "Name": "name", "Tags": "tags"}
    lines = [tuple(r) for r in files.csv_lines(df, headers, ["id"], {"tags": "; "}).orderBy("seq").collect()]
    assert lines == [(0, "\ufeffId,Name,Tags"), (1, '"1","a ""b"", c","x; y"'), (2, '"2","",""')]
    files.write_csv_export(df, f"{tmp_path}/export", headers, ["id"], {"tags": "; "})
    text = "".join(p.read_text() for p in sorted((tmp_path / "export").glob("part-*")))
    assert text == "".join(x + "\n" for _, x in lines)
    assert [r["line"] for r in files.csv_lines(df.limit(0), headers, ["id"], mark=False).collect()] == ["Id,Name,Tags"]
    (tmp_path / "odd.csv").write_text("id,name\n1,a\n2\n3,b,c\nx, d \n")
    odd = files.csv(spark, str(tmp_path / "odd.csv"), {"id": "int"})
    assert [(r["id"], r["name"]) for r in odd.collect()] == [(1, "a"), (2, None), (3, "b"), (None, "d")]
    assert {r["line"] for r in files.ragged(spark, str(tmp_path / "odd.csv")).collect()} == {"2", "3,b,c"}
    found = files.by_segment(spark.createDataFrame([("Salon de coiffure",), ("Garage",), (None,)], "category string"), {"salon": "beauty", "gar": "auto"})
    assert [r["segment"] for r in found.collect()] == ["beauty", "auto", "other"]


def test_json_columns(spark):
    text = '[{"name":"A","linkedin_url":"u","confidence":5},{"name":""},{"title":"x"}]'
    stored = '[{"leadId":"7","status":"odd","confidence":3.5,"sourcesTried":["a","b"],"decisionMakers":[{"name":"Zo","confidence":9,"email":4},{"title":"x"},5]},{"leadId":8},"x",{"leadId":"9","status":"failed","bestEmail":"e@x.test"}]'
    summary, sources = '{"totalEmails":3,"avgConfidence":"7","x":1}', '{"a":{"tried":2,"emailFound":"no"},"b":{"siretFound":1},"c":5,"d":null}'
    out = spark.createDataFrame([(text, summary, sources, stored), ("no", "no", "no", "no"), (None, None, None, None), ("{}", "[]", "{}", "{}")], "p string, s string, m string, r string")
    got = out.select(files.json_people("p").alias("p"), files.job_summary("s").alias("s"), files.source_map("m").alias("m"), files.lead_results("r").alias("r")).collect()
    assert [(x["name"], x["linkedinUrl"], x["email"], x["confidence"]) for x in got[0]["p"]] == [("A", "u", "", 5)] and list(got[1]["p"]) == [] and list(got[2]["p"]) == []
    assert tuple(got[0]["s"]) == (3, 0, 0, 0, 0, 0) and got[1]["s"] is None and got[2]["s"] is None
    assert {k: tuple(v) for k, v in got[0]["m"].items()} == {"a": (2, 0, 0, 0), "b": (0, 0, 0, 1)} and all(g["m"] is None for g in got[1:])
    a, b = got[0]["r"]
    assert (a["leadId"], a["status"], a["confidence"], a["sourcesTried"], b["leadId"], b["status"], b["bestEmail"]) == ("7", None, 3.5, ["a", "b"], "9", "failed", "e@x.test")
    assert [(p["name"], p["email"], p["source"], p["confidence"]) for p in a["decisionMakers"]] == [("Zo", None, "unknown", 9)] and list(b["decisionMakers"]) == [] and list(got[1]["r"]) == list(got[3]["r"]) == []
    items = spark.createDataFrame([("[1,2]",), ('{"items":[3]}',), ('{"a":1}',), ("bad",)], "v string").select(F.size(files.items("v")).alias("n"))
    assert [r["n"] for r in items.collect()][:3] == [2, 1, 1]


def test_filters(spark):
    df = spark.createDataFrame([(1, "pending", "a@x.test"), (2, None, ""), (3, "skipped", None), (4, "failed", "")], "id int, enrichment_status string, email string")
    ids = lambda test: [r["id"] for r in df.where(test).orderBy("id").collect()]
    assert [ids(filters.eligible(k)) for k in ("pending", "failed", "no_email", "all")] == [[1, 2], [3, 4], [2, 3, 4], [1, 2, 3, 4]]
    assert ids(filters.presence("email", True)) == [1] and ids(filters.presence("email", None)) == [1, 2, 3, 4]
    assert ids(filters.with_status("enrichment_status", "failed", ["failed"])) == [4] and len(ids(filters.with_status("enrichment_status", "odd", ["failed"]))) == 4
    assert ids(filters.listed_first(df, [2, 4], "id", F.lit(False))) == [2, 4] and ids(filters.listed_first(df, [], "id", F.col("id") == 1)) == [1]
    assert filters.page_number(0, 50, 9) == (1, 1) and filters.page_number(101, 50, 9) == (3, 3) and filters.clamp(None, 1, 5, 3) == 3 and filters.clamp(9, 1, 5, 3) == 5
    assert filters.one(df, "id", 3).count() == 1 and filters.one(df, "id", 9).count() == 0
    given = spark.createDataFrame([(1,), (9,)], "id int")
    assert [r["id"] for r in filters.unknown(given, df, "id").collect()] == [9]


def test_derived_columns(spark):
    df = spark.createDataFrame([(1, "", "g", None, "e@x.test", [("p@x.test", "deep_scrape", 60, "dirigeant"), ("k@x.test", "kaspr", 50, "dirigeant"), ("c@x.test", "x", 1, "global")]), (2, "s", None, "", None, [])], "id int, sg string, g string, e string, se string, a array<struct<email:string,source:string,confidence:int,type:string>>")
    shown = records.display_email("a", "sg", "g", "e", "se")
    assert [r[0] for r in df.orderBy("id").select(shown).collect()] == ["c@x.test", "s"]
    none = F.lit(None).cast("array<struct<email:string,source:string,confidence:int,type:string>>")
    people = F.from_json(F.lit('[{"email":""},{"email":"m@x.test"}]'), "array<struct<email:string>>")
    assert [r[0] for r in df.orderBy("id").select(records.personal_emails(none, "a", people, "e")).collect()] == [["k@x.test", "p@x.test"], ["m@x.test"]]
    assert [r[0] for r in df.orderBy("id").select(records.personal_emails("a", none, F.slice(people, 1, 1), F.lit("z"))).collect()] == [["k@x.test", "p@x.test"], ["z"]]
    at = spark.range(1).select(records.clock(F.lit(75.4)).alias("c"), records.local_time(F.lit("2024-07-01 12:00:00").cast("timestamp")).alias("t"), values.profile_guess(F.lit("Zoé Anne"), F.lit("d'Été")).alias("p"), values.profile_guess(F.lit("1"), F.lit("x")).alias("q")).first()
    assert tuple(at) == ("01:15", "01/07/2024 14:00:00", "https://www.linkedin.com/in/zoe-anne-dete", None)
    v = spark.range(1).select(scoring.verification(F.lit(True), F.lit(False), F.lit(None).cast("boolean"), F.lit(True), F.lit(False)).alias("v")).first()["v"]
    assert tuple(v) == (False, True, True)
    assert values.search_term("a%_(b),.\"'\\ ") == "ab" and spark.range(1).select(values.local_part_priority(F.lit("le.directeur@x.test"))).first()[0] == 1


def test_page_order(spark):
    ranked = html.ranked_emails(F.array(*map(F.lit, ["z@other.test", "info@x.test", "b@x.test", "a@sub.x.test"])), F.lit("x.test"))
    assert spark.range(1).select(ranked).first()[0] == ["b@x.test", "a@sub.x.test", "info@x.test", "z@other.test"]
    assert spark.range(1).select(html.ranked_emails(F.array().cast("array<string>"), F.lit("x.test"))).first()[0] == []


def test_updates_and_appends(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(7)], "id int, name string")
    out = tables.appended(df, f"{tmp_path}/t", 3, ["id"])
    assert rows(out) == [(0, 3), (1, 3), (2, 1)] and spark.read.parquet(f"{tmp_path}/t").count() == 7
    assert rows(tables.upsert(df.where("id < 2"), df.where("id = 1").withColumn("name", F.lit("new")), "id")) == [(0, "n0"), (1, "new")]
    assert rows(tables.union_keep_first([df.where("id < 2"), df.where("id = 2").withColumn("x", F.lit(1)).withColumn("name", F.lit("m"))], "name")) == [(0, "n0", None), (1, "n1", None), (2, "m", 1)]
    assert [r["name"] for r in tables.options(df.limit(2), "name", ["é", "f", "n1"]).collect()] == ["é", "f", "n0", "n1"]
    assert rows(tables.looked_up(df.where("id < 2"), "name", lambda k: k.withColumn("size", F.length("name")), "size")) == [("n0", 0, 2), ("n1", 1, 2)]
    late = spark.createDataFrame([(1, 400, "a"), (2, 10, "b")], "id int, ms int, email string")
    assert rows(tables.within(late, "ms", 300, ["email"])) == [(1, 400, None), (2, 10, "b")]
    with pytest.raises(ValueError):
        tables.combinations(df, df.withColumnsRenamed({"id": "i", "name": "n"}), ["id"], most=10)
    assert tables.combinations(df.limit(0), df.withColumnsRenamed({"id": "i", "name": "n"}), ["id"]).count() == 0
    assert rows(tables.payloads(tables.batches(df, 4, ["id"]), "batch", "seq", ["id"]).select("batch", "size")) == [(0, 4), (1, 3)]
    hit = tables.first_hit(df.where("id < 3"), [(spark.createDataFrame([(1, "a")], "id int, v string"), ["id"]), (spark.createDataFrame([("n0", "b"), ("n1", "c")], "name string, v string"), ["name"])], "v")
    assert sorted((r["id"], r["v"]) for r in hit.collect()) == [(0, "b"), (1, "a"), (2, None)]


def test_persisted(spark):
    stored = spark.createDataFrame([(1, "pending", 1, None, None, "old@x.test", ["p"]), (2, "pending", None, "was", 7, None, []), (3, "pending", None, None, None, None, []), (4, "pending", 2, None, None, None, ["p"])], "id int, enrichment_status string, enrichment_attempts int, enrichment_source string, enrichment_confidence int, email string, decision_makers array<string>")
    found = spark.createDataFrame([(1, "new@x.test", None, None, None, ["a", "b"], 80), (2, None, None, None, None, ["a"], 30), (4, None, "", None, None, ["a"], 30)], "id int, best_email string, best_phone string, registration string, officer string, tried array<string>, confidence int")
    short = lambda df: [tuple(r)[:6] for r in df.orderBy("id").collect()]
    assert short(cascade.persisted(stored, found)) == [(1, "enriched", 2, "a,b", 80, "new@x.test"), (2, "failed", 1, "was", 7, None), (3, "pending", 0, None, None, None), (4, "enriched", 3, None, None, None)]
    assert short(cascade.persisted(stored, found, always=True)) == [(1, "enriched", 1, "a,b", 80, "new@x.test"), (2, "failed", 0, "a", 0, None), (3, "pending", 0, None, None, None), (4, "enriched", 2, "a", 0, None)]


def test_logs_of_runs(spark):
    items = spark.createDataFrame([("j", 1, True, 2, None), ("j", 2, False, None, "boom"), ("k", 5, True, 0, None)], "job string, item int, ok boolean, found int, error string")
    log = jobs.scrape_log(items)
    j = [(r["seq"], r["event"], r["data"]) for r in log.where("job = 'j'").orderBy("seq").collect()]
    assert [e for _, e, _ in j] == ["job_created", "combo_start", "combo_done", "progress", "combo_start", "combo_error", "progress", "done"] and [s for s, *_ in j] == list(range(8))
    assert j[2][2] == '{"item":1,"found":2}' and j[5][2] == '{"item":2,"error":"boom"}' and j[6][2] == '{"done":2,"total":2,"percent":100}' and j[7][2] == '{"total":2,"ok":1,"found":2}'
    # a log written as frames, decoded and reduced is the state of the run
    text = jobs.as_frames(log).groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "").alias("value"))
    state = {r["job"]: r for r in jobs.state(jobs.frames(text)).collect()}
    assert (state["j"]["status"], state["j"]["results"], state["j"]["last_seq"]) == ("done", 1, 7)
    assert jobs.export_log(items.limit(0)).count() == 0
    assert [tuple(r) for r in jobs.empty_run(items.select("job").distinct().where("job = 'k'")).collect()] == [("k", 0, "done", '{"total":0,"ok":0,"found":0}')]
    signals = spark.createDataFrame([("j", 1, "pause")], "job string, batch int, signal string")
    ran, ended = jobs.interrupted(items, signals, 1)
    assert rows(ended) == [("j", "paused", 1, 2, None), ("k", "completed", 1, 1, None)] and ran.count() == 2
    table = spark.createDataFrame([(1, "running", None, "2024-01-01 10:00:00"), (2, "running", None, "2024-01-01 08:00:00"), (3, "paused", None, "2024-01-01 07:00:00")], "id int, status string, signal string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    assert jobs.restored(table, "2024-01-01 10:05:00").first()["id"] == 1 and jobs.restored(table, "2024-01-01 12:00:00").first()["id"] == 3
    asked = spark.createDataFrame([(1, "pause", 1), (1, "stop", 2), (3, "stop", 1), (2, "odd", 1)], "id int, signal string, seq int")
    assert [r["signal"] for r in jobs.signalled(table, asked).orderBy("id").collect()] == ["stop", None, None]


def test_reports(spark):
    df = spark.createDataFrame([("a", 3, 0), ("b", 1, 1), ("a", 2, None)], "segment string, sent int, bad int")
    assert [tuple(r) for r in stats.segment_report(df, "segment", "sent", "bad").collect()] == [("a", '{"leads":2,"uploaded":5,"errors":0}'), ("b", '{"leads":1,"uploaded":1,"errors":1}')]
    assert records.totals(df.limit(0), ["sent"]).first()["sent"] == 0 and tables.upload_totals(df.limit(0), "sent", "sent", "bad").first()["uploaded"] == 0
    assert stats.estimate(spark.createDataFrame([(["x", "y"],), (["z"],)], "c array<string>"), "c", 10).first()["records"] == 360
