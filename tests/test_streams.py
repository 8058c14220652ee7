"""Chunked logs and runs as streams: any cut gives the same rows, replays and restarts write nothing twice, signals end runs between batches."""

import json
import random

import pandas as pd
import pytest
from millrace.operators import tables
from millrace.streaming import chunks, jobs, runs
from pyspark.sql import functions as F


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


def stream(df, schema, path, files=1):
    return df.sparkSession.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(rows, folder, name):
    query = rows.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")


def test_numbers_within_parts(spark):
    df = spark.range(1000).selectExpr("IF(id % 3 = 0, NULL, IF(id < 900, 'hot', 'j' || id)) AS job", "1000 - id AS item")
    got = {(r["job"], r["item"]): r["n"] for r in tables.numbered(df, "job", ["item"], "n").collect()}
    by = {}
    for job, item in sorted(((r["job"], r["item"]) for r in df.collect()), key=lambda x: x[1]):
        by.setdefault(job, []).append(item)
    assert got == {(job, item): n for job, own in by.items() for n, item in enumerate(own)} and len(by[None]) > 300


def test_any_cut_of_a_log_gives_the_same_events(spark, tmp_path):
    rng = random.Random(4)
    logs = {"a": "", "b": ": comment\n\nevent: x\n\ndata: only\n\nevent: one\ndata: é日\n\n", "c": "event: done\ndata: {}\n\nevent: late\ndata: {}\n\n", "d": "event: a\nevent: b \ndata: 1\ndata: 2\n\nevent: cut\ndata: off"}
    for i in range(60):
        logs["a"] += f'event: lead_done\ndata: {{"leadId":"é{i}","name":"日本"}}\n\n' + ("\n\n" if i % 7 == 0 else "")
    parts = []
    for job, text in logs.items():
        raw, at, n = text.encode(), 0, 0
        while at < len(raw):
            to = min(len(raw), at + rng.randint(1, 40))
            parts.append((job, n, raw[at:to]))
            at, n = to, n + 1
    rng.shuffle(parts)
    parts += parts[:9]  # some come again
    for k in range(4):
        spark.createDataFrame(parts[k::4], "job string, chunk long, value binary").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = chunks.decoded(stream(spark.range(1), "job string, chunk long, value binary", f"{tmp_path}/in"))
    got = tuples(drained(rows, tmp_path, "out"))
    whole = spark.createDataFrame(list(logs.items()), "job string, value string")
    want = [r for r in tuples(jobs.frames(whole)) if not (r[0] == "c" and r[2] == "late")]
    assert got == want and len(got) == 63 and ("d", 0, "b", "2") in got
    # a stream started again from its checkpoint keeps what it has
    more = 'event: again\ndata: 1\n\nevent: half\nda'.encode()
    last = max(n for j, n, _ in parts if j == "a")
    spark.createDataFrame([("a", last + 2, b"ta: 2\n\n"), ("a", last + 1, more)], "job string, chunk long, value binary").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    again = chunks.decoded(stream(spark.range(1), "job string, chunk long, value binary", f"{tmp_path}/in"))
    assert [r[2:] for r in tuples(drained(again, tmp_path, "out")) if r[0] == "a" and r[2] in ("again", "half")] == [("again", "1"), ("half", "2")]


class Counted:
    """A state variable of a processor that counts the calls to it."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value if self.value is None or isinstance(self.value, tuple) else iter(self.value)

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def put(self, values):
        self.calls, self.value = self.calls + 1, list(values)

    def appendList(self, values):
        self.calls, self.value = self.calls + 1, [*(self.value or []), *values]

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def containsKey(self, key):
        self.calls += 1
        return key in dict(self.value or [])

    def getValue(self, key):
        self.calls += 1
        return dict(self.value)[key]

    def updateValue(self, key, value):
        self.calls, self.value = self.calls + 1, [*((k, v) for k, v in self.value or [] if k != key), (key, value)]

    def removeKey(self, key):
        self.calls, self.value = self.calls + 1, [(k, v) for k, v in self.value if k != key]


def test_chunks_that_wait_take_few_calls_to_the_state():
    kept = {}
    handle = type("Handle", (), {n: lambda self, name, *_: kept.setdefault(name, Counted()) for n in ("getValueState", "getListState", "getMapState")})()
    frames = chunks.Frames(None)
    frames.init(handle)
    text = b"".join(b"event: x\ndata: %d\n\n" % i for i in range(1_000))
    cut = [(n, text[at : at + 11]) for n, at in enumerate(range(0, len(text), 11))]
    random.Random(1).shuffle(cut)
    cut.sort(key=lambda c: c[0] == 0)  # the first chunk comes last
    k, got = len(cut) // 3, []
    for part in (cut[:k], cut[:k], cut[k : 2 * k], cut[2 * k :], cut):  # some come again, waiting or done
        rows = pd.DataFrame({"chunk": [c for c, _ in part], "bytes": [b for _, b in part]})
        got += [f for df in frames.handleInputRows(("a",), iter([rows]), None) for f in zip(df["seq"], df["frame"], strict=True)]
    assert got == [(i, f"event: x\ndata: {i}") for i in range(1_000)]
    assert sum(v.calls for v in kept.values()) < 30 and not kept["waiting"].value


def test_results_and_state_of_events(spark):
    ended = {"summary": {"totalEmails": 2}, "sourceStats": {"dns": {"tried": 3}}, "failed": 1, "skipped": 2}
    events = [("a", 0, "job_created", '{"jobId":"J"}'), ("a", 1, "lead_done", '{"leadId":"1","status":"enriched","confidence":7}'), ("a", 2, "progress", '{"processed":1,"percent":50,"failed":0}'), ("a", 3, "lead_error", '{"leadId":"2","status":"failed","error":"no"}'), ("a", 4, "lead_done", "bad"), ("a", 5, "done", json.dumps(ended)), ("b", 0, "error", '{"message":"boom"}'), ("c", 0, "paused", '{"processed":4,"percent":30}'), ("d", 0, "progress", '{"percent":10}'), (None, 0, "lead_result", '{"leadId":"9"}')]
    df = spark.createDataFrame(events, "job string, seq long, event string, data string")
    got = [(r["job"], r["leadId"], r["status"], r["confidence"], r["error"]) for r in jobs.results(df).orderBy("job", "seq").collect()]
    assert got == [(None, "9", None, 0, None), ("a", "1", "enriched", 7, None), ("a", "2", "failed", 0, "no")]
    s = {r["job"]: r for r in jobs.state(df).collect()}
    assert (s["a"]["status"], s["a"]["percent"], s["a"]["failed"], s["a"]["processed"], s["a"]["job_id"], s["a"]["summary"]["totalEmails"], s["a"]["sources"]["dns"]["tried"]) == ("done", 100, 1, 1, "J", 2, 3)
    assert (s["b"]["status"], s["b"]["message"], s["c"]["status"], s["c"]["percent"], s["d"]["status"], s["d"]["percent"]) == ("error", "boom", "paused", 30, "running", 10)


def work(items):
    bad, odd = F.col("item") % 5 == 0, F.col("item") % 4 == 0
    return items.select("job", "item", (~bad).alias("ok"), F.when(~bad, F.lit(1)).alias("found"), F.when(bad, F.lit("no")).alias("error"), F.when(odd, F.lit("slow")).alias("warning"))


@pytest.fixture
def items(spark, tmp_path):
    for k in range(3):
        rows = [("j", i) for i in range(k * 10, k * 10 + 10)] + [("k", 100 + k)]
        spark.createDataFrame(rows, "job string, item long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/items")
    return lambda: stream(spark.range(1), "job string, item long", f"{tmp_path}/items")


def totals(spark, **more):
    return spark.createDataFrame(list({"j": 30, "k": 3, **more}.items()), "job string, total long")


def checked(log):
    """Each job's events, numbered without gaps."""
    by = {}
    for job, seq, event, data in sorted(map(tuple, log.collect())):
        own = by.setdefault(job, [])
        assert seq == len(own)
        own.append((event, json.loads(data)))
    return by


def test_a_run_writes_its_log_once(spark, tmp_path, items):
    folder = f"{tmp_path}/run"
    log = runs.run(items(), totals(spark), folder, work)
    by = checked(log)
    assert [e for e, _ in by["k"]] == ["job_created", *["lead_start", "lead_error", "db_warning", "progress"], *["lead_start", "lead_done", "progress"] * 2, "done"]
    done = [d["item"] for e, d in by["j"] if e in ("lead_done", "lead_error")]
    assert sorted(done) == list(range(30)) and by["j"][-1] == ("done", {"processed": 30, "total": 30, "ok": 24, "percent": 100, "summary": {"ok": 24, "found": 24}})
    assert [d["percent"] for e, d in by["j"] if e == "progress"][-1] == 100
    assert tuples(runs.run(items(), totals(spark), folder, work)) == tuples(log)  # nothing new comes, nothing is written
    # batches that come again are passed over, whole or half written
    before = tuples(log)
    first = spark.createDataFrame([("j", 0)], "job string, item long")
    assert runs.step(first, 0, folder, work, ("lead_start", "lead_done", "lead_error")) is False and tuples(runs.log(spark, folder)) == before
    first.select(F.lit("j").alias("job"), F.lit(7).cast("long").alias("seq"), F.lit("x").alias("event"), F.lit("{}").alias("data")).write.parquet(f"{folder}/events/batch=99")
    assert tuples(runs.log(spark, folder)) == before  # events without a ledger entry don't exist


def test_a_run_that_breaks_off_goes_on(spark, tmp_path, items):
    folder, broken = f"{tmp_path}/run", []

    def fails(rows):
        if not broken and rows.where("item = 12").count():
            broken.append(1)
            raise RuntimeError("lost")
        return work(rows)

    with pytest.raises(Exception, match="lost"):
        runs.run(items(), totals(spark), folder, fails)
    by = checked(runs.log(spark, folder))
    assert [d["item"] for e, d in by["j"] if e == "lead_start"] != [] and by["j"][-1][0] == "progress"
    by = checked(runs.run(items(), totals(spark), folder, fails))
    assert sorted(d["item"] for e, d in by["j"] if e == "lead_start") == list(range(30)) and by["j"][-1][0] == by["k"][-1][0] == "done"


def test_signals_between_batches(spark, tmp_path, items):
    folder = f"{tmp_path}/run"

    def ask(number):
        if number == 0:
            assert runs.signal(spark, folder, "j", "stop") and runs.signal(spark, folder, "j", "pause")  # the last one counts
        if number == 1:
            assert not runs.signal(spark, folder, "j", "stop")  # it no longer runs

    with pytest.raises(ValueError):
        runs.signal(spark, folder, "j", "halt")
    by = checked(runs.run(items(), totals(spark), folder, work, between=ask))
    assert by["j"][-1][0] == "paused" and by["j"][-1][1]["processed"] == 10 and by["j"][-1][1]["summary"] == {"ok": 8, "found": 8} and by["k"][-1][0] == "done"
    state = {r["job"]: r["status"] for r in runs.jobs(spark, folder).collect()}
    assert state == {"j": "paused", "k": "done"} and not runs.resume(spark, folder, "k", 1)
    left = runs.remaining(spark.read.parquet(f"{tmp_path}/items"), folder)
    assert left.count() == 20 and runs.resume(spark, folder, "j", 1)
    left.coalesce(1).write.parquet(f"{tmp_path}/left")
    by = checked(runs.run(stream(left, "job string, item long", f"{tmp_path}/left"), totals(spark), folder, work, attempt=1))
    assert sorted(d["item"] for e, d in by["j"] if e == "lead_start") == list(range(30)) and by["j"][-1][0] == "done" and [e for e, _ in by["j"]].count("paused") == 1
    stopped = f"{tmp_path}/stopped"
    by = checked(runs.run(items(), totals(spark), stopped, work, between=lambda n: n == 0 and [runs.signal(spark, stopped, j, "stop") for j in "jk"]))
    assert by["j"][-1][0] == by["k"][-1][0] == "stopped" and runs.jobs(spark, stopped).where("status = 'stopped' AND processed < total").count() == 2
