"""Runs as streams: each micro-batch of items is worked on, its events are written once, signals are looked at before it.

A run's folder has ``events/batch=N`` (written over if the micro-batch comes again) and ``ledger/batch=N``, which is written
last: events of batches that the ledger has are the log, others don't exist yet. ``items/batch=N`` tells what was worked on.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.tables import kept, numbered
from millrace.streaming.jobs import _event

LEDGER = "job string, processed long, ok long, found long, events long, total long, status string, batch long"
EVENTS = "job string, seq long, event string, data string, batch long"
ITEMS = "job string, item string, batch long"
SIGNALS = "job string, signal string, seq long"
#: Batches of one attempt at most; a further attempt goes on with other numbers.
ATTEMPT = 1_000_000
STOPPED = {"pause": "paused", "stop": "stopped"}


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def opened(spark: SparkSession, folder: str, jobs: DataFrame) -> None:
    """A folder for runs of jobs (job, total), each with its job_created event. What is there already stays."""
    made = jobs.select(F.col("job").cast("string").alias("job"), F.col("total").cast("long").alias("total"))
    if not _exists(spark, f"{folder}/ledger/batch=-1/_SUCCESS"):
        spark.createDataFrame([], "job string, item string").write.mode("overwrite").parquet(f"{folder}/items/batch=-1")
        spark.createDataFrame([], SIGNALS).write.mode("append").parquet(f"{folder}/signals")
        created = made.select("job", F.lit(0).cast("long").alias("seq"), F.inline(F.array(_event("job_created", 0, jobId=F.col("job"), total=F.col("total"))))).drop("at")
        created.write.mode("overwrite").parquet(f"{folder}/events/batch=-1")
        zero = F.lit(0).cast("long")
        made.select("job", zero.alias("processed"), zero.alias("ok"), zero.alias("found"), F.lit(1).cast("long").alias("events"), "total", F.lit("running").alias("status")).write.mode("overwrite").parquet(f"{folder}/ledger/batch=-1")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def log(spark: SparkSession, folder: str) -> DataFrame:
    """The events of all batches that the ledger has: job, seq, event, data."""
    done = _read(spark, f"{folder}/ledger", LEDGER).select("batch").distinct()
    return _read(spark, f"{folder}/events", EVENTS).join(F.broadcast(done), "batch", "left_semi").select("job", "seq", "event", "data")


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Each job as the ledger has it: processed, ok, found, events (sums over its batches), total, status."""
    sums = [F.sum(c).alias(c) for c in ("processed", "ok", "found", "events")]
    return _read(spark, f"{folder}/ledger", LEDGER).groupBy("job").agg(*sums, F.max("total").alias("total"), F.max_by("status", "batch").alias("status"))


def signal(spark: SparkSession, folder: str, job: str, word: str) -> bool:
    """Ask a job to pause or stop; False, and nothing written, unless it runs. Other words are an error."""
    if word not in STOPPED:
        raise ValueError(f"{word} is no signal")
    if jobs(spark, folder).where((F.col("job") == job) & (F.col("status") == "running")).isEmpty():
        return False
    asked = _read(spark, f"{folder}/signals", SIGNALS)
    asked.agg(F.lit(job).alias("job"), F.lit(word).alias("signal"), (F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq")).write.mode("append").parquet(f"{folder}/signals")
    return True


def remaining(items: DataFrame, folder: str) -> DataFrame:
    """Items (job, item, ...) that no batch of the ledger has worked on: what a paused job goes on with."""
    spark = items.sparkSession
    committed = _read(spark, f"{folder}/ledger", LEDGER).select("batch").distinct()
    done = _read(spark, f"{folder}/items", ITEMS).join(F.broadcast(committed), "batch", "left_semi").select(F.col("job").alias("_job"), F.col("item").alias("_item"))
    return items.join(done, (items["job"].cast("string") == done["_job"]) & (items["item"].cast("string") == done["_item"]), "left_anti")


def resume(spark: SparkSession, folder: str, job: str, attempt: int) -> bool:
    """Let a paused job run again, as of a new attempt; its signal is cleared. False unless it is paused."""
    paused = kept(jobs(spark, folder).where((F.col("job") == job) & (F.col("status") == "paused")))
    if paused.isEmpty():
        return False
    asked = _read(spark, f"{folder}/signals", SIGNALS)
    asked.agg(F.lit(job).alias("job"), F.lit("none").alias("signal"), (F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq")).write.mode("append").parquet(f"{folder}/signals")
    _entries(paused, F.lit("running")).write.mode("overwrite").parquet(f"{folder}/ledger/batch={attempt * ATTEMPT - 1}")
    return True


def _entries(state: DataFrame, status: Column, **sums: Column) -> DataFrame:
    return state.select("job", *(sums.get(c, F.lit(0)).cast("long").alias(c) for c in ("processed", "ok", "found", "events")), "total", status.alias("status"))


def step(items: DataFrame, batch: int, folder: str, work: Callable[[DataFrame], DataFrame], words: tuple[str, str, str]) -> bool:
    """One micro-batch of items (job, item): its events and then its ledger entry. True while a job runs; a batch that the ledger has is passed over.

    Jobs with a signal end before the batch with a paused or stopped event that has their figures, the last signal counts. Items of
    jobs that run go through ``work``, a function to rows (job, item, ok, found, error, warning) with a row for each of them; a
    text in warning gives a db_warning. ``words``: the events of an item's start, success and failure.
    """
    spark = items.sparkSession
    if _exists(spark, f"{folder}/ledger/batch={batch}/_SUCCESS"):
        return not jobs(spark, folder).where("status = 'running'").isEmpty()
    state = kept(jobs(spark, folder))
    running = state.where("status = 'running'")
    asked = _read(spark, f"{folder}/signals", SIGNALS).groupBy("job").agg(F.max_by("signal", "seq").alias("signal")).where(F.col("signal").isin(*STOPPED))
    marked = running.join(asked, "job", "left")
    status = F.when(F.col("signal") == "pause", STOPPED["pause"]).otherwise(STOPPED["stop"])
    asked_to_end = kept(marked.where("signal IS NOT NULL"))
    given = marked.where("signal IS NULL").select("job", F.col("processed").alias("_before"), F.col("events").alias("_events"), F.col("total").alias("_total"))
    done = kept(work(items.select(F.col("job").cast("string").alias("job"), "item").join(given.select("job"), "job", "left_semi")))
    steps = numbered(done, "job", ["item"], "_n").join(given, "job")
    at = F.col("_before") + F.col("_n") + 1
    start, good, bad = words
    ended = F.when(F.col("ok"), _event(good, 1, item=F.col("item"), found=F.col("found"))).otherwise(_event(bad, 1, item=F.col("item"), error=F.col("error")))
    warned = F.when(F.col("warning").isNotNull(), _event("db_warning", 2, item=F.col("item"), error=F.col("warning")))
    progress = _event("progress", 3, processed=at, total=F.col("_total"), percent=F.floor(at * 100 / F.col("_total") + 0.5).cast("int"))
    each = steps.select("job", "_events", F.col("_n").alias("_step"), F.inline(F.filter(F.array(_event(start, 0, item=F.col("item")), ended, warned, progress), lambda e: e.isNotNull())))
    events = numbered(each, "job", ["_step", "at"], "_k").select("job", (F.col("_events") + F.col("_k")).cast("long").alias("seq"), "event", "data")
    figures = F.to_json(F.struct("processed", "total", "ok", F.struct("ok", "found").alias("summary")))
    ends = asked_to_end.select("job", F.col("events").alias("seq"), status.alias("event"), figures.alias("data"))
    events = kept(events.unionByName(ends))
    per = done.groupBy("job").agg(F.count("*").alias("processed"), F.count_if("ok").alias("ok"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"))
    written = events.groupBy("job").agg(F.count("*").alias("events"))
    worked = per.join(written, "job").join(given.select("job", "_total", "_before"), "job").withColumn("total", F.col("_total"))
    entries = _entries(worked, F.lit("running"), **{c: F.col(c) for c in ("processed", "ok", "found", "events")})
    entries = entries.unionByName(_entries(asked_to_end.drop("events"), status, events=F.lit(1)))
    done.select("job", F.col("item").cast("string").alias("item")).write.mode("overwrite").parquet(f"{folder}/items/batch={batch}")
    events.write.mode("overwrite").parquet(f"{folder}/events/batch={batch}")
    entries.write.mode("overwrite").parquet(f"{folder}/ledger/batch={batch}")
    return not jobs(spark, folder).where("status = 'running'").isEmpty()


def finished(spark: SparkSession, folder: str) -> None:
    """The done events of jobs that run and have all their items, as a last batch; a repeated call adds nothing."""
    now = jobs(spark, folder)
    ready = kept(now.where("status = 'running' AND processed >= total"))
    if ready.isEmpty():
        return
    batch = _read(spark, f"{folder}/ledger", LEDGER).agg(F.max("batch")).first()[0] + 1
    figures = F.to_json(F.struct("processed", "total", "ok", F.lit(100).alias("percent"), F.struct("ok", "found").alias("summary")))
    ready.select("job", F.col("events").alias("seq"), F.lit("done").alias("event"), figures.alias("data")).write.mode("overwrite").parquet(f"{folder}/events/batch={batch}")
    _entries(ready.drop("events"), F.lit("done"), events=F.lit(1)).write.mode("overwrite").parquet(f"{folder}/ledger/batch={batch}")


def run(items: DataFrame, jobs_: DataFrame, folder: str, work: Callable[[DataFrame], DataFrame], words: tuple[str, str, str] = ("lead_start", "lead_done", "lead_error"), attempt: int = 0, between: Callable[[int], None] | None = None) -> DataFrame:
    """Run a stream of items (job, item) to its end, or until all its jobs are paused or stopped, and return the log.

    Called again on the same folder and attempt it goes on where it ended: the stream's checkpoint is in the folder, too. Jobs that
    were paused go on, after ``resume``, as another attempt over the ``remaining`` items. ``between`` is called after each micro-batch,
    for tests and for whoever watches.
    """
    spark = items.sparkSession
    opened(spark, folder, jobs_)
    over = threading.Event()

    def batch(rows: DataFrame, number: int) -> None:
        if not over.is_set():
            more = step(rows, attempt * ATTEMPT + number, folder, work, words)
            if between:
                between(number)
            if not more:
                over.set()

    query = items.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint-{attempt}").trigger(availableNow=True).start()
    while query.isActive and not over.wait(0.2):
        pass
    if over.is_set():
        query.stop()
    query.awaitTermination()
    if not over.is_set():
        finished(spark, folder)
    return log(spark, folder)
