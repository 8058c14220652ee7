"""Event logs of jobs: decoding frames, and the latest state, as batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.tables import numbered
from millrace.sources import files


def parsed(whole: DataFrame, job: str = "job") -> DataFrame:
    """Events (job, seq, event, data) of whole frames (job, seq, frame): of several event or data lines the last counts; frames that lack either are left out."""
    last = lambda n: F.regexp_extract("frame", rf"(?:(?s:.*)\n|^){n}: ([^\n]*)", 1)
    return whole.select(job, F.col("seq").cast("long").alias("seq"), F.trim(last("event")).alias("event"), last("data").alias("data")).where("event <> '' AND data <> ''")


def frames(log: DataFrame, text: str = "value", job: str = "job") -> DataFrame:
    """Events of whole logs of server-sent frames: job, seq, event, data. What is behind the last blank line is no frame yet.

    Logs that come in chunks, which may cut frames anywhere, go through ``chunks.decoded``.
    """
    parts = F.split(text, "\n\n")
    return parsed(log.select(job, F.posexplode(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("seq", "frame")), job)


#: Events that end a run, and events that carry one result.
ENDS, RESULTS = ("done", "error", "stopped", "paused"), ("lead_done", "lead_error", "lead_result", "combo_done", "combo_error")


def results(events: DataFrame, job: str = "job") -> DataFrame:
    """The results that events append to their run, a row each: job, seq, and the fields of ``lead_result`` with the error of those that failed.

    Without shuffle and state, so a stream appends them as they come. Data that is no object, and a finished record without an id, is left out.
    """
    v = F.try_parse_json("data")
    failed = F.col("event").isin("lead_error", "combo_error")
    text = lambda n: F.when(F.schema_of_variant(F.try_variant_get(v, f"$['{n}']", "variant")) == "STRING", F.try_variant_get(v, f"$['{n}']", "string"))
    read = F.coalesce(files.lead_result(v), F.when(failed & F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), files.lead_result(F.try_parse_json(F.lit('{"leadId":""}')))))
    one = events.where(F.col("event").isin(*RESULTS)).select(job, "seq", "event", read.alias("r"), F.when(failed, text("error")).alias("error"))
    return one.where("r IS NOT NULL").select(job, "seq", "event", "r.*", "error")


def state(events: DataFrame, job: str = "job") -> DataFrame:
    """Per job: the latest progress, how many results and errors, whether it ended and how, the figures of its end. Works on a stream in complete or update mode.

    progress is the data of the latest progress event, percent 100 once a run is done; summary and sources come with the end,
    message with an error. Rows of one job are combined before the shuffle.
    """
    of = lambda *names: F.col("event").isin(*names)
    latest = lambda test, c: F.max_by(F.when(test, F.col(c)), F.when(test, F.col("seq")))
    end = of(*ENDS)
    out = events.groupBy(job).agg(
        latest(of("progress"), "data").alias("progress"),
        F.count_if(of("lead_done", "lead_result", "combo_done")).alias("results"),
        F.count_if(of("lead_error", "combo_error")).alias("errors"),
        F.coalesce(latest(end, "event"), F.lit("running")).alias("status"),
        F.max("seq").alias("last_seq"),
        latest(end, "data").alias("_end"),
        F.max_by(F.when(of("job_created"), F.col("data")), F.when(of("job_created"), F.col("seq"))).alias("_created"),
    )
    field = lambda c, n: F.get_json_object(c, f"$.{n}")
    number = lambda n: F.coalesce(field("_end", n), field("progress", n)).try_cast("double")
    percent = F.when(F.col("status") == "done", F.lit(100.0)).otherwise(number("percent"))
    figures = {"job_id": field("_created", "jobId"), "processed": number("processed"), "failed": number("failed"), "skipped": number("skipped"), "percent": percent}
    whole = out.withColumns({**figures, "summary": files.job_summary(field("_end", "summary")), "sources": files.source_map(field("_end", "sourceStats")), "message": F.when(F.col("status") == "error", field("_end", "message"))})
    return whole.drop("_end", "_created")


def resumed(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that a checkpoint doesn't list yet."""
    return items.join(done.select(key), key, "left_anti")


def restored(jobs: DataFrame, now: str, minutes: int = 10) -> DataFrame:
    """The job to show: the latest running one unless it is older than some minutes, else the latest paused, else completed."""
    fresh = F.col("created_at") > F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {minutes} MINUTES")
    rank = F.when((F.col("status") == "running") & fresh, 0).when(F.col("status") == "paused", 1).when(F.col("status") == "completed", 2)
    return jobs.withColumn("_r", rank).where("_r is not null").orderBy("_r", F.desc("created_at"), "id").limit(1).drop("_r")


def signalled(jobs: DataFrame, signals: DataFrame) -> DataFrame:
    """Jobs with pause or stop signals set, only while they run; the last of several signals (seq) counts."""
    last = signals.where(F.col("signal").isin("pause", "stop")).groupBy("id").agg(F.max_by("signal", "seq").alias("_s"))
    return jobs.join(last, "id", "left").withColumn("signal", F.when((F.col("status") == "running") & F.col("_s").isNotNull(), F.col("_s")).otherwise(F.col("signal"))).drop("_s")


def windowed_counts(events: DataFrame, time: str = "ts", size: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Counts by tumbling window with a watermark, batch or stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


# --- event logs that runs write --------------------------------------------------------------------------------


def _log(rows: DataFrame, job: str, order: list[str]) -> DataFrame:
    """Events (job, seq, event, data) numbered from 0 in the order of a job's steps, by ranges: a job may have any number of them."""
    return numbered(rows, job, order, "seq").select(job, F.col("seq").cast("long").alias("seq"), "event", "data")


def _event(name: str, at: int, **data) -> Column:
    return F.struct(F.lit(at).alias("at"), F.lit(name).alias("event"), F.to_json(F.struct(*(F.lit(v).alias(k) if not isinstance(v, Column) else v.alias(k) for k, v in data.items()))).alias("data"))


def run_log(items: DataFrame, start: str, done: str, failed: str, job: str = "job") -> DataFrame:
    """The event log of a run over items (job, item, ok, found, error) in the order of ``item``.

    job_created, for each item ``start``, then ``done`` or ``failed`` and a progress event in per cent, and done with
    totals. Items with a text in ``warning``, if there is such a column, have a db_warning too. A run over nothing is a single done
    event: see ``empty_run``. Runs that write their log as they go, and stop on a signal, are in ``runs``.
    """
    counted = items.groupBy(F.col(job).alias("_job")).agg(F.count("*").alias("_all"))
    steps = numbered(items, job, ["item"], "_n").withColumn("_n", F.col("_n") + 1)
    ran = steps.join(counted, steps[job] == counted["_job"]).drop("_job")
    percent = F.floor(F.col("_n") * 100 / F.col("_all") + 0.5).cast("int")
    ended = F.when(F.col("ok"), _event(done, 1, item=F.col("item"), found=F.col("found"))).otherwise(_event(failed, 1, item=F.col("item"), error=F.col("error")))
    warned = [F.when(F.col("warning").isNotNull(), _event("db_warning", 2, item=F.col("item"), error=F.col("warning")))] if "warning" in items.columns else []
    each = ran.select(job, F.col("_n").alias("_step"), F.inline(F.filter(F.array(_event(start, 0, item=F.col("item")), ended, *warned, _event("progress", 3, done=F.col("_n"), total=F.col("_all"), percent=percent)), lambda e: e.isNotNull())))
    per = items.groupBy(job).agg(F.count("*").alias("_all"), F.count_if("ok").alias("_ok"), F.coalesce(F.sum("found"), F.lit(0)).alias("_found"))
    first = per.select(job, F.lit(0).cast("long").alias("_step"), F.inline(F.array(_event("job_created", 0, total=F.col("_all")))))
    last = per.select(job, (F.col("_all") + 1).alias("_step"), F.inline(F.array(_event("done", 0, total=F.col("_all"), ok=F.col("_ok"), found=F.col("_found")))))
    return _log(first.unionByName(each).unionByName(last), job, ["_step", "at"])


def scrape_log(combos: DataFrame) -> DataFrame:
    return run_log(combos, "combo_start", "combo_done", "combo_error")


def enrichment_log(leads: DataFrame) -> DataFrame:
    return run_log(leads, "lead_start", "lead_done", "lead_error")


def export_log(steps: DataFrame) -> DataFrame:
    return run_log(steps, "step", "step_done", "step_error")


def empty_run(jobs: DataFrame, job: str = "job") -> DataFrame:
    """The log of runs that had nothing to do: a done event alone."""
    return jobs.select(job, F.lit(0).cast("long").alias("seq"), F.lit("done").alias("event"), F.to_json(F.struct(F.lit(0).alias("total"), F.lit(0).alias("ok"), F.lit(0).alias("found"))).alias("data"))


def as_frames(log: DataFrame, job: str = "job") -> DataFrame:
    """A log as server-sent frames, one text for each event: job, seq, value."""
    return log.select(job, "seq", F.concat(F.lit("event: "), "event", F.lit("\ndata: "), "data", F.lit("\n\n")).alias("value"))


def interrupted(items: DataFrame, signals: DataFrame, size: int, job: str = "job") -> tuple[DataFrame, DataFrame]:
    """What runs did before a pause or stop: (items processed, jobs with status, processed, total).

    Signals (job, batch, signal) are looked at before each batch of ``size`` items; the first one ends the run there and is
    cleared. Without one a run is completed.
    """
    batched = numbered(items, job, ["item"], "_n").withColumn("batch", F.floor(F.col("_n") / size)).drop("_n")
    first = signals.where(F.col("signal").isin("pause", "stop")).groupBy(job).agg(F.min(F.struct("batch", "signal")).alias("_s"))
    both = batched.join(first, job, "left")
    run = both.where(F.col("_s").isNull() | (F.col("batch") < F.col("_s.batch")))
    per = both.groupBy(job).agg(F.count("*").alias("total"), F.count_if(F.col("_s").isNull() | (F.col("batch") < F.col("_s.batch"))).alias("processed"), F.first("_s").alias("_s"))
    status = F.when(F.col("processed") == F.col("total"), "completed").when(F.col("_s.signal") == "pause", "paused").otherwise("stopped")
    return run.drop("_s"), per.select(job, status.alias("status"), "processed", "total", F.lit(None).cast("string").alias("signal"))


def guarded(stored: DataFrame, batch: DataFrame, done: DataFrame, key: str = "id", status: str = "enrichment_status") -> DataFrame:
    """Stored rows after a run of a batch: its rows are failed from the start, and what got done overwrites that."""
    tried = batch.select(F.col(key).alias("_tried")).distinct()
    ended = done.select(F.col(key).alias("_done"), F.col(status).alias("_status")).dropDuplicates(["_done"])
    out = stored.join(tried, F.col(key) == F.col("_tried"), "left").join(ended, F.col(key) == F.col("_done"), "left")
    return out.withColumn(status, F.coalesce("_status", F.when(F.col("_tried").isNotNull(), F.lit("failed")), F.col(status))).select(*stored.columns)
