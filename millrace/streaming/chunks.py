"""Logs that come in chunks: a stateful stream that keeps the unfinished frame of each job between chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.streaming.jobs import ENDS, parsed

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _event(frame: bytes) -> str:
    """The event of a frame: of several lines the last one counts."""
    lines = [line[7:] for line in frame.split(b"\n") if line.startswith(b"event: ")]
    return lines[-1].decode("utf-8", "replace").strip() if lines else ""


class Frames(StatefulProcessor):
    """Whole frames of each job's bytes, in order. State: the bytes behind the last frame, how many frames and chunks there were, whether
    the job ended; chunks that came before those in front of them wait. What comes again or behind the end is passed over.

    Each call to the state is a message to Spark, so chunks that wait are written in one call, and read in one, when the chunk in front
    of them comes; ``held`` has their numbers.

    A job of which nothing comes for ``minutes``, if given, is forgotten; one that had not ended gives a last frame, ``event: expired``.
    """

    def __init__(self, minutes: float | None):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "rest binary, frames long, chunks long, ended boolean, timer long, held array<long>")
        self.waiting = handle.getListState("waiting", "chunk long, bytes binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rest, frames, chunks, ended, timer, held = self.job.get() or (b"", 0, 0, False, 0, [])
        held, came = set(held), {}
        for batch in rows:
            came.update((int(c), bytes(b)) for c, b in zip(batch["chunk"], batch["bytes"], strict=True) if c >= chunks and c not in held)
        out, first = [], frames
        if ended:
            came = {}
        elif chunks in came:
            if held:
                came.update((int(c), bytes(b)) for c, b in self.waiting.get())
                self.waiting.clear()
                held = set()
            parts = [bytes(rest)]
            while chunks in came:
                parts.append(came.pop(chunks))
                chunks += 1
            *whole, rest = b"".join(parts).split(b"\n\n")
            last = next((k for k, frame in enumerate(whole) if _event(frame) in ENDS), None)
            ended = last is not None
            out = whole[: last + 1] if ended else whole
            frames += len(out)
            if ended:
                rest, came = b"", {}
        if came:
            self.waiting.appendList(list(came.items()))
            held |= came.keys()
        if self.minutes is not None:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + int(self.minutes * 60_000)
            self.handle.registerTimer(timer)
        self.job.update((bytes(rest), frames, chunks, ended, timer, sorted(held)))
        if out:
            yield self.rows(key[0], first, [f.decode("utf-8", "replace") for f in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, frames, _, ended, _, _ = self.job.get()
        self.job.clear()
        self.waiting.clear()
        if not ended:
            yield self.rows(key[0], frames, ["event: expired\ndata: {}"])

    @staticmethod
    def rows(job, first: int, frames: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"job": pd.Series([job] * len(frames), dtype=object), "seq": range(first, first + len(frames)), "frame": pd.Series(frames, dtype=object)})

    def close(self) -> None:
        pass


def stateful(spark: SparkSession) -> None:
    """State of processors needs the RocksDB store; a store of another kind that the user has set stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(name, "HDFSBacked"):
        spark.conf.set(name, _STORE)


def decoded(chunks: DataFrame, minutes: float | None = None) -> DataFrame:
    """Events (job, seq, event, data) of a stream of chunks (job, chunk, value): the same rows however the logs are cut.

    ``chunk`` numbers a job's chunks from 0; they may come in any order and more than once. ``value`` is text or bytes, and
    may be cut within a character. Null jobs are a job of their own; null values are empty. A job ends with one of ENDS. ``minutes``
    after its last chunk a job is forgotten; as that keeps a stream running, one that ends by itself (availableNow) goes without.
    """
    stateful(chunks.sparkSession)
    kind = dict(chunks.dtypes)["job"]
    rows = chunks.select("job", F.col("chunk").cast("long").alias("chunk"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("bytes"))
    whole = rows.groupBy("job").transformWithStateInPandas(Frames(minutes), f"job {kind}, seq long, frame string", "Append", "None" if minutes is None else "ProcessingTime")
    return parsed(whole)
