"""Helpers shared by the corpus operators: scratch tables, ordered running totals, byte-level word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that separates words: space, and tab to carriage return.
SEPARATORS = (9, 10, 11, 12, 13, 32)
ROWS_A_PARTITION = 200_000
#: Bytes of an Arrow batch of texts between Spark and a worker; a longer text is a batch alone.
BATCH_BYTES = 4 << 20
_LIBC = ctypes.CDLL(None)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset a temporary one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; keeps partitions and their order.

    With a bound on its rows known, a small result gets fewer partitions, and so fewer files.
    """
    shared_folder(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(8, rows // ROWS_A_PARTITION))
    return df.checkpoint(eager=True)


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back (columns can then be pruned).

    With a bound on its rows known, a small result gets fewer files.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(8, rows // ROWS_A_PARTITION))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES, unless its bound is lower already.

    Spark's own bound is 64 MB, which the executor (its buffers double as they grow) and each worker hold more than once. The
    setting stays for the session, as later actions on lazy results need it too; a user may set a lower one beforehand.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name, None) or "")
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, with underscores put before those that are among the columns ``taken`` (whatever the case)."""
    lower, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in lower:
            n = f"_{n}"
        lower.add(n.lower())
        out.append(n)
    return out


def folded(column: Column | str) -> Column:
    """``crc32(doc_id as text) mod 3 = 1``: the rows held out from learning."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % 3 == 1


def total_over(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Running totals over the whole table in the order of ``keys``: adds ``<value>_end`` (this row included).

    Rows are range-partitioned and sorted, each range is summed, and only one sum per range goes to the
    driver. ``keys`` should identify rows; rows equal in all keys may come in either order.
    """
    ranged = cut(df.repartitionByRange(_ranges(df.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id()))
    sums = {r["_range"]: [r[v] or 0 for v in values] for r in ranged.groupBy("_range").agg(*(F.sum(v).alias(v) for v in values)).collect()}
    before, at = {}, [0] * len(values)
    for k in sorted(sums):
        before[k] = list(at)
        at = [x + y for x, y in zip(at, sums[k], strict=True)]
    schema = T.StructType([*ranged.drop("_range").schema.fields, *(T.StructField(f"{v}_end", T.LongType()) for v in values)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, list[int]] = {}
        for b in batches:
            part = b.column(b.schema.get_field_index("_range"))
            if not b.num_rows:
                continue
            ends = {v: np.empty(b.num_rows, np.int64) for v in values}
            ids = part.to_numpy(zero_copy_only=False)
            for k in np.unique(ids):
                rows = np.flatnonzero(ids == k)
                have = state.setdefault(int(k), list(before[int(k)]))
                for i, v in enumerate(values):
                    sums = np.cumsum(b.column(v).to_numpy(zero_copy_only=False)[rows].astype(np.int64)) + have[i]
                    ends[v][rows] = sums
                    have[i] = int(sums[-1])
            kept = [n for n in b.schema.names if n != "_range"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), *(pa.array(ends[v]) for v in values)], names=[*kept, *(f"{v}_end" for v in values)])

    return ranged.mapInArrow(run, schema)


def _ranges(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


# --- text as bytes -------------------------------------------------------------------------------------------


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one text after another, and where each text starts and ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of products spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int = 1) -> np.ndarray:
    """``n`` odd pseudo-random 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


#: Words of up to so many bytes are hashed eight bytes at a time.
_CHUNKED = 64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (a run of bytes outside SEPARATORS) and the row it belongs to."""
    inside = _IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; which words are hashed with it doesn't matter.

    Words of up to _CHUNKED bytes are mixed eight bytes at a time, longer ones are sums of bytes times random odd numbers
    by place.
    """
    if lower:
        data = _LOWER[data]
    lengths = ends - starts
    out = mixed((lengths.astype(np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    at = np.flatnonzero((lengths > 0) & (lengths <= _CHUNKED))
    for done in range(0, _CHUNKED, 8):
        if not len(at):
            break
        left = lengths[at] - done
        out[at] = mixed(out[at] * np.uint64(0xD6E8FEB86659FD93) ^ (eight[starts[at] + done] & _MASKS[np.minimum(left, 8)]))
        at = at[left > 8]
    if len(long := np.flatnonzero(lengths > _CHUNKED)):
        n = lengths[long]
        place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
        raw = data[place + np.repeat(starts[long], n)].astype(np.uint64) + np.uint64(1)
        odd = mixed((place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)
        out[long] = mixed(out[long] + np.add.reduceat(raw * odd, np.cumsum(n) - n))
    return out


def window_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every ``width``-word window that lies within one row."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i, m in enumerate(multipliers(width, 7)):
        total += words[i : i + n] * m
    whole = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return mixed(total[whole]), rows[whole], whole


def groups_of(rows: np.ndarray, n: int) -> np.ndarray:
    """``n + 1`` bounds of the runs of equal values 0 .. n - 1 in sorted ``rows``."""
    return np.searchsorted(rows, np.arange(n + 1))


def in_pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Split batches so that each holds about ``most`` bytes of text, or a single longer text.

    Texts are not copied here.
    """
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0)
        offsets = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)])
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield b.slice(at, min(to, b.num_rows) - at)
            at = min(to, b.num_rows)
        release()


def release() -> None:
    """Give memory that Arrow and the C library no longer use back to the system: a worker lives through many stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


# --- links to components -------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (u, v): (node, component), component the smallest node reachable.

    Large-star and small-star in turn: every node's larger neighbours move to its smallest neighbour, until
    nothing changes. Minima are combined before they are shuffled and cut from the plan, so that the joins
    that follow are plain ones whose hot keys Spark splits at run time.

    Each round's edges are a written table: a checkpoint keeps its plan's estimate of size, which a join squares, so
    that after some rounds planning would take longer than the work.
    """
    n = 2 * links.count()
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), n)
    state = None
    while (now := edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()) != state:
        if not now[0]:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), n)
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), n)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
