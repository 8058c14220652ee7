"""Minimax contiguous sharding of atomic groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, total_over, written

#: First resolution of the running totals seen by the driver, and how much finer each further look is (bits).
FIRST_BITS, MORE_BITS = 14, 8


def _greedy(ends: np.ndarray, many: np.ndarray, total: int, shards: int, capacity: int, divisible: bool) -> list[int] | None:
    """Fill shards in order up to ``capacity``; the position of each cut, or None if ``shards`` don't suffice.

    ``ends`` are known running totals at ends of groups; the stretch up to ``ends[i]`` holds several groups where
    ``many[i]``. With ``divisible`` such a stretch may be cut anywhere, which bounds the true answer from below.
    """
    at, cuts = 0, []
    for _ in range(shards):
        to = at + capacity
        if to >= total:
            return cuts
        i = int(np.searchsorted(ends, to, side="right"))
        known = int(ends[i - 1]) if i else 0
        to = to if divisible and many[i] else known
        if to <= at:
            return None
        cuts.append(to)
        at = to
    return None


def _smallest(feasible, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) is not None else (middle + 1, high)
    return low


def minimax_cuts(groups: DataFrame, shards: int, total: int, largest: int) -> tuple[int, list[int]]:
    """Smallest capacity with which greedy filling needs at most ``shards``, and the last key of each shard but the final.

    ``groups`` has key, bytes and bytes_end (running total in key order). The driver sees the totals at a bounded
    number of places: a lower and an upper bound for the capacity come from binary searches, and only stretches
    where cuts may fall are looked at more finely, until the bounds meet. The result is exact.
    """
    scale = lambda bits: F.floor(F.col("bytes_end") / F.lit(float(total)) * F.lit(float(1 << bits)))
    look = lambda df, bits: [tuple(r) for r in df.groupBy(scale(bits).alias("b")).agg(F.max("bytes_end"), F.max("key"), F.count("*")).collect()]
    bits = FIRST_BITS
    points = {e: (b, k, n, bits) for b, e, k, n in look(groups, bits)}
    while True:
        ends = np.array(sorted(points), np.int64)
        many = np.array([points[e][2] > 1 for e in ends])
        start = max(-(-total // shards), largest)
        low = _smallest(lambda c: _greedy(ends, many, total, shards, c, True), start, total)
        high = _smallest(lambda c: _greedy(ends, many, total, shards, c, False), low, total)
        if low == high:
            return high, [points[e][1] for e in _greedy(ends, many, total, shards, high, False)]
        open_ = set()
        for c in {int(x) for x in np.linspace(low, high, 48)}:
            for divisible in (True, False):
                for to in _greedy(ends, many, total, shards, c, divisible) or []:
                    for place in (to, to + 1, to + c):
                        i = int(np.searchsorted(ends, place))
                        open_ |= {int(ends[i])} if i < len(ends) and many[i] else set()
        open_ = open_ or {int(ends[i]) for i in np.flatnonzero(many)}
        for was in {points[e][3] for e in open_}:
            chosen = [e for e in open_ if points[e][3] == was]
            inside = groups.where(scale(was).isin([points[e][0] for e in chosen]))
            for e in chosen:
                del points[e]
            points |= {e: (b, k, n, was + MORE_BITS) for b, e, k, n in look(inside, was + MORE_BITS)}


def shard_by_bytes(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id", overhead: int = 8) -> DataFrame:
    """Put every row into one of ``shards`` so that equal texts stay together and the largest shard is small.

    Groups of equal texts, in the order of their hash, are the atoms. A group above a fair share of what is left
    gets a shard of its own (these are fewer than ``shards``); the rest is cut into contiguous runs of the smallest
    feasible capacity. Adds size, text_crc32, shard and slot (place in the shard, from 0).

    Null and empty texts are one group, of size ``overhead`` each; repeated rows each take a slot; an empty table gives no rows;
    with fewer groups than shards some shards stay empty. Other columns are not carried.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + overhead).alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("key")))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    rest, free, own = groups.agg(F.sum("bytes")).first()[0] or 0, shards, []
    for key, size in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect():
        if free > 1 and size * free > rest:
            own.append(key)
            rest, free = rest - size, free - 1
    light = groups.where(~F.col("key").isin(own)) if own else groups
    cuts: list[int] = []
    if rest:
        light = cut(total_over(light, ["key"], ["bytes"]))
        cuts = minimax_cuts(light, free, rest, light.agg(F.max("bytes")).first()[0])[1]
    placed = rows.withColumn("shard", _shard(F.col("key"), cuts, own, free)).withColumn("one", F.lit(1))
    counts = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    first, at = {}, 0
    for k in range(shards):
        first[k], at = at, at + counts.get(k, 0)
    ranked = total_over(placed, ["shard", "key", "doc_id"], ["one"])
    starts = F.array(*(F.lit(first[k]).cast("long") for k in range(shards)))
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("one_end") - 1 - starts[F.col("shard")]).alias("slot"))


def _shard(key: Column, cuts: list[int], own: list[int], free: int) -> Column:
    place = F.lit(0)
    for c in cuts:
        place = place + (key > F.lit(c)).cast("int")
    for i, k in enumerate(own):
        place = F.when(key == F.lit(k), F.lit(free + i)).otherwise(place)
    return place.cast("int")
