"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut

#: Rows that one task rounds, and residuals that one node of the reduction tree combines, at most on average.
BLOCK, FAN_IN = 4_096, 64


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict:
    """Words to take from each source: a share of all words by weight, at most ``most`` times what the source has.

    Sources are ordered by code point, null last, and get the weights in turn. What exceeds a cap is shared out
    among the others by weight until no target is above its cap.
    """
    ordered = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    have = dict(ordered)
    left, open_, out = share * sum(have.values()), list(have), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if each * weight[s] > most * have[s]]
        if not full:
            return out | {s: each * weight[s] for s in open_}
        for s in full:
            out[s] = most * have[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def _pivot(p: np.ndarray, size: np.ndarray, seed: int) -> int:
    """Round the fractions ``p`` in place, keeping sum(p * size); returns the index left fractional, or -1.

    Two fractions meet at a time: at random, but without changing either expectation, mass moves from one to
    the other until one of them is 0 or 1.
    """
    draw = np.random.default_rng(seed).random(len(p))
    open_ = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if open_ < 0:
            open_ = j
            continue
        i, a, b = open_, float(size[open_]), float(size[j])
        up = min((1.0 - p[i]) * a, p[j] * b)
        down = min(p[i] * a, (1.0 - p[j]) * b)
        move = up if draw[j] * (up + down) < down else -down
        x, y = p[i] + move / a, p[j] - move / b
        if move > 0:
            i_done = (1.0 - p[i]) * a <= p[j] * b
            x, y = (1.0, y) if i_done else (x, 0.0)
        else:
            i_done = p[i] * a <= (1.0 - p[j]) * b
            x, y = (0.0, y) if i_done else (x, 1.0)
        p[i], p[j] = x, y
        open_ = j if i_done else i
        if not 0.0 < p[open_] < 1.0:
            open_ = -1
    return open_


def _round(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Round each source's fractions of one block; at most one row of a source stays fractional."""
    pdf = pdf.sort_values(["rank", "doc_id", "size", "copy"], kind="stable").reset_index(drop=True)
    p, size = pdf["part"].to_numpy(np.float64).copy(), pdf["size"].to_numpy()
    bounds = np.flatnonzero(np.diff(pdf["rank"].to_numpy(), prepend=-1, append=-1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = p[a:b]
        _pivot(own, size[a:b], seed * 1_000_003 + int(pdf["rank"].iat[a]))
    pdf["part"] = p
    return pdf


def mix(docs: DataFrame, size: str = "size", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, rest: str = "part", copy: str | None = None) -> DataFrame:
    """How many words of each document the mix takes: (doc_id, copy, source, size, source_size, target, taken).

    Every document of a source gets target / source_size copies in expectation; whole copies are certain and the
    fraction is rounded by the pivotal method so that the words taken stay at the target. Blocks of documents, dealt
    by hash, are rounded in parallel, whatever their source; each leaves at most one fractional document of a
    source, and a tree of further rounds combines these until one is left. That last one is taken in part
    (``rest="part"``) or rounded to the nearest (``rest="whole"``). A rerun over the same rows gives the same.

    Null sources form a source, ordered last; documents without words take nothing; repeated rows are separate
    (the column named by ``copy`` tells equal doc_ids apart, where there is one). A source list fits on the driver; nothing else goes there. An empty table
    gives no rows. Other columns are not carried.
    """
    spark = docs.sparkSession
    number = F.col(copy).cast("long") if copy else F.lit(0).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), number.alias("copy"))
    rows = cut(rows)
    per = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    want = targets([(r["source"], r["size"]) for r in per], weights, share, most)
    ordered = sorted(per, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    plan = spark.createDataFrame([(r["source"], i, r["size"], float(want[r["source"]]), float(want[r["source"]] / r["size"]) if r["size"] else 0.0) for i, r in enumerate(ordered)], "source string, rank int, source_size long, target double, rate double")
    known = rows.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    known = known.withColumn("whole", F.when(F.col("size") > 0, F.floor("rate")).otherwise(0).cast("long")).withColumn("part", F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0))
    blocks = max(1, -(-sum(r["n"] for r in per) // BLOCK))
    block = F.pmod(F.xxhash64("doc_id", "copy", F.lit(seed)), F.lit(blocks)).cast("int")
    schema = "doc_id long, copy long, rank int, size long, part double"
    state = cut(_rounds(known.select("doc_id", "copy", "rank", "size", "part", block.alias("block")), schema, seed))
    done, level = [], 0
    while blocks > 1:
        fractional = (F.col("part") > 0) & (F.col("part") < 1)
        done.append(state.where(~fractional))
        blocks, level = -(-blocks // FAN_IN), level + 1
        again = state.where(fractional).withColumn("block", F.pmod(F.xxhash64("doc_id", "copy", F.lit(seed + level)), F.lit(blocks)).cast("int"))
        state = cut(_rounds(again, schema, seed + level, by_source=True))
    for part in done:
        state = state.unionByName(part)
    share_of = F.col("part") * F.col("size")
    last = F.round(share_of) if rest == "part" else F.when(F.col("part") >= 0.5, F.col("size")).otherwise(0)
    share_of = F.when((F.col("part") > 0) & (F.col("part") < 1), last).otherwise(share_of).cast("long")
    table = plan.select("rank", "source", "source_size", "target", "rate")
    out = state.join(table, "rank").withColumn("whole", F.when(F.col("size") > 0, F.floor("rate")).otherwise(0).cast("long"))
    return out.select("doc_id", "copy", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + share_of).alias("taken"))


def _rounds(rows: DataFrame, schema: str, seed: int, by_source: bool = False) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return _round(pdf, seed * 7919 + int(pdf["block"].iat[0])).drop(columns="block")[["doc_id", "copy", "rank", "size", "part"]]

    return rows.groupBy("block", "rank").applyInPandas(one, schema) if by_source else rows.groupBy("block").applyInPandas(one, schema)
