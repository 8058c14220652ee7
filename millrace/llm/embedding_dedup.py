"""Near-duplicate vectors by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, cut, written

#: Trees, and vectors that a leaf should hold at most.
TREES, LEAF = 6, 512
#: How far from a threshold a vector goes to both sides: this share of the deviation that a linked pair's distance has along a
#: random direction, which falls with the root of the dimension as the spread of the vectors themselves does.
SPILL = 0.5
#: The trees are fitted on about so many vectors at most, and so many numbers in them (documented bounds); every vector is put into leaves.
SAMPLE, SAMPLE_NUMBERS = 30_000, 4_000_000
#: Vectors of the sample that a threshold is fitted on at least.
FEWEST = 32
#: Vectors of a part of a leaf; larger leaves are compared part by part. Rows of a block within a part.
PART, BLOCK = 2048, 1024
#: Vectors are compared as whole numbers up to this, so that their products are exact.
GRID = 32767
#: Hits whose earlier leaves are looked at together.
HITS = 1 << 20


@dataclass(frozen=True)
class Tree:
    """Nodes (direction, threshold, left, right; thresholds of further levels where the direction is None)."""

    nodes: list[tuple]
    further: np.ndarray

    def leaves(self, vectors: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves of unit vectors; those near a threshold go to both sides."""
        rows, found, todo = [], [], [(0, np.arange(len(vectors)))]
        while todo:
            node, own = todo.pop()
            d, at, left, right = self.nodes[node]
            if d is not None:
                x = vectors[own] @ d
                todo += [(left, own[x <= at + spill]), (right, own[x > at - spill])]
                continue
            code = np.full(len(own), node, np.int64)
            for direction, threshold in zip(self.further, at, strict=True):
                x = vectors[own] @ direction
                low, high = x <= threshold + spill, x > threshold - spill
                own, code = np.concatenate([own[low], own[high]]), np.concatenate([2 * code[low], 2 * code[high] + 1])
            rows.append(own)
            found.append(code)
        return np.concatenate(rows), np.concatenate(found)


def grow(sample: np.ndarray, n: int, leaf: int, seed: int) -> Tree:
    """A tree for ``n`` vectors, fitted on a sample of them: random directions, split at the median.

    Where the sample has no more than FEWEST vectors in a node, as many further levels as leaves of ``leaf`` vectors need
    follow, all with the same directions and with thresholds by the vectors of that node.
    """
    rng = np.random.default_rng(seed)
    size = max(FEWEST, math.ceil(leaf * len(sample) / n))
    levels = max(0, math.ceil(math.log2(n * size / (len(sample) * leaf)))) if len(sample) > leaf * len(sample) / n else 0
    unit = lambda shape: (d := rng.standard_normal(shape)) / np.linalg.norm(d, axis=-1, keepdims=True)
    further = unit((levels, sample.shape[1])).astype(np.float32)
    nodes: list[tuple] = []

    def split(rows: np.ndarray) -> int:
        at = len(nodes)
        nodes.append((None, np.median(sample[rows] @ further.T, axis=0) if levels else np.zeros(0), -1, -1))
        if len(rows) > size:
            d = unit(sample.shape[1])
            x = sample[rows] @ d
            cut_at = float(np.median(x))
            low, high = rows[x <= cut_at], rows[x > cut_at]
            if len(low) and len(high):
                nodes[at] = (d.astype(np.float32), cut_at, split(low), split(high))
        return at

    split(np.arange(len(sample)))
    return Tree(nodes, further)


def _united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of rows (the smallest row of a group) after pairs i, j are joined too."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return label
        label = new


def on_grid(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as whole numbers up to GRID, and how far the direction of each is from its vector's."""
    grid = np.rint(unit / np.abs(unit).max(1)[:, None] * GRID)
    return grid.astype(np.int16), np.linalg.norm(unit - grid / np.linalg.norm(grid, axis=1)[:, None], axis=1) + 1e-12


def leaves_before(earlier: list[np.ndarray], trees: int) -> list[np.ndarray]:
    """For each tree that came before, its leaves of each vector as columns, -1 where it has no more."""
    n = np.array([len(e) for e in earlier])
    code, row = np.concatenate([np.zeros(0, np.int64), *earlier]), np.repeat(np.arange(len(earlier)), n)
    out = []
    for t in np.unique(code % trees):
        own = code % trees == t
        r, c = row[own], code[own]
        nth = np.arange(len(r)) - np.searchsorted(r, r)  # rows are in order
        table = np.full((len(earlier), int(nth.max()) + 1), -1, np.int64)
        table[r, nth] = c
        out.append(table)
    return out


def met_before(tables: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of vectors share an earlier leaf."""
    seen = np.zeros(len(i), bool)
    for at in range(0, len(i), HITS):
        left = np.arange(at, min(at + HITS, len(i)))
        for table in tables:
            for a in range(table.shape[1]):
                x = table[i[left], a]
                found = np.zeros(len(left), bool)
                for b in range(table.shape[1]):
                    found |= (x == table[j[left], b]) & (x >= 0)
                seen[left[found]] = True
                left = left[~found]
    return seen


def hits(part: np.ndarray, grid: np.ndarray, slack: np.ndarray, earlier: list[np.ndarray], trees: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows within a part of a leaf, or between two parts, whose cosine may reach ``least``, and whether it surely does.

    Only these are looked up in earlier leaves; pairs that share one were compared there. Products of whole numbers are
    exact, so that pairs come out alike whichever other vectors are there.
    """
    tables = leaves_before(earlier, trees)
    own, other = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
    within = part.min() == part.max()
    whole = grid.astype(np.float64)
    norm = np.sqrt((whole * whole).sum(axis=1))
    for a in range(0, len(own), BLOCK):
        x = own[a : a + BLOCK]
        for b in range(a if within else 0, len(other), BLOCK):
            y = other[b : b + BLOCK]
            above = (whole[x] @ whole[y].T) / (norm[x][:, None] * norm[y]) - least
            if within and a == b:
                above[np.tril_indices(len(x))] = -2
            i, j = np.nonzero(above >= -(slack[x][:, None] + slack[y]))
            sure = above[i, j] >= slack[x[i]] + slack[y[j]]
            i, j = x[i], y[j]
            new = ~met_before(tables, i, j)
            yield i[new], j[new], sure[new]


def grouped(ids: np.ndarray, copies: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[list, list]:
    """(id, linked others) and (id, smaller id of its group) of links between rows. No list of links is made."""
    linked, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i, j in pairs:
        linked += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
        label = _united(label, i, j)
    # groups are named by their smallest row; rows are in the order of ids
    some, moved = np.flatnonzero(linked), np.flatnonzero(label != np.arange(len(ids)))
    return list(zip(ids[some].tolist(), linked[some].tolist(), strict=True)), list(zip(ids[moved].tolist(), ids[label[moved]].tolist(), strict=True))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.98, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """One row per vector: vec_id, n_links (others within the cosine), component_id and kept.

    Only vectors of one non-null label are compared. Equal vectors are compared once and counted as often as they
    occur. The trees are fitted on a bounded sample; each vector goes to a leaf of every tree, or to both sides where it is
    near a split. A leaf's vectors of one label are compared as 16-bit whole numbers, a large leaf part by part: links are counted and
    joined to groups there, so that no list of them is made. Vectors of pairs too near to the bound for that are named, get their
    original numbers, and their pairs are settled in double precision in the same leaf. A pair counts in the first leaf that it shares.

    Each row is a vector of its own, also where rows share a vec_id: rows with equal vectors and labels link with each other, others
    by their own vectors, and a component has the smallest vec_id of its rows. Null or zero vectors, those
    with null or non-finite parts, and rows without an id link with nothing; an empty table gives no rows. Other columns are not carried.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e"), F.col(label).alias("label"))
    sound = F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("e", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound & F.col("vec_id").isNotNull(), F.lit(False))).withColumn("key", F.when(F.col("sound"), F.struct(F.xxhash64("e", "label").alias("a"), F.xxhash64(F.lit(3), "label", "e").alias("b"))))
    ids = written(rows.select("vec_id", "sound", F.col("key.a").alias("a"), F.col("key.b").alias("b")))
    # equal vectors are one class; its number stays what it is once it is written
    classes = written(ids.where("sound").groupBy("a", "b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("c", F.monotonically_increasing_id()))
    member = written(ids.join(classes, ["a", "b"], "left").select("vec_id", "c", "rep", "copies"))
    mine = rows.where("sound").select(F.col("key.a").alias("a"), F.col("key.b").alias("b"), F.col("vec_id").alias("rep"), "e", "label")
    reps = written(mine.join(classes, ["a", "b", "rep"]).select(F.col("c").alias("vec_id"), "e", "label", "copies").dropDuplicates(["vec_id"]))
    n = reps.count()
    if not n:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sizes = {r[0]: r[1] for r in reps.groupBy(F.size("e")).count().collect()}
    forests = {}
    for k, many in sizes.items():
        take = min(SAMPLE, max(FEWEST, SAMPLE_NUMBERS // k))
        sampled = reps.where((F.size("e") == k) & (F.pmod(F.xxhash64("vec_id", F.lit(23)), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, take / many))))
        unit = np.array([np.array(r["e"], np.float32) for r in sampled.select("e").toLocalIterator()] or [np.ones(k, np.float32)])
        unit = unit / np.linalg.norm(unit.astype(np.float64), axis=1)[:, None]
        forests[k] = [grow(unit, many, leaf, 100 + t) for t in range(trees)]
    forests = spark.sparkContext.broadcast(forests)  # nodes in proportion to the sample
    spill = {k: SPILL * math.sqrt(2 * (1 - least) / k) for k in sizes}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                lists = b.column(1).to_pylist()
                dims = np.array([len(x) for x in lists])
                for k in np.unique(dims):
                    rows = np.flatnonzero(dims == k)
                    unit = np.array([lists[i] for i in rows], np.float64)
                    unit /= np.abs(unit).max(1)[:, None]  # so that no square is too large or too small
                    unit = unit / np.linalg.norm(unit, axis=1)[:, None]
                    single = unit.astype(np.float32)
                    grid, slack = on_grid(unit)
                    before: list[list[int]] = [[] for _ in rows]
                    for t, tree in enumerate(forests.value[int(k)]):
                        i, code = tree.leaves(single, spill[int(k)])
                        order = np.lexsort((code, i))
                        i, code = i[order], code[order]
                        out = []
                        for r, c in zip(i.tolist(), code.tolist(), strict=True):
                            c = c * trees + t
                            out.append(np.array(before[r], np.int64).tobytes())
                            before[r].append(c)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(i), k, np.int64)), pa.array(code * trees + t), b.column(2).take(pa.array(rows[i])), b.column(0).take(pa.array(rows[i])), b.column(3).take(pa.array(rows[i])), pa.array([x.tobytes() for x in grid[i]], pa.binary()), pa.array(slack[i]), pa.array(out, pa.binary())],
                            names=["size", "leaf", "label", "vec_id", "copies", "grid", "slack", "before"],
                        )

    kind = dict(reps.dtypes)["label"]
    placed = written(reps.mapInArrow(place, f"size long, leaf long, label {kind}, vec_id long, copies long, grid binary, slack double, before binary"))
    key = ["size", "leaf", "label"]
    large = cut(placed.groupBy(*key).count().where(F.col("count") > PART).select(*key, F.ceil(F.col("count") / PART).cast("int").alias("parts")))
    placed = placed.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.expr("CAST(pmod(xxhash64(vec_id, 31), parts) AS BIGINT)"))
    placed = placed.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"x": F.least("part", "q"), "y": F.greatest("part", "q")}).drop("q", "parts")

    group = [*key, "x", "y"]
    out = f"kind int, u long, v long, size long, leaf long, label {kind}, x long, y long"

    def opened(t: pa.Table) -> tuple[pa.Table, np.ndarray, tuple]:
        t = t.take(pa.array(np.argsort(t.column("vec_id").to_numpy(), kind="stable")))
        grid = np.frombuffer(b"".join(t.column("grid").to_pylist()), np.int16).reshape(t.num_rows, -1)
        part = t.column("part").to_numpy()
        alone = part.min() == part.max() and t.column("x")[0].as_py() != t.column("y")[0].as_py()  # the other part has none
        before = [np.frombuffer(x, np.int64) for x in t.column("before").to_pylist()]
        return t, t.column("vec_id").to_numpy(), () if alone else (part, grid, t.column("slack").to_numpy(), before, trees, least)

    def closed(t: pa.Table, *found: list) -> pa.Table:
        u, v = ([r[c] for rows in found for r in rows] for c in (0, 1))
        same = [pa.array([t.column(g)[0].as_py()] * len(u), t.schema.field(g).type) for g in group]
        return pa.table([pa.array(np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])), pa.array(u, pa.int64()), pa.array(v, pa.int64()), *same], names=["kind", "u", "v", *group])

    def compare(t: pa.Table) -> pa.Table:
        """Sure links as counts (kind 0) and groups (1), and the vectors that have an unsure one (2)."""
        t, ids, given = opened(t)
        unsure = np.zeros(len(ids), bool)

        def sure() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, j, good in hits(*given) if given else ():
                unsure[i[~good]] = unsure[j[~good]] = True
                yield i[good], j[good]

        found = grouped(ids, t.column("copies").to_numpy(), sure())
        return closed(t, *found, [(x, x) for x in ids[unsure].tolist()])

    def settle(t: pa.Table) -> pa.Table:
        """The unsure pairs of a leaf's named vectors, by their cosines in double precision."""
        t, ids, given = opened(t)
        e = np.array(t.column("e").to_pylist(), np.float64)
        e /= np.abs(e).max(axis=1)[:, None]
        norm = np.sqrt((e * e).sum(axis=1))

        def linked() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, j, good in hits(*given) if given else ():
                i, j = i[~good], j[~good]
                near = np.zeros(len(i), bool)
                for at in range(0, len(i), BLOCK * 8):
                    x, y = i[at : at + BLOCK * 8], j[at : at + BLOCK * 8]
                    near[at : at + BLOCK * 8] = np.einsum("ij,ij->i", e[x], e[y]) / (norm[x] * norm[y]) >= least
                yield i[near], j[near]

        return closed(t, *grouped(ids, t.column("copies").to_numpy(), linked()))

    found = written(placed.groupBy(*group).applyInArrow(compare, out))
    named = found.where("kind = 2").select(F.col("u").alias("vec_id"), *group)
    if not named.isEmpty():
        exact = placed.join(named, ["vec_id", *group]).join(reps.select("vec_id", "e"), "vec_id")
        found = written(found.where("kind < 2").unionByName(exact.groupBy(*group).applyInArrow(settle, out)))
    linked = cut(found.where("kind = 0").groupBy(F.col("u").alias("c")).agg(F.sum("v").alias("others")))
    reach = cut(components(found.where("kind = 1").select("u", "v")).withColumnRenamed("node", "c"))
    whole = reach.unionByName(reach.select(F.col("component").alias("c"), "component").distinct()).join(classes.select("c", "rep"), "c")
    names = cut(whole.join(whole.groupBy("component").agg(F.min("rep").alias("least")), "component").select("c", "least"))
    rows_ = member.join(linked, "c", "left").join(names, "c", "left")
    n_links = F.when(F.col("c").isNull(), 0).otherwise(F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long")
    return rows_.select("vec_id", n_links.alias("n_links"), F.coalesce("least", "rep", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
