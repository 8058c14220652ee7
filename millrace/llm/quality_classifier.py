"""Supervised subword embeddings: hashed word and character n-grams, averaged, softmax, trained by SGD in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_pieces, mixed, release, small_batches, text_bytes, word_hashes, words_of

BITS, DIMENSIONS, GRAM = 17, 16, 4
#: At most about so many labelled documents are fitted on, chosen by a hash of doc_id; a documented bound.
SAMPLE = 12_000
#: Bytes of text whose features a worker holds at once; a longer text is taken alone.
PIECE = 1 << 19


@dataclass(frozen=True)
class Model:
    """Embeddings of feature buckets, output weights and bias of the two classes."""

    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def margin(self) -> np.ndarray:
        """Log-odds of label 1 that a feature adds: the output is linear in the mean of embeddings."""
        return (self.table @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word and every character n-gram (of UTF-8 bytes) of the whole texts, and their rows."""
    data, offsets = text_bytes(texts)
    starts, ends, rows = words_of(data, offsets)
    words = (word_hashes(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int32)
    n = max(0, len(data) - GRAM + 1)
    gram = np.zeros(n, np.uint64)
    for i in range(GRAM):
        gram = (gram << np.uint64(8)) | data[i : i + n].astype(np.uint64)
    grams = (mixed(gram + np.uint64(1 << 40)) >> np.uint64(64 - BITS)).astype(np.int32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = row[:n] == row[GRAM - 1 : GRAM - 1 + n]
    return np.concatenate([words, grams[whole]]), np.concatenate([rows, row[:n][whole]])


def train(bags: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, epochs: int = 6, rate: float = 0.5, batch: int = 16, seed: int = 3) -> Model:
    """Stochastic gradient descent on the softmax loss; ``bags`` are the distinct buckets of each document, ``counts`` how often each occurs."""
    rng = np.random.default_rng(seed)
    table = ((rng.random((1 << BITS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    balance = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0)
    weights += rng.normal(0, 0.1, weights.shape).astype(np.float32)
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for a in range(0, len(order), batch):
            step = rate * (1 - done / steps)
            done += batch
            for k in order[a : a + batch]:
                ids, w = bags[k], counts[k].astype(np.float32)
                w /= w.sum()
                hidden = w @ table[ids]
                z = hidden @ weights + bias
                e = np.exp(z - z.max())
                error = e / e.sum()
                error[labels[k]] -= 1
                error = (error * balance[labels[k]]).astype(np.float32)
                back = weights @ error
                weights -= step * 0.1 * np.outer(hidden, error)
                bias -= step * 0.1 * error
                table[ids] -= step * 40 * np.outer(w, back).astype(np.float32)
    return Model(table, weights, bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled documents (doc_id, text) and (doc_id, quality), at most about ``sample`` of them.

    Rows without a text or label are left out. Only their buckets and counts go to the driver, bounded by the sample
    and the number of buckets. Without any label the model knows nothing and scores 0.5 everywhere.
    """
    small_batches(docs.sparkSession)
    known = labels.where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).dropDuplicates(["doc_id"])
    n = known.count()
    keep = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, sample / max(1, n)))
    chosen = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known.where(keep)), "doc_id")  # about ``sample`` ids: n was counted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "text", PIECE):
            buckets, owner = features(b.column(1))
            both, count = np.unique(owner.astype(np.int64) << BITS | buckets, return_counts=True)
            bounds = np.searchsorted(both >> BITS, np.arange(b.num_rows + 1))
            ids = (both & ((1 << BITS) - 1)).astype(np.int32)
            kinds = [np.uint16 if count[x:y].max(initial=0) < 1 << 16 else np.uint32 for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            rows = [(ids[x:y].tobytes(), count[x:y].astype(kind).tobytes()) for x, y, kind in zip(bounds[:-1], bounds[1:], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "quality", "ids", "counts"])

    rows = sorted((r for r in chosen.mapInArrow(run, "doc_id long, quality int, ids binary, counts binary").toLocalIterator() if r["ids"]), key=lambda r: (r["doc_id"], bytes(r["ids"])))
    if not rows:
        return Model(np.zeros((1 << BITS, DIMENSIONS), np.float32), np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32))
    counts = [np.frombuffer(r["counts"], np.uint16 if 2 * len(r["counts"]) == len(r["ids"]) else np.uint32) for r in rows]
    model = train([np.frombuffer(r["ids"], np.int32) for r in rows], counts, np.array([int(r["quality"] > 0) for r in rows]))
    del rows, counts
    release()
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Adds ``name`` (0 to 1, the softmax of label 1) of each whole text; a null or empty text gets the bias alone.

    A column of ``docs`` of that name is replaced. Repeated rows get equal scores; an empty table gives no rows.
    """
    docs = docs.drop(name) if name != text else docs
    small_batches(docs.sparkSession)
    margin = docs.sparkSession.sparkContext.broadcast(model.margin())  # 2 ** BITS numbers
    bias = float(model.bias[1] - model.bias[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, text, PIECE):
            buckets, owner = features(b.column(b.schema.get_field_index(text)))
            total = np.bincount(owner, margin.value[buckets], b.num_rows)
            z = total / np.maximum(1, np.bincount(owner, minlength=b.num_rows)) + bias
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{name}` double"]))
