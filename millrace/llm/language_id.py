"""Language identification with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_pieces, mixed, small_batches, text_bytes

DIMENSIONS, GRAM = 1024, 3
#: Profiles are learned from about so many documents at most, chosen by a hash of doc_id; a documented bound.
SAMPLE = 12_000
#: Rows of a piece and letters of all scripts that a packed n-gram key has room for.
_ROW_BITS, _LETTER_BITS = 9, 18
#: Letters whose vectors a worker remembers; symbols only need to agree within a piece.
_MOST_LETTERS = 20_000
_SYMBOL = np.full(0x110000, -1, np.int32)  # per process: code point to symbol; 0 is anything but a letter
_LETTERS = [0]
_ROLLED: list[np.ndarray] = []


def _symbols(points: np.ndarray) -> np.ndarray:
    """Symbols of code points: lower-cased letters are numbered as they turn up, all else is 0."""
    if len(_LETTERS) > _MOST_LETTERS:
        _SYMBOL[:] = -1
        del _LETTERS[1:]
        _ROLLED.clear()
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    for p in np.flatnonzero(seen & (_SYMBOL < 0)):
        c = chr(int(p))
        low = ord(c.lower()[0]) if c.isalpha() else -1
        if low < 0:
            _SYMBOL[p] = 0
        else:
            if _SYMBOL[low] <= 0:
                _SYMBOL[low] = len(_LETTERS)
                _LETTERS.append(low)
            _SYMBOL[p] = _SYMBOL[low]
    return _SYMBOL[points]


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The random +1/-1 vector of each code point, the same everywhere."""
    words = mixed(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + mixed(np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64))[None, :])
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def _bound(grams: np.ndarray) -> np.ndarray:
    """n-gram vectors: letter vectors, permuted (rolled) by their place, multiplied."""
    if not _ROLLED or len(_ROLLED[0]) < len(_LETTERS):
        base = letter_vectors(np.array(_LETTERS))
        _ROLLED[:] = [np.roll(base, GRAM - 1 - i, axis=1) for i in range(GRAM)]
    out = _ROLLED[0][grams[:, 0]]
    for i in range(1, GRAM):
        out = out * _ROLLED[i][grams[:, i]]
    return out


def profiles(texts: pa.Array) -> np.ndarray:
    """The bundle (sum of n-gram vectors) of each whole text; zero where it has no letter."""
    data, offsets = text_bytes(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(chars))
    symbols = _symbols(points)
    gap = symbols == 0
    keep = np.ones(len(symbols), bool)
    keep[1:] = ~(gap[1:] & gap[:-1] & (rows[1:] == rows[:-1]))
    symbols, rows = symbols[keep].astype(np.int64), rows[keep]
    # a gap before and after each text, so that short texts have n-grams too
    n = len(offsets) - 1
    at = np.arange(len(symbols)) + 2 * rows + 1
    padded, owner = np.zeros(len(symbols) + 2 * n, np.int64), np.repeat(np.arange(n), np.bincount(rows, minlength=n) + 2)
    padded[at] = symbols
    m = max(0, len(padded) - GRAM + 1)
    key = owner[:m].copy()
    for i in range(GRAM):
        key = key << _LETTER_BITS | padded[i : i + m]
    whole = (owner[:m] == owner[GRAM - 1 : GRAM - 1 + m]) & (np.stack([padded[i : i + m] for i in range(GRAM)]).max(0) > 0) if m else np.zeros(0, bool)
    keys, counts = np.unique(key[whole], return_counts=True)
    bounds = np.searchsorted(keys >> (_LETTER_BITS * GRAM), np.arange(n + 1))
    mask = (1 << _LETTER_BITS) - 1
    grams = np.stack([keys >> (_LETTER_BITS * (GRAM - 1 - i)) & mask for i in range(GRAM)], axis=1)
    out = np.zeros((n, DIMENSIONS), np.float32)
    for r in range(n):
        for a in range(bounds[r], bounds[r + 1], 4096):
            b = min(a + 4096, bounds[r + 1])
            out[r] += counts[a:b].astype(np.float32) @ _bound(grams[a:b]).astype(np.float32)
    return out


def _small(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for b in in_pieces(batches, column, 2 << 20):
        for at in range(0, b.num_rows, 1 << _ROW_BITS):
            yield b.slice(at, 1 << _ROW_BITS)


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """A prototype for each language: the normed sum of normed document bundles, from documents with text and lang.

    At most about ``sample`` documents are used; each task sends one vector per language to the driver, from at
    most 64 tasks.
    """
    small_batches(docs.sparkSession)
    docs = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    n = docs.count()
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, sample / max(1, n))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in _small(batches, "text"):
            vectors = profiles(b.column(1)).astype(np.float64)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
            for lang, v in zip(b.column(2).to_pylist(), vectors, strict=True):
                sums[lang] = sums.get(lang, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "vector"])

    total: dict[str, np.ndarray] = {}
    for r in sorted(chosen.coalesce(64).mapInArrow(run, "lang string, vector binary").collect(), key=lambda r: (r["lang"], bytes(r["vector"]))):
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["vector"], np.float64)
    return {k: v / np.linalg.norm(v) for k, v in sorted(total.items()) if np.linalg.norm(v) > 0}


def predicted(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Adds lang_pred, the language whose prototype has the largest cosine with the text's bundle, and that cosine as score.

    Null texts, texts without a letter and, without prototypes, all texts get ``und`` and 0. Ties go to the first
    language by name. Whole texts are used, in pieces of bounded memory. Columns of ``docs`` with these names are
    replaced; repeated rows get equal results; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    small_batches(docs.sparkSession)
    names = list(prototypes)
    matrix = docs.sparkSession.sparkContext.broadcast(np.array([prototypes[k] for k in names]).reshape(len(names), DIMENSIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, text):
            vectors = profiles(b.column(b.schema.get_field_index(text))).astype(np.float64)
            norms = np.linalg.norm(vectors, axis=1)
            lang, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            if names:
                cosines = vectors @ matrix.value.T / np.maximum(norms, 1e-12)[:, None]
                best = cosines.argmax(1)
                real = norms > 0
                lang[real] = np.array(names, object)[best[real]]
                score[real] = np.clip(cosines[np.arange(len(best)), best], 0, 1)[real]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang.tolist(), pa.string()), pa.array(score)], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), "lang_pred string", "score double"]))
