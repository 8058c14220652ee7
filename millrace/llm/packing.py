"""Packing tokenised documents into fixed windows: non-negative least squares over length combinations."""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SEPARATORS, cut, in_pieces, small_batches, text_bytes, total_over, word_hashes

WINDOW, END_ID = 4096, 2
#: Units whose ids a worker remembers; lengths that combinations are enumerated from.
REMEMBERED, DEPTH_LENGTHS = 1_000_000, 160
# --- fixed values: the split of a tokenizer for which texts may be cut at white space and between letters, digits and plain signs
WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# -------------------------------------------------------------------------------------------------------------
#: Kinds of bytes: 0 white space, 1 letter, 2 digit, 3 plain sign, 4 all else (quotes and brackets of special tokens, other scripts).
_KIND = np.full(256, 4, np.uint8)
_KIND[list(SEPARATORS)] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "'<|>"]] = 3
#: Whether a text may be cut between two kinds: at white space, where plain kinds differ, and after each digit.
_CUT = np.array([[0 in (a, b) or (4 not in (a, b) and (a != b or a == 2)) for b in range(5)] for a in range(5)])
_TABLES: dict[str, _Table] = {}


class _Table:
    """Ids of units by a hash: sorted keys, a second hash, and where the ids of each lie."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            steps = json.load(f).get("pre_tokenizer") or {}
        self.wordwise = any((x.get("pattern") or {}).get("Regex") == WORDWISE for x in steps.get("pretokenizers", [steps]))
        self.forget()

    def forget(self) -> None:
        self.keys, self.checks, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, "<u4")
        self.at, self.size, self.again = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts in turn, and how many each has."""
        out = [e.ids for k in range(0, len(texts), 20_000) for e in self.tokenizer.encode_batch_fast(texts[k : k + 20_000], add_special_tokens=False)]
        size = np.fromiter(map(len, out), np.int32, len(out))
        return np.fromiter(itertools.chain.from_iterable(out), "<u4", int(size.sum())), size

    def shrink(self) -> None:
        """Forget the units that were met in one batch only, or else all."""
        kept = np.flatnonzero(self.again)
        if 4 * len(kept) > 3 * REMEMBERED:
            return self.forget()
        size = self.size[kept]
        place = np.arange(int(size.sum())) + np.repeat(self.at[kept] - np.cumsum(size) + size, size)
        self.ids, self.at = self.ids[place], (np.cumsum(size) - size).astype(np.int32)
        self.keys, self.checks, self.size, self.again = self.keys[kept], self.checks[kept], size, np.zeros(len(kept), bool)

    def add(self, keys: np.ndarray, checks: np.ndarray, texts: list[str]) -> None:
        ids, size = self.encoded(texts)
        at = (len(self.ids) + np.cumsum(size) - size).astype(np.int32)
        place = np.searchsorted(self.keys, keys)
        for name, new in (("keys", keys), ("checks", checks), ("at", at), ("size", size), ("again", np.zeros(len(keys), bool))):
            setattr(self, name, np.insert(getattr(self, name), place, new))
        self.ids = np.concatenate([self.ids, ids])

    def known(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys are in the table; they count as met again."""
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        found = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        self.again[place[found]] = True
        return found


def units_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each unit and the row it belongs to; the ids of a text are those of its units in turn.

    A text is cut at white space, after each digit, and between an ASCII letter, digit or plain sign and one of another
    kind. Between other bytes it is not cut: marks combine, and "'s" or a special token is one piece for the tokenizer.
    """
    kind = _KIND[data]
    begins = np.ones(len(data), bool)
    begins[1:] = _CUT[kind[:-1], kind[1:]]
    cuts = offsets[:-1]
    begins[cuts[cuts < len(data)]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids (unsigned 32-bit) of all whole texts in turn, as the tokenizer gives without special tokens, and their bounds.

    With a tokenizer that splits by WORDWISE, each distinct unit is encoded once and remembered by a hash (a second hash
    tells units apart that share the first); ids of all units are then gathered at once. Others see whole texts.
    """
    table = _TABLES.get(path) or _TABLES.setdefault(path, _Table(path))
    if not table.wordwise:
        ids, size = table.encoded([t or "" for t in texts.to_pylist()])
        return ids, np.concatenate([[0], np.cumsum(size)])
    data, offsets = text_bytes(texts)
    starts, ends, rows = units_of(data, offsets)
    keys, checks = word_hashes(data, starts, ends), word_hashes(data, starts, ends, seed=29)
    unit = lambda i: data[starts[i] : ends[i]].tobytes().decode()
    distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    found = table.known(distinct)
    if len(table.keys) + len(distinct) - found.sum() > REMEMBERED:
        table.shrink()
        found = table.known(distinct)
    new = first[~found]
    table.add(keys[new], checks[new], [unit(i) for i in new])
    entry = np.searchsorted(table.keys, distinct)[inverse]
    at, size, ids = table.at[entry], table.size[entry], table.ids
    if len(odd := np.flatnonzero(table.checks[entry] != checks)):
        more, n = table.encoded([unit(i) for i in odd])
        at[odd], size[odd], ids = len(ids) + np.cumsum(n) - n, n, np.concatenate([ids, more])
    ends_at = np.concatenate([[0], np.cumsum(size)])
    bounds = ends_at[np.searchsorted(rows, np.arange(len(offsets)))]
    return ids[np.arange(ends_at[-1]) + np.repeat(at - ends_at[:-1], size)], bounds


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Tokenise every whole text, end it with ``end_id`` and cut it into full windows and a rest.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens. A null or empty text has the end id alone.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "text", 2 << 20):
            ids, bounds = token_ids(b.column(1), tokenizer)
            out: list[tuple] = []
            for i, low, high in zip(b.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                n = high - low + 1
                for k in range(0, n, window):
                    crc = zlib.crc32(ids[low + k : min(low + k + window, high)])
                    out.append((i, k, min(window, n - k), crc if k + window < n else zlib.crc32(end, crc), n))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(histogram: np.ndarray, window: int, slack: int) -> list[tuple[int, ...]]:
    """Combinations of one to three lengths that fill the window up to ``slack``, the most common lengths first."""
    present = np.flatnonzero(histogram)
    found = {(int(x),) for x in present[present >= window - slack]}
    for a in present[::-1]:
        i = int(np.searchsorted(present, window - a, side="right")) - 1
        if i >= 0 and a + present[i] >= window - slack:
            found.add((int(a), int(present[i])))
    common = present[np.argsort(-histogram[present] * present, kind="stable")][:DEPTH_LENGTHS]
    for k, a in enumerate(common):
        for b in common[k:]:
            if (room := window - a - b) > 0:
                i = int(np.searchsorted(present, room, side="right")) - 1
                if i >= 0 and present[i] >= room - slack:
                    found.add(tuple(sorted((int(a), int(b), int(present[i])), reverse=True)))
    return sorted(found, reverse=True)


def repeat_counts(combos: list[tuple[int, ...]], histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative least squares: repeats x of the combinations with A x near the histogram (accelerated projected gradient)."""
    width = max(map(len, combos))
    at = np.array([[*c, *[0] * (width - len(c))] for c in combos])
    real = at > 0
    target = histogram.astype(float)
    apply = lambda x: np.bincount(at[real], np.repeat(x, real.sum(1)), len(target))
    back = lambda r: (r[at] * real).sum(1)
    probe = np.ones(len(combos))
    for _ in range(30):
        probe = back(apply(probe))
        probe /= np.linalg.norm(probe) or 1
    rate = 1 / max(1e-9, 1.05 * float(probe @ back(apply(probe))))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * back(apply(y) - target))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (was - 1) / t * (new - x)
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used, so that every piece of the histogram is placed once.

    The rounded-down least-squares repeats come first, as far as pieces last; what is left is packed greedily: the
    longest rest first, then the longest that still fits, as often as the rests allow. Works on counts of lengths, so
    its cost does not depend on how many pieces there are.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    used: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        need = Counter(pattern)
        times = min([times, *(int(left[n]) // k for n, k in need.items())])
        if times > 0:
            used.append((pattern, times))
            for n, k in need.items():
                left[n] -= k * times

    if combos := combinations(left, window, slack=window // 512):
        x = repeat_counts(combos, left)
        for i in np.argsort(-x, kind="stable"):
            take(combos[i], int(x[i] + 1e-6))
    while (present := np.flatnonzero(left)).size:
        pattern, room, rest = [], window, left.copy()
        while room > 0 and (i := int(np.searchsorted(present, room, side="right")) - 1) >= 0:
            while i >= 0 and rest[present[i]] == 0:
                i -= 1
            if i < 0:
                break
            n = int(present[i])
            k = min(int(rest[n]), room // n)
            pattern += [n] * k
            rest[n] -= k
            room -= n * k
        take(tuple(pattern), int(left.max()))
    return used


def pack(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Place every piece in a sequence: adds sequence_id and offset to rows with doc_id, start and length.

    Only the histogram of lengths (at most ``window`` numbers) goes to the driver. Pieces of one length are numbered
    in the order of doc_id and start; the plan's patterns use them up in turn, so a piece finds its place from its
    number alone. No piece gives no rows.
    """
    parts = cut(parts)
    histogram = np.zeros(window + 1, np.int64)
    for n, k in parts.groupBy("length").count().collect():
        histogram[n] = k
    slots: dict[int, list[list[int]]] = {}
    sequence = 0
    for pattern, times in plan(histogram, window):
        offset = 0
        for n, k in sorted(Counter(pattern).items(), reverse=True):
            own = slots.setdefault(n, [])
            own.append([own[-1][1] if own else 0, (own[-1][1] if own else 0) + times * k, sequence, k, offset])
            offset += n * k
        sequence += times
    before = np.concatenate([[0], np.cumsum(histogram)])
    table = {n: np.array(x, np.int64) for n, x in slots.items()}
    ranked = total_over(parts.withColumn("one", F.lit(1)), ["length", "doc_id", "start"], ["one"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("one_end")).to_numpy() - 1 - before[length]
            at, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                rows, t = np.flatnonzero(length == n), table[int(n)]
                i = np.searchsorted(t[:, 1], rank[rows], side="right")
                q, r = np.divmod(rank[rows] - t[i, 0], t[i, 3])
                at[rows], offset[rows] = t[i, 2] + q, t[i, 4] + r * n
            names = [x for x in b.schema.names if x not in ("one", "one_end")]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(at), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kept = ", ".join(f"{n} {t}" for n, t in parts.dtypes)
    return ranked.mapInArrow(run, f"{kept}, sequence_id long, offset long")
