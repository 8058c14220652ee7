"""Fill-in-the-middle documents: cut in two places, the middle moved to the end, whole batches of texts at once.

Every byte has a class, a table over the classes of two neighbouring bytes tells where a unit starts, a running count of
starts that is reset at each text numbers the units, and one search in it finds the cuts of all texts of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import SEPARATORS, fresh, in_pieces, small_batches, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Forms by number, the marks of each and the parts (0 prefix, 1 middle, 2 suffix) behind them.
FORMS = ("plain", "psm", "spm")
_MARKS = np.array([["", "", ""], [PREFIX, SUFFIX, MIDDLE], [SUFFIX, PREFIX, MIDDLE]])
_PARTS = np.array([[0, 1, 2], [0, 2, 1], [2, 0, 1]])


def _classes(*members: list[int]) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for k, m in enumerate(members, 1):
        out[m] = k
    return out


#: For each kind of unit the class (0 or 1) of a byte and, by twice the class of a byte plus that of the next, whether a unit
#: starts at the next: a code point at a byte that continues none, a word with the white space before it, a line with its end.
UNITS = {
    "char": (_classes(list(range(0x80, 0xC0))), np.array([True, False, True, False])),
    "word": (_classes(list(SEPARATORS)), np.array([False, True, False, False])),
    "line": (_classes([10]), np.array([False, False, True, True])),
}


def unit_counts(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The running number of units that start up to each byte, that number before each text, and the units of each text."""
    classes, starts = UNITS[unit]
    kind = classes[data]
    first = np.ones(len(data), bool)
    first[1:] = starts[kind[:-1] * 2 + kind[1:]]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    upto = np.cumsum(first, dtype=np.int64)
    before = np.zeros(len(offsets), np.int64)
    before[offsets > 0] = upto[offsets[offsets > 0] - 1]
    return upto, before[:-1], np.diff(before)


def drawn(key: str, seed: int) -> list[Column]:
    """Four numbers below 2 ** 32 from the first hex digits of sha256 of ``seed:key``; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "char", plain: int = 10, spm: int = 20, seed: int = 1) -> DataFrame:
    """Documents with ``text`` put into its form, and n, form, prefix_units, middle_units (null where plain).

    The two cuts fall evenly on the n + 1 places between units (the same place twice leaves an empty middle). Of texts,
    ``plain`` per cent stay as they are, and of the others ``spm`` per cent have the suffix first; the choice depends on
    the key and the seed alone, so that reruns agree and equal rows have equal results. A null text counts as
    empty; empty texts and those that hold one of the marks stay plain. Other columns pass through, whatever their
    names: a new column whose name is taken gets an underscore before it.
    """
    small_batches(docs.sparkSession)
    new = fresh(docs.columns, "n", "form", "prefix_units", "middle_units")
    draws = fresh([*docs.columns, *new], "h1", "h2", "h3", "h4")
    names = [text if f.name.lower() == text.lower() else f.name for f in docs.schema.fields]
    types = [T.LongType(), T.StringType(), T.LongType(), T.LongType()]
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)), *(T.StructField(n, t) for n, t in zip(new, types, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, text):
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            h = np.stack([columns.pop(d).to_numpy(zero_copy_only=False) for d in draws])
            columns[text], n, form, bounds = rearranged(columns[text], h, unit, plain, spm)
            without = form == 0
            extra = [pa.array(n), pa.array(np.array(FORMS)[form]), pa.array(bounds[0], mask=without), pa.array(bounds[1] - bounds[0], mask=without)]
            yield pa.RecordBatch.from_arrays([*columns.values(), *extra], names=[*columns, *new])

    return docs.toDF(*names).withColumns(dict(zip(draws, drawn(key, seed), strict=True))).mapInArrow(run, schema)


def rearranged(texts: pa.Array, h: np.ndarray, unit: str, plain: int, spm: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Texts in their forms, their units, the forms' numbers, and how many units lie before either cut."""
    data, offsets = text_bytes(texts)
    upto, before, n = unit_counts(data, offsets, unit)
    bounds = np.sort(h[:2] % (n + 1), axis=0)
    cuts = np.searchsorted(upto, before + bounds + 1)
    marked = np.zeros(len(texts), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.fill_null(pc.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
    form = np.where((n == 0) | marked | (h[2] % 100 >= 100 - plain), 0, np.where(h[3] % 100 < spm, 2, 1))
    # the three parts of all texts, one after another, are slices of the same bytes
    edges = np.append(np.stack([offsets[:-1], *cuts], axis=1).ravel(), offsets[-1])
    parts = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    pieces = []
    for i in range(3):
        pieces += [pa.array(_MARKS[form, i], pa.large_string()), parts.take(pa.array(np.arange(len(texts)) * 3 + _PARTS[form, i]))]
    return pc.binary_join_element_wise(*pieces, pa.scalar("", pa.large_string())).cast(pa.string()), n, form, bounds


def restored(output: str = "text", form: str = "form") -> Column:
    """The text that a document had before, from its output and form alone."""
    parts = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda *order: F.concat(*(F.get(parts, F.lit(i)) for i in order))
    return F.when(F.col(form) == "psm", part(1, 3, 2)).when(F.col(form) == "spm", part(2, 3, 1)).otherwise(F.col(output))
