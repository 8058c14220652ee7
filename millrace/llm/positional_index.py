"""A positional inverted index of the corpus: exact phrases and terms near each other, found by intersecting posting lists.

The index is a table: for each segment (a batch of whole documents) and term the places of the term, counted through the
segment's documents, and one row without a term that names the documents. A search reads the lists of its own terms only,
gathers them by segment, and intersects them from the rarest term on, each list moved by the term's offset in the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import fresh, in_pieces, small_batches, text_bytes, total_over, written

#: Words of a benchmark window.
WINDOW = 10
#: Places between two documents of a segment: what is further apart than documents of one segment never meets.
GAP = 1 << 12
#: Bytes of query texts that one search sends to all tasks; larger query sets are searched in blocks.
QUERY_BYTES = 16 << 20
#: Candidate places that are intersected at once.
CANDIDATES = 1 << 20

INDEX = T.StructType([T.StructField("segment", T.LongType()), T.StructField("term", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("rows", T.ArrayType(T.LongType()))])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[0x30:0x3A] = _IN_TERM[0x61:0x7B] = _IN_TERM[0x80:] = True


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a string column (A-Z lower-cased; runs of digits, letters a-z and bytes from 0x80 on) and the terms of each row."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    inside = _IN_TERM[data]
    starts_term, ends_term = inside.copy(), inside.copy()
    starts_term[1:] &= ~inside[:-1]
    ends_term[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts_term[cuts], ends_term[cuts - 1] = inside[cuts], inside[cuts - 1]
    starts, ends = np.flatnonzero(starts_term), np.flatnonzero(ends_term) + 1
    edges = np.stack([starts, ends], axis=1).ravel()  # term, gap, term, ... are slices of the same bytes
    if not len(edges):
        return pa.array([], pa.large_string()), np.zeros(len(column), np.int64)
    slices = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    terms = slices.take(pa.array(np.arange(0, len(edges), 2))).cast(pa.large_string())
    return terms, np.diff(np.searchsorted(starts, offsets))


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all texts as a table in the shared folder. Its row numbers are those of ``numbered``; texts may be null or empty.

    A batch of documents of about 4 MB (or one longer document) is a segment; nothing is shuffled. ``places`` are gaps to the
    place before, in the order of the segment; the row without a term has each document's number of terms there and the
    documents' keys in ``rows``.
    """
    small_batches(docs.sparkSession)
    (column,) = fresh([key], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for b in in_pieces(batches, column):
            terms, n = terms_of(b.column(1))
            place = np.arange(len(terms)) + np.repeat(np.arange(len(n)), n) * GAP
            if len(terms) + len(n) * GAP >= 2**31:
                raise OverflowError("a segment has too many places")
            coded = terms.dictionary_encode()
            ids = coded.indices.to_numpy()
            order = np.argsort(ids, kind="stable")
            places, many = place[order], np.bincount(ids, minlength=len(coded.dictionary))
            first = np.cumsum(many) - many
            gaps = np.diff(places, prepend=0)
            gaps[first] = places[first]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0, len(n)], len(n) + first + many]).astype(np.int32)), pa.array(np.concatenate([n, gaps]).astype(np.int32)))
            rows = pa.array([b.column(0).to_pylist(), *[None] * len(many)], pa.list_(pa.int64()))
            names = pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary.cast(pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lists), segment)), names, lists, rows], names=INDEX.names)
            segment += 1

    return written(docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(column)).mapInArrow(run, INDEX))


@dataclass(frozen=True)
class Phrases:
    """Query terms by number, the distinct phrases as numbers one after another, and the query of each (phrase, query) pair."""

    terms: list[str]
    numbers: np.ndarray
    lengths: np.ndarray
    phrase: np.ndarray
    query: np.ndarray
    keys: list[str]


def phrases_of(keys: list[str], texts: list[str | None], window: int | None) -> Phrases:
    """Windows of ``window`` terms of each text (all its terms where it has fewer, or where ``window`` is None)."""
    terms, n = terms_of(pa.array(texts, pa.string()))
    coded = terms.dictionary_encode()
    ids, ends = coded.indices.to_numpy(), np.cumsum(n)
    names = {k: i for i, k in enumerate(sorted(set(keys)))}
    known: dict[tuple, int] = {}
    pairs = set()
    for key, end, many in zip(keys, ends, n, strict=True):
        width = min(many, window or many)
        for at in range(end - many, end - width + 1) if many else ():
            pairs.add((known.setdefault(tuple(ids[at : at + width].tolist()), len(known)), names[key]))
    lengths = np.array([len(p) for p in known], np.int64)
    numbers = np.array([t for p in known for t in p], np.int32)
    phrase, query = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
    return Phrases(coded.dictionary.to_pylist(), numbers, lengths, phrase, query, list(names))


class Lists:
    """Posting lists of one segment, merged into one sorted array of (term number, place)."""

    def __init__(self, postings: pa.Table, terms: list[str]):
        number = pc.index_in(postings["term"].combine_chunks(), pa.array(terms, pa.string())).to_numpy(zero_copy_only=False)
        self.many = np.zeros(len(terms), np.int64)
        self.first = np.zeros(len(terms), np.int64)
        order = np.argsort(number)
        places = postings["places"].combine_chunks()
        sizes = pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64)
        places = places.take(pa.array(order)).flatten().to_numpy().astype(np.int64)
        number, sizes = number[order], sizes[order]
        starts = np.cumsum(sizes) - sizes
        total = np.cumsum(places)
        self.place = total - np.repeat(total[starts] - places[starts], sizes) if len(sizes) else total
        self.many[number], self.first[number] = sizes, starts
        self.key = np.repeat(number.astype(np.int64), sizes) << 32 | self.place

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = term.astype(np.int64) << 32 | place
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return (self.key[at] == key) & (place >= 0)

    def phrases(self, numbers: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, start) of every occurrence: the rarest term's list, moved by its offset, intersected with the next rarer one's."""
        inside = np.arange(lengths.max(initial=0)) < lengths[:, None]
        padded = np.zeros(inside.shape, np.int64)
        padded[inside], numbers = numbers, padded
        sizes = np.where(inside, self.many[numbers], 2**62)
        asked = np.flatnonzero((sizes > 0).all(axis=1) & (lengths > 0))
        rarity = np.argsort(sizes[asked], axis=1, kind="stable")
        many = np.take_along_axis(sizes[asked], rarity[:, :1], axis=1)[:, 0]
        upto = np.cumsum(many)
        at = 0
        while at < len(asked):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CANDIDATES, side="right")))
            own, n = np.arange(at, to), many[at:to]
            row = np.repeat(own, n)
            offset = rarity[row, 0]
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = self.place[self.first[numbers[asked[row], offset]] + nth] - offset
            for step in range(1, numbers.shape[1]):
                offset = rarity[row, step]
                beyond = step >= lengths[asked[row]]
                kept = beyond | self.has(numbers[asked[row], offset], start + offset)
                row, start = row[kept], start[kept]
                if not len(row):
                    break
            yield asked[row], start
            at = to

    def near(self, terms: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of every shortest run of at most ``within`` places that holds all ``terms``, in any order."""
        terms = np.unique(terms)
        if not len(terms) or not self.many[terms].all():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        terms = terms[np.argsort(self.many[terms], kind="stable")]
        place = lambda t: self.place[self.first[t] : self.first[t] + self.many[t]]
        low = high = place(terms[0])
        for t in terms[1:]:  # the rarest term's places that have every other within reach
            at = np.searchsorted(place(t), low - within + 1)
            padded = np.append(place(t), 2**62)
            low = low[padded[at] < low + within]
        # a run may start at any place of a term within reach of a place that is left
        starts = np.unique(np.concatenate([p[(np.searchsorted(low, p + within, side="left") > np.searchsorted(low, p - within + 1))] for p in map(place, terms)]))
        high = starts
        for t in terms:
            padded = np.append(place(t), 2**62)
            high = np.maximum(high, padded[np.searchsorted(place(t), starts)])
        found = high < starts + within
        found[:-1] &= high[:-1] < high[1:]  # else the next start has the same end
        return starts[found], high[found]


def blocks(queries: DataFrame, key: str, text: str, most: int) -> Iterator[tuple[list[str], list[str | None]]]:
    """Keys (as strings) and texts of queries in blocks of about ``most`` bytes; queries without a key are the one named by an empty string."""
    own = queries.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text")).withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    if (own.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) <= most:
        parts = [own]
    else:
        placed = written(total_over(own, ["key", "text"], ["bytes"]).withColumn("block", F.expr(f"(bytes_end - bytes) DIV {most}")))
        parts = [placed.where(F.col("block") == r["block"]) for r in placed.select("block").distinct().orderBy("block").collect()]
    for p in parts:
        rows = p.select("key", "text").collect()
        yield [r["key"] for r in rows], [r["text"] for r in rows]


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (sorted) and ends of runs, those that overlap or touch merged."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


FOUND = T.StructType([T.StructField("segment", T.LongType()), T.StructField("nth", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


def _search(index: DataFrame, found: Phrases, within: int | None) -> DataFrame:
    """A row per document: its key and number of terms, the merged runs of places that matches cover, and the queries that match.

    ``within`` None: phrases; else all terms of a phrase in any order within so many places.
    """
    wanted = index.sparkSession.createDataFrame([(t,) for t in found.terms], "term string")
    lists = index.join(F.broadcast(wanted), "term", "left_semi").unionByName(index.where("term IS NULL"))

    def run(table: pa.Table) -> pa.Table:
        head = table.filter(pc.is_null(table["term"]))
        lists = Lists(table.filter(pc.is_valid(table["term"])), found.terms)
        keys, n = head["rows"][0].as_py(), head["places"][0].values.to_numpy().astype(np.int64)
        first = np.cumsum(n) - n + np.arange(len(n)) * GAP
        hit: list[tuple[np.ndarray, ...]] = []
        if len(lists.key) and within is None:
            hit = [(p, s, s + found.lengths[p]) for p, s in lists.phrases(found.numbers, found.lengths)]
        elif len(lists.key):
            for p, own in enumerate(np.split(found.numbers, np.cumsum(found.lengths)[:-1])):
                s, e = lists.near(own, within)
                hit.append((np.full(len(s), p), s, e + 1))
        phrase, start, end = (np.concatenate(x) if hit else np.zeros(0, np.int64) for x in (zip(*hit, strict=True) if hit else [()] * 3))
        doc = np.searchsorted(first, start, side="right") - 1
        where, which = np.divmod(np.unique(doc * max(1, len(found.lengths)) + phrase), max(1, len(found.lengths)))
        items: dict[int, set[int]] = {}
        for d, x, y in zip(where.tolist(), np.searchsorted(found.phrase, which).tolist(), np.searchsorted(found.phrase, which, side="right").tolist(), strict=True):
            items.setdefault(d, set()).update(found.query[x:y].tolist())
        order = np.argsort(start, kind="stable")
        start, end = _spans(start[order], end[order])
        doc = np.searchsorted(first, start, side="right") - 1
        bounds = np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32)
        base = first[doc]
        runs = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x - base)) for x in (start, end)]
        names = pa.array([sorted(found.keys[q] for q in items.get(d, ())) for d in range(len(n))], pa.list_(pa.string()))
        return pa.table([pa.array(np.full(len(n), head["segment"][0].as_py())), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(keys, pa.int64()), pa.array(n), *runs, names], names=FOUND.names)

    return lists.groupBy("segment").applyInArrow(run, FOUND)


def _together(parts: list[DataFrame]) -> DataFrame:
    """The results of several blocks of queries as one: runs merged, queries joined."""
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    runs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    every = every.groupBy("segment", "nth").agg(F.first("row").alias("row"), F.first("n_words").alias("n_words"), runs.alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.expr("""aggregate(runs, CAST(array() AS array<struct<starts: bigint, ends: bigint>>), (done, r) ->
        IF(size(done) > 0 AND r.starts <= element_at(done, -1).ends,
           concat(slice(done, 1, size(done) - 1), array(named_struct('starts', element_at(done, -1).starts, 'ends', greatest(element_at(done, -1).ends, r.ends)))),
           concat(done, array(r))))""")
    return every.withColumn("runs", merged).select("segment", "nth", "row", "n_words", F.col("runs.starts").alias("starts"), F.col("runs.ends").alias("ends"), "items")


def _matches(index: DataFrame, queries: DataFrame, window: int | None, within: int | None, key: str, text: str, name: str, most: int) -> DataFrame:
    parts = [_search(index, phrases_of(keys, texts, window), within) for keys, texts in blocks(queries, key, text, most)]
    return _together(parts).select(F.col("row").alias(name), "n_words", "starts", "ends", "items")


def phrase_matches(index: DataFrame, queries: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text", name: str = "doc_id", most: int = QUERY_BYTES) -> DataFrame:
    """A row per document of the index: its terms, the runs of terms covered by windows of queries, and those queries.

    A window is ``window`` consecutive terms of a query's text, or all of them where it has fewer. Runs are [start, end)
    in terms, merged. ``items`` are distinct keys as strings, sorted. Queries without terms match nothing; those that
    share a key are one, those without a key are the one named by an empty string. Documents that repeat a key are judged
    one by one. Query sets of more than ``most`` bytes are searched in blocks.
    """
    return _matches(index, queries, window, None, key, text, name, most)


def proximity_matches(index: DataFrame, queries: DataFrame, within: int, key: str = "item_id", text: str = "text", name: str = "doc_id", most: int = QUERY_BYTES) -> DataFrame:
    """As ``phrase_matches``, where all distinct terms of a query lie, in any order, within a run of ``within`` terms (less than GAP)."""
    if not 0 < within < GAP:
        raise ValueError(f"within must be between 1 and {GAP - 1}")
    return _matches(index, queries, None, within, key, text, name, most)


def n_hit() -> Column:
    """Terms in the runs of a match."""
    return F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
