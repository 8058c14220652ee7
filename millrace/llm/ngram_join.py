"""Exact Jaccard join on word n-grams with PartEnum signatures, and the groups of near duplicates it links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, cut, in_pieces, mixed, multipliers, release, small_batches, text_bytes, window_hashes, word_hashes, words_of, written

WIDTH, LEAST = 5, 75
#: Differences that a partition may have, and second-level partitions: subsets of CELLS - SPOILED of them are enumerated.
SPOILED, CELLS = 1, 2
#: Partitions beyond those that must agree, as a part of these: so many more signatures are asked for.
BEYOND = 0.25
#: Up to how many documents with a signature all pairs of them are counted; beyond, other ways find the links.
RUN = 32
#: The same for the rarest elements of documents; cells of the table that tells which elements are common (a byte each), and of one of its parts.
KEY_RUN, COMMON_CELLS, COMMON_PART = 8, 1 << 23, 1 << 17
#: Signatures that a sample of about so many documents has more than RUN times are not shuffled; at most so many are told apart. Neither
#: changes the result, only where the work is done.
HOT_SAMPLE, HOT_MOST = 4_000, 20_000
#: Bytes of signatures that one bucket should hold; bytes of text or sets that a worker holds at once (a longer one is taken alone).
BUCKET_BYTES, PIECE = 16 << 20, 1 << 20
#: Bits of the bitmap of documents whose sets are compared.
NAME_BITS = 1 << 23
#: Elements of sets in a block of documents that are compared with each other; ratio of the sizes of two neighbouring size bands of blocks.
BLOCK_ELEMENTS, BAND_RATIO = 200_000, 1.34
#: Bits of a signature, and of its part that a bucket keeps (the bucket tells the rest); entries that are enumerated at once; sets that a
#: task remembers to have signed.
_SIG_BITS, _KEPT_BITS, _ENTRIES, _SEEN = 60, 32, 4096, 200_000
_HEAD = [("id", np.int64), ("set", np.uint64), ("need", np.uint32), ("n", np.uint32), ("sigs", np.uint32)]
_HOT = [("id", np.int64), ("need", np.uint32), ("sigs", np.uint32), ("star", np.int64)]


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word windows of each whole text, sorted, one text after another, and their bounds.

    A-Z are lower-cased; a text with fewer words is one window; one without words has none.
    """
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    starts, ends, rows = words_of(data, offsets)
    words = word_hashes(data, starts, ends, lower=True)
    keys, owner, _ = window_hashes(words, rows, width)
    counts = np.bincount(rows, minlength=n)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.searchsorted(rows, short)
        place = multipliers(width, 13)
        whole = np.array([int((words[a : a + c] * place[:c]).sum()) for a, c in zip(first, counts[short], strict=True)], np.uint64)
        keys = np.concatenate([keys, mixed(whole + counts[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    out = [np.unique(keys[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.cumsum([0, *map(len, out)])


#: Salts of the two hashes of a whole set.
SALTS = (0x5DEECE66D, 0x2545F4914F6CDD1D)


def _whole(hashes: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes ^ np.uint64(salt)))])
    return mixed(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def odd_sketch(hashes: np.ndarray) -> bytes:
    """Bits that tell which cells of the domain have an odd number of a set's elements, four to eight cells for each element."""
    bits = max(6, int(4 * max(1, len(hashes)) - 1).bit_length())
    odd = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def odd_distance(a: bytes, b: bytes) -> int:
    """In how many cells the parities of two sets differ: never more than the elements in which the sets differ."""
    a, b = sorted((np.unpackbits(np.frombuffer(x, np.uint8)) for x in (a, b)), key=len)
    while len(b) > len(a):
        b = b[::2] ^ b[1::2]
    return int((a ^ b).sum())


def bands(largest: int, least: int = LEAST) -> np.ndarray:
    """Upper bounds of the size bands: a set's possible partners are in its band or the next one."""
    out = [0, 1]
    while out[-1] < largest * 100 / least + 1:
        out.append(max(out[-1] + 1, out[-1] * 100 // least))
    return np.array(out, np.int64)


def signatures(hashes: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures (of _SIG_BITS bits) of sets and the set each belongs to, sorted by set; how many a near set must share.

    For a band with sizes up to m, two sets within the similarity differ in at most k = m (200 - 2 least) / (100 + least)
    elements. The domain (hash values) is cut into k // 2 + 1 partitions and a quarter more, and each into CELLS cells. A
    partition with at most SPOILED differences agrees in CELLS - SPOILED of its cells at least, so every subset of so many cells
    gives a signature: a hash of the elements there. At most k // (SPOILED + 1) partitions have more differences. So two near sets share a signature
    for each partition but k // (SPOILED + 1) of those in which one of them has elements in more than SPOILED cells. A set in which that
    leaves none also gives the signatures of a second scheme, its first k + 1 elements by hash.
    """
    sizes = np.diff(bounds)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.ones(len(sizes), np.int64)
    if not len(sizes) or not sizes.max():
        return none
    tops = bands(int(sizes.max()), least)
    band = np.searchsorted(tops, sizes)
    far = sizes * 100 // least
    sets, levels = [], []
    for step in (0, 1):
        level = band + step
        real = (sizes > 0) & (step == 0 or far > tops[np.minimum(level - 1, len(tops) - 1)])
        sets.append(np.flatnonzero(real))
        levels.append(level[real])
    owner, level = np.concatenate(sets), np.concatenate(levels)
    most = tops[np.minimum(level, len(tops) - 1)]
    differ = (sizes[owner] + np.minimum(most, far[owner])) * (100 - least) // (100 + least)
    keep = differ > 0  # sets that may not differ at all are equal
    owner, level, most, differ = owner[keep], level[keep], most[keep], differ[keep]
    bad = 2 * most * (100 - least) // (100 + least) // (SPOILED + 1)
    parts = bad + 1 + np.ceil(BEYOND * bad).astype(np.int64)
    need = np.full(len(sizes), np.iinfo(np.int64).max)
    found, belongs = [none[0]], [none[1]]
    # a few entries at a time, of bounded size together; a large set is taken alone
    ends = np.cumsum(sizes[owner])
    at = 0
    while at < len(owner):
        to = max(at + 1, min(at + _ENTRIES, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE // 8, side="right"))))
        part = slice(at, to)
        sig, own, thick = _enumerated(hashes, bounds, owner[part], level[part], parts[part])
        sure = thick - differ[part] // (SPOILED + 1)
        np.minimum.at(need, owner[part], np.maximum(1, sure))
        found.append(sig)
        belongs.append(own)
        if len(few := np.flatnonzero(sure < 1)):
            sig, own = _first(hashes, bounds, owner[part][few], level[part][few], differ[part][few])
            found.append(sig)
            belongs.append(own)
        at = to
    found, belongs = np.concatenate(found), np.concatenate(belongs)
    order = np.argsort(belongs, kind="stable")
    need[need == np.iinfo(np.int64).max] = 1
    return found[order] >> np.uint64(64 - _SIG_BITS), belongs[order], need


def _elements(bounds: np.ndarray, owner: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, place and rank of the first ``lengths`` elements of each owner's set."""
    entry = np.repeat(np.arange(len(owner)), lengths)
    rank = np.arange(len(entry)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return entry, rank + np.repeat(bounds[owner], lengths), rank


def _enumerated(hashes: np.ndarray, bounds: np.ndarray, owner: np.ndarray, level: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of every subset of cells of every partition that has elements, their sets, and how many partitions of
    each entry (a set at a level) have elements in more than SPOILED cells. With SPOILED = 1, a subset leaves one cell out."""
    entry, place, _ = _elements(bounds, owner, np.diff(bounds)[owner])
    h = hashes[place]
    part = (h >> np.uint64(32)) * parts[entry].astype(np.uint64) >> np.uint64(32)
    cell = (h & np.uint64(0xFFFFFFFF)) * np.uint64(CELLS) >> np.uint64(32)
    new = np.ones(len(h), bool)
    new[1:] = (part[1:] != part[:-1]) | (entry[1:] != entry[:-1])
    starts = np.flatnonzero(new)
    h = mixed(h)
    sums = [np.add.reduceat(np.where(cell == np.uint64(c), h, np.uint64(0)), starts) for c in range(CELLS)]
    own = entry[starts]
    where = part[starts] * np.uint64(CELLS) + level[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    thick = np.bincount(own[sum((x > 0).astype(np.int64) for x in sums) > SPOILED], minlength=len(owner))
    found, belongs = [], []
    for left_out in range(CELLS):
        total = sum(x for c, x in enumerate(sums) if c != left_out)
        some = np.flatnonzero(total)
        found.append(mixed(total[some] + mixed(where[some] + np.uint64(left_out))))
        belongs.append(owner[own[some]])
    return np.concatenate(found), np.concatenate(belongs), thick


def _first(hashes: np.ndarray, bounds: np.ndarray, owner: np.ndarray, level: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``differ`` + 1 elements of each entry as signatures of their own."""
    entry, place, _ = _elements(bounds, owner, np.minimum(np.diff(bounds)[owner], differ + 1))
    return mixed(mixed(hashes[place]) + level[entry].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)), owner[entry]


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, each in as many bytes as the largest needs, after a byte that says how many."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _widened(blob: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """``n`` numbers that _narrow wrote at a place, and the place after them."""
    width = blob[at]
    return np.frombuffer(blob, f"<u{width}", n, at + 1).astype(np.uint64), at + 1 + n * width


def _blob(head: np.ndarray, copied: np.ndarray, sigs: np.ndarray) -> bytes:
    """Documents (_HEAD, by id) and their signatures in few bytes, as most documents have one or two signatures in a bucket.

    Ids are written as differences. Hashes of sets are those of ``copied`` documents only. Sizes and needed numbers are cut off where
    their bytes end: both are lower bounds then, which let more pairs pass, never fewer.
    """
    ids = head["id"].view(np.uint64)
    parts = [np.uint32(len(head)).tobytes(), ids[:1].tobytes(), _narrow(np.diff(ids)), _narrow(head["sigs"]), np.packbits(copied).tobytes(), head["set"][copied].tobytes()]
    return b"".join([*parts, np.minimum(head["n"], 0xFFFF).astype("<u2").tobytes(), np.minimum(head["need"], 0xFF).astype("<u1").tobytes(), sigs.astype("<u4").tobytes()])


def _open(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What _blob wrote: documents, whether they are copied ones, signatures."""
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    head = np.zeros(n, _HEAD)
    steps, at = _widened(blob, 12, n - 1)
    head["id"] = np.cumsum(np.concatenate([np.frombuffer(blob, "<u8", 1, 4), steps]), dtype=np.uint64).view(np.int64)
    head["sigs"], at = _widened(blob, at, n)
    copied = np.unpackbits(np.frombuffer(blob, np.uint8, -(-n // 8), at), count=n).astype(bool)
    at += -(-n // 8)
    head["set"][copied] = np.frombuffer(blob, "<u8", int(copied.sum()), at)
    at += 8 * int(copied.sum())
    head["n"], head["need"] = np.frombuffer(blob, "<u2", n, at), np.frombuffer(blob, "<u1", n, at + 2 * n)
    return head, copied, np.frombuffer(blob, "<u4", int(head["sigs"].sum()), at + 3 * n).astype(np.uint64)


def _spread(ids: np.ndarray, whole: np.ndarray, copied: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, buckets: int, hot: tuple[np.ndarray, np.ndarray], least: int) -> Iterator[tuple[int, bytes]]:
    """Signatures dealt to buckets: for each, its documents (id, hash of a ``copied`` set, size, signatures here, how many to share) and the signatures.

    Hot signatures are counted only: a bucket below 0 has documents with how many they have, and the sampled document that
    most of these name.
    """
    sig, owner, need = signatures(hashes, bounds, least)
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    ids, whole, copied, need, n, owner = ids[by_id], whole[by_id], copied[by_id], need[by_id], np.diff(bounds)[by_id], rank[owner]
    bucket, star = (sig % np.uint64(buckets)).astype(np.int64), np.full(len(ids), np.iinfo(np.int64).max)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], sig), len(hot[0]) - 1)
        is_hot = hot[0][at] == sig
        bucket[is_hot] = -1
        named = np.stack([owner[is_hot], hot[1][at[is_hot]]], axis=1)
        named, times = np.unique(named, axis=0, return_counts=True)
        best = np.lexsort((-named[:, 1], times, named[:, 0]))  # of equal counts the smallest document comes last, as it counts
        star[named[best, 0]] = named[best, 1]
    key = (bucket + 1) * len(ids) + owner
    order = np.argsort(key, kind="stable")
    key, sig = key[order], sig[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    head = np.zeros(len(starts), _HEAD)
    who = key[starts] % max(1, len(ids))
    head["id"], head["set"], head["need"], head["n"], head["sigs"] = ids[who], whole[who], need[who], n[who], np.diff(np.append(starts, len(key)))
    at = np.searchsorted(key[starts] // max(1, len(ids)), np.arange(buckets + 2))
    ends = np.append(starts, len(key))
    for k in np.flatnonzero(np.diff(at)):
        part = slice(at[k], at[k + 1])
        if not k:
            out = np.zeros(at[1], _HOT)
            out["id"], out["need"], out["sigs"], out["star"] = head["id"][part], head["need"][part], head["sigs"][part], star[who[part]]
            yield -1 - int(whole[0] % np.uint64(buckets)), out.tobytes()
        else:
            yield int(k) - 1, _blob(head[part], copied[who[part]], sig[ends[at[k]] : ends[at[k + 1]]] // np.uint64(buckets) & np.uint64((1 << _KEPT_BITS) - 1))


_OUT = "kind int, u long, v long, n long, key long"


def _rows(rows: list[tuple]) -> list[pa.Array]:
    kinds = np.concatenate([np.full(len(r[1]), r[0], np.int32) for r in rows])
    return [pa.array(kinds), *(pa.array(np.concatenate([r[i].astype(np.int64) for r in rows])) for i in (1, 2, 3, 4))]


def _matched(table: pa.Table, buckets: int, least: int) -> pa.Table:
    """One bucket. kind 1: pairs in short runs of a signature, the n signatures they share and the number they need (key);
    kind 3: how many signatures of document u are in long runs (n), and how many it must share (key); kind 4: document v
    of long runs and the smallest document u of these.

    Documents with equal sets count as the one with the smallest id, which is the same in every bucket. A bucket below 0 has
    documents with hot signatures: kinds 3 and 4 only, u being one of the sampled documents.
    """
    bucket = table.column("bucket")[0].as_py()
    none = lambda n: np.zeros(n, np.int64)
    if bucket < 0:
        head = np.concatenate([np.frombuffer(b.as_buffer(), _HOT) for b in table.column("blob")])
        other = head["star"] != head["id"]
        low, high = np.minimum(head["star"], head["id"])[other], np.maximum(head["star"], head["id"])[other]
        return pa.table(_rows([(3, head["id"], none(len(head)), head["sigs"], head["need"]), (4, low, high, none(len(low)), none(len(low)))]), names=["kind", "u", "v", "n", "key"])
    heads, copies, sigs = zip(*(_open(b.as_py()) for b in table.column("blob")), strict=True)
    head, copied, sig = np.concatenate(heads), np.concatenate(copies), np.concatenate(sigs)
    order = np.lexsort((head["id"], head["set"], copied))
    first = np.ones(len(head), bool)
    first[1:] = ~copied[order][1:] | (head["set"][order][1:] != head["set"][order][:-1]) | ~copied[order][:-1]
    chosen = np.zeros(len(head), bool)
    chosen[order[first]] = True
    doc = np.repeat(np.arange(len(head)), head["sigs"].astype(np.int64))
    sig, doc = sig[chosen[doc]], doc[chosen[doc]]
    by_id = np.argsort(head["id"], kind="stable")
    rank = np.empty(len(head), np.int64)
    rank[by_id] = np.arange(len(head))
    head = head[by_id]
    order = np.lexsort((rank[doc], sig))
    sig, doc = sig[order], rank[doc[order]]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    length = np.diff(np.append(start, len(sig)))
    run = np.repeat(np.arange(len(start)), length)
    small = length[run] <= RUN
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, RUN):
        i = np.flatnonzero((run[d:] == run[:-d]) & small[d:] & (doc[d:] != doc[:-d]))
        u.append(doc[i])
        v.append(doc[i + d])

    def pairs(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, times = np.unique(u << 32 | v, return_counts=True)
        a, b = head[key >> 32], head[key & 0xFFFFFFFF]
        near = np.minimum(a["n"], b["n"]).astype(np.int64) * 100 >= np.maximum(a["n"], b["n"]).astype(np.int64) * least
        return a[near], b[near], times[near]

    a, b, times = pairs(np.concatenate(u), np.concatenate(v))
    waits = np.flatnonzero(~small)
    star = np.full(len(head), len(head), np.int64)
    np.minimum.at(star, doc[waits], doc[start[run[waits]]])
    member = np.flatnonzero(star < np.arange(len(head)))
    c, d, _ = pairs(star[member], member)
    shared = np.bincount(doc[waits], minlength=len(head))
    some = np.flatnonzero(shared)
    rows = [
        (1, a["id"], b["id"], times, np.maximum(a["need"], b["need"])),
        (3, head["id"][some], none(len(some)), shared[some], head["need"][some]),
        (4, c["id"], d["id"], none(len(c)), none(len(c))),
    ]
    return pa.table(_rows(rows), names=["kind", "u", "v", "n", "key"])


def _by_piece(batches: Iterator[pa.RecordBatch], column: str = "set") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with the elements of their sets and the bounds of these."""
    for b in in_pieces(batches, column, PIECE):
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(b.schema.get_field_index(column))]
        yield b, np.concatenate(sets), np.cumsum([0, *map(len, sets)])


def _slot(c: str) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(53)), F.lit(NAME_BITS))


def _names(ids: DataFrame) -> Broadcast:
    """A bitmap of the _slot of ``ids`` (one column), sent to all tasks."""
    of_slots = ids.select((_slot(ids.columns[0]) + 1).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    bits = np.zeros(NAME_BITS // 8, np.uint8)
    for r in of_slots.collect():
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[(r["bucket"] - 1) * len(part) : r["bucket"] * len(part)] = part
    return ids.sparkSession.sparkContext.broadcast(bits)


def _is_named(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1 > 0


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (doc_id, ...) whose id may be among ``ids`` (one column), told by a bitmap of NAME_BITS, without a shuffle of the rows.

    A few others pass, and all of them where there are far more ids than bits: a join must follow where that matters.
    """
    bitmap = _names(ids)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(names).filter(pa.array(_is_named(bitmap.value, b.column(len(names)).to_numpy())))

    return rows.withColumn("_slot", _slot("doc_id")).mapInArrow(run, rows.schema)


_RARE = [("doc", np.int64), ("c", np.int64), ("n", np.uint32), ("keys", np.uint32)]


def _met(table: pa.Table, least: int) -> pa.Table:
    """One bucket of rare elements. kind 1: pairs u, v of an element that few documents have; kind 2: documents u (of size v) of
    one that more have. Elements whose documents are in one component are passed over."""
    heads, keys = [], []
    for blob in table.column("blob"):
        n = int(np.frombuffer(blob.as_buffer(), np.uint32, 1)[0])
        heads.append(np.frombuffer(blob.as_buffer(), _RARE, n, 4))
        keys.append(np.frombuffer(blob.as_buffer(), np.uint64, int(heads[-1]["keys"].sum()), 4 + heads[-1].nbytes))
    head, key = np.concatenate(heads), np.concatenate(keys)
    doc = np.repeat(np.arange(len(head)), head["keys"].astype(np.int64))
    order = np.lexsort((head["doc"][doc], key))
    key, doc = key[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.append(start, len(key)))
    c = head["c"][doc]
    open_ = np.repeat(np.minimum.reduceat(c, start) < np.maximum.reduceat(c, start), length)
    few, run = np.repeat(length <= KEY_RUN, length), np.repeat(np.arange(len(start)), length)
    found = [np.zeros((0, 2), np.int64)]
    for d in range(1, KEY_RUN):
        i = np.flatnonzero((run[d:] == run[:-d]) & open_[d:] & few[d:] & (c[d:] != c[:-d]))
        a, b = head[doc[i]], head[doc[i + d]]
        near = np.minimum(a["n"], b["n"]).astype(np.int64) * 100 >= np.maximum(a["n"], b["n"]).astype(np.int64) * least
        found.append(np.stack([a["doc"][near], b["doc"][near]], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    rest = head[np.unique(doc[open_ & ~few])]
    kinds = np.repeat(np.array([1, 2], np.int32), [len(pairs), len(rest)])
    return pa.table([pa.array(kinds), pa.array(np.concatenate([pairs[:, 0], rest["doc"]])), pa.array(np.concatenate([pairs[:, 1], rest["n"].astype(np.int64)]))], names=["kind", "u", "v"])


def _common(docs: DataFrame, buckets: int) -> Broadcast:
    """How common elements are among documents (doc, c, set): a table of COMMON_CELLS bytes, sent to all tasks, with a cell by _cells for each.

    0 stands for elements that up to KEY_RUN documents have, or documents of one component only; the others have a number
    that grows with the logarithm of how many documents have them. Of elements with one cell the most common counts. Elements are counted
    in buckets by 32 bits of hash, and with 32 bits of hash of the components; what is equal in these by chance is taken
    for more common or rarer than it is, in the same way everywhere.
    """
    spark = docs.sparkSession

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, h, bounds in _by_piece(batches):
            low = (mixed(b.column(1).to_numpy().view(np.uint64)) >> np.uint64(32)).repeat(np.diff(bounds))
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key = np.stack([h // np.uint64(buckets) & np.uint64(0xFFFFFFFF), low], axis=1)[order].astype("<u4")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([key[ends[x] : ends[x + 1]].tobytes() for x in some], pa.binary())], names=["bucket", "blob"])

    def counted(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        key, c = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in t.column("blob")]).reshape(-1, 2).T
        order = np.argsort(key, kind="stable")
        key, c = key[order], c[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(np.append(start, len(key)))
        some = (times > KEY_RUN) & (np.minimum.reduceat(c, start) < np.maximum.reduceat(c, start))
        cell = _cells(key[start][some].astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket), buckets)
        level = np.minimum(255, 8 * np.log2(times[some])).astype(np.uint8)
        order = np.argsort(cell)
        cell, level = cell[order], level[order]
        ends = np.searchsorted(cell, np.arange(0, COMMON_CELLS + 1, COMMON_PART))
        parts = np.flatnonzero(np.diff(ends))
        out = [(cell[ends[x] : ends[x + 1]] % COMMON_PART).astype("<u4").tobytes() + level[ends[x] : ends[x + 1]].tobytes() for x in parts]
        return pa.table([pa.array(parts, pa.int32()), pa.array(out, pa.binary())], names=["part", "cells"])

    def gathered(t: pa.Table) -> pa.Table:
        out = np.zeros(COMMON_PART, np.uint8)
        for x in t.column("cells"):
            n = len(x.as_buffer()) // 5
            np.maximum.at(out, np.frombuffer(x.as_buffer(), "<u4", n), np.frombuffer(x.as_buffer(), np.uint8, n, 4 * n))
        return pa.table([t.column("part")[:1].cast(pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["part", "cells"])

    found = docs.mapInArrow(dealt, "bucket int, blob binary").groupBy("bucket").applyInArrow(counted, "part int, cells binary")
    table = np.zeros(COMMON_CELLS, np.uint8)
    for r in found.groupBy("part").applyInArrow(gathered, "part int, cells binary").toLocalIterator():  # COMMON_CELLS bytes at most
        table[r["part"] * COMMON_PART : (r["part"] + 1) * COMMON_PART] = np.frombuffer(bytes(r["cells"]), np.uint8)
    return spark.sparkContext.broadcast(table)


def _cells(h: np.ndarray, buckets: int) -> np.ndarray:
    """The cell of each element in the table of _common, by the part of its hash that a bucket there knows."""
    n = np.uint64(buckets)
    return (mixed((h // n & np.uint64(0xFFFFFFFF)) * n + h % n) % np.uint64(COMMON_CELLS)).astype(np.int64)


def _rare(docs: DataFrame, sets: DataFrame, buckets: int, least: int) -> DataFrame:
    """What _met finds of documents (doc, c) by those elements of each of which two near ones share one, the rarest first.

    Of n elements these are the first n - ceil(n least / 100) + 1 in an order that is the same everywhere: by _common, then by hash.
    """
    own = _among(sets.select("doc_id", "set"), docs.select("doc"))
    both = written(docs.join(own.withColumnRenamed("doc_id", "doc"), "doc").select("doc", "c", "set"))
    table = _common(both, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, h, bounds in _by_piece(batches):
            n = np.diff(bounds)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, table.value[_cells(h, buckets)], owner))
            rank = np.arange(len(h)) - np.repeat(bounds[:-1], n)
            first = rank < (n - -(-n * least // 100) + 1)[owner]
            key, who = h[order][first], owner[first]
            at = np.lexsort((who, key % np.uint64(buckets)))
            key, who, bucket = key[at], who[at], (key[at] % np.uint64(buckets)).astype(np.int64)
            out = []
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            for x in np.flatnonzero(np.diff(ends)):
                part = slice(ends[x], ends[x + 1])
                own, times = np.unique(who[part], return_counts=True)
                head = np.zeros(len(own), _RARE)
                head["doc"], head["c"], head["n"], head["keys"] = b.column(0).to_numpy()[own], b.column(1).to_numpy()[own], n[own], times
                out.append((int(x), np.uint32(len(own)).tobytes() + head.tobytes() + key[part].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "blob"])

    return written(both.mapInArrow(run, "bucket int, blob binary").groupBy("bucket").applyInArrow(lambda t: _met(t, least), "kind int, u long, v long"))


def _compared(docs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Links between documents (doc, c, n) of different components c, found by comparing blocks of documents.

    Documents are dealt to bands by the size of their sets, so that near ones are in one band or in two neighbours, and
    in each band to blocks of bounded size by a hash. Each block meets those of its band and of the next. Within two blocks,
    intersections are counted through an inverted list, and links that join components are given.
    """
    banded = cut(docs.withColumn("band", F.floor(F.log(F.col("n")) / math.log(BAND_RATIO)).cast("int")))
    per = {r["band"]: max(1, -(-r["n"] // BLOCK_ELEMENTS)) for r in banded.groupBy("band").agg(F.sum("n").alias("n")).collect()}  # bands are few: the logarithm of a size
    if not per:
        return docs.select(F.col("doc").alias("u"), F.col("doc").alias("v")).limit(0)
    blocks = F.create_map(*(F.lit(x) for kv in per.items() for x in kv))
    many = lambda band: F.coalesce(F.try_element_at(blocks, band), F.lit(0))
    own = banded.withColumn("block", F.pmod(F.xxhash64("doc", F.lit(47)), many(F.col("band"))).cast("int"))
    group = lambda x, i, y, j: F.struct(x.alias("x"), i.alias("i"), y.alias("y"), j.alias("j"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    band, block = F.col("band"), F.col("block")
    meets = F.concat(
        F.transform(upto(many(band).cast("int")), lambda j: group(band, F.least(block, j), band, F.greatest(block, j))),
        F.transform(upto(many(band + 1).cast("int")), lambda j: group(band, block, band + 1, j)),
        F.transform(upto(many(band - 1).cast("int")), lambda j: group(band - 1, j, band, block)),
    )
    held = _among(sets.select("doc_id", "set"), docs.select("doc")).withColumnRenamed("doc_id", "doc")
    dealt = own.join(held, "doc").withColumn("g", F.explode(meets)).select("g.*", "band", "block", "doc", "c", "set")

    def compare(t: pa.Table) -> pa.Table:
        x, i, y, j = (t.column(k)[0].as_py() for k in "xiyj")
        at, doc, c = (t.column("band").to_numpy(), t.column("block").to_numpy()), t.column("doc").to_numpy(), t.column("c").to_numpy()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("set")]
        own, other = (np.flatnonzero((at[0] == a) & (at[1] == b)) for a, b in ((x, i), (y, j)))
        n = np.array([len(s) for s in sets])
        hashes = np.concatenate([np.zeros(0, np.uint64), *(sets[k] for k in other)])
        holder = np.repeat(np.arange(len(other)), n[other])
        order = np.argsort(hashes, kind="stable")
        hashes, holder = hashes[order], holder[order]
        # links that join two components yet, so that there are fewer than components
        parent: dict[int, int] = {}
        found: list[tuple[int, int]] = []

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = parent[x]
            return x

        for k in own:
            low, high = np.searchsorted(hashes, sets[k], "left"), np.searchsorted(hashes, sets[k], "right")
            much = high - low
            place = np.arange(much.sum()) - np.repeat(np.cumsum(much) - much, much) + np.repeat(low, much)
            both = np.bincount(holder[place], minlength=len(other))
            for m in other[(100 * both >= least * (n[k] + n[other] - both)) & (c[other] != c[k])]:
                if (a := root(int(c[k]))) != (b := root(int(c[m]))):
                    parent[b] = a
                    found.append((min(doc[k], doc[m]), max(doc[k], doc[m])))
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return dealt.groupBy("x", "i", "y", "j").applyInArrow(compare, "u long, v long")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles (size of the set) and component_id, the smallest doc_id reachable by links.

    Two documents link when their sets of distinct 5-word shingles have a Jaccard similarity of ``least`` per cent or
    more. Equal sets are merged first, and one document of each class goes on. Of the documents with a signature, short runs
    give all pairs, of which those with enough signatures in common are candidates, and long runs a star around their first;
    a candidate is verified on whole sets only where it joins two components. Signatures that a sample shows to be in long
    runs are never gathered: a document with fewer of them than it must share needs none, and the others are found with
    those of long runs. Members of long runs that then still span components are joined by their rarest elements, and
    those whose rarest elements are common too are compared block by block, so no link is lost.

    A null, empty or blank text has an empty set and links with nothing; fewer than five words are one shingle.
    Rows of one doc_id count as one document, that of the smallest hash, and give one row; rows without a doc_id give
    a row each, without a component. An empty table gives no rows. Other columns are not carried.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "text", PIECE):
            hashes, bounds = shingle_sets(b.column(1))
            sums = [pa.array(_whole(hashes, bounds, salt)) for salt in SALTS]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds).astype(np.int64)), *sums], names=["doc_id", "n", "a", "b"])

    every = written(rows.mapInArrow(hashed, "doc_id long, n long, a long, b long"))
    ids = every.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("a", "b", "n")).alias("s"), F.count("*").alias("k")).select("doc_id", "s.*", "k")
    classes = cut(ids.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")))
    documents, elements = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    member = written(ids.join(classes, ["a", "b", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"), ((F.col("members") > 1) | (F.col("k") > 1)).alias("copied")))
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), 10 * elements // BUCKET_BYTES)
    # of rows with one doc_id only the chosen one goes on
    several = written(ids.where("k > 1").select("doc_id", "a"))
    rows = rows.where("doc_id is not null")
    rows = rows.withColumn("a", F.lit(None).cast("long")) if several.isEmpty() else rows.join(several, "doc_id", "left")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, hashes of sets, elements and bounds of the rows (doc_id, text, a, ...) that go on, without those with empty sets, and the last column."""
        for b in in_pieces(batches, "text", PIECE):
            hashes, bounds = shingle_sets(b.column(1))
            n = np.diff(bounds)
            whole = _whole(hashes, bounds, SALTS[0])
            want = b.column(2).to_numpy(zero_copy_only=False)
            keep = (n > 0) & (b.column(2).is_null().to_numpy(zero_copy_only=False) | (want == whole))
            yield b.column(0).to_numpy()[keep], whole[keep].view(np.uint64), hashes[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[keep])]), b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)[keep]

    # signatures that many documents have, by a sample of the classes
    share = math.ceil(1_000_000 * min(1.0, HOT_SAMPLE / max(1, documents)))
    sample = written(classes.where(F.pmod(F.xxhash64("rep", F.lit(41)), F.lit(1_000_000)) < share).select(F.col("rep").alias("doc_id")), 1)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _, h, bounds, _ in chosen(batches):
            sig, owner, _ = signatures(h, bounds, least)
            order = np.lexsort((owner, sig))
            again = np.zeros(len(sig), bool)
            again[1:] = (sig[order][1:] == sig[order][:-1]) & (owner[order][1:] == owner[order][:-1])
            yield pa.RecordBatch.from_arrays([pa.array(sig[order][~again].astype(np.int64)), pa.array(own[owner[order][~again]])], names=["sig", "doc"])

    seen = rows.join(sample, "doc_id").select("doc_id", "text", "a").mapInArrow(sampled, "sig long, doc long").groupBy("sig").agg(F.count("*").alias("k"), F.min("doc").alias("doc")).where(F.col("k") > RUN)
    known = sorted((r["sig"], r["doc"]) for r in seen.orderBy(F.desc("k"), "sig").limit(HOT_MOST).collect())
    hot = spark.sparkContext.broadcast((np.array([x for x, _ in known], np.uint64), np.array([x for _, x in known], np.int64)))  # at most HOT_MOST

    del known
    release()
    # only sets that several documents have are told apart by their hash; a few others are, too
    copies = _names(member.where("copied").select("doc_id"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for own, whole, h, bounds, slots in chosen(batches):
            # of equal sets in a task one is signed, so that no copied text is sent more often than there are tasks
            new = []
            for k, key in enumerate(zip(whole.tolist(), np.diff(bounds).tolist(), strict=True)):
                if key not in done:
                    done.add(key)
                    new.append(k)
            if len(done) > _SEEN:
                done.clear()
            for at in range(0, len(new), _ENTRIES):
                some = np.array(new[at : at + _ENTRIES])
                n = np.diff(bounds)
                keep = np.zeros(len(n), bool)
                keep[some] = True
                out = list(_spread(own[some], whole[some], _is_named(copies.value, slots[some]), h[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[some])]), buckets, hot.value, least))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "blob"])
        release()

    blobs = rows.select("doc_id", "text", "a", _slot("doc_id").alias("slot")).mapInArrow(signed, "bucket int, blob binary")
    found = written(blobs.groupBy("bucket").applyInArrow(lambda t: _matched(t, buckets, least), _OUT))
    many = {k: n for k, n in found.groupBy("kind").count().collect()}
    short, runs = many.get(1, 0) + many.get(4, 0), many.get(3, 0)
    # what one document has in long runs may be missing in short ones
    long = cut(found.where("kind = 3").groupBy(F.col("u").alias("doc")).agg(F.sum("n").alias("n"), F.max("key").alias("need")), many.get(3, 0))
    counted = found.where("kind = 1").groupBy("u", "v").agg(F.sum("n").alias("n"), F.max("key").alias("need"))
    of_long = lambda n: long.select(F.col("doc").alias(n), F.col("n").alias(f"long_{n}"))
    counted = cut(counted, many.get(1, 0)).join(of_long("u"), "u", "left").join(of_long("v"), "v", "left")
    counted = counted.where(F.col("n") + F.least(F.coalesce("long_u", F.lit(0)), F.coalesce("long_v", F.lit(0))) >= F.col("need")).select("u", "v")
    # and if they share none in short runs, each has at least as many as it must share in long ones
    able = cut(long.where("n >= need").select(F.col("doc").alias("able")), many.get(3, 0))
    star = found.where("kind = 4").groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    pairs = cut(counted.union(star).distinct(), short)
    # sets are made again for the documents that are compared, told by a bitmap of fixed size: it lets a few others pass, which
    # does no harm, and all of them where there are far more than bits
    wanted = _among(rows.select("doc_id", "text", "a"), pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).union(able))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _, h, bounds, _ in chosen(batches):
            each = [h[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.diff(bounds)), pa.array([odd_sketch(x) for x in each], pa.binary()), pa.array([x.tobytes() for x in each], pa.binary())], names=["doc_id", "n", "odd", "set"])

    of = wanted.mapInArrow(sets, "doc_id long, n long, odd binary, set binary")
    of = written(of if several.isEmpty() else of.dropDuplicates(["doc_id"]))

    def both(candidates: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
        """Candidates u, v with columns of both documents."""
        side = lambda n: of.select(F.col("doc_id").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in columns))
        return candidates.join(side("u"), "u").join(side("v"), "v").select("u", "v", *(f"{c}_{n}" for c in columns for n in "uv"))

    def verified(candidates: DataFrame) -> DataFrame:
        """The candidates that link. Sketches rule most others out before whole sets are sent."""

        def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = b.column(2).to_numpy() + b.column(3).to_numpy()
                apart = [odd_distance(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column(4), b.column(5), strict=True)]
                yield b.select(["u", "v"]).filter(pa.array(np.array(apart, np.int64) * (100 + least) <= n * (100 - least)))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    at = np.searchsorted(x, y)
                    shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                    keep.append(100 * shared >= least * (len(x) + len(y) - shared))
                yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
            release()

        near = written(both(written(candidates, short), of, "n", "odd").mapInArrow(possible, "u long, v long"), short)
        ids = near.select(F.col("u").alias("doc_id")).union(near.select("v"))
        return cut(both(near, _among(of.select("doc_id", "set"), ids), "set").mapInArrow(check, "u long, v long"))  # sets are read here: no fewer tasks

    def apart(candidates: DataFrame, reach: DataFrame) -> DataFrame:
        """Candidates whose documents are in different components yet."""
        of_ = lambda n: reach.select(F.col("node").alias(n), F.col("component").alias(f"c{n}"))
        both = candidates.join(of_("u"), "u", "left").join(of_("v"), "v", "left")
        return both.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")

    links = verified(pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"))
    reach = cut(components(links), short)
    links = cut(links.unionByName(verified(cut(apart(pairs, reach), short))), short)
    reach = cut(components(links), short)
    def placed(own: DataFrame, reach: DataFrame, rows: int) -> DataFrame:
        """Documents (doc, ...) with their component c."""
        return cut(own.join(reach, own["doc"] == reach["node"], "left").withColumn("c", F.coalesce("component", "doc")).drop("node", "component"), rows)

    # documents of long runs that could link by these alone: by their rarest elements, then block by block
    rest = placed(able.select(F.col("able").alias("doc")), reach, runs)
    spans = lambda x: (lambda r: r[0] is not None and r[0] < r[1])(x.agg(F.min("c"), F.max("c")).first())
    if spans(rest):
        met = _rare(rest, of, buckets, least)
        some = met.count()
        links = cut(links.unionByName(verified(met.where("kind = 1").select("u", "v").distinct())), short)
        reach = cut(components(links), short)
        rest = placed(met.where("kind = 2").select(F.col("u").alias("doc"), F.col("v").alias("n")).distinct(), reach, some)
        if spans(rest):
            links = cut(links.unionByName(_compared(rest, of, least)))
            reach = cut(components(links), short)
    # nodes stand for their classes: those of one class are joined, and a component is named by the smallest document of its classes
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct().join(member.select(F.col("doc_id").alias("node"), "rep"), "node")
    reach = cut(components(links.unionByName(nodes.where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v")))), short)
    whole = reach.unionByName(reach.select(F.col("component").alias("node"), "component").distinct())
    named = whole.join(member.select(F.col("doc_id").alias("node"), "rep"), "node").select("component", "rep")
    label = named.join(named.groupBy("component").agg(F.min("rep").alias("least")), "component").select("rep", "least").distinct()
    out = member.join(label, "rep", "left").select("doc_id", "n_shingles", F.coalesce("least", "rep").alias("component_id"))
    return out.unionByName(every.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
