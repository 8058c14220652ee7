"""Operators 1, 2 and 7: every row of the result against slow loops."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from millrace.llm import line_dedup, mixing, quality_rules, sharding
from pyspark.sql import functions as F


def slow_shards(rows, shards):
    """doc_id, size, crc, shard and slot of each row: heavy groups apart, the rest cut at the smallest capacity that greedy filling allows."""
    key = lambda t: xxhash.xxh64((t or "").encode(), seed=42).intdigest()
    signed = lambda k: k - (1 << 64) if k >> 63 else k
    size = lambda t: len((t or "").encode()) + 8
    groups = {}
    for _, t in rows:
        groups[signed(key(t))] = groups.get(signed(key(t)), 0) + size(t)
    rest, free, own = sum(groups.values()), shards, []
    for k, b in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        if free > 1 and b * free > rest:
            own.append(k)
            rest, free = rest - b, free - 1
    light = sorted((k, b) for k, b in groups.items() if k not in own)

    def filled(capacity):
        out, at, used = {}, 0, 0
        for k, b in light:
            if used + b > capacity:
                at, used = at + 1, 0
            out[k] = at
            used += b
        return out if at < free else None

    capacity = max((b for _, b in light), default=0)
    while (placed := filled(capacity)) is None:
        capacity += 1
    placed |= {k: free + i for i, k in enumerate(own)}
    out, slots = [], {}
    for i, t in sorted(rows, key=lambda r: (signed(key(r[1])), r[0] is not None, r[0] or 0)):
        s = placed[signed(key(t))]
        out.append((i, size(t), zlib.crc32((t or "").encode()), s, slots.setdefault(s, 0)))
        slots[s] += 1
    return out


def test_shards_are_those_of_a_slow_loop(spark):
    rng = random.Random(6)
    texts = ["é" * rng.randint(0, 60) + str(rng.randint(0, 400)) for _ in range(300)] + ["copy " * 40] * 90 + ["other " * 30] * 35 + [None, "", ""]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "no id")]
    for shards in (24, 5, 1):
        out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()
        assert sorted(map(tuple, out), key=str) == sorted(slow_shards(rows, shards), key=str)
    assert len({r["shard"] for r in out}) == 1


def slow_mix(rows, seed=7):
    """taken of each row, where all rows are one block: mass moves between two fractions at a time until one is whole."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.targets(list(sizes.items()), (3, 1, 2), 1.5, 2.0)
    out = {}
    for rank, s in enumerate(ordered):
        own = sorted((i, n) for i, t, n in rows if t == s)
        rate = want[s] / sizes[s] if sizes[s] else 0.0
        whole, part = int(rate), rate - int(rate)
        p = [Fraction(part) if n else Fraction(0) for _, n in own]
        draws = np.random.default_rng((seed * 7919 + 0) * 1_000_003 + rank).random(len(own))
        open_ = None
        for j in range(len(own)):
            if not 0 < p[j] < 1:
                continue
            if open_ is None:
                open_ = j
                continue
            i, a, b = open_, own[open_][1], own[j][1]
            up, down = min((1 - p[i]) * a, p[j] * b), min(p[i] * a, (1 - p[j]) * b)
            move = up if draws[j] * float(up + down) < float(down) else -down
            p[i], p[j] = p[i] + move / a, p[j] - move / b
            open_ = next((k for k in (j, i) if 0 < p[k] < 1), None)
        assert sum(x * n for x, (_, n) in zip(p, own)) == Fraction(part) * sum(n for _, n in own)
        out |= {(i, s): whole * n + round(float(x * n)) for x, (i, n) in zip(p, own)}
    return out, want, sizes


def test_the_mix_is_that_of_a_slow_loop(spark):
    rng = random.Random(9)
    sources = ["b", "a", None, "é", "zz"]
    rows = [(i, rng.choice(sources), rng.choice([0, 1, 5, 40, rng.randint(1, 900)])) for i in range(400)]
    want, targets, sizes = slow_mix(rows)
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    got = {(r["doc_id"], r["source"]): r["taken"] for r in out}
    # the slow loop is exact: a word more or less where the last fraction of a source is cut
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) <= 1 and sum(got[k] != want[k] for k in want) <= len(sources)
    assert all(r["target"] == targets[r["source"]] and r["source_size"] == sizes[r["source"]] and r["taken"] <= 2 * r["size"] for r in out)


def test_rows_without_an_id_are_mixed_and_sharded(spark):
    rows = spark.createDataFrame([(None, "a", 5), (None, "a", 5), (1, "a", 7)], "doc_id long, source string, size long")
    assert mixing.mix(rows).count() == 3
    assert sharding.shard_by_bytes(rows.select("doc_id", F.col("source").alias("text")), 3).count() == 3


def slow_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_shouts."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside), len(lines), sum("A" <= c <= "Z" for c in t), t.count("!")]


def test_quality_counts_are_those_of_a_slow_loop():
    rng = random.Random(12)
    texts = [None, "", " \n\t", "a", "a b c d e", "é日 " * 30, "x\n\nx\n x\n"] + ["".join(rng.choice(["a ", "b ", "c\n", "é", "日 ", "# ", "AB!", "\x0b", "\r\n", "a b c d e ", "\x85", "\u2028"]) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    counts = quality_rules.text_counts(pa.array(texts, pa.string()))
    assert [[int(counts[c][i]) for c in quality_rules.COUNTS] for i in range(len(texts))] == [slow_counts(t) for t in texts]
    sliced = quality_rules.text_counts(pa.array(texts, pa.string()).slice(5, 50))
    assert [int(x) for x in sliced["n_repeat_words"]] == [slow_counts(t)[4] for t in texts[5:55]]


def test_each_group_has_limits_of_its_own(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(2, 9 + 3 * (i % 3)) + ("#" if rng.random() < 0.1 * (i % 2) else "") for _ in range(60)), "en", ["a", "b", "c", "d", "e", "f"][i % 6]) for i in range(180)]
    out = quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    limits = {r["source"]: (r["most_word_length"], r["most_symbol_rate"]) for r in out}
    assert len({x for x, _ in limits.values()}) > 3 and limits["d"][1] != limits["a"][1]  # thirty documents are enough to differ
    near = quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), prior=10**6).collect()
    assert len({r["most_word_length"] for r in near}) <= 2


def test_documents_are_told_by_a_bitmap(spark):
    docs = spark.createDataFrame([(i if i % 9 else None, "t", "r", 1) for i in range(500)], "doc_id long, text string, _row string, _bits int")
    ids = spark.createDataFrame([(i,) for i in range(0, 500, 7)] + [(None,)], "k long")
    out = line_dedup.told(docs, ids, "doc_id", "among")
    assert out.columns == [*docs.columns, "among"] and out.count() == 500
    assert [r["doc_id"] for r in out.where("among").orderBy("doc_id").collect()] == [i for i in range(0, 500, 7) if i % 9]
    assert line_dedup.told(docs, ids.limit(0), "doc_id", "among").where("among").count() == 0
