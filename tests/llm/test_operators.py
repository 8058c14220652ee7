"""Operators against brute force and planted cases, over nulls, empty texts, ties, repeated rows and clashing columns."""

import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, embedding_dedup, language_id, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, sharding, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, shard int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts = [None, "", "   \n\t", "One", "a b c"]
    for i in range(60):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 25))) for _ in range(rng.randint(1, 6))]
        texts.append("\n".join(lines))
        if i % 4 == 0:
            w = texts[-1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            texts += [texts[-1], " ".join(w), texts[-1].upper()]
    texts.append(" ".join(rng.choice(words) for _ in range(30_000)))
    rows = [(i, t, ["en", None][i % 7 == 0], ["s1", "s1", "s2", None][i % 4], 1, 2, 0.5, 9) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[8]], SCHEMA).cache()  # a repeated row


def empty(docs):
    return docs.limit(0)


def test_shards(docs):
    out = sharding.shard_by_bytes(docs, 5).toPandas()
    assert len(out) == docs.count() and (out.groupby("text_crc32").shard.nunique() == 1).all()
    assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard").slot)
    assert sharding.shard_by_bytes(empty(docs), 5).count() == 0


def test_minimax_capacity_is_smallest(spark):
    rng = random.Random(1)
    for sizes in ([5] * 40, [rng.randint(1, 30) for _ in range(60)], [7]):
        table = spark.createDataFrame([(i, s, sum(sizes[: i + 1])) for i, s in enumerate(sizes)], "key long, bytes long, bytes_end long")
        capacity, cuts = sharding.minimax_cuts(table, 4, sum(sizes), max(sizes))

        def shards(c, sizes=sizes):
            n, at = 1, 0
            for s in sizes:
                n, at = (n, at + s) if at + s <= c else (n + 1, s)
            return n

        assert capacity == next(c for c in range(max(sizes), sum(sizes) + 1) if shards(c) <= 4) and len(cuts) < 4


def test_quality_counts(docs):
    rows = docs.select("doc_id", "text").toPandas()
    counts = quality_rules.text_counts(pa.array(["a b\n\n x # x\na b\n", "", None, "u v w x y u v w x y z"]))
    assert counts["n_words"].tolist() == [7, 0, 0, 11] and counts["n_dup_lines"].tolist() == [1, 0, 0, 0]
    assert counts["n_repeat_words"].tolist() == [0, 0, 0, 10] and counts["n_symbols"].tolist() == [1, 0, 0, 0]
    out = quality_rules.judged(docs).toPandas()
    assert len(out) == len(rows) and not out[out.n_words == 0].kept.any()
    assert quality_rules.judged(empty(docs)).count() == 0


def test_sketch_bins(spark):
    df = spark.range(5000).selectExpr("id", f"CAST({quality_rules.sketch_bin('id')} AS INT) AS b").selectExpr("id", "b", f"{quality_rules.bin_top('b')} AS top")
    assert df.where("top < id or top > id * 17 / 16 + 1").count() == 0


def test_quality_verdicts_against_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows = []
    for lang, source, n, symbols, longer in (("en", "code", 230, 4, 1), ("en", "news", 240, 0, 1), ("de", None, 150, 0, 3), (None, "x", 30, 0, 1)):
        for i in range(n):
            w = [rng.choice(words) * longer for _ in range(rng.randint(12, 90))]
            for _ in range(rng.randint(0, symbols)):
                w[rng.randrange(len(w))] = "##"
            if i % 10 == 1:
                w += w[:7]  # below the base rule in longer texts
            if i % 23 == 2:
                w = [x + "#&!"[: i % 4] for x in w]
            if i % 31 == 3:
                w = [x.upper() * 2 for x in w]
            text = " ".join(w)
            rows.append((len(rows), text + f"\n{text[:30]}" * 3 if i % 29 == 4 else text, lang, source))
    rows += [(len(rows), None, "en", "news"), (len(rows) + 1, "", None, None)]
    counts = quality_rules.text_counts(pa.array([r[1] for r in rows], pa.string()))
    rules, base = quality_rules.RULES, (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
    rate = {m: counts[n] * 1000 // np.maximum(counts[d], 1) for m, (n, d, *_) in rules.items()}

    def top(v):  # the largest value of v's bin: exact below 256, then 128 bins for each power of two
        step = max(0, int(v).bit_length() - 8)
        return ((int(v) >> step) + 1 << step) - 1

    good = [j for j in range(len(rows)) if not base[j]]
    of_lang = lambda j, i: rows[j][2] == rows[i][2]
    of_group = lambda j, i: rows[j][2:] == rows[i][2:]

    def limits(i):
        """By weighted quantiles: each document counts for all, more for its language, most for its group."""
        prior, n, n_lang = quality_rules.PRIOR, len(good), sum(of_lang(j, i) for j in good)
        weight = {j: prior * prior + prior * n * of_lang(j, i) + n * (n_lang + prior) * of_group(j, i) for j in good}
        total = sum(weight.values())

        def quantile(x, tenths):
            upto = 0
            for j in sorted(good, key=lambda j: x[j]):
                upto += weight[j]
                if upto * 10 >= total * tenths:
                    return top(x[j])

        room = lambda r: r[4] * 2 * 1000 // max(1, quantile(counts[r[1]], 5)) if r[5] else 20
        return {m: quantile(rate[m], r[3]) * 9 - quantile(rate[m], 5) * 8 + room(r) for m, r in rules.items()}

    of_groups = {r[2:]: limits(i) for i, r in enumerate(rows) if not base[i]}

    def verdict(i):
        return not base[i] and all(rate[m][i] <= of_groups[rows[i][2:]][m] or counts[r[0]][i] <= r[4] for m, r in rules.items())

    want = {r[0]: bool(verdict(i)) for i, r in enumerate(rows)}
    out = {r["doc_id"]: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i: r["kept"] for i, r in out.items()} == want
    over = lambda r, m: not r["base_failed"] and not r["kept"] and r[m] > r[f"most_{m}"]
    assert all(any(over(r, m) for r in out.values()) for m in ("symbol_rate", "repeat_rate", "upper_rate"))
    of = {r["source"]: r for r in out.values() if r["lang"] == "en"}
    assert of["code"]["most_symbol_rate"] > 100 > of["news"]["most_symbol_rate"]  # a group's own habit sets its limit
    limits = {(r["lang"], r["source"]): r.asDict() for r in out.values()}
    assert all(len({r[f"most_{m}"] for r in limits.values() if r[f"most_{m}"] is not None}) > 1 for m in ("symbol_rate", "word_length"))
    # sketches of parts add up to that of the whole
    small = spark.createDataFrame(rows[:300], "doc_id long, text string, lang string, source string")
    metrics = quality_rules.counted(small).withColumns({m: F.col(n) for m, (n, *_) in rules.items()})
    merged = quality_rules.quantile_sketches(metrics, ["source"]).groupBy("metric", "bin").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, quality_rules.quantile_sketches(metrics, []).collect()))


def normal(line):
    return tuple(WORD.findall(line.lower()))


def test_line_dedup_is_exact(docs):
    out = line_dedup.without_repeated_lines(docs).dropDuplicates(["doc_id"]).toPandas().set_index("doc_id")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = [(i, k, normal(x)) for i, t in sorted(texts.items()) if t is not None for k, x in enumerate(t.split("\n")) if len(normal(x)) >= 5]
    first = {}
    for i, k, w in seen:
        first.setdefault(w, (i, k))

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    gone = {max(a, b, key=first.get) for a, b in itertools.combinations(first, 2) if abs(len(a) - len(b)) < 2 and near(a, b)}
    for i, t in texts.items():
        if t is not None:
            kept = [x for k, x in enumerate(t.split("\n")) if len(w := normal(x)) < 5 or (w not in gone and first[w] == (i, k))]
            assert out.text[i] == "\n".join(kept)
    assert out.text[0] is None and line_dedup.without_repeated_lines(empty(docs)).count() == 0


def test_short_lines_lose_exact_repeats(spark):
    texts = [None, "", "Home\n\nAll rights  reserved.\nall rights reserved.\none two three four five six\n ", "home\nnews\none two three four five sax\n\nall rights reserved. ©", "ALL RIGHTS RESERVED.\n\n", "home page\none two three four\none two three five"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {r["doc_id"]: r for r in line_dedup.without_repeated_lines(docs, fewest=1).collect()}
    seen, want = set(), {}
    for i, t in enumerate(texts):
        kept = []
        for x in (t or "").split("\n"):
            w = normal(x)
            if w and (w in seen or w == normal("one two three four five sax")):
                continue
            seen.add(w)
            kept.append(x)
        want[i] = t if t is None else "\n".join(kept)
    assert {i: r["text"] for i, r in out.items()} == want
    assert [(i, r["n_equal"], r["n_near"]) for i, r in sorted(out.items()) if r["n_equal"] or r["n_near"]] == [(2, 1, 0), (3, 1, 1), (4, 1, 0)]
    assert [i for i, r in out.items() if r["emptied"]] == [4]


def test_pipeline_lines_lose_short_repeats(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "menu\nfirst"), (2, "menu\nsecond"), (3, "menu"), (4, None)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert out == {1: "menu\nfirst", 2: "second", 4: None}


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    from millrace.llm.queries import tokenizer_path

    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    odd = ["it's don't! <|endoftext|>x", "a<|startoftext|>b, 12'34 I'LL 'tis éte, ́x .́ 1 2…,.a", "ΣΑΣ, İstanbul's, ǅ 12ab34", "日本語。テスト", "é, É", "a\x1cb\x85d z\x00a\x00", "", None, "²³ x2² 1.000,50 --- ''s 's's", "x" * 300 + "'s"]
    ids, bounds = packing.token_ids(pa.array(odd), path)
    for x, a, b in zip(odd, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == t.encode(x or "", add_special_tokens=False).ids
    out = packing.pack(packing.pieces(docs.dropDuplicates(["doc_id"]), path)).toPandas()
    assert out.groupby("doc_id").length.sum().eq(out.groupby("doc_id").doc_tokens.first()).all()
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 4096 and (s.offset.to_numpy() == s.length.cumsum().shift(fill_value=0).to_numpy()).all()
    assert packing.pack(packing.pieces(empty(docs), path)).count() == 0


def test_pieces_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    from millrace.llm.queries import table, tokenizer_path

    rows = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    t, want = Tokenizer.from_file(tokenizer_path()), {}
    for r in rows.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want |= {(r["doc_id"], k): (len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()), len(ids)) for k in range(0, len(ids), 4096)}
    found = lambda: {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"], r["doc_tokens"]) for r in packing.pieces(rows, tokenizer_path()).collect()}
    assert found() == want and any(k for _, k in want)


def test_units_with_one_hash_are_told_apart(monkeypatch):
    from tokenizers import Tokenizer

    from millrace.llm.queries import tokenizer_path

    real = packing.word_hashes
    monkeypatch.setattr(packing, "word_hashes", lambda d, s, e, seed=0: real(d, s, e, seed=seed) if seed else real(d, s, e) % np.uint64(3))
    monkeypatch.setattr(packing, "_TABLES", {})
    path, texts = tokenizer_path(), ["the cat, the dog", "a dog and the 2 cats"]
    ids, bounds = packing.token_ids(pa.array(texts), path)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    other = packing._Table(path)
    other.wordwise = False  # a tokenizer with another split sees whole texts
    monkeypatch.setattr(packing, "_TABLES", {path: other})
    whole, cuts = packing.token_ids(pa.array(texts), path)
    assert whole.tolist() == ids.tolist() and cuts.tolist() == bounds.tolist()


def test_language(spark, docs):
    rows = [(i, ("the cat and the dog were here " if i % 2 else "der hund und die katze waren hier ") * 4, "en" if i % 2 else "de") for i in range(20)]
    prototypes = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "the dog"), (2, "die katze"), (3, None), (4, "12 .."), (5, "")], "doc_id long, text string")
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.predicted(asked, prototypes).collect()}
    assert out == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und"}
    assert {r["lang_pred"] for r in language_id.predicted(asked, {}).collect()} == {"und"}


def test_warc_round_trip_and_salvage(spark):
    html = ["<p>one</p>", None, "<p>one</p>", "", "é" * 100_000, "<p>two</p>"]
    pages = spark.createDataFrame([(i, f"http://x.test/{i}\r\n" if i else None, h) for i, h in enumerate(html)], "page_id long, url string, html string")
    out = {r["record_id"]: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    for i, h in enumerate(html):
        r, body = out[f"urn:page:{i}"], (h or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), warc.digest(body))
        assert (r["record_type"], r["refers_to"]) == (("revisit", f"urn:page:{html.index(h) if h else 1}") if i in (2, 3) else ("response", None))
    members = [warc.member(warc.record(i, "u", b"x" * 50, None)) for i in range(4)]
    data = members[0] + b"noise" + members[1][:40] + members[2] + warc.record(9, "u", b"plain", None) + members[3][:-60]
    found = list(warc.salvage(data))
    assert [f["record_id"] for k, _, _, f in found if k == "record"] == ["urn:page:0", "urn:page:2", "urn:page:9"]
    gaps = [(a, b) for k, a, b, _ in found if k == "gap"]
    assert gaps == [(len(members[0]), len(members[0]) + 45), (len(data) - len(members[3]) + 60, len(data))]
    assert warc.write_archives(pages.limit(0)).count() == 0 and not list(warc.salvage(b""))


def test_members_with_several_records():
    rows = [warc.record(i, "u", bytes([65 + i]) * 3000, None) for i in range(5)]
    ids = lambda data: [f["record_id"][-1] for k, _, _, f in warc.salvage(data) if k == "record"]
    assert ids(warc.member(b"".join(rows))) == list("01234") == ids(b"".join(rows))
    torn = rows[2].replace(b"Content-Length", b"Content-Lengxx")
    found = list(warc.salvage(warc.member(rows[0] + torn + rows[3])))
    assert [k for k, *_ in found] == ["record", "gap", "record"] and "inside" in found[1][3]
    random.seed(2)
    noisy = [warc.record(i, "u", random.randbytes(200_000), None) for i in range(4)]
    whole = warc.member(b"".join(noisy))
    found = list(warc.salvage(whole[:-5] + b"xxxxx" + warc.member(rows[4])))
    assert [f["record_id"][-1] for k, _, _, f in found if k == "record"] == list("01234") and sum(k == "gap" for k, *_ in found) == 1
    assert ids(whole[:500_000]) == list("01")


def test_salvage_of_any_damage():
    rng = random.Random(4)
    rows = [warc.record(i, f"u{i}", rng.randbytes(rng.randint(0, 4000)), None) for i in range(12)]
    want = {f["record_id"]: f["payload"] for _, _, _, f in warc.salvage(b"".join(rows))}
    assert len(want) == 12
    for _ in range(60):
        parts = [warc.member(r) if rng.random() < 0.7 else r for r in rows]
        data, hurt, at = b"", set(), rng.randrange(12)
        for i, p in enumerate(parts):
            if i == at:
                hurt.add(i)
                k = rng.randrange(len(p))
                p = rng.choice([p[:k], p[:k] + bytes([p[k] ^ (1 << rng.randrange(8))]) + p[k + 1 :], p[:k] + rng.randbytes(30) + p[k:], p[k:], rng.randbytes(50)])
            data += p
        found = list(warc.salvage(data))
        got = {f["record_id"]: f["payload"] for k, _, _, f in found if k == "record"}
        assert {k: v for k, v in want.items() if k != f"urn:page:{at}"}.items() <= got.items() and all(want[k] == v for k, v in got.items() if k in want)
        assert all(0 <= a < b <= len(data) for k, a, b, _ in found if k == "gap")


def test_a_large_record_takes_linear_time():
    began = time.perf_counter()
    (found,) = warc.salvage(warc.member(warc.record(1, "u", b"0123456789abcdef" * (2 << 20), None)))  # 32 MB
    assert found[3]["payload_bytes"] == 32 << 20 and time.perf_counter() - began < 5


def test_round_trip_reports_what_is_lost(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "a"), (2, None, "a"), (1, "u", "a"), (3, "v", None), (None, None, "a")], "page_id long, url string, html string")
    rows = warc.round_trip(pages).collect()
    assert sorted((r["record_id"], r["record_type"], r["refers_to"]) for r in rows)[:2] == [("urn:page:1", "response", None)] * 2
    assert {r["record_type"] for r in rows if r["record_id"] == "urn:page:2"} == {"revisit"} and len(rows) == 5
    archives = warc.write_archives(pages, f"file://{tmp_path}/a")
    path = archives.first()["path"].removeprefix("file://")
    data = open(path, "rb").read()
    open(path, "wb").write(data[: len(data) // 2] + data[len(data) // 2 + 9 :])
    assert warc.read_archives(archives).where("kind = 'gap'").count() > 0
    monkeypatch.setattr(warc, "write_archives", lambda *_: archives)
    with pytest.raises(ValueError, match="gaps"):
        warc.round_trip(pages)


def test_mixing(docs):
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)))
    out = mixing.mix(sized).toPandas()
    per = out.fillna({"source": "-"}).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((per.taken - per.target).abs() <= 1).all() and (out.taken <= 2 * out["size"]).all() and len(out) == docs.count()
    again = mixing.mix(sized.repartition(3)).toPandas()
    assert sorted(zip(out.doc_id, out.taken)) == sorted(zip(again.doc_id, again.taken))
    want = mixing.targets([("a", 100), ("b", 100), (None, 100)])
    assert sum(want.values()) == pytest.approx(450) and max(want.values()) <= 200
    assert mixing.mix(empty(sized)).count() == 0


@pytest.mark.parametrize("dims, leaf", [(64, 64), (300, 40)])
def test_forest_recall_where_trees_split(spark, monkeypatch, dims, leaf):
    """A hot label with a dense group larger than a part, chains and lone vectors: no false link, recall of at least 0.9."""
    monkeypatch.setattr(embedding_dedup, "PART", 300)
    monkeypatch.setattr(embedding_dedup, "SAMPLE_NUMBERS", 500 * dims)  # so that levels follow that the sample doesn't reach
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    near = lambda x, n, d: unit(x + rng.standard_normal((n, dims)) * d / np.sqrt(dims))
    lone = unit(rng.standard_normal((1800, dims)))
    dense = near(unit(rng.standard_normal(dims)), 700, 0.12)  # cosines about 0.986, some below the bound
    pairs = np.concatenate([near(x, 3, 0.1) for x in lone[:400]])
    x = np.concatenate([lone, dense, pairs]).astype(np.float32)
    labels = [1 if i % 3 else 2 for i in range(len(lone))] + [1] * len(dense) + [1 if i % 3 else 2 for i in range(400) for _ in range(3)]
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, labels))]
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), leaf=leaf).collect()}
    wide, labels = unit(x.astype(np.float64)), np.array(labels)
    links = (wide @ wide.T >= 0.98) & (labels[:, None] == labels[None, :]) & ~np.eye(len(x), dtype=bool)
    want, got = links.sum(1), np.array([out[i]["n_links"] for i in range(len(x))])
    assert (got <= want).all() and 100_000 < want.sum() and got.sum() >= 0.97 * want.sum()
    least = np.arange(len(x))
    for _ in range(50):
        least = np.minimum(least, np.where(links, least[None, :], len(x)).min(1))
    same = np.array([out[i]["component_id"] for i in range(len(x))])
    assert (same >= least).all() and (same == least).mean() > 0.97 and all(out[i]["kept"] == (same[i] == i) for i in out)
    small = got[len(lone) + len(dense) :].sum() / want[len(lone) + len(dense) :].sum()
    print(f"{dims} dimensions: recall {got.sum() / want.sum():.4f}, of small groups {small:.4f}")
    assert small >= 0.9


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    near = base[rng.integers(0, 40, 300)] + rng.standard_normal((300, 16)) * 0.08
    rows = [(i, [float(x) for x in v], int(i % 3) if i % 11 else None) for i, v in enumerate(np.concatenate([base, near]))]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[5][1], rows[5][2]), (904, [], 1)]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [(i, np.array(v, np.float32).astype(float), k) for i, v, k in rows if v and k is not None and np.isfinite(v).all() and np.any(v)]
    links, reach = dict.fromkeys(out, 0), {i: i for i in out}
    for (i, a, k), (j, b, m) in itertools.combinations(good, 2):
        if k == m and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
            links[i], links[j] = links[i] + 1, links[j] + 1
            low, high = sorted((reach[i], reach[j]))
            reach = {x: low if c == high else c for x, c in reach.items()}
    assert sum(links.values()) > 50 and out == {i: (links[i], reach[i]) for i in out}


def test_classifier(spark, docs):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["clean", "plain", "good", "words"] if i % 2 else ["spam$$", "buy!!", "###", "click"]) for _ in range(20)) for i in range(80)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = quality_classifier.fit(table, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"))
    out = {r["doc_id"]: r["score"] for r in quality_classifier.scored(table, model).collect()}
    assert all((out[i] >= 0.5) == bool(i % 2) for i in range(60, 80))
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.scored(docs.drop("score"), model).collect())


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_groups_are_exact(docs):
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    reach = {i: i for i in sets}
    for i, j in itertools.combinations(sets, 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            low, high = sorted((reach[i], reach[j]))
            reach = {x: low if c == high else c for x, c in reach.items()}
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_groups(docs).collect()}
    assert out == {i: (len(sets[i]), reach[i]) for i in sets} and len(set(reach.values())) < len(sets)


def test_an_empty_table_has_no_groups(docs):
    assert ngram_join.near_groups(empty(docs)).count() == 0


def test_near_sets_share_the_signatures_they_need():
    rng = np.random.default_rng(9)
    sets = []
    for n in [*range(2, 40), *([150, 151, 600] * 20)]:
        a = rng.integers(0, 2**64, n, np.uint64)
        for gone in {0, n // 9, n // 7}:
            b = np.concatenate([a[gone:], rng.integers(0, 2**64, max(0, gone - 1), np.uint64)])
            sets += [np.unique(a), np.unique(b)]
    sig, owner, need = ngram_join.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    own = [set(sig[owner == i].tolist()) for i in range(len(sets))]
    for i in range(0, len(sets), 2):
        a, b = set(sets[i].tolist()), set(sets[i + 1].tolist())
        if a != b and 100 * len(a & b) >= 75 * len(a | b):
            assert len(own[i] & own[i + 1]) >= max(need[i], need[i + 1]) > 0


def test_long_runs_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "RUN", 2)
    rng = random.Random(4)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(w))
    test_jaccard_groups_are_exact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_parities_never_differ_more_than_sets():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 7, 50, 130, 1000):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        for gone, more in ((0, 0), (n // 9, n // 5), (n, n), (0, n)):
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**64, more, np.uint64)]))
            differ = len(np.setxor1d(a, b))
            found = ngram_join.odd_distance(ngram_join.odd_sketch(a), ngram_join.odd_sketch(b))
            assert found <= differ and found >= 0.6 * differ - 2


def test_subsets_of_cells_are_enumerated():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**64, 300, np.uint64))
    sig, owner, _ = ngram_join.signatures(a, np.array([0, len(a)]))
    top = [int(t) for t in ngram_join.bands(400) if t >= len(a)][:2]
    parts = [(k := 2 * t * 25 // 175 // 2) + 1 + -(-k // 4) for t in top]
    # a subset that leaves one cell out, for each cell of each partition, unless it is empty
    cells = ngram_join.CELLS
    assert len(set(sig.tolist())) == len(sig) and 0.85 * cells * sum(parts) < len(sig) <= cells * sum(parts)


def test_common_passages_and_hot_signatures_lose_no_link(spark, monkeypatch):
    """Passages that most documents share, in shares around the bound: hot signatures, rare elements, blocks."""
    monkeypatch.setattr(ngram_join, "RUN", 3)
    monkeypatch.setattr(ngram_join, "KEY_RUN", 4)
    monkeypatch.setattr(ngram_join, "HOT_SAMPLE", 60)
    monkeypatch.setattr(ngram_join, "BLOCK_ELEMENTS", 900)
    calls = []
    for name in ("_rare", "_compared"):
        real = getattr(ngram_join, name)
        monkeypatch.setattr(ngram_join, name, lambda *a, real=real, name=name: calls.append(name) or real(*a))
    rng = random.Random(11)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    base, texts = fresh(160), []
    for i in range(90):
        w = base[: rng.choice([60, 100, 120, 130, 140, 160])] + fresh(rng.choice([0, 10, 20, 30, 40]))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = [(5 * i + 1, t) for i, t in enumerate(texts)] + [(7000 + i, t) for i, t in enumerate(texts[:20])]
    test_jaccard_groups_are_exact(spark.createDataFrame(rows, "doc_id long, text string"))
    assert calls == ["_rare", "_compared"]


def test_ids_that_are_null_or_repeat(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "other words than those before it"), (4, "a b c d e f"), (None, None), (6, "")]
    out = sorted(map(tuple, ngram_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    of = {r[0]: r for r in out if r[0] is not None}
    assert len(out) == 5 and of[6] == (6, 0, 6) and sorted(r[1:] for r in out if r[0] is None) == [(0, None), (2, None)]
    assert of[3] in ((3, 2, 3), (3, 3, 3)) and of[4][2] == (3 if of[3][1] == 2 else 4)


def test_components_of_a_long_chain(spark):
    """Many rounds stay as quick to plan as the first."""
    ids = list(range(10, 3_010))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame([*zip(ids[:-1], ids[1:], strict=True), (1, 2), (2, 1), (5, 5)], "u long, v long")
    out = dict(tuple(r) for r in common.components(links).collect())
    assert out == {i: 10 for i in ids if i > 10} | {2: 1}
    assert common.components(links.limit(0)).count() == 0
