"""Each stage of the corpus pipeline against a brute-force version, with null, empty, repeated and clashing rows and columns."""

import itertools
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from millrace.llm import common, language_id, mixing, quality_classifier
from millrace.llm.queries import tokenizer_path
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copy string, key int, doc string, lines_emptied boolean, copies int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(2, 8)))
    words = [word() for _ in range(600)]
    texts = [None, "", " \n\t ", "menu", "menu\nmenu", "one two"]
    for i in range(80):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 20))) for _ in range(rng.randint(2, 8))] + ["All rights reserved."] * (i % 3 == 0)
        texts.append("\n".join(lines))
        if i % 5 == 0:
            texts += [texts[-1], "\n".join([lines[0].rsplit(" ", 1)[0] + " changed", *lines[1:]])]
        if i % 7 == 0:
            texts.append(" ".join(rng.choice(["$$$", "click", "###", "buy!!"]) for _ in range(40)))
    texts.append(" ".join(rng.choice(words) for _ in range(12_000)))
    out = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "a"][i % 4], len(t or ""), 0.25, "own", 3, "x", False, 7) for i, t in enumerate(texts)]
    return [*out, out[8], out[8], (None, "no id here at all, but a text of some words", "en", "b", 3, 0.5, "own", 1, "y", True, 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 0 if r[1] and "$$$" in r[1] else 1, 0) for r in rows if r[0] is not None and r[0] % 5 and r[1]]
    spark.createDataFrame([*labels, (3, None, 0), (10**6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def same(df, rows):
    key = lambda r: str(tuple(r))
    assert df.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert sorted(map(key, df.collect())) == sorted(map(key, rows))


def slow_score(model, text):
    """The softmax of the mean embedding, feature by feature."""
    data = (text or "").encode()
    ids = [int(common.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]) >> 64 - quality_classifier.BITS for w in WORD.findall(text or "")]
    for i in range(len(data) - 3):
        gram = int.from_bytes(data[i : i + 4], "big") + (1 << 40)
        ids.append(int(common.mixed(np.array([gram], np.uint64))[0]) >> 64 - quality_classifier.BITS)
    hidden = sum((model.table[k].astype(float) for k in ids), np.zeros(model.table.shape[1])) / max(1, len(ids))
    z = hidden @ model.weights.astype(float) + model.bias
    return 1 / (1 + np.exp(z[0] - z[1]))


def test_quality_stage(spark, docs, rows, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~common.folded("doc_id"))
    model = quality_classifier.fit(docs.select("doc_id", "text"), labels)
    scores = {r["doc_id"]: r["fit"] for r in quality_classifier.scored(docs, model, name="fit").collect()}
    want = {r[0]: slow_score(model, r[1]) for r in rows[:120]}
    assert all(scores[i] == pytest.approx(s, abs=1e-5) for i, s in want.items())
    kept = [r for r in rows if scores[r[0]] >= 0.5]
    same(corpus_pipeline.quality(spark, docs, folder), kept)
    assert 10 < len(kept) < len(rows) and all("$$$" not in (r[1] or "") for r in kept)
    replaced = quality_classifier.scored(docs, model)
    assert replaced.columns.count("score") == 1 and {r["doc_id"]: r["score"] for r in replaced.collect()} == scores


def deduped(texts):
    """Texts by id without repeated lines: equal ones of any length, and from five words on those within one word of an earlier line."""
    normal = lambda x: tuple(WORD.findall(x.lower()))
    first, out = {}, {}
    for i, t in sorted(texts.items()):
        for k, x in enumerate((t or "").split("\n")):
            if normal(x):
                first.setdefault(normal(x), (i, k))

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    long = [w for w in first if len(w) >= 5]
    gone = {max(a, b, key=first.get) for a, b in itertools.combinations(long, 2) if abs(len(a) - len(b)) < 2 and near(a, b)}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for k, x in enumerate(lines) if not (w := normal(x)) or (w not in gone and first[w] == (i, k))]
        emptied = any(map(normal, lines)) and not any(map(normal, kept))
        out[i] = None if t is None else None if emptied else "\n".join(kept)
        out[i] = (out[i], emptied)
    return out


def test_lines_stage(spark, docs, rows, folder):
    new = deduped({r[0]: r[1] for r in rows if r[0] is not None})
    new[None] = (rows[-1][1], False)
    kept = [(r[0], new[r[0]][0], r[2], r[3], None if r[1] is None else len(new[r[0]][0]), *r[5:]) for r in rows if not new[r[0]][1]]
    same(corpus_pipeline.lines(spark, docs, folder), kept)
    assert len(kept) < len(rows)


def test_near_duplicates_stage(spark, docs, rows, folder):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    reach = {i: i for i in sets}
    for i, j in itertools.combinations(sets, 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            low, high = sorted((reach[i], reach[j]))
            reach = {x: low if c == high else c for x, c in reach.items()}
    one = {r[0]: r for r in rows if r[0] is None or reach[r[0]] == r[0]}
    same(corpus_pipeline.near_duplicates(spark, docs, folder), one.values())
    assert len(one) < len(sets)
    other = spark.createDataFrame([(1, "some text that is here"), (1, "another text that is there"), (2, "x")], "doc_id long, text string")
    first, again = (sorted(map(tuple, corpus_pipeline.near_duplicates(spark, d, folder).collect())) for d in (other, other.orderBy(F.desc("text"))))
    assert first == again and [r[0] for r in first] == [1, 2]


def test_mixture_stage(spark, docs, rows, folder):
    out = corpus_pipeline.mixture(spark, docs, folder)
    assert out.columns == docs.columns
    got = list(map(tuple, out.collect()))
    assert sorted(got, key=str) == sorted(map(tuple, corpus_pipeline.mixture(spark, docs.repartition(3), folder).collect()), key=str)
    size = lambda r: len(WORD.findall(r[1] or ""))
    have = {s: sum(size(r) for r in rows if r[3] == s) for s in ("a", "b", None)}
    want = mixing.targets(list(have.items()))
    for s in have:
        assert abs(sum(size(r) for r in got if r[3] == s) - want[s]) <= 2 * max(size(r) for r in rows if r[3] == s)
    times = {r: got.count(r) for r in set(got)}
    assert all(r in rows and n <= 2 * rows.count(r) for r, n in times.items()) and all(size(r) for r in got)


def test_packing_stage(spark, docs, rows, folder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    ids = {r[0]: np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows}
    out = corpus_pipeline.packed(spark, docs, folder).collect()
    pieces = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out)
    want = sorted((r[0] is None, r[0] or 0, k, len(p := ids[r[0]][k : k + 4096]), zlib.crc32(p.tobytes()), len(ids[r[0]])) for r in rows for k in range(0, len(ids[r[0]]), 4096))
    assert pieces == want
    for _, own in itertools.groupby(sorted(out, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert {r["sequence_id"] for r in out} == set(range(len({r["sequence_id"] for r in out})))


def test_run_applies_the_stages_in_turn(spark, docs, folder, rows):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "ngram_join", "mixing", "packing"]
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        now = spark.createDataFrame(out.collect(), out.schema)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, now.collect())) and now.count() > 10


def test_empty_tables_pass_all_stages(spark, docs, folder):
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0 and (stage is corpus_pipeline.packed or out.columns == docs.columns)
    empty = spark.read.parquet(f"{folder}/labels.parquet").limit(0)
    model = quality_classifier.fit(docs.select("doc_id", "text"), empty)
    assert {r["score"] for r in quality_classifier.scored(docs, model).collect()} == {0.5}


def test_language_profiles_against_a_slow_loop(spark, docs):
    texts = ["Où est-il? été 12", "", "...", None, "Zoë's ÀB", "a" * 30, "x y"]
    fast = language_id.profiles(pa.array(texts))
    for text, got in zip(texts, fast):
        letters = [ord(c.lower()[0]) if c.isalpha() else 0 for c in text or ""]
        letters = [0, *(c for k, c in enumerate(letters) if c or k == 0 or letters[k - 1]), 0]
        total = np.zeros(language_id.DIMENSIONS)
        for i in range(len(letters) - 2):
            if any(gram := letters[i : i + 3]):
                total += np.prod([np.roll(language_id.letter_vectors(np.array([c]))[0], 2 - k) for k, c in enumerate(gram)], axis=0)
        assert (got == total).all()
    prototypes = language_id.learn(docs.where("doc_id is not null"))
    given = spark.createDataFrame([(i, t, 0.5, "own") for i, t in enumerate(texts)], "doc_id long, text string, score double, lang_pred string")
    out = {r["doc_id"]: r for r in language_id.predicted(given, prototypes).collect()}
    names = sorted(prototypes)
    for i, v in enumerate(fast):
        cosines = [float(v @ prototypes[n]) / max(1e-12, np.linalg.norm(v)) for n in names]
        best = int(np.argmax(cosines))
        assert (out[i]["lang_pred"], out[i]["score"]) == ((names[best], pytest.approx(min(1, max(0, cosines[best])))) if v.any() else ("und", 0.0))
    assert language_id.predicted(given, prototypes).columns == ["doc_id", "text", "lang_pred", "score"] and language_id.learn(docs.limit(0)) == {}
    assert language_id.predicted(given.limit(0), prototypes).count() == 0 and {r["lang_pred"] for r in language_id.predicted(given, {}).collect()} == {"und"}
