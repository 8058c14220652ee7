"""Operators 11 to 13 against slow loops, over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import embedding_dedup, fill_middle, positional_index, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = ["ab", "Cé", "d1", "e", "the", "THE", "f_g", "ñandú", "x", "日本"]
    texts = [None, "", " -- ", "the", "ab cé"]
    texts += [rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    texts.append(" ".join(rng.choice(words) for _ in range(20_000)))
    items = [(1, texts[7]), (2, " ".join(terms(texts[9])[3:16])), (2, "zz the"), (3, "D1 e"), (10, None), (11, "--"), (None, "ñandú the"), (12, "the"), (13, texts[-1][:400])]
    docs = spark.createDataFrame([(i, t, "x", 3, 7) for i, t in enumerate(texts)] + [(7, texts[7], "y", 1, 2), (None, texts[8], "z", 0, 0)], "doc_id long, text string, items string, n_words int, segment int")
    return docs, spark.createDataFrame(items, "item_id long, text string")


def found(out):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], tuple(zip(r["starts"], r["ends"], strict=True)), tuple(r["items"])) for r in out.collect())


def runs(hit):
    marks = sorted(hit)
    out = []
    for p in marks:
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return tuple(map(tuple, out))


@pytest.mark.parametrize("most", [positional_index.QUERY_BYTES, 60])
def test_phrases_against_brute_force(corpus, most):
    docs, items = corpus
    rows, queries = docs.collect(), [("" if r["item_id"] is None else str(r["item_id"]), terms(r["text"])) for r in items.collect()]
    want = []
    for r in rows:
        w, hit, named = terms(r["text"]), set(), set()
        for name, q in queries:
            k = min(len(q), 10)
            for j in range(len(q) - k + 1 if k else 0):
                for i in range(len(w) - k + 1):
                    if w[i : i + k] == q[j : j + k]:
                        hit |= set(range(i, i + k))
                        named.add(name)
        want.append((r["doc_id"] is None, r["doc_id"] or 0, len(w), runs(hit), tuple(sorted(named))))
    out = positional_index.phrase_matches(positional_index.build(docs), items, most=most)
    merged = sorted((*r[:3], runs({p for s, e in r[3] for p in range(s, e)}), r[4]) for r in found(out))
    assert merged == sorted(want) and sum(len(x[4]) for x in want) > 20
    counts = {r["doc_id"]: r["n"] for r in out.withColumn("n", positional_index.n_hit()).collect()}
    assert counts[9] == next(sum(e - s for s, e in x[3]) for x in want if x[1] == 9)


def test_terms_near_each_other_against_brute_force(corpus):
    docs, _ = corpus
    queries = docs.sparkSession.createDataFrame([(1, "ab d1 x"), (2, "日本 ñandú f"), (3, "the THE"), (4, "nowhere the"), (5, "")], "item_id long, text string")
    out = positional_index.proximity_matches(positional_index.build(docs), queries, 4)
    got = {(r["doc_id"], r["n_words"]): r for r in out.collect()}
    for r in docs.where("length(text) < 2000").collect():
        w, hit, named = terms(r["text"]), set(), set()
        for q in queries.collect():
            need = set(terms(q["text"]))
            for i in range(len(w)):
                for j in range(i, min(i + 4, len(w))):
                    inner = w[i : j + 1]
                    if need and need <= set(inner) and not need <= set(inner[1:]) and not need <= set(inner[:-1]):
                        hit |= set(range(i, j + 1))
                        named.add(str(q["item_id"]))
        x = got[r["doc_id"], len(w)]
        assert {p for s, e in zip(x["starts"], x["ends"], strict=True) for p in range(s, e)} == hit and x["items"] == sorted(named)


def test_index_of_nothing(corpus):
    docs, items = corpus
    assert positional_index.phrase_matches(positional_index.build(docs.limit(0)), items).count() == 0
    out = positional_index.phrase_matches(positional_index.build(docs), items.limit(0)).agg(F.count("*"), F.max(F.size("items"))).first()
    assert tuple(out) == (docs.count(), 0)


def slow_form(doc_id, text, unit, plain=10, spm=20):
    pattern = {"char": r"(?s).", "word": r"(?:^|[ \t-\r]+)[^ \t-\r]*|^[^ \t-\r]+", "line": r"[^\n]*\n|[^\n]+"}[unit]
    t = text or ""
    units = re.findall(pattern, t) if unit != "word" else [u for u in re.findall(r"^[^ \t-\r]+|[ \t-\r]+[^ \t-\r]*", t)]
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, t
    a, b, c = "".join(units[:p]), "".join(units[p:q]), "".join(units[q:])
    return (n, "spm", p, q - p, f"<S>{c}<P>{a}<M>{b}") if h[3] % 100 < spm else (n, "psm", p, q - p, f"<P>{a}<S>{c}<M>{b}")


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_forms_against_brute_force(spark, unit):
    rng = random.Random(2)
    texts = [None, "", "a", "<", "x <S> y", "é", "áb😀", "<P", "<S<M", " \n\n "]
    texts += ["".join(rng.choice("ab é日😀<>PSM \n\t") for _ in range(rng.randint(0, 70))) for _ in range(300)]
    texts.append("日é" * 200_000)
    rows = [(i, t, 5, "f") for i, t in enumerate(texts)] + [(3, "<", 5, "f"), (None, "no key", 5, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, TEXT string, n int, form string")
    out = fill_middle.transformed(docs, unit=unit)
    assert out.columns == ["doc_id", "text", "n", "form", "_n", "_form", "prefix_units", "middle_units"]
    got = sorted(out.withColumn("back", fill_middle.restored("text", "_form")).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    for r, (i, t, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        assert (r["_n"], r["_form"], r["prefix_units"], r["middle_units"], r["text"]) == slow_form(i, t, unit)
        assert r["back"] == (t or "") and (r["n"], r["form"]) == (5, "f")
    assert {r["_form"] for r in got} == set(fill_middle.FORMS)
    assert fill_middle.transformed(docs.limit(0), unit=unit).count() == 0


def test_forms_of_sliced_batches():
    texts = pa.array(["skip", "aé", None, "", "b日c"]).slice(1)
    h = np.array([[1, 0, 0, 2], [2, 0, 0, 0], [0, 0, 0, 0], [99, 0, 0, 0]])
    out, n, form, _ = fill_middle.rearranged(texts, h, "char", 10, 20)
    assert out.to_pylist() == ["<P>a<S><M>é", "", "", "<S>c<P><M>b日"] and n.tolist() == [2, 0, 0, 3] and form.tolist() == [1, 0, 0, 2]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, n int")


@pytest.mark.parametrize("dims", [1, 3, 24, 90])
def test_whitening_against_dense_eigenvectors(spark, dims):
    rng = np.random.default_rng(dims)
    raw = (rng.standard_normal((160, dims)) * (1 + np.arange(dims)[::-1]) ** 0.4 / 9 + 0.3).astype(np.float32)
    rows = [(i, [float(c) for c in v], 1, "a", 0) for i, v in enumerate(raw)]
    rows += [(0, rows[0][1], 1, "a", 0), (None, rows[1][1], 1, "a", 0), (500, None, 1, "a", 0), (501, [], 1, "a", 0), (502, [0.5] * (dims + 1), 1, "a", 0)]
    rows += [(503 + i, [*rows[2][1][:-1], bad], 1, "a", 0) for i, bad in enumerate((None, float("nan"), float("inf"), -float("inf"), 3e38))]
    out = whitening.whiten(vectors(spark, rows)).collect()
    kept = raw.astype(np.float64)
    x = np.floor(256 * kept).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    values, vectors_ = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    k = min(4, dims)
    assert len(out) == k * (len(raw) + 2) and {r["vec_id"] for r in out if (r["vec_id"] or 0) >= 500} == set()
    z = ((x - mean) @ vectors_)[:, ::-1][:, :k] / np.sqrt(values[::-1][:k])
    by = {(r["vec_id"], r["component"]): r for r in out}
    sums = fit.sum(axis=0)
    for j in range(k):
        sign = np.sign(by[0, j + 1]["whitened"] * z[0, j])
        for i in range(len(raw)):
            r = by[i, j + 1]
            assert abs(r["whitened"] * sign - z[i, j]) < 1e-8 and r["n"] == n and r["deviation"] == int(((n * x[i] - sums) ** 2).sum())
            assert abs(r["explained"] - values[::-1][j] / values.sum()) < 1e-10 and r["identity_error"] < 1e-9
        assert by[None, j + 1]["whitened"] == by[1, j + 1]["whitened"]


def test_whitening_without_variance(spark):
    out = whitening.whiten(vectors(spark, [(1, [0.5, 0.25, 0.5], 1, "a", 0), (2, [0.5, 0.5, 0.5], 1, "a", 0), (2, [0.5, 0.5, 0.5], 1, "a", 0)])).orderBy("vec_id", "component").collect()
    assert [r["component"] for r in out] == [1, 2, 3, 1, 1, 2, 2, 3, 3] and all((r["whitened"] is None) == (r["component"] > 1) for r in out)
    assert abs(out[0]["explained"] - 1) < 1e-12 and out[1]["explained"] == 0 and out[0]["n"] == 2 and abs(abs(out[0]["whitened"]) - 1) < 1e-12
    one = whitening.whiten(vectors(spark, [(1, [0.5], 1, "a", 0)])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, 0)]
    assert whitening.whiten(vectors(spark, [(1, [None], 1, "a", 0)])).count() == 0


def test_deviation_beyond_doubles(spark):
    big = [(i, [float(2**20 + i), float(-i)], 1, "a", 0) for i in range(300)]
    out = {r["vec_id"]: r["deviation"] for r in whitening.whiten(vectors(spark, big)).where("component = 1").collect()}
    x = [[256 * (2**20 + i), -256 * i] for i in range(300)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert all(out[i] == sum((300 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(x))


def test_lobpcg_certifies_clustered_eigenvalues():
    rng = np.random.default_rng(4)
    basis = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    values = np.concatenate([[5, 4.999, 4.998, 4.99], np.linspace(4.9, 0, 116)])
    matrix = (basis * values) @ basis.T
    v, e, residual, steps = whitening.lobpcg(lambda d: matrix @ d, 120, 4)
    assert np.allclose(e, values[:4], rtol=1e-12) and (residual <= 1e-11).all() and steps < 200
    assert np.abs(np.abs((v * basis[:, :4]).sum(axis=0)) - 1).max() < 1e-12


@pytest.mark.parametrize("order", [1, -1])
def test_rows_of_one_id_are_vectors_of_their_own(spark, order):
    rows = [(1, [1.0, 0, 0], 1), (1, [0, 1.0, 0], 1), (2, [1.0, 0.01, 0], 1), (3, [0.01, 1.0, 0], 1), (4, [0, 0, 1.0], 1), (4, [0, 0, 1.0], 1), (None, [1.0, 0, 0], 1)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame([(i, list(map(float, v)), k) for i, v, k in rows[::order]], "vec_id long, embedding array<float>, label int"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 1, 1, True)] * 2 + [(2, 1, 1, False), (3, 1, 1, False)] + [(4, 1, 4, True)] * 2 + [(None, 0, None, True)], key=str)


def test_unsure_pairs_are_settled_without_rows_of_pairs(spark):
    rng = np.random.default_rng(1)
    angle = np.arccos(0.98) * (1 + rng.standard_normal(300) * 1e-9)
    spokes = np.stack([np.cos(angle), np.sin(angle) * np.cos(np.arange(300)), np.sin(angle) * np.sin(np.arange(300))], axis=1)
    x = np.concatenate([[[1.0, 0, 0]], spokes])
    out = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id")
    norm = np.linalg.norm(x, axis=1)
    links = ((x @ x.T) / norm / norm[:, None] >= 0.98).sum(axis=1) - 1
    assert 60 < links[0] < 240 and (np.abs(out.n_links.sort_index().to_numpy() - links) <= 1).all() and abs(out.n_links[0] - links[0]) <= 3


def test_earlier_leaves_are_looked_up_for_hits_only():
    rng = np.random.default_rng(2)
    unit = rng.standard_normal((2048, 64)) + 4
    grid, slack = embedding_dedup.on_grid(unit / np.linalg.norm(unit, axis=1)[:, None])
    codes = [np.concatenate([rng.integers(0, 3000, rng.integers(1, 3)) * 6 + t for t in range(5)]) for _ in range(2048)]
    began = time.time()
    found = [x for x in embedding_dedup.hits(np.zeros(2048, int), grid, slack, codes, 6, 0.98)]
    took = time.time() - began
    assert took < 2  # 0.1 s where nothing else runs; a table of all leaves took 2 s
    seen = {(a, b) for i, j, _ in found for a, b in zip(i.tolist(), j.tolist())}
    cosine = (unit @ unit.T) / np.linalg.norm(unit, axis=1) / np.linalg.norm(unit, axis=1)[:, None]
    sets = [set(c.tolist()) for c in codes]
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(cosine >= 0.98, 1))) if not sets[a] & sets[b]}
    assert want <= seen and all(cosine[p] > 0.9799 for p in seen)
