"""What the n-gram join writes and shuffles stays in proportion to its input."""

import random
import time

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import ngram_join


def test_signatures_take_few_bytes_in_many_buckets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in rng.integers(100, 500, 200)]
    bounds = np.cumsum([0, *map(len, sets)])
    ids, whole = 7_000_000 + np.arange(200) * 3, rng.integers(0, 2**64, 200, np.uint64)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sig, _, _ = ngram_join.signatures(np.concatenate(sets), bounds)
    out = list(ngram_join._spread(ids, whole, rng.random(200) < 0.1, np.concatenate(sets), bounds, 900, none, 75))
    assert sum(len(b) for _, b in out) < 14 * len(sig)  # 32 with ids, hashes, sizes and counts in full


@pytest.mark.parametrize("seed", range(4))
def test_what_buckets_get_is_read_again(seed):
    rng = np.random.default_rng(seed)
    for k in (1, 2, 30):
        head = np.zeros(k, ngram_join._HEAD)
        ids = rng.integers(-(2**63), 2**63 - 1, k) if seed % 2 else 5 * 10**12 + rng.integers(0, 90, k)
        head["id"], head["set"] = np.sort(ids), rng.integers(0, 2**64, k, np.uint64)
        head["n"], head["need"], head["sigs"] = rng.integers(1, 2**18, k), rng.integers(1, 400, k), rng.integers(1, [3, 700][seed // 2], k)
        copied, sigs = rng.random(k) < 0.5, rng.integers(0, 2**32, int(head["sigs"].sum()), np.uint64)
        got, told, back = ngram_join._open(ngram_join._blob(head, copied, sigs))
        assert (got["id"] == head["id"]).all() and (got["sigs"] == head["sigs"]).all() and (told == copied).all() and (back == sigs).all()
        assert (got["set"] == np.where(copied, head["set"], 0)).all()
        assert (got["n"] == np.minimum(head["n"], 65535)).all() and (got["need"] == np.minimum(head["need"], 255)).all()


def test_passages_of_a_few_documents_are_not_taken_for_rare(spark):
    """More documents than a sample would tell, with elements of their own and passages that twelve documents have: none has to be compared in blocks."""
    rng = np.random.default_rng(2)
    passages = rng.integers(0, 2**63, (400, 20), np.uint64)
    rows, near = [], set()
    for i in range(4_800):
        own = rng.integers(0, 2**63, 40, np.uint64)
        if i % 100 == 99:  # the one before with two elements changed
            own = np.concatenate([last[2:], own[:2]])
            near.add((i - 1, i))
        last = own
        whole = np.unique(np.concatenate([own, passages[(i - i % 100 + min(i % 100, 98)) % 400]]))
        rows.append((i, i, whole.tobytes()))
    sets = spark.createDataFrame([(i, s) for i, _, s in rows], "doc_id long, set binary")
    met = ngram_join._rare(spark.createDataFrame([r[:2] for r in rows], "doc long, c long"), sets, 16, 75).collect()
    assert not [r for r in met if r["kind"] == 2]
    assert near <= {(r["u"], r["v"]) for r in met if r["kind"] == 1}


@pytest.mark.parametrize("kind", ["long", "int"])
def test_texts_of_documents_that_stay_are_not_shuffled(spark, kind):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=2_000))
    texts = [[word() for _ in range(40)] for _ in range(50)]
    rows = [(i, " ".join(w), "s") for i, w in enumerate(texts)] + [(60, " ".join([*texts[3], "more"]), "s"), (4, "of one id a b c", "s"), (None, "no id", "s"), (None, None, None)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, source string").cache()
    assert docs.count() == 54
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty(30_000)
        time.sleep(0.5)
        found = context.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = shuffled()
    out = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert shuffled() - before < 0.3 * sum(len(t or "") for _, t, _ in rows)
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == list(range(50)) and sum(r["doc_id"] is None for r in out) == 2
    assert {r["doc_id"]: r["text"] for r in out if r["doc_id"] not in (4, None)} == {i: " ".join(w) for i, w in enumerate(texts) if i != 4}
