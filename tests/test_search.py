"""Many keywords against a chain of searches, and paged searches over a store."""

import random

import pytest
from millrace.operators import keywords
from millrace.sources import remote
from pyspark.sql import functions as F


@pytest.mark.parametrize("most", [keywords.KEYWORD_BYTES, 40])
def test_first_keywords_against_a_chain(spark, most):
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("abé日 .") for _ in range(n))
    words = [(i, make(rng.randint(1, 5))) for i in range(60)]
    words += [(70, words[3][1]), (2, words[9][1]), (None, "a"), (5, None)]
    texts = [(i, make(rng.randint(0, 30)), 9) for i in range(200)] + [(300, None, 9), (301, "", 9), (301, "", 9), (302, "ab" * 100_000, 9)]
    rows = spark.createDataFrame(texts, "id long, t string, first int")
    for more in ([], [(65, "")]):
        table = spark.createDataFrame(words + more, "seq long, keyword string")
        out = keywords.first_keyword(rows, "t", table, name="seq", most=most).collect()
        want = sorted((i, min((s for s, w in words + more if s is not None and w is not None and t is not None and w in t), default=None)) for i, t, _ in texts)
        assert sorted((r["id"], r["seq"]) for r in out) == want and out[0].asDict().keys() == {"id", "t", "first", "seq"}
    assert keywords.first_keyword(rows.limit(0), "t", table).count() == 0
    assert keywords.first_keyword(rows.drop("first"), "t", table.limit(0)).where("first IS NOT NULL").count() == 0


def test_pages_of_a_search(spark, tmp_path):
    store = {("dentist", None): ([{"place_id": "a", "name": "A"}, {"place_id": None}], "1"), ("dentist", "1"): ([{"place_id": "b"}], "2"), ("dentist", "2"): ([{"place_id": "c"}], "3"), ("dentist", "3"): ([{"place_id": "never"}], None), ("lawyer", None): ([], None)}
    asked = f"{tmp_path}/asked"

    def fetch(query, token):
        with open(asked, "a") as f:
            f.write(f"{query} {token}\n")
        return store[query, token]

    remote.register(spark, "places", ["lawyer", "dentist"], {"place_id": "string", "name": "string"}, fetch)
    rows = spark.read.format("places").load().orderBy("seq", "page").collect()
    assert [tuple(r) for r in rows] == [(1, "dentist", 1, 0, "a", "A"), (1, "dentist", 2, 0, "b", None), (1, "dentist", 3, 0, "c", None)]
    open(asked, "w").close()
    assert spark.read.format("places").load().where(F.col("query") == "lawyer").count() == 0
    assert open(asked).read() == "lawyer None\n"  # the filter is taken over: no other query is asked
    assert spark.read.format("places").load().where("query = 'nothing'").count() == 0
    one = spark.read.format("places").load().where("query IN ('dentist') AND page < 2").collect()
    assert [r["place_id"] for r in one] == ["a"]
