"""Stored tables: merges touch only their partitions, broken changes are not read, appends count once."""

import random
from pathlib import Path

import pytest
from millrace.operators import stored
from pyspark.sql import functions as F

SCHEMA = "id long, name string, score int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet") if "manifest" not in str(p)}


@pytest.fixture
def table(spark, tmp_path):
    stored.create(spark.range(200).selectExpr("id", "'n' || id AS name", "CAST(id AS INT) AS score"), f"{tmp_path}/t", "id", 16)
    return f"{tmp_path}/t"


def test_merges_against_a_dictionary(spark, table):
    rng = random.Random(3)
    want = {i: (f"n{i}", i) for i in range(200)}
    for way in ("overwrite", "ignore", "sparse", "overwrite", "sparse"):
        keys = rng.sample(range(260), 7)
        given = [(k, rng.choice([None, f"x{k}"]), rng.choice([None, k * 2])) for k in keys] + [(None, "no key", 1)]
        got = stored.merge(table, spark.createDataFrame(given, SCHEMA), "id", SCHEMA, way)
        inserted = updated = 0
        for k, name, score in given[:-1]:
            if k in want and way != "ignore":
                updated += 1
                old = want[k]
                want[k] = (name, score) if way == "overwrite" else (name if name is not None else old[0], score if score is not None else old[1])
            elif k not in want and way != "sparse":
                inserted += 1
                want[k] = (name, score)
        assert got == {"inserted": inserted, "updated": updated}
        assert rows(stored.read(spark, table, SCHEMA)) == sorted(((k, *v) for k, v in want.items()), key=str)


def test_other_partitions_keep_their_files(spark, table):
    before = files(table)
    some = spark.createDataFrame([(5, 1), (5, 2), (999, 3)], "id long, score int")  # a key twice, a column less
    assert stored.merge(table, some, "id", SCHEMA, order=["score"]) == {"inserted": 1, "updated": 1}
    after = files(table)
    assert all(after[f] == t for f, t in before.items()) and 1 <= len({f.split("/")[2] for f in after if f not in before}) <= 2
    live = stored.read(spark, table, SCHEMA)
    assert rows(live.where("id IN (5, 999)")) == [(5, "n5", 1), (999, None, 3)] and live.count() == 201
    assert len(set(live.inputFiles()) & {f"file://{table}/{f}" for f in before}) >= 14
    assert stored.read(spark, table, SCHEMA, version=0).count() == 200
    assert stored.merge(table, some.limit(0), "id", SCHEMA) == {"inserted": 0, "updated": 0} and stored._manifest(spark, table)[0] == 1


def test_a_broken_merge_leaves_the_table_as_it_was(spark, table, monkeypatch):
    change = spark.createDataFrame([(1, "new", 1)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(stored, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            stored.merge(table, change, "id", SCHEMA)
    assert stored.read(spark, table, SCHEMA).where("name = 'new'").count() == 0
    assert stored.merge(table, change, "id", SCHEMA) == {"inserted": 0, "updated": 1} and stored.read(spark, table, SCHEMA).where("name = 'new'").count() == 1
    with pytest.raises(Exception, match="(?i)exists"):
        stored._commit(spark, table, 1, {}, 16)  # another change took the version
    with pytest.raises(ValueError):
        stored.merge(table, change, "id", SCHEMA, "odd")


def test_appends_count_once(spark, tmp_path, monkeypatch):
    path, df = f"{tmp_path}/a", spark.range(25).selectExpr("id", "IF(id = 12, '', 'x') AS email")
    stored.opened(spark, path)
    stored.opened(spark, path)
    check = F.col("email") != ""
    assert rows(stored.append_once(df, path, "r", 10, ["id"], check)) == [(0, 10, 10, 0), (1, 10, 0, 10), (2, 5, 5, 0)]
    assert stored.appended_rows(spark, path, "id long, email string").count() == 15
    assert rows(stored.append_once(df, path, "r", 10, ["id"], check)) == [(0, 10, 0, 0), (1, 10, 0, 10), (2, 5, 0, 0)]
    assert stored.appended_rows(spark, path, "id long, email string").count() == 15
    mended = df.withColumn("email", F.lit("y"))
    with monkeypatch.context() as m:  # the data is written, the ledger is not
        m.setattr(F, "when", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            stored.append_once(mended, path, "r", 10, ["id"], check)
    assert stored.appended_rows(spark, path, "id long, email string").count() == 15
    assert rows(stored.append_once(mended, path, "r", 10, ["id"], check)) == [(0, 10, 0, 0), (1, 10, 10, 0), (2, 5, 0, 0)]
    assert sorted(r["id"] for r in stored.appended_rows(spark, path, "id long, email string").collect()) == list(range(25))
    assert stored.append_once(df.limit(0), path, "s", 10, ["id"]).count() == 0
    assert rows(stored.append_once(df.limit(3), path, "s", 2, ["id"])) == [(0, 2, 2, 0), (1, 1, 1, 0)]
