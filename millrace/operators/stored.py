"""Stored tables that are changed: merges that write only the partitions they touch, appends that count once.

Files are never changed. A change writes new files first and then one small file that says which of them the table has (a
manifest, or a ledger of batches): until that file is there readers see the table as it was, and what a broken change left is not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators.tables import batches, kept

#: Partitions of a new table: a merge reads and writes those whose keys come in.
PARTS = 64
#: ignore: keys that are there stay as they are; overwrite: they take all columns; sparse: they take what isn't null, and no key is added.
WAYS = ("ignore", "overwrite", "sparse")


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The latest version, and the folder of each partition in it: as many rows as partitions."""
    rows = spark.read.schema("part int, folder string, version long").parquet(f"{path}/manifest")
    last = rows.agg(F.max("version")).first()[0]
    return last, {r["part"]: r["folder"] for r in rows.where(F.col("version") == last).collect() if r["part"] >= 0}


def _commit(spark: SparkSession, path: str, version: int, folders: dict[int, str], parts: int) -> None:
    """One file, and so one rename; an error if another change has taken the version."""
    spark.createDataFrame([(-parts, ""), *folders.items()], "part int, folder string").coalesce(1).write.parquet(f"{path}/manifest/version={version}")


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _staged(rows: DataFrame, path: str, parts: int) -> tuple[str, set[int]]:
    """Rows (with _part) in a new folder, a subfolder for each partition, and the partitions there are."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.repartition(parts, "_part").sortWithinPartitions("_part").write.partitionBy("_part").parquet(f"{path}/{folder}")
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
    listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    names = [s.getPath().getName() for s in listed]
    return folder, {int(n.removeprefix("_part=")) for n in names if n.startswith("_part=")}


def create(df: DataFrame, path: str, key: str, parts: int = PARTS) -> None:
    """A stored table of ``df``, whose keys are unique and not null. An error if there is one already."""
    folder, there = _staged(df.withColumn("_part", _part(key, parts)), path, parts)
    _commit(df.sparkSession, path, 0, {p: f"{folder}/_part={p}" for p in there}, parts)


def read(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The table as of its latest version, or an earlier one."""
    rows = spark.read.schema("part int, folder string, version long").parquet(f"{path}/manifest")
    last = rows.agg(F.max("version")).first()[0] if version is None else version
    folders = [r["folder"] for r in rows.where((F.col("version") == last) & (F.col("part") >= 0)).collect()]
    return _folders(spark, path, folders, schema)


def _folders(spark: SparkSession, path: str, folders: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)


def merge(path: str, incoming: DataFrame, key: str, schema: str, way: str = "overwrite", order: list[str] | None = None) -> dict[str, int]:
    """Merge rows into a stored table in one of WAYS and return how many were inserted and updated.

    ``incoming`` may have some of the columns; those it lacks are null in new rows and stay in others. Of incoming rows of one key the
    first in ``order`` counts (by their hash, if there is none); rows without a key are left out. Only partitions that keys come in for are read and
    written, the files of the others stay what they are. Nothing coming in makes no new version.
    """
    if way not in WAYS:
        raise ValueError(f"{way} is none of {WAYS}")
    spark = incoming.sparkSession
    version, folders = _manifest(spark, path)
    parts = -spark.read.schema("part int, version long").parquet(f"{path}/manifest").where(F.col("version") == version).agg(F.min("part")).first()[0]
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    given = [c for c in names if c in incoming.columns and c != key]
    first = F.struct(*(order or []), F.xxhash64(*incoming.columns))
    new = incoming.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(F.lit(True).alias("_in"), *given), first).alias("_new"))
    new = kept(new.withColumn("_part", _part("_key", parts)))
    touched = {r["_part"] for r in new.select("_part").distinct().collect()}
    if not touched:
        return {"inserted": 0, "updated": 0}
    old = _folders(spark, path, [folders[p] for p in sorted(touched & set(folders))], schema).withColumn("_old", F.lit(True))
    both = old.join(new.drop("_part"), old[key] == new["_key"], "full" if way != "sparse" else "left")
    is_old, is_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    take = {"ignore": lambda c: F.when(is_old, F.col(c)).otherwise(F.col(f"_new.{c}")), "overwrite": lambda c: F.when(is_new, F.col(f"_new.{c}")).otherwise(F.col(c)), "sparse": lambda c: F.coalesce(F.col(f"_new.{c}"), F.col(c))}[way]
    columns = [F.coalesce(F.col(key), F.col("_key")).alias(key) if c == key else take(c).alias(c) if c in given else F.col(c) for c in names]
    seen = Observation()
    counted = both.select(*columns, (is_new & ~is_old).alias("_inserted"), (is_new & is_old & F.lit(way != "ignore")).alias("_updated")).observe(seen, F.count_if("_inserted").alias("inserted"), F.count_if("_updated").alias("updated"))
    folder, there = _staged(counted.drop("_inserted", "_updated").withColumn("_part", _part(key, parts)), path, parts)
    _commit(spark, path, version + 1, {p: f for p, f in folders.items() if p not in touched} | {p: f"{folder}/_part={p}" for p in there}, parts)
    return {n: int(seen.get[n]) for n in ("inserted", "updated")}


LEDGER = "run string, attempt string, batch long, rows long, inserted long, failed long"


def opened(spark: SparkSession, path: str) -> None:
    """A table for ``append_once``; one that is there stays."""
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(f"{path}/ledger")


def append_once(df: DataFrame, path: str, run: str, size: int, order: list[str], check: Column | None = None) -> DataFrame:
    """Append rows in batches and return what became of each: batch, rows, inserted, failed.

    A batch with a row for which ``check`` doesn't hold fails as a whole. A batch of a run that the ledger has is not added again, so that a
    call that is repeated, or that broke off, adds every batch once; failed batches are tried again. Batches are cut in ``order``, which must tell rows
    apart for that.
    """
    spark = df.sparkSession
    ledger = spark.read.schema(LEDGER).parquet(f"{path}/ledger").where(F.col("run") == run)
    done = kept(ledger.where("failed = 0"))
    good = F.coalesce(check, F.lit(False)) if check is not None else F.lit(True)
    rows = kept(batches(df, size, order).drop("seq").withColumn("_good", good).withColumnRenamed("batch", "_batch"))
    per = rows.groupBy(F.col("_batch").cast("long").alias("batch")).agg(F.count("*").alias("rows"), F.min(F.col("_good").cast("int")).alias("_good"))
    todo = kept(per.join(done.select("batch"), "batch", "left_anti"))
    attempt = uuid.uuid4().hex
    wanted = todo.where("_good = 1").select(F.col("batch").alias("_batch"))
    rows.join(wanted, "_batch", "left_semi").drop("_batch", "_good").write.parquet(f"{path}/data/attempt={attempt}")
    ok = F.col("_good") == 1
    entries = todo.select(F.lit(run).alias("run"), F.lit(attempt).alias("attempt"), "batch", "rows", F.when(ok, F.col("rows")).otherwise(0).cast("long").alias("inserted"), F.when(ok, 0).otherwise(F.col("rows")).cast("long").alias("failed"))
    entries.coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    return entries.select("batch", "rows", "inserted", "failed").unionByName(done.select("batch", "rows", F.lit(0).cast("long").alias("inserted"), F.lit(0).cast("long").alias("failed")))


def appended_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all attempts that the ledger has."""
    known = spark.read.schema(LEDGER).parquet(f"{path}/ledger").select("attempt").distinct()
    return spark.read.schema(f"{schema}, attempt string").parquet(f"{path}/data").join(F.broadcast(known), "attempt", "left_semi").drop("attempt")
