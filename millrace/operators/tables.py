"""Deduplication, joins by key, updates, batches and combinations of record tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.values import col, filled, first_name, folded, parsed_name, valid_email

#: Rows that a cross product may have.
MOST_COMBINATIONS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset a temporary one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """``df`` after a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def bucketed(df: DataFrame, keys: list[str], dealt: bool = False) -> DataFrame:
    """``df`` written to the shared folder, bucketed and sorted by ``keys``: joins by all these keys don't shuffle or sort it again.

    There are as many buckets as shuffle partitions, so that what is joined with it meets it as it is. ``dealt`` tells that the rows come out of
    a join or an aggregate by the keys; others are dealt to the buckets first, so that a bucket is one file. The session's
    catalogue forgets the table at once, its files stay. Joins with it merge: Spark takes the size of its compressed files, which may be
    a tenth of its rows, for that of the table, and would send millions of rows through the driver as a broadcast.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"millrace_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(n, *keys)
    rows.write.option("path", f"{shared_folder(spark)}/{name}").bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved while the catalogue knows the table
    spark.sql(f"DROP TABLE {name}")
    return out.hint("merge")


def keep_first(df: DataFrame, keys: list[str], order: list[str], bypass: Column | None = None) -> DataFrame:
    """The first row of each key in an order; rows for which ``bypass`` holds are all kept.

    The first row is found by an aggregate, which combines before the shuffle, so a hot key is no hot task.
    """
    rows = df.where(~F.coalesce(bypass, F.lit(False))) if bypass is not None else df
    rest = [c for c in df.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*df.columns)
    return first.unionByName(df.where(bypass)) if bypass is not None else first


def keep_best(df: DataFrame, keys: list[str], score: str, order: list[str]) -> DataFrame:
    """The row with the highest score of each key; of equal ones the first in the order. A null score is the lowest."""
    rest = [c for c in df.columns if c not in keys]
    worse = F.struct(F.coalesce(-F.col(score).cast("double"), F.lit(float("inf"))), *(F.col(c) for c in order))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), worse).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; ranks within tasks limit what is shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def email_statistics(df: DataFrame, email: str) -> DataFrame:
    """One row: unique, duplicate and invalid addresses; they add up to the rows."""
    checked = df.select(valid_email(email).alias("e"))
    return checked.agg(F.count_distinct("e").alias("unique"), (F.count("e") - F.count_distinct("e")).alias("duplicate"), F.count(F.when(F.col("e").isNull(), 1)).alias("invalid"))


def new_rows(incoming: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Incoming rows with a key that neither exists nor came earlier."""
    return keep_first(incoming.join(existing.select(key), key, "left_anti").select(*incoming.columns), [key], order)


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows, replaced where the key comes in, and new ones."""
    return existing.join(incoming.select(key), key, "left_anti").select(*existing.columns).unionByName(incoming.select(*existing.columns))


def update(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the non-null columns of their changes; other columns and rows stay."""
    names = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in names))
    return existing.join(renamed, key, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in existing.columns))


def update_where(df: DataFrame, test: Column, **values) -> DataFrame:
    """Compare and set: new values where the test holds."""
    return df.withColumns({c: F.when(test, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def union_keep_first(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of several tables, earlier tables win; rows without a key are all kept. Columns only some have are null elsewhere."""
    tagged = [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    every = every.withColumn("_hash", F.xxhash64(*sorted(c for c in every.columns if c != "_table")))
    return keep_first(every, [key], ["_table", "_hash"], F.coalesce(F.col(key), F.lit("")) == "").drop("_table", "_hash")


def combinations(left: DataFrame, right: DataFrame, order: list[str], default: str | None = None, most: int = MOST_COMBINATIONS) -> DataFrame:
    """Every pair of two small dimension tables, numbered from 0 in an order. An empty side counts as one row of ``default``, if given.

    Both sides are counted first: a product of more than ``most`` rows is an error, so the pairs are few enough to be
    numbered in one task.
    """

    def side(df: DataFrame) -> tuple[DataFrame, int]:
        n = df.limit(most + 1).count()
        return (df, n) if n or default is None else (df.sparkSession.createDataFrame([(default,) * len(df.columns)], df.columns), 1)

    (left, n), (right, m) = side(left), side(right)
    if n * m > most:
        raise ValueError(f"{n} x {m} combinations are more than {most}")
    return left.crossJoin(right).withColumn("combo", F.row_number().over(Window.orderBy(*order)) - 1)


def exploded(segments: DataFrame, categories: str, cities: DataFrame, order: list[str]) -> DataFrame:
    """A row for each category of each segment in each city, numbered."""
    return combinations(segments.withColumn(categories, F.explode(categories)), cities, order)


def overruled(own: DataFrame, custom: DataFrame, key: str) -> DataFrame:
    """Built-in rows and custom ones of other keys, each key once."""
    return keep_first(own.withColumn("_o", F.lit(0)).unionByName(custom.select(*own.columns).withColumn("_o", F.lit(1))), [key], ["_o", *own.columns]).drop("_o")


def batches(df: DataFrame, size: int, order: list[str], key: str = "batch") -> DataFrame:
    """Numbers rows and batches of ``size`` from 0 in an order, with running totals of ranges rather than one sorted task.

    The ranges are of a fixed number and are checkpointed, so that both uses of them see the same rows in each.
    """
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    ranged = kept(df.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()))
    ranged = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_k"))  # one row for each range
    before = counts.withColumn("_before", F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_k")
    out = ranged.join(before, "_part").withColumn("seq", F.col("_n") + F.coalesce("_before", F.lit(0)) - 1)
    return out.withColumn(key, F.floor(F.col("seq") / size)).drop("_part", "_n", "_before")


def numbered(df: DataFrame, part: str, order: list[str], name: str) -> DataFrame:
    """Rows with ``name``: their number from 0 within their ``part`` in an order, however many rows a part has.

    Rows are dealt to ranges by part and order, numbered within each range and part, and moved by what earlier ranges have of the
    part: no task sees more than a range. The ranges are checkpointed, so that both uses of them see the same rows in each.
    """
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    ranged = kept(df.repartitionByRange(ranges, part, *order).withColumn("_part", F.spark_partition_id()))
    own = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part", part).orderBy(*order)))
    counts = ranged.groupBy("_part", F.col(part).alias("_of")).agg(F.count("*").alias("_k"))
    earlier = Window.partitionBy("_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = counts.withColumn("_before", F.coalesce(F.sum("_k").over(earlier), F.lit(0))).withColumnRenamed("_part", "_in").drop("_k")
    both = own.join(before, (own["_part"] == before["_in"]) & own[part].eqNullSafe(before["_of"]))
    return both.withColumn(name, F.col("_n") + F.col("_before") - 1).select(*df.columns, name)


def upload_batches(df: DataFrame, size: int, order: list[str], valid_first: bool = True) -> DataFrame:
    """Rows for an upload (email, name, phone, website, city, category) with batch and seq.

    ``valid_first``: addresses are checked and kept once, then batches are cut. Otherwise batches are cut first and bad
    addresses dropped afterwards, so that batches may be short or missing.
    """
    first, last, company = (parsed_name("name")[n] for n in ("firstName", "lastName", "companyName"))
    named = lambda d: d.withColumns({"email": valid_email("email"), "first_name": first, "last_name": last, "company_name": company})
    if valid_first:
        return batches(keep_first(named(df).where("email is not null"), ["email"], order), size, order)
    return named(batches(df, size, order)).where("email is not null")


def single_uploads(df: DataFrame) -> DataFrame:
    """One payload for each row with an address: email, first_name, company_name, and a map of the other texts that are there."""
    others = F.create_map(*(x for c in ("website", "city", "phone") for x in (F.lit(c), F.col(c))), F.lit("lt_category"), F.col("category"))
    return df.where(F.trim("email") != "").select(F.trim("email").alias("email"), first_name("name").alias("first_name"), F.coalesce("name", F.lit("")).alias("company_name"), F.map_filter(others, lambda _, v: filled(v)).alias("others"))


def upload_totals(results: DataFrame, size: str, uploaded: str = "uploaded", errors: str = "errors") -> DataFrame:
    """One row: uploaded (a missing number is the batch's size), errors, batches."""
    return results.agg(F.coalesce(F.sum(F.coalesce(uploaded, size)), F.lit(0)).alias("uploaded"), F.coalesce(F.sum(F.coalesce(errors, F.lit(0))), F.lit(0)).alias("errors"), F.count("*").alias("batches"))


def appended(df: DataFrame, path: str, size: int, order: list[str]) -> DataFrame:
    """Append rows to a Parquet table and report rows by batch: batch, written. A repeated call appends again."""
    numbered = kept(batches(df, size, order))
    numbered.drop("seq", "batch").write.mode("append").parquet(path)
    return numbered.groupBy("batch").agg(F.count("*").alias("written"))


def update_keys(df: DataFrame, key: str, keys: DataFrame, **values) -> DataFrame:
    """New values for the rows whose key is listed."""
    listed = keys.select(F.col(key).alias("_key")).distinct()
    out = df.join(listed, F.col(key) == F.col("_key"), "left")
    return update_where(out, F.col("_key").isNotNull(), **values).drop("_key")


def merged_rows(df: DataFrame, key: str, order: list[str], texts: list[str], score: str) -> DataFrame:
    """One row for each folded, trimmed key: the latest text that is there for each column, and the highest score.

    Aggregates only, so a hot key is combined before the shuffle; rows without a key are left out.
    """
    at = F.struct(*order)
    latest = [F.max_by(c, F.when(filled(c), at)).alias(c) for c in texts]
    return df.withColumn("_k", folded(F.trim(key))).where(filled("_k")).groupBy(F.col("_k").alias(key)).agg(*latest, F.max(score).alias(score))


def looked_up(df: DataFrame, key: str, lookup, value: str) -> DataFrame:
    """Rows with the result of a look-up that is made once for each distinct key: a function from keys to (key, value)."""
    return df.join(lookup(df.select(key).where(F.col(key).isNotNull()).distinct()).select(key, value), key, "left")


def within(df: DataFrame, latency: str, limit: int, columns: list[str]) -> DataFrame:
    """Results that came later than a limit count as none."""
    return df.withColumns({c: F.when(F.col(latency) <= limit, F.col(c)) for c in columns})


def searched(queries: DataFrame, results: DataFrame, key: str = "place_id", pages: int = 3) -> DataFrame:
    """Results (query, page, rank, key, ...) of queries (seq, query), up to a page, each key once: the first by query, page and rank.

    Results without a key are left out.
    """
    found = queries.join(results, "query").where((F.col("page") <= pages) & filled(key))
    return keep_first(found, [key], ["seq", "page", "rank"])


def payloads(df: DataFrame, batch: str, order: str, columns: list[str]) -> DataFrame:
    """One row per batch with its rows in order; batches are of bounded size."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    return df.groupBy(batch).agg(rows.alias("rows"), F.count("*").alias("size"))


def zero_filled(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join in which missing numbers are 0."""
    return left.join(right.select(key, *columns), key, "left").fillna(0, columns)


def first_hit(df: DataFrame, lookups: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """Adds ``value`` from the first of several keyed lookups that has it."""
    out, found = df, []
    for i, (table, keys) in enumerate(lookups):
        out = out.join(table.select(*keys, F.col(value).alias(f"_{i}")).dropDuplicates(keys), keys, "left")
        found.append(F.col(f"_{i}"))
    return out.withColumn(value, F.coalesce(*found)).drop(*(f"_{i}" for i in range(len(lookups))))


def running_percent(df: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """After each row, the share of its partition's rows done so far, in whole per cent."""
    w = Window.partitionBy(*part)
    done = F.row_number().over(w.orderBy(*order))
    return df.withColumn("percent", F.floor(done * 100 / F.count("*").over(w) + 0.5))


def options(df: DataFrame, c: str, defaults: list[str]) -> DataFrame:
    """Distinct values of a column and the defaults, in French order."""
    extra = df.sparkSession.createDataFrame([(x,) for x in defaults], f"{c} string")
    return df.select(c).where(col(c).isNotNull()).union(extra).distinct().orderBy(F.collate(F.col(c), "fr"), c)
