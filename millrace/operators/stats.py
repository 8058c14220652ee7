"""Dashboard aggregates: counts, rates, buckets, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.values import col, percent


def counts_where(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row: all rows as total, and the rows for which each test holds."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(t).alias(n) for n, t in tests.items()))


def average(c: Column | str, zero_nulls: bool = False) -> Column:
    """Mean to one decimal, halves up; 0 of nothing. Nulls are left out or count as 0."""
    x = F.coalesce(col(c), F.lit(0)) if zero_nulls else col(c)
    return F.coalesce(F.floor(F.avg(x) * 10 + 0.5) / F.lit(10.0), F.lit(0.0))


def buckets(c: Column | str, high: float = 80, middle: float = 50) -> list[Column]:
    """Counts of high, medium and low values; null is 0 and so low."""
    x = F.coalesce(col(c), F.lit(0))
    return [F.count_if(x >= high).alias("high"), F.count_if((x >= middle) & (x < high)).alias("medium"), F.count_if(x < middle).alias("low")]


def grouped_counts(df: DataFrame, c: str) -> DataFrame:
    """Rows by value; null and empty values are left out."""
    return df.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy(c).agg(F.count("*").alias("n"))


def rates(df: DataFrame, c: str, test: Column, otherwise: str = "Autre") -> DataFrame:
    """Rows, rows with the test and their share in per cent by group; null has a group of its own name. Largest first."""
    out = df.groupBy(F.coalesce(F.col(c), F.lit(otherwise)).alias(c)).agg(F.count("*").alias("total"), F.count_if(test).alias("with_value"))
    return out.withColumn("rate", percent("with_value", "total")).orderBy(F.desc("total"), c)


def counts_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by each key and over all in one pass: (key name, value, n)."""
    grouped = df.groupingSets([[k] for k in keys] + [[]], *keys).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    name = F.lit("all")
    for i, k in enumerate(keys):
        name = F.when(F.bitwise_not(F.col("_g")).bitwiseAND(1 << (len(keys) - 1 - i)) != 0, k).otherwise(name)
    return grouped.select(name.alias("dimension"), F.coalesce(*keys).alias("value"), "n")


def top(df: DataFrame, c: str, k: int) -> DataFrame:
    """The k largest groups, ties by name."""
    return grouped_counts(df, c).orderBy(F.desc("n"), c).limit(k)


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """One row per stage with its count, in order, from a single pass."""
    totals = df.agg(*(F.count_if(t).alias(f"s{i}") for i, (_, t) in enumerate(stages)))
    rows = ", ".join(f"{i}, '{n}', s{i}" for i, (n, _) in enumerate(stages))
    return totals.selectExpr(f"stack({len(stages)}, {rows}) AS (step, stage, n)")


def source_stats(results: DataFrame) -> DataFrame:
    """By source: how often it was tried and what it found (source, email, phone, registration)."""
    has = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return results.groupBy("source").agg(F.count("*").alias("tried"), has("email").alias("email_found"), has("phone").alias("phone_found"), has("registration").alias("registration_found"))


def run_summary(results: DataFrame, finds: list[str], averages: list[str]) -> DataFrame:
    """Finds of a run and rounded means, 0 of nothing."""
    has = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return results.agg(*(has(c).alias(f"total_{c}") for c in finds), *(F.coalesce(F.floor(F.avg(c) + 0.5), F.lit(0)).alias(f"avg_{c}") for c in averages))


def estimate(segments: DataFrame, categories: str, cities: int) -> DataFrame:
    """Requests, records, cost and minutes of a run over segments and a number of cities (fixed unit estimates)."""
    out = segments.agg((F.sum(F.size(categories)) * cities).alias("requests"), (F.count("*") * cities).alias("combos"))
    return out.select("requests", "combos", (F.col("combos") * 18).alias("records"), (F.col("requests") * F.lit(0.032)).alias("cost"), F.ceil((F.col("requests") * 0.15 + F.col("combos") * 0.3) / 60).alias("minutes"))


def exported(df: DataFrame, found: Column, counts: dict[str, Column], groups: list[str], k: int = 20) -> DataFrame:
    """Sections (section, content) of a JSON report: counts and rate over all, and the k largest groups of each column.

    Null and empty groups count as one; ties go by name. Each section is at most k groups, whatever the input.
    """
    total = df.agg(F.count("*").alias("total"), F.count_if(found).alias("with_value"), *(F.count_if(t).alias(n) for n, t in counts.items()))
    out = total.withColumn("rate", percent("with_value", "total")).select(F.lit("all").alias("section"), F.to_json(F.struct("*")).alias("content"))
    for g in groups:
        largest = rates(df.select(F.nullif(F.col(g), F.lit("")).alias(g), found.alias("_found")), g, F.col("_found")).limit(k)
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("order"), F.col(g).alias("name"), "total", "with_value")))
        content = largest.agg(F.to_json(F.transform(ordered, lambda x: x.dropFields("order"))).alias("content"))
        out = out.unionByName(content.select(F.lit(g).alias("section"), "content"))
    return out


def status_counts(df: DataFrame, c: str, names: list[str]) -> DataFrame:
    """One row: all rows and those of each status."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(F.col(c) == n).alias(n) for n in names))


def shares(df: DataFrame, c: str, k: int = 5) -> DataFrame:
    """The k largest groups with their share of all rows in whole per cent; null and empty values are counted in all only."""
    all_rows = df.agg(F.count("*").alias("_all"))
    return top(df, c, k).crossJoin(all_rows).select(c, "n", F.floor(F.col("n") * 100 / F.col("_all") + 0.5).alias("share"))  # one row each side at most k


def page_stats(df: DataFrame) -> DataFrame:
    """Figures of the rows at hand where those of the whole table are missing: counts and a rounded mean score."""
    has = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return df.agg(F.count("*").alias("total"), has("email").alias("with_email"), has("phone").alias("with_phone"), has("website").alias("with_website"), F.coalesce(F.floor(F.avg("score") + 0.5), F.lit(0)).alias("avg_score"))


def segment_report(df: DataFrame, segment: str, size: str, errors: str) -> DataFrame:
    """JSON upload figures by segment, the largest first: segment, content."""
    per = df.groupBy(segment).agg(F.count("*").alias("leads"), F.sum(size).alias("uploaded"), F.sum(errors).alias("errors"))
    return per.orderBy(F.desc("leads"), segment).select(segment, F.to_json(F.struct("leads", "uploaded", "errors")).alias("content"))


def upload_report(df: DataFrame, segment: str, uploaded: str, errors: str, timestamp: str, campaign: str, seconds: float) -> DataFrame:
    """One JSON text of an upload: timestamp, total_uploaded, total_errors, by_verticale (rows of each segment), campaign_id, duration_seconds.

    Segments are few: their counts are gathered into one object, the names in order. An empty table has totals of 0 and no segments.
    """
    per = df.groupBy(segment).agg(F.count("*").alias("n"), F.sum(uploaded).alias("u"), F.sum(errors).alias("e"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(segment, F.lit("")).alias("k"), F.col("n").alias("v")))))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    body = F.struct(F.lit(timestamp).alias("timestamp"), zero("u").alias("total_uploaded"), zero("e").alias("total_errors"), counts.alias("by_verticale"), F.lit(campaign).alias("campaign_id"), F.lit(round(seconds, 1)).alias("duration_seconds"))
    return per.agg(F.to_json(body).alias("content"))
