"""Readers and writers of record files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.values import first_match, number
from millrace.operators.tables import batches

PERSON = T.StructType([*(T.StructField(n, T.StringType()) for n in ("name", "firstName", "lastName", "title", "email", "phone", "linkedinUrl", "linkedin_url", "source")), T.StructField("confidence", T.IntegerType())])


def csv(spark: SparkSession, path: str, kinds: dict[str, str] | None = None, lists: dict[str, str] | None = None, line_breaks: bool = False) -> DataFrame:
    """CSV files with a header, all text trimmed; ``kinds`` are cast leniently, ``lists`` split at a separator. Short rows have nulls.

    Large files are split between tasks; ``line_breaks`` tells that quoted values hold some, and then a file is one task.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", line_breaks).option("escape", '"').csv(path)
    out = raw.select(*(F.trim(F.col(f"`{c}`")).alias(c) for c in raw.columns))
    out = out.withColumns({c: number(c, k) for c, k in (kinds or {}).items()}) if kinds else out
    return out.withColumns({c: F.filter(F.split(c, f"\\Q{s}\\E"), lambda x: x != "") for c, s in lists.items()}) if lists else out


def ragged(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Lines whose number of fields differs from the header's: line, fields, expected."""
    lines = spark.read.text(path)
    head = lines.first()
    expected = len(head[0].split(separator)) if head else 0
    bare = F.regexp_replace("value", '"[^"]*"', "")
    return lines.select(F.col("value").alias("line"), F.size(F.split(bare, f"\\Q{separator}\\E")).alias("fields"), F.lit(expected).alias("expected")).where("fields <> expected")


def write_csv(df: DataFrame, path: str, lists: dict[str, str] | None = None) -> None:
    """All values quoted, quotes doubled, lists joined."""
    df.withColumns({c: F.array_join(c, s) for c, s in (lists or {}).items()}).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def csv_lines(df: DataFrame, headers: dict[str, str], order: list[str], lists: dict[str, str] | None = None, mark: bool = True) -> DataFrame:
    """An export as lines (seq, line): the header, plain, behind one byte-order mark, then rows with all values quoted.

    ``headers``: the column behind each title. Quotes are doubled, lists joined, nulls empty. Rows are numbered from 1 in an order.
    """
    joined = df.withColumns({c: F.array_join(c, s) for c, s in (lists or {}).items()})
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in headers.values()]
    rows = batches(joined, 1, order).select((F.col("seq") + 1).cast("long").alias("seq"), F.concat_ws(",", *cells).alias("line"))
    head = ("\ufeff" if mark else "") + ",".join(headers)
    return df.sparkSession.createDataFrame([(0, head)], "seq long, line string").unionByName(rows)


def write_csv_export(df: DataFrame, path: str, headers: dict[str, str], order: list[str], lists: dict[str, str] | None = None, mark: bool = True) -> None:
    """``csv_lines`` as text files whose names are in the order of the lines: joined they are one export, of which only the first has the header."""
    csv_lines(df, headers, order, lists, mark).repartitionByRange("seq").sortWithinPartitions("seq").select("line").write.text(path)


def by_segment(leads: DataFrame, segments: dict[str, str], text: str = "category", otherwise: str = "other") -> DataFrame:
    """Rows with the segment whose first keyword their lower-case text contains."""
    return leads.withColumn("segment", first_match(F.lower(text), segments, otherwise))


_FIGURES = ("totalEmails", "totalPhones", "totalSiret", "totalDirigeants", "avgConfidence", "avgDurationMs")
_SOURCE_FIGURES = ("tried", "emailFound", "phoneFound", "siretFound")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _text(v: Column, name: str) -> Column:
    """A field that is a text, else null."""
    return F.when(_is(_field(v, name), "STRING"), F.try_variant_get(_field(v, name), "$", "string"))


def _number(v: Column, name: str) -> Column:
    """A field that is a number, else 0."""
    some = F.schema_of_variant(_field(v, name)).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)")
    return F.coalesce(F.when(some, F.try_variant_get(_field(v, name), "$", "double")), F.lit(0.0))


def _list(v: Column) -> Column:
    return F.coalesce(F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")), F.expr("CAST(array() AS array<variant>)"))


def job_summary(c: Column | str) -> Column:
    """Figures of a job from JSON text as it is stored: a struct of _FIGURES, 0 where one is missing or no number; null unless it is an object."""
    v = F.try_parse_json(c)
    return F.when(_is(v, "OBJECT"), F.struct(*(_number(v, n).alias(n) for n in _FIGURES)))


def source_map(c: Column | str) -> Column:
    """Counts of sources from a JSON object of objects: map of struct _SOURCE_FIGURES; null without any. Other members are left out."""
    parsed = F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"})
    objects = F.map_filter(parsed, lambda _, t: _is(F.try_parse_json(t), "OBJECT") | _is(F.try_parse_json(t), "ARRAY"))
    counts = F.transform_values(objects, lambda _, t: F.struct(*(_number(F.try_parse_json(t), n).alias(n) for n in _SOURCE_FIGURES)))
    return F.when(F.size(counts) > 0, counts)


def lead_result(v: Column) -> Column:
    """A record's result as it is stored (a variant), or null without a leadId: texts that are none are null, the status is one of three or null."""
    status, name = _text(v, "status"), lambda d, n: _text(d, n).alias(n)
    people = F.filter(_list(_field(v, "decisionMakers")), lambda d: _text(d, "name").isNotNull())
    person = lambda d: F.struct(*(name(d, n) for n in ("name", "firstName", "lastName", "title", "email", "phone", "linkedinUrl")), F.coalesce(_text(d, "source"), F.lit("unknown")).alias("source"), _number(d, "confidence").alias("confidence"))
    tried = F.transform(_list(_field(v, "sourcesTried")), lambda x: F.try_variant_get(x, "$", "string"))
    return F.when(
        _text(v, "leadId").isNotNull(),
        F.struct(name(v, "leadId"), name(v, "name"), F.when(status.isin("enriched", "failed", "skipped"), status).alias("status"), *(name(v, n) for n in ("bestEmail", "bestPhone", "dirigeant", "siret")), _number(v, "confidence").alias("confidence"), tried.alias("sourcesTried"), F.transform(people, person).alias("decisionMakers")),
    )


def lead_results(c: Column | str) -> Column:
    """Results from JSON text, an array of objects; others and those without a leadId are left out."""
    return F.filter(F.transform(_list(F.try_parse_json(c)), lead_result), lambda r: r.isNotNull())


def json_people(c: Column | str) -> Column:
    """People from JSON text: an array of objects; others and nameless ones are left out, texts default to empty."""
    parsed = F.from_json(c, T.ArrayType(PERSON), {"mode": "PERMISSIVE"})
    text = lambda p, n: F.coalesce(p[n], F.lit(""))
    named = F.filter(parsed, lambda p: F.coalesce(p["name"], F.lit("")) != "")
    link = lambda p: F.coalesce(p["linkedinUrl"], p["linkedin_url"], F.lit(""))
    whole = F.transform(named, lambda p: F.struct(*(text(p, n).alias(n) for n in ("name", "firstName", "lastName", "title", "email", "phone")), link(p).alias("linkedinUrl"), text(p, "source").alias("source"), F.coalesce(p["confidence"], F.lit(0)).alias("confidence")))
    return F.coalesce(whole, F.expr("filter(array(), x -> false)").cast(T.ArrayType(T.StructType([*(T.StructField(n, T.StringType()) for n in ("name", "firstName", "lastName", "title", "email", "phone", "linkedinUrl", "source")), T.StructField("confidence", T.IntegerType())]))))


def items(payload: Column | str) -> Column:
    """The list in a payload that is an array, an object with items, or one object: an array of variants."""
    v = F.try_parse_json(payload)
    kind = F.schema_of_variant(v)
    inner = F.try_variant_get(v, "$.items", "array<variant>")
    return F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>")).when(inner.isNotNull(), inner).when(v.isNotNull(), F.array(v))
