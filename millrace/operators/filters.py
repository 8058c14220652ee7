"""Filters, sorting and paging of record tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.values import col, filled, missing, search_term


def like_any(c: Column | str, patterns: list[str]) -> Column:
    """Whether the text contains any pattern, whatever the case; % and _ keep their meaning."""
    return reduce(lambda a, b: a | b, (col(c).ilike(f"%{p}%") for p in patterns)) if patterns else F.lit(True)


def search(columns: list[str], term: str) -> Column:
    """A term found in any column; characters with a meaning are taken out, and no term means no filter."""
    term = search_term(term)
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False)) for c in columns)) if term else F.lit(True)


def among(c: str, values: list) -> Column:
    return F.lit(True) if not values else F.col(c) == values[0] if len(values) == 1 else F.col(c).isin(values)


def with_status(c: str, value: str | None, allowed: list[str]) -> Column:
    """Equal to an allowed value; another value is no filter."""
    return F.col(c) == value if value in allowed else F.lit(True)


def eligible(kind: str) -> Column:
    """Records for a run: pending, failed, no_email or all."""
    status = F.col("enrichment_status")
    return {"pending": status.isNull() | (status == "pending"), "failed": status.isin("failed", "skipped"), "no_email": missing("email"), "all": F.lit(True)}[kind]


def presence(c: str, wanted: bool | None) -> Column:
    return F.lit(True) if wanted is None else filled(c) if wanted else missing(c)


def clamp(value: int | None, low: int, high: int, otherwise: int) -> int:
    """A parameter brought into its range."""
    return otherwise if value is None else max(low, min(high, value))


def unknown(given: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Given keys that are not known."""
    return given.select(key).distinct().join(known.select(key), key, "left_anti")


def page(df: DataFrame, by: str, allowed: list[str], key: str, descending: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page in the order of an allowed column (else the first allowed), key last. Nulls first when descending, last when ascending."""
    c = F.col(by if by in allowed else allowed[0])
    return df.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), F.col(key).asc()).offset(offset).limit(limit)


def page_number(n: int, size: int, wanted: int) -> tuple[int, int]:
    """Pages there are (at least one), and the wanted page brought into range."""
    pages = max(1, math.ceil(n / size))
    return pages, max(1, min(wanted, pages))


def after(df: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    """The next rows by key."""
    return (df if cursor is None else df.where(F.col(key) > cursor)).orderBy(key).limit(limit)


def by_priority(df: DataFrame, c: str, order: list[str], *then: Column) -> DataFrame:
    """Rows by the place of a value in ``order``, unlisted values last, then by further columns."""
    rank = reduce(lambda out, x: F.when(F.col(c) == x[1], x[0]).otherwise(out), reversed(list(enumerate(order))), F.lit(len(order)))
    return df.orderBy(rank, *then)


def one(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; two rows at most come, so a caller can tell none, one and several."""
    return df.where(F.col(key) == value).limit(2)


def leads(df: DataFrame, city: str, segment: list[str], n: int, key: str = "id") -> DataFrame:
    """Up to n records with an address, by parts of city and category (any of the segment's), in the order of the key."""
    found = df.where(filled("email") & (like_any("city", [city]) if city else F.lit(True)) & (like_any("category", segment) if segment else F.lit(True)))
    return found.orderBy(key).limit(clamp(n, 1, 10_000, 50))


def listed_first(df: DataFrame, keys: list, key: str, otherwise: Column) -> Column:
    """The condition of a run: the listed keys, or another condition where none is listed."""
    return F.col(key).isin(keys) if keys else otherwise


def sorted_list(df: DataFrame, by: str, key: str, descending: bool) -> DataFrame:
    """Order of a list: by a column, then by key as text, both turned round when descending."""
    turn = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    return df.orderBy(turn(F.col(by)), turn(F.col(key).cast("string")))


def tier(df: DataFrame, most: int, score: str = "score", n: int | None = None) -> DataFrame:
    """Rows of a dimension up to a tier, the best scores first, and the first n of these."""
    out = df.where(F.col("tier") <= most).orderBy(F.desc(score), "name")
    return out if n is None else out.limit(n)
