"""Additive scores, confidence, and small classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.values import col, either, filled, is_generic

# --- fixed values -------------------------------------------------------------------------------------------
BASE_CONFIDENCE = {"schema_org": 85, "deep_scrape": 65, "sirene": 90, "email_permutation": 90, "google_dork": 55, "kaspr": 88, "linkedin_search": 40, "dns_intel": 30}
SAME_DOMAIN, GENERIC, VERIFIED, EACH_SIGNAL, UNKNOWN_SOURCE, SEVERAL_SOURCES = 15, -10, 10, 5, 50, 20
# ------------------------------------------------------------------------------------------------------------


def _points(test: Column, points: int) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), points).otherwise(0)


def place_score(website: Column | str, phone: Column | str, rating: Column | str, reviews: Column | str, address: Column | str) -> Column:
    """30, +20 website, +15 phone, +15 or 8 for a rating of 4 or 3, +10 or 5 for 50 or 10 reviews, +10 address; at most 100."""
    total = F.lit(30) + _points(filled(website), 20) + _points(filled(phone), 15) + _points(filled(address), 10)
    total = total + F.when(col(rating) >= 4, 15).when(col(rating) >= 3, 8).otherwise(0) + F.when(col(reviews) >= 50, 10).when(col(reviews) >= 10, 5).otherwise(0)
    return F.least(total, F.lit(100))


def record_score(phone: Column | str, website: Column | str, rating: Column | str, reviews: Column | str, email: Column | str) -> Column:
    """50, +15 phone, +10 website, +10 for a rating of 4, +5 or 3 for 50 or 10 reviews, +10 e-mail; at most 100."""
    total = F.lit(50) + _points(filled(phone), 15) + _points(filled(website), 10) + _points(filled(email), 10) + _points(col(rating) >= 4, 10)
    return F.least(total + F.when(col(reviews) >= 50, 5).when(col(reviews) >= 10, 3).otherwise(0), F.lit(100))


def segment_score(calls: Column | str, missed: Column | str, buy: Column | str, market: Column | str, cycle: Column | str) -> Column:
    return col(calls) * 2 + col(missed) * 2.5 + col(buy) * 2 + col(market) * 1.5 + col(cycle) * 2


def confidence(source: Column | str, email: Column | str, host: Column | str, phone: Column | str, registration: Column | str, officer: Column | str, verified: Column | None = None) -> Column:
    """0 to 100: the source's base, and points for the address and for other finds. An empty result keeps its base."""
    base = F.lit(UNKNOWN_SOURCE)
    for name, points in BASE_CONFIDENCE.items():
        base = F.when(col(source) == name, points).otherwise(base)
    mail = F.lower(col(email))
    of_site = filled(host) & F.contains(F.coalesce(F.split(mail, "@")[1], F.lit("")), F.regexp_replace(col(host), r"^www\.", ""))
    by_mail = _points(of_site, SAME_DOMAIN) + _points(is_generic(mail), GENERIC) + _points(verified if verified is not None else F.lit(False), VERIFIED)
    total = base + F.when(filled(email), by_mail).otherwise(0) + sum((_points(filled(c), EACH_SIGNAL) for c in (phone, registration, officer)), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def activity(reply: Column | str, click: Column | str, opened: Column | str) -> Column:
    """replied, clicked, opened or sent, by the timestamps there are."""
    return F.when(filled(reply), "replied").when(filled(click), "clicked").when(filled(opened), "opened").otherwise("sent")


def last_activity(*columns: Column | str) -> Column:
    return F.coalesce(either(*columns), F.lit(""))


def verification(a_valid: Column, a_disposable: Column, b_valid: Column, b_disposable: Column, well_formed: Column) -> Column:
    """Struct verified (both services, not disposable), valid (either or well formed), disposable (either)."""
    no = F.lit(False)
    a, b, thrown = F.coalesce(a_valid, no), F.coalesce(b_valid, no), F.coalesce(a_disposable, no) | F.coalesce(b_disposable, no)
    return F.struct((a & b & ~thrown).alias("verified"), (a | b | well_formed).alias("valid"), thrown.alias("disposable"))
