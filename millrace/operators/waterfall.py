"""The whole cascade on snapshots: each source runs for the records it may run for, and what it finds is known to the next.

The state of a run is one row per record, a table bucketed by id that each source's step writes anew, so that the plan does not
grow with the number of sources and the state is never shuffled. Each source is a function from the rows it runs for to result
rows. Snapshots can be stored bucketed by the key they are looked up by (``stored``): then a step shuffles the keys that the
running records ask for, and the results on their way back to the records, and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scoring import confidence
from millrace.functions.values import domain, either, filled
from millrace.operators import cascade, lookups, sources
from millrace.operators.tables import bucketed

# --- fixed values -------------------------------------------------------------------------------------------
WRITES_PROFILE = ["google_dork", "linkedin_search"]
EXISTING_CONFIDENCE = 100
# ------------------------------------------------------------------------------------------------------------
Source = Callable[[DataFrame], DataFrame]
_RESULT = "struct<source:string,email:string,phone:string,officer:string,registration:string,metadata:map<string,string>,confidence:int>"


#: For each snapshot what makes it one row a key, and the keys.
PREPARED = {
    "dns": (lookups.hosts_by_domain, ["_domain"]),
    "pages": (sources.page_of, ["_url"]),
    "registry": (lookups.companies_by_query, ["_place"]),
    "searches": (sources.results_by_query, ["_query"]),
    "profiles": (sources.profiles_by_name, ["_first", "_last", "_company"]),
    "vendor": (sources.vendor_by_url, ["_profile_url"]),
    "checks": (sources.checked, ["_email"]),
}


def stored(**snapshots: DataFrame) -> dict[str, DataFrame]:
    """Snapshots made one row a key and written bucketed by it, for any number of runs."""
    return {name: bucketed(PREPARED[name][0](df), PREPARED[name][1], dealt=True) for name, df in snapshots.items()}


def on_snapshots(dns: DataFrame, pages: DataFrame, registry: DataFrame, searches: DataFrame, profiles: DataFrame, vendor: DataFrame, checks: DataFrame, not_names: list[str] | DataFrame) -> dict[str, Source]:
    """All sources bound to their snapshots, stored or as they are, by name. ``not_names``: words that no person's name has."""

    def hosts(records: DataFrame) -> DataFrame:
        out = lookups.mail_hosts(records, dns)
        return sources.result(out, has_mx=F.col("has_mx"), metadata=F.col("metadata"))

    def companies(records: DataFrame) -> DataFrame:
        out = lookups.registry(records, registry)
        none = F.lit(None).cast("string")
        people = F.transform("people", lambda p: F.struct(p["name"].alias("name"), p["firstName"].alias("firstName"), p["lastName"].alias("lastName"), p["title"].alias("title"), none.alias("email"), none.alias("phone"), none.alias("linkedinUrl"), p["source"].alias("source"), p["confidence"].alias("confidence")))
        return sources.result(out, officer=F.col("officer"), registration=F.col("registration"), metadata=F.col("metadata"), people=people)

    return {
        "dns_intel": hosts,
        "schema_org": lambda r: sources.schema_org(r, pages),
        "deep_scrape": lambda r: sources.deep_scrape(r, pages, not_names),
        "sirene": companies,
        "google_dork": lambda r: sources.google_dork(r, searches),
        "linkedin_search": lambda r: sources.linkedin_search(r, profiles),
        "kaspr": lambda r: sources.kaspr(r, vendor),
        "email_permutation": lambda r: sources.email_permutation(r, checks),
    }


def started(records: DataFrame) -> DataFrame:
    """The state of a run before its first source: known addresses and phones, nothing else. records: id, name, website, city, email, phone, score."""
    none = F.lit(None).cast("string")
    return records.select(
        "id", "name", "website", "city", domain("website").alias("domain"), "score",
        none.alias("officer"), none.alias("first_name"), none.alias("last_name"), none.alias("registration"), none.alias("profile"), none.alias("mx_provider"), F.lit(True).alias("has_mx"),
        F.when(filled("email"), F.array(F.lower("email"))).otherwise(F.array().cast("array<string>")).alias("emails"),
        F.when(filled("phone"), F.array(F.col("phone"))).otherwise(F.array().cast("array<string>")).alias("phones"),
        F.array().cast(sources.PEOPLE).alias("people"), F.array().cast(f"array<{_RESULT}>").alias("used"), F.array().cast("array<string>").alias("tried"), F.lit(False).alias("stopped"),
    )


def may_run(name: str, max_sources: int, paid_score: int, with_vendor: bool) -> Column:
    """Whether a source runs for a record: no stop yet, few enough sources, mail hosts where it needs them; the vendor only if
    it is on, the score suffices, and a profile or a name is known."""
    on = ~F.col("stopped") & (F.size("tried") < max_sources)
    if name in cascade.NEEDS_MAIL:
        on = on & F.col("has_mx")
    if name == "kaspr":
        profile = filled("profile") | F.exists("people", lambda p: filled(p["linkedinUrl"]))
        named = filled("officer") | (filled("first_name") & filled("last_name")) | F.exists("people", lambda p: filled(p["firstName"]) & filled(p["lastName"]))
        on = on & F.lit(with_vendor) & (F.coalesce("score", F.lit(0)) >= paid_score) & (profile | named)
    return on


def accumulation(threshold: int) -> Callable[[DataFrame, DataFrame, str], DataFrame]:
    """A function from a state, the results of a source for the rows that ran (column ``run``) and its name to the next state, with the stop decided.

    The expressions are the same for all sources (the name is a column) and are built once.
    """
    source = F.col("_source")
    has = F.col("run") & F.col("r").isNotNull()
    got = lambda f: F.when(has, F.col(f"r.{f}"))
    meta = lambda k: F.when(has, F.try_element_at("r.metadata", F.lit(k)))
    people = F.when(has, cascade.joined_people(F.col("people"), F.col("r.people"), ~source.isin(WRITES_PROFILE))).otherwise(F.col("people"))
    first = F.get("people", F.lit(0))
    words = F.split(F.trim(got("officer")), r"\s+")
    lead = F.when(filled("officer"), F.struct(F.col("officer").alias("o"), F.col("first_name").alias("f"), F.col("last_name").alias("l")))
    lead = F.coalesce(lead, F.when(has & (F.size("people") > 0), F.struct(first["name"].alias("o"), first["firstName"].alias("f"), first["lastName"].alias("l"))))
    split = lambda c, old: F.when(F.size(words) >= 2, c).otherwise(old)
    alone = F.struct(got("officer").alias("o"), split(words[0], F.col("first_name")).alias("f"), split(F.array_join(F.slice(words, 2, F.size(words)), " "), F.col("last_name")).alias("l"))
    lead = F.coalesce(lead, F.when(filled(got("officer")), alone))
    score = confidence(source, got("email"), F.col("domain"), got("phone"), got("registration"), got("officer"), F.coalesce(meta("smtp_verified") == "true", F.lit(False)))
    one = F.struct(source.alias("source"), got("email").alias("email"), got("phone").alias("phone"), got("officer").alias("officer"), got("registration").alias("registration"), F.col("r.metadata").alias("metadata"), score.cast("int").alias("confidence"))
    added = lambda c, x: F.when(filled(x) & ~F.array_contains(c, F.coalesce(x, F.lit(""))), F.array_append(c, x)).otherwise(F.col(c))
    rest = {
        "officer": F.coalesce("lead.o", "officer"), "first_name": F.coalesce("lead.f", "first_name"), "last_name": F.coalesce("lead.l", "last_name"),
        "registration": either("registration", got("registration")), "profile": either("profile", meta("linkedin_url"), meta("dirigeant_linkedin")), "mx_provider": either("mx_provider", meta("mx_provider")),
        "has_mx": F.when(meta("has_mx") == "true", True).when(meta("has_mx") == "false", False).otherwise(F.col("has_mx")),
        "emails": added("emails", F.lower(got("email"))), "phones": added("phones", got("phone")),
        "used": F.when(has, F.array_append("used", one)).otherwise(F.col("used")), "tried": F.when(F.col("run"), F.array_append("tried", source)).otherwise(F.col("tried")),
    }
    stop = F.col("run") & (cascade.aggregate_confidence(F.col("used")) >= threshold) & (F.size("emails") > 0)

    def accumulated(state: DataFrame, found: DataFrame, name: str) -> DataFrame:
        r = found.select("id", F.struct(*sources.FIELDS).alias("r"))
        both = state.join(r, "id", "left").withColumn("_source", F.lit(name)).withColumn("people", people).withColumn("lead", lead)
        return both.withColumns(rest).withColumn("stopped", F.col("stopped") | stop).drop("r", "lead", "_source", "run")

    return accumulated


def run(records: DataFrame, registered: dict[str, Source], order: list[str] | None = None, threshold: int = 80, max_sources: int = 8, paid_score: int = 0, with_vendor: bool = True) -> DataFrame:
    """Per record: tried, used results, confidence, best_email, best_phone, company_email, officer_email, and all that is known.

    Unregistered sources are passed over. A record stops once its results reach the threshold and an address is known,
    also one that was known before. An empty table gives no rows; ids must be unique and not null.
    """
    names = [n for n in order or cascade.PRIORITY if n in registered]
    runs = lambda state, n, dealt: bucketed(state.withColumn("run", may_run(n, max_sources, paid_score, with_vendor)), ["id"], dealt)
    state = runs(started(records), names[0], False) if names else started(records)
    accumulated = accumulation(threshold)
    for name, then in zip(names, [*names[1:], None], strict=True):
        state = accumulated(state, registered[name](state.where("run").drop("run")), name)
        state = runs(state, then, True) if then else bucketed(state, ["id"], True)
    picked = state.withColumns({"confidence": cascade.aggregate_confidence(F.col("used")), "picked": cascade.classified(F.col("used"), F.col("first_name"), F.col("last_name")), "ranked": cascade.best_email(F.col("used"))})
    phones = F.array_sort(F.transform(F.filter("used", lambda r: filled(r["phone"])), lambda r, i: F.struct((-r["confidence"]).alias("c"), i.alias("i"), r["phone"].alias("phone"))))
    out = picked.withColumns({"company_email": F.col("picked.company"), "officer_email": F.col("picked.officer"), "best_email": F.coalesce("picked.officer", "picked.company", "ranked"), "best_phone": F.get(phones, F.lit(0))["phone"]})
    every = cascade.provenance(F.col("used"), F.col("best_email"), F.col("company_email"), F.col("officer_email"), F.col("people"), F.col("first_name"), F.col("last_name"))
    return out.withColumn("addresses", every).drop("picked", "ranked")


def short_circuits(records: DataFrame) -> DataFrame:
    """Records that need no run: with an address (confidence 100, tried "existing") or without a website (error). Rows id, tried, confidence, email, error."""
    known, bare = filled("email"), ~filled("website")
    return records.where(known | bare).select(
        "id", F.when(known, F.array(F.lit("existing"))).otherwise(F.array().cast("array<string>")).alias("tried"), F.when(known, EXISTING_CONFIDENCE).otherwise(0).alias("confidence"), F.when(known, F.col("email")).alias("email"), F.when(~known, F.lit("no website")).alias("error")
    )


def capabilities(registered: dict[str, Source], spark) -> DataFrame:
    """Every source: its name, place, whether it is registered, needs mail hosts, and is a paid vendor."""
    rows = [(n, i, n in registered, n in cascade.NEEDS_MAIL, n in cascade.VENDORS) for i, n in enumerate(cascade.PRIORITY)]
    return spark.createDataFrame(rows, "source string, priority int, registered boolean, needs_mail boolean, vendor boolean")
