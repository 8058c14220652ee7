"""The enrichment cascade: prioritised sources, early stop, merging of people, choice of addresses.

Results of all sources for a record are rows (record, priority, source, email, phone, ...) from keyed snapshots. A record's
results are gathered in the order of priority (there are at most a few sources) and folded by higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scoring import SEVERAL_SOURCES, confidence
from millrace.functions.values import either, filled, folded, is_company_mailbox, is_generic, is_personal_match

# --- fixed values -------------------------------------------------------------------------------------------
PRIORITY = ["dns_intel", "schema_org", "deep_scrape", "sirene", "google_dork", "linkedin_search", "kaspr", "email_permutation"]
NEEDS_MAIL = ["email_permutation", "google_dork"]
VENDORS = ["kaspr", "email_permutation"]
# ------------------------------------------------------------------------------------------------------------


def aggregate_confidence(results: Column) -> Column:
    """The highest confidence, 20 more if two results have the same address, at most 100."""
    mails = F.filter(F.transform(results, lambda r: F.lower(r["email"])), lambda e: filled(e))
    several = F.size(mails) > F.size(F.array_distinct(mails))
    return F.least(F.lit(100), F.coalesce(F.array_max(F.transform(results, lambda r: r["confidence"])), F.lit(0)) + F.when(several, SEVERAL_SOURCES).otherwise(0))


def enrich(records: DataFrame, results: DataFrame, threshold: int = 80, max_sources: int = 8, paid_score: int = 0, with_vendor: bool = True) -> DataFrame:
    """Per record: tried (sources in order), used results, confidence, best_email, best_phone, stop.

    records: id, domain, email (known before or null), score, first_name, last_name. results: id, priority, source, email,
    phone, registration, officer, verified, has_mx. Sources run in the order of priority. One is passed over if too many ran, if it needs mail hosts
    and the record has none, or if it is a paid vendor that is off or above the record's score. After each, the run stops
    once the aggregate confidence reaches the threshold and an address is known. Of several results of one source the first
    by priority counts. Records without results stay, with nulls.
    """
    known = results.join(records.select("id", "domain"), "id")
    scored = known.withColumn("confidence", confidence("source", "email", "domain", "phone", "registration", "officer", F.col("verified")))
    row = F.struct("priority", "source", "email", "phone", "registration", "officer", "has_mx", "confidence")
    # a source runs once for a record: what is gathered is bounded by the number of sources, whatever the results
    once = scored.groupBy("id", "source").agg(F.min_by(row, row).alias("_row"))
    gathered = once.groupBy("id").agg(F.array_sort(F.collect_list("_row")).alias("all"))
    both = records.join(gathered, "id", "left").withColumn("all", F.coalesce("all", F.expr("filter(array(), x -> false)").cast(gathered.schema["all"].dataType)))
    empty = F.struct(F.slice("all", 1, 0).alias("used"), F.lit(True).alias("mx"), F.lit(False).alias("stop"))

    def step(state: Column, r: Column) -> Column:
        passed = state["stop"] | (F.size(state["used"]) >= max_sources) | (r["source"].isin(NEEDS_MAIL) & ~state["mx"])
        passed = passed | ((r["source"] == "kaspr") & (F.lit(not with_vendor) | (F.coalesce(F.col("score"), F.lit(0)) < paid_score)))
        used = F.when(passed, state["used"]).otherwise(F.array_append(state["used"], r))
        mx = F.when(passed, state["mx"]).otherwise(F.coalesce(r["has_mx"], state["mx"]))
        mail = filled("email") | F.exists(used, lambda x: filled(x["email"]))
        stop = state["stop"] | (~passed & (aggregate_confidence(used) >= threshold) & mail)
        return F.struct(used.alias("used"), mx.alias("mx"), stop.alias("stop"))

    out = both.withColumn("state", F.aggregate("all", empty, step)).drop("all")
    out = out.withColumns({"used": F.col("state.used"), "stopped": F.col("state.stop")}).drop("state")
    out = out.withColumns({"tried": F.transform("used", lambda r: r["source"]), "confidence": aggregate_confidence(F.col("used"))})
    picked = classified(F.col("used"), F.col("first_name"), F.col("last_name"))
    out = out.withColumn("picked", picked)
    phones = F.filter("used", lambda r: filled(r["phone"]))
    best_phone = F.array_sort(F.transform(phones, lambda r, i: F.struct((-r["confidence"]).alias("c"), i.alias("i"), r["phone"].alias("phone"))))
    return out.withColumns({"best_email": F.coalesce("picked.officer", "picked.company", best_email(F.col("used"))), "best_phone": F.get(best_phone, F.lit(0))["phone"]})


def early_stops(results: DataFrame, order: list[str], threshold: int = 80) -> DataFrame:
    """Per id: tried (how many results ran), confidence and stopped, for any number of results, by window functions only.

    results: id, the columns of ``order`` (they tell the results of an id apart), email and confidence. Results run in
    order until the aggregate confidence reaches the threshold and an address is known, as in ``enrich`` for records
    without a known address; none is passed over. Null ids are an id of their own.
    """
    upto = Window.partitionBy("id").orderBy(*order)
    mail = F.lower("email")
    rows = results.withColumn("_again", filled(mail) & (F.row_number().over(Window.partitionBy("id", mail).orderBy(*order)) > 1))
    several = F.when(F.max("_again").over(upto), SEVERAL_SOURCES).otherwise(0)
    rows = rows.withColumn("_sum", F.least(F.lit(100), F.coalesce(F.max("confidence").over(upto), F.lit(0)) + several))
    rows = rows.withColumn("_stop", F.max(filled("email")).over(upto) & (F.col("_sum") >= threshold))
    ran = rows.withColumn("_over", F.coalesce(F.lag("_stop").over(upto), F.lit(False))).where("not _over")
    return ran.groupBy("id").agg(F.count("*").alias("tried"), F.max("_sum").alias("confidence"), F.max("_stop").alias("stopped"))


def best_email(results: Column) -> Column:
    """The address that most results have, personal before generic, then by confidence, then the earliest."""
    mails = F.filter(results, lambda r: filled(r["email"]))
    times = lambda e: F.size(F.filter(mails, lambda r: F.lower(r["email"]) == e))
    keyed = F.transform(mails, lambda r, i: F.struct((-times(F.lower(r["email"]))).alias("t"), is_generic(r["email"]).cast("int").alias("g"), (-r["confidence"]).alias("c"), i.alias("i"), F.lower(r["email"]).alias("e")))
    return F.get(F.array_sort(keyed), F.lit(0))["e"]


def classified(results: Column, first: Column, last: Column) -> Column:
    """Struct company, officer: the last company mailbox (or else the first other address), and the most confident personal one."""
    start = F.struct(F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("officer"), F.lit(-1).alias("c"))

    def step(s: Column, r: Column) -> Column:
        e = F.lower(r["email"])
        generic = is_company_mailbox(e)
        personal = ~generic & (F.coalesce(is_personal_match(e, first, last), F.lit(False)) | r["source"].isin(VENDORS))
        better = personal & (r["confidence"] > s["c"])
        company = F.when(generic, e).when(~personal & s["company"].isNull(), e).otherwise(s["company"])
        new = F.struct(company.alias("company"), F.when(better, e).otherwise(s["officer"]).alias("officer"), F.when(better, r["confidence"]).otherwise(s["c"]).alias("c"))
        return F.when(filled(e), new).otherwise(s)

    return F.aggregate(results, start, step)


def merged_people(people: Column) -> Column:
    """People (name, email, phone, linkedin, source, confidence) merged by folded name across runs, in order.

    A later text replaces an earlier one unless it is missing, confidence is the highest, the source is the later one.
    People without a name are left out.
    """
    named = F.filter(people, lambda p: filled(F.trim(p["name"])))
    key = lambda p: folded(F.trim(p["name"]))
    fields = ("name", "email", "phone", "linkedin", "source")

    def one(k: Column) -> Column:
        own = F.filter(named, lambda p: key(p) == k)
        latest = lambda f: F.get(F.reverse(F.filter(F.transform(own, lambda p: p[f]), lambda x: filled(x))), F.lit(0)).alias(f)
        return F.struct(*map(latest, fields), F.array_max(F.transform(own, lambda p: p["confidence"])).alias("confidence"))

    return F.transform(F.array_distinct(F.transform(named, key)), one)


def joined_people(known: Column, found: Column, profile_moves_source: Column | bool = True) -> Column:
    """``known`` people with those ``found`` by a source in a run: merged by folded name, or put at the end.

    Texts found replace missing or other ones, confidence is the highest. The source changes with an address, and with a
    profile that was not known unless the source that found it writes it down beforehand (``profile_moves_source``).
    """

    def both(old: Column, new: Column) -> Column:
        text = lambda f: either(new[f], old[f]).alias(f)
        profile = filled(new["linkedinUrl"]) & ~filled(old["linkedinUrl"]) & profile_moves_source
        source = F.when(filled(new["email"]) | profile, new["source"]).otherwise(old["source"]).alias("source")
        most = F.greatest(F.coalesce(new["confidence"], F.lit(0)), F.coalesce(old["confidence"], F.lit(0))).alias("confidence")
        return F.struct(*(text(f) for f in ("name", "firstName", "lastName", "title", "email", "phone", "linkedinUrl")), source, most)

    def add(people: Column, new: Column) -> Column:
        same = lambda old: folded(old["name"]) == folded(new["name"])
        return F.when(F.exists(people, same), F.transform(people, lambda old: F.when(same(old), both(old, new)).otherwise(old))).otherwise(F.array_append(people, new))

    return F.aggregate(F.coalesce(found, F.slice(known, 1, 0)), known, add)


def person_of(email: Column, people: Column) -> Column:
    """The name of the first person with this address, whatever the case."""
    return F.get(F.filter(people, lambda p: F.lower(p["email"]) == F.lower(email)), F.lit(0))["name"]


def provenance(results: Column, best: Column, company: Column, officer: Column, people: Column | None = None, first: Column | None = None, last: Column | None = None) -> Column:
    """Addresses with their most confident result or person, type and whether they are the best.

    Results come first, people's addresses replace them when more confident and then are an officer's. Order: the best, then
    officer, company, unknown, then by confidence.
    """
    mails = F.transform(F.filter(results, lambda r: filled(r["email"])), lambda r: F.struct(F.lower(r["email"]).alias("e"), r["source"].alias("source"), r["confidence"].alias("c"), F.lit(False).alias("person")))
    if people is not None:
        mails = F.concat(mails, F.transform(F.filter(people, lambda p: filled(p["email"])), lambda p: F.struct(F.lower(p["email"]).alias("e"), p["source"].alias("source"), p["confidence"].alias("c"), F.lit(True).alias("person"))))
    match = lambda e: F.coalesce(is_personal_match(e, first, last), F.lit(False)) if first is not None and last is not None else F.lit(False)

    def one(e: Column, i: Column) -> Column:
        own = F.array_sort(F.transform(F.filter(mails, lambda r: r["e"] == e), lambda r, j: F.struct((-r["c"]).alias("c"), j.alias("j"), r["source"].alias("source"), r["person"].alias("person"))))
        top = F.get(own, F.lit(0))
        kind = F.when(top["person"] | (e == officer), "dirigeant").when((e == company) | is_company_mailbox(e), "global").when(top["source"].isin(VENDORS) | match(e), "dirigeant").otherwise("unknown")
        rank = F.when(kind == "dirigeant", 0).when(kind == "global", 1).otherwise(2)
        is_best = F.coalesce(e == best, F.lit(False))
        return F.struct((~is_best).alias("o1"), rank.alias("o2"), top["c"].alias("o3"), i.alias("o4"), e.alias("email"), top["source"].alias("source"), (-top["c"]).alias("confidence"), kind.alias("type"), is_best.alias("isBest"))

    each = F.array_distinct(F.transform(mails, lambda r: r["e"]))
    return F.transform(F.array_sort(F.transform(each, one)), lambda x: F.struct(x["email"], x["source"], x["confidence"], x["type"], x["isBest"]))


def persisted(stored: DataFrame, found: DataFrame, always: bool = False) -> DataFrame:
    """Stored records with what a run found: status, attempts, sources, confidence, and texts kept where nothing new came.

    found: id, best_email, best_phone, registration, officer, tried, confidence, one row an id. A record for which nothing
    was found is failed, or enriched if it has people. ``always`` writes sources whatever was found, and confidence 0 for nothing,
    as runs of a batch and of a single record do, which count no attempts; runs of a stream leave both alone then.
    """
    f = found.select("id", *(F.col(c).alias(f"_{c}") for c in ("best_email", "best_phone", "registration", "officer", "tried", "confidence")), F.lit(True).alias("_ran"))
    any_find = filled("_best_email") | filled("_best_phone") | filled("_registration") | filled("_officer")
    written = F.coalesce(F.col("_ran"), F.lit(False)) if always else any_find
    out = stored.join(f, "id", "left")
    new = {
        "enrichment_status": F.when(F.col("_ran"), F.when(any_find | (F.size(F.coalesce("decision_makers", F.array())) > 0), "enriched").otherwise("failed")).otherwise(F.col("enrichment_status")),
        "enrichment_attempts": F.coalesce("enrichment_attempts", F.lit(0)) + F.when(F.col("_ran") & ~F.lit(always), 1).otherwise(0),
        "enrichment_source": F.when(written, F.array_join("_tried", ",")).otherwise(F.col("enrichment_source")),
        "enrichment_confidence": F.when(any_find, F.col("_confidence")).when(written, 0).otherwise(F.col("enrichment_confidence")),
        "email": either("_best_email", "email"),
        "phone": either("_best_phone", "phone"),
        "siret": either("_registration", "siret"),
        "dirigeant": either("_officer", "dirigeant"),
    }
    return out.withColumns({k: v for k, v in new.items() if k in stored.columns}).select(*stored.columns)
