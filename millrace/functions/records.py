"""Derived columns of business records: what a list shows, filters by, and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.html import EMAIL
from millrace.functions.values import col, either, filled, local_part_priority, percent

# --- fixed values -------------------------------------------------------------------------------------------
STATUSES = ["enriched", "failed", "skipped", "pending"]
LEGACY_EXCLUDED = [
    "example.com", "sentry.io", "wixpress.com", "wordpress.org",
    "wordpress.com", "gravatar.com", "schema.org", "googleapis.com",
    "googleusercontent.com", "w3.org", "facebook.com", "twitter.com",
    "instagram.com", "linkedin.com", "youtube.com", "google.com",
    "apple.com", "microsoft.com", "amazon.com",
]
MONTHS = ["janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc."]
EXPORT = ["Entreprise", "Ville", "Verticale", "Email", "Emails Dirigeants", "Dirigeants", "Dirigeants Detail", "Telephone", "Site Web", "Score", "Adresse"]
LEGACY_STARTS = ["noreply", "no-reply", "donotreply", "mailer-daemon", "postmaster", "webmaster", "hostmaster", "abuse"]
CONTACT_STARTS = ["contact", "info", "accueil"]
BLACKLIST_PREFIXES = [
    "noreply", "no-reply", "no_reply", "webmaster", "postmaster", "mailer-daemon", "root", "admin", "administrator", "support", "abuse", "spam",
    "newsletter", "unsubscribe", "example", "test", "demo", "sentry", "wordpress", "woocommerce", "protection", "privacy", "dpo", "donotreply", "bounce", "alert",
]
BLACKLIST_DOMAINS = [
    "example.com", "example.org", "test.com", "sentry.io", "wordpress.org", "w3.org", "schema.org", "googleapis.com", "google.com", "facebook.com",
    "twitter.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com", "wixpress.com", "squarespace.com", "mailchimp.com", "hubspot.com",
    "salesforce.com", "zendesk.com", "gstatic.com", "cloudflare.com", "bootstrapcdn.com", "jquery.com", "jsdelivr.net", "unpkg.com", "gravatar.com",
    "wp.com", "googleusercontent.com",
]
ASSET_ENDS = [".png", ".jpg", ".jpeg", ".svg", ".gif", ".webp", ".bmp", ".ico", ".tiff", ".css", ".js", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".map", ".pdf"]
LONGEST_PART, LONGEST_UNPARTED, ENOUGH_EMAILS, WORKDAYS, NEVER_CALL_BACK, CONVERTED = 50, 30, 3, 22, 0.75, 0.4
# ------------------------------------------------------------------------------------------------------------


# --- lists of records ---------------------------------------------------------------------------------------


def derived_status(email: Column | str, enriched_at: Column | str, status: Column | str) -> Column:
    """enriched with an address or a date, else a known status, else pending."""
    return F.when(filled(email) | filled(col(enriched_at).cast("string")), "enriched").when(col(status).isin(STATUSES), col(status)).otherwise("pending")


def listed(df: DataFrame) -> DataFrame:
    """A stored record as a list shows it: missing texts empty, missing numbers 0, the status derived, an id made where there is none."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    made = F.concat(F.lit("lead-"), text("name"), F.lit("-"), text("city"))
    return df.select(
        F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), made).alias("id"), text("name").alias("nom_entreprise"), text("category").alias("type_etablissement"), text("city").alias("ville"), text("address").alias("adresse"),
        text("phone").alias("telephone"), text("email").alias("email"), text("website").alias("site_web"), zero("rating").alias("note_google"), zero("reviews").alias("nb_avis_google"), zero("score").alias("score"),
        text("category").alias("verticale"), F.lit("nouveau").alias("statut_pipeline"), either("source", F.lit("Google Maps Scraping")).alias("source"), derived_status("email", "enriched_at", "enrichment_status").alias("enrichment_status"), zero("enrichment_attempts").alias("enrichment_attempts"),
    )


def matches(search: str = "", cities: list[str] = (), segments: list[str] = (), pipeline: str = "", has_email: bool | None = None, low: float = 0, high: float = 100, status: str = "all") -> Column:
    """The filters of a list in one condition; those left at their default filter nothing. failed takes skipped in."""
    tests = [F.lit(True)]
    if search:
        tests.append(reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(search.lower())) for c in ("nom_entreprise", "email", "ville", "type_etablissement"))))
    tests += [F.col(c).isin(list(given)) for c, given in (("ville", cities), ("verticale", segments)) if given]
    tests += [F.col("statut_pipeline") == pipeline] if pipeline else []
    tests += [filled("email") if has_email else ~filled("email")] if has_email is not None else []
    tests += [F.col("score") >= low] if low > 0 else []
    tests += [F.col("score") <= high] if high < 100 else []
    tests += [] if status == "all" else [F.col("enrichment_status").isin(*({"failed", "skipped"} if status == "failed" else {status}))]
    return reduce(lambda a, b: a & b, tests)


def selectable(email: Column | str, session_email: Column | str, session_error: Column | str, status: Column | str) -> Column:
    """Whether a record may be chosen for a run: no address, no failed try in this session or before."""
    return ~(filled(email) | filled(session_email) | filled(session_error) | F.coalesce(col(status).isin("failed", "skipped"), F.lit(False)))


def cascade_input(df: DataFrame) -> DataFrame:
    """A stored record as the cascade takes it: an empty name for none, empty texts as missing."""
    text = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return df.select("id", F.coalesce("name", F.lit("")).alias("name"), *map(text, ("website", "city", "email", "phone")), "score")


def display_email(addresses: Column | str, session_global: Column | str, stored_global: Column | str, email: Column | str, session_email: Column | str) -> Column:
    """The first company address of the provenance list, else the first of four columns that has one."""
    of_list = F.get(F.filter(col(addresses), lambda a: a["type"] == "global"), F.lit(0))["email"]
    return either(of_list, session_global, stored_global, email, session_email)


def vendor_first(addresses: Column) -> Column:
    """Addresses with those of the vendor first, then by confidence, else in order."""
    keyed = F.transform(addresses, lambda a, i: F.struct((a["source"] != "kaspr").cast("int").alias("o"), (-F.coalesce(a["confidence"], F.lit(0))).alias("c"), i.alias("i"), a.alias("a")))
    return F.transform(F.array_sort(keyed), lambda x: x["a"])


def personal_emails(session: Column | str, stored: Column | str, people: Column | str, single: Column | str) -> Column:
    """Personal addresses: the session's provenance, else the stored one (vendor first), else people with an address, else one column."""
    personal = lambda c: F.filter(F.coalesce(col(c), F.expr("array()").cast("array<struct<email:string,source:string,confidence:int,type:string>>")), lambda a: a["type"] == "dirigeant")
    mails = lambda c: F.transform(vendor_first(personal(c)), lambda a: a["email"])
    of_people = F.transform(F.filter(col(people), lambda p: filled(p["email"])), lambda p: p["email"])
    none = F.array().cast("array<string>")
    return F.when(F.size(personal(session)) > 0, mails(session)).when(F.size(personal(stored)) > 0, mails(stored)).when(F.size(of_people) > 0, of_people).when(filled(single), F.array(col(single))).otherwise(none)


def completeness(company: list[Column | str], personal: list[Column | str], error: Column | str, status: Column | str) -> Column:
    """both, email, tried or untouched, by whether any company or personal address is there."""
    any_of = lambda columns: reduce(lambda a, b: a | b, map(filled, columns))
    return F.when(any_of(company) & any_of(personal), "both").when(any_of(company), "email").when(filled(error) | col(status).isin("failed", "skipped"), "tried").otherwise("untouched")


def display_name(first: Column | str, last: Column | str, email: Column | str) -> Column:
    """First and last name as far as there are, else the local part of the address."""
    return either(F.concat_ws(" ", F.nullif(col(first), F.lit("")), F.nullif(col(last), F.lit(""))), F.split(col(email), "@")[0])


def overlaid(stored: DataFrame, session: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored rows with the session's texts where it has any."""
    new = session.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns)).dropDuplicates([key])
    return stored.join(new, key, "left").select(*(either(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns))


# --- campaigns and replies ------------------------------------------------------------------------------------


def with_rates(campaigns: DataFrame, analytics: DataFrame, counts: list[str], sent: str = "emails_sent", opened: str = "emails_read", replied: str = "replied") -> DataFrame:
    """Campaigns with their counts, 0 where none came, and open and reply rates in per cent."""
    out = campaigns.join(analytics.select("id", *counts), "id", "left").fillna(0, counts)
    return out.withColumns({"open_rate": percent(opened, sent), "reply_rate": percent(replied, sent)})


def totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of sums, nulls and an empty table as 0."""
    return df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns))


def latest_messages(replies: DataFrame, messages: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` replied leads (email) in the order of ``seq``, each with the text of its latest message, cut; empty for none."""
    from millrace.functions.values import snippet

    first = replies.where("status = 'replied'").orderBy("seq").limit(most)
    last = messages.groupBy("email").agg(F.max_by(F.struct("reply_text", "body"), "at").alias("m")).select("email", snippet(either("m.reply_text", "m.body")).alias("snippet"))
    return first.join(last, "email", "left").fillna("", ["snippet"])


def thread(messages: DataFrame) -> DataFrame:
    """Messages of threads in time: direction, subject and body with their fall-backs, tags taken out. thread: its key."""
    text = lambda *c: F.trim(F.regexp_replace(F.coalesce(either(*c), F.lit("")), "<[^>]*>", ""))
    incoming = F.coalesce(F.col("is_reply"), F.lit(False)) | filled("reply_text") | filled("reply_html")
    none = F.lit("(sans objet)")
    return messages.select(
        "thread", "id", F.when(incoming, "received").otherwise("sent").alias("type"), F.when(incoming, either("reply_subject", "subject", none)).otherwise(either("subject", none)).alias("subject"),
        F.when(incoming, text("reply_text", "reply_html")).otherwise(text("body")).alias("body"), F.try_to_timestamp("timestamp").alias("at"),
    ).orderBy("thread", "at", "id")


def trailing_year(today: Column | str) -> Column:
    """Struct start_date, end_date of the twelve months up to a day."""
    day = F.to_date(col(today))
    return F.struct(F.add_months(day, -12).alias("start_date"), day.alias("end_date"))


def short_date(at: Column | str) -> Column:
    """Day and short month in French."""
    return F.concat_ws(" ", F.dayofmonth(col(at)).cast("string"), F.get(F.array(*map(F.lit, MONTHS)), F.month(col(at)) - 1))


def time_of_day(at: Column | str, now: Column | str) -> Column:
    """Hours and minutes of a time today, else the short date before them; empty for none."""
    clock = F.date_format(col(at), "HH:mm")
    return F.coalesce(F.when(F.to_date(col(at)) == F.to_date(col(now)), clock).otherwise(F.concat_ws(", ", short_date(at), clock)), F.lit(""))


def export_columns(people: Column | str, officer: Column | str, officer_email: Column | str) -> dict[str, Column]:
    """The texts of an export about people: their addresses, names, and both (name <address>), from a list or else a single person's columns."""
    some = F.filter(F.coalesce(col(people), F.array().cast("array<struct<name:string,email:string>>")), lambda p: filled(p["name"]) | filled(p["email"]))
    single = F.when(filled(officer) | filled(officer_email), F.array(F.struct(F.coalesce(col(officer), F.lit("")).alias("name"), F.coalesce(col(officer_email), F.lit("")).alias("email"))))
    own = F.when(F.size(some) > 0, F.transform(some, lambda p: F.struct(F.coalesce(p["name"], F.lit("")).alias("name"), F.coalesce(p["email"], F.lit("")).alias("email")))).otherwise(single)
    of = lambda f: F.coalesce(F.array_join(F.filter(F.transform(own, lambda p: p[f]), filled), "; "), F.lit(""))
    whole = F.transform(own, lambda p: F.when(filled(p["name"]) & filled(p["email"]), F.concat(p["name"], F.lit(" <"), p["email"], F.lit(">"))).otherwise(F.concat(p["name"], p["email"])))
    return {"emails_dirigeants": either(of("email"), officer_email, F.lit("")), "dirigeants": either(of("name"), officer, F.lit("")), "dirigeants_detail": F.coalesce(F.array_join(whole, "; "), F.lit(""))}


def time_ago(at: Column | str, now: Column | str) -> Column:
    """How long ago in French: now, minutes, hours, days, and from a week on the day and the short month; empty for none."""
    minutes = F.floor((F.unix_timestamp(col(now)) - F.unix_timestamp(col(at))) / 60)
    ago = lambda n, unit: F.concat(F.lit("il y a "), F.floor(n).cast("string"), F.lit(unit))
    out = F.when(minutes < 1, "a l'instant").when(minutes < 60, ago(minutes, "min")).when(minutes < 24 * 60, ago(minutes / 60, "h")).when(minutes < 7 * 24 * 60, ago(minutes / 1440, "j"))
    return F.coalesce(out.otherwise(short_date(at)), F.lit(""))


def local_time(at: Column | str, zone: str = "Europe/Paris", form: str = "dd/MM/yyyy HH:mm:ss") -> Column:
    """A UTC time written in a zone."""
    return F.date_format(F.from_utc_timestamp(col(at), zone), form)


def clock(seconds: Column | str) -> Column:
    """Seconds as mm:ss."""
    return F.format_string("%02d:%02d", F.floor(col(seconds) / 60), F.floor(col(seconds)) % 60)


def lost_calls(calls: Column | str, missed: Column | str, value: Column | str, plan: Column | str) -> Column:
    """Struct missed_month, lost_clients, lost_month, lost_year, won_clients, gain, roi of a phone's missed calls a day (a share)."""
    month = col(calls) * col(missed) * WORKDAYS
    lost = month * NEVER_CALL_BACK
    gain = month * CONVERTED * col(value)
    return F.struct(month.alias("missed_month"), lost.alias("lost_clients"), (lost * col(value)).alias("lost_month"), (lost * col(value) * 12).alias("lost_year"), (month * CONVERTED).alias("won_clients"), gain.alias("gain"), F.when(col(plan) > 0, gain / col(plan)).alias("roi"))


# --- other page extractors --------------------------------------------------------------------------------------


def legacy_email(page: Column | str, host: Column | str) -> Column:
    """One address of a page: of the site's host, else a contact mailbox, else the first; hosts are excluded by part."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(col(page), F.lit(EMAIL), 0), F.lower))
    part = lambda e: F.split(e, "@")[1]
    top = lambda e: F.length(F.substring_index(part(e), ".", -1))
    starts = lambda e, words: reduce(lambda a, b: a | b, (F.startswith(e, F.lit(w)) for w in words))
    bad = lambda e: reduce(lambda a, b: a | b, (F.contains(part(e), F.lit(d)) for d in LEGACY_EXCLUDED)) | starts(e, LEGACY_STARTS) | F.contains(e, F.lit("..")) | F.startswith(e, F.lit(".")) | ~top(e).between(2, 10)
    good = F.filter(found, lambda e: ~bad(e))
    first = lambda test: F.get(F.filter(good, test), F.lit(0))
    return F.coalesce(first(lambda e: F.contains(e, F.replace(F.lower(col(host)), F.lit("www."), F.lit("")))), first(lambda e: starts(e, CONTACT_STARTS)), F.get(good, F.lit(0)))


def crawled_emails(page: Column | str) -> Column:
    """Distinct addresses of a page and its mailto links that no black list, length or file name excludes, the most useful first.

    Of equal use they go by name, as a set has no order.
    """
    c = F.lower(col(page))
    links = F.transform(F.regexp_extract_all(c, F.lit(r"""<a\b[^>]*href\s*=\s*["']mailto:([^"'?]*)"""), 1), F.trim)
    found = F.array_distinct(F.concat(F.regexp_extract_all(c, F.lit(EMAIL), 0), F.filter(links, lambda e: F.contains(e, F.lit("@")))))
    local, host = lambda e: F.regexp_extract(e, "^(.*)@", 1), lambda e: F.substring_index(e, "@", -1)
    starts = lambda e: reduce(lambda a, b: a | b, (F.startswith(e, F.lit(p)) for p in BLACKLIST_PREFIXES))
    ends = lambda e: reduce(lambda a, b: a | b, (F.endswith(e, F.lit(x)) for x in ASSET_ENDS))
    long = lambda e: (F.length(local(e)) > LONGEST_PART) | (F.length(host(e)) > LONGEST_PART) | ((F.length(local(e)) > LONGEST_UNPARTED) & ~local(e).rlike("[._ -]"))
    good = F.filter(found, lambda e: ~(host(e).isin(BLACKLIST_DOMAINS) | starts(local(e)) | long(e) | F.contains(e, F.lit("..")) | ends(e)))
    return F.transform(F.array_sort(F.transform(good, lambda e: F.struct(local_part_priority(e).alias("p"), e.alias("e")))), lambda x: x["e"])


def crawl(sites: DataFrame, pages: DataFrame, paths: list[str], most: int) -> DataFrame:
    """Addresses of sites (id, website) by their pages (url, html) in the order of ``paths``: at most ``most`` pages are read, and
    reading ends at three distinct addresses. Rows id, emails (the most useful first) and pages_read."""
    base = F.regexp_replace("website", "(?i)^(https?://[^/]*).*$", "$1")
    asked = sites.select("id", base.alias("_base")).select("id", F.posexplode(F.array(*map(F.lit, paths))).alias("at", "_path"), "_base").withColumn("url", F.concat("_base", "_path"))
    known = pages.where("html is not null").groupBy("url").agg(F.max("html").alias("html"))
    read = asked.join(known, "url").select("id", F.struct("at", crawled_emails("html").alias("emails")).alias("p"))
    per = read.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("p")), 1, most).alias("p"))  # as many as there are paths
    start = F.struct(F.array().cast("array<string>").alias("emails"), F.lit(0).alias("n"))
    step = lambda s, p: F.when(F.size(s["emails"]) >= ENOUGH_EMAILS, s).otherwise(F.struct(F.array_union(s["emails"], p["emails"]).alias("emails"), (s["n"] + 1).alias("n")))
    out = sites.select("id").join(per.withColumn("s", F.aggregate("p", start, step)), "id", "left")
    ranked = F.array_sort(F.transform("s.emails", lambda e: F.struct(local_part_priority(e).alias("p"), e.alias("e"))))
    return out.select("id", F.coalesce(F.transform(ranked, lambda x: x["e"]), F.array().cast("array<string>")).alias("emails"), F.coalesce("s.n", F.lit(0)).alias("pages_read"))


def crawled_in_phases(sites: DataFrame, pages: DataFrame, first: list[str], second: list[str], most: tuple[int, int] = (6, 8)) -> DataFrame:
    """Rows id, emails, best, phase: phase 1 reads the usual pages, phase 2 more pages of sites without an address, and guesses
    contact@ of the domain where these have none either. Sites without a website have phase 0."""
    from millrace.functions.values import mail_domain

    none = F.array().cast("array<string>")
    has = sites.where(filled("website"))
    one = crawl(has, pages, first, most[0])
    two = crawl(has.join(one.where(F.size("emails") == 0).select("id"), "id", "left_semi"), pages, second, most[1]).select("id", F.col("emails").alias("more"))
    out = sites.join(one, "id", "left").join(two, "id", "left")
    guess = F.when(mail_domain("website").isNotNull(), F.array(F.concat(F.lit("contact@"), mail_domain("website"))))
    found = F.when(F.size("emails") > 0, F.struct(F.col("emails").alias("e"), F.lit(1).alias("phase"))).when(F.size("more") > 0, F.struct(F.col("more").alias("e"), F.lit(2).alias("phase"))).when(filled("website") & guess.isNotNull(), F.struct(guess.alias("e"), F.lit(2).alias("phase"))).otherwise(F.struct(none.alias("e"), F.lit(0).alias("phase")))
    return out.withColumn("f", found).select("id", F.col("f.e").alias("emails"), F.get("f.e", F.lit(0)).alias("best"), F.col("f.phase").alias("phase"))


def guessed_or_read(records: DataFrame, pages: DataFrame, technique: str) -> DataFrame:
    """One address for each record (id, website) by ``website_scraping`` of its home page or ``pattern_guess``: id, email, source, status, error."""
    from millrace.functions.values import domain

    url = F.when(F.startswith(F.trim("website"), F.lit("http")), F.trim("website")).otherwise(F.concat(F.lit("https://"), F.trim("website")))
    both = records.select("id", "website", url.alias("url")).join(pages.groupBy("url").agg(F.max("html").alias("html")), "url", "left")
    email = legacy_email("html", domain("url")) if technique == "website_scraping" else F.concat(F.lit("contact@"), domain("url"))
    out = both.select("id", F.when(filled("website"), email).alias("email"), F.lit(technique).alias("source"), filled("website").alias("has"))
    return out.select("id", "email", "source", F.when(F.col("email").isNotNull(), "enriched").otherwise("failed").alias("status"), F.when(~F.col("has"), "No website available for scraping").when(F.col("email").isNull(), "No email found").alias("error"))
