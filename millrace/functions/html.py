"""Column functions that take contact data out of web pages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.values import col, phone_digits

# --- fixed values -------------------------------------------------------------------------------------------
EXCLUDED_DOMAINS = [
    "example.com", "sentry.io", "wixpress.com", "wordpress.org",
    "wordpress.com", "gravatar.com", "schema.org", "googleapis.com",
    "googleusercontent.com", "w3.org", "facebook.com", "twitter.com",
    "instagram.com", "linkedin.com", "youtube.com", "google.com",
    "apple.com", "microsoft.com", "amazon.com", "cloudflare.com",
    "gstatic.com", "jquery.com", "bootstrapcdn.com", "unpkg.com",
    "jsdelivr.net", "cdnjs.cloudflare.com",
]
EXCLUDED_STARTS = ["noreply", "no-reply", "donotreply", "mailer-daemon", "postmaster", "webmaster", "hostmaster", "abuse", "support@wordpress", "support@wix"]
# Ways to hide an address and what they stand for, replaced in this order.
HIDDEN = [(r"\s*\[at\]\s*", "@"), (r"\s*\(at\)\s*", "@"), (r"\s*\{at\}\s*", "@"), (r"\s*\[dot\]\s*", "."), (r"\s*\(dot\)\s*", "."), (r"\s*\{dot\}\s*", "."), (r"\s*\[point\]\s*", "."), (r"\s*\(point\)\s*", "."), (r"\s+arobase\s+", "@"), (r"\s+at\s+", "@")]
FRENCH_PHONE = r"(?:(?:\+33|0033|0)\s?[1-9])(?:[\s.\-]?\d{2}){4}"
REGISTRATION = r"(?:siret|SIRET|Siret)\s*[:.]?\s*(\d{3}\s?\d{3}\s?\d{3}\s?\d{5})"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
MAILTO = r"(?i)mailto:([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"
META = r"""(?i)<meta[^>]*content\s*=\s*["']([^"']*@[^"']*\.[a-zA-Z]{2,})["'][^>]*>"""
LINK = r"""(?i)<link[^>]*href\s*=\s*["']mailto:([^"']+)["'][^>]*>"""
TEL = r"""(?i)href\s*=\s*["']tel:([^"']+)["']"""
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
ESCAPES = {r"\\u003e": ">", r"\\u003c": "<", r"\\u0026": "&"}
BUSINESS_TYPES = [
    "LocalBusiness", "Organization", "MedicalBusiness", "Dentist", "LegalService", "ProfessionalService", "HealthAndBeautyBusiness", "Store",
    "Restaurant", "FinancialService", "InsuranceAgency", "RealEstateAgent", "AutoRepair", "HomeAndConstructionBusiness", "SportsActivityLocation",
    "EntertainmentBusiness", "FoodEstablishment", "LodgingBusiness", "MedicalClinic", "Physician", "VeterinaryCare", "Pharmacy", "Optician",
    "Attorney", "AccountingService", "AutomotiveBusiness", "ChildCare", "DryCleaningOrLaundry", "EducationalOrganization", "GovernmentOffice",
    "Library", "TravelAgency",
]
PUBLISHED_EXCLUDED = ["example.com", "sentry.io", "wixpress.com", "wordpress.org", "schema.org", "googleapis.com", "w3.org"]
# ------------------------------------------------------------------------------------------------------------
#: What a text must have for a hidden address to be in it: a bracketed part, or a spelled @ before a host with a dot.
BRACKETED, SPELLED = r"(?i)[\[({](?:at|dot|point)[\])}]", r"(?i)\s(?:arobase|at)\s+[a-z0-9.\-]*\.[a-z]{2}"


def _once(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def without_tags(c: Column | str, scripts: bool = True) -> Column:
    """Text between tags, one space for each; the content of script and style goes too unless ``scripts`` is False."""
    body = F.regexp_replace(col(c), r"(?is)<(script|style)\b.*?</\1\s*>", " ") if scripts else col(c)
    return F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), r"\s+", " "))


def decoded(c: Column | str) -> Column:
    """Numeric entities (decimal ones first), a few named ones and a few escapes as characters.

    A text with numeric entities is split at them, in the JVM; numbers count modulo 2 ** 16 as a browser's char codes do, halves
    of pairs become the replacement character. Numbers of more than 18 digits are taken by their last 15.
    """
    text = col(c)

    def replaced(text: Column, pattern: str, digits: Callable[[Column], Column]) -> Column:
        parts = F.split(text, f"&#(?={pattern};)", -1)
        code = lambda p: digits(F.substring_index(p, ";", 1)) % 65536
        char = lambda n: F.when(n.between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE"))
        rest = lambda p: F.substring(p, F.instr(p, ";") + 1, F.length(p))
        whole = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(char(code(p)), rest(p))))
        return F.when(text.rlike(f"&#{pattern};"), F.array_join(whole, "")).otherwise(text)

    decimal = lambda t: replaced(t, "[0-9]+", lambda d: F.substring(d, -15, 15).cast("long"))
    hexadecimal = lambda t: replaced(t, "x[0-9a-fA-F]+", lambda d: F.conv(F.substring(F.substring(d, 2, 1 << 20), -4, 4), 16, 10).cast("long"))
    numbered = lambda t: F.when(F.contains(t, F.lit("&#")), _once(decimal(t), hexadecimal)).otherwise(t)
    named = lambda t: F.when(F.contains(t, F.lit("&")), reduce(lambda out, x: F.replace(out, F.lit(x[0]), F.lit(x[1])), ENTITIES.items(), t)).otherwise(t)
    escaped = lambda t: F.when(F.contains(t, F.lit("\\u")) | F.contains(t, F.lit("\\U")), reduce(lambda out, x: F.regexp_replace(out, f"(?i){x[0]}", x[1]), ESCAPES.items(), t)).otherwise(t)
    return _once(_once(numbered(text), named), escaped)


def revealed(c: Column | str) -> Column:
    """Hidden addresses written out."""
    return reduce(lambda out, x: F.regexp_replace(out, f"(?i){x[0]}", x[1]), HIDDEN, col(c))


def cleaned_email(c: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(c, r"^[<>;\s]+", ""), r"[<>;\s]+$", "")))


def is_contact_email(c: Column) -> Column:
    """Not of an excluded domain, mailbox or file name, and with a top-level domain of 2 to 10 characters."""
    host = F.split(c, "@")[1]
    top = F.length(F.substring_index(host, ".", -1))
    started = reduce(lambda a, b: a | b, (F.startswith(c, F.lit(p)) for p in EXCLUDED_STARTS))
    good = host.isNotNull() & ~host.isin(EXCLUDED_DOMAINS) & ~started & ~F.contains(c, F.lit("..")) & ~F.startswith(c, F.lit(".")) & ~c.rlike(r"(?i)\.(png|jpg|jpeg|gif|svg|webp|css|js)$") & top.between(2, 10)
    return F.coalesce(good, F.lit(False))


def emails(page: Column | str) -> Column:
    """Distinct contact addresses of a decoded page: links first, then text, meta and author tags.

    Addresses are written out only in texts that hide one, and looked for only in texts with an @ or a hidden one.
    """
    every = lambda text, pattern, group: F.regexp_extract_all(text, F.lit(pattern), group)

    def found(c: Column) -> Column:
        hidden = F.coalesce(c.rlike(BRACKETED) | c.rlike(SPELLED), F.lit(False))
        of_text = F.when(hidden, every(revealed(c), EMAIL, 0)).otherwise(every(c, EMAIL, 0))
        whole = F.concat(every(c, MAILTO, 1), of_text, every(c, META, 1), every(c, LINK, 1))
        return F.when(F.contains(c, F.lit("@")) | hidden, whole).when(c.isNotNull(), F.array().cast("array<string>"))

    return F.array_distinct(F.filter(F.transform(_once(col(page), found), cleaned_email), is_contact_email))


def phones(page: Column | str) -> Column:
    """Distinct phones of ten characters or more: tel links first, then French numbers in the text."""
    c = col(page)
    found = F.concat(F.regexp_extract_all(c, F.lit(TEL), 1), F.regexp_extract_all(c, F.lit(FRENCH_PHONE), 0))
    return F.array_distinct(F.filter(F.transform(found, phone_digits), lambda x: F.length(x) >= 10))


def registration(page: Column | str) -> Column:
    """The first labelled 14-digit registration number, without spaces."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.regexp_replace(col(page), "<[^>]*>", " "), REGISTRATION, 1), r"\s", ""), F.lit(""))


def ranked_emails(found: Column | str, host: Column | str) -> Column:
    """Addresses of the site's domain (or containing it) first, personal before generic, otherwise in order."""
    from millrace.functions.values import is_generic

    other = lambda e: (~F.coalesce(F.contains(F.split(e, "@")[1], col(host)), F.lit(False))).cast("int")
    keyed = F.transform(col(found), lambda e, i: F.struct(other(e).alias("o"), is_generic(e).cast("int").alias("g"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: x["e"])


def json_ld(page: Column | str) -> Column:
    """JSON-LD objects of a page as variants; lists are flattened, invalid blocks and other values left out."""
    blocks = F.regexp_extract_all(col(page), F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)
    parsed = F.filter(F.transform(blocks, lambda b: F.try_parse_json(F.trim(b))), lambda v: v.isNotNull())
    lists = F.transform(parsed, lambda v: F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v)))
    return F.filter(F.flatten(lists), lambda v: v.isNotNull() & _is(v, "OBJECT"))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _text(v: Column, *names: str) -> Column:
    """The first of several fields of a variant that is a text and not blank, trimmed."""
    at = lambda n: F.try_variant_get(v, f"$['{n}']", "variant")
    return F.coalesce(*(F.nullif(F.trim(F.when(_is(at(n), "STRING"), F.try_variant_get(at(n), "$", "string"))), F.lit("")) for n in names))


def business_entities(blocks: Column | str) -> Column:
    """Entities of JSON-LD objects, those of an @graph one by one, whose type (one or several) is a business."""
    inner = lambda v: F.filter(F.try_variant_get(v, "$['@graph']", "array<variant>"), lambda x: _is(x, "OBJECT"))
    whole = F.flatten(F.transform(col(blocks), lambda v: F.coalesce(inner(v), F.array(v))))
    several = lambda v: F.exists(F.try_variant_get(v, "$['@type']", "array<string>"), lambda t: t.isin(BUSINESS_TYPES))
    return F.filter(whole, lambda v: F.coalesce(_text(v, "@type").isin(BUSINESS_TYPES), several(v), F.lit(False)))


def entity(v: Column) -> Column:
    """Struct email, phone, name, founder, address, url of an entity; contact points give what the entity itself lacks."""
    at = lambda n: F.try_variant_get(v, f"$['{n}']", "variant")
    points = F.when(_is(at("contactPoint"), "ARRAY"), F.try_variant_get(at("contactPoint"), "$", "array<variant>")).when(at("contactPoint").isNotNull(), F.array(at("contactPoint")))
    point = lambda n: F.get(F.filter(F.transform(points, lambda p: _text(p, n)), lambda x: x.isNotNull()), F.lit(0))
    boss = F.coalesce(at("founder"), at("employee"))
    parts = F.filter(F.array(*(_text(at("address"), n) for n in ("streetAddress", "postalCode", "addressLocality"))), lambda x: x.isNotNull())
    return F.struct(
        F.coalesce(_text(v, "email"), point("email")).alias("email"),
        F.coalesce(_text(v, "telephone"), point("telephone")).alias("phone"),
        _text(v, "name", "legalName").alias("name"),
        F.when(_is(boss, "OBJECT"), _text(boss, "name")).alias("founder"),
        F.when(_is(at("address"), "OBJECT") & (F.size(parts) > 0), F.array_join(parts, ", ")).alias("address"),
        _text(v, "url").alias("url"),
    )


def is_published_email(c: Column) -> Column:
    """A whole address that isn't of one of a few domains of templates."""
    return F.coalesce(c.rlike(f"^{EMAIL}$") & ~F.lower(F.split(c, "@")[1]).isin(PUBLISHED_EXCLUDED), F.lit(False))


def entity_field(entity: Column | str, *paths: str) -> Column:
    """The first of several JSON paths of a variant that has a non-empty text."""
    return F.coalesce(*(F.nullif(F.try_variant_get(col(entity), p, "string"), F.lit("")) for p in paths))
