"""Column functions for missing values, rounding, names, domains, e-mail addresses and phones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------------------
# Domains and local parts that an address for outreach must not have; local parts of a whole company.
BLOCKED_DOMAINS = [
    "example.com", "example.fr", "test.com", "test.fr",
    "mailinator.com", "guerrillamail.com", "tempmail.com", "throwaway.email",
    "yopmail.com", "yopmail.fr", "trashmail.com", "sharklasers.com",
    "guerrillamailblock.com", "grr.la", "discard.email",
    "temp-mail.org", "fakeinbox.com", "mailnesia.com",
    "noreply.com", "no-reply.com",
    "10minutemail.com", "guerrillamail.info", "maildrop.cc",
    "tempail.com", "throwaway.com", "mailcatch.com",
]
JUNK_PREFIXES = ["noreply", "no-reply", "no_reply", "donotreply", "do-not-reply", "mailer-daemon", "postmaster", "webmaster", "abuse", "bounce", "unsubscribe", "root", "admin"]
COMPANY_PREFIXES = ["contact", "info", "accueil", "hello", "bonjour", "reception", "admin", "service", "direction", "commercial", "support", "sales", "office", "team", "mail", "noreply", "no-reply"]
GENERIC_STARTS = ["contact@", "info@", "accueil@"]
# Words of the local part and their priority, the first found counts.
LOCAL_PART_PRIORITY = {
    "direction": 1, "directeur": 1, "gerant": 1, "ceo": 1, "patron": 1,
    "dir": 2, "responsable": 2, "manager": 2, "president": 2,
    "contact": 3, "accueil": 3, "reception": 3,
    "info": 4, "information": 4, "renseignement": 4, "infos": 4,
    "commercial": 5, "vente": 5, "sales": 5, "devis": 5,
    "secretariat": 6, "administration": 6,
    "hello": 7, "bonjour": 7, "bienvenue": 7,
    "compta": 8, "comptabilite": 8, "facturation": 8,
}
# Parts of a mail host and the provider that they tell, the first found counts.
MAIL_HOSTS = {
    "google": "google", "googlemail": "google", "outlook": "microsoft", "microsoft": "microsoft", "protection.outlook": "microsoft",
    "ovh": "ovh", "mail.ovh": "ovh", "gandi": "gandi", "ionos": "ionos", "zoho": "zoho", "protonmail": "protonmail", "mxplan": "ovh",
    "infomaniak": "infomaniak", "o2switch": "o2switch", "hostinger": "hostinger", "yahoo": "yahoo", "icloud": "apple", "titan.email": "titan",
    "emailsrvr.com": "rackspace", "pphosted.com": "proofpoint", "messagelabs": "symantec", "mimecast": "mimecast", "barracuda": "barracuda",
}
ADDRESS = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?)*\.[a-zA-Z]{2,}$"
# ------------------------------------------------------------------------------------------------------------


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: Column | str) -> Column:
    """Not null and not empty; white space counts as text."""
    return F.coalesce(col(c) != "", F.lit(False))


def has_text(c: Column | str) -> Column:
    """Not null and not blank."""
    return F.coalesce(F.trim(col(c)) != "", F.lit(False))


def missing(c: Column | str) -> Column:
    """Null or empty."""
    return ~filled(c)


def either(*columns: Column | str) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in columns))


def number(c: Column | str, kind: str = "double") -> Column:
    """A number from text; null for blank or malformed text."""
    return F.nullif(F.trim(col(c)), F.lit("")).try_cast(kind)


def round_half_up(c: Column | str, digits: int = 0) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits: halves go up, negative ones too."""
    x = col(c).cast("double")
    return F.floor(x + 0.5) if not digits else F.floor(x * 10**digits + 0.5) / F.lit(float(10**digits))


def percent(part: Column | str, whole: Column | str) -> Column:
    """Share in per cent with one decimal; 0 of nothing."""
    return F.when(col(whole) > 0, F.floor(col(part) * 1000 / col(whole) + 0.5) / F.lit(10.0)).otherwise(F.lit(0.0))


def first_match(text: Column, table: dict[str, object], otherwise: object = None) -> Column:
    """The value of the first key, in order, that the text contains."""
    out = F.lit(otherwise)
    for key, value in reversed(table.items()):
        out = F.when(F.contains(text, F.lit(key)), F.lit(value)).otherwise(out)
    return out


def band(c: Column | str, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step (descending) that the value reaches."""
    return reduce(lambda out, s: F.when(col(c) >= s[0], F.lit(s[1])).otherwise(out), reversed(steps), F.lit(otherwise))


def one_of(c: Column | str, allowed: list[str], otherwise: str) -> Column:
    return F.when(col(c).isin(allowed), col(c)).otherwise(otherwise)


# --- names and text -----------------------------------------------------------------------------------------


def folded(c: Column | str) -> Column:
    """Lower case without the diacritics of Latin letters (a base letter for each; ligatures stay)."""
    import unicodedata

    marked = [chr(i) for i in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(i))) > 1]
    base = [unicodedata.normalize("NFD", x)[0] for x in marked]
    plain = F.translate(F.lower(col(c)), "".join(marked), "".join(base))
    return F.regexp_replace(plain, "[̀-ͯ]", "")


def name_letters(c: Column | str) -> Column:
    """A name's letters a to z only."""
    return F.regexp_replace(folded(c), "[^a-z]", "")


def slug(c: Column | str, joint: str = "_") -> Column:
    """Folded words joined by ``joint``."""
    return F.regexp_replace(F.regexp_replace(folded(c), "[^a-z0-9]+", joint), f"^{joint}|{joint}$", "")


def profile_guess(first: Column | str, last: Column | str) -> Column:
    """The usual profile address of a name: folded letters, spaces as hyphens; null unless both names have letters."""
    part = lambda c: F.regexp_replace(F.trim(F.regexp_replace(folded(c), r"[^a-z\s-]", "")), r"\s+", "-")
    f, n = part(first), part(last)
    return F.when((f != "") & (n != ""), F.concat(F.lit("https://www.linkedin.com/in/"), f, F.lit("-"), n))


def parsed_name(c: Column | str) -> Column:
    """Struct firstName, lastName, companyName: first word and rest of at most 200 characters; Contact for none."""
    name = F.substring(F.trim(F.coalesce(col(c), F.lit(""))), 1, 200)
    words = F.split(name, r"\s+")
    first = F.when(name == "", "Contact").when(F.size(words) > 1, words[0]).otherwise(F.substring(name, 1, 30))
    last = F.when(F.size(words) > 1, F.array_join(F.slice(words, 2, 2_000), " ")).otherwise("")
    return F.struct(first.alias("firstName"), last.alias("lastName"), name.alias("companyName"))


def first_name(c: Column | str, most: int = 20) -> Column:
    """The first of several words, else at most ``most`` characters; Contact for none."""
    name = F.trim(F.coalesce(col(c), F.lit("")))
    words = F.split(name, r"\s+")
    return F.when(F.size(words) > 1, words[0]).when(name == "", "Contact").otherwise(F.substring(name, 1, most))


def without_suffixes(c: Column | str, suffixes: list[str]) -> Column:
    """A company's name without legal forms, as words of their own; spaces collapsed."""
    forms = "|".join(suffixes)
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), rf"(?i)(?<![A-Za-z0-9_])(?:{forms})(?![A-Za-z0-9_])\.?", " "), r"\s+", " "))


def snippet(c: Column | str, most: int = 120) -> Column:
    """Text without tags, white space collapsed, cut."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(col(c), "<[^>]*>", " "), r"\s+", " ")), 1, most)


def search_term(term: str) -> str:
    """A search parameter without characters that have a meaning in patterns or lists."""
    return "".join(x for x in term if x not in "%_(),.\"'\\").strip()


def listed(c: Column | str, separator: str = ",") -> Column:
    """Trimmed, non-empty parts of a list written as text."""
    return F.filter(F.transform(F.split(col(c), f"\\Q{separator}\\E"), F.trim), lambda x: x != "")


# --- domains, addresses, phones -----------------------------------------------------------------------------


def domain(website: Column | str) -> Column:
    """Host of a web address, lower case, without a leading www.; the scheme may be missing."""
    c = F.trim(col(website))
    full = F.when(c.rlike("(?i)^https?://"), c).otherwise(F.concat(F.lit("https://"), c))
    host = F.coalesce(F.try_parse_url(full, F.lit("HOST")), F.regexp_extract(c, r"(?i)^(?:https?://)?([^/?#]+)", 1))
    return F.nullif(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit(""))


def mail_domain(website: Column | str) -> Column:
    """Host for guessing addresses: every www. and the port removed; null without a dot or at three characters or fewer."""
    host = F.regexp_extract(col(website), r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    host = F.split(F.replace(F.lower(host), F.lit("www."), F.lit("")), ":")[0]
    return F.when(F.contains(host, F.lit(".")) & (F.length(host) > 3), host)


def valid_email(c: Column | str) -> Column:
    """The trimmed, lower-case address, or null where it is malformed, too long, blocked or a junk mailbox."""
    e = F.lower(F.trim(col(c)))
    good = (F.length(e) <= 254) & e.rlike(ADDRESS) & ~F.substring_index(e, "@", -1).isin(BLOCKED_DOMAINS) & ~F.substring_index(e, "@", 1).isin(JUNK_PREFIXES)
    return F.when(good, e)


def is_generic(c: Column | str) -> Column:
    return reduce(lambda a, b: a | b, (F.startswith(F.lower(col(c)), F.lit(p)) for p in GENERIC_STARTS))


def is_company_mailbox(c: Column | str) -> Column:
    return F.substring_index(F.lower(col(c)), "@", 1).isin(COMPANY_PREFIXES)


def is_personal_match(c: Column | str, first: Column | str, last: Column | str) -> Column:
    """Whether the local part is made of the first and last name in a usual way, or contains both."""
    local, f, n = F.substring_index(F.lower(col(c)), "@", 1), name_letters(first), name_letters(last)
    i = F.substring(f, 1, 1)
    usual = [F.concat(f, F.lit("."), n), F.concat(i, F.lit("."), n), F.concat(f, n), F.concat(n, F.lit("."), f), n]
    return (f != "") & (n != "") & (reduce(lambda a, b: a | b, (local == u for u in usual)) | (F.contains(local, f) & F.contains(local, n)))


def permutations(first: Column | str, last: Column | str, host: Column | str) -> Column:
    """Likely addresses of a person, the most usual first; none without both names."""
    f, n, at = name_letters(first), name_letters(last), F.concat(F.lit("@"), col(host))
    i = F.substring(f, 1, 1)
    dot, dash, low = F.lit("."), F.lit("-"), F.lit("_")
    locals_ = [(f, dot, n), (f,), (i, dot, n), (n, dot, f), (n,), (f, n), (i, n), (n, f), (f, dash, n), (f, low, n), (i, F.substring(n, 1, 1)), (F.lit("contact"),)]
    return F.when((f != "") & (n != ""), F.array_distinct(F.array(*(F.concat(*x, at) for x in locals_)))).otherwise(F.array().cast("array<string>"))


def local_part_priority(c: Column | str) -> Column:
    """1 (best) to 8 by a word of the local part, 10 for none."""
    return first_match(F.substring_index(F.lower(col(c)), "@", 1), LOCAL_PART_PRIORITY, 10)


def mail_provider(hosts: Column | str) -> Column:
    """Provider by the mail hosts of a domain (an array)."""
    return first_match(F.lower(F.array_join(col(hosts), " ")), MAIL_HOSTS, "other")


def phone_digits(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[^\d+]", "")
