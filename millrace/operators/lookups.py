"""Stages of the cascade on snapshot tables: mail hosts of domains, and the company registry.

A stage takes records and gives a result row for each of them, with empty fields where nothing is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.values import col, filled, first_match, mail_provider, without_suffixes

# --- fixed values -------------------------------------------------------------------------------------------
SPF_INCLUDES = {"google": "google", "outlook": "microsoft", "microsoft": "microsoft", "ovh": "ovh", "zoho": "zoho", "sendinblue": "brevo", "brevo": "brevo", "sendgrid": "sendgrid", "mailchimp": "mailchimp"}
MARKETING = ["brevo", "sendgrid", "mailchimp"]
OFFICER_TITLES = ["gerant", "gerante", "president", "presidente", "directeur general", "directrice generale", "directeur", "directrice"]
LEGAL_FORMS = ["sarl", "sas", "sa", "eurl", "sasu", "sci", "snc", "gmbh", "ltd", "llc", "inc"]
NATURAL_PERSON = "personne physique"
DOMAIN_ENDS = r"(?i)\.(fr|com|net|org|eu|paris|bzh|io|co)$"
MOST_HOSTS, LEAST_WORDS, REGISTRY_CONFIDENCE = 5, 3, 90
# ------------------------------------------------------------------------------------------------------------


def spf_providers(texts: Column | str) -> Column:
    """Distinct providers that the include parts of SPF records (an array of texts) name, in order."""
    records = F.filter(F.transform(col(texts), F.lower), lambda t: F.contains(t, F.lit("v=spf1")))
    hosts = F.flatten(F.transform(records, lambda t: F.regexp_extract_all(t, F.lit(r'include:([^\s"]+)'), 1)))
    return F.array_distinct(F.filter(F.transform(hosts, lambda h: first_match(h, SPF_INCLUDES)), lambda p: p.isNotNull()))


def _present(**values: Column) -> Column:
    """A map of the values that are not null."""
    whole = F.create_map(*(x for name, v in values.items() for x in (F.lit(name), v.cast("string"))))
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def hosts_by_domain(dns: DataFrame) -> DataFrame:
    """A snapshot (domain, record_type, data) as one row a domain: _domain and the sorted data of its MX and TXT records. Such a table stays."""
    if "_domain" in dns.columns:
        return dns
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("record_type") == kind, F.col("data"))))
    return dns.groupBy(F.col("domain").alias("_domain")).agg(of("MX").alias("_mx"), of("TXT").alias("_txt"))


def mail_hosts(records: DataFrame, dns: DataFrame) -> DataFrame:
    """Result rows of records (id, domain) by a snapshot (domain, record_type, data): has_mx and metadata, no address.

    A domain without mail hosts has has_mx false, so that later sources which need them are passed over. Hosts are in the
    order of their data, at most five are listed.
    """
    both = records.select("id", F.col("domain").alias("_domain")).join(hosts_by_domain(dns), "_domain", "left")
    none = F.array().cast("array<string>")
    both = both.select("id", F.coalesce("_mx", none).alias("mx"), spf_providers(F.coalesce("_txt", none)).alias("spf"))
    some = F.size("mx") > 0
    about = _present(
        has_mx=some,
        mx_records=F.array_join(F.slice("mx", 1, MOST_HOSTS), ", "),
        mx_provider=F.when(some, mail_provider("mx")),
        spf_providers=F.when(F.size("spf") > 0, F.array_join("spf", ", ")),
        uses_marketing_email=F.when(F.arrays_overlap("spf", F.array(*map(F.lit, MARKETING))), F.lit(True)),
    )
    return both.select("id", some.alias("has_mx"), about.alias("metadata"))


def officers(listed: Column | str) -> Column:
    """Natural persons with a name of a company's officers (nom, prenoms, qualite, type_dirigeant), by the rank of their title.

    Titles are searched for as parts; those without a known one come last. Ties keep their order.
    """
    people = F.filter(col(listed), lambda p: filled(p["nom"]) & (p["type_dirigeant"] == NATURAL_PERSON))
    ranks = {title: i for i, title in enumerate(OFFICER_TITLES)}

    def person(p: Column, i: Column) -> Column:
        first = F.split(F.coalesce(p["prenoms"], F.lit("")), " ")[0]
        rank = first_match(F.lower(F.coalesce(p["qualite"], F.lit(""))), ranks, 999)
        name = F.trim(F.concat(first, F.lit(" "), p["nom"]))
        return F.struct(rank.cast("int").alias("rank"), i.alias("at"), name.alias("name"), first.alias("firstName"), p["nom"].alias("lastName"), p["qualite"].alias("title"), F.lit("sirene").alias("source"), F.lit(REGISTRY_CONFIDENCE).alias("confidence"))

    return F.transform(F.array_sort(F.transform(people, person)), lambda x: x.dropFields("rank", "at"))


def _place(query: Column, commune: Column) -> Column:
    """One text for a query and a commune, which may be missing."""
    return F.concat(query, F.lit("\n"), F.coalesce(commune, F.lit("\r")))


def companies_by_query(snapshot: DataFrame) -> DataFrame:
    """The company that the registry gives first for each query and commune: _place, company. Such a table stays."""
    if "_place" in snapshot.columns:
        return snapshot
    company = F.struct("siren", "siret", "nom_complet", "activite_principale", "dirigeants")
    return snapshot.where("rank = 1").select(_place(F.col("query"), F.col("commune")).alias("_place"), company.alias("company")).groupBy("_place").agg(F.min_by("company", F.xxhash64("company")).alias("company"))


def registry(records: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Result rows of records (id, name, city, domain) by a registry snapshot (query, commune, rank, siren, siret, ...).

    Three attempts: name in the city, name anywhere (commune null), and the domain's words in the city where they differ from the name.
    All attempts meet the snapshot in one join, and the first that found a company counts.
    """
    words = F.trim(F.regexp_replace(F.regexp_replace("domain", DOMAIN_ENDS, ""), "[-_]", " "))
    city = F.when(filled("city"), F.col("city"))
    use = (F.length(words) >= LEAST_WORDS) & (F.lower(words) != F.lower(F.coalesce("name", F.lit(""))))
    attempt = lambda n, query, commune: F.struct(F.lit(n).alias("attempt"), without_suffixes(query, LEGAL_FORMS).alias("query"), commune.alias("commune"))
    tries = F.array(attempt(1, F.col("name"), city), attempt(2, F.col("name"), F.lit(None).cast("string")), attempt(3, F.when(use, words), city))
    asked = records.select("id", F.inline(tries)).where(F.coalesce("query", F.lit("")) != "")
    keyed = asked.select("id", "attempt", _place(F.col("query"), F.col("commune")).alias("_place"))
    found = keyed.join(companies_by_query(snapshot), "_place")
    chosen = found.groupBy("id").agg(F.min_by("company", "attempt").alias("company"))
    out = records.select("id").join(chosen, "id", "left").withColumn("people", officers("company.dirigeants"))
    lead = F.get("people", F.lit(0))
    about = _present(
        siren=F.col("company.siren"),
        nom_complet=F.col("company.nom_complet"),
        activite_principale=F.when(F.col("company").isNotNull(), F.coalesce("company.activite_principale", F.lit(""))),
        dirigeant_first_name=lead["firstName"],
        dirigeant_last_name=lead["lastName"],
        dirigeant_qualite=F.nullif(F.get("company.dirigeants", F.lit(0))["qualite"], F.lit("")),
    )
    return out.select("id", F.col("company.siret").alias("registration"), lead["name"].alias("officer"), "people", about.alias("metadata"))
