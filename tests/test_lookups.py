from millrace.operators import lookups, stats
from pyspark.sql import functions as F

COMPANY = "query string, commune string, rank int, siren string, siret string, nom_complet string, activite_principale string, dirigeants array<struct<nom:string,prenoms:string,qualite:string,type_dirigeant:string>>"


def test_mail_hosts(spark):
    records = spark.createDataFrame([(1, "a.test"), (2, "b.test"), (3, None)], "id long, domain string")
    dns = spark.createDataFrame([("a.test", "MX", "10 aspmx.l.google.com"), ("a.test", "TXT", "v=spf1 include:_spf.google.com include:spf.sendinblue.com ~all"), ("b.test", "TXT", "include:ovh.net")], "domain string, record_type string, data string")
    rows = {r["id"]: r for r in lookups.mail_hosts(records, dns).collect()}
    assert [rows[i]["has_mx"] for i in (1, 2, 3)] == [True, False, False]
    assert rows[1]["metadata"] == {"has_mx": "true", "mx_records": "10 aspmx.l.google.com", "mx_provider": "google", "spf_providers": "google, brevo", "uses_marketing_email": "true"}
    assert rows[2]["metadata"] == {"has_mx": "false", "mx_records": ""}


def test_registry(spark):
    people = [("Roc", "Ana Lu", "Associe", "personne physique"), ("Holding", None, "President", "personne morale"), ("Dupont", "Jean", "Gerant", "personne physique"), ("", "X", "Gerant", "personne physique")]
    snapshot = spark.createDataFrame([("Salon Roc", None, 1, "s2", "t2", "ROC", None, people), ("Salon Roc", "Nice", 2, "s9", "t9", "NO", None, []), ("le salon", "Nice", 1, "s3", "t3", "LE", "96", None)], COMPANY)
    records = spark.createDataFrame([(1, "Salon Roc SARL", "Lyon", "x.test"), (2, "Autre", "Nice", "le-salon.fr"), (3, None, "", None), (4, "le salon", "Paris", "le-salon.fr")], "id long, name string, city string, domain string")
    rows = {r["id"]: r for r in lookups.registry(records, snapshot).collect()}
    assert (rows[1]["registration"], rows[1]["officer"], [p["lastName"] for p in rows[1]["people"]]) == ("t2", "Jean Dupont", ["Dupont", "Roc"])
    assert rows[1]["metadata"] == {"siren": "s2", "nom_complet": "ROC", "activite_principale": "", "dirigeant_first_name": "Jean", "dirigeant_last_name": "Dupont", "dirigeant_qualite": "Associe"}
    assert (rows[2]["registration"], rows[2]["officer"]) == ("t3", None)
    assert [rows[i]["registration"] for i in (3, 4)] == [None, None]


def test_exported(spark):
    df = spark.createDataFrame([("a", "x@y.fr"), ("a", None), ("", "z@y.fr"), (None, None), ("b", None)], "category string, email string")
    rows = {r["section"]: r["content"] for r in stats.exported(df, F.col("email").isNotNull(), {}, ["category"], 2).collect()}
    assert rows["all"] == '{"total":5,"with_value":2,"rate":40.0}'
    assert rows["category"] == '[{"name":"Autre","total":2,"with_value":1},{"name":"a","total":2,"with_value":1}]'
