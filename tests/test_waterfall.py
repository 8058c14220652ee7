"""The cascade on planted snapshots: the worked examples, its sources one by one, people and addresses."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions import html, people
from millrace.operators import cascade, sources, waterfall
from millrace.operators.tables import bucketed
from millrace.plans import examples


@pytest.fixture(scope="module")
def run(spark):
    out = waterfall.run(examples.records(spark), waterfall.on_snapshots(**examples.snapshots(spark), not_names=examples.NOT_NAMES))
    return {r["id"]: r for r in out.collect()}


def test_worked_examples(spark):
    assert sorted(map(tuple, examples.ran(spark).collect())) == examples.RUN


def test_people_and_profiles(run):
    assert [(p["name"], p["email"], p["linkedinUrl"], p["source"], p["confidence"]) for p in run[2]["people"]] == [("Ada Bec", "a.b@deux.test", "https://www.linkedin.com/in/ada-b", "kaspr", 90)]
    assert [(p["name"], p["title"], p["email"], p["source"], p["confidence"]) for p in run[4]["people"]] == [("Anne Lune", "Gérante", None, "deep_scrape", 65)]
    assert run[4]["used"][1]["metadata"] == {"json_ld_count": "1", "business_name": "Quatre", "address": "1 rue, Nice"}
    (jean,) = run[5]["people"]
    assert (jean["linkedinUrl"], jean["source"], jean["title"]) == ("https://fr.linkedin.com/in/jean-roc", "deep_scrape", "Directeur") and run[5]["profile"] == jean["linkedinUrl"]
    assert run[5]["used"][4]["metadata"] == {"pages_found": "1", "emails_found": "1", "dm_queries": "1", "search_engine": "brave", "linkedin_url": jean["linkedinUrl"]}
    assert [(a["email"], a["type"], a["isBest"]) for a in run[4]["addresses"]] == [("info@other.test", "global", True)]
    assert run[1]["mx_provider"] == "google" and not run[2]["has_mx"] and run[3]["emails"] == ["known@trois.test"]


def test_options_and_empty_tables(spark):
    given, tables = examples.records(spark), examples.snapshots(spark)
    bound = waterfall.on_snapshots(**tables, not_names=examples.NOT_NAMES)
    off = {r["id"]: r["tried"] for r in waterfall.run(given, bound, with_vendor=False, max_sources=5).collect()}
    assert off[2] == ["dns_intel", "schema_org", "deep_scrape", "sirene", "linkedin_search"] and len(off[6]) == 5
    nothing = waterfall.on_snapshots(**{k: t.limit(0) for k, t in tables.items()}, not_names=[])
    assert {tuple(r["tried"]) for r in waterfall.run(given.where("id <> 3"), nothing).collect()} == {("dns_intel", "schema_org", "deep_scrape", "sirene", "linkedin_search")}
    assert waterfall.run(given.limit(0), bound).count() == 0
    assert [tuple(r) for r in waterfall.short_circuits(given.where("id < 4").withColumn("website", F.when(F.col("id") > 1, F.col("website")))).orderBy("id").collect()] == [(1, [], 0, None, "no website"), (3, ["existing"], 100, "known@trois.test", None)]
    assert [r["source"] for r in waterfall.capabilities({"kaspr": bound["kaspr"]}, spark).where("registered").collect()] == ["kaspr"]


def test_permutations_take_the_first_usable(spark):
    person = ("Jean Roc", "Jean", "Roc", None, None, None, None, "sirene", 90)
    state = spark.createDataFrame([(1, "cinq.test", "Jean Roc", "Jean", "Roc", [person]), (2, "deux.test", None, None, None, []), (3, "six.test", "A B", "Jean", "Roc", [])], f"id int, domain string, officer string, first_name string, last_name string, people {sources.PEOPLE}")
    checks = examples.CHECKS + [("contact@deux.test", True, False, True, False), ("roc.jean@six.test", False, False, None, None)]
    out = {r["id"]: r for r in sources.email_permutation(state, spark.createDataFrame(checks, "email string, a_valid boolean, a_disposable boolean, b_valid boolean, b_disposable boolean")).collect()}
    assert out[1]["email"] is None and out[1]["metadata"]["dm_success"] == "0"  # both checked ones are disposable
    assert (out[2]["email"], out[2]["metadata"]) == ("contact@deux.test", {"strategy": "generic_fallback", "smtp_verified": "true"})
    assert (out[3]["email"], out[3]["officer"]) == ("roc.jean@six.test", "A B")


@pytest.mark.parametrize(
    "page, found",
    [
        ("<h3>Jean Dupont</h3>\n<p>Gérant</p>", [("Jean Dupont", "Gérant")]),
        ("<p>Fondatrice</p><div><span>Zoé De La Tour</span></div>", [("Zoé De La Tour", "Fondatrice"), ("La Tour", "Fondatrice")]),
        ("<li>Marc Petit, directeur général</li>", [("Marc Petit", "directeur général")]),
        ("<p>Notre PDG depuis 2010 est Luc Blanc</p>", [("Luc Blanc", "PDG")]),
        ("<h3>Mentions Legales</h3><p>Directeur</p>", []),
        ("<h3>JEAN DUPONT</h3><p>gérant</p>", []),
        ("<p>nobody</p>", []),
        (None, []),
    ],
)
def test_people_of_pages(spark, page, found):
    out = spark.createDataFrame([(page,)], "p string").select(people.page_people("p", examples.NOT_NAMES).alias("x")).first()["x"]
    assert [tuple(p) for p in out] == found


def test_entities_of_businesses(spark):
    page = """<script type='application/ld+json'>[{"@type":"Store","telephone":5,"founder":{"name":" Zoé Roc "},"address":{"postalCode":"06","addressLocality":"Nice"}},[1],
      {"@type":"Person","name":"no"},{"@type":["X","Library"],"legalName":"L","email":"a@x.test","contactPoint":{"telephone":"01","email":"b@x.test"},"employee":[{"name":"no"}]}]</script>
      <SCRIPT TYPE="application/ld+json">{"@graph":[{"@type":"Dentist","name":"D"},4]}</SCRIPT><script type="application/ld+json">{"@type":"Thing"}</script>"""
    e = spark.createDataFrame([(page,)], "p string").select(F.transform(html.business_entities(html.json_ld("p")), html.entity).alias("e")).first()["e"]
    assert [tuple(x) for x in e] == [(None, None, None, "Zoé Roc", "06, Nice", None), ("a@x.test", "01", "L", None, None, None), (None, None, "D", None, None, None)]
    profile = spark.createDataFrame(examples.VENDOR, examples.snapshots(spark)["vendor"].schema).select(sources.vendor_email(F.col("profile")).alias("m")).collect()
    assert [tuple(r["m"]) for r in profile] == [("a.b@deux.test", "work"), ("anne@quatre.test", "unknown")]


def test_numeric_entities(spark):
    cases = {"a&#64;b &#x41; &amp;lt;": "a@b A <", "&#38;#x41;": "A", "&#x26;#65;": "&#65;", "&#128512;": "", "&#55357;": "�", "&#;&#x;&#12a;": "&#;&#x;&#12a;", "x": "x", "": "", "é&#233;&#x20AC;;": "éé€;", "\\u003Ca\\u0026": "<a&"}
    rows = spark.createDataFrame(list(cases.items()), "raw string, want string").withColumn("got", html.decoded("raw"))
    assert rows.where("NOT got <=> want").collect() == []


def test_people_in_a_run_and_across_runs(spark):
    row = spark.createDataFrame([([("Zoé A", "Zoé", "A", None, None, None, None, "sirene", 90)], [("zoe a", "", "", "CEO", None, None, "u", "google_dork", 10), ("Bo B", "Bo", "B", None, "b@x.test", None, None, "kaspr", 88)])], f"known {sources.PEOPLE}, found {sources.PEOPLE}")
    moved, kept = row.select(cascade.joined_people(F.col("known"), F.col("found")).alias("a"), cascade.joined_people(F.col("known"), F.col("found"), False).alias("b")).first()
    assert [(p["name"], p["firstName"], p["title"], p["source"], p["confidence"]) for p in moved] == [("zoe a", "Zoé", "CEO", "google_dork", 90), ("Bo B", "Bo", None, "kaspr", 88)]
    assert kept[0]["source"] == "sirene"
    assert row.select(cascade.person_of(F.lit("B@x.test"), F.col("found"))).first()[0] == "Bo B"


PAIR = r"<(?:h[1-6]|span|p|div|strong|b|em|li)[^>]*>\s*([^<]{3,50}?)\s*</(?:h[1-6]|span|p|div|strong|b|em|li)>\s*(?:<[^>]*>\s*)*<(?:h[1-6]|span|p|div|strong|b|em|li)[^>]*>\s*([^<]{3,80}?)\s*</(?:h[1-6]|span|p|div|strong|b|em|li)>"


def test_scans_find_what_patterns_find():
    rng = random.Random(1)
    parts = ["<p>", "</p>", "<h3 class='x'>", "</h3>", "<b>", "</b>", "<br>", "<div>\n", "</div>", " ", "   ", "<", ">", "Jean Dupont", "Gérant", "Anne", "x", "Zoé De La Tour", "PDG", ",", "-", " - ", "directeur général", "</ p>", "<i>", "a b c", "T" * 55, "<span", "</span>", "Jean D Roc", "9Luc Blanc"]
    name, found = rf"{people.NAME_WORD}(?:\s+{people.NAME_WORD}){{1,3}}", 0
    for _ in range(20_000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(3, 22)))
        pairs = [(a.strip(), b.strip()) for a, b in re.findall(PAIR, page, re.I)]
        titled = [(a.strip(), b.strip()) for a, b in re.findall(rf"({name})\s*[,\-–—|:]\s*{people.STRICT_TITLE}", page, re.I)]
        assert list(people.neighbours(page)) == pairs and list(people.before_titles(page)) == titled
        found += len(pairs) + len(titled)
    assert found > 300


@pytest.mark.parametrize("page", ["<div><p>   </p>" * 300_000, "<p>Some words of a page, and more - of it</p>\n" * 100_000, "<script" * 700_000, "<" * 5_000_000, "Aa " * 1_700_000 + "<b>x</b>", "a" * 5_000_000 + ", gérant"])
def test_people_of_a_long_page_take_linear_time(page):
    page += "<h3>Jean Dupont</h3><p>Gérant</p>"
    began = time.time()
    out = people.people_of_page(page, frozenset(["gerant"]))
    assert time.time() - began < 20 and len(page) > 4_000_000  # far from quadratic, on any machine
    assert len(out) <= 2 and (not out or out[0] == ("Jean Dupont", "Gérant"))


def test_people_as_a_table_function(spark):
    words = spark.createDataFrame([("Syndic",), ("Directeur",), (None,)], "w string")
    pages = spark.createDataFrame([(1, "<h3>Syndic Nice</h3><p>Gérant</p>"), (2, "<p>Directeur</p><b>Zoé Roc</b><p>PDG</p><b>Luc Blanc</b>"), (3, None), (4, "")], "id int, html string")
    found = people.people_table(words)
    rows = pages.lateralJoin(found(F.col("html").outer())).select("id", "nth", "name", "title").orderBy("id", "nth").collect()
    assert [tuple(r) for r in rows] == [(2, 0, "Zoé Roc", "Directeur"), (2, 1, "Luc Blanc", "PDG")]
    pages.createOrReplaceTempView("some_pages")
    spark.udtf.register("page_people", found)
    assert spark.sql("SELECT id, p.name FROM some_pages, LATERAL page_people(html) p").count() == 2
    texts = spark.createDataFrame([("Le syndic et un Syndic, le Jean.",), ("syndic le Jean Jean é É",), (None,)], "t string")
    assert sorted(r["word"] for r in people.common_words(texts, "t").collect()) == ["le", "syndic"]


def test_sites_in_phases_and_single_pages(spark):
    assert sorted(map(tuple, examples.crawled(spark).collect())) == examples.CRAWLED
    assert sorted(map(tuple, examples.guessed(spark).collect())) == sorted(examples.GUESSED)


def test_stored_snapshots_are_not_shuffled(spark):
    given, tables = examples.records(spark), waterfall.stored(**examples.snapshots(spark))
    bound = waterfall.on_snapshots(**tables, not_names=examples.NOT_NAMES)
    out = waterfall.run(given, bound)
    assert sorted((r["id"], ",".join(r["tried"])) for r in out.select("id", "tried").collect()) == [r[:2] for r in examples.RUN]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = bucketed(waterfall.started(given), ["id"])
        for name, asked in (("dns_intel", "_domain"), ("schema_org", "_url"), ("deep_scrape", "_url"), ("kaspr", "_profile_url")):
            plan = waterfall.accumulation(80)(state.withColumn("run", F.lit(True)), bound[name](state), name)._jdf.queryExecution().executedPlan().toString()
            shuffled = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
            # the keys that are asked for go out, results come back by id; state and snapshot stay where they are
            assert sorted(set(shuffled)) == sorted({asked, "id"}) and shuffled.count(asked) == 1 and len(shuffled) <= 3 and plan.count("Bucketed: true") >= 2, (name, plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stored_snapshots_and_states_are_not_broadcast(spark):
    given, bound = examples.records(spark), waterfall.on_snapshots(**waterfall.stored(**examples.snapshots(spark)), not_names=examples.NOT_NAMES)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1_000_000  # these tables are far smaller
    state = bucketed(waterfall.started(given), ["id"]).withColumn("run", F.lit(True))
    for name, source in bound.items():
        step = waterfall.accumulation(80)(state, source(state.drop("run")), name)
        assert step.count() == len(examples.RECORDS)
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 2, (name, plan)
