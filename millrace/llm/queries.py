"""The corpus queries, each over its whole table, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import embedding_dedup, fill_middle, language_id, line_dedup, mixing, ngram_join, packing, positional_index, quality_classifier, quality_rules, sharding, warc, whitening
from millrace.llm.common import folded

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def word_count(text: str = "text") -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def op1_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_equal", "n_near", "emptied", F.md5("text").alias("text_md5"))


def op3_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_line_dedup, with exact repeats of short lines removed as well."""
    out = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents"), fewest=1)
    return out.select("doc_id", "n_lines", "n_equal", "n_near", "emptied", F.md5("text").alias("text_md5"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = language_id.learn(docs.where(~folded("doc_id")))
    out = language_id.predicted(docs.select("doc_id", "text"), prototypes)
    return out.select("doc_id", folded("doc_id").alias("held_out"), "lang_pred", "score")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    number = lambda c: F.try_to_number(F.substring(F.col(c), len(warc.PAGE) + 1, 30), F.lit("S9999999999999999999")).cast("long")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels").where(~folded("doc_id")))
    out = quality_classifier.scored(docs, model)
    return out.select("doc_id", folded("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = positional_index.build(table(spark, sf_dir, "documents"))
    out = positional_index.phrase_matches(index, table(spark, sf_dir, "benchmark")).withColumn("n_hit", positional_index.n_hit())
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = {"prefix_units": "prefix_chars", "middle_units": "middle_chars"}
    return out.withColumnsRenamed(names).select("doc_id", "n", "form", *names.values(), F.sha2("text", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_minimax_shards, op2_quality_rules, op3_line_dedup, op3_all_lines, op4_packing, op5_language_id, op6_warc, op7_mixing, op8_embedding_dedup, op9_quality_classifier, op10_ngram_join, op11_decontamination, op12_fill_middle, op13_whitening)}

_LINES = r"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, i - 1 AS line_no, trim(regexp_replace(lower(lines[i]), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM raw, unnest(range(1, len(lines) + 1)) t(i)),
seen AS (SELECT *, string_split(line, ' ') AS w FROM numbered WHERE len(string_split(line, ' ')) >= 5),
firsts AS (SELECT line, any_value(w) AS w, min((doc_id, line_no)) AS f FROM seen GROUP BY line),
gaps AS (SELECT line, f, i AS at, array_to_string(list_concat(w[1:i - 1], [chr(0)], w[i + 1:]), ' ') AS replaced, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS shorter FROM firsts, unnest(range(1, len(w) + 1)) t(i)),
centers AS (SELECT replaced, min(f) AS f FROM gaps GROUP BY replaced HAVING count(*) > 1),
near AS (
  SELECT g.line FROM gaps g JOIN centers c USING (replaced) WHERE g.f <> c.f
  UNION SELECT CASE WHEN g.f > o.f THEN g.line ELSE o.line END FROM gaps g JOIN firsts o ON g.shorter = o.line),
gone AS (SELECT s.doc_id, s.line_no, n.line IS NOT NULL AS near FROM seen s JOIN firsts f USING (line) LEFT JOIN near n USING (line) WHERE n.line IS NOT NULL OR (s.doc_id, s.line_no) <> f.f),
per AS (SELECT doc_id, list(line_no) AS nos, count(*) FILTER (WHERE near) AS n_near, count(*) FILTER (WHERE NOT near) AS n_equal FROM gone GROUP BY doc_id),
long AS (SELECT doc_id, count(*) AS n FROM seen GROUP BY doc_id)
SELECT r.doc_id, CAST(coalesce(len(r.lines), 0) AS INT) AS n_lines, CAST(coalesce(p.n_equal, 0) AS INT) AS n_equal, CAST(coalesce(p.n_near, 0) AS INT) AS n_near,
  coalesce(p.n_equal + p.n_near = l.n, false) AS emptied,
  md5(CASE WHEN p.nos IS NULL THEN r.text ELSE array_to_string(list_transform(list_filter(range(1, len(r.lines) + 1), lambda i: NOT list_contains(p.nos, i - 1)), lambda i: r.lines[i]), chr(10)) END) AS text_md5
FROM raw r LEFT JOIN per p USING (doc_id) LEFT JOIN long l USING (doc_id)
"""

#: Lines of any length may repeat; a word's edit is looked for in lines of five words or more.
_ALL_LINES = _LINES.replace("WHERE len(string_split(line, ' ')) >= 5)", "WHERE line <> '')").replace("FROM firsts, unnest(range(1, len(w) + 1)) t(i))", "FROM firsts, unnest(range(1, len(w) + 1)) t(i) WHERE len(w) >= 5)").replace("ON g.shorter = o.line)", "ON g.shorter = o.line WHERE len(o.w) >= 5)")

_REACH = """
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u AS node, u AS other FROM edges UNION SELECT r.node, b.v FROM reach r JOIN edges b ON r.other = b.u),
lowest AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
"""

_VECTORS = f"""
WITH RECURSIVE sound AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
{_REACH},
many AS (SELECT u, count(*) AS n FROM edges GROUP BY u)
SELECT e.vec_id, coalesce(m.n, 0) AS n_links, coalesce(l.component, e.vec_id) AS component_id, coalesce(l.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN many m ON m.u = e.vec_id LEFT JOIN lowest l ON l.node = e.vec_id
"""

_SHINGLES = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
{_REACH}
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component, w.doc_id) AS component_id
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN lowest l ON l.node = w.doc_id
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PHRASES = f"""
WITH docs AS (SELECT doc_id, coalesce({_TERMS}, []) AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, coalesce({_TERMS}, []) AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(i) WHERE len(w) > 0),
grams AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM docs, (SELECT DISTINCT k FROM windows), unnest(range(1, len(w) - k + 2)) t(i)),
found AS (SELECT doc_id, i, x.k, item FROM grams x JOIN windows y ON x.g = y.g AND x.k = y.k),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + k)) t(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_FORMS = """
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d FROM drawn),
formed AS (SELECT *, least(a, b) AS p, greatest(a, b) AS q, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
cut AS (SELECT *, substr(t, 1, p) AS pre, substr(t, p + 1, q - p) AS mid, substr(t, q + 1) AS suf FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut
"""

ORACLES = {"op3_line_dedup": _LINES, "op3_all_lines": _ALL_LINES, "op8_embedding_dedup": _VECTORS, "op10_ngram_join": _SHINGLES, "op11_decontamination": _PHRASES, "op12_fill_middle": _FORMS}
