"""Which of many keywords a text contains: one pass over each text, whatever the number of keywords."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.tables import kept

#: Bytes of keywords that one automaton holds and every task gets; more are searched for block by block.
KEYWORD_BYTES = 8 << 20


def _automaton(words: list[tuple[int, str]]) -> ahocorasick.Automaton:
    """Keywords with the first place of each in the order."""
    out = ahocorasick.Automaton()
    for seq, word in sorted(words, reverse=True):  # the first comes last and stays
        out.add_word(word, seq)
    if len(out):
        out.make_automaton()
    return out


def _blocks(keywords: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """Keywords (seq, keyword) in blocks of about ``most`` bytes; those without a text or place are left out."""
    words = kept(keywords.where("seq IS NOT NULL AND keyword IS NOT NULL").groupBy("keyword").agg(F.min("seq").cast("long").alias("seq")))
    total = words.agg(F.coalesce(F.sum(F.octet_length("keyword")), F.lit(0))).first()[0]
    many = max(1, -(-total // most))
    for k in range(many):
        yield [(r["seq"], r["keyword"]) for r in words.where(F.pmod(F.xxhash64("keyword"), F.lit(many)) == k).collect()]


def first_keyword(texts: DataFrame, text: str, keywords: DataFrame, name: str = "first", most: int = KEYWORD_BYTES) -> DataFrame:
    """``texts`` with ``name``: the lowest ``seq`` of the keywords (seq, keyword) that the text contains, null for none.

    As a chain of searches in the order of seq would find it, in one pass over each text and without a row per pair. Of
    keywords over ``most`` bytes together one block after another is searched for. An empty keyword is in every text, a null text contains none.
    """
    out = None
    for words in _blocks(keywords, most):
        table = texts.sparkSession.sparkContext.broadcast([w for w in words if w[1]])  # at most about ``most`` bytes
        every = min((s for s, w in words if not w), default=None)
        schema = T.StructType([*texts.schema.fields, T.StructField("_found", T.LongType())])

        def search(batches: Iterator[pa.RecordBatch], table=table, every=every) -> Iterator[pa.RecordBatch]:
            own = _automaton(table.value)
            for b in batches:
                found = []
                for t in b.column(b.schema.get_field_index(text)).to_pylist():
                    seqs = [s for _, s in own.iter(t)] if t and len(own) else []
                    found.append(min([*seqs, *([every] if every is not None and t is not None else [])], default=None))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], names=[*b.schema.names, "_found"])

        part = (texts if out is None else out.drop("_found").withColumnRenamed(name, "_before")).select("*")
        if out is None:
            out = part.mapInArrow(search, schema).withColumn(name, F.col("_found"))
        else:
            wider = T.StructType([*texts.schema.fields, T.StructField("_before", T.LongType()), T.StructField("_found", T.LongType())])
            out = part.mapInArrow(search, wider).withColumn(name, F.least("_before", "_found")).drop("_before")
    return out.drop("_found").select(*texts.columns, name)
