"""Quality rules with thresholds learned per language and source from mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, in_pieces, mixed, multipliers, small_batches, text_bytes, window_hashes, word_hashes, words_of, written

SYMBOLS = b"#*$%&|<>"
#: metric: (numerator, denominator, spreads above the upper quantile that are allowed, tenths of the upper quantile, numerator
#: that one event makes, whether room above the limit is by events). The base rule takes away the documents that could drag repeat_rate's ninth decile.
RULES = {
    "symbol_rate": ("n_symbols", "n_words", 8, 8, 1, True),
    "repeat_rate": ("n_repeat_words", "n_words", 8, 9, 10, False),
    "dup_line_rate": ("n_dup_lines", "n_lines", 8, 8, 1, True),
    "upper_rate": ("n_upper", "word_chars", 8, 8, 1, False),
    "shout_rate": ("n_shouts", "n_words", 8, 8, 1, True),
    "word_length": ("word_chars", "n_words", 8, 8, 0, False),
}
#: Room above a learned limit. Metrics that are 0 in most documents, and whose quantiles are then 0: so many events in a document of
#: the group's median size. Others, whose quantiles tell groups apart: a tiny guard, in per mille.
EVENTS, GUARD = 2, 20
#: Sizes whose medians are learned with the metrics.
SIZES = ("n_words", "n_lines", "word_chars")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts")
#: So many documents' worth of its language's sketch is added to each group's, and of that of all documents to each language's: a
#: small group's limits lie near its language's, a large group's are its own.
PRIOR = 200


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each whole text (null: none), from its bytes."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    starts, ends, rows = words_of(data, offsets)

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def marked(chars: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(chars)] = True
        return table[data]

    points = (data & 0xC0) != 0x80
    spaces = marked(bytes([9, 10, 11, 12, 13, 32]))
    out = {"n_words": np.bincount(rows, minlength=n), "word_chars": per_text(points & ~spaces), "n_symbols": per_text(marked(SYMBOLS)), "n_upper": per_text((data >= 65) & (data <= 90)), "n_shouts": per_text(data == 33)}

    # lines: cut at each newline and at the bounds of texts; only those with a word count
    begins = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    begins = begins[begins < len(data)]
    stops = np.concatenate([begins[1:], [len(data)]]).astype(np.int64)
    owner = np.searchsorted(offsets, begins, side="right") - 1
    stops -= (stops > begins) & (data[np.maximum(stops - 1, 0)] == 10)
    worded = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
    begins, stops, owner = begins[worded], stops[worded], owner[worded]
    out["n_lines"] = np.bincount(owner, minlength=n)
    salt = multipliers(n + 1, 99)
    lines = mixed(word_hashes(data, begins, stops) + salt[owner])
    _, firsts = np.unique(lines, return_index=True)
    again = np.ones(len(lines), bool)
    again[firsts] = False
    out["n_dup_lines"] = np.bincount(owner[again], minlength=n)

    windows, in_row, at = window_hashes(word_hashes(data, starts, ends), rows, 5)
    keys = mixed(windows + salt[in_row])
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    out["n_repeat_words"] = np.bincount(rows[np.cumsum(cover)[:-1] > 0], minlength=n)
    return out


def counted(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns to ``keep`` and the COUNTS of every whole text."""
    small_batches(docs.sparkSession)
    chosen = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in chosen.drop("_text").dtypes), *(f"{c} long" for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "_text"):
            counts = text_counts(b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], names=[*keep, *COUNTS])

    return chosen.mapInArrow(run, schema)


def sketch_bin(value: str) -> str:
    """SQL for the bin of a whole number: exact below 256, then 128 bins for each power of two, so that median and upper quantile of word_length don't share one."""
    return f"CASE WHEN {value} < 256 THEN {value} ELSE (length(bin({value})) - 8) * 128 + shiftright({value}, length(bin({value})) - 8) END"


def bin_top(b: str) -> str:
    """SQL for the largest value of a bin."""
    return f"CASE WHEN {b} < 256 THEN {b} ELSE shiftleft(({b}) % 128 + 129, CAST(({b}) DIV 128 - 1 AS INT)) - 1 END"


def quantile_sketches(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Per group and metric or size, how many documents fall in each bin. Adding up the counts merges sketches."""
    names = [*RULES, *SIZES]
    stacked = ", ".join(f"'{m}', CAST({m} AS BIGINT)" for m in names)
    return metrics.selectExpr(*by, f"stack({len(names)}, {stacked}) AS (metric, value)").selectExpr(*by, "metric", f"CAST({sketch_bin('value')} AS INT) AS bin").groupBy(*by, "metric", "bin").agg(F.count("*").alias("n"))


def _blended(sketches: DataFrame, prior: int) -> DataFrame:
    """Weights (lang, source, metric, bin, n) of each group's sketch with ``prior`` documents' worth of its language's, which has as many of all documents'.

    Whole numbers: group * languages' total + prior * language, and the same one level up. The tables are of sketches, never of documents.
    """
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)")
    k = F.lit(prior).cast("decimal(38,0)")
    every = sketches.groupBy("metric", "bin").agg(F.sum("n").alias("n_o"))
    total = every.groupBy(F.col("metric").alias("m")).agg(F.sum("n_o").alias("t_o"))
    every = every.join(total, F.col("metric") == F.col("m")).drop("m")
    of_lang = sketches.groupBy(F.col("lang").alias("l"), F.col("metric").alias("lm"), F.col("bin").alias("lb")).agg(F.sum("n").alias("n_l"))
    langs = sketches.select(F.col("lang").alias("kl"), F.col("metric").alias("km")).distinct().join(every, F.col("km") == F.col("metric"))
    langs = langs.join(of_lang, F.col("kl").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("lm")) & (F.col("bin") == F.col("lb")), "left")
    langs = langs.select("kl", "metric", "bin", (number("n_l") * number("t_o") + k * number("n_o")).cast("decimal(38,0)").alias("w_l"))
    whole = langs.groupBy(F.col("kl").alias("tl"), F.col("metric").alias("tm")).agg(F.sum("w_l").cast("decimal(38,0)").alias("t_l"))
    langs = langs.join(whole, F.col("kl").eqNullSafe(F.col("tl")) & (F.col("metric") == F.col("tm"))).drop("tl", "tm")
    own = sketches.select(F.col("lang").alias("gl"), F.col("source").alias("gs"), F.col("metric").alias("gm"), F.col("bin").alias("gb"), F.col("n").alias("n_g"))
    groups = sketches.select("lang", "source", F.col("metric").alias("km")).distinct().join(langs, F.col("lang").eqNullSafe(F.col("kl")) & (F.col("km") == F.col("metric")))
    groups = groups.join(own, F.col("lang").eqNullSafe(F.col("gl")) & F.col("source").eqNullSafe(F.col("gs")) & (F.col("metric") == F.col("gm")) & (F.col("bin") == F.col("gb")), "left")
    return groups.select("lang", "source", "metric", "bin", (number("n_g") * F.col("t_l") + k * F.col("w_l")).cast("decimal(38,0)").alias("n"))


def _limits(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Median and upper quantile of each sketch, and the limit they give for its metric."""
    whole = Window.partitionBy(*by, "metric")
    seen = sketches.withColumn("upto", F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(whole))
    tenths = F.create_map(*(x for m in [*RULES, *SIZES] for x in (F.lit(m), F.lit(RULES[m][3] if m in RULES else 5))))[F.col("metric")]
    at = lambda tenths: F.min(F.when(F.col("upto") * 10 >= F.col("total") * tenths, F.expr(bin_top("bin"))))
    cuts = seen.withColumn("tenths", tenths).groupBy(*by, "metric").agg(at(5).alias("middle"), at(F.col("tenths")).alias("high"))
    of = lambda c, m: F.max(F.when(F.col("metric") == m, F.col(c)))
    limits = []
    for m, (_, size, spreads, _, event, by_events) in RULES.items():
        room = F.floor(F.lit(EVENTS * event * 1000) / F.greatest(of("middle", size), F.lit(1))) if by_events else F.lit(GUARD)
        limits.append((of("high", m) + (of("high", m) - of("middle", m)) * spreads + room).cast("long").alias(m))
    return cuts.groupBy(*by).agg(*limits)


def judged(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source", prior: int = PRIOR) -> DataFrame:
    """Counts, base verdict and the verdict by learned thresholds for every document.

    Each metric's limit is an upper quantile among the documents of the language and source that pass the base rule,
    plus eight times its distance from the median and a little room (by the group's median size or GUARD); bad documents move it only where they are more than a
    fifth of those (a tenth for repeat_rate). A numerator that a single event makes is never too much. Sketches of languages and of all documents are merged from those of the groups, and
    ``prior`` documents' worth of them is added one level down, so that each group has limits of its own, the smaller it is the nearer to its language's. Null languages and sources are groups of their own. A null or empty text has no
    words and fails the base rule. Repeated rows are judged alike; rows without an id are judged too; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("_t"))
    counts = written(counted(rows, "_t"))
    rates = {m: F.when(F.col(d) > 0, F.floor(F.col(n) * 1000 / F.col(d))).otherwise(0).cast("long") for m, (n, d, *_) in RULES.items()}
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rated = counts.withColumns(rates).withColumn("base_failed", base)
    sketches = cut(quantile_sketches(rated.where("not base_failed"), ["lang", "source"]))
    own = _limits(_blended(sketches, prior), ["lang", "source"])
    limits = cut(own.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(F.col(m).alias(f"most_{m}") for m in RULES)))
    both = rated.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    good = F.lit(True)
    for m, (n, _, _, _, event, _) in RULES.items():
        good = good & ((F.col(m) <= F.coalesce(F.col(f"most_{m}"), F.col(m))) | (F.col(n) <= event))
    return both.withColumn("kept", ~F.col("base_failed") & good).drop("g_lang", "g_source")
