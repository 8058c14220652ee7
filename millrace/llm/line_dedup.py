"""Line deduplication by a deletion-neighbourhood join, with DataFrame functions only.

The edit unit is a word: two lines of at least MIN_WORDS words are near duplicates when one word is replaced, put in
or taken out. The first occurrence in the order of (doc_id, line number) is the one to keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, fresh, written

#: Lines with fewer words have no near duplicates; whether their exact repeats go is up to ``fewest``.
MIN_WORDS = 5
#: Word hashes are taken modulo this, so that sums of two million of them fit a long.
MODULUS = 1 << 42


#: Bits of the bitmap that tells documents, and of each of its rows, as Spark's bitmap functions cut it.
BITS, ROW_BITS = 1 << 23, 1 << 15
#: White space, other than single spaces, that lines may hold.
ODD = "[\t\x0B\f\r]|  "


def told(docs: DataFrame, ids: DataFrame, doc_id: str, name: str) -> DataFrame:
    """``docs`` with ``name``: whether their id may be among ``ids`` (one column), by a bitmap of fixed size; texts are not shuffled for it.

    A few others are told too, and all where there are far more ids than bits. Null ids are not.
    """
    row, bits = fresh([*docs.columns, name], "_row", "_bits")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    at = (slot(ids.columns[0]) + 1).alias("x")
    rows = cut(ids.where(F.col(ids.columns[0]).isNotNull()).select(at).groupBy(F.bitmap_bucket_number("x").alias(row)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias(bits)))  # BITS / ROW_BITS rows at most
    place = F.pmod(slot(doc_id), F.lit(ROW_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))), F.lit(2)) == 1
    number = F.when(F.col(doc_id).isNotNull(), F.floor(slot(doc_id) / ROW_BITS) + 1)
    return docs.join(F.broadcast(rows), number == F.col(row), "left").withColumn(name, F.coalesce(bit, F.lit(False))).drop(row, bits)


def normal(line: Column, may_be_odd: Column | None = None) -> Column:
    """Lower case, words separated by one space. Most lines are that already, which plain searches tell faster; ``may_be_odd``: whether
    the line's document has other white space at all."""
    odd = F.contains(line, F.lit("  "))
    for space in "\t\n\v\f\r":
        odd = odd | F.contains(line, F.lit(space))
    odd = odd if may_be_odd is None else may_be_odd & odd
    return F.trim(F.lower(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line)))


def occurrences(docs: DataFrame, fewest: int = MIN_WORDS) -> DataFrame:
    """Every non-blank line of at least ``fewest`` words: its place, 128 bits of hash, and hashes of its halves (none below MIN_WORDS words).

    One word's edit leaves the first or the last ``h`` words alone, h being half the words of the shorter line, so two
    near duplicates share a half. A line with an even number of words may be the longer of a pair and has halves of two
    lengths; ``halves`` are their hashes.
    """
    texts = docs.where("text is not null").select("doc_id", "text", F.col("text").rlike(ODD).alias("odd"))  # once a document, not once a line
    lines = texts.select("doc_id", "odd", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select("doc_id", "line_no", normal(F.col("line"), F.col("odd")).alias("line"))
    lines = lines.withColumn("n", (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("int")).where((F.col("n") >= fewest) & (F.col("line") != ""))
    half = lambda h: f"xxhash64(0, {h}, substring_index(line, ' ', {h})), xxhash64(1, {h}, substring_index(line, ' ', -({h})))"
    odd, even = f"array({half('n DIV 2')})", f"array({half('n DIV 2')}, {half('n DIV 2 - 1')})"
    # the counts of substring_index are ints
    odd, even = (x.replace("n DIV 2", "CAST(n DIV 2 AS INT)") for x in (odd, even))
    return lines.select("doc_id", "line_no", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"), F.expr(f"CASE WHEN n < {MIN_WORDS} THEN CAST(array() AS ARRAY<BIGINT>) WHEN n % 2 = 1 THEN {odd} ELSE {even} END").alias("halves"))


def variants(lines: DataFrame) -> DataFrame:
    """The deletion neighbourhood of each line (doc_id, line_no, words): a row for each variant, as a hashed key.

    kind 0: the line itself; kind 1: a word deleted, wherever it was; kind 2: a word deleted, the others at their places.
    Equal keys of kinds 0 and 1 join a line and one with a word more, kind 2 joins lines with one word replaced. Hashes
    of words are summed, so each variant's key takes one subtraction.
    """
    hashed = lines.select(
        "doc_id",
        "line_no",
        F.size("words").alias("n"),
        F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(MODULUS))).alias("free"),
        F.transform("words", lambda w, i: F.pmod(F.xxhash64(w, i), F.lit(MODULUS))).alias("fixed"),
    )
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    sums = hashed.withColumns({"all_free": total("free"), "all_fixed": total("fixed")})
    row = lambda kind, at, key: F.struct(F.lit(kind).alias("kind"), at.alias("at"), key.alias("key"))
    itself = F.array(row(0, F.lit(-1), F.xxhash64(F.lit(0), F.col("n"), F.col("all_free"))))
    shorter = F.transform("free", lambda x, i: row(1, i, F.xxhash64(F.lit(0), F.col("n") - 1, F.col("all_free") - x)))
    replaced = F.transform("fixed", lambda x, i: row(2, i, F.xxhash64(F.lit(2), F.col("n"), i, F.col("all_fixed") - x)))
    return sums.select("doc_id", "line_no", F.inline(F.concat(itself, shorter, replaced)))


def repeated_lines(docs: DataFrame, fewest: int = MIN_WORDS) -> DataFrame:
    """Documents with lines to remove: doc_id, gone (their numbers), near (those of gone with an earlier line that differs in a
    word) and lines (how many non-blank lines of ``fewest`` words the document has)."""
    seen = written(occurrences(docs, fewest))
    first = cut(seen.groupBy("a", "b").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("times"), F.first("halves").alias("halves")))

    # lines that share a half with another line, and only those, can have a near duplicate
    halves = first.select("first.*", F.explode("halves").alias("half"))
    shared = cut(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"))
    chosen = cut(halves.join(shared, "half").select("doc_id", "line_no").distinct())
    by_doc = cut(chosen.groupBy("doc_id").agg(F.collect_list("line_no").alias("wanted")))
    wanted = told(docs.select("doc_id", "text"), by_doc.select("doc_id"), "doc_id", "wanted_too").where("wanted_too")
    lines = wanted.join(by_doc, "doc_id").select("doc_id", F.split("text", "\n").alias("all"), F.explode("wanted").alias("line_no"))
    lines = written(lines.select("doc_id", "line_no", F.split(normal(F.col("all")[F.col("line_no")]), " ").alias("words")).dropDuplicates(["doc_id", "line_no"]))

    keys = variants(lines)
    place = F.struct("doc_id", "line_no")
    groups = cut(keys.groupBy("key").agg(F.min(F.when(F.col("kind") == 2, place)).alias("center"), F.count(F.when(F.col("kind") < 2, 1)).alias("free"), F.count("*").alias("n"), F.max(F.when(F.col("kind") == 0, 1)).alias("whole")).where("n > 1 and (center is not null or (whole = 1 and free > 1))").select("key", "center"))
    alike = cut(keys.join(groups, "key"))
    replaced = alike.where("kind = 2").select(place.alias("u"), F.col("center").alias("v"), "at", F.lit(True).alias("same")).where("u <> v")
    longer, whole = alike.where("kind = 1"), alike.where("kind = 0")
    put_in = longer.select("key", place.alias("u"), "at").join(whole.select("key", place.alias("v")), "key").select("u", "v", "at", F.lit(False).alias("same"))
    pairs = replaced.unionByName(put_in)

    side = lambda n: lines.select(F.struct("doc_id", "line_no").alias(n), F.col("words").alias(f"w{n}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    head = F.expr("slice(wu, 1, at)")
    tail = F.expr("slice(wu, at + 2, size(wu))")
    equal = F.when(F.col("same"), (head == F.expr("slice(wv, 1, at)")) & (tail == F.expr("slice(wv, at + 2, size(wv))"))).otherwise(F.concat(head, tail) == F.col("wv"))
    near = cut(both.where(equal).select(F.greatest("u", "v").alias("first")).distinct())

    # a near duplicate goes wherever it occurs; of equal lines all but the first go
    gone = first.join(near.withColumn("near", F.lit(True)), "first", "left").where("times > 1 or near").select("a", "b", "first", F.coalesce("near", F.lit(False)).alias("near"))
    places = seen.select("doc_id", "line_no", "a", "b")
    removed = places.join(cut(gone), ["a", "b"], "left").withColumn("gone", F.coalesce((place != F.col("first")) | F.col("near"), F.lit(False)))
    numbers = lambda which: F.collect_set(F.when(which, F.col("line_no")))
    out = removed.groupBy("doc_id").agg(numbers(F.col("gone")).alias("gone"), numbers(F.col("gone") & F.col("near")).alias("near"), F.count_distinct("line_no").alias("lines"))
    return out.where(F.size("gone") > 0)


def without_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fewest: int = MIN_WORDS, prefix: str = "") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and n_lines, n_equal, n_near (lines removed) and emptied.

    emptied: the text had non-blank lines of at least ``fewest`` words and has lost them all. A null text stays null and
    an empty one empty; rows of one doc_id count as the same document; rows without a doc_id are compared with nothing
    and stay as they are; blank lines and those of fewer than ``fewest``
    words stay (1: exact repeats of every non-blank line go; a word's edit is looked for from MIN_WORDS words on, or from
    ``fewest`` if that is more); an empty table gives no rows. All columns are carried in one join; names of the four
    results begin with ``prefix`` and replace columns of the same name.
    """
    results = [prefix + n for n in ("n_lines", "n_near", "n_equal", "emptied")]
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    key, gone, near, long, lines, kept, known = fresh([*docs.columns, *results], "_key", "_gone", "_near", "_long", "_lines", "_kept", "_known")
    found = repeated_lines(plain, fewest).select(F.col("doc_id").alias(key), F.col("gone").alias(gone), F.col("near").alias(near), F.col("lines").alias(long))
    found = cut(found)
    # documents that lose no line go past the join
    marked = told(docs, found.select(key), doc_id, known)
    past = marked.where(~F.col(known)).withColumns({f.name: F.lit(None).cast(f.dataType) for f in found.schema.fields})
    both = marked.where(known).join(found, F.col(doc_id) == F.col(key), "left").unionByName(past).drop(known).withColumn(lines, F.split(text, "\n"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.col(lines)[i])
    both = both.withColumn(kept, F.when(F.col(gone).isNotNull(), left))
    removed = F.coalesce(F.size(gone), F.lit(0))
    values = [F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size(near), F.lit(0)), removed - F.coalesce(F.size(near), F.lit(0)), F.coalesce(F.size(gone) == F.col(long), F.lit(False))]
    out = dict(zip(results, values, strict=True)) | {text: F.when(F.col(kept).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text))}
    return both.withColumns(out).drop(key, lines, gone, near, long, kept)
