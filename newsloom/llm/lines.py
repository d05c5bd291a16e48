"""Removal of lines that many documents share, in DataFrame operations only.

Line hashes are range-partitioned, with document and position as the secondary sort, so one pass over each partition meets
the places of a line one after the other and tells new documents from repeats. Hashes are salted by document, with as many
salts as four times the shuffle partitions, so that the places of a very common line are spread over many ranges. What comes back is a keep bitmap for each document that loses
lines, as run lengths (kept, dropped, kept, ...); text is read again only where the bitmaps are applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import cut

MIN_DOCS = 10
MIN_CHARS = 1
#: Salts of a line at least.
SALTS = 64
_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without [\\x20\\x09-\\x0D] at its ends, A-Z in lower case."""
    line = F.btrim(line, F.lit(_SPACE))
    # lower() is quick but knows other letters too, so it takes ASCII alone
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, _UPPER, _UPPER.lower()))


def line_array(text: Column) -> Column:
    """Lines of a text; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_mark() -> Column:
    """Tells apart the texts of rows that repeat a doc_id."""
    return F.hash(F.coalesce(F.col("text"), F.lit("")))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, g, doc_id, text_mark, pos) of each line whose key has min_chars code points: 96 bits of hash."""
    lines = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), text_mark().alias("text_mark"), F.posexplode(line_array(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_mark", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h"), F.hash("key").alias("g"), "doc_id", "text_mark", "pos")


def line_frequencies(hashes: DataFrame) -> DataFrame:
    """(h, g, n_docs, first): the documents that have a line, and where it comes first (doc_id, text_mark, pos)."""
    salts = max(SALTS, 4 * int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = hashes.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    order = ["doc_id", "text_mark", "pos"]
    ranged = salted.repartitionByRange("h", "g", "salt").sortWithinPartitions("h", "g", "salt", *order)
    stream = Window.partitionBy("h", "g", "salt").orderBy(*order)
    marked = ranged.withColumn("before", F.lag("doc_id").over(stream)).filter("before is null or before != doc_id")
    return marked.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct(*order)).alias("first"))


def line_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_mark, keep_runs array<int>) of each document that loses lines: how many lines in turn stay, go, stay, ...; lines
    after the last run stay. With keep_first the first place of a line stays (in the smallest doc_id, at the first position).
    ``counted`` (doc_id) limits the documents in which a line is counted, not those that lose it."""
    # read once, for the ranges' bounds, the frequencies and the places
    hashes = cut(line_hashes(docs, min_chars))
    if keep_first and min_docs <= 1:
        raise ValueError("keep_first needs min_docs of 2 or more")
    # cut, so that the join below has plain exchanges on both sides and a very common line can be split
    voters = hashes if counted is None else hashes.join(counted.select(F.col("doc_id").cast("long")), "doc_id", "left_semi")
    common = cut(line_frequencies(voters).filter(F.col("n_docs") >= min_docs))
    if keep_first:
        dropped = hashes.join(common, ["h", "g"]).filter(F.struct("doc_id", "text_mark", "pos") != F.col("first"))
    else:
        dropped = hashes.join(common.select("h", "g"), ["h", "g"], "left_semi")
    per_doc = dropped.groupBy("doc_id", "text_mark").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    # one character a line up to the last dropped one, then lengths of its runs
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("gone", i - 1))
    marks = F.array_join(F.transform("gone", lambda x, i: F.concat(F.repeat(F.lit("1"), x - before(i) - 1), F.lit("0"))), "")
    runs = F.transform(F.regexp_extract_all("marks", F.lit("1+|0+"), 0), F.length)
    kept_head = F.when(F.col("marks").startswith("0"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return per_doc.select("doc_id", "text_mark", marks.alias("marks")).select("doc_id", "text_mark", F.concat(kept_head, runs).alias("keep_runs"))


def keep_lines(lines: Column, keep_runs: Column) -> Column:
    """The lines that a keep bitmap keeps."""
    flags = F.flatten(F.transform(keep_runs, lambda n, i: F.array_repeat(i % 2 == 1, n)))
    zipped = F.arrays_zip(lines.alias("line"), flags.alias("gone"))
    return F.transform(F.filter(zipped, lambda z: z["line"].isNotNull() & ~F.coalesce(z["gone"], F.lit(False))), lambda z: z["line"])


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """docs with text replaced by the lines that stay, joined by \\n, and with n_lines (before) and n_dropped.

    A line's key is line_key(); lines whose key has min_chars code points and stands in min_docs documents or more lose all
    their places (all but the first with keep_first). A null or empty text is one empty line, so a null text comes back
    empty. Rows that repeat a doc_id count as one document, and each of their texts loses its own lines. Rows with a null
    doc_id are kept whole and don't count. Other columns are kept; columns named n_lines or n_dropped are replaced. An empty
    table gives no rows.
    """
    bitmaps = line_bitmaps(docs, min_docs, min_chars, keep_first, counted)
    bitmaps = bitmaps.select(F.col("doc_id").alias("_bitmap_doc"), F.col("text_mark").alias("_bitmap_mark"), F.col("keep_runs").alias("_keep_runs"))
    joined = docs.join(bitmaps, (F.col("doc_id").cast("long") == F.col("_bitmap_doc")) & (text_mark() == F.col("_bitmap_mark")), "left")
    lines = line_array(F.col("text"))
    kept = F.when(F.col("_keep_runs").isNull(), lines).otherwise(keep_lines(lines, F.col("_keep_runs")))
    out = joined.withColumn("_lines", lines).withColumn("_kept", kept)
    return (
        out.withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dropped", (F.size("_lines") - F.size("_kept")).cast("long"))
        .withColumn("text", F.array_join("_kept", "\n"))
        .drop("_bitmap_doc", "_bitmap_mark", "_keep_runs", "_lines", "_kept")
    )
