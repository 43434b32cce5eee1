"""Line dedup with DataFrame functions only.

Line keys become 128-bit hashes that are dealt out by range of (hash, document), sorted by (hash, document,
position) and streamed: the first occurrence of a key in a document counts the document, partial sums per key
meet in one small shuffle, and what leaves the search is a compressed keep bitmap per document, its runs of kept
lines, never text.  A key that a third of all lines share spreads over as many ranges as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import drop_staged, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIPPED = " \t\n\x0b\x0c\r"
TO_END = 1 << 30
OWN = ("kept_text", "n_lines", "n_dropped")


def line_key(line: Column) -> Column:
    """The line without white space at both ends and with A-Z in lower case; other letters stay."""
    bare = F.trim(line, F.lit(STRIPPED))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, row_key, pos) of every line whose key has at least ``min_chars`` code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("row_key"), F.posexplode(F.split(text, "\n")).alias("pos", "line")
    )
    keyed = lines.filter(F.octet_length("line") >= min_chars).select("doc", "row_key", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "row_key", "pos"
    )


def keep_bitmaps(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, row_key, keep, n_dropped): which lines stay, as a run-length coded bitmap per document row.

    A line's key must have ``min_chars`` code points and occur in ``min_docs`` documents; its lines stay only
    in the largest document holding it.  ``keep`` lists the runs (at, n) of lines that stay; the last run has no end
    and n = ``TO_END``.  Documents that keep all have no row.  ``row_key`` is the xxhash64 of the text, so that rows
    repeating an id with another text keep bitmaps of their own.
    """
    lines = stage(spark, hashed_lines(docs, id_col, text_col, min_chars), "line-hashes")
    ordered = lines.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos")
    nth = F.row_number().over(Window.partitionBy("h1", "h2", "doc").orderBy("pos"))
    firsts = ordered.withColumn("nth", nth).filter("nth = 1")
    keys = firsts.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper")).filter(F.col("n_docs") >= min_docs)
    keys = stage(spark, keys.select("h1", "h2", "keeper"), "line-keys")
    dropped = lines.join(keys, ["h1", "h2"]).filter("doc <> keeper")
    gone = dropped.groupBy("doc", "row_key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    begins = F.concat(F.array(F.lit(0)), F.transform("gone", lambda x: x + 1))
    runs = F.zip_with(begins, F.col("gone"), lambda at, to: F.struct(at.alias("at"), F.coalesce(to - at, F.lit(TO_END)).alias("n")))
    maps = gone.select("doc", "row_key", F.filter(runs, lambda r: r["n"] > 0).alias("keep"), F.size("gone").cast("long").alias("n_dropped"))
    out = stage(spark, maps, "line-bitmaps")
    drop_staged(spark, lines, keys)
    return out


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``; NULL text counts as one empty line."""
    names = docs.columns
    at = [c.lower() for c in names]
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.coalesce(F.col(f"c{at.index(text_col.lower())}"), F.lit(""))
    rows = rows.withColumn("doc", F.col(f"c{at.index(id_col.lower())}")).withColumn("row_key", F.xxhash64(text))
    both = rows.join(bitmaps.select("doc", "row_key", "keep", "n_dropped").hint("merge"), ["doc", "row_key"], "left")
    lines = F.split(text, "\n")
    kept = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice(lines, r["at"] + 1, r["n"]))), "\n")
    return both.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c.lower() not in OWN],
        F.when(F.col("keep").isNull(), text).otherwise(kept).alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
    )


def line_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Every row of ``docs`` with its text after line dedup (``kept_text``), ``n_lines`` and ``n_dropped``.

    Defined cases: NULL or empty text is one empty line and keeps it; a NULL id neither counts as a document nor
    loses lines; rows repeating an id are one document; an empty table gives an empty result; other columns pass
    through unread under any name, but those named like a result give way to it.
    """
    renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = [c.lower() for c in docs.columns]
    bitmaps = keep_bitmaps(spark, renamed, f"c{at.index(id_col.lower())}", f"c{at.index(text_col.lower())}", min_chars, min_docs)
    return apply_bitmaps(docs, bitmaps, id_col, text_col)
