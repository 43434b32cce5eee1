"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, substring dedup, packing.

``STAGES`` lists (name, function).  A function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next one's docs.  All but the last return the columns of ``documents``, with ``n_chars``
following the text; the last returns pieces of packed sequences.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, line_dedup, packing, quality, simhash, substring_dedup
from lodestone.shipping import ship

TOKENIZER = "word_bpe_49k.json"
#: A packing stage needs a tokenizer and a near-duplicate stage hashes no SQL engine has: tested by brute force.
ORACLE_SQL = None

_done: list[str] = []


def _stage(f):
    """What a stage left in the shared folder goes when the next one starts: its result has been written by then."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        common.drop_staged(spark, *_done)
        before = set(common.staged())
        out = f(spark, docs, sf_dir)
        _done[:] = [p for p in common.staged() if p not in before]
        return out

    return run_stage


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with its columns renamed to c0, c1, .. so that none clashes with an operator's, and the names of id and text."""
    at = [c.lower() for c in docs.columns]
    return docs.toDF(*[f"c{i}" for i in range(len(at))]), f"c{at.index('doc_id')}", f"c{at.index('text')}"


def _named(docs: DataFrame, found: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of ``docs`` from their numbered forms; with another text, ``n_chars`` of it where there is that column."""
    own = {} if text is None else {"text": F.col(text), "n_chars": F.char_length(text).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return found.select(*[own.get(c.lower(), F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v1; rejected ones go.

    Every row is judged by itself, whatever its id (NULL and repeated ids too); NULL and empty texts have too few words and
    go; other columns pass through unread under any name; an empty table gives an empty one.
    """
    rows, _, text = _numbered(docs)
    others = tuple(c for c in rows.columns if c != text)
    return _named(docs, quality.quality_rules(spark, rows, "v1", text_col=text, keep=others, carry_text=True).filter("kept"))


@_stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that go.

    All rows stay.  NULL text becomes one empty line; rows without an id lose no lines and count for no key; rows that
    repeat an id are one document with bitmaps of their own; other columns pass through under any name; an empty table gives
    an empty one.
    """
    rows, key, text = _numbered(docs)
    return _named(docs, line_dedup.line_dedup(spark, rows, key, text), "kept_text")


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest row of each near-duplicate component by (doc_id, hash of the text), and every row without an id.

    Rows that repeat an id stand for themselves: those with different texts stay unless they are near copies, and of rows
    equal in id and text one stays.  Texts without a word are copies of each other.  Other columns pass through under any
    name; an empty table gives an empty one.
    """
    rows, key, text = _numbered(docs)
    rows = rows.withColumn("h", F.xxhash64(F.coalesce(text, F.lit(""))))
    named = rows.filter(F.col(key).isNotNull())
    keyed = rows.select(F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("d"), "h")).alias("id"), F.col(text).alias("text"))
    found = simhash.near_components(spark, keyed, "id")
    keep = found.filter("id = component").select(F.col("id.d").alias(key), F.col("id.h").alias("h")).distinct()
    named = named.join(keep.hint("merge"), [key, "h"], "left_semi").dropDuplicates([key, "h"])
    return _named(docs, named.unionByName(rows.filter(F.col(key).isNull())))


@_stage
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated 50-word windows.

    All rows stay, even where no word does.  NULL text becomes the empty text; rows without an id neither lose words nor
    cost others theirs; rows that repeat an id are one document; other columns pass through under any name; an empty table
    gives an empty one.
    """
    rows, key, text = _numbered(docs)
    others = tuple(c for c in rows.columns if c != text)
    return _named(docs, substring_dedup.substring_dedup(spark, rows, key, text, keep=others, with_text=True), "kept")


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens: every row's ids once, NULL and repeated ids included; NULL text is the
    end id alone; other columns are not read; an empty table gives no piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        after = common.stage(spark, f(spark, docs, sf_dir), name.replace(" ", "-"))
        if hasattr(docs, "_lodestone_path"):
            common.drop_staged(spark, docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
