"""Paragraph tables and corpus audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Non-empty cleaned lines with their position and positional id (``<doc>:p000001``).

    Positions are found inside the document's own array, so no shuffle is needed.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.struct(x.alias("raw"), T.ascii_clean(x).alias("clean")))
    kept = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.filter(lines, lambda x: x["clean"] != "")).alias("position", "p"))
    pid = F.concat(F.col("doc_id").cast("string"), F.lit(":p"), F.lpad((F.col("position") + 1).cast("string"), 6, "0"))
    return kept.select("doc_id", F.col("position").cast("long").alias("position"), pid.alias("paragraph_id"), F.col("p.raw").alias("raw_text"), F.col("p.clean").alias("clean_text"))


def document_metrics(paras: DataFrame) -> DataFrame:
    """Counts and coverage per document."""
    return paras.groupBy("doc_id").agg(
        F.count("*").alias("n_paragraphs"),
        F.sum(F.char_length("clean_text").cast("long")).alias("clean_chars"),
        F.sum(F.char_length("raw_text").cast("long")).alias("raw_chars"),
        F.max(F.char_length("clean_text").cast("long")).alias("longest"),
        F.sum(F.when(F.char_length("clean_text") >= 200, 1).otherwise(0)).cast("long").alias("n_long"),
        F.count_if(T.reference_like(F.col("clean_text"))).alias("n_reference_like"),
    )


def guarded_ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL where the denominator is zero."""
    return T.round6(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per category, NULL as ``unavailable``."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unavailable")).alias("category")).agg(F.count("*").alias("n"))


def fragment_groups(paras: DataFrame, min_chars: int = 200, min_docs: int = 2) -> DataFrame:
    """Groups of equal normalised fragments that occur in several documents.

    Fragments are counted per document first, so that a fragment everywhere is partial sums and not one group.
    """
    norm = paras.select("doc_id", T.key(F.col("clean_text")).alias("fragment")).filter(F.length("fragment") >= min_chars)
    keyed = norm.select("doc_id", F.sha2("fragment", 256).alias("fragment_sha"), F.length("fragment").cast("long").alias("chars"))
    each = keyed.groupBy("fragment_sha", "doc_id").agg(F.count("*").alias("n"), F.max("chars").alias("chars"))
    found = each.groupBy("fragment_sha").agg(F.sum("n").alias("n_members"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("chars").alias("fragment_chars"))
    return found.filter(F.col("n_docs") >= min_docs)


def repeated_fragments(paras: DataFrame, per_page: int = 5, min_pages: int = 3) -> DataFrame:
    """Short fragments (20-200 characters) on several pages of one document (running heads and the like)."""
    norm = paras.select("doc_id", (F.col("position") / per_page).cast("long").alias("page"), T.key(F.col("clean_text")).alias("fragment"))
    norm = norm.filter(F.length("fragment").between(20, 200))
    out = norm.groupBy("doc_id", "fragment").agg(F.countDistinct("page").alias("n_pages"), F.count("*").alias("n"))
    return out.filter(F.col("n_pages") >= min_pages).groupBy("doc_id").agg(F.count("*").alias("n_fragments"), F.sum("n").alias("n_members"))


def collisions(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Keys shared by several ids: (key, n, first id)."""
    return df.select(key.alias("key"), F.col(id_col).alias("id")).filter("key <> ''").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def sum_maps(df: DataFrame, column: str) -> DataFrame:
    """Element-wise sum of map columns: (key, total)."""
    return df.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def five_numbers(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, exact linear-interpolated quartiles, P95 and extremes of a column."""
    p = F.expr(f"percentile({value}, array(0.25, 0.5, 0.75, 0.95))")
    out = df.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), p.alias("p"))
    return out.select(
        *(by or []), "n", T.round6(F.col("mean")).alias("mean"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"),
        *[T.round6(F.col("p")[i]).alias(n) for i, n in enumerate(("p25", "p50", "p75", "p95"))],
    )


def gates(checks: dict[str, Column], df: DataFrame) -> DataFrame:
    """One row per named check with whether every row passes it, and how many fail."""
    agg = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    rows = agg.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("n_failed")) for n in checks])).alias("g"))
    return rows.select("g.gate", "g.n_failed", (F.col("g.n_failed") == 0).alias("passed"))


def validate(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows with the list of the failed checks' names, comma-joined in the order given."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks.items()]))
    return df.withColumn("errors", F.array_join(failed, ",")).withColumn("n_errors", F.size(failed).cast("long"))


def first_failing(rules: dict[str, Column]) -> Column:
    """The name of the first rule that rejects, in the order given; NULL where none does."""
    return F.coalesce(*[F.when(c, n) for n, c in rules.items()])
