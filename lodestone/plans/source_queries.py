"""Canonical parsing, materialization, files and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import canonical as P
from lodestone.operators import detect as D
from lodestone.operators import materialize as M
from lodestone.plans.detection_queries import candidates_input
from lodestone.plans.registry import Registry, table
from lodestone.shipping import ship
from lodestone.sources import io
from lodestone.streaming import ingest

query = Registry()


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("content"))
    return P.with_sections(P.elements(pages, "html"))


@query("canonical_html_elements")
def canonical_html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of every page with kind, section path and reason for being left out."""
    e = _elements(spark, sf_dir)
    return e.select("doc_id", "seq", "kind", "role", "section_id", F.array_join("section_path", " > ").alias("section_path"), F.sha2("clean_text", 256).alias("clean_sha"), "excluded_reason")


@query("canonical_documents")
def canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents of all pages, with sizes of their collections."""
    d = P.documents(_elements(spark, sf_dir))
    return d.select("doc_id", "title", *[F.size(c).alias(f"n_{c}") for c in ("sections", "paragraphs", "objects", "uncertain_elements")], F.to_json("excluded_counts").alias("excluded"), "n_errors")


@query("materialize_instances")
def materialize_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric instances with their exclusion reasons."""
    d = D.detect_numbers(candidates_input(spark, sf_dir))
    return M.materialize(d, F.col("accepted"), "materialize").select("instance_id", "doc_id", "position", "answer", "context", "exclusion")


@query("checksum_manifest")
def checksum_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of all files of all tables."""
    ship(spark)
    return io.checksums(spark, sf_dir)


@query("event_windows", """SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n, floor(sum(value) * 1e4 + 0.5) / 1e4 AS total FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event counts by the streaming aggregation, run as a batch (an extension)."""
    w = ingest.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "value")
    return w.select("start", "kind", "n", (F.floor(F.col("total") * 1e4 + 0.5) / 1e4).alias("total"))
