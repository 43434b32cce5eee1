"""Corpus building and audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import corpus as C
from lodestone.plans.registry import Registry, table

query = Registry()

#: The paragraphs of documents, for the oracles below.
PARAS = r"""
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw_text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents),
c AS (SELECT *, trim(regexp_replace(regexp_replace(raw_text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t\n\r]+', ' ', 'g')) AS clean_text FROM l),
paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS position, raw_text, clean_text FROM c WHERE clean_text <> '')
"""
R6 = "floor(({0})::DOUBLE * 1e6 + 0.5) / 1e6"


def _paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.paragraphs(table(spark, sf_dir, "documents"))


@query("corpus_paragraphs", f"WITH {PARAS} SELECT doc_id, position, doc_id || ':p' || lpad((position + 1)::VARCHAR, 6, '0') AS paragraph_id, sha256(clean_text) AS clean_sha, length(clean_text) AS n_chars FROM paras")
def corpus_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, numbered paragraphs."""
    return _paras(spark, sf_dir).select("doc_id", "position", "paragraph_id", F.sha2("clean_text", 256).alias("clean_sha"), F.char_length("clean_text").cast("long").alias("n_chars"))


_REF = r"regexp_matches(lower(clean_text), '^(?:\[?[0-9]{1,3}\]?\s*[.)]|references?\b|bibliography\b)|\bdoi\s*:\s*10\.[0-9]{4,9}/')"


@query(
    "corpus_clean_metrics",
    f"""WITH {PARAS} SELECT doc_id, count(*) AS n_paragraphs, sum(length(clean_text))::BIGINT AS clean_chars, sum(length(raw_text))::BIGINT AS raw_chars,
      max(length(clean_text)) AS longest, count(*) FILTER (length(clean_text) >= 200) AS n_long, count(*) FILTER ({_REF}) AS n_reference_like,
      {R6.format('sum(length(clean_text)) / sum(length(raw_text))')} AS retention FROM paras GROUP BY doc_id""",
)
def corpus_clean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-document counts with the share of characters kept."""
    m = C.document_metrics(_paras(spark, sf_dir))
    return m.withColumn("retention", C.guarded_ratio(F.col("clean_chars"), F.col("raw_chars")))


@query(
    "corpus_token_retention",
    rf"""WITH {PARAS}, t AS (SELECT len(regexp_extract_all(raw_text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]')) AS r, len(regexp_extract_all(clean_text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]')) AS c FROM paras)
      SELECT count(*) AS n_paragraphs, sum(r)::BIGINT AS raw_tokens, sum(c)::BIGINT AS clean_tokens, {R6.format('sum(c) / sum(r)')} AS retention FROM t""",
)
def corpus_token_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens before and after cleaning."""
    t = _paras(spark, sf_dir).agg(F.count("*").alias("n_paragraphs"), F.sum(T.token_count(F.col("raw_text"))).alias("raw_tokens"), F.sum(T.token_count(F.col("clean_text"))).alias("clean_tokens"))
    return t.withColumn("retention", C.guarded_ratio(F.col("clean_tokens"), F.col("raw_tokens")))


_KEY = "trim(regexp_replace(lower(clean_text), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "audit_fragment_dups",
    f"""WITH {PARAS}, norm AS (SELECT doc_id, {_KEY} AS fragment FROM paras)
      SELECT sha256(fragment) AS fragment_sha, count(*) AS n_members, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc, max(length(fragment)) AS fragment_chars
      FROM norm WHERE length(fragment) >= 200 GROUP BY sha256(fragment) HAVING count(DISTINCT doc_id) >= 2""",
)
def audit_fragment_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long fragments that several documents share (flagship)."""
    return C.fragment_groups(_paras(spark, sf_dir))


@query(
    "audit_repeated_fragments",
    f"""WITH {PARAS}, norm AS (SELECT doc_id, position // 5 AS page, {_KEY} AS f FROM paras),
      g AS (SELECT doc_id, f, count(*) AS n FROM norm WHERE length(f) BETWEEN 20 AND 200 GROUP BY doc_id, f HAVING count(DISTINCT page) >= 3)
      SELECT doc_id, count(*) AS n_fragments, sum(n)::BIGINT AS n_members FROM g GROUP BY doc_id""",
)
def audit_repeated_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short fragments repeated over pages of a document."""
    return C.repeated_fragments(_paras(spark, sf_dir))


@query("audit_reference_like", f"WITH {PARAS} SELECT doc_id, count(*) AS n FROM paras WHERE {_REF} GROUP BY doc_id")
def audit_reference_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference-like paragraphs per document."""
    return _paras(spark, sf_dir).filter(T.reference_like(F.col("clean_text"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    "audit_mojibake",
    f"""WITH {PARAS} SELECT lang, count(*) AS n_paragraphs, count(*) FILTER ({' OR '.join(f"contains(raw_text, '{m}')" for m in T.MOJIBAKE_MARKERS)}) AS n_mojibake
      FROM paras JOIN documents USING (doc_id) GROUP BY lang""",
)
def audit_mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with marks of a wrong decoding, per language."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("raw_text")).filter(T.ascii_clean(F.col("raw_text")) != "")
    return lines.groupBy("lang").agg(F.count("*").alias("n_paragraphs"), F.count_if(T.mojibake(F.col("raw_text"))).alias("n_mojibake"))


@query("audit_nfkc_changed")
def audit_nfkc_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that NFKC changes, and with control or format characters before and after cleaning."""
    p = _paras(spark, sf_dir)
    normal = p.withColumn("normal", T.nfkc(F.col("raw_text"))).withColumn("clean", T.unicode_clean(F.col("raw_text")))
    control = lambda c: F.count_if(F.col(c).rlike(r"[\p{Cc}\p{Cf}]"))
    return normal.groupBy("doc_id").agg(F.count_if(F.col("normal") != F.col("raw_text")).alias("n_changed"), control("raw_text").alias("n_raw_control"), control("clean").alias("n_clean_control"))


_TITLE = "trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', ' ', 'g'))"


@query("audit_title_collisions", f"SELECT {_TITLE} AS key, count(*) AS n, min(page_id) AS first_id FROM pages WHERE {_TITLE} <> '' GROUP BY 1 HAVING count(*) > 1")
def audit_title_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that several pages share."""
    return C.collisions(table(spark, sf_dir, "pages"), T.key(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), "page_id")


@query("audit_distributions", "".join(("SELECT 'lang' AS field, coalesce(lang, 'unavailable') AS category, count(*) AS n FROM documents GROUP BY 2 UNION ALL ", "SELECT 'source', coalesce(source, 'unavailable'), count(*) FROM documents GROUP BY 2")))
def audit_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per language and source."""
    docs = table(spark, sf_dir, "documents")
    one = lambda c: C.distribution(docs, c).select(F.lit(c).alias("field"), "category", "n")
    return one("lang").unionByName(one("source"))


_TAGS = ("script", "style", "nav", "header", "footer")


@query(
    "canonical_excluded_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS key, sum(len(regexp_extract_all(html, '<{t}[ >]')))::BIGINT AS total FROM pages" for t in _TAGS) + " UNION ALL SELECT 'comment', sum(len(regexp_extract_all(html, '<!--')))::BIGINT FROM pages",
)
def canonical_excluded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of each excluded kind over all pages (sum of per-page maps)."""
    kinds = {t: f"<{t}[ >]" for t in _TAGS} | {"comment": "<!--"}
    counts = F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*[F.size(F.regexp_extract_all("html", F.lit(f"({r})"), 1)).cast("long") for r in kinds.values()]))
    return C.sum_maps(table(spark, sf_dir, "pages").select(counts.alias("excluded")), "excluded")


@query(
    "validate_documents",
    """WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS nth FROM conversations),
      e AS (SELECT conv_id, turn, role, (CASE WHEN role IN ('user', 'assistant', 'system') THEN 0 ELSE 1 END) AS a, (CASE WHEN trim(coalesce(text, '')) <> '' THEN 0 ELSE 1 END) AS b, (CASE WHEN turn >= 0 THEN 0 ELSE 1 END) AS c, (CASE WHEN nth = 1 THEN 0 ELSE 1 END) AS d FROM t)
      SELECT conv_id, turn, role, concat_ws(',', CASE WHEN a = 1 THEN 'role' END, CASE WHEN b = 1 THEN 'empty_text' END, CASE WHEN c = 1 THEN 'turn' END, CASE WHEN d = 1 THEN 'duplicate_turn' END) AS errors, (a + b + c + d)::BIGINT AS n_errors FROM e""",
)
def validate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error lists of conversation turns."""
    t = table(spark, sf_dir, "conversations")
    t = t.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.asc_nulls_last("role"), F.asc_nulls_last("text"))))
    checks = {
        "role": F.col("role").isin("user", "assistant", "system"),
        "empty_text": F.trim(F.coalesce("text", F.lit(""))) != "",
        "turn": F.col("turn") >= 0,
        "duplicate_turn": F.col("nth") == 1,
    }
    return C.validate(t, checks).select("conv_id", "turn", "role", "errors", "n_errors")


@query(
    "units_summary",
    f"""WITH {PARAS}, t AS (SELECT d.lang, len(regexp_extract_all(clean_text, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]')) AS n FROM paras JOIN documents d USING (doc_id))
      SELECT lang, count(*) AS n, {R6.format('avg(n)')} AS mean, min(n) AS low, max(n) AS high, {R6.format('quantile_cont(n, 0.25)')} AS p25, {R6.format('quantile_cont(n, 0.5)')} AS p50,
      {R6.format('quantile_cont(n, 0.75)')} AS p75, {R6.format('quantile_cont(n, 0.95)')} AS p95 FROM t GROUP BY lang""",
)
def units_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of paragraphs by language: mean, extremes and exact percentiles."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("raw")).select("lang", T.ascii_clean(F.col("raw")).alias("clean")).filter("clean <> ''")
    return C.five_numbers(lines.select("lang", T.token_count(F.col("clean")).alias("tokens")), "tokens", ["lang"])
