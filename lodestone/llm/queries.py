"""One registered query per operator of this subpackage, with DuckDB SQL where that can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language_id, line_dedup, media, packing, quality, simhash, substring_dedup, subwords, toxicity, warc
from lodestone.llm.common import crc_mod4
from lodestone.shipping import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex_sha256(column):
    return F.sha2(column.cast("binary"), 256)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from documents that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit_language_id(docs))
    return found.select(F.col("id").alias("doc_id"), (crc_mod4("id") == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents as 8-bit media in the chunk store, read back."""
    return media.media_features(spark, _table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-dedup of documents: 3-word shingles, links at 2 differing bits."""
    found = simhash.simhash_components(spark, _table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of documents: keys of 40 code points in 5 documents stay in the largest only."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.line_dedup(spark, docs)
    return found.select("doc_id", "n_lines", "n_dropped", _hex_sha256(F.col("kept_text")).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
bad AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN bad USING (k) GROUP BY doc_id
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality ledger of documents under policy v1."""
    rows = quality.quality_rules(spark, _table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *quality.MEASURES, "base_failed", "kept", "failures")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win),
cover AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest(range(8)) AS o) WHERE c >= 2 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN cover USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars > 25 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 2 * n_symbols > n_words THEN 16 ELSE 0 END) + (CASE WHEN n_dup_lines > 20 AND 20 * n_dup_lines > n_words THEN 32 ELSE 0 END) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failures = 0 AS kept, failures::BIGINT AS failures FROM f
"""


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 rejects, alone and with others, from the stored ledger."""
    return quality.ablation(quality.quality_rules(spark, _table(spark, sf_dir, "documents")))


QUALITY_ABLATION_SQL = f"""
WITH g AS ({OP5_SQL}), b AS (SELECT unnest([{", ".join(f"'{k}'" for k in quality.RULES)}]) AS rule, unnest([{", ".join(map(str, quality.BITS.values()))}])::BIGINT AS bit)
SELECT rule, count(*) FILTER (failures & bit <> 0) AS n_failed, count(*) FILTER (failures = bit) AS n_failed_alone, count(*) FILTER (failures & ~bit = 0) AS n_kept_without FROM g, b GROUP BY rule
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    return warc.warc_round_trip(spark, _table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM d LEFT JOIN k USING (payload_digest)
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents in 50-word windows that a smaller document holds too are removed."""
    found = substring_dedup.substring_dedup(spark, _table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("kept", "kept_sha256")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM s),
low AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM win),
cover AS (SELECT DISTINCT doc_id, i + o AS j FROM low, (SELECT unnest(range(50)) AS o) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
cut AS (SELECT words.doc_id, x, words.j, cover.j IS NOT NULL AS gone FROM words LEFT JOIN cover ON words.doc_id = cover.doc_id AND words.j = cover.j),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY j) FILTER (NOT gone) AS t FROM cut GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of documents that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(spark, docs, _table(spark, sf_dir, "labels"))
    found = toxicity.score_documents(docs, model)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return found.select(F.col("id").alias("doc_id"), (crc_mod4("id") == 2).alias("held_out"), "score", predicted, F.size("spans").cast("long").alias("n_spans"), F.to_json("spans").alias("spans"))


def op10_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled SentencePiece segmentations of every document, decoded again."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return subwords.sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)} | {"quality_ablation": quality_ablation}


def oracle_sql() -> dict[str, str]:
    names = {name: name.split("_")[0] if name.startswith("op") else name for name in queries()}
    return {name: sql for name, short in names.items() if (sql := globals().get(short.upper() + "_SQL"))}
