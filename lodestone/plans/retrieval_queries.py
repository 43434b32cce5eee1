"""Units, links, leakage, retrieval and its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import corpus as C
from lodestone.operators import evaluate as E
from lodestone.operators import retrieval as R
from lodestone.operators import units as U
from lodestone.plans.corpus_queries import PARAS
from lodestone.plans.registry import Registry, table

query = Registry()
R6 = "floor(({0})::DOUBLE * 1e6 + 0.5) / 1e6"
_TOK = r"len(regexp_extract_all(clean_text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]'))"


def _paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.paragraphs(table(spark, sf_dir, "documents"))


@query("units_fixed", f"""WITH {PARAS}, s AS (SELECT doc_id, position, {_TOK} AS n, sum({_TOK}) OVER (PARTITION BY doc_id ORDER BY position) AS t1, sum({_TOK}) OVER (PARTITION BY doc_id) AS total FROM paras),
  w AS (SELECT doc_id, unnest(range(0, total::BIGINT, 448)) AS start, total FROM (SELECT DISTINCT doc_id, total FROM s)), v AS (SELECT doc_id, start, least(start + 512, total) AS stop FROM w WHERE start = 0 OR start + 64 < total)
  SELECT doc_id || '::B1::' || lpad((start // 448)::VARCHAR, 5, '0') AS unit_id, v.doc_id, max(stop - start)::BIGINT AS token_count, count(*) AS n_overlapping, count(*) FILTER (t1 - n >= start AND t1 <= stop) AS n_whole, min(position) AS first_position, max(position) AS last_position
  FROM v JOIN s USING (doc_id) WHERE n > 0 AND t1 - n < stop AND start < t1 GROUP BY v.doc_id, start""")
def units_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 512 tokens with 64 overlapping, and the paragraphs they cover."""
    spans = U.paragraph_spans(_paras(spark, sf_dir), T.token_count(F.col("clean_text")))
    return U.fixed_units(spans).select("unit_id", "doc_id", F.col("token_count").cast("long").alias("token_count"), "n_overlapping", "n_whole", "first_position", "last_position")


@query("units_atomic", f"WITH {PARAS} SELECT doc_id || ':p' || lpad((position + 1)::VARCHAR, 6, '0') || '::B2' AS unit_id, sha256('[Section] s' || (position // 4) || chr(10) || '[Paragraph] ' || clean_text) AS text_sha FROM paras")
def units_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph units led by their section."""
    return U.atomic_units(_paras(spark, sf_dir), U.section_of(F.col("position"))).select("unit_id", F.sha2("text", 256).alias("text_sha"))


@query("units_package", f"""WITH {PARAS}, n AS (SELECT *, lag(clean_text) OVER w AS b, lead(clean_text) OVER w AS a FROM paras WINDOW w AS (PARTITION BY doc_id, position // 4 ORDER BY position))
  SELECT doc_id || ':p' || lpad((position + 1)::VARCHAR, 6, '0') || '::B3' AS unit_id, (b IS NOT NULL)::BIGINT + (a IS NOT NULL)::BIGINT AS n_supports,
  sha256(concat_ws(chr(10), '[Section] s' || (position // 4), '[Support] ' || b, '[Anchor] ' || clean_text, '[Support] ' || a)) AS text_sha FROM n""")
def units_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor paragraphs with their neighbours in the section."""
    return U.package_units(_paras(spark, sf_dir), U.section_of(F.col("position"))).select("unit_id", "n_supports", F.sha2("text", 256).alias("text_sha"))


@query("object_link_labels", r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(lower(html), '<(h[1-6]|p|li|img|table)[ >]', 1)) AS label FROM pages), m AS (SELECT page_id, unnest(['h1', 'h2', 'p', 'img', 'table']) AS label FROM pages)
  SELECT label, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM (SELECT DISTINCT page_id, label FROM h) JOIN m USING (page_id, label) GROUP BY label""")
def object_link_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors linked to the objects of their page by label."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    tags = F.array_distinct(F.regexp_extract_all(F.lower("html"), F.lit("<(h[1-6]|p|li|img|table)[ >]"), 1))
    objects = pages.select(F.col("page_id").alias("doc_id"), F.explode(tags).alias("label")).select("doc_id", "label", F.concat_ws(":", "doc_id", "label").alias("object_id"), F.lit("object").alias("kind"), F.lit(0).alias("page"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("y1"))
    wanted = F.array(*[F.lit(x) for x in ("h1", "h2", "p", "img", "table")])
    anchors = pages.select(F.col("page_id").alias("doc_id"), F.col("page_id").alias("anchor_id"), wanted.alias("labels"), F.lit(0).alias("page"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("y1"), F.lit(False).alias("cue"))
    links = U.linked_objects(anchors, objects).withColumn("label", F.split("object_id", ":")[1])
    return links.groupBy("label").agg(F.count("*").alias("n_links"), F.countDistinct("doc_id").alias("n_pages"))


_TKEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_BENCH = f"b AS (SELECT item_id, {_TKEY.format('text')} AS k FROM benchmark)"


@query("leakage_exact", f"WITH {PARAS}, {_BENCH}, p AS (SELECT doc_id, {_TKEY.format('clean_text')} AS k FROM paras) SELECT item_id, count(*) AS n_paragraphs, count(DISTINCT doc_id) AS n_docs FROM b JOIN p USING (k) WHERE k <> '' GROUP BY item_id")
def leakage_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that occur as paragraphs."""
    b = table(spark, sf_dir, "benchmark").select("item_id", T.key(F.col("text")).alias("k")).filter("k <> ''")
    p = _paras(spark, sf_dir).select("doc_id", T.key(F.col("clean_text")).alias("k"))
    return p.join(b, "k").groupBy("item_id").agg(F.count("*").alias("n_paragraphs"), F.countDistinct("doc_id").alias("n_docs"))


@query("leakage_jaccard", f"""WITH {PARAS}, {_BENCH}, bt AS (SELECT item_id, list_distinct(string_split(k, ' ')) AS t FROM b WHERE k <> ''), p AS (SELECT DISTINCT {_TKEY.format('clean_text')} AS k FROM paras), pt AS (SELECT k, list_distinct(string_split(k, ' ')) AS t FROM p WHERE k <> ''),
  j AS (SELECT item_id, k, len(list_intersect(bt.t, pt.t))::DOUBLE / (len(bt.t) + len(pt.t) - len(list_intersect(bt.t, pt.t))) AS s FROM bt JOIN pt ON len(bt.t) >= 5 AND len(pt.t) >= 5 AND len(pt.t) BETWEEN 0.8 * len(bt.t) AND len(bt.t) / 0.8)
  SELECT item_id, {R6.format('max(s)')} AS jaccard FROM j WHERE s >= 0.8 GROUP BY item_id""")
def leakage_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best similarity of each benchmark item to a paragraph, by prefix-filtered candidates."""
    tokens = lambda k: F.array_distinct(F.split(k, " "))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), T.key(F.col("text")).alias("k")).filter("k <> ''").select("id", tokens("k").alias("tokens"))
    p = _paras(spark, sf_dir).select(T.key(F.col("clean_text")).alias("k")).filter("k <> ''").distinct().select(F.xxhash64("k").alias("id"), tokens("k").alias("tokens"))
    return U.similar_texts(b, p, 0.8).select(F.col("l_id").alias("item_id"), T.round6(F.col("jaccard")).alias("jaccard"))


@query("evidence_chunk_mapping", r"""WITH e AS (SELECT d.doc_id, item_id, strpos(d.text, b.text) - 1 AS e0, strpos(d.text, b.text) - 1 + length(b.text) AS e1, length(d.text) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE len(string_split_regex(trim(b.text), '\s+')) >= 5),
  k AS (SELECT *, unnest(range(0, n, 600)) AS c0 FROM e), j AS (SELECT doc_id, item_id, count(*) FILTER (c0 <= e0 AND e1 <= least(c0 + 600, n)) AS w, count(*) FILTER (c0 < e1 AND e0 < least(c0 + 600, n)) AS m FROM k GROUP BY ALL)
  SELECT CASE WHEN w > 0 THEN 'fully' WHEN m > 0 THEN 'multi' ELSE 'unmapped' END AS class, count(*) AS n, count(DISTINCT item_id) AS n_items FROM j GROUP BY 1""")
def evidence_chunk_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages of at least five words where documents hold them, against chunks of 600 characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = U.passages(docs, table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")))
    size = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.char_length("text").alias("n"))
    chunks = size.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(600))).alias("c0")).select("doc_id", "c0", F.least(F.col("c0") + 600, F.col("n")).alias("c1"))
    return U.evidence_class(found, chunks).groupBy("class").agg(F.count("*").alias("n"), F.countDistinct("evidence_id").alias("n_items"))


RANKING = f"""q AS (SELECT vec_id AS query_id, label AS scope, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
r AS (SELECT query_id, vec_id AS unit_id, 100.0 + vec_id % 7 * 50 AS cost, floor(list_inner_product(q.v::DOUBLE[], e.embedding::DOUBLE[]) * 1e6 + 0.5) / 1e6 AS score FROM q JOIN embeddings e ON e.label = q.scope AND vec_id <> query_id),
ranking AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM r),
gold AS (SELECT DISTINCT query_id, a AS annotator, (unit_id // 3) % 2 AS element, unit_id % 3 AS alternative, unit_id % 11 AS atom FROM r, (SELECT unnest([0, 1]) AS a) WHERE unit_id % 5 = a),
rec AS (SELECT query_id, unit_id % 11 AS atom, min(rank) AS rank FROM ranking GROUP BY ALL)"""


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20, against all vectors of its label."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("scope"), F.col("embedding").alias("v"))
    u = e.select(F.col("vec_id").alias("unit_id"), F.col("label").alias("scope"), F.col("embedding").alias("v"), (F.lit(100.0) + F.col("vec_id") % 7 * 50).alias("cost"))
    return R.scoped_ranking(q, u)


@query("retrieval_rank_topk", f"WITH {RANKING} SELECT query_id, unit_id, rank, {R6.format('score')} AS score FROM ranking WHERE rank <= 10")
def retrieval_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best units of each query in its scope."""
    return ranking(spark, sf_dir).filter("rank <= 10").select("query_id", "unit_id", "rank", T.round6(F.col("score")).alias("score"))


@query("retrieval_metrics", f"""WITH {RANKING}, alt AS (SELECT g.query_id, annotator, element, alternative, CASE WHEN count(*) = count(rank) THEN max(rank) END AS rank FROM gold g LEFT JOIN rec USING (query_id, atom) GROUP BY ALL),
  el AS (SELECT query_id, annotator, element, min(rank) AS rank FROM alt GROUP BY ALL), s AS (SELECT query_id, annotator, avg((coalesce(rank, 1e9) <= 5)::INT) AS s5, avg((coalesce(rank, 1e9) <= 10)::INT) AS s10 FROM el GROUP BY ALL)
  SELECT query_id, {R6.format('max(s5)')} AS recall_5, max((s5 = 1)::BIGINT) AS complete_5, {R6.format('max(s10)')} AS recall_10, max((s10 = 1)::BIGINT) AS complete_10, {R6.format('max(mrr)')} AS mrr
  FROM s JOIN (SELECT query_id, coalesce(1.0 / min(rank), 0) AS mrr FROM el GROUP BY query_id) USING (query_id) GROUP BY query_id""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and complete evidence at 5 and 10, and reciprocal rank, from the rank at which each gold element is met."""
    ranked = ranking(spark, sf_dir)
    parts = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), (F.col("vec_id") % 11).alias("atom"))
    both = ranked.select("query_id", "unit_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("annotator")).filter("unit_id % 5 = annotator")
    gold = both.select("query_id", "annotator", F.expr("(unit_id div 3) % 2").alias("element"), F.expr("unit_id % 3").alias("alternative"), F.expr("unit_id % 11").alias("atom")).distinct()
    m = E.element_scores(R.gold_ranks(gold, R.recovery_ranks(ranked, parts)), {"5": F.lit(5), "10": F.lit(10)})
    return m.select("query_id", T.round6(F.col("recall_5")).alias("recall_5"), "complete_5", T.round6(F.col("recall_10")).alias("recall_10"), "complete_10", T.round6(F.col("mrr")).alias("mrr"))


@query("retrieval_budget", f"""WITH {RANKING}, c AS (SELECT query_id, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS spent FROM ranking)
  SELECT query_id, count(*) FILTER (spent <= 1024) AS n_units, coalesce(max(spent) FILTER (spent <= 1024), 0)::DOUBLE AS spent, max(spent) <= 1024 AS exhausted FROM c GROUP BY query_id""")
def retrieval_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units within 1,024 tokens over the full ranking."""
    return R.budget_depth(ranking(spark, sf_dir), 1024)


@query("interval_union", """WITH i AS (SELECT user_id, event_id % 500 AS s, event_id % 500 + 1 + event_id % 9 AS e FROM events), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i)
  SELECT user_id, count(*) AS n, sum(greatest(0, e - greatest(s, coalesce(p, s))))::DOUBLE AS covered FROM m GROUP BY user_id""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union length of each user's intervals."""
    i = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 500).alias("s"), (F.col("event_id") % 500 + 1 + F.col("event_id") % 9).alias("e"))
    return R.interval_union(i, ["user_id"], "s", "e")
