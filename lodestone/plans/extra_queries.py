"""Queries of the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import detect as D
from lodestone.operators import extras as X
from lodestone.operators import materialize as M
from lodestone.operators import selection as S
from lodestone.plans.detection_queries import candidates_input
from lodestone.plans.registry import Registry, table
from lodestone.plans.selection_queries import YIELDS, yields
from lodestone.shipping import ship

query = Registry()
R6 = "floor(({0})::DOUBLE * 1e6 + 0.5) / 1e6"


@query("table_flatten", "SELECT o_custkey % 100 AS bucket, sha256(string_agg(o_orderkey || ' | ' || o_orderstatus, chr(10) ORDER BY o_orderkey)) AS text_sha FROM orders GROUP BY 1")
def table_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of cells as text, per bucket of orders."""
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("r"))
    rows = F.transform("r", lambda x: F.array(x["o_orderkey"].cast("string"), x["o_orderstatus"]))
    return o.select("bucket", F.sha2(X.table_text(rows), 256).alias("text_sha"))


@query("bio_projection", r"""WITH w AS (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark), u AS (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS i, ws FROM w), e AS (SELECT item_id, i, w, length(array_to_string(ws[1:i + 1], ' ')) AS b FROM u),
  t AS (SELECT item_id, i, w, b - length(w) AS a, b, lag(b - length(w)) OVER (PARTITION BY item_id ORDER BY i) AS pa, lag(b) OVER (PARTITION BY item_id ORDER BY i) AS pb FROM e), s AS (SELECT item_id, greatest(0, a - 12) AS lo, b AS hi FROM t WHERE regexp_matches(w, '[.!?]$')),
  h AS (SELECT t.item_id, t.i, bool_or(s.lo IS NOT NULL) AS hit, bool_or(s.lo < t.pb AND t.pa < s.hi) AS same FROM t LEFT JOIN s ON s.item_id = t.item_id AND s.lo < t.b AND t.a < s.hi GROUP BY ALL)
  SELECT CASE WHEN NOT hit THEN 'O' WHEN coalesce(same, false) THEN 'I-END' ELSE 'B-END' END AS label, count(*) AS n FROM h GROUP BY 1""")
def bio_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BIO labels of benchmark words for every span of letters followed by a stop, counted."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    ends = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.char_length(F.array_join(F.slice("w", 1, i), " ")))
    tokens = F.transform("w", lambda x, i: F.struct(x.alias("text"), (F.get(ends, i) - F.char_length(x)).alias("start"), F.get(ends, i).alias("end")))
    t = b.select("item_id", tokens.alias("tokens"))
    spans = F.transform(F.filter("tokens", lambda x: x["text"].rlike(r"[.!?]$")), lambda x: F.struct(F.greatest(F.lit(0), x["start"] - 12).alias("start"), x["end"].alias("end")))
    labels = X.bio_labels(F.col("tokens"), F.col("spans"), "END")
    return t.withColumn("spans", spans).select("item_id", F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("recursive_chunks")
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive chunks of every document: number, longest and shortest."""
    c = X.chunked(table(spark, sf_dir, "documents"), "doc_id", "text")
    return c.groupBy("id").agg(F.count("*").alias("n_chunks"), F.max(F.char_length("chunk")).alias("longest"), F.min(F.char_length("chunk")).alias("shortest")).withColumnRenamed("id", "doc_id")


CHUNKED = [("aaaa bbbb. cccc dddd. eeee", ["aaaa bbbb. ", "cccc dddd. ", "eeee"]), ("one two three four five", ["one two ", "three four ", "five"]), ("x" * 25, ["x" * 12, "x" * 12, "x"]), ("a b\n\nc d e f g h", ["a b\n\n", "c d e f g h"]), ("", [])]


@query("chunk_cases", " UNION ALL ".join(f"SELECT {i} AS id, {n} AS nth, '{c}' AS chunk" for i, (_, out) in enumerate(CHUNKED) for n, c in enumerate(out)))
def chunk_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive chunks of hand-made texts under small limits."""
    ship(spark)
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CHUNKED)], "doc_id int, text string")
    return X.chunked(d, "doc_id", "text", target=11, least=3, most=12)


@query("leave_top_out", f"WITH {YIELDS}, r AS (SELECT task, n, row_number() OVER (PARTITION BY task ORDER BY n DESC, source) AS k, count(*) OVER (PARTITION BY task) AS m FROM yields) SELECT task, count(*) AS n_sources, {R6.format('avg(n)')} AS mean FROM r WHERE k > ceil(0.01 * m) GROUP BY task")
def leave_top_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean yields without the top hundredth of sources."""
    return X.leave_top_out(yields(spark, sf_dir), ["task"], "n", "source").groupBy("task").agg(F.count("*").alias("n_sources"), T.round6(F.avg("n")).alias("mean"))


@query("nb_deviance", f"""WITH {YIELDS}, m AS (SELECT *, avg(n) OVER (PARTITION BY task) AS mu FROM yields) SELECT task, {R6.format('sum(2 * ((CASE WHEN n > 0 THEN n * ln(n / mu) ELSE 0 END) - (n + 2) * ln((1 + 0.5 * n) / (1 + 0.5 * mu))))')} AS deviance, count(*) FILTER (n = 0) AS zeros, {R6.format('sum(pow(1 + 0.5 * mu, -2))')} AS expected_zeros FROM m GROUP BY task""")
def nb_deviance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null deviance of yields at alpha 0.5, and zeros found against zeros expected."""
    y = yields(spark, sf_dir)
    mu = y.groupBy("task").agg(F.avg("n").alias("mu"))
    d = X.nb_deviance(F.col("n").cast("double"), F.col("mu"), 0.5)
    zero = F.sum(X.nb_zero(F.col("mu"), 0.5))
    return y.join(F.broadcast(mu), "task").groupBy("task").agg(T.round6(F.sum(d)).alias("deviance"), F.count_if(F.col("n") == 0).alias("zeros"), T.round6(zero).alias("expected_zeros"))


_G = "VALUES ('T1', 0.05, 0.01, 0.003), ('T2', 0.02, -0.01, 0.2), ('T3', -0.01, -0.03, 0.7)"


@query("utility_judgment", f"WITH g(task, gain, low, p) AS ({_G}) SELECT task, CASE WHEN gain > 0 AND low > 0 AND p < 0.05 THEN 'supported' WHEN gain > 0 THEN 'directional' ELSE 'not_supported' END AS judgment FROM g")
def utility_judgment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from gain, interval and adjusted p."""
    g = spark.sql(f"SELECT * FROM ({_G}) AS t(task, gain, low, p)")
    return g.select("task", X.utility_judgment(F.col("gain"), F.col("low"), F.col("p")).alias("judgment"))


@query("bootstrap_selection")
def bootstrap_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task score against common score, with selection inside each replicate."""
    ps = yields(spark, sf_dir).withColumn("score", S.percentile_score("n", ["task"]))
    common = ps.groupBy("source").agg(F.avg("score").alias("common"))
    own = ps.filter("task = 'A'").join(common, "source").select("source", "score", "common", F.col("n").cast("double").alias("gain"))
    return X.bootstrap_selection(own, "source", "score", "common", "gain", 0.2, "bootstrap_selection")


@query("evaluation_instances")
def evaluation_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One numeric instance per document for evaluation."""
    made = M.materialize(D.detect_numbers(candidates_input(spark, sf_dir)), F.col("accepted"), "materialize")
    return M.evaluation_set(made, "evaluation", 300).select("instance_id", "doc_id", "answer")
