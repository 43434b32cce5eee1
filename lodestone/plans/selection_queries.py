"""Source yields, selection under budgets, splits and pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import corpus as C
from lodestone.operators import selection as S
from lodestone.operators import stats as A
from lodestone.plans.registry import Registry, table

query = Registry()
R6 = "floor(({0})::DOUBLE * 1e6 + 0.5) / 1e6"
#: Yields of sources (parts) by task (return flag): dense over both, zero where nothing was found.
YIELDS = """
tasks AS (SELECT unnest(['A', 'N', 'R']) AS task),
got AS (SELECT l_partkey, l_returnflag, count(*) AS n, sum(l_quantity) AS cost FROM lineitem GROUP BY ALL),
yields AS (SELECT p_partkey AS source, task, coalesce(n, 0) AS n, coalesce(cost, 0)::DOUBLE AS cost, p_size::BIGINT AS tokens
  FROM part CROSS JOIN tasks LEFT JOIN got ON l_partkey = p_partkey AND l_returnflag = task)
"""
TASKS = ("A", "N", "R")


def yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense source x task yields; the tasks are three constants, so the expansion is no join."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("source"), F.col("l_returnflag").alias("task")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("cost"))
    dense = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.col("p_size").cast("long").alias("tokens"), F.explode(F.array(*map(F.lit, TASKS))).alias("task"))
    return dense.join(items, ["source", "task"], "left").select("source", "task", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("cost", F.lit(0.0)).cast("double").alias("cost"), "tokens")


@query("source_task_yields", f"""WITH {YIELDS}, u AS (SELECT source, task, n, cost FROM yields UNION ALL SELECT source, 'AN_TOTAL', sum(n), sum(cost) FROM yields WHERE task IN ('A', 'N') GROUP BY source)
  SELECT task, count(*) AS n_sources, sum(n)::BIGINT AS total, count(*) FILTER (n = 0) AS n_zero, {R6.format('avg(n)')} AS mean, {R6.format('var_samp(n) / avg(n)')} AS dispersion, {R6.format('count(*) FILTER (n = 0) / count(*)')} AS zero_share,
  CASE WHEN count(*) FILTER (n > 0) > 0.9 * count(*) THEN 'saturated' WHEN count(*) FILTER (n > 0) < 0.1 * count(*) THEN 'sparse' ELSE 'usable' END AS saturation FROM u GROUP BY task""")
def source_task_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yield summary with a hierarchical total and dispersion diagnostics."""
    y = yields(spark, sf_dir).select("source", "task", "n")
    total = y.filter(F.col("task").isin("A", "N")).groupBy("source").agg(F.sum("n").alias("n")).select("source", F.lit("AN_TOTAL").alias("task"), "n")
    g = y.unionByName(total).groupBy("task").agg(F.count("*").alias("n_sources"), F.sum("n").alias("total"), F.count_if(F.col("n") == 0).alias("n_zero"), F.avg("n").alias("m"), F.var_samp("n").alias("v"))
    hit = F.col("n_sources") - F.col("n_zero")
    saturation = F.when(hit > 0.9 * F.col("n_sources"), "saturated").when(hit < 0.1 * F.col("n_sources"), "sparse").otherwise("usable")
    return g.select("task", "n_sources", "total", "n_zero", T.round6(F.col("m")).alias("mean"), T.round6(F.try_divide("v", F.nullif(F.col("m"), F.lit(0.0)))).alias("dispersion"), T.round6(F.col("n_zero") / F.col("n_sources")).alias("zero_share"), saturation.alias("saturation"))


@query("feature_zscore_winsor", f"""WITH s AS (SELECT p_partkey AS source, ln(1 + p_retailprice) AS x FROM part), q AS (SELECT avg(x) m, stddev_samp(x) sd, quantile_cont(x, 0.01) lo, quantile_cont(x, 0.99) hi FROM s)
  SELECT source, {R6.format('(x - m) / sd')} AS z, {R6.format('least(greatest(x, lo), hi)')} AS winsor FROM s, q""")
def feature_zscore_winsor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log, z-score with the sample deviation, and 1/99 winsorization; the statistics are one broadcast row."""
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.log1p("p_retailprice").alias("x"))
    q = s.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"), F.expr("percentile(x, array(0.01, 0.99))").alias("p"))
    return s.crossJoin(F.broadcast(q)).select("source", T.round6((F.col("x") - F.col("m")) / F.col("sd")).alias("z"), T.round6(F.least(F.greatest("x", F.col("p")[0]), F.col("p")[1])).alias("winsor"))


PERCENTILES = f"""{YIELDS},
ps AS (SELECT *, coalesce((rank() OVER (PARTITION BY task ORDER BY n) + (count(*) OVER (PARTITION BY task, n) - 1) / 2.0 - 1) / nullif(count(*) OVER (PARTITION BY task) - 1, 0), 0)::DOUBLE AS score FROM yields),
common AS (SELECT source, avg(score) AS common FROM ps GROUP BY source)"""


@query("rank_percentile_common", f"""WITH {PERCENTILES} SELECT source, {R6.format("max(score) FILTER (task = 'A')")} AS score_a, {R6.format("max(score) FILTER (task = 'N')")} AS score_n, {R6.format("max(score) FILTER (task = 'R')")} AS score_r,
  {R6.format('avg(score)')} AS common FROM ps GROUP BY source""")
def rank_percentile_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-tie percentile scores per task, pivoted, with their mean as the common score."""
    ps = _percentiles(spark, sf_dir)
    wide = ps.groupBy("source").pivot("task", list(TASKS)).agg(F.first("score"))
    common = (F.col("A") + F.col("N") + F.col("R")) / 3
    return wide.select("source", T.round6(F.col("A")).alias("score_a"), T.round6(F.col("N")).alias("score_n"), T.round6(F.col("R")).alias("score_r"), T.round6(common).alias("common"))


def _percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yields(spark, sf_dir).withColumn("score", S.percentile_score("n", ["task"]))


@query("top_examples", f"WITH {YIELDS}, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC, source) AS rank FROM yields) SELECT task, rank, source, n FROM r WHERE rank <= 100")
def top_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best sources of each task, for illustration."""
    return S.top_k(yields(spark, sf_dir), ["task"], [F.desc("n"), F.asc("source")], 100).select("task", "rank", "source", "n")


@query("select_paper_budget", f"""WITH {YIELDS}, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC, source) AS k, count(*) OVER (PARTITION BY task) AS m, sum(n) OVER (PARTITION BY task) AS total FROM yields)
  SELECT task, count(*) AS n_selected, sum(n)::BIGINT AS captured, {R6.format('sum(n) / max(total)')} AS capture, {R6.format('sum(n) / max(total) / 0.2')} AS lift FROM r WHERE k <= ceil(0.2 * m) GROUP BY task""")
def select_paper_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture and lift of the best fifth of sources per task."""
    y = yields(spark, sf_dir).withColumn("total", F.sum("n").over(Window.partitionBy("task")))
    chosen = S.within_fraction(S.ranked(y, ["task"], [F.desc("n"), F.asc("source")]), ["task"], 0.2)
    g = chosen.groupBy("task").agg(F.count("*").alias("n_selected"), F.sum("n").alias("captured"), F.max("total").alias("t"))
    share = F.col("captured").cast("double") / F.col("t")
    return g.select("task", "n_selected", "captured", T.round6(share).alias("capture"), T.round6(share / 0.2).alias("lift"))


@query("select_token_budget", f"""WITH {YIELDS}, r AS (SELECT *, n::DOUBLE / tokens AS rate, sum(n) OVER (PARTITION BY task) AS total, floor(0.2 * sum(tokens) OVER (PARTITION BY task)) AS budget FROM yields),
  s AS (SELECT *, sum(tokens) OVER (PARTITION BY task ORDER BY rate DESC, source ROWS UNBOUNDED PRECEDING) AS spent FROM r)
  SELECT task, count(*) AS n_selected, sum(tokens)::BIGINT AS spent, sum(n)::BIGINT AS captured, {R6.format('sum(n) / max(total)')} AS capture FROM s WHERE spent <= budget GROUP BY task""")
def select_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture under a fifth of all tokens, whole sources by rate."""
    y = yields(spark, sf_dir).withColumn("rate", F.col("n").cast("double") / F.col("tokens")).withColumn("total", F.sum("n").over(Window.partitionBy("task")))
    chosen = S.within_fraction(S.ranked(y, ["task"], [F.desc("rate"), F.asc("source")]), ["task"], 0.2, "tokens")
    g = chosen.groupBy("task").agg(F.count("*").alias("n_selected"), F.sum("tokens").alias("spent"), F.sum("n").alias("captured"), F.max("total").alias("t"))
    return g.select("task", "n_selected", "spent", "captured", T.round6(F.col("captured").cast("double") / F.col("t")).alias("capture"))


@query("random_baseline", f"""WITH {YIELDS}, reps AS (SELECT unnest(range(20)) AS rep), r AS (SELECT task, rep, source, n, row_number() OVER (PARTITION BY task, rep ORDER BY sha256('baseline|' || rep || '|' || source), source) AS k,
  count(*) OVER (PARTITION BY task, rep) AS m, sum(n) OVER (PARTITION BY task, rep) AS total FROM yields CROSS JOIN reps), c AS (SELECT task, rep, sum(n) / max(total) AS capture FROM r WHERE k <= ceil(0.2 * m) GROUP BY task, rep)
  SELECT task, count(*) AS n_reps, {R6.format('avg(capture)')} AS mean_capture, {R6.format('max(capture)')} AS best FROM c GROUP BY task""")
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random selections in hash order: 20 repeats, a constant expansion of each row."""
    y = yields(spark, sf_dir).select("task", "source", "n", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("rep"))
    y = y.withColumn("total", F.sum("n").over(Window.partitionBy("task", "rep")))
    chosen = S.within_fraction(S.ranked(y, ["task", "rep"], [S.hash_order("baseline", F.col("rep"), F.col("source")), F.asc("source")]), ["task", "rep"], 0.2)
    c = chosen.groupBy("task", "rep").agg((F.sum("n").cast("double") / F.max("total")).alias("capture"))
    return c.groupBy("task").agg(F.count("*").alias("n_reps"), T.round6(F.avg("capture")).alias("mean_capture"), T.round6(F.max("capture")).alias("best"))


@query("rank_overlap_jaccard", f"""WITH {YIELDS}, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC, source) AS k, count(*) OVER (PARTITION BY task) AS m FROM yields), t AS (SELECT task, source FROM r WHERE k <= ceil(0.2 * m)),
  p AS (SELECT a.task AS task_a, b.task AS task_b, count(*) AS n_both FROM t a JOIN t b ON a.source = b.source AND a.task < b.task GROUP BY ALL), z AS (SELECT task, count(*) AS n FROM t GROUP BY task)
  SELECT task_a, task_b, n_both, {R6.format('n_both::DOUBLE / (za.n + zb.n - n_both)')} AS jaccard, {R6.format('n_both::DOUBLE / least(za.n, zb.n)')} AS overlap FROM p JOIN z za ON za.task = task_a JOIN z zb ON zb.task = task_b""")
def rank_overlap_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard and overlap of the best fifths of each pair of tasks: one row per source carries its tasks."""
    t = S.within_fraction(S.ranked(yields(spark, sf_dir), ["task"], [F.desc("n"), F.asc("source")]), ["task"], 0.2).select("task", "source")
    sets = t.groupBy("source").agg(F.array_sort(F.collect_set("task")).alias("ts"))
    pairs = F.explode(F.expr("flatten(transform(ts, (a, i) -> transform(slice(ts, i + 2, size(ts)), b -> struct(a as task_a, b as task_b))))")).alias("p")
    both = sets.select(pairs).groupBy("p.task_a", "p.task_b").agg(F.count("*").alias("n_both"))
    size = t.groupBy("task").agg(F.count("*").alias("n"))
    j = both.join(F.broadcast(size.withColumnRenamed("task", "task_a").withColumnRenamed("n", "na")), "task_a").join(F.broadcast(size.withColumnRenamed("task", "task_b").withColumnRenamed("n", "nb")), "task_b")
    n = F.col("n_both").cast("double")
    return j.select("task_a", "task_b", "n_both", T.round6(n / (F.col("na") + F.col("nb") - F.col("n_both"))).alias("jaccard"), T.round6(n / F.least("na", "nb")).alias("overlap"))


_CORR = f"{PERCENTILES}, w AS (SELECT source, max(score) FILTER (task = 'A') AS a, max(score) FILTER (task = 'R') AS r, max(n) FILTER (task = 'A') AS na, max(n) FILTER (task = 'R') AS nr FROM ps GROUP BY source)"


@query("rank_spearman", f"WITH {_CORR} SELECT count(*) AS n, {R6.format('corr(a, r)')} AS spearman, {R6.format('corr(na, nr)')} AS pearson FROM w")
def rank_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman (Pearson of average ranks) and Pearson between two tasks."""
    ps = _percentiles(spark, sf_dir).filter(F.col("task").isin("A", "R"))
    w = ps.groupBy("source").agg(*[F.max(F.when(F.col("task") == k, F.col(c))).alias(n) for k, c, n in (("A", "score", "a"), ("R", "score", "r"), ("A", "n", "na"), ("R", "n", "nr"))])
    return w.agg(F.count("*").alias("n"), T.round6(F.corr("a", "r")).alias("spearman"), T.round6(F.corr("na", "nr")).alias("pearson"))


@query("rank_kendall", f"""WITH {_CORR}, p AS (SELECT sign(x.na - y.na) * sign(x.nr - y.nr) AS s, (x.na <> y.na)::INT AS ux, (x.nr <> y.nr)::INT AS uy FROM w x JOIN w y ON x.source < y.source)
  SELECT (SELECT count(*) FROM w) AS n, {R6.format('sum(s) / sqrt(sum(ux)::DOUBLE * sum(uy))')} AS tau FROM p""")
def rank_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau-b between two tasks by merge counting."""
    y = yields(spark, sf_dir).filter(F.col("task").isin("A", "R")).groupBy("source").agg(F.max(F.when(F.col("task") == "A", F.col("n"))).alias("a"), F.max(F.when(F.col("task") == "R", F.col("n"))).alias("r"))
    return A.kendall_counts(y, "a", "r").select("n", T.round6(F.col("tau")).alias("tau"))


@query("fold_assignment", "SELECT doc_id, ((row_number() OVER (ORDER BY sha256('folds|' || doc_id), doc_id) - 1) % 5)::BIGINT AS fold FROM documents")
def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds by hash order."""
    return S.folds(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "folds", 5)


@query("split_hash", """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('split|' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents)
  SELECT doc_id, CASE WHEN k <= 500 THEN 'train' WHEN k > n - 100 THEN 'eval' ELSE 'unused' END AS split FROM o""")
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and evaluation documents by hash order."""
    return S.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "split", 500, 100)


POOLS = """
r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('pool|' || doc_id), doc_id) AS turn FROM documents),
o AS (SELECT source, doc_id, turn, row_number() OVER (ORDER BY turn, sha256('pool|' || source), source) AS ordinal FROM r WHERE turn <= 30),
pools AS (SELECT *, scale FROM o, (SELECT unnest([100, 250, 500]) AS scale) WHERE ordinal <= scale)"""


@query("roundrobin_nested_pools", f"WITH {POOLS} SELECT scale::BIGINT AS scale, ordinal, turn, source, doc_id FROM pools")
def roundrobin_nested_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested pools dealt round-robin over sources."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    return S.nested_pools(S.round_robin(docs, "source", "doc_id", "pool", 30), [100, 250, 500]).select("scale", "ordinal", "turn", "source", "doc_id")


@query("membership_hash", f"WITH {POOLS} SELECT scale::BIGINT AS scale, count(*) AS n, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY ordinal)) AS membership FROM pools GROUP BY scale")
def membership_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of each pool's ids in order."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    pools = S.nested_pools(S.round_robin(docs, "source", "doc_id", "pool", 30), [100, 250, 500])
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "doc_id"))), lambda x: x["doc_id"].cast("string")), "\n")
    return pools.groupBy("scale").agg(F.count("*").alias("n"), F.sha2(ids, 256).alias("membership"))


@query("dedup_keep_first", "SELECT doc_id, lang, sha256(text) AS text_sha FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("text_sha"))
    return docs.groupBy("text_sha").agg(F.min_by(F.struct("doc_id", "lang"), "doc_id").alias("d")).select("d.doc_id", "d.lang", "text_sha")


@query("split_leakage_gates", """WITH o AS (SELECT doc_id, text, row_number() OVER (ORDER BY sha256('split|' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents),
  s AS (SELECT sha256(text) AS h, max((k <= 500)::INT) AS tr, max((k > n - 100 AND k > 500)::INT) AS ev FROM o GROUP BY 1)
  SELECT 'text_disjoint' AS gate, count(*) FILTER (tr = 1 AND ev = 1) AS n_failed, count(*) FILTER (tr = 1 AND ev = 1) = 0 AS passed FROM s UNION ALL SELECT 'text_seen_once', count(*) FILTER (tr + ev = 0), count(*) FILTER (tr + ev = 0) = 0 FROM s""")
def split_leakage_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over the hash split: no text on both sides, and none left out."""
    docs = S.split(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "doc_id", "split", 500, 100)
    s = docs.groupBy("h").agg(F.max((F.col("split") == "train").cast("int")).alias("tr"), F.max((F.col("split") == "eval").cast("int")).alias("ev"))
    return C.gates({"text_disjoint": F.col("tr") + F.col("ev") < 2, "text_seen_once": F.col("tr") + F.col("ev") > 0}, s)
