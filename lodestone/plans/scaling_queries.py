"""Templates, prediction metrics, scaling statistics, resampling and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import scaling as M
from lodestone.operators import selection as S
from lodestone.operators import stats as A
from lodestone.plans.registry import Registry, table
from lodestone.plans.selection_queries import yields

query = Registry()
R6 = "floor(({0})::DOUBLE * 1e6 + 0.5) / 1e6"
_CASES = " ".join(f"WHEN role = '{k}' AND t = {i} THEN " + " || ".join(f"'{x}'" if x != "@" else "coalesce(text, '')" for x in w.replace("{0}", "\0@\0").split("\0") if x) for k, ws in M.TEMPLATES.items() for i, w in enumerate(ws))


@query("template_render", f"""SELECT conv_id, turn, role, t AS template, sha256(CASE {_CASES} END) AS instruction_sha FROM conversations, (SELECT unnest([0, 1, 2]) AS t)""")
def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three wordings of each turn's instruction, with its whole text as the variable."""
    t = table(spark, sf_dir, "conversations")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("template"), M.rendered(F.col("role"), F.coalesce("text", F.lit("")), i).alias("s")) for i in range(3)])).alias("x")
    return t.select("conv_id", "turn", "role", each).select("conv_id", "turn", "role", "x.template", F.sha2("x.s", 256).alias("instruction_sha"))


PAIRS = "p AS (SELECT conv_id, max(text) FILTER (role = 'user') AS gold, max(text) FILTER (role = 'assistant') AS found FROM conversations GROUP BY conv_id)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda r: F.max(F.when(F.col("role") == r, F.col("text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(side("user").alias("gold"), side("assistant").alias("found"))


@query("token_f1", f"""WITH {PAIRS}, t AS (SELECT conv_id, regexp_extract_all(lower(coalesce(gold, '')), '[a-z0-9]+') AS g, regexp_extract_all(lower(coalesce(found, '')), '[a-z0-9]+') AS f FROM p),
  a AS (SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest(g) AS w FROM t) GROUP BY ALL), b AS (SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest(f) AS w FROM t) GROUP BY ALL),
  s AS (SELECT conv_id, sum(least(a.n, b.n)) AS s FROM a JOIN b USING (conv_id, w) GROUP BY conv_id), m AS (SELECT conv_id, len(g) AS ng, len(f) AS nf, coalesce(s, 0) AS s FROM t LEFT JOIN s USING (conv_id))
  SELECT conv_id, {R6.format('CASE WHEN ng = 0 OR nf = 0 THEN (ng = nf)::INT ELSE s / nf END')} AS precision, {R6.format('CASE WHEN ng = 0 OR nf = 0 THEN (ng = nf)::INT ELSE s / ng END')} AS recall, {R6.format('CASE WHEN ng = 0 OR nf = 0 THEN (ng = nf)::INT ELSE 2.0 * s / (ng + nf) END')} AS f1 FROM m""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag-of-token F1 of each conversation's reply against its question."""
    p = _pairs(spark, sf_dir).select("conv_id", F.coalesce("gold", F.lit("")).alias("gold"), F.coalesce("found", F.lit("")).alias("found"))
    return M.token_f1(p, "gold", "found", ["conv_id"]).select("conv_id", *[T.round6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("preservation_metrics", f"""WITH {PAIRS}, r AS (SELECT gold, found, regexp_matches(gold, '[0-9]') AS need_number, regexp_matches(found, '[0-9]') AS has_number, contains(' ' || lower(gold) || ' ', 'not') AS need_negation, contains(' ' || lower(found) || ' ', 'not') AS has_negation FROM p WHERE gold IS NOT NULL)
  SELECT count(*) AS n, count(*) FILTER (need_number) AS n_number, {R6.format('avg(coalesce(has_number, false)::INT) FILTER (need_number)')} AS number_preserved, count(*) FILTER (need_negation) AS n_negation, {R6.format('avg(coalesce(has_negation, false)::INT) FILTER (need_negation)')} AS negation_preserved FROM r""")
def preservation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a reply keeps a property its question requires."""
    p = _pairs(spark, sf_dir).filter("gold is not null")
    number = lambda c: F.col(c).rlike("[0-9]")
    negation = lambda c: F.lower(c).contains("not")
    m = p.agg(F.count("*").alias("n"), F.count_if(number("gold")).alias("n_number"), M.conditional_accuracy(number("gold"), number("found")).alias("a"), F.count_if(negation("gold")).alias("n_negation"), M.conditional_accuracy(negation("gold"), negation("found")).alias("b"))
    return m.select("n", "n_number", T.round6(F.col("a")).alias("number_preserved"), "n_negation", T.round6(F.col("b")).alias("negation_preserved"))


RUNS = "r AS (SELECT o_orderpriority AS template, o_orderstatus AS task, (o_orderkey % 3)::BIGINT AS seed, avg((o_totalprice > 150000)::INT) AS nem FROM orders GROUP BY ALL)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("template"), F.col("o_orderstatus").alias("task"), (F.col("o_orderkey") % 3).alias("seed")).agg(F.avg((F.col("o_totalprice") > 150000).cast("int")).alias("nem"))


@query("scale_metrics", f"WITH {RUNS} SELECT task, template, count(*) AS n_seeds, {R6.format('avg(nem)')} AS mean, {R6.format('stddev_samp(nem)')} AS sd, {R6.format('min(nem)')} AS low, {R6.format('max(nem)')} AS high FROM r GROUP BY task, template")
def scale_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sample deviation over seeds."""
    g = _runs(spark, sf_dir).groupBy("task", "template").agg(F.count("*").alias("n_seeds"), F.avg("nem").alias("mean"), F.stddev_samp("nem").alias("sd"), F.min("nem").alias("low"), F.max("nem").alias("high"))
    return g.select("task", "template", "n_seeds", *[T.round6(F.col(c)).alias(c) for c in ("mean", "sd", "low", "high")])


@query("template_robustness", f"""WITH {RUNS}, m AS (SELECT task, template, avg(nem) AS v FROM r GROUP BY ALL) SELECT task, {R6.format("max(v) FILTER (template = '1-URGENT')")} AS primary_mean, {R6.format("avg(v) FILTER (template <> '1-URGENT')")} AS paraphrase_mean, {R6.format('min(v)')} AS worst, {R6.format('stddev_samp(v)')} AS sd FROM m GROUP BY task""")
def template_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary, mean paraphrase, worst template and deviation."""
    m = _runs(spark, sf_dir).groupBy("task", "template").agg(F.avg("nem").alias("v"))
    main = F.col("template") == "1-URGENT"
    g = m.groupBy("task").agg(F.max(F.when(main, F.col("v"))).alias("p"), F.avg(F.when(~main, F.col("v"))).alias("q"), F.min("v").alias("w"), F.stddev_samp("v").alias("s"))
    return g.select("task", T.round6(F.col("p")).alias("primary_mean"), T.round6(F.col("q")).alias("paraphrase_mean"), T.round6(F.col("w")).alias("worst"), T.round6(F.col("s")).alias("sd"))


_P = "VALUES ('f', 'a', 0.0003), ('f', 'b', 0.02), ('f', 'c', 0.011), ('f', 'd', 0.4), ('g', 'a', 0.04), ('g', 'b', 0.03), ('g', 'c', 0.005)"


@query("holm_adjust", f"""WITH t(family, test, p) AS ({_P}), r AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, test) + 1)) AS raw FROM t)
  SELECT family, test, {R6.format('max(raw) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING)')} AS holm_p FROM r""")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm's adjustment in two families."""
    t = spark.sql(f"SELECT family, test, cast(p AS double) AS p FROM ({_P}) AS t(family, test, p)")
    return A.holm(t, ["family"], "p", ["test"]).select("family", "test", T.round6(F.col("holm_p")).alias("holm_p"))


_U = "VALUES ('T1', 100, 0.09), ('T1', 250, 0.03), ('T1', 500, 0.018), ('T1', 1000, 0.004), ('T2', 100, 0.2), ('T2', 250, 0.11), ('T2', 500, 0.07), ('T2', 1000, 0.05)"


@query("nstar_delta_grid", f"""WITH u(task, scale, ucb) AS ({_U}), d AS (SELECT unnest([0.01, 0.02, 0.05])::DOUBLE AS delta), g AS (SELECT task, delta, min(scale) FILTER (ucb <= delta + 1e-15) AS n FROM u, d GROUP BY ALL)
  SELECT task, delta, n AS n_star, CASE WHEN n IS NULL THEN 'not_identified' ELSE 'identified' END AS status FROM g""")
def nstar_delta_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest practically equivalent scale over a grid of margins."""
    u = spark.sql(f"SELECT task, scale, cast(ucb AS double) AS ucb FROM ({_U}) AS t(task, scale, ucb)")
    return A.smallest_equivalent(u, [0.01, 0.02, 0.05], "task", "scale", "ucb")


@query("plateau", f"WITH u(task, scale, ucb) AS ({_U}), g AS (SELECT *, ucb - lag(ucb) OVER (PARTITION BY task ORDER BY scale) AS gain FROM u) SELECT task, scale, {R6.format('gain')} AS gain, coalesce(abs(gain) <= 0.02, false) AS plateau, CASE WHEN gain IS NULL THEN 'first_scale' WHEN abs(gain) <= 0.02 THEN 'plateau' WHEN gain < 0 THEN 'still_improving' ELSE 'worse' END AS judgment FROM g")
def plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change from scale to scale."""
    u = spark.sql(f"SELECT task, scale, cast(ucb AS double) AS ucb FROM ({_U}) AS t(task, scale, ucb)")
    return M.plateau(u, "task", "scale", "ucb", 0.02).select("task", "scale", T.round6(F.col("gain")).alias("gain"), "plateau", M.plateau_judgment(F.col("gain"), 0.02).alias("judgment"))


@query("group_argmax_pivot", f"""WITH g AS (SELECT o_custkey % 50 AS bucket, o_orderstatus AS s, sum(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY ALL) SELECT bucket, {R6.format("max(v) FILTER (s = 'F')")} AS f, {R6.format("max(v) FILTER (s = 'O')")} AS o, {R6.format("max(v) FILTER (s = 'P')")} AS p, arg_max(s, (n, s)) AS top_status FROM g GROUP BY bucket""")
def group_argmax_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot with explicit values and the most frequent status."""
    g = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("bucket"), F.col("o_orderstatus").alias("s")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))
    side = lambda k: T.round6(F.max(F.when(F.col("s") == k, F.col("v"))))
    return g.groupBy("bucket").agg(side("F").alias("f"), side("O").alias("o"), side("P").alias("p"), F.max_by("s", F.struct("n", "s")).alias("top_status"))


@query("set_equality", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer) SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS n_both, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_a, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_b""")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric comparison of two id sets in one full join."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).withColumn("b", F.lit(1))
    j = a.join(b, "k", "full")
    n = lambda x, y: F.count_if((F.col("a").isNotNull() == x) & (F.col("b").isNotNull() == y))
    return j.agg(n(True, True).alias("n_both"), n(True, False).alias("only_a"), n(False, True).alias("only_b"))


@query("bootstrap_mean")
def bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of the mean discount over orders (one row per order)."""
    u = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg("l_discount").alias("t")).select("t", F.lit(1.0).alias("l"))
    return A.bootstrap_ratio(spark, u, "t", "l", "bootstrap_mean")


@query("bootstrap_cluster")
def bootstrap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster bootstrap of discounted over full price, by supplier."""
    u = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("t"), F.sum("l_extendedprice").alias("l"))
    return A.bootstrap_ratio(spark, u, "t", "l", "bootstrap_cluster")


@query("bootstrap_hier")
def bootstrap_hier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical bootstrap of a paired difference: seeds outside, items inside."""
    r = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 3).alias("seed"), F.col("l_partkey").alias("item"), F.col("l_tax").alias("a"), F.col("l_discount").alias("b"))
    return A.bootstrap_hierarchical(spark, r, "seed", "item", "a", "b", "bootstrap_hier", 300)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = yields(spark, sf_dir).filter("tokens > 0")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.col("p_retailprice").alias("price"), F.char_length("p_name").cast("double").alias("name_len"))
    return y.join(p, "source").withColumn("hit", (F.col("n") > 10).cast("int")).withColumn("n", F.col("n").cast("double")).withColumn("tokens", F.col("tokens").cast("double"))


@query("glm_logistic")
def glm_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression of a high yield per task."""
    return M.fit_groups(_sources(spark, sf_dir).select("task", "price", "name_len", "hit"), "task", ["price", "name_len"], "hit", None)


@query("nb2_fit")
def nb2_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NB2 regression of yields with a log-token offset per task."""
    return M.fit_groups(_sources(spark, sf_dir).select("task", "price", "name_len", "n", "tokens"), "task", ["price", "name_len"], "n", "tokens")


@query("oof_predictions")
def oof_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-fold out-of-fold yield predictions."""
    ids = S.folds(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source")), "source", "oof", 5)
    return M.out_of_fold(_sources(spark, sf_dir).select("task", "source", "price", "name_len", "n", "tokens").join(ids, "source"), "task", "source", ["price", "name_len"], "n", "tokens", 5)


_VIF = "c AS (SELECT corr(p_retailprice, length(p_name)) AS a, corr(p_retailprice, p_size) AS b, corr(length(p_name), p_size) AS c FROM part WHERE p_size > 0), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c)"


@query("feature_vif", f"WITH {_VIF} SELECT 'price' AS feature, {R6.format('(1 - c * c) / det')} AS vif FROM d UNION ALL SELECT 'name_len', {R6.format('(1 - b * b) / det')} FROM d UNION ALL SELECT 'tokens', {R6.format('(1 - a * a) / det')} FROM d")
def feature_vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance inflation of the source features."""
    v = M.variance_inflation(_sources(spark, sf_dir).filter("task = 'A'"), ["price", "name_len", "tokens"])
    return v.select("feature", T.round6(F.col("vif")).alias("vif"))


#: Feature to its role in the models.
FEATURES = {"p_size": "exposure", "p_retailprice": "predictor", "p_brand": "group"}
_FEATURE = "SELECT '{0}' AS feature, '{1}' AS role, (SELECT CASE WHEN typeof(max({0})) IN ('INTEGER', 'BIGINT') THEN 'integer' WHEN typeof(max({0})) = 'DOUBLE' THEN 'real' ELSE 'text' END FROM part) AS kind, count(*) - count({0}) AS n_missing, {2} AS missing_pct, count(DISTINCT {0}) AS n_distinct FROM part"


@query("feature_availability", " UNION ALL ".join(_FEATURE.format(c, r, R6.format(f"100.0 * (count(*) - count({c})) / count(*)")) for c, r in FEATURES.items()))
def feature_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role, kind, missing and distinct values of each feature, in one pass."""
    t = table(spark, sf_dir, "part")
    kinds = {c: "integer" if k in ("int", "bigint") else "real" if k == "double" else "text" for c, k in t.dtypes}
    one = t.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in FEATURES], *[F.countDistinct(c).alias(f"d_{c}") for c in FEATURES])
    row = lambda c, r: F.struct(F.lit(c).alias("feature"), F.lit(r).alias("role"), F.lit(kinds[c]).alias("kind"), F.col(f"m_{c}").alias("n_missing"), T.round6(100.0 * F.col(f"m_{c}") / F.col("n")).alias("missing_pct"), F.col(f"d_{c}").alias("n_distinct"))
    return one.select(F.explode(F.array(*[row(c, r) for c, r in FEATURES.items()])).alias("r")).select("r.*")
