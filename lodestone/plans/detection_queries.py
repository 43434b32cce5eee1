"""Detectors, cascades, verification and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import patterns as P
from lodestone.functions import text as T
from lodestone.operators import corpus as C
from lodestone.operators import detect as D
from lodestone.operators import stats as A
from lodestone.plans.corpus_queries import PARAS
from lodestone.plans.registry import Registry, table

query = Registry()
R6 = "floor(({0})::DOUBLE * 1e6 + 0.5) / 1e6"
#: The invented prose of the tables holds hardly any acronym, quantity or claim; these paragraphs do.
FIXTURE = [
    ("f1", 0, "Results", "The total organic carbon (TOC) content was measured in all cores."),
    ("f1", 1, "Results", "The total organic carbon (TOC) content was measured in all cores again."),
    ("f2", 0, "Results", "Loose soil water (XYZ) was sampled."),
    ("f3", 0, "References", "The total organic carbon (TOC) content was measured in all cores."),
    ("f3", 1, "Results", "The total organic carbon (TOC) content was measured in all cores."),
    ("f4", 0, "Results", "The mean concentration was 12.5 ± 0.3 mg/L in the deep samples."),
    ("f4", 1, "Methods", "Samples were collected during 2015 at four remote stations."),
    ("f4", 2, "Results", "Growth differed between the two groups (p < 0.05) in that regression."),
    ("f5", 0, "Results", "Soil moisture increased strongly under drought treatment in the northern basin."),
    ("f5", 1, "Introduction", "Soil moisture increased strongly under drought treatment in the northern basin."),
    ("f5", 2, "Results", "Soil moisture increased strongly under drought treatment in the northern basin"),
]


def candidates_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paragraphs of documents in a section cycling by position, and the fixture."""
    p = C.paragraphs(table(spark, sf_dir, "documents"))
    sections = F.array(*[F.lit(x) for x in ("Introduction", "Methods", "Results", "Discussion")])
    own = p.select(F.col("doc_id").cast("string").alias("doc_id"), "position", F.get(sections, F.expr("cast(position % 4 as int)")).alias("section"), F.lit(True).alias("provenance_ok"), F.col("clean_text").alias("text"))
    extra = spark.createDataFrame(FIXTURE, "doc_id string, position long, section string, text string").select("doc_id", "position", "section", F.lit(True).alias("provenance_ok"), "text")
    return own.unionByName(extra)


_OUT = ("doc_id", "position", "pattern", "start", "end", "answer", "reject", "accepted", "ready")


_ABBREVIATIONS = "|".join(a.replace(".", r"\.") for a in P.ABBREVIATIONS)


@query("sentences", rf"""WITH {PARAS}, m AS (SELECT doc_id, position, string_split(regexp_replace(regexp_replace(clean_text, '([.!?])(\s+)([A-Z0-9(])', '\1\2' || chr(1) || '\3', 'g'), '(?i)((?:{_ABBREVIATIONS})\s+)\x01', '\1', 'g'), chr(1)) AS p FROM paras),
  u AS (SELECT doc_id, position, unnest(p) AS x, unnest(range(len(p))) AS k, p FROM m), o AS (SELECT doc_id, position, x, coalesce(list_sum(list_transform(p[1:k], lambda y: length(y))), 0)::BIGINT AS lo FROM u)
  SELECT doc_id, position, lo AS start, lo + length(trim(x)) AS "end", sha256(trim(x)) AS sentence_sha FROM o WHERE trim(x) <> ''""")
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every paragraph with their offsets."""
    return D.sentence_table(C.paragraphs(table(spark, sf_dir, "documents"))).select("doc_id", "position", "start", "end", F.sha2("sentence", 256).alias("sentence_sha"))


@query("detect_t1")
def detect_t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect_terms(candidates_input(spark, sf_dir)).select(*_OUT, "term", "definition")


@query("detect_t2")
def detect_t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect_numbers(candidates_input(spark, sf_dir)).select(*_OUT, "subtype", "unit")


@query("detect_t3")
def detect_t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect_claims(candidates_input(spark, sf_dir)).select(*_OUT, "relation", "polarity", F.array_join(F.array_sort(F.map_keys("conditions")), ",").alias("condition_kinds"))


@query("counterfactual_numeric")
def counterfactual_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric candidates with their counterfactual check."""
    d = D.detect_numbers(candidates_input(spark, sf_dir)).withColumn("id", T.stable_id("cand", F.col("doc_id"), F.col("position"), F.col("start"), F.col("answer")))
    return D.verify_numbers(d, D.counterfactuals(d, "T2")).select("id", "answer", "signature", "n_variants", "counterfactual_pass", "machine_verified")


@query("counterfactual_claims")
def counterfactual_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed counterfactuals of accepted claims, counted by kind."""
    d = D.detect_claims(candidates_input(spark, sf_dir)).filter("accepted").withColumn("id", T.stable_id("cand", F.col("doc_id"), F.col("position"), F.col("start"), F.col("answer")))
    return D.counterfactuals(d, "T3").groupBy("kind").agg(F.count("*").alias("n"))


_CASCADE = r"""CASE WHEN length(clean_text) < 18 THEN 'too_short' WHEN regexp_matches(clean_text, '[#*$%&|<>]{3}') THEN 'symbols' WHEN NOT regexp_matches(clean_text, '[.!?]$') THEN 'no_terminal_punctuation'
  WHEN contains(lower(clean_text), 'license') THEN 'license' WHEN length(clean_text) > 500 THEN 'too_long' END"""


@query("reject_cascade_counts", f"""WITH {PARAS}, r AS (SELECT d.lang, coalesce({_CASCADE}, 'accepted') AS reason FROM paras JOIN documents d USING (doc_id)), cnt AS (SELECT lang, reason, count(*) AS n FROM r GROUP BY ALL)
  SELECT lang, reason, n FROM cnt QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, reason) <= 5""")
def reject_cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent first-failing rules per language."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("raw")).select("lang", T.ascii_clean(F.col("raw")).alias("t")).filter("t <> ''")
    rules = {
        "too_short": F.char_length("t") < 18,
        "symbols": F.col("t").rlike(r"[#*$%&|<>]{3}"),
        "no_terminal_punctuation": ~F.col("t").rlike(r"[.!?]\z"),
        "license": F.lower("t").contains("license"),
        "too_long": F.char_length("t") > 500,
    }
    c = lines.withColumn("reason", F.coalesce(C.first_failing(rules), F.lit("accepted"))).groupBy("lang", "reason").agg(F.count("*").alias("n"))
    from lodestone.operators.selection import top_k

    return top_k(c, ["lang"], [F.desc("n"), F.asc("reason")], 5).select("lang", "reason", "n")


_LATTICE = "s AS (SELECT doc_id, n_chars > 200 AS raw_ok, n_chars > 400 AS hard_ok, quality = 1 AS ready, toxic = 0 AS verified FROM documents JOIN labels USING (doc_id))"


@query("stage_lattice_audit", f"""WITH {_LATTICE} SELECT 'hard_implies_raw' AS gate, count(*) FILTER (hard_ok AND NOT raw_ok) AS n_failed, count(*) FILTER (hard_ok AND NOT raw_ok) = 0 AS passed FROM s
  UNION ALL SELECT 'ready_implies_hard', count(*) FILTER (ready AND NOT hard_ok), count(*) FILTER (ready AND NOT hard_ok) = 0 FROM s UNION ALL SELECT 'verified_implies_ready', count(*) FILTER (verified AND NOT ready), count(*) FILTER (verified AND NOT ready) = 0 FROM s""")
def stage_lattice_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of stage implications."""
    s = _labelled(spark, sf_dir)
    raw, hard, ready, ver = F.col("n_chars") > 200, F.col("n_chars") > 400, F.col("quality") == 1, F.col("toxic") == 0
    return C.gates({"hard_implies_raw": ~hard | raw, "ready_implies_hard": ~ready | hard, "verified_implies_ready": ~ver | ready}, s)


@query("hierarchy_repair", f"""WITH {_LATTICE}, t AS (SELECT verified AS before, verified AND ready AND hard_ok AND raw_ok AS after FROM s) SELECT CASE WHEN before AND after THEN 'kept' WHEN before THEN 'demoted' ELSE 'never' END AS transition, count(*) AS n FROM t GROUP BY 1""")
def hierarchy_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels after repair: verified only where every earlier stage holds."""
    s = _labelled(spark, sf_dir).withColumn("before", F.col("toxic") == 0)
    after = F.col("before") & (F.col("quality") == 1) & (F.col("n_chars") > 400)
    return s.groupBy(F.when(F.col("before") & after, "kept").when(F.col("before"), "demoted").otherwise("never").alias("transition")).agg(F.count("*").alias("n"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


_TRUTH = "l AS (SELECT doc_id, lang, source, quality = 1 AS truth, toxic = 1 AS toxic, n_chars > 1200 AS pred, n_chars FROM documents JOIN labels USING (doc_id))"


@query("binary_metrics", f"""WITH {_TRUTH}, c AS (SELECT lang, count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND pred) AS fp, count(*) FILTER (truth AND NOT pred) AS fn, count(*) FILTER (NOT truth AND NOT pred) AS tn FROM l GROUP BY lang)
  SELECT *, {R6.format('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {R6.format('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall, {R6.format('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f FROM c""")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts, precision, recall and F1 by language."""
    c = _labelled(spark, sf_dir).groupBy("lang").agg(*A.binary_counts(F.col("quality") == 1, F.col("n_chars") > 1200))
    return c.select("*", *[T.round6(v).alias(k) for k, v in A.f_beta().items()])


@query("threshold_sweep", f"""WITH {_TRUTH}, e AS (SELECT n_chars AS s, count(*) FILTER (truth) AS t, count(*) FILTER (NOT truth) AS f FROM l GROUP BY 1), c AS (SELECT s, sum(t) OVER w AS tp, sum(f) OVER w AS fp, sum(t) OVER () AS pos FROM e WINDOW w AS (ORDER BY s DESC)),
  m AS (SELECT s, tp / (tp + fp) AS p, tp / pos AS r FROM c), b AS (SELECT s, p, r, coalesce(1.25 * p * r / nullif(0.25 * p + r, 0), 0) AS f FROM m)
  SELECT s AS threshold, {R6.format('p')} AS precision, {R6.format('r')} AS recall, {R6.format('f')} AS f FROM b ORDER BY b.f DESC, p DESC, s DESC LIMIT 1""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length threshold with the best F0.5."""
    b = A.best_threshold(_labelled(spark, sf_dir).withColumn("truth", F.col("quality") == 1), "n_chars", "truth")
    return b.select("threshold", *[T.round6(F.col(c)).alias(c) for c in ("precision", "recall", "f")])


@query("set_prf", f"""WITH {_TRUTH}, g AS (SELECT doc_id FROM l WHERE truth), p AS (SELECT doc_id FROM l WHERE pred), b AS (SELECT count(*) AS n FROM g JOIN p USING (doc_id))
  SELECT (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM p) AS n_found, n AS n_both, {R6.format('CASE WHEN (SELECT count(*) FROM p) = 0 THEN 1 ELSE n / (SELECT count(*) FROM p) END')} AS precision, {R6.format('CASE WHEN (SELECT count(*) FROM g) = 0 THEN 1 ELSE n / (SELECT count(*) FROM g) END')} AS recall FROM b""")
def set_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set precision and recall of ids."""
    d = _labelled(spark, sf_dir)
    m = A.set_prf(d.filter("quality = 1"), d.filter("n_chars > 1200"), ["doc_id"])
    return m.select("n_gold", "n_found", "n_both", T.round6(F.col("precision")).alias("precision"), T.round6(F.col("recall")).alias("recall"))


@query("eligibility_funnel", f"""WITH {_TRUTH}, s AS (SELECT count(*) AS a, count(*) FILTER (truth) AS b, count(*) FILTER (truth AND NOT toxic) AS c, count(*) FILTER (truth AND NOT toxic AND pred) AS d FROM l)
  SELECT 1::BIGINT AS stage_order, 'quality' AS stage, a AS input_n, b AS remaining_n, a - b AS excluded_n FROM s UNION ALL SELECT 2, 'clean', b, c, b - c FROM s UNION ALL SELECT 3, 'long', c, d, c - d FROM s""")
def eligibility_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows entering and leaving each stage."""
    return A.funnel(_labelled(spark, sf_dir), {"quality": F.col("quality") == 1, "clean": F.col("toxic") == 0, "long": F.col("n_chars") > 1200})


@query("density_smd_comparison", f"""WITH {_TRUTH} SELECT count(*) FILTER (truth) AS n1, count(*) FILTER (NOT truth) AS n0, {R6.format('avg(n_chars) FILTER (truth)')} AS mean1, {R6.format('avg(n_chars) FILTER (NOT truth)')} AS mean0,
  {R6.format('(avg(n_chars) FILTER (truth) - avg(n_chars) FILTER (NOT truth)) / sqrt((var_samp(n_chars) FILTER (truth) + var_samp(n_chars) FILTER (NOT truth)) / 2)')} AS smd, {R6.format('median(n_chars) FILTER (truth)')} AS median1, {R6.format('median(n_chars) FILTER (NOT truth)')} AS median0,
  {R6.format('abs(avg((n_chars > 0)::INT) FILTER (truth) - avg((n_chars > 0)::INT) FILTER (NOT truth))')} AS share_difference FROM l""")
def density_smd_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardized difference of lengths between quality groups."""
    m = A.mean_difference(_labelled(spark, sf_dir), F.col("quality") == 1, "n_chars")
    return m.select("n1", "n0", *[T.round6(F.col(c)).alias(c) for c in ("mean1", "mean0", "smd", "median1", "median0", "share_difference")])


_JUDGE = "j AS (SELECT doc_id, k AS judge, CASE WHEN (doc_id + k * quality) % 4 < 2 THEN 'Accept' WHEN (doc_id + k) % 3 = 0 THEN 'Reject' ELSE 'Borderline' END AS label FROM labels, (SELECT unnest([0, 1, 2]) AS k))"


def _judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("judge"))
    label = F.when((F.col("doc_id") + F.col("judge") * F.col("quality")) % 4 < 2, "Accept").when((F.col("doc_id") + F.col("judge")) % 3 == 0, "Reject").otherwise("Borderline")
    return rows.select("doc_id", "judge", label.alias("label"))


@query("consensus", f"""WITH {_JUDGE}, n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (label = 'Accept') AS n_accept, count(*) FILTER (label = 'Reject') AS n_reject, count(DISTINCT label) AS n_labels FROM j GROUP BY doc_id)
  SELECT *, n_accept >= 2 AND n_reject = 0 AS strict, n_accept >= 2 AS relaxed, n_accept > 0 AND n_reject > 0 AS conflict, n_labels = 1 AS complete FROM n""")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority flags over three judges."""
    return A.consensus(_judgments(spark, sf_dir), "doc_id", "label", "Accept", "Reject")


@query("fleiss_kappa", f"""WITH {_JUDGE}, c AS (SELECT doc_id, label, count(*) AS n FROM j GROUP BY ALL), i AS (SELECT doc_id, sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) AS a FROM c GROUP BY doc_id), r AS (SELECT avg(a) AS pa, count(*) AS n FROM i),
  s AS (SELECT label, sum(n) AS n FROM c GROUP BY label), e AS (SELECT sum(n * n) / (sum(n) * sum(n)) AS pe FROM s) SELECT n AS n_items, {R6.format('pa')} AS agreement, {R6.format('(pa - pe) / nullif(1 - pe, 0)')} AS kappa FROM r, e""")
def fleiss_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleiss' kappa over three judges."""
    return A.fleiss(_judgments(spark, sf_dir), "doc_id", "label").select("n_items", T.round6(F.col("agreement")).alias("agreement"), T.round6(F.col("kappa")).alias("kappa"))
