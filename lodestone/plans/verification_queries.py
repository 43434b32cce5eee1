"""Verification of candidates: hand-derived cases with their expected rows, and rates over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import detect as D
from lodestone.operators import scaling as M
from lodestone.operators import verify as V
from lodestone.plans.detection_queries import FIXTURE
from lodestone.plans.registry import Registry, table
from lodestone.shipping import ship

query = Registry()
R6 = "floor(({0})::DOUBLE * 1e6 + 0.5) / 1e6"


def _values(rows: list[tuple]) -> str:
    lit = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


ALIGNED = [
    ("TOC", "total organic carbon", True), ("XYZ", "loose soil water", False), ("DNA", "deoxyribonucleic acid", True), ("CO2", "carbon dioxide", False), ("A", "alpha", False),
    ("NGS", "next-generation sequencing", True), ("SE", "close effort", False), ("PCR", "Polymerase chain reaction", True), ("OC", "organic-carbon", True), ("TOC", None, False),
]


@query("acronym_alignment", f"SELECT term, definition, aligned FROM ({_values(ALIGNED)}) AS t(term, definition, aligned)")
def acronym_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second alignment of short and long forms, on hand-derived pairs."""
    rows = spark.createDataFrame([r[:2] for r in ALIGNED], "term string, definition string")
    return rows.select("term", "definition", V.aligned(F.col("term"), F.col("definition")).alias("aligned"))


TERMS = [
    # set, id, explicit, term, definition, text, hard; then aligned, variant, counterfactual_pass, machine_verified
    (1, "c0", False, "OC", "organic carbon", "organic carbon (OC)", True, True, "total organic carbon", False, False),
    (1, "c1", False, "TOC", "total organic carbon", "The total organic carbon (TOC)", True, True, "polymerase chain reaction", True, True),
    (1, "c2", False, "PCR", "polymerase chain reaction", "polymerase chain reaction (PCR)", True, True, "loose soil water", True, True),
    (1, "c3", False, "PCR", "Polymerase chain  reaction", "Polymerase chain  reaction (PCR)", False, True, "loose soil water", True, False),
    (1, "c4", False, "XYZ", "loose soil water", "loose soil water (XYZ)", True, False, "organic carbon", True, False),
    (1, "c5", True, "Albedo", "the share of light sent back", "Albedo refers to the share of light sent back.", True, None, None, None, True),
    (1, "c6", True, "Albedo", "the share of light", "No such words.", True, None, None, None, False),
    (2, "d1", False, "ABC", "alpha beta case", "alpha beta case (ABC)", True, True, None, None, True),
    (3, "e1", False, "AB", "alpha bet", "alpha bet (AB)", True, True, "core deck", True, True),
    (3, "e2", False, "CD", "core deck", "core deck (CD)", True, True, "Alpha bet", True, True),
    (3, "e3", False, "AB", "Alpha bet", "Alpha bet (AB)", True, True, "core deck", True, True),
]


@query("verify_terms", f"SELECT id, coalesce(aligned::VARCHAR, 'none') AS aligned, coalesce(variant, 'none') AS variant, coalesce(counterfactual_pass::VARCHAR, 'none') AS counterfactual_pass, machine_verified FROM ({_values([(r[1], *r[7:]) for r in TERMS])}) AS t(id, aligned, variant, counterfactual_pass, machine_verified)")
def verify_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with their cyclic counterfactuals, on hand-derived sets."""
    rows = spark.createDataFrame([r[:7] for r in TERMS], "set_id int, id string, explicit boolean, term string, definition string, text string, hard boolean")
    said = [F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in ("aligned", "variant", "counterfactual_pass")]
    return V.verify_terms(rows).select("id", *said, "machine_verified")


CLAIMS = [
    ("c1", 0, "Results", "Soil moisture increased strongly under drought treatment in the northern basin."),
    ("c2", 0, "Results", "Yields did not increase significantly after irrigation compared with dry plots."),
    ("c3", 0, "Results", "Dense biomass may have reduced nitrogen losses in wet soils."),
    ("c4", 0, "Results", "Soil moisture increased strongly under drought treatment in the northern basin."),
]


def _claims(spark: SparkSession) -> DataFrame:
    """Detected claims; the spans of the last are moved by one character, as damaged ones would be."""
    ship(spark)
    rows = spark.createDataFrame([(d, p, s, True, t) for d, p, s, t in CLAIMS], "doc_id string, position long, section string, provenance_ok boolean, text string")
    moved = F.transform_values("conditions", lambda _, s: F.struct(s["text"].alias("text"), (s["start"] + 1).alias("start"), (s["end"] + 1).alias("end")))
    return D.detect_claims(rows).withColumn("conditions", F.when(F.col("doc_id") == "c4", moved).otherwise(F.col("conditions")))


@query("verify_claims", "SELECT * FROM (VALUES ('c1', 2, 2, 'none', true), ('c2', 2, 2, 'none', false), ('c3', 0, 0, 'none', true), ('c4', 2, 0, 'condition_not_preserved', false)) AS t(doc_id, n_spans, n_kept, claim_reject, machine_verified)")
def verify_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with a given entailment score: the second is not entailed, the fourth lost its spans."""
    score = F.when(F.col("doc_id") == "c2", 0.2).otherwise(0.9)
    return V.verify_claims(_claims(spark), score, 0.5).select("doc_id", "n_spans", "n_kept", F.coalesce("claim_reject", F.lit("none")).alias("claim_reject"), "machine_verified")


@query("claim_integrity", f"""SELECT c AS "check", n, p AS passed, {R6.format('p / n')} AS rate FROM (VALUES ('exact_evidence_span', 4, 4), ('negation', 1, 1), ('uncertainty', 1, 1), ('condition_spans', 6, 4), ('claims_with_conditions', 3, 2)) AS t(c, n, p)""")
def claim_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the hand-derived claims is preserved."""
    return V.claim_integrity(_claims(spark))


SIDES = [("c1", "Soil moisture", 0, 13, "strongly under drought treatment in the northern basin.", 24, 79, "Intro words here.|After words."), ("c2", "Yields did not", 0, 14, "significantly after irrigation compared with dry plots.", 24, 79, "")]


@query("claim_sides", f"SELECT * FROM ({_values(SIDES)}) AS t(doc_id, subject, subject_start, subject_end, outcome, outcome_start, outcome_end, supports)")
def claim_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject and outcome of hand-derived claims with their places, and the paragraphs around them in their section."""
    ship(spark)
    rows = [("c1", 0, "Results", "Intro words here."), ("c1", 1, "Results", CLAIMS[0][3]), ("c1", 2, "Methods", "Elsewhere."), ("c1", 3, "Results", "After words."), ("c2", 0, "Results", CLAIMS[1][3])]
    paras = spark.createDataFrame([(d, p, s, True, t) for d, p, s, t in rows], "doc_id string, position long, section string, provenance_ok boolean, text string")
    c = D.with_supports(D.detect_claims(paras), paras)
    return c.select("doc_id", "subject", "subject_start", "subject_end", "outcome", "outcome_start", "outcome_end", F.array_join("supports", "|").alias("supports"))


PRESERVED = [
    (1, "12 mg/L", "about 12  mg/L", True, True, True, True), (2, "p < 0.05", "p > 0.05", True, False, True, True), (3, "did not rise", "rose", True, True, False, True),
    (4, "may rise by 5 %", "rises by 5 percent", True, True, True, False), (5, "3 kg", "3 g", False, True, True, True),
]


@query("preservation_flags", f"SELECT id, unit, operator, negation, uncertainty FROM ({_values([(r[0], *r[3:]) for r in PRESERVED])}) AS t(id, unit, operator, negation, uncertainty)")
def preservation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether hand-made replies keep unit, comparison, negation and uncertainty of what they answer."""
    rows = spark.createDataFrame([r[:3] for r in PRESERVED], "id int, gold string, found string")
    return rows.select("id", *[c.alias(k) for k, c in M.preservation_flags(F.col("gold"), F.col("found")).items()])


#: The first failing rule of each candidate in the paragraphs of the detectors' fixture, derived by hand.
DETECTED = [
    ("T1", "T1a", "f1", 0, None), ("T1", "T1a", "f1", 1, "duplicate_term_definition_within_paper"), ("T1", "T1a", "f2", 0, "acronym_long_form_alignment_failed"),
    ("T1", "T1a", "f3", 0, "excluded_structural_section"), ("T1", "T1a", "f3", 1, None), ("T2", "T2", "f4", 0, None), ("T2", "T2", "f4", 1, "year_like_1800_2100"), ("T2", "T2", "f4", 2, None),
    ("T3", "T3", "f5", 0, None), ("T3", "T3", "f5", 1, "background_or_ineligible_section"), ("T3", "T3", "f5", 2, "incomplete_statement_no_terminal_punctuation"),
]


@query("detect_fixture", f"SELECT task, report_task, doc_id, position, coalesce(reject, 'none') AS reject FROM ({_values(DETECTED)}) AS t(task, report_task, doc_id, position, reject)")
def detect_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three detectors over their hand-derived paragraphs."""
    ship(spark)
    rows = spark.createDataFrame([(d, p, s, True, t) for d, p, s, t in FIXTURE], "doc_id string, position long, section string, provenance_ok boolean, text string")
    return V.detect_all(rows).select("task", "report_task", "doc_id", "position", F.coalesce("reject", F.lit("none")).alias("reject"))


SIGNATURES = [
    ("12.5 ± 0.3 mg/L", "12.5,0.3|mg/L|±", "mg/L±", "pm"), ("p < 0.05", "0.05||<", "p<", "lt"), ("1,200 km", "1200|km|", "km", "none"), ("≤ 3 %", "3|%|≤", "≤%", "le"), ("5 percent", "5||", "%", "none"),
]


@query("numeric_signatures", f"SELECT * FROM ({_values([(a, b, d) for a, b, _, d in SIGNATURES])}) AS t(answer, signature, operator)")
def numeric_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of hand-derived answers, and their comparison."""
    ship(spark)
    rows = spark.createDataFrame([r[:1] for r in SIGNATURES], "answer string")
    return rows.select("answer", D.signature(F.col("answer")).alias("signature"), M.operator_signature(F.col("answer")).alias("operator"))


CONTAINED = [("50 percent", "rose by 50  Percent in May", False, True), ("50 %", "rose by 50 % in May", True, True), ("x", "", False, False), ("", "any", True, False), ("Alpha beta", "so alpha\tbeta went", False, True)]


@query("containment", f"SELECT * FROM ({_values(CONTAINED)}) AS t(needle, hay, exact, normal)")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and normalized containment of hand-derived pairs."""
    rows = spark.createDataFrame([r[:2] for r in CONTAINED], "needle string, hay string")
    exact, normal = V.contained(F.col("needle"), F.col("hay"))
    return rows.select("needle", "hay", exact.alias("exact"), normal.alias("normal"))


@query("counterfactual_rejection", f"""SELECT o_orderpriority AS kind, count(*) AS n, {R6.format('avg((o_totalprice / 500000 < 0.3)::INT)')} AS score_reject_rate, {R6.format("avg((o_orderstatus = 'F')::INT)")} AS rule_reject_rate,
  {R6.format("avg((o_totalprice / 500000 < 0.3 OR o_orderstatus = 'F')::INT)")} AS combined_reject_rate FROM orders GROUP BY 1""")
def counterfactual_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejection by score, rule and either, per kind (scores and rules of orders stand in)."""
    v = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), (F.col("o_totalprice") / 500000).alias("score"), (F.col("o_orderstatus") == "F").alias("rule"))
    return V.rejection_rates(v, "kind", "score", "rule", 0.3)


_REPLAY = "s AS (SELECT doc_id, n_chars > 200 AS span, toxic = 0 AS unit, quality = 1 AS ready, n_chars > 200 AND toxic = 0 AND doc_id % 50 <> 7 AS stored FROM documents JOIN labels USING (doc_id))"


@query("label_replay", f"""WITH {_REPLAY}, r AS (SELECT *, span AND unit AS replayed FROM s) SELECT CASE WHEN NOT replayed THEN 'not_accepted' WHEN ready THEN 'accepted_unchanged' ELSE 'accepted_but_not_ready' END AS transition,
  count(*) AS n, count(*) FILTER (replayed <> stored) AS n_mismatch, count(*) FILTER (replayed AND ready) AS n_verified FROM r GROUP BY 1""")
def label_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels rebuilt from their primitives, against stored ones of which some were damaged."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    span, unit = F.col("n_chars") > 200, F.col("toxic") == 0
    d = d.withColumn("stored", span & unit & (F.col("doc_id") % 50 != 7))
    r = V.replay_labels(d, "stored", {"span": span, "unit": unit}, F.col("quality") == 1)
    return r.groupBy("transition").agg(F.count("*").alias("n"), F.count_if("mismatch").alias("n_mismatch"), F.count_if("verified").alias("n_verified"))


@query("coverage_ratios", f"SELECT lang, count(*) AS n, {R6.format('avg((coalesce(n_chars, 0) > 0 AND source IS NOT NULL)::INT)')} AS provenance, {R6.format('avg(coalesce(length(text) = n_chars, false)::INT)')} AS span FROM documents GROUP BY lang")
def coverage_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of documents with provenance, and whose length is the recorded one."""
    docs = table(spark, sf_dir, "documents")
    return V.coverage_ratios(docs, "lang", {"provenance": (F.coalesce("n_chars", F.lit(0)) > 0) & F.col("source").isNotNull(), "span": F.char_length("text") == F.col("n_chars")})


@query("text_flags", r"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations) SELECT conv_id, turn, """ + " OR ".join(f"contains(' ' || lower(x) || ' ', '{c.replace(chr(39), chr(39) * 2)}')" for c in T.NEGATION_CUES)
       + r" AS negated, regexp_matches(lower(x), '\b(?:" + "|".join(T.UNCERTAINTY_CUES) + r")') AS uncertain, regexp_matches(x, '(?:^|[^\pL\pN_])(?:[A-Za-z]{3,}-\s+[a-z]{2,}|[A-Za-z]{2,}\s+(?:" + T.STRAY_ENDINGS + r"))(?:$|[^\pL\pN_])') AS word_split FROM t")
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negation, uncertainty and suspected word splits of every turn."""
    x = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.negated(x).alias("negated"), T.uncertain(x).alias("uncertain"), T.word_split_suspected(x).alias("word_split"))
