"""Machine verification of candidates: alignment, counterfactuals, claim integrity, label replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import patterns as P
from lodestone.functions import text as T
from lodestone.operators import detect as D

# The conditions of a claim that must survive, with their place in the evidence.
KEPT_CONDITIONS = ("quantity_or_threshold", "spatial", "temporal", "treatment", "comparison")


def aligned(short: Column, long: Column) -> Column:
    """Whether the letters of a short form occur in order in a long form, the first at the start of a word.

    Built from the short form as a pattern and matched by the JVM, so it shares nothing with the detector.
    """
    letters = F.regexp_replace(short, "[^A-Za-z0-9]", "")
    pattern = F.concat(F.lit(r"(?is)(?<![\p{L}\p{N}])"), F.array_join(F.filter(F.split(letters, ""), lambda c: c != ""), ".*"))
    return F.coalesce(F.char_length(letters).between(2, 10) & F.regexp_like(F.coalesce(long, F.lit("")), pattern), F.lit(False))


def contained(needle: Column, text: Column) -> tuple[Column, Column]:
    """Whether a text holds another exactly, and in normal form (never where that form is empty)."""
    n = T.match_text(needle)
    return text.contains(needle), (n != "") & T.match_text(text).contains(n)


def report_task(task: Column, pattern: Column) -> Column:
    """The reported task: terms split into acronyms and explicit definitions."""
    return F.when(task != "T1", task).when(pattern == "explicit_definition", "T1b").otherwise("T1a")


def detect_all(paras: DataFrame) -> DataFrame:
    """Candidates of all three tasks with their verdicts, in the columns they share."""
    shared = ["doc_id", "position", "pattern", "start", "end", "answer", "text", "class", "reject", "accepted", "ready"]
    tasks = {"T1": D.detect_terms, "T2": D.detect_numbers, "T3": D.detect_claims}
    parts = [f(paras).select(F.lit(t).alias("task"), report_task(F.lit(t), F.col("pattern")).alias("report_task"), *shared) for t, f in tasks.items()]
    return reduce(DataFrame.unionByName, parts)


def term_counterfactuals(rows: DataFrame, by: str = "set_id") -> DataFrame:
    """``variant``: the definition of the next row, in the cyclic order of ``id``, whose normal form differs.

    rows: ``by`` (the verification set a row belongs to), id, definition.  Runs of equal definitions are found first, so
    the next differing one is that of the next run; NULL where a set has a single definition.
    """
    order = Window.partitionBy(by).orderBy("id")
    own = rows.withColumn("form", T.match_text(F.col("definition")))
    fresh = F.coalesce((F.col("form") != F.lag("form").over(order)).cast("int"), F.lit(1))
    own = own.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    runs = own.groupBy(by, "run").agg(F.min_by("definition", "id").alias("definition"), F.first("form").alias("form"))
    ring = Window.partitionBy(by).orderBy("run")
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    all_rows = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.slice(F.collect_list(F.struct("definition", "form")).over(all_rows), 1, 2)
    runs = runs.withColumn("next", F.lead(F.struct("definition", "form")).over(ring)).withColumn("head", head).withColumn("n", n)
    after = F.coalesce("next", F.get("head", F.lit(0)))
    after = F.when(after["form"] != F.col("form"), after["definition"]).otherwise(F.get("head", F.lit(1))["definition"])
    return own.join(runs.select(by, "run", F.when(F.col("n") > 1, after).alias("variant")), [by, "run"]).drop("form", "fresh", "run")


def verify_terms(rows: DataFrame, by: str = "set_id") -> DataFrame:
    """Verdicts on term candidates (set_id, id, explicit, term, definition, text, hard).

    An explicit definition must stand in its text.  An acronym must also align with its definition, and must not align
    with its counterfactual.
    """
    acronyms = term_counterfactuals(rows.filter(~F.col("explicit")), by).select(by, "id", "variant")
    j = rows.join(acronyms, [by, "id"], "left")
    present = F.col("text").contains(F.col("term")) & F.col("text").contains(F.col("definition"))
    j = j.withColumn("present", present).withColumn("aligned", F.when(~F.col("explicit"), aligned(F.col("term"), F.col("definition"))))
    j = j.withColumn("counterfactual_pass", F.when(F.col("variant").isNotNull(), ~aligned(F.col("term"), F.col("variant"))))
    rule = F.col("explicit") | (F.col("aligned") & F.coalesce("counterfactual_pass", F.lit(True)))
    return j.withColumn("machine_verified", F.col("hard") & F.col("present") & rule)


def _span_holds(span: Column) -> Column:
    """A condition's span has the words it says, inside the claim, at its place in the evidence."""
    there = F.substring(F.col("text"), span["start"] + 1, span["end"] - span["start"]) == span["text"]
    return F.coalesce((span["text"] != "") & F.col("answer").contains(span["text"]) & there, F.lit(False))


def claim_checks(claims: DataFrame) -> DataFrame:
    """Per claim (text, start, end, answer, conditions): what must be preserved and whether it is; ``claim_reject`` is the first failure."""
    kept = [F.col("conditions")[k] for k in KEPT_CONDITIONS]
    spans = F.filter(F.array(*kept), lambda s: s.isNotNull())
    out = claims.withColumn("exact", T.valid_span(F.col("text"), F.col("start"), F.col("end"), F.col("answer")))
    for cue in ("negation", "uncertainty"):
        has = F.col("answer").rlike("(?i)" + P.CONDITIONS[cue])
        out = out.withColumn(f"has_{cue}", has).withColumn(f"keeps_{cue}", _span_holds(F.col("conditions")[cue]))
    out = out.withColumn("n_spans", F.size(spans)).withColumn("n_kept", F.size(F.filter(spans, _span_holds)))
    reason = F.when(~F.col("exact"), "claim_span_not_traceable").when(F.col("has_negation") & ~F.col("keeps_negation"), "negation_condition_not_preserved")
    reason = reason.when(F.col("has_uncertainty") & ~F.col("keeps_uncertainty"), "uncertainty_condition_not_preserved").when(F.col("n_kept") < F.col("n_spans"), "condition_not_preserved")
    return out.withColumn("claim_reject", reason)


def verify_claims(claims: DataFrame, entailment: Column, threshold: float) -> DataFrame:
    """``machine_verified`` of claims: ready, entailed at the threshold (the score comes in), and nothing lost."""
    return claim_checks(claims).withColumn("machine_verified", F.col("ready") & (entailment >= threshold) & F.col("claim_reject").isNull())


def claim_integrity(claims: DataFrame) -> DataFrame:
    """(check, n, passed, rate) over claims: exact spans, negation, uncertainty, condition spans, and claims with all of theirs."""
    c = claim_checks(claims)
    pairs = {
        "exact_evidence_span": (F.count("*"), F.count_if("exact")),
        "negation": (F.count_if("has_negation"), F.count_if(F.col("has_negation") & F.col("keeps_negation"))),
        "uncertainty": (F.count_if("has_uncertainty"), F.count_if(F.col("has_uncertainty") & F.col("keeps_uncertainty"))),
        "condition_spans": (F.sum("n_spans"), F.sum("n_kept")),
        "claims_with_conditions": (F.count_if(F.col("n_spans") > 0), F.count_if((F.col("n_spans") > 0) & (F.col("n_kept") == F.col("n_spans")))),
    }
    one = c.agg(*[F.coalesce(x.cast("long"), F.lit(0)).alias(f"{k}_{i}") for k, v in pairs.items() for i, x in enumerate(v)])
    rows = [F.struct(F.lit(k).alias("check"), F.col(f"{k}_0").alias("n"), F.col(f"{k}_1").alias("passed"), T.round6(F.try_divide(F.col(f"{k}_1").cast("double"), F.nullif(F.col(f"{k}_0"), F.lit(0)))).alias("rate")) for k in pairs]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def rejection_rates(variants: DataFrame, by: str, score: str, rule: str, threshold: float) -> DataFrame:
    """Share of counterfactuals of each kind rejected by the score, by the rule, and by either."""
    low = F.col(score) < threshold
    share = lambda c: T.round6(F.avg(F.coalesce(c, F.lit(False)).cast("double")))
    return variants.groupBy(by).agg(F.count("*").alias("n"), share(low).alias("score_reject_rate"), share(F.col(rule)).alias("rule_reject_rate"), share(low | F.col(rule)).alias("combined_reject_rate"))


def replay_labels(rows: DataFrame, stored: str, primitives: dict[str, Column], ready: Column) -> DataFrame:
    """``replayed`` from the primitive outcomes, ``mismatch`` with the stored label, and the transition under the hierarchy."""
    replayed = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in primitives.values()])
    out = rows.withColumn("replayed", replayed).withColumn("mismatch", F.col("replayed") != F.col(stored))
    kind = F.when(~F.col("replayed"), "not_accepted").when(ready, "accepted_unchanged").otherwise("accepted_but_not_ready")
    return out.withColumn("transition", kind).withColumn("verified", F.col("replayed") & ready)


def coverage_ratios(rows: DataFrame, by: str, checks: dict[str, Column]) -> DataFrame:
    """(by, n, share of rows passing each check)."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[T.round6(F.avg(F.coalesce(c, F.lit(False)).cast("double"))).alias(k) for k, c in checks.items()])
