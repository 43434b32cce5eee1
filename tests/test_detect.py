"""Detectors on hand-derived paragraphs, and properties of their parts."""

from __future__ import annotations

from lodestone.operators import detect as D
from lodestone.plans.detection_queries import FIXTURE


def _input(spark, rows=FIXTURE):
    return spark.createDataFrame([(d, p, s, True, t) for d, p, s, t in rows], "doc_id string, position long, section string, provenance_ok boolean, text string")


def test_terms(spark):
    got = {(r.doc_id, r.position): (r.term, r.definition, r.reject) for r in D.detect_terms(_input(spark)).collect()}
    assert got["f1", 0] == ("TOC", "total organic carbon", None)
    assert got["f1", 1][2] == "duplicate_term_definition_within_paper"
    assert got["f2", 0][2] == "acronym_long_form_alignment_failed"
    assert got["f3", 0][2] == "excluded_structural_section"
    assert got["f3", 1][2] is None, "a rejected candidate never shadows a later one"


def test_numbers(spark):
    rows = {(r.doc_id, r.position): r for r in D.detect_numbers(_input(spark)).filter("doc_id = 'f4'").collect()}
    assert rows["f4", 0].subtype == "mean_dispersion" and rows["f4", 0].unit == "mg/L" and rows["f4", 0].accepted
    assert rows["f4", 1].reject == "year_like_1800_2100"
    assert rows["f4", 2].subtype == "statistical_value" and rows["f4", 2].ready
    assert len(rows) == 3


def test_claims(spark):
    rows = {r.position: r for r in D.detect_claims(_input(spark)).filter("doc_id = 'f5'").collect()}
    assert rows[0].accepted and rows[0].ready and rows[0].relation == "increased" and rows[0].polarity == "positive"
    assert "treatment" in rows[0].conditions and "spatial" in rows[0].conditions
    assert rows[1].reject == "background_or_ineligible_section"
    assert rows[2].reject == "incomplete_statement_no_terminal_punctuation"


def test_verdicts_do_not_depend_on_partitions(spark):
    one = sorted(map(str, D.detect_terms(_input(spark).coalesce(1)).select("doc_id", "position", "reject").collect()))
    many = sorted(map(str, D.detect_terms(_input(spark).repartition(7)).select("doc_id", "position", "reject").collect()))
    assert one == many


def test_sentences():
    t = "See Fig. 3 for it. The rest (see al. 2) follows! Is it? Yes."
    assert [t[a:b] for a, b in D.sentences(t)] == ["See Fig. 3 for it.", "The rest (see al. 2) follows!", "Is it?", "Yes."]
    assert D.sentences("") == [] and D.sentences("  x ") == [(2, 3)]


def test_acronyms():
    assert D.acronym_fits("TOC", "total organic carbon")
    assert D.acronym_fits("DNA", "deoxyribonucleic acid")
    assert not D.acronym_fits("XYZ", "soil water")
    assert not D.acronym_fits("A", "alpha")


def test_counterfactuals_differ():
    for a in ("12.5 ± 0.3 mg/L", "p < 0.05", "3-5 km", "40%"):
        for _, v in D.numeric_variants(a):
            assert v != a and D.numeric_signature(v) != D.numeric_signature(a)
    s = "Soil moisture increased under drought compared with controls."
    kinds = dict(D.claim_variants(s))
    assert "decreased" in kinds["direction_flip"] and "compared" not in kinds["comparison_removal"]
