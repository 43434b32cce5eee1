"""Candidate spans for terms, numbers and claims, and the cascades that judge them.

Finding spans needs Python's regular expressions and offsets, so one Arrow-fed pass over paragraphs emits raw
candidates with the facts the rules ask for.  Every decision after that, including "first accepted wins" dedup inside
a document, is Catalyst.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import patterns as P
from lodestone.functions import text as T
from lodestone.operators.corpus import first_failing

PARAGRAPH = "doc_id string, position long, section string, provenance_ok boolean, text string"
_COMMON = PARAGRAPH + ", pattern string, pattern_order int, start int, end int, answer string, anchor_start int, anchor string"
_BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9(])")
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9'/-]*")


def sentences(text: str) -> list[tuple[int, int]]:
    """Offsets of sentences: a stop, white space, then a capital, digit or bracket, unless an abbreviation ends there."""
    cuts = [m.span() for m in _BREAK.finditer(text)]
    spans, start = [], 0
    for lo, hi in [*cuts, (len(text), len(text))]:
        if lo < len(text) and text[max(start, lo - 16) : lo].casefold().endswith(P.ABBREVIATIONS):
            continue
        body = text[start:lo]
        if body.strip():
            head = start + len(body) - len(body.lstrip())
            spans.append((head, head + len(body.strip())))
        start = hi
    return spans


def enclosing(spans: list[tuple[int, int]], lo: int, hi: int, length: int) -> tuple[int, int]:
    """The sentence that holds a span, or the whole text."""
    return next((s for s in spans if s[0] <= lo and hi <= s[1]), (0, length))


def acronym_fits(acronym: str, long_form: str) -> bool:
    """Initials of the content words end in the acronym, or its characters occur in order from a word's start."""
    letters = re.sub(r"[^A-Z0-9]", "", acronym.upper())
    words = [w for w in (re.sub(r"[^A-Za-z0-9]", "", x) for x in long_form.split()) if w]
    if not (2 <= len(letters) <= 10 and words):
        return False
    if "".join(w[0].upper() for w in words if w.casefold() not in P.SMALL_WORDS).endswith(letters):
        return True
    return re.search(r"(?<![^\W_])" + ".*".join(map(re.escape, letters)), long_form.upper(), re.S) is not None


def shortest_fit(acronym: str, long_form: str) -> int | None:
    """Offset of the shortest word suffix that the acronym fits, looking back a bounded number of words."""
    starts = [m.start() for m in _WORD.finditer(long_form)]
    reach = max(len(re.sub(r"[^A-Z0-9]", "", acronym)) + 5, 2 * len(acronym))
    return next((s for s in reversed(starts[-reach:]) if acronym_fits(acronym, long_form[s:].strip())), None)


def _terms(text: str) -> Iterator[tuple]:
    spans = sentences(text)
    for order, (name, pattern) in enumerate(P.TERMS.items()):
        for m in pattern.finditer(text):
            term, (lo, hi), cue = " ".join(m["term"].split()), m.span("long"), ""
            if name == "explicit_definition":
                cue = m["cue"].casefold()
                term = term.split()[-1] if term.casefold().startswith("where ") else term
                if tail := re.search(r"\s+and\s+[A-Za-z0-9_-]{1,12}\s+(?:is|denotes|means|refers\s+to)\b", text[lo:hi], re.I):
                    hi = lo + tail.start()
                fits = True
            else:
                at = shortest_fit(term, m["long"])
                fits, lo = at is not None, lo + (at or 0)
            a, b = enclosing(spans, lo, hi, len(text))
            yield name, order, lo, hi, text[lo:hi], a, text[a:b], term, " ".join(text[lo:hi].split()), cue, fits, text[hi : hi + 1].isalpha()


def _numbers(text: str) -> Iterator[tuple]:
    spans, taken = sentences(text), []
    for order, (name, pattern) in enumerate(P.NUMBERS.items()):
        for m in pattern.finditer(text):
            lo, hi = m.span(1)
            if any(lo < y and x < hi for x, y in taken):
                continue
            taken.append((lo, hi))
            a, b = enclosing(spans, lo, hi, len(text))
            subtype = "statistical_value" if name.startswith("statistical") else "other_numeric" if name == "year_like" else name
            units = [u[0] for u in re.finditer(P.UNIT, text[lo:hi])]
            unit = "%" if subtype == "percentage" else units[-1] if units and subtype not in ("statistical_value", "other_numeric") else None
            yield name, order, lo, hi, text[lo:hi], a, text[a:b], subtype, unit, text[max(0, lo - 24) : lo], text[max(0, lo - 40) : hi + 40]


def conditions(sentence: str, base: int) -> dict[str, dict]:
    """The first span of each condition kind in a sentence, with offsets in the paragraph."""
    found = {k: re.search(p, sentence, re.I) for k, p in P.CONDITIONS.items()}
    return {k: {"text": m[0], "start": base + m.start(), "end": base + m.end()} for k, m in found.items() if m}


def _inner(sentence: str, lo: int, hi: int, base: int) -> tuple[str, int, int]:
    """A stretch of a sentence without blanks and marks around it, and its place in the paragraph."""
    part = sentence[lo:hi]
    lo += len(part) - len(part.lstrip(" ,;:-"))
    inner = part.strip(" ,;:-")
    return inner, base + lo, base + lo + len(inner)


def _claims(text: str) -> Iterator[tuple]:
    for a, b in sentences(text):
        sentence = text[a:b]
        if not (m := P.RELATION.search(sentence)):
            continue
        cue = m[1].casefold()
        up, down = ("increase", "higher", "improv", "promot"), ("decrease", "lower", "reduc", "inhibit")
        polarity = "positive" if any(x in cue for x in up) else "negative" if any(x in cue for x in down) else "neutral_or_unspecified"
        sides = (_inner(sentence, 0, m.start(), a), _inner(sentence, m.end(), len(sentence), a))
        yield "relation_cue", 0, a, b, sentence, a, sentence, m[1], *(t for t, _, _ in sides), polarity, conditions(sentence, a), *(x for _, lo, hi in sides for x in (lo, hi))


_SPAN = "struct<text:string,start:int,end:int>"
_EMITTERS = {
    "T1": (_terms, "term string, definition string, cue string, fits boolean, cut boolean"),
    "T2": (_numbers, "subtype string, unit string, before string, around string"),
    "T3": (_claims, f"relation string, subject string, outcome string, polarity string, conditions map<string,{_SPAN}>, subject_start int, subject_end int, outcome_start int, outcome_end int"),
}


def may_hold(task: str, text: Column) -> Column:
    """Whether a task's patterns can match at all, decided by the JVM: other paragraphs never reach Python."""
    if task == "T1":
        return T.any_of(text, ("(", *P.DEFINITION_CUES))
    if task == "T2":
        return text.rlike(r"\p{Nd}")
    # Case-insensitive patterns of Python also take the long s and the dotless i.
    return text.rlike("(?i)" + "|".join(P.RELATION_CUES) + "|[\u017f\u0131]")


def raw_candidates(paras: DataFrame, task: str) -> DataFrame:
    """Every span a task's patterns find; input columns as in ``PARAGRAPH``."""
    emit, extra = _EMITTERS[task]
    names = [x.split()[0] for x in re.sub(r"<.*?>+", "", _COMMON + ", " + extra).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*p, *c) for p in b.itertuples(index=False, name=None) for c in emit(p[4])]
            yield pd.DataFrame(rows, columns=names)

    src = paras.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("position").cast("long").alias("position"), "section", "provenance_ok", F.coalesce("text", F.lit("")).alias("text"))
    src = src.filter(may_hold(task, F.col("text")))
    return src.mapInPandas(run, f"{_COMMON}, {extra}")


def _judged(df: DataFrame, rules: dict, duplicate: str, key) -> DataFrame:
    """First failing rule as ``reject``; of equal keys in a document the first accepted stays and later ones are rejected."""
    rows = df.withColumn("reject", first_failing(rules)).withColumn("duplicate_key", key)
    order = Window.partitionBy("doc_id", "duplicate_key", F.col("reject").isNull()).orderBy("position", "pattern_order", "start")
    again = F.col("reject").isNull() & (F.row_number().over(order) > 1)
    return rows.withColumn("reject", F.when(again, duplicate).otherwise(F.col("reject"))).withColumn("accepted", F.col("reject").isNull())


def _words(c, pattern: str):
    return F.size(F.regexp_extract_all(c, F.lit(f"({pattern})"), 1))


def detect_terms(paras: DataFrame) -> DataFrame:
    """Term and definition candidates with their verdicts."""
    d = raw_candidates(paras, "T1").withColumn("class", T.section_class(F.coalesce("section", F.lit(""))))
    explicit = F.col("pattern") == "explicit_definition"
    last = F.element_at(F.split(F.lower("term"), r"\s+"), -1)
    lead = F.element_at(F.split(F.lower("definition"), r"\s+"), 1)
    rules = {
        "excluded_structural_section": F.col("class") == "excluded",
        "incomplete_provenance": ~F.col("provenance_ok"),
        "answer_span_not_traceable": ~T.valid_span(F.col("text"), F.col("start"), F.col("end"), F.col("answer")),
        "empty_or_nonlexical_definition": (F.col("term") == "") | (_words(F.col("definition"), "[A-Za-z]") < 3),
        "invalid_term_url_doi_or_number": F.col("term").rlike(r"^\d+$") | F.col("term").rlike(P.URL_OR_DOI),
        "nondefinitional_cue_usage": explicit & (F.col("term").rlike(P.INVALID_TERM) | last.isin("a", "an", "the", "by", "of", "and") | ((F.col("cue") == "means") & lead.isin("of", "to", "and"))),
        "truncated_definition_span": explicit & F.col("cut"),
        "acronym_long_form_alignment_failed": ~explicit & ~F.col("fits"),
    }
    out = _judged(d, rules, "duplicate_term_definition_within_paper", F.concat_ws("|", T.key(F.col("term")), T.key(F.col("definition"))))
    return out.withColumn("ready", F.col("accepted"))


def detect_numbers(paras: DataFrame) -> DataFrame:
    """Numeric candidates with their verdicts; a statistical value is ready only in a statistical sentence."""
    d = raw_candidates(paras, "T2").withColumn("class", T.section_class(F.coalesce("section", F.lit(""))))
    rules = {
        "year_like_1800_2100": (F.col("pattern") == "year_like") | F.col("answer").rlike(r"^(?:18|19|20|21)\d{2}s$"),
        "ambiguous_compact_single_letter_unit": F.col("answer").rlike(r"^[+-]?(?:\d+(?:\.\d+)?|\.\d+)[A-Za-z]$"),
        "excluded_structural_section": F.col("class") == "excluded",
        "incomplete_provenance": ~F.col("provenance_ok"),
        "answer_span_not_traceable": ~T.valid_span(F.col("text"), F.col("start"), F.col("end"), F.col("answer")),
        "doi_or_url_numeric": F.col("anchor").rlike(P.URL_OR_DOI) & F.col("around").rlike(P.URL_OR_DOI),
        "bibliographic_or_structural_numeric": F.col("before").rlike(P.STRUCTURAL_PREFIX) | F.col("before").rlike(r"\[\s*$"),
        "insufficient_semantic_context": ~T.semantic_context(F.col("anchor")),
        "unit_not_retained": ~F.col("subtype").isin("statistical_value", "other_numeric", "percentage") & F.col("unit").isNull(),
    }
    key = F.concat_ws("|", "subtype", T.key(F.col("answer")), T.key(F.col("anchor")))
    out = _judged(d, rules, "duplicate_numeric_fact_within_paper", key)
    return out.withColumn("ready", F.col("accepted") & ((F.col("subtype") != "statistical_value") | F.col("anchor").rlike(P.STATISTICAL_CONTEXT)))


def detect_claims(paras: DataFrame) -> DataFrame:
    """Claim candidates (one per sentence with a relation cue) with their verdicts."""
    d = raw_candidates(paras, "T3").withColumn("class", T.section_class(F.coalesce("section", F.lit(""))))
    rules = {
        "excluded_structural_section": F.col("class") == "excluded",
        "background_or_ineligible_section": F.col("class").isin("introduction", "other", "abstract"),
        "methods_without_performance_or_comparison_result": (F.col("class") == "methods") & ~F.col("answer").rlike(P.METHOD_RESULT),
        "incomplete_provenance": ~F.col("provenance_ok"),
        "claim_span_not_traceable": ~T.valid_span(F.col("text"), F.col("start"), F.col("end"), F.col("answer")),
        "incomplete_statement_no_terminal_punctuation": ~F.col("answer").rlike("[.!?][\"']?$"),
        "incomplete_or_nonsemantic_statement": ~T.semantic_context(F.col("answer")) | (F.char_length("answer") > 500),
        "unidentified_claim_subject": _words(F.col("subject"), "[A-Za-z][A-Za-z'-]*") < 2,
        "unidentified_claim_outcome": _words(F.col("outcome"), "[A-Za-z][A-Za-z'-]*") < 2,
    }
    out = _judged(d, rules, "duplicate_claim_within_paper", T.key(F.col("answer")))
    return out.withColumn("ready", F.col("accepted") & (F.char_length("answer") <= 350))


def with_supports(claims: DataFrame, paras: DataFrame) -> DataFrame:
    """``supports`` of claims: the paragraphs before and after theirs in the same section of the document (up to two)."""
    around = Window.partitionBy("doc_id", "section").orderBy("position")
    near = F.array_compact(F.array(F.lag("text").over(around), F.lead("text").over(around)))
    rows = paras.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("position").cast("long").alias("position"), "section", "text").withColumn("supports", near)
    return claims.join(rows.select("doc_id", "position", "supports"), ["doc_id", "position"], "left")


def sentence_table(paras: DataFrame) -> DataFrame:
    """(doc_id, position, start, end, sentence) of every sentence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, p, lo, hi, t[lo:hi]) for d, p, t in b.itertuples(index=False, name=None) for lo, hi in sentences(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "position", "start", "end", "sentence"])

    return paras.select("doc_id", "position", "clean_text").mapInPandas(run, f"doc_id {paras.schema['doc_id'].dataType.simpleString()}, position long, start int, end int, sentence string")


_SWAPS = (("<", ">"), (">", "<"), ("≤", "≥"), ("≥", "≤"))


def numeric_variants(answer: str) -> list[tuple[str, str]]:
    """Counterfactuals of a numeric answer: (kind, text), each differing from it."""
    numbers = list(re.finditer(P.NUMBER, answer))
    out = []
    for a, b in _SWAPS:
        if a in answer:
            out.append(("operator_flip", answer.replace(a, b, 1)))
            break
    if len(numbers) >= 2:
        x, y = numbers[0], numbers[1]
        out.append(("endpoint_swap", answer[: x.start()] + y[0] + answer[x.end() : y.start()] + x[0] + answer[y.end() :]))
    if numbers:
        m = numbers[0]
        digit = next(i for i in range(m.start(), m.end()) if answer[i].isdigit())
        out.append(("perturb", answer[:digit] + str((int(answer[digit]) + 1) % 10) + answer[digit + 1 :]))
    if unit := re.search(P.UNIT + r"$", answer):
        out.append(("unit_removal", answer[: unit.start()].rstrip()))
    return [(k, v) for k, v in out if v != answer]


_FLIPS = {"increased": "decreased", "decreased": "increased", "higher": "lower", "lower": "higher", "increase": "decrease", "decrease": "increase", "improved": "reduced", "reduced": "improved"}


def claim_variants(sentence: str) -> list[tuple[str, str]]:
    """Counterfactuals of a claim: direction flip, negation inserted or removed, conditions removed."""
    out = []
    for word, other in _FLIPS.items():
        if m := re.search(rf"\b{word}\b", sentence, re.I):
            new = other.upper() if m[0].isupper() else other.capitalize() if m[0][0].isupper() else other
            out.append(("direction_flip", sentence[: m.start()] + new + sentence[m.end() :]))
            break
    if m := re.search(r"\b(?:did|was) not\b|\bnot\b", sentence):
        out.append(("negation_removal", (sentence[: m.start()] + m[0].replace("not", "").strip() + sentence[m.end() :]).replace("  ", " ")))
    elif m := re.search(r"\b(?:was|were|is|are)\b", sentence):
        out.append(("negation_insertion", sentence[: m.end()] + " not" + sentence[m.end() :]))
    for name in ("comparison", "treatment", "temporal", "spatial"):
        if m := re.search(P.CONDITIONS[name], sentence, re.I):
            out.append((f"{name}_removal", (sentence[: m.start()] + sentence[m.end() :]).replace("  ", " ").replace(" .", ".")))
    return [(k, v) for k, v in out if v != sentence]


def counterfactuals(df: DataFrame, task: str) -> DataFrame:
    """(id, kind, variant) of each row's ``answer``; one row in, several out."""
    make = numeric_variants if task == "T2" else claim_variants

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, v) for i, a in b.itertuples(index=False, name=None) for k, v in make(a)]
            yield pd.DataFrame(rows, columns=["id", "kind", "variant"])

    return df.select("id", "answer").mapInPandas(run, "id string, kind string, variant string")


def numeric_signature(answer: str) -> str:
    """Values, unit and comparison of a numeric answer in one string; equal signatures state the same quantity."""
    values = [float(re.sub(r"[,\s]", "", re.split(r"[×x]", m[0])[0])) for m in re.finditer(P.NUMBER, answer)]
    unit = re.findall(P.UNIT, answer)
    op = next((o for o in ("≤", "≥", "<", ">", "±", "=") if o in answer), "")
    return "|".join([",".join(f"{v:g}" for v in values), unit[-1] if unit else "", op])


def signature(answer: Column) -> Column:
    """``numeric_signature`` as a column, by batches."""
    return F.pandas_udf(lambda s: s.map(numeric_signature), "string")(answer)


def verify_numbers(candidates: DataFrame, counter: DataFrame) -> DataFrame:
    """Machine verification of numeric candidates: a ready one whose every counterfactual has another signature."""
    own = candidates.select("id", "answer", "ready").withColumn("signature", signature(F.col("answer")))
    other = counter.withColumn("other", signature(F.col("variant"))).groupBy("id").agg(F.collect_set("other").alias("others"), F.count("*").alias("n_variants"))
    j = own.join(other, "id", "left")
    return j.withColumn("counterfactual_pass", ~F.coalesce(F.array_contains("others", F.col("signature")), F.lit(False))).withColumn("machine_verified", F.col("ready") & F.col("counterfactual_pass"))
