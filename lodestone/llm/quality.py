"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger row holds the measurements and one bit per failed rule.
A policy is a versioned mask: applying it, or asking what a policy without some rule would keep, is bitwise
arithmetic on the ledger and never reads text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import words as W
from lodestone.llm.common import in_bytes, lean, stage, utf8

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rule bit to its failure condition over the measurements, all in integer arithmetic.
RULES = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "words_too_short": "n_words > 0 AND word_chars < 2 * n_words",
    "words_too_long": "word_chars > 25 * n_words",
    "too_many_symbols": "2 * n_symbols > n_words",
    "too_many_dup_lines": "n_dup_lines > 20 AND 20 * n_dup_lines > n_words",
}
#: Columns of the ledger and of its verdicts.
OWN = {*MEASURES, "failures", "base_failed", "kept"}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BITS["too_few_words"] | BITS["repeated_windows"]
#: Version to the mask of the rules that reject.
POLICIES = {"base": BASE, "v1": sum(BITS.values())}
CHUNK = 1 << 20


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measurements of each text, by the rules' definitions, over whole texts."""
    buf, at = W.joined(texts)
    start, end = W.spans(buf)
    n = len(texts)
    doc = np.searchsorted(at, start, "right") - 1
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    first = np.searchsorted(start, at)
    out = {
        "n_words": np.diff(first),
        "word_chars": np.bincount(doc, lead[end] - lead[start], n).astype(np.int64),
        "n_symbols": np.bincount(np.searchsorted(at, np.flatnonzero(SYMBOLS[buf]), "right") - 1, minlength=n),
        "n_dup_lines": np.zeros(n, np.int64),
        "n_repeat_words": np.zeros(n, np.int64),
    }
    for i, t in enumerate(texts):
        if (k := t.count(b"\n")) > 0:
            lines = t.split(b"\n")
            if len(set(lines)) <= k:
                seen: set[bytes] = set()
                dup = 0
                for x in lines:
                    dup += x in seen and not x.isspace() and bool(x)
                    seen.add(x)
                out["n_dup_lines"][i] = dup
    if len(start) >= WINDOW:
        win = W.window_hashes(W.hashes(buf, start, end), WINDOW)
        own = doc[: len(win)] == doc[WINDOW - 1 :]
        pos = np.flatnonzero(own)
        key, owner = win[pos], doc[pos]
        order = np.lexsort((key, owner))
        k, o = key[order], owner[order]
        same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
        if same.any():
            hit = np.zeros(len(k), bool)
            hit[1:] |= same
            hit[:-1] |= same
            cover = np.zeros(len(start) + 1, np.int64)
            twice = pos[order[hit]]
            cover[:-1] += np.bincount(twice, minlength=len(start))
            cover -= np.bincount(twice + WINDOW, minlength=len(start) + 1)
            out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = utf8(b.column(b.num_columns - 1))
        parts = [measure(run) for _, run in in_bytes(texts, CHUNK)]
        cols = [np.concatenate([p[m] for p in parts]) if parts else np.empty(0, np.int64) for m in MEASURES]
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c.astype(np.int64)) for c in cols)], names=[*b.schema.names, *MEASURES])


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), carry_text: bool = False) -> DataFrame:
    """The columns ``keep``, the measurements and ``failures`` (bit per failed rule) of every row.

    NULL and empty texts have no words: they measure zero and fail ``too_few_words``.  With ``carry_text`` the
    text comes along under its own name.  Rows are measured one by one, so NULL and repeated ids are as good as others; an
    empty table gives an empty ledger; columns to keep that are named like one of the ledger's give way to it.
    """
    keep = tuple(c for c in keep if c.lower() not in OWN)
    src = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("t"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields)
    out = src.mapInArrow(lean(_measured), fields + "".join(f", {m} long" for m in MEASURES))
    mask = sum((F.when(F.expr(rule), BITS[name]).otherwise(0) for name, rule in RULES.items()), F.lit(0))
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *([F.col("t").alias(text_col)] if carry_text else []), *MEASURES, mask.cast("long").alias("failures")
    )


def verdict(policy: str = "v1"):
    """Column: whether a ledger row passes a policy version."""
    return F.col("failures").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """One row per rule of a policy: documents failing it, failing it alone, and kept if it were left out."""
    mask, f = POLICIES[policy], F.col("failures")
    names = [r for r in RULES if BITS[r] & mask]
    combos = rows.groupBy(f.bitwiseAND(F.lit(mask)).alias("failures")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in names])).alias("r")
    each = combos.select("failures", "n", rules).select("failures", "n", "r.rule", "r.bit")
    hits = F.col("failures").bitwiseAND(F.col("bit")) != 0
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        total(hits).alias("n_failed"),
        total(F.col("failures") == F.col("bit")).alias("n_failed_alone"),
        total((F.col("failures") == 0) | (F.col("failures") == F.col("bit"))).alias("n_kept_without"),
    )


def quality_rules(spark: SparkSession, docs: DataFrame, policy: str = "v1", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), carry_text: bool = False) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` (no base rule and no rule of the policy fails).

    The ledger is a table in the shared folder, and the policy is applied to it; only where the text is carried along does
    it stay in the same pass.  Its defined cases are those of ``ledger``.
    """
    rows = ledger(docs, text_col, keep, carry_text)
    rows = rows if carry_text else stage(spark, rows, "quality-ledger")
    base_failed = F.col("failures").bitwiseAND(F.lit(BASE)) != 0
    return rows.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & verdict(policy))
