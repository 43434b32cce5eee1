"""Smaller operators: label projection, table text, recursive chunks, count models and selection inside resampling."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.scaling import design
from lodestone.operators.stats import draw_keys, poisson_weights, ranges


def table_text(rows: Column) -> Column:
    """Text of an array of rows of cells: cells joined by `` | ``, rows by line feeds."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def bio_labels(tokens: Column, spans: Column, kind: str) -> Column:
    """BIO labels of an array of (text, start, end) tokens for an array of (start, end) spans.

    A token that overlaps a span is inside it, and begins it where the token before does not overlap the same span.
    """

    def label(t: Column, i: Column) -> Column:
        hit = F.filter(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
        before = F.get(tokens, i - 1)
        same = F.exists(hit, lambda s: (s["start"] < before["end"]) & (before["start"] < s["end"]))
        return F.when(F.size(hit) == 0, F.lit("O")).when(F.coalesce(same, F.lit(False)), F.lit(f"I-{kind}")).otherwise(F.lit(f"B-{kind}"))

    return F.transform(tokens, label)


def recursive_chunks(text: str, target: int = 600, least: int = 100, most: int = 1150, separators: tuple[str, ...] = (r"\n\n", r"\n", r"(?<=[.!?])\s", r"\s")) -> list[str]:
    """Chunks of about ``target`` characters and at most ``most``: split at the coarsest separator that is enough,
    pieces joined greedily, then small chunks merged with a neighbour where both still fit."""
    if len(text) <= most or not separators:
        parts = [text] if len(text) <= most else [text[i : i + most] for i in range(0, len(text), most)]
        return [p for p in parts if p.strip()]
    out, held = [], ""
    for piece in re.split(f"({separators[0]})", text):
        if len(held) + len(piece) > target and held.strip():
            out += [held] if len(held) <= most else recursive_chunks(held, target, least, most, separators[1:])
            held = ""
        held += piece
    if held.strip():
        out += [held] if len(held) <= most else recursive_chunks(held, target, least, most, separators[1:])
    merged: list[str] = []
    for c in out:
        if merged and min(len(c), len(merged[-1])) < least and len(c) + len(merged[-1]) <= most:
            merged[-1] += c
        else:
            merged.append(c)
    return merged


def chunked(docs: DataFrame, id_col: str, text_col: str, **limits: int) -> DataFrame:
    """(id, nth, chunk) of recursive chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, c) for i, t in b.itertuples(index=False, name=None) for n, c in enumerate(recursive_chunks(t or "", **limits))]
            yield pd.DataFrame(rows, columns=["id", "nth", "chunk"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {docs.schema[id_col].dataType.simpleString()}, nth long, chunk string")


def leave_top_out(df: DataFrame, by: list[str], value: str, id_col: str, share: float = 0.01) -> DataFrame:
    """Rows without the ``ceil(share n)`` largest values of each group."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), id_col)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn("_k", F.row_number().over(order)).withColumn("_n", n).filter(F.col("_k") > F.ceil(share * F.col("_n"))).drop("_k", "_n")


def nb_deviance(y: Column, mu: Column, alpha: float) -> Column:
    """Deviance of one NB2 observation."""
    first = F.when(y > 0, y * F.log(y / mu)).otherwise(F.lit(0.0))
    return 2 * (first - (y + 1 / alpha) * F.log((1 + alpha * y) / (1 + alpha * mu)))


def nb_zero(mu: Column, alpha: float) -> Column:
    """Probability of zero under NB2."""
    return F.pow(1 + alpha * mu, F.lit(-1 / alpha))


def poisson(x: np.ndarray, y: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, float]:
    """Poisson regression with offset: (coefficients, Pearson dispersion)."""
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(max(1e-9, y.sum()) / np.exp(offset).sum())
    for _ in range(100):
        mu = np.exp(np.clip(x @ beta + offset, -30, 30))
        step = np.linalg.solve((x * mu[:, None]).T @ x + 1e-9 * np.eye(len(beta)), x.T @ (y - mu))
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    return beta, float(((y - mu) ** 2 / mu).sum() / max(1, len(y) - len(beta)))


def fit_poisson(df: DataFrame, by: str, columns: list[str], target: str, exposure: str) -> DataFrame:
    """One Poisson model per group, with log exposure as offset: (by, term, estimate, dispersion, n_rows)."""

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(frame.columns))
        x, _, _ = design(frame, columns)
        beta, dispersion = poisson(x, frame[target].to_numpy(float), np.log(frame[exposure].to_numpy(float)))
        return pd.DataFrame({by: key[0], "term": ["intercept", *columns], "estimate": beta, "dispersion": dispersion, "n_rows": len(frame)})

    return df.groupBy(by).applyInPandas(fit, f"{by} {df.schema[by].dataType.simpleString()}, term string, estimate double, dispersion double, n_rows long")


def utility_judgment(gain: Column, low: Column, holm_p: Column, level: float = 0.05) -> Column:
    """``supported`` where the gain is positive and significant with its interval above zero, then ``directional``, ``not_supported``."""
    return F.when((gain > 0) & (low > 0) & (holm_p < level), "supported").when(gain > 0, "directional").otherwise("not_supported")


def bootstrap_selection(rows: DataFrame, unit: str, score: str, other: str, gain: str, fraction: float, label: str, replicates: int = 500, block: int = 1024) -> DataFrame:
    """Bootstrap of the difference in captured gain of two scores, selecting anew in every replicate.

    Units stay distributed and draw Poisson weights; of a unit drawn twice both copies count.  Rows lie in ranges of the
    score; sums of ranges tell in which range each replicate's budget ends, and only there are its rows walked in order.
    """
    frame = rows.select(F.xxhash64(unit).alias("unit"), F.col(score).cast("double").alias("a"), F.col(other).cast("double").alias("b"), F.col(gain).cast("double").alias("g"))
    keys = draw_keys(label, np.arange(replicates))

    def ordered(t: pd.DataFrame, c: str) -> tuple[np.ndarray, np.ndarray]:
        t = t.sort_values([c, "unit"], ascending=[False, True])
        return t["unit"].to_numpy().view(np.uint64), t["g"].to_numpy()

    def captured(c: str) -> DataFrame:
        dealt = frame.withColumn("range", ranges(frame, c))

        def sums(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
            units, g = ordered(t, c)
            total = np.zeros((replicates, 2))
            for lo in range(0, len(g), block):
                w = poisson_weights(units[lo : lo + block], keys)
                total += np.stack((w.sum(0), w.T @ g[lo : lo + block]), 1)
            return pd.DataFrame({"range": int(key[0]), "r": np.arange(replicates), "w": total[:, 0], "t": total[:, 1]})

        each = dealt.groupBy("range").applyInPandas(sums, "range int, r long, w double, t double")
        down, whole = Window.partitionBy("r").orderBy(F.desc("range")), Window.partitionBy("r")
        before = down.rowsBetween(Window.unboundedPreceding, -1)
        each = each.select("r", "range", "w", "t", F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w0"), F.coalesce(F.sum("t").over(before), F.lit(0.0)).alias("t0"), F.ceil(fraction * F.sum("w").over(whole)).alias("k"), F.sum("t").over(whole).alias("all"))
        # One row per replicate: the range in which its budget ends.
        ends = each.filter((F.col("w0") < F.col("k")) & (F.col("k") <= F.col("w0") + F.col("w"))).select("r", "range", (F.col("k") - F.col("w0")).alias("left"), "t0", "all").toPandas()

        def last(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
            own = ends[ends["range"] == key[0]].sort_values("r")
            units, g = ordered(t, c)
            left, got = own["left"].to_numpy(float), np.zeros(len(own))
            for lo in range(0, len(g), block):
                w = poisson_weights(units[lo : lo + block], keys[own["r"].to_numpy()])
                used = np.clip(left - (np.cumsum(w, 0) - w), 0, w)
                got += used.T @ g[lo : lo + block]
                left = left - w.sum(0)
            with np.errstate(invalid="ignore", divide="ignore"):
                return pd.DataFrame({"r": own["r"], f"c_{c}": (own["t0"].to_numpy() + got) / own["all"].to_numpy()})

        return dealt.groupBy("range").applyInPandas(last, f"r long, c_{c} double")

    draws = captured("a").join(captured("b"), "r").select((F.col("c_a") - F.col("c_b")).alias("v")).filter(~F.isnan("v"))
    return draws.agg(F.avg("v").alias("mean"), F.expr("percentile(v, array(0.025, 0.975))").alias("q"), ((F.count_if(F.col("v") <= 0) + 1) / (F.count("v") + 1)).alias("p_one_sided")).select("mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "p_one_sided")
