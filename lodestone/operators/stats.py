"""Agreement, tests, correlation, and resampling.

Resampling keeps units distributed: each unit draws a Poisson weight for every replicate, and tasks return partial sums
per replicate, so nothing limits the number of units.  A weight depends on a label, a replicate and the unit alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of units whose partial sums are added in order.
BUCKETS = 256


def holm(df: DataFrame, by: list[str], p: str, key: list[str]) -> DataFrame:
    """``holm_p``: step-down adjusted p-values in each family."""
    order = Window.partitionBy(*by).orderBy(p, *key)
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    raw = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(order) + 1))
    stepped = df.withColumn("_raw", raw)
    return stepped.withColumn("holm_p", F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_raw")


def smallest_equivalent(df: DataFrame, deltas: list[float], by: str, scale: str, ucb: str) -> DataFrame:
    """Per delta the smallest scale whose one-sided upper bound stays within it, with a status."""
    grid = F.explode(F.array(*[F.lit(float(d)) for d in deltas])).alias("delta")
    n = F.min(F.when(F.col(ucb) <= F.col("delta") + 1e-15, F.col(scale))).alias("n_star")
    out = df.select("*", grid).groupBy(by, "delta").agg(n)
    return out.withColumn("status", F.when(F.col("n_star").isNull(), "not_identified").otherwise("identified"))


def binary_counts(truth: Column, prediction: Column) -> list[Column]:
    """tp, fp, fn, tn."""
    return [F.count_if(truth & prediction).alias("tp"), F.count_if(~truth & prediction).alias("fp"), F.count_if(truth & ~prediction).alias("fn"), F.count_if(~truth & ~prediction).alias("tn")]


def f_beta(beta: float = 1.0) -> dict[str, Column]:
    """Precision, recall and F of the counts above; 0 where undefined."""
    d = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))
    p, r = d(F.col("tp"), F.col("tp") + F.col("fp")), d(F.col("tp"), F.col("tp") + F.col("fn"))
    b2 = beta * beta
    return {"precision": p, "recall": r, "f": d((1 + b2) * p * r, b2 * p + r)}


def set_prf(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Precision and recall of a set of keys; precision of an empty prediction and recall of an empty gold set are 1."""
    both = gold.select(*keys).distinct().withColumn("g", F.lit(1)).join(found.select(*keys).distinct().withColumn("f", F.lit(1)), keys, "full")
    n = both.agg(F.count("g").alias("n_gold"), F.count("f").alias("n_found"), F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("n_both"))
    one = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col("n_both").cast("double") / F.nullif(F.col(c).cast("double"), F.lit(0.0)))
    return n.select("n_gold", "n_found", "n_both", one("n_found").alias("precision"), one("n_gold").alias("recall"))


def ranges(df: DataFrame, column: str, n: int = 64) -> Column:
    """Number of the range a value lies in, of about ``n`` that hold equally many rows; equal values share one.

    The limits (``n - 1`` numbers) come to the driver; results must not depend on where they lie.
    """
    limits = sorted(set(df.approxQuantile(column, [i / n for i in range(1, n)], 0.25 / n)))
    return F.size(F.filter(F.array(*map(F.lit, limits)).cast("array<double>"), lambda x: x < F.col(column))) if limits else F.lit(0)


def best_threshold(df: DataFrame, score: str, truth: str, beta: float = 0.5) -> DataFrame:
    """The score threshold with the best (F-beta, precision, threshold), from cumulative counts per distinct score.

    Counts are added up inside ranges of scores, and the sums of ranges (a bounded number) over them.
    """
    each = df.groupBy(score).agg(F.count_if(F.col(truth)).alias("t"), F.count_if(~F.col(truth)).alias("f")).withColumn("g", ranges(df.filter(F.col(score).isNotNull()), score))
    sums = each.groupBy("g").agg(F.sum("t").alias("gt"), F.sum("f").alias("gf"))
    above = Window.orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    sums = sums.select("g", so_far("gt").alias("bt"), so_far("gf").alias("bf"), F.sum("gt").over(Window.partitionBy()).alias("pos"))
    down = Window.partitionBy("g").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    cum = each.join(F.broadcast(sums), "g").select(F.col(score).alias("threshold"), (F.col("bt") + F.sum("t").over(down)).alias("tp"), (F.col("bf") + F.sum("f").over(down)).alias("fp"), "pos").withColumn("fn", F.col("pos") - F.col("tp"))
    m = f_beta(beta)
    return cum.select("threshold", m["precision"].alias("precision"), m["recall"].alias("recall"), m["f"].alias("f")).orderBy(F.desc("f"), F.desc("precision"), F.desc("threshold")).limit(1)


def consensus(df: DataFrame, item: str, label: str, accept: str, reject: str) -> DataFrame:
    """Per item: counts, strict (two accepts, no reject), relaxed, conflict and complete agreement."""
    n = df.groupBy(item).agg(F.count("*").alias("n"), F.count_if(F.col(label) == accept).alias("n_accept"), F.count_if(F.col(label) == reject).alias("n_reject"), F.countDistinct(label).alias("n_labels"))
    return n.select(
        "*", ((F.col("n_accept") >= 2) & (F.col("n_reject") == 0)).alias("strict"), (F.col("n_accept") >= 2).alias("relaxed"),
        ((F.col("n_accept") > 0) & (F.col("n_reject") > 0)).alias("conflict"), (F.col("n_labels") == 1).alias("complete"),
    )


def fleiss(df: DataFrame, item: str, label: str) -> DataFrame:
    """Fleiss' kappa and raw pairwise agreement of items with the same number of ratings; NULL where undefined."""
    cell = df.groupBy(item, label).agg(F.count("*").alias("n"))
    items = cell.groupBy(item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree"))
    raw = items.agg(F.avg(F.col("agree").cast("double") / (F.col("m") * (F.col("m") - 1))).alias("agreement"), F.count("*").alias("n_items"))
    share = cell.groupBy(label).agg(F.sum("n").alias("n"))
    chance = share.agg((F.sum(F.col("n").cast("double") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("chance"))
    return raw.crossJoin(F.broadcast(chance)).select("n_items", "agreement", F.try_divide(F.col("agreement") - F.col("chance"), F.nullif(1 - F.col("chance"), F.lit(0.0))).alias("kappa"))


def mean_difference(df: DataFrame, group: Column, value: str) -> DataFrame:
    """Means, medians, variances, the standardized mean difference of two groups (pooled as half the sum of variances), and
    the absolute difference of their shares of values above zero."""
    side = lambda g, f: f(F.when(group == g, F.col(value)))
    share = lambda g: F.avg(F.when(group == g, (F.col(value) > 0).cast("double")))
    a = df.agg(F.count_if(group).alias("n1"), F.count_if(~group).alias("n0"), side(True, F.avg).alias("mean1"), side(False, F.avg).alias("mean0"), side(True, F.var_samp).alias("v1"), side(False, F.var_samp).alias("v0"), side(True, F.median).alias("median1"), side(False, F.median).alias("median0"), share(True).alias("p1"), share(False).alias("p0"))
    a = a.withColumn("share_difference", F.abs(F.col("p1") - F.col("p0")))
    return a.withColumn("smd", F.try_divide(F.col("mean1") - F.col("mean0"), F.nullif(F.sqrt((F.col("v1") + F.col("v0")) / 2), F.lit(0.0))))


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Eligibility funnel: rows entering, excluded and remaining at each stage, in one pass."""
    passed = F.lit(True)
    cols = []
    for i, (_, c) in enumerate(stages.items()):
        passed = passed & F.coalesce(c, F.lit(False))
        cols.append(F.count_if(passed).alias(f"s{i}"))
    one = df.agg(F.count("*").alias("all"), *cols)
    rows = [F.struct(F.lit(i + 1).cast("long").alias("stage_order"), F.lit(n).alias("stage"), F.col("all" if i == 0 else f"s{i - 1}").alias("input_n"), F.col(f"s{i}").alias("remaining_n")) for i, n in enumerate(stages)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*", (F.col("r.input_n") - F.col("r.remaining_n")).alias("excluded_n"))


def inversions(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Weighted pairs with a smaller x and a larger y, by merging halves."""
    order = np.lexsort((y, x))

    def merged(v: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        if len(v) < 2:
            return v, m, 0
        half = len(v) // 2
        (a, p, i), (b, q, j) = merged(v[:half], m[:half]), merged(v[half:], m[half:])
        before = np.concatenate(([0], np.cumsum(p)))
        across = int((q * (before[-1] - before[np.searchsorted(a, b, "right")])).sum())
        both, weight = np.concatenate((a, b)), np.concatenate((p, q))
        by = np.argsort(both, kind="stable")
        return both[by], weight[by], i + j + across

    return merged(y[order], w[order])[2]


def kendall_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, tau): Kendall's tau-b of two columns; rows with a NULL are left out.

    Pairs of different ranges of both x and y are counted on the grid of ranges, whose size is fixed; those of one range of
    x, and those of different ranges of x in one of y, by merging inside the range, one task each.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    cells = rows.groupBy("x", "y").agg(F.count("*").alias("c")).withColumns({"gx": ranges(rows, "x"), "gy": ranges(rows, "y")})
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)

    def ties(*by: str) -> DataFrame:
        return cells.groupBy(*by).agg(F.sum("c").alias("c")).agg(F.coalesce(pairs("c"), F.lit(0.0)).alias("_".join(["t", *by])))

    def inside(first: str, second: str):
        def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"d": [float(inversions(g[first].to_numpy(), g[second].to_numpy(), g["c"].to_numpy()))]})

        return run

    def grid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = pd.concat(list(batches) or [pd.DataFrame({"gx": [], "gy": [], "c": []})])
        # A grid cell is one point: pairs of one range of x or of y do not count here.
        yield pd.DataFrame({"d": [float(inversions(h["gx"].to_numpy(float), h["gy"].to_numpy(float), h["c"].to_numpy(float)))]})

    parts = cells.groupBy("gx").applyInPandas(inside("x", "y"), "d double").unionAll(cells.groupBy("gy").applyInPandas(inside("gx", "y"), "d double"))
    parts = parts.unionAll(cells.groupBy("gx", "gy").agg(F.sum("c").alias("c")).coalesce(1).mapInPandas(grid, "d double"))
    one = parts.agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("d")).crossJoin(F.broadcast(cells.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))))
    for by in (("x",), ("y",), ("x", "y")):
        one = one.crossJoin(F.broadcast(ties(*by)))
    total = F.col("n") * (F.col("n") - 1) / 2
    low = F.sqrt((total - F.col("t_x")) * (total - F.col("t_y")))
    return one.select("n", F.try_divide(total - F.col("t_x") - F.col("t_y") + F.col("t_x_y") - 2 * F.col("d"), F.nullif(low, F.lit(0.0))).alias("tau"))


def seed_of(label: str) -> int:
    """A 64-bit seed from a label."""
    return int(hashlib.sha256(label.encode()).hexdigest()[:16], 16)


def bootstrap_ratio(spark: SparkSession, units: DataFrame, top: str, low: str, label: str, replicates: int = 2000, block: int = 1024) -> DataFrame:
    """Poisson bootstrap of ``sum(top) / sum(low)`` over resampled units (items, or clusters summed to one row each).

    Returns (estimate, lo, hi, ucb, p): percentile interval, one-sided upper bound, two-sided p against zero.
    Units stay distributed and may be any number: equal units are counted, and the count of each draws a Poisson weight
    for every replicate (that of a sum of units with mean 1 each).  Buckets by hash, each in order, give partial sums per
    replicate that are added in the order of buckets, so the result does not depend on partitioning.
    """
    own = units.select(F.col(top).cast("double").alias("t"), F.col(low).cast("double").alias("l")).groupBy("t", "l").agg(F.count("*").alias("m"))
    base = seed_of(label)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["t", "l"])
        v, m = g[["t", "l"]].to_numpy(float), g["m"].to_numpy()
        rng = np.random.Generator(np.random.PCG64([base & 0xFFFFFFFF, int(key[0])]))
        total = np.zeros((replicates + 1, 2))
        for i in range(0, len(v), block):
            part, n = v[i : i + block], m[i : i + block, None]
            total[0] += (n * part).sum(0)
            total[1:] += rng.poisson(n, (len(part), replicates)).T.astype(float) @ part
        return pd.DataFrame({"r": np.arange(replicates + 1), "b": int(key[0]), "t": total[:, 0], "l": total[:, 1]})

    partial = own.groupBy(F.pmod(F.xxhash64("t", "l"), F.lit(BUCKETS)).alias("bucket")).applyInPandas(run, "r long, b long, t double, l double")
    each = partial.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("b", "t", "l"))).alias("x"))
    total = lambda c: F.aggregate("x", F.lit(0.0), lambda s, x: s + x[c])
    each = each.select("r", total("t").alias("t"), total("l").alias("l")).select("r", F.when(F.col("l") != 0, F.col("t") / F.nullif("l", F.lit(0.0))).when(F.col("r") > 0, float("nan")).alias("v"))
    draw = F.when(F.col("r") > 0, F.col("v"))
    p = F.least(F.lit(1.0), 2 * F.least((F.count_if(draw <= 0) + 1) / (F.count(draw) + 1), (F.count_if(draw >= 0) + 1) / (F.count(draw) + 1)))
    q = F.percentile(draw, F.array(F.lit(0.025), F.lit(0.975), F.lit(0.95)))
    return each.agg(F.max(F.when(F.col("r") == 0, F.col("v"))).alias("estimate"), q.alias("q"), p.alias("p")).select("estimate", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), F.col("q")[2].alias("ucb"), "p")


_POISSON = np.cumsum(np.exp(-1.0) / np.array([float(math.factorial(k)) for k in range(18)]))


def poisson_weights(units: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """(units, draws) Poisson weights with mean 1, each from the hash of a unit and of a draw."""
    x = units[:, None] ^ draws[None]
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.searchsorted(_POISSON, u, "right")


def draw_keys(label: str, *numbers: np.ndarray) -> np.ndarray:
    """64-bit keys of draws, from a label and their numbers."""
    out = np.full(len(numbers[0]), seed_of(label), np.uint64)
    for n in numbers:
        out = (out ^ n.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def bootstrap_hierarchical(spark: SparkSession, rows: DataFrame, outer: str, item: str, a: str, b: str, label: str, replicates: int = 1000, block: int = 1024) -> DataFrame:
    """Bootstrap of mean(a - b): outer units drawn with replacement, items drawn afresh in each slot for both arms.

    Outer units (seeds of runs) are few, and their number comes to the driver; items may be any number.
    """
    frame = rows.select(F.col(outer).alias("o"), F.col(item).alias("i"), (F.col(a) - F.col(b)).cast("double").alias("d")).groupBy("o", "i").agg(F.avg("d").alias("d"))
    place = frame.select("o").distinct().withColumn("at", F.row_number().over(Window.orderBy("o")) - 1)
    n = place.count()
    numbered = frame.join(F.broadcast(place), "o").withColumn("unit", F.xxhash64("i"))
    base = seed_of(label)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["unit", "d"])
        picks = np.stack([np.random.Generator(np.random.PCG64([base & 0xFFFFFFFF, r])).integers(0, n, n) for r in range(replicates)])
        r, slot = np.nonzero(picks == key[0])
        keys = draw_keys(label, r, slot)
        total = np.zeros((len(r), 2))
        units, d = g["unit"].to_numpy().view(np.uint64), g["d"].to_numpy()
        for lo in range(0, len(d), block):
            w = poisson_weights(units[lo : lo + block], keys)
            total += np.stack((w.T @ d[lo : lo + block], w.sum(0)), 1)
        return pd.DataFrame({"r": r, "slot": slot, "b": int(key[1]), "t": total[:, 0], "w": total[:, 1]})

    parts = numbered.groupBy("at", F.pmod("unit", F.lit(BUCKETS)).alias("bucket")).applyInPandas(run, "r long, slot long, b long, t double, w double")
    slots = parts.groupBy("r", "slot").agg(F.sort_array(F.collect_list(F.struct("b", "t", "w"))).alias("x"))
    total = lambda c: F.aggregate("x", F.lit(0.0), lambda s, x: s + x[c])
    draws = slots.select("r", "slot", F.try_divide(total("t"), F.nullif(total("w"), F.lit(0.0))).alias("v"))
    draws = draws.groupBy("r").agg(F.sort_array(F.collect_list("v")).alias("v")).select((F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")).alias("v"))
    return draws.agg(F.avg("v").alias("mean"), F.expr("percentile(v, array(0.025, 0.975, 0.95))").alias("q")).select(F.lit(n).cast("long").alias("n_outer"), "mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), F.col("q")[2].alias("ucb"))


def bootstrap_views(df: DataFrame, unit: str, views: list[str], label: str, replicates: int = 2000, block: int = 1024) -> DataFrame:
    """(view_a, view_b, estimate, lo, hi, p): means of views of the same units, and differences of every two, under shared draws.

    A unit has one Poisson weight in a replicate for all views, so differences are paired.  ``view_b`` is NULL for means.
    """
    own = df.select(F.xxhash64(unit).alias("unit"), *[F.col(v).cast("double").alias(v) for v in views])
    keys = draw_keys(label, np.arange(replicates))
    names = [f"s{i}" for i in range(len(views))]

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["unit", *views])
        units, v = g["unit"].to_numpy().view(np.uint64), g[views].to_numpy(float)
        w_sum, total = np.zeros(replicates + 1), np.zeros((replicates + 1, len(views)))
        for lo in range(0, len(v), block):
            w = poisson_weights(units[lo : lo + block], keys)
            part = v[lo : lo + block]
            w_sum += np.append(w.sum(0), len(part))
            total += np.concatenate((w.T @ part, part.sum(0, keepdims=True)))
        return pd.DataFrame({"r": np.arange(replicates + 1), "b": int(key[0]), "w": w_sum} | dict(zip(names, total.T)))

    fields = "r long, b long, w double, " + ", ".join(f"{n} double" for n in names)
    parts = own.groupBy(F.pmod("unit", F.lit(BUCKETS)).alias("bucket")).applyInPandas(run, fields).groupBy("r").agg(F.sort_array(F.collect_list(F.struct("b", "w", *names))).alias("x"))
    total = lambda c: F.aggregate("x", F.lit(0.0), lambda s, x: s + x[c])
    means = parts.select("r", *[F.try_divide(total(n), F.nullif(total("w"), F.lit(0.0))).alias(v) for n, v in zip(names, views)])
    rows = [F.struct(F.lit(a).alias("view_a"), F.lit(None).cast("string").alias("view_b"), F.col(a).alias("v")) for a in views]
    rows += [F.struct(F.lit(a).alias("view_a"), F.lit(b).alias("view_b"), (F.col(a) - F.col(b)).alias("v")) for i, a in enumerate(views) for b in views[i + 1 :]]
    each = means.select("r", F.explode(F.array(*rows)).alias("x")).select("r", "x.*")
    draw = F.when(F.col("r") < replicates, F.col("v"))
    p = F.least(F.lit(1.0), 2 * F.least((F.count_if(draw <= 0) + 1) / (F.count(draw) + 1), (F.count_if(draw >= 0) + 1) / (F.count(draw) + 1)))
    q = F.percentile(draw, F.array(F.lit(0.025), F.lit(0.975)))
    return each.groupBy("view_a", "view_b").agg(F.max(F.when(F.col("r") == replicates, F.col("v"))).alias("estimate"), q.alias("q"), p.alias("p")).select("view_a", "view_b", "estimate", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "p")
