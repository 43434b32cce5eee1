"""Ranking, budgeted selection, splits and nested pools.

Orders are total (score, then id) and randomness is the SHA-256 of a seed and an id, so every result is the same on
any number of partitions.  A global order numbers rows inside buckets of the hash and adds up the sizes of buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Row numbers from 1 in each group, in a total order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return ranked(df, by, order).filter(F.col("rank") <= k)


def percentile_score(value: str, by: list[str]) -> Column:
    """Average-tie percentile rank ``(rank - 1) / (n - 1)`` in each group; a single row gets 0."""
    low = F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).asc())).cast("double")
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value)).cast("double")
    n = F.count(F.lit(1)).over(Window.partitionBy(*by)).cast("double")
    return F.coalesce(F.try_divide(low + (ties - 1) / 2 - 1, F.nullif(n - 1, F.lit(0.0))), F.lit(0.0))


def running_cost(df: DataFrame, by: list[str], cost: str, name: str = "spent") -> DataFrame:
    """Cost up to and with each row, in the order of ``rank``."""
    return df.withColumn(name, F.sum(cost).over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))


def within_budget(df: DataFrame, by: list[str], cost: str, budget: Column) -> DataFrame:
    """The longest ranked prefix whose cost stays in the budget: it stops at the first row that would not fit."""
    return running_cost(df, by, cost).filter(F.col("spent") <= budget)


def within_fraction(df: DataFrame, by: list[str], fraction: float, cost: str | None = None) -> DataFrame:
    """The ranked prefix of ``ceil(fraction n)`` rows, or of ``floor(fraction total cost)``."""
    w = Window.partitionBy(*by)
    if cost is None:
        return df.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("rank") <= F.ceil(F.lit(fraction) * F.col("_n"))).drop("_n")
    total = df.withColumn("_budget", F.floor(F.lit(fraction) * F.sum(cost).over(w)))
    return within_budget(total, by, cost, F.col("_budget")).drop("_budget")


def hash_order(seed: str, *ids: Column) -> Column:
    """The SHA-256 that stands in for a random order."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[i.cast("string") for i in ids]), 256)


#: Hexadecimal digits of the hash that name the buckets of a global order: 16 ** 3 rows at most are ordered in one place.
DIGITS = 3


def dealt_rank(df: DataFrame, buckets: list[str], order: list[Column], name: str) -> DataFrame:
    """``name`` and ``n_all``: place from 1 in the order of (buckets, order) over all rows, and their number.

    Rows are numbered inside their bucket; only one row per bucket, their sizes, is ordered in one place and broadcast, so
    the buckets must be a bounded number of values.
    """
    sizes = df.groupBy(*buckets).agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*buckets, F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_k").over(Window.partitionBy()).alias("n_all"))
    own = F.row_number().over(Window.partitionBy(*buckets).orderBy(*order))
    return df.join(F.broadcast(sizes), buckets).withColumn(name, F.col("_before") + own).drop("_before")


def _hashed(df: DataFrame, seed: str, col: str) -> DataFrame:
    return df.withColumn("_hash", hash_order(seed, F.col(col))).withColumn("_bucket", F.substring("_hash", 1, DIGITS))


def folds(df: DataFrame, id_col: str, seed: str, k: int) -> DataFrame:
    """Fold = position in hash order modulo ``k``."""
    r = dealt_rank(_hashed(df, seed, id_col), ["_bucket"], [F.col("_hash"), F.col(id_col)], "_at")
    return r.select(*df.columns, F.pmod(F.col("_at") - 1, F.lit(k)).cast("long").alias("fold"))


def split(df: DataFrame, id_col: str, seed: str, first: int, last: int) -> DataFrame:
    """``train`` for the first, ``eval`` for the last rows in hash order, ``unused`` between."""
    r = dealt_rank(_hashed(df, seed, id_col), ["_bucket"], [F.col("_hash"), F.col(id_col)], "_at")
    return r.select(*df.columns, F.when(F.col("_at") <= first, "train").when(F.col("_at") > F.col("n_all") - last, "eval").otherwise("unused").alias("split"))


def prefix_sample(df: DataFrame, id_col: str, seed: str, n: int) -> DataFrame:
    """The first ``n`` rows in hash order: samples of one seed are prefixes of each other."""
    return df.withColumn("_hash", hash_order(seed, F.col(id_col))).orderBy("_hash", id_col).limit(n).drop("_hash")


def round_robin(df: DataFrame, group: str, item: str, seed: str, cap: int) -> DataFrame:
    """At most ``cap`` items of each group, dealt one per group and turn, groups in hash order: (.., turn, ordinal)."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, F.col(item)), item))
    some = df.withColumn("turn", turn.cast("long")).filter(F.col("turn") <= cap)
    r = dealt_rank(_hashed(some, seed, group), ["turn", "_bucket"], [F.col("_hash"), F.col(group)], "ordinal")
    return r.select(*df.columns, "turn", F.col("ordinal").cast("long").alias("ordinal"))


def nested_pools(df: DataFrame, scales: list[int]) -> DataFrame:
    """Each scale's prefix of ``ordinal``, so that smaller pools are prefixes of larger ones."""
    each = F.explode(F.array(*[F.lit(s).cast("long") for s in scales])).alias("scale")
    return df.select("*", each).filter(F.col("ordinal") <= F.col("scale"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a defined order."""
    return ranked(df, keys, order, "_n").filter("_n = 1").drop("_n")
