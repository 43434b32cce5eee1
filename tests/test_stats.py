"""Statistics against plain Python, known values and simulated data."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from lodestone.operators import extras as X
from lodestone.operators import retrieval as R
from lodestone.operators import scaling as M
from lodestone.operators import selection as S
from lodestone.operators import stats as A
from lodestone.operators import units as U


def test_kendall_against_pairs(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 8, 120).astype(float), rng.integers(0, 6, 120).astype(float)
    s = ux = uy = 0
    for i in range(120):
        for j in range(i):
            s += np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
            ux += x[i] != x[j]
            uy += y[i] != y[j]
    rows = [*zip(x.tolist(), y.tolist()), (None, 1.0), (2.0, None)]
    row = A.kendall_counts(spark.createDataFrame(rows, "a double, b double").repartition(3), "a", "b").first()
    assert row.n == 120 and row.tau == pytest.approx(s / (ux * uy) ** 0.5)
    assert A.kendall_counts(spark.createDataFrame([(1.0, float(i)) for i in range(4)], "a double, b double"), "a", "b").first().tau is None
    z = rng.normal(size=2000)
    smooth = A.kendall_counts(spark.createDataFrame([(float(v), float(v * v)) for v in z], "a double, b double"), "a", "b").first().tau
    want = (np.sign(z[:, None] - z[None]) * np.sign((z * z)[:, None] - (z * z)[None])).sum() / (2000 * 1999)
    assert smooth == pytest.approx(want)


def test_similar_texts_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    right = [(i, [f"w{k}" for k in sorted(set(rng.zipf(1.3, 30) % 60))]) for i in range(80)]
    left = [(1000 + i, [*t[: len(t) - int(rng.integers(0, 3))], *[f"x{j}" for j in range(int(rng.integers(0, 2)))]]) for i, t in right[:40]]
    left, right = ([(i, t) for i, t in side if len(t) >= 5] for side in (left, right))
    want = {}
    for i, a in left:
        best = max(((len(set(a) & set(b)) / len(set(a) | set(b)), -k) for k, b in right), default=(0, 0))
        if best[0] >= 0.8:
            want[i] = (-best[1], round(best[0], 9))
    frame = lambda rows: spark.createDataFrame(rows, "id long, tokens array<string>")
    got = {r.l_id: (r.r_id, round(r.jaccard, 9)) for r in U.similar_texts(frame(left), frame(right), 0.8).collect()}
    assert want and got == want


def test_fleiss_undefined_when_all_agree(spark):
    df = spark.createDataFrame([(i, "a") for i in range(3) for _ in range(3)], "item int, label string")
    row = A.fleiss(df, "item", "label").first()
    assert row.agreement == 1.0 and row.kappa is None


def test_set_prf_of_empty_sets(spark):
    e = spark.createDataFrame([], "k int")
    x = spark.createDataFrame([(1,)], "k int")
    assert A.set_prf(x, e, ["k"]).first()[3:] == (1.0, 0.0)
    assert A.set_prf(e, e, ["k"]).first()[3:] == (1.0, 1.0)


def test_percentile_score(spark):
    df = spark.createDataFrame([("t", v) for v in (1, 2, 2, 3)], "g string, v int")
    got = sorted(r[0] for r in df.select(S.percentile_score("v", ["g"])).collect())
    assert got == [0.0, 0.5, 0.5, 1.0]


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([("q", 1, 400.0), ("q", 2, 700.0), ("q", 3, 100.0)], "query_id string, rank long, cost double")
    assert R.budget_depth(df, 1024).first().n_units == 1


def test_interval_union(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 8), ("a", 10, 12), ("a", 1, 2)], "g string, s int, e int")
    assert R.interval_union(df, ["g"], "s", "e").first().covered == 10.0


@pytest.mark.parametrize(("n", "k"), [(0, 0), (1, 1), (512, 1), (513, 2), (960, 2), (961, 3)])
def test_token_windows(spark, n, k):
    from pyspark.sql import functions as F

    assert len(spark.range(1).select(U.token_windows(F.lit(n))).first()[0]) == k


def test_round_robin(spark):
    df = spark.createDataFrame([(p, i) for p, n in (("a", 4), ("b", 2), ("c", 1)) for i in range(n)], "p string, i int")
    rows = S.round_robin(df, "p", "i", "s", 3).orderBy("ordinal").collect()
    assert [r.turn for r in rows] == [1, 1, 1, 2, 2, 3]
    small, large = (S.nested_pools(S.round_robin(df, "p", "i", "s", 3), [2, 5]).filter(f"scale = {k}").collect() for k in (2, 5))
    assert {(r.p, r.i) for r in small} <= {(r.p, r.i) for r in large}


def test_similar_texts_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    sets = [sorted(set(map(str, rng.integers(0, 14, 9)))) for _ in range(60)]
    left, right = list(enumerate(sets[:20])), list(enumerate(sets[20:]))
    frame = lambda x: spark.createDataFrame(x, "id long, tokens array<string>")
    got = {(r.l_id): r.jaccard for r in U.similar_texts(frame(left), frame(right), 0.6).collect()}
    want = {}
    for i, a in left:
        best = max(len(set(a) & set(b)) / len(set(a) | set(b)) for _, b in right if len(b) >= 5)
        if best >= 0.6 and len(a) >= 5:
            want[i] = best
    assert got == pytest.approx(want)


def test_nb2_recovers_parameters():
    rng = np.random.default_rng(1)
    n = 6000
    x = rng.normal(size=n)
    offset = np.log(rng.uniform(1, 5, n))
    mu = np.exp(0.4 + 0.5 * x + offset)
    y = rng.poisson(rng.gamma(1 / 0.7, 0.7 * mu))
    m = M.nb2(np.column_stack((np.ones(n), x)), y.astype(float), offset)
    assert m["beta"] == pytest.approx([0.4, 0.5], abs=0.06) and m["alpha"] == pytest.approx(0.7, abs=0.08)


def test_log_gamma():
    import math

    v = np.array([0.01, 0.5, 1, 3.3, 50])
    assert M._log_gamma(v) == pytest.approx([math.lgamma(x) for x in v], abs=1e-9)


def test_logistic_recovers_parameters():
    rng = np.random.default_rng(2)
    x = np.column_stack((np.ones(8000), rng.normal(size=8000)))
    y = (rng.random(8000) < 1 / (1 + np.exp(-x @ [-0.5, 1.2]))).astype(float)
    b, se = M.logistic(x, y)
    assert np.all(np.abs(b - [-0.5, 1.2]) < 4 * se)


def test_bootstrap_is_seeded(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(50)], "t double, l double")
    a, b = (A.bootstrap_ratio(spark, df.repartition(k), "t", "l", "x", 200).first() for k in (1, 5))
    assert a == b and a.lo < a.estimate < a.hi


def test_poisson_weights():
    units = np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64)
    w = A.poisson_weights(units, A.draw_keys("x", np.arange(50)))
    assert w.shape == (4000, 50) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.6


def test_bootstrap_selection_against_brute_force(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    rows = [(i, float(a), float(b), float(g)) for i, (a, b, g) in enumerate(zip(rng.integers(0, 9, 300), rng.normal(size=300), rng.integers(0, 5, 300)))]
    df = spark.createDataFrame(rows, "u long, a double, b double, g double")
    got = X.bootstrap_selection(df.repartition(4), "u", "a", "b", "g", 0.2, "x", 40).first()
    unit = np.array([r[0] for r in df.select(F.xxhash64("u")).collect()], np.int64)
    w = A.poisson_weights(unit.view(np.uint64), A.draw_keys("x", np.arange(40)))
    g = np.array([r[3] for r in rows])

    def capture(column, r):
        order = np.lexsort((unit, -np.array([row[column] for row in rows])))
        own = np.repeat(g[order], w[order, r])
        return own[: int(np.ceil(0.2 * len(own)))].sum() / own.sum()

    draws = [capture(1, r) - capture(2, r) for r in range(40)]
    assert got.mean == pytest.approx(np.mean(draws)) and [got.lo, got.hi] == pytest.approx(np.percentile(draws, [2.5, 97.5]).tolist())


def test_bootstrap_of_views_shares_draws(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(3, 1, 900)
    y = x - 0.1 + rng.normal(0, 0.1, 900)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "u long, a double, b double")
    got = {(r.view_a, r.view_b): r for r in A.bootstrap_views(df.repartition(3), "u", ["a", "b"], "x", 800).collect()}
    assert got["a", None].estimate == pytest.approx(x.mean()) and got["a", "b"].estimate == pytest.approx((x - y).mean())
    assert (got["a", None].hi - got["a", None].lo) / 2 == pytest.approx(1.96 * x.std() / 30, rel=0.15)
    assert (got["a", "b"].hi - got["a", "b"].lo) / 2 == pytest.approx(1.96 * (x - y).std() / 30, rel=0.15) and got["a", "b"].p < 0.01


def test_bootstrap_hierarchical(spark):
    rng = np.random.default_rng(7)
    rows = [(o, i, float(v), 0.0) for o in range(3) for i, v in enumerate(rng.normal(o, 1, 400))]
    df = spark.createDataFrame(rows, "o long, i long, a double, b double")
    one, two = (A.bootstrap_hierarchical(spark, df.repartition(k), "o", "i", "a", "b", "x", 400).first() for k in (2, 5))
    assert one == two and one.n_outer == 3 and abs(one.mean - 1) < 0.1
    assert (one.hi - one.lo) / 2 == pytest.approx(1.96 * (2 / 3 / 3) ** 0.5, rel=0.3)  # means of three draws from 0, 1, 2


def test_bootstrap_of_any_number_of_units(spark):
    x = np.random.default_rng(3).normal(5, 2, 3000).round(1)
    df = spark.createDataFrame([(float(v), 1.0) for v in x], "t double, l double")
    got = A.bootstrap_ratio(spark, df, "t", "l", "x").first()
    again = A.bootstrap_ratio(spark, df.repartition(7), "t", "l", "x").first()
    half = 1.96 * x.std() / len(x) ** 0.5
    assert got == again and got.estimate == pytest.approx(x.mean())
    assert (got.hi - got.lo) / 2 == pytest.approx(half, rel=0.1) and got.lo == pytest.approx(x.mean() - half, abs=half / 5)


def test_holm_known_values(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "g string, k string, p double")
    got = {r.k: r.holm_p for r in A.holm(df, ["g"], "p", ["k"]).collect()}
    assert got == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})


def test_crop_keeps_the_span(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pd.DataFrame({"w": [[str(i) for i in range(20)]]}))
    for lo, hi in ((0, 2), (9, 11), (18, 20)):
        at = df.select(M.crop(F.col("w"), F.lit(lo), F.lit(hi), 6)).first()[0]
        assert at.start <= lo and hi <= at.end and at.end - at.start == 6
    assert df.select(M.crop(F.col("w"), F.lit(0), F.lit(9), 6)).first()[0] is None


def test_templates_take_the_whole_text(spark):
    import hashlib

    from conftest import DATA

    from lodestone.plans import catalogue

    turns = spark.read.parquet(f"{DATA}/sf0.001/conversations.parquet").filter("length(text) > 80 and role in ('user', 'assistant', 'system')").collect()
    got = {(r.conv_id, r.turn, r.template): r.instruction_sha for r in catalogue.queries()["template_render"](spark, f"{DATA}/sf0.001").collect()}
    assert turns
    for r in turns:
        for i, w in enumerate(M.TEMPLATES[r.role]):
            assert got[r.conv_id, r.turn, i] == hashlib.sha256(w.format(r.text).encode()).hexdigest()
