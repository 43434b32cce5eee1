"""Language identification and toxicity: held-out accuracy, gradients of the field by enumeration, edge cases."""

from __future__ import annotations

import itertools

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from lodestone.llm import language_id, toxicity
from lodestone.llm import queries as Q


def test_language_held_out(spark):
    sf = f"{DATA}/sf0.01"
    got = Q.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert (got[got.accepted].lang == got[got.accepted].lang_pred).mean() > 0.98


def test_language_edge_cases(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    model = language_id.fit_language_id(docs)
    odd = [(1, None), (2, ""), (3, "123 !? \n"), (4, "x"), (5, "é"), (6, "日本"), (7, "the " * 200000), (None, "the of and")]
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.id: r for r in language_id.identify(df, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (1, 2, 3))
    assert all(got[i].lang_pred in model.languages and 0 < got[i].score <= 1 for i in (4, 5, 6, 7, None))
    assert language_id.identify(df.limit(0), model).count() == 0
    empty = language_id.fit_language_id(docs.limit(0))
    assert language_id.identify(df, empty).count() == len(odd)


def test_language_learns_from_the_right_rows(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(language_id.crc_mod4("doc_id") == 2, F.lit("wrong")).otherwise(F.col("lang")))
    a, b = language_id.fit_language_id(docs), language_id.fit_language_id(spoiled.repartition(3))
    assert a.languages == b.languages and np.array_equal(a.table, b.table) and a.temperature == b.temperature


def test_language_gradients_by_differences():
    rng = np.random.default_rng(2)
    emb, soft, bias = rng.normal(size=(9, 4)), rng.normal(size=(4, 3)), rng.normal(size=3)
    flat, size, y = rng.integers(0, 9, 12), np.array([5, 3, 4]), np.array([2, 0, 1])
    loss, by_emb, by_soft, by_bias = language_id.gradients(emb, soft, bias, flat, size, y)
    whole = np.zeros_like(emb)
    np.add.at(whole, flat, by_emb)
    for x, g in ((emb, whole), (soft, by_soft), (bias, by_bias)):
        for i in np.ndindex(x.shape):
            x[i] += 1e-6
            more = language_id.gradients(emb, soft, bias, flat, size, y)[0]
            x[i] -= 1e-6
            assert abs((more - loss) / 1e-6 - g[i]) < 1e-4


def test_field_gradients_by_differences():
    """The gradient of the log-likelihood by a potential is label minus marginal, by a transition seen minus expected."""
    rng = np.random.default_rng(4)
    n = 5
    u, pair, y = rng.normal(size=n), rng.normal(size=(2, 2)), rng.integers(0, 2, n)

    def score(path):
        return sum(u[t] for t in range(n) if path[t]) + sum(pair[a, b] for a, b in itertools.pairwise(path))

    def loglik():
        return score(y) - np.log(sum(np.exp(score(p)) for p in itertools.product((0, 1), repeat=n)))

    p, expected = toxicity.marginals(u, np.array([0]), np.array([n]), pair)
    seen = np.zeros((2, 2))
    for a, b in itertools.pairwise(y):
        seen[a, b] += 1
    before = loglik()
    for x, g in ((u, y - p), (pair, seen - expected)):
        for i in np.ndindex(x.shape):
            x[i] += 1e-6
            assert abs((loglik() - before) / 1e-6 - g[i]) < 1e-4
            x[i] -= 1e-6


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    size = np.array([3, 1, 5])
    first = np.cumsum(size) - size
    u, pair = rng.normal(size=9), rng.normal(size=(2, 2))
    p, expected = toxicity.marginals(u, first, size, pair)
    want, trans = np.zeros(9), np.zeros((2, 2))
    for f, n in zip(first, size):
        paths = list(itertools.product((0, 1), repeat=n))
        w = np.exp([sum(u[f + i] * y[i] for i in range(n)) + sum(pair[y[i - 1], y[i]] for i in range(1, n)) for y in paths])
        for y, v in zip(paths, w / w.sum()):
            for i in range(n):
                want[f + i] += v * y[i]
                if i:
                    trans[y[i - 1], y[i]] += v
    assert np.allclose(p, want) and np.allclose(expected, trans)


def test_toxicity_held_out(spark):
    sf = f"{DATA}/sf0.1"
    got = Q.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    y = got.toxic == 1
    assert (got[y].predicted == 1).mean() > 0.8 and (got[~y].predicted == 1).mean() < 0.04
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_toxic_spans_and_edge_cases(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(0, 300)}"
    docs, labels = [], []
    for i in range(400):
        words = [word() for _ in range(30)]
        if i % 4 == 0:
            words[int(rng.integers(0, 30))] = "Vilewört" if i % 8 else "vilewört,"
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(i % 4 == 0)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit_toxicity(spark, d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.id: r for r in toxicity.score_documents(d, model).collect()}
    assert all((got[i].score >= 0.3) == (t == 1) for i, t in labels)
    for i, t in labels:
        if t:
            s = got[i].spans[0]
            assert docs[i][1][s.start : s.end].lower() == "vilewört"
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "w1 " * 100000), (None, "x")], "doc_id long, text string").withColumn("spans", F.lit(0))
    rows = {r.id: r for r in toxicity.score_documents(odd, model).collect()}
    assert len(rows) == 5 and all(0 <= r.score < 0.3 for r in rows.values())
    assert toxicity.score_documents(odd.limit(0), model).count() == 0
    none = toxicity.fit_toxicity(spark, d.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_documents(d, none).count() == 400
