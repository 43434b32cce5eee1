"""The pipeline on a small table whose right outcome is known, stage by stage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P

RNG = np.random.default_rng(11)


def _words(n):
    return [f"w{x}" for x in RNG.integers(0, 4000, n)]


def _table():
    line = "This boilerplate line stands in very many of the documents here."
    passage = " ".join(_words(70))
    rows = [(i, " ".join(_words(80)), "en") for i in range(8)]
    rows += [(10 + i, " ".join(_words(60)) + f"\n{line}\n" + " ".join(_words(60)), "en") for i in range(6)]
    rows += [(20 + i, " ".join(_words(40)) + " " + passage + " " + " ".join(_words(40)), "en") for i in range(3)]
    base = _words(200)
    rows += [(30, " ".join(base), "en"), (31, " ".join(base), "en"), (32, " ".join([*base[:100], "changed", *base[101:]]), "en")]
    rows += [(40, "too short", "en"), (41, "again and " * 100, "en"), (42, None, "en"), (43, "", "en")]
    return rows


def _write(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(_table(), "doc_id long, text string, lang string").withColumn("n_chars", F.char_length("text").cast("long")).withColumn("extra", F.lit("x"))
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5
    seen = {}
    for k, (name, f) in enumerate(P.STAGES):
        out = _write(f(spark, docs, ""), tmp_path / str(k))
        if k < 4:
            assert out.columns == docs.columns
            assert out.filter("n_chars <> char_length(text)").count() == 0
        seen[name] = {r.doc_id: r for r in out.collect()}
        docs = out
    first, second, third, fourth = (seen[n] for n in names[:4])
    assert not {40, 41, 42, 43} & set(first) and len(first) == len(_table()) - 4
    assert [i for i in range(10, 16) if "boilerplate" in second[i].text] == [15]
    assert {30, 31, 32} & set(third) == {30} and len(third) == len(second) - 2
    assert len(fourth[20].text.split()) == 150 and len(fourth[21].text.split()) == len(fourth[22].text.split()) == 80
    assert all(fourth[i].text == third[i].text for i in range(8))
    assert set(seen["packing"]) == set(fourth)


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (_words(100) for _ in range(3))
    a, b, c, b2 = (" ".join(x) for x in (a, b, c, [*b[:99], "changed"]))
    rows = [(1, b2), (2, a), (2, b), (2, a), (3, c), (3, c), (4, a), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in P.near_duplicate_stage(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, b2), (2, a), (3, c), (None, a), (None, a)], key=repr)


def test_run(spark, tmp_path):
    docs = spark.createDataFrame(_table(), "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {*range(8), *range(10, 16), 20, 21, 22, 30}


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")
    for k, (_, f) in enumerate(P.STAGES):
        docs = _write(f(spark, docs, ""), tmp_path / str(k))
        assert docs.count() == 0
