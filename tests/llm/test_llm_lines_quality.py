"""Line dedup and quality rules against brute force, with the awkward cases."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodestone.llm import line_dedup, quality
from lodestone.llm import queries as Q

LONG = "This line is long enough to be counted as a repeated one. "
ROWS = [
    (1, f"{LONG}\nown 1\n\t{LONG.upper()}\x0b"),
    (2, f"{LONG}\n{LONG}\nown 2"),
    (3, LONG),
    (4, None),
    (5, ""),
    (6, "É" * 40 + "\nx"),
    (7, f"a\n\n {LONG.strip()}"),
    (8, "é" * 40),
    (9, "\n\n"),
    (9, f"{LONG}\nsecond row of nine"),
    (None, LONG),
]
SPACE = " \t\n\x0b\x0c\r"


def _key(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def _brute(rows, min_docs):
    where: dict[str, set] = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(_key(x)) >= 40:
                where.setdefault(_key(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if d is None or len(where.get(_key(x), ())) < min_docs or d == max(where[_key(x)])]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("pos", F.lit("clash")).withColumn("h1", F.lit(1)).withColumn("words", F.lit(2))
    for k in (2, 5, 6):
        rows = line_dedup.line_dedup(spark, df.repartition(3), min_docs=k)
        assert rows.columns[:5] == df.columns
        got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in rows.collect()), key=repr)
        assert got == _brute(ROWS, k)


def test_line_dedup_of_very_many_lines(spark):
    text = "\n".join(f"{LONG}{i % 700}" for i in range(3000))
    rows = [(i, text) for i in range(6)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (0 if i == 5 else 3000) for i in range(6)}


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_dedup(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _measure(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = (text or "").split("\n")
    dup = sum(bool(x.strip(SPACE)) and x in lines[:i] for i, x in enumerate(lines))
    win = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    rep = {j for i, w in enumerate(win) if win.count(w) > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(rep))


def test_quality_against_brute_force(spark):
    texts = [None, "", " \n ", "a b c d e f g h a b c d e f g h", "x " * 60, "é#|é\nq\nq\n\n\nq\t1", "\x1c \x85 word", "one two three four five six seven eight " * 3 + "tail", "a" * 5000, "w v z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("t", F.lit(0)).withColumn("failures", F.lit("x"))
    rows = {r.doc_id: r for r in quality.quality_rules(spark, df).collect()}
    for i, t in enumerate(texts):
        assert tuple(rows[i][m] for m in quality.MEASURES) == _measure(t), t
        n, rep = rows[i].n_words, rows[i].n_repeat_words
        assert rows[i].base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (rows[i].kept and rows[i].base_failed)
    assert quality.quality_rules(spark, df.limit(0)).count() == 0


def test_ablation_by_bits(spark):
    fails = [0, 1, 1, 3, 2, 16, 17, 0]
    rows = spark.createDataFrame([(f,) for f in fails], "failures long")
    got = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in quality.ablation(rows).collect()}
    assert got["too_few_words"] == (4, 2, 4) and got["repeated_windows"] == (2, 1, 3) and got["too_many_symbols"] == (2, 1, 3)


def test_queries_match_duckdb(same_as_duckdb):
    for name, sql in Q.oracle_sql().items():
        same_as_duckdb(Q.queries()[name], sql)
