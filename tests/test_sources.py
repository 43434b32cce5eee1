"""Sources, sinks, canonical parsing and streaming."""

from __future__ import annotations

import gzip
import hashlib
import io as stdio
import json
import sqlite3
import tarfile

import numpy as np
import pytest
from conftest import DATA

from lodestone.operators import canonical as P
from lodestone.plans import catalogue
from lodestone.shipping import ship
from lodestone.sources import io
from lodestone.streaming import ingest


def test_archives_sqlite_and_npy(spark, tmp_path):
    ship(spark)
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        raw = b'{"a": 1}\n{"a": 2}\n'
        info = tarfile.TarInfo("x.jsonl")
        info.size = len(raw)
        tar.addfile(info, stdio.BytesIO(raw))
    assert [json.loads(r.json)["a"] for r in io.read_json_archive(spark, str(tmp_path / "a.tar.gz")).orderBy("line_no").collect()] == [1, 2]
    con = sqlite3.connect(tmp_path / "m.db")
    con.execute("create table t (k integer, v text)")
    con.executemany("insert into t values (?, ?)", [(1, "x"), (2, "y")])
    con.commit()
    con.close()
    assert io.read_sqlite(spark, str(tmp_path / "m.db"), "select k, v from t order by k", "k long, v string").count() == 2
    np.save(tmp_path / "e.npy", np.arange(6, dtype="float32").reshape(3, 2))
    assert [list(r.v) for r in io.read_npy(spark, str(tmp_path / "e.npy")).orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]


def test_guards_and_checksums(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    at = str(tmp_path / "t")
    io.write_once(df, at)
    with pytest.raises(Exception, match="(?i)exist"):
        io.write_once(df, at)
    with pytest.raises(ValueError, match="already"):
        io.append_new(spark, df, at, ["k"])
    io.append_new(spark, spark.createDataFrame([(2, "b")], "k long, v string"), at, ["k"])
    assert spark.read.parquet(at).count() == 2
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.txt").write_text("hello")
    found = io.checksums(spark, str(tmp_path / "f"))
    assert found.first().sha256 == io.sha256_text("hello")
    bad = spark.createDataFrame([("x.txt", "0" * 64)], "name string, sha256 string")
    assert io.checksum_failures(bad, found).count() == 1


def test_checksums_of_all_files(spark, tmp_path):
    ship(spark)
    noise = np.random.default_rng(1).integers(0, 256, 1_500_000).astype(np.uint8).tobytes()
    files = {"a/part-0": noise, "b/part-0": noise[:-1] + b"\n", "empty": b"", "lf": b"\n", "lines": b"x\r\ny\r\n\n", "no end": b"x\ny", "mark": b"\xef\xbb\xbfx\ny\n", "mark2": b"\xef\xbb\xbfx"}
    files |= {"long": bytes(100_000), "z.gz": gzip.compress(b"text"), "c/p.snappy.parquet": noise[:70_000]}
    for name, raw in files.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(raw)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = {r.name: (r.sha256, r.n_bytes) for r in io.checksums(spark, str(tmp_path / "t")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k: (hashlib.sha256(v).hexdigest(), len(v)) for k, v in files.items()}


def test_manifest_has_every_table(spark):
    from pathlib import Path

    at = Path(DATA, "sf0.001")
    got = {r.name: r.sha256 for r in catalogue.queries()["checksum_manifest"](spark, str(at)).collect()}
    assert got == {str(f.relative_to(at)): hashlib.sha256(f.read_bytes()).hexdigest() for f in at.rglob("*") if f.is_file()}


def test_settings_and_json():
    assert io.block_settings("a:\n  x: 1\n  y: 'b'  # c\nd: 2\n") == {"a": {"x": "1", "y": "b"}, "d": {"": "2"}}
    assert io.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    with pytest.raises(ValueError):
        io.canonical_json(float("nan"))


def test_layouts(spark):
    ship(spark)
    flat = [
        {"type": "text", "text": "A title", "text_level": 1, "page_idx": 0},
        {"type": "text", "text": "Front words", "page_idx": 0},
        {"type": "text", "text": "Abstract", "text_level": 2},
        {"type": "text", "text": "Short."},
        {"type": "text", "text": "Methods", "text_level": 2},
        {"type": "text", "text": "Inner", "text_level": 3},
        {"type": "text", "text": "Body\u200b \u00a0text \ufb01x", "bbox": [0, 1, 2, 3]},
        {"type": "table", "table_body": "<table>", "table_caption": ["Table 1"]},
        {"type": "page_number", "text": "7"},
        {"type": "odd", "text": "?"},
    ]
    paged = [[{"type": "title", "content": {"title_content": [{"content": "Results"}], "level": 2}}, {"type": "paragraph", "content": {"paragraph_content": [{"content": "Two"}, {"content": "parts"}]}}]]
    df = spark.createDataFrame([("d", json.dumps(flat)), ("e", "{")], "doc_id string, content string")
    e = P.with_sections(P.elements(df, "flat"))
    rows = {r.seq: r for r in e.filter("doc_id = 'd'").collect()}
    assert rows[0].role == "title" and rows[1].excluded_reason == "front_matter_unsectioned" and rows[3].excluded_reason == "abstract_or_keywords"
    assert rows[6].section_path == ["Methods", "Inner"] and rows[6].clean_text == "Body text fix" and rows[6].excluded_reason is None
    d = {r.doc_id: r for r in P.documents(e).collect()}
    assert d["e"].n_errors == 1 and len(d["d"].objects) == 1 and d["d"].excluded_counts["page_number"] == 1 and d["d"].title == "A title"
    p = P.with_sections(P.elements(spark.createDataFrame([("d", json.dumps(paged))], "doc_id string, content string"), "paged"))
    assert {r.clean_text for r in p.collect()} == {"Results", "Two parts"}


def test_directory_of_documents_prefers_the_flat_layout(spark, tmp_path):
    ship(spark)
    flat = json.dumps([{"type": "text", "text": "From flat"}])
    paged = json.dumps([[{"type": "paragraph", "content": {"paragraph_content": [{"content": "From paged"}]}}]])
    for name, raw in {"flat/a.json": flat, "paged/a.json": paged, "paged/b.json": paged, "flat/c.json": "{", "flat/note.txt": "x", "other/d.json": flat}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(raw)
    rows = lambda only: {(r.doc_id, r.parser_source): (r.kind, r.raw_text) for r in P.directory_elements(spark, str(tmp_path), only).collect()}
    got = rows(None)
    assert set(got) == {("a", "flat"), ("b", "paged"), ("c", "flat")} and got["a", "flat"] == ("text", "From flat") and got["c", "flat"][0] == "error"
    assert set(rows("paged")) == {("a", "paged"), ("b", "paged")}


def test_text_sources_and_report_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x, y"\n2,é\n', encoding="utf-8")
    assert [tuple(r) for r in io.read_csv(spark, str(tmp_path / "a.csv"), "k long, v string").orderBy("k").collect()] == [(1, "x, y"), (2, "é")]
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "x"}\n{"k": 2\n')
    rows = io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k long, v string").cache().collect()
    assert [(r.k, r.v) for r in rows if r._corrupt is None] == [(1, "x")] and sum(r._corrupt is not None for r in rows) == 1
    (tmp_path / "a.json").write_text('{\n "k": 3,\n "v": "z"\n}')
    row = io.read_json(spark, str(tmp_path / "a.json"), "k long, v string").first()
    assert (row.k, row.v) == (3, "z") and row.path.endswith("a.json")
    df = spark.createDataFrame([(1, "x", "extra")], "k long, v string, more string")
    io.write_csv(df, str(tmp_path / "out"), ["v", "k"])
    assert [f.read_text() for f in (tmp_path / "out").glob("*.csv")] == ["v,k\nx,1\n"]
    assert io.markdown(df.select("k", "v"), "T") == "# T\n\n| k | v |\n|---|---|\n| 1 | x |\n"


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "a  b\n\nc"), (2, None)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    q = ingest.write_paragraphs(ingest.read_documents(spark, str(tmp_path / "in"), "doc_id long, text string"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(r.clean_text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a b", "c"]
