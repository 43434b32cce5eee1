"""Sources and sinks: explicit schemas, JSON in archives, SQLite, checksums, write-once and append guards."""

from __future__ import annotations

import hashlib
import io
import json
import sqlite3
import tarfile
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a stated schema (never inferred)."""
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; lines that do not parse come with ``_corrupt``."""
    return spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file, with the file's path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.from_json(F.col("content").cast("string"), schema).alias("doc")).select("path", "doc.*")


def read_json_archive(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """(archive, member, line_no, json) of the JSON lines inside tar.gz archives; a ``.json`` member is one line."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in b.itertuples(index=False, name=None):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(suffix):
                            raw = tar.extractfile(m).read().decode()
                            lines = [raw] if suffix == ".json" else [x for x in raw.split("\n") if x.strip()]
                            yield pd.DataFrame({"archive": name, "member": m.name, "line_no": range(len(lines)), "json": lines})

    return files.mapInPandas(run, "archive string, member string, line_no long, json string")


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of a read-only query on SQLite files, each opened by the task that got its bytes."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with tempfile.NamedTemporaryFile(suffix=".db") as f:
                    f.write(content)
                    f.flush()
                    con = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
                    if con.execute("PRAGMA integrity_check").fetchone()[0] != "ok":
                        raise ValueError("damaged SQLite file")
                    yield pd.DataFrame(con.execute(query).fetchall(), columns=names)
                    con.close()

    return files.mapInPandas(run, schema)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, v array<float>) of two-dimensional .npy files."""
    import numpy as np

    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in b.itertuples(index=False, name=None):
                m = np.load(io.BytesIO(content), allow_pickle=False).astype("float32")
                yield pd.DataFrame({"path": name, "row": range(len(m)), "v": list(m)})

    return files.mapInPandas(run, "path string, row long, v array<float>")


def block_settings(text: str) -> dict[str, dict[str, str]]:
    """Two-level ``key:`` / ``  name: value`` settings text as a dictionary (driver-side configuration)."""
    out: dict[str, dict[str, str]] = {}
    own: dict[str, str] = {}
    for line in text.splitlines():
        body = line.split("#", 1)[0].rstrip()
        if not body.strip():
            continue
        name, _, value = body.strip().partition(":")
        if not body[0].isspace():
            own = out.setdefault(name, {})
            if value.strip():
                own[""] = value.strip().strip("'\"")
        else:
            own[name] = value.strip().strip("'\"")
    return out


def write_once(df: DataFrame, path: str) -> None:
    """Parquet (zstd) to a path that must not exist yet; Spark's commit makes it whole or absent."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def append_new(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows, refusing any whose key is already there."""
    held = spark.read.parquet(path).select(*keys)
    if df.join(held, keys, "left_semi").limit(1).count():
        raise ValueError("some keys are already in the table")
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """One CSV file with a header and the stated fields, for small reports."""
    df.select(*fields).coalesce(1).write.mode("errorifexists").csv(path, header=True)


def canonical_json(value) -> str:
    """Sorted, compact, non-ASCII kept, NaN refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


#: Bytes of a file that travel in one row, and names that Spark's text reader would decompress.
CHUNK = 1 << 14
PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst|zstd)$"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, size, start, value) of lines in order to (path, size, start, nth, chunk), each line with its line feed."""

    def rows(key: tuple, first: int, raw: bytes) -> pa.RecordBatch:
        parts = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        columns = [*([k] * len(parts) for k in key), range(first, first + len(parts)), parts]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "size", "start", "nth", "chunk"])

    now, nth, held = None, 0, bytearray()
    for b in batches:
        for *key, value in zip(*(b.column(i).to_pylist() for i in range(4))):
            if key != now:
                if held:
                    yield rows(now, nth, bytes(held))
                now, nth, held = key, 0, bytearray()
            held += value
            held += b"\n"
            if len(held) >= 64 * CHUNK:
                out = rows(now, nth, bytes(held))
                yield out
                nth, held = nth + len(out), bytearray()
    if held:
        yield rows(now, nth, bytes(held))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole files in order to (path, sha256).

    The reader tells neither whether the last line ends in a line feed nor whether it left out a byte order mark: the size does.
    """

    def digest(path: str, size: int, total: int, hashers: tuple, last: bytes) -> pa.RecordBatch:
        extra = total - size
        if extra not in (0, 1, -3, -2):
            raise ValueError(f"{path} is not as long as it was listed")
        own = hashers[extra < 0]
        if extra in (0, -3):
            own.update(last)
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([own.hexdigest()])], names=["path", "sha256"])

    now = None
    for b in batches:
        for path, size, chunk in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist()):
            if path != now:
                if now is not None:
                    yield digest(now, length, total, hashers, last)
                now, length, total, last = path, size, 0, b""
                hashers = hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")
            for h in hashers:
                h.update(last)
                h.update(chunk[:-1])
            last, total = chunk[-1:], total + len(chunk)
    if now is not None:
        yield digest(now, length, total, hashers, last)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, n_bytes) of all files at or below a path; names are relative to a folder, and last components otherwise.

    Files are read as lines of bytes by as many tasks as they have splits and hashed as a stream of chunks, one task a file,
    through Spark's readers alone.  Only names that the text reader would decompress are hashed as one value.
    Hidden files, whose names begin with ``.`` or ``_``, are not listed.
    """
    meta = F.col("_metadata.file_path")
    reader = spark.read.option("recursiveFileLookup", "true")
    files = reader.format("binaryFile").load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/") + "/"
    at = F.instr("path", root)
    name = F.when(at > 0, F.col("path").substr(at + len(root), F.length("path"))).otherwise(F.element_at(F.split("path", "/"), -1))
    # Scans leave out empty files; the index has them.
    jvm = spark._jvm
    every = spark.createDataFrame([(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(x)).toString(),) for x in files.inputFiles()], "path string")
    listed = every.join(files.select("path", meta.alias("at"), "length"), "path", "left").select("at", name.alias("name"), F.coalesce("length", F.lit(0)).alias("n_bytes"))
    packed = files.filter(meta.rlike(PACKED)).select(meta.alias("path"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path).filter(~meta.rlike(PACKED))
    lines = lines.select(meta.alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    chunks = lines.mapInArrow(_chunks, "path string, size long, start long, nth long, chunk binary")
    hashed = chunks.repartition("path").sortWithinPartitions("path", "start", "nth").mapInArrow(_digests, "path string, sha256 string")
    found = listed.join(hashed.unionAll(packed), F.col("at") == F.col("path"), "left")
    return found.select("name", F.coalesce("sha256", F.when(F.col("n_bytes") == 0, sha256_text(""))).alias("sha256"), "n_bytes")


def checksum_failures(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Manifest rows (name, sha256) whose file is absent or different."""
    return manifest.join(found.select("name", "sha256"), ["name", "sha256"], "left_anti")


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A report table of at most ``limit`` rows (the one place where a result is meant to be small)."""
    rows = df.limit(limit).collect()
    head = f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(str(x) for x in r) + " |" for r in rows)]) + "\n"


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
