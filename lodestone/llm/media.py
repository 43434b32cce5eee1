"""Media columns in a content-addressed chunk store.

A text becomes a payload of 8-bit samples, zero-padded to a multiple of 64.  A rolling gear hash cuts payloads into
chunks; chunk digests are deduplicated by Spark joins over narrow rows.  The store keeps each chunk once, in the row
of the payload that owns it, and every payload keeps the ordered list of its digests.  Reading back rebuilds payloads
from those lists and verifies every digest; only chunks owned elsewhere travel.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import drop_staged, in_bytes, lean, stage, utf8

SAMPLES = 64
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 512, 16384, 11
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, 256, dtype=np.uint32)
_CUT = np.uint32(((1 << CUT_BITS) - 1) << (32 - CUT_BITS))
CHUNK = 1 << 20
MAGIC = b"CDC1"
_RECIPE = "array<struct<digest:binary,size:int>>"


def payload(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % SAMPLES or (0 if text else SAMPLES))


def gear(buf: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash at each byte, ``h = 2 h + G[byte]``: the last 32 bytes decide it."""
    h = _GEAR[buf]
    for k in range(5):
        step = 1 << k
        if len(h) > step:
            h = np.concatenate((h[:step], h[step:] + (h[:-step] << np.uint32(step))))
    return h


def chunk_ends(payloads: list[bytes]) -> list[list[int]]:
    """Chunk ends of each payload.  A chunk has at least ``MIN_CHUNK`` bytes (but for the last), more than the hash
    looks back on, so cuts depend on the payload alone."""
    buf = np.frombuffer(b"".join(payloads), np.uint8)
    marks = (np.flatnonzero((gear(buf) & _CUT) == 0) + 1).tolist()
    out, base = [], 0
    for p in payloads:
        ends, at, n = [], base, base + len(p)
        while n - at > MIN_CHUNK:
            i = bisect_left(marks, at + MIN_CHUNK)
            at = min(marks[i] if i < len(marks) else n, at + MAX_CHUNK, n)
            ends.append(at - base)
        if at < n:
            ends.append(n - base)
        out.append(ends)
        base = n
    return out


_LIST = pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32())]))


def recipe(p: bytes, ends: list[int]) -> list[dict]:
    """The ordered chunk list of a payload."""
    return [{"digest": hashlib.sha256(p[lo:hi]).digest(), "size": hi - lo} for lo, hi in zip([0, *ends], ends)]


def head(recipe: list[dict]) -> bytes:
    """What a store row keeps of the chunk list: a mark, the number of chunks, then digest and size of each."""
    return MAGIC + len(recipe).to_bytes(8, "big") + b"".join(r["digest"] + r["size"].to_bytes(4, "big") for r in recipe)


def chunk_list(raw: bytes) -> list[tuple[bytes, int]]:
    """The digests and sizes in a stored head."""
    n = int.from_bytes(raw[4:12], "big")
    if raw[:4] != MAGIC or len(raw) != 12 + 36 * n:
        raise ValueError("a stored chunk list is damaged")
    return [(raw[i : i + 32], int.from_bytes(raw[i + 32 : i + 36], "big")) for i in range(12, len(raw), 36)]


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shas, lists = [], []
        for _, texts in in_bytes(utf8(b.column(0)), CHUNK):
            whole = [payload(t) for t in texts]
            shas += [hashlib.sha256(p).digest() for p in whole]
            lists += [recipe(p, ends) for p, ends in zip(whole, chunk_ends(whole))]
        yield pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), pa.array(lists, _LIST)], names=["sha", "recipe"])


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=9)
    for b in batches:
        texts = utf8(b.column(0))
        shas = [hashlib.sha256(payload(t)).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), pa.array([press.compress(t) for t in texts], pa.binary())], names=["sha", "z"])


_STORED = pa.list_(pa.struct([("seq", pa.int32()), ("data", pa.binary()), ("shared", pa.bool_())]))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sha, z, marks) to store rows: the chunks a payload owns; ``marks`` lists its shared chunks."""
    for b in batches:
        press = zstandard.ZstdDecompressor()
        linked, lends, own, lists = [], [], [], []
        whole = [payload(press.decompress(z)) for z in b.column(1).to_pylist()]
        marks = b.column(2).to_pylist()
        for first, run in in_bytes(whole, CHUNK):
            for i, (p, ends) in enumerate(zip(run, chunk_ends(run)), first):
                shared = {m["seq"]: m["owned"] for m in marks[i] or ()}
                rows = []
                for k, (lo, hi) in enumerate(zip([0, *ends], ends)):
                    if shared.get(k, True):
                        rows.append({"seq": k, "data": p[lo:hi], "shared": k in shared})
                own.append(rows)
                lists.append(head(recipe(p, ends)))
                linked.append(len(rows) < len(ends))
                lends.append(any(shared.values()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.binary()), pa.array(lends, pa.bool_()), pa.array(own, _STORED), pa.array(linked, pa.bool_())], names=["sha", "head", "lends", "own", "linked"])


def feature(samples: np.ndarray) -> str:
    """Mean, root mean square, zero-crossing rate about 128 and peak of 8-bit samples."""
    x = samples.astype(np.int64)
    side = samples >= 128
    return f"mean={x.sum() / len(x):.6f};rms={np.sqrt((x * x).sum() / len(x)):.6f};zcr={np.count_nonzero(side[1:] != side[:-1]) / len(x):.6f};peak={int(x.max())}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sha, head, own, foreign) to features of the rebuilt payloads.

    The stored form of a payload is its head and its chunks in order, all of them bytes read from the store.
    """
    for b in batches:
        out = []
        for sha, raw, own, foreign in zip(*(b.column(i).to_pylist() for i in range(4))):
            parts = {x["seq"]: x["data"] for x in own}
            parts.update((x["seq"], x["data"]) for x in foreign or ())
            listed = chunk_list(raw)
            chunks = [parts[i] for i in range(len(listed))]
            for c, (digest, size) in zip(chunks, listed):
                if len(c) != size or hashlib.sha256(c).digest() != digest:
                    raise ValueError("a stored chunk does not match its digest")
            p = b"".join(chunks)
            whole = hashlib.sha256(p)
            if whole.digest() != sha:
                raise ValueError("a rebuilt payload does not match its digest")
            stored = hashlib.sha256(raw)
            stored.update(p)
            out.append((sha, len(p), whole.hexdigest(), zlib.crc32(p[-SAMPLES:]), len(raw) + len(p), stored.hexdigest(), len(listed), feature(np.frombuffer(p, np.uint8))))
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        columns = list(zip(*out)) if out else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["sha", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_chunks", "feature"])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, sha) of every row: the SHA-256 of its padded payload, computed by Spark itself."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    n = F.octet_length(text)
    pad = F.when(n == 0, SAMPLES).otherwise(F.pmod(-n, F.lit(SAMPLES)))
    return docs.select(F.col(f"`{id_col}`").alias("id"), n.cast("long").alias("n_bytes"), F.unhex(F.sha2(F.concat(text.cast("binary"), F.unhex(F.repeat(F.lit("00"), pad))), 256)).alias("sha"))


def store_media(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write the chunk store: (shared, store), both staged.

    ``shared`` lists the chunks that several places use, with whether the place owns the bytes; a row of ``store`` is
    a distinct payload with its ordered chunk list and the bytes of the chunks it owns.
    """
    src = docs.select(F.col(f"`{text_col}`").alias("text"))
    payloads = stage(spark, src.mapInArrow(lean(_recipes), f"sha binary, recipe {_RECIPE}").groupBy("sha").agg(F.first("recipe").alias("recipe")), "media-recipes")
    places = payloads.select("sha", F.posexplode("recipe").alias("seq", "chunk")).select("sha", "seq", "chunk.digest")
    owners = places.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("sha", "seq")).alias("owner")).filter("n > 1").select("digest", "owner")
    owners = stage(spark, owners, "media-owners")  # staged, the join can split a chunk that very many payloads hold
    shared = places.join(owners, "digest").select("sha", "seq", "digest", (F.struct("sha", "seq") == F.col("owner")).alias("owned"))
    shared = stage(spark, shared, "media-shared")
    drop_staged(spark, payloads, owners)
    marks = shared.groupBy("sha").agg(F.collect_list(F.struct("seq", "owned")).alias("marks"))
    texts = src.mapInArrow(lean(_squeezed), "sha binary, z binary").groupBy("sha").agg(F.first("z").alias("z"))
    stored = texts.join(marks, "sha", "left").select("sha", "z", "marks").mapInArrow(lean(_stored), "sha binary, head binary, lends boolean, own array<struct<seq:int,data:binary,shared:boolean>>, linked boolean")
    return shared, stage(spark, stored, "media-store", ["linked"], level=9)


def read_media(shared: DataFrame, store: DataFrame) -> DataFrame:
    """Features of every stored payload, from the bytes read back through its ordered chunk list.

    Payloads that own all their chunks are read where they lie; only rows with chunks owned elsewhere, and those
    chunks, are shuffled.
    """
    fields = "sha binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_chunks long, feature string"
    lent = store.filter("lends").select("sha", F.explode("own").alias("c")).filter("c.shared").select("sha", "c.seq", "c.data")
    lent = lent.join(shared.filter("owned").select("sha", "seq", "digest"), ["sha", "seq"]).select("digest", "data")
    foreign = shared.filter("not owned").select("sha", "seq", "digest").join(lent, "digest").groupBy("sha").agg(F.collect_list(F.struct("seq", "data")).alias("foreign"))
    alone = store.filter("not linked").select("sha", "head", "own", F.lit(None).cast("array<struct<seq:int,data:binary>>").alias("foreign"))
    linked = store.filter("linked").select("sha", "head", "own").join(foreign, "sha", "left")
    return alone.unionAll(linked).mapInArrow(lean(_features), fields)


def media_features(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id and ``n_bytes`` with the features of its payload as stored and read back.

    Defined cases: NULL text is empty, and an empty text is a payload of 64 zero bytes; rows with NULL or repeated
    ids are rows like others; equal texts share one stored payload; an empty table gives an empty result.
    """
    shared, store = store_media(spark, docs, text_col)
    read = stage(spark, read_media(shared, store), "media-features")
    drop_staged(spark, shared, store)
    return keyed(docs, id_col, text_col).join(read.hint("merge"), "sha").drop("sha")
