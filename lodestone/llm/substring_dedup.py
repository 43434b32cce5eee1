"""Substring dedup by FM-index shards.

A word goes when a window of ``WINDOW`` words over it also starts in a document with a smaller id.  Every window has
a content-defined anchor, the least hash among its word 8-grams, so equal windows share an anchor and meet in one
shard.  Consecutive windows of a document with one anchor form a region; regions of anchors found in one document
only are never looked at again, and equal regions are indexed once, for their smallest document.  Each shard builds a
compressed FM-index of its regions and streams them against it by backward search; truncated matching statistics
give, for every window, the smallest document that holds it, and nothing else decides what goes.

An anchor with more than ``SPLIT`` different regions (the rim of a passage that very many documents share) is split
over shards: its regions are cut again by anchors of longer word grams, and last by whole windows, of which an anchor
has one text.  Equal windows still meet, and parts that only one document holds drop out on the way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import words as W
from lodestone.llm.common import drop_staged, in_bytes, lean, stage, staging, utf8
from lodestone.llm.fmindex import FMIndex

WINDOW = 50
GRAM = 8
REGION_MAX = 64
SPLIT = 128
SHARD_WORDS = 400_000
CHUNK = 1 << 20


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` consecutive values."""
    span = 1
    while 2 * span <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (size - span)], x[size - span :]) if size > span else x


def regions(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start word, number of windows, anchor, content hash) of every region of the texts."""
    buf, at = W.joined(texts)
    begin, end = W.spans(buf)
    h = W.hashes(buf, begin, end)
    if len(h) < window:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    doc = np.searchsorted(at, begin, "right") - 1
    anchor = sliding_min(W.window_hashes(h, gram), window - gram + 1)
    inside = np.flatnonzero(doc[: len(anchor)] == doc[window - 1 :])
    a, d = anchor[inside], doc[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (a[1:] != a[:-1]) | (inside[1:] != inside[:-1] + 1) | (d[1:] != d[:-1])
    head = np.flatnonzero(new)
    nth = np.arange(len(inside)) - np.repeat(head, np.diff(np.append(head, len(inside))))
    head = np.flatnonzero(nth % REGION_MAX == 0)
    n = np.diff(np.append(head, len(inside)))
    lo = inside[head]
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * W.powers(W._BASE, len(h)), out=total[1:])
    hi = lo + n + window - 1
    content = W.mix((total[hi] - total[lo]) * W.powers(W._INVERSE, len(h) + 1)[lo] + n.astype(np.uint64))
    first = np.searchsorted(begin, at[:-1])
    return d[head], lo - first[d[head]], n, a[head], content


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _find(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in in_bytes(utf8(b.column(2)), CHUNK):
                doc, start, n, anchor, content = regions(texts, window)
                row = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(row), b.column(1).take(row), _signed(anchor), _signed(content), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["doc", "row", "anchor", "content", "start", "n"],
                )

    return run


def _slices(b: pa.RecordBatch, window: int) -> Iterator[tuple[int, dict, bytes]]:
    """(row, region, its words) for rows (doc, row, wanted, text)."""
    for i, (wanted, text) in enumerate(zip(b.column(2).to_pylist(), utf8(b.column(3)))):
        split = text.split()
        for w in wanted:
            yield i, w, b" ".join(split[w["start"] : w["start"] + w["n"] + window - 1])


def _texts(window: int):
    """Rows (doc, row, wanted, text) to the words of each wanted region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(w["anchor"], w["content"], i, w["top"], words) for i, w, words in _slices(b, window)]
            anchor, content, own, top, words = zip(*out) if out else [[]] * 5
            kind = b.schema.field(0).type
            columns = [pa.array(anchor, pa.int64()), pa.array(content, pa.int64()), b.column(0).take(pa.array(own, pa.int64())), pa.array(top, kind), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "content", "least", "top", "words"])

    return run


def _split(window: int, gram: int):
    """Rows (doc, row, wanted, text) to the regions by grams of ``gram`` words inside each wanted region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, wanted, words = [list(x) for x in zip(*_slices(b, window))] or [[]] * 3
            kind = b.schema.field(0).type
            for first, texts in in_bytes(words, CHUNK):
                at, start, n, anchor, content = regions(texts, window, gram)
                own = [wanted[first + i] for i in at.tolist()]
                row = pa.array([rows[first + i] for i in at.tolist()], pa.int64())
                absolute = np.array([w["start"] for w in own], np.int64) + start
                columns = [
                    b.column(0).take(row), b.column(1).take(row), pa.array([w["top"] for w in own], kind), _signed(anchor), _signed(content), pa.array(absolute.astype(np.int32)),
                    pa.array(n.astype(np.int32)), pa.array([w["anchor"] for w in own], pa.int64()), pa.array([w["content"] for w in own], pa.int64()), pa.array(start.astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "row", "top", "anchor", "content", "start", "n", "in_anchor", "in_content", "in_at"])

    return run


def matched(texts: list[bytes], owner: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each region text, the smallest owner of a region that holds the window at each of its places."""
    if not texts:
        return []
    buf, at = W.joined(texts)
    begin, end = W.spans(buf)
    doc = np.searchsorted(at, begin, "right") - 1
    _, symbol = np.unique(W.hashes(buf, begin, end), return_inverse=True)
    text = np.zeros(len(symbol) + len(texts), np.int64)
    place = np.arange(len(symbol)) + doc
    text[place] = symbol + 1
    owners = np.full(len(text), np.iinfo(np.int64).max)
    owners[place] = owner[doc]
    size = np.bincount(doc, minlength=len(texts))
    start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    least = FMIndex(text, int(symbol.max()) + 2, owners, window).least_owner(text, start, size)
    return [least[s : s + max(0, n - window + 1)] for s, n in zip(start.tolist(), size.tolist())]


def _ranks(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct ids of several columns in order, and each column as places among them."""
    kind = columns[0].type
    raw = [c.to_numpy() if pa.types.is_integer(kind) else np.array(c.to_pylist(), object) for c in columns]
    values, place = np.unique(np.concatenate(raw), return_inverse=True)
    return pa.array(values.tolist(), kind), np.split(place, np.cumsum([len(r) for r in raw])[:-1])


def _shard(window: int):
    """One partition is one shard: index its regions, stream them, return runs of windows that smaller owners hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        values, (least, top) = _ranks(t.column("least"), t.column("top"))
        found = matched(t.column("words").to_pylist(), least, window)
        size = np.array([len(f) for f in found])
        region, low = np.repeat(np.arange(len(found)), size), np.concatenate(found)
        at = np.arange(len(low)) - np.repeat(np.cumsum(size) - size, size)
        new = np.ones(len(low), bool)
        new[1:] = (region[1:] != region[:-1]) | (low[1:] != low[:-1])
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(low)))
        keep = low[head] < top[region[head]]
        head, n = head[keep], n[keep]
        hit, first = np.unique(region[head], return_index=True)
        runs = pa.StructArray.from_arrays([pa.array(at[head].astype(np.int32)), pa.array(n.astype(np.int32)), values.take(pa.array(low[head]))], names=["at", "n", "low"])
        rows = t.select(["anchor", "content"]).take(pa.array(hit, pa.int64())).combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(head)).astype(np.int32)), runs)
        yield from pa.table([rows.column(0), rows.column(1), lists], names=["anchor", "content", "runs"]).to_batches()

    return run


@dataclass
class _Level:
    """Regions of one gram size that may be shared, their distinct texts, and the anchors to split."""

    rows: DataFrame
    distinct: DataFrame
    hot: DataFrame | None


def _level(spark: SparkSession, found: DataFrame, top: str, split: int | None) -> _Level:
    """Reduce regions to those whose anchor several documents hold; ``top`` is the largest document of each."""
    shared = stage(spark, found.groupBy("anchor").agg(F.min("doc").alias("a"), F.max(top).alias("b")).filter("a < b").select("anchor"), "shared-anchors")
    rows = stage(spark, found.join(shared, "anchor", "left_semi"), "shared-regions")
    drop_staged(spark, found, shared)
    least = F.min(F.struct("doc", "row", "start", "n")).alias("m")
    distinct = stage(spark, rows.groupBy("anchor", "content").agg(least, F.max(top).alias("top")).select("anchor", "content", "m.*", "top"), "distinct-regions")
    if split is None:
        return _Level(rows, distinct, None)
    return _Level(rows, distinct, stage(spark, distinct.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > split).select("anchor"), "split-anchors"))


def repeated_words(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, split: int = SPLIT) -> DataFrame:
    """(doc, row, cuts): word intervals [lo, hi) of each document row that are covered by repeated windows.

    ``row`` is the hash of the text, which keeps rows that repeat an id apart.  Ids may be of any type with an order.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("row"), F.col(f"`{text_col}`").alias("text")).filter("doc is not null")
    kind = src.schema["doc"].dataType.simpleString()

    def with_text(regions: DataFrame) -> DataFrame:
        supply = regions.groupBy("doc", "row").agg(F.collect_list(F.struct("anchor", "content", "start", "n", "top")).alias("wanted"))
        return src.join(supply.hint("merge"), ["doc", "row"]).dropDuplicates(["doc", "row"]).select("doc", "row", "wanted", "text")

    found = stage(spark, src.mapInArrow(lean(_find(window)), f"doc {kind}, row long, anchor long, content long, start int, n int"), "regions")
    levels = [_level(spark, found, "doc", split)]
    for gram, limit in (((GRAM + window) // 2, split), (window, None)):
        before = levels[-1]
        if not before.hot.take(1):
            break
        fields = f"doc {kind}, row long, top {kind}, anchor long, content long, start int, n int, in_anchor long, in_content long, in_at int"
        parts = with_text(before.distinct.join(before.hot, "anchor", "left_semi")).mapInArrow(lean(_split(window, gram)), fields)
        levels.append(_level(spark, stage(spark, parts, "split-regions"), "top", limit))

    leaves = [x.distinct if x.hot is None else x.distinct.join(x.hot, "anchor", "left_anti") for x in levels]
    texts = with_text(reduce(DataFrame.unionAll, leaves))
    texts = stage(spark, texts.mapInArrow(lean(_texts(window)), f"anchor long, content long, least {kind}, top {kind}, words binary"), "region-texts")
    with staging(spark):
        n_words = sum(x.agg(F.sum(F.col("n") + F.lit(window))).first()[0] or 0 for x in leaves)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words // SHARD_WORDS))
    hits = texts.repartition(shards, "anchor").mapInArrow(lean(_shard(window)), f"anchor long, content long, runs array<struct<at:int,n:int,low:{kind}>>")
    hits = stage(spark, hits, "window-hits")
    drop_staged(spark, texts)
    for x in levels[:0:-1]:
        moved = F.transform("runs", lambda r: F.struct((r["at"] + F.col("in_at")).alias("at"), r["n"].alias("n"), r["low"].alias("low"))).alias("runs")
        inner = x.rows.join(hits, ["anchor", "content"]).select(F.col("in_anchor").alias("anchor"), F.col("in_content").alias("content"), moved)
        inner = inner.groupBy("anchor", "content").agg(F.flatten(F.collect_list("runs")).alias("runs"))
        above = stage(spark, hits.unionAll(inner), "window-hits")
        drop_staged(spark, hits)
        hits = above
    smaller = F.filter("runs", lambda r: r["low"] < F.col("doc"))
    cuts = F.transform(smaller, lambda r: F.struct((F.col("start") + r["at"]).alias("lo"), (F.col("start") + r["at"] + r["n"] + (window - 1)).alias("hi"))).alias("cuts")
    cuts = levels[0].rows.join(hits, ["anchor", "content"]).select("doc", "row", cuts).filter("size(cuts) > 0")
    out = stage(spark, cuts.groupBy("doc", "row").agg(F.flatten(F.collect_list("cuts")).alias("cuts")), "word-cuts")
    drop_staged(spark, hits, *[t for x in levels for t in (x.rows, x.distinct, x.hot) if t is not None])
    return out


def _kept(with_text: bool, n_keys: int):
    """Rows (keys .., cuts, text) to the counts, and the kept words joined by one space or their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = b.column(n_keys)
            n_words, n_removed, kept = [], [], []
            for i, text in enumerate(utf8(b.column(n_keys + 1))):
                words = text.split()
                n_words.append(len(words))
                gone = 0
                if cuts[i].is_valid:
                    own = cuts.slice(i, 1).flatten()
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, np.asarray(own.field("lo")), 1)
                    np.add.at(edge, np.asarray(own.field("hi")), -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(stay.sum())
                    words = [words[j] for j in np.flatnonzero(stay)]
                n_removed.append(gone)
                if with_text:
                    kept.append(text if not gone else b" ".join(words))
                else:
                    kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            last = pa.array(kept, pa.binary()).cast(pa.string()) if with_text else pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keys], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), last], names=[*b.schema.names[:n_keys], "n_words", "n_removed", "kept"])

    return run


def substring_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False, window: int = WINDOW) -> DataFrame:
    """The columns ``keep`` of every row with ``n_words``, ``n_removed`` and ``kept``.

    ``kept`` is the SHA-256 of the kept words joined by one space; with ``with_text`` it is those words, or the
    text as it was where nothing goes.  Defined cases: NULL text has no words; a NULL id neither loses words nor
    costs other documents theirs; rows repeating an id are one document; ids are of any type with an order (numbers
    compare as numbers, text by code points); columns to keep that are named like a result give way to it; an empty table
    gives an empty result.
    """
    keep = tuple(c for c in keep if c.lower() not in ("n_words", "n_removed", "kept"))
    cuts = repeated_words(spark, docs, id_col, text_col, window)
    text = F.col(f"`{text_col}`")
    src = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{id_col}`").alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"), text.alias("text"))
    both = src.join(cuts.hint("merge"), ["doc", "row"], "left").select(*[f"k{i}" for i in range(len(keep))], "cuts", "text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema.fields[: len(keep)])
    out = both.mapInArrow(lean(_kept(with_text, len(keep))), f"{fields}, n_words long, n_removed long, kept string")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_removed", "kept")
