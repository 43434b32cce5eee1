"""SimHash near-dedup with bit-sliced comparison.

Distinct fingerprints (not documents) are grouped by shared blocks of bits: two fingerprints within ``radius``
bits agree on at least ``BLOCKS - radius`` of ``BLOCKS`` blocks, so each choice of that many blocks is one exact
grouping and no link is missed.  A group with more than ``GROUP_MAX`` members is grouped again by blocks of the
bits left over, which bounds its subgroups by the few bits that then remain free.  Inside a group the fingerprints
lie as vertical bit planes; a query is compared with 64 members per machine word, carry-save counters saturate
above the radius, and a block of words is abandoned once all its members exceed it.  A group emits the edges of a
spanning forest, never its pairs; components then come from large-star/small-star rounds in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lodestone.llm import words as W
from lodestone.llm.common import drop_staged, in_bytes, lean, stage, utf8

SEED = 42
BLOCKS = 5
GROUP_MAX = 1024
#: (query, word of 64 members) pairs compared at once.
PAIRS_MAX = 1 << 15
_ONE = np.uint64(1)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles (repeats included) of a text with A-Z in lower case; 0 without words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words])
    start = np.concatenate(([0], end[:-1]))
    k = max(1, n - shingle + 1)
    last = (end[min(shingle, n) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(start[:k].tolist(), last)])
    total = np.zeros(64, np.int64)
    step = 1 << 16
    for i in range(0, len(raw), 8 * step):
        part = np.frombuffer(raw[i : i + 8 * step], np.uint8)
        total += np.unpackbits(part.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > k).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t, shingle) for t in utf8(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every row, as a signed 64-bit value."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(lean(_fingerprints(shingle)), f"id {src.schema['id'].dataType.simpleString()}, fp long")


def _cuts(n_bits: int, blocks: int) -> list[int]:
    return [round(i * n_bits / blocks) for i in range(blocks + 1)]


def masks(radius: int, free: int = 2**64 - 1) -> list[int]:
    """One mask per choice of ``BLOCKS - radius`` blocks of the bits set in ``free``; pairs within ``radius`` on these bits agree under one of them."""
    bits = [i for i in range(64) if free >> i & 1]
    blocks = max(BLOCKS, radius + 2)
    cut = _cuts(len(bits), blocks)
    own = [sum(1 << b for b in bits[cut[i] : cut[i + 1]]) for i in range(blocks)]
    return [sum(own[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def as_bytes(fps: np.ndarray) -> np.ndarray:
    """(n, 8) bytes of 64-bit fingerprints, most significant first."""
    return fps.astype(">u8").view(np.uint8).reshape(-1, 8)


def planes(fps: np.ndarray) -> np.ndarray:
    """(bits, words) planes of fingerprints given as rows of bytes, 64 members to a word."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros((n, fps.shape[1]), np.uint8)
    padded[: len(fps)] = fps
    bits = np.ascontiguousarray(np.unpackbits(padded, axis=1).T)
    return np.packbits(bits.reshape(len(bits), n // 64, 64), axis=2, bitorder="little").view("<u8")[:, :, 0]


def compared(bits: np.ndarray, vertical: np.ndarray, closed: np.ndarray, q: np.ndarray, w: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) of the pairs at most ``radius`` bits apart, for queries ``q`` against words ``w`` of members.

    ``bits`` are the queries' bits, ``closed`` the bits of each word that hold no member.  All (query, word) pairs
    advance plane by plane with carry-save counters as bits ``c0, c1, ..``, and ``over`` for members beyond the
    radius; a pair whose members are all beyond it is abandoned.
    """
    flips = np.where(bits, ~np.uint64(0), np.uint64(0)).T
    over = closed[w]
    width = (radius + 1).bit_length()
    count = [np.zeros(len(q), np.uint64) for _ in range(width)]
    for i in range(len(vertical)):
        carry = vertical[i][w] ^ flips[i][q]
        for c in count:
            c[:], carry = c ^ carry, c & carry
        over |= carry
        excess = ~over
        for j in range(width):
            excess &= count[j] if (radius + 1) >> j & 1 else ~count[j]
        over |= excess
        if i >= radius and i % 4 == 3:
            live = over != ~np.uint64(0)
            if not live.all():
                q, w, over = q[live], w[live], over[live]
                count = [c[live] for c in count]
                if not len(q):
                    break
    hits = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(len(q), 8), axis=1, bitorder="little")
    row, bit = np.nonzero(hits)
    return q[row], w[row] * 64 + bit


def forests(groups: list[np.ndarray], radius: int, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (member, root) of spanning forests of the links inside each group, as rows of bytes.

    groups: distinct rows of bytes, sorted, whose first ``width`` (all by default) are the fingerprint.  Each group fills words of its own, so that many small
    groups are compared in one pass, and a large one in blocks of queries.
    """
    first, held, pairs = 0, 0, 0
    for i, g in enumerate(groups):
        more = len(g) * -(-len(g) // 64)
        if held and pairs + more > PAIRS_MAX:
            yield _forest(groups[first:i], radius, width)
            first, held, pairs = i, 0, 0
        held, pairs = held + 1, pairs + more
    if held:
        yield _forest(groups[first:], radius, width)


def _forest(groups: list[np.ndarray], radius: int, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(g) for g in groups])
    words = -(-size // 64)
    word_at = np.cumsum(words) - words
    n_words = int(words.sum())
    place = np.repeat(64 * word_at - (np.cumsum(size) - size), size) + np.arange(size.sum())
    members = np.zeros((64 * n_words, groups[0].shape[1]), np.uint8)
    members[place] = np.concatenate(groups)
    here = np.zeros(64 * n_words, np.uint8)
    here[place] = 1
    closed = ~np.packbits(here, bitorder="little").view("<u8")
    vertical = planes(members[:, :width])
    per = np.repeat(words, size)  # words to compare each member with
    parent = np.arange(64 * n_words)
    step = max(1, PAIRS_MAX // int(words.max()))
    lead = np.repeat(word_at, size)
    for i in range(0, len(place), step):
        own, n = place[i : i + step], per[i : i + step]
        q = np.repeat(np.arange(len(own)), n)
        w = np.repeat(lead[i : i + step], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = compared(np.unpackbits(members[own, :width], axis=1), vertical, closed, q, w, radius)
        a = own[a]
        keep = a < b
        a, b = a[keep], b[keep]
        while len(a):
            ra, rb = parent[a], parent[b]
            live = ra != rb
            if not live.any():
                break
            a, b, ra, rb = a[live], b[live], ra[live], rb[live]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(parent, up := parent[parent]):
                parent = up
    member = np.flatnonzero(parent != np.arange(len(parent)))
    return members[member], members[parent[member]]


def _sorted_rows(flat: list[bytes]) -> np.ndarray:
    own = sorted(set(flat))
    return np.frombuffer(b"".join(own), np.uint8).reshape(len(own), -1)


def _linked(radius: int):
    """Rows (fps) of 64-bit fingerprints to forest edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets = np.asarray(b.column(0).offsets)
            flat = np.asarray(b.column(0).values).view(np.uint64)
            groups = [as_bytes(np.unique(flat[lo:hi])) for lo, hi in zip(offsets[:-1], offsets[1:])]
            for large, small in forests(groups, radius):
                out = [pa.array(np.ascontiguousarray(x).view(">u8")[:, 0].astype(np.uint64).view(np.int64)) for x in (large, small)]
                yield pa.RecordBatch.from_arrays(out, names=["a", "b"])

    return run


def _grouped(fps: DataFrame, choice: list[int], prefix: list[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(choice)]))
    return fps.select(*prefix, "fp", each.alias("g")).select(*prefix, "fp", "g.m", "g.v")


def links(spark: SparkSession, fps: DataFrame, radius: int = 2, group_max: int = GROUP_MAX) -> DataFrame:
    """Spanning-forest edges (a, b) over the distinct fingerprints ``fp`` at most ``radius`` bits apart.

    Groups beyond ``group_max`` are found by a count, which needs no group in one place, and split again by
    blocks of the bits their mask leaves free; a subgroup shares all but a few bits and so is small.
    """
    choice = masks(radius)
    rows = stage(spark, _grouped(fps, choice, []), "simhash-rows")
    sizes = rows.groupBy("m", "v").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = stage(spark, sizes, "simhash-groups")
    normal = rows.join(sizes.filter(F.col("n") <= group_max).select("m", "v"), ["m", "v"], "left_semi")
    parts = [normal.groupBy("m", "v").agg(F.collect_list("fp").alias("fps")).select("fps")]
    big = sizes.filter(F.col("n") > group_max).select("m", "v")
    if big.take(1):
        hot = rows.join(big, ["m", "v"], "left_semi").withColumnRenamed("m", "m0").withColumnRenamed("v", "v0")
        for i, m in enumerate(choice):
            sub = _grouped(hot.filter(F.col("m0") == i), masks(radius, 2**64 - 1 - m), ["v0"])
            parts.append(sub.groupBy("v0", "m", "v").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1").select("fps"))
    groups = parts[0]
    for p in parts[1:]:
        groups = groups.unionAll(p)
    out = stage(spark, groups.mapInArrow(lean(_linked(radius)), "a long, b long").distinct(), "simhash-links")
    drop_staged(spark, rows, sizes)
    return out


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for every node that reaches a smaller one.

    Alternating large-star and small-star rounds; each round is written to the shared folder, and only a row
    count and a checksum come to the driver.  Neighbour minima are aggregates with partial sums, so a hub is no
    single task.
    """
    now = stage(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            break
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select("b", "a"))
        low = stage(spark, both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-low")  # staged, the join can split a hub
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = stage(spark, large.distinct(), "cc-large")
        floor = stage(spark, large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "cc-floor")
        small = large.join(floor, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(floor.select("u", "m"))
        after = stage(spark, small.filter("a <> b").distinct(), "cc")
        drop_staged(spark, now, large, low, floor)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component): every row with its fingerprint and the smallest id reachable over links.

    Rows with equal fingerprints are linked; texts without a word have fingerprint 0 and link like any other.
    Defined cases: NULL text is empty; a NULL id takes part, and a component of NULL ids alone has a NULL
    component; rows repeating an id are linked as rows with one id would be; an empty table gives none.
    """
    fps = stage(spark, fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = stage(spark, fps.groupBy("fp").agg(F.min("id").alias("least")), "fp-least")
    edges = links(spark, least.select("fp"), radius)
    return _labelled(spark, fps, least, edges)


def _labelled(spark: SparkSession, fps: DataFrame, least: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fp, component) from rows (id, fp), the smallest id of each fp, and edges between fps."""
    roots = components(spark, edges)
    # The root of a component is its smallest fingerprint; the id wanted is the smallest of its documents.
    named = least.select("fp", "least").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stage(spark, named, "fp-roots")
    lowest = stage(spark, named.groupBy("root").agg(F.min("least").alias("component")), "fp-components")
    by_fp = named.join(lowest.hint("merge"), "root").select("fp", "component")
    return fps.select("id", "fp").join(by_fp.hint("merge"), "fp").select("id", "fp", "component")


#: Near copies: shingle words, fingerprint bits, bands of smallest shingle hashes that name the groups, and tile size.
NEAR_SHINGLE, NEAR_BITS, BANDS, ROWS, TILE = 5, 256, 16, 3, 256
#: Sketches of a group, and texts of a component, that one task compares without leaders.
NEAR_GROUP = 256
#: Leaders of a large group in each round.
LEADERS = (1, 4, 8)
_WIDTH = NEAR_BITS // 8
_BIT_SALTS = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64) for i in range(NEAR_BITS // 64)]
_MIN_ODDS = [np.uint64((0xD1B54A32D192ED03 * (2 * i + 1) ^ i << 40) % 2**64 | 1) for i in range(BANDS * ROWS)]


def near_radius(similarity: float) -> int:
    """Bits in which fingerprints of texts of a Jaccard similarity differ at most: six standard deviations above the
    mean, which is the angle between their shingle sets, whose cosine is 2 J / (1 + J), as a share of half a turn.

    At 0.8 these are 73 bits; the widest pair there, sets of 4 and 5 shingles, differs in 48 on average, 4 deviations less.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(NEAR_BITS * share + 6 * np.sqrt(NEAR_BITS * share * (1 - share))))


def shingle_sets(texts: list[bytes], shingle: int = NEAR_SHINGLE) -> Iterator[np.ndarray]:
    """Per text the sorted hashes of its set of word shingles (A-Z in lower case).

    Texts of fewer words have one shingle, all their words; texts without words have none.
    """
    buf, at = W.joined([t.lower() for t in texts])
    start, end = W.spans(buf)
    h = W.hashes(buf, start, end)
    first = np.searchsorted(start, at)
    for i in range(len(texts)):
        own = h[first[i] : first[i + 1]]
        yield np.unique(W.window_hashes(own, min(shingle, len(own)))) if len(own) else own


def set_key(g: np.ndarray) -> bytes:
    """The name of a shingle set."""
    return xxhash.xxh3_128_digest(g.tobytes())


def near_sketch(texts: list[bytes], shingle: int = NEAR_SHINGLE) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Per text the name of its shingle set, the 256-bit SimHash of the set, and its band keys; texts without words share a zero sketch."""
    names = []
    prints = np.zeros((len(texts), _WIDTH), np.uint8)
    keys = np.zeros((len(texts), BANDS), np.uint64)
    for i, g in enumerate(shingle_sets(texts, shingle)):
        names.append(set_key(g))
        if not len(g):
            continue
        total = np.zeros(NEAR_BITS, np.int64)
        for j in range(0, len(g), 1 << 14):
            wide = np.stack([W.mix(g[j : j + (1 << 14)] ^ s) for s in _BIT_SALTS], 1)
            total += np.unpackbits(wide.view(np.uint8), axis=1).sum(0, dtype=np.int64)
        prints[i] = np.packbits(2 * total > len(g))
        least = np.array([(g * odd).min() for odd in _MIN_ODDS], np.uint64).reshape(BANDS, ROWS)
        keys[i] = W.mix(W.mix(W.mix(least[:, 0]) ^ least[:, 1]) ^ least[:, 2])
    return names, prints, keys


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, prints, keys = [], [], []
        for _, texts in in_bytes(utf8(b.column(1)), 1 << 20):
            n, p, k = near_sketch(texts)
            names += n
            prints += [x.tobytes() for x in p]
            keys += list(k.view(np.int64))
        columns = [b.column(0), pa.array(names, pa.binary()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "bits", "bands"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text) to (fp, text)."""
    for b in batches:
        for first, texts in in_bytes(utf8(b.column(0)), 1 << 20):
            names = pa.array([set_key(g) for g in shingle_sets(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([names, b.column(0).slice(first, len(texts))], names=["fp", "text"])


def _near_linked(radius: int):
    """Rows (fps) of sketches, each followed by the name of its set, to forest edges between names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for large, small in forests([_sorted_rows(x) for x in b.column(0).to_pylist()], radius, _WIDTH):
                yield pa.RecordBatch.from_arrays([pa.array([x[_WIDTH:].tobytes() for x in y], pa.binary()) for y in (large, small)], names=["a", "b"])

    return run


def confirmed(prints: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int) -> list[tuple[int, int]]:
    """Spanning-forest edges of the pairs of sets whose exact Jaccard similarity is at least ``similarity``.

    prints: the sets' SimHashes as rows of bytes; pairs over ``radius`` bits apart are not looked at.
    """
    wide = np.ascontiguousarray(prints).view(np.uint64)
    size = np.array([len(g) for g in sets])
    end = np.cumsum(size)
    every = np.concatenate(sets)
    held, ids = np.unique(every, return_inverse=True)
    mark = np.zeros(len(held), bool)
    root = np.arange(len(sets))
    out = []
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        j = j[root[j] != root[i]]
        j = j[np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9]
        j = j[np.bitwise_count(wide[j] ^ wide[i]).sum(1) <= radius]
        if not len(j):
            continue
        own = ids[end[i] - size[i] : end[i]]
        mark[own] = True
        both = np.array([np.count_nonzero(mark[ids[end[k] - size[k] : end[k]]]) for k in j])
        mark[own] = False
        for k in j[both >= similarity * (size[i] + size[j] - both) - 1e-9]:
            if root[k] != root[i]:
                out.append((i, int(k)))
                root[root == root[k]] = root[i]
    return out


def _confirmed(similarity: float, radius: int):
    """Rows (root, lo, hi, fp, bits, text), those of one (root, lo, hi) in a row, to confirmed forest edges."""

    def edges(names: list[bytes], prints: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
        sets = [g for _, part in in_bytes(texts, 1 << 20) for g in shingle_sets(part)]
        rows = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)
        pairs = confirmed(rows, sets, similarity, radius)
        return pa.RecordBatch.from_arrays([pa.array([names[p[i]] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, prints, texts = None, [], [], []
        for b in batches:
            keys = zip(*(b.column(i).to_pylist() for i in range(3)))
            for key, name, bits, text in zip(keys, b.column(3).to_pylist(), b.column(4).to_pylist(), utf8(b.column(5))):
                if key != now:
                    if len(names) > 1:
                        yield edges(names, prints, texts)
                    now, names, prints, texts = key, [], [], []
                names.append(name)
                prints.append(bits)
                texts.append(text)
        if len(names) > 1:
            yield edges(names, prints, texts)

    return run


def _near_bits(radius: int):
    """Rows and leaders (fp, ..) at most ``radius`` bits apart, by the sketch that ``fp`` begins with."""

    def prepare(leaders: list[dict]) -> np.ndarray:
        return np.frombuffer(b"".join(x["fp"][:_WIDTH] for x in leaders), np.uint64).reshape(len(leaders), -1)

    def test(leaders: np.ndarray, rows: dict[str, list]) -> np.ndarray:
        own = np.frombuffer(b"".join(x[:_WIDTH] for x in rows["fp"]), np.uint64).reshape(len(rows["fp"]), -1)
        return np.bitwise_count(own[:, None] ^ leaders[None]).sum(2) <= radius

    return prepare, test


def _near_sets(similarity: float):
    """Rows and leaders (fp, bits, text) whose shingle sets have at least that Jaccard similarity."""

    def prepare(leaders: list[dict]) -> list[np.ndarray]:
        return list(shingle_sets([x["text"].encode() for x in leaders]))

    def test(leaders: list[np.ndarray], rows: dict[str, list]) -> np.ndarray:
        out = []
        for _, part in in_bytes([t.encode() for t in rows["text"]], 1 << 20):
            for g in shingle_sets(part):
                both = np.array([np.isin(g, x, assume_unique=True).sum() if min(len(g), len(x)) >= similarity * max(len(g), len(x)) - 1e-9 else -1 for x in leaders])
                size = np.array([len(x) for x in leaders])
                out.append((both >= 0) & (both >= similarity * (len(g) + size - both) - 1e-9))
        return np.array(out)

    return prepare, test


def _follow(by: list[str], pay: list[str], first: int, near):
    """Rows (by .., fp, pay .., k, leads, lead) to the same but ``lead``: ``k`` gains a bit and ``leads`` a name for every leader
    a row is near to; leaders are numbered from ``first``."""
    prepare, test = near
    names = [*by, "fp", *pay, "k", "leads"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders, ready = None, [], None
        for b in batches:
            t = {c: b.column(c).to_pylist() for c in names}
            keys = list(zip(*(t[c] for c in by)))
            lo = 0
            while lo < len(keys):
                hi = lo
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                if keys[lo] != now:
                    now, leaders = keys[lo], b.column("lead")[lo].as_py() or []
                    ready = prepare(leaders) if leaders else None
                if leaders:
                    close = test(ready, {c: t[c][lo:hi] for c in ("fp", *pay)})
                    for i in np.flatnonzero(close.any(1)).tolist():
                        own = np.flatnonzero(close[i]).tolist()
                        t["k"][lo + i] |= sum(1 << first + j for j in own)
                        t["leads"][lo + i] = t["leads"][lo + i] + [leaders[j]["fp"] for j in own if leaders[j]["fp"] != t["fp"][lo + i]]
                lo = hi
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*by, "fp", *pay)), pa.array(t["k"], pa.int64()), pa.array(t["leads"], pa.list_(pa.binary()))], names=names)

    return run


@F.pandas_udf(ArrayType(LongType()))
def _joined(masks: pd.Series) -> pd.Series:
    """Each mask of a row's list with the bits of all masks that it reaches through common bits."""

    def closed(own: np.ndarray) -> list[int]:
        groups: list[int] = []
        for m in map(int, own):
            apart = [g for g in groups if not g & m]
            groups = [*apart, reduce(or_, (g for g in groups if g & m), m)]
        return [next((g for g in groups if g & m), 0) for m in map(int, own)]

    return masks.map(closed)


def led(spark: SparkSession, rows: DataFrame, by: list[str], pay: list[str], near, name: str) -> tuple[DataFrame, DataFrame]:
    """(edges, pairs): how the rows (by .., fp, pay ..) of large groups are compared without all pairs of a group.

    In ``LEADERS`` rounds some rows of each group that follow no leader yet lead it: every row is compared with them.
    ``edges`` (a, b) join rows to leaders they are near to, so rows of one leader need no comparison among themselves, nor
    those of leaders that some row follows both.  ``pairs`` holds the other rows, those without a leader above all, once for
    each pair (lo, hi) of tiles of about ``TILE`` rows that may still hold a link: nothing where all rows of a group follow
    one leader, and no link is lost.
    """
    now = stage(spark, rows.select(*by, "fp", *pay, F.lit(0).cast("long").alias("k"), F.array().cast("array<binary>").alias("leads")), name)
    first = 0
    for n in LEADERS:
        free = now.filter("k = 0").groupBy(*by, F.pmod(F.xxhash64("fp"), F.lit(n)).alias("s")).agg(F.min(F.struct("fp", *pay)).alias("x"))
        leaders = stage(spark, free.groupBy(*by).agg(F.sort_array(F.collect_list("x")).alias("lead")), name + "-leaders")
        after = stage(spark, now.join(leaders.hint("merge"), by, "left").mapInArrow(lean(_follow(by, pay, first, near)), now.schema), name)
        drop_staged(spark, now, leaders)
        now, first = after, first + n
    edges = now.select(F.col("fp").alias("a"), F.explode("leads").alias("b"))

    # Leaders with a follower in common are one.  Followers that are few are as rows without a leader (-1).
    sizes = now.groupBy(*by, "k").agg(F.count("*").alias("n")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("c"))
    sizes = sizes.withColumn("g", _joined("c.k")).select(*by, F.explode(F.arrays_zip(F.col("c.k").alias("own"), F.col("c.n").alias("n"), F.col("g").alias("k"))).alias("x"))
    sizes = sizes.select(*by, "x.*").groupBy(*by, "k").agg(F.sum("n").alias("n"), F.collect_list("own").alias("own"))
    alone = (F.col("k") == 0) | (F.col("n") < TILE)
    sizes = sizes.groupBy(*by, F.when(alone, -1).otherwise(F.col("k")).alias("k")).agg(F.ceil(F.sum("n") / TILE).cast("int").alias("tiles"), F.flatten(F.collect_list("own")).alias("own"))
    sizes = sizes.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("k", "tiles", "own"))).alias("c"))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<k:bigint,first:int,tiles:int,own:array<bigint>>>").alias("out"))
    placed = F.aggregate(
        "c",
        start,
        lambda s, c: F.struct((s["next"] + c["tiles"]).alias("next"), F.concat(s["out"], F.array(F.struct(c["k"].alias("k"), s["next"].alias("first"), c["tiles"].alias("tiles"), c["own"].alias("own")))).alias("out")),
        lambda s: s["out"],
    )
    plan = stage(spark, sizes.select(*by, placed.alias("c")), name + "-tiles")
    pairs = now.select(*by, "fp", *pay, "k").join(plan.hint("merge"), by)
    mine = F.get(F.filter("c", lambda c: F.array_contains(c["own"], F.col("k"))), F.lit(0))
    pairs = pairs.withColumn("mine", mine)
    others = F.flatten(F.transform(F.filter("c", lambda c: (c["k"] != F.col("mine.k")) | (c["k"] == -1)), lambda c: F.sequence(c["first"], c["first"] + c["tiles"] - 1)))
    pairs = pairs.withColumn("t", F.col("mine.first") + F.pmod(F.xxhash64("fp"), F.col("mine.tiles")).cast("int")).withColumn("o", F.explode(others))
    return edges, pairs.select(*by, "fp", *pay, F.least("t", "o").alias("lo"), F.greatest("t", "o").alias("hi"))


def near_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, group_max: int = NEAR_GROUP) -> DataFrame:
    """(id, fp, component): near copies, that is texts linked by pairs whose sets of five-word shingles have a Jaccard
    similarity of ``similarity`` at least; ``fp`` names the set of a row.

    Candidates: groups are named by bands of smallest shingle hashes (a pair at 0.8 shares one with probability
    0.99999), and inside a group the 256-bit SimHashes of distinct sets are compared bit-sliced at a radius that keeps
    pairs at ``similarity`` surely.  Each component of candidates is then compared again, and an edge counts only where
    the exact similarity of the shingle sets confirms it.  Groups and components over ``group_max`` are first compared
    with leaders (``led``), so that near copies of one text cost as many comparisons as there are of them.
    Defined cases: NULL text is empty, and texts without a word are copies of each other; a NULL id takes part, and a
    component of NULL ids alone has a NULL component; rows repeating an id are linked as rows with one id would be; other
    columns are not read; an empty table gives none.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    radius = near_radius(similarity)
    fps = stage(spark, src.mapInArrow(lean(_sketched), f"id {kind}, fp binary, bits binary, bands array<long>"), "sketches")
    # Equal names have equal sets, and so equal sketches and bands.
    least = stage(spark, fps.groupBy("fp").agg(F.min("id").alias("least"), F.first("bits").alias("bits"), F.first("bands").alias("bands")), "sketch-least")
    rows = stage(spark, least.select(F.concat("bits", "fp").alias("fp"), F.posexplode("bands").alias("m", "v")), "sketch-rows")
    sizes = stage(spark, rows.groupBy("m", "v").agg(F.count("*").alias("n")).filter("n > 1"), "sketch-groups")
    groups = rows.join(sizes.filter(F.col("n") <= group_max), ["m", "v"]).groupBy("m", "v").agg(F.collect_list("fp").alias("fps")).select("fps")
    big = sizes.filter(F.col("n") > group_max).select("m", "v")
    loose = None
    if big.take(1):
        loose, pairs = led(spark, rows.join(big, ["m", "v"], "left_semi"), ["m", "v"], [], _near_bits(radius), "sketch-large")
        loose = loose.select(*[F.expr(f"substring({c}, {_WIDTH + 1}, 16)").alias(c) for c in ("a", "b")])
        groups = groups.unionAll(pairs.groupBy("m", "v", "lo", "hi").agg(F.collect_list("fp").alias("fps")).select("fps"))
    near = groups.mapInArrow(lean(_near_linked(radius)), "a binary, b binary")
    loose = stage(spark, (near if loose is None else near.unionAll(loose)).distinct(), "sketch-links")
    drop_staged(spark, rows, sizes)

    roots = components(spark, loose)
    roots = stage(spark, roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct()), "sketch-roots")
    sizes = stage(spark, roots.groupBy("root").agg(F.count("*").alias("n")), "sketch-sizes")
    named = roots.join(sizes.hint("merge"), "root").select("root", "n", F.col("node").alias("fp"))
    members = stage(spark, named.join(least.select("fp", "bits").hint("merge"), "fp"), "sketch-members")
    texts = src.select("text").mapInArrow(lean(_keyed), "fp binary, text string").groupBy("fp").agg(F.min("text").alias("text"))
    members = members.join(texts.hint("merge"), "fp").select("root", "n", "fp", "bits", F.coalesce("text", F.lit("")).alias("text"))
    edges = None
    if sizes.filter(F.col("n") > group_max).take(1):
        members = stage(spark, members, "sketch-texts")
        edges, pairs = led(spark, members.filter(F.col("n") > group_max), ["root"], ["bits", "text"], _near_sets(similarity), "near-large")
        small = members.filter(F.col("n") <= group_max)
        small = small.select("root", "fp", "bits", "text", F.lit(0).alias("lo"), F.lit(0).alias("hi")).unionByName(pairs)
    else:
        small = members.select("root", "fp", "bits", "text", F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    small = small.select("root", "lo", "hi", "fp", "bits", "text").repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "fp")
    found = small.mapInArrow(lean(_confirmed(similarity, radius)), "a binary, b binary")
    edges = stage(spark, (found if edges is None else found.unionAll(edges)).distinct(), "near-links")
    drop_staged(spark, loose, roots, sizes)
    return _labelled(spark, fps, least, edges)
