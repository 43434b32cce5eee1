"""SimHash components and substring dedup against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import simhash, substring_dedup
from lodestone.llm.fmindex import FMIndex, Wavelet


def _fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(rows, fps, radius):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    groups: dict[int, list] = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(rows))]


def _texts():
    rng = np.random.default_rng(0)
    base = " ".join(map(str, rng.integers(0, 400, 300)))
    near = [base.replace(" 7", f" {k}", 1) for k in range(400, 440)]
    return [None, "", " \t", "one", "ONE", "one two", "One Two", *near, base, base, "x " * 5000, "É é", *[" ".join(map(str, rng.integers(0, 9, 30))) for _ in range(20)]]


def test_components(spark):
    rows = [(i, t) for i, t in enumerate(_texts())] + [(3, "again"), (None, "one")]
    fps = [_fingerprint(t) for _, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("m", F.lit(2))
    got = simhash.simhash_components(spark, df.repartition(5)).collect()
    want = _components(rows, fps, 2)
    ids = sorted(((i, f, c) for (i, _), f, c in zip(rows, fps, want)), key=repr)
    assert sorted(((r.id, r.fp % 2**64, r.component) for r in got), key=repr) == ids
    assert simhash.simhash_components(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("group_max", [1024, 2])
def test_links_join_the_same_fingerprints_at_any_group_size(spark, group_max):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 6).astype(np.uint64)
    near = [int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for s in seeds for _ in range(25)]
    fps = sorted(set(near))
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(spark, df, 2, group_max).collect()]
    assert all((a ^ b).bit_count() <= 128 for a, b in edges)
    roots = {r.node: r.root for r in simhash.components(spark, simhash.links(spark, df, 2, group_max)).collect()}
    want = _components([(f,) for f in fps], fps, 2)
    mine: dict = {}
    for f, w in zip(fps, want):
        mine.setdefault(roots.get(simhash._signed(f), simhash._signed(f)), set()).add(w)
    assert all(len(v) == 1 for v in mine.values()) and len(mine) == len(set(want))


def test_bit_sliced_distances(monkeypatch):
    rng = np.random.default_rng(2)
    m = rng.integers(0, 256, (150, 32)).astype(np.uint8)
    m[75:] = m[:75]
    m[75:, 3] ^= 1
    m[100:, 0] ^= 5
    n = 150
    closed = np.array([0, 0, 2**64 - 2**22], np.uint64)
    q, w = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(3), indexing="ij"))
    for radius in (0, 2, 20, 130):
        a, b = simhash.compared(np.unpackbits(m, axis=1), simhash.planes(m), closed, q, w, radius)
        d = np.bitwise_count(m[:, None] ^ m[None]).sum(2)
        assert set(zip(a.tolist(), b.tolist())) == set(zip(*map(list, np.nonzero(d <= radius))))
    for limit in (4, 64, 1 << 15):
        monkeypatch.setattr(simhash, "PAIRS_MAX", limit)
        groups = [m[:70], m[60:63], m[[5, 80]], m]
        edges = [e for large, small in simhash.forests(groups, 2) for e in zip(map(bytes, large), map(bytes, small))]
        assert all(np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum() <= 4 for a, b in edges)
        assert len(edges) == 1 + 25


@pytest.mark.parametrize("group_max", [1024, 4])
def test_near_copies(spark, group_max):
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    rows = []
    for g in range(5):
        base = word(300)
        for c in range(12):
            own = list(base)
            own[rng.integers(0, 300)] = f"changed{c}"
            rows.append((100 * g + c, " ".join(own)))
    rows += [(900 + i, " ".join(word(200))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component for r in simhash.near_components(spark, df, group_max=group_max).collect()}
    assert got == {i: (i if i >= 900 else i // 100 * 100) for i, _ in rows}


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _alike(rows, similarity=0.8):
    """The smallest id reachable over pairs of an exact Jaccard similarity, by brute force."""
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                root = [root[i] if r == root[j] else r for r in root]
    return {d: min(rows[k][0] for k in range(len(rows)) if root[k] == r) for (d, _), r in zip(rows, root)}


@pytest.mark.parametrize("group_max, tile", [(1024, 512), (3, 4)])
def test_near_copies_are_those_of_exact_similarity(spark, group_max, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 9000, n)]
    rows = []
    for n in (8, 60, 200, 800):
        for j in (0.75, 0.78, 0.79, 0.8, 0.81, 0.82, 0.85, 0.9):
            for _ in range(6):
                base = word(n + 4)
                tail = round(n * (1 - j) / (1 + j))  # the last shingles differ
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[: len(base) - tail] + word(tail)))]
    base = word(204)
    for c in range(14):  # a chain whose neighbours alone are near copies
        rows.append((len(rows), " ".join(base[c * 8 : c * 8 + 100])))
    want = _alike(rows)
    assert 80 < sum(want[i] != i for i, _ in rows) < len(rows) // 2
    got = {r.id: r.component for r in simhash.near_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), group_max=group_max).collect()}
    assert got == want


@pytest.mark.parametrize("strays", [0, 5])
def test_a_large_group_of_near_copies_is_compared_with_its_leaders_alone(spark, strays):
    rng = np.random.default_rng(3)
    center = np.unpackbits(rng.integers(0, 256, 32).astype(np.uint8))
    n = 20_000
    bits = np.repeat(center[None], n, 0)
    bits[np.arange(n), rng.integers(0, 256, n)] ^= 1
    rows = [np.packbits(b).tobytes() + i.to_bytes(16, "big") for i, b in enumerate(bits)]
    rows += [rng.bytes(32) + (n + i).to_bytes(16, "big") for i in range(strays)]
    df = spark.createDataFrame([(0, 7, r) for r in rows], "m int, v long, fp binary")
    edges, pairs = simhash.led(spark, df, ["m", "v"], [], simhash._near_bits(simhash.near_radius(0.8)), "test")
    roots = {bytes(r.node): r.root for r in simhash.components(spark, edges).collect()}
    assert len({bytes(v) for v in roots.values()}) == 1 and len(roots) == n - 1
    assert pairs.count() == 0 if not strays else pairs.count() <= 2 * n


def test_sets_of_one_sketch_stay_apart(spark):
    words = [f"w{x}" for x in np.random.default_rng(7).integers(0, 9**9, 20000)]
    text = " ".join(words)
    first = simhash.near_sketch([text.encode()])
    for k in range(100):
        other = f"{text} more{k}"
        second = simhash.near_sketch([other.encode()])
        if (first[1] == second[1]).all():
            break
    assert (first[1] == second[1]).all() and first[0] != second[0]
    got = {r.id: r for r in simhash.near_components(spark, spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")).collect()}
    assert got[1].fp != got[2].fp and got[2].component == 1


def _removed(rows, window=50):
    words = [((d, t), (t or "").encode().split()) for d, t in rows]
    low: dict = {}
    for (d, _), w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                low[k] = min(d, low.get(k, d))
    out = []
    for (d, _), w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and low.get(tuple(w[i : i + window]), d) < d:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _passages():
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    p, q = word(90), word(49)
    rows = [(1, None), (2, ""), (3, " ".join(p)), (4, " ".join(word(30) + p + word(40))), (5, "\n".join(word(10) + p[20:75] + word(10)))]
    rows += [(6, " ".join(word(5) + q)), (7, " ".join(q + word(5))), (8, "a " * 300), (9, " b" + " a" * 120), (10, " ".join(p + p))]
    rows += [(20 + i, " ".join(word(int(rng.integers(0, 60))) + p + word(int(rng.integers(0, 60))))) for i in range(40)]
    rows += [(70 + i, rows[3][1]) for i in range(5)] + [(None, " ".join(p)), (4, " ".join(p[:60])), (200, " ".join(word(3000) + p + q + word(2000)))]
    return rows


@pytest.mark.parametrize("split", [substring_dedup.SPLIT, 3, 0])
def test_substring_dedup(spark, split):
    rows = _passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("anchor", F.lit(0))
    if split < substring_dedup.SPLIT:
        cuts = substring_dedup.repeated_words(spark, df.repartition(4), "doc_id", "text", split=split)
        want = {(d, n) for d, _, n, _ in _removed(rows) if n}
        got = {(r.doc, len({j for c in r.cuts for j in range(c.lo, c.hi)})) for r in cuts.collect()}
        assert got == want
    else:
        got = substring_dedup.substring_dedup(spark, df.repartition(4)).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == _removed(rows)
        assert substring_dedup.substring_dedup(spark, df.limit(0)).count() == 0


def test_substring_dedup_takes_text_ids(spark):
    rows = [(d and f"id-{d:05d}", t) for d, t in _passages()]
    got = substring_dedup.substring_dedup(spark, spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == _removed(rows)


def test_every_cut_comes_from_matching_statistics(spark, monkeypatch):
    """Without the answers of the shards nothing is removed, exact copies included."""
    monkeypatch.setattr(substring_dedup, "_shard", lambda window: lambda batches: (pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.nulls(b.num_rows, RUNS)], names=["anchor", "content", "runs"]) for b in batches))
    df = spark.createDataFrame(_passages(), "doc_id long, text string")
    assert substring_dedup.repeated_words(spark, df, "doc_id", "text", split=3).count() == 0


RUNS = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("low", pa.int64())]))


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    text = np.concatenate((rng.integers(1, 4, 300), [0], rng.integers(1, 4, 200), [0]))
    index = FMIndex(text, 4, np.zeros(len(text), np.int64), 40)
    for size in (1, 2, 3, 5, 8):
        for at in rng.integers(0, 290, 30):
            pattern = text[at : at + size]
            lo, hi = np.array([0]), np.array([len(text)])
            for c in pattern[::-1]:
                lo, hi = index.extend(np.array([c]), lo, hi)
            count = sum((text[i : i + size] == pattern).all() for i in range(len(text) - size + 1))
            assert hi[0] - lo[0] == count
    s = rng.integers(0, 37, 1000)
    w = Wavelet(s, 37)
    for c in range(37):
        i = np.arange(0, 1001, 7)
        assert (w.rank(np.full(len(i), c), i) == [np.count_nonzero(s[:k] == c) for k in i]).all()


def test_matches_of_a_shard():
    rng = np.random.default_rng(9)
    word = lambda n: [b"w%d" % x for x in rng.integers(0, 9, n)]
    p = word(80)
    texts = [b" ".join(x) for x in (p, word(7) + p[3:70], p[:60] + word(9), word(60), p)]
    owner = np.array([5, 2, 9, 1, 5])
    got = substring_dedup.matched(texts, owner)
    split = [t.split() for t in texts]
    for i, w in enumerate(split):
        want = [min(owner[j] for j, v in enumerate(split) for m in range(len(v) - 49) if w[k : k + 50] == v[m : m + 50]) for k in range(len(w) - 49)]
        assert got[i].tolist() == want
