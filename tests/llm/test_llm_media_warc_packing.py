"""Exact round trips: the chunk store, WARC archives, packing and segmentations."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import media, packing, subwords, warc
from lodestone.llm import queries as Q

TOKENIZER, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
RNG = np.random.default_rng(1)
LONG = " ".join(f"word{x}" for x in RNG.integers(0, 900, 9000))


def test_chunks_depend_on_the_payload_alone():
    h, want = 0, []
    raw = RNG.bytes(2000)
    for x in raw:
        h = ((h << 1) + int(media._GEAR[x])) & 0xFFFFFFFF
        want.append(h)
    assert media.gear(np.frombuffer(raw, np.uint8)).tolist() == want
    many = [media.payload(RNG.bytes(n)) for n in (0, 1, 63, 64, 65, 511, 70000, 5)]
    assert media.chunk_ends(many) == [media.chunk_ends([p])[0] for p in many]
    shifted = media.payload(b"prefix" + LONG.encode())
    cuts = lambda p: {p[a:b] for a, b in itertools.pairwise([0, *media.chunk_ends([p])[0]])}
    assert len(cuts(shifted) & cuts(media.payload(LONG.encode()))) > 10


def test_media(spark):
    rows = [(1, None), (2, ""), (3, "x" * 64), (4, "é\n"), (5, LONG), (6, "intro " + LONG), (7, LONG), (7, "other"), (None, LONG[:5000]), (8, LONG + LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sha", F.lit(1)).withColumn("own", F.lit("z"))
    got = media.media_features(spark, df.repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = [(t or "").encode() for d, t in rows if d == r.id]
        pads = {hashlib.sha256(p).hexdigest(): p for p in map(media.payload, raw)}
        p = pads[r.payload_sha256]
        assert len(p) == r.payload_bytes and len(p) % 64 == 0 and r.n_bytes in map(len, raw) and r.tail_crc32 == zlib.crc32(p[-64:])
        assert p.rstrip(b"\0") in [x.rstrip(b"\0") for x in raw]
    by = collections.defaultdict(set)
    for r in got:
        by[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())
    assert media.media_features(spark, df.limit(0)).count() == 0


def test_chunks_are_stored_once(spark):
    df = spark.createDataFrame([(1, LONG), (2, "intro " + LONG)], "doc_id long, text string")
    _, store = media.store_media(spark, df)
    sizes = store.select(F.explode("own").alias("c")).agg(F.sum(F.length("c.data"))).first()[0]
    assert sizes < 1.3 * len(LONG)


def test_warc(spark):
    big = "<p>" + "payload " * 300
    rows = [(1, "http://a/ b", big), (2, None, big), (9, "http://c", big), (9, "http://c", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "é", "é" * 600), (None, "n", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("offset", F.lit(0))
    index = warc.write_archives(spark, df.repartition(3))
    got = warc.read_archives(index).collect()
    want = [(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), *(("revisit", 9) if h == big and i != 9 else ("response", None))) for i, _, h in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    one = index.filter("page_id = 3").first()
    raw = open(one.archive.removeprefix("file://"), "rb").read()[one.offset : one.offset + one.length]
    rec = warc.parse(zlib.decompress(raw, 31))
    assert rec["payload"] == b"small" and rec["fields"]["WARC-Type"] == "response" and rec["fields"]["WARC-Target-URI"] == "u"
    assert warc.warc_round_trip(spark, df.limit(0)).count() == 0


def test_warc_matches_duckdb(same_as_duckdb):
    same_as_duckdb(Q.op7_warc, Q.OP7_SQL)


ODD = ["", None, "a <|endoftext|> b", "É é x́y z q don't I'LL 123 a\x1cb !'s 's'", "x" * 5000, "ὈΔΥΣΣΕΎΣ Σ. İ ŀ ǅ ẞ", "日本語 テキスト。 한국어 \U0001f600", LONG, LONG, "One. Two! Three? " * 900]


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = [(i % 9, t) for i, t in enumerate(ODD)] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    tok = Tokenizer.from_file(TOKENIZER)
    want = sorted((np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1]).tolist() for _, t in rows), key=repr)
    pieces = packing.pack(df.coalesce(2), TOKENIZER, with_ids=True).toPandas()
    seqs = pieces.sort_values(["sequence_id", "offset"])
    assert ((seqs.groupby("sequence_id").length.cumsum() - seqs.length) == seqs.offset).all()
    fill = seqs.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and fill.sum() / (2048 * (len(fill) - 2)) > 0.97
    for r in pieces.itertuples():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    docs, own = [], []
    for r in seqs.itertuples():  # documents keep their order in the stream
        own += list(r.ids)
        if r.start + r.length == r.doc_tokens:
            docs.append(own)
            own = []
        assert r.start + r.length <= r.doc_tokens
    assert sorted(docs, key=repr) == want
    assert packing.pack(df.limit(0), TOKENIZER).count() == 0


def _any_text(rng, top: int, n: int = 40) -> str:
    """Code points below ``top``, unassigned ones and combining marks included, among blanks, contractions and digits."""
    often = " \n'stredlvm0129aB.!\u0327\u0301\u0130\u0308"
    points = [int(x) for x in rng.integers(0, top, n)]
    return "".join(often[x % len(often)] if x % 3 == 0 or 0xD800 <= x < 0xE000 else chr(x) for x in points)


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER)
    texts = [_any_text(RNG, top) for top in (0x250, 0x600, 0x3000, 0x10000, 0x20000, 0x110000) for _ in range(400)]
    texts += ["abc B\u0558 def", "\u209eA", "x\u088fy", "\u0c5cS", "\u058b'", "\u0130\u0329", "\x85\xa0a\x1cb"]
    texts.append(" ".join(f"w{i}x." for i in range(1_100_000)))  # 11 MB, over a million distinct words
    for first, last, s in enc.streams([t.encode() for t in texts], 1):
        ends = [0, *s.doc_end.tolist()]
        for i in range(first, last):
            got = s.ids[ends[i - first] : ends[i - first + 1]]
            assert np.array_equal(got, [*tok.encode(texts[i], add_special_tokens=False).ids, 1]), texts[i][:99]
    assert len(s.sentence_end) == 1_100_000 and s.at[-1] == len(s.ids) and np.diff(s.at).max() <= 2048


def test_cuts_are_optimal():
    for _ in range(30):
        at = np.cumsum(RNG.integers(1, 9, 14))
        cost = RNG.integers(0, 6, 14)
        cost[-1] = 0

        def price(cuts):
            ends = [0, *cuts]
            if any(b - a > 12 for a, b in itertools.pairwise(ends)):
                return math.inf
            return sum(12 - (b - a) for a, b in itertools.pairwise(ends)) + sum(cost[at.tolist().index(c)] for c in cuts)

        best = min(price([*c, at[-1]]) for k in range(14) for c in itertools.combinations(at[:-1].tolist(), k))
        assert price(packing.best_cuts(at, cost, 12)) == best


def test_segmentations_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "▁ literal"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("seed", F.lit("clash"))
    got = subwords.sample_segmentations(df.repartition(3), PIECES, k=3, with_ids=True).collect()
    assert all(r.round_trip for r in got)
    per = collections.Counter((r.id, r.decoded_crc32) for r in got)
    assert per[1, 0] == 1 and per[9, zlib.crc32(ODD[9].encode())] == 3
    for key in per:
        own = [tuple(r.ids) for r in got if (r.id, r.decoded_crc32) == key]
        assert len(set(own)) == len(own) or key[0] in (7, 8)
    again = subwords.sample_segmentations(df.repartition(1), PIECES, k=3).collect()
    assert sorted((str(r.id), r.sample, r.ids_crc32) for r in got) == sorted((str(r.id), r.sample, r.ids_crc32) for r in again)
    assert subwords.sample_segmentations(df.limit(0), PIECES).count() == 0


def test_encode_and_decode_are_the_models_own(spark):
    texts = ["  Hello   world \n\nfoo\tbar", "é \U0001f600", "", "plain words here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = subwords.encode(df, PIECES)
    sp = subwords.vocabulary(PIECES).model
    assert {r.id: list(r.ids) for r in coded.collect()} == {i: sp.encode(t) for i, t in enumerate(texts)}
    assert {r.id: r.text for r in subwords.decode(coded, PIECES).collect()} == dict(enumerate(texts))


def test_sampling_without_replacement_has_the_right_law():
    v = subwords.vocabulary(PIECES, 0.25)
    text = b"the cat"
    lat = subwords.Lattices(v)
    token, _ = lat.words([text])

    def paths(node, base):
        return [[]] if node == base else [[*p, e] for e in range(lat.head[node], lat.head[node + 1]) for p in paths(lat.begin[e], base)]

    words = [paths(lat.last[w], lat.base[w]) for w in token]
    law = {tuple(lat.ids(np.array(sum(c, []))).tolist()): math.exp(sum(lat.log_p[e] for p in c for e in p)) for c in itertools.product(*words)}
    assert sum(law.values()) == pytest.approx(1)
    n = 6000
    first, pairs, inclusion = collections.Counter(), collections.Counter(), collections.Counter()
    for rows in subwords.segmentations(v, [text] * n, np.arange(n).astype(np.uint64) * 7919, 2):
        a, b = (tuple(r[0].tolist()) for r in rows)
        assert a != b and rows[0][2] >= rows[1][2]
        first[a] += 1
        pairs[a, b] += 1
        for r, k in zip(rows, (a, b)):
            inclusion[k] += 1 / r[3]
    top = sorted(law, key=lambda k: -law[k])[:3]
    for a in top:
        assert abs(first[a] / n - law[a]) < 4 * (law[a] / n) ** 0.5
        assert inclusion[a] / n == pytest.approx(1, abs=0.12)
        for b in top:
            if a != b:
                p = law[a] * law[b] / (1 - law[a])
                assert abs(pairs[a, b] / n - p) < 4 * (p / n) ** 0.5


def test_a_text_with_few_segmentations_gives_all():
    v = subwords.vocabulary(PIECES, 0.25)
    rows = subwords.segmentations(v, [b"q7"], np.array([1], np.uint64), 50)[0]
    lat = subwords.Lattices(v)
    token, _ = lat.words([b"q7"])
    assert len(rows) == len({tuple(r[0].tolist()) for r in rows})
    assert sum(math.exp(r[1]) for r in rows) == pytest.approx(1)
    assert len(token) == 1
