"""Toxic spans by a linear-chain conditional random field.

Tokens of a sentence form a chain with two states.  The labels known are those of documents, so tokens are labelled
first: a word or prefix that occurs in labelled toxic documents and hardly ever in others marks its tokens there.
The field is trained on those chains in numpy; forward-backward gives each token's marginal, and a document's score
comes from its marginals through a logistic curve calibrated on documents the field was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import words as W
from lodestone.llm.common import crc_mod4, drop_staged, in_bytes, lean, stage, utf8

#: Documents sampled with label 1 and 0, cue features kept, chains taken from a document.
TOXIC_MAX, CLEAN_MAX, CUES_MAX, CHAINS = 3000, 6000, 20_000, 12
MIN_TOXIC, MIN_PRECISION = 3, 0.9
BUCKET_BITS = 18
PREFIXES = (3, 4, 5, 6)
N_FEATURES = len(PREFIXES) + 3
CHAIN_MAX = 64
EPOCHS, BATCH, RATE, DECAY = 5, 256, 0.5, 1e-5
THRESHOLD = 0.3
SPAN = 0.3
CHUNK = 1 << 19
_TOKEN = np.zeros(256, bool)
_TOKEN[128:] = True
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


@dataclass
class Tokens:
    """Tokens of several texts: spans in ``buf``, owning text, chain starts and lengths, feature hashes."""

    buf: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    size: np.ndarray
    hashes: np.ndarray = field(repr=False)


def tokenize(texts: list[bytes]) -> Tokens:
    """Letter and digit runs; a chain ends with its sentence, its text, or after ``CHAIN_MAX`` tokens.

    Feature hashes of a token: its word and prefixes, each salted, then the words before and after it.
    """
    buf, at = W.joined(texts)
    edge = np.zeros(len(buf) + 2, np.int8)
    edge[1:-1] = _TOKEN[buf]
    cut = np.flatnonzero(edge[1:] != edge[:-1])
    start, end = cut[::2], cut[1::2]
    n = len(start)
    doc = np.searchsorted(at, start, "right") - 1
    stops = np.concatenate(([0], np.cumsum(_STOP[buf])))
    new = np.ones(n, bool)
    new[1:] = (stops[start[1:]] > stops[end[:-1]]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    nth = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
    first = np.flatnonzero(nth % CHAIN_MAX == 0)
    low = _LOWER[buf]
    word = W.hashes(low, start, end)
    cols = [word] + [W.hashes(low, start, np.minimum(start + k, end)) + np.uint64(k) for k in PREFIXES]
    before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[first] = 1
    after[np.append(first[1:], n)[: len(first)] - 1] = 2
    cols += [before * np.uint64(0xD6E8FEB86659FD93), after * np.uint64(0xA0761D6478BD642F)]
    hashes = np.stack(cols) if n else np.empty((N_FEATURES, 0), np.uint64)
    return Tokens(buf, at, start, end, doc, first, np.diff(np.append(first, n)), hashes)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


@dataclass
class Field:
    """Weights of the field and of the score curve."""

    unary: np.ndarray
    bias: float
    pair: np.ndarray
    curve: np.ndarray


def marginals(u: np.ndarray, first: np.ndarray, size: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of state 1 at each token, and the expected transitions (2 x 2), by forward-backward.

    Chains advance together, longest first; ``u`` is the log potential of state 1 against state 0.
    """
    order = np.argsort(-size, kind="stable")
    at, left = first[order], -size[order]
    e = np.exp(np.clip(u, -30, 30))
    m = np.exp(pair)
    a = np.empty((len(u), 2))
    top = int(size.max(initial=0))
    for t in range(top):
        i = at[: np.searchsorted(left, -t, "left")] + t
        prev = a[i - 1] @ m if t else np.ones((len(i), 2))
        prev[:, 1] *= e[i]
        a[i] = prev / prev.sum(1, keepdims=True)
    b = np.ones((len(u), 2))
    expected = np.zeros((2, 2))
    for t in range(top - 1, 0, -1):
        i = at[: np.searchsorted(left, -t, "left")] + t
        ahead = b[i].copy()
        ahead[:, 1] *= e[i]
        both = a[i - 1][:, :, None] * m[None] * ahead[:, None, :]
        z = both.sum((1, 2))
        expected += (both / z[:, None, None]).sum(0)
        back = ahead @ m.T
        b[i - 1] = back / back.sum(1, keepdims=True)
    p = a * b
    return p[:, 1] / p.sum(1) if len(u) else np.empty(0), expected


def train_field(features: list[np.ndarray], labels: list[np.ndarray], seed: int = 5) -> Field:
    """Fit unary and transition weights by Adagrad on the log-likelihood of labelled chains."""
    out = Field(np.zeros(1 << BUCKET_BITS), -3.0, np.zeros((2, 2)), np.array([-4.0, 1.0, 1.0]))
    if not features:
        return out
    rng = np.random.Generator(np.random.PCG64(seed))
    square, square_pair, square_bias = np.full(1 << BUCKET_BITS, 1e-3), np.full((2, 2), 1.0), 1.0
    order = np.arange(len(features))
    for _ in range(EPOCHS):
        order = rng.permutation(order)
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            size = np.array([features[r].shape[1] for r in rows])
            x = np.concatenate([features[r] for r in rows], 1)
            y = np.concatenate([labels[r] for r in rows])
            first = np.cumsum(size) - size
            p, expected = marginals(out.unary[x].sum(0) + out.bias, first, size, out.pair)
            inner = np.ones(len(y), bool)
            inner[first] = False
            j = np.flatnonzero(inner)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[j - 1].astype(int), y[j].astype(int)), 1)
            up = y - p
            used, where = np.unique(x, return_inverse=True)
            g = np.bincount(where.ravel(), np.broadcast_to(up, x.shape).ravel()) - DECAY * out.unary[used]
            square[used] += g * g
            out.unary[used] += RATE * g / np.sqrt(square[used])
            g = seen - expected
            square_pair += g * g
            out.pair += RATE * g / np.sqrt(square_pair)
            square_bias += up.sum() ** 2
            out.bias += RATE * up.sum() / np.sqrt(square_bias)
    out.unary = out.unary.astype(np.float32)
    return out


def evidence(model: Field, texts: list[bytes]) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """Tokens, their marginals, and per text (log of the expected toxic tokens, log odds of the strongest token)."""
    t = tokenize(texts)
    u = np.full(len(t.start), model.bias)
    for h in t.hashes:
        u += model.unary[buckets(h)]
    p, _ = marginals(u, t.first, t.size, model.pair)
    total = np.bincount(t.doc, np.where(p > 0.05, p, 0), len(texts))
    most = np.full(len(texts), 1e-6)
    np.maximum.at(most, t.doc, p)
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return t, p, np.stack((np.log1p(total), np.log(most / (1 - most)) / 4))


def score(model: Field, x: np.ndarray) -> np.ndarray:
    """Document scores from their evidence."""
    return 1 / (1 + np.exp(-np.clip(model.curve[0] + model.curve[1:] @ x, -30, 30)))


def calibrate(model: Field, x: np.ndarray, y: np.ndarray) -> None:
    """Fit the logistic score curve by Newton steps with a small ridge."""
    full = np.concatenate((np.ones((1, x.shape[1])), x))
    w = np.zeros(len(full))
    ridge = np.diag([1e-6, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ full, -30, 30)))
        step = np.linalg.solve((full * (p * (1 - p))) @ full.T + ridge + 1e-9 * np.eye(len(w)), full @ (y - p) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    model.curve = w


def _document_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, text) to (feature, toxic documents, clean documents), summed per batch."""
    for b in batches:
        toxic = np.array(b.column(0).to_pylist(), np.int64)
        keys, counts = [], []
        for first, texts in in_bytes(utf8(b.column(1)), CHUNK):
            t = tokenize(texts)
            own = t.hashes[: len(PREFIXES) + 1]
            pairs = np.unique(np.stack((own.ravel(), np.tile(t.doc, len(own)).astype(np.uint64))), axis=1) if len(t.doc) else np.empty((2, 0), np.uint64)
            keys.append(pairs[0])
            counts.append(toxic[pairs[1].astype(np.int64) + first])
        flat, is_toxic = np.concatenate(keys or [np.empty(0, np.uint64)]), np.concatenate(counts or [np.empty(0, np.int64)])
        used, where = np.unique(flat, return_inverse=True)
        n_toxic = np.bincount(where, is_toxic, len(used)).astype(np.int64)
        n_all = np.bincount(where, minlength=len(used))
        yield pa.RecordBatch.from_arrays([pa.array(used.view(np.int64)), pa.array(n_toxic), pa.array(n_all - n_toxic)], names=["feature", "toxic", "clean"])


def _chains(cues: np.ndarray):
    """Rows (seed, toxic, text) to labelled chains (seed, n, features, labels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for seed, toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))):
                t = tokenize([text])
                label = np.zeros(len(t.start), bool)
                if toxic:
                    for h in t.hashes[: len(PREFIXES) + 1]:
                        label |= np.isin(h, cues)
                rng = np.random.Generator(np.random.PCG64(seed & 0xFFFFFFFF))
                chain = np.repeat(np.arange(len(t.first)), t.size)
                marked = np.unique(chain[label])
                plain = np.setdiff1d(np.arange(len(t.first)), marked)
                chosen = np.concatenate((rng.permutation(marked)[:CHAINS], rng.permutation(plain)[: CHAINS // 3]))
                for c in chosen.tolist():
                    own = slice(int(t.first[c]), int(t.first[c] + t.size[c]))
                    out.append((seed, int(t.size[c]), buckets(t.hashes[:, own]).ravel(), label[own].astype(np.int8)))
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int8())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["seed", "n", "x", "y"])

    return run


def _unexplained(strong: np.ndarray, weak: np.ndarray):
    """Rows (seed, text) of toxic documents without a strong cue to (seed, their weak cues)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seeds, found = [], []
            for seed, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                own = np.unique(tokenize([text]).hashes[: len(PREFIXES) + 1])
                if not np.isin(own, strong).any():
                    seeds.append(seed)
                    found.append(own[np.isin(own, weak)].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["seed", "cues"])

    return run


def find_cues(spark: SparkSession, fit: DataFrame) -> np.ndarray:
    """Feature hashes that mark tokens of toxic documents.

    A cue is strong if that many toxic documents and so few others hold it that chance among all features does not
    explain it.  Documents without a strong cue take the weak ones that cover most of them, one after another.
    """
    table = fit.select("toxic", "text").mapInArrow(lean(_document_features), "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).filter("t + c >= 3")
    table = stage(spark, table, "toxicity-features")
    n = {r["toxic"]: r["count"] for r in fit.groupBy("toxic").count().collect()}
    base = max(1, n.get(1, 0)) / max(2, sum(n.values()))
    least = max(MIN_TOXIC, int(np.ceil((np.log(max(2, table.count())) + 2) / -np.log(min(0.6, base)))))
    good = table.filter((F.col("t") >= MIN_TOXIC) & (F.col("t") >= MIN_PRECISION * (F.col("t") + F.col("c"))))
    rows = good.orderBy(F.desc("t"), "feature").limit(CUES_MAX).collect()
    cues = np.array([r["feature"] for r in rows], np.int64).view(np.uint64)
    strong = np.array([r["t"] >= least for r in rows], bool)
    left = fit.filter("toxic = 1").select("seed", "text").mapInArrow(lean(_unexplained(cues[strong], cues[~strong])), "seed long, cues array<long>").collect()
    drop_staged(spark, table)
    docs = [set(r["cues"]) for r in sorted(left)]
    chosen = []
    while docs:
        counts: dict[int, int] = {}
        for d in docs:
            for c in d:
                counts[c] = counts.get(c, 0) + 1
        best = max(counts.items(), key=lambda x: (x[1], -x[0]), default=(0, 0))
        if best[1] < MIN_TOXIC:
            break
        chosen.append(best[0])
        docs = [d for d in docs if best[0] not in d]
    return np.concatenate((cues[strong], np.array(chosen, np.int64).view(np.uint64)))


def fit_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_max: int = TOXIC_MAX, clean_max: int = CLEAN_MAX) -> Field:
    """Learn from labelled rows whose crc32(id) modulo 4 is not 2, about ``toxic_max`` and ``clean_max`` of them.

    The bounded hash sample is staged; what comes to the driver is the list of cues, chains of at most ``CHAIN_MAX``
    tokens, and two numbers per calibration document.
    """
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
    marks = marks.filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & (crc_mod4("id") != 2)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    rate = F.when(F.col("toxic") == 1, min(1.0, toxic_max / max(1, counts.get(1, 0)))).otherwise(min(1.0, clean_max / max(1, counts.get(0, 0))))
    chosen = marks.withColumn("seed", F.xxhash64(F.col("id").cast("string"), F.lit("toxicity"))).filter(F.pmod("seed", F.lit(1 << 20)) < rate * (1 << 20))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    sample = stage(spark, src.join(F.broadcast(chosen), "id").select("seed", "toxic", "text"), "toxicity-sample")
    fit, hold = sample.filter("pmod(shiftright(seed, 20), 4) <> 0"), sample.filter("pmod(shiftright(seed, 20), 4) = 0")
    cues = find_cues(spark, fit)
    chains = sorted(fit.mapInArrow(lean(_chains(cues)), "seed long, n int, x array<int>, y array<tinyint>").collect())
    model = train_field([np.array(r["x"], np.int32).reshape(N_FEATURES, r["n"]) for r in chains], [np.array(r["y"], np.float64) for r in chains])
    held = sorted(score_documents(hold.withColumnRenamed("seed", "id"), model, "id", "text", ("toxic",)).select("id", "total", "most", "toxic").collect())
    if len({r["toxic"] for r in held}) == 2:
        calibrate(model, np.array([[r["total"] for r in held], [r["most"] for r in held]]), np.array([r["toxic"] for r in held], float))
    drop_staged(spark, sample)
    return model


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def score_documents(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep .., score, total, most, spans) of every row, over its whole text.

    ``spans`` are the code-point offsets of tokens whose marginal reaches ``SPAN``.  NULL and empty texts have no
    token and get the curve's lowest score; rows are scored one by one, so NULL and repeated ids are as good as others;
    other columns are not read; ``keep`` passes some through under any name, but those named like a result give way to it;
    an empty table gives none.
    """
    keep = tuple(c for c in keep if c.lower() not in ("id", "score", "total", "most", "spans"))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n_keys = 1 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            xs, spans = [np.empty((2, 0))], []
            for _, texts in in_bytes(utf8(b.column(n_keys)), CHUNK):
                t, p, x = evidence(m, texts)
                xs.append(x)
                own: list[list] = [[] for _ in texts]
                if len(hit := np.flatnonzero(p >= SPAN)):
                    lead = np.concatenate(([0], np.cumsum((t.buf & 0xC0) != 0x80)))  # characters before each byte
                    base = lead[t.at[t.doc[hit]]]
                    for d, lo, hi, q in zip(t.doc[hit].tolist(), (lead[t.start[hit]] - base).tolist(), (lead[t.end[hit]] - base).tolist(), p[hit].tolist()):
                        own[d].append({"start": lo, "end": hi, "p": q})
                spans += own
            x = np.concatenate(xs, 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keys], pa.array(score(m, x)), pa.array(x[0]), pa.array(x[1]), pa.array(spans, _SPANS)], names=[*b.schema.names[:n_keys], "score", "total", "most", "spans"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:n_keys])
    out = src.mapInArrow(lean(run), f"{fields}, score double, total double, most double, spans array<struct<start:int,end:int,p:double>>")
    return out.select("id", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score", "total", "most", "spans")
