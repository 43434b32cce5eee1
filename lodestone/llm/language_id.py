"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its hashed byte 3-, 4- and 5-grams (letters in lower case, everything else in
ASCII a single space), classified by a linear softmax.  Embeddings and softmax are trained together by stochastic
gradient descent in numpy on segments of a bounded, stratified sample; the whole texts of documents held back from it fit
the temperature of the scores and the score below which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import words as W
from lodestone.llm.common import crc_mod4, in_bytes, lean, utf8

BUCKET_BITS, WIDTH = 17, 12
#: Documents sampled per language, segments of each, the share held back to calibrate on (one in ``HOLD``), and languages
#: learned, the most frequent first.
PER_LANGUAGE, SEGMENTS, HOLD, LANGUAGES_MAX = 600, 4, 5, 256
#: Passes over the sample, raised for small samples to reach ``STEPS`` updates.
EPOCHS, STEPS, BATCH, RATE = 4, 2500, 16, 16.0
TARGET_PRECISION = 0.995
UNKNOWN = "und"
CHUNK = 1 << 20
_SALT = {3: 0x9E3779B1, 4: 0x85EBCA77, 5: 0xC2B2AE3D}
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[128:] = np.arange(128, 256)
for _c in range(97, 123):
    _PLAIN[_c] = _PLAIN[_c - 32] = _c


@dataclass
class Model:
    """Bucket scores per language (embeddings times softmax weights), bias, temperature and rejection level."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the texts, and where each text's begin (one more at the end)."""
    buf, at = W.joined(texts)
    plain = _PLAIN[buf]
    space = plain == 32
    keep = np.ones(len(plain), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[at[:-1]] = True  # every text has a subword
    ends = np.cumsum(keep)[at[1:] - 1]
    x = np.concatenate((plain[keep], np.full(4, 32, np.uint8))).astype(np.uint64)
    n = len(x) - 4
    g3 = x[:n] | x[1 : n + 1] << np.uint64(8) | x[2 : n + 2] << np.uint64(16)
    g4 = g3 | x[3 : n + 3] << np.uint64(24)
    g5 = g4 | x[4 : n + 4] << np.uint64(32)
    shift = np.uint64(64 - BUCKET_BITS)
    odd = np.uint64(0x9E3779B97F4A7C15)
    out = np.empty((n, 3), np.int32)
    for k, g in enumerate((g3, g4, g5)):
        out[:, k] = ((g + np.uint64(_SALT[k + 3])) * odd) >> shift
    return out.ravel(), 3 * np.concatenate(([0], ends))


def has_letter(text: bytes) -> bool:
    """Whether a text has a letter of any script."""
    plain = _PLAIN[np.frombuffer(text, np.uint8)]
    if ((plain != 32) & (plain < 128)).any():
        return True
    return (plain >= 128).any() and any(map(str.isalpha, text.decode("utf-8", "replace")))


def segments(text: bytes, seed: int, n: int = SEGMENTS) -> list[bytes]:
    """``n`` stretches of 20 to 600 bytes from anywhere in a text, cut at white space where there is any."""
    if not text:
        return []
    rng = np.random.Generator(np.random.PCG64(seed & 0xFFFFFFFF))
    out = []
    for _ in range(n):
        size = int(20 * 30 ** rng.random())
        at = int(rng.integers(0, max(1, len(text) - size)))
        part = text[at : at + size]
        out.append(part.split(b" ", 1)[-1] if at and b" " in part[:-1] else part)
    return [x for x in out if x.strip()]


def train(samples: list[bytes], labels: list[str], seed: int = 11) -> Model:
    """Fit embeddings and softmax by SGD on labelled segments."""
    languages = sorted(set(labels))
    if not samples:
        return Model([UNKNOWN], np.zeros((1 << BUCKET_BITS, 1), np.float32), np.zeros(1))
    y = np.searchsorted(languages, labels)
    rng = np.random.Generator(np.random.PCG64(seed))
    fit = rng.permutation(len(samples))
    idx, at = grams(samples)
    emb = (rng.random((1 << BUCKET_BITS, WIDTH)).astype(np.float32) - 0.5) / WIDTH
    soft = np.zeros((WIDTH, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    a_pass = -(-len(fit) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // a_pass))
    steps, total = 0, epochs * a_pass
    for _ in range(epochs):
        for i in range(0, len(fit), BATCH):
            rows = fit[i : i + BATCH]
            size = at[rows + 1] - at[rows]
            flat = np.concatenate([idx[at[r] : at[r + 1]] for r in rows])
            _, by_emb, by_soft, by_bias = gradients(emb, soft, bias, flat, size, y[rows])
            rate = RATE * (1 - steps / total)
            soft -= rate * by_soft
            bias -= 0.1 * rate * by_bias
            np.subtract.at(emb, flat, (rate * by_emb).astype(np.float32))
            steps += 1
        fit = rng.permutation(fit)
    return Model(languages, (emb @ soft).astype(np.float32), bias.astype(np.float64))


def gradients(emb: np.ndarray, soft: np.ndarray, bias: np.ndarray, flat: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean loss of a batch and its gradients by the used buckets' embeddings (in the order of ``flat``), softmax and bias."""
    n = len(size)
    h = np.add.reduceat(emb[flat], np.cumsum(size) - size) / size[:, None]
    z = h @ soft + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss = float(-np.log(p[np.arange(n), y]).mean())
    p[np.arange(n), y] -= 1
    return loss, np.repeat((p @ soft.T) / (n * size[:, None]), size, 0), h.T @ p / n, p.sum(0) / n


def calibrate(model: Model, z: np.ndarray, y: np.ndarray) -> None:
    """Fit temperature and rejection level to the logits of documents that the model has not seen."""
    if not len(z):
        return
    top = z.max(1, keepdims=True)
    grid = np.geomspace(0.02, 4, 60)
    loss = [-((z[np.arange(len(z)), y] - top[:, 0]) / t - np.log(np.exp((z - top) / t).sum(1))).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = probabilities(model, z)
    best, right = p.max(1), p.argmax(1) == y
    by = np.argsort(-best, kind="stable")
    precision = np.cumsum(right[by]) / np.arange(1, len(by) + 1)
    good = np.flatnonzero(precision >= TARGET_PRECISION)
    model.reject_below = float(best[by[good[-1]]]) if len(good) else 1.0


def logits(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean bucket scores plus bias of each text."""
    idx, at = grams(texts)
    total = np.add.reduceat(model.table[idx], at[:-1], dtype=np.float64) if len(texts) else np.empty((0, len(model.languages)))
    return total / np.diff(at)[:, None] + model.bias


def probabilities(model: Model, z: np.ndarray) -> np.ndarray:
    """Calibrated class probabilities."""
    p = np.exp((z - z.max(1, keepdims=True)) / model.temperature) if len(z) else z
    return p / p.sum(1, keepdims=True)


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(seed, lang, s) for seed, lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))) for s in segments(t, seed) if has_letter(s)]
        columns = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.binary()))], names=["seed", "lang", "part"])


def fit_language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Train on rows with a language whose crc32(id) modulo 4 is not 2; at most about ``per_language`` rows each.

    The sample is a hash sample, so it does not depend on partitioning.  Of one document in ``HOLD`` only the logits of the
    whole text come to the driver, to calibrate on; of the others segments of some hundred bytes.  Languages beyond the
    ``LANGUAGES_MAX`` most frequent are not learned, which bounds the model where labels are dirty.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    src = src.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod4("id") != 2))
    counts = {r["lang"]: r["count"] for r in src.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES_MAX).collect()}
    if not counts:
        return train([], [])
    seed = F.xxhash64(F.col("id").cast("string"), F.lit("language"))
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in counts.items()], F.lit(0.0))
    chosen = src.withColumn("seed", seed).filter(F.pmod("seed", F.lit(1 << 20)) < rate * (1 << 20)).select("seed", "lang", "text")
    held = F.pmod(F.shiftright("seed", 20), F.lit(HOLD)) == 0
    rows = sorted(chosen.filter(~held).mapInArrow(lean(_segmented), "seed long, lang string, part binary").collect())
    model = train([bytes(r["part"]) for r in rows], [r["lang"] for r in rows])
    known = chosen.filter(held & F.col("lang").isin(model.languages))
    tests = sorted(known.mapInArrow(lean(_scored(model)), "lang string, z array<double>").collect())
    z = np.array([r["z"] for r in tests]).reshape(len(tests), len(model.languages))
    calibrate(model, z, np.searchsorted(model.languages, [r["lang"] for r in tests]))
    return model


def _scored(model: Model):
    """Rows (seed, lang, text) to (lang, z): the logits of whole texts that have a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, zs = [], []
            for first, texts in in_bytes(utf8(b.column(2)), CHUNK):
                keep = [i for i, t in enumerate(texts) if has_letter(t)]
                langs += [b.column(1)[first + i].as_py() for i in keep]
                zs += list(logits(model, [texts[i] for i in keep]))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(zs, pa.list_(pa.float64()))], names=["lang", "z"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted) of every row, over its whole text.

    ``lang_pred`` is a learned language, or ``und`` with score 0 where the text is NULL or has no letter;
    ``accepted`` is false where the calibrated score lies below the rejection level.  Rows are scored one by one, so NULL
    and repeated ids are as good as others; other columns are not read; an empty table gives none.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            names, scores = [], []
            for _, texts in in_bytes(utf8(b.column(1)), CHUNK):
                p = probabilities(m, logits(m, texts))
                for t, top, score in zip(texts, p.argmax(1), p.max(1)):
                    known = has_letter(t)
                    names.append(m.languages[top] if known else UNKNOWN)
                    scores.append(float(score) if known else 0.0)
            yes = [n != UNKNOWN and s >= m.reject_below for n, s in zip(names, scores)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(yes, pa.bool_())], names=["id", "lang_pred", "score", "accepted"])

    return src.mapInArrow(lean(run), f"id {kind}, lang_pred string, score double, accepted boolean")
