"""Supervised subword embeddings: a quality classifier trained by numpy gradient descent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import MULT, chunks, mix, utf8

BITS, DIM, ORDERS, LAGS = 18, 16, (2, 3, 4), (1, 2, 3)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x5851F42D4C957F2D)  # odd, so it has an inverse modulo 2^64
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.cumprod(out, dtype=np.uint64)


def features(texts: list[bytes]):
    """``(owner, bucket)`` of every feature of the texts, whole and with case and marks: words, and byte n-grams of
    :data:`ORDERS` that touch a word's edge at most from outside, and repeats of a word :data:`LAGS` words later."""
    joined = b" " + b" ".join(texts) + b"     "
    raw = np.frombuffer(joined, np.uint8)
    n = len(raw)
    space = SPACE[raw]
    starts = np.cumsum([1] + [len(t) + 1 for t in texts])
    codes = mix((np.where(space, 32, raw).astype(np.uint64) + np.uint64(1)) * MULT)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * _powers(_STEP, n), out=total[1:])
    back = _powers(_BACK, n)
    owner = np.searchsorted(starts, np.arange(n), side="right") - 1
    owner = np.clip(owner, 0, len(texts) - 1).astype(np.int32)
    who, what = [], []
    for k in ORDERS:
        size = n - k + 1
        ok = np.ones(size, bool)
        for i in range(k):
            if 0 < i < k - 1:
                ok &= ~space[i : i + size]  # no gap inside
        ok &= ~(space[:size] & space[k - 1 :])
        at = np.flatnonzero(ok)
        h = (total[at + k] - total[at]) * back[at]
        what.append(mix(h + np.uint64(k)) >> np.uint64(64 - BITS))
        who.append(owner[np.minimum(at + 1, n - 1)])
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    h = (total[last] - total[first]) * back[first]
    what.append(mix(h + np.uint64(99)) >> np.uint64(64 - BITS))
    who.append(owner[first])
    for lag in LAGS:  # a word n-gram that says only that a word comes again after so many words
        again = np.flatnonzero((h[lag:] == h[:-lag]) & (owner[first[lag:]] == owner[first[:-lag]])) + lag
        what.append(np.full(len(again), mix(np.array([lag], np.uint64) * MULT)[0] >> np.uint64(64 - BITS), np.uint64))
        who.append(owner[first[again]])
    return np.concatenate(who), np.concatenate(what).astype(np.int64)


def fit(texts: list[bytes], labels: list[int], epochs: int = 6, rate: float = 0.5, seed: int = 7):
    """Learns bucket vectors and the softmax layer; returns ``(table, bias)``: what each bucket adds to the log odds of
    label 1. After averaging, the layer is linear in the bucket vectors, so one number a bucket is all that scoring needs."""
    if not texts or len(set(labels)) < 2:
        return np.zeros(1 << BITS, np.float32), 4.0 if not labels or labels[0] == 1 else -4.0
    rng = np.random.default_rng(seed)
    vectors = (rng.random((1 << BITS, DIM), np.float32) * 2 - 1) / DIM
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    # all documents' features in two arrays that grow: 8 bytes a different feature of a document
    ids, weights, ends = np.empty(1 << 20, np.int32), np.empty(1 << 20, np.float32), [0]
    for t in texts:
        _, b = features([t])
        own, n = np.unique(b, return_counts=True)
        a, z = ends[-1], ends[-1] + len(own)
        if z > len(ids):
            ids, weights = (np.concatenate([x[:a], np.empty(z, x.dtype)]) for x in (ids, weights))
        ids[a:z], weights[a:z] = own, n / max(1, n.sum())
        ends.append(z)
    y, steps, step = np.eye(2, dtype=np.float32)[labels], epochs * len(texts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            lr = rate * (1 - step / steps)
            at, w = ids[ends[i] : ends[i + 1]], weights[ends[i] : ends[i + 1]]
            hidden = w @ vectors[at]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            grad = p / p.sum() - y[i]
            back = layer @ grad
            layer -= lr * np.outer(hidden, grad)
            bias -= lr * 0.1 * grad
            # a mean over many features moves each one little: scaled by the document's spread
            vectors[at] -= (lr * 20) * w[:, None] * back[None, :]
            step += 1
    lean = layer[:, 1] - layer[:, 0]
    return (vectors @ lean).astype(np.float32), float(bias[1] - bias[0])


def score_texts(texts: list[bytes | None], table: np.ndarray, bias: float, block: int = 1 << 18) -> np.ndarray:
    out = np.zeros(len(texts))
    for a, b in chunks([len(t or b"") + 1 for t in texts], block):
        who, what = features([t or b"" for t in texts[a:b]])
        n = np.bincount(who, minlength=b - a)
        total = np.bincount(who, weights=table[what], minlength=b - a)
        out[a:b] = total / np.maximum(n, 1) + bias
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4000, sample_bytes: int = 24_000_000):
    """About ``sample`` labelled documents outside the held-out fifth, dealt by a hash of the id, in order of another hash, up
    to ``sample_bytes`` of text together. Both bounds are kept before any text leaves the executors, at any size of the
    corpus. Null ids and texts, and labels other than 0 and 1, are not learned from; of several labels of an id the larger counts."""
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy("doc_id").agg(F.max(label).alias("y"))
    n = ids.count()
    share = min(1.0, sample / max(n, 1))
    chosen = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")  # at most 2 * sample ids
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("size", F.octet_length("text"))
    # sizes first: at most 2 * sample rows of three numbers, or as many more as ids are repeated
    sizes = rows.groupBy("h").agg(F.max("size").alias("size")).orderBy("h").limit(2 * sample).collect()
    used, last = 0, None
    for r in sizes:
        used += r.size
        if used > sample_bytes:
            break
        last = r.h
    if last is None:
        return [], []
    got = rows.where(F.col("h") <= last).groupBy("h").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    got = sorted((r.h, r.text.encode("utf-8"), int(r.y)) for r in got.toLocalIterator())
    return [x[1] for x in got], [x[2] for x in got]


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, sample: int = 4000) -> DataFrame:
    """``docs`` rows' ``doc_id, text, score``: the model's probability of label 1, from the whole text alone.

    Trained on a bounded sample of labelled rows (see :func:`training_sample`). Null and empty texts have no feature and
    get the prior; null ids are scored like others and never learned from; repeated rows get one row each; without
    labels, or with one label only, every text scores alike. Other columns are not read.
    """
    texts, ys = training_sample(docs, labels, label, sample)
    table, bias = fit(texts, ys)

    def run(batches):
        for batch in batches:
            got = score_texts(utf8(batch.column("text")), table, bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*batch.schema.names, "score"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, score double")


def digest(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The contract's columns of :func:`classify`'s result; a null id is not held out."""
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, sample: int = 4000) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``; see :func:`classify`."""
    texts, ys = training_sample(docs, labels, label, sample)
    table, bias = fit(texts, ys)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score_texts(utf8(batch.column("text")), table, bias) >= threshold))

    return docs.mapInArrow(run, docs.schema)
