"""Toxicity scores: character n-grams scaled by naive Bayes log-count ratios in a linear classifier.

Features are the distinct character n-grams of the lower-cased text, hashed into
a fixed number of buckets.  Document counts per bucket and class come from all
labelled training rows.  Their smoothed log ratio scales each feature, and a
logistic regression is fitted on a bounded sample of labelled rows per class,
weighted back to the classes' true shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions.lineage import materialise
from cellframe.llm.common import rows_of

BUCKET_BITS = 18
ORDERS = (3, 4, 5)
PER_CLASS = 2000
PARTS = 8
THRESHOLD = 0.3


def features(text: str) -> np.ndarray:
    """Sorted distinct buckets of the text's character n-grams."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found, h = [], c * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[n - 1 :] * np.uint32(0xC2B2AE3D)
        if n in ORDERS:
            x = (h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)
            found.append((x >> np.uint32(32 - BUCKET_BITS)).astype(np.int32))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int32)


@dataclass
class Model:
    weights: np.ndarray  # one per bucket, the log-count ratio multiplied in
    bias: float

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-(self.weights[features(text)].sum(dtype=np.float64) + self.bias))))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learned from: those whose crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def log_count_ratios(labelled: DataFrame) -> np.ndarray:
    """Smoothed log ratio per bucket over all labelled rows (text, label); the result has a fixed size."""
    schema = pa.schema([("bucket", pa.int32()), ("pos", pa.int64()), ("neg", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_label, rows = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64), [0, 0]
        for cols in rows_of(batches):
            for text, label in zip(cols["text"], cols["label"], strict=True):
                by_label[label, features(text)] += 1
                rows[label] += 1
        used = np.flatnonzero(by_label.sum(axis=0))
        for at in range(0, len(used), 10_000):
            b = used[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(by_label[1, b]), pa.array(by_label[0, b])], schema=schema)
        yield pa.RecordBatch.from_pydict({"bucket": [-1], "pos": [rows[1]], "neg": [rows[0]]}, schema=schema)

    counts = labelled.mapInArrow(count, "bucket int, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    got = counts.toArrow()  # one row per bucket at most, 20 bytes each
    bucket, pos, neg = (got.column(c).to_numpy() for c in ("bucket", "pos", "neg"))
    total, real = bucket < 0, bucket >= 0
    n_pos, n_neg = int(pos[total].sum()), int(neg[total].sum())
    ratio = np.zeros(1 << BUCKET_BITS)
    ratio[bucket[real]] = np.log((pos[real] + 1) / (n_pos + 2)) - np.log((neg[real] + 1) / (n_neg + 2))
    return ratio


def gradient(sample: DataFrame, weights: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
    """Loss, gradient by bucket and gradient of the bias over rows (label, share, buckets), summed where the rows are.

    Each task returns one vector of fixed size, so what comes to the driver does
    not depend on how long the texts are.
    """
    schema = pa.schema([("loss", pa.float64()), ("error", pa.float64()), ("grad", pa.binary())])
    sent = sample.sparkSession.sparkContext.broadcast(weights)  # one number per bucket

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, grad, loss, error = sent.value, np.zeros(1 << BUCKET_BITS), 0.0, 0.0
        for cols in rows_of(batches, 100):
            for y, share, raw in zip(cols["label"], cols["share"], cols["buckets"], strict=True):
                r = np.frombuffer(raw, dtype="<i4")
                z = float(weights[r].sum()) + bias
                e = share * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
                grad[r] += e  # a row has each bucket once
                error += e
                loss += share * (np.logaddexp(0, z) - y * z)
        yield pa.RecordBatch.from_pydict({"loss": [loss], "error": [error], "grad": [grad.tobytes()]}, schema=schema)

    parts = sample.mapInArrow(sums, "loss double, error double, grad binary").toArrow()  # one row per task, of which there are PARTS at most
    sent.destroy()
    total = np.zeros(1 << BUCKET_BITS)
    for g in parts.column("grad"):
        total += np.frombuffer(g.as_buffer())
    return float(parts.column("loss").to_numpy().sum()), total, float(parts.column("error").to_numpy().sum())


def logistic(sample: DataFrame, scale: np.ndarray, prior: float, ridge: float = 1e-4, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge-penalised logistic regression on scaled 0/1 features, by L-BFGS; Spark sums each step.

    ``sample`` holds label, share (adding up to 1) and the buckets of each row.
    """

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, grad, error = gradient(sample, w[:-1] * scale, float(w[-1]))
        return value + ridge / 2 * float(w[:-1] @ w[:-1]), np.concatenate([grad * scale + ridge * w[:-1], [error]])

    w = np.zeros(len(scale) + 1)
    w[-1] = prior
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = -grad, []
        for s, g in reversed(past):
            a = (s @ d) / (s @ g)
            kept.append(a)
            d = d - a * g
        if past:
            d = d * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, g), a in zip(past, reversed(kept), strict=True):
            d = d + (a - (g @ d) / (s @ g)) * s
        size, slope = (1.0 if past else 1 / max(1.0, float(np.abs(grad).sum()))), float(grad @ d)
        for _ in range(20):
            new_value, new_grad = loss(w + size * d)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, g = size * d, new_grad - grad
        if s @ g > 1e-12:
            past = [*past[-9:], (s, g)]
        done = value - new_value < 1e-7
        w, value, grad = w + s, new_value, new_grad
        if done:
            break
    return w[:-1] * scale, float(w[-1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on the labelled rows (labels: doc_id, toxic) outside the held-out fold.

    ``per_class`` bounds the rows of each class that the regression is fitted on;
    they are those with the smallest hash of doc_id.  The ratios use all rows.  A
    doc_id labelled twice is toxic if one label says so; null labels, null
    doc_ids and labels without a document teach nothing.  With no label at all, every score is 0; with one class only,
    the prior decides.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    own = materialise(own)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ratio = log_count_ratios(text.join(own, "doc_id"))
    counts = {r.label: r["count"] for r in own.groupBy("label").count().collect()}
    if not counts:
        return Model(np.zeros(1 << BUCKET_BITS, dtype=np.float32), -30.0)
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = own.where("label = 0").orderBy(*by_hash).limit(per_class).unionByName(own.where("label = 1").orderBy(*by_hash).limit(per_class))
    schema = pa.schema([("label", pa.int32()), ("buckets", pa.binary())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in rows_of(batches):
            buckets = [(f := features(t))[ratio[f] != 0].astype("<i4").tobytes() for t in cols["text"]]
            yield pa.RecordBatch.from_pydict({"label": cols["label"], "buckets": buckets}, schema=schema)

    few = F.broadcast(some)  # 2 * per_class rows at most
    found = materialise(text.join(few, "doc_id").mapInArrow(extract, "label int, buckets binary"))
    rows_by = {r.label: r["count"] for r in found.groupBy("label").count().collect()}
    if not rows_by:
        return Model(np.zeros(1 << BUCKET_BITS, dtype=np.float32), -30.0)
    share = {label: counts[label] / min(per_class, counts[label]) for label in rows_by}
    total = sum(share[label] * n for label, n in rows_by.items())
    part = {label: share[label] * n / total for label, n in rows_by.items()}
    weight = F.when(F.col("label") == 1, F.lit(share.get(1, 0.0) / total)).otherwise(F.lit(share.get(0, 0.0) / total))
    sample = found.withColumn("share", weight).coalesce(PARTS)
    prior = float(np.log(max(part.get(1, 0.0), 1e-3) / max(part.get(0, 0.0), 1e-3)))
    weights, bias = logistic(sample, ratio, prior)
    return Model(weights.astype(np.float32), bias)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` with toxicity (0 to 1) and toxic (1 if at or over ``threshold``); only the text is looked at.

    A null text scores as an empty one.  Columns of these names are replaced,
    all others and repeated rows kept.
    """
    def run(s: pd.Series) -> pd.Series:
        return s.map(model.score).astype("float64")

    scored = docs.withColumn("toxicity", F.pandas_udf(run, "double")(F.coalesce(F.col(text), F.lit(""))))
    return scored.withColumn("toxic", (F.col("toxicity") >= threshold).cast("int"))
