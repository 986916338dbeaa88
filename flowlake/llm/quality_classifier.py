"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Training takes at most max_rows labelled rows (those first by a hash of doc_id), and of these the first whose features
together are at most max_features, in one task bounded by both. Features are made before the rows are sorted, so no text goes there. Scoring is a sparse
dot product per document with a weight vector of fixed size (2**bits floats), map-only.

Tokens: runs of letters and digits, lower-cased in A-Z, or of one kind of mark; a token equal to the one before it becomes a
repeat mark. Features: hashed unigrams and bigrams, by square root of their count, in unit length, and a bias.
Null and empty texts have the bias only, so they get a score. Texts of any length count whole. Rows with a null id aren't
learned from; they are scored, held_out false. Repeated rows are scored alike; labels that contradict each
other all count; columns named as results are replaced; an empty table gives an empty result. Without labelled rows, scores
are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import buffer_of, fold, hash_runs, mix, slices, table

BITS, MAX_ROWS, MAX_FEATURES = 18, 20_000, 30_000_000
_KIND = np.zeros(256, np.uint8)  # 0 space, 1 letter or digit, from 2 on one kind a mark
_KIND[33:128] = np.arange(2, 97)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_a:_b] = 1


def features(texts: list[bytes | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the non-zero features of the texts."""
    data, ends = buffer_of(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    kind = _KIND[data]
    cut = np.flatnonzero(np.diff(np.concatenate(([255], kind)).astype(np.int16)) != 0)
    stop = np.append(cut[1:], len(data))
    full = kind[cut] > 0
    starts, stops = cut[full], stop[full]
    h = hash_runs(data, starts, stops)
    row = np.searchsorted(ends, starts, "right")
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    h = np.where(again, np.uint64(12345), h)
    pair = mix(h[1:] * np.uint64(3) + h[:-1]) [row[1:] == row[:-1]]
    shift = np.uint64(64 - bits)
    rows = np.concatenate((row, row[1:][row[1:] == row[:-1]]))
    code = (rows.astype(np.int64) << bits) | np.concatenate((h >> shift, pair >> shift)).astype(np.int64)
    code, count = np.unique(code, return_counts=True)
    rows, cols = code >> bits, code & ((1 << bits) - 1)
    value = np.sqrt(count)
    norm = np.sqrt(np.bincount(rows, value * value, len(texts)))
    return rows, cols, value / norm[rows]


def examples_of(texts: list[bytes | None], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Columns and values of each text, the bias last, in four bytes each."""
    rows, cols, values = features(texts, bits)
    at = np.searchsorted(rows, np.arange(len(texts) + 1))
    return [(np.append(cols[a:b], 1 << bits).astype(np.int32), np.append(values[a:b], 1.0).astype(np.float32)) for a, b in zip(at[:-1], at[1:], strict=True)]


def train_ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> np.ndarray:
    """Weights (the last one is the bias) after per-row FTRL-proximal updates in the given order."""
    n = (1 << bits) + 1
    z, sq = np.zeros(n), np.zeros(n)
    weigh = lambda zi, ni: np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
    for _ in range(epochs):
        for (c, v), y in zip(examples, labels, strict=True):
            w = weigh(z[c], sq[c])
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y) * v
            z[c] += g - (np.sqrt(sq[c] + g * g) - np.sqrt(sq[c])) / alpha * w
            sq[c] += g * g
    return weigh(z, sq).astype(np.float32)


def fit_quality(labelled: DataFrame, text: str = "text", label: str = "quality", bits: int = BITS, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> np.ndarray:
    """Weights from at most max_rows rows (doc_id, text, label) and max_features features, which one task holds; null labels don't count."""

    def describe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                made = examples_of(part.column(3).to_pylist(), bits)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array([m[k].tobytes() for m in made], pa.binary()) for k in (0, 1))], names=["o", "y", "tie", "cols", "vals"])

    def train(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows: list = []
        room = max_features
        for batch in batches:
            for o, y, tie, c, v in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                room -= len(c) // 4
                if room < 0 and rows:
                    break
                rows.append((np.frombuffer(c, np.int32), np.frombuffer(v, np.float32), y))
            if room < 0:
                break
        if rows:
            w = train_ftrl([r[:2] for r in rows], np.array([r[2] for r in rows], float), bits)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])

    picked = labelled.where(F.col(label).isNotNull()).select(F.xxhash64("doc_id").alias("o"), F.col(label).cast("int").alias("y"), F.xxhash64("doc_id", text).alias("tie"), F.col(text).cast("binary").alias("t"))
    made = picked.mapInArrow(describe, "o long, y int, tie long, cols binary, vals binary")
    found = made.orderBy("o", "tie", "y").limit(max_rows).coalesce(1).mapInArrow(train, "w binary").collect()
    return np.frombuffer(found[0]["w"], np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without text, with score (0..1) and predicted (score >= threshold)."""
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # of a fixed size
    names = [c for c in docs.columns if c not in ("score", "predicted", text)]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        w = shared.value.astype(np.float64)
        for batch in batches:
            for part in slices(batch):
                rows, cols, values = features(part.column(len(names)).to_pylist(), bits)
                margin = np.bincount(rows, values * w[cols], part.num_rows) + w[-1]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35))))], names=[*names, "score"])

    out = docs.select(*names, F.col(text).cast("binary").alias("__t")).mapInArrow(score, schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0).select("doc_id", "quality")
    # The sample is chosen by id before texts are joined, so only its texts move.
    ids = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(MAX_ROWS)
    weights = fit_quality(docs.join(F.broadcast(ids), "doc_id"))
    return score_quality(docs, weights).select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
SQL: dict[str, str] = {}
