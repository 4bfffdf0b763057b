"""Quality by regularised quadratic discriminant analysis.

Each document becomes a vector of transformed statistics of its whole text (``FEATURES``; square roots of
shares, logarithms of sizes, with a prior weight so that a few odd letters don't decide a short text).
Each class has a mean and a covariance, shrunk towards the pooled covariance and its diagonal. The score
is the difference of the log-densities, from Mahalanobis distances by Cholesky factors that are computed
once and sent to the tasks, put on a probability scale by a logistic fit of one variable.

The class sums cover every labelled row outside the held-out fold; Spark adds them up, so only sums reach
the driver. The vectors are computed in one pass over the texts and written; fitting and scoring read
them. A fifth of the learning rows only calibrate. Without rows of both classes every score is 0.5. Null
text counts as empty, which is an ordinary vector. Rows that repeat a doc_id are scored one by one. Equal
texts have equal scores. An empty table gives no rows. Texts of any length are read whole. Only doc_id and text
are read; ``accepted`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, free_names, steps, texts_of, written
from .labelled import labelled_rows, platt, sigmoid

FEATURES = (
    "upper", "digit", "symbol", "stop", "space", "other", "log_bytes", "log_words", "word_length", "log_line_words",
    "repeated_words", "repeated_pairs", "repeated_neighbours", "repeated_lines", "symbol_words",
)
MOD, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: At most so many labelled ids (8 bytes each) are broadcast to pick their texts out; more are joined by shuffling.
MAX_BROADCAST = 1_000_000
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.05


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 2, np.uint8)  # symbols
    kind[65:91] = 0
    kind[48:58] = 1
    kind[[ord(c) for c in ".,;:'\"()-?"]] = 3
    kind[[9, 10, 11, 12, 13, 32]] = 4
    kind[128:] = 5
    kind[97:123] = 6
    return kind


KIND = _byte_classes()
_SYMBOL_END = tuple(bytes([c]) for c in range(33, 127) if KIND[c] == 2)


def vectors(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = np.diff(off).astype(np.float64)
    kind = KIND[data]
    out = np.zeros((len(n), len(FEATURES)))
    for k in range(6):
        running = np.concatenate([[0], np.cumsum(kind == k)])
        out[:, k] = np.sqrt((running[off[1:]] - running[off[:-1]]) / (n + 60))
    for i, text in enumerate(texts_of(data, off)):
        words, lines = text.split(), [x for x in text.split(b"\n") if x]
        w = len(words)
        pairs = len(set(zip(words, words[1:])))
        ends = sum(x.endswith(_SYMBOL_END) for x in words)
        out[i, 7:] = (
            np.log1p(w),
            np.log((n[i] + 60) / (w + 10)),
            np.log((w + 10) / (len(lines) + 1)),
            np.sqrt((w - len(set(words))) / (w + 10)),
            np.sqrt(max(0, w - 1 - pairs) / (w + 10)),
            np.sqrt(sum(map(eq, words, words[1:])) / (w + 10)),
            np.sqrt((len(lines) - len(set(lines))) / (len(lines) + 3)),
            np.sqrt(ends / (w + 10)),
        )
    out[:, 6] = np.log1p(n)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, off in steps(batches, "text"):
        rows = vectors(data, off)
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.reshape(-1)))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], ["doc_id", "vector"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: the number of rows, the sum of the vectors and of their outer products."""
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = _matrix(batch.column("vector")), batch.column("label").to_numpy()
        for k in (0, 1):
            own = x[y == k]
            total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).reshape(-1)])
    label = np.repeat([0, 1], total.shape[1]).astype(np.int32)
    at = np.tile(np.arange(total.shape[1], dtype=np.int32), 2)
    yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(at), pa.array(total.reshape(-1))], ["label", "at", "value"])


class Discriminant:
    """Two Gaussians with shrunken covariances and their Cholesky factors."""

    def __init__(self, sums: np.ndarray):
        d = len(FEATURES)
        n = sums[:, 0]
        self.mean = sums[:, 1 : 1 + d] / n[:, None]
        scatter = [sums[k, 1 + d :].reshape(d, d) - n[k] * np.outer(self.mean[k], self.mean[k]) for k in (0, 1)]
        pooled = sum(scatter) / n.sum()
        self.factor, self.constant = [], []
        for k in (0, 1):
            own = (1 - SHRINK_POOLED) * scatter[k] / n[k] + SHRINK_POOLED * pooled
            spread = np.diag(pooled) + 1e-4
            own = (1 - SHRINK_DIAGONAL) * own + SHRINK_DIAGONAL * np.diag(spread) + 1e-6 * np.eye(d)
            lower = np.linalg.cholesky(own)
            self.factor.append(np.linalg.inv(lower))
            self.constant.append(-np.log(np.diag(lower)).sum())

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        z = (x - self.mean[k]) @ self.factor[k].T
        return self.constant[k] - 0.5 * (z * z).sum(1)

    def difference(self, x: np.ndarray) -> np.ndarray:
        return self.log_density(x, 1) - self.log_density(x, 0)

    def scale(self, x: np.ndarray) -> np.ndarray:
        """The difference on a signed log scale: far outliers differ by hundreds, which no logistic fit would follow."""
        raw = self.difference(x)
        return np.sign(raw) * np.log1p(np.abs(raw))


def fitted(seen: DataFrame, known: DataFrame) -> tuple[Discriminant | None, float, float]:
    """The model, and slope and intercept of its probabilities, from vectors (doc_id, vector) and labels (doc_id, label)."""
    calibrates = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    added = seen.join(known.where(~calibrates), "doc_id").select("vector", "label").mapInArrow(_sums, "label int, at int, value double")
    sums = np.zeros((2, 1 + len(FEATURES) + len(FEATURES) ** 2))
    for r in added.groupBy("label", "at").agg(F.sum("value").alias("value")).collect():
        sums[r["label"], r["at"]] = r["value"]
    if sums[:, 0].min() <= 0:
        return None, 0.0, 0.0
    model = Discriminant(sums)
    shared = seen.sparkSession.sparkContext.broadcast(model)
    rows = seen.join(known.where(calibrates), "doc_id").select("vector", "label").mapInArrow(_calibration(shared), "x double, label int")
    return model, *platt(rows)


def _calibration(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.value.scale(_matrix(batch.column("vector")))), batch.column("label")], ["x", "label"])

    return run


def _differences(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.value.scale(_matrix(batch.column("vector"))) if batch.num_rows and model.value is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x)], ["doc_id", "x"])

    return run


def _vectors_of(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(_features, "doc_id long, vector array<double>"), "quality-vectors")


def quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, log_density_difference (on a signed log scale), score, predicted."""
    seen = _vectors_of(docs)
    model, slope, intercept = fitted(seen, labelled_rows(labels, label, mod=MOD, held_out=HELD_OUT, most=1 << 62))
    scored = seen.mapInArrow(_differences(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, x double")
    score = sigmoid(F.lit(slope) * F.col("x") + F.lit(intercept))
    return scored.select(
        "doc_id", (fold("doc_id", MOD) == HELD_OUT).alias("held_out"), F.col("x").alias("log_density_difference"), score.alias("score"), (score >= threshold).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, *, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least the threshold, all columns untouched; all rows if nothing can be learned."""
    known = written(labelled_rows(labels, label, mod=MOD, held_out=HELD_OUT, most=1 << 62), "quality-labels")
    (name,) = free_names(docs.columns, "labelled_id")
    ids = known.select(F.col("doc_id").alias(name))
    learned = docs.join(F.broadcast(ids) if known.count() <= MAX_BROADCAST else ids, F.col("doc_id").cast("long") == F.col(name), "left_semi")
    model, slope, intercept = fitted(_vectors_of(learned), known)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((model, slope, intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, a, b = shared.value
        for part, data, off in steps(batches, "text"):
            score = 1 / (1 + np.exp(-(a * own.scale(vectors(data, off)) + b)))
            yield part.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
