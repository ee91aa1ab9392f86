"""Quality classifier: Gaussian-kernel ridge regression by random Fourier features, calibrated by isotonic regression.

``features`` turns a text into statistics of its characters, words and lines; nothing else of a row is used. Ridge
weights come from normal equations summed within partitions, then over a fixed number of partial sums; no row is
sampled. Calibration uses the fifth of the labelled rows that the weights never saw, counted in fixed bins of the raw
score. Both models are of fixed size, whatever the input.

Defined cases: a null or empty text has all statistics zero and a score like any other. A doc_id with several labels
takes the lowest. Rows with a null doc_id are never labelled. Without labelled rows, or with one class only, all scores
are the share of label 1 (0.5 without rows). Repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, slices, small_batches, written
from .kernel import shingles, words

_CLASS = np.full(256, 5, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 sentence marks, 5 other signs, 6 not ASCII, 7 line end
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:], _CLASS[10] = 0, 1, 2, 6, 7
_CLASS[[9, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = 4
NAMES = ["log_bytes", "upper", "digit", "space", "marks", "signs", "other", "line_ends", "log_words", "word_length", "long_words", "short_words", "distinct", "top_word", "repeats", "distinct_3"]


def features(arr: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    w = words(arr)
    rows = len(w.offsets) - 1
    out = np.zeros((rows, len(NAMES)))
    if not rows:
        return out
    raw, off = _raw(arr)
    size = np.diff(off)
    kinds = _CLASS[raw]
    some = size > 0
    at = off[:-1][some]
    for k, col in ((1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7)):
        if len(at):
            out[some, col] = np.add.reduceat((kinds == k).astype(np.int64), at) / size[some]
    out[:, 0] = np.log1p(size)
    b = w.bounds()
    n = np.diff(b)
    length = w.end - w.start
    out[:, 8] = np.log1p(n)
    has = n > 0
    first = b[:-1][has]
    if len(first):
        per = lambda x: np.add.reduceat(x.astype(np.float64), first) / n[has]
        out[has, 9], out[has, 10], out[has, 11] = per(length), per(length > 12), per(length <= 3)
        same = np.zeros(len(w.h), bool)
        same[1:] = (w.h[1:] == w.h[:-1]) & (w.doc[1:] == w.doc[:-1])
        out[has, 14] = per(same)
    doc3, h3 = shingles(w, 3)
    c = np.searchsorted(doc3, np.arange(rows + 1))
    for i in np.flatnonzero(has):
        counts = np.unique(w.h[b[i] : b[i + 1]], return_counts=True)[1]
        out[i, 12], out[i, 13] = len(counts) / n[i], counts.max() / n[i]
        if c[i + 1] > c[i]:
            out[i, 15] = len(np.unique(h3[c[i] : c[i + 1]])) / (c[i + 1] - c[i])
    return out


def _raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    from .kernel import buffers

    return buffers(arr)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, x (statistics), one row per document."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                x = features(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, x array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    size: int
    seed: int
    knots: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1), np.full(1, 0.5)))

    def z(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of a Gaussian kernel of width sqrt(number of statistics), and a constant."""
        g = np.random.default_rng(self.seed)
        w = g.normal(size=(x.shape[1], self.size)) / np.sqrt(x.shape[1])
        phase = g.uniform(0, 2 * np.pi, self.size)
        s = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / self.size) * np.cos(s @ w + phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.z(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, with a thousandth part of the raw score, which orders rows within a step."""
        r = self.raw(x)
        return 0.999 * np.interp(r, *self.knots) + 0.001 / (1 + np.exp(-np.clip(r, -30, 30)))


def _x(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)


def isotonic(at: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (positions, values) of the blocks' weighted centres."""
    blocks: list[list[float]] = []
    for x, k, y in zip(at, n, ones):
        blocks.append([x * k, k, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            for i, v in enumerate(blocks.pop()):
                blocks[-1][i] += v
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(table: DataFrame, labels: DataFrame, size: int = 384, ridge: float = 1e-3, bins: int = 2048, seed: int = 7, usable: Column | None = None) -> QualityModel:
    """table: feature_table's rows; labels: doc_id, quality. Learns from rows where usable holds (default: not held out)."""
    spark = table.sparkSession
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("y"))
    known = known.where(~held_out(F.col("doc_id")) if usable is None else usable)
    rows = written(table.join(known, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0), "quality-rows")
    m = table.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(len(NAMES)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([m[f"m{i}"] or 0.0 for i in range(len(NAMES))])
    scale = np.array([m[f"s{i}"] or 1.0 for i in range(len(NAMES))])
    model = QualityModel(mean, scale, np.zeros(size + 1), size, seed)

    def sums(batches):
        a, b, n = np.zeros((size + 1, size + 1)), np.zeros(size + 1), 0
        for batch in batches:
            z, y = model.z(_x(batch)), np.asarray(batch.column("y"))
            a += z.T @ z
            b += z.T @ y
            n += len(y)
        if n:
            yield pa.RecordBatch.from_pydict({"a": [a.tobytes()], "b": [b.tobytes()], "n": [n]})

    def merged(batches):
        a, b, n = np.zeros((size + 1) ** 2), np.zeros(size + 1), 0
        for batch in batches:
            for r in batch.to_pylist():
                a += np.frombuffer(r["a"])
                b += np.frombuffer(r["b"])
                n += r["n"]
        if n:
            yield pa.RecordBatch.from_pydict({"a": [a.tobytes()], "b": [b.tobytes()], "n": [n]})

    kind = "a binary, b binary, n long"
    parts = rows.where(~F.col("fold")).mapInArrow(released(sums), kind).repartition(8).mapInArrow(released(merged), kind).toLocalIterator()
    a, b, n = np.zeros((size + 1, size + 1)), np.zeros(size + 1), 0
    for r in parts:
        a += np.frombuffer(r.a).reshape(a.shape)
        b += np.frombuffer(r.b)
        n += r.n
    if n:
        a[np.diag_indices(size)] += ridge * n
        model.weights = np.linalg.solve(a + 1e-9 * np.eye(size + 1), b)

    def binned(batches):
        for batch in batches:
            k = np.clip((model.raw(_x(batch)) + 1) / 3 * bins, 0, bins - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), batch.column("y")], ["k", "y"])

    counts = rows.where("fold").mapInArrow(released(binned), "k int, y double").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).orderBy("k").collect()
    if counts:
        k = np.array([r.k for r in counts])
        model.knots = isotonic((k + 0.5) / bins * 3 - 1, np.array([r.n for r in counts], float), np.array([r.ones for r in counts]))
    elif n:
        model.knots = (np.zeros(1), np.full(1, b[-1] / n))
    return model


def score_table(table: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_x(b)))], ["doc_id", "score"])

    return table.mapInArrow(released(run), "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    table = written(feature_table(docs), "quality-features")
    return score_table(table, fit(table, labels, **options))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs, all columns, whose score is at least threshold. Texts are read twice and never shuffled."""
    model = fit(written(feature_table(docs), "quality-features"), labels, **options)

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                yield b.filter(pa.array(model.score(features(b.column("text"))) >= threshold))

    return docs.mapInArrow(released(run), docs.schema)
