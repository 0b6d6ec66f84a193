"""Quality classifier: naive Bayes support vectors over byte n-grams.

A text is the set of its byte bigrams and trigrams (hashed to fixed tables).
Each indicator is scaled by the log ratio of its smoothed class counts, rows are
brought to unit length, and a linear model with hinge loss is fitted to them by
dual coordinate descent.  A logistic curve, fitted to the margins of rows left
out of the fit, turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .scratch import Scratch

BITS = 16
WIDTH = 1 << BITS
#: Features: bigrams exactly, then hashed trigrams.
FEATURES = 2 * WIDTH
_DOCS = 64


def indicators(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, feature) of every feature a document has, once each, by stretches of documents."""
    codes = buf.astype(np.int64)
    slot = np.zeros(_DOCS * WIDTH, np.int64)
    for first in range(0, len(offs) - 1, _DOCS):
        stop = min(first + _DOCS, len(offs) - 1)
        at = slice(offs[first], offs[stop])
        part = codes[at]
        size = np.diff(offs[first : stop + 1])
        doc = np.repeat(np.arange(stop - first), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(part))  # bytes to the document's end
        for k, gram in ((2, part[:-1] << 8 | part[1:]), (3, ((part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * 0x9E3779B1 >> 13) & (WIDTH - 1))):
            ok = np.flatnonzero(left[: len(gram)] >= k)
            key = doc[ok] * WIDTH + gram[ok]
            slot[key] = np.arange(len(key))  # the last of equal keys stays
            once = slot[key] == np.arange(len(key))
            yield doc[ok][once] + first, gram[ok][once] + (k - 2) * WIDTH


class NbSvm:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def scores(self, block: kernel.Block) -> np.ndarray:
        total, count = np.zeros(block.n), np.zeros(block.n)
        for doc, feature in indicators(block.buf, block.offs):
            total += np.bincount(doc, self.weights[feature, 0], block.n)
            count += np.bincount(doc, self.weights[feature, 1], block.n)
        margin = total / np.sqrt(np.maximum(count, 1e-12)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def fit_nb_svm(rows: list[np.ndarray], labels: np.ndarray, *, alpha: float = 1.0, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> NbSvm:
    """rows are feature ids; labels are 0 or 1.  With a single class the score is that class throughout."""
    positive = labels == 1
    if positive.all() or not positive.any():
        constant = 0.0 if not len(labels) else (20.0 if positive.all() else -20.0)
        return NbSvm(np.zeros((FEATURES, 2)), 0.0, 0.0, constant)
    counts = [np.full(FEATURES, alpha), np.full(FEATURES, alpha)]
    for row, y in zip(rows, positive.tolist(), strict=True):
        counts[y][row] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    left_out = order[: len(rows) // 5] if len(rows) >= 50 else order[:0]
    fitted = order[len(left_out) :]
    weight, bias = np.zeros(FEATURES), 0.0
    sign = np.where(positive, 1.0, -1.0)
    share = np.where(positive, 0.5 / positive.mean(), 0.5 / (1 - positive.mean())) * cost  # both classes weigh alike
    norm = np.array([max(np.sqrt((ratio[r] ** 2).sum()), 1e-6) for r in rows])
    dual = np.zeros(len(rows))
    for _ in range(epochs):
        for i in rng.permutation(fitted).tolist():
            r = rows[i]
            margin = (weight[r] @ ratio[r]) / norm[i] + bias
            gradient = sign[i] * margin - 1
            new = min(max(dual[i] - gradient / 2.0, 0.0), share[i])  # a row and its bias have squared length 2
            step = (new - dual[i]) * sign[i]
            if step:
                weight[r] += step * ratio[r] / norm[i]
                bias += step
                dual[i] = new
    check = left_out if len(left_out) and 0 < positive[left_out].sum() < len(left_out) else fitted
    margins = np.array([(weight[rows[i]] @ ratio[rows[i]]) / norm[i] + bias for i in check.tolist()])
    slope, shift = _logistic(margins, positive[check])
    return NbSvm(np.stack([weight * ratio, ratio**2], 1), bias, slope, shift)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's curve with smoothed targets, by Newton steps."""
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2)
    target = np.where(y, high, low)
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        g = np.array([((p - target) * x).sum(), (p - target).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * x * x).sum() + 1e-6, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -5, 5)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def train_quality_model(docs: DataFrame, labels: DataFrame, learn, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 6000, max_bytes: int = 64 << 20) -> NbSvm:
    """The model of a bounded sample of labelled rows where ``learn`` (a condition on the label's id) holds.

    The labelled documents with the smallest hash of id are used, whole: max_rows
    ids, as far as max_bytes goes for their features (4 bytes each, at most
    512 KB a text), one of them at least.  Ids with several labels count if these
    agree; labels other than 0 and 1, and nulls, teach nothing; repeated rows
    teach once.  A null text is an empty one.  Without any labelled row every
    score is 0.5.
    """
    spark = docs.sparkSession
    marks = labels.where(learn).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    marks = marks.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    marks = marks.select(F.xxhash64("id").alias("h"), "id", "y").orderBy("h", "id").limit(max_rows).toPandas()
    if marks.empty:
        return fit_nb_svm([], np.zeros(0, np.int64))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in kernel.blocks(batch.column(3)):
                got = [*indicators(block.buf, block.offs)]
                doc = np.concatenate([d for d, _ in got])
                feature = np.concatenate([f for _, f in got])[np.argsort(doc, kind="stable")].astype(np.int32)
                cut = np.searchsorted(np.sort(doc), np.arange(block.n + 1))
                rows = [feature[cut[i] : cut[i + 1]].tobytes() for i in range(block.n)]
                part = batch.slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(rows, pa.binary())], ["h", "id", "y", "features"])

    chosen = F.broadcast(spark.createDataFrame(marks))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")
    rows = rows.select("h", F.col("id").cast("string").alias("id"), F.col("y").cast("int").alias("y"), F.coalesce("text", F.lit("")).alias("text"))
    got = Scratch(spark).table(rows.mapInArrow(features, "h long, id string, y int, features binary").dropDuplicates())
    # The sizes come first, then the rows up to the place where these exceed the limit.
    sizes = got.groupBy("h").agg(F.sum(F.length("features")).alias("n")).orderBy("h").toPandas()
    fits = sizes[(sizes["n"].cumsum() <= max_bytes) | (sizes.index == 0)]
    if fits.empty:
        return fit_nb_svm([], np.zeros(0, np.int64))
    got = got.where(F.col("h") <= int(fits["h"].iloc[-1])).toPandas().sort_values(["h", "id", "features"])
    return fit_nb_svm([np.frombuffer(f, np.int32) for f in got["features"]], got["y"].to_numpy())


def score_quality(df: DataFrame, model: NbSvm, *, text_col: str = "text") -> DataFrame:
    """df with the column ``quality_score`` (0 to 1, higher: better) of whole texts; a null text is an empty one.

    Narrow; rows, repeated ones too, and other columns are kept, a column of that
    name is replaced; an empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [shared.value.scores(block) for block in kernel.blocks(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return df.withColumn("quality_score", score(F.col(text_col).cast("string")))
