"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

A text's features are which n-grams it holds: single words and pairs of words, lower-cased, and single
shapes and pairs of shapes (runs of letters, capitals, digits, each other sign), and a mark for a word
that follows itself; hashed to FEATURES. Indicators are scaled by the class log-count ratios, a row is
scaled to length one, and a linear hinge-loss model is fitted by dual coordinate descent. Scores are
probabilities by a sigmoid fitted on a fifth of the sample that the model has not seen.

Learned from a bounded sample: about TRAIN_ROWS labelled rows, whole texts, chosen by a hash of
doc_id; of several labels of one document the largest counts, null labels do not, and of several texts
of one document the one with the smallest features' hash. Only distinct feature numbers of the sample
reach the driver, 4 bytes each: about TRAIN_ROWS times the distinct n-grams of a text (FEATURES at most,
so 1 MB for the longest). Every row's text is scored in whole, by one task; repeated rows and those with a null doc_id too, and
other columns play no part. Null or empty text has no feature and gets the model's bias. Where the
sample lacks a class, the score is the share of label 1 in it (0.5 if it is empty). An empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import BLANK, LOWER, byte_hashes, mix, span_hashes, text_slices, word_spans

FEATURES = 1 << 18
TRAIN_ROWS = 6000
HOLD_BACK = 5
SMOOTH = 1.0
COST = 2.0
EPOCHS = 12

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def features(buffer: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct feature numbers, sorted."""
    starts, ends = word_spans(buffer, begins, BLANK)
    first = np.searchsorted(starts, begins)
    words = span_hashes(byte_hashes(LOWER[buffer]), starts, ends)
    shape = _SHAPE[buffer]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    place = np.r_[0, np.cumsum(keep)]
    shapes = span_hashes(byte_hashes(shape[keep]), place[starts], place[ends])
    n = len(words)
    pair = lambda x, kind: mix(x[:-1] * np.uint64(0x9FB21C651E98DF25) + x[1:] + np.uint64(kind)) if n else x
    same = np.full(max(0, n - 1), mix(np.array([7]))[0])
    kinds = [mix(words + np.uint64(1)), mix(shapes + np.uint64(2))], [pair(words, 3), pair(shapes, 4), np.where(words[1:] == words[:-1], same, pair(shapes, 4))]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = [x[a:b] for x in kinds[0]] + [x[a : max(a, b - 1)] for x in kinds[1]]
        out.append(np.unique(np.concatenate(own) & np.uint64(FEATURES - 1)).astype(np.uint32))
    return out


def fit_linear(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over rows scaled by ratio, by dual coordinate descent."""
    w, bias = np.zeros(FEATURES), 0.0
    alpha = np.zeros(len(rows))
    scaled = []
    for x in rows:
        v = ratio[x]
        scaled.append(v / max(np.linalg.norm(v), 1e-12) if len(v) else v)
    norm = np.array([float(v @ v) + 1 for v in scaled])
    cost = COST * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)).tolist():
            x, v = rows[i], scaled[i]
            slope = y[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[x] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def fit_sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of P(label 1) = 1 / (1 + exp(-(a margin + b))), with Platt's targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margin * margin).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


class Model:
    """value[f]: weight times ratio; scale[f]: ratio squared, which gives a row's length."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, held: np.ndarray):
        self.share = float(labels.mean()) if len(labels) else 0.5
        self.fitted = bool(len(set(labels[~held])) == 2)
        if not self.fitted:
            return
        y = np.where(labels > 0, 1, -1)
        train = np.flatnonzero(~held)
        counts = [np.full(FEATURES, SMOOTH) for _ in range(2)]
        for i in train:
            counts[int(y[i] > 0)][rows[i]] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        w, self.bias = fit_linear([rows[i] for i in train], y[train], ratio)
        self.value, self.scale = w * ratio, ratio * ratio
        rest = np.flatnonzero(held)
        self.a, self.b = fit_sigmoid(np.array([self.margin(rows[i]) for i in rest]), y[rest]) if len(rest) else (1.0, 0.0)

    def margin(self, x: np.ndarray) -> float:
        return float(self.value[x].sum()) / max(float(self.scale[x].sum()) ** 0.5, 1e-12) + self.bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.a * self.margin(x) + self.b)))) if self.fitted else self.share


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buffer, begins in text_slices(batch):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("quality"), pa.array([x.tobytes() for x in features(buffer, begins)], pa.binary())], names=["doc_id", "quality", "features"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, quality); about `rows` labelled rows reach the driver, as feature numbers."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    share = rows / max(1, labels.count())
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.broadcast(labels.where(draw < share))  # at most about `rows` rows of two numbers
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").mapInArrow(_rows, "doc_id long, quality int, features binary")
    got = held.toPandas()
    got = got.assign(mark=[zlib.crc32(x) for x in got["features"]]).sort_values(["doc_id", "mark", "features"]).drop_duplicates("doc_id")
    return Model([np.frombuffer(x, np.uint32) for x in got["features"]], got["quality"].to_numpy(np.int64), mix(got["doc_id"].to_numpy(np.int64).astype(np.uint64)) % np.uint64(HOLD_BACK) == 0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row of docs (doc_id, text, ...)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for rows, buffer, begins in text_slices(batch):
                score = np.array([model.score(x) for x in features(buffer, begins)])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def accepted_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are predicted 1, as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buffer, begins in text_slices(batch):
                yield rows.filter(pa.array([held.value.score(x) >= 0.5 for x in features(buffer, begins)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return predict(docs, learn(docs, labels.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "score", "predicted")
