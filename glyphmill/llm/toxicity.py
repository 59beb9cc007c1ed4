"""Toxicity by a classifier chain.

The categories are predicted in order.  Each has a linear (logistic) model over
the presence of hashed words, and over the log-odds of all earlier categories.
For training these are out-of-fold predictions, so that a later model learns
from what earlier models say about documents they have not seen.

The labelled sample is bounded by ``max_train_rows`` (the rows of the smallest
key hashes); every document is scored.  A model's features are the words, of those
in at least ``LEAST_DOCS`` of its training documents, whose likelihood-ratio statistic
with the category is ``TELLING`` or more (one in a thousand by chance), however many.
Each out-of-fold model chooses its own from the other folds alone.  Words are runs between white space and ASCII punctuation, lower-cased
(A-Z).

Null labels and keys don't train.  Null and empty texts have no words and get
the models' constant terms.  Repeated rows each get their row.  Without labels
of both values in a category its probability is the share seen (0 without any
labels).  Empty tables give an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import as_bytes, read, scratch
from ._text import U64, binary_rows, word_hashes

MAX_TRAIN_ROWS, LEAST_DOCS, TELLING, FOLDS, BUCKETS = 6000, 4, 5.4, 5, 1 << 20
#: In chain order.  The labels have two marks; the last category is their product, low quality and toxic at once.
CATEGORIES = ("low_quality", "toxic", "severe")
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def buckets(text: bytes) -> np.ndarray:
    """The distinct word buckets of a text."""
    return np.unique(word_hashes(text.translate(_TO_SPACE)) & U64(BUCKETS - 1)).astype(np.int32)


@dataclass
class Linear:
    weights: np.ndarray
    constant: float

    def logit(self, x: Sparse) -> np.ndarray:
        return x.times(self.weights) + self.constant


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Sparse:
    """Rows of distinct features, all of value 1, and dense columns beside them."""

    row: np.ndarray
    column: np.ndarray
    shape: tuple[int, int]
    dense: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.shape[0]) + self.dense @ w[self.shape[1] :]

    def transposed(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, v[self.row], self.shape[1]), self.dense.T @ v])

    def rows(self, keep: np.ndarray) -> Sparse:
        place = np.cumsum(keep) - 1
        mine = keep[self.row]
        return Sparse(place[self.row[mine]], self.column[mine], (int(keep.sum()), self.shape[1]), self.dense[keep])

    def columns(self, keep: np.ndarray) -> Sparse:
        place = np.cumsum(keep) - 1
        mine = keep[self.column]
        return Sparse(self.row[mine], place[self.column[mine]], (self.shape[0], int(keep.sum())), self.dense)

    def beside(self, column: np.ndarray) -> Sparse:
        return Sparse(self.row, self.column, self.shape, np.column_stack([self.dense, column]))


def fit(x: Sparse, y: np.ndarray, l2: float = 1.0, rounds: int = 200) -> Linear:
    """L2-regularised logistic regression by accelerated gradient descent. """
    n, p = x.shape[0], x.shape[1] + x.dense.shape[1]
    if not n or y.min() == y.max():
        share = float(np.clip(y.mean() if n else 0.0, 1e-6, 1 - 1e-6))
        return Linear(np.zeros(p), float(np.log(share / (1 - share))))
    v = np.ones(p)
    for _ in range(12):  # the largest curvature, by power iteration
        u = x.transposed(x.times(v))
        v = u / max(float(np.linalg.norm(u)), 1e-12)
    step = 1 / (float(np.linalg.norm(x.times(v))) ** 2 / 4 * 1.1 + n / 4 + l2)
    w, b = np.zeros(p), float(np.log(y.mean() / (1 - y.mean())))
    at_w, at_b, t = w.copy(), b, 1.0
    for _ in range(rounds):
        error = _sigmoid(x.times(at_w) + at_b) - y
        new_w, new_b = at_w - step * (x.transposed(error) + l2 * at_w), at_b - step * float(error.sum())
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        at_w, at_b = new_w + (t - 1) / t_next * (new_w - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new_w, new_b, t_next
    return Linear(w, b)


def telling(x: Sparse, y: np.ndarray) -> np.ndarray:
    """Each feature's likelihood-ratio statistic with the category; 0 where it is in too few rows."""
    n, positives = x.shape[0], y.sum()
    with_, hit = np.bincount(x.column, minlength=x.shape[1]).astype(float), np.bincount(x.column, y[x.row], x.shape[1])
    total = np.zeros(x.shape[1])
    for seen, size in ((hit, with_ * positives), (with_ - hit, with_ * (n - positives)), (positives - hit, (n - with_) * positives), (n - with_ - positives + hit, (n - with_) * (n - positives))):
        expected = np.maximum(size / max(n, 1), 1e-12)
        total += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / expected), 0)
    return np.where(with_ >= LEAST_DOCS, total, 0.0)


def fit_telling(x: Sparse, y: np.ndarray) -> Linear:
    """A model over the telling features and the dense columns; other features weigh 0."""
    keep = telling(x, y) >= TELLING
    small = fit(x.columns(keep), y)
    weights = np.zeros(len(keep) + x.dense.shape[1])
    weights[np.concatenate([keep, np.ones(x.dense.shape[1], bool)])] = small.weights
    return Linear(weights, small.constant)


@dataclass
class Chain:
    """``place``: the feature of each bucket, or -1; ``n``: how many features there are."""

    place: np.ndarray
    n: int
    models: list[Linear]
    thresholds: list[float]

    def probabilities(self, found: np.ndarray) -> list[float]:
        """Of one text, by its distinct buckets."""
        at = self.place[found]
        at = at[at >= 0]
        n = self.n
        logits: list[float] = []
        for m in self.models:
            logits.append(float(m.constant + m.weights[at].sum() + np.dot(m.weights[n:], logits)))
        return _sigmoid(np.array(logits)).tolist()


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The out-of-fold probability with the best F1, half-way to the next below; 0.5 without positives."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    if not len(p) or not hits[-1]:
        return 0.5
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + hits[-1])
    k = int(np.argmax(f1))
    return float((p[order[k]] + p[order[min(k + 1, len(p) - 1)]]) / 2)


def train_chain(x: Sparse, labels: np.ndarray, folds: np.ndarray, place: np.ndarray) -> Chain:
    """``x``: presence of features; ``labels``: a column for each category; ``folds``: 0 to FOLDS - 1."""
    models, thresholds = [], []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        unseen = np.zeros(len(y))
        for f in range(FOLDS):
            out = folds == f
            if out.any():
                unseen[out] = fit_telling(x.rows(~out), y[~out]).logit(x.rows(out))
        models.append(fit_telling(x, y))
        thresholds.append(_best_threshold(_sigmoid(unseen), y))
        x = x.beside(unseen)
    return Chain(place, x.shape[1], models, thresholds)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_train_rows: int = MAX_TRAIN_ROWS) -> Chain:
    """``labels``: key and a 0/1 column for each category, in chain order.  Of rows with one key one text trains, the smallest."""
    names = [c for c in labels.columns if c != key]
    mark = [f"_c{k}" for k in range(len(names))]
    whole = labels.select(F.col(key).alias("_key"), *(F.col(f"`{c}`").cast("int").alias(m) for c, m in zip(names, mark, strict=True))).dropna()
    sample = whole.groupBy("_key").agg(*(F.max(m).alias(m) for m in mark)).withColumn("_h", F.xxhash64("_key")).orderBy("_h", "_key").limit(max_train_rows)
    sample = scratch(sample.select("_key", F.pmod("_h", F.lit(FOLDS)).cast("int").alias("_fold"), *mark), "labelled-sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in binary_rows(batches, "_text"):
            found = [buckets(t) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))], names=["_key", "_fold", *mark, "_words"])

    # the sample is bounded: its keys can go to every task
    held = docs.select(F.col(key).alias("_key"), as_bytes(text).alias("_text")).join(F.broadcast(sample), "_key").select("_key", "_fold", *mark, "_text")
    kind = docs.schema[key].dataType.simpleString()
    told = held.mapInArrow(words, ", ".join([f"_key {kind}", "_fold int", *(f"{m} int" for m in mark), "_words array<int>"]))
    rows = scratch(told.groupBy("_key").agg(*(F.min(c).alias(c) for c in ("_fold", *mark, "_words"))), "labelled-words")
    often = rows.select(F.explode("_words").alias("_word")).groupBy("_word").agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST_DOCS)
    chosen = np.sort(often.select("_word").toArrow()["_word"].to_numpy())  # at most as many rows as buckets
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    kept = rows.drop("_key").toArrow()  # of at most max_train_rows texts
    lists = [place[np.asarray(x, np.int64)] for x in kept["_words"].to_pylist()]
    lists = [np.sort(x[x >= 0]) for x in lists]
    n = len(lists)
    order = np.lexsort([*(kept[m].to_numpy() for m in mark), kept["_fold"].to_numpy(), [zlib.crc32(x.tobytes()) for x in lists]]) if n else np.zeros(0, int)
    lists = [lists[k] for k in order]
    x = Sparse(np.repeat(np.arange(n), [len(f) for f in lists]), np.concatenate(lists) if n else np.zeros(0, int), (n, len(chosen)), np.zeros((n, 0)))
    y = np.column_stack([kept[m].to_numpy()[order] for m in mark]) if n else np.zeros((0, len(names)))
    return train_chain(x, y, kept["_fold"].to_numpy()[order] if n else np.zeros(0), place)


def score(docs: DataFrame, chain: Chain, categories: tuple[str, ...] = CATEGORIES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and, for each category, its probability and whether it reaches the threshold (``is_...``)."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch, texts in binary_rows(batches, "_text"):
            p = np.array([chain.probabilities(buckets(t)) for t in texts]).reshape(len(texts), -1)
            flags = [pa.array(p[:, k] >= t) for k, t in enumerate(chain.thresholds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), *flags], names=[key, *(f"p_{c}" for c in categories), *(f"is_{c}" for c in categories)])

    kind = docs.schema[key].dataType.simpleString()
    out = [f"`{key}` {kind}", *(f"p_{c} double" for c in categories), *(f"is_{c} boolean" for c in categories)]
    return docs.select(F.col(key), as_bytes(text).alias("_text")).mapInArrow(run, ", ".join(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    low = 1 - F.col("quality")
    chained = labels.select("doc_id", low.alias("low_quality"), F.col("toxic"), (low * F.col("toxic")).alias("severe"))
    return score(docs, learn(docs, chained))
