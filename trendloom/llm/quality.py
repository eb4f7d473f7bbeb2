"""Quality classifier: naive Bayes support vectors (NBSVM).

A text's features are indicators of n-grams in three views: its words, the shapes of its words (letters in
either case, digits and signs, runs as one), and how many words in a row all stood among the last ones before.
Indicators are scaled by the log-count ratio of the classes, rows to unit length, and a linear
model with hinge loss is fitted by dual coordinate descent. A logistic curve over held-aside margins
turns a margin into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import only_columns, spread
from trendloom.llm.token_counts import slices

BUCKETS = 1 << 18
NGRAMS = 3
#: A word counts as repeated if it stands among so many words before; rows of that many repeats are features.
RECENT = 64
REPEATS = (4, 8, 16, 32, 64)
#: At most so many labelled documents of each class are learned from, those of least hash.
TRAIN_EACH = 3000
#: Of each class, documents are learned from until so many features are together (4 bytes each on the driver).
TRAIN_FEATURES = 1 << 23
THRESHOLD = 0.7
BATCH_BYTES = 2 << 20
COST = 1.0
EPOCHS = 12
FOLDS = 3


def _class_table() -> np.ndarray:
    """Of each code point below 2^16: X upper, x lower, 9 digit, space, or itself."""
    table = np.arange(0x10000)
    for i in range(0x10000):
        c = chr(i)
        table[i] = 88 if c.isupper() else 120 if c.isalpha() else 57 if c.isdigit() else 32 if c.isspace() else i
    return table


_TABLE: list[np.ndarray] = []


def _hashed(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of codes, the same wherever it stands; stretches are apart and in order."""
    n = ends - starts
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = inside + np.repeat(starts, n)
    with np.errstate(over="ignore"):
        mixed = (codes[at].astype(np.uint64) + np.uint64(77)) * (inside.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))
        mixed ^= mixed >> np.uint64(29)
        return np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), np.cumsum(n) - n)


def _stretches(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of `codes` (white space as 32) start and end."""
    solid = np.concatenate(([False], codes != 32, [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def _view(texts: list[str], shapes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the text of each."""
    if not _TABLE:
        _TABLE.append(_class_table())
    parts = [np.frombuffer((t + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in parts])
    codes = np.concatenate(parts)
    kinds = np.where(codes < 0x10000, _TABLE[0][np.minimum(codes, 0xFFFF)], codes)
    if shapes:
        keep = np.concatenate(([True], (kinds[1:] != kinds[:-1]) | (kinds[1:] == 32)))
        owner = np.repeat(np.arange(len(texts)), sizes)[keep]
        codes = kinds = kinds[keep]
    else:
        codes = np.where(kinds == 32, 32, codes)
        kinds, owner = codes, np.repeat(np.arange(len(texts)), sizes)
    starts, ends = _stretches(kinds)
    return (_hashed(codes, starts, ends) if len(starts) else np.zeros(0, np.uint64)), owner[starts]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every feature that a text has, each once, sorted."""
    owners, buckets = [], []

    def add(owner: np.ndarray, hashed: np.ndarray, salt: int) -> None:
        with np.errstate(over="ignore"):
            mixed = (hashed + np.uint64(salt)) * np.uint64(0x94D049BB133111EB)
        owners.append(owner)
        buckets.append((mixed >> np.uint64(46)).astype(np.int64))

    for shapes, view in ((0, [t.lower() for t in texts]), (1, texts)):
        words, owner = _view(view, bool(shapes))
        mixed = words
        for n in range(1, NGRAMS + 1):
            if n > 1:
                with np.errstate(over="ignore"):
                    mixed = mixed[: len(words) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :]
            if len(mixed):
                same = owner[: len(mixed)] == owner[n - 1 :]
                add(owner[: len(mixed)][same], mixed[same], 10 * shapes + n)
        if not shapes and len(words):
            order = np.lexsort((np.arange(len(words)), words, owner))
            again = np.zeros(len(words), bool)
            near = (words[order][1:] == words[order][:-1]) & (owner[order][1:] == owner[order][:-1]) & (np.diff(order) <= RECENT)
            again[order[1:][near]] = True
            run = np.arange(len(words)) - np.maximum.accumulate(np.where(again, -1, np.arange(len(words))))
            for k in REPEATS:
                at = owner[run >= k]
                add(at, np.full(len(at), k, np.uint64), 30)
    if not sum(map(len, owners)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.sort(np.concatenate(owners) * BUCKETS + np.concatenate(buckets))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key // BUCKETS, key % BUCKETS


@dataclass
class Model:
    """`weights` already hold the log-count ratios; `lengths` their squares for the rows' lengths."""

    weights: np.ndarray
    lengths: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, owner: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        length = np.sqrt(np.bincount(owner, self.lengths[bucket], n))
        return np.bincount(owner, self.weights[bucket], n) / np.where(length > 0, length, 1.0) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margins(*features(texts), len(texts)) + self.shift, -30, 30)))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1-loss linear SVM (Hsieh et al. 2008); the bias is a constant feature."""
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    norm = np.array([v @ v for v in values]) + 1.0
    draw = np.random.default_rng(11)
    for _ in range(epochs):
        for i in draw.permutation(len(y)).tolist():
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def _train(rows: list[np.ndarray], y: np.ndarray) -> Model:
    ratio = np.zeros(BUCKETS)
    counts = []
    for sign in (1, -1):
        own = [r for r, s in zip(rows, y, strict=True) if s == sign]
        n = np.bincount(np.concatenate(own), minlength=BUCKETS) + 1.0 if own else np.ones(BUCKETS)
        counts.append(n / n.sum())
    ratio = np.log(counts[0] / counts[1])
    values = [ratio[r] / max(np.sqrt(ratio[r] @ ratio[r]), 1e-12) for r in rows]
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    w, bias = descend(rows, values, y, COST * 0.5 / np.maximum(share, 1e-3))
    return Model(w * ratio, ratio * ratio, bias, 1.0, 0.0)


def _curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of labels over margins (Platt's targets, Newton steps)."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.stack([margin, np.ones_like(margin)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - goal)))
        theta = theta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def fit(docs: DataFrame, labels: DataFrame, each: int = TRAIN_EACH) -> Model:
    """Learns quality from the labelled rows whose crc32(doc_id as text) mod 4 isn't 2.

    Of each class the `each` documents of least hash are read, as long as those before have fewer than TRAIN_FEATURES features
    together; these features come to the driver. Without both classes every text scores the share of label 1 (0.5
    without labels). Of rows that repeat a doc_id the one whose text has the least hash is read. A doc_id with contrary labels counts as 0; labels without a doc_id or of another value count nothing.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marked = marked.where(F.col("quality").isin(0, 1) & (remainder(4) != 2)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = [marked.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for k in (0, 1)]
    rows = only_columns(docs, {"doc_id": "long", "text": "string"}).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # 2 * each rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, bucket = features([t or "" for t in part.column(2).to_pylist()])
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["doc_id", "quality", "features"])

    found = rows.mapInArrow(run, "doc_id long, quality int, features array<int>")
    before = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("features")).rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("ahead", F.coalesce(F.sum(F.size("features")).over(before), F.lit(0))).where(F.col("ahead") < TRAIN_FEATURES).drop("ahead")
    table = found.toArrow().sort_by("doc_id")
    y = np.where(table.column("quality").to_numpy() == 1, 1, -1)
    lists = [np.asarray(x.values.to_numpy()) if x.is_valid else np.zeros(0, np.int64) for x in table.column("features")]
    if len(set(y.tolist())) < 2:
        share = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    model = _train(lists, y)
    fold, margin = np.arange(len(y)) % FOLDS, np.zeros(len(y))
    for k in range(FOLDS):
        inside, aside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        part = _train([lists[i] for i in inside], y[inside])
        owner = np.repeat(np.arange(len(aside)), [len(lists[i]) for i in aside])
        margin[aside] = part.margins(owner, np.concatenate([lists[i] for i in aside]) if len(aside) else owner, len(aside))
    weight = np.where(y > 0, sizes[1] / (y > 0).sum(), sizes[0] / (y < 0).sum())
    model.slope, model.shift = _curve(margin, y, weight)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id, score` of every row of `docs(doc_id, text)`; a null text scores as the empty one."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # two floats a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes, BATCH_BYTES):
                found = shipped.value.scores([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found)], ["doc_id", "score"])

    return spread(only_columns(docs, {"doc_id": "long", "text": "string"})).mapInArrow(run, "doc_id long, score double")


def predict(docs: DataFrame, labels: DataFrame, each: int = TRAIN_EACH) -> DataFrame:
    """`doc_id, held_out, score, predicted` of every row of `docs`, learned from `labels`."""
    found = score(docs, fit(docs, labels, each))
    held = F.coalesce(remainder(4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
