"""Quality classifier: Naive Bayes support vectors.

A text becomes the set of its n-gram indicators, hashed into a fixed number of buckets: word
unigrams and bigrams, 1- to 3-grams of word shapes, and indicators that bin how much of
the text repeats. Each indicator is scaled by its class log-count ratio; a linear hinge-loss model is
fitted on the scaled rows by dual coordinate descent; a logistic curve over its margin, fitted
on rows the model has not seen, gives the score.

``train`` fits on at most ``sample`` labelled rows, those with the smallest seeded hash of their id, or, without
``sample``, on every labelled row in shards. Everything else covers all documents and whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import buckets_for, remainder, stored, texts

BUCKETS = 1 << 18
SAMPLE = 5000
SHARD_ROWS = 5000
SHARD_BYTES = 6 << 20
SEED = 1
FOLDS = 5
CALIBRATION_FOLDS = 5
# Weights of shards are added as whole multiples of 1 / UNIT, so that their order does not matter.
UNIT = float(1 << 52)
BUCKETS_AT_ONCE = 1 << 14
THRESHOLD = 0.3
REMEMBERED = 200_000


@dataclass(frozen=True)
class Model:
    """Per bucket: weight times log-count ratio, and the squared ratio for a row's length."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, ids: np.ndarray) -> float:
        length = float(np.sqrt(self.squares[ids].sum())) if len(ids) else 0.0
        return (float(self.weights[ids].sum()) / length if length else 0.0) + self.bias

    def score(self, ids: np.ndarray) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.slope * self.margin(ids) + self.offset, -60, 60))))


def shape(word: str) -> str:
    """Runs of capitals, small letters, digits; any other character as it is, runs as one."""
    out = ""
    for ch in word:
        kind = "X" if ch.isupper() else "x" if ch.isalpha() else "9" if ch.isdigit() else ch
        if not out or out[-1] != kind:
            out += kind
    return out


class _Words(dict):
    """Word to (hash of its lower case, hash of its shape) packed into one integer."""

    def __missing__(self, word: str) -> int:
        pair = zlib.crc32(word.lower().encode()) << 32 | zlib.crc32(shape(word).encode(), 7)
        self[word] = pair
        return pair


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros_like(parts[0])
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def indicators(text: str, words: _Words | None = None) -> np.ndarray:
    """Sorted distinct buckets of a whole text; an empty text has only its bin.

    ``words`` keeps the hashes of words between texts.
    """
    words = _Words() if words is None else words
    if len(words) > REMEMBERED:
        words.clear()
    tokens = text.split()
    n = len(tokens)
    packed = np.fromiter(map(words.__getitem__, tokens), np.uint64, n)
    word, form = packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF)
    pairs = _mix(word[:-1], word[1:])
    repeat = 1 - len(np.unique(word)) / n if n else 0.0
    pair_repeat = 1 - len(np.unique(pairs)) / len(pairs) if n > 1 else 0.0
    shapes = 1 - len(np.unique(form)) / n if n else 0.0
    bins = [10 + int(repeat * 20), 50 + int(pair_repeat * 20), 90 + n.bit_length() // 2, 130 + 32 * int(repeat * 10) + n.bit_length(), 600 + int(shapes * 20)]
    grams = [
        _mix(np.array(bins, np.uint64), np.full(len(bins), 1, np.uint64)),
        _mix(word, np.full(n, 2, np.uint64)),
        pairs,
        _mix(form, np.full(n, 3, np.uint64)),
        _mix(form[:-1], form[1:], np.full(max(0, n - 1), 4, np.uint64)),
        _mix(form[:-2], form[1:-1], form[2:], np.full(max(0, n - 2), 5, np.uint64)),
    ]
    return np.unique((np.concatenate(grams) >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log of smoothed indicator shares of class 1 over those of class 0."""
    counts = np.zeros((2, BUCKETS))
    for ids, y in zip(rows, labels):
        counts[int(y)][ids] += 1
    return _ratios(counts)


def _ratios(counts: np.ndarray) -> np.ndarray:
    smoothed = counts + 1.0
    shares = smoothed / smoothed.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: np.ndarray, epochs: int = 20, seed: int = 1
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum of cost_i * hinge_i, one dual variable at a time."""
    w, b, alpha, rng = np.zeros(BUCKETS), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    lengths = [float(v @ v) + 1.0 for v in values]
    for _ in range(epochs):
        change = 0.0
        for i in rng.permutation(len(rows)):
            ids, x, y = rows[i], values[i], labels[i]
            gradient = y * (float(w[ids] @ x) + b) - 1.0
            new = min(max(alpha[i] - gradient / lengths[i], 0.0), cost[i])
            step = (new - alpha[i]) * y
            if step:
                w[ids] += step * x
                b += step
                alpha[i] = new
                change = max(change, abs(step))
        if change < 1e-4:
            break
    return w, b


def logistic_curve(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed targets."""
    low, high = _targets(positive.sum(), (~positive).sum())
    target = np.where(positive, high, low)

    def sums(a: float, c: float) -> list[float]:
        p = 1 / (1 + np.exp(-np.clip(a * margins + c, -40, 40)))
        s = p * (1 - p) + 1e-9
        return [((p - target) * margins).sum(), (p - target).sum(), (s * margins**2).sum(), (s * margins).sum(), s.sum()]

    return _newton(sums)


def logistic_curve_of(table: DataFrame, n1: int, n0: int) -> tuple[float, float]:
    """``logistic_curve`` of a table (quality, margin) with ``n1`` rows of quality 1 and ``n0`` of 0: each step is one aggregate."""
    low, high = _targets(n1, n0)
    margin, target = F.col("margin"), F.when(F.col("quality") == 1, F.lit(high)).otherwise(F.lit(low))

    def sums(a: float, c: float) -> list[float]:
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.lit(a) * margin + F.lit(c)))))
        rows = table.select("margin", (p - target).alias("gap"), (p * (1 - p) + 1e-9).alias("s"))
        parts = (F.col("gap") * margin, F.col("gap"), F.col("s") * margin * margin, F.col("s") * margin, F.col("s"))
        return list(rows.agg(*[F.sum(x).alias(f"x{i}") for i, x in enumerate(parts)]).first())

    return _newton(sums)


def _targets(n1: int, n0: int) -> tuple[float, float]:
    return float(1 / (n0 + 2)), float((n1 + 1) / (n1 + 2))


def _newton(sums: Callable[[float, float], list[float]]) -> tuple[float, float]:
    a, c = 1.0, 0.0
    for _ in range(50):
        ga, gc, haa, hac, hcc = sums(a, c)
        hessian = np.array([[haa, hac], [hac, hcc]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, np.array([ga, gc]))
        a, c = float(a - step[0]), float(c - step[1])
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(c)


def fit_model(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The classifier of labelled rows; without both classes it scores their share of label 1."""
    y = np.asarray(labels, dtype=np.int64)
    if len(y) == 0 or y.min() == y.max():
        return _share_model(int(y.sum()), len(y))
    whole = fit_margins(rows, y)
    margins = np.array([whole.margin(r) for r in rows])
    for fold in range(CALIBRATION_FOLDS):
        unseen = np.arange(len(y)) % CALIBRATION_FOLDS == fold
        kept = np.flatnonzero(~unseen)
        if len(np.unique(y[kept])) == 2:
            part = fit_margins([rows[i] for i in kept], y[kept])
            margins[unseen] = [part.margin(rows[i]) for i in np.flatnonzero(unseen)]
    slope, offset = logistic_curve(margins, y == 1)
    return Model(whole.weights, whole.squares, whole.bias, slope, offset)


def _share_model(positive: int, n: int) -> Model:
    share = (positive + 0.5) / (n + 1)
    zero = np.zeros(BUCKETS, np.float32)
    return Model(zero, zero, 0.0, 1.0, float(np.log(share / (1 - share))))


def fit_margins(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Ratios and hinge-loss weights of rows of both classes, each class with the same total cost."""
    ratios = log_count_ratios(rows, y)
    w, bias = hinge_weights(rows, y, ratios, np.bincount(y, minlength=2))
    return _margin_model(w, bias, ratios)


def _margin_model(w: np.ndarray, bias: float, ratios: np.ndarray) -> Model:
    return Model((w * ratios).astype(np.float32), (ratios**2).astype(np.float32), bias, 1.0, 0.0)


def hinge_weights(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of rows scaled by ``ratios``; ``sizes``, the rows of each class, set their costs."""
    squares = ratios**2
    values = [ratios[ids] / max(float(np.sqrt(squares[ids].sum())), 1e-9) for ids in rows]
    return dual_coordinate_descent(rows, values, np.where(y == 1, 1.0, -1.0), sizes.sum() / (2 * sizes[y]))


def train(docs: DataFrame, labels: DataFrame, sample: int | None = SAMPLE, folds: int = FOLDS, shard_rows: int = SHARD_ROWS) -> Model:
    """Fit on labelled documents outside the held-out fold, ``sample`` rows at most, all of them if it is None.

    Labels other than 0 and 1 and null ids do not count; of repeated labels of an id the largest holds,
    of repeated documents the smallest text. Null texts are empty texts.
    """
    if sample is None:
        return _train_on_all(docs, _marks(labels, folds), shard_rows)
    marks = _marks(labels, folds).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    # At most ``sample`` ids: the one side that is broadcast.
    table = _labelled(docs, F.broadcast(marks)).toPandas().sort_values("doc_id")
    return fit_model([np.frombuffer(b, np.int32) for b in table["ids"]], table["quality"].to_numpy())


def _marks(labels: DataFrame, folds: int) -> DataFrame:
    """doc_id and quality of the labels that are learned from."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), folds) != 0))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )


def _labelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, quality and the encoded indicators of each marked document."""
    bodies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    @F.pandas_udf("binary")
    def encoded(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _Words()
        for column in columns:
            yield pd.Series([indicators(t, words).tobytes() for t in texts(column)])

    joined = bodies.join(marks, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return joined.select("doc_id", "quality", encoded("text").alias("ids"))


def _train_on_all(docs: DataFrame, marks: DataFrame, shard_rows: int) -> Model:
    """Fit on every marked document.

    Rows are dealt by a seeded hash of their id into shards of about ``shard_rows``, fewer if their texts are long, since a
    task holds one shard. The ratios are counted over all rows. Under them each shard fits its weights, and the model's weights are their mean over the shards, by rows.
    The logistic curve is fitted on the margins of all rows, each under a model of the other calibration folds of
    all shards. One shard gives the model of ``fit_model``. The driver gets sums per bucket only.
    """
    length = F.octet_length("text").cast("long")
    lengths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), length.alias("length")).join(marks, "doc_id").agg(F.sum("length"))
    shards = max(buckets_for(marks.count(), shard_rows), buckets_for(lengths.first()[0] or 0, SHARD_BYTES))
    shard = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string")), F.lit(shards)).cast("int")
    place = F.row_number().over(Window.partitionBy("shard").orderBy("doc_id")) - 1
    rows = _labelled(docs, marks).withColumn("shard", shard).withColumn("part", (place % CALIBRATION_FOLDS).cast("int"))
    rows = stored(rows, "labelled")
    sizes = np.zeros((CALIBRATION_FOLDS, 2), np.int64)
    for r in rows.groupBy("part", "quality").count().collect():
        sizes[r["part"], r["quality"]] = r["count"]
    n0, n1 = map(int, sizes.sum(axis=0))
    if not n0 or not n1:
        return _share_model(n1, n0 + n1)
    cells = [f"c{i}" for i in range(2 * CALIBRATION_FOLDS)]
    tallied = rows.select("part", "quality", "ids").mapInArrow(_tally, f"bucket int, {', '.join(f'{c} long' for c in cells)}")
    counts = _bucket_sums(tallied, cells, BUCKETS).reshape(CALIBRATION_FOLDS, 2, BUCKETS)
    # A model without each calibration fold, and last the one of all rows.
    sizes = np.concatenate((sizes.sum(axis=0) - sizes, [sizes.sum(axis=0)]))
    ratios = np.stack([_ratios(c) for c in (*(counts.sum(axis=0) - counts), counts.sum(axis=0))])
    spark, columns = docs.sparkSession, [f"w{i}" for i in range(len(sizes))]
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "doc_id").select("shard", "part", "quality", "ids")
    fits = dealt.mapInArrow(_shard_weights(spark.sparkContext.broadcast((ratios, sizes))), f"bucket int, {', '.join(f'{c} long' for c in columns)}")
    weights = _bucket_sums(fits, columns, BUCKETS + 1) / UNIT
    models = [_margin_model(w[:BUCKETS], float(w[BUCKETS]), r) for w, r in zip(weights, ratios)]
    whole = models[-1]
    unseen = [m if n.all() else whole for m, n in zip(models[:-1], sizes)]
    margins = stored(rows.select("part", "quality", "ids").mapInArrow(_margins(spark.sparkContext.broadcast(unseen)), "quality int, margin double"), "margins")
    slope, offset = logistic_curve_of(margins, n1, n0)
    return Model(whole.weights, whole.squares, whole.bias, slope, offset)


def _bucket_sums(rows: DataFrame, columns: list[str], buckets: int) -> np.ndarray:
    """The sums of each column by bucket, one array a column."""
    found = rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    out = np.zeros((len(columns), buckets), np.int64)
    out[:, found["bucket"].to_numpy()] = [found[c].to_numpy() for c in columns]
    return out


def _bucket_rows(sums: np.ndarray, names: str) -> Iterator[pa.RecordBatch]:
    """A row for each bucket in which a column has something, some thousand rows at a time."""
    columns = ["bucket", *[f"{names}{i}" for i in range(len(sums))]]
    for start in range(0, sums.shape[1], BUCKETS_AT_ONCE):
        part = sums[:, start : start + BUCKETS_AT_ONCE]
        some = np.flatnonzero(part.any(axis=0))
        yield pa.record_batch([pa.array((some + start).astype(np.int32)), *[pa.array(x[some]) for x in part]], columns)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each bucket, by calibration fold and class."""
    counts = np.zeros((2 * CALIBRATION_FOLDS, BUCKETS), np.int64)
    for batch in batches:
        cell = 2 * batch["part"].to_numpy() + batch["quality"].to_numpy()
        ids = batch["ids"].to_pylist()
        for c in np.unique(cell).tolist():
            found = b"".join([ids[i] for i in np.flatnonzero(cell == c).tolist()])
            counts[c] += np.bincount(np.frombuffer(found, np.int32), minlength=BUCKETS)
    yield from _bucket_rows(counts, "c")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Indicators, qualities and calibration folds of each shard; rows arrive sorted by shard."""
    last, ids, qualities, parts = None, [], [], []
    for batch in batches:
        shard = batch["shard"].to_numpy()
        starts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(shard)]):
            if ids and shard[a] != last:
                yield ids, np.concatenate(qualities), np.concatenate(parts)
                ids, qualities, parts = [], [], []
            last, rows = shard[a], batch.slice(a, b - a)
            ids += [np.frombuffer(x, np.int32) for x in rows["ids"].to_pylist()]
            qualities.append(rows["quality"].to_numpy())
            parts.append(rows["part"].to_numpy())
    if ids:
        yield ids, np.concatenate(qualities), np.concatenate(parts)


def _shard_weights(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each model's weights on each shard's rows, times the shard's part of the model's rows, added; the last bucket is the bias."""
        ratios, sizes = shared.value
        sums = np.zeros((len(sizes), BUCKETS + 1), np.int64)
        for ids, y, part in _shards(batches):
            for m, n in enumerate(sizes):
                kept = np.flatnonzero(part != m)
                if n.all() and len(kept):
                    w, bias = hinge_weights([ids[i] for i in kept.tolist()], y[kept], ratios[m], n)
                    sums[m] += np.rint(np.append(w, bias) * (len(kept) / n.sum()) * UNIT).astype(np.int64)
        yield from _bucket_rows(sums, "w")

    return run


def _margins(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's margin under the model that has not seen its calibration fold."""
        models = shared.value
        for batch in batches:
            rows = zip(batch["part"].to_pylist(), batch["ids"].to_pylist())
            margins = pa.array([models[p].margin(np.frombuffer(b, np.int32)) for p, b in rows], pa.float64())
            yield pa.record_batch([batch["quality"], margins], ["quality", "margin"])

    return run


def quality_score(spark: SparkSession, text: Column, model: Model) -> Column:
    """Score from 0 to 1 of each whole text; null counts as empty.

    The model is broadcast; its size is fixed, two floats per bucket.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, words = shared.value, _Words()
        for column in columns:
            yield pd.Series([known.score(indicators(t, words)) for t in texts(column)], dtype="float64")

    return score(text)


def score_documents(docs: DataFrame, model: Model, folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts get the score of an empty text. Null ids are not held out. Repeated rows
    keep one result each; an empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"),
        quality_score(docs.sparkSession, F.col("text"), model).alias("score"),
    )
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text the model does not reject, with all their columns."""
    return docs.where(quality_score(docs.sparkSession, F.col("text"), model) >= threshold)
