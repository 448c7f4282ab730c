"""Quality classifier: random Fourier features, ridge normal equations, isotonic calibration.

Sixteen statistics of each whole text are standardised by their means and deviations over all
documents and mapped to ``FEATURES`` random Fourier features of a Gaussian kernel.  Every task sums its part
of the normal equations of all labelled training rows, apart for each of ``FOLDS`` folds; the parts are added in two rounds, by row block and
salt, so no task gathers all of them.  The driver solves systems of fixed size.  Calibration is a monotone fit
(pool adjacent violators) of label rates over binned raw scores.  Each training row's raw score comes from the weights of the
other folds, whose equations are the sum of all less the row's own, so calibration never sees a score that was fitted on its own label.

Defined results: null and empty texts have statistics of 0 and a score like any other; null labels do not
count; several labels of a document all count; a label of a null doc_id counts for nothing; without any label every score is 0.5; a null doc_id
is hashed as ''; copies get equal scores; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, gram_hashes, hash_words, materialize, shared_dir, spread, text_bytes
from .langid import fold

FEATURES = 256
STATS = 16
BLOCKS, SALTS = 16, 32
FOLDS = 4
BINS = 2000
_UPPER, _LOWERCASE, _DIGIT, _SPACE, _LINE, _STOP, _BANG, _BAR, _SYMBOL, _OTHER = range(10)
_class = np.full(256, _SYMBOL, np.int64)
_class[65:91], _class[97:123], _class[48:58], _class[128:] = _UPPER, _LOWERCASE, _DIGIT, _OTHER
for _c, _k in ((b" \t\x0b\x0c\r", _SPACE), (b"\n", _LINE), (b".,;:?'\"-()", _STOP), (b"!", _BANG), (b"|", _BAR)):
    _class[list(_c)] = _k


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of some documents, a row each."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    c = np.bincount(doc * 10 + _class[data], minlength=10 * n).reshape(n, 10).astype(float)
    words, first, starts, ends = hash_words(data, offsets)
    count = np.diff(first)
    of = np.repeat(np.arange(n), count)
    length = (ends - starts).astype(float)
    mean = np.bincount(of, length, n) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) / np.maximum(count, 1) - mean**2, 0))

    def variety(h, d):
        """Distinct hashes of a document, and the most frequent one's count."""
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        top = np.zeros(n)
        np.maximum.at(top, d[at], np.diff(np.r_[at, len(h)]))
        return np.bincount(d[at], minlength=n), top

    distinct, top = variety(words, of)
    again = np.zeros(n)
    if len(words) > 1:
        same = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        again = np.bincount(of[1:][same], minlength=n)
    grams = gram_hashes(words, 3)
    inside = of[: len(grams)] == of[2:] if len(grams) else np.zeros(0, bool)
    tri, _ = variety(grams[inside], of[: len(grams)][inside])
    size, w = np.maximum(np.diff(offsets), 1).astype(float), np.maximum(count, 1).astype(float)
    return np.column_stack([
        np.log1p(count), np.log1p(size), mean, spread, c[:, _UPPER] / size, c[:, _DIGIT] / size, c[:, _STOP] / w, c[:, _SYMBOL] / w,
        c[:, _BANG] / w, c[:, _BAR] / w, c[:, _OTHER] / size, c[:, _LINE] / w, distinct / w, again / w, top / w, tri / np.maximum(count - 2, 1)])


def describe(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, stats): the statistics as packed doubles."""
    schema = docs.select(*keep).schema.add("stats", "binary")

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(len(keep)))
            out = []
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                out += [x.tobytes() for x in statistics(data[part[0] : part[-1]], part - part[0])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, STATS)


def _add(blobs) -> bytes:
    return np.sum([np.frombuffer(x.as_py(), np.float64) for x in blobs], 0).tobytes()


def sum_blocks(parts: DataFrame) -> dict[int, np.ndarray]:
    """Add the arrays of (block, salt, part), first by block and salt, then by block; blocks are few."""
    def add(key, table):
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "part": pa.array([_add(table.column("part"))], pa.binary())})

    schema = "block int, salt int, part binary"
    once = parts.groupBy("block", "salt").applyInArrow(add, schema)
    return {r["block"]: np.frombuffer(r["part"], np.float64) for r in once.groupBy("block", "salt").applyInArrow(add, schema).collect()}


def moments(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        total = np.zeros((2, STATS))
        n = 0
        for batch in batches:
            x = _matrix(batch.column(0))
            total += [x.sum(0), (x * x).sum(0)]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId() % SALTS], pa.int32()), pa.array([np.r_[n, total.ravel()].tobytes()])], names=["block", "salt", "part"])

    got = sum_blocks(stats.select("stats").mapInArrow(run, "block int, salt int, part binary")).get(0, np.zeros(1 + 2 * STATS))
    n = max(got[0], 1)
    mean = got[1 : 1 + STATS] / n
    return mean, np.sqrt(np.maximum(got[1 + STATS :] / n - mean**2, 1e-12))


class Model:
    """Standardisation, features, weights and calibration; a few hundred kilobytes."""

    def __init__(self, mean, deviation, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, deviation
        self.w = rng.normal(0, 1 / np.sqrt(STATS), (STATS, FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = None
        self.at = self.rate = np.array([0.5])

    def features(self, x):
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones(len(x))])

    def raw(self, x):
        return np.zeros(len(x)) if self.beta is None else self.features(x) @ self.beta

    def score(self, x):
        return np.clip(np.interp(self.raw(x), self.at, self.rate), 0, 1)


def solve(total: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights from the summed normal equations [Z'Z | Z'y]; the last feature is constant, so its square counts rows."""
    return np.linalg.solve(total[:, :-1] + ridge * max(total[-1, -2], 1) * np.eye(len(total)), total[:, -1])


def fit(rows: DataFrame, model: Model, ridge: float = 1e-3) -> Model:
    """Fit weights and calibration on (stats, y, fold)."""
    spark = rows.sparkSession
    width = FEATURES + 1
    shared = spark.sparkContext.broadcast(model)

    def normal(batches):
        total = np.zeros((FOLDS, width, width + 1))
        for batch in batches:
            z = shared.value.features(_matrix(batch.column(0)))
            zy, f = np.column_stack([z, batch.column(1).to_numpy().astype(float)]), batch.column(2).to_numpy()
            for k in range(FOLDS):
                total[k] += z[f == k].T @ zy[f == k]
        salt = TaskContext.get().partitionId() % SALTS
        cut = np.array_split(total, BLOCKS, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([salt] * BLOCKS, pa.int32()), pa.array([np.ascontiguousarray(x).tobytes() for x in cut], pa.binary())], names=["block", "salt", "part"])

    rows = rows.select("stats", "y", "fold")
    got = sum_blocks(rows.mapInArrow(normal, "block int, salt int, part binary"))
    if not got:
        return model
    folds = np.concatenate([got[i].reshape(FOLDS, -1, width + 1) for i in range(BLOCKS)], 1)
    total = folds.sum(0)
    if not total[-1, -2]:
        return model
    model.beta = solve(total, ridge)
    others = spark.sparkContext.broadcast((model, np.column_stack([solve(total - folds[k], ridge) for k in range(FOLDS)])))

    def binned(batches):
        m, betas = others.value
        total = np.zeros((2, BINS))
        for batch in batches:
            raw = (m.features(_matrix(batch.column(0))) @ betas)[np.arange(batch.num_rows), batch.column(2).to_numpy()]
            b = ((np.clip(raw, -0.5, 1.4999) + 0.5) * BINS / 2).astype(int)
            total += [np.bincount(b, minlength=BINS), np.bincount(b, batch.column(1).to_numpy(), BINS)]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId() % SALTS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "salt", "part"])

    n, y = sum_blocks(rows.mapInArrow(binned, "block int, salt int, part binary"))[0].reshape(2, BINS)
    others.destroy()
    model.at, model.rate = isotonic((np.arange(BINS) + 0.5) * 2 / BINS - 0.5, n, y)
    return model


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins at x with n rows and y positives: block centres and rates."""
    stack: list[list[float]] = []  # n, y, n * x
    for xi, ni, yi in zip(x, n, y):
        if ni:
            stack.append([ni, yi, ni * xi])
            while len(stack) > 1 and stack[-2][1] * stack[-1][0] >= stack[-1][1] * stack[-2][0]:
                last = stack.pop()
                stack[-1] = [a + b for a, b in zip(stack[-1], last)]
    at = np.array([s[2] / s[0] for s in stack])
    base = y.sum() / max(n.sum(), 1)
    rate = np.array([(s[1] + base) / (s[0] + 1) for s in stack])  # one row of the overall rate in each block
    return at, np.maximum.accumulate(rate)


def predict(stats: DataFrame, model: Model) -> DataFrame:
    """Replace stats with score and predicted."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    names = [c for c in stats.columns if c != "stats"]
    schema = stats.select(*names).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        for batch in batches:
            s = shared.value.score(_matrix(batch.column(len(names))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= 0.3).astype(np.int32))], names=schema.names)

    return stats.select(*names, "stats").mapInArrow(run, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("y"))
    stats = materialize(describe(docs), folder, "stats")
    own = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    train = stats.where(~fold("doc_id", 5, 0)).join(labels, "doc_id").select("stats", "y", own.alias("fold"))
    model = fit(train, Model(*moments(stats)))
    scored = predict(stats, model)
    return scored.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")
