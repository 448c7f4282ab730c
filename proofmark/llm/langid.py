"""Language identification as multilingual mixture inference.

Labelled documents give character trigram counts a language (hashed to ``BUCKETS``; summed within tasks,
then over them, from whole texts).  Of a document, expectation-maximisation estimates the
proportions of a mixture of all learned languages' trigram models.  Then languages are dropped as long as
the penalised likelihood does not get worse: first, at once, all whose share explains fewer trigrams than their
penalty, and then the one with the smallest share at a time.  The prediction is the largest share of the set that is left, the score is that share,
shrunk for short texts.  All documents of a chunk go through the numpy passes together; a chunk is the smaller the
more languages there are.

``fit`` says how well that mixture explains the text: its log-likelihood a trigram less that of trigrams drawn evenly.
Below 0 the letters are better explained by chance; a few words around a key or a number come near that, an unlearned
language or junk goes far below, so ``keep_known`` draws the line at -1, a factor of e a trigram.

Letters are lower-cased code points of ``str.isalpha``; everything else separates words.  The model holds
``BUCKETS`` numbers a language and is the only thing broadcast.

Defined results: null texts, texts without a letter, and all texts if nothing was learned are
``und`` with score 0 and no fit; a null doc_id is hashed as ''; copies get equal results; an empty table
gives no rows; extra columns pass through, unless named as one of the columns made here, which
``identify`` replaces; ``keep_known`` makes no column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread, tidy

BUCKETS = 1 << 15
#: Characters times languages that one numpy pass handles.
CHUNK_CHARS = 1 << 20
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_table: list[np.ndarray] = []


def letters(codes: np.ndarray) -> np.ndarray:
    """Lower-cased letters; 32 for all other code points."""
    if not _table:
        def low(i: int) -> int:
            c = chr(i)
            return (ord(c.lower()) if len(c.lower()) == 1 else i) if c.isalpha() else 32
        _table.append(np.array([low(i) for i in range(0x10000)], dtype=np.uint32))
    out = _table[0][np.minimum(codes, 0xFFFF)]
    if (high := codes > 0xFFFF).any():
        u, back = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in u], dtype=np.uint32)[back]
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count), ordered by document, of the trigrams of each text."""
    parts = [f" {t} " for t in texts]
    codes = letters(np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32))
    ends = np.cumsum([len(p) for p in parts])
    doc = np.repeat(np.arange(len(parts)), np.diff(np.r_[0, ends]))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (doc[1:] != doc[:-1])
    codes, doc = codes[keep].astype(np.uint64), doc[keep]
    if len(codes) < 3:
        none = np.zeros(0, np.int64)
        return none, none, none
    h = codes[:-2] * _A + codes[1:-1] * _B + codes[2:] * _C
    h = ((h ^ (h >> np.uint64(29))) * _A) >> np.uint64(49)
    inside = doc[:-2] == doc[2:]
    key, n = np.unique(doc[:-2][inside] * BUCKETS + h[inside].astype(np.int64), return_counts=True)
    return key // BUCKETS, key % BUCKETS, n


def text_chunks(column: pa.Array, languages: int = 4):
    """(lo, hi, texts) of about CHUNK_CHARS characters for all languages together."""
    texts = [t or "" for t in column.to_pylist()]
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size * languages >= CHUNK_CHARS or i == len(texts) - 1:
            yield lo, i + 1, texts[lo : i + 1]
            lo, size = i + 1, 0


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram log-probabilities, from rows of (text, lang)."""
    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, hi, texts in text_chunks(batch.column(0)):
                doc, bucket, n = trigrams(texts)
                names = sorted(set(langs[lo:hi]))
                which = np.array([names.index(x) for x in langs[lo:hi]], dtype=np.int64)
                got = np.bincount(which[doc] * BUCKETS + bucket, n, len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, row in zip(names, got):
                    total[name] = total.get(name, 0) + row
        for name, row in total.items():
            b = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(b), pa.string()), pa.array(b, pa.int32()), pa.array(row[b].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang").mapInArrow(tidy(count), "lang string, bucket int, n long")
    sums = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows a language at most
    langs = sorted(set(sums.column(0).to_pylist()))
    counts = np.full((len(langs), BUCKETS), 0.1)
    if langs:
        at = {x: i for i, x in enumerate(langs)}
        np.add.at(counts, ([at[x] for x in sums.column(0).to_pylist()], sums.column(1).to_numpy()), sums.column(2).to_numpy())
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def infer(doc: np.ndarray, bucket: np.ndarray, n: np.ndarray, n_docs: int, logp: np.ndarray, rounds: int = 8):
    """For each document the languages' proportions (0 for those dropped), its trigrams, and the fit."""
    size = np.bincount(doc, n, n_docs)
    width = logp.shape[1]
    shares, fits = np.zeros((n_docs, width)), np.full(n_docs, np.nan)
    has = np.flatnonzero(size)
    if not len(has):
        return shares, size, fits
    starts = np.searchsorted(doc, has)
    row = np.searchsorted(has, doc)
    q = np.exp(logp)[bucket]
    total = size[has]
    penalty = 0.5 * np.log(total)

    def em(pi, times):
        for _ in range(times):
            w = q * pi[row]
            w *= (n / w.sum(1))[:, None]
            pi = np.add.reduceat(w, starts) / total[:, None]
        return pi, np.add.reduceat(n * np.log((q * pi[row]).sum(1)), starts) / 3  # trigrams overlap

    live = np.ones((len(has), width), bool)
    pi, fit = em(np.full(live.shape, 1.0 / width), 2 * rounds)

    def without(dropped):
        """Try sets without the dropped languages; the documents for which that is no worse."""
        nonlocal live, pi, fit
        trial = live & ~dropped
        start = np.where(trial, pi + 1e-6, 0.0)
        new, new_fit = em(start / start.sum(1, keepdims=True), rounds)
        better = dropped.any(1) & (new_fit >= fit - penalty * dropped.sum(1))
        live = np.where(better[:, None], trial, live)
        pi = np.where(better[:, None], new, pi)
        fit = np.where(better, new_fit, fit)
        return better

    if width > 2:
        little = pi * total[:, None] / 3 < penalty[:, None]
        little[np.arange(len(has)), pi.argmax(1)] = False
        without(little)
    open_ = live.sum(1) > 1
    while open_.any():
        weakest = np.zeros_like(live)
        weakest[np.arange(len(has)), np.where(live, pi, 2.0).argmin(1)] = open_
        open_ = without(weakest) & (live.sum(1) > 1)
    shares[has] = np.where(live, pi, 0.0)
    fits[has] = 3 * fit / total + np.log(BUCKETS)
    return shares, size, fits


MADE = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.StringType()), T.StructField("fit", T.DoubleType())]


def _inferred(column: pa.Array, langs: list[str], logp: np.ndarray):
    """(shares, trigrams, fits) of runs of texts."""
    for _, _, texts in text_chunks(column, max(1, len(langs))):
        if langs:
            doc, bucket, n = trigrams(texts)
            yield infer(doc, bucket, n, len(texts), logp)
        else:
            yield np.zeros((len(texts), 0)), np.zeros(len(texts)), np.full(len(texts), np.nan)


def _broadcast(docs: DataFrame, model):
    return docs.sparkSession.sparkContext.broadcast((model[0], np.ascontiguousarray(model[1].T, dtype=np.float64)))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred, score, languages ('en:0.91,fr:0.09', largest first) and fit."""
    docs = docs.drop(*[c for c in docs.columns if c in {f.name for f in MADE}])
    shared = _broadcast(docs, model)
    at = docs.columns.index("text")

    def run(batches):
        langs, logp = shared.value
        for batch in batches:
            preds, scores, sets, fits = [], [], [], []
            for shares, size, fit in _inferred(batch.column(at), langs, logp):
                for i in range(len(size)):
                    if not size[i]:
                        preds.append("und"), scores.append(0.0), sets.append(""), fits.append(None)
                        continue
                    order = sorted((-shares[i, c], langs[c]) for c in np.flatnonzero(shares[i]))
                    preds.append(order[0][1])
                    scores.append(min(1.0, -order[0][0] * size[i] / (size[i] + 1)))
                    sets.append(",".join(f"{x}:{-s:.2f}" for s, x in order))
                    fits.append(float(fit[i]))
            made = [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string()), pa.array(fits, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *(f.name for f in MADE)])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *MADE]))


def keep_known(docs: DataFrame, model: tuple[list[str], np.ndarray], least_fit: float = -1.0) -> DataFrame:
    """The rows of ``docs`` in a learned language: those that have a letter and whose fit reaches ``least_fit``."""
    shared = _broadcast(docs, model)
    at = docs.columns.index("text")

    def run(batches):
        langs, logp = shared.value
        for batch in batches:
            keep = [(size > 0) & (np.nan_to_num(fit, nan=-np.inf) >= least_fit) for _, size, fit in _inferred(batch.column(at), langs, logp)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(tidy(run), docs.schema)


def fold(column: str, parts: int, rest: int) -> F.Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts == rest


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    model = learn(docs.where(~fold("doc_id", 4, 2)).select("text", "lang"))
    rows = docs.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "languages", "fit")
