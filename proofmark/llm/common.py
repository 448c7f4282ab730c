"""Helpers shared by the operators: carried columns, joins that split hot keys, packed shuffles, vectorised words.

Words are the runs of ``[^\\x20\\x09-\\x0D]`` in the UTF-8 bytes of a text.  They are hashed
to 64 bits with a polynomial over random byte values, evaluated with prefix sums, so a whole
chunk of documents is tokenised and hashed by a few numpy passes and no Python loop.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import broadcast_bytes, materialize, plan_bytes, remove, scope, shared_dir, small, spread  # noqa: F401

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass handles; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Keys that a join sends to every task: no more can hold a thousandth of all rows each.
HOT_KEYS = 1000


# ---------------------------------------------------------------- caller's columns and joins

def carried(docs: DataFrame, *columns) -> DataFrame:
    """``docs`` as one struct column ``row`` beside the given columns: no name of a caller's can clash with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def unpacked_row(rows: DataFrame, columns: list[str], **made) -> list:
    """The carried columns again; ``made`` replaces some of them."""
    return [made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in columns]


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with a table of one row a key; ``left`` should be cheap to read twice, and no key may be null.

    A table within the session's bound is broadcast.  Otherwise keys that hold over a thousandth of the rows, which can be no more than a
    thousand, are joined by broadcast and the rest by a shuffle, so that no key meets in one task.
    """
    if plan_bytes(right) <= broadcast_bytes(right.sparkSession):
        return left.join(F.broadcast(right), keys, how)
    counts = left.groupBy(*keys).agg(F.count("*").alias("__n"))
    got = counts.agg(F.sum("__n").alias("total"), F.max("__n").alias("most")).first()
    limit = max((got["total"] or 0) // HOT_KEYS, 1)
    if (got["most"] or 0) <= limit:
        return left.join(right, keys, how)
    hot = counts.where(F.col("__n") > limit).select(*keys)
    few = left.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), keys, "left_semi")), keys, how)
    return few.unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how))


# ---------------------------------------------------------------- memory of workers

def tidy(run):
    """``run`` that gives freed memory back to the system when a task ends: a worker that waits for the next one stays small."""
    def inner(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
    return inner


# ---------------------------------------------------------------- packed shuffles

#: Bytes of packed rows that a task may get.
TASK_BYTES = 64 << 20


def by_bucket(rows: DataFrame, size: int = 0) -> DataFrame:
    """Rows of (bucket, ...) with each bucket in one task, bucket after bucket; ``size`` estimates their bytes.

    The number of tasks follows the size where the session's number of shuffle partitions would give larger ones.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-size // TASK_BYTES)
    dealt = rows.repartition(wanted, "bucket") if wanted > parts else rows.repartition("bucket")
    return dealt.sortWithinPartitions("bucket")


def bucket_count(spark, size: int = 0) -> int:
    """Buckets for packed rows of about so many bytes: several a task, so that one is a part of it."""
    return 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def buckets(batches) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(bucket, its other columns) of sorted (bucket, ...) rows, one bucket in memory at a time."""
    now, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[0] != now:
                if now is not None:
                    yield now, held
                now, held = row[0], [[] for _ in row[1:]]
            for h, x in zip(held, row[1:]):
                h.append(x)
    if now is not None:
        yield now, held


# ---------------------------------------------------------------- words

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
#: For words without punctuation: runs of ASCII letters, digits and bytes above 127.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
_BASE = 0x9E3779B97F4A7C15
_COEF = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow["up"]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _pow[name] = out
    return _pow["up"], _pow["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, table: np.ndarray = _WORD):
    """Hash every word (run of the bytes of ``table``) of some documents.

    ``data`` are their UTF-8 bytes, document ``i`` at ``offsets[i]:offsets[i+1]``.  Returns the
    hashes, the index of each document's first word (one more at the end), and the words' byte
    starts and ends.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    word = table[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = word[0]
    edge[-1] = word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    joined = np.unique(inner[word[inner - 1] & word[inner]])  # a word touches the next document's first
    at = np.flatnonzero(edge)
    if len(joined):
        at = np.sort(np.concatenate([at, joined, joined]), kind="stable")
    starts, ends = at[0::2], at[1::2]
    up, down = _powers(len(data))
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, offsets), starts, ends


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words (document borders are the caller's business)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _COEF[0]
    for j in range(1, k):
        out += words[j : n + j] * _COEF[j]
    return mix64(out + np.uint64(k))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if offs else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes together."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_chunks(batch: pa.RecordBatch, column: str = "text", lower: bool = False):
    """(lo, hi, word hashes, first word of each document) for the chunks of a batch."""
    data, offsets = text_bytes(batch.column(column))
    for lo, hi in chunks(offsets):
        part = offsets[lo : hi + 1]
        hashes, first, _, _ = hash_words(data[part[0] : part[-1]], part - part[0], lower)
        yield lo, hi, hashes, first


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
