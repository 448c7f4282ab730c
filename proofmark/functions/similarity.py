"""Similarity by longest common subsequence, and word differences, as Arrow functions.

Each takes null for rows that need no score, so a caller's ``when`` really saves the work, and
scores each distinct pair of a batch once.
"""

from __future__ import annotations

import difflib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import DIFF


def char_masks(text: str) -> dict[str, int]:
    """For each character the set of its positions, as bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _lcs(masks: dict[str, int], n: int, other: str) -> int:
    full = (1 << n) - 1
    v = full
    for c in other:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    return _lcs(char_masks(a), len(a), b)


def _lcs_of_prefixes(masks: dict[str, int], n: int, other: str) -> list[int]:
    """The same with every non-empty prefix of ``other``, in one pass."""
    full = (1 << n) - 1
    v, out = full, []
    for c in other:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
        out.append(n - v.bit_count())
    return out


def ratio(a: str, b: str) -> float:
    """0..100: twice the common subsequence over both lengths; two empty strings are equal."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def _best_window(short: str, long: str, enough: float) -> float:
    """The best ratio of ``short`` with the windows of ``long``, edges included; any value from ``enough`` up ends it.

    A step of a window changes the common subsequence by one at most, so after a window that is k short of the
    best so far the next k - 1 cannot beat it and are left out.
    """
    n, m = len(short), len(long)
    masks = char_masks(short)
    best = 0.0
    for text, pattern in ((long[: n - 1], masks), (long[::-1][: n - 1], char_masks(short[::-1]))):
        for size, common in enumerate(_lcs_of_prefixes(pattern, n, text), 1):
            best = max(best, 200.0 * common / (n + size))
    for at in range(0, m - n + 1, max(1, n // 4)):  # a coarse pass finds most of the best, so that the fine one can leap
        if best >= enough:
            return best
        best = max(best, 100.0 * _lcs(masks, n, long[at : at + n]) / n)
    at = 0
    while at <= m - n and best < enough:
        common = _lcs(masks, n, long[at : at + n])
        best = max(best, 100.0 * common / n)
        at += max(1, int(best * n / 100.0 + 1e-9) + 1 - common)
    return best


def partial_ratio(a: str, b: str, enough: float = 100.0) -> float:
    """The best ratio of the shorter string against the windows of the longer, edge windows included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    best = _best_window(a, b, enough)
    return best if len(a) < len(b) or best >= enough else max(best, _best_window(b, a, enough))


def support(quoted: str, blob: str) -> float:
    """0..1: how far the blob holds the quote; a quote longer than the blob cannot be contained and is compared whole."""
    if not quoted or not blob:
        return 0.0
    return (ratio if len(quoted) > len(blob) else partial_ratio)(quoted, blob) / 100.0


def supports(quoted: str, blob: str, floor: float) -> bool:
    """Whether ``support`` reaches the floor, from bounds where they tell."""
    if not quoted or not blob:
        return floor <= 0.0
    if quoted in blob:
        return floor <= 1.0
    n, m = len(quoted), len(blob)
    shared = sum((Counter(quoted) & Counter(blob)).values())  # no subsequence is longer
    if 2 * shared < floor * (n + (m if n > m else shared)):
        return False
    return (ratio(quoted, blob) if n > m else partial_ratio(quoted, blob, 100.0 * floor)) / 100.0 >= floor


def word_diff(expected: str, found: str) -> list[dict[str, str]]:
    """Word edits between two texts, compared without case, shown as printed: what lies between the blocks they share."""
    left, right = expected.split(), found.split()
    shared = difflib.SequenceMatcher(a=" ".join(left).casefold().split(), b=" ".join(right).casefold().split(), autojunk=False)
    edits, done = [], (0, 0)
    for block in shared.get_matching_blocks():  # the last one is empty and ends both texts
        gone, new = left[done[0] : block.a], right[done[1] : block.b]
        if gone or new:
            edits.append({"op": "replace" if gone and new else "delete" if gone else "insert", "expected": " ".join(gone), "found": " ".join(new)})
        done = block.a + block.size, block.b + block.size
    return edits


def _each_pair(function, a: pa.Array, b: pa.Array) -> list:
    known: dict[tuple, object] = {}
    out = []
    for pair in zip(a.to_pylist(), b.to_pylist()):
        if None in pair:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = function(*pair)
        out.append(known[pair])
    return out


@F.arrow_udf(T.DoubleType())
def indel_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(_each_pair(ratio, a, b), pa.float64())


@F.arrow_udf(T.DoubleType())
def _supports(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(_each_pair(support, a, b), pa.float64())


def field_support(quoted: Column | str, blob: Column | str) -> Column:
    """0..1; only quotes that the text does not hold as they are reach the similarity function."""
    quoted, blob = (F.col(x) if isinstance(x, str) else x for x in (quoted, blob))
    held = (quoted != "") & F.contains(blob, quoted)
    return F.when(held, 1.0).otherwise(_supports(F.when(~held, quoted), blob))


def lacks_support(floor: float):
    """An Arrow function of (quote, text): whether the text's support of the quote is below the floor."""
    @F.arrow_udf(T.BooleanType())
    def lacks(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(_each_pair(lambda x, y: not supports(x, y, floor), a, b), pa.bool_())
    return lacks


@F.arrow_udf(DIFF)
def word_edits(expected: pa.Array, found: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("op", pa.string()), ("expected", pa.string()), ("found", pa.string())]))
    return pa.array(_each_pair(word_diff, expected, found), kind)


EDITS = "pos int, op string, expected string, found string"


@F.udtf(returnType=EDITS, useArrow=True)
class WordDiff:
    """Table function of (expected, found): a row a word edit, numbered from 0; none for null."""

    def eval(self, expected: str, found: str):
        if expected is not None and found is not None:
            for i, e in enumerate(word_diff(expected, found)):
                yield i, e["op"], e["expected"], e["found"]


def edit_rows(rows: DataFrame, expected: str, found: str, *keep: str) -> DataFrame:
    """(*keep, pos, op, expected, found): the word edits between two columns as rows, by a lateral join; equal texts never reach the function."""
    spark = rows.sparkSession
    spark.udtf.register("proofmark_word_diff", WordDiff)
    differ = rows.where(F.col(expected) != F.col(found))
    names = "".join(f"r.`{c}`, " for c in keep)
    return spark.sql(f"SELECT {names}e.* FROM {{rows}} r, LATERAL proofmark_word_diff(r.`{expected}`, r.`{found}`) e", rows=differ)
