"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

Texts and templates become lower-cased words without punctuation.  Hashes of ``GRAM`` words are winnowed
over windows of ``WINDOW``, in texts and templates alike, so any ``GRAM + WINDOW - 1`` words in common leave a common
fingerprint.  An inverted index of the templates' fingerprints (fixed templates, so of bounded size) gives
candidates with a diagonal; the template is aligned with the text in a band about it, all cells of a template word at once, and
the share of template words matched and the span in the text are reported.

A notice of up to ``SHORT`` words may be changed in every other place and still match, so its grams are all indexed and
all of the text's are looked up, of ``gram_length`` words each: with no more than a fifth of its words replaced or left out, one stays whole.
In a longer template the same holds as long as somewhere ``GRAM + WINDOW - 1`` words in a row are unchanged.

Templates are whole licence texts and the headers and notices that name one (``license_texts``): MIT, BSD with two and
three clauses, ISC, zlib, Unlicense, Boost, Apache-2.0, MPL-2.0, GPL-2.0 and 3.0, LGPL-2.1 and 3.0, the AGPL-3.0 header,
Artistic-1.0, CC0-1.0 and notices of CC BY, BY-SA and BY-NC; others give no row.  Of matches that overlap by more than
half, the one with the most matched words stays, then the one with the larger coverage, which tells licences that contain each other apart.

Rows never move: there is no shuffle, and a hot source or passage costs only its own texts.

Defined results: null and empty texts match nothing; a null doc_id is kept; copies and repeated rows get equal
results; each template is reported once per place; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil
from pathlib import Path

import numpy as np
import pyarrow as pa
import yaml
from pyspark.sql import DataFrame

from .common import ALNUM, chunks, gram_hashes, hash_words, spread, text_bytes

GRAM, WINDOW = 3, 4
SHORT = 24
#: Share of a template's words that has to be met, in order.
COVERAGE = 0.8
TEXTS = Path(__file__).parent / "license_texts"


@lru_cache(maxsize=1)
def templates() -> dict[str, str]:
    """Name -> text of everything that is looked for."""
    whole = {p.stem: p.read_text(encoding="utf-8") for p in sorted(TEXTS.glob("*.txt"))}
    return yaml.safe_load((TEXTS / "short.yaml").read_text(encoding="utf-8")) | whole


def words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return hash_words(data, np.array([0, len(data)]), True, ALNUM)[0]


def gram_length(n: int, coverage: float = COVERAGE) -> int:
    """Words of a gram that a template of n words keeps whole if a share of 1 - ``coverage`` is replaced or left out."""
    lost = int((1 - coverage) * n + 1e-9)
    return min(GRAM, max(1, ceil((n - lost) / (lost + 1))))


def band_of(n: int) -> int:
    """How far an alignment may leave the diagonal of its fingerprint, either way."""
    return 4 + n // 10


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions that hold the minimum of some window, ties included; all of them if there are fewer than a window."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.arange(len(grams))
    low = grams[:n].copy()
    for j in range(1, window):
        np.minimum(low, grams[j : n + j], out=low)
    picked = np.zeros(len(grams), bool)
    for j in range(window):
        picked[j : n + j] |= grams[j : n + j] == low
    return np.flatnonzero(picked)


class Index:
    """Fingerprints of templates: (length, winnowed) -> sorted hashes with template and position."""

    def __init__(self, texts: dict[str, str], coverage: float = COVERAGE):
        self.names, self.coverage = list(texts), coverage
        self.words = [words(t) for t in texts.values()]
        found: dict[tuple[int, bool], list] = {}
        for t, w in enumerate(self.words):
            k = GRAM if len(w) > SHORT else gram_length(len(w), coverage)
            grams = gram_hashes(w, k)
            at = winnow(grams) if len(w) > SHORT else np.arange(len(grams))
            found.setdefault((k, len(w) > SHORT), []).append(np.array([grams[at], np.full(len(at), t, np.uint64), at.astype(np.uint64)]))
        self.tables = []
        for (k, winnowed), parts in found.items():
            rows = np.concatenate(parts, 1)
            rows = rows[:, np.argsort(rows[0], kind="stable")]
            known = np.zeros(1 << 16, bool)
            known[(rows[0] >> np.uint64(48)).astype(np.int64)] = True
            self.tables.append((k, winnowed, rows[0], rows[1].astype(np.int64), rows[2].astype(np.int64), known))

    def candidates(self, w: np.ndarray) -> np.ndarray:
        """(position, template, diagonal) of each fingerprint that the words share with a template."""
        out = []
        for k, winnowed, hashes, owner, place, known in self.tables:
            grams = gram_hashes(w, k)
            at = winnow(grams) if winnowed else np.arange(len(grams))
            at = at[known[(grams[at] >> np.uint64(48)).astype(np.int64)]]
            lo, hi = np.searchsorted(hashes, grams[at]), np.searchsorted(hashes, grams[at], side="right")
            n = hi - lo
            row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            p = np.repeat(at, n)
            out.append(np.stack([p, owner[row], p - place[row]]))
        return np.concatenate(out, 1)


_FIELD = 20
_LOW = np.int64((1 << _FIELD) - 1)


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, last + 1) of the best alignment within ``band`` of a diagonal (text - template position).

    A cell is one number: the words matched, then the first of them, then the last counted backwards, so the largest
    number is the alignment with most matches, the latest start and the earliest end.
    """
    lead, n, width = diagonal - band, len(template), 2 * band + 1
    places = np.arange(n + width, dtype=np.int64)  # from ``lead`` on
    inside = places[max(0, -lead) : max(0, min(n + width, len(text) - lead))]
    if not len(inside):
        return 0, 0, 0
    near, real = np.zeros(n + width, np.uint64), np.zeros(n + width, bool)
    near[inside], real[inside] = text[inside + lead], True
    best = np.zeros(width, np.int64)
    for i in range(n):
        here = slice(i, i + width)
        start = np.where(best > 0, best & ~_LOW, places[here] << _FIELD)
        row = np.where(real[here] & (near[here] == template[i]), start + (np.int64(1) << 2 * _FIELD) + (_LOW - places[here]), best)
        np.maximum(row[:-1], best[1:], out=row[:-1])  # a template word has no partner
        best = np.maximum.accumulate(row)  # a text word has no partner
    top = int(best.max())
    if not top:
        return 0, 0, 0
    return top >> 2 * _FIELD, lead + (top >> _FIELD & int(_LOW)), lead + int(_LOW) - (top & int(_LOW)) + 1


def matches(index: Index, w: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(template, matched, first, last + 1) of every place where a template is covered, by template and place."""
    hits = index.candidates(w)
    out = []
    for t in np.unique(hits[1]):
        template, n = index.words[t], len(index.words[t])
        band = band_of(n)
        done = None
        for g in np.unique(hits[2][hits[1] == t]).tolist():
            if done is not None and g - done <= band:
                continue
            done = g
            near = w[max(0, g - band // 2) : max(0, g + 2 * band + n)]
            if np.isin(template, near).sum() < index.coverage * n:
                continue  # no alignment matches more words than occur at all
            m, a, b = align(template, w, g + band // 2, band)
            if m >= index.coverage * n and not any(x[0] == t and a < x[3] and x[2] < b for x in out):
                out.append((int(t), m, a, b))
    return out


def settle(index: Index, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The matches that stay where some overlap: most words first, then the larger coverage."""
    kept: list[tuple[int, int, int, int]] = []
    for x in sorted(found, key=lambda x: (-x[1], -x[1] / len(index.words[x[0]]), x[2], x[0])):
        if not any(2 * (min(x[3], y[3]) - max(x[2], y[2])) > x[3] - x[2] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[2], x[0]))


def scan(docs: DataFrame, texts: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, matched, start, stop, matched_text) with spans in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(texts or templates(), coverage))
    schema = docs.select("doc_id").schema
    for name, kind in (("license", "string"), ("coverage", "double"), ("matched", "integer"), ("start", "integer"), ("stop", "integer"), ("matched_text", "string")):
        schema = schema.add(name, kind)
    kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def run(batches):
        index = shared.value
        for batch in batches:
            ids, rows = batch.column(0), []
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                own = data[part[0] : part[-1]]
                w, first, starts, ends = hash_words(own, part - part[0], True, ALNUM)
                known = np.unique(np.searchsorted(first, index.candidates(w)[0], side="right") - 1)  # those across two texts fall out below
                for d in known.tolist():
                    a, b = first[d], first[d + 1]
                    for t, m, x, y in settle(index, matches(index, w[a:b])):
                        base = part[d] - part[0]
                        s, e = int(starts[a + x]), int(ends[a + y - 1])
                        at = len(own[base:s].tobytes().decode(errors="ignore"))
                        matched = own[s:e].tobytes().decode()
                        rows.append((lo + d, index.names[t], m / len(index.words[t]), m, at, at + len(matched), matched))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0])), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return scan(docs)
