"""Which texts hold which references, on letters and digits alone.

Every reference has an anchor, a hash of some of its characters.  A text is hashed at every place in a few numpy
passes; only where a place has a known anchor are characters compared.  So the work follows the texts' length and the matches,
not texts times references.  References are sent to the tasks in blocks of bounded size; each block is
one more pass over the texts, which are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import squash

#: Characters of an anchor; shorter references are hashed whole.
ANCHOR = 16
#: Bytes of references that are sent at once, and of texts that one numpy pass handles.
BLOCK_BYTES, CHUNK_BYTES = 16 << 20, 1 << 21
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on."""
    n = max(0, len(data) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _BASE
        out += data[j : n + j]
    out ^= out >> np.uint64(31)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


class Anchors:
    """The anchors of some references, by the number of characters hashed."""

    def __init__(self, targets: list[bytes]):
        self.targets = targets
        groups: dict[int, list[tuple[int, int, int]]] = {}
        for i, t in enumerate(targets):
            k = min(ANCHOR, len(t))
            h = gram_hashes(np.frombuffer(t, np.uint8), k)
            at = int(h.argmin())  # any place would do; the least hash spreads references that begin alike
            groups.setdefault(k, []).append((int(h[at]), i, at))
        self.groups = []
        for k, rows in groups.items():
            rows.sort()
            hashes = np.array([r[0] for r in rows], np.uint64)
            known = np.zeros(1 << 16, bool)
            known[(hashes >> np.uint64(48)).astype(np.int64)] = True
            self.groups.append((k, hashes, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), known))

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """(text, reference) for each text, ``offsets`` apart, that holds a reference."""
        whole, found = data.tobytes(), set()
        for k, hashes, refs, places, known in self.groups:
            grams = gram_hashes(data, k)
            at = np.flatnonzero(known[(grams >> np.uint64(48)).astype(np.int64)])
            first = np.searchsorted(hashes, grams[at])
            last = np.searchsorted(hashes, grams[at], side="right")
            for p, a, b in zip(at[last > first].tolist(), first[last > first].tolist(), last[last > first].tolist()):
                text = int(np.searchsorted(offsets, p, side="right")) - 1
                for r in range(a, b):
                    start = p - int(places[r])
                    if (text, refs[r]) not in found and start >= offsets[text] and whole.startswith(self.targets[refs[r]], start) and start + len(self.targets[refs[r]]) <= offsets[text + 1]:
                        found.add((text, refs[r]))
        return sorted((int(t), int(r)) for t, r in found)


def _chunks(column: pa.Array):
    """(first row, bytes, offsets) of runs of texts."""
    texts = column.cast(pa.binary()).fill_null(b"").to_pylist()
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES or i == len(texts) - 1:
            part = texts[lo : i + 1]
            yield lo, np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)])
            lo, size = i + 1, 0


def contained(texts: DataFrame, references: DataFrame, text_key: str, reference_key: str) -> DataFrame:
    """(text_key, reference_key) of the texts (key, text) that hold a reference (key, text); empty references are in none."""
    spark = texts.sparkSession
    targets = references.select(reference_key, squash(F.col("text")).alias("target")).where("target <> ''")
    size = targets.agg(F.sum(F.length("target") + 64).alias("n")).first()["n"] or 0
    blocks = -(-size // BLOCK_BYTES)
    read = texts.select(text_key, squash(F.col("text")).alias("read")).where("read IS NOT NULL")
    schema = texts.select(text_key).schema.add(references.schema[reference_key])
    out = None
    for i in range(blocks):
        rows = targets.where(F.pmod(F.xxhash64("target"), F.lit(blocks)) == i).toArrow()  # BLOCK_BYTES on average
        shared = spark.sparkContext.broadcast((Anchors([x.encode() for x in rows.column(1).to_pylist()]), rows.column(0).combine_chunks()))

        def run(batches, shared=shared):
            anchors, keys = shared.value
            for batch in batches:
                got = [(lo + t, r) for lo, data, offsets in _chunks(batch.column(1)) for t, r in anchors.find(data, offsets)]
                if got:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([g[0] for g in got])), keys.take(pa.array([g[1] for g in got]))], names=schema.names)

        part = read.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out
