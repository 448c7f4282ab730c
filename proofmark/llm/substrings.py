"""Substring deduplication with an FM-index per shard.

A window is ``WINDOW`` consecutive words of a document.  Words covered by a window whose word sequence also
starts earlier (smaller doc_id, or same document and earlier start) are removed.

Sharding keeps equal windows together without comparing every document to every shard.  Of the
``GRAM``-word hashes in a window the smallest, leftmost first, is its anchor; equal windows have
equal anchors.  Anchors that occur once in all documents cannot belong to a repeated window, and only
the other anchors' windows go on, as segments (the words of consecutive windows with one anchor), to
the shard of their anchor.  Equal segments of one task travel as one, with the first place; the task's others
start later, so they are repeats at once.  An anchor that occurs more than ``HOT`` times sends its
windows one by one, sharded by their own content, and a task that meets it so often knows that by itself, so a passage in a third of all
documents does not fill one shard.

Each shard builds indexes over the distinct segments of its anchors: suffixes are sorted to the depth of a window, the
Burrows-Wheeler transform is kept in a wavelet matrix of packed bits, and the suffix array is dropped.  What stays
of it is a bit a suffix that marks where another window begins, and for each distinct window the earliest place where it
starts.  Then all the shard's segments are streamed: backward search computes, from every end position,
the matching statistic up to the threshold, and where it reaches it, the suffix interval gives that earliest place;
a window that starts later is a repeat.  (An index sorted to depth k answers backward searches of up to k words exactly.)
Words are compared by 64-bit hashes.

Defined results: null and empty texts have no words; a null doc_id comes last; rows that repeat an id and text are
one document and get one result; rows that share an id only are ordered by
start, then by text checksum; an empty table gives no rows; extra columns pass through ``dedup`` whatever their names, unless
named as one of the columns made here, which replace them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, buckets, by_bucket, chunks, gram_hashes, hash_words, materialize, mix64, remove, shared_dir, small, spread, text_bytes

WINDOW = 20
GRAM = 8
HOT = 100
#: Bytes of segments that a task holds before it sends them on.
HELD = 24 << 20
#: Words of an index.
INDEXED = 1_000_000
_NULL_ID = np.iinfo(np.int64).max


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, anchor) of each run of windows with one anchor; starts and ends count windows
    and words from the chunk's first word; and the hashes of all grams."""
    none = np.zeros(0, np.int64)
    grams = gram_hashes(words, GRAM)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return none, none, none, grams
    low, at = grams[:n].copy(), np.zeros(n, np.int32)
    for j in range(1, WINDOW - GRAM + 1):
        less = grams[j : n + j] < low
        np.copyto(low, grams[j : n + j], where=less)
        at[less] = j
    count = np.maximum(np.diff(first) - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    anchor = start + at[start]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else none
    end = start[np.r_[new[1:] - 1, len(doc) - 1]] + 1 if len(doc) else none
    return doc[new], start[new], end, anchor[new], grams


ROW = np.dtype([("hash", "<u8"), ("id", "<i8"), ("pos", "<i4"), ("check", "<u4")])
SEGMENT = np.dtype([("hash", "<u8"), ("id", "<i8"), ("pos", "<i4"), ("check", "<u4"), ("words", "<i4")])


def _ids(column) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)


def _split(bucket: np.ndarray):
    """(bucket, its positions) in groups."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else []
    for a, b in zip(cut, [*cut[1:], len(order)]):
        yield int(bucket[order[a]]), order[a:b]


def emit_anchors(n_buckets: int, most: int):
    """(bucket, rows, known): where each anchor occurs.

    Of an anchor that a batch holds more than ``most`` times one place more is sent, enough to tell that it is hot; the
    others are known already and are dealt out by document.
    """
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            ids, checks = _ids(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
            parts = []
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                w, first, _, _ = hash_words(data[part[0] : part[-1]], part - part[0])
                doc, _, _, anchor, grams = anchors(w, first) if len(w) >= WINDOW else (np.zeros(0, np.int64),) * 4 + (None,)
                if len(doc):
                    rows = np.empty(len(doc), ROW)
                    rows["hash"], rows["id"], rows["pos"], rows["check"] = grams[anchor], ids[lo + doc], np.arange(len(doc)) - np.searchsorted(doc, doc), checks[lo + doc]
                    parts.append(rows)
            if parts:
                rows = np.concatenate(parts)
                rows = rows[np.argsort(rows["hash"], kind="stable")]
                first = np.flatnonzero(np.r_[True, rows["hash"][1:] != rows["hash"][:-1]])
                place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
                known, rows = rows[place > most], rows[place <= most]
                sent = {b: rows[at].tobytes() for b, at in _split((rows["hash"] % np.uint64(n_buckets)).astype(np.int32))}
                told = {b: known[at].tobytes() for b, at in _split((mix64(known["id"].view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32))}
                both = sorted({*sent, *told})
                yield pa.RecordBatch.from_arrays([pa.array(both, pa.int32()), pa.array([sent.get(b, b"") for b in both], pa.binary()), pa.array([told.get(b, b"") for b in both], pa.binary())], names=["bucket", "rows", "known"])
    return run


def repeated_anchors(most: int):
    """(id, check, pos) of anchors that occur more than once, numbered within their document; the pos of one that occurs more than ``most`` times is -1 - pos."""
    def out(got, hot):
        pos = np.where(hot, -1 - got["pos"], got["pos"]).astype(np.int32)
        for at in range(0, len(got), 100_000):
            cut = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got["id"][cut])), pa.array(got["check"][cut].astype(np.int64)), pa.array(pos[cut])], names=["id", "check", "pos"])

    def run(batches):
        for _, (blobs, known) in buckets(batches):
            told = np.frombuffer(b"".join(known), ROW)
            yield from out(told, np.ones(len(told), bool))
            rows = np.frombuffer(b"".join(blobs), ROW)
            rows = rows[np.argsort(rows["hash"], kind="stable")]
            first = np.flatnonzero(np.r_[True, rows["hash"][1:] != rows["hash"][:-1]]) if len(rows) else np.zeros(0, np.int64)
            n = np.diff(np.r_[first, len(rows)])
            n = np.repeat(n, n)
            yield from out(rows[n > 1], n[n > 1] > most)
    return run


_HOT_RANGE = 1 << 62


def _runs(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers as ranges, first << 32 | last."""
    if not len(x):
        return np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(x) != 1)
    return x[np.r_[0, cut + 1]] << 32 | x[np.r_[cut, len(x) - 1]]


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans, start << 32 | end, merged where they overlap or touch."""
    spans = np.sort(spans)
    start, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new] << 32 | end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]


def _each_list(function):
    """Apply a function to the third column's list of each row; keeps what is joined to the documents small."""
    def run(batches):
        for batch in batches:
            column = batch.column(2)
            values, at = column.values.to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy()
            lists = [function(values[a:b]) for a, b in zip(at, at[1:])]
            out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in lists])], pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], names=batch.schema.names)
    return run


def mark_ranges(pos: np.ndarray) -> np.ndarray:
    pos = np.sort(pos)
    return np.r_[_runs(pos[pos >= 0]), _runs(np.sort(-1 - pos[pos < 0])) | _HOT_RANGE]


def segment_hash(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each run of ``lengths`` words."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    starts = np.cumsum(lengths) - lengths
    place = (np.arange(len(words)) - np.repeat(starts, lengths)).astype(np.uint64)
    return mix64(np.add.reduceat(mix64(words + place * np.uint64(0x9E3779B97F4A7C15)), starts) + lengths.astype(np.uint64))


def first_places(heads: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal contents the index of the earliest segment, and the indices of those that start later."""
    order = np.lexsort((heads["check"], heads["pos"], heads["id"], content))
    new = np.r_[True, content[order][1:] != content[order][:-1]]
    lead = order[np.flatnonzero(new)]
    own = lead[np.cumsum(new) - 1]
    place = heads[["id", "pos", "check"]]
    later = place[order] != place[own]
    return lead, order[later]


def take_segments(heads: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = heads["words"].astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    n = lengths[at]
    index = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return heads[at], words[index]


def _covered(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, a, 1)
    np.add.at(step, b, -1)
    return np.cumsum(step)[:n] > 0


def emit_segments(n_buckets: int):
    """(bucket, heads, words, repeats): segments of repeated anchors, and places already known to repeat."""
    def flush(heads, words):
        heads, words = np.concatenate(heads), np.concatenate(words)
        lead, later = first_places(heads, segment_hash(words, heads["words"].astype(np.int64)))
        known = heads[later]
        bucket = (heads["hash"][lead] % np.uint64(n_buckets)).astype(np.int32)
        got = {b: take_segments(heads, words, lead[at]) for b, at in _split(bucket)}
        more = {b: known[at] for b, at in _split((mix64(known["id"].view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32))}
        rows = [(b, *(x.tobytes() for x in got.get(b, (np.zeros(0, SEGMENT), np.zeros(0, np.uint64)))), more.get(b, np.zeros(0, SEGMENT)).tobytes()) for b in sorted({*got, *more})]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "heads", "words", "repeats"])

    def run(batches):
        heads, words, held = [], [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            ids, checks = _ids(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
            listed = batch.column(3)
            marks, mark_at = listed.values.to_numpy(zero_copy_only=False), listed.offsets.to_numpy()
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                w, first, _, _ = hash_words(data[part[0] : part[-1]], part - part[0])
                if len(w) < WINDOW:
                    continue
                doc, start, end, anchor, grams = anchors(w, first)
                r = marks[mark_at[lo] : mark_at[hi]].astype(np.int64)
                base = np.searchsorted(doc, np.repeat(np.arange(hi - lo), np.diff(mark_at[lo : hi + 1])))
                hot = r >= _HOT_RANGE
                r = r & (_HOT_RANGE - 1)
                whole, single = (_covered(len(doc), (base + (r >> 32))[k], (base + (r & 0xFFFFFFFF) + 1)[k]) for k in (~hot, hot))
                n = (end - start)[single]  # windows of hot anchors, one by one
                a = np.r_[start[whole], np.repeat(start[single] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                b = np.r_[end[whole], np.repeat(start[single] - (np.cumsum(n) - n), n) + np.arange(n.sum()) + 1]
                d = np.r_[doc[whole], np.repeat(doc[single], n)]
                if not len(a):
                    continue
                size = b - a + WINDOW - 1
                index = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
                h = np.empty(len(a), SEGMENT)
                h["id"], h["check"], h["pos"], h["words"] = ids[lo + d], checks[lo + d], a - first[d], size
                k = int(whole.sum())
                h["hash"][:k] = grams[anchor[whole]]
                h["hash"][k:] = segment_hash(w[index][size[:k].sum() :], size[k:])
                heads.append(h)
                words.append(w[index])
                held += words[-1].nbytes + h.nbytes
                if held > HELD:
                    yield flush(heads, words)
                    heads, words, held = [], [], 0
        if heads:
            yield flush(heads, words)
    return run


def _packed(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits in words of 64, and the number of ones before each word."""
    packed = np.packbits(bits, bitorder="little")
    packed = np.frombuffer(np.pad(packed, (0, 8 - len(packed) % 8 + 8)).tobytes()[: (len(bits) // 64 + 1) * 8], np.uint64)
    return packed, np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]].astype(np.int32)


def _ones_before(packed: np.ndarray, counts: np.ndarray, i: np.ndarray) -> np.ndarray:
    block = i >> 6
    mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
    return counts[block] + np.bitwise_count(packed[block] & mask)


class FMIndex:
    """FM-index over integer symbols below ``sigma``, sorted to the depth of a window, with a wavelet matrix.

    ``place`` numbers the text's positions; of each distinct context of ``depth`` symbols the least number is kept.
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int = WINDOW, place: np.ndarray | None = None):
        n = len(text)
        rank = text.astype(np.int64)
        done = 1
        while done < depth:
            step = min(done, depth - done)
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (int(after.max(initial=0)) + 1) + after
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]]) if n else 0
            done += step
        suffixes = np.argsort(rank, kind="stable")
        bwt = text[suffixes - 1]
        new = np.r_[True, np.diff(rank[suffixes]) != 0] if n else np.zeros(0, bool)
        self.starts, self.started = _packed(new)
        if place is not None:  # the least of the places of each distinct context
            self.least = np.minimum.reduceat(place[suffixes], np.flatnonzero(new)).astype(np.int32) if n else place
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]
        self.levels = []
        current = bwt.astype(np.uint32)
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (current >> np.uint32(bit)) & np.uint32(1) == 1
            self.levels.append((bit, *_packed(ones), int(n - ones.sum())))
            current = np.concatenate([current[~ones], current[ones]])
        self.origin = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, packed, counts, zeros in self.levels:
            ones = _ones_before(packed, counts, i)
            i = np.where((symbol >> bit) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i of the transform."""
        return self._descend(symbol, i) - self.origin[symbol]

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, limit: int = WINDOW):
        """For each end position the longest match backwards, up to ``limit``, and its suffix interval.

        The caller sees to it that ``limit`` symbols end there.
        """
        c = text[ends]
        low, high = self.before[c].copy(), self.before[c + 1].copy()
        length = (high > low).astype(np.int32)
        live = np.flatnonzero(high > low)
        for t in range(1, limit):
            c = text[ends[live] - t]
            both = self.rank(np.r_[c, c], np.r_[low[live], high[live]])
            lo, hi = self.before[c] + both[: len(c)], self.before[c] + both[len(c) :]
            ok = hi > lo
            live = live[ok]
            low[live], high[live] = lo[ok], hi[ok]
            length[live] += 1
        return length, low, high


    def earliest(self, low: np.ndarray) -> np.ndarray:
        """The least place of the context of full depth whose interval begins at ``low``."""
        return self.least[_ones_before(self.starts, self.started, low + 1) - 1]


def _window_places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of every window of segments of so many words."""
    windows = lengths - WINDOW + 1
    seg = np.repeat(np.arange(len(lengths)), windows)
    return seg, np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)


def repeats_in_shard(heads: np.ndarray, words: np.ndarray, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first window, windows) of the runs of windows that also start earlier in a segment.

    Equal segments are indexed and searched once, at their first place; what the search finds holds for each of them.
    """
    content = segment_hash(words, heads["words"].astype(np.int64))
    lead, _ = first_places(heads, content)
    of = np.searchsorted(content[lead], content)  # leads are in the order of their contents
    own, text_words = take_segments(heads, words, lead)
    n = own["words"].astype(np.int64)
    _, symbols = np.unique(text_words, return_inverse=True)
    starts = np.cumsum(n + 1) - n - 1
    inside = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(len(text_words))
    text = np.zeros(int(n.sum() + len(n)), np.int64)  # 0 ends each segment
    text[inside] = symbols + 1
    seg, within = _window_places(n)
    at = starts[seg] + within
    order = np.lexsort((own["check"][seg], own["pos"][seg].astype(np.int64) + within, own["id"][seg]))
    place = np.full(len(text), np.iinfo(np.int32).max, np.int64)
    place[at[order]] = np.arange(len(order))
    index = FMIndex(text, int(symbols.max(initial=0)) + 2, WINDOW, place)
    found = np.zeros(len(seg), np.int64)  # the window that starts first of those equal to each
    for a in range(0, len(seg), block):  # stream the segments through the index
        length, low, _ = index.matching_statistics(text, at[a : a + block] + WINDOW - 1)
        found[a : a + block] = order[index.earliest(low)]  # all of them reach the threshold, as they stand in the index
    lead_first = np.cumsum(n - WINDOW + 1) - (n - WINDOW + 1)
    seg, offset = _window_places(heads["words"].astype(np.int64))
    earliest = found[lead_first[of[seg]] + offset]
    e = _of(earliest, n)
    eid, epos, echeck = own["id"][e], own["pos"][e].astype(np.int64) + earliest - lead_first[e], own["check"][e]
    mid, mpos, mcheck = heads["id"][seg], heads["pos"][seg].astype(np.int64) + offset, heads["check"][seg]
    again = (eid < mid) | (eid == mid) & ((epos < mpos) | (epos == mpos) & (echeck < mcheck))
    if not len(seg):
        return seg, seg, seg
    same = seg[1:] == seg[:-1]
    run = np.flatnonzero(again & ~np.r_[False, again[:-1] & same])
    stop = np.flatnonzero(again & ~np.r_[again[1:] & same, False])
    return seg[run], offset[run], stop - run + 1


def _of(window: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The segment of each window, numbered through all segments."""
    return np.searchsorted(np.cumsum(lengths - WINDOW + 1), window, side="right")


def search_shards(batches):
    """(id, check, span): word ranges to remove, start << 32 | end."""
    def out(h, a, b):
        for at in range(0, len(h), 100_000):
            c = slice(at, at + 100_000)
            start = h["pos"][c].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h["id"][c])), pa.array(h["check"][c].astype(np.int64)), pa.array((start + a[c]) << 32 | (start + b[c]))], names=["id", "check", "span"])

    for _, (heads, words, repeats) in buckets(batches):
        known = np.frombuffer(b"".join(repeats), SEGMENT)
        yield from out(known, np.zeros(len(known), np.int64), known["words"].astype(np.int64))
        heads, words = np.frombuffer(b"".join(heads), SEGMENT), np.frombuffer(b"".join(words), np.uint64)
        # anchors in groups of bounded size, each with an index of its own; alone with its anchor, a segment has nothing to share
        order = np.argsort(heads["hash"], kind="stable")
        first = np.flatnonzero(np.r_[True, heads["hash"][order][1:] != heads["hash"][order][:-1]]) if len(order) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(order)])
        size = np.cumsum(heads["words"][order].astype(np.int64))
        part = np.repeat(size[first] // INDEXED, n)
        shared = np.repeat(n, n) > 1
        for _, at in _split(part[shared].astype(np.int32)):
            h, w = take_segments(heads, words, order[shared][at])
            seg, a, n_windows = repeats_in_shard(h, w)
            yield from out(h[seg], a, a + n_windows + WINDOW - 1)


def _id(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("long"), F.lit(int(_NULL_ID)))


def _check():
    return F.coalesce(F.crc32("text"), F.lit(0))


def repeated_marks(rows: DataFrame, n: int, size: int) -> DataFrame:
    """(id, check, marks): where the repeated anchors of each document of (id, check, text) are."""
    occur = rows.mapInArrow(emit_anchors(n, HOT), "bucket int, rows binary, known binary")
    marks = by_bucket(occur, size // 4).mapInArrow(repeated_anchors(HOT), "id long, check long, pos int")
    return marks.groupBy("id", "check").agg(F.collect_set("pos").alias("marks")).mapInArrow(_each_list(mark_ranges), "id long, check long, marks array<long>")


def repeated_spans(rows: DataFrame, marks: DataFrame, n: int, size: int) -> DataFrame:
    """(id, check, spans): the word ranges that windows with those anchors repeat."""
    cut = rows.join(small(marks), ["id", "check"]).select("id", "check", "text", "marks")
    segments = cut.mapInArrow(emit_segments(n), "bucket int, heads binary, words binary, repeats binary")
    found = by_bucket(segments, size).mapInArrow(search_shards, "id long, check long, span long")
    return found.groupBy("id", "check").agg(F.collect_set("span").alias("spans")).mapInArrow(_each_list(_merged), "id long, check long, spans array<long>")


def removals(docs: DataFrame, folder: str) -> DataFrame:
    """(id, check, spans) of the documents that lose words."""
    spark = docs.sparkSession
    rows = docs.select(_id().alias("id"), _check().alias("check"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = bucket_count(spark, size)
    marks = materialize(repeated_marks(rows, n, size), folder, "anchors")
    remove(spark)  # the shuffle of the anchors
    spans = materialize(repeated_spans(rows, marks, n, size), folder, "spans")
    remove(spark, f"{folder}/anchors")
    return spans


MADE = ("n_words", "n_removed", "kept_sha256", "kept")


def dedup(docs: DataFrame, folder: str | None = None, with_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and, with its text, kept (the remaining words, joined by single spaces)."""
    spans = removals(docs.select("doc_id", "text"), folder or shared_dir(docs.sparkSession))
    columns = [c for c in docs.columns if c not in MADE and (with_text or c != "text")]
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    joined = docs.select(row, _id().alias("id"), _check().alias("check"), "text").join(small(spans), ["id", "check"], "left").select("row", "text", "spans")
    schema = joined.select("row").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if with_text:
        schema = schema.add("kept", "string")

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            spans = batch.column(2)
            counts, gone, shas, kept = [], [], [], []
            for i in range(batch.num_rows):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                total = len(words)
                if spans[i].is_valid:
                    s = spans[i].values.to_numpy()
                    mark = np.zeros(total + 1, np.int32)
                    np.add.at(mark, s >> 32, 1)
                    np.add.at(mark, s & 0xFFFFFFFF, -1)
                    covered = np.cumsum(mark)[:-1] > 0
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                rest = b" ".join(words)
                counts.append(total), gone.append(total - len(words)), shas.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest.decode())
            made = [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())] + ([pa.array(kept, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=schema.names)

    out = joined.mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in columns], *schema.names[1:])


def op9(spark, sf_dir: str) -> DataFrame:
    return dedup(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), with_text=False)
