"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of ``2 * HALF`` words, overlapping by half.  Over the words of
those passages, document frequencies are counted in all passages of all documents, in one pass for the whole
benchmark.  A randomised SVD (a random range, two products with the distributed TF-IDF rows of the passages, whose
words are hashed to at most ``DIMENSIONS`` features) gives a basis of the passages' row space, into which documents' passages are folded.

Where a document can match an item at all, enough of the item's words are met: of an item of n words of which m must be
met, any n - m + r hold r that are met.  An inverted index of the rarest n - m + r words of each item gives the windows of
``4 * HALF`` words more than the item, at every multiple of ``HALF``, that hold r of them; no match of
``min_paraphrase`` lies elsewhere.  Of these, windows in which a passage's cosine to a passage of the item reaches
``min_cosine`` are candidates.  So are those that hold enough of the fewer rarest words that ``min_lcs`` leaves,
whatever their cosine: the rank is smaller than a large benchmark's row space, and no match of ``min_lcs`` may depend on it.

Candidates are decided on words: the longest common subsequence of the item and the window must cover
``min_lcs`` of the item, or ``min_paraphrase`` of it together with ``min_answer`` of its last ``ANSWER`` words (the
answer).  A hit's ``route`` says what found it: ``latent`` where some window's cosine did, ``words`` where rare words alone did.  Items of fewer than ``LEAST`` words are matched as consecutive words.

Documents are read once for the frequencies and once for each block of ``BLOCK_WORDS`` words of the benchmark, and never
shuffled; what tasks send is a count a vocabulary word.  The basis, the vocabulary and what is broadcast are bounded by the block,
whatever the size of the benchmark.

Defined results: null and empty texts and items match nothing; copies get equal results; repeated items each
report; a null doc_id or item_id is kept; an empty table on either side gives no hits; extra columns pass through
``decontaminate`` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, as_long, chunks, gram_hashes, hash_words, materialize, mix64, shared_dir, spread, text_bytes, tidy

HALF = 24
RANK = 160
DIMENSIONS = 1 << 15
ANSWER = 8
LEAST = 6
#: Words of a block of items, and of the vocabulary whose frequencies one pass counts.
BLOCK_WORDS, VOCABULARY = 1 << 20, 1 << 22
#: Words of a block of items that one task handles.
TASK_WORDS = 1 << 17
#: Rare words that a window must hold, at least and as a share of the item; occurrences of them that one numpy pass handles (a longer document is a pass of its own).
RARE, RARE_SHARE = 4, 6
OCCURRENCES = 1 << 21
SALTS = 16


def item_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return hash_words(data, np.array([0, len(data)]), True, ALNUM)[0]


def passages(n: int) -> list[tuple[int, int]]:
    """Word ranges of the passages of n words."""
    return [(a, min(a + 2 * HALF, n)) for a in range(0, max(n - HALF, 1), HALF)]


class Vocabulary:
    """Words by sorted hash, with a table that tells most other words apart at once."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, word numbers) of the words that are in the vocabulary."""
        at = np.flatnonzero(self.table[(words >> np.uint64(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hashes, words[at]), len(self.hashes) - 1)
        ok = self.hashes[k] == words[at]
        return at[ok], k[ok]


def _half_passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of HALF words that never cross documents, and each document's first run (one more at the end)."""
    n = -(-np.diff(first) // HALF)
    lead = np.r_[0, np.cumsum(n)]
    within = np.arange(lead[-1]) - np.repeat(lead[:-1], n)
    return np.repeat(first[:-1], n) + within * HALF, lead


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, and so on."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _parsed(batch, at: int):
    data, offsets = text_bytes(batch.column(at))
    for lo, hi in chunks(offsets):
        part = offsets[lo : hi + 1]
        w, first, _, _ = hash_words(data[part[0] : part[-1]], part - part[0], True, ALNUM)
        yield lo, w, first


# ---------------------------------------------------------------- items and their words

def parse_items(benchmark: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """(item_id, words, n, block) of the items with words, and the number of blocks."""
    schema = benchmark.select("item_id").schema.add("words", "binary").add("n", "integer")

    def run(batches):
        for batch in batches:
            words = [item_words(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.tobytes() for w in words], pa.binary()), pa.array([len(w) for w in words], pa.int32())], names=schema.names)

    items = materialize(benchmark.select("item_id", "text").mapInArrow(tidy(run), schema).where("n > 0"), folder, "items")
    blocks = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS))
    return items.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks))), blocks


def item_vocabulary(items: DataFrame) -> DataFrame:
    """(w): the distinct words of the items."""
    def run(batches):
        for batch in batches:
            w = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in batch.column(0).to_pylist())]))
            yield pa.RecordBatch.from_arrays([pa.array(as_long(w))], names=["w"])

    return items.select("words").mapInArrow(tidy(run), "w long").distinct()


def frequencies(docs: DataFrame, words: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """(w, n): in how many half passages of all documents each word occurs; and how many there are."""
    spark = docs.sparkSession
    words = materialize(words, folder, "words")
    ranges = max(1, -(-words.count() // VOCABULARY))
    out = None
    for i in range(ranges):  # one pass over the documents for each VOCABULARY words
        part = words.where(F.pmod(F.xxhash64("w"), F.lit(ranges)) == i).toArrow().column(0).to_numpy().view(np.uint64)
        if not len(part):
            continue
        shared = spark.sparkContext.broadcast(Vocabulary(part))

        def run(batches, shared=shared, counts_runs=out is None):
            v = shared.value
            size = len(v.hashes)
            total, runs = np.zeros(size, np.int64), 0
            for batch in batches:
                for _, w, first in _parsed(batch, 0):
                    starts, lead = _half_passages(first)
                    at, k = v.find(w)
                    key = np.unique((np.searchsorted(starts, at, side="right") - 1) * size + k)
                    total += np.bincount(key % size, minlength=size)
                    runs += int(lead[-1])
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(v.hashes[k])), pa.array(total[k])], names=["w", "n"])
            if counts_runs:
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([runs])], names=["w", "n"])

        counts = docs.select("text").mapInArrow(tidy(run), "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
        out = counts if out is None else out.unionByName(counts)
    if out is None:
        return spark.createDataFrame([], "w long, n long"), 0
    found = materialize(out, folder, "frequencies")
    runs = found.where("w IS NULL").agg(F.sum("n")).first()[0] or 0
    return found.where("w IS NOT NULL"), runs


# ---------------------------------------------------------------- latent space

class Space:
    """The words of a block, their weights, their features and the basis."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray, runs: int):
        self.vocabulary = Vocabulary(hashes)
        df = np.zeros(len(self.vocabulary.hashes))
        df[np.searchsorted(self.vocabulary.hashes, hashes)] = n
        self.idf = np.log((runs + 1) / (df + 1)) + 0.01
        self.dimensions = min(DIMENSIONS, 1 << max(8, int(2 * len(df)).bit_length()))
        self.feature = (mix64(self.vocabulary.hashes) % np.uint64(self.dimensions)).astype(np.int64)
        self.basis = np.zeros((self.dimensions, 0), np.float32)

    def tfidf(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sparse unit vector of a passage: features and weights (a feature may stand twice)."""
        k, n = np.unique(self.vocabulary.find(words)[1], return_counts=True)
        v = (1 + np.log(n)) * self.idf[k]
        return self.feature[k], v / max(float(np.sqrt((v * v).sum())), 1e-12)

    def latent(self, words: np.ndarray) -> np.ndarray:
        """Unit vectors of the passages of some words in the latent space."""
        out = np.array([x @ self.basis[f] for f, x in (self.tfidf(words[a:b]) for a, b in passages(len(words)))]).reshape(-1, self.basis.shape[1])
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def sum_products(rows: DataFrame, shape: tuple[int, int], product) -> np.ndarray:
    """The sum of ``product`` over all rows of (words): a task adds up its own, and parts are added by row block and salt."""
    blocks = -(-shape[0] // 2048)

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                product(total, np.frombuffer(x, np.uint64))
        salt = TaskContext.get().partitionId() % SALTS
        cut = np.array_split(total, blocks)
        used = [i for i in range(blocks) if cut[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([salt] * len(used), pa.int32()), pa.array([np.ascontiguousarray(cut[i]).tobytes() for i in used], pa.binary())], names=["block", "salt", "part"])

    def add(key, table):
        whole = np.sum([np.frombuffer(x.as_py(), np.float64) for x in table.column("part")], 0)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "part": pa.array([whole.tobytes()], pa.binary())})

    schema = "block int, salt int, part binary"
    parts = rows.select("words").mapInArrow(tidy(run), schema).groupBy("block", "salt").applyInArrow(add, schema).groupBy("block", "salt").applyInArrow(add, schema)
    cut = [np.zeros(x.shape) for x in np.array_split(np.zeros(shape), blocks)]
    for r in parts.toLocalIterator():  # DIMENSIONS rows of RANK numbers, whatever the benchmark
        cut[r["block"]] += np.frombuffer(r["part"], np.float64).reshape(cut[r["block"]].shape)
    return np.concatenate(cut)


def latent_basis(items: DataFrame, space: Space, n_passages: int, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """Right singular vectors (features x rank) of the TF-IDF rows of all passages of the items, which stay where they are."""
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast(space)

    def gram_times(block: np.ndarray) -> np.ndarray:
        """A' A block."""
        right = spark.sparkContext.broadcast(block.astype(np.float32))

        def product(total, words):
            s = shared.value
            for a, b in passages(len(words)):
                f, x = s.tfidf(words[a:b])
                np.add.at(total, f, np.outer(x, x @ right.value[f]))

        out = sum_products(items, block.shape, product)
        right.destroy()
        return out

    width = min(rank + 10, space.dimensions)
    q, _ = np.linalg.qr(gram_times(np.random.default_rng(seed).normal(size=(space.dimensions, width))))
    q, _ = np.linalg.qr(gram_times(q))
    right = spark.sparkContext.broadcast(q.astype(np.float32))

    def product(total, words):
        s = shared.value
        for a, b in passages(len(words)):
            f, x = s.tfidf(words[a:b])
            y = x @ right.value[f]
            total += np.outer(y, y)

    values, vectors = np.linalg.eigh(sum_products(items, (width, width), product))
    right.destroy()
    shared.destroy()
    best = np.argsort(-values)[: min(rank, n_passages)]
    return (q @ vectors[:, best[values[best] > 1e-9]]).astype(np.float32)


# ---------------------------------------------------------------- search

def lcs(masks: dict[int, int], length: int, text: list[int]) -> int:
    """Length of the longest common subsequence of a pattern (bit masks by word) and a text, bit-parallel."""
    full = (1 << length) - 1
    v = full
    for w in text:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


class RareWords:
    """The rarest words of each item, of which a window that covers a share of the item holds ``least``: word -> items."""

    def __init__(self, items: list[np.ndarray], space: Space, share: float):
        self.held = OCCURRENCES
        words, owners, least = [], [], []
        for i, w in enumerate(items):
            m = max(int(np.ceil(share * len(w) - 1e-9)), 1)
            r = min(max(RARE, len(w) // RARE_SHARE), m)
            k = space.vocabulary.find(w)[1]
            k = np.unique(k[np.argsort(-space.idf[k], kind="stable")[: len(w) - m + r]])
            words.append(k), owners.append(np.full(len(k), i)), least.append(r)
        words, owners, self.least = (np.concatenate([np.zeros(0, np.int64), *words]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *owners]), np.array(least, np.int64))
        order = np.argsort(words, kind="stable")
        self.items = owners[order].astype(np.int32)
        self.of_word = np.searchsorted(words[order], np.arange(len(space.idf) + 1))

    def windows(self, at: np.ndarray, k: np.ndarray, first: np.ndarray, lead: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """First half passage * items + item of the windows that hold enough of an item's words, sorted."""
        n = np.diff(self.of_word)[k]
        total = np.r_[0, np.cumsum(n)]
        cuts = np.searchsorted(at, first)  # documents in word positions
        group = total[cuts[:-1]] // self.held
        cuts = np.r_[cuts[:-1][np.r_[True, group[1:] != group[:-1]]], len(at)]
        found = [np.zeros(0, np.int64)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            item = self.items[_ragged(self.of_word[k[a:b]], n[a:b])].astype(np.int64)
            order = np.argsort(item, kind="stable")
            item, x = item[order], np.repeat(at[a:b], n[a:b])[order]
            last = np.arange(len(item)) + self.least[item] - 1
            here = np.flatnonzero(last < len(item))
            here = here[item[last[here]] == item[here]]
            item, x, y = item[here], x[here], x[last[here]]
            wide = 4 * HALF + lengths[item]
            doc = np.searchsorted(first, x, side="right") - 1
            near = (y - x < wide) & (y < first[doc + 1])
            x, y, item, wide, doc = x[near], y[near], item[near], wide[near], doc[near]
            low = np.maximum(-((first[doc] + wide - y - 1) // HALF), 0)
            count = (x - first[doc]) // HALF - low + 1
            found.append(_ragged(lead[doc] + low, count) * len(lengths) + np.repeat(item, count))
        return np.unique(np.concatenate(found))


class Retriever:
    """Everything a task needs for one block of items of at least LEAST words."""

    def __init__(self, items: list[np.ndarray], space: Space, rows: list[np.ndarray], min_cosine: float, min_lcs: float, min_paraphrase: float, min_answer: float):
        self.items, self.space = items, space
        self.rows = np.concatenate([np.zeros((0, space.basis.shape[1]), np.float32), *rows])
        self.columns = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
        self.lengths = np.array([len(w) for w in items], np.int64)
        self.limits = min_cosine, min_lcs, min_paraphrase, min_answer
        self.loose, self.strict = (RareWords(items, space, x) for x in (min_paraphrase, min_lcs))
        self.made: dict[int, tuple] = {}

    def patterns(self, i: int) -> tuple:
        """Masks of an item and its answer, and its words with their counts; made when first asked for."""
        if i not in self.made:
            w = self.items[i]
            self.made[i] = _masks(w), _masks(w[-ANSWER:]), *np.unique(w, return_counts=True)
        return self.made[i]

    def cosines(self, p: np.ndarray, item: np.ndarray, at: np.ndarray, k: np.ndarray, starts: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window (by first half passage) and item the best cosine of their passages, and that passage's first half."""
        doc = np.searchsorted(lead, p, side="right") - 1
        stop = np.minimum(lead[doc + 1], p + 4 + self.lengths[item] // HALF)
        needed = np.zeros(len(starts) + 1, bool)
        needed[_ragged(p, stop - p)] = True
        number = np.cumsum(needed) - 1
        run = np.searchsorted(starts, at, side="right") - 1
        ours = np.flatnonzero(needed[run])
        half = np.zeros((int(needed.sum()), self.rows.shape[1]), np.float32)
        for piece in np.array_split(ours, max(1, len(ours) // (1 << 14))):
            if len(piece):
                r = number[run[piece]]  # ascending, so a run's words are consecutive
                cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                half[r[cut]] += np.add.reduceat(self.space.basis[self.space.feature[k[piece]]] * self.space.idf[k[piece]].astype(np.float32)[:, None], cut)
        whole = half.copy()  # a passage is a run and the next one of its document; the last run also stands alone
        runs = np.flatnonzero(needed[:-1])
        ends = np.zeros(len(starts) + 1, bool)
        ends[lead[1:] - 1] = True
        joined = np.flatnonzero(~ends[runs] & needed[runs + 1])
        whole[joined] += half[joined + 1]
        whole /= np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-12)
        best, place = np.zeros(len(p), np.float32), p.copy()
        wide = np.diff(self.columns)[item]
        pairs = (stop - p) * wide
        for part in np.array_split(np.arange(len(p)), max(1, int(pairs.sum()) // (1 << 15))):
            if not len(part):
                continue
            size = pairs[part]
            inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            row, col = inside // np.repeat(wide[part], size), inside % np.repeat(wide[part], size)
            values = np.einsum("ij,ij->i", whole[number[np.repeat(p[part], size) + row]], self.rows[np.repeat(self.columns[item[part]], size) + col])
            cut = np.cumsum(size) - size
            best[part] = np.maximum.reduceat(values, cut)
            top = np.flatnonzero(values == np.repeat(best[part], size))
            of = np.repeat(np.arange(len(part)), size)[top]
            lead_top = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            place[part] += row[top[lead_top]]
        return best, place

    def measure(self, i: int, text: np.ndarray) -> tuple[float, float] | None:
        """(lcs, answer) of an item and a text, if they match."""
        _, min_lcs, min_paraphrase, min_answer = self.limits
        length = int(self.lengths[i])
        masks, answers, words, counts = self.patterns(i)
        met = np.minimum(np.searchsorted(words, text), len(words) - 1)
        met = met[words[met] == text]
        if counts[np.bincount(met, minlength=len(words)) > 0].sum() < min_paraphrase * length:
            return None  # no subsequence can be longer than the item's words that occur at all
        text = text.tolist()
        share = lcs(masks, length, text) / length
        if share < min_paraphrase:
            return None
        n = min(ANSWER, length)
        answer = lcs(answers, n, text) / n
        return (share, answer) if share >= min_lcs or answer >= min_answer else None

    def hits(self, w: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, float, float, int, str]]:
        """(document, item, cosine, lcs, answer, word, route) for each hit."""
        at, k = self.space.vocabulary.find(w)
        if not len(at) or not self.items:
            return []
        starts, lead = _half_passages(first)
        key = self.loose.windows(at, k, first, lead, self.lengths)
        if not len(key):
            return []
        sure = np.isin(key, self.strict.windows(at, k, first, lead, self.lengths), assume_unique=True)
        p, item = key // len(self.items), key % len(self.items)
        cosine, place = self.cosines(p, item, at, k, starts, lead)
        best: dict[tuple[int, int], tuple] = {}
        routes: dict[tuple[int, int], str] = {}
        doc = np.searchsorted(lead, p, side="right") - 1
        near = cosine >= self.limits[0]
        for x in np.flatnonzero(sure | near).tolist():
            i, d = int(item[x]), int(doc[x])
            got = self.measure(i, w[starts[p[x]] : min(first[d + 1], starts[p[x]] + 4 * HALF + self.lengths[i])])
            if got:
                best[d, i] = max(best.get((d, i), (0.0,)), (*got, float(cosine[x]), int(starts[place[x]] - first[d])))
                routes[d, i] = "latent" if near[x] else routes.get((d, i), "words")
        return [(d, i, x[2], x[0], x[1], x[3], routes[d, i]) for (d, i), x in sorted(best.items())]


class Exact:
    """Items of fewer than LEAST words, found as consecutive words."""

    def __init__(self, items: list[np.ndarray]):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(w) for w in items}):
            own = [i for i, w in enumerate(items) if len(w) == n]
            h = np.concatenate([gram_hashes(items[i], n) for i in own])
            order = np.argsort(h, kind="stable")
            self.by_length[n] = h[order], np.array(own)[order]

    def hits(self, w: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float | None, float, float, int, str]]:
        found: dict[tuple[int, int], int] = {}
        for n, (hashes, own) in self.by_length.items():
            grams = gram_hashes(w, n)
            left, right = np.searchsorted(hashes, grams), np.searchsorted(hashes, grams, side="right")
            at = np.flatnonzero(right > left)
            doc = np.searchsorted(first, at, side="right") - 1
            inside = at + n <= first[doc + 1]
            for p, d in zip(at[inside].tolist(), doc[inside].tolist()):
                for i in own[left[p] : right[p]].tolist():
                    found.setdefault((d, i), p - int(first[d]))
        return [(d, i, None, 1.0, 1.0, p, "words") for (d, i), p in sorted(found.items())]


def retrievers(docs: DataFrame, benchmark: DataFrame, folder: str, min_cosine: float = 0.4, min_lcs: float = 0.75,
               min_paraphrase: float = 0.6, min_answer: float = 0.75):
    """(searcher, item ids) for each block of long items, and for the short ones."""
    spark = docs.sparkSession
    items, blocks = parse_items(benchmark, folder)
    long = items.where(F.col("n") >= LEAST)
    counts, runs = frequencies(docs, item_vocabulary(long), folder)
    for b in range(blocks):
        block = long.where(F.col("block") == b)
        size = block.agg(F.sum("n").alias("words"), F.sum(F.greatest(F.ceil((F.col("n") - HALF) / HALF), F.lit(1))).alias("passages")).first()
        if size["words"]:
            tasks = -(-size["words"] // TASK_WORDS)
            block = materialize(block.repartition(int(tasks)), folder, f"block{b}")
            words = item_vocabulary(block).join(counts, "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("n")).toArrow()  # BLOCK_WORDS at most
            space = Space(words.column(0).to_numpy().view(np.uint64), words.column(1).to_numpy(), runs)
            space.basis = latent_basis(block, space, int(size["passages"]))
            shared = spark.sparkContext.broadcast(space)

            def run(batches, shared=shared):
                for batch in batches:
                    rows = [shared.value.latent(np.frombuffer(x, np.uint64)).tobytes() for x in batch.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], names=["item_id", "words", "rows"])

            made = block.select("item_id", "words").mapInArrow(tidy(run), block.select("item_id", "words").schema.add("rows", "binary")).toArrow()
            shared.destroy()
            of = [np.frombuffer(x, np.uint64) for x in made.column(1).to_pylist()]
            rows = [np.frombuffer(x, np.float32).reshape(-1, space.basis.shape[1]) if space.basis.shape[1] else np.zeros((len(passages(len(w))), 0), np.float32) for x, w in zip(made.column(2).to_pylist(), of)]
            yield Retriever(of, space, rows, min_cosine, min_lcs, min_paraphrase, min_answer), made.column(0).combine_chunks()
        made = items.where((F.col("block") == b) & (F.col("n") < LEAST)).select("item_id", "words").toArrow()
        if made.num_rows:
            yield Exact([np.frombuffer(x, np.uint64) for x in made.column(1).to_pylist()]), made.column(0).combine_chunks()


HITS = "cosine double, lcs double, answer double, word integer, route string"


def find(docs: DataFrame, benchmark: DataFrame, folder: str | None = None, **limits) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, word, route) for each document and item that match."""
    spark = docs.sparkSession
    schema = docs.select("doc_id").schema.add(benchmark.schema["item_id"])
    for f in HITS.split(", "):
        schema = schema.add(*f.split())
    kinds = [pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.string()]
    out = None
    for searcher, ids in retrievers(docs, benchmark, folder or shared_dir(spark), **limits):
        shared = spark.sparkContext.broadcast((searcher, ids))

        def run(batches, shared=shared):
            searcher, ids = shared.value
            for batch in batches:
                rows = [(lo + h[0], *h[1:]) for lo, w, first in _parsed(batch, 1) for h in searcher.hits(w, first)]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), ids.take(pa.array(cols[1])), *(pa.array(c, k) for c, k in zip(cols[2:], kinds))], names=schema.names)

        part = docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, folder: str | None = None, **limits) -> DataFrame:
    """``docs`` without the rows that match an item; each row is decided where it lies."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for searcher, _ in retrievers(docs, benchmark, folder or shared_dir(spark), **limits):
        shared = spark.sparkContext.broadcast(searcher)

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, w, first in _parsed(batch, at):
                    keep[[lo + h[0] for h in shared.value.hits(w, first)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
