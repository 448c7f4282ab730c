"""Ranked lexical search with WAND, shard of documents by shard.

A first pass sums up the corpus: documents, terms, and the documents that hold each term of the queries.  In a second
one every task cuts its documents into shards, and gives each an index of the queries' terms: postings by
document, their impacts, and the largest impact a term has in the shard.  A query keeps one cursor a term.  The terms are
ordered by their cursors' documents and their largest impacts summed up until the sum reaches the lowest score that would still
enter the query's heap: the document at which it does is the pivot, and none before it can enter.  All cursors go to the pivot; from there on a window of
documents is bounded at once by the largest impacts of the terms that each holds, only documents whose bound reaches the heap are scored, and the cursors
move past the window.  A task's heaps are kept from shard to shard, so its later shards start with a high threshold; the
heaps of all tasks are merged in two steps, so that no query's meet in one task unreduced.

Queries are taken in blocks of bounded size (``BLOCK_TERMS``, ``BLOCK_ITEMS``), each a pass for the documents that hold its terms and one for the search.
A task holds the postings of one shard (``SHARD_POSTINGS``, ``SHARD_DOCS``), the heaps of a block, and a chunk of text; a document longer than a chunk is a
chunk of its own and costs some 40 bytes a byte of text while it is read.

Terms are hashed to 64 bits; scores are exact 64-bit integers.

Defined results: a null or empty text, or one without terms, is in no ranking and not counted; a query without terms, or whose terms no document
holds, has no rows; rows that repeat are documents of their own, and repeated items queries of their own; of equal scores the smaller doc_id is first, null
last; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, as_long, chunks, hash_words, materialize, shared_dir, spread, text_bytes, tidy

#: Terms and queries of a block.
BLOCK_TERMS, BLOCK_ITEMS = 1 << 18, 1 << 12
#: Postings after which a shard is full, and documents.
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 13
#: Documents that are bounded at once from a pivot on.
WINDOW = 512
_EXACT = 1 << 53


def term_chunks(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, hashed terms, first term of each text) for chunks of a column of texts."""
    data, offsets = text_bytes(column)
    for lo, hi in chunks(offsets):
        part = offsets[lo : hi + 1]
        hashes, first, _, _ = hash_words(data[part[0] : part[-1]], part - part[0], lower=True, table=ALNUM)
        yield lo, hi, hashes, first


# ---------------------------------------------------------------- queries

class Block:
    """Some queries: their ids, and for each the places of its distinct terms in one sorted vocabulary."""

    def __init__(self, ids: list[int | None], terms: list[np.ndarray]):
        self.ids = ids
        self.vocabulary = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
        self.terms = [np.searchsorted(self.vocabulary, t) for t in terms]


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct hashed terms of every item that has some."""
    def run(batches):
        for batch in batches:
            for lo, hi, hashes, first in term_chunks(batch.column("text")):
                rows = [np.unique(hashes[a:b]) for a, b in zip(first, first[1:])]
                kept = [i for i, x in enumerate(rows) if len(x)]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(lo, hi - lo).take(pa.array(kept, pa.int64())), pa.array([as_long(rows[i]) for i in kept], pa.list_(pa.int64()))], names=["item_id", "terms"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, terms array<long>")


def blocks(queries: DataFrame) -> Iterator[Block]:
    """The queries in blocks, one in the driver at a time; more terms than ``BLOCK_TERMS`` make a block only alone."""
    ids, terms, size = [], [], 0
    for r in queries.toLocalIterator():
        t = np.array(r["terms"], np.int64).view(np.uint64)
        if ids and (size + len(t) > BLOCK_TERMS or len(ids) >= BLOCK_ITEMS):
            yield Block(ids, terms)
            ids, terms, size = [], [], 0
        ids.append(r["item_id"])
        terms.append(t)
        size += len(t)
    if ids:
        yield Block(ids, terms)


# ---------------------------------------------------------------- statistics

def postings(vocabulary: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place of the term, occurrences) of the vocabulary's terms in some documents, by document."""
    at = np.searchsorted(vocabulary, hashes)
    known = at < len(vocabulary)
    known[known] = vocabulary[at[known]] == hashes[known]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[known]
    key, tf = np.unique(doc * max(len(vocabulary), 1) + at[known], return_counts=True)
    return key // max(len(vocabulary), 1), key % max(len(vocabulary), 1), tf


def statistics(docs: DataFrame, block) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, documents that hold each term of the broadcast block)."""
    def run(batches):
        vocabulary = block.value.vocabulary
        held, n, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for _, _, hashes, first in term_chunks(batch.column("text")):
                n += int(np.count_nonzero(np.diff(first)))
                total += len(hashes)
                held += np.bincount(postings(vocabulary, hashes, first)[1], minlength=len(vocabulary))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], at])), pa.array(np.concatenate([[n, total], held[at]]))], names=["term", "n"])

    held, n, total = np.zeros(len(block.value.vocabulary), np.int64), 0, 0
    for r in docs.select("text").mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term of the block
        if r["term"] == -1:
            n = r["n"]
        elif r["term"] == -2:
            total = r["n"]
        else:
            held[r["term"]] = r["n"]
    return n, total, held


def weights(n: int, held: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * held + 1))).astype(np.int64)


def damping(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """How much a document of so many terms damps occurrences; of average length 100."""
    if len(lengths) and 50 * n * int(lengths.max()) >= 1 << 63:
        return np.array([50 + 50 * n * int(x) // total for x in lengths], np.int64)
    return 50 + 50 * n * lengths // total


# ---------------------------------------------------------------- search

class Heap:
    """The best documents of a query so far, and the lowest score that may still enter."""

    def __init__(self, k: int):
        self.k, self.bar = k, 1
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def push(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        self.scores, self.ids, self.null = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.null, null)))
        best = np.lexsort((self.ids, self.null, -self.scores))[: self.k]
        self.scores, self.ids, self.null = self.scores[best], self.ids[best], self.null[best]
        if len(best) == self.k:  # an equal score enters if its id is smaller
            self.bar = max(1, int(self.scores[-1]))


class Shard:
    """An index of some documents: by (term, document) the impacts, and the largest of each term."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, lengths: np.ndarray, weight: np.ndarray, n: int, total: int):
        self.size = len(lengths)
        key = term * self.size + doc
        order = np.argsort(key)
        self.keys = key[order]
        self.docs = doc[order]
        tf, term = tf[order], term[order]
        self.impacts = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * damping(lengths, n, total)[self.docs]))
        self.starts = np.searchsorted(self.keys, np.arange(len(weight) + 1) * self.size)
        self.most = np.zeros(len(weight), np.int64)
        if len(self.keys):
            present = np.flatnonzero(np.diff(self.starts))
            self.most[present] = np.maximum.reduceat(self.impacts, self.starts[present])


def add_up(at: np.ndarray, values: np.ndarray, size: int, exact: bool) -> np.ndarray:
    """Sums of integers by place; those of doubles are exact below 2**53."""
    if exact:
        return np.bincount(at, values, size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, at, values)
    return out


def wand(shard: Shard, terms: np.ndarray, heap: Heap, ids: np.ndarray, null: np.ndarray) -> int:
    """Bring a query's heap up to date with a shard; returns how many of its documents were scored."""
    terms = terms[shard.most[terms] > 0]
    most, base, cursor, end = shard.most[terms], terms * shard.size, shard.starts[terms], shard.starts[terms + 1]
    exact, scored = int(most.sum()) < _EXACT, 0
    while len(terms):
        at = shard.docs[cursor]
        order = np.argsort(at, kind="stable")
        pivot = int(np.searchsorted(np.cumsum(most[order]), heap.bar))
        if pivot == len(order):  # all that is left together cannot reach the heap
            break
        first = int(at[order[pivot]])
        last = min(first + WINDOW, shard.size)
        lo, hi = np.maximum(cursor, np.searchsorted(shard.keys, base + first)), np.searchsorted(shard.keys, base + last)
        n = hi - lo
        place = np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)
        doc = shard.docs[place] - first
        reach = add_up(doc, np.repeat(most, n), last - first, exact) >= heap.bar
        inside = reach[doc]
        scored += int(np.count_nonzero(reach))
        score = add_up(doc[inside], shard.impacts[place[inside]], last - first, exact)
        enter = np.flatnonzero(score >= heap.bar)
        if len(enter):
            heap.push(score[enter], ids[first + enter], null[first + enter])
        cursor = hi
        if (over := cursor >= end).any():
            terms, most, base, cursor, end = (x[~over] for x in (terms, most, base, cursor, end))
    return scored


HITS = "query long, item_id long, doc_id long, score long, part int"


def shard_heaps(docs: DataFrame, block, n: int, total: int, weight: np.ndarray, k: int) -> DataFrame:
    """The heaps of every task: rows of (query, item_id, doc_id, score, part)."""
    def run(batches):
        from pyspark import TaskContext

        queries = block.value
        heaps = [Heap(k) for _ in queries.terms]
        held: list[tuple[np.ndarray, ...]] = []
        size = count = 0

        def search():
            doc, term, tf, lengths, ids, null = (np.concatenate(x) for x in zip(*held))
            shard = Shard(doc, term, tf, lengths, weight, n, total)
            for terms, heap in zip(queries.terms, heaps):
                wand(shard, terms, heap, ids, null)

        for batch in batches:
            id_column = batch.column("doc_id")
            null = id_column.is_null().to_numpy(zero_copy_only=False)
            ids = id_column.fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi, hashes, first in term_chunks(batch.column("text")):
                doc, term, tf = postings(queries.vocabulary, hashes, first)
                held.append((doc + count, term, tf, np.diff(first), ids[lo:hi], null[lo:hi]))
                size, count = size + len(doc), count + hi - lo
                if size >= SHARD_POSTINGS or count >= SHARD_DOCS:
                    search()
                    held, size, count = [], 0, 0
        if held:
            search()
        part = TaskContext.get().partitionId()
        for q, heap in enumerate(heaps):
            if m := len(heap.scores):
                yield pa.RecordBatch.from_arrays([pa.array([q] * m, pa.int64()), pa.array([queries.ids[q]] * m, pa.int64()), pa.array(heap.ids, pa.int64(), mask=heap.null), pa.array(heap.scores), pa.array([part] * m, pa.int32())], names=[x.split()[0] for x in HITS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), HITS)


def best(hits: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy("query", *by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = 50, folder: str | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for every row of ``items``."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    queries = materialize(query_terms(items), folder, "queries")
    tops = []
    for b in blocks(queries):
        shared = spark.sparkContext.broadcast(b)
        n, total, held = statistics(docs, shared)
        if n:
            merged = max(1, int(docs.rdd.getNumPartitions() ** 0.5))
            hits = shard_heaps(docs, shared, n, total, weights(n, held), k).withColumn("part", F.col("part") % merged)
            top = best(best(hits, k, "part"), k).select("item_id", "rank", "doc_id", "score")
            tops.append(materialize(top, folder, f"top{len(tops)}"))
        shared.destroy()
    if not tops:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return spark.read.schema(tops[0].schema).parquet(*[f"{folder}/top{i}" for i in range(len(tops))])


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rank(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS d, doc_id, unnest({_TERMS}) AS term FROM documents WHERE text IS NOT NULL),
q AS (SELECT DISTINCT item, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark WHERE text IS NOT NULL)),
l AS (SELECT d, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n FROM t GROUP BY d),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM l),
p AS (SELECT d, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY d, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), c),
m AS (SELECT d, doc_id, 50 + (50 * n * docs) // words AS m FROM l, c),
s AS (SELECT item, item_id, d, m.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (d) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 50
"""
