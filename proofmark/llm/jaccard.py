"""N-gram Jaccard join by universe partitioning, with exact components.

Documents are sets of hashed word shingles.  Equal sets are one node from the start.

1.  A prefix filter drops sets that cannot have a partner: of the ``n - ceil(t n) + 1 + x`` smallest
    hashes of a set with a partner, ``x + 1`` belong to another set too.
2.  The universe of shingles is hashed into ``m`` segments, by size band.  Sets of a band pair that reach the
    threshold differ in at most H elements.  Either they agree on at least ``m - H`` segments, and the
    subset of a set in a segment, hashed, is a signature; or they differ by at most one element in ``m - H // 2`` segments, and
    the subset with its one-deletion neighbourhood gives the signatures.  ``allocate`` estimates
    the signatures and the false candidates of both, for several m, and takes the cheaper one for each band.
3.  Thin subsets (empty; of one element, where one is deleted), and signatures of more than ``POPULAR`` sets, are left out at first: both sets of a pair agree
    on what is left out, so a pair can only be lost if both sets leave out more than the slack,
    the segments they agree on beyond one.  Sets with too many thin subsets are partitioned again by another seed (the last
    seed keeps the thin ones); sets that leave out too many popular ones keep those.
4.  Pairs that agree on enough signatures, and stars over the popular groups of the latter sets, form candidate clusters.
    Clusters of up to ``CLUSTER`` sets are verified in one task each, all pairs not yet connected.
    Larger ones are compared with a few pivots; what the pivots leave outside the main component meets others
    through an index inside the cluster (``large_links``).  So no link between different texts is lost.

The search's shuffles carry packed hashes, not texts, and their tasks hold one bucket at a time.  Texts travel once to be joined with the keys of what survives the
prefix filter, and once more where rows are dropped; both joins are the same merge join at every size, so figures measured small hold at size.  Equal sets, popular signatures and large clusters are all
split or collapsed before they meet in a task, and joins on labels split hot ones.  Hashes have 64 bits.

Defined results: null texts and texts without words have no shingles and are linked with nothing, not
even each other; texts of fewer than ``k`` words are one shingle; a null doc_id is a component of
its own or joins as the largest id; repeated rows get one result each; an empty table gives no rows.  ``deduplicate``
keeps rows of the smallest id of a component, told apart by id and text checksum, so a row is dropped for its own text only;
linked rows without an id go if any of their component has one.  Its extra columns pass through whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TASK_BYTES, bucket_count, buckets, by_bucket, carried, chunks, gram_hashes, hash_words, join_unique, materialize, mix64, remove, shared_dir, small, spread, text_bytes, tidy

K = 5
POPULAR = 8
CLUSTER = 256
PIVOTS = 8
#: Members of a large cluster that meet its pivots in one task.
SALTED = 4096
SEEDS = 4
NUM, DEN = 3, 4  # the threshold, as a fraction
_NULL_ID = np.iinfo(np.int64).max


# ---------------------------------------------------------------- sets

def shingle_sets(batch: pa.RecordBatch, column: int, k: int = K):
    """(row, sorted distinct shingle hashes) of each text with words."""
    data, offsets = text_bytes(batch.column(column))
    for lo, hi in chunks(offsets):
        part = offsets[lo : hi + 1]
        w, first, _, _ = hash_words(data[part[0] : part[-1]], part - part[0], lower=True)
        grams = gram_hashes(w, k)
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= k:
                yield lo + i, np.unique(grams[a : b - k + 1])
            elif b > a:
                yield lo + i, mix64(gram_hashes(w[a:b], b - a) + np.uint64(0x5851F42D4C957F2D))


def set_id(tokens: np.ndarray) -> int:
    return int(mix64(np.add.reduce(mix64(tokens), keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0])


def describe_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, check, n_shingles, set_id) of (doc_id, check, text); set_id is null for an empty set."""
    schema = docs.select("doc_id", "check").schema.add("n_shingles", "long").add("set_id", "long")

    def run(batches):
        for batch in batches:
            n, ids, ok = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for i, s in shingle_sets(batch, 2, k):
                n[i], ids[i], ok[i] = len(s), set_id(s), True
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(ids, mask=~ok)], names=schema.names)

    return docs.select("doc_id", "check", "text").mapInArrow(tidy(run), schema)


# ---------------------------------------------------------------- packed shuffles

def packed(bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """(bucket, rows): structured rows, one value a bucket."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cut = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    rows = rows[order]
    return pa.RecordBatch.from_arrays([pa.array(sorted_[cut].astype(np.int32)), pa.array([x.tobytes() for x in np.split(rows, cut[1:])], pa.binary())], names=["bucket", "rows"])


# ---------------------------------------------------------------- prefix filter

PREFIX = np.dtype([("token", "<u4"), ("set", "<i8")])


def extra(n):
    """How many hashes beyond the prefix are looked at; so many more have to be shared."""
    return n // 20


def in_groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the size of each row's group, and the row's place in it."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.r_[first, len(key)])
    return np.repeat(n, n), np.arange(len(key)) - np.repeat(first, n)


def send(bucket: np.ndarray, rows: np.ndarray, known: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """(bucket, rows, known): rows to group, and rows that are known without it, dealt out by set."""
    parts: dict[int, list[bytes]] = {}
    for i, (of, what) in enumerate(((bucket, rows), ((mix64(known["set"].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int32), known))):
        batch = packed(of, what) if len(what) else None
        for b, blob in zip(*(c.to_pylist() for c in batch.columns)) if batch else ():
            parts.setdefault(b, [b"", b""])[i] = blob
    cols = list(zip(*[(b, *x) for b, x in sorted(parts.items())])) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["bucket", "rows", "known"])


SENT = "bucket int, rows binary, known binary"
COUNTED = np.dtype([("set", "<i8"), ("n", "<i4")])


def emit_prefixes(n_buckets: int, k: int):
    """Prefix tokens, at most two rows a token and batch: of more sets the rest know already that they share it."""
    def run(batches):
        for batch in batches:
            tokens, sets = [], []
            for _, s in shingle_sets(batch, 0, k):
                n = len(s)
                tokens.append(s[: n - -(-NUM * n // DEN) + 1 + extra(n)])
                sets.append(np.full(len(tokens[-1]), set_id(s), np.int64))
            if tokens:
                low, sets = mix64(np.concatenate(tokens)), np.concatenate(sets)
                order = np.lexsort((sets, low))
                low, sets = low[order], sets[order]
                new = np.r_[True, (low[1:] != low[:-1]) | (sets[1:] != sets[:-1])]
                low, sets = low[new], sets[new]
                _, place = in_groups(low)
                sent = place < 2
                u, n = np.unique(sets[~sent], return_counts=True)
                known, rows = np.empty(len(u), COUNTED), np.empty(int(sent.sum()), PREFIX)
                known["set"], known["n"] = u, n
                rows["token"], rows["set"] = low[sent] & np.uint64(0xFFFFFFFF), sets[sent]
                yield send(((low[sent] >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int32), rows, known, n_buckets)
    return run


def shared_prefixes(batches):
    """(set_id, n): how many tokens of a set here belong to another set too."""
    for _, (blobs, known) in buckets(batches):
        rows, told = np.frombuffer(b"".join(blobs), PREFIX), np.frombuffer(b"".join(known), COUNTED)
        order = np.lexsort((rows["set"], rows["token"]))
        token, sets = rows["token"][order], rows["set"][order]
        new = np.r_[True, (token[1:] != token[:-1]) | (sets[1:] != sets[:-1])] if len(rows) else np.zeros(0, bool)
        token, sets = token[new], sets[new]
        u, c = np.unique(sets[in_groups(token)[0] > 1], return_counts=True)
        u, c = np.r_[u, told["set"]], np.r_[c, told["n"].astype(np.int64)]
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], names=["set_id", "n"])


# ---------------------------------------------------------------- universe partition

def bands(largest: int) -> list[int]:
    """Lower ends of the size bands; a partner of a set is in its band or the next one up."""
    lows = [1]
    while lows[-1] <= largest:
        lows.append(max(lows[-1] + 1, -(-lows[-1] * DEN // NUM)))
    return [*lows, -(-lows[-1] * DEN // NUM)]


def allocate(lows: list[int], k: int) -> tuple[int, int, int]:
    """(segments, slack, deletions) for the pairs whose smaller set is in band k: the plan of least estimated cost.

    The cost is a set's signatures, each more dear the likelier its subset is thin: few elements collide with sets that
    only share a line, and too many thin subsets make a set go through another seed.
    """
    lo, hi = lows[k], lows[k + 1] - 1
    total = np.arange(2 * lo, hi + hi * DEN // NUM + 1)
    h = int((total - 2 * -(-NUM * total // (NUM + DEN))).max())
    if h == 0:
        return 1, 0, 0

    def risky(m: int, deletions: int) -> float:
        """How likely a subset is empty or, with deletions, has two elements at most."""
        load = lo / m
        return math.exp(-load) * (1 + deletions * (load + load * load / 2)) if m > 1 else 0.0

    plans = []
    for slack in {0, 1, 2, 3, 2 * (h + 1) // 5 + 1, 3 * (h + 1) // 5 + 1}:
        for deletions, needed in ((0, h + 1), (1, h // 2 + 1)):
            m = needed + slack
            share = risky(m, deletions)
            seeds = 1 + 2 * (m * share > slack)  # a set with more risky subsets sends the signatures of several seeds
            sent = hi + m if deletions else m * (1 - share)
            plans.append((sent * (1 + 8 * share) * seeds, m, slack, deletions))
    cost, m, slack, deletions = min(plans)
    return m, slack, deletions


SIGNATURE = np.dtype([("sig", "<u8"), ("set", "<i8"), ("key", "<i2"), ("slack", "<i2")])


def signatures(tokens: np.ndarray, lows: list[int], plan: dict[int, tuple[int, int, int]]):
    """(key, slack, signatures) of a set for the band pairs it takes part in."""
    band = int(np.searchsorted(lows, len(tokens), side="right")) - 1
    for k in (band - 1, band):
        if k < 0:
            continue
        m, slack, deletions = plan[k]
        for seed in range(SEEDS):
            key = k * SEEDS + seed
            salt = mix64(np.array([key + 1], np.uint64))[0]
            value = mix64(tokens ^ salt)
            where = (mix64(value + np.uint64(seed)) % np.uint64(m)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            value, where = value[order], where[order]
            size = np.bincount(where, minlength=m)
            sums = np.zeros(m, np.uint64)
            sums[size > 0] = np.add.reduceat(value, (np.cumsum(size) - size)[size > 0])
            names = mix64(np.arange(m, dtype=np.uint64) + salt)
            # a partner's subset may have one element less, and be thin where this one is not
            out, short = (size <= deletions, int((size <= 2 * deletions).sum())) if m > 1 else (np.zeros(m, bool), 0)
            if seed == SEEDS - 1 and short > slack:
                out, short = np.zeros(m, bool), 0
            sigs = mix64(sums ^ names)[~out]
            if deletions:
                kept = ~out[where]
                sigs = np.unique(np.r_[sigs, mix64((sums[where] - value) ^ names[where])[kept]])
            yield key, slack - short, sigs
            if short <= slack:
                break


KNOWN = np.dtype([("set", "<i8"), ("sig", "<u8"), ("key", "<i2"), ("slack", "<i2")])


def emit_signatures(n_buckets: int, lows: list[int], most: int):
    """Signatures, of each at most ``most`` + 1 rows a batch: the rest of more sets know already that it is popular."""
    plan = {k: allocate(lows, k) for k in range(len(lows) - 2)}

    def run(batches):
        for batch in batches:
            parts = []
            for sid, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for key, slack, sigs in signatures(np.frombuffer(blob, np.uint64), lows, plan):
                    rows = np.empty(len(sigs), SIGNATURE)
                    rows["sig"], rows["set"], rows["key"], rows["slack"] = sigs, sid, key, max(-1, min(slack, 32767))
                    parts.append(rows)
            if parts:
                rows = np.concatenate(parts)
                rows = rows[np.lexsort((rows["set"], rows["sig"]))]
                rows = rows[np.r_[True, (rows["sig"][1:] != rows["sig"][:-1]) | (rows["set"][1:] != rows["set"][:-1])]]
                _, place = in_groups(rows["sig"])
                rest = rows[place > most]
                known = np.empty(len(rest), KNOWN)
                for c in KNOWN.names:
                    known[c] = rest[c]
                rows = rows[place <= most]
                yield send((mix64(rows["sig"]) % np.uint64(n_buckets)).astype(np.int32), rows, known, n_buckets)
    return run


GROUPED = "popular boolean, a long, b long, key int, n int, slack_a int, slack_b int, sig long"


def group_signatures(popular_from: int):
    """Pairs with the number of signatures they share here, and the members of popular signatures."""
    names = [x.split()[0] for x in GROUPED.split(", ")]

    def table(popular, a, b, key, count, slack_a, slack_b, sig):
        for at in range(0, len(a), 100_000):
            c = slice(at, at + 100_000)
            cols = [pa.array(np.full(len(a[c]), popular)), *(pa.array(np.ascontiguousarray(x[c])) for x in (a, b, key.astype(np.int32), count.astype(np.int32), slack_a.astype(np.int32), slack_b.astype(np.int32), sig))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        for _, (blobs, known) in buckets(batches):
            told = np.frombuffer(b"".join(known), KNOWN)
            zero = np.zeros(len(told), np.int64)
            yield from table(True, told["set"], zero, told["key"], zero, told["slack"], zero, told["sig"].view(np.int64) if len(told) else zero)
            rows = np.frombuffer(b"".join(blobs), SIGNATURE)
            if not len(rows):
                continue
            rows = rows[np.lexsort((rows["set"], rows["sig"]))]
            rows = rows[np.r_[True, (rows["sig"][1:] != rows["sig"][:-1]) | (rows["set"][1:] != rows["set"][:-1])]]
            n, place = in_groups(rows["sig"])
            left, right = [], []
            for size in range(2, popular_from + 1):
                start = np.flatnonzero((n == size) & (place == 0))
                if len(start):
                    i, j = np.triu_indices(size, 1)
                    left.append((start[:, None] + i).ravel()), right.append((start[:, None] + j).ravel())
            if left:
                x, y = rows[np.concatenate(left)], rows[np.concatenate(right)]
                order = np.lexsort((x["key"], y["set"], x["set"]))
                x, y = x[order], y[order]
                at = np.flatnonzero(np.r_[True, (x["set"][1:] != x["set"][:-1]) | (y["set"][1:] != y["set"][:-1]) | (x["key"][1:] != x["key"][:-1])])
                count = np.diff(np.r_[at, len(x)])
                x, y = x[at], y[at]
                yield from table(False, x["set"], y["set"], x["key"], count, x["slack"], y["slack"], np.zeros(len(x), np.int64))
            many = rows[n > popular_from]
            zero = np.zeros(len(many), np.int64)
            yield from table(True, many["set"], zero, many["key"], zero, many["slack"], zero, many["sig"].view(np.int64) if len(many) else zero)
    return run


def candidate_edges(surviving: DataFrame, lows: list[int], folder: str, shingles: int) -> DataFrame:
    """(a, b): pairs that agree on enough signatures, and stars over popular ones."""
    spark = surviving.sparkSession
    size = shingles * SIGNATURE.itemsize // 2
    sent = surviving.select("set_id", "tokens").mapInArrow(tidy(emit_signatures(bucket_count(spark, size), lows, POPULAR)), SENT)
    grouped = materialize(by_bucket(sent, size).mapInArrow(tidy(group_signatures(POPULAR)), GROUPED), folder, "grouped")
    popular = grouped.where("popular").select(F.col("a").alias("set"), "key", F.col("slack_a").alias("slack"), "sig")
    left_out = materialize(popular.groupBy("set", "key").agg(F.count("*").alias("out"), F.max("slack").alias("slack")), folder, "left_out")
    pairs = (grouped.where("NOT popular").groupBy("a", "b", "key")
             .agg(F.sum("n").alias("n"), F.max("slack_a").alias("slack_a"), F.max("slack_b").alias("slack_b")))
    for side in ("a", "b"):
        out = left_out.select(F.col("set").alias(side), "key", F.col("out").alias(f"out_{side}"))
        pairs = pairs.join(small(out), [side, "key"], "left")
    room = F.greatest(*[F.col(f"slack_{s}") - F.coalesce(F.col(f"out_{s}"), F.lit(0)) for s in ("a", "b")])
    pairs = pairs.where(F.col("n") >= F.greatest(F.lit(1), 1 + room)).select("a", "b")
    kept = materialize(popular.join(small(left_out.where("out > slack").select("set", "key")), ["set", "key"]).select("set", "sig"), folder, "kept")
    hubs = materialize(kept.groupBy("sig").agg(F.min("set").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n"), folder, "hubs")
    stars = join_unique(kept, hubs, ["sig"]).where("hub <> set").select(F.col("hub").alias("a"), F.col("set").alias("b"))
    return pairs.unionByName(stars)


# ---------------------------------------------------------------- components

def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, label): the smallest node of its component, for every node with an edge.

    Each round every node takes the smallest label next to it, then its label's label, and the graph is contracted:
    edges within a label go, so a dense group costs its edges once.  Tables of a round that is over are deleted.
    """
    spark = edges.sparkSession
    keep = lambda df, what: materialize(df, folder, f"{name}_{what}")
    drop = lambda *what: remove(spark, *[f"{folder}/{name}_{x}" for x in what])
    rest = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges0")
    total, step = None, 0
    while True:
        step += 1
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), f"hook{step}")
        if hook.isEmpty():
            drop(f"hook{step}", f"edges{step - 1}")
            break
        up = hook.select(F.col("node").alias("label"), F.col("label").alias("up"))
        near = keep(join_unique(hook, up, ["label"]).select("node", F.col("up").alias("label")), f"near{step}")
        half = keep(join_unique(rest, near.select(F.col("node").alias("a"), F.col("label").alias("la")), ["a"]).select("la", "b"), f"half{step}")
        rest = join_unique(half, near.select(F.col("node").alias("b"), F.col("label").alias("lb")), ["b"])
        rest = keep(rest.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), f"edges{step}")
        drop(f"edges{step - 1}", f"half{step}", f"hook{step}")
        if total is None:
            total = near
        else:
            over = near.select(F.col("node").alias("label"), F.col("label").alias("over"))
            total = keep(join_unique(total, over, ["label"], "left").select("node", F.coalesce("over", "label").alias("label")), f"labels{step}")
            drop(f"near{step}", f"labels{step - 1}" if step > 2 else "near1")
    if total is None:
        return spark.createDataFrame([], "node long, label long")
    least = materialize(total.groupBy("label").agg(F.min("node").alias("least")), folder, f"{name}_least")
    return keep(join_unique(total, least, ["label"]).select("node", F.least("least", "label").alias("label")), "labels")


# ---------------------------------------------------------------- verification

def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(a) > len(b):
        a, b = b, a
    if DEN * len(a) < NUM * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def _tokens(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def verify_cluster(table: pa.Table) -> pa.Table:
    """(set_id, label): the exact components of a small cluster, from all pairs not connected already."""
    ids, sets = table.column("set_id").to_pylist(), _tokens(table.column("tokens"))
    order = np.argsort([len(s) for s in sets], kind="stable").tolist()
    u = Union(len(ids))
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if DEN * len(sets[i]) < NUM * len(sets[j]):
                break
            if u.find(i) != u.find(j) and (ids[i] == ids[j] or similar(sets[i], sets[j])):
                u.join(i, j)
    least: dict[int, int] = {}
    for i, sid in enumerate(ids):
        least[u.find(i)] = min(sid, least.get(u.find(i), sid))
    got = sorted({(sid, least[u.find(i)]) for i, sid in enumerate(ids)})
    return pa.table({"set_id": pa.array([x[0] for x in got], pa.int64()), "label": pa.array([x[1] for x in got], pa.int64())})


def reach(batches):
    """Of (a, b, na, nb, ta, tb): the groups whose popular parts alone reach the threshold at the sets' whole sizes."""
    for batch in batches:
        n = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(_tokens(batch.column(4)), _tokens(batch.column(5)))]
        yield batch.filter(pa.array([DEN * k >= NUM * (i + j - k) for k, (i, j) in zip(both, n)], pa.bool_())).select([0, 1])


def part_tokens(batches):
    """(cluster, id, n, odd, token), a row for each token of a group's popular part."""
    for batch in batches:
        parts = _tokens(batch.column(2))
        row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        token = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
        for at in range(0, len(row), 100_000):
            cut = slice(at, at + 100_000)
            own = [batch.column(i).take(pa.array(row[cut])) for i in (0, 3, 1, 4)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(token[cut])], names=["cluster", "id", "n", "odd", "token"])


def alike_groups(grouped: DataFrame, folder: str) -> DataFrame:
    """(a, b): links of groups of (cluster, n, tokens, id, odd), one of them odd, whose popular parts reach the threshold alone.

    They connect, with the groups that are not odd as connected already, what all such links connect.

    Two that reach the threshold t share at least ``t n`` popular tokens, n the whole size of either: with
    each part's tokens in order of the groups that hold them, fewest first, the prefixes of ``p - ceil(t n) + 1`` meet.
    The index of those prefixes gives the candidates; a place in both, and masks of 256 bits, say how much can be shared.
    """
    save = lambda df, name: materialize(df, folder, f"large_{name}")
    tokens = grouped.select("cluster", "n", "tokens", "id", "odd").mapInArrow(part_tokens, "cluster long, id long, n long, odd int, token long")
    held = tokens.groupBy("cluster", "token").agg(F.count("*").alias("groups"))
    order = F.sort_array(F.collect_list(F.struct("groups", "token"))).alias("order")
    masks = [F.bit_xor(F.expr(f"IF(pmod(token, 256) DIV 64 = {i}, shiftleft(1L, CAST(pmod(token, 64) AS INT)), 0L)")).alias(f"m{i}") for i in range(4)]
    side = ["id", "n", "rest", "p", "m0", "m1", "m2", "m3"]
    ordered = tokens.join(held, ["cluster", "token"]).groupBy("cluster", "id", "n", "odd").agg(order, *masks).withColumn("p", F.size("order"))
    prefix = F.slice("order", 1, (F.col("p") - F.ceil(F.col("n") * NUM / DEN) + 1).cast("int"))
    met = save(ordered.select("*", F.posexplode(prefix).alias("pos", "at")).select("cluster", F.col("at.token").alias("token"), "odd", (F.col("p") - F.col("pos")).alias("rest"), *[c for c in side if c != "rest"]), "prefixes")

    def verified(found, name):
        """The pairs of ``side`` and another, numbered 2, that can reach the threshold, and do.

        Two parts share no more than the rest of either from a common token on, nor than the bits in which their masks differ allow.
        """
        apart = sum(F.bit_count(F.col(f"m{i}").bitwiseXOR(F.col(f"m{i}2"))) for i in range(4))
        enough = NUM * (F.col("n") + F.col("n2"))
        can = ((NUM + DEN) * F.least("rest", "rest2") >= enough) & ((NUM + DEN) * (F.col("p") + F.col("p2") - apart) >= 2 * enough) & (F.col("id") != F.col("id2"))
        pairs = save(found.where(can).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct(), f"{name}_pairs")
        for x in ("a", "b"):
            pairs = pairs.join(grouped.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}")), x)
        return save(pairs.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(reach, "a long, b long"), name)

    # first one group of each list, of the main component where it can be; then only what is not connected by that
    hubs = met.groupBy("cluster", "token").agg(F.min(F.struct("odd", *side)).alias("hub")).select("cluster", "token", *[F.col(f"hub.{c}").alias(f"{c}2") for c in side])
    stars = verified(met.where("odd = 1").join(hubs, ["cluster", "token"]), "stars")
    main = grouped.where("odd = 0").select("cluster", "id")
    main = main.join(main.groupBy("cluster").agg(F.min("id").alias("b")), "cluster").select(F.col("id").alias("a"), "b")
    labels = components(stars.unionByName(main), folder, "group").withColumnRenamed("node", "id")
    known = save(join_unique(met, labels, ["id"], "left").withColumn("label", F.coalesce("label", "id")), "known")
    others = known.select("cluster", "token", *[F.col(c).alias(f"{c}2") for c in (*side, "label")])
    near = stars.unionByName(verified(known.where("odd = 1").join(others, ["cluster", "token"]).where("label <> label2"), "near"))
    p = F.octet_length("tokens") / 8
    within = grouped.where((F.col("odd") == 1) & (DEN * p >= NUM * (2 * F.col("n") - p))).select(F.col("id").alias("a"), F.col("id").alias("b"))
    return save(near.unionByName(within), "alike")


RARE = np.dtype([("token", "<u8"), ("cluster", "<i8"), ("set", "<i8"), ("label", "<i8"), ("odd", "u1")])


def rare_tokens(n_buckets: int):
    """Of (cluster, set_id, label, odd, tokens, popular): (bucket, rows) of the rare tokens by which a partner is met."""
    def run(batches):
        for batch in batches:
            parts = []
            for cluster, sid, label, odd, blob, hot in zip(*(c.to_pylist() for c in batch.columns)):
                tokens, rare, n_popular = split_tokens(blob, hot)
                n = len(tokens)
                wanted = max(1, -(-NUM * n // DEN) - n_popular)  # rare tokens that a partner shares at least, if any
                if len(rare) >= wanted:
                    rows = np.empty(len(rare) - wanted + 1, RARE)
                    rows["token"], rows["cluster"], rows["set"], rows["label"], rows["odd"] = rare[: len(rows)], cluster, sid, label, odd
                    parts.append(rows)
            if parts:
                rows = np.concatenate(parts)
                yield packed((mix64(rows["token"] + rows["cluster"].view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32), rows)
    return run


def split_tokens(blob: bytes, popular: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(all, rare, number of popular ones) of a set's sorted tokens."""
    tokens = np.frombuffer(blob, np.uint64)
    known = np.frombuffer(popular or b"", np.uint64)
    if not len(known):
        return tokens, tokens, 0
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    hot = known[at] == tokens
    return tokens, tokens[~hot], int(hot.sum())


def rare_pairs(batches):
    """(a, b): an odd set and another of its cluster, of another label, that share a rare token."""
    for _, (blobs,) in buckets(batches):
        rows = np.frombuffer(b"".join(blobs), RARE)
        rows = rows[np.lexsort((rows["set"], rows["cluster"], rows["token"]))]
        cut = np.flatnonzero(np.r_[True, (rows["token"][1:] != rows["token"][:-1]) | (rows["cluster"][1:] != rows["cluster"][:-1])])
        for x, y in zip(cut, np.r_[cut[1:], len(rows)]):
            group = rows[x:y]
            odd = group[group["odd"] == 1]
            if len(odd) and (group["label"] != group["label"][0]).any():
                i, j = np.nonzero(odd["label"][:, None] != group["label"][None, :])
                a, b = odd["set"][i], group["set"][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def popular_parts(batches):
    """(id, cluster, n, tokens, odd): the popular part of each set that can have a partner without sharing a rare token."""
    names = ["id", "cluster", "n", "tokens", "odd"]
    for batch in batches:
        rows = []
        for cluster, sid, _, odd, blob, hot in zip(*(c.to_pylist() for c in batch.columns)):
            tokens, rare, n_popular = split_tokens(blob, hot)
            if DEN * n_popular >= NUM * len(tokens):
                rows.append((sid, cluster, len(tokens), np.setdiff1d(tokens, rare, assume_unique=True).tobytes(), odd))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()))], names=names)


def large_links(members: DataFrame, folder: str, shingles: int) -> DataFrame:
    """(a, b) links of clusters too large for one task, from (set_id, tokens, cluster, size).

    Sets that pivots do not join to the cluster's main component are odd.  A token of more than ``CLUSTER`` sets of the
    cluster is popular there.  A partner of an odd set shares a rare token with it, and then one among those
    that a prefix of its rare ones holds; or it does not, and then the popular parts of the two reach the
    threshold alone.  The first are found through an inverted index of rare tokens, each in few sets; the second through
    one of the distinct (popular part, size) groups' prefixes (``alike_groups``), whose members are then alike.
    """
    spark = members.sparkSession
    save = lambda df, name: materialize(df, folder, f"large_{name}")
    salts = F.ceil(F.col("size") / SALTED).cast("int")
    members = save(members.select("set_id", "tokens", "cluster", "size").withColumn("salt", F.pmod(F.xxhash64("set_id"), salts.cast("long")).cast("int")), "members")
    # set ids are hashes: one in so many, by id, is a random choice of about PIVOTS a cluster; the smallest id is always one
    one_in = F.greatest(F.col("size") / F.lit(PIVOTS), F.lit(1.0)).cast("long")
    pivots = save(members.where((F.col("set_id") == F.col("cluster")) | (F.pmod(F.xxhash64("set_id", F.lit(1)), one_in) == 0))
                  .select("cluster", "size", F.col("set_id").alias("pivot"), F.col("tokens").alias("pivot_tokens")).distinct(), "pivots")

    def against(batches):
        for batch in batches:
            a, b = _tokens(batch.column(2)), _tokens(batch.column(3))
            yield batch.filter(pa.array([similar(x, y) for x, y in zip(a, b)], pa.bool_())).select([0, 1])

    everywhere = lambda df: small(df.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("size"))
    met = members.join(everywhere(pivots), ["cluster", "salt"]).where("pivot <> set_id")
    first = save(met.select(F.col("pivot").alias("a"), F.col("set_id").alias("b"), "pivot_tokens", "tokens").mapInArrow(against, "a long, b long"), "pivot_links")
    labels = components(first, folder, "pivot")
    labelled = save(members.drop("size").join(small(labels.withColumnRenamed("node", "set_id")), "set_id", "left").withColumn("label", F.coalesce("label", "set_id")), "labelled")
    sizes = labelled.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    main = save(sizes.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("size"), F.count("*").alias("labels")).where("labels > 1"), "main")
    if main.isEmpty():
        return first
    left = labelled.join(everywhere(main.select("cluster", "main", "size")), ["cluster", "salt"]).withColumn("odd", (F.col("label") != F.col("main")).cast("int"))

    def each_token(batches):
        for batch in batches:
            counts: dict[int, list[np.ndarray]] = {}
            for c, t in zip(batch.column(0).to_pylist(), _tokens(batch.column(1))):
                counts.setdefault(c, []).append(t)
            for c, parts in counts.items():
                t, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), c)), pa.array(t.view(np.int64)), pa.array(n)], names=["cluster", "token", "n"])

    def sorted_blob(key, table):
        return pa.table({"cluster": pa.array([key[0].as_py()], pa.int64()), "popular": pa.array([np.sort(table.column("token").to_numpy().view(np.uint64)).tobytes()], pa.binary())})

    counts = left.select("cluster", "tokens").mapInArrow(each_token, "cluster long, token long, n long").groupBy("cluster", "token").agg(F.sum("n").alias("n"))
    popular = save(counts.where(F.col("n") > CLUSTER).groupBy("cluster").applyInArrow(sorted_blob, "cluster long, popular binary"), "popular")
    popular = main.select("cluster", "size").join(popular, "cluster")
    rows = save(left.join(everywhere(popular), ["cluster", "salt"], "left").select("cluster", "set_id", "label", "odd", "tokens", "popular"), "rows")
    size = shingles * RARE.itemsize
    pairs = by_bucket(rows.mapInArrow(rare_tokens(bucket_count(spark, size)), "bucket int, rows binary"), size).mapInArrow(rare_pairs, "a long, b long").distinct()
    sets = rows.select("set_id", "tokens").distinct()
    pairs = save(pairs, "pairs")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("set_id").alias(side), F.col("tokens").alias(f"t{side}")), side)
    near = pairs.select("a", "b", "ta", "tb").mapInArrow(against, "a long, b long")
    parts = save(rows.mapInArrow(popular_parts, "id long, cluster long, n long, tokens binary, odd int"), "parts")
    grouped = save(parts.groupBy("cluster", "n", "tokens").agg(F.min("id").alias("id"), F.max("odd").alias("odd")), "groups")
    members_of = parts.join(grouped.select("cluster", "n", "tokens", F.col("id").alias("group")), ["cluster", "n", "tokens"]).select("id", "group")
    alike = alike_groups(grouped, folder)
    # every member of a group is linked to every member of a group alike: to its first one, that is
    partner = alike.unionByName(alike.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
    through = members_of.join(partner, F.col("group") == F.col("a")).select(F.col("id").alias("a"), "b")
    return first.unionByName(near).unionByName(alike).unionByName(through)


# ---------------------------------------------------------------- the join

def set_components(docs: DataFrame, sets: DataFrame, folder: str, k: int = K) -> DataFrame:
    """(set_id, label) for the sets that are linked with another set, from (doc_id, check, text) and their sets."""
    spark = docs.sparkSession
    shingles = sets.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_NULL_ID)))
    nodes = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.max("n_shingles").alias("n"), F.min(F.struct(key.alias("id"), "check")).alias("at"))
    size = shingles * PREFIX.itemsize * 3 // 10
    prefixes = docs.select("text").mapInArrow(tidy(emit_prefixes(bucket_count(spark, size), k)), SENT)
    counted = by_bucket(prefixes, size).mapInArrow(tidy(shared_prefixes), "set_id long, n long").groupBy("set_id").agg(F.sum("n").alias("shared"))
    wanted = nodes.join(counted, "set_id").where(F.col("shared") >= F.floor(F.col("n") / 20) + 1)
    wanted = materialize(wanted.select(F.col("at.id").alias("id"), F.col("at.check").alias("check"), F.col("set_id").alias("wanted"), "n"), folder, "wanted")
    stats = wanted.agg(F.count("*").alias("rows"), F.max("n").alias("largest"), F.sum("n").alias("shingles")).first()
    if not stats["rows"]:
        return spark.createDataFrame([], "set_id long, label long")
    texts = docs.withColumn("id", key).join(wanted.select("id", "check", "wanted").hint("merge"), ["id", "check"]).select("wanted", "text")

    def keep(batches):
        for batch in batches:
            wanted_ids = batch.column(0).to_pylist()
            rows = [(wanted_ids[i], s.tobytes()) for i, s in shingle_sets(batch, 1, k) if set_id(s) == wanted_ids[i]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["set_id", "tokens"])

    surviving = materialize(texts.mapInArrow(tidy(keep), "set_id long, tokens binary"), folder, "surviving")
    edges = candidate_edges(surviving, bands(stats["largest"]), folder, stats["shingles"])
    clusters = components(edges, folder, "cluster")
    remove(spark, *[f"{folder}/{x}" for x in ("wanted", "grouped", "left_out", "kept", "hubs")])
    sizes = materialize(clusters.groupBy("label").agg(F.count("*").alias("size")), folder, "sizes")
    placed = materialize(join_unique(clusters, sizes, ["label"]).select(F.col("node").alias("set_id"), F.col("label").alias("cluster"), "size"), folder, "placed")
    members = materialize(surviving.join(placed.hint("merge"), "set_id"), folder, "members")  # the sets travel once, whatever the number of clusters
    remove(spark, f"{folder}/surviving")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-8 * int(stats["shingles"]) // TASK_BYTES))
    few = members.where(F.col("size") <= CLUSTER).repartition(parts, "cluster").groupBy("cluster").applyInArrow(verify_cluster, "set_id long, label long")
    labels = materialize(few, folder, "small_labels")
    if not placed.where(F.col("size") > CLUSTER).isEmpty():
        links = large_links(members.where(F.col("size") > CLUSTER), folder, stats["shingles"])
        labels = labels.unionByName(components(links, folder, "linked").select(F.col("node").alias("set_id"), "label"))
    return labels


def _components(docs: DataFrame, folder: str, k: int) -> DataFrame:
    """(doc_id, check, n_shingles, component_id) of every row of (doc_id, check, text)."""
    spark = docs.sparkSession
    sets = materialize(describe_sets(docs, k), folder, "sets")
    labels = set_components(docs, sets, folder, k)
    # equal sets are one class; a class's component is its label, or itself
    classes = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes.join(small(labels), "set_id", "left").withColumn("label", F.coalesce("label", "set_id")), folder, "classes")
    smallest = classes.groupBy("label").agg(F.min("least").alias("component"), F.sum("copies").alias("rows")).where("rows > 1").drop("rows")
    linked = materialize(join_unique(classes.select("set_id", "label"), materialize(smallest, folder, "smallest"), ["label"]).select("set_id", "component"), folder, "linked")
    remove(spark, *[f"{folder}/{x}" for x in ("members", "placed", "sizes", "small_labels", "classes", "smallest")])
    none, some = sets.where("set_id IS NULL"), sets.where("set_id IS NOT NULL")
    out = join_unique(some, linked, ["set_id"], "left").select("doc_id", "check", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.unionByName(none.select("doc_id", "check", "n_shingles", F.col("doc_id").alias("component_id")))


def _checked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.crc32("text"), F.lit(0)).alias("check"), "text")


def join_components(docs: DataFrame, folder: str | None = None, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return _components(_checked(docs), folder or shared_dir(docs.sparkSession), k).drop("check")


def deduplicate(docs: DataFrame, folder: str | None = None, k: int = K) -> DataFrame:
    """``docs`` with one row of each component: a row of the smallest doc_id; rows that repeat an id and a text count as one."""
    folder = folder or shared_dir(docs.sparkSession)
    found = materialize(_components(_checked(docs), folder, k), folder, "components")
    remove(docs.sparkSession, f"{folder}/sets", f"{folder}/linked")
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_NULL_ID)))
    other = F.col("component_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("component_id") != F.col("doc_id")))
    gone = materialize(found.where(other).select(id_.alias("id"), "check").distinct(), folder, "gone")
    rows = carried(docs, id_.alias("id"), F.coalesce(F.crc32("text"), F.lit(0)).alias("check"))
    return rows.join(gone.hint("merge"), ["id", "check"], "left_anti").select("row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return join_components(docs)
