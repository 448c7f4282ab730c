"""Exact top-k search by distributed histogram selection.

Vectors become integers and are packed into blocks of candidates and blocks of queries, both tables in shared storage.
Every block of queries meets every block of candidates of its dimension: the queries are broadcast if
measured to be small, otherwise candidates and queries are dealt out over a grid of cells, each of bounded size.  One pass scores all pairs
and counts the scores in a histogram a query; from the summed histograms the bin that holds the global k-th value is
found for all queries together and refined until it is one score wide, so the number of passes depends on
the range of the scores and not on the number of queries.  Thresholds live beside the queries, not in the driver.
Since the global k-th value is no less than a task's own k-th, a task sends only its bins from the top down to that,
at most k a query.  Then a last pass keeps scores from the threshold up and breaks ties by the smaller id; of
equal scores a task sends at most k, which is enough as ids decide.

Scores are exact: float64 products where the norms prove every partial sum below 2**53, 64-bit integers
where they prove it below 2**63, otherwise Python integers for the rows concerned alone.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows with a null id; empty vectors score 0; vectors meet only those of their own length; repeated ids are
rows of their own: each such query is answered, and another row of its id is a candidate like any; fewer than k
candidates give all of them; a score beyond 64 bits counts as the largest or smallest number of 64 bits; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, spread

#: Bytes of queries that are broadcast, or that a cell of the grid holds.
QUERY_BYTES = 8 << 20
#: Rows of a block of candidates, and queries of a block on average.
ROWS, QUERIES = 4096, 1024
BINS = 128
#: Numbers of counts, or candidates, that a task gathers before it sends them on.
HELD = 1 << 22
_PLAIN = 2.0**52  # squared norms below it: products of such rows are below 2**52
BLOCK = "block long, dim int, ids binary, vectors binary, ask binary, top double"
QUERY = "dim int, ids binary, vectors binary, home binary, place binary, top double"


def pack(most: int):
    """(block, dim, ids, vectors, ask, top): blocks of at most ``most`` rows of whole numbers as doubles; ``top``: the largest squared norm."""
    out = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("ask", pa.binary()), ("top", pa.float64())])
    limit = np.finfo(np.float64).max / 4

    def run(batches):
        for batch in batches:
            groups: dict[int, list] = {}
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                groups.setdefault(len(row[1]), []).append(row)
            rows = []
            for dim, got in groups.items():
                for at in range(0, len(got), most):
                    part = got[at : at + most]
                    with np.errstate(over="ignore"):
                        v = np.clip(np.floor(64 * np.array([x for _, x, _ in part], dtype=np.float64).reshape(len(part), dim)), -limit, limit)
                        top = float((v * v).sum(1).max(initial=0))
                    rows.append((0, dim, np.array([x for x, _, _ in part], dtype=np.int64).tobytes(), v.tobytes(), np.array([bool(q) for _, _, q in part]).tobytes(), top))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)
    return run


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as int64, exactly, at the ends of 64 bits where it is beyond them."""
    with np.errstate(over="ignore", invalid="ignore"):
        norm_a, norm_b = (a * a).sum(1), (b * b).sum(1)
        plain_a, plain_b = norm_a < _PLAIN, norm_b < _PLAIN
        if plain_a.all() and plain_b.all():
            return (a @ b.T).astype(np.int64)
        top_a, top_b = norm_a.max(initial=0), norm_b.max(initial=0)
        if top_a < 2.0**62 and top_b < 2.0**62 and top_a * top_b < 2.0**124:
            return a.astype(np.int64) @ b.astype(np.int64).T
        out = np.zeros((len(a), len(b)), np.int64)
        out[np.ix_(plain_a, plain_b)] = (a[plain_a] @ b[plain_b].T).astype(np.int64)
    ends = np.iinfo(np.int64)
    whole = lambda x: np.array([[int(y) for y in r] for r in x], dtype=object).reshape(x.shape)
    exact = lambda x, y: np.clip((whole(x) @ whole(y).T) if x.shape[1] else np.zeros((len(x), len(y)), object), ends.min, ends.max).astype(np.int64)
    if (~plain_a).any():
        out[~plain_a] = exact(a[~plain_a], b)
    if plain_a.any() and (~plain_b).any():
        out[np.ix_(plain_a, ~plain_b)] = exact(a[plain_a], b[~plain_b])
    return out


def ask(batches):
    """The queries of each block, with the block and place they stand at."""
    names = [x.split()[0] for x in QUERY.split(", ")]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            at = np.flatnonzero(np.frombuffer(r["ask"], bool))
            if len(at):
                v = np.frombuffer(r["vectors"], np.float64).reshape(len(r["ids"]) // 8, r["dim"])[at]
                rows.append((r["dim"], np.frombuffer(r["ids"], np.int64)[at].tobytes(), v.tobytes(), np.full(len(at), r["block"], np.int64).tobytes(), at.astype(np.int64).tobytes(), r["top"]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 4, pa.float64()])], names=names)


def _join_pieces(key, table):
    """The queries of a group, some QUERIES of them, as one block."""
    whole = {c: pa.array([b"".join(table.column(c).to_pylist())], pa.binary()) for c in ("ids", "vectors", "home", "place")}
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), **whole, "top": pa.array([max(table.column("top").to_pylist())], pa.float64())})


class Pairs:
    """Rows of a candidate block and a query block as arrays, scored, with the query's own row masked out."""

    def __init__(self, batches):
        self.batches = batches

    def __iter__(self):
        for batch in self.batches:
            for r in batch.to_pylist():
                c_ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                c, q = (np.frombuffer(r[x], np.float64).reshape(n, r["dim"]) for x, n in (("vectors", len(c_ids)), ("q_vectors", len(q_ids))))
                other = np.ones((len(q_ids), len(c_ids)), bool)
                own = np.flatnonzero(np.frombuffer(r["home"], np.int64) == r["block"])
                other[own, np.frombuffer(r["place"], np.int64)[own]] = False
                yield r["q_block"], q_ids, c_ids, scores(q, c), other, np.frombuffer(r["low"], np.int64)


def count_scores(span: int, width: int, k: int):
    """(q_block, query, bin, n): counts of one refinement, bins of ``width`` over the ``span`` from each query's own low end."""
    n_bins = -(-span // width)

    def send(block, total):
        n = total[:, :n_bins]
        down = n[:, ::-1].cumsum(1)[:, ::-1] - n + total[:, n_bins:]  # scores above the bin
        q, b = np.nonzero((n > 0) & (down < k))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), block, np.int64)), pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n[q, b])], names=["q_block", "query", "bin", "n"])

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for block, q_ids, _, s, other, low in Pairs(batches):
            t = total.setdefault(block, np.zeros((len(q_ids), n_bins + 1), np.int64))  # the last column: above all bins
            above = s >= low[:, None]
            over = np.where(above, s - np.where(above, low[:, None], s), 0).astype(np.uint64)
            b = np.where(over > np.uint64(span - 1), n_bins, (over // np.uint64(width)).astype(np.int64))
            ok = other & above
            t += np.bincount((np.arange(len(q_ids))[:, None] * (n_bins + 1) + b)[ok], minlength=t.size).reshape(t.shape)
            if sum(x.size for x in total.values()) > HELD:
                yield from (send(b, x) for b, x in total.items())
                total = {}
        yield from (send(b, x) for b, x in total.items())
    return run


def pick_scores(k: int):
    """(q_block, query, query_id, vec_id, score): the task's own best k of each query, from its threshold up."""
    names = ["q_block", "query", "query_id", "vec_id", "score"]

    def run(batches):
        best: dict[int, list[np.ndarray]] = {}

        def send():
            for block, (q, i, v, x) in best.items():
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), block, np.int64)), pa.array(q.astype(np.int32)), pa.array(i), pa.array(v), pa.array(x)], names=names)

        for block, q_ids, c_ids, s, other, low in Pairs(batches):
            q, c = np.nonzero(other & (s >= low[:, None]))
            new = [q, q_ids[q], c_ids[c], s[q, c]]
            q, i, v, x = (np.concatenate(p) for p in zip(best[block], new)) if block in best else new
            order = np.lexsort((v, ~x, q))  # ~x falls as x grows, without overflow
            q, i, v, x = q[order], i[order], v[order], x[order]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
            best[block] = [y[rank < k] for y in (q, i, v, x)]
            if sum(len(y[0]) for y in best.values()) > HELD // 4:
                yield from send()
                best.clear()
        yield from send()
    return run


def _refined(width: int, k: int):
    """Move each query's low end to the bin that holds what is left to find; (q_block, low, need)."""
    def run(key, left, right):
        if not left.num_rows:  # cannot be: every count belongs to a block
            return left.select(["q_block", "low", "need"])
        low, need = (np.frombuffer(left.column(c)[0].as_py(), np.int64).copy() for c in ("low", "need"))
        q, b, n = (right.column(c).to_numpy() for c in ("query", "bin", "n"))
        order = np.lexsort((-b.astype(np.int64), q))
        q, b, n = q[order], b[order].astype(np.int64), n[order]
        start = np.searchsorted(q, np.arange(len(low) + 1))
        for i in range(len(low)):
            upto = np.cumsum(n[start[i] : start[i + 1]])
            at = int(np.searchsorted(upto, need[i]))
            if at < len(upto):
                need[i] -= upto[at - 1] if at else 0
                low[i] += b[start[i] + at] * width
            else:
                need[i] = k  # fewer candidates than k: everything from the lowest score up
        return pa.table({"q_block": left.column("q_block").slice(0, 1), "low": pa.array([low.tobytes()], pa.binary()), "need": pa.array([need.tobytes()], pa.binary())})
    return run


def _first_ends(start: int, k: int):
    """The low end and the number to find that every query begins with."""
    def run(batches):
        for batch in batches:
            n = [len(x) // 8 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([np.full(m, x, np.int64).tobytes() for m in n], pa.binary()) for x in (start, k))], names=["q_block", "low", "need"])
    return run


def _pairs(packed: DataFrame, queries: DataFrame, ends: DataFrame, size: int) -> DataFrame:
    """Every block of queries, with its low ends, beside every block of candidates of its dimension.

    Beyond a broadcast, candidates fall into G groups and queries into H; a cell of the grid gets one of each, so H bounds
    what a cell has to hold and G how many candidates stream past it.
    """
    asked = queries.select("q_block", "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "home", "place").join(ends.select("q_block", "low"), "q_block")
    blocks = packed.select("block", "dim", "ids", "vectors")
    if size <= QUERY_BYTES:
        return blocks.join(F.broadcast(asked), "dim")
    h = -(-size // QUERY_BYTES)
    g = max(1, -(-int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")) // h))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = blocks.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(g)).cast("int")).withColumn("h", each(h))
    asked = asked.withColumn("h", F.pmod(F.xxhash64("q_block"), F.lit(h)).cast("int")).withColumn("g", each(g))
    return blocks.join(asked, ["dim", "g", "h"])


def exact_topk(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
               folder: str | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every query row."""
    spark = vectors.sparkSession
    folder = folder or shared_dir(spark)
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    packed = materialize(fine.mapInArrow(pack(ROWS), BLOCK).withColumn("block", F.monotonically_increasing_id()), folder, "packed")
    count = F.octet_length("ids") / 8
    pieces = materialize(packed.mapInArrow(ask, QUERY), folder, "pieces")
    sizes = {r["dim"]: r for r in pieces.groupBy("dim").agg(F.sum(count).alias("n"), F.max("top").alias("top"), F.sum(F.octet_length("vectors")).alias("bytes")).collect()}
    tops = {r["dim"]: r["top"] for r in packed.groupBy("dim").agg(F.max("top").alias("top")).collect()}
    result = "query_id long, rank int, vec_id long, score long"
    if not sizes:
        return spark.createDataFrame([], result)
    groups = F.element_at(F.create_map(*[F.lit(x) for d, r in sizes.items() for x in (d, -(-int(r["n"]) // QUERIES))]), F.col("dim"))
    asked = pieces.withColumn("g", F.pmod(F.xxhash64("home", "place"), groups)).groupBy("dim", "g").applyInArrow(_join_pieces, QUERY)
    bound = min(np.iinfo(np.int64).max // 4, max(int(min((r["top"] * tops[d]) ** 0.5, 2.0**62) * 1.000001) + 2 for d, r in sizes.items()))
    huge = any(not r["top"] * tops[d] < 2.0**120 for d, r in sizes.items())
    start, span = (np.iinfo(np.int64).min, 1 << 64) if huge else (-bound, 2 * bound + 1)
    queries = materialize(asked.withColumn("q_block", F.monotonically_increasing_id()), folder, "queries")
    ends = materialize(queries.select("q_block", "ids").mapInArrow(_first_ends(start, k), "q_block long, low binary, need binary"), folder, "ends0")
    total = sum(r["bytes"] for r in sizes.values())
    step = 0
    while True:
        width = -(-span // BINS)
        pairs = _pairs(packed, queries, ends, total)
        counts = pairs.mapInArrow(count_scores(span, width, k), "q_block long, query int, bin int, n long")
        counts = counts.groupBy("q_block", "query", "bin").agg(F.sum("n").alias("n"))
        moved = ends.groupBy("q_block").cogroup(counts.groupBy("q_block")).applyInArrow(_refined(width, k), "q_block long, low binary, need binary")
        step += 1
        ends = materialize(moved, folder, f"ends{step}")
        if width == 1:
            break
        span = width
    rows = _pairs(packed, queries, ends, total).mapInArrow(pick_scores(k), "q_block long, query int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q_block", "query").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    vectors = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return exact_topk(vectors, F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
