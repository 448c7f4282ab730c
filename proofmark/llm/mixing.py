"""Mixing sources to target weights by capped water-filling.

Sources, in code-point order with null last, get cyclic weights and share a word budget.  A
source is clamped at ``max_epochs`` times its size and its excess goes to the others by weight
until none is above its cap.  Each turn of that loop is one sum over the table of sources (one row each),
which never meets in one task: with the level (words a unit of weight) at which the budget is used up, sources whose cap is below it
are clamped, and the level rises to what the others share.

Within a source each document is taken ``floor(rate)`` times; the fractional repetition goes to
the documents whose seeded hash bin is at most the bin at which the running sum of words comes
nearest to what is left.  The sums are per source and bin, so a source with a third of all rows
is summed by every task first and never meets in one of them.

Defined results: a null text has size 0; a null source is a source of its own; sources of size
0 get target 0; rows of null doc_id are put into seeded random bins one by one by their places in the table, so that the remainder is cut among them even where all are
equal (reruns over the same files agree); copies of a row with one doc_id share a bin; an empty table gives no rows;
extra columns pass through whatever their names, unless named as one of the columns made here, which replace them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, carried, join_unique, materialize, remove, shared_dir, spread, unpacked_row

MADE = ["size", "source_size", "target", "taken"]


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def in_order(sources: DataFrame, folder: str) -> DataFrame:
    """(source, source_size, pos): sources numbered from 0 by code point, null last, by ranges and not in one task."""
    spark = sources.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), folder, "sources")
    before, starts = 0, []
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # a row a range
        starts.append((r["part"], before))
        before += r["count"]
    first = F.broadcast(spark.createDataFrame(starts, "part int, first long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("place", place).join(first, "part").select("source", "source_size", (F.col("first") + F.col("place")).alias("pos"))


def source_targets(sizes: DataFrame, folder: str, weights=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(source, source_size, target) from rows of (source, size)."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    src = in_order(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), folder)
    src = src.withColumn("w", weight).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    src = materialize(src.withColumn("ratio", F.col("cap") / F.col("w")), folder, "weighted")
    whole = (src.agg(F.sum("source_size")).first()[0] or 0) * float(budget)
    clamped, level = -1, 0.0
    while True:
        under = F.col("ratio") <= level if clamped >= 0 else F.lit(False)
        r = src.agg(F.count_if(under).alias("n"), F.sum(F.when(under, F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(under, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if r["n"] == clamped or not r["w"]:
            break
        clamped, level = r["n"], (whole - r["cap"]) / r["w"]
    return src.select("source", "source_size", F.when(F.col("ratio") <= level, F.col("cap")).otherwise(F.col("w") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, weights=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2, seed: int = 1,
        folder: str | None = None) -> DataFrame:
    """``docs`` with size, source_size, target (of the source) and taken (words, repeats counted)."""
    folder = folder or shared_dir(docs.sparkSession)
    columns = [c for c in docs.columns if c not in MADE]
    hashed = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}"))), 1, 3), 16, 10).cast("int")
    dealt = F.floor(F.rand(seed) * 4096).cast("int")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))  # a null source has a key, too
    made = [key.alias("key"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")]
    nameless = materialize(carried(docs.where("doc_id IS NULL"), *made, dealt.alias("bin")), folder, "nameless")  # written, as a bin is drawn once
    sized = carried(docs.where("doc_id IS NOT NULL"), *made, hashed.alias("bin")).unionByName(nameless)
    bins = materialize(sized.groupBy("key", "source", "bin").agg(F.sum("size").alias("size")), folder, "bins")
    targets = source_targets(bins, folder, weights, budget, max_epochs)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key"), "source_size", "target")
    upto = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 4096 bins a source at most
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.col("target") - F.col("whole") * F.col("source_size")
    plan = (
        join_unique(bins.drop("source"), targets, ["key"])
        .withColumn("whole", whole)
        .withColumn("middle", F.sum("size").over(upto) - F.col("size") / 2)
        .groupBy("key", "source_size", "target", "whole")
        .agg(F.coalesce(F.max(F.when(F.col("middle") <= left, F.col("bin"))), F.lit(-1)).alias("cut"))
    )
    plan = materialize(plan, folder, "plan")
    remove(docs.sparkSession, *[f"{folder}/{x}" for x in ("bins", "sources", "weighted")])
    joined = join_unique(sized, plan, ["key"])
    taken = F.col("size") * (F.col("whole") + (F.col("bin") <= F.col("cut")).cast("long"))
    return joined.select(*unpacked_row(joined, columns), "size", "source_size", "target", taken.alias("taken"))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return mix(docs).select("doc_id", *MADE)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':1'), 1, 3))::INT AS bin FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS ss, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS pos FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][pos % 3 + 1]::DOUBLE AS w, 2 * ss AS cap, sum(ss) OVER () * 1.5 AS budget FROM s),
r AS (SELECT *, cap / w AS ratio, sum(w) OVER () AS w_all FROM w),
p AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
             coalesce(sum(w) OVER (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before FROM r),
c AS (SELECT *, ratio <= (budget - cap_before) / (w_all - w_before) AS clamped FROM p),
t AS (SELECT source, ss, CASE WHEN clamped THEN cap ELSE w * ((budget - coalesce(sum(cap) FILTER (clamped) OVER (), 0)) / (sum(w) FILTER (NOT clamped) OVER ())) END AS target FROM c),
f AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS whole FROM t),
b AS (SELECT source, bin, sum(size)::DOUBLE AS size FROM d GROUP BY source, bin),
m AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY bin) - size / 2 AS middle FROM b),
k AS (SELECT f.source, any_value(ss) AS ss, any_value(target) AS target, any_value(whole) AS whole,
             coalesce(max(CASE WHEN middle <= target - whole * ss THEN bin END), -1) AS cut
      FROM f JOIN m ON f.source IS NOT DISTINCT FROM m.source GROUP BY f.source)
SELECT doc_id, size, ss::BIGINT AS source_size, target, (size * (whole + (bin <= cut)::INT))::BIGINT AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
