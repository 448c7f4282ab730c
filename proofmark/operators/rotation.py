"""Sideways labels: the first rotation whose read holds the statement is added to the upright read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, shared_dir
from .gate import blob, confirms_exactly

#: The order of attempts.
ROTATIONS = (90, 180, 270)


def pick(attempts: DataFrame) -> DataFrame:
    """(label_id, rotation): of (label_id, attempt, rotation, contains_reference) the first that holds it."""
    return attempts.where("contains_reference").groupBy("label_id").agg(F.min_by("rotation", "attempt").alias("rotation"))


def recover(labels: DataFrame, reads: DataFrame, reference: str) -> DataFrame:
    """``labels`` with the lines of the first rotation (label_id, rotation, lines) that holds the reference, after the upright ones.

    Only labels whose upright read lacks it take part in the join.
    """
    lacks = F.col("ocr_lines").isNotNull() & ~confirms_exactly(F.lit(reference), blob(F.col("ocr_lines")))
    order = F.array_position(F.array(*[F.lit(r) for r in ROTATIONS]), F.col("rotation"))
    fits = reads.where(F.col("rotation").isin(*ROTATIONS) & confirms_exactly(F.lit(reference), blob(F.col("lines"))))
    best = fits.groupBy("label_id").agg(F.min_by(F.struct("rotation", "lines"), order).alias("best"))
    turned = F.transform("best.lines", lambda x: x.withField("rotation", F.col("best.rotation").cast("int")).withField("pos", x["pos"] + 1_000_000))
    joined = labels.withColumn("__lacks", lacks).join(best, "label_id", "left")
    return joined.withColumn("ocr_lines", F.when(F.col("__lacks") & F.col("best").isNotNull(), F.concat("ocr_lines", turned)).otherwise(F.col("ocr_lines"))).drop("__lacks", "best")


def retry(labels: DataFrame, read: Callable[[DataFrame], DataFrame], reference: str, folder: str | None = None) -> DataFrame:
    """``labels`` after at most three more reads of those whose upright read lacks the reference.

    ``read`` turns (label_id, rotation) rows into (label_id, rotation, lines).  A label is asked for the next rotation
    only while none held the reference, and the first that does is added to the upright lines.  Which labels are asked and what a turn gave
    are written to the shared folder, so no label is read twice at a turn, however often the result is computed.
    """
    folder = folder or shared_dir(labels.sparkSession)
    lacks = F.col("ocr_lines").isNotNull() & ~confirms_exactly(F.lit(reference), blob(F.col("ocr_lines")))
    open_ = materialize(labels.where(lacks).select("label_id"), folder, "asked0")
    hits = None
    for turn in ROTATIONS:
        holds = (F.col("rotation") == turn) & confirms_exactly(F.lit(reference), blob(F.col("lines")))
        got = read(open_.withColumn("rotation", F.lit(turn))).select("label_id", "rotation", F.when(holds, F.col("lines")).alias("lines"))
        got = materialize(got, folder, f"read{turn}").where("lines IS NOT NULL")
        hits = got if hits is None else hits.unionByName(got)
        if turn != ROTATIONS[-1]:
            open_ = materialize(open_.join(got.select("label_id"), "label_id", "left_anti"), folder, f"asked{turn}")
    return recover(labels, hits, reference)


def parse_option(text) -> F.Column:
    """0, 90, 180 or 270; null for anything else."""
    return F.when(text.isin("0", *[str(r) for r in ROTATIONS]), text.cast("int"))
