"""Incremental batches: labels are checked as they arrive, results and counts grow with every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.batch import summary, to_items
from ..operators.verify import verify
from ..rulebook import Rulebook
from ..sources.images import read_files

#: Files of a micro-batch, so that they can be numbered together.
FILES = 1000


def land_stream(arrivals: DataFrame, check: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str, *by: str) -> StreamingQuery:
    """Start a query over a stream; ``check`` turns a micro-batch and its number into batch items (with the columns ``by``).

    A micro-batch writes its items to ``out`` under its own number, so one that is run again replaces itself, and then the counts of all that
    has landed (``history``).
    """
    def land(rows: DataFrame, number: int) -> None:
        check(rows, number).write.mode("overwrite").parquet(f"{out}/items/batch={number}")
        progress(rows.sparkSession, out, *by).coalesce(1).write.mode("overwrite").parquet(f"{out}/progress/batch={number}")

    return arrivals.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_batch(spark: SparkSession, path: str, extract: Callable[[DataFrame], DataFrame], rulebook: Rulebook, out: str, checkpoint: str) -> StreamingQuery:
    """Start a query over the image files of a folder; ``extract`` turns accepted files into ``model.LABEL`` rows.

    Files are numbered as they were uploaded: micro-batch after micro-batch, and within one by time and name; ``label_id`` is that number.
    A file that is turned down is an error row; the others go on.
    """
    def check(files: DataFrame, number: int) -> DataFrame:
        place = F.row_number().over(Window.orderBy("modified", "place")) - 1  # at most FILES rows
        files = files.drop("content").withColumn("label_id", place + F.lit(number) * FILES).join(files.select("place", "content"), "place")
        rejected = files.where("problem IS NOT NULL").select(F.col("label_id").alias("pos"), "filename", F.col("problem").alias("detail"))
        return to_items(verify(extract(files.where("problem IS NULL")), rulebook), rejected=rejected)

    return land_stream(read_files(spark, path, stream=True, most=FILES), check, out, checkpoint)


def progress(spark: SparkSession, out: str, *by: str) -> DataFrame:
    """Counts over what has landed so far."""
    return summary(spark.read.option("basePath", f"{out}/items").parquet(f"{out}/items/batch=*"), *by)


def history(spark: SparkSession, out: str) -> DataFrame:
    """The counts after each micro-batch, with its number as ``batch``."""
    return spark.read.option("basePath", f"{out}/progress").parquet(f"{out}/progress/batch=*")
