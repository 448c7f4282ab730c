"""Retention of jobs as a stateful stream: running jobs and the newest finished ones stay, older finished ones go.

Jobs are dealt to shards by a hash of their number.  A shard's state is the numbers of its newest ``keep`` finished jobs and nothing else, so it
is bounded however many jobs there are; the newest of all are among those.  The stream writes a log of (created_seq, finished, kept): a job
enters when it is created, a finished one leaves the log's store once ``keep`` newer ones of its shard have
finished.  No job comes back, so the log needs no versions: a job is finished if any of its rows says so, and gone if any says that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.batch import FINISHED_JOBS, retain
from .budget import rocksdb

LOG = "created_seq long, finished boolean, kept boolean"


class NewestFinished(StatefulProcessor):
    """The newest finished jobs of a shard."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getListState("newest", "created_seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = np.array([x[0] for x in self.newest.get()] if self.newest.exists() else [], np.int64)
        now = before
        for part in rows:  # what is kept and one piece of the micro-batch are held
            done = part["finished"].to_numpy(bool)
            if (~done).any():
                yield pd.DataFrame({"created_seq": part["created_seq"].to_numpy()[~done], "finished": False, "kept": True})
            ended = np.unique(np.concatenate([now, part["created_seq"].to_numpy(np.int64)[done]]))
            now, gone = ended[-self.keep :] if self.keep else ended[:0], ended[: max(0, len(ended) - self.keep)]
            if len(gone):
                yield pd.DataFrame({"created_seq": gone, "finished": True, "kept": False})
        if not np.array_equal(now, before):
            self.newest.put([(int(x),) for x in now])
            entered = np.setdiff1d(now, before)
            yield pd.DataFrame({"created_seq": entered, "finished": True, "kept": True})

    def close(self) -> None:
        pass


def retain_stream(jobs: DataFrame, keep: int = FINISHED_JOBS, shards: int = 32) -> DataFrame:
    """The log of a stream of (created_seq, finished); a job that runs comes again when it has finished.  Needs the RocksDB state store."""
    shard = F.pmod(F.xxhash64("created_seq"), F.lit(shards)).cast("int").alias("shard")
    dealt = jobs.where("created_seq IS NOT NULL").select(shard, "created_seq", F.coalesce("finished", F.lit(False)).alias("finished"))
    return dealt.groupBy("shard").transformWithStateInPandas(NewestFinished(keep), LOG, "Append", "None")


def run_once(jobs: DataFrame, folder: str, keep: int = FINISHED_JOBS, shards: int = 32) -> None:
    """Bring the log in ``folder`` up to date with a stream, from where the run before stopped."""
    with rocksdb(jobs.sparkSession):
        (retain_stream(jobs, keep, shards).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/log")
         .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()).awaitTermination()


def store(spark, folder: str, keep: int = FINISHED_JOBS) -> DataFrame:
    """(created_seq, finished) of the jobs that stay."""
    log = spark.read.schema(LOG).parquet(f"{folder}/log")
    jobs = log.groupBy("created_seq").agg(F.bool_or("finished").alias("finished"), F.bool_and("kept").alias("kept"))
    return retain(jobs.where("kept").drop("kept"), keep)
