"""The daily budget as a keyed stateful stream: one counter a day, admitted while the day has room."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.budget import allowance

OUTPUT = "day string, event_id long, admitted boolean"


class DayCounter(StatefulProcessor):
    """Counts a day's admitted checks; refused ones cost nothing."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        room = max(0, self.limit - (self.spent.get()[0] if self.spent.exists() else 0))
        first = pd.DataFrame({"ts": pd.Series(dtype="datetime64[ns]"), "event_id": pd.Series(dtype="int64")})
        for part in rows:  # at most ``room`` checks and one piece of the micro-batch are held
            got = (pd.concat([first, part[["ts", "event_id"]]]) if len(first) else part[["ts", "event_id"]]).sort_values(["ts", "event_id"])
            first, refused = got.iloc[:room], got.iloc[room:]
            if len(refused):
                yield pd.DataFrame({"day": key[0], "event_id": refused["event_id"].to_numpy(), "admitted": False})
        if len(first):
            self.spent.update((self.limit - room + len(first),))
            yield pd.DataFrame({"day": key[0], "event_id": first["event_id"].to_numpy(), "admitted": True})

    def close(self) -> None:
        pass


def admit_stream(checks: DataFrame, limit: Decimal | str) -> DataFrame:
    """(day, event_id, admitted) of a stream of (event_id, ts); needs the RocksDB state store."""
    days = checks.select(F.to_date("ts").cast("string").alias("day"), "event_id", "ts")
    return days.groupBy("day").transformWithStateInPandas(DayCounter(allowance(limit)), OUTPUT, "Append", "None")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(store, before)


def run_once(checks: DataFrame, limit: Decimal | str, folder: str) -> DataFrame:
    """Run a bounded stream to its end; ``folder`` takes its state and its rows, and is shared by all executors."""
    spark = checks.sparkSession
    with rocksdb(spark):
        query = (admit_stream(checks, limit).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
                 .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{folder}/rows")
