"""The daily budget: every check costs the same, so a day admits its first N."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import commit_new, names, read_file

#: Fixed value: price of a check in dollars.
COST = Decimal("0.005")


def allowance(limit: Decimal | str) -> int:
    return int(Decimal(limit) / COST)


def admit(checks: DataFrame, limit: Decimal | str, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """``checks`` with day and admitted, in order of time within each day of the session's time zone.

    Only a day's first N can be admitted, so the window is cut to N rows in every task before the shuffle; what it gives
    is one row a day, the last that is admitted, and the checks themselves stay where they are.
    """
    n = allowance(limit)
    days = checks.withColumn("day", F.to_date(ts))
    order = F.struct(ts, key)
    first = Window.partitionBy("day").orderBy(ts, key)
    ranked = days.select("day", ts, key).withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= n)
    last = ranked.groupBy("day").agg(F.max(order).alias("__last"))
    # a row a day: a thousand years are under half a million
    return days.join(F.broadcast(last), "day", "left").withColumn("admitted", F.coalesce(order <= F.col("__last"), F.lit(False))).drop("__last")


class Ledger:
    """What a day has spent, in a folder that all drivers share: each reservation is a numbered record, and of two writers of one number one tries again.

    A reservation is made before the reader is asked, so no number of batches at once goes past the limit.
    """

    def __init__(self, spark: SparkSession, folder: str, limit: Decimal | str):
        self.spark, self.folder, self.room = spark, folder.rstrip("/"), allowance(limit)

    def reserved(self, day: str) -> tuple[int, int]:
        """(records, checks) of a day."""
        known = [x for x in names(self.spark, f"{self.folder}/{day}") if x.isdigit()]
        return (int(known[-1]), json.loads(read_file(self.spark, f"{self.folder}/{day}/{known[-1]}"))["reserved"]) if known else (0, 0)

    def reserve(self, checks: int, day: str) -> int:
        """How many of so many checks the day still admits; those are accounted for."""
        while True:
            number, before = self.reserved(day)
            granted = max(0, min(checks, self.room - before))
            if not granted or commit_new(self.spark, f"{self.folder}/{day}/{number + 1:08d}", json.dumps({"reserved": before + granted, "granted": granted}).encode()):
                return granted
