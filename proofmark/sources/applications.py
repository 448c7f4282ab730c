"""The CSV of filed applications, and the sinks of batch results."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pairing_key
from ..operators.batch import BATCH_FILES, grid
from ..rulebook import Rulebook

COLUMNS = ("filename", "brand_name", "class_type", "fanciful_name")
CSV_BYTES = 5 << 20
NO_CSV = "The applications file is not a CSV file."
#: Control characters, and what stands for bytes that are not UTF-8.
NOT_TEXT = re.compile("[\x00-\x1f\ufffd]")


class ApplicationsError(ValueError):
    """The upload is no usable CSV of applications; the message may be shown."""


def parse(data: bytes) -> list[tuple[int, str, str, str, str]]:
    """(pos, filename, brand_name, class_type, fanciful_name) of an upload of at most 5 MB.

    Headers count without case and blanks; rows without a file name are left out.
    """
    if len(data) > CSV_BYTES:
        raise ApplicationsError("The applications file is larger than 5 MB.")
    try:
        table = list(csv.reader(io.StringIO(data.decode("utf-8-sig", errors="replace"), newline="")))
    except csv.Error as e:
        raise ApplicationsError(NO_CSV) from e
    if not table or not table[0]:
        return []
    places = _places([x.strip().lower() for x in table[0]])
    found = []
    for pos, row in enumerate(table[1:]):
        cell = dict(enumerate(row))
        values = [cell.get(places.get(c, -1), "").strip() for c in COLUMNS]
        if values[0]:
            found.append((pos, *values))
    return found


def _places(names: list[str]) -> dict[str, int]:
    """Where each header stands, the last of equal ones; an error unless they can be headers of applications."""
    if NOT_TEXT.search("".join(names)):
        raise ApplicationsError(NO_CSV)
    places = dict(zip(names, range(len(names))))
    if COLUMNS[0] not in places:
        raise ApplicationsError(f"The applications file has no column named {COLUMNS[0]}.")
    return places


def last_wins(rows: DataFrame) -> DataFrame:
    """One row a key of (pos, filename, ...): the last one filed.  An aggregate, so it combines before the shuffle."""
    last = F.max_by(F.struct("filename", "brand_name", "class_type", "fanciful_name"), "pos").alias("r")
    return rows.groupBy(pairing_key(F.col("filename")).alias("key")).agg(last).select("key", "r.*")


def from_upload(spark: SparkSession, data: bytes) -> DataFrame:
    """(key, filename, brand_name, class_type, fanciful_name) of an uploaded file."""
    schema = "pos int, filename string, brand_name string, class_type string, fanciful_name string"
    return last_wins(spark.createDataFrame(parse(data), schema))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """The same from files of any size; the order of rows within a file and of file names decides."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    names = [c.lstrip("﻿").strip().lower() for c in raw.columns]
    _places(names)
    raw = raw.toDF(*names).withColumn("pos", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    cells = [F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) if c in names else F.lit("").alias(c) for c in COLUMNS]
    return last_wins(raw.select("pos", *cells).where("filename <> ''"))


def write_grid(items: DataFrame, rulebook: Rulebook, path: str) -> None:
    """The grid of one upload as one CSV file, in the order of upload; more items than one may have go to ``sources.export``."""
    if items.limit(BATCH_FILES + 1).count() > BATCH_FILES:
        raise ApplicationsError(f"One file takes at most {BATCH_FILES} items.")
    ordered = items.coalesce(1).sortWithinPartitions("grp", "pos")
    grid(ordered, rulebook).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def progress_json(counts: DataFrame, items: DataFrame, pairing: DataFrame) -> DataFrame:
    """One row of JSON: counts, pairing and the items of a batch in order; more items than a batch may hold are an error."""
    one = F.struct("grp", "pos", "filename", "status", "verdict", "detail")
    rows = items.limit(BATCH_FILES + 1).agg(F.array_sort(F.collect_list(one)).alias("items"))
    whole = F.when(F.size("items") > BATCH_FILES, F.raise_error(F.lit(f"a batch has at most {BATCH_FILES} items"))).otherwise(F.col("items"))
    shown = F.transform(whole, lambda i: F.struct(i["filename"].alias("filename"), i["status"].alias("status"), i["verdict"].alias("verdict"), i["detail"].alias("detail")))
    keys = ("pass", "needs_review", "fail", "error", "not_evaluable")
    return counts.crossJoin(pairing).crossJoin(rows).select(  # one row each
        F.to_json(F.struct("total", "done", F.struct(*keys).alias("summary"), "csv_rows", "csv_unmatched", shown.alias("items")), {"ignoreNullFields": "false"}).alias("json"))


def status(reader: Column, ocr: Column) -> Column:
    """ok where both ways of reading a label are reachable, else degraded."""
    return F.when(reader & ocr, "ok").otherwise("degraded")


def health(spark: SparkSession, version: str, rules: int, reader: bool, ocr: bool) -> DataFrame:
    """One row on what is loaded and reachable."""
    row = spark.createDataFrame([(version, rules, reader, ocr)], "rulebook_version string, rules int, reader boolean, ocr boolean")
    return row.select(status(F.col("reader"), F.col("ocr")).alias("status"), "*")
