"""Batch results as ordered files: a sink whose tasks write parts and whose commit publishes them in the order of upload.

``proofmark_export`` is a data source writer in Python.  Rows come in ranges of their order, one range a task, so the parts in the order of their
ranges are the whole.  A task writes a part under a name of its own attempt and reports it; the commit checks that the ranges follow each other and
writes a manifest that lists the parts.  An aborted write deletes its parts, and what no manifest names is no part of the export.
Nothing but names and counts passes through the driver, and no task gets more than its range.

Formats: ``csv`` (header in the first part only, so the parts put together are one file) and ``json`` (one object a line).
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.batch import grid
from ..rulebook import Rulebook
from ..storage import materialize, remove, shared_dir

FORMAT = "proofmark_export"
MANIFEST = "_manifest.json"
#: Rows of a part.
PART_ROWS = 250_000
_ORDER = ("__grp", "__pos")


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int
    first: list
    last: list


class Export(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> PartWriter:
        return PartWriter(self.options, schema.names)


class PartWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.kind = options["path"], options.get("kind", "csv")
        if self.kind not in ("csv", "json"):
            raise ValueError(f"no such kind of export: {self.kind}")
        if list(columns[: len(_ORDER)]) != list(_ORDER):
            raise ValueError(f"an export starts with the columns {_ORDER}")
        self.columns = list(columns[len(_ORDER) :])

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Part:
        store, root = self._open()
        name, n, first, last = f"part-{uuid.uuid4().hex}.{self.kind}", 0, [], []
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            text = io.StringIO(newline="")
            writer = csv.writer(text, lineterminator="\n")
            for row in iterator:
                order, values = list(row[: len(_ORDER)]), row[len(_ORDER) :]
                if last and order < last:
                    raise ValueError("the rows of a part are out of order")
                first, last, n = first or order, order, n + 1
                if self.kind == "csv":
                    writer.writerow(["" if v is None else v for v in values])
                else:
                    text.write(json.dumps(dict(zip(self.columns, values)), ensure_ascii=False) + "\n")
                if text.tell() >= 1 << 20:
                    out.write(text.getvalue().encode())
                    text.seek(0)
                    text.truncate()
            out.write(text.getvalue().encode())
        return Part(name, n, first, last)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = self._open()
        done = [m for m in messages if m is not None]
        for m in done:
            if not m.rows:
                store.delete_file(f"{root}/{m.name}")
        parts = sorted((m for m in done if m.rows), key=lambda m: m.first)
        for a, b in zip(parts, parts[1:]):
            if not a.last < b.first:
                raise ValueError("the ranges of an export overlap")
        head = io.StringIO(newline="")
        csv.writer(head, lineterminator="\n").writerow(self.columns)
        record = {"kind": self.kind, "columns": self.columns, "rows": sum(m.rows for m in parts), "header": head.getvalue() if self.kind == "csv" else "", "parts": [{"name": m.name, "rows": m.rows} for m in parts]}
        beside = f"{root}/.{uuid.uuid4().hex}"
        store.create_dir(root, recursive=True)
        with store.open_output_stream(beside, compression=None) as out:
            out.write(json.dumps(record).encode())
        store.move(beside, f"{root}/{MANIFEST}")

    def abort(self, messages: list[Part | None]) -> None:
        store, root = self._open()
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.name}")


def write_rows(rows: DataFrame, grp: str, pos: str, path: str, kind: str = "csv") -> None:
    """Write the other columns of ``rows`` in the order of (grp, pos), which no two rows share, to a new folder.

    The rows are written once before: they are counted, their ranges found and dealt out, and each would compute them again.
    """
    spark = rows.sparkSession
    spark.dataSource.register(Export)
    folder = shared_dir(spark)
    rows = materialize(rows, folder, "rows")
    n = max(1, -(-rows.count() // PART_ROWS))
    ordered = rows.select(F.col(grp).cast("long").alias("__grp"), F.col(pos).cast("long").alias("__pos"), *[c for c in rows.columns if c not in (grp, pos)])
    ordered = ordered.repartitionByRange(n, *_ORDER).sortWithinPartitions(*_ORDER)
    ordered.write.format(FORMAT).option("path", path).option("kind", kind).mode("append").save()
    remove(spark, folder)


def write_grid(items: DataFrame, rulebook: Rulebook, path: str) -> None:
    """The grid of a batch of any size as CSV parts in the order of upload."""
    write_rows(grid(items, rulebook, "grp", "pos"), "grp", "pos", path)


def write_progress(items: DataFrame, path: str) -> None:
    """The items of a batch of any size as JSON lines in the order of upload."""
    write_rows(items.select("grp", "pos", "filename", "status", "verdict", "detail"), "grp", "pos", path, "json")


def manifest(path: str) -> dict:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def pieces(path: str) -> Iterator[bytes]:
    """The export as one stream of bytes, for a download."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    known = manifest(path)
    yield known["header"].encode()
    for part in known["parts"]:
        with store.open_input_stream(f"{root}/{part['name']}", compression=None) as f:
            while data := f.read(1 << 20):
                yield data


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(place, *columns) of an export, every column text: place counts from 1 in the order of the parts and their rows."""
    known = manifest(path)
    schema = ", ".join(f"`{c}` string" for c in known["columns"])
    if not known["parts"]:
        return spark.createDataFrame([], f"place long, {schema}")
    starts, n = {}, 0
    for p in known["parts"]:
        starts[p["name"]] = n
        n += p["rows"]
    files = [f"{path}/{name}" for name in starts]
    rows = (spark.read.schema(schema).option("escape", '"').option("multiLine", True).option("emptyValue", "").option("nullValue", "\x00").csv(files) if known["kind"] == "csv"
            else spark.read.schema(schema).json(files))
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
    first = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), name)
    rows = rows.select("*", name.alias("__part"), first.alias("__first"), F.monotonically_increasing_id().alias("__id"))
    place = F.col("__first") + F.row_number().over(Window.partitionBy("__part").orderBy("__id"))  # ids grow along a file; it has about PART_ROWS rows
    cell = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if known["kind"] == "csv" else F.col(f"`{c}`")
    return rows.select(place.cast("long").alias("place"), *[cell(c) for c in known["columns"]])
