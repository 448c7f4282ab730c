"""Compaction of many small files by a first-fit plan, made in SQL and executed.

``deal`` writes a table as Parquet, one file for each (day, lot, piece).  ``plan_groups`` packs the small files of every day: SQL collects
a day's files, largest first, into one array, ``aggregate()`` folds it into an array of groups, each file joining the
earliest group that can still hold it, and an ``explode`` makes the groups rows.  ``execute`` writes each group of several files as one, its
rows in the order of the files and of the rows within them, moves it to its place and deletes what it replaces; other files
are not touched.  ``inspect`` reads final files, each in one task and batch by batch.

What is collected in one place is a day's small files, at most four a lot; lots grow with a day's share of all rows and not with their number.  A file is
written and read by one task, streaming: it has to be one file.  Plans go from step to step as tables; they are broadcast within the
session's bound by their size.

Recovery: both writes go through Spark's commit protocol.  Groups are written to a hidden folder; only when all are there does each get its place and lose
its sources, in tasks that can be run again at any point (what is moved or gone already is left).  The plan is a table of its own, so
``settle`` can finish a compaction whose driver was lost.

Defined results: a null time is a day of its own (null), a null id is hashed as '' and comes first; rows that repeat are kept and share a file; nulls and
texts of any length in other columns are copied; an empty table gives no files and no rows; extra columns are copied whatever their names
(those of the folders then get a trailing underscore).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import join_unique, materialize, remove, shared_dir, small
from .warc import filesystem, run_spread


def share(rows: int, parts: int) -> int:
    """Rows of a file that holds one of so many parts of the table."""
    return 1 + rows // parts


def folder_names(columns: list[str]) -> list[str]:
    """Names of the partition columns: those of no column of the table."""
    taken, out = {c.lower() for c in columns}, []
    for name in ("day", "lot", "piece"):
        while name in taken:
            name += "_"
        out.append(name)
    return out


def deal(rows: DataFrame, folder: str, work: str, time: str = "arrived_at", key: str = "click_id", parts: int = 150) -> int:
    """Write a file for each (day, lot, piece), sorted by time and key; returns the number of rows."""
    spark = rows.sparkSession
    day, lot, piece = folder_names(rows.columns)
    date = F.unix_date(F.col(f"`{time}`").cast("date")).cast("long")
    per_day = rows.select(F.coalesce(date, F.lit(-(1 << 40))).alias("__day")).groupBy("__day").agg(F.count("*").alias("__rows"))
    days = materialize(per_day, work, "days")
    total = days.agg(F.sum("__rows")).first()[0] or 0
    h = F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    placed = join_unique(rows.select("*", date.alias(day), F.coalesce(date, F.lit(-(1 << 40))).alias("__day")), days, ["__day"])
    placed = placed.withColumns({lot: F.floor(h / 16) % (1 + F.floor(F.col("__rows") / share(total, parts))), piece: F.least(h % 4, F.floor(h / 4) % 4)}).drop("__day", "__rows")
    order = [day, lot, piece, f"`{time}`", f"`{key}`"]
    (placed.select(*[f"`{c}`" for c in rows.columns], day, lot, piece).repartition(day, lot, piece).sortWithinPartitions(*order)
     .write.partitionBy(day, lot, piece).option("maxRecordsPerFile", 0).parquet(folder))
    spark.catalog.refreshByPath(folder)
    return total


def read_files(spark: SparkSession, schema, folder: str) -> DataFrame:
    """The rows of a folder with their (day, lot, piece) as ``__day``, ``__lot``, ``__piece``, file and place in it."""
    names = folder_names(schema.fieldNames())
    typed = StructType([*schema.fields, *[StructField(n, LongType()) for n in names]])
    rows = spark.read.schema(typed).parquet(folder)
    return rows.select(*[f"`{c}`" for c in schema.fieldNames()], *[F.col(n).alias(f"__{k}") for n, k in zip(names, ("day", "lot", "piece"))],
                       F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))


def file_table(spark: SparkSession, schema, folder: str) -> DataFrame:
    """(day, lot, piece, path, n_rows) of the files of a folder."""
    rows = read_files(spark, schema, folder).select("__day", "__lot", "__piece", "__path")
    return rows.groupBy(F.col("__day").alias("day"), F.col("__lot").alias("lot"), F.col("__piece").alias("piece"), F.col("__path").alias("path")).agg(F.count("*").alias("n_rows"))


_FILE = "struct<down: bigint, lot: bigint, piece: bigint, n_rows: bigint, path: string>"

#: A row a final file: its day, and the files that it holds in order.
PLAN = f"""
WITH days AS (
  SELECT day, sort_array(collect_list(struct(-n_rows AS down, lot, piece, n_rows, path))) AS files
  FROM {{files}} WHERE n_rows < {{under}} GROUP BY day),
folded AS (
  SELECT day, aggregate(
    files,
    CAST(array() AS array<struct<n_rows: bigint, files: array<{_FILE}>>>),
    (groups, f) -> transform(
      array(array_position(transform(groups, g -> g.n_rows + f.n_rows <= {{most}}), true)),
      fits -> if(fits = 0,
        concat(groups, array(named_struct('n_rows', f.n_rows, 'files', array(f)))),
        transform(groups, (g, i) -> if(i + 1 = fits, named_struct('n_rows', g.n_rows + f.n_rows, 'files', concat(g.files, array(f))), g))))[0]) AS groups
  FROM days)
SELECT day, g.files FROM folded LATERAL VIEW explode(groups) AS g
UNION ALL
SELECT day, array(struct(-n_rows AS down, lot, piece, n_rows, path)) AS files FROM {{files}} WHERE n_rows >= {{under}}
"""


def plan_groups(files: DataFrame, under: int, most: int) -> DataFrame:
    """(day, lot, piece, rewritten, files): the final files; lot and piece are those of the first source."""
    groups = files.sparkSession.sql(PLAN, files=files, under=under, most=most)
    return groups.select("day", F.col("files")[0]["lot"].alias("lot"), F.col("files")[0]["piece"].alias("piece"), (F.size("files") > 1).alias("rewritten"), "files")


def execute(spark: SparkSession, schema, folder: str, plan: DataFrame) -> DataFrame:
    """Write every group of several files as one file under ``_merged``, rows in the order of files and places.

    Returns the plan with the file ``staged`` for each group; has to be written before ``settle`` moves files.
    """
    day, lot, piece = folder_names(schema.fieldNames())
    moves = plan.where("rewritten").select(F.col("day").alias(day), F.col("lot").alias(lot), F.col("piece").alias(piece), F.posexplode("files").alias("__at", "__file"))
    moves = moves.select(day, lot, piece, "__at", F.col("__file.lot").alias("__of_lot"), F.col("__file.piece").alias("__of_piece"))
    rows = read_files(spark, schema, folder)
    same = (F.col("__lot") == F.col("__of_lot")) & (F.col("__piece") == F.col("__of_piece")) & F.col("__day").eqNullSafe(F.col(day))
    merged = rows.join(small(moves), same).select(*[f"`{c}`" for c in schema.fieldNames()], day, lot, piece, "__at", "__row")
    (merged.repartition(day, lot, piece).sortWithinPartitions(day, lot, piece, "__at", "__row").drop("__at", "__row")
     .write.mode("overwrite").partitionBy(day, lot, piece).option("maxRecordsPerFile", 0).parquet(f"{folder}/_merged"))
    staged = file_table(spark, schema, f"{folder}/_merged").withColumnsRenamed({"day": "m_day", "lot": "m_lot", "piece": "m_piece", "path": "staged"})
    same = F.col("rewritten") & F.col("day").eqNullSafe(F.col("m_day")) & (F.col("lot") == F.col("m_lot")) & (F.col("piece") == F.col("m_piece"))
    return plan.join(staged, same, "left").select("day", "lot", "piece", "rewritten", "files", "staged")


FINAL = f"day long, lot long, piece long, rewritten boolean, files array<{_FILE}>, path string"


def settle(staged: DataFrame) -> DataFrame:
    """Give the written groups their places and delete their sources; the plan with the ``path`` of each final file.

    Every task can be run again: it finds what is done already.
    """
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                new, r["path"] = r.pop("staged"), r["files"][0]["path"]
                if r["rewritten"]:
                    if new is None:
                        raise ValueError(f"no file was written for the group of {r['path']}")
                    r["path"] = f"{r['path'].rpartition('/')[0]}/{new.rpartition('/')[2]}"
                    place(new, r["path"], [f["path"] for f in r["files"]])
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema.remove(batch.schema.get_field_index("staged")).append(pa.field("path", pa.string())))

    return run_spread(staged, run, FINAL)


def place(staged: str, path: str, sources: list[str]) -> None:
    from pyarrow.fs import FileType

    fs, at = filesystem(staged)
    to = filesystem(path)[1]
    beside = lambda p: f"{p.rpartition('/')[0]}/.{p.rpartition('/')[2]}.crc"  # noqa: E731  checksums of a local folder
    is_file = lambda p: fs.get_file_info(p).type == FileType.File
    for a, b in ((at, to), (beside(at), beside(to))):
        if is_file(a):
            fs.move(a, b)
    if not is_file(to):
        raise ValueError(f"{path} is not there")
    for s in sources:
        s = filesystem(s)[1]
        for p in (s, beside(s)):
            if is_file(p):
                fs.delete_file(p)


REPORT = "day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, sources string, ids_sha256 string, columns string, path string, rewritten boolean"


def inspect(files: DataFrame, key: str = "click_id", amount: str = "value") -> DataFrame:
    """What final files hold, read back batch by batch: ``REPORT``."""
    def run(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                fs, path = filesystem(r["path"])
                digest, n, cents, low, high = hashlib.sha256(), 0, 0, None, None
                with fs.open_input_file(path) as source:
                    file = pq.ParquetFile(source)
                    for part in file.iter_batches(1 << 15, columns=[key, amount], use_threads=False):
                        ids, value = part.column(0), part.column(1)
                        text = pc.binary_join(pa.array([pc.fill_null(pc.cast(ids, pa.string()), "").to_pylist()], pa.list_(pa.string())), ",")[0].as_py()
                        digest.update((("," if n else "") + text).encode())
                        n += len(part)
                        value = pc.fill_null(value.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
                        cents += sum(int(x) for x in np.floor(100 * value[np.isfinite(value)] + 0.5).tolist())
                        ends = pc.min_max(ids).as_py()
                        if ends["min"] is not None:
                            low, high = min(ends["min"], ends["min"] if low is None else low), max(ends["max"], ends["max"] if high is None else high)
                    names = file.schema_arrow.names
                out.append({"day": r["day"], "lot": r["lot"], "piece": r["piece"], "n_rows": n, "min_click_id": low, "max_click_id": high, "cents": cents, "sources": ",".join(f"{f['lot']}-{f['piece']}" for f in r["files"]),
                            "ids_sha256": digest.hexdigest(), "columns": ",".join(names), "path": r["path"], "rewritten": r["rewritten"]})
            types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(c, types[t]) for c, t in (x.split() for x in REPORT.split(", "))]))

    return run_spread(files, run, REPORT)


def compact(rows: DataFrame, folder: str | None = None, parts: int = 150, under: int = 600, most: int = 400) -> DataFrame:
    """Write ``rows`` to a new folder, compact it there and report its files; S of a number is the rows of that part of the table."""
    spark = rows.sparkSession
    folder, work = folder or f"{shared_dir(spark)}/table", shared_dir(spark)
    total = deal(rows, folder, work, parts=parts)
    if not total:
        return spark.createDataFrame([], REPORT)
    files = materialize(file_table(spark, rows.schema, folder), work, "files")
    plan = materialize(plan_groups(files, share(total, under), share(total, most)), work, "plan")
    staged = materialize(execute(spark, rows.schema, folder, plan), work, "staged")
    final = materialize(settle(staged), work, "final")
    remove(spark, f"{folder}/_merged")  # empty folders by now
    return inspect(final)


def op12(spark, sf_dir: str) -> DataFrame:
    return compact(spark.read.parquet(f"{sf_dir}/clicks.parquet"))
