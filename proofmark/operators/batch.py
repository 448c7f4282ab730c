"""Batch steps: pairing labels with filings, rollups, retention, the export grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import neutralize_csv_cell, pairing_key
from ..model import APPLICATION, SEVERITY
from ..rulebook import Rulebook

# Limits of an upload.
FILE_BYTES, CSV_BYTES, BATCH_BYTES, BATCH_FILES = 5 << 20, 5 << 20, 1600 << 20, 1000
FINISHED_JOBS = 50
#: What an error row says if its cause is not for showing.
FAILED = "The label could not be checked."


def pair(labels: DataFrame, applications: DataFrame) -> DataFrame:
    """Every label with the filing of its file name; without one, an empty filing.

    ``applications`` has one row a key (``sources.applications``).  The join is the same merge join at every size: the optimizer's size
    of a table that is derived, not read, is a small part of what a broadcast of it takes.
    """
    filed = applications.select("key", F.struct("brand_name", "class_type", "fanciful_name").alias("application")).hint("merge")
    empty = F.struct(*[F.lit("").alias(f) for f in APPLICATION.names])
    joined = labels.drop("application").withColumn("key", pairing_key(F.col("filename"))).join(filed, "key", "left")
    return joined.withColumn("matched", F.col("application").isNotNull()).withColumn("application", F.coalesce("application", empty)).drop("key")


def pairing_counts(labels: DataFrame, applications: DataFrame) -> DataFrame:
    """(csv_rows, csv_unmatched): distinct filed keys, and distinct uploaded keys that have none."""
    keys = labels.select(pairing_key(F.col("filename")).alias("key")).distinct()
    unmatched = keys.join(applications.select("key").distinct(), "key", "left_anti").agg(F.count("*").alias("csv_unmatched"))
    return applications.agg(F.countDistinct("key").alias("csv_rows")).crossJoin(unmatched)  # one row each


def pairing_gate(labels: DataFrame, applications: DataFrame, *by: str) -> DataFrame:
    """(*by, uploaded, matched, problem): distinct uploaded keys, those that are filed too, and why a batch is turned down.

    The keys in common are an intersection, so both sides shrink to distinct keys before they meet.
    """
    keys = labels.select(*by, pairing_key(F.col("filename")).alias("key"))
    shared = keys.intersect(applications.select(*by, "key")).groupBy(*by).agg(F.count("*").alias("matched"))
    uploaded = keys.groupBy(*by).agg(F.countDistinct("key").alias("uploaded"))
    joined = uploaded.join(shared, list(by), "left") if by else uploaded.crossJoin(shared)  # one row each
    return joined.withColumn("matched", F.coalesce("matched", F.lit(0).cast("long"))).withColumn(
        "problem", F.when(F.col("matched") == 0, "The applications file matches none of the images."))


def summary(items: DataFrame, *by: str) -> DataFrame:
    """Counts of a batch from (status, verdict): every key is there, pending rows only count in the total."""
    of = lambda v: F.count_if((F.col("status") != "error") & (F.col("verdict") == v))
    done = F.count_if(F.col("status") != "pending")
    return items.groupBy(*by).agg(
        *[of(v).alias(v) for v in ("pass", "needs_review", "fail", "not_evaluable")], F.count_if(F.col("status") == "error").alias("error"),
        F.count("*").alias("total"), done.alias("done"), (done == F.count("*")).alias("finished"))


def headline(findings: Column, verdict: Column) -> Column:
    """One line for a report: the worst finding's detail, first in rule order; for a pass, what was not checked."""
    skipped = F.filter(findings, lambda f: f["verdict"] == "not_evaluable")
    rank = lambda v: F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), v)
    first = F.array_min(F.transform(findings, lambda f: F.struct(rank(f["verdict"]).alias("s"), f["rule_pos"].alias("p"), f["detail"].alias("d"))))
    passed = (F.when(F.size(skipped) == 0, "Every check passed.")
              .when(F.size(skipped) == 1, F.concat(F.lit("Every check that ran passed. Left out: "), F.try_element_at(skipped, F.lit(1))["detail"]))
              .otherwise(F.concat(F.lit("Every check that ran passed; left out: "), F.size(skipped).cast("string"))))
    return F.when(verdict == "pass", passed).otherwise(F.coalesce(first["d"], F.lit("There are no findings.")))


def rule_map(findings: Column) -> Column:
    """rule id -> verdict."""
    return F.map_from_entries(F.transform(findings, lambda f: F.struct(f["rule_id"], f["verdict"])))


def isolate(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels that were read, and error rows (*columns, detail) of those whose reading failed.

    ``reader_error`` is a message that may be shown, ``failed`` any other failure.  One label's failure is its own.
    """
    bad = F.col("reader_error").isNotNull() | F.coalesce("failed", F.lit(False))
    errors = labels.where(bad).withColumn("detail", F.coalesce("reader_error", F.lit(FAILED)))
    return labels.where(~bad).drop("reader_error", "failed"), errors.drop("reader_error", "failed")


def _bare(rows: DataFrame, group: int, status: str, detail: Column, keep: tuple[str, ...]) -> DataFrame:
    return rows.select(
        F.lit(group).alias("grp"), F.col("pos").cast("long").alias("pos"), "filename", F.lit(status).alias("status"), F.lit(None).cast("string").alias("verdict"),
        detail.alias("detail"), F.create_map().cast("map<string,string>").alias("rule_verdicts"), *keep)


def to_items(reports: DataFrame, errors: DataFrame | None = None, rejected: DataFrame | None = None, pending: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Batch items: reports, labels that failed (pos, filename, detail) and labels that wait (pos, filename) in the order
    of upload, and after them the rejected files (pos, filename, detail).  ``keep`` names columns that all of them have."""
    items = reports.select(
        F.lit(0).alias("grp"), F.col("label_id").alias("pos"), "filename", F.lit("done").alias("status"), "verdict",
        headline(F.col("findings"), F.col("verdict")).alias("detail"), rule_map(F.col("findings")).alias("rule_verdicts"), *keep)
    for rows, group, status, detail in ((errors, 0, "error", F.col("detail")), (pending, 0, "pending", F.lit(None).cast("string")), (rejected, 1, "error", F.col("detail"))):
        if rows is not None:
            items = items.unionByName(_bare(rows, group, status, detail, keep))
    return items


def in_order(items: DataFrame, *by: str) -> DataFrame:
    """``items`` with ``place``: 1, 2, ... within each batch."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("grp", "pos")))


def grid(items: DataFrame, rulebook: Rulebook, *keep: str) -> DataFrame:
    """The export: filename, status, verdict, detail and a column a rule, safe for spreadsheets.

    Rows are not sorted here: ``sources.applications.write_grid`` sorts a batch when it writes it.
    """
    safe = lambda c: neutralize_csv_cell(F.coalesce(c, F.lit("")))
    return items.select(
        *keep, *[safe(F.col(c)).alias(c) for c in ("filename", "status", "verdict", "detail")],
        *[safe(F.try_element_at("rule_verdicts", F.lit(r.id))).alias(r.id) for r in rulebook.rules])


def _against(manifest: DataFrame, reports: DataFrame) -> DataFrame:
    """The manifest's rows with what was reported; reports are never the side of a broadcast, so checks run in all tasks of the join at any size."""
    return manifest.select("label_id", "defect", "expected").join(reports.hint("merge"), "label_id", "left")


def evaluate(reports: DataFrame, manifest: DataFrame) -> DataFrame:
    """(defect, expected, labels, agreeing, false_pass, false_fail, missing) of reports against a manifest of (label_id, defect, expected)."""
    got = _against(manifest, reports.select("label_id", "verdict"))
    wrong = F.col("verdict") != F.col("expected")
    return got.groupBy("defect", "expected").agg(
        F.count("*").alias("labels"), F.count_if(F.col("verdict") == F.col("expected")).alias("agreeing"), F.count_if(wrong & (F.col("verdict") == "pass")).alias("false_pass"),
        F.count_if(wrong & (F.col("verdict") == "fail")).alias("false_fail"), F.count_if(F.col("verdict").isNull()).alias("missing"))


def disagreements(reports: DataFrame, manifest: DataFrame) -> DataFrame:
    """(label_id, filename, defect, expected, verdict, detail) of the labels whose verdict is not the expected one, or missing."""
    got = _against(manifest, reports.select("label_id", "filename", "verdict", headline(F.col("findings"), F.col("verdict")).alias("detail")))
    return got.where(~F.col("verdict").eqNullSafe(F.col("expected"))).select("label_id", "filename", "defect", "expected", "verdict", "detail")


def job_id() -> Column:
    """A random name of 32 hexadecimal digits."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def display_status(status: Column, verdict: Column) -> Column:
    """What a list shows: error, else the verdict, else pending."""
    return F.when(status == "error", "error").otherwise(F.coalesce(verdict, F.lit("pending")))


# Wording of verdicts in lists.
VERDICT_LABELS = {"pass": "Pass", "needs_review": "Needs review", "fail": "Fail", "not_evaluable": "Not evaluable", "error": "Error", "pending": "Pending"}


def display_text(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in VERDICT_LABELS.items() for x in kv]), status)


def retain(jobs: DataFrame, keep: int = FINISHED_JOBS, key: str = "created_seq") -> DataFrame:
    """Jobs (created_seq, finished) that stay: all that run, and the newest ``keep`` finished ones; ``key`` decides ties.

    The cut is a top-k over the finished jobs, so no task gets them all.
    """
    order = F.struct("created_seq", key)
    newest = jobs.where("finished").select(order.alias("__at")).orderBy(F.desc("__at")).limit(keep)
    oldest = newest.agg(F.min("__at").alias("__cut"))
    return jobs.join(F.broadcast(oldest)).where(~F.col("finished") | (order >= F.col("__cut"))).drop("__cut")  # one row


def upload_gate(size: Column, head: Column) -> Column:
    """Why a file is turned down (size in bytes, first bytes), or null."""
    from ..sources.images import is_image

    return (F.when(size == 0, "The file is empty.").when(size > FILE_BYTES, "The file is larger than 5 MB.")
            .when(~is_image(head), "The file is not a PNG or JPEG image."))


def batch_gate(files: DataFrame, *by: str) -> DataFrame:
    """(*by, files, bytes, accepted, problem) of batches of (length, head)."""
    ok = upload_gate(F.col("length"), F.col("head")).isNull()
    out = files.groupBy(*by).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count_if(ok).alias("accepted"))
    return out.withColumn("problem", F.when(F.col("files") > BATCH_FILES, "too many files").when(F.col("bytes") > BATCH_BYTES, "too large").when(F.col("accepted") == 0, "no image"))
