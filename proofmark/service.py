"""Checks as a caller asks for them: one label at once, or a batch that runs behind it.

Both run in a pool of Spark's fair scheduler (``spark.scheduler.mode=FAIR`` with ``pools.xml``), in which an interactive
check gets free cores before a batch does.  Running tasks are not interrupted.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .jobs import JobStore, Version
from .operators import batch, rotation
from .operators.budget import Ledger
from .operators.verify import verify
from .rulebook import Rulebook
from .settings import Settings

#: What a session is made with so that interactive checks go first.
FAIR = {"spark.scheduler.mode": "FAIR", "spark.scheduler.allocation.file": f"file://{Path(__file__).parent / 'pools.xml'}"}
INTERACTIVE, BATCH = "interactive", "batch"
POOL = "spark.scheduler.pool"

Read = Callable[[DataFrame], DataFrame]


@contextmanager
def pool(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs that this thread starts inside run in the pool."""
    before = spark.sparkContext.getLocalProperty(POOL)
    spark.sparkContext.setLocalProperty(POOL, name)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty(POOL, before)


class Phases:
    """Seconds of the named phases of a check, and one line of them for a log; nothing of the label is in it."""

    def __init__(self) -> None:
        self.began = time.perf_counter()
        self.seconds: dict[str, float] = {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def line(self) -> str:
        parts = "".join(f" {k}={v:.3f}s" for k, v in self.seconds.items())
        return f"check total={time.perf_counter() - self.began:.3f}s{parts}"


class Metrics:
    """Rows of the phases of a run, counted by the run itself: work that is put off is counted when and where it is done."""

    def __init__(self) -> None:
        self.watched: dict[str, Observation] = {}
        self.began = time.perf_counter()

    def watch(self, rows: DataFrame, phase: str) -> DataFrame:
        self.watched[phase] = Observation(f"{phase}-{uuid.uuid4().hex}")
        return rows.observe(self.watched[phase], F.count(F.lit(1)).alias("rows"))

    def rows(self) -> dict[str, int]:
        """Waits for the run's action to end."""
        return {phase: o.get["rows"] for phase, o in self.watched.items()}

    def line(self) -> str:
        return f"batch total={time.perf_counter() - self.began:.3f}s" + "".join(f" {k}={v}" for k, v in self.rows().items())


def check_label(label: DataFrame, rulebook: Rulebook) -> DataFrame:
    """The report of one label, collected: one ``model.LABEL`` row in, a local table of its report out.

    More rows than a batch may hold are an error; they are for ``check_batch``.
    """
    spark = label.sparkSession
    with pool(spark, INTERACTIVE):
        reports = verify(label, rulebook)
        rows = reports.limit(batch.BATCH_FILES + 1).collect()
        if len(rows) > batch.BATCH_FILES:
            raise ValueError(f"an interactive check takes at most {batch.BATCH_FILES} labels")
        return spark.createDataFrame(rows, reports.schema)


def check_batch(labels: DataFrame, applications: DataFrame, rulebook: Rulebook, settings: Settings | None = None, read: Read | None = None,
                metrics: Metrics | None = None) -> DataFrame:
    """Batch items of labels (with ``reader_error`` and ``failed``) against filings, one row a key.

    ``read`` reads labels again at a rotation, for those whose upright read lacks the statement, if the settings say so.
    ``metrics`` counts what was read, failed, was checked and became an item, while the result is written.
    """
    watch = metrics.watch if metrics else lambda rows, phase: rows
    settings = settings or Settings.of(labels.sparkSession)
    good, errors = batch.isolate(labels)
    good, errors = watch(good, "read"), watch(errors, "failed")
    good = batch.pair(good, applications).drop("matched")
    if read is not None and settings.rotations and rulebook.warning is not None:
        good = rotation.retry(good, read, rulebook.warning.match.reference or "")
    items = batch.to_items(watch(verify(good, rulebook), "checked"), errors.select(F.col("label_id").alias("pos"), "filename", "detail"))
    return watch(items, "items")


def write_batch(items: DataFrame, path: str, settings: Settings | None = None, labels: int = batch.BATCH_FILES) -> None:
    """Write a batch's items from at most ``workers`` tasks, behind interactive checks; more ``labels`` than an upload may have are as many batches."""
    spark = items.sparkSession
    batches = max(1, -(-labels // batch.BATCH_FILES))
    with pool(spark, BATCH):
        items.coalesce(batches * (settings or Settings.of(spark)).workers).write.mode("overwrite").parquet(path)


class UploadError(ValueError):
    """The upload is turned down as a whole; the message may be shown."""


#: Why an upload is turned down, by ``operators.batch.batch_gate``.
REFUSED = {"too many files": f"A batch takes at most {batch.BATCH_FILES} labels.", "too large": "The batch is too large to run in one go.", "no image": "There is no PNG or JPEG image among the files."}
OVER_BUDGET = "The daily limit for reading labels is reached."


def submit(store: JobStore, files: DataFrame, applications: DataFrame | None = None) -> str:
    """A job over uploaded (pos, filename, length, head), whose unusable files are error rows at once; its id.

    An upload of too many files or bytes, without an image, or with applications of which none fits, is turned down as a whole.
    """
    problem = batch.batch_gate(files).first()["problem"]
    if problem:
        raise UploadError(REFUSED[problem])
    refused = files.withColumn("detail", batch.upload_gate(F.col("length"), F.col("head")))
    if applications is not None:
        if problem := batch.pairing_gate(refused.where("detail IS NULL"), applications).first()["problem"]:
            raise UploadError(problem)
    job = store.create(files.select("pos", "filename"))
    store.land(job, _errors(refused.where("detail IS NOT NULL"), F.col("detail")))
    return job


def _errors(rows: DataFrame, detail: Column) -> DataFrame:
    return rows.select("pos", F.lit("error").alias("status"), F.lit(None).cast("string").alias("verdict"), detail.alias("detail"), F.create_map().cast("map<string,string>").alias("rule_verdicts"))


def run_job(store: JobStore, job: str, labels: DataFrame, applications: DataFrame, rulebook: Rulebook, ledger: Ledger | None = None, settings: Settings | None = None, read: Read | None = None) -> Version:
    """Check a job's labels and land them, as far as the day's budget goes; the first ones in the order of upload are checked.

    The budget is reserved before anything is read, so ``labels`` has to be lazy where reading costs.
    """
    spark = store.spark
    if ledger is not None:
        order = labels.select("label_id").orderBy("label_id")
        wanted = order.count()
        granted = ledger.reserve(wanted, str(spark.sql("SELECT current_date()").first()[0]))
        if granted < wanted:
            cut = order.limit(granted).agg(F.max("label_id")).first()[0] if granted else None
            late = F.col("label_id") > cut if granted else F.lit(True)
            store.land(job, _errors(labels.where(late).select(F.col("label_id").alias("pos")), F.lit(OVER_BUDGET)))
            if not granted:
                return store.version(job)
            labels = labels.where(~late)
    with pool(spark, BATCH):
        return store.land(job, check_batch(labels, applications, rulebook, settings, read))
