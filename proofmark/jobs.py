"""Batch jobs that are created, filled, read, exported, cancelled and forgotten by id.

A job is a folder of the store: what was uploaded (``items``), parts of results, and versions.  A version is a small record
that names the parts and the state; it is written beside and renamed to its number, and a rename never replaces a file, so of two
writers that would make the same version one has to try again.  Readers see the parts of one version and nothing
of a part that is still being written or was given up.

The work of a job runs under a tag of its id, so ``cancel`` interrupts whatever Spark jobs it has, in any thread.  A cancelled job keeps
its list of items, each of which is an error if it had no result yet, and its other files are swept.
Only names and counts pass through the driver; items and results are tables.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.batch import FINISHED_JOBS, summary
from .rulebook import Rulebook
from .storage import commit_new, names, read_file, remove

ITEMS = "pos long, filename string"
RESULTS = "pos long, status string, verdict string, detail string, rule_verdicts map<string,string>"
#: What an item of a cancelled job says if it had no result.
CANCELLED = "The batch was cancelled."
RUNNING, FINISHED, STOPPED = "running", "finished", "cancelled"
_TRIES = 20


class JobError(ValueError):
    """A job that is not there, or not in a state for what is asked; the message may be shown."""


@dataclass(frozen=True)
class Version:
    number: int
    state: str
    total: int
    done: int
    created: int
    parts: tuple[str, ...] = field(default=())


class JobStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # ------------------------------------------------------------ versions

    def _names(self, folder: str) -> list[str]:
        return names(self.spark, folder)

    def _commit(self, job: str, version: Version) -> bool:
        """Write a version; false if another writer was first."""
        return commit_new(self.spark, f"{self.folder}/{job}/versions/{version.number:08d}", json.dumps(asdict(version)).encode())

    def version(self, job: str) -> Version:
        known = [x for x in self._names(f"{self.folder}/{job}/versions") if x.isdigit()] if job.isalnum() else []
        if not known:
            raise JobError("That batch was not found; only the newest ones are kept.")
        got = json.loads(read_file(self.spark, f"{self.folder}/{job}/versions/{known[-1]}"))
        return Version(**got | {"parts": tuple(got["parts"])})

    def _advance(self, job: str, change: Callable[[Version], Version]) -> Version:
        for _ in range(_TRIES):
            new = change(self.version(job))
            if self._commit(job, new):
                return new
        raise JobError("The batch is being changed by too many at once.")

    # ------------------------------------------------------------ a job's life

    def create(self, items: DataFrame) -> str:
        """A new job over (pos, filename); its id.  Finished jobs beyond the newest ones go."""
        job = uuid.uuid4().hex
        items.select("pos", "filename").write.parquet(f"{self.folder}/{job}/items")
        total = self.spark.read.schema(ITEMS).parquet(f"{self.folder}/{job}/items").count()
        self._commit(job, Version(1, FINISHED if not total else RUNNING, total, 0, time.time_ns()))
        self.evict()
        return job

    def land(self, job: str, results: DataFrame) -> Version:
        """Add the results of some items; an item's result is the one that landed first.

        If the job is cancelled meanwhile, or the write fails, the part is swept and the job stays as it was.
        """
        if self.version(job).state != RUNNING:
            raise JobError("The batch takes no more results.")
        part = uuid.uuid4().hex
        path = f"{self.folder}/{job}/parts/{part}"
        self.spark.sparkContext.addJobTag(self.tag(job))
        try:
            results.select("pos", "status", "verdict", "detail", "rule_verdicts").write.parquet(path)

            def change(v: Version) -> Version:
                if v.state != RUNNING:
                    raise JobError(CANCELLED)
                parts = (*v.parts, part)
                done = self._results(job, parts).select("pos").join(self._items(job).select("pos"), "pos", "left_semi").distinct().count()
                return Version(v.number + 1, FINISHED if done == v.total else RUNNING, v.total, done, v.created, parts)

            return self._advance(job, change)
        except BaseException:
            remove(self.spark, path)
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag(job))

    def cancel(self, job: str) -> Version:
        """Stop a running job: its Spark jobs end, its parts are swept once its version says so; a finished job stays."""
        def change(v: Version) -> Version:
            return Version(v.number + 1, STOPPED, v.total, v.total, v.created, v.parts) if v.state == RUNNING else v

        for _ in range(_TRIES):
            before = self.version(job)
            after = change(before)
            if after is before:
                return before
            if self._commit(job, after):
                self.spark.sparkContext.cancelJobsWithTag(self.tag(job))
                self.sweep(job)
                return after
        raise JobError("The batch is being changed by too many at once.")

    def sweep(self, job: str) -> None:
        """Delete the parts that the newest version does not name: of writes that failed, were cancelled or lost their driver."""
        known = set(self.version(job).parts)
        lost = [x for x in self._names(f"{self.folder}/{job}/parts") if x not in known]
        if lost:
            remove(self.spark, *[f"{self.folder}/{job}/parts/{x}" for x in lost])

    @staticmethod
    def tag(job: str) -> str:
        return f"proofmark-job-{job}"

    # ------------------------------------------------------------ reading

    def _items(self, job: str) -> DataFrame:
        return self.spark.read.schema(ITEMS).parquet(f"{self.folder}/{job}/items")

    def _results(self, job: str, parts: tuple[str, ...]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], f"{RESULTS}, part int")
        paths = [f"{self.folder}/{job}/parts/{x}" for x in parts]
        numbers = F.create_map(*[F.lit(y) for i, x in enumerate(parts) for y in (x, i)])
        rows = self.spark.read.schema(RESULTS).option("basePath", f"{self.folder}/{job}/parts").parquet(*paths)
        return rows.withColumn("part", F.element_at(numbers, F.regexp_extract(F.col("_metadata.file_path"), r"/parts/([0-9a-f]+)/[^/]*$", 1)))

    def read(self, job: str) -> DataFrame:
        """The items of a job as they are now: (grp, pos, filename, status, verdict, detail, rule_verdicts)."""
        v = self.version(job)
        first = self._results(job, v.parts).groupBy("pos").agg(F.min_by(F.struct("status", "verdict", "detail", "rule_verdicts"), "part").alias("r"))
        waiting = F.lit("error" if v.state == STOPPED else "pending")
        told = F.lit(CANCELLED if v.state == STOPPED else None).cast("string")
        return self._items(job).join(first, "pos", "left").select(
            F.lit(0).alias("grp"), "pos", "filename", F.coalesce("r.status", waiting).alias("status"), F.col("r.verdict").alias("verdict"),
            F.when(F.col("r").isNull(), told).otherwise(F.col("r.detail")).alias("detail"), F.coalesce("r.rule_verdicts", F.create_map().cast("map<string,string>")).alias("rule_verdicts"))

    def progress(self, job: str) -> DataFrame:
        """Counts of a job: ``operators.batch.summary`` and its state."""
        return summary(self.read(job)).withColumn("state", F.lit(self.version(job).state))

    def export(self, job: str, rulebook: Rulebook, path: str) -> None:
        """The job's grid in the order of upload (``sources.export``)."""
        from .sources.export import write_grid

        write_grid(self.read(job), rulebook, path)

    def jobs(self) -> DataFrame:
        """(job, state, total, done, created) of every job, newest first; a row a job, of which a bounded number is finished."""
        rows = [(j, v.state, v.total, v.done, v.created) for j in self._names(self.folder) if (v := self._known(j))]
        return self.spark.createDataFrame(sorted(rows, key=lambda r: -r[4]), "job string, state string, total long, done long, created long")

    def _known(self, job: str) -> Version | None:
        try:
            return self.version(job)
        except JobError:
            return None

    def evict(self, keep: int = FINISHED_JOBS) -> None:
        """Forget finished and cancelled jobs beyond the newest; running ones stay."""
        ended = sorted(((v.created, j) for j in self._names(self.folder) if (v := self._known(j)) and v.state != RUNNING), reverse=True)
        if gone := ended[keep:]:
            remove(self.spark, *[f"{self.folder}/{j}" for _, j in gone])

    # ------------------------------------------------------------ running

    def run(self, job: str, check: Callable[[DataFrame], DataFrame], pieces: int = 1) -> Version:
        """Check the items that have no result yet and land them in so many pieces; ``check`` turns (pos, filename) into results."""
        done = self._results(job, self.version(job).parts).select("pos").distinct()
        open_ = self._items(job).join(done, "pos", "left_anti")
        for i in range(pieces):
            self.land(job, check(open_.where(F.pmod(F.xxhash64("pos"), F.lit(pieces)) == i)))
        return self.version(job)
