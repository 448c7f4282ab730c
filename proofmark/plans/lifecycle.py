"""Registered queries over what lives longer than one plan: jobs, their retention as a stream, and recorded reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jobs import CANCELLED, JobStore
from ..operators.batch import disagreements
from ..operators.budget import Ledger
from ..operators.verify import verify
from ..rulebook import load
from ..service import Metrics, check_batch, write_batch
from ..settings import Settings
from ..sources import reader
from ..sources.applications import last_wins
from ..storage import shared_dir
from ..streaming import retention
from . import surface
from .queries import ORACLES as CORE
from .queries import table


def retention_stream(spark, sf_dir):
    """The jobs that stay, from a stream in which every job is created and most finish later; it starts again in between."""
    jobs, folder = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("created_seq"), (F.col("o_orderstatus") != "P").alias("finished")), shared_dir(spark)
    for delivery in (jobs.withColumn("finished", F.lit(False)), jobs.where("finished")):
        delivery.repartition(4).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(jobs.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        retention.run_once(stream, folder)
    return retention.store(spark, folder)


def _results(events: DataFrame) -> DataFrame:
    """What a check of an event would give: events of errors fail, the others get a verdict by their value."""
    failed = F.col("event_type") == "error"
    verdict = F.when(~failed, F.when(F.col("value") < 10, "fail").when(F.col("value") < 20, "needs_review").otherwise("pass"))
    return events.select(
        F.col("event_id").alias("pos"), F.when(failed, "error").otherwise("done").alias("status"), verdict.alias("verdict"),
        F.when(failed, "The reader gave no answer in time.").otherwise(F.concat(F.lit("value "), F.col("event_id").cast("string"))).alias("detail"),
        F.when(~failed, F.create_map(F.lit("rule"), verdict)).otherwise(F.create_map().cast("map<string,string>")).alias("rule_verdicts"))


def _upload(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("pos"), F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".png")).alias("filename"))


def job_items(spark, sf_dir):
    """The items of a job that has landed in three parts, one of them twice, and still waits for others."""
    events, store = table(spark, sf_dir, "events"), JobStore(spark, shared_dir(spark))
    job = store.create(_upload(events))
    for part in (0, 1, 0, 2):
        again = part == 0 and store.version(job).done > 0
        rows = _results(events.where(F.col("event_id") % 4 == part))
        store.land(job, rows.withColumn("detail", F.lit("again")) if again else rows)
    return store.read(job).select("pos", "filename", "status", "verdict", "detail", F.try_element_at("rule_verdicts", F.lit("rule")).alias("rule"))


def job_cancelled(spark, sf_dir):
    """The items of a job that was cancelled after its first part."""
    events, store = table(spark, sf_dir, "events"), JobStore(spark, shared_dir(spark))
    job = store.create(_upload(events))
    store.land(job, _results(events.where(F.col("event_id") % 4 == 0)))
    store.cancel(job)
    return store.read(job).select("pos", "status", "verdict", "detail")


def job_progress(spark, sf_dir):
    """Counts of a job for each priority of orders, filled so far by the orders that are not open."""
    orders, store = table(spark, sf_dir, "orders"), JobStore(spark, shared_dir(spark))
    out = None
    for priority in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        own = orders.where(F.col("o_orderpriority") == priority).select(F.col("o_orderkey").alias("pos"), "o_orderstatus")
        job = store.create(own.select("pos", F.concat(F.lit("o"), F.col("pos").cast("string")).alias("filename")))
        verdict = F.when(F.col("o_orderstatus") == "F", "pass").otherwise("needs_review")
        store.land(job, own.where("o_orderstatus <> 'O'").select("pos", F.lit("done").alias("status"), verdict.alias("verdict"), F.lit("").alias("detail"), F.create_map().cast("map<string,string>").alias("rule_verdicts")))
        counts = store.progress(job).select(F.lit(priority).alias("priority"), "pass", "needs_review", "total", "done", "finished", "state")
        out = counts if out is None else out.unionByName(counts)
    return out


def recorded_reads(spark, sf_dir):
    """What the reader says of each distinct page, by its content: recorded for most, missing for the others."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("key"), F.concat(F.lit("Brand "), F.length("html").cast("string")).alias("brand"))
    told = F.to_json(F.struct(F.struct(F.col("brand").alias("verbatim"), F.lit(True).alias("found"), F.col("brand").alias("value")).alias("brand_name")))
    recorded = pages.where(~F.startswith("key", F.lit("a"))).select("key", told.alias("payload"))
    got = reader.ask(pages, recorded)
    return got.select("key", "status", "attempts", F.from_json("payload", "brand_name struct<verbatim: string, found: boolean, value: string>")["brand_name"]["verbatim"].alias("brand"))


def run_metrics(spark, sf_dir):
    """Rows of each phase of a batch, as counted while it was written."""
    rows = surface.flat(spark, sf_dir)
    failures = [F.when(F.col("failure") == "reader", "The reader gave no answer in time.").alias("reader_error"), (F.col("failure") == "other").alias("failed")]
    labels = surface.labels(rows.select(*rows.columns, *failures), "reader_error", "failed")
    metrics = Metrics()
    items = check_batch(labels, last_wins(surface.applications(rows)), load(), Settings(), metrics=metrics)
    write_batch(items, f"{shared_dir(spark)}/items", Settings(), table(spark, sf_dir, "part").count())
    return spark.createDataFrame(sorted(metrics.rows().items()), "phase string, rows long")


def budget_ledger(spark, sf_dir):
    """What each day grants to three batches of its events, one after the other."""
    asked = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day"), (F.col("event_id") % 3).alias("wave")).agg(F.count("*").alias("asked"))
    ledger = Ledger(spark, shared_dir(spark), "0.5")
    rows = [(r["day"], r["wave"], r["asked"], ledger.reserve(r["asked"], r["day"])) for r in asked.orderBy("day", "wave").collect()]  # three rows a day
    return spark.createDataFrame(rows, "day string, wave long, asked long, granted long")


def evaluation_list(spark, sf_dir):
    """The labels on which verdicts and an opposite manifest disagree, with what the report says."""
    rows = surface.corpus(spark, sf_dir)
    opposite = F.when(F.col("label_id") % 10 == 0, F.when(F.col("expected") == "pass", "fail").otherwise("pass")).otherwise(F.col("expected"))
    return disagreements(verify(surface.labels(rows), load()), rows.withColumn("expected", opposite)).select("label_id", "filename", "defect", "expected", "verdict")


QUERIES = {f.__name__: f for f in (retention_stream, job_items, job_cancelled, job_progress, recorded_reads, run_metrics, budget_ledger, evaluation_list)}

_JOB = """WITH e AS (SELECT event_id AS pos, event_id % 4 AS part, event_type = 'error' AS failed, CASE WHEN value < 10 THEN 'fail' WHEN value < 20 THEN 'needs_review' ELSE 'pass' END AS verdict FROM events)"""

ORACLES = {
    "retention_stream": CORE["retention_top50"],
    "job_items": f"""{_JOB} SELECT pos, 'e' || pos || '.png' AS filename, CASE WHEN part = 3 THEN 'pending' WHEN failed THEN 'error' ELSE 'done' END AS status,
      CASE WHEN part < 3 AND NOT failed THEN verdict END AS verdict, CASE WHEN part < 3 THEN CASE WHEN failed THEN 'The reader gave no answer in time.' ELSE 'value ' || pos END END AS detail,
      CASE WHEN part < 3 AND NOT failed THEN verdict END AS rule FROM e""",
    "job_cancelled": f"""{_JOB} SELECT pos, CASE WHEN part > 0 OR failed THEN 'error' ELSE 'done' END AS status, CASE WHEN part = 0 AND NOT failed THEN verdict END AS verdict,
      CASE WHEN part > 0 THEN '{CANCELLED}' WHEN failed THEN 'The reader gave no answer in time.' ELSE 'value ' || pos END AS detail FROM e""",
    "job_progress": """SELECT o_orderpriority AS priority, count_if(o_orderstatus = 'F') AS pass, count_if(o_orderstatus NOT IN ('F', 'O')) AS needs_review, count(*) AS total, count_if(o_orderstatus <> 'O') AS done,
      count_if(o_orderstatus = 'O') = 0 AS finished, CASE WHEN count_if(o_orderstatus = 'O') = 0 THEN 'finished' ELSE 'running' END AS state FROM orders GROUP BY 1""",
    "budget_ledger": """WITH a AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id % 3 AS wave, count(*) AS asked FROM events GROUP BY ALL),
      b AS (SELECT *, coalesce(sum(asked) OVER (PARTITION BY day ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
      SELECT day, wave, asked, greatest(0, least(asked, 100 - before))::BIGINT AS granted FROM b""",
    "evaluation_list": f"""WITH s AS ({surface.corpus_sql('part')}) SELECT label_id, filename, defect, CASE expected WHEN 'pass' THEN 'fail' ELSE 'pass' END AS expected, expected AS verdict FROM s WHERE label_id % 10 = 0""",
    "run_metrics": f"""WITH s AS ({surface.surface_sql('part')}), c AS (SELECT count(*) AS n, count_if(coalesce(failure, '') IN ('reader', 'other')) AS bad FROM s)
      SELECT phase, rows FROM (SELECT unnest(['checked', 'failed', 'items', 'read']) AS phase, unnest([n - bad, bad, n, n - bad])::BIGINT AS rows FROM c)""",
    "recorded_reads": """SELECT key, CASE WHEN key LIKE 'a%' THEN 'missing' ELSE 'read' END AS status, 1 AS attempts, CASE WHEN key NOT LIKE 'a%' THEN 'Brand ' || n END AS brand
      FROM (SELECT DISTINCT sha256(html) AS key, length(html) AS n FROM pages WHERE html IS NOT NULL)""",
}
