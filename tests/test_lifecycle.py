"""Jobs by id, their cancellation and retention, ordered exports and the reader behind its port."""

import csv
import io
import json
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from proofmark import service
from proofmark.jobs import CANCELLED, JobError, JobStore
from proofmark.operators import batch
from proofmark.operators.batch import BATCH_FILES, retain
from proofmark.model import LABEL
from proofmark.operators.budget import Ledger
from proofmark.rulebook import load
from proofmark.sources import applications, export, reader
from proofmark.storage import shared_dir
from proofmark.streaming import retention

from .test_engine import label

RESULT = "pos long, status string, verdict string, detail string, rule_verdicts map<string,string>"


def items(spark, n):
    return spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("l"), "id").alias("filename"))


def results(rows, verdict="pass"):
    return rows.select("pos", F.lit("done").alias("status"), F.lit(verdict).alias("verdict"), F.lit("=1+1, \"q\"\nnext").alias("detail"), F.create_map(F.lit("health_warning_bold"), F.lit(verdict)).alias("rule_verdicts"))


def files(store, job):
    root = Path(store.folder.removeprefix("file://")) / job
    return {p.relative_to(root).parts[0] for p in root.rglob("*.parquet")}


@pytest.fixture
def store(spark):
    return JobStore(spark, shared_dir(spark))


def test_a_job_is_created_filled_read_and_exported(spark, store):
    job = store.create(items(spark, 100))
    assert store.progress(job).first().asDict() == {"pass": 0, "needs_review": 0, "fail": 0, "not_evaluable": 0, "error": 0, "total": 100, "done": 0, "finished": False, "state": "running"}
    store.land(job, results(items(spark, 40)))
    before = store.read(job)
    v = store.land(job, results(items(spark, 100).where("pos >= 30"), "fail"))  # ten of them have a result already
    assert (v.state, v.done, v.number) == ("finished", 100, 3)
    assert before.where("status = 'done'").count() == 40  # a reader keeps the version it has
    got = {r["pos"]: r["verdict"] for r in store.read(job).collect()}
    assert got == {i: "pass" if i < 40 else "fail" for i in range(100)}
    with pytest.raises(JobError, match="no more"):
        store.land(job, results(items(spark, 1)))
    path = f"{shared_dir(spark)}/export"
    store.export(job, load(), path)
    table = list(csv.reader(io.StringIO(b"".join(export.pieces(path)).decode())))
    assert table[0] == ["filename", "status", "verdict", "detail", *[r.id for r in load().rules]]
    assert [r[0] for r in table[1:]] == [f"l{i}" for i in range(100)] and {r[3] for r in table[1:]} == {"'=1+1, \"q\"\nnext"}
    assert [r["job"] for r in store.jobs().collect()] == [job]


def test_items_that_fail_or_repeat_and_jobs_without_items(spark, store):
    assert store.version(store.create(items(spark, 0))).state == "finished"
    job = store.create(items(spark, 2))
    foreign = spark.createDataFrame([(7, "done", "pass", "", {})], RESULT)
    assert store.land(job, foreign).done == 0  # results of no item are no progress
    assert store.land(job, results(items(spark, 1))).done == 1
    for name in ("nothing", "../x", ""):
        with pytest.raises(JobError, match="not found"):
            store.read(name)


def test_of_two_writers_of_a_version_one_has_to_try_again(spark, store):
    job = store.create(items(spark, 3))
    v = store.version(job)
    assert not store._commit(job, v) and store.version(job) == v
    landed = []
    threads = [threading.Thread(target=lambda i=i: landed.append(store.land(job, results(items(spark, 3).where(F.col("pos") == i))))) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(landed) == 3 and sorted(v.number for v in landed) == [2, 3, 4] and store.version(job).state == "finished"


def test_a_cancelled_job_ends_its_work_and_leaves_no_file(spark, store):
    job, other = store.create(items(spark, 10)), store.create(items(spark, 1))
    store.land(job, results(items(spark, 4)))

    def slow(rows):
        def run(batches):
            for b in batches:
                time.sleep(600)
                yield b

        return results(rows).mapInArrow(run, RESULT)

    ended = []

    def work():
        try:
            store.run(job, slow)
        except Exception as e:  # Spark's error of a cancelled job
            ended.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    tracker = spark.sparkContext.statusTracker()
    while not any(i.numActiveTasks for s in tracker.getActiveStageIds() if (i := tracker.getStageInfo(s))):
        time.sleep(0.2)
    time.sleep(1)
    began = time.time()
    store.cancel(job)
    thread.join(60)
    assert not thread.is_alive() and time.time() - began < 60 and len(ended) == 1
    v = store.version(job)
    assert v.state == "cancelled" and store._names(f"{store.folder}/{job}/parts") == list(v.parts) and len(v.parts) == 1
    got = {r["pos"]: (r["status"], r["detail"] == CANCELLED) for r in store.read(job).collect()}
    assert got == {i: ("done", False) if i < 4 else ("error", True) for i in range(10)}
    with pytest.raises(JobError, match="no more"):
        store.land(job, results(items(spark, 10)))
    assert store.cancel(job) == v and store.version(other).state == "running"


def test_a_failed_or_late_part_is_swept(spark, store, monkeypatch):
    job = store.create(items(spark, 5))
    with pytest.raises(Exception, match="division|DIVIDE"):
        store.land(job, results(items(spark, 5)).withColumn("pos", F.expr("1 div (pos - pos)")))
    assert store._names(f"{store.folder}/{job}/parts") == [] and store.version(job).number == 1
    results(items(spark, 5)).write.parquet(f"{store.folder}/{job}/parts/{'0' * 32}")  # of a driver that was lost
    assert store.read(job).where("status = 'done'").count() == 0
    store.sweep(job)
    assert store._names(f"{store.folder}/{job}/parts") == []
    advance = store._advance
    monkeypatch.setattr(store, "_advance", lambda j, change: (store.cancel(j), advance(j, change))[1])  # cancelled after its part was written
    with pytest.raises(JobError, match="cancelled"):
        store.land(job, results(items(spark, 5)))
    assert files(store, job) == {"items"} and store.version(job).state == "cancelled"


def test_finished_jobs_beyond_the_newest_go(spark, store):
    running = store.create(items(spark, 1))
    ended = [store.create(items(spark, 0)) for _ in range(6)]
    store.cancel(stopped := store.create(items(spark, 1)))
    store.evict(3)
    assert {r["job"] for r in store.jobs().collect()} == {running, *ended[-2:], stopped}


# ---------------------------------------------------------------- submission and budget

def uploads(spark, rows):
    return spark.createDataFrame([(i, f"l{i}.png", n, head) for i, (n, head) in enumerate(rows)], "pos long, filename string, length long, head binary")


PNG_HEAD = b"\x89PNG\r\n\x1a\n"


def test_an_upload_is_gated_read_within_the_budget_and_landed(spark, store, tmp_path):
    files_ = uploads(spark, [(100, PNG_HEAD), (0, b""), (100, PNG_HEAD), (100, b"text"), (100, PNG_HEAD), (100, PNG_HEAD)])
    filed = spark.createDataFrame([("l0.png", "l0.png", "Old Tom", "", "")], "key string, filename string, brand_name string, class_type string, fanciful_name string")
    job = service.submit(store, files_, filed)
    assert {r["pos"]: (r["status"], r["detail"]) for r in store.read(job).collect() if r["status"] != "pending"} == {1: ("error", "The file is empty."), 3: ("error", "The file is not a PNG or JPEG image.")}
    asked = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            asked.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(*label(i)[:6], None, False) for i in (0, 2, 4, 5)], LABEL.add("reader_error", "string").add("failed", "boolean"))
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", "0.015")
    v = service.run_job(store, job, rows, filed, load(), ledger)
    got = {r["pos"]: (r["status"], r["verdict"], r["detail"]) for r in store.read(job).collect()}
    assert v.state == "finished" and got[5] == ("error", None, service.OVER_BUDGET) and {got[i][0] for i in (0, 2, 4)} == {"done"} and got[0][1] == "pass"
    again = service.submit(store, uploads(spark, [(100, PNG_HEAD)]))  # nothing is left: nothing is read
    assert service.run_job(store, again, rows.limit(1).mapInArrow(count, rows.schema).withColumn("label_id", F.lit(0).cast("long")), filed, load(), ledger).state == "finished"
    assert store.read(again).first()["detail"] == service.OVER_BUDGET


def test_uploads_are_turned_down_as_a_whole(spark, store):
    filed = spark.createDataFrame([("other.png", "other.png", "", "", "")], "key string, filename string, brand_name string, class_type string, fanciful_name string")
    good = [(100, PNG_HEAD)]
    for rows, applications_, message in (([], None, "no PNG or JPEG"), ([(5, b"text")], None, "no PNG or JPEG"), (good * (BATCH_FILES + 1), None, "at most 1000"), ([(4 << 20, PNG_HEAD)] * 500, None, "too large"), (good, filed, "none of the images")):
        with pytest.raises(service.UploadError, match=message):
            service.submit(store, uploads(spark, rows), applications_)
    assert store.jobs().count() == 0


def test_reservations_at_once_never_pass_the_limit(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", "0.05")
    granted = []
    threads = [threading.Thread(target=lambda n=n: granted.append(ledger.reserve(n, "2024-01-01"))) for n in (1, 2, 3, 4, 5, 6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(granted) == 10 == ledger.reserved("2024-01-01")[1] and ledger.reserve(3, "2024-01-01") == 0 and ledger.reserve(3, "2024-01-02") == 3


# ---------------------------------------------------------------- retention

def test_retention_stream_over_restarts_and_several_shards(spark, tmp_path):
    deliveries = [[(i, False) for i in range(300)], [(i, True) for i in range(0, 300, 2)], [(i, True) for i in (1, 299, 3)], [(i, i % 5 > 0) for i in range(300, 340)] + [(None, True)]]
    for i, rows in enumerate(deliveries):
        spark.createDataFrame(rows, "created_seq long, finished boolean").repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("created_seq long, finished boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        retention.run_once(stream, f"file://{tmp_path}/out", keep=20, shards=3)
        known = {}
        for part in deliveries[: i + 1]:
            known |= {k: known.get(k, False) or f for k, f in part if k is not None}
        expected = retain(spark.createDataFrame(sorted(known.items()), "created_seq long, finished boolean"), 20)
        assert sorted(retention.store(spark, f"file://{tmp_path}/out", 20).collect()) == sorted(expected.collect())


def test_state_is_bounded_by_what_is_kept():
    import pandas as pd

    class State:
        rows = []
        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)

        def put(self, rows):
            State.rows = rows

    p = retention.NewestFinished(5)
    p.newest = State()
    log = [row for start in range(0, 1000, 100) for out in p.handleInputRows((0,), iter([pd.DataFrame({"created_seq": range(start, start + 100), "finished": True})]), None) for row in out.itertuples(index=False)]
    assert State.rows == [(i,) for i in range(995, 1000)]
    gone = {r.created_seq for r in log if not r.kept}
    assert gone == set(range(995)) and all(r.finished for r in log)


# ---------------------------------------------------------------- exports

def exported(spark, n, path, kind="csv", parts=7):
    rows = spark.range(n).repartition(5).select((F.col("id") % 2).alias("grp"), F.col("id").alias("pos"), F.concat(F.lit("é,\n"), "id").alias("a"), F.when(F.col("id") % 3 > 0, F.lit('x"')).alias("b"))
    before, export.PART_ROWS = export.PART_ROWS, max(1, n // parts)
    try:
        export.write_rows(rows, "grp", "pos", path, kind)
    finally:
        export.PART_ROWS = before
    return [[f"é,\n{i}", 'x"' if i % 3 else None] for i in [*range(0, n, 2), *range(1, n, 2)]]


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_parts_of_an_export_are_in_order(spark, kind):
    path = f"{shared_dir(spark)}/e"
    expected = exported(spark, 1000, path, kind)
    known = export.manifest(path)
    assert known["rows"] == 1000 == sum(p["rows"] for p in known["parts"]) and len(known["parts"]) > 3
    whole = b"".join(export.pieces(path)).decode()
    plain = [[r[0], r[1] or None] for r in list(csv.reader(io.StringIO(whole)))[1:]] if kind == "csv" else [[x["a"], x["b"]] for x in map(json.loads, whole.splitlines())]
    assert plain == expected
    back = export.read_back(spark, path).orderBy("place").collect()
    assert [[r["a"], r["b"] or None] for r in back] == expected and [r["place"] for r in back] == list(range(1, 1001))


def test_a_million_items_export_in_order(spark):
    path = f"{shared_dir(spark)}/e"
    rows = spark.range(1_000_000).select(F.lit(0).alias("grp"), F.col("id").alias("pos"), F.concat(F.lit("l"), "id").alias("filename"), F.lit("done").alias("status"), F.lit("pass").alias("verdict"), F.lit("").alias("detail"))
    export.write_progress(rows, path)
    parts = export.manifest(path)["parts"]
    assert len(parts) == 4 and max(p["rows"] for p in parts) < 400_000
    back = export.read_back(spark, path)
    assert back.where(F.col("filename") != F.concat(F.lit("l"), (F.col("place") - 1).cast("string"))).count() == 0 and back.count() == 1_000_000


def test_an_export_that_fails_leaves_no_manifest_and_nothing_is_an_export(spark):
    path = f"{shared_dir(spark)}/e"
    rows = spark.range(100).select(F.lit(0).alias("grp"), F.col("id").alias("pos"), F.expr("assert_true(id < 90) IS NULL").alias("a"))
    with pytest.raises(Exception):
        export.write_rows(rows, "grp", "pos", path)
    assert not (Path(path.removeprefix("file://")) / export.MANIFEST).exists()
    exported(spark, 0, path)
    assert export.read_back(spark, path).count() == 0 and b"".join(export.pieces(path)) == b"a,b\n"


def test_commit_refuses_ranges_that_overlap_and_abort_deletes(spark, tmp_path):
    writer = export.PartWriter({"path": f"file://{tmp_path}/e"}, ["__grp", "__pos", "a"])
    done = [writer.write(iter([(0, i, "x") for i in r])) for r in (range(5, 9), range(0, 5), range(0, 0))]
    with pytest.raises(ValueError, match="out of order"):
        writer.write(iter([(0, 2, "x"), (0, 1, "x")]))
    writer.commit(done)
    assert [p["rows"] for p in export.manifest(f"file://{tmp_path}/e")["parts"]] == [5, 4]
    again = writer.write(iter([(0, 8, "x")]))
    with pytest.raises(ValueError, match="overlap"):
        writer.commit([done[0], again])
    writer.abort([again, None])
    assert len(list((tmp_path / "e").glob("part-*.csv"))) == 3  # one is of the task that broke off, named by no manifest
    with pytest.raises(ValueError, match="no such kind"):
        export.PartWriter({"path": "x", "kind": "xml"}, [])


def test_the_small_grid_says_when_it_is_too_small(spark, tmp_path):
    rows = items(spark, BATCH_FILES + 1).select(F.lit(0).alias("grp"), "pos", "filename", F.lit("done").alias("status"), F.lit("pass").alias("verdict"), F.lit("").alias("detail"), F.create_map().cast("map<string,string>").alias("rule_verdicts"))
    with pytest.raises(applications.ApplicationsError, match="at most 1000"):
        applications.write_grid(rows, load(), str(tmp_path / "g"))


def test_headers_of_files_are_checked_like_those_of_uploads(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"filename,bra\x00nd\na,b\n")
    with pytest.raises(applications.ApplicationsError):
        applications.from_files(spark, str(tmp_path / "x.csv"))


# ---------------------------------------------------------------- the reader

def test_every_answer_of_a_reader_is_a_typed_row(spark):
    kinds = ("fine", "slow", "slowonce", "away", "awayonce", "unknown", "broken")
    keys = spark.createDataFrame([(f"{k}-{i}",) for k in kinds for i in range(2 if "slow" in k else 30)] + [(None,), ("fine-0",)], "key string")
    got = reader.ask(keys, client="tests.clients:Moody", timeout=0.5).collect()
    assert len(got) == len({r["key"] for r in got}) == 5 * 30 + 2 * 2
    told = {k: {(r["status"], r["attempts"], r["detail"], r["payload"] is not None) for r in got if r["key"].split("-")[0] == k} for k in kinds}
    late = "The reader gave no answer in time."
    assert told == {"fine": {("read", 1, None, True)}, "slow": {("timeout", 2, late, False)}, "slowonce": {("read", 2, None, True)}, "away": {("unavailable", 2, "The reader is away.", False)},
                    "awayonce": {("read", 2, None, True)}, "unknown": {("missing", 1, "No extraction is recorded for this label.", False)}, "broken": {("failed", 1, "ValueError", False)}}


def test_recorded_reads_come_from_their_bucket(spark, monkeypatch):
    monkeypatch.setattr(reader, "BUCKET_ROWS", 10)
    keys = spark.range(500).select(F.col("id").cast("string").alias("key"))
    recorded = keys.where("key % 3 = 0").select("key", F.concat(F.lit("p"), "key").alias("payload")).unionByName(spark.createDataFrame([("0", "p"), (None, "x"), ("900", "y")], "key string, payload string"))
    got = {r["key"]: (r["status"], r["payload"]) for r in reader.ask(keys, recorded).collect()}
    assert got == {str(i): ("read", f"p{i}") if i % 3 == 0 else ("missing", None) for i in range(500)}
    assert reader.ask(keys.where("false"), recorded).count() == 0
    assert {r["status"] for r in reader.ask(keys, recorded.where("false")).collect()} == {"missing"}


def merged(rows):
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan and "Broadcast" not in plan


def test_reports_are_no_side_of_a_broadcast(spark):
    reports = spark.range(4).select(F.col("id").alias("label_id"), F.lit("f").alias("filename"), F.lit("pass").alias("verdict"), F.array(F.struct(F.lit("pass").alias("verdict"), F.lit(0).alias("rule_pos"), F.lit("").alias("detail"))).alias("findings"))
    manifest = spark.range(5).select(F.col("id").alias("label_id"), F.lit("d").alias("defect"), F.when(F.col("id") == 1, "fail").otherwise("pass").alias("expected"))
    wrong = batch.disagreements(reports, manifest)
    assert merged(wrong) and merged(batch.evaluate(reports, manifest))
    assert sorted((r["label_id"], r["expected"], r["verdict"]) for r in wrong.collect()) == [(1, "fail", "pass"), (4, "pass", None)]


def test_filings_are_no_side_of_a_broadcast(spark):
    filings = spark.range(3).select(F.concat(F.lit("l"), "id", F.lit(".png")).alias("filename"), F.col("id").alias("pos"), *[F.lit("b").alias(c) for c in ("brand_name", "class_type", "fanciful_name")])
    paired = batch.pair(items(spark, 4).withColumn("filename", F.concat("filename", F.lit(".png"))), applications.last_wins(filings))
    assert merged(paired)
    assert sorted((r["pos"], r["matched"]) for r in paired.collect()) == [(0, True), (1, True), (2, True), (3, False)]


def test_more_labels_than_a_batch_may_have_get_more_tasks(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 9)
    for n, tasks in ((BATCH_FILES, 6), (3 * BATCH_FILES, 9)):
        service.write_batch(rows, str(tmp_path / str(n)), service.Settings(), n)
        assert len(list((tmp_path / str(n)).glob("*.parquet"))) == tasks
