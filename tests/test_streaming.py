"""The streams give what the batch operators give."""

from decimal import Decimal

from pyspark.sql import functions as F

from proofmark.operators.budget import admit
from proofmark.rulebook import load
from proofmark.streaming.budget import run_once
from proofmark.streaming.progress import progress, run_batch

from .conftest import SF


def test_budget_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = run_once(stream, Decimal("0.10"), f"file://{tmp_path}/out")
    expected = admit(events, Decimal("0.10"))
    assert got.count() == events.count()
    assert got.where("admitted").groupBy("day").count().orderBy("day").collect() == expected.where("admitted").groupBy(F.col("day").cast("string").alias("day")).count().orderBy("day").collect()


def test_batch_stream_lands_items_and_errors(spark, tmp_path):
    from .test_engine import LABEL, REF, png, np

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(np.zeros((20, 30), np.uint8)))
    (tmp_path / "in" / "b.txt").write_bytes(b"no image")

    def extract(files):
        field = lambda x: F.struct(F.lit(x).alias("verbatim"), F.lit(True).alias("found"), F.lit(x).alias("value"))
        fields = F.struct(field("Old Tom").alias("brand_name"), field(None).alias("class_type"), field("40% alc").alias("alcohol_content"), field(None).alias("net_contents"), field(REF).alias("government_warning"))
        return files.select("label_id", "filename", fields.cast(LABEL["fields"].dataType).alias("fields"), F.struct(F.lit("Old Tom").alias("brand_name"), F.lit("").alias("class_type"), F.lit("").alias("fanciful_name")).alias("application"),
                            F.lit(None).cast(LABEL["ocr_lines"].dataType).alias("ocr_lines"), F.lit(None).cast("string").alias("bold"))

    run_batch(spark, str(tmp_path / "in"), extract, load(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = progress(spark, str(tmp_path / "out")).first()
    assert (got["pass"], got["error"], got["total"]) == (1, 1, 2)


def test_micro_batches_are_dealt_out_and_exports_compute_rows_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from proofmark.plans import surface
    from proofmark.sources import export
    from proofmark.storage import shared_dir

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").coalesce(1)
    assert surface.over(part).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(i):
        made.add(1)
        return f"row {i}"

    monkeypatch.setattr(export, "PART_ROWS", 10)  # several ranges
    folder = f"{shared_dir(spark)}/x"
    export.write_rows(spark.range(50).select(F.lit(0).alias("grp"), F.col("id").alias("pos"), told("id").alias("told")), "grp", "pos", folder)
    assert export.manifest(folder)["rows"] == 50 and made.value == 50
