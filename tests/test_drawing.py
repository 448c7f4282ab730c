"""Drawn labels measure as they were drawn."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmark.functions.strokes import measure
from proofmark.sources import drawing, images, jpeg
from proofmark.storage import shared_dir


@pytest.mark.parametrize("text", ["IIIIII", "HELTFI", "EEEE"])
def test_drawn_lines_measure_as_drawn(text):
    for cap in (20, 31):
        widths = [measure(drawing.draw([(text, s, cap)])[:, :, 0]) for s in (2, 3, 4, 6)]
        assert all(m.cap == cap for m in widths)
        assert all(abs(m.stroke - s) <= 1.2 for m, s in zip(widths, (2, 3, 4, 6))) and widths[3].stroke > 1.3 * widths[2].stroke > 1.3 * widths[0].stroke


def test_turns_channels_and_bad_letters():
    lines = [("LT", 3, 20), ("F", 2, 15)]
    flat = drawing.draw(lines)
    for turn in (0, 90, 180, 270):
        turned = drawing.draw(lines, 3, turn)
        assert turned.shape[2] == 3 and np.array_equal(images.rotate(turned[:, :, 0], turn), flat[:, :, 0])
    assert drawing.draw([]).shape == (16, 16, 1) and drawing.draw([("", 2, 10)]).min() == 255
    with pytest.raises(ValueError, match="no glyph"):
        drawing.draw([("x", 2, 10)])


def test_files_decode_to_what_was_drawn(spark):
    folder = shared_dir(spark)
    rows = spark.range(9).select(F.concat(F.lit("l"), "id", F.lit(".png")).alias("name"), F.when(F.col("id") < 8, F.array(F.struct(F.lit("HI").alias("text"), F.lit(3).alias("stroke"), (F.col("id") + 14).cast("int").alias("cap")))).alias("lines"),
                                  (1 + 2 * (F.col("id") % 2)).cast("int").alias("channels"), (F.col("id") % 4 * 90).cast("int").alias("turn"))
    assert drawing.write_images(rows, f"{folder}/i").count() == 9
    problems = {r["filename"]: r["problem"] for r in images.read_files(spark, f"{folder}/i").collect()}
    assert problems["l8.png"] == "The file is not a PNG or JPEG image." and sum(p is None for p in problems.values()) == 8
    for r in images.read_rasters(spark, f"{folder}/i").collect():
        i, image = int(r["key"][1:-4]), r["image"]
        expected = drawing.draw([("HI", 3, i + 14)], 1 + 2 * (i % 2), i % 4 * 90)
        assert np.array_equal(np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"]), expected)


# ---------------------------------------------------------------- previews

def rasters():
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:61, 0:83]
    slope = ((x * 2 + y) % 256).astype(np.uint8)
    return {"white": np.full((17, 9, 1), 255, np.uint8), "dot": np.zeros((1, 1, 3), np.uint8), "slope": slope[:, :, None], "colours": np.dstack([slope, slope[::-1], slope[:, ::-1]]), "label": drawing.draw([("HELTFI", 3, 24), ("III", 2, 15)], 3, 90),
            "noise": rng.integers(0, 256, (40, 56, 1), dtype=np.uint8), "checks": np.indices((33, 47)).sum(0).astype(np.uint8)[:, :, None] % 2 * 255, "alpha": np.dstack([slope] * 3 + [np.full_like(slope, 7)])}


def test_previews_decode_to_nearly_what_they_were_made_of(spark):
    folder = shared_dir(spark)
    made = rasters()
    rows = spark.createDataFrame([(k, (None, *v.shape, 16, bytearray(v.tobytes()))) for k, v in made.items()], f"name string, image {images.IMAGE.simpleString()}")
    Path(folder.removeprefix("file://")).mkdir()
    for r in rows.select("name", images.preview(F.col("image")).alias("jpeg")).collect():
        assert r["jpeg"][:2] == b"\xff\xd8" and b"Exif" not in r["jpeg"] and images.jpeg_facts(bytes(r["jpeg"]))[:2] == made[r["name"]].shape[1::-1]
        (Path(folder.removeprefix("file://")) / f"{r['name']}.jpg").write_bytes(r["jpeg"])
    got = {r["key"].removesuffix(".jpg"): r["image"] for r in images.read_rasters(spark, folder).collect()}
    for name, raster in made.items():
        image = got[name]
        back = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"]).astype(int)
        worst = np.abs(back - raster[:, :, : back.shape[2]]).max()
        assert worst <= (2 if made[name].shape[2] == 1 else 4), (name, worst)


def test_previews_are_bounded_and_smaller_than_their_source(spark):
    big = drawing.draw([("HELTFI" * 12, 6, 60)])
    row = spark.createDataFrame([((None, *big.shape, 0, bytearray(big.tobytes())),), ((None, -1, -1, -1, -1, bytearray()),)], f"image {images.IMAGE.simpleString()}")
    a, b = [r[0] for r in row.select(images.preview(F.col("image"))).collect()]
    assert b is None and images.jpeg_facts(bytes(a))[0] == images.PREVIEW_EDGE and len(a) < big.size / 4
    assert len(jpeg.encode(big, 8)) < len(jpeg.encode(big, 0))


def test_rows_that_are_drawn_alike_share_a_file(spark, same_rows, tmp_path):
    import duckdb

    from proofmark import storage
    from proofmark.plans import rasters as plan

    part = spark.range(60).select(((F.col("id") % 3 + 4) + F.floor(F.col("id") / 3) * 5 * 11 * 4 * 29).alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("p_brand"), (F.col("id") % 3).cast("int").alias("p_size"))
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    for name, query in plan.QUERIES.items():
        before = len(storage._made)
        same_rows(query(spark, str(tmp_path)), con.sql(plan.ORACLES[name]))
        folder = Path(storage._made[before].removeprefix("file://"))
        assert len(list((folder / "images").glob("*.png"))) == 3
