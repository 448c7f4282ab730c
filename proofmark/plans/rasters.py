"""Registered query over images: drawn from table rows, stored, gated, decoded, keyed, turned, measured and judged."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import pairing_key
from ..operators import bold
from ..sources import drawing, images
from ..storage import materialize, settled, shared_dir, small, spread
from .queries import table

M, GAP = drawing.MARGIN, drawing.LEADING
#: Glyphs of a heading and of the line below it.
HEAD, BODY = 6, 9


def _drawn(spark, sf_dir):
    """What is drawn for each part: strokes, heights, channels and a turn; every 29th file is no image."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")).select(
        "p_partkey", "p_brand", (2 + size % 7).cast("int").alias("head"), (2 + k % 5).cast("int").alias("body"), (14 + size % 9).cast("int").alias("head_cap"),
        (14 + k % 11).cast("int").alias("body_cap"), (1 + 2 * (k % 2)).cast("int").alias("channels"), (k % 4 * 90).cast("int").alias("turn"), F.concat(F.lit("L"), k.cast("string"), F.lit(".png")).alias("name"))
    line = lambda n, s, c: F.struct(F.lit("I" * n).alias("text"), F.col(s).alias("stroke"), F.col(c).alias("cap"))
    return rows.withColumn("lines", F.when(k % 29 != 5, F.array(line(HEAD, "head", "head_cap"), line(BODY, "body", "body_cap"))))


def _around(n: int, top, stroke: str, cap: str):
    """The rectangle of a line, with some white."""
    part = lambda x: x.cast("int")
    return F.struct(part(F.lit(M - 4)).alias("x0"), part(top - 4).alias("y0"), part((3 * n - 2) * F.col(stroke) + M + 4).alias("x1"), part(top + F.col(cap) + 4).alias("y1"))


def _decoded(spark, sf_dir, folder: str):
    """(rows with the key of their drawing, decoded drawings by key): what is drawn alike is drawn, stored, gated and decoded once."""
    spec = F.struct("lines", "channels", "turn")
    rows = _drawn(spark, sf_dir).withColumn("name", F.concat(F.sha2(F.to_json(spec), 256), F.lit(".png"))).withColumn("key", pairing_key(F.col("name")))
    made = rows.select("name", "lines", "channels", "turn").distinct().repartition(4 * spark.sparkContext.defaultParallelism)
    materialize(drawing.write_images(made, f"{folder}/images"), folder, "written")
    return rows, materialize(images.read_rasters(spark, f"{folder}/images"), folder, "decoded")


def raster_strokes(spark, sf_dir):
    """Strokes, heights, verdict, pixel key, size of the reader's copy and replayed brand of every image that passes the gates."""
    folder = shared_dir(spark)
    rows, decoded = _decoded(spark, sf_dir, folder)
    known = rows.select("key", "head", "body", "head_cap", "body_cap", "turn").distinct()
    upright = images.turn(decoded.join(known, "key"), F.col("turn"))
    keyed = materialize(upright.withColumn("pixel_key", images.pixel_key(F.col("image"))).drop("turn"), folder, "upright")
    recorded = rows.select("key", "p_brand").join(small(keyed.select("key", "pixel_key")), "key").groupBy("pixel_key").agg(F.min("p_brand").alias("fields"))
    recorded = materialize(recorded, folder, "recorded")
    rectangles = F.array(_around(HEAD, F.lit(M), "head", "head_cap"), _around(BODY, M + F.col("head_cap") + GAP, "body", "body_cap"))
    image = F.col("image")
    measured = settled(images.replay(keyed.drop("pixel_key"), recorded), m=bold.measure_rectangles(image["data"], image["height"], image["width"], image["nChannels"], rectangles), copy=images.png_size(images.vision_copy(image)))
    told = measured.select(
        "key", F.col("m")[0]["stroke"].alias("head_stroke"), F.col("m")[0]["cap"].alias("head_cap"), F.col("m")[1]["stroke"].alias("body_stroke"), F.col("m")[1]["cap"].alias("body_cap"),
        bold.decide(F.lit(True), F.col("m"))["verdict"].alias("verdict"), "pixel_key", F.col("copy.width").alias("width"), F.col("copy.height").alias("height"), F.col("fields").alias("brand"))
    return rows.select("p_partkey", "key").join(small(materialize(told, folder, "told")), "key").drop("key")


def raster_previews(spark, sf_dir):
    """The size of every image's preview, and whether it decodes to nearly the image."""
    folder = shared_dir(spark)
    rows, decoded = _decoded(spark, sf_dir, folder)
    previews = decoded.select(F.concat("key", F.lit(".jpg")).alias("name"), images.preview(F.col("image")).alias("content"))
    materialize(images.store_files(previews, f"{folder}/previews"), folder, "stored")
    back = images.read_rasters(spark, f"{folder}/previews").select(F.replace("key", F.lit(".png.jpg"), F.lit(".png")).alias("key"), F.col("image").alias("preview"))
    both = decoded.join(back, "key").select("key", F.col("preview.width").cast("long").alias("width"), F.col("preview.height").cast("long").alias("height"), (images.differences(F.col("image"), F.col("preview")) <= 2).alias("near"))
    return rows.select("p_partkey", "key").join(small(materialize(both, folder, "compared")), "key").drop("key")


QUERIES = {"raster_strokes": raster_strokes, "raster_previews": raster_previews}

_ROW = lambda n, s: f"repeat('ffffff', {M}) || repeat(repeat('000000', {s}) || repeat('ffffff', 2 * {s}), {n - 1}) || repeat('000000', {s}) || repeat('ffffff', w - {M} - {3 * n - 2} * {s})"

#: The stroke of a bar is read at the middle of it: twice the pixels to its edge.
_DRAWN = f"""
WITH p AS (SELECT p_partkey, p_brand, 2 + p_size % 7 AS hs, 2 + p_partkey % 5 AS bs, 14 + p_size % 9 AS hc, 14 + p_partkey % 11 AS bc FROM part WHERE p_partkey % 29 <> 5),
d AS (SELECT *, ({2 * M} + greatest({3 * HEAD - 2} * hs, {3 * BODY - 2} * bs))::BIGINT AS w, ({2 * M + GAP} + hc + bc)::BIGINT AS h, (2.0 * ((hs + 1) // 2))::DOUBLE AS hm, (2.0 * ((bs + 1) // 2))::DOUBLE AS bm FROM p)"""

ORACLES = {
    "raster_previews": f"""{_DRAWN} SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN w ELSE h END AS width, CASE WHEN p_partkey % 2 = 0 THEN h ELSE w END AS height, true AS near FROM d""",
    "raster_strokes": f"""{_DRAWN},
k AS (SELECT *, sha256(encode(w || 'x' || h || ':') || from_hex(repeat(repeat('ffffff', w), {M}) || repeat({_ROW(HEAD, 'hs')}, hc) || repeat(repeat('ffffff', w), {GAP}) || repeat({_ROW(BODY, 'bs')}, bc) || repeat(repeat('ffffff', w), {M}))) AS pixel_key FROM d)
SELECT p_partkey, hm AS head_stroke, hc::DOUBLE AS head_cap, bm AS body_stroke, bc::DOUBLE AS body_cap,
  CASE WHEN hm / bm >= 1.30 THEN 'bold_ok' WHEN hm / bm <= 0.90 AND greatest(hc, bc) <= 1.40 * least(hc, bc) THEN 'not_bold' ELSE 'review' END AS verdict,
  pixel_key, w AS width, h AS height, min(p_brand) OVER (PARTITION BY pixel_key) AS brand FROM k""",
}
