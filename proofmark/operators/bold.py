"""The weight of the warning heading, from rasters and the lines read from them.

Where to measure and what the measures mean are expressions over the lines; only the stroke widths come
from an Arrow function, which sees pixels and rectangles and knows nothing of rules.

``layout`` picks the heading and the rectangles: the heading's words and what stands beside them on its line,
or, if nothing much does, the heading and the lines of the statement's body.  ``decide`` reads the verdict
from their measures.  Lines of other sizes can clear a heading but never condemn it.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strokes import measure
from ..functions.text import count_words, pairing_key, squash

# Decision bands and limits.
MIN_CAP = 14.0
BOLD, NOT_BOLD, NOT_BOLD_SURE, SAME_SIZE, CROSS_LINE = 1.30, 1.12, 0.90, 1.40, 1.15
MIN_BESIDE, MIN_BESIDE_PX, MIN_BODY_WORDS, MIN_BODY_LINES = 8, 10, 2, 2
# Words of the statement's body.
BODY_WORDS = ("surgeon", "general", "women", "should", "drink", "alcoholic", "beverages", "pregnancy", "birth", "defects",
              "consumption", "impairs", "ability", "machinery", "health")

RECTANGLE = T.StructType([T.StructField(x, T.IntegerType()) for x in ("x0", "y0", "x1", "y1")])
MEASURE = T.StructType([T.StructField("stroke", T.DoubleType()), T.StructField("cap", T.DoubleType())])
LAYOUT = "struct<beside:boolean,rectangles:array<struct<x0:int,y0:int,x1:int,y1:int>>>"


def rectangle(box: Column) -> Column:
    """Whole pixels around a quadrilateral, from the raster's edge on."""
    side = lambda axis, pick: F.greatest(F.lit(0), pick(F.transform(box, lambda p: p[axis])).cast("int"))
    return F.struct(side("x", F.array_min).alias("x0"), side("y", F.array_min).alias("y0"), side("x", F.array_max).alias("x1"), side("y", F.array_max).alias("y1"))


def layout(lines: Column) -> Column:
    """``LAYOUT`` of a label's lines, or null if there is nothing to measure."""
    boxed = F.filter(F.array_sort(F.transform(lines, lambda x: F.struct(
        x["pos"].alias("pos"), x["text"].alias("text"), F.coalesce(x["rotation"], F.lit(0)).alias("turn"), F.when(F.size(x["box"]) > 0, rectangle(x["box"])).alias("at")))),
        lambda x: x["at"].isNotNull())
    heading = F.try_element_at(F.filter(boxed, lambda x: F.contains(squash(x["text"]), F.lit("governmentwarning"))), F.lit(1))

    def place(head: Column) -> Column:
        stop = F.instr(F.lower(head["text"]), "warning") + 6  # characters up to the word's end
        r = head["at"]
        cut = r["x0"] + ((r["x1"] - r["x0"]) * (stop / F.length(head["text"]))).cast("int")
        left, right = (F.struct(a.alias("x0"), r["y0"].alias("y0"), b.alias("x1"), r["y1"].alias("y1")) for a, b in ((r["x0"], cut), (cut, r["x1"])))
        fits = (cut > r["x0"]) & (r["x1"] - cut >= MIN_BESIDE_PX) & (r["y1"] > r["y0"])
        body = F.filter(boxed, lambda x: (x["turn"] == 0) & (x["pos"] != head["pos"]) & (count_words(x["text"], BODY_WORDS) >= MIN_BODY_WORDS))
        beside = F.length(squash(F.substr(head["text"], stop + 1))) >= MIN_BESIDE
        spread = F.concat(F.array(r), F.transform(body, lambda x: x["at"]))
        chosen = F.struct(beside.alias("beside"), F.when(~beside, spread).when(fits, F.array(left, right)).alias("rectangles"))
        return F.when((head["turn"] == 0) & (stop > 6), chosen.cast(LAYOUT))

    return F.element_at(F.transform(F.array(heading), place), 1)


def decide(beside: Column, measures: Column) -> Column:
    """struct(verdict, ratio) from the measures of the rectangles (null where nothing could be measured)."""
    m = lambda i: F.try_element_at(measures, F.lit(i))
    head, other = m(1), m(2)
    heavier = head["stroke"] / other["stroke"]
    readable = (F.least(head["cap"], other["cap"]) >= MIN_CAP) & (other["stroke"] > 0)
    alike = F.greatest(head["cap"], other["cap"]) <= SAME_SIZE * F.least(head["cap"], other["cap"])
    on_line = F.when(heavier >= BOLD, "bold_ok").when((heavier <= min(NOT_BOLD, NOT_BOLD_SURE)) & alike, "not_bold").otherwise("review")

    weight = lambda x: x["stroke"] / x["cap"]
    usable = F.filter(F.slice(measures, 2, F.greatest(F.size(measures) - 1, F.lit(0))), lambda x: (x["stroke"] > 0) & (x["cap"] > 0))
    ratios = F.array_sort(F.transform(usable, lambda x: weight(head) / weight(x)))
    n = F.size(ratios)
    middle = (F.try_element_at(ratios, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(ratios, F.floor(n / 2).cast("int") + 1)) / 2
    across = F.when((head["cap"] >= MIN_CAP) & (n >= MIN_BODY_LINES), middle)
    return (F.when(beside & readable, F.struct(on_line.alias("verdict"), heavier.alias("ratio")))
            .when(~beside & (F.size(measures) > 0), F.struct(F.when(across >= CROSS_LINE, "bold_ok").otherwise("review").alias("verdict"), across.alias("ratio")))
            .otherwise(F.struct(F.lit("review").alias("verdict"), F.lit(None).cast("double").alias("ratio"))))


def to_gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luma of a decoded image (blue, green, red order, or grey)."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return x[:, :, 0]
    return (x[:, :, :3] @ np.array([0.114, 0.587, 0.299]) + 0.5).astype(np.uint8)


@F.arrow_udf(T.ArrayType(MEASURE))
def measure_rectangles(data: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array, rectangles: pa.Array) -> pa.Array:
    """The stroke measure of each rectangle; null for a row that gives none or fails."""
    out = []
    for d, h, w, c, r in zip(data, height, width, channels, rectangles):  # one raster in memory at a time
        if not d.is_valid or not r.is_valid:
            out.append(None)
            continue
        try:
            gray = to_gray(d.as_py(), h.as_py(), w.as_py(), c.as_py())
            got = [measure(gray[x["y0"] : x["y1"], x["x0"] : x["x1"]]) for x in r.as_py()]
            out.append([g and {"stroke": g.stroke, "cap": g.cap} for g in got])
        except Exception:  # one image that cannot be measured is not evaluable; the others go on
            logging.getLogger(__name__).exception("the heading could not be measured")
            out.append(None)
    return pa.array(out, pa.list_(pa.struct([("stroke", pa.float64()), ("cap", pa.float64())])))


def with_bold(labels: DataFrame, rasters: DataFrame) -> DataFrame:
    """``labels`` with ``bold``: the verdict on its raster of (key, image); null if there is none, no line, or it failed.

    Paired like filings, by the base name.  Labels without a heading to measure never reach the function.
    """
    r = rasters.select(F.col("key").alias("__key"), "image")
    joined = labels.drop("bold").join(r, pairing_key(F.col("filename")) == F.col("__key"), "left")
    joined = joined.withColumns({"__ready": (F.col("image.width") > 0) & (F.size("ocr_lines") > 0), "__layout": layout(F.col("ocr_lines"))})
    wanted = F.when(F.col("__ready"), F.col("__layout.rectangles"))
    joined = joined.withColumn("__measures", measure_rectangles(F.when(wanted.isNotNull(), F.col("image.data")), F.col("image.height"), F.col("image.width"), F.col("image.nChannels"), wanted))
    judged = F.when(F.col("__ready"), F.when(wanted.isNull(), "review").when(F.col("__measures").isNotNull(), decide(F.col("__layout.beside"), F.col("__measures"))["verdict"]))
    return joined.withColumn("bold", judged).drop("__key", "image", "__ready", "__layout", "__measures")
