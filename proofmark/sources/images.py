"""Image files: gates on size and header before anything is decoded, rasters the right way up, replayed extractions."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import pairing_key
from ..storage import gather, shared_dir

# Signatures and bounds.
PNG, JPEG, RIFF, WEBP = "89504E470D0A1A0A", "FFD8FF", "52494646", "57454250"
MAX_PIXELS = 40_000_000
FILE_BYTES = 5 << 20
BINARY = "path string, modificationTime timestamp, length long, content binary"


def is_image(head: Column) -> Column:
    """Whether the first bytes are those of a PNG or JPEG file."""
    return F.coalesce(F.hex(F.substring(head, 1, 8)) == PNG, F.lit(False)) | F.coalesce(F.hex(F.substring(head, 1, 3)) == JPEG, F.lit(False))


def media_type(head: Column) -> Column:
    """image/png, image/jpeg or image/webp; null for other content."""
    return (F.when(F.hex(F.substring(head, 1, 8)) == PNG, "image/png").when(F.hex(F.substring(head, 1, 3)) == JPEG, "image/jpeg")
            .when((F.hex(F.substring(head, 1, 4)) == RIFF) & (F.hex(F.substring(head, 9, 4)) == WEBP), "image/webp"))


def png_size(content: Column) -> Column:
    """struct(width, height) from the header of a PNG file, without decoding it."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(content, 1, 8)) == PNG, F.struct(number(17).alias("width"), number(21).alias("height")))


def jpeg_facts(content: bytes) -> tuple[int, int, int] | None:
    """(width, height, orientation) from the segments before a JPEG file's scan; null if there is no frame header."""
    at, turn = 2, 1
    while at + 4 <= len(content) and content[at] == 0xFF:
        kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4])
        body = content[at + 4 : at + 2 + size]
        if kind == 0xFF:  # a fill byte
            at += 1
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return (int.from_bytes(body[3:5]), int.from_bytes(body[1:3]), turn) if len(body) >= 5 else None
        if kind == 0xE1 and body[:6] == b"Exif\0\0":
            turn = exif_orientation(body[6:])
        if kind == 0xDA or size < 2:
            return None
        at += 2 + size
    return None


def exif_orientation(tiff: bytes) -> int:
    """The orientation tag of the first directory, 1 to 8; 1 if there is none."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        start = struct.unpack_from(f"{order}I", tiff, 4)[0]
        for i in range(struct.unpack_from(f"{order}H", tiff, start)[0]):
            tag, _, _, value = struct.unpack_from(f"{order}HHIH", tiff, start + 2 + 12 * i)
            if tag == 0x0112:
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


_FACTS = T.StructType([T.StructField(x, T.LongType()) for x in ("width", "height", "orientation")])


@F.arrow_udf(_FACTS)
def _jpeg(content: pa.Array) -> pa.Array:
    got = [jpeg_facts(c.as_py()) if c.is_valid else None for c in content]
    return pa.array([g and dict(zip(_FACTS.names, g)) for g in got], pa.struct([(x, pa.int64()) for x in _FACTS.names]))


def image_facts(content: Column) -> Column:
    """struct(width, height, orientation) from the header of a PNG or JPEG file, without decoding it.

    PNG headers are read by expressions; only JPEG files reach the function that walks their segments.
    """
    png, jpeg = png_size(content), _jpeg(F.when(F.hex(F.substring(content, 1, 3)) == JPEG, content))
    return F.when(png.isNotNull(), F.struct(png["width"].alias("width"), png["height"].alias("height"), F.lit(1).cast("long").alias("orientation"))).otherwise(jpeg)


def problem(length: Column, content: Column, facts: Column) -> Column:
    """Why a file is not taken, or null: empty, too large, no image, no size in its header, too many pixels."""
    return (F.when(length == 0, "The file is empty.").when(length > FILE_BYTES, "The file is larger than 5 MB.")
            .when(~is_image(content), "The file is not a PNG or JPEG image.")
            .when((facts["width"] * facts["height"]).isNull(), "The image cannot be read.").when(facts["width"] * facts["height"] > MAX_PIXELS, "The image has too many pixels."))


def read_files(spark: SparkSession, path: str, stream: bool = False, most: int = 1000) -> DataFrame:
    """(place, filename, key, length, content, facts, modified, problem); files beyond the limit are listed without reading their content.

    A stream takes at most so many files at a time.
    """
    reader = (spark.readStream.schema(BINARY).option("maxFilesPerTrigger", most) if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.load(path).withColumn("place", F.col("_metadata.file_path"))
    if not stream:
        small = files.where(F.col("length") <= FILE_BYTES)  # pushed into the source
        files = small.unionByName(files.where(F.col("length") > FILE_BYTES).drop("content").withColumn("content", F.lit(None).cast("binary")))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    files = files.select("place", name.alias("filename"), pairing_key(name).alias("key"), "length", "content", image_facts(F.col("content")).alias("facts"), F.col("modificationTime").alias("modified"))
    return files.withColumn("problem", problem(F.col("length"), F.col("content"), F.col("facts")))


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """(key, image) of the files that pass the gates, decoded by the JVM and turned the right way up; width -1 if undecodable.

    The decoder takes whole folders, so where a file is turned down the others are first copied to a folder of their
    own in shared storage: nothing that fails the gate is ever decoded.
    """
    files, folder, place = read_files(spark, path), path, F.col("_metadata.file_path")
    if not files.where("problem IS NOT NULL").isEmpty():
        folder, place = f"{shared_dir(spark)}/accepted", F.regexp_extract("_metadata.file_path", "([^/]*)$", 1)
        files = _copy(files.where("problem IS NULL"), folder)
    known = files.select("place", "key", F.col("facts.orientation").alias("orientation"))
    images = spark.read.schema("image " + IMAGE.simpleString()).format("image").option("recursiveFileLookup", "true").load(folder)
    return gather(images).select(place.alias("place"), "image").join(known, "place").select("key", upright(F.col("image"), F.col("orientation")).alias("image"))


def _copy(files: DataFrame, folder: str) -> DataFrame:
    """Write accepted files to a folder, named by a digest of where they lie; (place, key, facts)."""
    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(3)):
                with store.open_output_stream(f"{root}/{name.as_py()}", compression=None) as out:
                    out.write(content.as_py())
            yield batch.select([0, 1, 2])

    files = files.select(F.sha1("place").alias("place"), "key", "facts", "content")
    schema = files.drop("content").schema
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    gather(files).mapInArrow(run, schema).write.parquet(f"{folder}-list")  # before the decoder looks for the files
    return files.sparkSession.read.schema(schema).parquet(f"{folder}-list")


def store_files(files: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) as files of a folder that executors share; (name, size) of each.  Rows without content give none."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                with store.open_output_stream(f"{root}/{name.as_py()}", compression=None) as out:
                    out.write(content.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c.as_py()) for c in batch.column(1)], pa.int64())], names=["name", "size"])

    return files.where("content IS NOT NULL").select("name", "content").mapInArrow(run, "name string, size long")


def differences(a: Column, b: Column) -> Column:
    """The largest difference of a grey level or colour between two images of one size and number of channels; null if they are not."""
    return _differences(a["data"], b["data"], (a["height"] == b["height"]) & (a["width"] == b["width"]) & (a["nChannels"] == b["nChannels"]))


@F.arrow_udf(T.IntegerType())
def _differences(a: pa.Array, b: pa.Array, alike: pa.Array) -> pa.Array:
    levels = lambda x: np.frombuffer(x.as_py(), np.uint8).astype(np.int16)
    return pa.array([int(np.abs(levels(x) - levels(y)).max(initial=0)) if same.as_py() and x.is_valid and y.is_valid else None for x, y, same in zip(a, b, alike)], pa.int32())


def rotate(raster: np.ndarray, clockwise: int) -> np.ndarray:
    """Undo an apparent clockwise turn of 0, 90, 180 or 270 degrees."""
    if clockwise not in (0, 90, 180, 270):
        raise ValueError(f"no right angle: {clockwise}")
    return np.rot90(raster, clockwise // 90)


def orient(raster: np.ndarray, orientation: int) -> np.ndarray:
    """A raster with the given orientation tag, the right way up."""
    turned = np.rot90(raster, {1: 0, 2: 0, 3: 2, 4: 2, 5: 3, 6: 3, 7: 1, 8: 1}[orientation])
    return turned[:, ::-1] if orientation in (2, 4, 5, 7) else turned


IMAGE = T.StructType([T.StructField("origin", T.StringType()), *[T.StructField(x, T.IntegerType()) for x in ("height", "width", "nChannels", "mode")], T.StructField("data", T.BinaryType())])
_TURNED = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("data", T.BinaryType())])
#: An apparent clockwise turn -> the orientation tag that undoes it.
_TURNS = {90: 8, 180: 3, 270: 6}


@F.arrow_udf(_TURNED)
def _oriented(data: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array, orientation: pa.Array) -> pa.Array:
    out = []
    for d, h, w, c, o in zip(data, height, width, channels, orientation):
        if not d.is_valid or not o.is_valid:
            out.append(None)
            continue
        x = np.ascontiguousarray(orient(np.frombuffer(d.as_py(), np.uint8).reshape(h.as_py(), w.as_py(), c.as_py()), o.as_py()))
        out.append({"height": x.shape[0], "width": x.shape[1], "data": x.tobytes()})
    return pa.array(out, pa.struct([("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())]))


def upright(image: Column, orientation: Column) -> Column:
    """An image struct with its orientation tag applied; images that are upright, or could not be decoded, stay as they are."""
    turned = F.when(orientation.between(2, 8) & (image["width"] > 0), orientation.cast("int"))
    got = _oriented(F.when(turned.isNotNull(), image["data"]), image["height"], image["width"], image["nChannels"], turned)
    part = lambda x: (F.coalesce(got[x], image[x]) if x in ("height", "width", "data") else image[x]).alias(x)
    return F.struct(*[part(x) for x in IMAGE.names])


def turn(rasters: DataFrame, clockwise: Column) -> DataFrame:
    """``rasters`` with an apparent clockwise turn of 90, 180 or 270 degrees undone; other values change nothing."""
    tag = F.try_element_at(F.create_map(*[F.lit(x) for kv in _TURNS.items() for x in kv]), clockwise.cast("int"))
    return rasters.withColumn("image", upright(F.col("image"), tag))


def write_png(raster: np.ndarray) -> bytes:
    """A PNG file, without metadata, of a grey or blue-green-red raster."""
    rgb = raster[:, :, 0] if raster.shape[2] == 1 else raster[:, :, 2::-1]
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = np.concatenate([np.zeros((rgb.shape[0], 1), np.uint8), np.ascontiguousarray(rgb).reshape(rgb.shape[0], -1)], 1)
    header = struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 0 if rgb.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def shrink(raster: np.ndarray, edge: int) -> np.ndarray:
    """A raster whose longer edge is at most ``edge``, each pixel the mean of those it stands for."""
    scale = max(raster.shape[:2]) / edge
    if scale <= 1:
        return raster
    x = raster.astype(np.float64)
    for axis in (0, 1):
        cuts = (np.arange(max(1, round(raster.shape[axis] / scale))) * scale).astype(np.int64)
        counts = np.diff(np.r_[cuts, x.shape[axis]])
        x = np.add.reduceat(x, cuts, axis) / counts.reshape([-1 if i == axis else 1 for i in range(3)])
    return (x + 0.5).astype(np.uint8)


#: Fixed value: the longer edge of a copy for the reader.
VISION_EDGE = 1568


@F.arrow_udf(T.BinaryType())
def _vision(data: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array) -> pa.Array:
    out = []
    for d, h, w, c in zip(data, height, width, channels):
        ok = d.is_valid and w.as_py() > 0
        out.append(write_png(shrink(np.frombuffer(d.as_py(), np.uint8).reshape(h.as_py(), w.as_py(), c.as_py()), VISION_EDGE)) if ok else None)
    return pa.array(out, pa.binary())


def vision_copy(image: Column) -> Column:
    """The image as a PNG file of bounded size for a reader; null if it could not be decoded."""
    return _vision(image["data"], image["height"], image["width"], image["nChannels"])


#: Fixed value: the longer edge of a preview.
PREVIEW_EDGE = 1200


@F.arrow_udf(T.BinaryType())
def _preview(data: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array) -> pa.Array:
    from .jpeg import encode

    out = []
    for d, h, w, c in zip(data, height, width, channels):
        ok = d.is_valid and w.as_py() > 0
        out.append(encode(shrink(np.frombuffer(d.as_py(), np.uint8).reshape(h.as_py(), w.as_py(), c.as_py()), PREVIEW_EDGE)) if ok else None)
    return pa.array(out, pa.binary())


def preview(image: Column) -> Column:
    """The image as a JPEG file of bounded size, without metadata, for a page; null if it could not be decoded."""
    return _preview(image["data"], image["height"], image["width"], image["nChannels"])


def _pixel_keys(data: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array) -> pa.Array:
    import hashlib

    out = []
    for d, h, w, c in zip(data, height, width, channels):
        if not d.is_valid or w.as_py() <= 0:
            out.append(None)
            continue
        x = np.frombuffer(d.as_py(), np.uint8).reshape(h.as_py(), w.as_py(), c.as_py())
        rgb = np.repeat(x, 3, 2) if x.shape[2] == 1 else x[:, :, 2::-1]
        out.append(hashlib.sha256(f"{w.as_py()}x{h.as_py()}:".encode() + np.ascontiguousarray(rgb).tobytes()).hexdigest())
    return pa.array(out, pa.string())


_keys = F.arrow_udf(_pixel_keys, T.StringType())


def pixel_key(image: Column) -> Column:
    """SHA-256 of size and RGB pixels: finds a recorded extraction whatever the file's encoding."""
    return _keys(image["data"], image["height"], image["width"], image["nChannels"])


def replay(rasters: DataFrame, recorded: DataFrame) -> DataFrame:
    """``rasters`` with the recorded fields of (pixel_key, fields); an image without a record is an error."""
    keyed = rasters.withColumn("pixel_key", pixel_key(F.col("image")))
    missing = keyed.join(recorded, "pixel_key", "left_anti").select("key").take(1)
    if missing:
        raise KeyError(f"no extraction is recorded for {missing[0]['key']}")
    return keyed.join(recorded, "pixel_key")
