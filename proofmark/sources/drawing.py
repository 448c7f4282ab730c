"""Label images drawn from table rows: lines of glyphs of known stroke and height, as PNG files in a folder.

A glyph is a few bars of one stroke width, so what a measurement of the decoded image has to give is known from the row.  Each task draws
and writes one image at a time; the files take their names from the rows, so a task that runs again writes the same files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from .images import write_png

#: White around an image and between its lines, in pixels; between two glyphs it is two strokes.
MARGIN, LEADING = 8, 12
LINES = "array<struct<text: string, stroke: int, cap: int>>"


def glyph(letter: str, stroke: int, cap: int) -> np.ndarray:
    """The ink of a letter of bars, ``cap`` pixels high: E, F, H, I, L or T."""
    wide = max(2 * stroke + 2, cap // 2)
    ink = np.zeros((cap, stroke if letter == "I" else wide), bool)
    middle = (cap - stroke) // 2
    bars = {"I": [ink], "L": [ink[:, :stroke], ink[-stroke:]], "E": [ink[:, :stroke], ink[:stroke], ink[middle : middle + stroke], ink[-stroke:]],
            "F": [ink[:, :stroke], ink[:stroke], ink[middle : middle + stroke]], "H": [ink[:, :stroke], ink[:, -stroke:], ink[middle : middle + stroke]],
            "T": [ink[:stroke], ink[:, (wide - stroke) // 2 : (wide - stroke) // 2 + stroke]]}
    if letter not in bars:
        raise ValueError(f"no glyph for {letter!r}")
    for bar in bars[letter]:
        bar[...] = True
    return ink


def draw_line(text: str, stroke: int, cap: int) -> np.ndarray:
    parts: list[np.ndarray] = []
    for letter in text:
        parts += [glyph(letter, stroke, cap), np.zeros((cap, 2 * stroke), bool)]
    return np.hstack(parts[:-1]) if parts else np.zeros((cap, 0), bool)


def draw(lines: list[tuple[str, int, int]], channels: int = 1, turn: int = 0) -> np.ndarray:
    """A raster (height, width, channels) of lines (text, stroke, cap), black on white, turned clockwise by right angles."""
    inks = [draw_line(*line) for line in lines]
    height = 2 * MARGIN + sum(len(x) for x in inks) + LEADING * max(0, len(inks) - 1)
    out = np.full((height, 2 * MARGIN + max((x.shape[1] for x in inks), default=0)), 255, np.uint8)
    y = MARGIN
    for ink in inks:
        out[y : y + len(ink), MARGIN : MARGIN + ink.shape[1]][ink] = 0
        y += len(ink) + LEADING
    return np.ascontiguousarray(np.repeat(np.rot90(out, -(turn // 90))[:, :, None], channels, 2))


def write_images(rows: DataFrame, folder: str) -> DataFrame:
    """Draw (name, lines, channels, turn) into PNG files of a folder that executors share; (name, size) of each.

    Rows without lines become files that are no images.
    """
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            sizes = []
            for r in batch.to_pylist():
                data = b"no image" if r["lines"] is None else write_png(draw([(x["text"], x["stroke"], x["cap"]) for x in r["lines"]], r["channels"], r["turn"]))
                with store.open_output_stream(f"{root}/{r['name']}", compression=None) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "size"])

    return rows.select("name", "lines", "channels", "turn").mapInArrow(run, "name string, size long")
