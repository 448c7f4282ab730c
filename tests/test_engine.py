"""Behaviours of the engine on hand-made labels."""

import json
import struct
import zlib
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofmark.functions import numeric, similarity, strokes, text
from proofmark.model import LABEL
from proofmark import service
from proofmark.operators import batch, bold, budget, corroborate, gate, matchers, page, rotation
from proofmark.operators.verify import beverage_class, verify
from proofmark.rulebook import Rulebook, load
from proofmark.settings import Settings
from proofmark.sources import applications, images

REF = load().warning.match.reference


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + ", ".join(f"c{j} string" for j in range(len(values[0]) if isinstance(values[0], tuple) else 1)))
    return [r[0] for r in rows.select("i", expression.alias("x")).orderBy("i").select("x").collect()]


def test_warning_verdicts(spark):
    cases = [
        (REF, "match"), (REF.upper(), "match"), (REF.replace(" ", "  "), "match"), (REF.replace("machinery,", "machin-\nery,"), "match"),
        (REF.replace("GOVERNMENT WARNING:", "GOVERNMENTWARNING:"), "match"), (REF.replace(" ", ""), "match"), (REF.replace("machinery, and", "machinery. and"), "match"),
        (REF.replace("GOVERNMENT WARNING", "Government Warning"), "capitalization"), (REF.replace("birth defects", "birth effects"), "altered"),
        (REF.replace("GOVERNMENT WARNING", "Government Warning").replace("birth defects", "birth effects"), "altered"), (REF.replace("GOVERNMENT", "GOVERMENT"), "altered"),
        (REF.replace("birth ", ""), "altered"), ("", "absent"), ("  \n ", "absent"), (None, "absent"), (REF.replace("-", "–").replace(" ", " "), "match")]
    got = column(spark, [(c,) for c, _ in cases], matchers.compare_warning(F.col("c0"), REF))
    assert got == [v for _, v in cases]


def test_reference_is_a_fixed_point(spark):
    assert column(spark, [(REF,)], text.canon_statutory(F.col("c0"))) == [REF]


def test_brand_verdicts(spark):
    cases = [
        ("STONE'S THROW", "Stone's Throw", "match"), ("Old Crow Distillery, Inc.", "Old Crow Distillery", "match"), ("OLD CROW", "OLD CROW RESERVE", "review"),
        ("MORTALIS", "MORTALIS BREWING COMPANY", "review"), ("VODKA 7", "7", "review"), ("7", "VODKA 7", "review"), ("RÉMY Œuf", "remy oeuf", "match"),
        ("old tom distillery", "river bend distillery", "mismatch"), ("Tito's Handmade Vodka", "Grey Goose", "mismatch"), ("Jack Daniei's", "Jack Daniel's", "review"),
        (None, "Grey Goose", "review"), ("Cisco", "Cisco Co. Inc", "match"), ("M&S", "M and S", "match"), ("STONEâ€™S", "Stone's", "match")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = matchers.match_brand(rows, "a", "b", "v", "s").orderBy("i").collect()
    assert [r["v"] for r in got] == [c[2] for c in cases]
    assert round(got[9]["s"], 2) == 91.67 and round(got[7]["s"], 2) == 61.54


def test_alcohol(spark):
    cases = [
        ("45% Alc./Vol. (90 Proof)", 45, 90), ("45% Alc./Vol. (100 Proof)", 45, 100), ("13.5% ALC BY VOL", Decimal("13.5"), None), ("750 mL", None, None), ("", None, None), (None, None, None),
        ("TEQUILA 100% DE AGAVE 40% ALC./VOL. (80 PROOF)", 40, 80), ("100% DE AGAVE 80 PROOF", None, None), (".5% ALC/VOL", None, None), ("ALCOHOL 40 PERCENT BY VOLUME", 40, None), ("5% more! 40% ALC", 5, None)]
    got = column(spark, [(c[0],) for c in cases], numeric.parse_alcohol(F.col("c0")))
    assert [(g and g["abv"], g and g["proof"]) for g in got] == [(a, p) for _, a, p in cases]


def test_csv_cells(spark):
    raw = ["=1+1", "+1", "-1", "@SUM(A1)", "\t=1+1", "\r=1+1", "\n=1+1", "x.png", "label-2024.png", "brand=value", ""]
    got = column(spark, [(x,) for x in raw], text.neutralize_csv_cell(F.col("c0")))
    assert got == ["'" + x for x in raw[:7]] + raw[7:]


def test_pairing_keys(spark):
    raw = ["labels/Label1.PNG", "scans\\Label1.PNG", "a/b/", "Straße.png", "x/."]
    assert column(spark, [(x,) for x in raw], text.pairing_key(F.col("c0"))) == ["label1.png", "label1.png", "b", "strasse.png", "x"]


def test_squash_folds_every_letter_like_python(spark):
    points = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    got = {r["id"]: r["s"] for r in points.select("id", text.squash(F.col("c")).alias("s")).where("s <> ''").collect()}
    fold = lambda i: "".join(x for x in chr(i).casefold() if x.isascii() and x.isalnum())
    assert got == {i: fold(i) for i in range(1, 0x110000) if fold(i)}


def test_beverages(spark):
    raw = ["Table Wine", "Robust Porter", "Single Malt Whisky", "Vodka", None, "Pale Ale"]
    assert column(spark, [(x,) for x in raw], beverage_class(F.col("c0"))) == ["wine", "wine", "malt", "spirits", "spirits", "malt"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab c", max_size=12), st.text(alphabet="ab c", max_size=12))
def test_similarity_is_the_textbook_one(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert similarity.lcs(a, b) == table[-1][-1]
    if a and a in b:
        assert similarity.partial_ratio(a, b) == 100


def test_support_of_long_quotes_and_edges():
    assert similarity.support("", "abc") == 0 and similarity.support("abc", "") == 0
    assert similarity.support("abcdefgh", "abc") == pytest.approx(6 / 11)
    assert similarity.support("abc", "xxabcxx") == 1
    assert similarity.word_diff("a B c", "a b d") == [{"op": "replace", "expected": "c", "found": "d"}]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=0x20, max_codepoint=0x24F), max_size=40), min_size=1, max_size=30))
def test_canonical_forms_are_idempotent(spark, values):
    for form in (text.canon_statutory, text.canon_brand):
        once = column(spark, [(v,) for v in values], form(F.col("c0")))
        assert column(spark, [(v,) for v in once], form(F.col("c0"))) == once


def label(i, warning=REF, brand="Old Tom", filed="Old Tom", fanciful="", alcohol="45% Alc./Vol. (90 Proof)", lines="same", bold_=None):
    f = lambda x: (x, x is not None, x)
    if lines == "same":
        lines = [(0, brand or "", 0.9, None, 0), (1, alcohol or "", 0.9, None, 0), (2, warning or "", 0.9, None, 0)]
    return (i, f"l{i}.png", (f(brand), f(None), f(alcohol), f(None), f(warning)), (filed, "", fanciful), lines, bold_)


def reports(spark, rows):
    return {r["label_id"]: (r["verdict"], {f["rule_id"].split("_")[0] + str(f["rule_pos"]): f["verdict"] for f in r["findings"]}, r["findings"]) for r in verify(spark.createDataFrame(rows, LABEL), load()).collect()}


def test_gate_and_verdicts(spark):
    wrong = REF.replace("birth defects", "birth effects")
    got = reports(spark, [
        label(0), label(1, warning=wrong), label(2, lines=[(0, "Old Tom 45% Alc./Vol. (90 Proof) " + wrong, 0.9, None, 0)]), label(3, lines=None), label(4, lines=[]),
        label(5, brand="Grey Goose", lines=[(0, "Zyx 45% Alc./Vol. (90 Proof) " + REF, 0.9, None, 0)]), label(6, brand="Grey Goose"), label(7, filed=""), label(8, filed="", bold_="not_bold"),
        label(9, brand="Yellow Card", filed="Earth", fanciful="Yellow Card"), label(10, alcohol=None), label(11, warning=None), label(12, brand="Grey Goose", lines=[(0, "x", 0.1, None, 0)])])
    assert got[0][0] == "pass" and got[0][1]["health1"] == "not_evaluable"
    assert got[1][0] == "fail" and [d["op"] for d in got[1][2][0]["diff"]] == ["replace"]
    assert got[2][1]["health0"] == "needs_review"  # recited: the second read does not confirm it
    assert got[3][1]["health0"] == "pass" and got[4][1]["health0"] == "needs_review"  # no read is not an empty read
    assert got[5][1]["brand2"] == "needs_review" and got[6][1]["brand2"] == "fail" and got[12][1]["brand2"] == "fail"
    assert got[7][1]["brand2"] == "not_evaluable" and got[7][0] == "pass" and got[8][0] == "fail"
    assert got[9][1]["brand2"] == "pass" and got[10][0] == "needs_review" and got[11][0] == "needs_review"


def test_labels_without_rules_go_to_review(spark):
    book = Rulebook(rules=[load().rules[0].model_copy(update={"beverage_classes": ["wine"]})], version="x")
    got = verify(spark.createDataFrame([label(0)], LABEL), book).first()
    assert got["verdict"] == "needs_review" and got["findings"] == []


def test_rulebook_rejects_bad_rules(tmp_path):
    with pytest.raises(ValueError):
        load(str(tmp_path))
    (tmp_path / "a.yaml").write_text("rules: [{id: a, title: t, citation: c, beverage_classes: [all], match: {strategy: unknown}}]")
    load.cache_clear()
    with pytest.raises(ValueError):
        load(str(tmp_path))
    assert len(load().version) == 12 and set(matchers.STRATEGIES) == {r.match.strategy for r in load().rules}


def test_statement_is_in_one_file_only():
    from pathlib import Path

    words = "because of the " + "risk of birth"
    root = Path(__file__).resolve().parent.parent
    assert [p for p in root.rglob("*.py") if words in p.read_text()] == []


def test_applications(spark):
    parse = applications.parse
    assert parse(b"") == [] and parse(b"\xef\xbb\xbfFilename , Brand_Name\na.png, Old Tom \n,x\n") == [(0, "a.png", "Old Tom", "", "")]
    for bad in (b"nothing,useful\n1,2\n", b"\x89PNG\r\n\x1a\n\x00\x00", b"a" * 200_000):
        with pytest.raises(applications.ApplicationsError):
            parse(bad)
    got = applications.from_upload(spark, b"filename,brand_name\nx/A.png,first\na.PNG,\"last, one\"\n").collect()
    assert [(r["key"], r["brand_name"], r["fanciful_name"]) for r in got] == [("a.png", "last, one", "")]


def test_applications_from_files_and_grid_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Filename,Brand_Name\nl0.png,"Old ""Tom"", Inc"\nL0.PNG,last\n')
    got = applications.from_files(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["key"], r["brand_name"]) for r in got] == [("l0.png", "last")]
    items = batch.to_items(verify(spark.createDataFrame([label(0), label(1, warning=None)], LABEL), load()), rejected=spark.createDataFrame([(0, "=x", "The file is empty.")], "pos int, filename string, detail string"))
    applications.write_grid(items, load(), str(tmp_path / "out"))
    lines = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert lines[0].startswith("filename,status,verdict,detail,health_warning_verbatim") and lines[3].startswith("'=x,error,,The file is empty.,,")
    counts = batch.summary(items).first()
    assert (counts["pass"], counts["needs_review"], counts["error"], counts["total"], counts["finished"]) == (1, 1, 1, 3, True)
    pairing = spark.createDataFrame([(1, 0)], "csv_rows int, csv_unmatched int")
    body = json.loads(applications.progress_json(batch.summary(items), items, pairing).first()["json"])
    assert body["total"] == 3 and [i["status"] for i in body["items"]] == ["done", "done", "error"] and body["items"][2]["verdict"] is None


def test_headlines(spark):
    got = {r["pos"]: r["detail"] for r in batch.to_items(verify(spark.createDataFrame([label(0, bold_="bold_ok"), label(1), label(2, filed=""), label(3, alcohol=None, warning=None)], LABEL), load())).collect()}
    assert got[0] == "Every check passed." and got[1].startswith("Every check that ran passed. Left out: ") and got[2].endswith("left out: 2") and "health warning" in got[3]


def test_retention_and_budget(spark):
    jobs = spark.createDataFrame([(i, i % 3 != 0) for i in range(200)], "created_seq long, finished boolean")
    kept = batch.retain(jobs).collect()
    assert sum(r["finished"] for r in kept) == 50 and sum(not r["finished"] for r in kept) == 67
    assert budget.allowance("5.0") == 1000 and budget.allowance("0.004") == 0
    few = spark.createDataFrame([(1, True)], "created_seq long, finished boolean")
    assert batch.retain(few).count() == 1 and batch.retain(few.where("false")).count() == 0


def test_rotation(spark):
    rows = spark.createDataFrame([label(0, lines=[(0, "upright only", 0.9, None, 0)]), label(1)], LABEL)
    line = "array<struct<pos:int,text:string,confidence:double,box:array<struct<x:double,y:double>>,rotation:int>>"
    reads = spark.createDataFrame([(0, 90, [(0, "noise", 0.9, None, 0)]), (0, 180, [(0, REF, 0.9, None, 0)]), (0, 270, [(0, REF, 0.9, None, 0)]), (1, 90, [(0, REF, 0.9, None, 0)])], f"label_id long, rotation int, lines {line}")
    got = {r["label_id"]: r["ocr_lines"] for r in rotation.recover(rows, reads, REF).collect()}
    assert [x["rotation"] for x in got[0]] == [0, 180] and len(got[1]) == 3
    assert np.array_equal(images.rotate(np.array([[1, 2]]), 90), np.array([[2], [1]]))


def png(gray: np.ndarray) -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + r.tobytes() for r in gray)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def bars(widths, height=24, gap=12):
    """Upright bars of given widths, as stand-ins for letters."""
    out = [np.full((height + 8, gap), 255, np.uint8)]
    for w in widths:
        bar = np.full((height + 8, w), 0, np.uint8)
        bar[:4], bar[-4:] = 255, 255
        out += [bar, np.full((height + 8, gap), 255, np.uint8)]
    return np.hstack(out)


def decided(spark, beside, *measures):
    kind = "struct<beside:boolean,m:array<struct<stroke:double,cap:double>>>"
    row = spark.createDataFrame([((beside, [m and (m.stroke, m.cap) if not isinstance(m, tuple) else m for m in measures]),)], f"x {kind}")
    got = row.select(bold.decide(F.col("x.beside"), F.col("x.m")).alias("d")).first()["d"]
    return got["verdict"], got["ratio"]


def test_stroke_measure_and_bands(spark):
    thin, thick = strokes.measure(bars([4] * 6)), strokes.measure(bars([8] * 6))
    assert thin.cap == thick.cap == 24 and thick.stroke / thin.stroke > 1.5
    assert decided(spark, True, thick, thin)[0] == "bold_ok" and decided(spark, True, thin, thick)[0] == "not_bold" and decided(spark, True, thin, thin)[0] == "review"
    assert decided(spark, True, strokes.measure(bars([8] * 6, 10)), strokes.measure(bars([4] * 6, 10)))[0] == "review"
    assert decided(spark, True, None, thin) == ("review", None) and decided(spark, True, (0.5, 30.0), (1.0, 20.0))[0] == "review"  # sizes too far apart
    for ratio, verdict in ((1.30, "bold_ok"), (1.2, "review"), (1.0, "review"), (0.90, "not_bold")):
        assert decided(spark, True, (ratio, 20.0), (1.0, 20.0))[0] == verdict
    assert strokes.measure(np.full((3, 50), 255, np.uint8)) is None
    parts, n = strokes.label(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0]], bool))
    assert n == 1


def test_other_lines_clear_only(spark):
    assert decided(spark, False, (2.0, 20.0), (1.0, 20.0), (1.0, 20.0)) == ("bold_ok", 2.0)
    assert decided(spark, False, (1.0, 20.0), (1.0, 20.0), None, (2.0, 20.0), (4.0, 20.0))[0] == "review"
    assert decided(spark, False, (2.0, 20.0), (1.0, 20.0)) == ("review", None) and decided(spark, False, (2.0, 13.0), (1.0, 20.0), (1.0, 20.0)) == ("review", None)
    assert decided(spark, False, (6.0, 20.0), (1.0, 20.0), (2.0, 20.0), (3.0, 20.0), (6.0, 20.0))[1] == 2.5  # the median of 6, 3, 2, 1


def test_layout(spark):
    at = lambda x, y, w: [(float(p), float(q)) for p, q in ((x, y), (x + w, y), (x + w, y + 32.9), (x, y + 32.9))]
    head, body = (3, "GOVERNMENT WARNING:", 0.9, at(10.7, 5, 200), 0), [(i, t, 0.9, at(0, 60 * i, 100), r) for i, t, r in ((4, "women should not drink", 0), (5, "brewed and bottled", 0), (6, "birth defects", 90), (7, "birth defects", 0))]
    beside = (3, "GOVERNMENT WARNING: (1) women should", 0.9, at(10, 5, 360), 0)
    cases = [[head, *body], [beside], [], [(0, "GOVERNMENT WARNING:", 0.9, None, 0)], [head[:4] + (90,)], [(0, "GOVERNMENT WARN ING: women should", 0.9, at(0, 0, 300), 0)], [beside[:3] + (at(10, 5, 12), 0)], [(9, "GOVERNMENT WARNING:", 0.9, at(0, 0, 50), 0), head]]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, lines " + LABEL["ocr_lines"].dataType.simpleString())
    got = [r["at"] for r in rows.select("i", bold.layout(F.col("lines")).alias("at")).orderBy("i").collect()]
    assert [tuple(r) for r in got[0]["rectangles"]] == [(10, 5, 210, 37), (0, 240, 100, 272), (0, 420, 100, 452)] and not got[0]["beside"]
    assert [tuple(r) for r in got[1]["rectangles"]] == [(10, 5, 190, 37), (190, 5, 370, 37)] and got[1]["beside"]
    assert got[2] is None and got[3] is None and got[4] is None and got[5] is None and got[6]["rectangles"] is None
    assert got[7]["rectangles"][0]["x0"] == 10  # the first in order


def test_bold_end_to_end(spark, tmp_path):
    head, body = bars([8] * 10), bars([4] * 20)
    for name, raster in (("l0.png", np.hstack([head, body])), ("l1.png", np.hstack([body[:, : head.shape[1]], head, head])), ("l2.png", np.full((40, 400), 255, np.uint8))):
        (tmp_path / name).write_bytes(png(raster))
    (tmp_path / "l3.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    (tmp_path / "l4.txt").write_bytes(b"text")
    title, width = "GOVERNMENT WARNING: ", head.shape[1]
    full = width + body.shape[1]
    words = title + "x" * int(len("GOVERNMENT WARNING") * (full - width) / width)
    box = [(0.0, 0.0), (float(full), 0.0), (float(full), 32.0), (0.0, 32.0)]
    rows = [label(i, lines=[(0, words, 0.9, box, 0)]) for i in range(4)]
    rasters = images.read_rasters(spark, str(tmp_path))
    got = {r["label_id"]: r["bold"] for r in bold.with_bold(spark.createDataFrame(rows, LABEL), rasters).collect()}
    assert got == {0: "bold_ok", 1: "not_bold", 2: "review", 3: None}
    files = {r["filename"]: r["problem"] for r in images.read_files(spark, str(tmp_path)).collect()}
    assert files["l0.png"] is None and files["l4.txt"] == "The file is not a PNG or JPEG image."
    keyed = rasters.where("image.width > 0").withColumn("pixel_key", images.pixel_key(F.col("image"))).select("pixel_key", F.col("key").alias("fields"))
    assert images.replay(rasters.where("image.width > 0"), keyed).count() == 3
    with pytest.raises(KeyError):
        images.replay(rasters.where("image.width > 0"), keyed.limit(1))


def jpeg(width, height, orientation=None, order="<"):
    """The segments of a JPEG file up to its frame header."""
    exif = b""
    if orientation:
        tiff = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HIH", 42, 8, 2) + struct.pack(f"{order}HHIHH", 0x010F, 3, 1, 7, 0) + struct.pack(f"{order}HHIHH", 0x0112, 3, 1, orientation, 0)
        exif = b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\0\x04AB" + exif + b"\xff\xdb\0\x03A\xff\xc2\0\x0b\x08" + struct.pack(">HH", height, width) + b"\x01\x01\x11\0"


def test_header_gate_reads_size_without_decoding(spark):
    huge = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 30_000, 20_000)
    files = [(huge, "The image has too many pixels.", 30_000, 1), (png(np.zeros((20, 30), np.uint8)), None, 30, 1), (b"", "The file is empty.", None, None), (jpeg(400, 300), None, 400, 1), (jpeg(30_000, 20_000), "The image has too many pixels.", 30_000, 1),
             (jpeg(400, 300, 6), None, 400, 6), (jpeg(400, 300, 8, ">"), None, 400, 8), (jpeg(400, 300, 99), None, 400, 1), (b"\xff\xd8\xff\xda\0\x04AB", "The image cannot be read.", None, None), (b"\xff\xd8\xff", "The image cannot be read.", None, None), (b"GIF89a", "The file is not a PNG or JPEG image.", None, None)]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, (c, *_) in enumerate(files)], "i int, content binary").withColumn("facts", images.image_facts(F.col("content")))
    got = rows.select("i", images.problem(F.length("content"), F.col("content"), F.col("facts")).alias("p"), "facts").orderBy("i").collect()
    assert [(r["p"], r["facts"] and r["facts"]["width"], r["facts"] and r["facts"]["orientation"]) for r in got] == [tuple(f[1:]) for f in files]


def test_only_accepted_files_are_decoded(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "sp ace%20é.png").write_bytes(png(np.arange(60, dtype=np.uint8).reshape(6, 10)))
    assert [(r["key"], r["image"]["width"]) for r in images.read_rasters(spark, str(tmp_path / "in")).collect()] == [("sp ace%20é.png", 10)]
    (tmp_path / "in" / "bomb.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 30_000, 20_000))
    (tmp_path / "in" / "bomb.jpg").write_bytes(jpeg(30_000, 20_000))
    rasters = images.read_rasters(spark, str(tmp_path / "in"))
    assert [(r["key"], r["image"]["height"]) for r in rasters.collect()] == [("sp ace%20é.png", 6)]
    assert not any("/in/" in r["image"]["origin"] for r in rasters.collect())


def test_orientation_and_turns(spark):
    grid = np.arange(6, dtype=np.uint8).reshape(2, 3)
    seen = {1: grid, 2: grid[:, ::-1], 3: grid[::-1, ::-1], 4: grid[::-1], 5: grid.T, 6: np.rot90(grid, -1), 7: grid[::-1, ::-1].T, 8: np.rot90(grid)}
    assert all(np.array_equal(images.orient(grid, k), v) for k, v in seen.items())
    rows = spark.createDataFrame([(k, ("", 2, 3, 1, 0, bytearray(grid.tobytes()))) for k in range(1, 10)], "k long, image " + images.IMAGE.simpleString())
    got = {r["k"]: np.frombuffer(r["i"]["data"], np.uint8).reshape(r["i"]["height"], r["i"]["width"]) for r in rows.select("k", images.upright(F.col("image"), F.col("k")).alias("i")).collect()}
    assert all(np.array_equal(got[k], v) for k, v in seen.items()) and np.array_equal(got[9], grid)
    for clockwise in (90, 180, 270):
        turned = images.turn(rows.where("k = 1"), F.lit(clockwise)).first()["image"]
        assert np.array_equal(np.frombuffer(turned["data"], np.uint8).reshape(turned["height"], turned["width"]), images.rotate(grid, clockwise))


def test_vision_copy(spark, tmp_path):
    wide = np.zeros((100, 4000), np.uint8)
    wide[:, 2000:] = 200
    (tmp_path / "a.png").write_bytes(png(wide))
    small = images.read_rasters(spark, str(tmp_path)).select(images.vision_copy(F.col("image")).alias("c")).first()["c"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.png").write_bytes(small)
    back = images.read_rasters(spark, str(tmp_path / "b")).first()["image"]
    x = np.frombuffer(back["data"], np.uint8).reshape(back["height"], back["width"], -1)
    assert back["width"] == images.VISION_EDGE and back["height"] == 39 and x[5, 100, 0] == 0 and x[5, -100, 0] == 200


def test_plans_stay_in_one_stage(spark):
    rows = spark.createDataFrame([label(0)], LABEL)
    plan = verify(rows, load(), unicode=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_gate_decides_like_the_score():
    import random

    rng = random.Random(8)
    for _ in range(400):
        blob = "".join(rng.choice("abcd") for _ in range(rng.randrange(40)))
        quote = "".join(rng.choice("abcdxyz"[: rng.choice((4, 7))]) for _ in range(rng.randrange(30)))
        if rng.random() < 0.5 and blob:
            at = rng.randrange(len(blob))
            quote = "".join(c for c in blob[at : at + 20] if rng.random() < 0.8)
        n, m = sorted((quote, blob), key=len)
        windows = [w for a, b in ([(n, m)] if len(n) < len(m) else [(n, m), (m, n)]) for w in [(a, b[max(0, i) : max(0, min(len(b), i + len(a)))]) for i in range(1 - len(a), len(b))]]
        plain = 0.0 if not quote or not blob else similarity.ratio(quote, blob) if len(quote) > len(blob) else max(similarity.ratio(*w) for w in windows)
        assert similarity.support(quote, blob) == pytest.approx(plain / 100)
        for floor in (0.3, 0.6, 0.9):
            assert similarity.supports(quote, blob, floor) == (plain / 100 >= floor)


def test_gate_fires_on_the_surface(spark):
    from proofmark.plans.queries import QUERIES

    from .conftest import SF

    held = QUERIES["verify_findings"](spark, SF).where("held").groupBy("rule_id").count().collect()
    assert len(held) == 4 and all(r["verdict"] == "needs_review" for r in QUERIES["verify_findings"](spark, SF).where("held").collect())


def test_word_edits_name_what_changed():
    diff = lambda a, b: [tuple(d.values()) for d in similarity.word_diff(a, b)]
    assert diff("a b c", "A B C") == [] and diff("a b c", "a c") == [("delete", "b", "")] and diff("a c", "a x y c") == [("insert", "", "x y")]
    assert diff("a b c d", "x b c y z") == [("replace", "a", "x"), ("replace", "d", "y z")] and diff("", "a") == [("insert", "", "a")] and diff("a", "") == [("delete", "a", "")]


def test_repair_and_transliteration():
    twice = "Rémy".encode().decode("latin-1").encode().decode("latin-1")
    assert text.repair("RÃ©my") == "Rémy" and text.repair(twice) == "Rémy" and text.repair("Rémy") == "Rémy" and text.repair("plain") == "plain"
    cases = {"Éß Øre": "Ess Ore", "Столичная": "Stolichnaya", "Щука": "Shchuka", "Μεταξά": "Metaxa", "サケ": "sake", "소주": "soju", "Œuf": "Oeuf", "İç": "Ic", "漢": "漢"}
    assert {k: text.transliterate(k) for k in cases} == cases and text.latin_name("ｻｹ  x-\n y") == "sake xy"


def broken(x, encoding="cp1252"):
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in x.encode())


@pytest.mark.parametrize("name", ["café", "œuvre", "“Grün”", "Вода", "日本酒", "l’Étoile", "Łódź", "αβγ", "Señor – Jo", "😀 Bräu", "KÖLN"])
def test_broken_spans_are_repaired_where_the_rest_is_right(name):
    for before, after in (("", ""), ("é ", ""), ("Straße ", " Weiß"), ("“x” ", " ß")):
        assert text.repair(before + broken(name) + after) == before + name + after
        assert text.repair(before + name + after) == before + name + after
    assert text.repair("ß " + broken(broken("café"))) == "ß café"


@pytest.mark.parametrize("name", ["MAÇÃ”", "Å–Å", "É–BAR", "Ã", "x â", "ÃO", "Â", "100 £", "Ï»", ""])
def test_right_texts_stay(name):
    assert text.repair("ß " + name) == "ß " + name


def test_other_scripts_are_romanised():
    assert [text.transliterate(x).lower() for x in ("深圳", "青岛啤酒", "سلمان دراز", "אברהם", "Вода", "한국", "ὠδή")] == ["shenzhen", "qingdaopijiu", "slman draz", "'vrhm", "voda", "hangug", "odi"]
    assert text.transliterate("鬱") == "鬱"


def test_rule_map_and_pairing_counts(spark):
    row = spark.createDataFrame([label(0)], LABEL)
    got = verify(row, load()).select(batch.rule_map(F.col("findings")).alias("m")).first()["m"]
    assert set(got) == {r.id for r in load().rules} and got["health_warning_bold"] == "not_evaluable"
    names = spark.createDataFrame([("a.png",), ("x/A.PNG",), ("b.png",)], "filename string")
    filed = spark.createDataFrame([("a.png",), ("c.png",)], "key string")
    assert tuple(batch.pairing_counts(names, filed).first()) == (2, 1)
    assert tuple(batch.pairing_gate(names, filed).first()) == (2, 1, None)
    assert batch.pairing_gate(names, filed.where("key = 'c.png'")).first()["problem"] and batch.pairing_gate(names, filed.where("false")).first()["matched"] == 0


def test_batch_gate(spark):
    good, bad = bytearray(b"\x89PNG\r\n\x1a\n"), bytearray(b"text")
    files = lambda *rows: batch.batch_gate(spark.createDataFrame(list(rows), "length long, head binary")).first()["problem"]
    assert files((9, good), (9, bad)) is None and files((9, bad), (0, bytearray())) == "no image"
    assert files(*[(5 << 20, good)] * 321) == "too large" and files(*[(9, good)] * 1001) == "too many files"


def test_one_failure_does_not_end_a_batch(spark):
    rows = spark.createDataFrame([label(0), label(1), label(2)], LABEL)
    rows = rows.withColumns({"reader_error": F.when(F.col("label_id") == 1, "The reader gave no answer."), "failed": F.col("label_id") == 2})
    filed = spark.createDataFrame([("l0.png", "l0.png", "Old Tom", "", "")], "key string, filename string, brand_name string, class_type string, fanciful_name string")
    got = {r["pos"]: (r["status"], r["verdict"], r["detail"]) for r in service.check_batch(rows, filed, load(), Settings()).collect()}
    assert got[0][:2] == ("done", "pass") and got[1] == ("error", None, "The reader gave no answer.") and got[2] == ("error", None, batch.FAILED)


def test_retry_asks_only_while_nothing_is_found(spark):
    """Reads are counted where they are made: however often the result is computed, no label is read twice at a turn."""
    counted = {turn: spark.sparkContext.accumulator(0) for turn in rotation.ROTATIONS}
    rows = spark.createDataFrame([label(i, lines=[(0, "upright only", 0.9, None, 0)]) for i in range(4)] + [label(4)], LABEL)

    def read(df):
        def run(batches):
            for pdf in batches:
                for turn in pdf["rotation"]:
                    counted[turn].add(1)
                yield pdf

        line = F.struct(F.lit(0).alias("pos"), F.when(F.col("rotation") >= F.col("label_id") * 90, F.lit(REF)).otherwise("noise").alias("text"), F.lit(0.9).alias("confidence"), F.lit(None).alias("box"), F.lit(0).alias("rotation"))
        return df.mapInPandas(run, df.schema).where("label_id > 0").select("label_id", "rotation", F.array(line).cast(LABEL["ocr_lines"].dataType).alias("lines"))

    out = rotation.retry(rows, read, REF)
    for _ in range(2):
        got = {r["label_id"]: [x["rotation"] for x in r["ocr_lines"]] for r in out.collect()}
        assert got == {0: [0], 1: [0, 90], 2: [0, 180], 3: [0, 270], 4: [0, 0, 0]}
    assert [counted[t].value for t in rotation.ROTATIONS] == [4, 3, 2]


def test_pages_escape_and_read_back(spark):
    reports = verify(spark.createDataFrame([label(0, brand="<b>&'\"", filed="x"), label(1, warning=REF.replace("birth defects", "<i> effects"))], LABEL), load())
    pages = [r[0] for r in reports.orderBy("label_id").select(page.render(F.col("verdict"), F.col("findings"), F.col("fields"), F.lit(1234.5))).collect()]
    assert "<b>&'" not in pages[0] and "&lt;b&gt;&amp;&#39;&quot;" in pages[0] and "<del>birth defects.</del> became <ins>&lt;i&gt; effects.</ins>" in pages[1]
    back = spark.createDataFrame([(p,) for p in pages], "p string").select(page.read_verdict(F.col("p")).alias("v"), page.read_seconds(F.col("p")).alias("s"), page.read_findings(F.col("p")).alias("f")).collect()
    assert [r["v"] for r in back] == [r["verdict"] for r in reports.orderBy("label_id").collect()] and back[0]["s"] == 1234.5 and [f["rule_id"] for f in back[0]["f"]] == [r.id for r in load().rules]


def test_settings_pools_and_phases(spark):
    assert Settings.of(spark) == Settings()
    spark.conf.set("spark.proofmark.daily_limit", "0.02")
    try:
        assert Settings.of(spark).daily_limit == Decimal("0.02")
        spark.conf.set("spark.proofmark.daily_limit", "-1")
        with pytest.raises(ValueError):
            Settings.of(spark)
    finally:
        spark.conf.unset("spark.proofmark.daily_limit")
    with service.pool(spark, service.BATCH):
        assert spark.sparkContext.getLocalProperty(service.POOL) == "batch"
    assert spark.sparkContext.getLocalProperty(service.POOL) is None
    phases = service.Phases()
    with phases.phase("read"):
        pass
    assert phases.line().startswith("check total=") and " read=" in phases.line()
    ids = [r[0] for r in spark.range(2).select(batch.job_id()).collect()]
    assert len(set(ids)) == 2 and all(len(i) == 32 and int(i, 16) >= 0 for i in ids)
    assert service.check_label(spark.createDataFrame([label(0)], LABEL), load()).first()["verdict"] == "pass"


def test_health_and_progress_cap(spark):
    assert applications.health(spark, "v", 4, True, True).first()["status"] == "ok"
    items = spark.range(batch.BATCH_FILES + 1).select(F.lit(0).alias("grp"), F.col("id").alias("pos"), F.lit("f").alias("filename"), F.lit("done").alias("status"), F.lit("pass").alias("verdict"), F.lit("").alias("detail"))
    pairing = spark.createDataFrame([(1, 0)], "csv_rows int, csv_unmatched int")
    with pytest.raises(Exception, match="at most 1000"):
        applications.progress_json(batch.summary(items), items, pairing).collect()


def test_ties_at_the_cut_keep_no_more(spark):
    jobs = spark.createDataFrame([(i // 10, i, True) for i in range(200)], "created_seq long, job long, finished boolean")
    assert sorted(r["job"] for r in batch.retain(jobs, key="job").collect()) == list(range(150, 200))


def test_containment_equals_a_plain_search(spark, monkeypatch):
    import random

    rng = random.Random(6)
    base = "".join(rng.choice("abc ") for _ in range(3000))
    refs = [base[i : i + n] for i, n in ((0, 1), (5, 9), (100, 16), (200, 17), (300, 400), (2900, 100))] + ["", None, "not there at all", base[300:700], "abcabcabcabcabcabcq"]
    texts = [base, base[:500], None, "", base[250:720].upper(), base[150:350]]
    squash = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    expected = sorted((i, j) for i, t in enumerate(texts) for j, r in enumerate(refs) if squash(r) and squash(r) in squash(t))
    a, b = spark.createDataFrame(list(enumerate(texts)), "k long, text string"), spark.createDataFrame(list(enumerate(refs)), "r int, text string")
    assert sorted(tuple(x) for x in corroborate.contained(a, b, "k", "r").collect()) == expected
    monkeypatch.setattr(corroborate, "BLOCK_BYTES", 300)
    assert sorted(tuple(x) for x in corroborate.contained(a, b, "k", "r").collect()) == expected
    assert corroborate.contained(a, b.where("false"), "k", "r").count() == 0 and corroborate.contained(a.where("false"), b, "k", "r").count() == 0


def test_storage_needs_a_shared_folder_off_local_masters(spark, monkeypatch):
    from proofmark import storage

    with storage.scope(spark):
        folder = storage.shared_dir(spark)
        assert storage.materialize(spark.range(3), folder, "t").count() == 3 and 0 < storage.plan_bytes(storage.materialize(spark.range(1000), folder, "u")) < 1 << 20 and storage.broadcast_bytes(spark) == 10 << 20
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        try:
            for text, size in (("10MB", 10 << 20), ("64mb", 64 << 20), ("1GB", 1 << 30), ("256k", 256 << 10), ("5kb", 5 << 10), ("2g", 2 << 30), ("77b", 77), ("77", 77), ("0", 0), ("-1", 0)):
                spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
                assert storage.broadcast_bytes(spark) == size, text
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{folder}/t").count()
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"master": "spark://x"})
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        storage.shared_dir(Cluster)


def test_a_file_is_published_once_whatever_the_store(spark, tmp_path):
    from proofmark import storage

    for path in (f"file://{tmp_path}/a/1", f"viewfs://local/b/1"):
        spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.local.link./b", f"file://{tmp_path}/b")
        (tmp_path / "b").mkdir(exist_ok=True)
        assert storage.commit_new(spark, path, b"first") and not storage.commit_new(spark, path, b"second")
        assert storage.read_file(spark, path) == b"first" and [x for x in storage.names(spark, path.rpartition("/")[0]) if not x.startswith(".")] == ["1"]
    assert storage.names(spark, f"file://{tmp_path}/nothing") == []


def test_each_rulebook_of_a_table_is_parsed_and_fails_alone(spark):
    from proofmark.rulebook import scan, texts

    good = texts()
    files = [("a", n, t) for n, t in reversed(good)] + [("b", "1.yaml", "rules: [{id: x}]"), ("c", "1.yaml", "rules: ["), ("d", "1.yaml", ""), ("e", "1.yaml", "- 1"), (None, "1.yaml", good[1][1])]
    got = {r["book"]: r for r in scan(spark.createDataFrame(files, "book string, name string, text string"), "book").collect()}
    assert got["a"]["version"] == load().version and [r["id"] for r in got["a"]["rules"]] == [r.id for r in load().rules] and got["a"]["problem"] is None
    assert all(got[k]["problem"] and not got[k]["rules"] and got[k]["version"] is None for k in "bcde") and len(got[None]["rules"]) == 2


def test_verify_computes_each_step_once(spark):
    """A step that passes a Python function is not written out again wherever it is read."""
    rows = spark.createDataFrame([label(0)], LABEL)
    spark.conf.set("spark.sql.maxPlanStringLength", 1 << 27)
    plan = verify(rows, load())._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxPlanStringLength")
    assert plan.count("regexp_replace(") < 120 and "Exchange" not in plan


def test_settled_columns_and_ascii_forms(spark):
    from proofmark.storage import settled

    got = settled(spark.range(3), id=F.col("id") + 1, b=F.when(F.col("id") > 0, F.col("id") * 2)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, None), (2, 2), (3, 4)]
    forms = [("aKb-C1", "akbc1"), ("Straße ﬃ 1", "strasseffi1"), ("plain -- Text\n2", "plaintext2"), ("İx", "ix"), ("", ""), (None, None)]
    assert column(spark, [(a,) for a, _ in forms], text.squash(F.col("c0"))) == [b for _, b in forms]
