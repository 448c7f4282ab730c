"""Registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import parse_alcohol, proof_matches
from ..functions.similarity import edit_rows, field_support, word_edits
from ..functions.text import canon_brand, canon_statutory, count_words, neutralize_csv_cell, pairing_key, squash, tokens
from ..operators import batch, bold, budget, corroborate, gate, matchers, page, rotation
from ..operators.verify import beverage_class, findings, verify
from ..rulebook import Rulebook, load, scan, texts
from ..sources import export
from ..sources.applications import from_files, last_wins, status
from ..sources.images import media_type, png_size
from ..storage import is_file, shared_dir, spread
from ..streaming.budget import run_once
from ..streaming.progress import history, land_stream
from . import surface


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reports(spark, sf_dir, *keep: str) -> DataFrame:
    return verify(surface.labels(surface.flat(spark, sf_dir), *keep), load())


def _books(spark, sf_dir) -> DataFrame:
    """A rulebook for every supplier: the rules with its name in their citations; every seventh has a strategy that there is not."""
    files = [F.struct(F.lit(n).alias("name"), F.lit(t).alias("text")) for n, t in texts()]
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.explode(F.array(*files)).alias("f"))
    text = F.replace(F.col("f.text"), F.lit("27 CFR"), F.col("s_name"))
    text = F.when(F.col("s_suppkey") % 7 == 3, F.replace(text, F.lit("brand_match,"), F.lit("guess,"))).otherwise(text)
    return scan(rows.select("s_suppkey", F.col("f.name").alias("name"), text.alias("text")), "s_suppkey")


def rules(spark, sf_dir):
    """The rules of each supplier's rulebook, in order."""
    return _books(spark, sf_dir).select("s_suppkey", "version", F.explode("rules").alias("r")).select("s_suppkey", "r.rule_pos", "r.id", "r.citation", "r.strategy", "r.field", "version")


def rulebook_version(spark, sf_dir):
    return _books(spark, sf_dir).select("s_suppkey", "version", F.col("problem").isNotNull().alias("broken"))


def health(spark, sf_dir):
    """What is loaded and reachable for each supplier."""
    books = _books(spark, sf_dir).withColumns({"reader": F.col("s_suppkey") % 2 == 0, "ocr": F.col("problem").isNull()})
    return books.select("s_suppkey", status(F.col("reader"), F.col("ocr")).alias("status"), F.col("version").alias("rulebook_version"), F.size("rules").alias("rules"), "reader", "ocr")


def applications_csv(spark, sf_dir):
    """Filings as CSV files give them: those of half of the labels are filed twice, and the last one counts."""
    rows = surface.applications(surface.flat(spark, sf_dir))
    first = rows.where(F.col("pos") % 2 == 0).select((F.col("pos") * 2).alias("pos"), F.upper("filename").alias("Filename "), F.lit('old "name", first').alias("BRAND_NAME"), F.lit("x\ny").alias("class_type"), F.lit("").alias("other"))
    last = rows.select((F.col("pos") * 2 + 1).alias("pos"), F.col("filename").alias("Filename "), F.concat(F.lit(" "), "brand_name").alias("BRAND_NAME"), "class_type", F.lit("").alias("other"))
    folder = f"{shared_dir(spark)}/filed"
    both = first.unionByName(last).repartition(F.floor(F.col("pos") / 2)).sortWithinPartitions("pos").drop("pos")
    both.write.option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return from_files(spark, folder).select("key", "filename", "brand_name", "class_type", "fanciful_name")


def _by_class() -> Rulebook:
    """The rules, each for other classes."""
    classes = (["all"], ["wine", "malt"], ["spirits"], ["malt"])
    return Rulebook(rules=[r.model_copy(update={"beverage_classes": c}) for r, c in zip(load().rules, classes)], version="by class")


def class_rules(spark, sf_dir):
    rows = surface.flat(spark, sf_dir)
    beverage = beverage_class(F.coalesce(F.nullif(F.col("class_filed"), F.lit("")), F.col("class_read")))
    applies = [F.when(r.applies(F.col("beverage")), F.lit(r.id)) for r in _by_class().rules]
    return rows.select("label_id", beverage.alias("beverage")).select("label_id", "beverage", F.array_join(F.array_compact(F.array(*applies)), ",").alias("rules"))


def abv_consistency(spark, sf_dir):
    content = parse_alcohol(F.col("alcohol_text"))
    return surface.flat(spark, sf_dir).select("label_id", content.alias("c")).select(
        "label_id", F.col("c.abv").cast("double").alias("abv"), F.col("c.proof").cast("double").alias("proof"), proof_matches(F.col("c")).alias("consistent"))


def warning_verdict(spark, sf_dir):
    got = matchers.compare_warning(F.col("warning_text"), load().warning.match.reference)
    return surface.flat(spark, sf_dir).select("label_id", got.alias("warning"))


def warning_edits(spark, sf_dir):
    """Word differences of statements worded otherwise, as op:expected:found."""
    rows = surface.flat(spark, sf_dir).select("label_id", canon_statutory(F.col("warning_text")).alias("found"))
    rows = rows.withColumn("edits", word_edits(F.lit(load().warning.match.reference), F.col("found"))).where(F.size("edits") > 0)
    return rows.select("label_id", F.array_join(F.transform("edits", lambda e: F.concat_ws(":", e["op"], e["expected"], e["found"])), ";").alias("edits"))


def warning_edit_rows(spark, sf_dir):
    """The same as rows, from a table function."""
    rows = surface.flat(spark, sf_dir).select("label_id", F.lit(load().warning.match.reference).alias("reference"), canon_statutory(F.col("warning_text")).alias("read"))
    return edit_rows(rows, "reference", "read", "label_id")


#: Names in other scripts, or half of them read in another encoding, and what they stand for.
SCRIPTS = [("caf\u00c3\u00a9 caf\u00e9 ", "cafe cafe "), ("\u767d\u9152 ", "baijiu "), ("\u0633\u0644\u0645\u0627\u0646 ", "slman "), ("\u05d0\u05d1\u05e8\u05d4\u05dd ", "vrhm "), ("\u00e2\u20ac\u0153Gr\u00fcn\u00e2\u20ac\u009d ", "grun "),
           ("\u00d0\u0092\u00d0\u00be\u00d0\u00b4\u00d0\u00b0 \u0412\u043e\u0434\u0430 ", "voda voda "), ("Tsingtao \u9752\u5c9b ", "tsingtao qingdao "), ("MA\u00c7\u00c3\u201d ", "maca ")]


def brand_scripts(spark, sf_dir):
    """Canonical names whose beginning is in another script or badly read."""
    lead = F.element_at(F.array(*[F.lit(a) for a, _ in SCRIPTS]), (F.col("p_partkey") % len(SCRIPTS) + 1).cast("int"))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", canon_brand(F.concat(lead, F.col("p_name"))).alias("name"))


def brand_match(spark, sf_dir):
    got = matchers.match_brand(surface.flat(spark, sf_dir), "brand_label", "brand_filed", "brand", "raw")
    return got.select("label_id", "brand", F.round("raw", 4).alias("score"))


def verify_findings(spark, sf_dir):
    return findings(_reports(spark, sf_dir)).select("label_id", "rule_id", "verdict", F.endswith("detail", F.lit("has to look.")).alias("held"))


def verify_report(spark, sf_dir):
    return _reports(spark, sf_dir).select("label_id", "beverage", "verdict", F.size("findings").cast("long").alias("findings"))


def _items(spark, sf_dir) -> DataFrame:
    return _items_of(surface.flat(spark, sf_dir))


def _items_of(rows: DataFrame) -> DataFrame:
    """Batch items of the surface: labels that were read, whose reading failed, that wait, and files turned down."""
    uploaded = rows.where("failure IS NULL OR failure IN ('reader', 'other')")
    failures = [F.when(F.col("failure") == "reader", "The reader gave no answer in time.").alias("reader_error"), (F.col("failure") == "other").alias("failed")]
    good, errors = batch.isolate(surface.labels(uploaded.select(*[c for c in rows.columns], *failures), "batch_no", "reader_error", "failed"))
    named = lambda status: rows.where(F.col("failure") == status).select(F.col("label_id").alias("pos"), "filename", "batch_no", F.lit("The file is empty.").alias("detail"))
    return batch.to_items(verify(good, load()), errors.withColumnRenamed("label_id", "pos"), named("rejected"), named("pending"), ("batch_no",))


def batch_summary(spark, sf_dir):
    return batch.summary(_items(spark, sf_dir), "batch_no")


def batch_items(spark, sf_dir):
    """Items in the order of their batch, with what a list shows."""
    items = batch.in_order(_items(spark, sf_dir), "batch_no")
    return items.select("batch_no", "place", "filename", batch.display_status(F.col("status"), F.col("verdict")).alias("shown"), F.when(F.col("status") == "error", F.col("detail")).alias("error"))


def export_items(spark, sf_dir):
    """All items as one export in parts, read back in its order."""
    folder = f"{shared_dir(spark)}/export"
    export.write_grid(_items(spark, sf_dir), load(), folder)
    return export.read_back(spark, folder).select("place", "filename", "status", "verdict", *[r.id for r in load().rules])


def stream_progress(spark, sf_dir):
    """The counts after the last micro-batch of a stream of labels, which starts again halfway."""
    rows, folder = table(spark, sf_dir, "part"), shared_dir(spark)
    for half in range(2):
        rows.where(F.col("p_partkey") % 2 == half).repartition(4).write.mode("append").parquet(f"{folder}/part.parquet")
        arrivals = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/part.parquet")
        land_stream(arrivals, lambda part, number: _items_of(surface.over(part)), f"{folder}/out", f"{folder}/state", "batch_no").awaitTermination()
    last = history(spark, f"{folder}/out")
    return last.join(F.broadcast(last.agg(F.max("batch").alias("batch"))), "batch").drop("batch")  # one row


def headline(spark, sf_dir):
    return batch.to_items(_reports(spark, sf_dir)).select(F.col("pos").alias("label_id"), "verdict", "detail")


def rule_grid(spark, sf_dir):
    return batch.grid(batch.to_items(_reports(spark, sf_dir)), load())


def report_pages(spark, sf_dir):
    """What an evaluation reads back from the rendered pages."""
    made = page.render(F.col("verdict"), F.col("findings"), F.col("fields"), (F.col("label_id") % 7 + 0.25).cast("double"))
    read = _reports(spark, sf_dir).select("label_id", made.alias("page"))
    pairs = page.read_findings(F.col("page"))
    return read.select("label_id", page.read_verdict(F.col("page")).alias("verdict"), page.read_seconds(F.col("page")).alias("seconds"),
                       F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["rule_id"], p["verdict"])), " ").alias("findings"))


def defect_counts(spark, sf_dir):
    reports = _reports(spark, sf_dir).select((F.col("label_id") % 14).alias("defect"), "verdict")
    return reports.groupBy("defect").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("pass", "needs_review", "fail")])


def evaluation(spark, sf_dir):
    """Labels of one known defect each against the verdict each has to get."""
    rows = surface.corpus(spark, sf_dir)
    return batch.evaluate(verify(surface.labels(rows), load()), rows)


def mutations(spark, sf_dir):
    """What the matchers say of each defect's own texts: the corpus is what its names promise."""
    rows = matchers.match_brand(surface.corpus(spark, sf_dir), "brand_label", "brand_filed", "brand", "score")
    warning = matchers.compare_warning(F.col("warning_text"), load().warning.match.reference)
    rows = rows.select("defect", "brand", warning.alias("warning"), proof_matches(parse_alcohol(F.col("alcohol_text"))).alias("proof"))
    return rows.groupBy("defect", "warning", "brand", F.coalesce("proof", F.lit(True)).alias("proof")).agg(F.count("*").alias("labels"))


def _filings(rows: DataFrame) -> DataFrame:
    return last_wins(surface.applications(rows))


def pairing(spark, sf_dir):
    rows = surface.flat(spark, sf_dir)
    paired = batch.pair(rows.select("label_id", "filename"), _filings(rows))
    return paired.select("label_id", pairing_key(F.col("filename")).alias("key"), "matched", F.col("application.brand_name").alias("brand_name"))


def csv_unmatched(spark, sf_dir):
    rows = surface.flat(spark, sf_dir)
    return batch.pairing_counts(rows, _filings(rows))


def pairing_gate(spark, sf_dir):
    rows = surface.flat(spark, sf_dir)
    filed = surface.applications(rows, "batch_no").select("batch_no", pairing_key(F.col("filename")).alias("key"))
    return batch.pairing_gate(rows, filed, "batch_no")


def page_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pairing_key(F.col("url")).alias("key"))


def exact_corroboration(spark, sf_dir):
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return corroborate.contained(documents, table(spark, sf_dir, "benchmark").select("item_id", "text"), "doc_id", "item_id")


def _conversations(spark, sf_dir) -> DataFrame:
    line = F.struct(F.col("turn").cast("int").alias("pos"), "text", ((F.col("turn") % 3 + 1) / 4).alias("confidence"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(line).alias("lines"))


def ocr_blob(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", F.sha2(gate.blob(F.col("lines")), 256).alias("blob_sha"), gate.is_alive(F.col("lines")).alias("alive"))


def field_support_scores(spark, sf_dir):
    """Support of each conversation's last line by all its lines, which hold it."""
    last = F.array_max(F.transform("lines", lambda x: F.struct(x["pos"].alias("pos"), x["text"].alias("text"))))["text"]  # by position, as in the blob
    rows = _conversations(spark, sf_dir).select("conv_id", squash(gate.blob(F.col("lines"))).alias("read"), squash(last).alias("quote"))
    return rows.select("conv_id", F.round(field_support("quote", "read"), 4).alias("support"))


def claim_support(spark, sf_dir):
    """Support of the brand as filed by a misread of the label: partial where the read is longer, whole where it is shorter."""
    rows = surface.flat(spark, sf_dir).select("label_id", squash(F.concat_ws(" ", "brand_filed", F.when(F.col("label_id") % 3 == 0, F.col("fanciful_filed")))).alias("quote"), squash(
        F.concat(F.substring("brand_filed", 3, 50), F.lit(" "), F.when(F.col("label_id") % 2 == 0, F.col("class_filed")).otherwise(""))).alias("read"))
    return rows.select("label_id", F.round(field_support("quote", "read"), 4).alias("support"))


def body_words(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", count_words(F.col("text"), bold.BODY_WORDS).cast("long").alias("body_words"), F.size(tokens(F.coalesce("text", F.lit("")))).cast("long").alias("distinct_tokens"))


def csv_neutralize(spark, sf_dir):
    lead = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "\t", "x")]), (F.col("event_id") % 6 + 1).cast("int")), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", neutralize_csv_cell(lead).alias("cell"), neutralize_csv_cell(F.col("props")).alias("props"))


def daily_budget(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return budget.admit(events, Decimal("1.25")).select("event_id", F.col("day").cast("string").alias("day"), "admitted")


def budget_stream(spark, sf_dir):
    """The same from a stream of checks with a counter a day as its state."""
    schema = table(spark, sf_dir, "events").select("event_id", "ts").schema
    checks = spark.readStream.schema(schema)
    if is_file(spark, f"{sf_dir}/events.parquet"):  # a stream reads folders
        checks = checks.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        checks = checks.parquet(f"{sf_dir}/events.parquet")
    return run_once(checks, Decimal("1.25"), shared_dir(spark))


def retention_top50(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("created_seq"), (F.col("o_orderstatus") != "P").alias("finished"))
    return batch.retain(jobs)


def rotation_pick(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    attempts = e.select(F.col("user_id").alias("label_id"), F.col("event_id").alias("attempt"), ((F.col("event_id") % 3 + 1) * 90).cast("int").alias("rotation"), (F.col("value") > 30).alias("contains_reference"))
    return rotation.pick(attempts)


def rotation_merge(spark, sf_dir):
    """Labels whose upright read lacks the statement, read again at each turn until one holds it."""
    reference = load().warning.match.reference
    rows = surface.flat(spark, sf_dir)

    def read(asked: DataFrame) -> DataFrame:
        holds = F.col("rotation") == (F.col("label_id") % 4) * 90
        line = F.struct(F.lit(0).alias("pos"), F.when(holds, F.lit(reference)).otherwise("sideways").alias("text"), F.lit(0.9).alias("confidence"), F.lit(None).alias("box"), F.lit(0).alias("rotation"))
        return asked.select("label_id", "rotation", F.array(line).cast(surface.LINES).alias("lines"))

    got = rotation.retry(surface.labels(rows), read, reference).where("ocr_lines IS NOT NULL")
    turned = F.array_max(F.transform("ocr_lines", lambda x: x["rotation"]))
    return got.select("label_id", F.size("ocr_lines").cast("long").alias("lines"), turned.alias("rotation"), F.sha2(gate.blob(F.col("ocr_lines")), 256).alias("blob_sha"))


def cross_line_median(spark, sf_dir):
    ratio = (F.col("l_quantity") / (F.col("l_linenumber") + 10))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.median(ratio).alias("m"), F.count("*").alias("lines")).where("lines >= 2").select("l_orderkey", F.round("m", 6).alias("median_ratio"), "lines")


def _order_lines(spark, sf_dir) -> DataFrame:
    """One row an order and line number, as they stand for a label's lines."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))


def _box(x0, y0, x1, y1):
    """A quadrilateral of doubles with its corners in turn."""
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def bold_layout(spark, sf_dir):
    """Where the weight of the heading is measured: line and box of each order's items stand for a label's lines."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    heading = F.element_at(F.array(*[F.lit(x) for x in ("GOVERNMENT WARNING:", "Government Warning: (1) according to", "GOVERNMENT WARN ING: women", "no heading")]), (k % 4 + 1).cast("int"))
    body = F.element_at(F.array(*[F.lit(x) for x in ("Surgeon General says", "women should not drink", "brewed and bottled", "birth defects of health")]), ((n + k) % 4 + 1).cast("int"))
    box = F.when((k + n) % 11 != 0, _box(n * 10 + 0.75, n * 20, n * 10 + F.col("l_quantity") * 4, n * 20 + 15.5))
    line = F.struct(n.alias("pos"), F.when(n == 1 + k % 2, heading).otherwise(body).alias("text"), F.lit(0.9).alias("confidence"), box.alias("box"), F.when((k + n) % 13 == 0, 90).otherwise(0).alias("rotation"))
    labels = _order_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    got = labels.select("l_orderkey", bold.layout(F.col("lines")).alias("at"))
    return got.select("l_orderkey", F.col("at.beside").alias("beside"), F.array_join(F.transform("at.rectangles", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("x0", "y0", "x1", "y1")])), " ").alias("rectangles"))


def bold_verdict(spark, sf_dir):
    """Verdicts from given measures: those of each order's items stand for a label's rectangles."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    measured = F.when((k + n) % 10 != 0, F.struct((F.col("l_quantity") / 10 + 2).alias("stroke"), (F.col("l_quantity") % 17 + 10).alias("cap")))
    labels = _order_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), measured.alias("m")))).alias("m"))
    got = labels.select("l_orderkey", bold.decide(k % 2 == 0, F.transform("m", lambda x: x["m"])).alias("b"))
    return got.select("l_orderkey", F.col("b.verdict").alias("verdict"), F.round("b.ratio", 6).alias("ratio"))


def display_status(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderkey") % 10 == 0, "error").otherwise("done")
    verdict = F.when(status == "done", F.element_at(F.array(*[F.lit(x) for x in ("pass", "needs_review", "fail")]), (F.col("o_orderkey") % 3 + 1).cast("int")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", batch.display_status(status, verdict).alias("shown"))
    return rows.withColumn("label", batch.display_text(F.col("shown")))


def _uploads(spark, sf_dir) -> DataFrame:
    heads = F.element_at(F.array(*[F.unhex(F.lit(x)) for x in ("89504E470D0A1A0A0000000D49484452000000300000001800", "FFD8FFE000104A46", "52494646FFFFFFFF57454250", "255044462D312E37", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    size = F.when(F.length("head") == 0, F.lit(0)).otherwise((F.col("p_size") * 131072).cast("long"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", heads.alias("head")).withColumn("length", size)


def upload_gates(spark, sf_dir):
    return _uploads(spark, sf_dir).select(
        "p_partkey", batch.upload_gate(F.col("length"), F.col("head")).alias("problem"), media_type(F.col("head")).alias("media"), png_size(F.col("head"))["width"].alias("width"), png_size(F.col("head"))["height"].alias("height"))


def batch_gates(spark, sf_dir):
    """Uploads in batches of all, of many and of the unusable ones."""
    number = F.when(F.col("p_partkey") % 5 >= 2, F.col("p_partkey") % 3).otherwise(F.col("p_partkey") % 10 + 3)
    return batch.batch_gate(_uploads(spark, sf_dir).withColumn("batch_no", number), "batch_no")


def rotation_option(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rotation.parse_option((F.col("l_linenumber") * 45).cast("string")).alias("rotation"))


QUERIES = {f.__name__: f for f in (
    rules, rulebook_version, health, applications_csv, class_rules, abv_consistency, warning_verdict, warning_edits, warning_edit_rows, brand_scripts, brand_match, verify_findings, verify_report, batch_summary, batch_items, export_items, stream_progress, headline, rule_grid,
    report_pages, defect_counts, evaluation, mutations, pairing, csv_unmatched, pairing_gate, page_keys, exact_corroboration, ocr_blob, field_support_scores, claim_support, body_words,
    csv_neutralize, daily_budget, budget_stream, retention_top50, rotation_pick, rotation_merge, cross_line_median, bold_layout, bold_verdict, display_status, upload_gates, batch_gates, rotation_option)}


# ---------------------------------------------------------------- the same rows in SQL

def _squash(x: str) -> str:
    return f"regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^a-z0-9]', '', 'g')"


def _key(x: str) -> str:
    return f"""replace(lower(regexp_extract(regexp_replace(replace({x}, '\\', '/'), '(/\\.?)+$', ''), '([^/]*)$', 1)), 'ß', 'ss')"""


def _latin(x: str) -> str:
    """The surface's letters beyond ASCII as what they stand for."""
    for a, b in ((surface.MOJIBAKE, "e"), (surface.ACUTE, "e"), (surface.WIDE_THE, "The"), (surface.WIDE_HEADING, "GOVERNMENT"), (surface.APOSTROPHE, "''"), (surface.NBSP, " "), (surface.ZERO_WIDTH, "")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _canon(x: str) -> str:
    s = f"regexp_replace(replace(replace(lower({_latin(x)}), '&', ' and '), '''', ''), '[^a-z0-9_]+', ' ', 'g')"
    s = f"regexp_replace(' ' || {s} || ' ', ' ((the|a|an) )+', ' ', 'g')"
    return f"trim(regexp_replace({s}, '( (inc|incorporated|llc|ltd|limited|co|corp|corporation|company|lp|llp|plc))+ *$', ''))"


def _lcs(a: str, b: str) -> str:
    return f"""list_reduce(range(1, len({a}) + 1), lambda prev, i: list_reduce(range(1, len({b}) + 1), lambda acc, j:
      list_append(acc, greatest(acc[-1], prev[j + 1], prev[j] + ({a}[i] = {b}[j])::INT)), [0]), list_transform(range(len({b}) + 1), lambda z: 0))[-1]"""


def _brand(label: str, filed: str) -> str:
    """Score and words of two names, from canonical columns."""
    ta, tb = (f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))" for x in (label, filed))
    return f"CASE WHEN {label} = {filed} AND {label} <> '' THEN 100.0 WHEN {label} = '' AND {filed} = '' THEN 100.0 ELSE 200.0 * {_lcs(label, filed)} / (len({label}) + len({filed})) END AS score, {ta} AS ta, {tb} AS tb"


def _warning(ref_body: str) -> str:
    got = rf"trim(regexp_replace(regexp_replace({_latin('warning_text')}, '-\s*\n\s*', '', 'g'), '\s+', ' ', 'g'))"
    chars = r"\s*".join("GOVERNMENTWARNING:")
    pattern = rf"(?is)^(\s*{chars})(.*)$"
    return f"""CASE WHEN warning_text IS NULL OR trim(warning_text) = '' THEN 'absent'
      WHEN regexp_extract({got}, '{pattern}', 1) = '' OR {_squash(f"regexp_extract({got}, '{pattern}', 2)")} <> '{ref_body}' THEN 'altered'
      WHEN regexp_replace(regexp_extract({got}, '{pattern}', 1), '\\s', '', 'g') <> 'GOVERNMENTWARNING:' THEN 'capitalization' ELSE 'match' END"""


#: Whether a read supports a quote, by bounds that decide every pair of the surface (null would show): what the two have in
#: common by letters is more than any subsequence; a start and an end of the quote that stand in the read are less.
_GATE = f"""
claims AS (SELECT label_id, unnest(['brand', 'alcohol', 'warning']) AS field, unnest([brand_label, alcohol_text, warning_text]) AS claim, {_squash("brand_read || alcohol_read || warning_read")} AS read FROM s WHERE ocr_state = 'read'),
quotes AS (SELECT label_id, field, {_squash("claim")} AS quote, read FROM claims WHERE claim <> ''),
asked AS (SELECT DISTINCT quote, read, len(quote) AS n, len(read) AS m FROM quotes WHERE quote = '' OR NOT contains(read, quote)),
parts AS (SELECT *, list_max(list_filter(range(0, n + 1), lambda x: contains(read, left(quote, x)))) AS p, list_max(list_filter(range(0, n + 1), lambda x: contains(read, right(quote, x)))) AS q,
  coalesce(list_sum(list_transform(list_distinct(string_split(quote, '')), lambda c: least(n - len(replace(quote, c, '')), m - len(replace(read, c, ''))))), 0) AS both_ FROM asked),
placed AS (SELECT *, instr(read, left(quote, p)) AS i, instr(read, right(quote, q)) AS j FROM parts),
bounded AS (SELECT *, CASE WHEN j < i + p THEN greatest(p, q) WHEN n > m THEN least(n, p + q) ELSE greatest(q, least(n, p + least(q, greatest(0, i + n - j)))) END AS least_ FROM placed),
decided AS (SELECT quote, read, CASE WHEN 2 * both_ < 0.6 * (n + CASE WHEN n > m THEN m ELSE both_ END) THEN true WHEN 2 * least_ >= 0.6 * (n + CASE WHEN n > m THEN m ELSE n END) THEN false END AS unsupported FROM bounded),
gate AS (SELECT label_id, field, CASE WHEN d.quote IS NULL THEN false ELSE unsupported END AS unsupported FROM quotes LEFT JOIN decided d USING (quote, read))"""


def _sql() -> dict[str, str]:
    book = load()
    reference = book.warning.match.reference
    alnum = lambda s: "".join(c for c in s.lower() if c.isascii() and c.isalnum())
    body = alnum(" ".join(reference.split()[2:]))
    base, corpus = f"WITH s AS ({surface.surface_sql('part')})", f"WITH s AS ({surface.corpus_sql('part')})"
    number = r"(\d{1,2}(?:\.\d+)?)"
    abv = rf"coalesce(nullif(regexp_extract(alcohol_text, '(?:^|[^\d.]){number}\s*%', 1), ''), nullif(regexp_extract(alcohol_text, '(?i)alc(?:ohol)?\.?\s*{number}\s*percent', 1), ''))"
    proof = r"nullif(regexp_extract(alcohol_text, '(?i)(?:^|[^\d.])(\d{1,3}(?:\.\d+)?)\s*proof', 1), '')"
    cls = "lower(coalesce(nullif(class_filed, ''), class_read, ''))"
    beverage = f"CASE WHEN regexp_matches({cls}, 'wine|port|sherry|vermouth|madeira|champagne') THEN 'wine' WHEN regexp_matches({cls}, 'beer|ale|lager|porter|stout|malt') THEN 'malt' ELSE 'spirits' END"
    brand = f"""
, canon AS (SELECT DISTINCT brand_label AS bl, x.f AS bf, {_canon('brand_label')} AS a, {_canon('x.f')} AS b FROM s, (SELECT DISTINCT unnest([brand_filed, fanciful_filed]) AS f, label_id AS l FROM s) x WHERE x.l = s.label_id),
scored AS (SELECT bl, bf, {_brand('a', 'b')}, a, b FROM canon WHERE bl <> '' AND bf <> ''),
judged AS (SELECT bl, bf, score, CASE WHEN a = b AND a <> '' THEN 'match' WHEN len(ta) > 0 AND len(tb) > 0 AND len(ta) <> len(tb) AND (list_has_all(ta, tb) OR list_has_all(tb, ta)) OR score >= 82 THEN 'review' ELSE 'mismatch' END AS v FROM scored)"""
    full = f"""{base}{brand},{_GATE},
m AS (SELECT s.*, {_warning(body)} AS w, {abv} AS abv, {proof} AS proof, {beverage} AS beverage,
      coalesce(j.v, 'review') AS bv, coalesce(k.v, 'review') AS fv,
      ocr_state = 'none' OR (ocr_state = 'read' AND contains({_squash('warning_read')}, '{alnum(reference)}')) AS confirmed
      FROM s LEFT JOIN judged j ON j.bl = brand_label AND j.bf = brand_filed LEFT JOIN judged k ON k.bl = brand_label AND k.bf = fanciful_filed),
f0 AS (
  SELECT label_id, filename, beverage, 0 AS pos, 'warning' AS field, 'health_warning_verbatim' AS rule_id,
    CASE w WHEN 'absent' THEN 'needs_review' WHEN 'match' THEN CASE WHEN confirmed THEN 'pass' ELSE 'needs_review' END ELSE 'fail' END AS verdict,
    CASE w WHEN 'absent' THEN 'The label shows no health warning that could be read.' WHEN 'altered' THEN 'The health warning is not worded as the regulation requires.'
      WHEN 'capitalization' THEN 'The heading is not in capitals: Government Warning:' ELSE CASE WHEN confirmed THEN 'The health warning is worded as required.'
      ELSE 'The quoted warning is right, but the second read of the label does not confirm it.' END END AS detail FROM m
  UNION ALL SELECT label_id, filename, beverage, 1, 'warning', 'health_warning_bold',
    CASE WHEN bold IS NULL OR ocr_state = 'none' THEN 'not_evaluable' WHEN bold = 'bold_ok' THEN 'pass' WHEN bold = 'not_bold' THEN 'fail' ELSE 'needs_review' END,
    CASE WHEN bold IS NULL OR ocr_state = 'none' THEN 'The weight of the heading was not measured.' WHEN bold = 'bold_ok' THEN 'The heading is bolder than the statement.'
      WHEN bold = 'not_bold' THEN 'The heading is no bolder than the statement.' ELSE 'The weight of the heading cannot be told from the image.' END FROM m
  UNION ALL SELECT label_id, filename, beverage, 2, 'brand', 'brand_name_matches_application',
    CASE WHEN brand_filed = '' THEN 'not_evaluable' WHEN bv = 'match' OR (fanciful_filed <> '' AND fv = 'match') THEN 'pass' WHEN bv = 'review' OR (fanciful_filed <> '' AND fv = 'review') THEN 'needs_review' ELSE 'fail' END,
    CASE WHEN brand_filed = '' THEN 'No brand name is filed to compare with.' WHEN bv = 'match' THEN 'The label shows the filed brand name: ' || brand_filed
      WHEN fanciful_filed <> '' AND fv = 'match' THEN 'The label shows the filed fanciful name: ' || fanciful_filed WHEN bv = 'review' THEN 'The name on the label may be the filed brand name: ' || brand_filed
      WHEN fanciful_filed <> '' AND fv = 'review' THEN 'The name on the label may be the filed fanciful name: ' || fanciful_filed ELSE 'The name on the label is not the filed one: ' || brand_filed END FROM m
  UNION ALL SELECT label_id, filename, beverage, 3, 'alcohol', 'alcohol_content_internally_consistent',
    CASE WHEN abv IS NULL THEN 'needs_review' WHEN abv::DECIMAL(10,4) * 2 <> proof::DECIMAL(10,4) THEN 'fail' ELSE 'pass' END,
    CASE WHEN abv IS NULL THEN 'The alcohol content could not be read.' WHEN abv::DECIMAL(10,4) * 2 <> proof::DECIMAL(10,4) THEN 'Proof and alcohol by volume disagree: ' || proof::DOUBLE || ' and ' || abv::DOUBLE
      ELSE 'The alcohol content is consistent.' END FROM m),
f1 AS (SELECT f0.*, coalesce(verdict IN ('pass', 'fail') AND CASE WHEN g.label_id IS NULL THEN false ELSE g.unsupported END, NULL) AS held FROM f0 LEFT JOIN gate g ON g.label_id = f0.label_id AND g.field = f0.field),
f AS (SELECT label_id, filename, beverage, pos, rule_id, held, CASE WHEN held THEN 'needs_review' WHEN NOT held THEN verdict END AS verdict,
  detail || CASE WHEN held THEN ' The second read of the label does not support this, so a person has to look.' ELSE '' END AS detail FROM f1),
r AS (SELECT label_id, any_value(filename) AS filename, any_value(beverage) AS beverage, count(*)::BIGINT AS findings,
  CASE WHEN bool_or(verdict = 'fail') THEN 'fail' WHEN bool_or(verdict = 'needs_review') OR NOT bool_or(verdict = 'pass') THEN 'needs_review' ELSE 'pass' END AS verdict,
  arg_min(detail, (CASE verdict WHEN 'fail' THEN 0 WHEN 'needs_review' THEN 1 WHEN 'not_evaluable' THEN 2 ELSE 3 END) * 10 + pos) AS worst,
  count_if(verdict = 'not_evaluable') AS skipped, min(CASE WHEN verdict = 'not_evaluable' THEN pos || detail END) AS skip FROM f GROUP BY label_id),
h AS (SELECT *, CASE WHEN verdict <> 'pass' THEN worst WHEN skipped = 0 THEN 'Every check passed.' WHEN skipped = 1 THEN 'Every check that ran passed. Left out: ' || substr(skip, 2) ELSE 'Every check that ran passed; left out: ' || skipped END AS detail FROM r)"""
    rows = ", ".join(f"({i}, '{r.id}', '{r.citation.removeprefix('27 CFR')}', '{r.match.strategy}', '{r.match.field}')" for i, r in enumerate(book.rules))
    files = " || ".join("replace('{}', '27 CFR', s_name)".format(t.replace("'", "''")) for _, t in texts())
    books = f"WITH b AS (SELECT s_suppkey, s_name, s_suppkey % 7 = 3 AS broken, substr(sha256({files}), 1, 12) AS version FROM supplier)"
    ids = [r.id for r in book.rules]
    apps = f"{base}, a AS (SELECT {_key('filed_filename')} AS key, arg_max(brand_filed, label_id) AS brand_name FROM s GROUP BY 1)"
    words = " + ".join(f"contains(lower(text), '{w}')::BIGINT" for w in bold.BODY_WORDS)
    cell = lambda x: f"CASE WHEN substr({x}, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13), chr(10)) THEN '''' || {x} ELSE {x} END"
    grid = ", ".join(f"coalesce(max(CASE WHEN rule_id = '{r.id}' THEN f.verdict END), '') AS {r.id}" for r in book.rules)
    items = f"{full}, i AS (SELECT s.label_id, s.batch_no, s.filename, s.failure, h.verdict, coalesce(failure, '') IN ('rejected', 'reader', 'other') AS bad FROM s LEFT JOIN h USING (label_id))"
    uploads = "SELECT p_partkey, p_partkey % 5 AS k, CASE WHEN p_partkey % 5 = 4 THEN 0 ELSE p_size::BIGINT * 131072 END AS n FROM part"
    refused = "CASE WHEN n = 0 THEN 'The file is empty.' WHEN n > 5242880 THEN 'The file is larger than 5 MB.' WHEN k > 1 THEN 'The file is not a PNG or JPEG image.' END"
    window = "substr(read, greatest(i, 0) + 1, least(len(read), i + len(quote)) - greatest(i, 0))"
    back = "substr(quote, greatest(i, 0) + 1, least(len(quote), i + len(read)) - greatest(i, 0))"
    out = {
        "rules": f"{books} SELECT s_suppkey, rule_pos, id, s_name || part AS citation, strategy, field, version FROM b JOIN (VALUES {rows}) v(rule_pos, id, part, strategy, field) ON NOT broken",
        "rulebook_version": f"{books} SELECT s_suppkey, CASE WHEN NOT broken THEN version END AS version, broken FROM b",
        "health": f"{books} SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND NOT broken THEN 'ok' ELSE 'degraded' END AS status, CASE WHEN NOT broken THEN version END AS rulebook_version, CASE WHEN broken THEN 0 ELSE {len(book.rules)} END AS rules, s_suppkey % 2 = 0 AS reader, NOT broken AS ocr FROM b",
        "applications_csv": f"{base} SELECT {_key('filed_filename')} AS key, filed_filename AS filename, brand_filed AS brand_name, class_filed AS class_type, '' AS fanciful_name FROM s",
        "class_rules": f"{base}, b AS (SELECT label_id, {beverage} AS beverage FROM s) SELECT *, '{ids[0]}' || CASE beverage WHEN 'wine' THEN ',{ids[1]}' WHEN 'malt' THEN ',{ids[1]},{ids[3]}' ELSE ',{ids[2]}' END AS rules FROM b",
        "abv_consistency": f"{base}, c AS (SELECT label_id, ({abv})::DECIMAL(10,4) AS abv, ({proof})::DECIMAL(10,4) AS proof FROM s) SELECT label_id, abv::DOUBLE AS abv, CASE WHEN abv IS NOT NULL THEN proof::DOUBLE END AS proof, abv * 2 = proof AS consistent FROM c",
        "warning_verdict": f"{base} SELECT label_id, {_warning(body)} AS warning FROM s",
        "warning_edits": f"{base} SELECT label_id, CASE label_id % 14 WHEN 3 THEN 'replace:defects.:effects.' WHEN 5 THEN 'replace:GOVERNMENT WARNING::GOVERNMENTWARNING:' WHEN 7 THEN 'replace:GOVERNMENT:GOVERMENT' ELSE 'replace:machinery,:machinery.' END AS edits FROM s WHERE label_id % 14 IN (3, 5, 7, 8)",
        "warning_edit_rows": f"""{base}, e AS (SELECT label_id, CASE label_id % 14 WHEN 3 THEN ['replace', 'defects.', 'effects.'] WHEN 5 THEN ['replace', 'GOVERNMENT WARNING:', 'GOVERNMENTWARNING:'] WHEN 7 THEN ['replace', 'GOVERNMENT', 'GOVERMENT'] ELSE ['replace', 'machinery,', 'machinery.'] END AS e
          FROM s WHERE label_id % 14 IN (3, 5, 7, 8)) SELECT label_id, 0 AS pos, e[1] AS op, e[2] AS expected, e[3] AS found FROM e""",
        "brand_scripts": f"""SELECT p_partkey, [{", ".join(f"'{b}'" for _, b in SCRIPTS)}][p_partkey % {len(SCRIPTS)} + 1] || trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', ' ', 'g')) AS name FROM part""",
        "brand_match": f"{base}{brand} SELECT label_id, coalesce(v, 'review') AS brand, round(coalesce(score, 0.0), 4) AS score FROM s LEFT JOIN judged ON bl = brand_label AND bf = brand_filed",
        "verify_findings": f"{full} SELECT label_id, rule_id, verdict, held FROM f",
        "verify_report": f"{full} SELECT label_id, beverage, verdict, findings FROM r",
        "batch_summary": f"{items} SELECT batch_no, count_if(failure IS NULL AND verdict = 'pass')::BIGINT AS pass, count_if(failure IS NULL AND verdict = 'needs_review')::BIGINT AS needs_review, count_if(failure IS NULL AND verdict = 'fail')::BIGINT AS fail, count_if(failure IS NULL AND verdict = 'not_evaluable')::BIGINT AS not_evaluable, count_if(bad)::BIGINT AS error, count(*) AS total, count_if(coalesce(failure, '') <> 'pending')::BIGINT AS done, count_if(coalesce(failure, '') = 'pending') = 0 AS finished FROM i GROUP BY batch_no",
        "batch_items": f"{items} SELECT batch_no, row_number() OVER (PARTITION BY batch_no ORDER BY coalesce(failure, '') = 'rejected', label_id)::INT AS place, filename, CASE WHEN bad THEN 'error' WHEN failure = 'pending' THEN 'pending' ELSE verdict END AS shown, CASE failure WHEN 'rejected' THEN 'The file is empty.' WHEN 'reader' THEN 'The reader gave no answer in time.' WHEN 'other' THEN 'The label could not be checked.' END AS error FROM i",
        "export_items": f"{items}, g AS (SELECT label_id, {grid} FROM f GROUP BY label_id) SELECT row_number() OVER (ORDER BY coalesce(failure, '') = 'rejected', i.label_id) AS place, filename, CASE WHEN bad THEN 'error' WHEN failure = 'pending' THEN 'pending' ELSE 'done' END AS status, {', '.join(f"CASE WHEN failure IS NULL THEN {c} ELSE '' END AS {c}" for c in ('verdict', *ids))} FROM i JOIN g USING (label_id)",
        "headline": f"{full} SELECT label_id, verdict, detail FROM h",
        "rule_grid": f"{full} SELECT any_value(h.filename) AS filename, 'done' AS status, any_value(h.verdict) AS verdict, any_value(h.detail) AS detail, {grid} FROM h JOIN f USING (label_id) GROUP BY label_id",
        "report_pages": f"{full} SELECT label_id, any_value(r.verdict) AS verdict, label_id % 7 + 0.25::DOUBLE AS seconds, string_agg(rule_id || '=' || f.verdict, ' ' ORDER BY pos) AS findings FROM r JOIN f USING (label_id) GROUP BY label_id",
        "defect_counts": f"{full} SELECT label_id % 14 AS defect, count_if(verdict = 'pass')::BIGINT AS pass, count_if(verdict = 'needs_review')::BIGINT AS needs_review, count_if(verdict = 'fail')::BIGINT AS fail FROM r GROUP BY 1",
        "evaluation": f"{corpus} SELECT defect, expected, count(*) AS labels, count(*) AS agreeing, 0::BIGINT AS false_pass, 0::BIGINT AS false_fail, 0::BIGINT AS missing FROM s GROUP BY defect, expected",
        "mutations": f"{corpus} SELECT defect, CASE defect WHEN 'warning_title_case' THEN 'capitalization' WHEN 'warning_altered_text' THEN 'altered' WHEN 'warning_missing' THEN 'absent' ELSE 'match' END AS warning, CASE defect WHEN 'brand_typo' THEN 'review' WHEN 'brand_different' THEN 'mismatch' ELSE 'match' END AS brand, defect <> 'proof_mismatch' AS proof, count(*) AS labels FROM s GROUP BY defect",
        "pairing": f"{apps} SELECT label_id, {_key('filename')} AS key, a.key IS NOT NULL AS matched, coalesce(brand_name, '') AS brand_name FROM s LEFT JOIN a ON a.key = {_key('filename')}",
        "csv_unmatched": f"{apps} SELECT (SELECT count(*) FROM a) AS csv_rows, (SELECT count(DISTINCT {_key('filename')}) FROM s WHERE {_key('filename')} NOT IN (SELECT key FROM a)) AS csv_unmatched",
        "pairing_gate": f"{base}, u AS (SELECT DISTINCT batch_no, {_key('filename')} AS key FROM s), a AS (SELECT DISTINCT batch_no, {_key('filed_filename')} AS key FROM s), j AS (SELECT u.batch_no, count(*) AS uploaded, count(a.key) AS matched FROM u LEFT JOIN a USING (batch_no, key) GROUP BY 1) SELECT *, CASE WHEN matched = 0 THEN 'The applications file matches none of the images.' END AS problem FROM j",
        "page_keys": f"SELECT page_id, {_key('url')} AS key FROM pages",
        "exact_corroboration": f"WITH d AS (SELECT doc_id, {_squash('text')} AS r FROM documents), b AS (SELECT item_id, {_squash('text')} AS t FROM benchmark) SELECT doc_id, item_id FROM d JOIN b ON t <> '' AND contains(r, t)",
        "ocr_blob": "SELECT conv_id, sha256(string_agg(coalesce(text, ''), ' ' ORDER BY turn)) AS blob_sha, sum(length(text)) >= 8 AND bool_or((turn % 3 + 1) / 4.0 >= 0.5) AS alive FROM conversations GROUP BY conv_id",
        "field_support_scores": f"WITH q AS (SELECT conv_id, {_squash('arg_max_null(text, turn)')} AS quote FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN quote = '' THEN 0.0 WHEN quote <> '' THEN 1.0 END::DOUBLE AS support FROM q",
        "claim_support": f"""{base}, p AS (SELECT label_id, {_squash("brand_filed || ' ' || CASE WHEN label_id % 3 = 0 THEN fanciful_filed ELSE '' END")} AS quote,
          {_squash("substr(brand_filed, 3, 50) || ' ' || CASE WHEN label_id % 2 = 0 THEN class_filed ELSE '' END")} AS read FROM s),
          d AS (SELECT DISTINCT quote, read FROM p WHERE quote <> '' AND read <> '' AND NOT contains(read, quote)),
          w AS (SELECT quote, read, len(quote) + len(read) AS total, quote AS a, read AS b FROM d WHERE len(quote) > len(read)
            UNION ALL SELECT quote, read, len(quote) + len({window}), quote, {window} FROM (SELECT *, unnest(range(1 - len(quote), len(read))) AS i FROM d WHERE len(quote) <= len(read))
            UNION ALL SELECT quote, read, len(read) + len({back}), {back}, read FROM (SELECT *, unnest(range(1 - len(read), len(quote))) AS i FROM d WHERE len(quote) = len(read))),
          b AS (SELECT quote, read, max(2.0 * {_lcs('a', 'b')} / total) AS best FROM w GROUP BY quote, read)
          SELECT label_id, round(CASE WHEN quote = '' OR read = '' THEN 0.0 WHEN contains(read, quote) THEN 1.0 ELSE best END, 4)::DOUBLE AS support FROM p LEFT JOIN b USING (quote, read)""",
        "body_words": f"SELECT doc_id, {words} AS body_words, len(list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda t: t <> '')))::BIGINT AS distinct_tokens FROM documents",
        "csv_neutralize": f"WITH e AS (SELECT event_id, ['=', '+', '-', '@', chr(9), 'x'][event_id % 6 + 1] || event_type AS c, props FROM events) SELECT event_id, {cell('c')} AS cell, {cell('props')} AS props FROM e",
        "daily_budget": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) <= 250 AS admitted FROM events",
        "budget_stream": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) <= 250 AS admitted FROM events",
        "retention_top50": "WITH j AS (SELECT o_orderkey AS created_seq, o_orderstatus <> 'P' AS finished FROM orders) SELECT created_seq, finished FROM (SELECT *, row_number() OVER (PARTITION BY finished ORDER BY created_seq DESC) AS n FROM j) WHERE NOT finished OR n <= 50",
        "rotation_pick": "SELECT user_id AS label_id, arg_min(((event_id % 3 + 1) * 90)::INT, event_id) AS rotation FROM events WHERE value > 30 GROUP BY 1",
        "rotation_merge": f"""{base}, t AS (SELECT label_id, CASE WHEN ocr_state = 'dead' THEN 'x' ELSE brand_read || ' ' || alcohol_read || ' ' || warning_read END AS read, CASE WHEN ocr_state = 'dead' THEN 1 ELSE 3 END AS lines FROM s WHERE ocr_state <> 'none'),
          v AS (SELECT *, NOT contains({_squash('read')}, '{alnum(reference)}') AND label_id % 4 > 0 AS turned FROM t)
          SELECT label_id, lines + turned::BIGINT AS lines, CASE WHEN turned THEN label_id % 4 * 90 ELSE 0 END::INT AS rotation, sha256(read || CASE WHEN turned THEN ' {reference}' ELSE '' END) AS blob_sha FROM v""",
        "cross_line_median": "SELECT l_orderkey, round(median(l_quantity / (l_linenumber + 10)), 6) AS median_ratio, count(*) AS lines FROM lineitem GROUP BY 1 HAVING count(*) >= 2",
        "bold_layout": f"""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
          t AS (SELECT k, n, CASE WHEN n = 1 + k % 2 THEN ['GOVERNMENT WARNING:', 'Government Warning: (1) according to', 'GOVERNMENT WARN ING: women', 'no heading'][k % 4 + 1] ELSE ['Surgeon General says', 'women should not drink', 'brewed and bottled', 'birth defects of health'][(n + k) % 4 + 1] END AS text,
            trunc(n * 10 + 0.75)::INT AS x0, (n * 20)::INT AS y0, trunc(n * 10 + q * 4)::INT AS x1, trunc(n * 20 + 15.5)::INT AS y1, (k + n) % 13 = 0 AS turned FROM l WHERE (k + n) % 11 <> 0),
          b AS (SELECT k, n, turned, x0 || ',' || y0 || ',' || x1 || ',' || y1 AS r, {words} AS words FROM t),
          h AS (SELECT * FROM t WHERE contains({_squash('text')}, 'governmentwarning')),
          g AS (SELECT *, strpos(lower(text), 'warning') + 6 AS stop, x0 + trunc((x1 - x0) * ((strpos(lower(text), 'warning') + 6)::DOUBLE / len(text)))::INT AS cut FROM h),
          o AS (SELECT *, len({_squash('substr(text, stop + 1)')}) >= 8 AS beside FROM g WHERE NOT turned AND stop > 6),
          e AS (SELECT o.k, any_value(o.beside) AS beside, any_value(CASE WHEN cut > x0 AND x1 - cut >= 10 AND y1 > y0 THEN x0 || ',' || y0 || ',' || cut || ',' || y1 || ' ' || cut || ',' || y0 || ',' || x1 || ',' || y1 END) AS two,
            any_value(x0 || ',' || y0 || ',' || x1 || ',' || y1) || coalesce(' ' || string_agg(b.r, ' ' ORDER BY b.n), '') AS all_ FROM o LEFT JOIN b ON b.k = o.k AND b.n <> o.n AND NOT b.turned AND b.words >= 2 GROUP BY o.k)
          SELECT DISTINCT l.k AS l_orderkey, beside, CASE WHEN beside THEN two WHEN NOT beside THEN all_ END AS rectangles FROM l LEFT JOIN e USING (k)""",
        "bold_verdict": """WITH l AS (SELECT l_orderkey AS k, list(CASE WHEN (l_orderkey + l_linenumber) % 10 <> 0 THEN {'s': l_quantity / 10 + 2, 'c': l_quantity % 17 + 10} END ORDER BY l_linenumber) AS m FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY 1),
          t AS (SELECT *, m[1].s AS s1, m[1].c AS c1, m[2].s AS s2, m[2].c AS c2, list_transform(list_filter(m[2:], lambda x: x.s > 0 AND x.c > 0), lambda x: (m[1].s / m[1].c) / (x.s / x.c)) AS ratios FROM l),
          u AS (SELECT *, k % 2 = 0 AND least(c1, c2) >= 14 AND s2 > 0 AND c1 IS NOT NULL AND c2 IS NOT NULL AS readable, CASE WHEN k % 2 = 1 AND c1 >= 14 AND len(ratios) >= 2 THEN list_median(ratios) END AS across FROM t)
          SELECT k AS l_orderkey, CASE WHEN readable AND s1 / s2 >= 1.30 THEN 'bold_ok' WHEN readable AND s1 / s2 <= 0.90 AND greatest(c1, c2) <= 1.40 * least(c1, c2) THEN 'not_bold' WHEN across >= 1.15 THEN 'bold_ok' ELSE 'review' END AS verdict,
            round(CASE WHEN readable THEN s1 / s2 ELSE across END, 6) AS ratio FROM u""",
        "display_status": "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderkey % 10 = 0 THEN 'error' ELSE ['pass', 'needs_review', 'fail'][o_orderkey % 3 + 1] END AS shown FROM orders) SELECT o_orderkey, shown, CASE shown WHEN 'pass' THEN 'Pass' WHEN 'needs_review' THEN 'Needs review' WHEN 'fail' THEN 'Fail' WHEN 'error' THEN 'Error' ELSE 'Pending' END AS label FROM o",
        "upload_gates": f"WITH u AS ({uploads}) SELECT p_partkey, {refused} AS problem, CASE k WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/webp' END AS media, CASE WHEN k = 0 THEN 48::BIGINT END AS width, CASE WHEN k = 0 THEN 24::BIGINT END AS height FROM u",
        "batch_gates": f"WITH u AS ({uploads}), b AS (SELECT CASE WHEN k >= 2 THEN p_partkey % 3 ELSE p_partkey % 10 + 3 END AS batch_no, count(*) AS files, sum(n)::BIGINT AS bytes, count_if({refused} IS NULL)::BIGINT AS accepted FROM u GROUP BY 1) SELECT *, CASE WHEN files > 1000 THEN 'too many files' WHEN bytes > 1677721600 THEN 'too large' WHEN accepted = 0 THEN 'no image' END AS problem FROM b",
        "rotation_option": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber * 45 IN (0, 90, 180, 270) THEN l_linenumber * 45 END AS rotation FROM lineitem",
    }
    return out | {"stream_progress": out["batch_summary"]}


ORACLES = _sql()
