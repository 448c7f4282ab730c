"""The label surface: labels, filings and second reads derived from ``part``, with known defects by key.

The SQL runs unchanged on Spark and DuckDB, so a query and its check start from the same rows.  ``surface_sql`` mixes
defects freely, with names and statements in other than ASCII letters and second reads that miss a claim;
``corpus_sql`` puts one known defect, and the verdict it has to get, on each label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import APPLICATION, FIELD, OCR_LINE
from ..rulebook import load
from ..storage import spread

NBSP, ZERO_WIDTH = "\u00a0", "\u200b"
WIDE_HEADING, WIDE_THE = "\uff27\uff2f\uff36\uff25\uff32\uff2e\uff2d\uff25\uff2e\uff34", "\uff34\uff48\uff45"
ACUTE, MOJIBAKE, APOSTROPHE = "\u00e9", "\u00c3\u00a9", "\u2019"
#: Batches of the surface.
BATCHES = 40
LINES = T.ArrayType(OCR_LINE)


def surface_sql(part: str) -> str:
    """Flat rows of the surface; ``part`` names the table."""
    reference = load().warning.match.reference
    return f"""
SELECT label_id, batch_no, filename, filed_filename, brand_label, brand_filed, fanciful_filed, class_filed, class_read, alcohol_text, warning_text, bold, ocr_state, failure,
       CASE WHEN gap = 11 THEN '1111' ELSE coalesce(brand_label, '') END AS brand_read,
       CASE WHEN gap = 11 THEN '22222222' ELSE concat_ws(' ', alcohol_text, class_read) END AS alcohol_read,
       CASE WHEN gap = 11 THEN '333' WHEN gap = 13 THEN substr(coalesce(warning_text, ''), 1, 210) WHEN gap = 14 THEN substr(coalesce(warning_text, ''), 1, 50)
            WHEN label_id % 17 = 5 THEN replace(coalesce(warning_text, ''), 'pregnancy', 'pregnant') ELSE coalesce(warning_text, '') END AS warning_read
FROM (
SELECT p_partkey AS label_id, p_partkey % {BATCHES} AS batch_no, p_partkey % 19 AS gap,
       'labels/L' || CAST(p_partkey AS VARCHAR(20)) || CASE WHEN p_partkey % 2 = 0 THEN '.PNG' ELSE '.png' END AS filename,
       CASE WHEN p_partkey % 29 = 3 THEN 'other/' ELSE '' END || CASE WHEN p_partkey % 23 = 6 OR p_partkey % {BATCHES} = 7 THEN 'x' ELSE 'l' END || CAST(p_partkey AS VARCHAR(20)) || '.png' AS filed_filename,
       CASE p_partkey % 12 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ', Inc.' WHEN 2 THEN p_name || ' reserve' WHEN 3 THEN 'The ' || p_name
            WHEN 4 THEN substr(p_name, 1, 2) || substr(p_name, 4) WHEN 5 THEN p_brand WHEN 6 THEN NULL WHEN 8 THEN replace(p_name, 'e', '{ACUTE}')
            WHEN 9 THEN p_name || '{APOSTROPHE}s' WHEN 10 THEN '{WIDE_THE} ' || replace(p_name, ' ', '{NBSP}{ZERO_WIDTH}') WHEN 11 THEN replace(p_name, 'e', '{MOJIBAKE}') ELSE p_name END AS brand_label,
       CASE WHEN p_partkey % 13 = 12 THEN '' ELSE p_name END AS brand_filed,
       CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE '' END AS fanciful_filed,
       CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_type = 'ECONOMY' THEN 'Table Wine' WHEN p_type = 'SMALL' THEN 'Robust Porter' WHEN p_type = 'MEDIUM' THEN 'Pale Ale'
            WHEN p_type = 'PROMO' THEN 'Single Malt Whisky' WHEN p_type = 'STANDARD' THEN 'Vodka' ELSE 'Gin' END AS class_filed,
       CASE WHEN p_partkey % 7 = 2 THEN 'Sherry' WHEN p_partkey % 7 = 4 THEN NULL ELSE 'Straight Rye' END AS class_read,
       CASE p_partkey % 7 WHEN 3 THEN CAST(5 + p_size % 40 AS VARCHAR(20)) || '% Alc./Vol. (' || CAST(2 * (5 + p_size % 40) + 10 AS VARCHAR(20)) || ' Proof)'
            WHEN 4 THEN CAST(5 + p_size % 40 AS VARCHAR(20)) || '.5 % ALC BY VOL' WHEN 5 THEN 'No statement' WHEN 6 THEN 'ALCOHOL ' || CAST(5 + p_size % 40 AS VARCHAR(20)) || ' PERCENT BY VOLUME'
            WHEN 2 THEN 'TEQUILA 100% AGAVE ' || CAST(5 + p_size % 40 AS VARCHAR(20)) || '.5% ALC./VOL. (' || CAST(2 * (5 + p_size % 40) + 1 AS VARCHAR(20)) || ' PROOF)'
            ELSE CAST(5 + p_size % 40 AS VARCHAR(20)) || '% Alc./Vol. (' || CAST(2 * (5 + p_size % 40) AS VARCHAR(20)) || ' Proof)' END AS alcohol_text,
       CASE p_partkey % 14 WHEN 1 THEN replace(ref, 'GOVERNMENT WARNING', 'Government Warning') WHEN 2 THEN upper(ref) WHEN 3 THEN replace(ref, 'birth defects', 'birth effects')
            WHEN 4 THEN NULL WHEN 5 THEN replace(ref, 'GOVERNMENT WARNING:', 'GOVERNMENTWARNING:') WHEN 6 THEN replace(ref, ' ', '  ')
            WHEN 7 THEN replace(ref, 'GOVERNMENT', 'GOVERMENT') WHEN 8 THEN replace(ref, 'machinery, and', 'machinery. and') WHEN 11 THEN replace(ref, ' ', '{NBSP}')
            WHEN 12 THEN replace(ref, 'machinery', 'machin{ZERO_WIDTH}ery') WHEN 13 THEN replace(ref, 'GOVERNMENT', '{WIDE_HEADING}') ELSE ref END AS warning_text,
       CASE p_partkey % 4 WHEN 0 THEN 'bold_ok' WHEN 1 THEN 'not_bold' WHEN 2 THEN 'review' ELSE NULL END AS bold,
       CASE p_partkey % 9 WHEN 8 THEN 'none' WHEN 7 THEN 'dead' ELSE 'read' END AS ocr_state,
       CASE p_partkey % 31 WHEN 7 THEN 'rejected' WHEN 8 THEN 'reader' WHEN 9 THEN 'other' WHEN 10 THEN 'pending' END AS failure
FROM (SELECT *, '{reference}' AS ref FROM {part}) p) s
"""


#: Defect -> verdict it has to get: the corpus by ``p_partkey % 9``.
DEFECTS = {"compliant": "pass", "warning_body_caps": "pass", "warning_title_case": "fail", "warning_not_bold": "fail", "warning_altered_text": "fail",
           "warning_missing": "needs_review", "proof_mismatch": "fail", "brand_typo": "needs_review", "brand_different": "fail"}


def corpus_sql(part: str) -> str:
    """Labels with one known defect each and read without error: (defect, expected) and the columns of the surface."""
    reference = load().warning.match.reference
    head, _, body = reference.partition(": ")
    names = " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DEFECTS))
    verdicts = " ".join(f"WHEN '{d}' THEN '{v}'" for d, v in DEFECTS.items())
    return f"""
SELECT *, CASE defect {verdicts} END AS expected, coalesce(brand_label, '') AS brand_read, alcohol_text || ' ' || class_read AS alcohol_read, coalesce(warning_text, '') AS warning_read
FROM (SELECT p_partkey AS label_id, p_partkey % {BATCHES} AS batch_no, defect, 'labels/L' || CAST(p_partkey AS VARCHAR(20)) || '.png' AS filename, 'l' || CAST(p_partkey AS VARCHAR(20)) || '.png' AS filed_filename,
       CASE defect WHEN 'brand_typo' THEN substr(p_name, 1, 1 + p_partkey % 3) || substr(p_name, 3 + p_partkey % 3) WHEN 'brand_different' THEN p_brand ELSE upper(p_name) END AS brand_label,
       p_name AS brand_filed, '' AS fanciful_filed, CASE WHEN p_size % 2 = 0 THEN 'Straight Rye Whisky' ELSE 'Table Wine' END AS class_filed,
       CASE WHEN p_size % 2 = 0 THEN 'Straight Rye Whisky' ELSE 'Table Wine' END AS class_read,
       CASE WHEN defect = 'proof_mismatch' THEN CAST(abv AS VARCHAR(20)) || '% Alc./Vol. (' || CAST(2 * abv + 2 + 2 * (p_partkey % 5) AS VARCHAR(20)) || ' Proof)'
            WHEN p_partkey % 3 = 0 THEN CAST(abv AS VARCHAR(20)) || '% Alc./Vol. (' || CAST(2 * abv AS VARCHAR(20)) || ' Proof)'
            WHEN p_partkey % 3 = 1 THEN CAST(abv AS VARCHAR(20)) || '% ALC BY VOL' ELSE 'ALCOHOL ' || CAST(abv AS VARCHAR(20)) || '% BY VOLUME' END AS alcohol_text,
       CASE defect WHEN 'warning_missing' THEN NULL WHEN 'warning_body_caps' THEN '{head}: ' || upper('{body}') WHEN 'warning_title_case' THEN 'Government Warning: {body}'
            WHEN 'warning_altered_text' THEN replace('{reference}', CASE p_partkey % 4 WHEN 0 THEN 'birth defects' WHEN 1 THEN 'should not' WHEN 2 THEN 'Surgeon General' ELSE 'may cause' END, 'some')
            ELSE '{reference}' END AS warning_text,
       CASE WHEN defect = 'warning_not_bold' THEN 'not_bold' ELSE 'bold_ok' END AS bold, 'read' AS ocr_state, CAST(NULL AS VARCHAR(20)) AS failure
FROM (SELECT *, 5 + p_size % 40 AS abv, CASE p_partkey % {len(DEFECTS)} {names} END AS defect FROM {part}) p) s
"""


def _rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return spark.sql(sql, part=spread(part))


def over(part: DataFrame) -> DataFrame:
    """The surface of some rows of ``part``; those of fewer files than cores, as in a micro-batch, are dealt out."""
    return part.sparkSession.sql(surface_sql("{part}"), part=spread(part))


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, surface_sql("{part}"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, corpus_sql("{part}"))


def labels(rows: DataFrame, *keep: str) -> DataFrame:
    """``model.LABEL`` rows of the flat surface, each with its own filing, and some columns of the surface."""
    read = lambda c: F.struct(F.col(c).alias("verbatim"), F.col(c).isNotNull().alias("found"), F.col(c).alias("value")).cast(FIELD)
    line = lambda pos, c, conf: F.struct(F.lit(pos).alias("pos"), c.alias("text"), F.lit(conf).alias("confidence"), F.lit(None).alias("box"), F.lit(0).alias("rotation")).cast(OCR_LINE)
    lines = (F.when(F.col("ocr_state") == "none", None).when(F.col("ocr_state") == "dead", F.array(line(0, F.lit("x"), 0.2)))
             .otherwise(F.array(line(2, F.col("warning_read"), 0.9), line(0, F.col("brand_read"), 0.8), line(1, F.col("alcohol_read"), 0.7))))
    fields = F.struct(read("brand_label").alias("brand_name"), read("class_read").alias("class_type"), read("alcohol_text").alias("alcohol_content"),
                      F.lit(None).cast(FIELD).alias("net_contents"), read("warning_text").alias("government_warning"))
    filing = F.struct(F.col("brand_filed").alias("brand_name"), F.col("class_filed").alias("class_type"), F.col("fanciful_filed").alias("fanciful_name")).cast(APPLICATION)
    return rows.select("label_id", "filename", fields.alias("fields"), filing.alias("application"), lines.alias("ocr_lines"), "bold", *keep)


def applications(rows: DataFrame, *keep: str) -> DataFrame:
    """The filings as an applications file would give them."""
    return rows.select(F.col("label_id").alias("pos"), F.col("filed_filename").alias("filename"), F.col("brand_filed").alias("brand_name"), F.col("class_filed").alias("class_type"), F.col("fanciful_filed").alias("fanciful_name"), *keep)
