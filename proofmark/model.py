"""Types and vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

#: Worst first, for headlines.
SEVERITY = {"fail": 0, "needs_review": 1, "not_evaluable": 2, "pass": 3}
FIELDS = ("brand_name", "class_type", "alcohol_content", "net_contents", "government_warning")
STRATEGIES = ("verbatim", "warning_bold", "brand_match", "abv_consistency")

FIELD = T.StructType([T.StructField("verbatim", T.StringType()), T.StructField("found", T.BooleanType()), T.StructField("value", T.StringType())])
EXTRACTION = T.StructType([T.StructField(f, FIELD) for f in FIELDS])
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
OCR_LINE = T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("box", T.ArrayType(POINT)), T.StructField("rotation", T.IntegerType())])
APPLICATION = T.StructType([T.StructField(f, T.StringType()) for f in ("brand_name", "class_type", "fanciful_name")])
DIFF = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("op", "expected", "found")]))
FINDING = T.StructType([
    T.StructField("rule_pos", T.IntegerType()), *[T.StructField(f, T.StringType()) for f in ("rule_id", "title", "citation", "verdict", "detail")],
    T.StructField("diff", DIFF)])
LABEL = T.StructType([
    T.StructField("label_id", T.LongType()), T.StructField("filename", T.StringType()), T.StructField("fields", EXTRACTION),
    T.StructField("application", APPLICATION), T.StructField("ocr_lines", T.ArrayType(OCR_LINE)), T.StructField("bold", T.StringType())])
