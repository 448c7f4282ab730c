"""The four matching strategies, each a struct(verdict, detail, diff) over the columns of a label.

``STRATEGIES`` maps a strategy's name to its matcher; the rulebook picks by name, so rules stay data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import parse_alcohol, proof_matches
from ..functions.similarity import indel_ratio, word_edits
from ..functions.text import canon_brand, canon_statutory, heading_pattern, squash, tokens
from ..model import DIFF
from ..rulebook import Rule
from ..storage import settled
from .gate import blob

#: Fixed value: from this similarity up, names that differ are for a person to judge.
BRAND_REVIEW_FLOOR = 82.0


def outcome(verdict: Column | str, detail: Column | str, diff: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(verdict).alias("verdict"), lit(detail).alias("detail"), (diff if diff is not None else F.array().cast(DIFF)).alias("diff"))


def warning_parts(got: Column, reference: str) -> tuple[Column, Column]:
    """The heading as printed and the rest of a canonical text; the heading is empty if the text does not open with it."""
    pattern = heading_pattern(" ".join(reference.split()[:2]))
    return F.regexp_extract(got, pattern, 1), F.regexp_extract(got, pattern, 2)


def warning_verdict(found: Column, printed: Column, rest: Column, reference: str) -> Column:
    """absent, altered, capitalization or match; altered wording outranks the heading's case."""
    words = reference.split()
    return (F.when(found.isNull() | (F.length(F.regexp_replace(found, r"(?U)\s", "")) == 0), "absent")
            .when((printed == "") | (squash(rest) != squash(F.lit(" ".join(words[2:])))), "altered")
            .when(F.regexp_replace(printed, r"(?U)\s", "") != "".join(words[:2]), "capitalization")
            .otherwise("match"))


def compare_warning(found: Column, reference: str, unicode: bool = True) -> Column:
    """The verdict on a printed statement against the reference."""
    return warning_verdict(found, *warning_parts(canon_statutory(found, unicode), reference), reference)


def brand_score(label: Column, filed: Column, a: Column, b: Column) -> Column:
    """0..100 from names and their canonical forms; only names that differ reach the similarity function."""
    missing = (F.coalesce(label, F.lit("")) == "") | (F.coalesce(filed, F.lit("")) == "")
    equal = (a == b) & (a != "")
    return F.when(missing, 0.0).when(equal, 100.0).otherwise(indel_ratio(F.when(~missing & ~equal, a), b))


def brand_verdict(label: Column, filed: Column, a: Column, b: Column, score: Column) -> Column:
    """match, review or mismatch: equality, then containment of the words, then similarity."""
    missing = (F.coalesce(label, F.lit("")) == "") | (F.coalesce(filed, F.lit("")) == "")
    ta, tb = tokens(a), tokens(b)
    inside = (F.size(ta) > 0) & (F.size(tb) > 0) & (F.size(ta) != F.size(tb)) & (
        (F.size(F.array_except(ta, tb)) == 0) | (F.size(F.array_except(tb, ta)) == 0))
    return F.when(missing, "review").when((a == b) & (a != ""), "match").when((score >= BRAND_REVIEW_FLOOR) | inside, "review").otherwise("mismatch")


def match_brand(rows: DataFrame, label: str, filed: str, verdict: str, score: str, unicode: bool = True) -> DataFrame:
    """``rows`` with the verdict and score of two name columns."""
    rows = settled(rows, __a=canon_brand(F.col(label), unicode), __b=canon_brand(F.col(filed), unicode))
    rows = settled(rows, **{score: brand_score(F.col(label), F.col(filed), F.col("__a"), F.col("__b"))})
    return rows.withColumn(verdict, brand_verdict(F.col(label), F.col(filed), F.col("__a"), F.col("__b"), F.col(score))).drop("__a", "__b")


def verbatim(rule: Rule, unicode: bool) -> Column:
    """Wording of the statement; a match must also be in the independent read, if there is one."""
    reference = rule.match.reference or ""
    printed, heading_text = F.col("__warning"), F.trim(F.col("__printed"))
    confirmed = F.col("ocr_lines").isNull() | F.coalesce(F.contains("__blob", squash(F.lit(reference))), F.lit(False))
    edits = word_edits(F.when(printed == "altered", F.lit(reference)), F.col("__canon"))
    heading = F.array(F.struct(F.lit("replace").alias("op"), F.lit(" ".join(reference.split()[:2])).alias("expected"), heading_text.alias("found"))).cast(DIFF)
    return (F.when(printed == "absent", outcome("needs_review", "The label shows no health warning that could be read."))
            .when(printed == "altered", outcome("fail", "The health warning is not worded as the regulation requires.", F.coalesce(edits, F.array().cast(DIFF))))
            .when(printed == "capitalization", outcome("fail", F.concat(F.lit("The heading is not in capitals: "), heading_text), heading))
            .when(~confirmed, outcome("needs_review", "The quoted warning is right, but the second read of the label does not confirm it."))
            .otherwise(outcome("pass", "The health warning is worded as required.")))


def brand_match(rule: Rule, unicode: bool) -> Column:
    """The label's name against the filed brand and, if there is one, the filed fanciful name: the better one counts."""
    filed, fanciful = F.col("application.brand_name"), F.col("application.fanciful_name")
    brand, other = F.col("__brand"), F.col("__fanciful")
    has_other = F.coalesce(fanciful, F.lit("")) != ""
    return (F.when(F.coalesce(filed, F.lit("")) == "", outcome("not_evaluable", "No brand name is filed to compare with."))
            .when(brand == "match", outcome("pass", F.concat(F.lit("The label shows the filed brand name: "), filed)))
            .when(has_other & (other == "match"), outcome("pass", F.concat(F.lit("The label shows the filed fanciful name: "), fanciful)))
            .when(brand == "review", outcome("needs_review", F.concat(F.lit("The name on the label may be the filed brand name: "), filed)))
            .when(has_other & (other == "review"), outcome("needs_review", F.concat(F.lit("The name on the label may be the filed fanciful name: "), fanciful)))
            .otherwise(outcome("fail", F.concat(F.lit("The name on the label is not the filed one: "), filed))))


def abv_consistency(rule: Rule, unicode: bool) -> Column:
    """A stated proof has to be twice the alcohol by volume."""
    content = {"abv": F.col("__abv"), "proof": F.col("__proof")}
    return (F.when(content["abv"].isNull(), outcome("needs_review", "The alcohol content could not be read."))
            .when(proof_matches(content) == F.lit(False), outcome("fail", F.concat(F.lit("Proof and alcohol by volume disagree: "), content["proof"].cast("double").cast("string"), F.lit(" and "), content["abv"].cast("double").cast("string"))))
            .otherwise(outcome("pass", "The alcohol content is consistent.")))


def warning_bold(rule: Rule, unicode: bool) -> Column:
    """What the stroke measurement said (column ``bold``: bold_ok, not_bold or review; null if not measured)."""
    bold = F.col("bold")
    return (F.when(bold.isNull() | F.col("ocr_lines").isNull() | (F.size("ocr_lines") == 0), outcome("not_evaluable", "The weight of the heading was not measured."))
            .when(bold == "bold_ok", outcome("pass", "The heading is bolder than the statement."))
            .when(bold == "not_bold", outcome("fail", "The heading is no bolder than the statement."))
            .otherwise(outcome("needs_review", "The weight of the heading cannot be told from the image.")))


STRATEGIES: dict[str, Callable[[Rule, bool], Column]] = {
    "verbatim": verbatim, "warning_bold": warning_bold, "brand_match": brand_match, "abv_consistency": abv_consistency}


def asserted(field: str) -> Column:
    """What a field claims: its quote, or without one its value."""
    f = F.col("fields")[field]
    return F.coalesce(F.nullif(f["verbatim"], F.lit("")), f["value"])


def prepare(labels: DataFrame, reference: str, brand_field: str, unicode: bool) -> DataFrame:
    """Intermediate columns, in steps: what passes a Python function is settled, and functions of one step run side by side."""
    warning = F.col("fields.government_warning.verbatim")
    label, filed, other = F.col("fields")[brand_field]["value"], F.col("application.brand_name"), F.nullif(F.col("application.fanciful_name"), F.lit(""))
    out = settled(labels, __text=blob(F.col("ocr_lines")), __canon=canon_statutory(warning, unicode), __label=label, __filed=filed, __other=other, __stated=asserted("alcohol_content"),
                  __a=canon_brand(label, unicode), __b=canon_brand(filed, unicode), __c=canon_brand(other, unicode))
    printed, rest = warning_parts(F.col("__canon"), reference)
    out = out.withColumns({"__blob": squash(F.col("__text")), "__printed": printed, "__rest": rest, "__alcohol": parse_alcohol(F.col("__stated"))})
    names = {"__brand": (F.col("__filed"), F.col("__b")), "__fanciful": (F.col("__other"), F.col("__c"))}
    scores = {f"{k}_score": brand_score(F.col("__label"), name, F.col("__a"), form) for k, (name, form) in names.items()}
    told = warning_verdict(warning, F.col("__printed"), F.col("__rest"), reference)
    out = settled(out, **scores, __warning=told, __abv=F.col("__alcohol.abv"), __proof=F.col("__alcohol.proof"))
    verdicts = {k: brand_verdict(F.col("__label"), name, F.col("__a"), form, F.col(f"{k}_score")) for k, (name, form) in names.items()}
    return out.withColumns(verdicts).drop("__a", "__b", "__c")
