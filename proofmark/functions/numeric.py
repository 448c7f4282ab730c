"""Alcohol content: exact decimals, parsed by JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "decimal(20,10)"
# How labels state alcohol by volume and proof; the digits behind a dot or digit are no number of their own.
PERCENT = r"(?U)(?<![\d.])(\d{1,2}(?:\.\d+)?)\s*%"
PERCENT_WORD = r"(?iU)alc(?:ohol)?\.?\s*(\d{1,2}(?:\.\d+)?)\s*percent"
PROOF = r"(?iU)(?<![\d.])(\d{1,3}(?:\.\d+)?)\s*proof"


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def parse_alcohol(text: Column) -> Column:
    """struct(abv, proof); null if the text states no alcohol by volume.  The first percentage counts."""
    abv = F.coalesce(_first(text, PERCENT), _first(text, PERCENT_WORD)).try_cast(NUMBER)
    proof = _first(text, PROOF).try_cast(NUMBER)
    return F.when(abv.between(0, 100), F.struct(abv.alias("abv"), proof.alias("proof")))


def proof_matches(content: Column) -> Column:
    """Whether the proof is twice the alcohol by volume; null without a proof."""
    return content["abv"] * 2 == content["proof"]
