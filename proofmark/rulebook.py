"""The rulebook: rules as data, validated and versioned when loaded."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import yaml
from pydantic import BaseModel, ConfigDict, Field, field_validator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import FIELDS, STRATEGIES

RULES = Path(__file__).parent / "rules"


class Match(BaseModel):
    strategy: str
    field: str | None = None
    reference: str | None = None

    @field_validator("strategy")
    @classmethod
    def known(cls, value: str) -> str:
        if value not in STRATEGIES:
            raise ValueError(f"no such strategy: {value}")
        return value

    @field_validator("field")
    @classmethod
    def existing(cls, value: str | None) -> str | None:
        if value is not None and value not in FIELDS:
            raise ValueError(f"no such field: {value}")
        return value


class Rule(BaseModel):
    model_config = ConfigDict(extra="ignore")
    id: str = Field(min_length=1)
    title: str = Field(min_length=1)
    citation: str = Field(min_length=1)
    beverage_classes: list[str]
    description: str = ""
    match: Match

    def applies(self, beverage: Column) -> Column:
        """Whether the rule covers a beverage class."""
        return F.lit(True) if "all" in self.beverage_classes else beverage.isin(*self.beverage_classes)


class Rulebook(BaseModel):
    rules: list[Rule] = Field(min_length=1)
    version: str

    @property
    def warning(self) -> Rule | None:
        """The first verbatim rule on the warning field: the statement a label has to carry."""
        return next((r for r in self.rules if r.match.strategy == "verbatim" and r.match.field == "government_warning"), None)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, r.id, r.title, r.citation, r.beverage_classes, r.match.strategy, r.match.field, r.match.reference, self.version) for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "rule_pos int, id string, title string, citation string, beverage_classes array<string>, strategy string, field string, reference string, version string")


def texts(folder: str = str(RULES)) -> list[tuple[str, str]]:
    """(name, text) of the rule files, in the order of their names."""
    files = sorted(p for p in Path(folder).iterdir() if p.suffix in (".yaml", ".yml"))
    return [(p.name, p.read_text(encoding="utf-8")) for p in files]


def parse(files: list[str]) -> Rulebook:
    """A rulebook of the texts of its files, in order; an unknown strategy, a missing title or citation, or no rule is an error."""
    rules = [r for t in files for r in (yaml.safe_load(t) or {}).get("rules", [])]
    return Rulebook(rules=rules, version=hashlib.sha256("".join(files).encode()).hexdigest()[:12])


@lru_cache(maxsize=4)
def load(folder: str = str(RULES)) -> Rulebook:
    """Rules in file-name order."""
    return parse([t for _, t in texts(folder)])


_SCANNED = T.StructType([
    T.StructField("version", T.StringType()), T.StructField("problem", T.StringType()),
    T.StructField("rules", T.ArrayType(T.StructType([T.StructField("rule_pos", T.IntegerType()), *[T.StructField(f, T.StringType()) for f in ("id", "title", "citation", "strategy", "field")]])))])


@F.arrow_udf(_SCANNED)
def _parsed(files: pa.Array) -> pa.Array:
    out = []
    for texts_ in files.to_pylist():
        try:
            book = parse(texts_)
            out.append({"version": book.version, "problem": None, "rules": [{"rule_pos": i, "id": r.id, "title": r.title, "citation": r.citation, "strategy": r.match.strategy, "field": r.match.field} for i, r in enumerate(book.rules)]})
        except (ValueError, AttributeError, TypeError, yaml.YAMLError) as e:  # this book is of no use; the others are
            out.append({"version": None, "problem": type(e).__name__, "rules": []})
    rule = pa.struct([("rule_pos", pa.int32()), *[(f, pa.string()) for f in ("id", "title", "citation", "strategy", "field")]])
    return pa.array(out, pa.struct([("version", pa.string()), ("problem", pa.string()), ("rules", pa.list_(rule))]))


def scan(files: DataFrame, *by: str) -> DataFrame:
    """(*by, version, problem, rules) of many rulebooks, from (*by, name, text): each is parsed, validated and versioned by its own files, and fails alone."""
    books = files.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("name", "text"))).alias("__files"))
    return books.select(*by, _parsed(F.transform("__files", lambda f: f["text"])).alias("__book")).select(*by, "__book.version", "__book.problem", "__book.rules")
