"""Every query of the engine against the same rows in SQL."""

import re
from collections import defaultdict

import pytest

from proofmark.functions.similarity import partial_ratio
from proofmark.plans import lifecycle, queries, rasters

from .conftest import SF

QUERIES, ORACLES = queries.QUERIES | lifecycle.QUERIES | rasters.QUERIES, queries.ORACLES | lifecycle.ORACLES | rasters.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_sql(spark, duck, same_rows, name):
    same_rows(QUERIES[name](spark, SF), duck.sql(ORACLES[name]))


def test_field_support_compares_whole_texts(spark):
    squashed = lambda t: re.sub("[^a-z0-9]", "", (t or "").lower().replace("ß", "ss"))
    lines = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        lines[r["conv_id"]].append((r["turn"], r["text"]))
    expected = {}
    for conv, rows in lines.items():
        rows.sort()
        read, quote = squashed(" ".join(t or "" for _, t in rows)), squashed(rows[-1][1])
        expected[conv] = None if rows[-1][1] is None else round(partial_ratio(quote, read) / 100, 4) if quote else 0.0
    assert any(len(squashed(" ".join(t or "" for _, t in rows))) > 400 for rows in lines.values())
    assert {r["conv_id"]: r["support"] for r in QUERIES["field_support_scores"](spark, SF).collect()} == expected


def test_entry_has_rows_and_a_stable_schema(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert df.columns == ["label_id", "beverage", "verdict", "findings"]
    assert set(e.oracle_sql()) <= set(e.queries())
