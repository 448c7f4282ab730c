"""The pipeline's rows against a plain version of its stages."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ..conftest import SF
from . import brute
from .test_operators import CLASHES, passed_through, words


def plain(rows, items):
    """doc_id -> (text, size, target, taken) of (doc_id, text, lang, source) rows, all ids different."""
    languages = brute.Languages([(r["text"], r["lang"]) for r in rows])
    fits = {r["doc_id"]: languages.predict(r["text"])[2] for r in rows}
    rows = sorted((r for r in rows if fits[r["doc_id"]] is not None and fits[r["doc_id"]] >= -1), key=lambda r: r["doc_id"])
    rows = [r for i, (r, (_, c)) in enumerate(zip(rows, brute.components([r["text"] for r in rows]))) if c == i]
    rows = [r for r in rows if not any(brute.benchmark_scores(r["text"], t) for t in items if t)]
    random_ = brute.random_tokens([r["text"] for r in rows])
    texts = {r["doc_id"]: brute.redacted(r["text"], brute.base_spans(r["text"]) + x) for r, x in zip(rows, random_)}
    mixed = brute.mixed([(r["doc_id"], r["source"], texts[r["doc_id"]]) for r in rows])
    return {i: (texts[i], *m) for i, m in mixed.items() if m[2] > 0}


def check(got, expected):
    assert set(got) == set(expected)
    for i, (text, size, target, taken) in expected.items():
        assert (got[i]["text"], got[i]["size"], got[i]["taken"]) == (text, size, taken) and got[i]["target"] == pytest.approx(target)
        assert got[i]["repeats"] * got[i]["size"] == taken and got[i]["n_chars"] == len(text)


def test_rows_equal_the_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language id", "n-gram jaccard join", "benchmark decontamination", "secret scans", "mixing sources"]
    check({r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}, plain(rows, items))


def test_junk_and_unlearned_languages_go_and_clashing_columns_stay(spark, tmp_path):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(3)
    junk = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(400)), "Zażółć gęślą jaźń, pchnąć w tę łódź jeża lub ośm skrzyń fig", "привет мир это просто текст на другом языке", "12345 !!! ...", "", None]
    more = spark.createDataFrame([(10**6 + i, t, None, None, len(t or "")) for i, t in enumerate(junk)], given.schema)
    rows = given.unionByName(more).select("*", *[F.lit("x").alias(c) for c in CLASHES])
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert passed_through(got, ("size", "source_size", "target", "taken")) and not any(r["doc_id"] >= 10**6 for r in got)
    check({r["doc_id"]: r for r in got}, plain(rows.collect(), [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]))


def test_every_stage_takes_an_empty_table_and_awkward_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (5, " ".join(words(40000, 3)), "en", "s", 1), (5, " ".join(words(40000, 3)), "en", "s", 1), (None, "the text", None, "s", None)], docs.schema)
    rows = docs.unionByName(odd).select("*", *[F.lit("x").alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.where("false"), SF).count() == 0
        got = stage(spark, rows, SF)
        if name != "mixing sources":
            assert got.columns == rows.columns and got.schema.simpleString() == rows.schema.simpleString()
        out = got.collect()
        assert passed_through(out, ("size", "source_size", "target", "taken") if name == "mixing sources" else ())
        assert sum(r["doc_id"] == 5 and len(r["text"]) > 10**5 for r in out) in (0, 2)
