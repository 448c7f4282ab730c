"""WAND search, executed compaction and the URL filter against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from proofmark.llm import compaction, lexical, urls
from proofmark.llm.queries import QUERIES

from ..conftest import SF
from .test_operators import CLASHES, awkward, docs, no_broadcast, passed_through, words  # noqa: F401

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


# ---------------------------------------------------------------- 11

def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(rows, items, k):
    """Every document scored for every item."""
    counted = [(i, Counter(terms(t))) for i, t in rows]
    n = sum(bool(c) for _, c in counted)
    total = sum(sum(c.values()) for _, c in counted)
    held = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 50 + 50 * sum(c.values()) * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranking(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"{'Wé'[i % 2]}{int(300 * rng.random() ** 3)}" for i in range(3000)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 20, 200]))) for _ in range(n)]


@pytest.mark.parametrize("window,shard,block", [(512, 1 << 20, 1 << 18), (3, 40, 30)])
def test_search_equals_scoring_everything(spark, monkeypatch, window, shard, block):
    for name, value in (("WINDOW", window), ("SHARD_POSTINGS", shard), ("BLOCK_TERMS", block)):
        monkeypatch.setattr(lexical, name, value)
    texts = corpus(1, 240)
    texts = [*awkward(), *texts, *texts[:30], *["tie tie"] * 9]
    rows = docs(spark, texts, extra=True).withColumn("doc_id", F.when(F.col("doc_id") % 40 != 7, F.col("doc_id"))).repartition(5)
    items = [(i, t) for i, t in enumerate([*corpus(2, 12), None, "", " .,", "tie", "nowhere", texts[20]])] + [(3, "tie W1"), (None, "W2 é5"), (3, "tie W1")]
    got = ranking(lexical.rank(rows, spark.createDataFrame(items, "item_id long, text string"), 10))
    assert got == plain_ranking([(r["doc_id"], r["text"]) for r in rows.collect()], items, 10)


def test_search_of_and_with_nothing(spark):
    none, some = docs(spark, []), docs(spark, ["a b", None])
    items = spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")
    assert lexical.rank(none, items).count() == 0 and lexical.rank(docs(spark, [None, "."]), items).count() == 0
    assert lexical.rank(some, items.where("false")).count() == 0
    assert ranking(lexical.rank(some, items)) == plain_ranking([(0, "a b"), (1, None)], [(1, "a"), (2, None)], 50)


def test_documents_that_cannot_enter_are_not_scored():
    rng = np.random.default_rng(5)
    size, vocabulary = 4000, 40
    key = np.unique(rng.integers(0, size, 30000) * vocabulary + (vocabulary * rng.random(30000) ** 2).astype(int))
    doc, term = key // vocabulary, key % vocabulary
    tf, lengths = rng.integers(1, 6, len(key)), rng.integers(5, 400, size)
    held = np.bincount(term, minlength=vocabulary)
    shard = lexical.Shard(doc, term, tf, lengths, lexical.weights(size, held), size, int(lengths.sum()))
    for terms_ in (np.array([0, 1, 2, 35, 36, 37, 38, 39]), np.array([39]), np.arange(vocabulary)):
        heap = lexical.Heap(10)
        scored = lexical.wand(shard, terms_, heap, np.arange(size), np.zeros(size, bool))
        every = np.zeros(size, np.int64)
        inside = np.isin(shard.keys // size, terms_)
        np.add.at(every, shard.docs[inside], shard.impacts[inside])
        best = np.lexsort((np.arange(size), -every))[:10]
        assert heap.ids.tolist() == best.tolist() and heap.scores.tolist() == every[best].tolist()
        assert 10 <= scored <= np.count_nonzero(every) and (len(terms_) == 1 or scored < 0.8 * np.count_nonzero(every))


def test_huge_counts_stay_exact():
    assert lexical.damping(np.array([10**12]), 10**9, 10**13).tolist() == [50 + 50 * 10**12 * 10**9 // 10**13]


def test_search_query_on_a_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ranking(QUERIES["op11_wand_search"](spark, SF)) == plain_ranking(rows, items, 50)


# ---------------------------------------------------------------- 12

def plain_compaction(rows, parts=150, under=600, most=400):
    """(day, lot, piece) -> what the final file holds; rows are (click_id, arrived_at, value) in no order."""
    s = lambda x: 1 + len(rows) // x
    day = lambda t: None if t is None else (t.date() - date(1970, 1, 1)).days
    days = Counter(day(t) for _, t, _ in rows)
    files = defaultdict(list)
    for i, t, v in rows:
        h = zlib.crc32(("" if i is None else str(i)).encode())
        files[day(t), h // 16 % (1 + days[day(t)] // s(parts)), min(h % 4, h // 4 % 4)].append((t or datetime.min, i is not None, i or 0, v))
    final = {}
    for d in days:
        groups = []
        for k in sorted((k for k in files if k[0] == d), key=lambda k: (-len(files[k]), k[1], k[2])):
            if len(files[k]) >= s(under):
                final[k] = [k]
                continue
            fits = next((g for g in groups if sum(len(files[x]) for x in g) + len(files[k]) <= s(most)), None)
            if fits:
                fits.append(k)
            else:
                groups.append([k])
        final |= {g[0]: g for g in groups}
    out = {}
    for k, sources in final.items():
        held = [x for f in sources for x in sorted(files[f], key=lambda x: x[:3])]
        ids = [x[2] if x[1] else None for x in held]
        known = [i for i in ids if i is not None]
        out[k] = (len(held), min(known, default=None), max(known, default=None), sum(math.floor(100 * x[3] + 0.5) for x in held if x[3] is not None and math.isfinite(x[3])),
                  ",".join(f"{x[1]}-{x[2]}" for x in sources), hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest(), len(sources) > 1)
    return out


def reported(df):
    rows = df.collect()
    out = {(r["day"], r["lot"], r["piece"]): (r["n_rows"], r["min_click_id"], r["max_click_id"], r["cents"], r["sources"], r["ids_sha256"], r["rewritten"]) for r in rows}
    assert len(out) == len(rows)
    return out, rows


def local(path):
    return Path(re.sub("^file:/*", "/", path))


def test_compaction_query_equals_a_plain_version(spark):
    clicks = spark.read.parquet(f"{SF}/clicks.parquet")
    got, rows = reported(QUERIES["op12_executed_compaction"](spark, SF))
    assert got == plain_compaction([tuple(r) for r in clicks.select("click_id", "arrived_at", "value").collect()])
    assert {r["columns"] for r in rows} == {",".join(clicks.columns)} and {r["rewritten"] for r in rows} == {True, False}
    folder = next(p for p in local(rows[0]["path"]).parents if p.name == "table")
    assert {p for p in folder.rglob("*") if p.is_file() and p.suffix == ".parquet"} == {local(r["path"]) for r in rows}
    assert not (folder / "_merged").exists()
    back = spark.read.parquet(str(folder)).select(*clicks.columns)
    assert back.schema == clicks.schema and back.exceptAll(clicks).count() == clicks.exceptAll(back).count() == 0


def test_compaction_leaves_other_files_and_can_be_resumed(spark, tmp_path, no_broadcast):  # noqa: F811
    start = datetime(1969, 12, 30)
    rng = random.Random(4)
    data = [(rng.randrange(500) if i % 50 else None, None if i % 97 == 0 else start + timedelta(hours=int(200 * rng.random() ** 3)), rng.choice([None, -1.005, 2.5, float("nan")]), "x" * (10_000 if i == 5 else i % 9), 1, 2) for i in range(3000)]
    data += data[:40]
    rows = spark.createDataFrame(data, "click_id long, arrived_at timestamp_ntz, value double, day string, LOT long, piece_ int").repartition(6)
    folder = f"file://{tmp_path}/table"
    total = compaction.deal(rows, folder, f"file://{tmp_path}/work")
    files = compaction.materialize(compaction.file_table(spark, rows.schema, folder), f"file://{tmp_path}/work", "files")
    before = {p: p.read_bytes() for p in (tmp_path / "table").rglob("*.parquet")}
    assert len(before) == files.count()
    plan = compaction.materialize(compaction.plan_groups(files, compaction.share(total, 600), compaction.share(total, 400)), f"file://{tmp_path}/work", "plan")
    staged = compaction.materialize(compaction.execute(spark, rows.schema, folder, plan), f"file://{tmp_path}/work", "staged")
    assert compaction.settle(staged.where("rewritten").limit(3)).count() == 3  # the driver is lost on the way
    final = compaction.materialize(compaction.settle(staged), f"file://{tmp_path}/work", "final")
    assert compaction.settle(staged).count() == final.count()
    got, out = reported(compaction.inspect(final))
    assert got == plain_compaction([x[:3] for x in data])
    assert all(local(r["path"]).read_bytes() == before[local(r["path"])] for r in out if not r["rewritten"])
    assert {p for p in (tmp_path / "table").rglob("*.parquet") if "_merged" not in str(p)} == {local(r["path"]) for r in out}
    assert {pq.ParquetFile(local(r["path"])).schema_arrow.names == rows.columns for r in out} == {True}


def test_compaction_of_nothing_and_one_row(spark):
    rows = spark.createDataFrame([(7, datetime(2024, 1, 1), 1.0)], "click_id long, arrived_at timestamp_ntz, value double")
    assert compaction.compact(rows.where("false")).collect() == []
    assert reported(compaction.compact(rows))[0] == plain_compaction([tuple(r) for r in rows.collect()])


# ---------------------------------------------------------------- 13

def plain_verdict(url, rules, default="allow"):
    _, found, rest = (url or "").partition("://")
    m = re.match(r"([^/?#]*)([^?#]*)", rest if found else "")
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    best = max(fits, key=lambda x: (x[0], x[1], x[3] == "block"), default=(0, 0, None, default))
    return host, path, best[2], best[3]


def random_urls(n, seed=8):
    rng = random.Random(seed)
    label = lambda: rng.choice(["a", "b", "É", "x-1", "", "B"])
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 6))) + rng.choice(["", ":80"])
    path = lambda: "".join(rng.choice(["/", "p", "q", "%20", "é", "\n"]) for _ in range(rng.randrange(9)))
    return [rng.choice(["http", "HTTPS", "", "x://y"]) + rng.choice(["://", "://", "://", ":/", ""]) + host() + rng.choice(["", "/" + path(), "/" + path()]) + rng.choice(["", "?a=://b/p", "#/f", "?#"]) for _ in range(n)]


@pytest.mark.parametrize("narrow", [False, True])
def test_urls_equal_every_rule_tried(spark, request, narrow):
    if narrow:
        request.getfixturevalue("no_broadcast")
    rng = random.Random(9)
    rules = {(".".join(rng.choice(["a", "b", "É", "x-1"]) for _ in range(rng.randrange(1, 4))), rng.choice(["", "/" + "".join(rng.choice("/pq") for _ in range(rng.randrange(5)))])) for _ in range(60)}
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in sorted(rules)]
    rules += [(h, p, "block") for h, p, _ in rules[:5]]
    bad = [(None, "/", "block"), ("", "/", "block"), ("a", "p", "block"), ("a/b", "/", "block"), ("b", "/", "maybe"), ("b", "/", None), ("A", None, "allow")]
    given = [*[r for r in rules], ("a", "", "allow")]
    deepest = "a." * 3000 + "a"
    all_urls = [None, "", "http://", "http:///p", f"http://{deepest}/p", "http://a/" + "p" * 100_000, *random_urls(400), *["http://a.b/pp"] * 300]
    pages = spark.createDataFrame([(i if i % 9 else None, u) for i, u in enumerate(all_urls)], "page_id long, url string")
    pages = pages.select("*", *[F.lit("x").alias(c) for c in CLASHES if c != "path"], F.lit("gone").alias("path"))
    got = urls.judge(pages, spark.createDataFrame(rules + bad, urls.RULES)).collect()
    assert passed_through(got, urls.MADE) and len(got) == len(all_urls)
    block_first = {(h, p): "block" for h, p, v in given if v == "block"}
    expected = [(i if i % 9 else None, *plain_verdict(u, [(h, p, block_first.get((h, p), v)) for h, p, v in given])) for i, u in enumerate(all_urls)]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["page_id"], *(r[c] for c in urls.MADE)) for r in got), key=key) == sorted(expected, key=key)


def test_urls_of_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    none = spark.createDataFrame([], urls.RULES)
    assert [tuple(r) for r in urls.judge(pages, none).select("page_id", *urls.MADE).collect()] == [(1, "a", "/b", None, "allow")]
    assert urls.judge(pages.where("false"), none).count() == 0
