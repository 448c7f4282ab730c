"""URL filter: hashed expressions of host suffixes and path prefixes against a table of rules.

A rule is (host, path, verdict): it fits its host and every subdomain of it where the URL's path starts with the
rule's.  Each distinct (host, path) of the input is expanded in two steps, so that only expressions that a rule can
equal are made: its host suffixes meet the hosts of the rules, and each suffix that is one is followed by the path
prefixes of the lengths that the rules of this host have.  Both joins are on the first four bytes of SHA-256
digests; what meets is confirmed by the full digest.  Of the rules that fit, the longest (host and path together)
wins, then that with the longer host.

The rules are broadcast within the session's bound by their written size; beyond it both joins shuffle, with keys that many URLs
share dealt apart.  No host or URL meets in one task: equal URLs are one before they are expanded, and hot ones are
joined with their verdict where they lie.  A URL makes at most as many expressions as a rule has labels, times the distinct path lengths of that
rule's host, so a very long URL costs no more than a short one beyond being read.

Defined results: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case, with port and user
if it has them; the path goes on from there up to ``?``, ``#`` or the end; a null URL or one without ``://`` has both empty and
gets the default verdict; no rule fits an empty host.  Rules without a host, with a path that is neither empty nor
starts with ``/``, or with a verdict other than allow and block are left out; of equal rules with different verdicts block wins.
Rows that repeat are answered each, a null page_id as well; an empty table gives no rows; extra columns pass through
whatever their names, unless named as one of the columns made here, which replace them.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, join_unique, materialize, shared_dir, unpacked_row

MADE = ["host", "path", "rule", "verdict"]
RULES = "host string, path string, verdict string"


def lower_ascii(text) -> F.Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_of(url) -> F.Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url) -> F.Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def hashed(rows: DataFrame, expression: str, digest: str) -> DataFrame:
    """``rows`` with the full digest of an expression and its first four bytes as ``key``."""
    return rows.withColumn(digest, F.sha2(F.col(expression), 256)).withColumn("key", F.substring(digest, 1, 8))


def usable(rules: DataFrame) -> DataFrame:
    """(rule, host, path, verdict), one row a rule."""
    rows = rules.select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rows = rows.where((F.col("host") != "") & ~F.contains("host", F.lit("/")) & ((F.col("path") == "") | F.startswith("path", F.lit("/"))) & F.col("verdict").isin("allow", "block"))
    block = F.bool_or(F.col("verdict") == "block")
    return rows.groupBy("host", "path").agg(F.when(block, "block").otherwise("allow").alias("verdict")).select(F.concat("host", "path").alias("rule"), "host", "path", "verdict")


def fitting(keys: DataFrame, rules: DataFrame, folder: str) -> DataFrame:
    """(host, path, rule, verdict) for the distinct (host, path) of ``keys`` that some rule fits."""
    rules = materialize(hashed(usable(rules), "rule", "rule_digest"), folder, "rules")
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths")).withColumnRenamed("host", "rule_host")
    hosts = materialize(hashed(lengths, "rule_host", "host_digest").drop("rule_host"), folder, "hosts")
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0]
    if most is None:
        return keys.where("false").select("host", "path", F.lit("").alias("rule"), F.lit("").alias("verdict"))
    labels = F.least(F.size(F.split("host", r"\.")), F.lit(most))
    suffixes = F.transform(F.sequence(F.lit(1), labels), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    by_host = hashed(keys.where("host <> ''").select("host", "path", F.explode(suffixes).alias("suffix")), "suffix", "digest")
    met = join_unique(by_host, hosts, ["key"]).where("digest = host_digest").drop("key", "digest", "host_digest")
    by_path = met.select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    expressions = by_path.withColumn("expression", F.concat("suffix", F.substring(F.col("path"), F.lit(1), F.col("n"))))
    fits = join_unique(hashed(expressions, "expression", "digest").select("host", "path", "suffix", "digest", "key"), rules.select("rule", "verdict", "rule_digest", "key"), ["key"]).where("digest = rule_digest")
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("suffix"))).alias("best")
    return fits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", folder: str | None = None) -> DataFrame:
    """``pages`` with the host and path of each url, the rule that decides (null: none fits) and the verdict."""
    folder = folder or shared_dir(pages.sparkSession)
    columns = [c for c in pages.columns if c not in MADE]
    parsed = carried(pages, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = materialize(fitting(parsed.select("host", "path").distinct(), rules, folder), folder, "found")
    joined = join_unique(parsed, found, ["host", "path"], "left")
    return joined.select(*unpacked_row(joined, columns), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: The rules of the query.
RULE_ROWS = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op13(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, spark.createDataFrame(RULE_ROWS, RULES)).select("page_id", *MADE)


ORACLE = rf"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(map(str, RULE_ROWS))}),
u AS (SELECT row_number() OVER () AS n, page_id,
             translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT n, rule_host || rule_path AS rule, rule_verdict FROM u JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
b AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS verdict FROM f GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN b USING (n)
"""
