"""Reports: every applicable rule's finding for every label, and the verdict over them.

Rules are few and known when the plan is made, so label x rule is an array built in the row: no join, no
explode and no shuffle.  Labels without a finding keep their row and go to review.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DIFF, FINDING
from ..rulebook import Rule, Rulebook
from ..storage import settled
from . import gate
from .matchers import STRATEGIES, asserted, prepare

# What a class is recognised by, in this order.
WINE = ("wine", "port", "sherry", "vermouth", "madeira", "champagne")
MALT = ("beer", "ale", "lager", "porter", "stout", "malt")
NOTE = " The second read of the label does not support this, so a person has to look."


def beverage_class(text: Column) -> Column:
    """wine, malt or spirits, by substrings; wine is looked for first."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike("|".join(WINE)), "wine").when(low.rlike("|".join(MALT)), "malt").otherwise("spirits")


def worst(findings: Column) -> Column:
    """fail over needs_review over pass; without a pass there is nothing to stand on, so review."""
    has = lambda v: F.exists(findings, lambda f: f["verdict"] == v)
    return F.when(has("fail"), "fail").when(has("needs_review") | ~has("pass"), "needs_review").otherwise("pass")


def verify(labels: DataFrame, rulebook: Rulebook, unicode: bool = True) -> DataFrame:
    """(*columns, beverage, findings, verdict, rulebook_version) of labels (``model.LABEL``).

    ``unicode=False`` leaves out the functions for other than ASCII text, where the texts are known to be ASCII.
    Rules come before the gate: a claim is scored against the second read only if a pass or fail hangs on it.
    """
    columns = labels.columns
    rules = [(i, r) for i, r in enumerate(rulebook.rules) if r.match.strategy in STRATEGIES]
    reference = rulebook.warning.match.reference if rulebook.warning else ""
    brand_field = next((r.match.field for _, r in rules if r.match.strategy == "brand_match" and r.match.field), "brand_name")
    out = prepare(labels, reference or "", brand_field, unicode)
    filed = F.nullif(F.col("application.class_type"), F.lit(""))
    made = {f"__rule_{i}": STRATEGIES[r.match.strategy](r, unicode) for i, r in rules}
    out = settled(out, **made | {"__alive": gate.is_alive(F.col("ocr_lines")), "beverage": beverage_class(F.coalesce(filed, F.col("fields.class_type.value")))})
    decided = lambda i, r: r.applies(F.col("beverage")) & F.col(f"__rule_{i}.verdict").isin("pass", "fail")
    by_field: dict[str, list[Column]] = {}
    for i, r in rules:
        if r.match.field:
            by_field.setdefault(r.match.field, []).append(decided(i, r))
    out = out.withColumns({f"__ask_{f}": gate.asks(asserted(f), F.col("__blob"), F.col("__alive") & reduce(or_, held)) for f, held in by_field.items()})
    out = settled(out, **{f"__open_{f}": gate.unsupported(F.col(f"__ask_{f}"), F.col("__blob")) for f in by_field})

    def finding(i: int, rule: Rule) -> Column:
        got = F.col(f"__rule_{i}")
        held = (F.col(f"__open_{rule.match.field}") if rule.match.field else F.lit(False)) & got["verdict"].isin("pass", "fail")
        row = F.struct(
            F.lit(i).alias("rule_pos"), F.lit(rule.id).alias("rule_id"), F.lit(rule.title).alias("title"), F.lit(rule.citation).alias("citation"),
            F.when(held, "needs_review").otherwise(got["verdict"]).alias("verdict"),
            F.when(held, F.concat(got["detail"], F.lit(NOTE))).otherwise(got["detail"]).alias("detail"),
            F.when(held, F.array().cast(DIFF)).otherwise(got["diff"]).alias("diff"))
        return F.when(rule.applies(F.col("beverage")), row.cast(FINDING))

    out = out.select(*columns, "beverage", F.array_compact(F.array(*[finding(i, r) for i, r in rules])).alias("findings"))
    return out.withColumns({"verdict": worst(F.col("findings")), "rulebook_version": F.lit(rulebook.version)})


def findings(reports: DataFrame) -> DataFrame:
    """A row a finding, in rule order."""
    # the outer form: for explode() the optimizer would add a filter on the array below and compute it twice
    return reports.select("label_id", F.explode_outer("findings").alias("f")).where("f IS NOT NULL").select("label_id", "f.*")
