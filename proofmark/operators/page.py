"""A report as a page, and what an evaluation reads back from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .batch import display_text


def escape(text: Column) -> Column:
    """Text for the inside of an element or an attribute."""
    out = F.coalesce(text, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def phrase(edit: Column) -> Column:
    """One difference in words."""
    expected, found = escape(edit["expected"]), escape(edit["found"])
    return (F.when(edit["op"] == "insert", F.concat(F.lit("added <ins>"), found, F.lit("</ins>")))
            .when(edit["op"] == "delete", F.concat(F.lit("left out <del>"), expected, F.lit("</del>")))
            .otherwise(F.concat(F.lit("<del>"), expected, F.lit("</del> became <ins>"), found, F.lit("</ins>"))))


def render(verdict: Column, findings: Column, fields: Column, seconds: Column) -> Column:
    """The page of a report: verdict, what was read, a finding a row with its citation and differences, and the time it took."""
    read = [F.concat(F.lit(f"<tr><th>{title}</th><td>"), escape(F.coalesce(fields[name]["value"], F.lit("not read"))), F.lit("</td></tr>"))
            for name, title in (("brand_name", "Brand"), ("class_type", "Class"), ("alcohol_content", "Alcohol"), ("net_contents", "Contents"))]
    seen = F.when(F.coalesce(fields["government_warning"]["found"], F.lit(False)), "shown").otherwise("not found")
    rows = F.transform(findings, lambda f: F.concat(
        F.lit('<li data-rule="'), escape(f["rule_id"]), F.lit('" data-verdict="'), f["verdict"], F.lit('"><b>'), escape(f["title"]), F.lit("</b> <cite>"), escape(f["citation"]),
        F.lit("</cite><p>"), escape(f["detail"]), F.lit("</p>"), F.array_join(F.transform(f["diff"], lambda d: F.concat(F.lit("<p>"), phrase(d), F.lit("</p>"))), ""), F.lit("</li>")))
    return F.concat(F.lit('<article data-verdict="'), verdict, F.lit('"><h1>'), display_text(verdict), F.lit("</h1><table>"), *read, F.lit("<tr><th>Warning</th><td>"), seen,
                    F.lit("</td></tr></table><ul>"), F.array_join(rows, ""), F.lit("</ul><footer>checked in "), F.format_number(seconds, 2), F.lit(" s</footer></article>"))


def read_verdict(page: Column) -> Column:
    return F.nullif(F.regexp_extract(page, r'<article data-verdict="(\w+)"', 1), F.lit(""))


def read_findings(page: Column) -> Column:
    """array of struct(rule_id, verdict), in the page's order."""
    pattern = r'<li data-rule="([^"]*)" data-verdict="(\w+)"'
    part = lambda i: F.regexp_extract_all(page, F.lit(pattern), F.lit(i))
    return F.arrays_zip(part(1).alias("rule_id"), part(2).alias("verdict"))


def read_seconds(page: Column) -> Column:
    return F.nullif(F.replace(F.regexp_extract(page, r"checked in ([\d,.]+) s", 1), F.lit(","), F.lit("")), F.lit("")).try_cast("double")
