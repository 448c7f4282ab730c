"""The cross-check of two independent reads of a label.

A null array of lines means that there was no second read; an empty one means that it read nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.similarity import lacks_support
from ..functions.text import squash

#: Below this share a claim is not confirmed; what a usable read holds at least.
SUPPORT_FLOOR = 0.60
ALIVE_CHARACTERS, ALIVE_CONFIDENCE = 8, 0.5


def blob(lines: Column) -> Column:
    """The text of the lines in order of position, joined by spaces."""
    ordered = F.array_sort(F.transform(lines, lambda x: F.struct(x["pos"].alias("pos"), x["text"].alias("text"))))
    return F.array_join(F.transform(ordered, lambda x: F.coalesce(x["text"], F.lit(""))), " ")


def is_alive(lines: Column) -> Column:
    """Whether the second read holds anything usable."""
    size = F.aggregate(lines, F.lit(0), lambda n, x: n + F.coalesce(F.length(x["text"]), F.lit(0)))
    return F.coalesce((size >= ALIVE_CHARACTERS) & F.exists(lines, lambda x: F.coalesce(x["confidence"], F.lit(0.0)) >= ALIVE_CONFIDENCE), F.lit(False))


def confirms_exactly(reference: Column, text: Column) -> Column:
    """Whether the text holds the reference, on letters and digits alone."""
    target = squash(reference)
    return F.coalesce((target != "") & F.contains(squash(text), target), F.lit(False))


_lacks = lacks_support(SUPPORT_FLOOR)


def asks(claim: Column, squashed: Column, usable: Column) -> Column:
    """The squashed claim if it has to be scored against the second read (squashed).

    Null where nothing has to be: no claim, no usable read, or a read that holds the claim as it is.
    """
    quote = squash(claim)
    return F.when(usable & (F.coalesce(claim, F.lit("")) != "") & ((quote == "") | ~F.contains(squashed, quote)), quote)


def unsupported(ask: Column, squashed: Column) -> Column:
    """Whether the read's support of an asked claim is below the floor; an empty claim has none."""
    return F.coalesce(_lacks(ask, squashed), F.lit(False))
