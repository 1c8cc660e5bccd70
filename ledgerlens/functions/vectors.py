"""Vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What models expect before a query and before a passage.
PREFIXES = {"e5-small": ("query: ", "passage: "), "bge-small-en": ("Represent this sentence for searching relevant passages: ", "")}


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """A vector of length 1; one of zeros as it is."""
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))), 1)


def prefixed(text: Column, kind: str, model: str) -> Column:
    """The text as a model wants it: ``kind`` is query or passage; an unknown model takes it as it is."""
    query, passage = PREFIXES.get(model, ("", ""))
    return F.concat(F.lit(query if kind == "query" else passage), text)
