"""Near duplicates of texts by their token sets, joined on rare tokens only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import reader_tokens, tokens
from ..sources.storage import materialize


def token_sets(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Classes (rep, terms) of texts with equal token sets, and membership (key, rep). Texts without tokens are in no class."""
    sets = docs.select(key, F.array_sort(F.array_distinct(tokens(F.col(text)))).alias("terms")).where(F.size("terms") > 0)
    named = sets.withColumn("name", F.sha2(F.array_join("terms", " "), 256))
    classes = named.groupBy("name").agg(F.min(key).alias("rep"), F.first("terms").alias("terms"))
    members = named.select(key, "name").join(classes.select("name", "rep"), "name").select(key, "rep")
    return classes.select("rep", "terms"), members


def named_sets(rows: DataFrame, by: list[str], terms: str = "terms") -> DataFrame:
    """``rows`` with ``name``, which rows of one group ``by`` have in common exactly if their sets of terms are equal."""
    return rows.withColumn("name", F.sha2(F.to_json(F.struct(*by, F.array_sort(F.array_distinct(terms)).alias("s"))), 256))


def alike(sets: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(a, b, similarity), a < b: names of sets (.. by, name, terms) of one group with a Jaccard similarity of ``threshold`` or more.

    ``sets`` has a row for each name. Terms are ordered from rare to common; two such sets share one of
    the first n - ceil(threshold n) + 1 of each, at places that leave them enough to share. So a term that
    all sets have brings no pairs together, unless sets are little else.
    """
    each = materialize(sets.select(*by, "name", F.explode("terms").alias("term")).distinct(), "set-terms")
    rarity = each.groupBy("term").agg(F.count("*").alias("df"))
    in_order = F.array_sort(F.collect_list(F.struct("df", "term")))
    ordered = materialize(each.join(rarity, "term").groupBy(*by, "name").agg(in_order.alias("t")).select(*by, "name", F.col("t.term").alias("terms")), "ordered-sets")
    pairs = candidate_pairs(ordered, by, threshold)
    left, right = (ordered.select(F.col("name").alias(end), F.col("terms").alias(f"t{end}")) for end in "ab")
    both = F.size(F.array_intersect("ta", "tb"))
    sim = both / (F.size("ta") + F.size("tb") - both)
    return pairs.join(left, "a").join(right, "b").select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= threshold)


def candidate_pairs(ordered: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(a, b): pairs of sets (.. by, name, terms from rare to common) that length, prefix and places leave over."""
    n = F.size("terms")
    keep = n - F.ceil(n * threshold - 1e-9) + 1
    rare = ordered.select(*by, "name", n.alias("n"), F.posexplode(F.slice("terms", F.lit(1), keep.cast("int"))).alias("at", "term"))
    x, y = (rare.select(*by, "term", *[F.col(c).alias(f"{end}_{c}") for c in ("name", "n", "at")]) for end in "xy")
    near = (F.col("x_n") >= F.col("y_n") * threshold) & (F.col("y_n") >= F.col("x_n") * threshold)
    most = F.least("x_at", "y_at") + F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    enough = most >= (F.col("x_n") + F.col("y_n")) * (threshold / (1 + threshold)) - 1e-9
    found = x.join(y, [*by, "term"]).where((F.col("x_name") < F.col("y_name")) & near & enough)
    return found.select(F.col("x_name").alias("a"), F.col("y_name").alias("b")).distinct()


def both_ways(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` in both orders, and each set of ``sets`` with itself."""
    turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")
    return pairs.unionByName(turned).unionByName(sets.select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("similarity")))


def same_day(log: DataFrame, reject: float = 0.8, warn: float = 0.6) -> DataFrame:
    """(seq, verdict) of writes whose text nearly repeats an earlier one of the same topic and day.

    Texts meet as sets of words, each set once; texts without words are alike.
    """
    t = reader_tokens(F.col("content"))
    w = log.where(F.col("type") == "write_event").select("seq", "slug", F.to_date("ts").alias("day"), F.when(F.size(t) > 0, t).otherwise(F.array(F.lit(""))).alias("terms"))
    rows = materialize(named_sets(w, ["slug", "day"]), "day-sets")
    sets = materialize(rows.groupBy("slug", "day", "name").agg(F.min("seq").alias("first_seq"), F.first("terms").alias("terms")), "day-names")
    near = both_ways(alike(sets, ["slug", "day"], warn), sets)
    earlier = near.join(sets.select(F.col("name").alias("b"), "first_seq"), "b")
    found = rows.select("seq", F.col("name").alias("a")).join(earlier, "a").where(F.col("first_seq") < F.col("seq"))
    best = found.groupBy("seq").agg(F.max("similarity").alias("best"))
    return best.select("seq", F.when(F.col("best") >= reject, "reject").otherwise("warn").alias("verdict"))
