"""Access-controlled, tiered retrieval: lexical and cosine arms fused by reciprocal rank, for many queries at once.

Queries are tables: (qid, text) for words, (qid, vector) for vectors. Words are looked up in
written postings; everything that a query may not see goes before anything is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunks, tokens
from ..sources.storage import materialize
from .blocks import nearest, top
from .expansion import expanded

# BM25 with a lower bound on term frequency, as a published search library has it, and the bounds of both arms.
K1, B, DELTA = 1.2, 0.7, 0.5
RRF_K, LEXICAL_WEIGHT, N_PRE, FLOOR = 60, 0.5, 100, 0.30
#: Weights of fields and share of a term's letters that may differ, in searches of units and of whole topics.
UNIT_BOOSTS, UNIT_FUZZY = {"content": 1.0, "slug": 2.0}, 0.3
TOPIC_BOOSTS, TOPIC_FUZZY = {"slug": 5.0, "tags": 2.0, "content": 0.5}, 0.1


def own_tag(tag: Column, imported_field: Column) -> Column:
    """Whether an entry's tag stands for what it is: one that was imported (``imported_field`` says from which part of a file) must come from the part of that name."""
    return imported_field.isNull() | (imported_field == F.lower(tag))


def tier(tag: Column, retired: Column, imported_field: Column | None = None) -> Column:
    """curated, source or note; null for a retired curated unit. A curated or source entry imported from elsewhere is a note."""
    own = F.lit(True) if imported_field is None else own_tag(tag, imported_field)
    return F.when((tag == "CURATED") & retired, None).when((tag == "CURATED") & own, "curated").when((tag == "SOURCE") & own, "source").otherwise("note")


def in_scope(tier_col: Column, scope: str = "curated") -> Column:
    return F.lit(True) if scope == "all" else tier_col == "curated"


def live(units: DataFrame) -> DataFrame:
    """Units with their tier; retired curated ones have none and go. Where they have an imported_field, it counts."""
    field = F.col("imported_field") if "imported_field" in units.columns else None
    return units.withColumn("tier", tier(F.col("tag"), F.col("retired"), field)).where("tier is not null")


def chunked(units: DataFrame) -> DataFrame:
    """Units (key ending in the chunk's number, .., content) cut into chunks, each a unit of its own."""
    rest = [c for c in units.columns if c not in ("key", "content")]
    rows = units.select("key", *rest, F.inline(chunks(F.col("content"))))
    return rows.withColumn("key", F.concat(F.regexp_replace("key", r"::0$", "::"), F.col("chunk_index").cast("string")))


def readable(units: DataFrame, acl: DataFrame, principal: str) -> DataFrame:
    """Units of topics whose readers include the principal; without readers a topic is closed."""
    return units.join(acl.where(F.array_contains("readers", principal)).select("slug"), "slug", "left_semi")


def authorized(asked: DataFrame, acl: DataFrame, principal: str) -> DataFrame:
    """(ask_id, allowed): every topic asked for must be readable. ``asked`` is (ask_id, slug)."""
    open_ = acl.where(F.array_contains("readers", principal)).select("slug", F.lit(1).alias("open"))
    return asked.join(open_, "slug", "left").groupBy("ask_id").agg((F.count("open") == F.count("*")).alias("allowed"))


@dataclass
class Index:
    """postings (key, field, term, tf), lengths (key, field, length) in distinct terms, and means (field, n, mean)."""

    postings: DataFrame
    lengths: DataFrame
    means: DataFrame


def fields(units: DataFrame, names=("content", "slug")) -> DataFrame:
    """(key, field, text) of these columns."""
    return units.select("key", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("text")) for n in names])))


def index(rows: DataFrame) -> Index:
    """The index of rows (key, field, text), tokenised once; a field's rows of one key count as one text."""
    each = rows.select("key", "field", F.explode_outer(tokens(F.col("text"))).alias("term"))
    p = materialize(each.groupBy("key", "field", "term").agg(F.count("*").alias("tf")), "postings")
    lengths = materialize(p.groupBy("key", "field").agg(F.count("term").alias("length")), "lengths")
    means = lengths.groupBy("field").agg(F.count("*").alias("n"), F.greatest(F.avg("length"), F.lit(1.0)).alias("mean"))
    return Index(p.where("term is not null"), lengths, means)


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, q): the distinct tokens of each query (qid, text); the text itself, lower-cased, where it has none."""
    t = F.array_distinct(tokens(F.col("text")))
    return queries.select("qid", F.explode(F.when(F.size(t) > 0, t).otherwise(F.array(F.lower("text")))).alias("q"))


def lexical(index: Index, queries: DataFrame, boosts: dict[str, float] = UNIT_BOOSTS, fuzzy: float | None = UNIT_FUZZY, mode: str = "auto", limit: int = N_PRE) -> DataFrame:
    """(qid, key, score, rank): each query's best ``limit`` keys. ``auto``: all terms, or any where no key has all.

    Without ``fuzzy`` only equal terms count. Only postings of asked terms are read further than
    their filter; a score is the sum over terms and fields times the query terms met.
    """
    asked = materialize(query_terms(queries), "query-terms")
    exact = asked.select("q", F.col("q").alias("term"), F.lit(1.0).alias("weight")).distinct()
    terms = exact if fuzzy is None else materialize(expanded(index.postings, asked, fuzzy), "expanded")
    hits = materialize(index.postings.join(terms, "term"), "hits")
    df = hits.select("key", "field", "term").distinct().groupBy("field", "term").agg(F.count("*").alias("df"))
    boost = F.create_map(*[F.lit(x) for pair in boosts.items() for x in pair])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean"))) + DELTA
    each = (
        hits.join(index.lengths, ["key", "field"]).join(df, ["field", "term"]).join(F.broadcast(index.means), "field")  # a row for each field
        .groupBy("q", "key").agg(F.sum(F.element_at(boost, F.col("field")) * F.col("weight") * idf * tf).alias("s"))
    )
    scored = each.join(asked, "q").groupBy("qid", "key").agg((F.sum("s") * F.count("*")).alias("score"), F.count("*").alias("matched"))
    if mode != "or":
        scored = materialize(scored, "scored")
        wanted = asked.groupBy("qid").agg(F.count("*").alias("wanted")).join(scored.groupBy("qid").agg(F.max("matched").alias("most")), "qid")
        whole = F.col("matched") == F.col("wanted")
        scored = scored.join(wanted, "qid").where(whole if mode == "and" else whole | (F.col("most") < F.col("wanted")))
    return top(scored.select("qid", "key", "score"), limit)


def exact_lookup(units: DataFrame, acl: DataFrame, principal: str, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(qid, slug, score, rank) of whole topics by slug, tags and content: live units of a topic count as one text; access comes first."""
    own = readable(live(units), acl, principal).select(F.col("slug").alias("key"), "content", "tag")
    once = lambda name, c: own.select("key", F.lit(name).alias("field"), F.col(c).alias("text")).distinct()
    rows = own.select("key", F.lit("content").alias("field"), F.col("content").alias("text")).union(once("slug", "key")).union(once("tags", "tag"))
    return lexical(index(rows), queries, TOPIC_BOOSTS, TOPIC_FUZZY, "or", limit).withColumnRenamed("key", "slug")


def confidence(best: Column) -> Column:
    return F.when(best >= 4, "high").when(best >= 1.5, "medium").otherwise("low")


def context_pack(found: DataFrame, topics: DataFrame, max_topics: int = 3) -> DataFrame:
    """(qid, slug, rank, confidence, excerpt): each query's first topics by their best hit, with an excerpt of their text (slug, text); topics without one go."""
    best = found.groupBy("qid", "slug").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    first = best.withColumn("place", place).where(F.col("place") <= min(max(max_topics, 1), 10)).drop("place")
    excerpt = F.when(F.length("text") > 1500, F.concat(F.substring("text", 1, 1500), F.lit("…"))).otherwise(F.col("text"))
    return first.join(topics, "slug").select("qid", "slug", "rank", confidence(F.col("score")).alias("confidence"), excerpt.alias("excerpt"))


def cache_status(live_keys: DataFrame, cached: DataFrame | None) -> DataFrame:
    """(missing, orphaned, status) of a vector cache: missing, partial, stale or fresh."""
    if cached is None:
        return live_keys.agg(F.count("*").alias("missing"), F.lit(0).cast("long").alias("orphaned"), F.lit("missing").alias("status"))
    both = live_keys.select("key", F.lit(1).alias("l")).join(cached.select("key", F.lit(1).alias("c")), "key", "full_outer")
    counts = both.agg(F.count_if(F.col("c").isNull()).alias("missing"), F.count_if(F.col("l").isNull()).alias("orphaned"))
    status = F.when(F.col("missing") > 0, "partial").when(F.col("orphaned") > 0, "stale").otherwise("fresh")
    return counts.withColumn("status", status)


def fused(arms: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """(qid, key, score): sum of weight / (k + rank) over the arms that hold a key; an absent arm adds nothing."""
    parts = None
    for name, arm in arms.items():
        w = (weights or {}).get(name, 1.0)
        one = arm.select("qid", "key", (F.lit(w) / (k + F.col("rank"))).alias("s"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("qid", "key").agg(F.sum("s").alias("score"))


def cosine(vectors: DataFrame, asked: DataFrame, floor: float = FLOOR, limit: int = N_PRE) -> DataFrame:
    """(qid, key, score, rank): keys whose normalised vector has a dot product of ``floor`` or more with the asked one."""
    return nearest(materialize(vectors.select("key", "embedding"), "vectors"), materialize(asked.select("qid", "vector"), "asked"), floor, limit)


def retrieve(
    units: DataFrame, acl: DataFrame, principal: str, queries: DataFrame, asked: DataFrame | None = None,
    vectors: DataFrame | None = None, scope: str = "curated", limit: int = 10,
) -> DataFrame:
    """(qid, key, slug, tier, score, rank, preview, lexical_rank, semantic_rank, tier_outranks_curated) over chunks.

    Access and scope come before scoring, so nothing hidden shapes a rank. Without vectors the
    lexical arm stands alone.
    """
    own = materialize(chunked(readable(live(units), acl, principal).where(in_scope(F.col("tier"), scope))), "own-chunks")
    arms, weights = {"L": lexical(index(fields(own)), queries)}, None
    if asked is not None and vectors is not None:
        arms["S"] = cosine(vectors.join(own.select("key"), "key", "left_semi"), asked)
        weights = {"L": LEXICAL_WEIGHT, "S": 1.0}
    arms = {name: materialize(arm, "arm") for name, arm in arms.items()}
    whole = top(fused(arms, weights), 2 * N_PRE)  # all that the arms can hold
    rows = own.join(whole, "key")
    for name, column in (("L", "lexical_rank"), ("S", "semantic_rank")):
        if name in arms:
            rows = rows.join(arms[name].select("qid", "key", F.col("rank").alias(column)), ["qid", "key"], "left")
        else:
            rows = rows.withColumn(column, F.lit(None).cast("long"))
    best = F.min(F.when(F.col("tier") == "curated", F.col("rank"))).over(Window.partitionBy("qid"))  # 200 rows a query at most
    outranks = (F.col("tier") != "curated") & (F.col("rank") < F.coalesce(best, F.lit(1 << 30)))
    return (
        rows.withColumn("tier_outranks_curated", outranks).where(F.col("rank") <= limit)
        .select("qid", "key", "slug", "tier", "score", "rank", F.substring("content", 1, 240).alias("preview"), "lexical_rank", "semantic_rank", "tier_outranks_curated")
    )


def occurring(chunks: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``chunks`` with the tier and vector_key that a cache's occurrences (key, tier, vector_key) have for them, else their own coarse tier and no vector."""
    held = occurrences.select("key", F.col("tier").alias("precise"), "vector_key")
    return chunks.join(held, "key", "left").withColumn("tier", F.coalesce("precise", "tier")).drop("precise")


def search(mode: str, units: DataFrame, acl: DataFrame, principal: str, queries: DataFrame | None = None, **how) -> DataFrame:
    """One entry for the three ways to look: ``context_retrieval``, ``exact_lookup``, ``orientation_view``."""
    if not principal:
        raise ValueError("who asks must be known")
    if mode == "context_retrieval":
        return retrieve(units, acl, principal, queries, **how)
    if mode == "exact_lookup":
        return exact_lookup(units, acl, principal, queries, **how)
    if mode == "orientation_view":
        own = readable(live(units), acl, principal)
        return orientation(own.groupBy("slug").agg(F.max("seq").alias("last_updated_seq"), F.count("*").alias("n_writes")), **how)
    raise ValueError(f"no such mode: {mode}")


def orientation(topics: DataFrame, n: int = 20) -> DataFrame:
    """The topics updated last, at most 50."""
    return topics.orderBy(F.desc("last_updated_seq"), "slug").limit(min(max(n, 1), 50))
