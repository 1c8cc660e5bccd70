"""Queries over what is kept between runs: folds by month, streams by key, stored indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import admission, block_max, chain, projection, retrieval, state
from ..sources import adapters, json_array, jsonl, markdown
from ..sources.storage import materialize, scratch_path
from ..streaming import fold, keyed
from . import append, evals, imports, publish, rankers, vector_store
from .catalog import _CHAIN, _DAMAGED, _DELTA, _LAYERS, _RANKINGS, _vector_hits, _asked, _chunk_sql, _damaged, _entries, _lexical_sql, _log, _units, query

# incremental fold ---------------------------------------------------------------------------


def _lines(log: DataFrame) -> DataFrame:
    """Entries of a log as lines, what they name spelled out: (pos, seq, ts, raw), ts in a month of its own for every five days."""
    named = state.with_last_suggested(log).join(state.retire_asks(log).select(F.col("ask_id").alias("pos"), F.slice("seqs", 1, 2).alias("asked")), "pos", "left")
    kind, last = F.col("type"), F.col("last_suggested")
    payload = F.struct(
        F.col("slug").alias("topic"), "tag", "k", F.array_distinct("asked").alias("superseded_seqs"),
        F.when(kind == "TOPIC_SUGGESTION_ACCEPTED", last).alias("suggestion_seq"),
        F.when((kind == "TOPIC_SUGGESTION_DISMISSED") & last.isNotNull(), F.array(last)).alias("suggestion_seqs"), "cooldown_days",
    )
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    month = F.date_format(F.add_months(F.lit("2024-01-01"), F.floor((F.dayofyear("ts") - 1) / 5).cast("int")), "yyyy-MM-dd")
    return named.select("pos", "seq", month.alias("ts"), F.to_json(F.struct("type", "seq", ts.alias("ts"), payload.alias("payload"))).alias("raw"))


def _delete(spark, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def folded_in_steps(spark, log: DataFrame) -> tuple[fold.Fold, fold.Fold]:
    """A log folded when two thirds of it are there and a sealed month lacks entries; and again after the rest came and that month was restored."""
    path, root = scratch_path(spark, "fold-log"), scratch_path(spark, "fold-kept")
    cut = (log.agg(F.max("seq")).first()[0] or 0) * 2 // 3
    lines = _lines(log)
    early, second = F.col("seq") <= cut, F.col("ts").startswith("2024-02")
    jsonl.write(lines.where(early & ~second), f"{path}/1", line="raw")
    jsonl.write(lines.where(early & second & (F.col("seq") % 10 != 0)), f"{path}/2", line="raw")
    before = fold.fold(spark, path, root)
    _delete(spark, f"{path}/2")
    jsonl.write(lines.where(early & second), f"{path}/2", line="raw")
    jsonl.write(lines.where(~early), f"{path}/3", line="raw")
    return before, fold.fold(spark, path, root)


@query("""SELECT 'slug' AS kind, slug, NULL::BIGINT AS seq, NULL AS value FROM log WHERE type IN ('write_event', 'TOPIC_METADATA_SET') GROUP BY slug
UNION ALL SELECT 'topic', slug, max(seq) FILTER (type = 'write_event'), count(*) FILTER (type = 'write_event') || ':' || coalesce(max_by(k, pos) FILTER (type = 'TOPIC_METADATA_SET'), -1)
  FROM log WHERE type IN ('write_event', 'TOPIC_METADATA_SET') GROUP BY slug
UNION ALL SELECT DISTINCT 'retired', slug, superseded_seq, NULL FROM retired WHERE effective
UNION ALL SELECT 'suggestion', slug, suggestion_seq, status || ':' || coalesce(resolver_seq, 0) FROM suggested
UNION ALL SELECT 'cooldown', slug_key, dismissal_seq, until_ms::VARCHAR FROM (
  SELECT *, row_number() OVER (PARTITION BY slug_key ORDER BY until_ms DESC, dismissal_seq) AS rn FROM dismissed WHERE cleared_by_accept_seq IS NULL) WHERE rn = 1""")
def incremental_fold(spark, d):
    """State after appends and a rewritten sealed month, from what was kept and the months that changed."""
    _, found = folded_in_steps(spark, _log(spark, d))
    part, none = found.part, F.lit(None)
    row = lambda df, kind, slug, seq, value: df.select(F.lit(kind).alias("kind"), F.col(slug).alias("slug"), seq.cast("long").alias("seq"), value.cast("string").alias("value"))
    return (
        row(fold.admissible(part), "slug", "slug", none, none)
        .unionByName(row(fold.topics(part), "topic", "slug", F.col("last_seq"), F.concat_ws(":", "n_writes", F.coalesce("meta_k", F.lit(-1)))))
        .unionByName(row(fold.retired(part), "retired", "slug", F.col("seq"), none))
        .unionByName(row(fold.suggestions(part), "suggestion", "slug", F.col("suggestion_seq"), F.concat_ws(":", "status", F.coalesce("resolver_seq", F.lit(0)))))
        .unionByName(row(fold.cooldowns(part), "cooldown", "slug_key", F.col("dismissal_seq"), F.col("until_ms")))
    )


# streams by key -----------------------------------------------------------------------------


def _halves(rows: DataFrame, seq: str) -> list:
    """Conditions for the first half of a table and the rest."""
    half = (rows.agg(F.max(seq)).first()[0] or 0) // 2
    return [F.col(seq) <= half, F.col(seq) > half]


@query("""gaps AS (SELECT slug, seq, row_number() OVER (PARTITION BY slug ORDER BY seq) AS i, (k % 50) / 10.0 AS gap FROM log),
fold AS (WITH RECURSIVE f AS (
  SELECT slug, i, gap > 3 AS now, (gap > 3)::INT AS flip FROM gaps WHERE i = 1
  UNION ALL
  SELECT g.slug, g.i, CASE WHEN f.now THEN g.gap > 1 ELSE g.gap > 3 END, (CASE WHEN f.now THEN g.gap > 1 ELSE g.gap > 3 END <> f.now)::INT
  FROM f JOIN gaps g ON g.slug = f.slug AND g.i = f.i + 1) SELECT * FROM f)
SELECT slug, sum(flip)::BIGINT AS flips, max_by(now, i) AS is_stale FROM fold GROUP BY slug""")
def stream_hysteresis(spark, d):
    """A stream that is stopped half way and started again."""
    gaps, root = _log(spark, d).select("slug", "seq", (F.col("k") % 50 / 10.0).alias("gap")), scratch_path(spark, "hysteresis")
    return keyed.in_parts(gaps, _halves(gaps, "seq"), f"{root}/in", lambda s: keyed.hysteresis(s, f"{root}/stream"))


@query("""runs AS (SELECT slug, epoch_us(ts) // 1000 AS ms, event_type = 'purchase' AND k % 4 = 0 AS good, row_number() OVER (PARTITION BY slug ORDER BY seq) AS i FROM log),
walk AS (WITH RECURSIVE c AS (
  SELECT slug, i, ms AS first, CASE WHEN good THEN ms END AS success, false AS stale, NULL::BIGINT AS emitted, ms + CASE WHEN good THEN 3 ELSE 2 END * 86400000 + 1 AS deadline,
         NULL::VARCHAR AS kind1, NULL::BIGINT AS at1, NULL::VARCHAR AS kind2, NULL::BIGINT AS at2 FROM runs WHERE i = 1
  UNION ALL
  SELECT slug, i, first, success2, stale2, CASE WHEN kind2 IS NULL THEN emitted1 ELSE ms END,
         CASE WHEN coalesce(success2 + 3 * 86400000, first + 2 * 86400000) + 1 > ms THEN coalesce(success2 + 3 * 86400000, first + 2 * 86400000) + 1 END,
         kind1, CASE WHEN kind1 IS NOT NULL THEN deadline END, kind2, CASE WHEN kind2 IS NOT NULL THEN ms END
  FROM (SELECT *, CASE WHEN emitted1 IS NULL OR ms - emitted1 > 21600000 THEN CASE WHEN success2 IS NULL AND ms - first > 2 * 86400000 THEN 'curate_never_succeeded' WHEN stale2 THEN 'curate_liveness_stale' END END AS kind2
    FROM (SELECT *, success2 IS NOT NULL AND ms - success2 > CASE WHEN stale1 THEN 86400000 ELSE 3 * 86400000 END AS stale2
      FROM (SELECT *, CASE WHEN good THEN ms ELSE success END AS success2, CASE WHEN kind1 IS NULL THEN emitted ELSE deadline END AS emitted1
        FROM (SELECT *, CASE WHEN passed AND (emitted IS NULL OR deadline - emitted > 21600000) THEN CASE WHEN success IS NULL AND deadline - first > 2 * 86400000 THEN 'curate_never_succeeded' WHEN stale1 THEN 'curate_liveness_stale' END END AS kind1
          FROM (SELECT *, CASE WHEN passed THEN success IS NOT NULL AND deadline - success > CASE WHEN stale THEN 86400000 ELSE 3 * 86400000 END ELSE stale END AS stale1
            FROM (SELECT c.slug, r.i, r.ms, r.good, first, success, stale, emitted, deadline, coalesce(deadline < r.ms, false) AS passed FROM c JOIN runs r ON r.slug = c.slug AND r.i = c.i + 1)))))))
  SELECT * FROM c),
final AS (SELECT w.*, success IS NOT NULL AND deadline - success > CASE WHEN stale THEN 86400000 ELSE 3 * 86400000 END AS lit FROM walk w
  WHERE deadline <= (SELECT max(ms) FROM runs) AND i = (SELECT max(i) FROM runs r WHERE r.slug = w.slug))
SELECT slug, kind1 AS kind, at1 AS at_ms FROM walk WHERE kind1 IS NOT NULL
UNION ALL SELECT slug, kind2, at2 FROM walk WHERE kind2 IS NOT NULL
UNION ALL SELECT slug, CASE WHEN success IS NULL THEN 'curate_never_succeeded' ELSE 'curate_liveness_stale' END, deadline FROM final
  WHERE (emitted IS NULL OR deadline - emitted > 21600000) AND (success IS NULL AND deadline - first > 2 * 86400000 OR lit)""")
def stream_notices(spark, d):
    """Entries of jobs as a stream that is stopped half way: what timers and entries show, at most once in six hours."""
    log, root = _log(spark, d), scratch_path(spark, "notices")
    good = F.coalesce(F.col("tag") == "CURATED", F.lit(False)) & (F.col("k") % 4 == 0)
    runs = log.select("slug", "seq", F.col("ts").cast("timestamp").alias("ts"), good.alias("complete"))
    return keyed.in_parts(runs, _halves(runs, "seq"), f"{root}/in", lambda s: keyed.notices(s, f"{root}/stream"))


@query(_DELTA.replace("WHERE turn > 0 AND", "WHERE turn > -1 AND") + r""",
ends AS (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id),
est AS (SELECT conv_id, count(*) AS n, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))::BIGINT AS words FROM delta GROUP BY conv_id)
SELECT conv_id, last_turn, coalesce(n, 0) AS n_messages, coalesce(words, 0) AS words FROM ends LEFT JOIN est USING (conv_id)""")
def stream_offsets(spark, d):
    """Sessions read as a stream: their first three turns, then the rest after a new start."""
    turns, root = adapters.table(spark, d, "conversations"), scratch_path(spark, "offsets")
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return keyed.in_parts(turns, [F.col("turn") < 3, F.col("turn") >= 3], f"{root}/in", lambda s: keyed.offsets(s, f"{root}/stream"))


# stored indexes -----------------------------------------------------------------------------


@query(_lexical_sql("or") + " SELECT qid, key, round(score, 6) AS score, rank FROM lex")
def lexical_blocks(spark, d):
    """The best hits from stored postings, blocks that cannot reach them left unread."""
    index = block_max.build(retrieval.fields(retrieval.live(_units(spark, d))), scratch_path(spark, "block-index"))
    return block_max.best(index, _asked(spark, d)).found.withColumn("score", F.round("score", 6))


# vectors ------------------------------------------------------------------------------------

# a text's key is the hash of its canonical form, quotes included
_KEYED = _chunk_sql("live") + """, keyed AS (SELECT *, sha256(to_json(nfc_normalize(content))::VARCHAR) AS vector_key FROM chunk)"""


def _builds(spark, d):
    """A store made of the first half of the units, then of all, then of all but curated ones, then of these again."""
    units, root = _units(spark, d), scratch_path(spark, "vectors")
    half = (units.agg(F.max("seq")).first()[0] or 0) // 2
    rest = units.where("tag <> 'CURATED'")
    return [vector_store.build(u, root, vector_store.COUNTING, half) for u in (units.where(F.col("seq") <= half), units, rest, rest)]


@query(_KEYED + """ SELECT DISTINCT vector_key, (length(content) + 9)::DOUBLE AS length, length(regexp_replace(content, '[^ ]', '', 'g')) + 1.0::DOUBLE AS spaces,
  length(regexp_replace(content, '[^e]', '', 'g')) + 1.0::DOUBLE AS e FROM keyed WHERE tier <> 'curated'""")
def vector_store_vectors(spark, d):
    """The vectors left after four builds: what no unit needs any more is gone."""
    v = F.col("vector")
    return _builds(spark, d)[-1].vectors.select("vector_key", v[0].alias("length"), v[1].alias("spaces"), v[2].alias("e"))


@query(_KEYED + """ SELECT slug, doc_id + 1 AS seq, chunk_index, tier, vector_key, char_start, char_start + length(content) AS char_end FROM keyed WHERE tier <> 'curated'""")
def vector_store_occurrences(spark, d):
    found = _builds(spark, d)[-1].occurrences
    return found.select("slug", "seq", "tier", "vector_key", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "char_start", "char_end")])


@query(_KEYED + """, half AS (SELECT max(doc_id + 1) // 2 AS h FROM units),
b AS (SELECT 1 AS build, vector_key FROM keyed, half WHERE doc_id + 1 <= h UNION ALL SELECT 2, vector_key FROM keyed UNION ALL SELECT 3, vector_key FROM keyed WHERE tier <> 'curated' UNION ALL SELECT 4, vector_key FROM keyed WHERE tier <> 'curated'),
k AS (SELECT build, vector_key, count(*) AS chunks FROM b GROUP BY ALL)
SELECT build, count(*) AS vectors, sum(chunks)::BIGINT AS chunks, count(*) FILTER (NOT EXISTS (SELECT 1 FROM k p WHERE p.build = k.build - 1 AND p.vector_key = k.vector_key)) AS embedded_new,
  (SELECT count(*) FROM k p WHERE p.build = k.build - 1 AND NOT EXISTS (SELECT 1 FROM k q WHERE q.build = k.build AND q.vector_key = p.vector_key)) AS pruned
FROM k GROUP BY build""")
def vector_store_manifest(spark, d):
    """What each of the four builds embedded and dropped: the last embeds nothing."""
    rows = [(k + 1, m["vectors"], m["chunks"], m["embedded_new"], m["pruned"]) for k, m in enumerate(s.manifest for s in _builds(spark, d))]
    return spark.createDataFrame(rows, "build long, vectors long, chunks long, embedded_new long, pruned long")


# appends ------------------------------------------------------------------------------------


@query(_CHAIN + " SELECT slug AS log, pos, i AS seq, hash_prev, self_hash FROM chain")
def append_resume(spark, d):
    """Each topic's log made by three appends, each chained to the tails that it finds."""
    entries, root = _entries(spark, d), scratch_path(spark, "logs")
    last = entries.agg(F.max("pos")).first()[0] or 0
    for part in (F.col("pos") <= last // 3, F.col("pos").between(last // 3 + 1, last * 3 // 4), F.col("pos") > last * 3 // 4):
        found = append.append(entries.where(part), root)
    return found.lines.select("log", "pos", "seq", "hash_prev", "self_hash")


@query(_DAMAGED + """, w AS (WITH RECURSIVE a AS (
  SELECT log, min(pos) AS pos, min_by(self_hash, pos) AS self_hash FROM d WHERE hash_prev = repeat('0', 64) GROUP BY log
  UNION ALL
  SELECT d.log, min(d.pos), min_by(d.self_hash, d.pos) FROM a JOIN d ON d.log = a.log AND d.hash_prev = a.self_hash AND d.pos > a.pos GROUP BY d.log) SELECT * FROM a)
SELECT log, pos FROM w""")
def chain_resume(spark, d):
    """A damaged log walked to its half, and on from there."""
    rows = materialize(_damaged(spark, d).select("log", "pos", "hash_prev", "self_hash"), "damaged")
    half = (rows.agg(F.max("pos")).first()[0] or 0) // 2
    early = rows.where(F.col("pos") <= half)
    held = chain.accepted(early)
    return held.unionByName(chain.accepted(rows, chain.anchors(early, held)))


# one large file -----------------------------------------------------------------------------


@query("SELECT doc_id, lang, n_chars, md5(text) AS text_md5 FROM documents")
def json_array_split(spark, d):
    """Documents as one JSON array in one file, read in ranges of a megabyte."""
    path = scratch_path(spark, "json-array")
    json_array.write(adapters.table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text"), "doc_id", path)
    found = json_array.read(spark, path, split_bytes=1 << 20)
    return found.withColumn("x", F.from_json("raw", "doc_id long, lang string, n_chars long, text string")).select("x.doc_id", "x.lang", "x.n_chars", F.md5("x.text").alias("text_md5"))


# imports ------------------------------------------------------------------------------------

_FIELD_SQL = "CASE {n} % 4 WHEN 1 THEN 'curated' WHEN 2 THEN 'source' WHEN 3 THEN 'events' END"


def _field(n):
    """Which part of a file an entry was imported from; null for one that wasn't imported."""
    return F.when(n % 4 == 1, "curated").when(n % 4 == 2, "source").when(n % 4 == 3, "events")


@query(f"""f AS (SELECT *, {_FIELD_SQL.format(n='doc_id')} AS field FROM units)
SELECT key, CASE WHEN tag = 'CURATED' AND coalesce(field, 'curated') = 'curated' THEN 'curated' WHEN tag = 'SOURCE' AND coalesce(field, 'source') = 'source' THEN 'source' ELSE 'note' END AS tier
FROM f WHERE NOT (tag = 'CURATED' AND retired)""")
def imported_tiers(spark, d):
    """Entries imported from another part of a file than their tag's are notes."""
    return retrieval.live(_units(spark, d).withColumn("imported_field", _field(F.col("doc_id")))).select("key", "tier")


@query(f"""w AS (SELECT *, {_FIELD_SQL.format(n='k')} AS field FROM log WHERE type = 'write_event' AND trim(content, ' ') <> ''),
l2 AS (SELECT slug, string_agg(trim(content, ' '), chr(10) || chr(10) ORDER BY pos) AS text FROM w WHERE tag = 'CURATED' AND coalesce(field, 'curated') = 'curated'
  AND NOT EXISTS (SELECT 1 FROM retired r WHERE r.effective AND r.slug = w.slug AND r.superseded_seq = w.seq) GROUP BY slug),
l3 AS (SELECT slug, string_agg(trim(content, ' '), chr(10) || chr(10) ORDER BY ts DESC, seq DESC) AS text FROM w WHERE tag = 'SOURCE' AND coalesce(field, 'source') = 'source' GROUP BY slug)
SELECT 2 AS layer, slug, md5(text) AS text_md5 FROM l2 UNION ALL SELECT 3, slug, md5(text) FROM l3""")
def imported_layers(spark, d):
    log = _log(spark, d).withColumn("imported_field", _field(F.col("k")))
    row = lambda n, df: df.select(F.lit(n).alias("layer"), "slug", F.md5("text").alias("text_md5"))
    return row(2, projection.layer2(log)).unionByName(row(3, projection.layer3(log)))


def _authored(spark, d) -> DataFrame:
    """(path, text): a log's days as an author might lay them out: a header, comments when the writer changes, lines in all forms."""
    w = state.writes(_log(spark, d)).withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    k, none = F.col("k"), F.lit(None).cast("string")
    line = projection.written_line(F.col("tag"), F.col("slug"), F.col("content"), k % 7 == 0, F.when(k % 3 == 0, F.lit("HIGH")).otherwise(none), F.when(k % 5 == 0, F.col("principal")).otherwise(none))
    changed = F.coalesce(F.col("principal") != F.lag("principal").over(Window.partitionBy("date").orderBy("seq")), F.lit(True))
    row = F.concat(F.when(k % 11 == 0, F.lit("\n")).otherwise(""), F.when(changed, F.concat(F.lit("\n<!-- by "), "principal", F.lit(" -->\n"))).otherwise(""), line)
    days = w.withColumn("row", row).groupBy("date").agg(F.array_sort(F.collect_list(F.struct("seq", "row"))).alias("rows"))
    return days.select(F.concat("date", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "date", F.lit("\n"), F.array_join("rows.row", "\n"), F.lit("\n")).alias("text"))


@query("""w AS (SELECT *, strftime(ts, '%Y-%m-%d') AS date FROM log WHERE type = 'write_event'),
r AS (SELECT date, seq, CASE WHEN k % 11 = 0 THEN chr(10) ELSE '' END
  || CASE WHEN coalesce(principal <> lag(principal) OVER (PARTITION BY date ORDER BY seq), true) THEN chr(10) || '<!-- by ' || principal || ' -->' || chr(10) ELSE '' END
  || '[' || CASE WHEN k % 7 = 0 THEN 'AUTO-' ELSE '' END || tag || CASE WHEN k % 3 = 0 THEN ':HIGH' ELSE '' END || '] ' || slug || ': ' || CASE WHEN k % 5 = 0 THEN '[' || principal || '] ' ELSE '' END || content AS row FROM w)
SELECT date, md5('# ' || date || chr(10) || string_agg(row, chr(10) ORDER BY seq) || chr(10)) AS text_md5 FROM r GROUP BY date""")
def log_roundtrip(spark, d):
    """Dated logs imported line by line and written again from what the import kept."""
    none = spark.createDataFrame([], "slug string")
    entries = imports.log_entries(_authored(spark, d), none).where("type = 'write_event'")
    hints = F.from_json("detail", projection.HINTS).alias("hints")
    rows = entries.select(F.substring("source_file", 1, 10).alias("date"), F.col("at").alias("seq"), "tag", "slug", "principal", "content", hints)
    return projection.regenerated(rows).select("date", F.md5("text").alias("text_md5"))


# projections as files -----------------------------------------------------------------------


@query(_LAYERS + """, half AS (SELECT max(pos) * 19 // 20 AS h FROM log)
SELECT slug, (SELECT count(*) FROM log l, half WHERE l.slug = meta.slug AND l.pos > h) > 0 AS touched_again, md5(coalesce(two, '')) AS curated_md5 FROM meta""")
def published_files(spark, d):
    """Topic files published when most of the log was there, and again after the rest: which were made twice, and their curated part."""
    log, root = _log(spark, d), scratch_path(spark, "published")
    half = (log.agg(F.max("pos")).first()[0] or 0) * 19 // 20
    first = publish.update(log.where(F.col("pos") <= half), root)
    later = log.where(F.col("pos") > half).select("slug").distinct().withColumn("again", F.lit(True))
    second = publish.update(log, root)
    kept = second.index.where(F.col("since") == first.version).select("slug")
    parts = markdown.topic_files(second.texts())
    rows = second.index.select("slug").join(later, "slug", "left").join(parts.select("slug", "curated"), "slug")
    # a topic without new entries keeps the file of the first version
    stale = rows.where("again is null").join(kept, "slug", "left_anti")
    if not stale.isEmpty():
        raise AssertionError("a file was written again without need")
    return rows.select("slug", F.coalesce("again", F.lit(False)).alias("touched_again"), F.md5("curated").alias("curated_md5"))


# rankers by session -------------------------------------------------------------------------

_TURNS = "SELECT conv_id || ':' || turn AS key, 'content' AS field, coalesce(text, '') AS text FROM conversations WHERE role = 'user'"
_COUNTED = "[length({p} || {t})::DOUBLE, length(regexp_replace({p} || {t}, '[^ ]', '', 'g'))::DOUBLE, length(regexp_replace({p} || {t}, '[^e]', '', 'g'))::DOUBLE]"
_RANKED = _lexical_sql("auto", 0.3, fields=_TURNS, boosts={"content": 1.0}, limit=1_000_000_000) + """,
by_words AS (SELECT qid, session, row_number() OVER (PARTITION BY qid ORDER BY best, session) AS rank FROM (SELECT qid, regexp_extract(key, '^(.*):', 1) AS session, min(rank) AS best FROM lex GROUP BY ALL)),
texts AS (SELECT conv_id::VARCHAR AS session, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id),
sv AS (SELECT session, """ + _COUNTED.format(p="'passage: '", t="t") + """ AS v FROM texts), qv AS (SELECT item_id AS qid, """ + _COUNTED.format(p="'query: '", t="text") + """ AS v FROM benchmark WHERE item_id % 100 = 0),
cs AS (SELECT qid, session, list_sum(list_transform([1, 2, 3], lambda i: sv.v[i] * qv.v[i])) / sqrt(list_sum(list_transform(sv.v, lambda x: x * x)) * list_sum(list_transform(qv.v, lambda x: x * x))) AS c FROM sv, qv),
by_vectors AS (SELECT qid, session, row_number() OVER (PARTITION BY qid ORDER BY round(c, 9) DESC, session) AS rank FROM cs),
fu AS (SELECT qid, session, sum(w / (60 + rank)) AS score FROM (SELECT *, 0.5 AS w FROM by_words UNION ALL SELECT *, 1.0 FROM by_vectors) GROUP BY ALL),
by_both AS (SELECT qid, session, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, session) AS rank FROM fu)"""


def _ranked(spark, d):
    passages = vector_store.COUNTING
    return rankers.rank_all(adapters.table(spark, d, "conversations"), _asked(spark, d), passages, vector_store.Model(passages.identity, passages.load, "query: "))


@query(_RANKED + """ SELECT 'lexical' AS ranker, qid, session, rank FROM by_words UNION ALL SELECT 'semantic', qid, session, rank FROM by_vectors UNION ALL SELECT 'hybrid', qid, session, rank FROM by_both""")
def session_rankers(spark, d):
    """Every session's place for each question, by words, by vectors and by both."""
    found = [r.select(F.lit(name).alias("ranker"), "qid", "session", "rank") for name, r in _ranked(spark, d).items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(_RANKED + ",\n" + _RANKINGS.replace("gold AS", "vgold AS").replace("sims AS", "vsims AS").replace("FROM sims", "FROM vsims").replace("top AS", "vtop AS").replace("FROM top", "FROM vtop").replace("s AS (SELECT qid, session, row_number()", "vs AS (SELECT qid, session, row_number()") + """,
g AS (SELECT item_id AS qid, (item_id // 100)::VARCHAR AS session FROM benchmark WHERE item_id % 100 = 0),
m AS (SELECT 100 * avg((SELECT count(*) FROM by_words w WHERE w.qid = g.qid AND w.session = g.session AND w.rank <= 5)::DOUBLE) AS lexical, 100 * avg((SELECT count(*) FROM by_both b WHERE b.qid = g.qid AND b.session = g.session AND b.rank <= 5)::DOUBLE) AS hybrid,
  count(*) FILTER (EXISTS (SELECT 1 FROM by_words w WHERE w.qid = g.qid AND w.session = g.session AND w.rank <= 5) AND NOT EXISTS (SELECT 1 FROM by_both b WHERE b.qid = g.qid AND b.session = g.session AND b.rank <= 5)) AS regressions FROM g),
h AS (SELECT vgold.qid, tier, vtop.session = vgold.session AS relevant FROM vtop JOIN vgold USING (qid) JOIN live ON live.doc_id = vtop.key WHERE rank <= 5),
p AS (SELECT avg(p) AS p FROM (SELECT avg(relevant::INT) AS p FROM h WHERE tier <> 'curated' GROUP BY qid, tier)),
c AS (SELECT 100 * avg((EXISTS (SELECT 1 FROM h WHERE h.qid = vgold.qid AND tier = 'curated' AND relevant))::INT) AS c FROM vgold)
SELECT hybrid >= lexical + 5 AS recall_gain, p IS NULL OR p >= 0.5 AS advisory_precision_ok, c >= 95 AS trust_compliance, regressions = 0 AS no_regression,
  hybrid >= lexical + 5 AND (p IS NULL OR p >= 0.5) AND c >= 95 AND regressions = 0 AS promote, round(lexical, 6) AS lexical_recall, round(hybrid, 6) AS hybrid_recall, round(p, 6) AS advisory_precision, round(c, 6) AS compliance, regressions FROM m, p, c""")
def promotion_bar(spark, d):
    """The bar from measured inputs: both rankings of sessions, the precision of lower tiers, what was at hand to answer from, and what fusion lost."""
    ranked = _ranked(spark, d)
    gold = _asked(spark, d).select("qid", F.floor(F.col("qid") / 100).cast("string").alias("session"))
    recall = lambda name: evals.recall(ranked[name], gold, (5,)).select((F.col("recall_all_5") * 100).alias(f"{name}_recall"))
    as_slug = lambda df: df.withColumnRenamed("session", "slug")
    lost = evals.regressions(as_slug(ranked["lexical"]), as_slug(ranked["hybrid"]), as_slug(gold)).withColumnRenamed("n", "regressions")
    hits = _vector_hits(spark, d)
    precision = evals.advisory_precision(hits).withColumnRenamed("precision", "advisory_precision")
    asked = adapters.table(spark, d, "embeddings").where("vec_id % 100 = 0")
    cases = asked.select(F.col("vec_id").alias("qid"), F.lit("right").alias("correct_slug"), F.lit("note").alias("wrong_tier"))
    held = evals.compliance(hits.withColumn("slug", F.when(F.col("relevant"), "right").otherwise("other")), cases)
    row = recall("lexical")
    for one in (recall("hybrid"), lost, precision, held):  # one row each
        row = row.join(F.broadcast(one))
    row = materialize(row, "bar")
    shown = [F.round(c, 6).alias(c) for c in ("lexical_recall", "hybrid_recall", "advisory_precision", "compliance")]
    return evals.promotion(row).join(F.broadcast(row.select(*shown, "regressions")))


# payloads as JSON ---------------------------------------------------------------------------


@query("""p AS (SELECT seq, (CASE k % 8 WHEN 0 THEN '{"suggestion_seq":' || seq || ',"accepted_slug":"' || slug || '"}' WHEN 1 THEN '{"suggestion_seq":1,"note":"x","accepted_slug":"' || slug || '"}'
  WHEN 2 THEN '{"accepted_slug":"' || slug || '"}' WHEN 3 THEN '{"suggestion_seq":"' || seq || '","accepted_slug":"' || slug || '"}' WHEN 4 THEN '{"suggestion_seq":' || (k - 50) || '.5,"accepted_slug":"a-b"}'
  WHEN 5 THEN '{"suggestion_seq":' || (seq + k - 50) || ',"accepted_slug":"a-b"}' WHEN 6 THEN '{"suggestion_seq":1}' ELSE '{"suggestion_seq":1,"accepted_slug":"Bad ' || slug || '"}' END)::JSON AS j FROM log)
SELECT seq, CASE WHEN len(list_filter(json_keys(j), lambda x: x NOT IN ('suggestion_seq', 'accepted_slug'))) > 0 THEN list_filter(json_keys(j), lambda x: x NOT IN ('suggestion_seq', 'accepted_slug'))[1] || ':unknown_field'
  WHEN NOT list_contains(json_keys(j), 'suggestion_seq') THEN 'suggestion_seq:required'
  WHEN json_type(j, '$.suggestion_seq') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR (j->>'suggestion_seq')::DOUBLE <> floor((j->>'suggestion_seq')::DOUBLE) OR (j->>'suggestion_seq')::DOUBLE < 1 THEN 'suggestion_seq:must_be_safe_positive_integer'
  WHEN (j->>'suggestion_seq')::DOUBLE > seq - 1 THEN 'suggestion_seq:future_or_unknown_seq' WHEN NOT list_contains(json_keys(j), 'accepted_slug') THEN 'accepted_slug:required'
  WHEN length(j->>'accepted_slug') NOT BETWEEN 2 AND 40 THEN 'accepted_slug:length_out_of_range' WHEN NOT regexp_matches(j->>'accepted_slug', '^[a-z0-9]+(-[a-z0-9]+)*$') THEN 'accepted_slug:slug_regex_mismatch' END AS reason FROM p""")
def accepted_rejects(spark, d):
    """Payloads of accepted suggestions in eight forms, offered when the number before their own was the last."""
    k, seq, slug = F.col("k"), F.col("seq").cast("string"), F.col("slug")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    payload = (
        F.when(k % 8 == 0, text('{"suggestion_seq":', seq, ',"accepted_slug":"', slug, '"}')).when(k % 8 == 1, text('{"suggestion_seq":1,"note":"x","accepted_slug":"', slug, '"}'))
        .when(k % 8 == 2, text('{"accepted_slug":"', slug, '"}')).when(k % 8 == 3, text('{"suggestion_seq":"', seq, '","accepted_slug":"', slug, '"}'))
        .when(k % 8 == 4, text('{"suggestion_seq":', (k - 50).cast("string"), '.5,"accepted_slug":"a-b"}')).when(k % 8 == 5, text('{"suggestion_seq":', (F.col("seq") + k - 50).cast("string"), ',"accepted_slug":"a-b"}'))
        .when(k % 8 == 6, F.lit('{"suggestion_seq":1}')).otherwise(text('{"suggestion_seq":1,"accepted_slug":"Bad ', slug, '"}'))
    )
    return _log(spark, d).select("seq", admission.accepted_reason(payload, F.col("seq") - 1).alias("reason"))
