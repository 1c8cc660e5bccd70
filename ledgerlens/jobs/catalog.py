"""The registered queries over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical, vectors
from ..functions import text as T
from ..operators import admission, blocks, chain, expansion, near_texts, preconditions, projection, proposals, retrieval, similarity, state
from ..schema import matrix
from ..sources import adapters, jsonl, markdown
from ..sources.storage import scratch_path
from ..streaming import incremental
from . import answers, evals, imports, liveness, reading, transcripts

PRINCIPAL = "p1"


def _log(spark, d):
    return adapters.log(adapters.table(spark, d, "events"))


def _control(spark, d):
    return adapters.control(adapters.table(spark, d, "events"))


def _units(spark, d):
    return adapters.units(adapters.table(spark, d, "documents"), adapters.table(spark, d, "labels"))


def _now_ms(log: DataFrame) -> int:
    return log.agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0] or 0


def _vectors(spark, d):
    """Vectors keyed like the units of the same number."""
    v = adapters.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return v.join(_units(spark, d).select("doc_id", "key"), "doc_id")


def _asked(spark, d):
    """The stated queries in words: benchmark items whose number is divisible by 100, in full."""
    return adapters.table(spark, d, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("qid"), "text")


def _asked_vectors(spark, d):
    """The stated queries as vectors: those whose number is divisible by 100."""
    return adapters.table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        name = f.__name__
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = "WITH " + ",\n".join([*COMMON, sql.strip()]) if sql.lstrip().split(None, 1)[0] != "SELECT" else "WITH " + ",\n".join(COMMON) + "\n" + sql
        return f

    return put


_STOP = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(T.PT_STOP + T.EN_STOP)) + "]"


def _tok(x: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), '[^{T.WORD_CHARS}\\s]', ' ', 'g'), '\\s+'),"
        f" lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))"
    )


_READER_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(content), '[\\s\\p{P}]+'), lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(f"'{w}'" for w in dict.fromkeys(T.READER_STOP)) + ")))"


COMMON = [
    r"""log AS (
  SELECT event_id AS pos, event_id + 1 AS seq, 'user-' || user_id AS slug, 'p' || (user_id % 7) AS principal, ts, value,
         CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k, event_type,
         CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 'write_event'
              WHEN event_type = 'signup' THEN CASE CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) % 3 WHEN 0 THEN 'TOPIC_METADATA_SET' WHEN 1 THEN 'TOPIC_CURATED' ELSE 'TOPIC_VERIFIED' END
              WHEN CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) < 50 THEN 'TOPIC_BULLETS_RETIRED'
              WHEN CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) < 70 THEN 'TOPIC_SUGGESTED'
              WHEN CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) < 85 THEN 'TOPIC_SUGGESTION_ACCEPTED'
              ELSE 'TOPIC_SUGGESTION_DISMISSED' END AS type,
         CASE event_type WHEN 'purchase' THEN 'CURATED' WHEN 'view' THEN 'SOURCE' WHEN 'click' THEN 'FACT' END AS tag,
         event_type || ' number ' || CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) || '.' AS content,
         1 + CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) % 30 AS cooldown_days
  FROM events)""",
    """refs AS (
  SELECT *, max(CASE WHEN tag = 'CURATED' THEN seq END) OVER w AS last_curated,
         max(CASE WHEN type = 'TOPIC_SUGGESTED' THEN seq END) OVER w AS last_suggested
  FROM log WINDOW w AS (PARTITION BY slug ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    """units AS (
  SELECT source || '::' || (doc_id + 1) || '::0' AS key, source AS slug, doc_id + 1 AS seq, doc_id,
         CASE quality WHEN 1 THEN 'CURATED' WHEN 0 THEN 'FACT' ELSE 'SOURCE' END AS tag,
         coalesce(toxic, 0) = 1 AS retired, coalesce(text, '') AS content
  FROM documents LEFT JOIN labels USING (doc_id))""",
    """live AS (
  SELECT *, CASE tag WHEN 'CURATED' THEN 'curated' WHEN 'SOURCE' THEN 'source' ELSE 'note' END AS tier FROM units WHERE NOT (retired AND tag = 'CURATED'))""",
    """acl AS (SELECT DISTINCT slug, ['p' || (CAST(regexp_extract(slug, '(\\d+)', 1) AS BIGINT) % 3), 'operator'] AS readers FROM units)""".replace("\\\\", "\\"),
    """retired AS (
  SELECT DISTINCT r.pos, r.slug, s.superseded_seq, coalesce(w.pos < r.pos, false) AS effective
  FROM (SELECT * FROM refs WHERE type = 'TOPIC_BULLETS_RETIRED') r
  CROSS JOIN LATERAL (SELECT unnest(list_distinct([coalesce(r.last_curated, 0), r.seq - 1])) AS superseded_seq) s
  LEFT JOIN log w ON w.tag = 'CURATED' AND w.slug = r.slug AND w.seq = s.superseded_seq)""",
    """resolved AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY last_suggested ORDER BY pos) AS rn FROM refs
                 WHERE type IN ('TOPIC_SUGGESTION_ACCEPTED', 'TOPIC_SUGGESTION_DISMISSED') AND last_suggested IS NOT NULL) WHERE rn = 1)""",
    """suggested AS (
  SELECT s.seq AS suggestion_seq, s.slug, s.ts, s.k,
         CASE WHEN r.seq IS NULL THEN 'pending' WHEN r.type = 'TOPIC_SUGGESTION_ACCEPTED' THEN 'accepted' ELSE 'dismissed' END AS status,
         r.seq AS resolver_seq, r.pos AS resolved_pos, r.cooldown_days, r.ts AS resolved_ts
  FROM log s LEFT JOIN resolved r ON r.last_suggested = s.seq WHERE s.type = 'TOPIC_SUGGESTED')""",
    """dismissed AS (
  SELECT replace(lower(d.slug), '-', '') AS slug_key, d.suggestion_seq, d.resolver_seq AS dismissal_seq,
         (epoch_us(d.resolved_ts) // 1000) + d.cooldown_days * 86400000 AS until_ms,
         (SELECT min(a.resolver_seq) FROM suggested a WHERE a.status = 'accepted' AND replace(lower(a.slug), '-', '') = replace(lower(d.slug), '-', '')
            AND a.resolved_pos > d.resolved_pos AND a.resolver_seq > d.resolver_seq) AS cleared_by_accept_seq
  FROM suggested d WHERE d.status = 'dismissed')""",
    """topics AS (
  SELECT slug, coalesce(max(CASE WHEN type = 'write_event' THEN seq END), min(seq)) AS last_updated_seq,
         count(*) FILTER (type = 'write_event') AS n_writes, max_by(k, pos) FILTER (type = 'TOPIC_METADATA_SET') AS meta_k,
         max(CASE WHEN type = 'TOPIC_CURATED' THEN seq END) AS curated_seq, max(CASE WHEN type = 'TOPIC_VERIFIED' THEN seq END) AS verified_seq
  FROM log WHERE type IN ('write_event', 'TOPIC_METADATA_SET', 'TOPIC_CURATED', 'TOPIC_VERIFIED') GROUP BY slug)""",
]


# state ---------------------------------------------------------------------------------------

@query("SELECT slug, last_updated_seq, n_writes, meta_k, curated_seq, verified_seq FROM topics")
def topic_index_latest_wins(spark, d):
    return state.topics(_log(spark, d))


@query("""SELECT slug, string_agg(tag, ',' ORDER BY first) AS tags
FROM (SELECT slug, tag, min(pos) AS first FROM log WHERE type = 'write_event' GROUP BY slug, tag) GROUP BY slug""")
def event_tags_ordered(spark, d):
    return state.ordered_tags(_log(spark, d))


@query("SELECT slug, min_by(principal, pos) || ',operator' AS readers FROM log WHERE type = 'write_event' GROUP BY slug")
def first_write_acl(spark, d):
    return state.first_write_acl(_log(spark, d))


@query("SELECT pos, slug, superseded_seq FROM retired WHERE effective")
def retire_temporal_join(spark, d):
    return state.retirements(_log(spark, d)).where("effective").drop("effective")


@query("SELECT pos, slug, superseded_seq FROM retired WHERE NOT effective")
def retire_skips(spark, d):
    return state.retirements(_log(spark, d)).where("not effective").drop("effective")


@query("SELECT suggestion_seq, slug, status, resolver_seq FROM suggested")
def suggestion_lifecycle(spark, d):
    return state.suggestions(_log(spark, d)).select("suggestion_seq", "slug", "status", "resolver_seq")


@query("SELECT status, count(*) AS n FROM suggested GROUP BY status")
def suggestion_status_counts(spark, d):
    return state.suggestions(_log(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT slug_key, suggestion_seq, dismissal_seq, until_ms FROM dismissed")
def dismissal_history(spark, d):
    return state.dismissals(_log(spark, d)).drop("cleared_by_accept_seq")


@query("SELECT slug_key, dismissal_seq, cleared_by_accept_seq FROM dismissed WHERE cleared_by_accept_seq IS NOT NULL")
def cooldown_cleared(spark, d):
    return state.dismissals(_log(spark, d)).where("cleared_by_accept_seq is not null").select("slug_key", "dismissal_seq", "cleared_by_accept_seq")


@query("""SELECT slug_key, dismissal_seq, until_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY slug_key ORDER BY until_ms DESC, dismissal_seq) AS rn FROM dismissed WHERE cleared_by_accept_seq IS NULL) WHERE rn = 1""")
def cooldowns(spark, d):
    return state.cooldowns(_log(spark, d))


@query("""declared AS (SELECT principal, min(pos) AS declared_pos FROM log GROUP BY principal)
SELECT d.principal, declared_pos, coalesce((SELECT max_by(CASE WHEN k % 10 = 0 THEN 'tombstoned' WHEN k % 2 = 0 THEN 'active' ELSE 'disabled' END, pos)
  FROM log l WHERE l.principal = d.principal AND type = 'TOPIC_VERIFIED' AND pos > declared_pos), 'active') AS status FROM declared d""")
def principals_status(spark, d):
    return state.principals(_log(spark, d))


_CONTROL = """control AS (SELECT pos, 'feature-' || k AS feature, CASE k % 5 WHEN 0 THEN 'FEATURE_ACTIVE' WHEN 1 THEN 'FEATURE_ROLLED_BACK' WHEN 2 THEN 'RECOVERY_MODE_ENTERED' WHEN 3 THEN 'RECOVERY_MODE_EXITED' ELSE 'NOVEL' END AS type FROM
  (SELECT pos, k, event_type FROM log) WHERE event_type = 'signup')"""


@query(_CONTROL + """ SELECT feature, max_by(type = 'FEATURE_ACTIVE', pos) AS active FROM control WHERE type LIKE 'FEATURE%' GROUP BY feature""")
def flags_last(spark, d):
    return state.flags(_control(spark, d))


@query(_CONTROL + """ SELECT CASE max_by(type, pos) WHEN 'RECOVERY_MODE_ENTERED' THEN 'recovery' ELSE 'normal' END AS mode FROM control WHERE type LIKE 'RECOVERY%'""")
def mode_last(spark, d):
    return state.mode(_control(spark, d))


@query("SELECT max(pos) AS pos, max_by(seq, pos) AS last_seq FROM log")
def log_tail(spark, d):
    return state.tail(_log(spark, d))


@query("""cut AS (SELECT * FROM log WHERE pos < coalesce((SELECT min(pos) FROM log WHERE seq > (SELECT max(seq) // 2 FROM log)), 1000000000000))
SELECT slug, count(*) AS n_writes, max(seq) AS last_seq FROM cut WHERE type = 'write_event' GROUP BY slug""")
def as_of_state(spark, d):
    """The state at half the numbers given out so far."""
    log = _log(spark, d)
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2
    return state.writes(state.as_of(log, half)).groupBy("slug").agg(F.count("*").alias("n_writes"), F.max("seq").alias("last_seq"))


@query("SELECT slug || ':' || k AS intent_id, min(pos) AS first_pos, max(seq) AS last_seq FROM log GROUP BY 1 ORDER BY first_pos DESC, intent_id LIMIT 100000")
def dedup_witness(spark, d):
    return state.witnesses(_log(spark, d))


@query("SELECT slug, last_updated_seq, n_writes FROM topics ORDER BY last_updated_seq DESC, slug LIMIT 20")
def orientation_topn(spark, d):
    return retrieval.orientation(state.topics(_log(spark, d)).select("slug", "last_updated_seq", "n_writes"), 20)


@query("SELECT tag, count(*) AS n FROM log WHERE type = 'write_event' GROUP BY tag ORDER BY n DESC, tag LIMIT 50")
def tag_distribution(spark, d):
    return state.writes(_log(spark, d)).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(50)


@query("SELECT slug, min(seq) AS first_seq, max(seq) AS last_seq FROM log WHERE seq > 0 GROUP BY slug")
def seq_range(spark, d):
    return _log(spark, d).where("seq > 0").groupBy("slug").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


# admission and chain ----------------------------------------------------------------------------

@query("""control AS (SELECT CASE k % 5 WHEN 0 THEN 'FEATURE_ACTIVE' WHEN 1 THEN 'FEATURE_ROLLED_BACK' WHEN 2 THEN 'RECOVERY_MODE_ENTERED' WHEN 3 THEN 'RECOVERY_MODE_EXITED' ELSE 'NOVEL' END AS type FROM log WHERE event_type = 'signup'),
every AS (SELECT type FROM log UNION ALL SELECT type FROM control),
place AS (SELECT socket, mode FROM (SELECT unnest(['standard', 'admin']) AS socket), (SELECT unnest(['normal', 'install_freeze', 'read_only', 'recovery']) AS mode))
SELECT type, socket, mode, CASE WHEN type = 'NOVEL' THEN 'UNKNOWN_EVENT_TYPE_NOT_REGISTERED'
  WHEN mode = 'normal' AND (socket = 'admin' OR type = 'write_event' OR type LIKE 'TOPIC%') THEN NULL
  WHEN socket = 'admin' AND type LIKE 'FEATURE%' AND mode IN ('install_freeze', 'recovery') THEN NULL
  WHEN socket = 'admin' AND type = 'RECOVERY_MODE_ENTERED' AND mode = 'read_only' THEN NULL
  WHEN socket = 'admin' AND type = 'RECOVERY_MODE_EXITED' AND mode = 'recovery' THEN NULL
  ELSE 'EVENT_NOT_ADMISSIBLE' END AS reject_code, count(*) AS n FROM every, place GROUP BY ALL""")
def admission_matrix(spark, d):
    entries = _log(spark, d).select("seq", "type").unionByName(_control(spark, d).select("seq", "type"))
    return admission.by_matrix(entries, matrix(spark)).groupBy("type", "socket", "mode", "reject_code").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN content = '' THEN 'content:required' WHEN contains(content, 'retrieval_origin') THEN 'payload:retrieval_origin'
  WHEN length(content) > CASE tag WHEN 'SOURCE' THEN 200000 WHEN 'CURATED' THEN 50000 ELSE 500 END THEN 'content:length_out_of_range'
  WHEN tag = 'FACT' AND regexp_matches(content, '[\\r\\n]') THEN 'content:must_be_single_line_for_tag' END AS reason FROM units""".replace("\\\\", "\\"))
def payload_rejects(spark, d):
    u = _units(spark, d)
    none = F.lit(None).cast("string")
    return u.select("doc_id", admission.write_payload_reason(F.col("slug"), F.col("content"), F.col("tag"), none, none).alias("reason"))


@query("""SELECT seq, slug, CASE WHEN NOT known THEN 'SLUG_NOT_ADMITTED' END AS reject_code FROM (
  SELECT *, coalesce(count(*) FILTER (type IN ('write_event', 'TOPIC_METADATA_SET')) OVER (PARTITION BY slug ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS known FROM log)
WHERE type = 'write_event'""")
def slug_admissible_staged(spark, d):
    return admission.slug_admissible(_log(spark, d))


@query("SELECT DISTINCT slug FROM log WHERE type IN ('write_event', 'TOPIC_METADATA_SET')")
def admissible_slugs(spark, d):
    return admission.admissible_slugs(_log(spark, d))


@query("""ok AS (SELECT DISTINCT slug FROM log WHERE type = 'TOPIC_METADATA_SET')
SELECT coalesce(ok.slug, 'general') AS slug, ok.slug IS NULL AS rerouted, count(*) AS n FROM log LEFT JOIN ok USING (slug) WHERE type = 'write_event' GROUP BY ALL""")
def extract_reroute(spark, d):
    log = _log(spark, d)
    ok = log.where("type = 'TOPIC_METADATA_SET'").select("slug").distinct()
    return admission.rerouted(state.writes(log), ok).groupBy("slug", "rerouted").agg(F.count("*").alias("n"))


def _line_sql(prev: str, t: str = "") -> str:
    """An entry's canonical line: its keys in order."""
    parts = [
        '{"hash_prev":"', prev, '","intent_id":"', f"{t}slug", ":", f"{t}pos", '","is_state_bearing":true,"payload":{"content":"', f"{t}content", '","slug":"', f"{t}slug",
        '","tag":"', f"coalesce({t}tag, 'NONE')", '"},"principal":"', f"{t}principal", '","schema_version":"v12.5.0","seq":', f"{t}i", ',"ts":"', f"strftime({t}ts, '%Y-%m-%dT%H:%M:%S')",
        'Z","type":"', f"{t}type", '"}',
    ]
    return " || ".join(x if i % 2 else f"'{x}'" for i, x in enumerate(parts))


_CHAIN = f"""n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY pos) AS i FROM log),
chain AS (WITH RECURSIVE c AS (
  SELECT slug, pos, i, repeat('0', 64) AS hash_prev, sha256({_line_sql("repeat('0', 64)")}) AS self_hash FROM n WHERE i = 1
  UNION ALL
  SELECT n.slug, n.pos, n.i, c.self_hash, sha256({_line_sql("c.self_hash", "n.")}) FROM c JOIN n ON n.slug = c.slug AND n.i = c.i + 1) SELECT * FROM c)"""


def _entries(spark, d):
    """Entries of each topic as a log of its own."""
    payload = F.to_json(F.struct("slug", F.coalesce("tag", F.lit("NONE")).alias("tag"), "content"))
    ts = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("ts")
    intent = F.concat_ws(":", "slug", "pos").alias("intent_id")
    return _log(spark, d).select(F.col("slug").alias("log"), "pos", "type", intent, "principal", ts, payload.alias("payload"))


def _written(spark, d):
    """Each topic's entries, chained."""
    return chain.written(_entries(spark, d))


@query(_CHAIN + " SELECT slug AS log, pos, i AS seq, hash_prev, self_hash FROM chain")
def chain_links(spark, d):
    return _written(spark, d).select("log", "pos", "seq", "hash_prev", "self_hash")


# every 97th line is changed after it was written, every 89th is lost
_DAMAGED = _CHAIN + """, d AS (SELECT slug AS log, pos, hash_prev, CASE WHEN pos % 97 = 50 THEN 'changed' ELSE self_hash END AS self_hash, i FROM chain WHERE pos % 89 <> 40)"""


def _damaged(spark, d):
    changed = F.when(F.col("pos") % 97 == 50, F.lit("changed")).otherwise(F.col("self_hash"))
    return _written(spark, d).where("pos % 89 <> 40").withColumn("self_hash", changed)


@query(_DAMAGED + """, p AS (SELECT *, lag(self_hash) OVER (PARTITION BY log ORDER BY pos) AS before FROM d)
SELECT log, pos FROM p WHERE hash_prev <> coalesce(before, repeat('0', 64))""")
def chain_breaks(spark, d):
    r = chain.previous(_damaged(spark, d), "self_hash", "before")
    return r.where(F.col("hash_prev") != F.coalesce("before", F.lit(chain.GENESIS))).select("log", "pos")


@query(_DAMAGED + """, w AS (WITH RECURSIVE a AS (
  SELECT log, min(pos) AS pos, min_by(self_hash, pos) AS self_hash FROM d WHERE hash_prev = repeat('0', 64) GROUP BY log
  UNION ALL
  SELECT d.log, min(d.pos), min_by(d.self_hash, d.pos) FROM a JOIN d ON d.log = a.log AND d.hash_prev = a.self_hash AND d.pos > a.pos GROUP BY d.log) SELECT * FROM a)
SELECT log, count(*) AS n, max(pos) AS last FROM w GROUP BY log""")
def chain_verify(spark, d):
    held = chain.accepted(_damaged(spark, d).select("log", "pos", "hash_prev", "self_hash"))
    return held.groupBy("log").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


@query(_DAMAGED + """, w AS (WITH RECURSIVE a AS (
  SELECT log, min(pos) AS pos, min_by(self_hash, pos) AS self_hash FROM d WHERE hash_prev = repeat('0', 64) GROUP BY log
  UNION ALL
  SELECT d.log, min(d.pos), min_by(d.self_hash, d.pos) FROM a JOIN d ON d.log = a.log AND d.hash_prev = a.self_hash AND d.pos > a.pos GROUP BY d.log) SELECT * FROM a),
t AS (SELECT log, max_by(i, pos) AS tail_seq FROM d GROUP BY log), l AS (SELECT w.log, max_by(d.i, d.pos) AS last_seq FROM w JOIN d USING (log, pos) GROUP BY w.log)
SELECT log, coalesce(last_seq, 0) AS last_seq, tail_seq, coalesce(last_seq, 0) = tail_seq AS safe FROM t LEFT JOIN l USING (log)""")
def tail_safety(spark, d):
    """Whether each damaged log may be appended to."""
    rows = _damaged(spark, d)
    return chain.tail_safe(rows, chain.accepted(rows.select("log", "pos", "hash_prev", "self_hash")))


@query("""g AS (SELECT slug, list(seq ORDER BY seq) AS seqs FROM log WHERE type = 'write_event' GROUP BY slug)
SELECT slug, substr(sha256('[' || array_to_string(seqs, ',') || ']'), 1, 16) AS fingerprint, true AS ascends FROM g""")
def support_fingerprint(spark, d):
    g = state.writes(_log(spark, d)).groupBy("slug").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))
    return g.select("slug", T.support_fingerprint(F.col("seqs")).alias("fingerprint"), T.ascending(F.col("seqs")).alias("ascends"))


# retrieval ------------------------------------------------------------------------------------

@query("SELECT key, CASE WHEN tag = 'CURATED' AND retired THEN NULL WHEN tag = 'CURATED' THEN 'curated' WHEN tag = 'SOURCE' THEN 'source' ELSE 'note' END AS tier FROM units")
def tier_classify(spark, d):
    return _units(spark, d).select("key", retrieval.tier(F.col("tag"), F.col("retired")).alias("tier"))


@query("SELECT tier, count(*) AS n FROM live GROUP BY tier")
def tier_counts(spark, d):
    return retrieval.live(_units(spark, d)).groupBy("tier").agg(F.count("*").alias("n"))


@query("SELECT key FROM live WHERE tier = 'curated'")
def scope_filter(spark, d):
    return retrieval.live(_units(spark, d)).where(retrieval.in_scope(F.col("tier"))).select("key")


@query("SELECT key FROM live JOIN acl USING (slug) WHERE list_contains(readers, 'p1')")
def acl_semi(spark, d):
    u = _units(spark, d)
    return retrieval.readable(retrieval.live(u), adapters.acl(u), PRINCIPAL).select("key")


@query("""asked AS (SELECT DISTINCT lang || ':' || (doc_id % 50) AS ask_id, source AS slug FROM documents)
SELECT ask_id, bool_and(coalesce(list_contains(readers, 'p1'), false)) AS allowed FROM asked LEFT JOIN acl USING (slug) GROUP BY ask_id""")
def acl_intersection(spark, d):
    """What each language and residue of document numbers asks for: one to a few sources each, over all documents."""
    ask = F.concat_ws(":", "lang", (F.col("doc_id") % 50).cast("string")).alias("ask_id")
    asked = adapters.table(spark, d, "documents").select(ask, F.col("source").alias("slug")).distinct()
    return retrieval.authorized(asked, adapters.acl(_units(spark, d)), PRINCIPAL)


@query("SELECT key FROM units WHERE NOT (retired AND tag = 'CURATED')")
def retired_anti(spark, d):
    u = _units(spark, d)
    return u.join(u.where("retired and tag = 'CURATED'").select("seq"), "seq", "left_anti").select("key")


@query(f"SELECT key, len({_tok('content')}) AS n_tokens, len(list_distinct({_tok('content')})) AS n_distinct FROM units")
def tokenize_counts(spark, d):
    t = T.tokens(F.col("content"))
    return _units(spark, d).select("key", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"SELECT item_id, CASE WHEN len({_tok('text')}) = 0 THEN text ELSE array_to_string({_tok('text')}, ' ') END AS q FROM benchmark")
def normalize_query(spark, d):
    return adapters.table(spark, d, "benchmark").select("item_id", T.normalized_query(F.col("text")).alias("q"))


@query(r"""n AS (SELECT key, len(regexp_extract_all(content, '[\p{L}\p{N}_]+|[^\s]'))::BIGINT AS n FROM units),
c AS (SELECT key, n, unnest(CASE WHEN n <= 512 THEN [0] ELSE range(0, greatest(ceil((n - 256) / 192.0), 0)::BIGINT + 1) END) AS chunk_index FROM n)
SELECT key, chunk_index::BIGINT AS chunk_index, (CASE WHEN n <= 512 THEN 0 ELSE chunk_index * 192 END)::BIGINT AS token_start, (CASE WHEN n <= 512 THEN n ELSE least(chunk_index * 192 + 256, n) END)::BIGINT AS token_end FROM c""")
def chunk_windows(spark, d):
    n = F.size(T.positional_tokens(F.col("content")))
    u = _units(spark, d).select("key", n.alias("n")).select("key", F.explode(T.windows(F.col("n"))).alias("w"))
    return u.select("key", *[F.col(f"w.{c}").cast("long").alias(c) for c in ("chunk_index", "token_start", "token_end")])


# edit distance counts characters: accented ones, two bytes each, get a stand-in of one byte
_FLAT = "translate({}, 'àáâãéêíóôõúç', '!#$%&()*+,-.')"
_ASKED = f"""asked AS (SELECT item_id AS qid, unnest(CASE WHEN len({_tok('text')}) > 0 THEN list_distinct({_tok('text')}) ELSE [lower(text)] END) AS q FROM benchmark WHERE item_id % 100 = 0)"""
_UNIT_FIELDS = "SELECT key, 'content' AS field, content AS text FROM {base} UNION ALL SELECT key, 'slug', slug FROM {base}"


def _close(fuzzy: float) -> str:
    q, t = _FLAT.format("q"), _FLAT.format("term")
    most = f"least(round(length(q) * {fuzzy}), 6)"
    return f"""(SELECT q, term, CASE WHEN q = term THEN 1.0 WHEN starts_with(term, q) THEN 0.375 * length(term) / (length(term) + 0.3 * (length(term) - length(q)))
  ELSE 0.45 * length(term) / (length(term) + levenshtein({q}, {t})) END AS weight
  FROM (SELECT DISTINCT q FROM asked), (SELECT DISTINCT term FROM post)
  WHERE starts_with(term, q) OR (abs(length(q) - length(term)) <= {most} AND levenshtein({q}, {t}) <= {most}))"""


def _lexical_sql(mode: str, fuzzy: float | None = None, fields: str = _UNIT_FIELDS.format(base="live"), boosts=retrieval.UNIT_BOOSTS, limit: int = 100) -> str:
    terms = "(SELECT DISTINCT q, q AS term, 1.0 AS weight FROM asked)" if fuzzy is None else _close(fuzzy)
    boost = "CASE field " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in boosts.items()) + " END"
    which = {"or": "true", "auto": "matched = wanted OR most < wanted"}[mode]
    return f"""{_ASKED},
fld AS ({fields}),
post AS (SELECT key, field, term, count(*) AS tf FROM (SELECT key, field, unnest({_tok('text')}) AS term FROM fld) GROUP BY ALL),
lens AS (SELECT key, field, count(term) AS length FROM (SELECT DISTINCT key, field FROM fld) LEFT JOIN post USING (key, field) GROUP BY ALL),
st AS (SELECT field, count(*) AS n, greatest(avg(length), 1.0) AS mean FROM lens GROUP BY field),
hits AS (SELECT * FROM post JOIN {terms} USING (term)),
df AS (SELECT field, term, count(DISTINCT key) AS df FROM hits GROUP BY ALL),
each AS (SELECT q, key, sum({boost} * weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * length / mean)) + 0.5)) AS s
         FROM hits JOIN lens USING (key, field) JOIN df USING (field, term) JOIN st USING (field) GROUP BY ALL),
sc AS (SELECT *, max(matched) OVER (PARTITION BY qid) AS most FROM (SELECT qid, key, sum(s) * count(*) AS score, count(*) AS matched FROM each JOIN asked USING (q) GROUP BY ALL)
       JOIN (SELECT qid, count(*) AS wanted FROM asked GROUP BY qid) USING (qid)),
lex AS (SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rank FROM sc WHERE {which} QUALIFY rank <= {limit})"""


def _lexical(spark, d, **how):
    return retrieval.lexical(retrieval.index(retrieval.fields(retrieval.live(_units(spark, d)))), _asked(spark, d), **how)


@query(_lexical_sql("or") + " SELECT qid, key, round(score, 6) AS score, rank FROM lex")
def lexical_topk(spark, d):
    return _lexical(spark, d, fuzzy=None, mode="or").withColumn("score", F.round("score", 6))


@query(_lexical_sql("auto", 0.3) + " SELECT qid, key, round(score, 6) AS score, rank FROM lex")
def lexical_and_or(spark, d):
    return _lexical(spark, d, mode="auto").withColumn("score", F.round("score", 6))


@query(f"""{_ASKED}, post AS (SELECT DISTINCT unnest({_tok('content')}) AS term FROM live)
SELECT q, term, round(weight, 9) AS weight FROM {_close(0.3)}""")
def fuzzy_prefix_terms(spark, d):
    rows = retrieval.live(_units(spark, d)).select("key", F.lit("content").alias("field"), F.col("content").alias("text"))
    found = expansion.expanded(retrieval.index(rows).postings, retrieval.query_terms(_asked(spark, d)), retrieval.UNIT_FUZZY)
    return found.withColumn("weight", F.round("weight", 9))


_STRETCH = r"(?s)^\s+|(?:(?:[\p{L}\p{N}_]+|[^\s])\s*){1,64}"


def _chunk_sql(base: str) -> str:
    return f"""pieces AS (SELECT *, regexp_extract_all(content, '{_STRETCH}') AS p, len(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+|[^\\s]'))::BIGINT AS n FROM {base}),
led AS (SELECT *, CASE WHEN len(p) > 0 AND regexp_matches(p[1], '^\\s') THEN 1 ELSE 0 END AS lead FROM pieces),
cut AS (SELECT *, unnest(CASE WHEN n <= 512 THEN [0] ELSE range(0, greatest(ceil((n - 256) / 192.0), 0)::BIGINT + 1) END) AS i FROM led),
chunk AS (SELECT doc_id, slug, tier, i AS chunk_index, regexp_replace(key, '::0$', '::') || i AS key,
  CASE WHEN n <= 512 THEN 0 ELSE coalesce(list_sum(list_transform(p[1:lead + 3 * i], lambda x: length(x))), 0) END::BIGINT AS char_start,
  CASE WHEN n <= 512 THEN content ELSE regexp_replace(array_to_string(p[lead + 3 * i + 1:lead + 3 * i + 4], ''), '\\s+$', '') END AS content FROM cut)"""


@query(_chunk_sql("live") + " SELECT key, chunk_index, char_start, char_start + length(content) AS char_end, md5(content) AS text_md5 FROM chunk")
def unit_chunks(spark, d):
    """Live units cut into overlapping windows, with each one's place and text."""
    c = retrieval.chunked(retrieval.live(_units(spark, d)))
    return c.select("key", *[F.col(x).cast("long").alias(x) for x in ("chunk_index", "char_start", "char_end")], F.md5("content").alias("text_md5"))


_COSINE = """qv AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
sims AS (SELECT qid, key, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * q[i])) AS score FROM embeddings JOIN {base} ON doc_id = vec_id, qv),
sem AS (SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rank FROM sims WHERE score >= 0.3 QUALIFY rank <= 100)"""


@query(_COSINE.format(base="units") + " SELECT qid, key, round(score, 6) AS score, rank FROM sem")
def cosine_topk(spark, d):
    return retrieval.cosine(_vectors(spark, d), _asked_vectors(spark, d)).withColumn("score", F.round("score", 6))


@query(_COSINE.format(base="units") + " SELECT qid, count(*) AS n, round(min(score), 6) AS least FROM sims WHERE score >= 0.3 GROUP BY qid")
def similarity_floor(spark, d):
    """How many vectors each query finds at or above the floor, without a limit."""
    v = _vectors(spark, d)
    found = retrieval.cosine(v, _asked_vectors(spark, d), limit=1 << 31)
    return found.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("least"))


@query(_lexical_sql("or") + "," + _COSINE.format(base="units") + """
SELECT qid, key, round(sum(s), 9) AS score FROM (SELECT qid, key, 0.5 / (60 + rank) AS s FROM lex UNION ALL SELECT qid, key, 1.0 / (60 + rank) FROM sem) GROUP BY qid, key""")
def rrf_weighted(spark, d):
    arms = {"L": _lexical(spark, d, fuzzy=None, mode="or"), "S": retrieval.cosine(_vectors(spark, d), _asked_vectors(spark, d))}
    return retrieval.fused(arms, {"L": 0.5, "S": 1.0}).withColumn("score", F.round("score", 9))


@query(_lexical_sql("or") + """ SELECT qid, key, round(1.0 / (60 + rank), 9) AS score FROM lex""")
def rrf_fusion(spark, d):
    return retrieval.fused({"L": _lexical(spark, d, fuzzy=None, mode="or")}).withColumn("score", F.round("score", 9))


@query("own AS (SELECT live.* FROM live JOIN acl USING (slug) WHERE list_contains(readers, 'p1')),\n" + _chunk_sql("own") + ",\n"
       + _lexical_sql("auto", 0.3, _UNIT_FIELDS.format(base="chunk")) + "," + _COSINE.format(base="own") + """,
f AS (SELECT qid, key, sum(s) AS score FROM (SELECT qid, key, 0.5 / (60 + rank) AS s FROM lex UNION ALL SELECT qid, key, 1.0 / (60 + rank) FROM sem) GROUP BY qid, key),
r AS (SELECT qid, key, slug, tier, content, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rank FROM f JOIN chunk USING (key)),
m AS (SELECT *, min(CASE WHEN tier = 'curated' THEN rank END) OVER (PARTITION BY qid) AS best FROM r)
SELECT m.qid, m.key, slug, tier, round(m.score, 9) AS score, m.rank, md5(substr(content, 1, 240)) AS preview, lex.rank AS lexical_rank, sem.rank AS semantic_rank,
       tier <> 'curated' AND m.rank < coalesce(best, 1000000000) AS tier_outranks_curated
FROM m LEFT JOIN lex ON lex.qid = m.qid AND lex.key = m.key LEFT JOIN sem ON sem.qid = m.qid AND sem.key = m.key WHERE m.rank <= 10""")
def hybrid_retrieve(spark, d):
    u = _units(spark, d)
    found = retrieval.retrieve(u, adapters.acl(u), PRINCIPAL, _asked(spark, d), _asked_vectors(spark, d), _vectors(spark, d), scope="all")
    return found.withColumn("score", F.round("score", 9)).withColumn("preview", F.md5("preview"))


_TOPIC_FIELDS = "SELECT slug AS key, 'content' AS field, content AS text FROM own UNION ALL SELECT DISTINCT slug, 'slug', slug FROM own UNION ALL SELECT DISTINCT slug, 'tags', tag FROM own"


@query("own AS (SELECT live.* FROM live JOIN acl USING (slug) WHERE list_contains(readers, 'p1')),\n"
       + _lexical_sql("or", 0.1, _TOPIC_FIELDS, retrieval.TOPIC_BOOSTS, 10) + " SELECT qid, key AS slug, round(score, 6) AS score, rank FROM lex")
def exact_lookup(spark, d):
    u = _units(spark, d)
    return retrieval.exact_lookup(u, adapters.acl(u), PRINCIPAL, _asked(spark, d)).withColumn("score", F.round("score", 6))


@query("""w AS (SELECT key FROM live), h AS (SELECT key FROM units JOIN embeddings ON vec_id = doc_id)
SELECT count(*) FILTER (h.key IS NULL) AS missing, count(*) FILTER (w.key IS NULL) AS orphaned, CASE WHEN count(*) FILTER (h.key IS NULL) > 0 THEN 'partial' WHEN count(*) FILTER (w.key IS NULL) > 0 THEN 'stale' ELSE 'fresh' END AS status
FROM w FULL JOIN h ON w.key = h.key""")
def cache_status(spark, d):
    return retrieval.cache_status(retrieval.live(_units(spark, d)), _vectors(spark, d))


# similarity -----------------------------------------------------------------------------------

@query(f"""s AS (SELECT doc_id, list_sort(list_distinct({_tok('text')})) AS t FROM documents),
c AS (SELECT min(doc_id) AS rep, t FROM s WHERE len(t) > 0 GROUP BY t),
e AS (SELECT rep, len(t) AS n, unnest(t) AS term FROM c),
b AS (SELECT x.rep AS a, y.rep AS b, x.n AS n, y.n AS m, count(*) AS shared FROM e x JOIN e y ON x.term = y.term AND x.rep < y.rep AND x.n >= 0.8 * y.n AND y.n >= 0.8 * x.n GROUP BY ALL)
SELECT a, b, round(shared / (n + m - shared), 9) AS similarity FROM b WHERE shared / (n + m - shared) >= 0.8""")
def near_dup_pairs(spark, d):
    docs = adapters.table(spark, d, "documents").select(F.col("doc_id").alias("i"), "text")
    return near_texts.near(docs, [])[0].select("a", "b", F.round("similarity", 9).alias("similarity"))


@query(f"""s AS (SELECT doc_id, list_sort(list_distinct({_tok('text')})) AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS rep FROM s WHERE len(t) > 0""")
def near_dup_classes(spark, d):
    return similarity.token_sets(adapters.table(spark, d, "documents"), "doc_id", "text")[1]


@query(f"""w AS (SELECT seq, slug, ts::DATE AS day, content, {_READER_TOK} AS t FROM log WHERE type = 'write_event'),
p AS (SELECT a.seq, CASE WHEN len(a.t) + len(b.t) = 0 THEN 1.0 ELSE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END AS sim
      FROM w a JOIN w b ON a.slug = b.slug AND a.day = b.day AND b.seq < a.seq)
SELECT seq, CASE WHEN max(sim) >= 0.8 THEN 'reject' ELSE 'warn' END AS verdict FROM p GROUP BY seq HAVING max(sim) >= 0.6""")
def dup_same_day_slug(spark, d):
    return similarity.same_day(_log(spark, d))


# projections ----------------------------------------------------------------------------------

@query("""kept AS (SELECT l.* FROM log l WHERE tag = 'CURATED' AND NOT EXISTS (SELECT 1 FROM retired r WHERE r.effective AND r.slug = l.slug AND r.superseded_seq = l.seq))
SELECT slug, md5(string_agg(trim(content), chr(10) || chr(10) ORDER BY pos)) AS text_md5 FROM kept GROUP BY slug""")
def layer2_text(spark, d):
    return projection.layer2(_log(spark, d)).select("slug", F.md5("text").alias("text_md5"))


@query("SELECT slug, md5(string_agg(trim(content), chr(10) || chr(10) ORDER BY ts DESC, seq DESC)) AS text_md5 FROM log WHERE tag = 'SOURCE' GROUP BY slug")
def layer3_text(spark, d):
    return projection.layer3(_log(spark, d)).select("slug", F.md5("text").alias("text_md5"))


@query("""t AS (SELECT slug, string_agg(trim(content), chr(10) || chr(10) ORDER BY ts DESC, seq DESC) AS text FROM log WHERE tag = 'SOURCE' GROUP BY slug)
SELECT slug, len(string_split(text, chr(10)))::BIGINT AS lines, round(strlen(text) / 1024.0, 1)::DOUBLE AS kb FROM t""")
def mech_fields(spark, d):
    m = projection.mechanical(projection.layer3(_log(spark, d)))
    return m.select("slug", F.col("lines").cast("long").alias("lines"), F.col("kb").cast("double").alias("kb"))


_INDEX = """idx AS (SELECT slug, ['reference', 'project', 'feedback', 'personal', 'archive', 'business', 'hobby'][meta_k % 7 + 1] AS kind, 'user, tag-' || (meta_k % 3) AS tags, 'active' AS status,
  'Topic ' || slug || ' has ' || n_writes || ' entries.' AS summary FROM topics WHERE meta_k IS NOT NULL AND meta_k % 5 <> 0)"""


@query(_INDEX + " SELECT slug, slug || ' | ' || kind || ' | ' || tags || ' | ' || status || ' | ' || summary AS line FROM idx")
def topic_index_lines(spark, d):
    return projection.topic_index(_log(spark, d))


@query(r"""s AS (SELECT doc_id, trim(content, ' ') AS t, regexp_extract(trim(content, ' '), '(?s)^.+?[.!?](?:\s+[A-Z]|\s*\z)') AS m FROM units)
SELECT doc_id, md5(CASE WHEN m <> '' THEN trim(regexp_replace(m, '\s+[A-Z]$|\s+$', ''), ' ')
  ELSE CASE WHEN length(trim(split_part(t, chr(10), 1), ' ')) <= 160 THEN trim(split_part(t, chr(10), 1), ' ')
       ELSE rtrim(substr(trim(split_part(t, chr(10), 1), ' '), 1, 160), ' ') || '…' END END) AS sentence FROM s""")
def first_sentence(spark, d):
    return _units(spark, d).select("doc_id", F.md5(T.first_sentence(F.col("content"))).alias("sentence"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS date, md5(string_agg('[' || tag || '] ' || slug || ': ' || content, chr(10) ORDER BY seq) || chr(10)) AS text_md5
FROM log WHERE type = 'write_event' GROUP BY 1""")
def event_log_by_date(spark, d):
    return projection.event_logs(_log(spark, d)).select("date", F.md5("text").alias("text_md5"))


@query("""SELECT date, count(*) FILTER (changed) AS changes FROM (
  SELECT strftime(ts, '%Y-%m-%d') AS date, coalesce(principal <> lag(principal) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY seq), true) AS changed FROM log WHERE type = 'write_event') GROUP BY date""")
def context_change(spark, d):
    """The day's writer stands for the comment its lines come under."""
    return projection.context_changes(projection.event_lines(_log(spark, d)).withColumnRenamed("principal", "comment"))


@query("""SELECT suggestion_seq, slug, floor(((SELECT max((epoch_us(ts) // 1000)) FROM log) - (epoch_us(ts) // 1000)) / 86400000)::BIGINT AS age_days
FROM suggested WHERE status = 'pending' ORDER BY ts, suggestion_seq LIMIT 10""")
def pending_envelope(spark, d):
    log = _log(spark, d)
    return projection.pending(log, _now_ms(log))


@query("""w AS (SELECT DISTINCT sha256(to_json(nfc_normalize(content))::VARCHAR) AS vector_key FROM live), h AS (SELECT DISTINCT sha256(to_json(nfc_normalize(content))::VARCHAR) AS vector_key FROM units JOIN embeddings ON vec_id = doc_id)
SELECT CASE WHEN h.vector_key IS NULL THEN 'embed' WHEN w.vector_key IS NULL THEN 'prune' ELSE 'reuse' END AS action, count(*) AS n FROM w FULL JOIN h ON w.vector_key = h.vector_key GROUP BY 1""")
def vector_store_delta(spark, d):
    u = _units(spark, d)
    key = canonical.key_of(F.col("content")).alias("vector_key")
    held = u.join(adapters.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return projection.vector_delta(retrieval.live(u).select(key), held.select(key))


# proposals ------------------------------------------------------------------------------------

@query("""SELECT seq, slug, tag FROM log WHERE type = 'write_event' AND slug IN (SELECT slug FROM topics WHERE meta_k IS NOT NULL)
AND (epoch_us(ts) // 1000) >= (SELECT max((epoch_us(ts) // 1000)) FROM log) - 30 * 86400000::BIGINT""")
def scan_events(spark, d):
    log = _log(spark, d)
    typed = state.topics(log).where("meta_k is not null").select("slug")
    return proposals.scan(log, typed, _now_ms(log)).select("seq", "slug", "tag")


@query("""e AS (SELECT seq, slug, count(*) OVER (PARTITION BY slug) AS n, sum(length(content) + 32) OVER (PARTITION BY slug) AS chars,
         row_number() OVER (PARTITION BY slug ORDER BY seq) - 1 AS i FROM log WHERE type = 'write_event'),
t AS (SELECT *, greatest(floor(1000 / (chars / n)), 2) AS target FROM e),
p AS (SELECT DISTINCT slug, floor((j + 0.5) * ((n - 2) / (target - 2)))::BIGINT AS mid FROM (SELECT DISTINCT slug, n, target, unnest(range(0, (target - 2)::BIGINT)) AS j FROM t WHERE target > 2))
SELECT seq, slug FROM t WHERE chars <= 1000 OR n <= 2 OR target >= n OR i = 0 OR i = n - 1 OR EXISTS (SELECT 1 FROM p WHERE p.slug = t.slug AND p.mid = t.i - 1)""")
def stratified_sample(spark, d):
    return proposals.sampled(state.writes(_log(spark, d)).select("seq", "slug", "content"), 1000)


_SUPPORTS = """w AS (SELECT slug, seq, pos, row_number() OVER (PARTITION BY slug ORDER BY pos) AS wn FROM log WHERE type = 'write_event'),
prop AS (SELECT slug || '-x' AS slug, seq FROM w WHERE wn <= 100),
sup AS (SELECT s.seq AS suggestion_seq, w.seq FROM (SELECT *, (SELECT count(*) FROM w WHERE w.slug = log.slug AND w.pos < log.pos) AS n FROM log WHERE type = 'TOPIC_SUGGESTED') s
        JOIN w ON w.slug = s.slug AND w.wn <= s.n AND w.wn > s.n - 100)"""


_PROPOSED = """fit AS (SELECT slug AS origin, list(seq ORDER BY seq) AS seqs, max(seq) AS m FROM w WHERE wn <= 100 GROUP BY slug),
made AS (SELECT CASE m % 7 WHEN 0 THEN origin WHEN 1 THEN upper(origin) ELSE origin || '-x' END AS slug, CASE WHEN m % 11 = 0 THEN '' ELSE 'About ' || origin END AS name,
  CASE WHEN m % 13 = 0 THEN NULL ELSE 'About ' || origin END AS description, origin, m,
  CASE m % 5 WHEN 0 THEN list_append(seqs, seqs[1]) WHEN 1 THEN list_prepend(0, seqs) WHEN 2 THEN list_append(seqs, 1000000000) ELSE seqs END AS seqs FROM fit)"""


def _proposed(log):
    """Each topic's proposal, some of them spoilt in ways that its latest support gives."""
    p = proposals.proposals(log).withColumn("m", F.array_max("seqs"))
    slug = F.when(F.col("m") % 7 == 0, F.col("origin")).when(F.col("m") % 7 == 1, F.upper("origin")).otherwise(F.col("slug"))
    seqs = F.when(F.col("m") % 5 == 0, F.array_append("seqs", F.get("seqs", F.lit(0)))).when(F.col("m") % 5 == 1, F.array_prepend("seqs", F.lit(0).cast("long")))
    seqs = seqs.when(F.col("m") % 5 == 2, F.array_append("seqs", F.lit(1_000_000_000).cast("long"))).otherwise(F.col("seqs"))
    name = F.when(F.col("m") % 11 == 0, "").otherwise(F.col("name"))
    return p.select(slug.alias("slug"), name.alias("name"), F.when(F.col("m") % 13 != 0, F.col("description")).alias("description"), "rationale", seqs.alias("seqs"), "m")


_NOW = "(SELECT max((epoch_us(ts) // 1000)) FROM log)"
_VERDICTS = _SUPPORTS + ",\n" + _PROPOSED + f""",
each AS (SELECT slug, i - 1 AS i, seqs[i] AS seq, list_position(seqs, seqs[i]) < i AS again FROM (SELECT slug, seqs, unnest(range(1, len(seqs) + 1)) AS i FROM made)),
cited AS (SELECT slug, min_by(x, i) AS cited FROM (SELECT e.slug, i, CASE WHEN e.seq < 1 THEN 'supporting_seq_invalid' WHEN again THEN 'supporting_seq_duplicate' WHEN w.seq IS NULL THEN 'supporting_seq_not_found'
  WHEN w.slug NOT IN (SELECT slug FROM topics WHERE meta_k IS NOT NULL) THEN 'supporting_seq_wrong_slug' END AS x FROM each e LEFT JOIN w ON w.seq = e.seq) WHERE x IS NOT NULL GROUP BY slug),
msup AS (SELECT suggestion_seq, count(*) OVER (PARTITION BY suggestion_seq) AS m, seq FROM sup),
sim AS (SELECT slug, suggestion_seq, count(*) AS shared, min(n) AS n, min(msup.m) AS m FROM (SELECT slug, len(seqs) AS n, unnest(seqs) AS seq FROM made) JOIN msup USING (seq) GROUP BY ALL),
near AS (SELECT * FROM sim WHERE shared / (n + m - shared) >= 0.65),
rep AS (SELECT near.slug, min(suggestion_seq) AS repeats FROM near JOIN suggested s USING (suggestion_seq) WHERE s.status = 'pending' GROUP BY near.slug),
gone AS (SELECT near.slug, min_by(slug_key, dismissal_seq) AS gone FROM near JOIN dismissed USING (suggestion_seq) WHERE cleared_by_accept_seq IS NULL AND until_ms > {_NOW} GROUP BY near.slug),
cool AS (SELECT DISTINCT slug_key FROM dismissed WHERE cleared_by_accept_seq IS NULL AND until_ms > {_NOW}),
verdicts AS (SELECT made.slug, CASE WHEN coalesce(name, '') = '' THEN 'name_missing' WHEN coalesce(description, '') = '' THEN 'description_missing'
  WHEN NOT regexp_matches(made.slug, '^[a-z0-9]+(-[a-z0-9]+)*$') THEN 'slug_invalid_regex' WHEN t.slug IS NOT NULL THEN 'slug_collision_with_topic_index' WHEN c.slug_key IS NOT NULL THEN 'cooldown_active'
  WHEN cited IS NOT NULL THEN cited WHEN repeats IS NOT NULL THEN 'support_overlap_pending_seq_' || repeats WHEN gone IS NOT NULL THEN 'support_overlap_cooldown_active_' || gone END AS reason, made.m, seqs
  FROM made LEFT JOIN topics t ON t.slug = made.slug AND t.meta_k IS NOT NULL LEFT JOIN cool c ON c.slug_key = replace(lower(made.slug), '-', '')
  LEFT JOIN cited ON cited.slug = made.slug LEFT JOIN rep ON rep.slug = made.slug LEFT JOIN gone ON gone.slug = made.slug)"""


def _verdicts(log):
    scan = state.topics(log).where("meta_k is not null").select("slug")
    return proposals.validated(_proposed(log), log, _now_ms(log), scan)


@query(_VERDICTS + " SELECT slug, reason FROM verdicts")
def cluster_validate(spark, d):
    return _verdicts(_log(spark, d))


@query(_VERDICTS + " SELECT slug, m AS place FROM verdicts WHERE reason IS NULL ORDER BY m LIMIT 3")
def cluster_emit(spark, d):
    """A run's suggestions: the first three that break no rule."""
    log = _log(spark, d)
    return proposals.emitted(_verdicts(log), _proposed(log).select("slug", F.col("m").alias("place")))


@query("""g AS (SELECT slug, strftime(ts, '%Y-%m-%d') AS day, min(seq) AS place, list(DISTINCT seq // 7 ORDER BY seq // 7) AS seqs FROM log WHERE type = 'write_event' GROUP BY ALL),
i AS (SELECT *, 'intent:detect:' || day || ':cluster-' || substr(sha256('[' || array_to_string(seqs, ',') || ']'), 1, 16) AS intent_id FROM g)
SELECT intent_id, min(place) AS place, min_by(slug, place) AS slug FROM i GROUP BY intent_id""")
def cluster_intents(spark, d):
    """Ids of a day's clusters: those of equal support are one intent."""
    w = state.writes(_log(spark, d)).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    made = w.groupBy("slug", "day").agg(F.min("seq").alias("place"), F.array_sort(F.collect_set(F.floor(F.col("seq") / 7))).alias("seqs"))
    return proposals.intents(made).select("intent_id", "place", "slug")


@query("""asks AS (SELECT pos AS ask_id, slug AS topic, unnest(list_distinct([coalesce(last_curated, 0), seq - 1, k])) AS seq FROM refs WHERE type = 'TOPIC_BULLETS_RETIRED'),
gone AS (SELECT DISTINCT slug, superseded_seq FROM retired WHERE effective),
codes AS (SELECT ask_id, a.seq, CASE WHEN a.seq < 1 THEN 'INVALID_RETIRE_SEQ' WHEN w.seq IS NULL THEN 'SEQ_NOT_FOUND' WHEN w.slug <> topic THEN 'SEQ_NOT_ON_TOPIC' WHEN w.tag <> 'CURATED' THEN 'SEQ_NOT_CURATED'
  WHEN g.slug IS NOT NULL THEN 'SEQ_ALREADY_RETIRED' END AS code FROM asks a LEFT JOIN (SELECT * FROM log WHERE type = 'write_event') w ON w.seq = a.seq LEFT JOIN gone g ON g.slug = topic AND g.superseded_seq = a.seq)
SELECT ask_id, CASE WHEN bool_or(seq < 1) THEN 'INVALID_RETIRE_SEQ' WHEN count(code) = 0 THEN NULL WHEN count(*) = 1 THEN min(code) ELSE 'RETIRE_INVALID_SEQS' END AS code, count(*) AS n, count(code) AS n_invalid FROM codes GROUP BY ask_id""")
def retire_preconditions(spark, d):
    """Each retirement of the log asked again at its end, with two more numbers."""
    log = _log(spark, d)
    return preconditions.retire(state.retire_asks(log), log)


@query(_SUPPORTS + """,
asks AS (SELECT pos AS ask_id, coalesce(last_suggested, k) AS suggestion_seq, CASE WHEN k % 4 = 0 THEN slug ELSE slug || '-y' END AS slug FROM refs WHERE type = 'TOPIC_SUGGESTION_ACCEPTED' OR (type = 'TOPIC_SUGGESTED' AND k % 2 = 0)),
wrong AS (SELECT suggestion_seq, min_by(x, seq) AS x FROM (SELECT suggestion_seq, sup.seq, CASE WHEN w.slug NOT IN (SELECT slug FROM topics WHERE meta_k IS NOT NULL) THEN 'SUPPORTING_SEQ_WRONG_SLUG' END AS x FROM sup JOIN w USING (seq)) WHERE x IS NOT NULL GROUP BY suggestion_seq)
SELECT ask_id, CASE WHEN s.status IS NULL THEN 'SUGGESTION_NOT_FOUND' WHEN s.status <> 'pending' THEN 'SUGGESTION_NOT_PENDING' WHEN t.slug IS NOT NULL THEN 'SLUG_COLLISION' ELSE x END AS code
FROM asks a LEFT JOIN suggested s USING (suggestion_seq) LEFT JOIN topics t ON t.slug = a.slug AND t.meta_k IS NOT NULL LEFT JOIN wrong USING (suggestion_seq)""")
def accept_preconditions(spark, d):
    log = _log(spark, d)
    scan = state.topics(log).where("meta_k is not null").select("slug")
    kind = (F.col("type") == "TOPIC_SUGGESTION_ACCEPTED") | ((F.col("type") == "TOPIC_SUGGESTED") & (F.col("k") % 2 == 0))
    named = state.with_last_suggested(log).where(kind)
    slug = F.when(F.col("k") % 4 == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-y")))
    asked = named.select(F.col("pos").alias("ask_id"), F.coalesce("last_suggested", "k").alias("suggestion_seq"), slug.alias("slug"))
    return preconditions.accept(asked, log, proposals.supports(log), scan)


@query("""asks AS (SELECT pos AS ask_id, unnest(list_distinct([coalesce(last_suggested, 0), k])) AS suggestion_seq FROM refs WHERE type = 'TOPIC_SUGGESTION_DISMISSED'),
r AS (SELECT ask_id, suggestion_seq, CASE WHEN status IS NULL THEN 'not_found' WHEN status <> 'pending' THEN 'not_pending_' || status END AS reason FROM asks LEFT JOIN suggested USING (suggestion_seq))
SELECT ask_id, CASE WHEN count(reason) > 0 THEN 'DISMISS_INVALID_SEQS' END AS code, count(*) AS n, coalesce(string_agg(suggestion_seq || ':' || reason, ',' ORDER BY suggestion_seq) FILTER (reason IS NOT NULL), '') AS invalid FROM r GROUP BY ask_id""")
def dismiss_preconditions(spark, d):
    log = _log(spark, d)
    named = state.with_last_suggested(log).where("type = 'TOPIC_SUGGESTION_DISMISSED'")
    return preconditions.dismiss(named.select(F.col("pos").alias("ask_id"), F.array(F.coalesce("last_suggested", F.lit(0)), "k").alias("seqs")), log)


@query(f"""asks AS (SELECT pos AS ask_id, CASE k % 4 WHEN 0 THEN slug WHEN 1 THEN replace(slug, '-', '') WHEN 2 THEN slug || '_' ELSE slug || '-z' END AS slug FROM log WHERE type = 'TOPIC_SUGGESTED')
SELECT ask_id, CASE WHEN NOT regexp_matches(a.slug, '^[a-z0-9]+(-[a-z0-9]+)*$') THEN 'INVALID_SLUG' WHEN t.slug IS NOT NULL THEN 'SLUG_COLLISION'
  WHEN replace(a.slug, '-', '') IN (SELECT replace(slug, '-', '') FROM suggested WHERE status = 'pending') THEN 'PENDING_SUGGESTION_EXISTS'
  WHEN replace(a.slug, '-', '') IN (SELECT slug_key FROM dismissed WHERE cleared_by_accept_seq IS NULL AND until_ms > {_NOW}) THEN 'COOLDOWN_ACTIVE' END AS code
FROM asks a LEFT JOIN topics t ON t.slug = a.slug AND t.meta_k IS NOT NULL""")
def create_preconditions(spark, d):
    log = _log(spark, d)
    kinds = F.array("slug", F.replace("slug", F.lit("-"), F.lit("")), F.concat("slug", F.lit("_")), F.concat("slug", F.lit("-z")))
    asked = log.where("type = 'TOPIC_SUGGESTED'").select(F.col("pos").alias("ask_id"), F.get(kinds, (F.col("k") % 4).cast("int")).alias("slug"))
    return preconditions.create(asked, log, _now_ms(log))


@query("""SELECT bool_or(type = 'TOPIC_SUGGESTED') AS had_suggestion, bool_or(type = 'write_event' AND slug = 'system' AND contains(content, 'first run deferred')) AS marked,
  count(*) FILTER (type = 'write_event' AND slug IN (SELECT slug FROM topics WHERE meta_k IS NOT NULL)) AS n, false AS deferred FROM log""")
def first_run_deferral(spark, d):
    log = _log(spark, d)
    return preconditions.deferred(log, state.topics(log).where("meta_k is not null").select("slug"))


@query(_SUPPORTS + """,
pend AS (SELECT suggestion_seq, count(*) OVER (PARTITION BY suggestion_seq) AS m, seq FROM sup JOIN suggested USING (suggestion_seq) WHERE status = 'pending'),
b AS (SELECT slug, suggestion_seq, m, count(*) AS shared FROM prop JOIN pend USING (seq) GROUP BY ALL),
n AS (SELECT slug, count(*) AS n FROM prop GROUP BY slug)
SELECT slug, suggestion_seq, round(shared / (n + m - shared), 9) AS overlap FROM b JOIN n USING (slug) WHERE shared / (n + m - shared) >= 0.65""")
def support_overlap(spark, d):
    log = _log(spark, d)
    return proposals.overlapping(proposals.proposals(log), log).withColumn("overlap", F.round("overlap", 9))


@query("""n AS (SELECT slug, count(*) AS n FROM log WHERE type = 'write_event' AND tag <> 'CURATED' AND (epoch_us(ts) // 1000) >= (SELECT max((epoch_us(ts) // 1000)) FROM log) - 7 * 86400000::BIGINT GROUP BY slug)
SELECT slug, n FROM n WHERE n >= 3 AND slug IN (SELECT slug FROM topics WHERE meta_k IS NOT NULL)""")
def curate_targets(spark, d):
    log = _log(spark, d)
    return proposals.curate_targets(log, _now_ms(log))


@query("""a AS (SELECT slug, max((epoch_us(resolved_ts) // 1000)) AS ms FROM suggested WHERE status = 'accepted' GROUP BY slug)
SELECT slug FROM a WHERE ms >= (SELECT max((epoch_us(ts) // 1000)) FROM log) - 60 * 86400000::BIGINT AND slug IN (SELECT slug FROM topics WHERE meta_k IS NOT NULL)
  AND slug NOT IN (SELECT l.slug FROM log l WHERE tag = 'CURATED' AND l.k % 2 = 0 AND NOT EXISTS (SELECT 1 FROM retired r WHERE r.effective AND r.slug = l.slug AND r.superseded_seq = l.seq))""")
def bootstrap_eligible(spark, d):
    """Of the curated writes every other one counts, so that some topics are left without."""
    log = _log(spark, d)
    half = log.where((F.col("tag").isNull()) | (F.col("tag") != "CURATED") | (F.col("k") % 2 == 0))
    retired = state.retired_seqs(log)
    curated = state.writes(half).where("tag = 'CURATED'").select("slug", "seq").join(retired, ["slug", "seq"], "left_anti")
    young = proposals.bootstrap_eligible(log.where((F.col("tag").isNull()) | (F.col("tag") != "CURATED")), _now_ms(log))
    return young.join(curated, "slug", "left_anti")


@query(f"""w AS (SELECT slug, seq, tag, list_distinct({_tok('content')}) AS t FROM log WHERE type = 'write_event')
SELECT DISTINCT b.slug, b.seq FROM w b JOIN w o ON b.slug = o.slug AND o.seq > b.seq AND b.tag = 'CURATED' AND o.tag <> 'CURATED'
WHERE len(b.t) >= 2 AND len(list_intersect(b.t, o.t)) / (len(b.t) + len(o.t) - len(list_intersect(b.t, o.t))) >= 0.3""")
def repeated_bullets(spark, d):
    return proposals.repeated_bullets(_log(spark, d), threshold=0.3, least=2)


@query("""SELECT seq, 'FACT' AS tag, 'TENTATIVE' AS confidence, slug, content FROM log WHERE tag = 'FACT' AND k % 5 <> 0""")
def extracted_entries(spark, d):
    """Model output lines, a fifth of them malformed, parsed by the entry grammar."""
    bad = F.when(F.col("k") % 5 == 0, F.concat(F.lit("[FACT] "), "content")).otherwise(F.concat(F.lit("  [AUTO-FACT:TENTATIVE] "), "slug", F.lit(" : "), "content"))
    lines = _log(spark, d).where("tag = 'FACT'").select("seq", bad.alias("line"))
    return proposals.extracted(lines).drop("line")


# transcripts, evaluation, liveness ----------------------------------------------------------

_DELTA = r"""delta AS (SELECT conv_id, turn, role, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...[truncated]' ELSE text END AS text
  FROM conversations WHERE turn > 0 AND role IN ('user', 'assistant') AND text <> '' AND NOT regexp_matches(text, '^[/<]')
    AND NOT (regexp_matches(text, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}') AND length(text) < 30) AND NOT contains(text, '<tool_result>')
    AND NOT contains(text, '</tool_result>') AND NOT starts_with(text, 'System:') AND NOT starts_with(text, '[system]'))"""


def _delta(spark, d):
    return transcripts.delta(adapters.table(spark, d, "conversations"), after_turn=0)


@query(_DELTA + " SELECT conv_id, turn, role, md5(text) AS text_md5 FROM delta")
def transcript_delta(spark, d):
    return _delta(spark, d).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query(_DELTA + " SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM delta GROUP BY conv_id")
def transcript_body(spark, d):
    return transcripts.body(_delta(spark, d)).select("conv_id", F.md5("text").alias("text_md5"))


@query(_DELTA + r" SELECT conv_id, count(*) AS n_messages, round(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) * 0.75)::BIGINT AS token_estimate FROM delta GROUP BY conv_id")
def token_estimate(spark, d):
    return transcripts.estimate(_delta(spark, d))


_RANKINGS = """sims AS (SELECT q.vec_id AS qid, v.vec_id AS key, v.label AS session, list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: v.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)) AS sim
  FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
top AS (SELECT qid, key, session, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, key) AS rank FROM sims),
s AS (SELECT qid, session, row_number() OVER (PARTITION BY qid ORDER BY min(rank), session) AS rank FROM top GROUP BY qid, session),
gold AS (SELECT vec_id AS qid, label AS session FROM embeddings WHERE vec_id % 100 = 0)"""


def _sessions(spark, d):
    """Sessions in the order of their best vectors for each stated query, which meets all vectors in tiles."""
    v = adapters.table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").cast("long").alias("session"), "embedding")
    return blocks.top(blocks.best_of_groups(v, _asked_vectors(spark, d)), 1 << 31).select("qid", "session", "rank")


def _gold(spark, d):
    return adapters.table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("label").cast("long").alias("session"))


@query(_RANKINGS + " SELECT qid, session, rank FROM s")
def session_collapse(spark, d):
    return _sessions(spark, d)


@query(_RANKINGS + """, h AS (SELECT g.qid, count(*) AS n, min(rank) AS best, list(rank) AS ranks FROM gold g LEFT JOIN s USING (qid, session) GROUP BY g.qid)
SELECT round(avg(coalesce(1 / best, 0)), 9) AS mrr""" + "".join(
    f", round(avg((len(list_filter(ranks, lambda r: r <= {k})) > 0)::INT), 9) AS recall_any_{k}, round(avg((len(list_filter(ranks, lambda r: r <= {k})) = n)::INT), 9) AS recall_all_{k}" for k in (1, 3, 5, 10)) + " FROM h")
def recall_mrr(spark, d):
    r = evals.recall(_sessions(spark, d), _gold(spark, d))
    return r.select(*[F.round(c, 9).alias(c) for c in r.columns])


@query(_RANKINGS + """ SELECT g.qid, round(coalesce(max(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 0), 9) AS ndcg FROM gold g LEFT JOIN s USING (qid, session) GROUP BY g.qid""")
def ndcg(spark, d):
    return evals.ndcg(_sessions(spark, d), _gold(spark, d)).withColumn("ndcg", F.round("ndcg", 9))


@query(_RANKINGS + """ SELECT tier, count(*) AS n, round(avg((top.session = gold.session)::INT), 9) AS precision
FROM top JOIN gold USING (qid) JOIN live ON live.doc_id = top.key WHERE rank <= 5 GROUP BY tier""")
def precision_by_tier(spark, d):
    return evals.precision_by_tier(_vector_hits(spark, d)).withColumn("precision", F.round("precision", 9))


def _vector_hits(spark, d):
    """(qid, tier, rank, relevant): each query's five nearest vectors that are live units."""
    v = adapters.table(spark, d, "embeddings")
    key = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    best = retrieval.cosine(v.select(key("vec_id").alias("key"), "embedding"), _asked_vectors(spark, d), floor=-2.0, limit=6)
    best = blocks.top(best.where(F.col("key") != key("qid")).drop("rank"), 5)  # a query finds itself
    tiers = retrieval.live(_units(spark, d)).select(F.col("doc_id").alias("key"), "tier")
    sessions = v.select(F.col("vec_id").alias("key"), F.col("label").cast("long").alias("session"))
    gold = _gold(spark, d).withColumnRenamed("session", "wanted")
    hits = best.withColumn("key", F.col("key").cast("long")).join(sessions, "key").join(gold, "qid").join(tiers, "key")
    return hits.withColumn("relevant", F.col("session") == F.col("wanted"))


_RUNS = "runs AS (SELECT slug, seq, CASE k % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' ELSE 'started' END AS kind FROM log)"


@query(_RUNS + """, ok AS (SELECT slug, max(seq) AS last_success_seq FROM runs WHERE kind = 'complete' GROUP BY slug)
SELECT slug, last_success_seq, max_by(kind, seq) AS last_kind, count(*) FILTER (kind = 'failed' AND seq > coalesce(last_success_seq, -1)) AS consecutive_failures
FROM runs LEFT JOIN ok USING (slug) GROUP BY slug, last_success_seq""")
def liveness_failures(spark, d):
    kind = F.when(F.col("k") % 3 == 0, "complete").when(F.col("k") % 3 == 1, "failed").otherwise("started")
    return liveness.heartbeat(_log(spark, d).select("slug", "seq", kind.alias("kind")))


@query("""gaps AS (SELECT slug, seq, row_number() OVER (PARTITION BY slug ORDER BY seq) AS i, (k % 50) / 10.0 AS gap FROM log),
fold AS (WITH RECURSIVE f AS (
  SELECT slug, i, gap > 3 AS now, (gap > 3)::INT AS flip FROM gaps WHERE i = 1
  UNION ALL
  SELECT g.slug, g.i, CASE WHEN f.now THEN g.gap > 1 ELSE g.gap > 3 END, (CASE WHEN f.now THEN g.gap > 1 ELSE g.gap > 3 END <> f.now)::INT
  FROM f JOIN gaps g ON g.slug = f.slug AND g.i = f.i + 1) SELECT * FROM f)
SELECT slug, sum(flip)::BIGINT AS flips, max_by(now, i) AS is_stale FROM fold GROUP BY slug""")
def liveness_hysteresis(spark, d):
    return liveness.hysteresis(_log(spark, d).select("slug", "seq", (F.col("k") % 50 / 10.0).alias("gap")))


@query("SELECT slug, count(*) AS n_writes, max(seq) AS last_seq, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM log WHERE type = 'write_event' GROUP BY slug")
def streaming_incremental_equals_batch(spark, d):
    out = incremental.run(spark, f"{d}/events*.parquet")
    return out.select("slug", "n_writes", "last_seq", F.array_join("tags", ",").alias("tags"))


@query("""SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def star_broadcast_join(spark, d):
    t = lambda n: adapters.table(spark, d, n)
    # nations and regions are fixed, 25 and 5 rows
    places = F.broadcast(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")))
    per = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    whole = per.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return whole.groupBy("r_name", "n_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("s"), 2).alias("total"))


# files ----------------------------------------------------------------------------------------

_LAYERS = """kept AS (SELECT l.* FROM log l WHERE tag = 'CURATED' AND NOT EXISTS (SELECT 1 FROM retired r WHERE r.effective AND r.slug = l.slug AND r.superseded_seq = l.seq)),
two AS (SELECT slug, string_agg(trim(content), chr(10) || chr(10) ORDER BY pos) AS two FROM kept GROUP BY slug),
three AS (SELECT slug, string_agg(trim(content), chr(10) || chr(10) ORDER BY ts DESC, seq DESC) AS three FROM log WHERE tag = 'SOURCE' GROUP BY slug),
dates AS (SELECT slug, strftime(min_by(ts, pos) FILTER (type = 'write_event'), '%Y-%m-%d') AS first, strftime(max_by(ts, pos) FILTER (type = 'TOPIC_VERIFIED'), '%Y-%m-%d') AS verified,
  strftime(max_by(ts, pos) FILTER (type = 'TOPIC_CURATED'), '%Y-%m-%d') AS curated, strftime(max_by(ts, pos), '%Y-%m-%d') AS last
  FROM log WHERE type IN ('write_event', 'TOPIC_METADATA_SET', 'TOPIC_CURATED', 'TOPIC_VERIFIED') GROUP BY slug),
meta AS (SELECT slug, ['reference', 'project', 'feedback', 'personal', 'archive', 'business', 'hobby'][meta_k % 7 + 1] AS kind, 'user, tag-' || (meta_k % 3) AS tags, 'Entity: ' || (meta_k % 4) AS entity,
  CASE WHEN meta_k % 5 = 0 THEN 'archived' ELSE 'active' END AS status, CASE WHEN meta_k % 9 = 0 THEN 'private' END AS sensitivity, coalesce(first, '2026-04-22') AS created,
  coalesce(verified, first, '2026-04-22') AS last_verified, coalesce(curated, last) AS last_curated, 'Topic ' || slug || ' has ' || n_writes || ' entries.' AS summary, two, three
  FROM topics JOIN dates USING (slug) LEFT JOIN two USING (slug) LEFT JOIN three USING (slug) WHERE meta_k IS NOT NULL)"""


@query(_LAYERS + """
SELECT slug, md5('---' || chr(10) || 'topic: ' || slug || chr(10) || 'type: ' || kind || chr(10) || 'tags: [' || tags || ']' || chr(10) || 'entities: ["' || entity || '"]' || chr(10) || 'status: ' || status
  || coalesce(chr(10) || 'sensitivity: ' || sensitivity, '') || chr(10) || 'created: ' || created || chr(10) || 'last_verified: ' || last_verified || chr(10) || 'last_curated: ' || last_curated
  || chr(10) || 'curated_lines: ' || coalesce(len(string_split(two, chr(10))), 0)
  || chr(10) || 'source_lines: ' || coalesce(len(string_split(three, chr(10))), 0) || chr(10) || 'source_kb: ' || format('{:.1f}', round(strlen(coalesce(three, '')) / 1024.0, 1))
  || chr(10) || 'summary: >' || chr(10) || '  ' || summary || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || '<!-- CURATED_START -->' || chr(10) || chr(10) || coalesce(two || chr(10) || chr(10), '') || '<!-- CURATED_END -->' || chr(10) || chr(10)
  || '<!-- SOURCE_START -->' || chr(10) || chr(10) || coalesce(three || chr(10) || chr(10), '') || '<!-- SOURCE_END -->' || chr(10)) AS text_md5
FROM meta""")
def topic_file_text(spark, d):
    return projection.topic_files(_log(spark, d)).select("slug", F.md5("text").alias("text_md5"))


@query(_LAYERS + """
SELECT slug, slug AS topic, kind, tags, entity AS entities, status, sensitivity, created, last_verified, last_curated, summary, true AS trailing_blank, md5(coalesce(two, '')) AS curated_md5, md5(coalesce(three, '')) AS source_md5 FROM meta""")
def topic_file_parse(spark, d):
    """Topic files as written, taken apart again."""
    t = markdown.topic_files(projection.topic_files(_log(spark, d)))
    own = ["slug", "topic", "kind", "status", "sensitivity", "created", "last_verified", "last_curated", "summary", "trailing_blank"]
    lists = [F.array_join(c, ", ").alias(c) for c in ("tags", "entities")]
    return t.select(*own, *lists, F.md5("curated").alias("curated_md5"), F.md5("source").alias("source_md5"))


@query(_LAYERS + """,
e AS (SELECT slug, 0 AS g, 'TOPIC_METADATA_SET' AS type, NULL AS tag, created || 'T00:00:00Z' AS ts, NULL AS content FROM meta
  UNION ALL SELECT slug, 1, 'TOPIC_VERIFIED', NULL, last_verified || 'T00:00:00Z', NULL FROM meta
  UNION ALL SELECT slug, 2, 'TOPIC_CURATED', NULL, last_curated || 'T00:00:00Z', NULL FROM meta
  UNION ALL SELECT slug, 3, 'write_event', 'FACT', created || 'T00:00:00Z', summary FROM meta
  UNION ALL SELECT slug, 4, 'write_event', 'CURATED', created || 'T00:00:00Z', two FROM meta WHERE two <> ''
  UNION ALL SELECT slug, 5, 'ACL_SEALED', NULL, created || 'T00:00:00Z', NULL FROM meta WHERE sensitivity = 'private')
SELECT 'topics/' || slug || '.md' AS source_file, row_number() OVER (PARTITION BY slug ORDER BY g) - 1 AS at, slug, type, tag, ts, md5(content) AS text_md5 FROM e""")
def import_topics(spark, d):
    """Topic files as written, imported as new log entries."""
    files = projection.topic_files(_log(spark, d)).select(F.concat(F.lit("topics/"), "slug", F.lit(".md")).alias("path"), "text")
    e = imports.topic_entries(files, "me", "2026-01-01T00:00:00Z")
    return e.select("source_file", F.col("at").cast("long").alias("at"), "slug", "type", "tag", "ts", F.md5("content").alias("text_md5"))


@query("""w AS (SELECT *, strftime(ts, '%Y-%m-%d') AS date, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY seq) - 1 AS i FROM log WHERE type = 'write_event'),
made AS (SELECT slug, min(struct_pack(date := date, i := i)) AS f FROM w WHERE slug NOT IN (SELECT slug FROM log WHERE type = 'TOPIC_METADATA_SET') GROUP BY slug)
SELECT date || '.md' AS source_file, i + 1000000 AS at, 'write_event' AS type, slug, tag, date || 'T12:' || lpad(least(i // 60, 23)::VARCHAR, 2, '0') || ':' || lpad((i % 60)::VARCHAR, 2, '0') || 'Z' AS ts, content FROM w
UNION ALL SELECT f.date || '.md', f.i, 'TOPIC_METADATA_SET', slug, NULL, f.date || 'T12:00:00Z', NULL FROM made""")
def import_logs(spark, d):
    """Dated logs as written, imported where only topics with metadata are known."""
    log = _log(spark, d)
    files = projection.event_logs(log).select(F.concat("date", F.lit(".md")).alias("path"), "text")
    e = imports.log_entries(files, log.where("type = 'TOPIC_METADATA_SET'").select("slug").distinct())
    return e.select("source_file", F.col("at").cast("long").alias("at"), "type", "slug", "tag", "ts", "content")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS date, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY seq) - 1 AS line_no, tag, slug, content FROM log WHERE type = 'write_event'""")
def event_lines_parse(spark, d):
    """Dated logs as written, line by line."""
    parsed = markdown.event_lines(markdown.lines(projection.event_logs(_log(spark, d))))
    return parsed.where("kind = 'event'").select("date", F.col("line_no").cast("long").alias("line_no"), "tag", "slug", "content")


@query("""e AS (SELECT strftime(ts, '%Y-%m-%d') AS date, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY seq) - 1 AS i FROM log WHERE type = 'write_event')
SELECT date, i AS line_no, date || 'T12:' || lpad(least(i // 60, 23)::VARCHAR, 2, '0') || ':' || lpad((i % 60)::VARCHAR, 2, '0') || 'Z' AS ts FROM e""")
def event_lines_context(spark, d):
    parsed = markdown.event_lines(markdown.lines(projection.event_logs(_log(spark, d))))
    return markdown.with_context(parsed).select("date", F.col("line_no").cast("long").alias("line_no"), "ts")


@query(_CHAIN + """ SELECT strftime(ts, '%Y-%m') || '.jsonl' AS log_file, count(*) AS n, sum(n.i)::BIGINT AS seqs, true AS ok, min(chain.self_hash) AS least
FROM chain JOIN n USING (slug, pos) GROUP BY 1""")
def jsonl_roundtrip(spark, d):
    """Chained lines written as month files and read back: hashes are computed anew from the lines."""
    path = scratch_path(spark, "jsonl")
    rows = _written(spark, d)
    jsonl.write(rows.select("seq", F.get_json_object("raw", "$.ts").alias("ts"), "raw"), path, line="raw")
    back = jsonl.parsed(jsonl.read(spark, path))
    ok = F.bool_and(F.col("shape_ok")).alias("ok")
    return back.groupBy("log_file").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"), ok, F.min("self_hash").alias("least"))


@query("""SELECT doc_id, CASE WHEN trim(content, ' ') = '' THEN 'name:must_be_nonblank' WHEN length(content) > 80 THEN 'name:length_out_of_range'
  WHEN regexp_matches(content, '[\\r\\n]') THEN 'name:must_be_single_line'
  WHEN n % 3 <> 1 THEN 'supporting_seqs:must_be_strictly_ascending' END AS reason
FROM (SELECT *, length(content) AS n FROM units)""".replace("\\\\", "\\"))
def suggestion_rejects(spark, d):
    u = _units(spark, d).withColumn("n", F.length("content"))
    seqs = F.array(F.col("seq"), F.col("seq") + F.when(F.col("n") % 3 == 0, 0).when(F.col("n") % 3 == 1, 5).otherwise(-1) + F.when((F.col("n") % 3 == 2) & (F.col("seq") == 1), 2).otherwise(0))
    line = F.lit("one line")
    return u.select("doc_id", admission.suggested_reason(F.col("slug"), F.col("content"), line, line, seqs).alias("reason"))


@query("""SELECT doc_id, CASE WHEN n % 4 = 0 THEN 'type:enum_violation' WHEN n % 5 = 0 THEN 'status:enum_violation' WHEN n % 7 = 0 THEN 'tags:item_slug_regex_mismatch'
  WHEN n % 11 = 0 THEN 'created:must_be_iso_date_yyyy_mm_dd' WHEN n > 1000 THEN 'summary:length_out_of_range' END AS reason FROM (SELECT *, length(content) AS n FROM units)""")
def metadata_rejects(spark, d):
    u = _units(spark, d).withColumn("n", F.length("content"))
    pick = lambda k, bad, good: F.when(F.col("n") % k == 0, bad).otherwise(good)
    reason = admission.metadata_reason(
        F.col("slug"), pick(4, "novel", "project"), pick(5, "gone", "active"), F.array(F.lit("a-b"), pick(7, "A b", "c")), pick(11, "1 May", "2024-05-01"), F.regexp_replace("content", "\r", " ")
    )
    return u.select("doc_id", reason.alias("reason"))


# readers, answers of models --------------------------------------------------------------------

@query(_INDEX + " SELECT slug, kind, tags, status, summary FROM idx")
def topic_index_scan(spark, d):
    """The topic index as written among headings and fences, read back."""
    lines = projection.topic_index(_log(spark, d)).select(F.explode(F.array(F.lit("# Topics"), F.lit("```"), F.col("line"), F.lit("a | b"))).alias("line"))
    return reading.index_rows(lines).withColumn("tags", F.array_join("tags", ", "))


@query("""w AS (SELECT *, strftime(ts, '%Y-%m-%d') AS date, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY seq) - 1 AS line_no FROM log WHERE type = 'write_event')
SELECT date, line_no, tag, slug, content FROM w WHERE date > strftime((SELECT max(ts) FROM log) - INTERVAL 7 DAY, '%Y-%m-%d') AND tag <> 'CURATED' AND tag <> 'SOURCE'""")
def read_events(spark, d):
    """A week of dated logs; lines with tags of layers are none of the readers' lines."""
    log = _log(spark, d)
    until = log.agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).first()[0] or "1970-01-01"
    found = reading.events(projection.event_logs(log), until, days=7)
    return found.select("date", F.col("line_no").cast("long").alias("line_no"), "tag", "slug", "content")


@query(_LAYERS + """,
asks AS (SELECT pos AS ask_id, slug, k % 7 AS c, CASE k % 7 WHEN 0 THEN 'topic:' || slug WHEN 1 THEN 'topic:' || slug || '#layer-1' WHEN 2 THEN 'topic:' || slug || '#layer-2' WHEN 3 THEN 'event:2024-01-01:' || seq WHEN 4 THEN 'handoff:a-b.md'
  WHEN 5 THEN 'topic:' || slug || '-none' ELSE 'topic:' || upper(slug) END AS id FROM log WHERE event_type = 'signup')
SELECT ask_id, CASE WHEN c IN (0, 1, 2) AND meta.slug IS NOT NULL THEN 'topic:' || asks.slug || '#layer-' || CASE c WHEN 1 THEN 1 ELSE 2 END ELSE id END AS id,
  md5(CASE WHEN meta.slug IS NULL THEN NULL WHEN c = 1 THEN 'type: ' || kind || chr(10) || 'status: ' || status || chr(10) || 'created: ' || created || chr(10) || 'summary: ' || summary WHEN c IN (0, 2) THEN coalesce(two, '') END) AS text_md5,
  CASE WHEN c IN (3, 4) THEN 'FETCH_KIND_DEFERRED' WHEN c = 6 THEN 'FETCH_UNKNOWN_ID' WHEN c = 5 OR meta.slug IS NULL THEN 'FETCH_NOT_FOUND' END AS code
FROM asks LEFT JOIN meta USING (slug)""")
def fetch_by_id(spark, d):
    log = _log(spark, d)
    one = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    slug = F.col("slug")
    ids = F.array(one("topic:", slug), one("topic:", slug, "#layer-1"), one("topic:", slug, "#layer-2"), one("event:2024-01-01:", F.col("seq").cast("string")), F.lit("handoff:a-b.md"), one("topic:", slug, "-none"), one("topic:", F.upper(slug)))
    asked = log.where("type in ('TOPIC_METADATA_SET', 'TOPIC_CURATED', 'TOPIC_VERIFIED')").select(F.col("pos").alias("ask_id"), F.get(ids, (F.col("k") % 7).cast("int")).alias("id"))
    files = projection.topic_files(log)
    found = reading.fetched(asked, files, files.select("slug"))
    return found.select("ask_id", "id", F.md5("text").alias("text_md5"), "code")


@query("""a AS (SELECT slug, max(seq) AS m, count(*) AS n FROM log WHERE type = 'write_event' GROUP BY slug)
SELECT slug AS answer_id, i, slug || '-' || i AS slug, 'Name ' || i AS name, m + i AS first_seq FROM (SELECT *, unnest(CASE m % 4 WHEN 0 THEN [0, 1] WHEN 1 THEN [0] ELSE [] END) AS i FROM a)""")
def cluster_answers(spark, d):
    """Answers of a detector - fenced, bare, empty and broken ones - taken apart."""
    a = state.writes(_log(spark, d)).groupBy("slug").agg(F.max("seq").alias("m"))
    item = lambda i: F.to_json(F.struct(F.concat("slug", F.lit(f"-{i}")).alias("slug"), F.lit(f"Name {i}").alias("name"), F.array(F.col("m") + i).alias("supporting_seqs")))
    fenced = F.concat(F.lit("Here:\n```json\n["), item(0), F.lit(", "), item(1), F.lit("]\n```\nDone."))
    raws = F.array(fenced, F.concat(F.lit(" ["), item(0), F.lit("]")), F.lit("NOTHING_TO_PROPOSE"), F.concat(F.lit("["), item(0)))
    found = answers.clusters(a.select(F.col("slug").alias("answer_id"), F.get(raws, (F.col("m") % 4).cast("int")).alias("raw")))
    return found.select("answer_id", F.col("i").cast("long").alias("i"), "slug", "name", F.get("supporting_seqs", F.lit(0)).alias("first_seq"))


_ACTIVE = """act AS (SELECT slug, seq, row_number() OVER (PARTITION BY slug ORDER BY seq) AS n FROM log l WHERE tag = 'CURATED' AND NOT EXISTS (SELECT 1 FROM retired r WHERE r.effective AND r.slug = l.slug AND r.superseded_seq = l.seq)),
ans AS (SELECT slug, max(seq) % 5 AS c FROM log WHERE type = 'write_event' GROUP BY slug)"""


def _curation_answers(spark, d):
    log = _log(spark, d)
    c = F.max("seq") % 5
    rows = state.writes(log).groupBy("slug").agg(c.alias("c"))
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    n = F.col("c").cast("string")
    raw = line("RETIRE: ", n, "\n retire: 2 \nRETIRE: 900\nREASON: ", F.repeat(F.lit("r"), (F.col("c") * 40).cast("int")), "\nREASON: second\n- bullet ", n, "\n-not one\n- ", F.repeat(F.lit("b"), (F.col("c") * 60).cast("int")), "\n- \nprose")
    live = state.writes(log).where("tag = 'CURATED'").select("slug", "seq").join(state.retired_seqs(log), ["slug", "seq"], "left_anti")
    active = live.withColumn("n", F.row_number().over(Window.partitionBy("slug").orderBy("seq")).cast("long")).withColumnRenamed("slug", "answer_id")
    return answers.curation(rows.select(F.col("slug").alias("answer_id"), raw.alias("raw")), active)


@query(_ACTIVE + """ SELECT ans.slug AS answer_id, coalesce((SELECT string_agg(seq, ',' ORDER BY seq) FROM act WHERE act.slug = ans.slug AND n IN (c, 2, 900)), '') AS seqs, CASE WHEN c BETWEEN 1 AND 3 THEN repeat('r', c * 40) ELSE 'second' END AS reason FROM ans""")
def curation_retirements(spark, d):
    gone, _ = _curation_answers(spark, d)
    return gone.select("answer_id", F.array_join(F.transform("superseded_seqs", lambda x: x.cast("string")), ",").alias("seqs"), "reason")


@query(_ACTIVE + """ SELECT slug AS answer_id, 'bullet ' || c AS bullet FROM ans UNION ALL SELECT slug, repeat('b', c * 60) FROM ans WHERE c BETWEEN 1 AND 3""")
def curation_bullets(spark, d):
    return _curation_answers(spark, d)[1].select("answer_id", "bullet")


@query("""c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id AS answer_id, p AS place, 'point ' || p AS bullet FROM (SELECT conv_id, n, unnest(range(1, 13)) AS p FROM c) WHERE p <= n * 3 AND n % 5 <> 0""")
def bootstrap_bullets(spark, d):
    """Three bullets for each turn, of which the first twelve count."""
    c = adapters.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    lines = F.transform(F.sequence(F.lit(1), (F.col("n") * 3).cast("int")), lambda i: F.concat(F.lit(" - point "), i.cast("string")))
    raw = F.when(F.col("n") % 5 == 0, "NOTHING_TO_ADD").otherwise(F.concat(F.lit("Facts:\n"), F.array_join(lines, "\n")))
    return answers.bootstrap(c.select(F.col("conv_id").alias("answer_id"), raw.alias("raw")))


@query(f"""c AS (SELECT source AS batch, doc_id AS i, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, list_distinct({_tok('text')}) AS t FROM documents),
f AS (WITH RECURSIVE g AS (
  SELECT batch, r, CASE WHEN len(t) > 0 THEN [t] ELSE CAST([] AS VARCHAR[][]) END AS held, i AS kept FROM c WHERE r = 1
  UNION ALL
  SELECT c.batch, c.r, CASE WHEN dup OR len(c.t) = 0 THEN held ELSE list_append(held, c.t) END, CASE WHEN dup THEN NULL ELSE c.i END
  FROM (SELECT g.*, c.t, c.i, c.r AS next, len(list_filter(held, lambda h: len(list_intersect(h, c.t)) >= 0.8 * (len(h) + len(c.t) - len(list_intersect(h, c.t))))) > 0 AS dup FROM g JOIN c ON c.batch = g.batch AND c.r = g.r + 1) x JOIN c ON c.batch = x.batch AND c.r = x.next) SELECT * FROM g)
SELECT batch, kept AS i FROM f WHERE kept IS NOT NULL""")
def near_dup_survivors(spark, d):
    """Each source's documents in order; those that resemble an earlier survivor go."""
    docs = adapters.table(spark, d, "documents").select(F.col("source").alias("batch"), F.col("doc_id").alias("i"), F.col("text").alias("content"))
    return answers.survivors(docs)


# history, liveness, evaluation ------------------------------------------------------------------

@query("SELECT slug, row_number() OVER (PARTITION BY slug ORDER BY pos) AS place, seq, tag, principal, content FROM log WHERE type = 'write_event'")
def topic_history(spark, d):
    return state.history(_log(spark, d)).drop("ts")


@query("""SELECT slug, place, seq, tag, content FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY pos DESC) AS place FROM log WHERE type = 'write_event' AND tag <> 'CURATED') WHERE place <= 50""")
def latest_writes(spark, d):
    return state.latest_writes(_log(spark, d))


_RUN_SQL = """run AS (SELECT seq, epoch_us(ts) // 1000 AS ms, CASE k % 3 WHEN 0 THEN 'curate' ELSE 'detect' END || ' ' || ['run started', 'run complete', 'run failed', 'first run deferred', 'insufficient events', 'note'][k % 6 + 1] AS content,
  CASE WHEN k % 2 = 0 THEN 'curate' END AS source FROM log WHERE event_type = 'error')"""


def _run_entries(spark, d):
    what = F.get(F.array(*[F.lit(x) for x in ("run started", "run complete", "run failed", "first run deferred", "insufficient events", "note")]), (F.col("k") % 6).cast("int"))
    own = _log(spark, d).where("type in ('TOPIC_BULLETS_RETIRED', 'TOPIC_SUGGESTED', 'TOPIC_SUGGESTION_ACCEPTED', 'TOPIC_SUGGESTION_DISMISSED')")
    job = F.when(F.col("k") % 3 == 0, "curate").otherwise("detect")
    return own.select("seq", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.concat_ws(" ", job, what).alias("content"), F.when(F.col("k") % 2 == 0, "curate").alias("source"))


def _status_sql(job: str, own: bool) -> str:
    kinds = "CASE WHEN contains(content, 'run started') THEN 'started' WHEN contains(content, 'run complete') THEN 'complete' WHEN contains(content, 'run failed') THEN 'failed'"
    kinds += "" if own else " WHEN contains(content, 'first run deferred') THEN 'deferred' WHEN contains(content, 'insufficient events') THEN 'idle'"
    return f"""{_RUN_SQL}, e AS (SELECT * FROM (SELECT *, {kinds} END AS kind FROM run WHERE starts_with(content, '{job}'){" AND source = '" + job + "'" if own else ""}) WHERE kind IS NOT NULL),
g AS (SELECT max(seq) AS good_seq FROM e WHERE kind IN ('complete', 'idle'))
SELECT max_by(ms, seq) AS last_run_ms, max_by(ms, seq) FILTER (kind IN ('complete', 'idle')) AS last_success_ms, count(*) FILTER (kind = 'failed' AND seq > coalesce(good_seq, -1)) AS consecutive_failures,
  max_by(content, seq) FILTER (kind = 'failed' AND seq > coalesce(good_seq, -1)) AS last_failure, max_by(kind, seq) AS last_kind, bool_or(kind = 'deferred') AS deferred FROM e, g"""


@query(_status_sql("curate", True))
def curator_status(spark, d):
    return liveness.status(_run_entries(spark, d), "curate", own_source=True)


@query(_status_sql("detect", False))
def detector_status(spark, d):
    return liveness.status(_run_entries(spark, d), "detect", own_source=False)


_JOBS_SQL = f"""now AS (SELECT max(epoch_us(ts) // 1000) AS now FROM log),
j AS (SELECT slug AS job, max(epoch_us(ts) // 1000) FILTER (k % 3 = 0 AND k > 60) AS last_success_ms, max_by(CASE k % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' ELSE 'started' END, pos) AS last_kind, max(k) % 2 = 0 AS was_stale,
  min(epoch_us(ts) // 1000) AS first_seen_ms, max(epoch_us(ts) // 1000) AS computed_ms, max(epoch_us(ts) // 1000) FILTER (k = 7) AS emitted_ms FROM log GROUP BY slug),
v AS (SELECT *, (now - last_success_ms) / 86400000.0 AS days, CASE WHEN last_success_ms IS NULL OR now < last_success_ms THEN false WHEN was_stale THEN (now - last_success_ms) / 86400000.0 > 1 ELSE (now - last_success_ms) / 86400000.0 > 3 END AS is_stale FROM j, now)"""


def _job_verdicts(spark, d):
    log = _log(spark, d)
    ms, now = F.unix_millis(F.col("ts").cast("timestamp")), _now_ms(log)
    kind = F.when(F.col("k") % 3 == 0, "complete").when(F.col("k") % 3 == 1, "failed").otherwise("started")
    statuses = log.groupBy(F.col("slug").alias("job")).agg(
        F.max(F.when((F.col("k") % 3 == 0) & (F.col("k") > 60), ms)).alias("last_success_ms"), F.max_by(kind, "pos").alias("last_kind"), (F.max("k") % 2 == 0).alias("was_stale"),
        F.min(ms).alias("first_seen_ms"), F.max(ms).alias("computed_ms"), F.max(F.when(F.col("k") == 7, ms)).alias("emitted_ms"),
    )
    return liveness.verdict(statuses, now), now


@query(_JOBS_SQL + " SELECT job, round(days, 6) AS days_since_success, last_kind = 'started' AS in_progress, is_stale FROM v")
def liveness_verdicts(spark, d):
    v, _ = _job_verdicts(spark, d)
    return v.select("job", F.round("days_since_success", 6).alias("days_since_success"), "in_progress", "is_stale")


@query(_JOBS_SQL + """ SELECT job, kind FROM (SELECT job, CASE WHEN now - computed_ms > 3 * 86400000 THEN 'curate_monitor_stale' WHEN last_success_ms IS NULL AND now - first_seen_ms > 2 * 86400000 THEN 'curate_never_succeeded'
  WHEN is_stale THEN 'curate_liveness_stale' END AS kind FROM v WHERE emitted_ms IS NULL OR now - emitted_ms >= 6 * 3600000) WHERE kind IS NOT NULL""")
def liveness_notices(spark, d):
    v, now = _job_verdicts(spark, d)
    return liveness.notices(v, now)


@query(_DELTA.replace("WHERE turn > 0 AND", "WHERE turn > CASE WHEN conv_id % 2 = 0 THEN 2 ELSE -1 END AND") + r""",
ends AS (SELECT conv_id, max(turn) AS last_turn FROM conversations WHERE turn > CASE WHEN conv_id % 2 = 0 THEN 2 ELSE -1 END GROUP BY conv_id),
est AS (SELECT conv_id, round(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) * 0.75)::BIGINT AS n FROM delta GROUP BY conv_id)
SELECT conv_id, last_turn, coalesce(n, 0) AS token_estimate, coalesce(n, 0) >= 200 AS ready FROM ends LEFT JOIN est USING (conv_id)""")
def session_offsets(spark, d):
    """Half of the sessions were read up to their third turn before."""
    turns = adapters.table(spark, d, "conversations")
    done = turns.where("conv_id % 2 = 0").select("conv_id", F.lit(2).cast("long").alias("last_turn")).distinct()
    return transcripts.advanced(turns, done)


@query(_RANKINGS + """, h AS (SELECT g.qid, g.qid // 100 % 3 AS type, bool_and(coalesce(rank <= 5, false)) AS whole FROM gold g LEFT JOIN s USING (qid, session) GROUP BY ALL)
SELECT 'type ' || type AS type, count(*) AS n, round(avg(whole::INT), 9) AS recall_all FROM h GROUP BY ALL""")
def recall_by_type(spark, d):
    gold = _gold(spark, d).withColumn("type", F.concat(F.lit("type "), F.floor(F.col("qid") / 100) % 3))
    return evals.recall_by_type(_sessions(spark, d), gold).withColumn("recall_all", F.round("recall_all", 9))


@query("""t AS (SELECT conv_id % 20 AS qid, conv_id AS session, CASE WHEN conv_id % 20 < 15 THEN length(text) % 7 = 0 END AS has_answer FROM conversations),
m AS (SELECT qid FROM t GROUP BY qid HAVING count(has_answer) = 0)
SELECT DISTINCT qid, session FROM t WHERE has_answer UNION ALL SELECT DISTINCT qid, session FROM t WHERE qid IN (SELECT qid FROM m) AND session % 3 = 0""")
def gold_sessions(spark, d):
    """Questions with marked turns, and questions without, whose stated answers stand."""
    marked = F.when(F.col("conv_id") % 20 < 15, F.length("text") % 7 == 0)
    turns = adapters.table(spark, d, "conversations").select((F.col("conv_id") % 20).alias("qid"), F.col("conv_id").alias("session"), marked.alias("has_answer"))
    return evals.gold_of(turns, turns.where("session % 3 = 0"))


@query("SELECT vec_id AS qid FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def remaining_questions(spark, d):
    """Vectors as questions, of which the labelled are done."""
    asked = adapters.table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"))
    return evals.remaining(asked, adapters.table(spark, d, "labels").select(F.col("doc_id").alias("qid")))


@query("SELECT item_id, sha256(to_json(nfc_normalize(text))::VARCHAR) AS digest FROM benchmark")
def query_digest(spark, d):
    return adapters.table(spark, d, "benchmark").select("item_id", canonical.key_of(F.col("text")).alias("digest"))


@query(_DAMAGED + """, w AS (WITH RECURSIVE a AS (
  SELECT log, min(pos) AS pos, min_by(self_hash, pos) AS self_hash FROM d WHERE hash_prev = repeat('0', 64) GROUP BY log
  UNION ALL
  SELECT d.log, min(d.pos), min_by(d.self_hash, d.pos) FROM a JOIN d ON d.log = a.log AND d.hash_prev = a.self_hash AND d.pos > a.pos GROUP BY d.log) SELECT * FROM a)
SELECT log, count(*) AS n, true AS refused FROM d WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.log = d.log AND w.pos = d.pos) GROUP BY log""")
def strict_regenerate(spark, d):
    """Damaged logs that may not be projected."""
    return chain.strict(chain.skipped(_damaged(spark, d).withColumn("shape_ok", F.lit(True))))


@query("own AS (SELECT live.* FROM live JOIN acl USING (slug) WHERE list_contains(readers, 'p1')),\n"
       + _lexical_sql("or", 0.1, _TOPIC_FIELDS, retrieval.TOPIC_BOOSTS, 10) + """,
t AS (SELECT source AS slug, arg_max(text, doc_id) AS text FROM documents GROUP BY source),
p AS (SELECT qid, key AS slug, score, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM lex)
SELECT qid, slug, rank, CASE WHEN score >= 4 THEN 'high' WHEN score >= 1.5 THEN 'medium' ELSE 'low' END AS confidence, md5(CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || '…' ELSE text END) AS excerpt FROM p JOIN t USING (slug) WHERE place <= 3""")
def context_pack(spark, d):
    """The best topics of each query with an excerpt of their latest document."""
    u = _units(spark, d)
    found = retrieval.exact_lookup(u, adapters.acl(u), PRINCIPAL, _asked(spark, d))
    texts = adapters.table(spark, d, "documents").groupBy(F.col("source").alias("slug")).agg(F.max_by("text", "doc_id").alias("text"))
    return retrieval.context_pack(found, texts).withColumn("excerpt", F.md5("excerpt"))


_OFFERED = """every AS (SELECT pos, type, k, slug, k % 2 = 0 AS typed FROM log UNION ALL SELECT pos, type, k, slug || '-c', false FROM
  (SELECT pos, k, slug, CASE k % 5 WHEN 0 THEN 'FEATURE_ACTIVE' WHEN 1 THEN 'FEATURE_ROLLED_BACK' WHEN 2 THEN 'RECOVERY_MODE_ENTERED' WHEN 3 THEN 'RECOVERY_MODE_EXITED' ELSE 'NOVEL' END AS type FROM log WHERE event_type = 'signup')),
off AS (SELECT pos // 50 AS batch, pos * 2 + (type LIKE 'FEATURE%' OR type LIKE 'RECOVERY%' OR type = 'NOVEL')::INT AS i, type, CASE k % 10 WHEN 1 THEN 'admin' WHEN 2 THEN 'other' END AS socket, CASE k % 25 WHEN 3 THEN 'recovery' WHEN 4 THEN 'normal' END AS mode, slug, typed FROM every),
ok AS (SELECT DISTINCT slug FROM log WHERE type = 'write_event' AND k < 20),
codes AS (SELECT batch, i, CASE WHEN mode = 'recovery' THEN 'INVALID_WRITER_MODE' WHEN type = 'NOVEL' THEN 'UNKNOWN_EVENT_TYPE_NOT_REGISTERED'
  WHEN socket = 'other' OR (coalesce(socket, 'standard') = 'standard' AND (type LIKE 'FEATURE%' OR type LIKE 'RECOVERY%')) THEN 'EVENT_NOT_ADMISSIBLE'
  WHEN type = 'write_event' AND slug NOT IN (SELECT slug FROM ok) AND NOT EXISTS (SELECT 1 FROM off o WHERE o.batch = off.batch AND o.slug = off.slug AND o.i < off.i AND o.type = 'TOPIC_METADATA_SET' AND o.typed) THEN 'SLUG_NOT_ADMITTED' END AS code FROM off)"""


def _offered(spark, d):
    """The log's entries and those about features and modes, offered in batches by sockets and in modes of all sorts."""
    log = _log(spark, d)
    control = adapters.control(adapters.table(spark, d, "events")).select("pos", "type").join(log.select("pos", "k", "slug"), "pos")
    sort = lambda n, named: F.get(F.array(*[F.lit(named.get(i)) for i in range(n)]), (F.col("k") % n).cast("int"))
    rows = log.select("pos", "type", "k", "slug", (F.col("k") % 2 == 0).alias("typed"), F.lit(0).alias("c")).unionByName(
        control.select("pos", "type", "k", F.concat("slug", F.lit("-c")).alias("slug"), F.lit(False).alias("typed"), F.lit(1).alias("c"))
    )
    return rows.select(
        F.floor(F.col("pos") / 50).alias("batch"), (F.col("pos") * 2 + F.col("c")).alias("i"), "type", sort(10, {1: "admin", 2: "other"}).alias("socket"), sort(25, {3: "recovery", 4: "normal"}).alias("mode"), "slug", "typed"
    )


def _batch_codes(spark, d):
    ok = state.writes(_log(spark, d)).where("k < 20").select("slug").distinct()
    return admission.batch(_offered(spark, d), matrix(spark), ok)


@query(_OFFERED + " SELECT batch, i, code FROM codes")
def batch_admission(spark, d):
    return _batch_codes(spark, d)


@query(_OFFERED + " SELECT batch, min(i) FILTER (code IS NOT NULL) AS i, min_by(code, i) FILTER (code IS NOT NULL) AS code FROM codes GROUP BY batch")
def batch_whole(spark, d):
    """Which entry keeps each batch from being written."""
    return admission.whole(_batch_codes(spark, d))


@query("""m AS (SELECT pos, ['Prov 429: slow down', 'Prov 429: You exceeded your current quota', 'Prov 401: no', 'request timed out', 'read ECONNRESET', 'Prov 404: model', 'Prov 503: busy', 'Prov 402: pay', 'odd', 'Incorrect API key'][k % 10 + 1] AS t, k % 10 AS c FROM log WHERE event_type = 'error')
SELECT pos, ['rate_limited', 'quota_exceeded', 'auth_invalid', 'request_timeout', 'network_error', 'request_invalid', 'server_error', 'quota_exceeded', 'unknown', 'auth_invalid'][c + 1] AS code, [429, 429, 401, NULL, NULL, 404, 503, 402, NULL, NULL][c + 1] AS status, c IN (0, 3, 4, 6) AS retryable FROM m""")
def error_codes(spark, d):
    texts = ("Prov 429: slow down", "Prov 429: You exceeded your current quota", "Prov 401: no", "request timed out", "read ECONNRESET", "Prov 404: model", "Prov 503: busy", "Prov 402: pay", "odd", "Incorrect API key")
    own = _log(spark, d).where("type in ('TOPIC_BULLETS_RETIRED', 'TOPIC_SUGGESTED', 'TOPIC_SUGGESTION_ACCEPTED', 'TOPIC_SUGGESTION_DISMISSED')")
    message = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("k") % 10).cast("int"))
    return own.select("pos", answers.error_code(message).alias("e")).select("pos", "e.*")


@query(_ACTIVE + """, b AS (SELECT slug, string_agg(n || '. ' || content, chr(10) ORDER BY n) AS held FROM act JOIN log USING (slug, seq) GROUP BY slug),
r AS (SELECT slug, string_agg('[' || strftime(ts, '%Y-%m-%d') || '] [' || tag || '] ' || content, chr(10) ORDER BY place DESC) AS new FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY pos DESC) AS place FROM log WHERE type = 'write_event' AND tag <> 'CURATED') WHERE place <= 50 GROUP BY slug)
SELECT slug, md5('Topic: ' || slug || chr(10) || 'Current bullets:' || chr(10) || coalesce(held, '(none)') || chr(10) || 'Recent entries:' || chr(10) || new) AS text_md5 FROM r LEFT JOIN b USING (slug)""")
def curation_prompts(spark, d):
    log = _log(spark, d)
    live = state.writes(log).where("tag = 'CURATED'").join(state.retired_seqs(log), ["slug", "seq"], "left_anti")
    bullets = live.select("slug", F.row_number().over(Window.partitionBy("slug").orderBy("seq")).alias("n"), "content")
    recent = state.latest_writes(log).join(log.select("seq", F.date_format("ts", "yyyy-MM-dd").alias("day")), "seq")
    return answers.curation_prompts(bullets, recent).select("slug", F.md5("text").alias("text_md5"))


@query("""o AS (SELECT key, CASE WHEN label % 2 = 0 THEN 'note' ELSE 'curated' END AS tier, sha256(to_json(nfc_normalize(content))::VARCHAR) AS vector_key FROM units JOIN embeddings ON vec_id = doc_id)
SELECT live.key, coalesce(o.tier, live.tier) AS tier, vector_key FROM live LEFT JOIN o USING (key)""")
def unit_occurrences(spark, d):
    u = _units(spark, d)
    v = adapters.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    held = u.join(v, "doc_id").select("key", F.when(F.col("label") % 2 == 0, "note").otherwise("curated").alias("tier"), canonical.key_of(F.col("content")).alias("vector_key"))
    return retrieval.occurring(retrieval.live(u), held).select("key", "tier", "vector_key")


@query("""n AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) SELECT vec_id, round(s / n, 6) AS total FROM n""")
def vectors_normalized(spark, d):
    """The sum of each vector's components after it is given length 1, from three times the vector."""
    v = F.transform("embedding", lambda x: x.cast("double") * 3)
    total = F.aggregate(vectors.normalized(v), F.lit(0.0), lambda s, x: s + x)
    return adapters.table(spark, d, "embeddings").select("vec_id", F.round(total, 6).alias("total"))


@query("SELECT key, md5('passage: ' || content) AS text_md5 FROM live UNION ALL SELECT 'query ' || item_id, md5('query: ' || text) FROM benchmark")
def embedding_inputs(spark, d):
    u = retrieval.live(_units(spark, d)).select("key", F.md5(vectors.prefixed(F.col("content"), "passage", "e5-small")).alias("text_md5"))
    q = adapters.table(spark, d, "benchmark").select(F.concat(F.lit("query "), F.col("item_id").cast("string")).alias("key"), F.md5(vectors.prefixed(F.col("text"), "query", "e5-small")).alias("text_md5"))
    return u.unionByName(q)


def _registered() -> None:
    """Modules that put queries of their own here."""
    from . import kept  # noqa: F401


def queries() -> dict:
    _registered()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _registered()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_retrieve(spark, sf_dir)
