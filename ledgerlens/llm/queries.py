"""Queries over the given tables, one for each operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, exact_dedup, merkle, packing, pieces, quality_rules, quality_sites, secret_scan, simhash, suffixes, token_store, toxicity
from .common import scratch_path, table


def _held_out(doc_col: str = "doc_id"):
    """Rows that toxicity is never learned from: crc32 of the id in decimal divides by 5."""
    return F.coalesce(F.crc32(F.col(doc_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~_held_out()))
    return toxicity.score(docs, model).select(
        "doc_id", _held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_text=False
    )
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees")


def op3_quality_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are sources, paths the languages within them."""
    found = quality_sites.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id"])
    return found.select("doc_id", "evidence", "host_mean", "path_mean", "posterior", "kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=3, width=3)
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, max_tokens=1024
    )
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    token_store.write(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0
    )
    return token_store.with_crc32(token_store.with_start(token_store.read(spark, path)))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop("redacted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rated(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.aligned(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), with_groups=False
    )
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the id's checksum, one is added to n_chars after the manifest was made."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_sites": op3_quality_sites,
    "op4_simhash": op4_simhash,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_token_store": op6_token_store,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_format": op10_chat_format,
    "op11_token_alignment": op11_token_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_suffix_dedup": op13_suffix_dedup,
}
ORACLES: dict[str, str] = {
    "op7_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM n
    """,
    "op9_quality_rules": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
          FROM documents
        ), windows AS (
          SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
                 unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS k
          FROM d WHERE len(w) > 2
        ), twice AS (
          SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1
        ), covered AS (
          SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id
        ), lines AS (
          SELECT doc_id, unnest(lines) AS x FROM d
        ), judged AS (
          SELECT doc_id, length(x) AS chars,
                 regexp_matches(x, '[.!?…。！？]["'')\]»”’]*[\x20\x09-\x0D]*\z')
                 AND len(regexp_extract_all(x, '[#*$%&|<>]')) * 10 < len(regexp_extract_all(x, '[^\x20\x09-\x0D]'))
                 AND len(regexp_extract_all(x, '!!')) * 20 < len(regexp_extract_all(x, '[^\x20\x09-\x0D]'))
                 AND len(regexp_extract_all(x, '\p{Lu}')) * 2 < len(regexp_extract_all(x, '[^\x20\x09-\x0D]'))
                 AND len(regexp_extract_all(x, '[|»›•·→]')) < 2
                 AND NOT regexp_matches(x, '(?i)all rights reserved|cookie policy|privacy policy|terms of (use|service)|accept cookies|enable javascript|sign in|log in|subscribe to|share this|click here') AS good
          FROM lines
        ), chars AS (
          SELECT doc_id, sum(chars) AS line_chars, coalesce(sum(chars) FILTER (good), 0) AS good_chars FROM judged GROUP BY doc_id
        ), base AS (
          SELECT d.doc_id, len(w)::BIGINT AS n_words,
                 length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                 len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                 coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
                 coalesce(line_chars, 0) AS line_chars, coalesce(good_chars, 0) AS good_chars
          FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN chars USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND good_chars >= line_chars * 0.5 AS kept
        FROM base
    """,
    "op10_chat_format": r"""
        WITH t AS (
          SELECT coalesce(conv_id::VARCHAR, 'row ' || row_number() OVER ()) AS key, conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
        ), r AS (
          SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn, role, text) - 1 AS rank FROM t
        ), c AS (
          SELECT key, conv_id, count(*) AS n_turns, list([role, text] ORDER BY rank) AS l FROM r GROUP BY key, conv_id
        ), whole AS (
          SELECT min_by(key, (conv_id IS NULL, conv_id, key)) AS key, count(*) AS copies, n_turns, l FROM c GROUP BY n_turns, l
        ), proper AS (
          SELECT DISTINCT k, l[1:k] AS l FROM (SELECT l, unnest(range(1, n_turns)) AS k FROM c)
        ), parts AS (
          SELECT key, conv_id, rank // 512 AS part,
                 string_agg('<|' || lower(role) || '|>' || chr(10) || trim(text, ' ') || chr(10) || '<|end|>', chr(10) ORDER BY rank) AS rendered
          FROM r GROUP BY key, conv_id, rank // 512
        )
        SELECT parts.conv_id, part::BIGINT AS part, whole.n_turns, copies, rendered
        FROM whole JOIN parts ON parts.key = whole.key
        WHERE NOT EXISTS (SELECT 1 FROM proper WHERE k = whole.n_turns AND proper.l = whole.l)
    """,
    "op12_merkle_manifest": r"""
        WITH RECURSIVE bytes AS (  -- crc32 of the id's digits, bit by bit
          SELECT doc_id, source, lang, n_chars, text,
                 xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                   lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
                     lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 7 = 0 AS hit
          FROM documents
        ), fields AS (
          SELECT doc_id, lang, hit AND n_chars IS NOT NULL AS hit,
                 coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                 coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS own,
                 coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS more,
                 coalesce(strlen(text) || ':' || text, '-') AS tail
          FROM bytes
        ), leaves AS (
          SELECT doc_id, lang, sha256(head || own || tail) AS leaf,
                 CASE WHEN hit THEN sha256(head || more || tail) ELSE sha256(head || own || tail) END AS found,
                 row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos
          FROM fields
        ), t AS (
          SELECT coalesce(':' || lang, '-') AS tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
          UNION ALL
          SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2)
          FROM t WHERE n > 1 GROUP BY tree, level, pos // 2
        ), roots AS (
          SELECT tree, h AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS lang_pos FROM t WHERE n = 1
        ), u AS (
          SELECT 0 AS level, lang_pos AS pos, subroot AS h, count(*) OVER () AS n FROM roots
          UNION ALL
          SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2)
          FROM u WHERE n > 1 GROUP BY level, pos // 2
        ), own AS (
          SELECT doc_id, leaf, found, pos, tree, subroot, height, lang_pos, root, top
          FROM leaves JOIN roots ON tree = coalesce(':' || lang, '-'), (SELECT h AS root, level AS top FROM u WHERE n = 1)
        ), steps AS (
          SELECT doc_id, t.level AS step, ((own.pos >> t.level) & 1) = 1 AS at_left, t.h
          FROM own JOIN t ON t.tree = own.tree AND t.level < own.height AND t.pos = xor(own.pos >> t.level, 1)
          UNION ALL
          SELECT doc_id, own.height + u.level, ((own.lang_pos >> u.level) & 1) = 1, u.h
          FROM own JOIN u ON u.level < own.top AND u.pos = xor(own.lang_pos >> u.level, 1)
        ), proofs AS (
          SELECT doc_id, sha256(coalesce(string_agg(h, '' ORDER BY step) FILTER (h IS NOT NULL), '')) AS proof_sha256
          FROM own LEFT JOIN steps USING (doc_id) GROUP BY doc_id
        ), f AS (
          SELECT doc_id, 0 AS step, found AS h, height + top AS last FROM own
          UNION ALL
          SELECT f.doc_id, f.step + 1, sha256(CASE WHEN s.at_left THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), last
          FROM f LEFT JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step WHERE f.step < last
        )
        SELECT doc_id, leaf, subroot, root, proof_sha256, f.h AS folded_root, f.h = root AS verified
        FROM own JOIN proofs USING (doc_id) JOIN f USING (doc_id) WHERE f.step = f.last
    """,
    "op13_suffix_dedup": r"""
        WITH d AS (
          SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
        ), stretches AS (  -- 500 bytes and what the strings that begin there need
          SELECT doc_id, n, c * 500 AS base, substr(h, 1000 * c + 1, 1198) AS h FROM (SELECT *, unnest(range((n + 499) // 500)) AS c FROM d)
        ), bytes AS (
          SELECT doc_id, base + i AS p, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN base + i + 100 <= n THEN md5_number(substr(h, 2 * i + 1, 200)) END AS s
          FROM (SELECT *, unnest(range(least(500, n - base))) AS i FROM stretches)
        ), seen AS (
          SELECT doc_id, p, byte, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS again FROM bytes
        ), gone AS (
          SELECT doc_id, p, byte, max(again::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) = 1 AS gone FROM seen
        ), runs AS (
          SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS head FROM gone
        ), found AS (
          SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept
          FROM runs GROUP BY doc_id
        )
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN found USING (doc_id)
    """,
}
