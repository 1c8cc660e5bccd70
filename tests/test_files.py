"""Markdown taken apart and imported, readers, answers, and streams that resume."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from ledgerlens.jobs import answers, imports, liveness, reading, transcripts
from ledgerlens.sources import markdown
from ledgerlens.streaming import incremental

TOPIC = """---
topic: pets
type: hobby
tags: [rover, "a, b"]
entities: ['Dr: Who']
status: active
sensitivity: private
created: 2026-04-01
last_verified: 2026-04-03
summary: >
  Rover loves walks.
  Daily routine: yes.
---

Preface.

<!-- CURATED_START -->

Lost text.

## Current State

- Walks

## Empty

## Routine
- Feed

<!-- CURATED_END -->

<!-- SOURCE_START -->

### 2026-04-22 — Visit — vet
> All clear.

### 2026-04-23 - Second
more

<!-- SOURCE_END -->
"""
PLAIN = "---\ntype: reference\nsummary: one line\n\n---\n<!-- CURATED_START -->\nno headings here\n"


def files(spark, **texts):
    return spark.createDataFrame([(f"topics/{k.replace('_', '-')}.md", v) for k, v in texts.items()], "path string, text string")


def test_topic_files_become_entries(spark):
    df = files(spark, pets=TOPIC, plain=PLAIN, old_archive=TOPIC, broken="no front matter")
    got = sorted(imports.topic_entries(df, "me", "2026-05-01T00:00:00Z").collect(), key=lambda r: (r.source_file, r.at))
    pets = [r for r in got if r.source_file == "topics/pets.md"]
    assert [(r.type, r.tag, r.ts[:10]) for r in pets] == [
        ("TOPIC_METADATA_SET", None, "2026-04-01"), ("TOPIC_VERIFIED", None, "2026-04-03"), ("write_event", "FACT", "2026-04-01"), ("write_event", "CURATED", "2026-04-01"),
        ("write_event", "CURATED", "2026-04-01"), ("write_event", "SOURCE", "2026-04-22"), ("write_event", "SOURCE", "2026-04-23"), ("ACL_SEALED", None, "2026-04-01"),
    ]
    about = json.loads(pets[0].detail)
    assert about["tags"] == ["rover", "a, b"] and about["entities"] == ["Dr: Who"] and about["type"] == "hobby" and about["summary_trailing_blank"] is False
    assert pets[2].content == "Rover loves walks.\nDaily routine: yes."
    assert [r.content for r in pets[3:7]] == ["## Current State\n\n- Walks", "## Routine\n\n- Feed", "### 2026-04-22 — Visit — vet\n> All clear.", "### 2026-04-23 — Second\nmore"]
    assert (pets[-1].principal, pets[-1].socket) == ("operator", "admin") and {r.principal for r in pets[:-1]} == {"me"}
    plain = [r for r in got if r.source_file == "topics/plain.md"]
    assert [(r.type, r.slug, r.content) for r in plain] == [("TOPIC_METADATA_SET", "plain", None), ("write_event", "plain", "one line"), ("write_event", "plain", "no headings here")]
    assert [tuple(r) for r in imports.errors(df).collect()] == [("topics/broken.md", "no front matter")]
    assert {r.source_file for r in got} == {"topics/pets.md", "topics/plain.md"}


LOG = """# Event Log
<!-- auto: first -->

[FACT] pets: [rover.1] walked   
not a line
[AUTO-TODO:TENTATIVE] house: paint it

<!-- second -->
# Later
[EVENT] Bad_Slug: no
[DECISION] pets: keep: him"""


def test_dated_logs_become_entries(spark):
    df = spark.createDataFrame([("events/2026-03-15.md", LOG), ("events/2026-03-16.md", "[FACT] house: again"), ("events/notes.md", LOG)], "path string, text string")
    got = sorted(imports.log_entries(df, spark.createDataFrame([("pets",)], "slug string"), "op").collect(), key=lambda r: (r.source_file, r.at))
    assert [(r.source_file[7:17], r.type, r.slug, r.principal, r.content, r.ts[11:]) for r in got] == [
        ("2026-03-15", "TOPIC_METADATA_SET", "house", "op", None, "12:00:00Z"), ("2026-03-15", "write_event", "pets", "rover.1", "walked", "12:00:00Z"),
        ("2026-03-15", "write_event", "house", "op", "paint it", "12:00:01Z"), ("2026-03-15", "write_event", "pets", "op", "keep: him", "12:00:02Z"), ("2026-03-16", "write_event", "house", "op", "again", "12:00:00Z"),
    ]
    d = [json.loads(r.detail) for r in got[1:4]]
    assert [(x["source_line"], x.get("context_comment"), x["prefix_blanks"], x.get("date_header"), x["principal_was_prefixed"], x["auto_extracted"], x.get("confidence")) for x in d] == [
        (4, "auto: first", 1, "# Event Log", True, False, None), (6, "auto: first", 0, None, False, True, "TENTATIVE"), (11, "second", 0, None, False, False, None),
    ]
    assert d[0]["raw_line"] == "[FACT] pets: [rover.1] walked" and d[0]["first_of_date"] and not d[1]["first_of_date"]
    assert sorted((r.path[-8:], r.events, r.unrecognized) for r in imports.counts(df).collect())[0] == ("03-15.md", 3, 2)


def test_timestamps(spark):
    rows = [("2026-04-01",), ("2026-04-01T10:00:00+02:00",), ("May",), (None,)]
    got = [r.t for r in spark.createDataFrame(rows, "v string").select(markdown.iso_timestamp(F.col("v")).alias("t")).collect()]
    assert got == ["2026-04-01T00:00:00Z", "2026-04-01T08:00:00.000Z", None, None]


def test_ids_and_layers(spark):
    asked = ["topic:pets", "topic:pets#layer-1", "topic:pets#layer-2", "topic:pets#layer-9", "topic:Bad_Slug", "topic:PETS", "topic:none-such", "topic:no-file", "event:2026-05-19:1543", "handoff:2026-x.md", "", "random", None]
    ids = spark.createDataFrame(list(enumerate(asked)), "ask_id int, id string")
    index = spark.createDataFrame([("pets",), ("no-file",)], "slug string")
    got = {r.ask_id: r for r in reading.fetched(ids, spark.createDataFrame([("pets", TOPIC)], "slug string, text string"), index).collect()}
    codes = [got[i].code for i in range(len(asked))]
    assert codes == [None, None, None, "FETCH_UNKNOWN_ID", "FETCH_UNKNOWN_ID", "FETCH_UNKNOWN_ID", "FETCH_NOT_FOUND", "FETCH_FILE_MISSING", "FETCH_KIND_DEFERRED", "FETCH_KIND_DEFERRED", "FETCH_UNKNOWN_ID", "FETCH_UNKNOWN_ID", "FETCH_UNKNOWN_ID"]
    assert got[0].id == "topic:pets#layer-2" and "Walks" in got[0].text and "All clear" not in got[0].text and "status: active" in got[1].text


def test_index_and_dates(spark):
    lines = ["# Topics", "```", "| pets | hobby | a, b | active | Rover. |", "x | y | z", "Last generated: now", "house | reference |  | active | Home | more"]
    got = [tuple(r) for r in reading.index_rows(spark.createDataFrame([(x,) for x in lines], "line string")).collect()]
    assert got == [("pets", "hobby", ["a", "b"], "active", "Rover."), ("house", "reference", [], "active", "Home")]
    assert reading.index_error(reading.index_rows(spark.createDataFrame([("x",)], "line string"))).first().code == "INDEX_PARSE_ERROR"
    logs = spark.createDataFrame([(f"2026-03-{x}", f"[FACT] pets: [bot] day {x}\n<!-- c -->\n[AUTO-FACT:CONFIRMED] house: day {x}") for x in (14, 15, 16)], "date string, text string")
    both = reading.events(logs, "2026-03-16", days=2)
    assert sorted((r.date[-2:], r.slug, r.source, r.confidence) for r in both.collect()) == [("15", "house", None, "CONFIRMED"), ("15", "pets", "bot", None), ("16", "house", None, "CONFIRMED"), ("16", "pets", "bot", None)]
    assert reading.events(logs, "2026-03-16", 30, exclude_source="bot", slug="pets").count() == 0
    with pytest.raises(ValueError):
        reading.events(logs, "2026-03-16", 31)


def test_survivors_are_greedy(spark):
    import random

    r = random.Random(7)
    rows = [(b, i, " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(r.randrange(0, 7)))) for b in range(6) for i in range(40)]
    got = {(x.batch, x.i) for x in answers.survivors(spark.createDataFrame(rows, "batch int, i int, content string"), 0.6).collect()}
    want, held = set(), {}
    for b, i, t in rows:
        own = set(t.split())
        if not any(own and len(own & h) / len(own | h) >= 0.6 for h in held.setdefault(b, [])):
            want.add((b, i))
            held[b].append(own)
    assert got == want


def test_short_stretches_move_the_offset(spark):
    turns = spark.createDataFrame([(1, t, "user", "word " * 10) for t in range(4)] + [(2, t, "user", "word " * 300) for t in range(3)] + [(3, 0, "tool", "x")], "conv_id long, turn long, role string, text string")
    done = spark.createDataFrame([(2, 2)], "conv_id long, last_turn long")
    got = {r.conv_id: (r.last_turn, r.token_estimate, r.ready) for r in transcripts.advanced(turns, done).collect()}
    assert got == {1: (3, 30, False), 3: (0, 0, False)}


def test_job_status_variants(spark):
    rows = [(1, 10, "curate run started", "curate"), (2, 20, "curate run complete", "curate"), (3, 30, "curate run failed (exit=1)", "curate"), (4, 40, "curate run failed (exit=2)", None), (5, 50, "detect insufficient events", None), (6, 60, "detect first run deferred", None)]
    e = spark.createDataFrame(rows, "seq long, ms long, content string, source string")
    c, d = liveness.status(e, "curate", True).first(), liveness.status(e, "detect", False).first()
    assert (c.last_run_ms, c.last_success_ms, c.consecutive_failures, c.last_failure, c.last_kind) == (30, 20, 1, "curate run failed (exit=1)", "failed")
    assert (d.last_run_ms, d.last_success_ms, d.consecutive_failures, d.last_kind, d.deferred) == (60, 50, 0, "deferred", True)
    assert liveness.status(e, "other", False).count() == 0


def test_streams_resume_where_they_stopped(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 3, ("purchase", "view", "click")[i % 3], 1.0, '{"k": 5}', f"2024-01-0{1 + i % 5} 00:00:00") for i in range(40)], "event_id long, user_id long, event_type string, value double, props string, t string")
    events = events.select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
    src, root = tmp_path / "in", str(tmp_path / "state")
    events.where("event_id < 25").repartition(3).write.parquet(str(src))
    first = {r.slug: r.n_writes for r in incremental.run(spark, str(src), root=root).collect()}
    assert sum(first.values()) == 25
    events.where("event_id >= 25").coalesce(1).write.mode("append").parquet(str(src))
    again = {r.slug: (r.n_writes, r.last_seq) for r in incremental.run(spark, str(src), root=root).collect()}
    assert sum(n for n, _ in again.values()) == 40 and max(s for _, s in again.values()) == 40
    assert {r.slug: (r.n_writes, r.last_seq) for r in incremental.run(spark, str(src), root=root).collect()} == again  # nothing new
    assert len([x for x in (tmp_path / "state").iterdir() if x.name.startswith("snapshot-")]) <= 2
    shutil.rmtree(root)
