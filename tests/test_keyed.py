"""Streams by key against walks over the same rows, stopped and started in between."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerlens.jobs import liveness, transcripts
from ledgerlens.sources.storage import scratch_path
from ledgerlens.streaming import keyed

HOUR = 3_600_000


def plain_notices(rows, until):
    """Each job by itself, hour rules spelled out; ``until``: how far time had come at the end."""
    out = []
    for slug in {r[0] for r in rows}:
        first = success = emitted = None
        lit, own = False, sorted(r for r in rows if r[0] == slug)
        looks = []
        for k, (_, _, ms, good) in enumerate(own):
            looks.append((ms, good, own[k + 1][2] if k + 1 < len(own) else until + 1))
        for ms, good, nxt in looks:
            first = ms if first is None else first
            success = ms if good else success
            due = first + 48 * HOUR + 1 if success is None else success + 72 * HOUR + 1
            for now in [ms, *([due] if ms < due < nxt else [])]:
                lit = success is not None and now - success > (24 if lit else 72) * HOUR
                kind = "curate_never_succeeded" if success is None and now - first > 48 * HOUR else "curate_liveness_stale" if lit else None
                if kind and (emitted is None or now - emitted > 6 * HOUR):
                    emitted = now
                    out.append((slug, kind, now))
    return sorted(out)


def runs(seed, n=400):
    r, t, out = random.Random(seed), datetime(2024, 1, 1, tzinfo=timezone.utc), []
    for i in range(n):
        t += timedelta(minutes=r.randrange(1, 200))
        out.append((f"s{r.randrange(6)}", i, t, r.random() < 0.06))
    return out


@pytest.mark.parametrize("cuts", [[], [130], [60, 150, 300]])
def test_notices(spark, cuts):
    rows = runs(7)
    df = spark.createDataFrame(rows, "slug string, seq long, ts timestamp, complete boolean")
    root = scratch_path(spark, "t")
    edges = [-1, *cuts, 10_000]
    parts = [F.col("seq").between(a + 1, b) for a, b in zip(edges, edges[1:], strict=False)]
    found = keyed.in_parts(df, parts, f"{root}/in", lambda s: keyed.notices(s, f"{root}/stream"))
    ms = lambda t: int(t.timestamp() * 1000)
    want = plain_notices([(s, i, ms(t), g) for s, i, t, g in rows], ms(rows[-1][2]))
    assert len(want) > 20 and {k for _, k, _ in want} == {"curate_never_succeeded", "curate_liveness_stale"}
    got = sorted((r.slug, r.kind, r.at_ms) for r in found.collect())
    assert got == want
    for (a, _, x), (b, _, y) in zip(got, got[1:], strict=False):
        assert a != b or abs(y - x) > 6 * HOUR or a == b and x > y


def test_a_silent_job_is_noticed_by_its_timer(spark):
    t = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [("quiet", 0, t, True), ("other", 1, t + timedelta(days=1), True), ("other", 2, t + timedelta(days=5), True)]
    df, root = spark.createDataFrame(rows, "slug string, seq long, ts timestamp, complete boolean"), scratch_path(spark, "t")
    found = keyed.in_parts(df, [F.col("seq") < 2, F.col("seq") == 2], f"{root}/in", lambda s: keyed.notices(s, f"{root}/stream")).collect()
    base = int(t.timestamp() * 1000)
    assert {(r.slug, r.kind, r.at_ms - base) for r in found} == {("quiet", "curate_liveness_stale", 72 * HOUR + 1), ("other", "curate_liveness_stale", 96 * HOUR + 1)}


def test_hysteresis_goes_on_after_a_stop(spark):
    r = random.Random(2)
    rows = [(f"s{r.randrange(5)}", i, r.choice([0.5, 1.0, 2.0, 3.0, 3.5, 5.0])) for i in range(300)]
    df, root = spark.createDataFrame(rows, "slug string, seq long, gap double"), scratch_path(spark, "t")
    parts = [F.col("seq") < 90, F.col("seq").between(90, 200), F.col("seq") > 200]
    got = keyed.in_parts(df, parts, f"{root}/in", lambda s: keyed.hysteresis(s, f"{root}/stream")).collect()
    want = liveness.hysteresis(df).collect()
    key = lambda rows: sorted((r.slug, r.flips, r.is_stale) for r in rows)
    assert key(got) == key(want) and max(r.flips for r in got) > 5


def test_offsets_read_nothing_twice(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "tool"]), r.choice(["some words here", "/command", "two  spaces", ""])) for c in range(20) for t in range(r.randrange(1, 12))]
    df, root = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), scratch_path(spark, "t")
    parts = [F.col("turn") < 3, F.col("turn").between(2, 6), F.col("turn") > 5]  # some come twice
    got = keyed.in_parts(df, parts, f"{root}/in", lambda s: keyed.offsets(s, f"{root}/stream")).collect()
    est = {x.conv_id: x for x in transcripts.estimate(transcripts.delta(df)).collect()}
    last = {}
    for c, t, *_ in rows:
        last[c] = max(t, last.get(c, -1))
    assert {x.conv_id: x.last_turn for x in got} == last
    assert all(x.n_messages == (est[x.conv_id].n_messages if x.conv_id in est else 0) for x in got)
