"""Appends to logs that exist, two writers on one tail, and walks that go on from an anchor."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.jobs import append
from ledgerlens.operators import chain
from ledgerlens.sources.storage import scratch_path
from ledgerlens.sources.versions import Conflict

SCHEMA = "log string, pos long, type string, intent_id string, principal string, ts string, payload string"


def entries(spark, n, start=0, logs=3):
    rows = [(f"l{i % logs}", i, "write_event", f"i{i}", "p", "2024-01-01T00:00:00Z", '{"b": 1, "a": "é"}') for i in range(start, n)]
    return spark.createDataFrame(rows, SCHEMA)


def lines(df):
    return sorted((r.log, r.seq, r.pos, r.hash_prev, r.self_hash, r.raw) for r in df.collect())


def test_parts_make_the_same_log(spark):
    root, whole = scratch_path(spark, "t"), entries(spark, 40)
    assert append.read(spark, root).version == 0
    for a, b in ((0, 10), (10, 11), (11, 40)):
        found = append.append(whole.where(F.col("pos").between(a, b - 1)), root)
    assert found.version == 3 and found.entries == 40 and lines(found.lines) == lines(chain.written(whole))
    tails = {r.log: (r.seq, r.hash) for r in found.tails.collect()}
    want = {}
    for log, seq, _, _, own, _ in lines(found.lines):
        want[log] = (seq, own)
    assert tails == want


def test_two_writers_leave_one_winner(spark):
    root = scratch_path(spark, "t")
    base = append.append(entries(spark, 9), root)
    first, second = (append.stage(entries(spark, k + 6, k), root, base) for k in (9, 100))
    won = append.commit(spark, root, second)
    with pytest.raises(Conflict):
        append.commit(spark, root, first)
    now = append.read(spark, root)
    assert now.version == won.version == 2 and {r.pos for r in now.lines.collect()} == {*range(9), *range(100, 106)}
    after = append.append(entries(spark, 15, 9), root)  # the loser chains anew
    rows = after.lines.collect()
    assert after.version == 3 and len(rows) == 21
    by = {(r.log, r.seq): r for r in rows}
    assert all(r.hash_prev == (by[r.log, r.seq - 1].self_hash if r.seq > 1 else chain.GENESIS) for r in rows)


def test_a_lost_race_is_run_again(spark, monkeypatch):
    root = scratch_path(spark, "t")
    append.append(entries(spark, 6), root)
    real, raced = append.commit, []

    def racing(s, r, staged):
        if not raced:
            raced.append(1)
            real(s, r, append.stage(entries(spark, 53, 50), r, staged.base))
        return real(s, r, staged)

    monkeypatch.setattr(append, "commit", racing)
    found = append.append(entries(spark, 9, 6), root)
    assert found.version == 3 and found.entries == 12
    assert {(r.log, r.seq) for r in found.lines.collect()} == {(f"l{k}", s) for k in range(3) for s in range(1, 5)}


@pytest.mark.parametrize("cut", [0, 1, 37, 80, 119])
def test_walks_go_on_from_an_anchor(spark, cut):
    r = random.Random(cut)
    rows = [(x.log, x.pos, x.hash_prev, "changed" if r.random() < 0.04 else x.self_hash) for x in chain.written(entries(spark, 120, logs=2)).collect() if r.random() > 0.04]
    df = spark.createDataFrame(rows, "log string, pos long, hash_prev string, self_hash string")
    key = lambda d: sorted((x.log, x.pos) for x in d.collect())
    before = df.where(F.col("pos") < cut)
    held = chain.accepted(before)
    more = chain.accepted(df, chain.anchors(before, held))
    assert key(held) + key(more) != [] and sorted(key(held) + key(more)) == key(chain.accepted(df))
