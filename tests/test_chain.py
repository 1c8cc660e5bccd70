"""The set-based chain against a sequential walk, and entries written, read back and hashed."""

import hashlib
import json
import os
import random
import unicodedata

from pyspark.sql import functions as F

from ledgerlens.functions import canonical
from ledgerlens.operators import chain
from ledgerlens.sources import jsonl
from ledgerlens.sources.storage import scratch_path

SCHEMA = "log string, pos long, self_hash string, hash_prev string"


def walk(rows):
    kept, last = [], chain.GENESIS
    for pos, own, prev in rows:
        if prev == last:
            kept.append(pos)
            last = own
    return kept


def random_log(seed):
    r = random.Random(seed)
    rows, last = [], chain.GENESIS
    for i in range(r.randrange(1, 60)):
        own = hashlib.sha256(f"{seed}:{i}:{r.random()}".encode()).hexdigest()
        rows.append([own, last])
        last = own
    for _ in range(r.randrange(0, 9)):
        i = r.randrange(len(rows))
        kind = r.randrange(4)
        if kind == 0:
            rows[i][1] = "f" * 64
        elif kind == 1:
            rows.insert(r.randrange(len(rows)), list(rows[i]))
        elif kind == 2:  # a forged entry that the next one doesn't know
            rows.insert(i, ["e" * 64, rows[i][1]])
        else:
            rows.pop(i)
            if not rows:
                break
    return [(i, a, b) for i, (a, b) in enumerate(rows)]


def test_accepts_what_the_walk_accepts(spark):
    logs = {f"log {seed}": random_log(seed) for seed in range(60)}
    df = spark.createDataFrame([(k, *row) for k, rows in logs.items() for row in rows], SCHEMA)
    got = sorted((r.log, r.pos) for r in chain.accepted(df).collect())
    assert got == sorted((k, pos) for k, rows in logs.items() for pos in walk(rows))
    assert chain.accepted(df.limit(0)).count() == 0


def test_every_entry_in_a_run_of_its_own(spark):
    # entries alternate between two interleaved chains: no entry follows the one before it
    rows, a, b = [], chain.GENESIS, "x" * 64
    for i in range(0, 200, 2):
        rows += [("l", i, f"a{i}", a), ("l", i + 1, f"b{i}", b)]
        a, b = f"a{i}", f"b{i}"
    assert sorted(r.pos for r in chain.accepted(spark.createDataFrame(rows, SCHEMA)).collect()) == list(range(0, 200, 2))


def test_canonical_json():
    assert canonical.of_json('{"b": 1.0, "a": [true, null, "e\\u0301"], "": {"z": "\\n", "B": -0.0}}') == '{"":{"B":0,"z":"\\n"},"a":[true,null,"é"],"b":1}'
    cases = {"1e21": "1e+21", "1e20": "100000000000000000000", "0.000001": "0.000001", "1e-7": "1e-7", "123.456": "123.456", "-1.5e-10": "-1.5e-10", "9007199254740993": "9007199254740992", "1.2e300": "1.2e+300", "5e-324": "5e-324"}
    assert {k: canonical.of_json(k) for k in cases} == cases
    assert canonical.of_json('{"\\ud83d\\ude00": 1, "\\uffee": 2}').startswith('{"😀"')  # by UTF-16 units
    assert canonical.of_json("{oops") is None and canonical.of_json(None) is None


def test_keys_are_hashes_of_composed_quoted_strings(spark):
    words = ["café", unicodedata.normalize("NFD", "café"), 'a"b', "", None]
    got = [r.k for r in spark.createDataFrame([(w,) for w in words], "w string").select(canonical.key_of(F.col("w")).alias("k")).collect()]
    of = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == [of('"café"'), of('"café"'), of('"a\\"b"'), of('""'), None]


def entries(n):
    return [("l", i, "write_event", f"i{i}", "me", f"2024-0{1 + i // 4}-01T00:00:0{i % 10}Z", json.dumps({"slug": "s", "content": f"é {i}"})) for i in range(n)]


def written(spark, n):
    return chain.written(spark.createDataFrame(entries(n), "log string, pos long, type string, intent_id string, principal string, ts string, payload string"))


def test_month_files_with_damage(spark):
    lines = [r.raw for r in sorted(written(spark, 12).collect(), key=lambda r: r.seq)]
    folder = scratch_path(spark, "months").removeprefix("file://")
    os.makedirs(f"{folder}/sub")
    files = {
        "2024-01.jsonl": lines[0] + "\n\n" + lines[1] + "\r\n" + "null\n" + lines[2] + "\n{broken\n" + lines[3] + "\n",
        "2024-02.jsonl": lines[4] + "\n" + lines[4] + "\n" + lines[5],  # the last line lacks its line feed
        "2024-03.jsonl": "",
        "2024-04.jsonl": '{"seq": 9, "type": "write_event"}\n',
        "notes.jsonl": lines[6] + "\n",
        "2024-05.txt": lines[7] + "\n",
    }
    for name, text in files.items():
        with open(f"{folder}/{name}", "w", newline="") as f:
            f.write(text)
    rows = jsonl.parsed(jsonl.read(spark, folder)).collect()
    good = sorted((r.log_file, r.seq) for r in rows if r.shape_ok)
    assert good == [("2024-01.jsonl", 1), ("2024-01.jsonl", 2), ("2024-01.jsonl", 3), ("2024-01.jsonl", 4), ("2024-02.jsonl", 5), ("2024-02.jsonl", 5)]
    assert sorted(r.raw for r in rows if not r.shape_ok) == ["null", '{"seq": 9, "type": "write_event"}']
    by_seq = {r.seq: r.self_hash for r in rows if r.shape_ok}
    assert by_seq == {i + 1: hashlib.sha256(lines[i].encode()).hexdigest() for i in range(5)}
    assert jsonl.read(spark, folder, months=["2024-02"]).count() == 2
    last = jsonl.tail(spark, folder).first()
    assert (last.log_file, last.seq) == ("2024-04.jsonl", 9)
    os.remove(f"{folder}/2024-04.jsonl")
    assert jsonl.tail(spark, folder).first().seq == 6  # a torn line is the physical tail
    ordered = sorted(rows, key=lambda r: (r.log_file, r.place))
    numbered = [("l", i, r.hash_prev, r.self_hash, r.shape_ok, r.seq) for i, r in enumerate(ordered)]
    df = spark.createDataFrame(numbered, "log string, pos long, hash_prev string, self_hash string, shape_ok boolean, seq long")
    skips = sorted((r.pos, r.reason) for r in chain.skipped(df).collect())
    assert skips == [(2, "malformed_entry_shape"), (6, "hash_chain_break"), (7, "malformed_entry_shape")]
    assert chain.strict(chain.skipped(df)).first().refused


def test_written_months_read_back_in_order(spark):
    path = scratch_path(spark, "months")
    rows = written(spark, 12)
    jsonl.write(rows.select("seq", F.get_json_object("raw", "$.ts").alias("ts"), "raw").repartition(4), path, line="raw")
    back = jsonl.parsed(jsonl.read(spark, path)).collect()
    assert {r.log_file for r in back} == {"2024-01.jsonl", "2024-02.jsonl", "2024-03.jsonl"}
    assert [r.seq for r in sorted(back, key=lambda r: (r.log_file, r.place))] == list(range(1, 13))
    assert {r.seq: r.self_hash for r in back} == {r.seq: r.self_hash for r in rows.collect()}
    held = chain.accepted(spark.createDataFrame([("l", r.seq, r.hash_prev, r.self_hash) for r in back], "log string, pos long, hash_prev string, self_hash string"))
    assert held.count() == 12
