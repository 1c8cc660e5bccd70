"""One JSON array read in ranges gives what a parser of the whole file gives."""

import json
import random

import pytest

from ledgerlens.sources import json_array

STRINGS = ['plain', 'braces } { ] [ inside', 'quote " and \\ backslash', '\\', '\\\\"', 'ends with \\"', 'new\nline', '😀 é ü', '', '}}}}', '","', '],[', 'x' * 500 + '}' * 40]


def value(r, depth=0):
    k = r.randrange(7 if depth < 3 else 4)
    if k < 2:
        return r.choice(STRINGS)
    if k == 2:
        return r.choice([0, -1.5, 1e9, True, False, None])
    if k == 3:
        return "".join(r.choice('a"\\}{][,:') for _ in range(r.randrange(30)))
    if k == 4:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(STRINGS) + str(i): value(r, depth + 1) for i in range(r.randrange(4))}


def got(spark, path, size):
    rows = json_array.read(spark, path, size).orderBy("file", "block", "index").collect()
    return [json.loads(r.raw) for r in rows]


@pytest.mark.parametrize("size", [40, 300, 5000, None])
def test_ranges_of_any_size(spark, tmp_path, size):
    r = random.Random(1)
    whole = [value(r) for _ in range(60)] + [{"s": s} for s in STRINGS] + [[], {}, "", [[[]]], {"big": ["}" * 900, '"'] * 3}]
    file = tmp_path / "one.json"
    file.write_text(json.dumps(whole, ensure_ascii=False, indent=r.choice([None, 1])))
    assert got(spark, str(file), size) == whole


def test_space_and_empty_arrays(spark, tmp_path):
    for k, text in enumerate(["[]", " [ ] \n", "[1]", '[\n "a" ,\n {"b": [1, 2]}\n]\n', '["}"]']):
        file = tmp_path / f"{k}.json"
        file.write_text(text)
        assert got(spark, str(file), 30) == json.loads(text), text


def test_broken_files_are_refused(spark, tmp_path):
    for k, text in enumerate(['[{"a": 1}', '[{"a": "x}]', '[{"a": 1}]]']):
        file = tmp_path / f"{k}.json"
        file.write_text(text)
        with pytest.raises(ValueError):
            json_array.read(spark, str(file), 30)


def test_several_files(spark, tmp_path):
    parts = [[{"n": i, "s": "}" * i} for i in range(30)], ["only"], [{"m": [k] * k} for k in range(20)]]
    for k, p in enumerate(parts):
        (tmp_path / f"{k}.json").write_text(json.dumps(p))
    assert got(spark, str(tmp_path), 64) == [x for p in parts for x in p]
