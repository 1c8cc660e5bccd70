"""The fold by months against a fold of the whole log, entry by entry."""

import json
import os
import random

import pytest

from ledgerlens.sources import jsonl
from ledgerlens.sources.storage import scratch_path
from ledgerlens.streaming import fold

DAY = 86_400_000


def entry(r, seq, month):
    kind = r.choice(["write_event"] * 3 + ["TOPIC_METADATA_SET", "TOPIC_BULLETS_RETIRED", "TOPIC_SUGGESTED", "TOPIC_SUGGESTED", "TOPIC_SUGGESTION_ACCEPTED", "TOPIC_SUGGESTION_DISMISSED"])
    p = {"topic" if r.random() < 0.5 else "slug": f"s-{r.randrange(5)}"}
    if kind == "write_event":
        p["tag"] = r.choice(["CURATED", "FACT"])
    elif kind == "TOPIC_METADATA_SET":
        p["k"] = r.randrange(100)
    elif kind == "TOPIC_BULLETS_RETIRED":
        p["superseded_seqs"] = [r.randrange(1, seq + 3) for _ in range(r.randrange(3))]
    elif kind == "TOPIC_SUGGESTION_ACCEPTED":
        p["suggestion_seq"] = r.randrange(1, seq + 2)
    elif kind == "TOPIC_SUGGESTION_DISMISSED":
        p |= {"suggestion_seqs": [r.randrange(1, seq + 2) for _ in range(r.randrange(1, 3))], "cooldown_days": r.randrange(1, 30)}
    return {"type": kind, "seq": seq, "ts": f"{month}-{1 + seq % 27:02d}T00:00:00Z", "payload": p}


def plain(lines):
    """Every relation by one walk over all lines."""
    from datetime import datetime

    slugs, writes, meta, curated, retired, made, resolved = set(), {}, {}, {}, set(), {}, {}
    for e in map(json.loads, lines):
        p, seq = e["payload"], e["seq"]
        slug = p.get("topic", p.get("slug"))
        if e["type"] == "write_event":
            slugs.add(slug)
            n, _ = writes.get(slug, (0, 0))
            writes[slug] = n + 1, seq
            if p["tag"] == "CURATED":
                curated[slug, seq] = True
        elif e["type"] == "TOPIC_METADATA_SET":
            slugs.add(slug)
            meta[slug] = p["k"]
        elif e["type"] == "TOPIC_BULLETS_RETIRED":
            retired |= {(slug, s) for s in p["superseded_seqs"] if (slug, s) in curated}
        elif e["type"] == "TOPIC_SUGGESTED":
            made[seq] = slug
        else:
            for s in p.get("suggestion_seqs", [p.get("suggestion_seq")]):
                if s in made and s not in resolved:
                    resolved[s] = (e["type"], seq, p.get("cooldown_days"), e["ts"])
    lasting = {}
    gone = []
    for s, (kind, seq, days, ts) in sorted(resolved.items(), key=lambda x: x[1][1]):
        key = made[s].replace("-", "")
        if kind.endswith("ACCEPTED"):
            gone = [g for g in gone if g[0] != key or g[1] >= seq]
        else:
            gone.append((key, seq, int(datetime.fromisoformat(ts).timestamp() * 1000) + days * DAY))
    for key, seq, until in gone:
        if key not in lasting or (until, -seq) > (lasting[key][1], -lasting[key][0]):
            lasting[key] = seq, until
    status = {s: ("pending", None) if s not in resolved else ("accepted" if resolved[s][0].endswith("ACCEPTED") else "dismissed", resolved[s][1]) for s in made}
    return {
        "slugs": slugs, "topics": {(s, *writes.get(s, (0, None)), meta.get(s)) for s in {*writes, *meta}}, "retired": retired,
        "suggestions": {(s, made[s], *status[s]) for s in made}, "cooldowns": {(k, *v) for k, v in lasting.items()},
    }


def got(part):
    rows = lambda df, *c: {tuple(r) for r in df.select(*c).collect()}
    return {
        "slugs": {s for (s,) in rows(fold.admissible(part), "slug")}, "topics": rows(fold.topics(part), "slug", "n_writes", "last_seq", "meta_k"),
        "retired": rows(fold.retired(part), "slug", "seq"), "suggestions": rows(fold.suggestions(part), "suggestion_seq", "slug", "status", "resolver_seq"),
        "cooldowns": rows(fold.cooldowns(part), "slug_key", "dismissal_seq", "until_ms"),
    }


@pytest.fixture
def log(spark, tmp_path):
    """A log of four months, as (folder, {month: lines}, a function that writes a month)."""
    r, seq, months = random.Random(3), 0, {}
    for m in ("2024-01", "2024-02", "2024-03", "2024-04"):
        months[m] = []
        for _ in range(60):
            seq += 1
            months[m].append(json.dumps(entry(r, seq, m)))

    def put(month, end="\n"):
        (tmp_path / f"{month}.jsonl").write_text("\n".join(months[month]) + end)

    for m in months:
        put(m)
    return str(tmp_path), months, put, scratch_path(spark, "fold-test")


def everything(months):
    return [x for m in sorted(months) for x in months[m]]


def test_appends_fold_the_newest_month_alone(spark, log):
    path, months, put, root = log
    first = fold.fold(spark, path, root)
    assert first.folded == sorted(months) and first.sealed_anew and got(first.part) == plain(everything(months))
    r = random.Random(4)
    months["2024-04"] += [json.dumps(entry(r, 240 + i, "2024-04")) for i in range(1, 30)]
    put("2024-04")
    second = fold.fold(spark, path, root)
    assert (second.folded, second.kept, second.sealed_anew) == (["2024-04"], ["2024-01", "2024-02", "2024-03"], False)
    assert got(second.part) == plain(everything(months))
    # a new month seals the last one: what was folded of it counts as long as its file stays
    months["2024-05"] = [json.dumps(entry(r, 300 + i, "2024-05")) for i in range(40)]
    put("2024-05")
    third = fold.fold(spark, path, root)
    assert third.folded == ["2024-05"] and third.sealed_anew and got(third.part) == plain(everything(months))


def test_rewritten_months_are_folded_again(spark, log):
    path, months, put, root = log
    fold.fold(spark, path, root)
    months["2024-02"] = months["2024-02"][:20] + months["2024-02"][25:]
    put("2024-02")
    found = fold.fold(spark, path, root)
    assert found.folded == ["2024-02", "2024-04"] and found.sealed_anew and got(found.part) == plain(everything(months))
    # same size, same time: only the lines themselves tell
    file = os.path.join(path, "2024-01.jsonl")
    before = os.stat(file)
    at = next(i for i, x in enumerate(months["2024-01"]) if '"FACT"' in x)
    months["2024-01"][at] = months["2024-01"][at].replace('"seq": ', '"seq":  ').replace(', "ts"', ',"ts"')
    months["2024-01"][at] = months["2024-01"][at].replace('"s-', '"t-')
    put("2024-01")
    os.utime(file, ns=(before.st_atime_ns, before.st_mtime_ns))
    assert os.stat(file).st_size == before.st_size
    assert fold.fold(spark, path, root).folded == ["2024-04"]
    found = fold.fold(spark, path, root, verify=True)
    assert found.folded == ["2024-01", "2024-04"] and got(found.part) == plain(everything(months))


def test_torn_blank_and_missing(spark, log):
    path, months, put, root = log
    months["2024-04"] += ["", "no json"]
    put("2024-04", end='\n{"type": "write_event", "seq": 999')
    found = fold.fold(spark, path, root)
    kept = [x for x in everything(months) if x.startswith("{")]
    assert got(found.part) == plain(kept) and fold.tail(found.part).first().last_seq == 240
    os.remove(os.path.join(path, "2024-03.jsonl"))
    del months["2024-03"]
    found = fold.fold(spark, path, root)
    assert found.folded == ["2024-04"] and got(found.part) == plain([x for x in everything(months) if x.startswith("{")])
    assert fold.fold(spark, path + "/none", root + "-none").part.count() == 0


def test_a_month_that_changes_meanwhile(spark, log, monkeypatch):
    path, months, put, root = log
    real, calls = jsonl.month_files, []

    def moving(*a):
        calls.append(1)
        return {m: [(n, s, t + len(calls)) for n, s, t in v] for m, v in real(*a).items()}

    monkeypatch.setattr(jsonl, "month_files", moving)
    found = fold.fold(spark, path, root)
    assert not found.published and got(found.part) == plain(everything(months))


def test_one_month_reads_one_file(spark, log):
    path, months, _, _ = log
    read = jsonl.read(spark, path, ["2024-02"])
    assert read.count() == 60 and {r.log_file for r in read.select("log_file").distinct().collect()} == {"2024-02.jsonl"}
    assert [os.path.basename(n) for n, _, _ in jsonl.month_files(spark, path)["2024-02"]] == ["2024-02.jsonl"]
