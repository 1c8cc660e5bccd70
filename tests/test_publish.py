"""Files are made anew for topics with new entries, and seen one version at a time."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.jobs import publish
from ledgerlens.operators import projection
from ledgerlens.sources import adapters, versions
from ledgerlens.sources.storage import scratch_path

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    return adapters.log(adapters.table(spark, D, "events"))


def files(df):
    return {r.slug: hashlib.sha256(r.text.encode()).hexdigest() for r in df.collect()}


def test_updates_touch_what_changed(spark, log):
    root = scratch_path(spark, "t")
    assert publish.load(spark, root).version == 0 and publish.load(spark, root).texts().count() == 0
    first = publish.update(log.where("pos < 700"), root)
    assert files(first.texts()) == files(projection.topic_files(log.where("pos < 700"))) and first.head == 699
    few = log.where("pos < 704")
    second = publish.update(few, root)
    assert 0 < second.made <= 4 and second.changed <= second.made and files(second.texts()) == files(projection.topic_files(few))
    since = {r.slug: (r.since, r.sha256) for r in second.index.collect()}
    before = {r.slug: (r.since, r.sha256) for r in first.index.collect()}
    assert sum(v[0] == 2 for v in since.values()) == second.changed
    assert all(before[k] == v for k, v in since.items() if v[0] == 1)
    again = publish.update(few, root)
    assert (again.made, again.changed, again.head) == (0, 0, 703) and files(again.texts()) == files(second.texts())


def test_readers_see_one_version(spark, log, monkeypatch):
    root = scratch_path(spark, "t")
    first = publish.update(log.where("pos < 500"), root)
    want, seen = files(first.texts()), []

    def late(*a, real=versions.publish):
        seen.append(files(publish.load(spark, root).texts()))  # all is written, nothing published
        real(*a)

    monkeypatch.setattr(publish, "publish", late)
    second = publish.update(log, root)
    assert seen == [want] and files(second.texts()) != want and files(first.texts()) == want

    def lost(*a):
        raise OSError("lost")

    monkeypatch.setattr(publish, "publish", lost)
    with pytest.raises(OSError):
        publish.update(log.where("pos < 0"), root)
    assert publish.load(spark, root).version == 2 and files(publish.load(spark, root).texts()) == files(second.texts())


def test_plain_files(spark, log, tmp_path):
    found, out = publish.update(log, scratch_path(spark, "t")), str(tmp_path / "out")
    publish.exported(found, out)
    got = {}
    for folder, _, names in os.walk(out):
        for n in names:
            if n.endswith(".txt"):
                with open(os.path.join(folder, n)) as f:
                    got[os.path.basename(folder).split("=")[1]] = hashlib.sha256(f.read().encode()).hexdigest()
    assert got == {r.slug: r.sha256 for r in found.index.select("slug", "sha256").collect()} and F is not None
