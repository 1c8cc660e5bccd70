"""Dated logs come back as they were, and entries imported from elsewhere lose their rank."""

from pyspark.sql import functions as F

from ledgerlens.jobs import imports
from ledgerlens.operators import projection, retrieval

TEXT = """# Friday, the 5th

[FACT] alpha: one
[AUTO-CURATED:HIGH] beta: [helder] two words


<!-- session of the morning -->
[SOURCE] alpha:   spaced   out
[TODO] gamma: same comment
<!-- another -->
[FACT] alpha: three

<!-- session of the morning -->
[FACT] alpha: back
"""
PLAIN = "[FACT] a: no header\n[FACT] a: no blank\n"


def again(spark, files):
    none = spark.createDataFrame([], "slug string")
    rows = imports.log_entries(spark.createDataFrame(files, "path string, text string"), none).where("type = 'write_event'")
    return rows.select(F.substring("source_file", 1, 10).alias("date"), F.col("at").alias("seq"), "tag", "slug", "principal", "content", F.from_json("detail", projection.HINTS).alias("hints"))


def test_dated_logs_come_back_byte_for_byte(spark):
    files = [("2024-01-05.md", TEXT), ("2024-01-06.md", PLAIN), ("2024-01-07.md", "# only\n\n<!-- c -->\n[FACT] a: x\n")]
    got = {r.date: r.text for r in projection.regenerated(again(spark, files)).collect()}
    assert got == {p[:10]: t for p, t in files}


def test_lines_are_made_from_their_parts(spark):
    native = [
        ("d", 1, "FACT", "a", "p1", "two\nlines\r\nhere", None), ("d", 2, None, None, "p1", None, None),
        ("d", 3, "TODO", "b", "p2", "x", (None, "c1", None, None, True, "LOW", True)), ("d", 4, "TODO", "b", "p2", "y", ("", "c1", None, None, None, None, None)),
        ("d", 5, "TODO", "b", "p2", "z", (None, "", 2, None, None, None, False)), ("d", 6, "TODO", "b", "p2", "z", (None, "c1", None, None, None, None, None)),
        ("e", 1, "FACT", "a", "p", "x", (None, "c", None, "# e", None, None, None)),
    ]
    df = spark.createDataFrame(native, f"date string, seq long, tag string, slug string, principal string, content string, hints struct<{projection.HINTS.replace(' ', ':').replace(',:', ',')}>")
    got = {r.date: r.text for r in projection.regenerated(df).collect()}
    assert got["d"] == "[FACT] a: two ⏎ lines ⏎ here\n[EVENT] general: \n\n<!-- c1 -->\n[AUTO-TODO:LOW] b: [p2] x\n[TODO] b: y\n\n\n[TODO] b: z\n[TODO] b: z\n"
    assert got["e"] == "# e\n\n<!-- c -->\n[FACT] a: x\n"
    changes = projection.context_changes(df.select("date", "seq", F.col("hints.context_comment").alias("comment")))
    assert {r.date: r.changes for r in changes.collect()} == {"d": 1, "e": 1}


def test_entries_imported_from_elsewhere_are_notes(spark):
    rows = [("CURATED", None), ("CURATED", "curated"), ("CURATED", "source"), ("CURATED", "events"), ("SOURCE", None), ("SOURCE", "source"), ("SOURCE", "curated"), ("FACT", "curated")]
    df = spark.createDataFrame([(f"s::{i}::0", "s", i, t, False, "x", f) for i, (t, f) in enumerate(rows)], "key string, slug string, seq long, tag string, retired boolean, content string, imported_field string")
    got = [r.tier for r in retrieval.live(df).orderBy("seq").collect()]
    assert got == ["curated", "curated", "note", "note", "source", "source", "note", "note"]
    assert [r.tier for r in retrieval.live(df.withColumn("retired", F.lit(True))).orderBy("seq").collect()] == ["source", "source", "note", "note"]
