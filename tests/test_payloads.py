"""Rules on whole payloads as JSON."""

from pyspark.sql import functions as F

from ledgerlens.operators import admission


def test_accepted_payloads(spark):
    cases = {
        '{"suggestion_seq": 3, "accepted_slug": "a-b"}': None, '{"accepted_slug": "a-b", "suggestion_seq": 3.0}': None, "[1]": "payload:must_be_object", "no json": "payload:must_be_object", "3": "payload:must_be_object",
        "{}": "suggestion_seq:required", '{"x": 1, "y": 2}': "x:unknown_field", '{"suggestion_seq": "3", "accepted_slug": "a-b"}': "suggestion_seq:must_be_safe_positive_integer",
        '{"suggestion_seq": null, "accepted_slug": "a-b"}': "suggestion_seq:must_be_safe_positive_integer", '{"suggestion_seq": 0, "accepted_slug": "a-b"}': "suggestion_seq:must_be_safe_positive_integer",
        '{"suggestion_seq": 1.5, "accepted_slug": "a-b"}': "suggestion_seq:must_be_safe_positive_integer", '{"suggestion_seq": 9007199254740993, "accepted_slug": "a-b"}': "suggestion_seq:must_be_safe_positive_integer",
        '{"suggestion_seq": true, "accepted_slug": "a-b"}': "suggestion_seq:must_be_safe_positive_integer", '{"suggestion_seq": 12, "accepted_slug": "a-b"}': "suggestion_seq:future_or_unknown_seq",
        '{"suggestion_seq": 3}': "accepted_slug:required", '{"suggestion_seq": 3, "accepted_slug": 4}': "accepted_slug:must_be_string", '{"suggestion_seq": 3, "accepted_slug": "a"}': "accepted_slug:length_out_of_range",
        '{"suggestion_seq": 3, "accepted_slug": "A b"}': "accepted_slug:slug_regex_mismatch",
    }
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "p string")
    got = {r.p: r.r for r in df.select("p", admission.accepted_reason(F.col("p"), F.lit(11)).alias("r")).collect()}
    assert got == {**cases, None: "payload:must_be_object"}


def test_a_mark_anywhere_in_a_payload(spark):
    rows = ['{"content": "x", "deep": [{"__mark__": 1}]}', '{"content": "says __mark__ here"}', '{"content": "clean mark"}', None]
    df = spark.createDataFrame([(r,) for r in rows], "p string").withColumns({"slug": F.lit("ab"), "content": F.lit("x"), "tag": F.lit("FACT"), "n": F.lit(None).cast("string")})
    c = F.col
    reason = admission.write_payload_reason(c("slug"), c("content"), c("tag"), c("n"), c("n"), c("p"), "__mark__")
    assert [r.r for r in df.select(reason.alias("r")).collect()] == ["payload:retrieval_origin"] * 2 + [None] * 2
