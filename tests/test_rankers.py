"""Sessions ranked by words, vectors and both; the share of cases that comply."""

from ledgerlens.jobs import evals, rankers, vector_store

TURNS = [
    (1, 0, "user", "the garden has tomatoes"), (1, 1, "assistant", "tomatoes tomatoes"), (1, 2, "user", "and basil"), (2, 0, "user", "train tickets"),
    (2, 1, None, "garden party"), (3, 0, "assistant", "garden tomatoes"), (4, 0, "user", None),
]


def test_rankers(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    asked = spark.createDataFrame([(7, "garden tomatoes"), (8, "train basil")], "qid long, text string")
    found = rankers.rank_all(turns, asked, vector_store.COUNTING, vector_store.COUNTING)
    rows = {name: sorted((r.qid, r["rank"], r.session) for r in df.collect()) for name, df in found.items()}
    # all words in one turn; else any of them: what only assistants said doesn't count
    assert rows["lexical"] == [(7, 1, "1"), (8, 1, "1"), (8, 2, "2")] or rows["lexical"] == [(7, 1, "1"), (8, 1, "2"), (8, 2, "1")]
    assert [s for q, _, s in rows["semantic"] if q == 7] and {s for _, _, s in rows["semantic"]} == {"1", "2", "4"}
    place = {n: {(q, s): k for q, k, s in r} for n, r in rows.items()}
    for q in (7, 8):
        score = {s: 0.5 / (60 + place["lexical"].get((q, s), 1e18)) + 1 / (60 + place["semantic"][q, s]) for s in ("1", "2", "4")}
        assert [s for p, _, s in rows["hybrid"] if p == q] == sorted(score, key=lambda s: (-round(score[s], 9), s))


def test_compliance(spark):
    hits = spark.createDataFrame([(1, "a", "curated"), (1, "b", "note"), (2, "a", "note"), (3, "a", "curated")], "qid long, slug string, tier string")
    cases = lambda *rows: spark.createDataFrame(list(rows), "qid long, correct_slug string, wrong_tier string")
    value = lambda c: evals.compliance(hits, c).first().compliance
    assert value(cases((1, "a", "note"), (2, "a", "note"), (3, "b", "source"), (3, "a", "curated"))) == 25.0
    assert value(cases((1, "a", "source"))) == 100.0 and value(cases((1, "a", "note")).limit(0)) == 100.0
