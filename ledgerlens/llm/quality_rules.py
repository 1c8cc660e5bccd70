"""Line-first cleaning, in built-in functions alone.

Each line is judged by itself: its punctuation (it ends like a sentence and isn't
made of symbols, shouting or exclamation marks), navigation (menus, crumbs and
table rows) and boilerplate (rights, cookie and login notices). Failing lines go;
a document that loses too much of its text goes too. Base counts over the whole
text - words, symbols, repeated lines, repeated three-word windows - decide first.

A null text has no words, like an empty one: it fails the base rules and keeps no
lines. Rows are judged one by one, so ties and repeated rows are of no account;
other columns pass through ``rated`` unless they bear the name of a result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, let, text_or_empty

MIN_WORDS = 50
#: Percentage of words in repeated windows beyond which a text fails.
MAX_REPEATED = 50
#: Share of a text's visible characters that must stay after line cleaning.
MIN_KEPT = 0.5

# Marks and phrases of the line rules.
SENTENCE_END = r"[.!?…。！？][\"')\]»”’]*[\x20\x09-\x0D]*\z"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·→"
PHRASES = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "accept cookies",
    "enable javascript", "sign in", "log in", "subscribe to", "share this", "click here",
)
BOILERPLATE = "(?i)" + "|".join(PHRASES)


def _left(text: Column, others: str) -> Column:
    """How many characters are left without the runs that ``others`` matches: no array of matches is built."""
    return F.length(F.regexp_replace(text, others, ""))


def line_passes(line: Column) -> Column:
    """Whether a line of text passes the punctuation and navigation rules."""
    symbols = _left(line, f"[^{SYMBOLS}]+")
    shouts = (F.length(line) - F.length(F.replace(line, F.lit("!!")))) / 2
    capitals = _left(line, r"\P{Lu}+")
    # a line that is looked at has a visible character: its sentence end
    calm = let(_left(line, SPACE), lambda visible: (symbols * 10 < visible) & (shouts * 20 < visible) & (capitals * 2 < visible))
    return line.rlike(SENTENCE_END) & calm & (_left(line, f"[^{SEPARATORS}]+") < 2)


def good_lines(text: Column, lines: Column) -> Column:
    """The lines that pass all rules. Phrases are looked for in single lines only where the whole text has one."""
    some = let(F.lower(text), lambda low: reduce(or_, [F.contains(low, F.lit(x)) for x in PHRASES]))
    return F.when(some, F.filter(lines, lambda x: line_passes(x) & ~x.rlike(BOILERPLATE))).otherwise(F.filter(lines, line_passes))


def _windows(w: Column) -> Column:
    return F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))


def _starts(s: Column, same) -> Column:
    """Places, in order, of those windows in ``s``, sorted structs with a place ``i``, that are the ``same`` as a neighbour."""
    marked = F.transform(s, lambda x, j: F.when(same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)), x["i"]))
    return F.sort_array(F.array_compact(marked))


def _covered(starts: Column) -> Column:
    """Words in three-word windows that begin at these ascending places."""
    own = F.transform(starts, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - x, F.lit(3))))
    return F.aggregate(own, F.lit(0), lambda s, x: s + x)


def _repeated_windows(w: Column, h: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first occurrence included.

    Distinct hashes mean distinct windows. Where some are equal, windows are sorted by hash
    and neighbours of one hash compared in full; should two different ones share a hash,
    windows are sorted as texts instead.
    """
    by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    by_text = F.sort_array(
        F.transform(_windows(w), lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    )
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    word = lambda x, k: F.get(w, x["i"] + k)
    unlike = lambda x, y: same(x, y) & ((word(x, 0) != word(y, 0)) | (word(x, 1) != word(y, 1)) | (word(x, 2) != word(y, 2)))

    def counted(s: Column) -> Column:
        collide = F.exists(F.transform(s, lambda x, j: unlike(x, F.get(s, j + 1))), lambda x: x)
        return F.when(F.coalesce(collide, F.lit(False)), let(by_text, lambda t: let(_starts(t, same), _covered))).otherwise(
            let(_starts(s, same), _covered)
        )

    return F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(let(by_hash, counted))


def rated(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text, kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "kept"]
    rest = [c for c in docs.columns if c not in names]
    t = text_or_empty(text_col)
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"),
        t.alias("t"),
        F.array_remove(F.split(t, SPACE), "").alias("w"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_SPACE)).alias("lines"),
        _left(t, f"[^{SYMBOLS}]+").cast("long").alias("n_symbols"),
    )
    w, h = F.col("w"), F.col("h")
    hashed = F.transform(_windows(w), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    row = row.withColumn("h", hashed).withColumn("good", good_lines(F.col("t"), F.col("lines")))
    chars = lambda a: F.length(F.array_join(a, "")).cast("long")
    row = row.select(
        "row",
        F.size(w).cast("long").alias("n_words"),
        chars(w).alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_windows(w, h).cast("long").alias("n_repeat_words"),
        chars(F.col("lines")).alias("line_chars"),
        chars(F.col("good")).alias("good_chars"),
        F.array_join("good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    row = row.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("good_chars") >= F.col("line_chars") * MIN_KEPT)
    return row.withColumn("kept", kept).select("row.*", *names)


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, their text reduced to the lines that pass."""
    found = rated(docs, text_col).where("kept")
    return found.select(*[F.col("clean_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
