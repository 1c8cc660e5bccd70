"""Text functions as Column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the tokenizer, Portuguese and English.
PT_STOP = (
    "de a o e do da em um uma para com por que se no na os as dos das ao à "
    "isto isso ele ela eles elas mas ou como por quando onde quem seu sua "
    "este esta esse essa meu minha teu tua"
).split()
EN_STOP = (
    "the a an is are was were be been has have had will would should could "
    "of in on at to for and or but not this that we i you he she they it "
    "from with by as do does did"
).split()
READER_STOP = (
    "de a o e do da em um uma para com que na no os as se ao dos das por "
    "the a an is are was were be been have has had do does did will would could should may might can shall not and or but if "
    "then than so at by for in of on to with from up out into over after"
).split()
WORD_CHARS = "0-9A-Za-z_àáâãéêíóôõúç"
# The same one by one: Java looks characters of a class up in one table, but tries its ranges one after another.
EACH_WORD_CHAR = string.digits + string.ascii_letters + WORD_CHARS[9:]
SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*$"


def tokens(text: Column) -> Column:
    """Lower-cased words of over two characters that are no stop words, in order."""
    stop = list(dict.fromkeys(PT_STOP + EN_STOP))
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), rf"[^{EACH_WORD_CHAR}]+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop))


def reader_tokens(text: Column) -> Column:
    """The second tokenizer, of readers: lower-cased runs between white space and punctuation, of over one character and no stop words, each once."""
    stop = list(dict.fromkeys(READER_STOP))
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{P}]+"), lambda w: (F.length(w) > 1) & ~w.isin(*stop)))


def normalized_query(query: Column) -> Column:
    """The query's tokens joined by spaces; the query itself where none is left."""
    joined = F.array_join(tokens(query), " ")
    return F.when(joined == "", query).otherwise(joined)


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Similarity of two arrays as sets; what two empty ones are worth differs from use to use."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(union == 0, F.lit(both_empty)).otherwise(both / union)


def slug_ok(slug: Column) -> Column:
    return slug.rlike(SLUG) & F.length(slug).between(2, 40)


def slug_key(slug: Column) -> Column:
    """Slugs that differ in case or hyphens alone share a key."""
    return F.replace(F.lower(slug), F.lit("-"), F.lit(""))


def first_sentence(text: Column) -> Column:
    """Up to the first sentence end before a capital or the text's end; else the first line, cut at 160 characters."""
    t = F.trim(text)
    sentence = F.regexp_extract(t, r"(?s)^.+?[.!?](?=\s+[A-Z]|\s*\z)", 0)
    line = F.trim(F.split_part(t, F.lit("\n"), F.lit(1)))
    cut = F.when(F.length(line) <= 160, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, 160)), F.lit("…")))
    return F.when(sentence != "", F.trim(sentence)).otherwise(cut)


def positional_tokens(text: Column) -> Column:
    """Runs of letters, numbers and underscores, and other visible characters one by one."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\s]"), 0)


# A token by position, and stretches of 64 of them with the white space after each, which windows begin and end at.
TOKEN = r"(?:[\p{L}\p{N}_]+|[^\s])"
STRETCH = rf"(?s)^\s+|(?:{TOKEN}\s*){{1,64}}"


def chunks(text: Column, size: int = 256, overlap: int = 64, ceiling: int = 512) -> Column:
    """(chunk_index, char_start, char_end, content) of a text's token windows; one whole chunk up to the ceiling.

    ``size`` and ``overlap`` are multiples of 64: windows are runs of stretches, so their texts
    and places are exact.
    """
    def cut(s: Column) -> Column:
        lead = F.when(F.get(s, F.lit(0)).rlike(r"^\s"), F.lit(1)).otherwise(F.lit(0))
        count = F.size(s) - lead
        n = F.when(count > 0, (count - 1) * 64 + F.size(positional_tokens(F.get(s, F.size(s) - 1)))).otherwise(F.lit(0))
        before = lambda w: lead + F.floor(w["token_start"] / 64).cast("int")
        length = lambda a: F.aggregate(a, F.lit(0), lambda k, x: k + F.length(x))
        part = lambda w: F.array_join(F.slice(s, before(w) + 1, F.ceil((w["token_end"] - w["token_start"]) / 64).cast("int")), "")
        many = F.transform(
            windows(n, size, overlap, ceiling),
            lambda w: F.struct(
                w["chunk_index"].cast("int").alias("chunk_index"),
                length(F.slice(s, F.lit(1), before(w))).alias("char_start"),
                F.regexp_replace(part(w), r"\s+$", "").alias("content"),
            ),
        )
        one = F.array(F.struct(F.lit(0).alias("chunk_index"), F.lit(0).alias("char_start"), text.alias("content")))
        return F.when(n <= ceiling, one).otherwise(many)

    found = F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(STRETCH), 0)), cut), 1)
    return F.transform(
        found,
        lambda c: F.struct(
            c["chunk_index"].alias("chunk_index"), c["char_start"].alias("char_start"),
            (c["char_start"] + F.length(c["content"])).alias("char_end"), c["content"].alias("content"),
        ),
    )


def windows(n: Column, size: int = 256, overlap: int = 64, ceiling: int = 512) -> Column:
    """(chunk_index, token_start, token_end) of a unit of ``n`` tokens: one up to the ceiling, else overlapping windows."""
    step = size - overlap
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    many = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(i.alias("chunk_index"), (i * step).alias("token_start"), F.least(i * step + size, n).alias("token_end")),
    )
    one = F.array(F.struct(F.lit(0).alias("chunk_index"), F.lit(0).alias("token_start"), n.alias("token_end")))
    return F.when(n <= ceiling, one).otherwise(many)


def support_fingerprint(seqs: Column) -> Column:
    """Sixteen hex digits that name a set of sequence numbers."""
    return F.substring(F.sha2(F.to_json(F.array_sort(F.array_distinct(seqs))), 256), 1, 16)


def ascending(seqs: Column) -> Column:
    """Whether an array of positive numbers strictly ascends."""
    return (F.size(seqs) > 0) & F.forall(
        F.sequence(F.lit(1), F.size(seqs)),
        lambda i: (F.get(seqs, i - 1) > 0) & F.coalesce(F.get(seqs, i - 1) > F.get(seqs, i - 2), F.lit(True)),
    )
