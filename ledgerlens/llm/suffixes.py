"""Removal of bytes whose 100-byte strings occur earlier, by a sparse suffix array.

Every string of 100 bytes is led to one place inside it, its anchor: where the least
hash of its 24-byte strings stands. Equal strings have equal anchors at equal
distances, so only suffixes that begin at anchors are sorted, about one in forty, to
the right and, reversed, to the left:

1. documents are packed into units, written once; each unit tells the hashes of its
   anchors, and hears which of them the table has more than once;
2. for those, the bytes that the anchor's strings span go to the task of that hash;
3. there both sides are put in order by deep-shallow sorting (``deep_shallow``).
   Neighbours' shared prefixes tell which strings of 100 bytes are the same: all but
   the earliest are repeats;
4. the repeats' spans go back to their units, and are taken out.

Spans equal to an earlier one of the same unit never leave it. An anchor that ``hot``
places or more have is taken apart into its single strings, each a key of its own;
copies of such a string are reduced over ``fan_in`` units at a time, round by round,
so that no task gathers all of them.

Rows come in order of their ids, then of their place in the written units; rows
without an id come first; rows with one id are documents of their own. Null texts are
empty. Texts are cut into pieces that overlap, so any length works; a text of one
repeated byte has an anchor at every byte. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, scratch_path, small_batches, text_or_empty
from .deep_shallow import sort
from .word_ids import raw

#: Bytes of a string, and of those whose hashes choose its anchor.
SIZE, GRAM = 100, 24
SPAN = SIZE - GRAM  # the farthest that an anchor is from its string's start
#: Strings looked at together, and bytes of spans that one task sorts, about.
PIECE, PART_BYTES = 1 << 17, 8 << 20
#: Hashes that one task counts, about.
COUNTED = 1 << 20
#: Places of an anchor from which it is taken apart; units reduced together.
HOT, FAN_IN = 100_000, 4096
#: Answers to units that are broadcast at most; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE_BITS = 24  # documents of a unit

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _powers:
        _powers.clear()
        both = []
        for base in (_BASE, _INVERSE):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            both.append(np.cumprod(x))
        _powers[n] = (both[0], both[1])
    return _powers[n]


def hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each string of ``size`` bytes."""
    up, down = _power(PIECE + 2 * SIZE)
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(up[:n] * (data.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _spread(h: np.ndarray) -> np.ndarray:
    """Hashes evenly spread again, one to one: the least of many are all small."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, first, last): runs of strings that share an anchor, and where the first and last begin.

    ``ends``: where each text of ``data`` ends; strings lie within texts.
    """
    found = []
    for start in range(0, max(len(data) - SIZE + 1, 0), PIECE):
        part = data[start : start + PIECE + SIZE - 1]
        h = hashes(part, GRAM)
        # the least hash, and of equal ones the leftmost: the place fills the lower bits
        low = np.uint64((1 << 18) - 1)
        least = h & ~low | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < SPAN + 1:
            rest = SPAN + 1 - width
            least = np.minimum(least[:-rest], least[rest:])
        at = np.arange(start, start + len(least))
        inside = at + SIZE <= ends[np.searchsorted(ends, at, side="right")]
        at, place = at[inside], (least[inside] & low).astype(np.int64)
        if not len(at):
            continue
        new = np.ones(len(at), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (np.diff(at) != 1)
        head = np.flatnonzero(new)
        found.append((_spread(h[place[head]]), start + place[head], at[head], at[np.append(head[1:], len(at)) - 1]))
    if not found:
        nothing = np.zeros(0, dtype=np.int64)
        return nothing.astype(np.uint64), nothing, nothing, nothing
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# ---- units -----------------------------------------------------------------

_UNIT = "unit long, ids binary, nulls binary, ends binary, data binary"


def units(docs: DataFrame, doc_col: str, text_col: str, unit_rows: int) -> DataFrame:
    """Written rows of many documents each: ids, where texts end, and the texts' bytes; ordered by id within a unit."""
    spark = docs.sparkSession
    small_batches(spark, rows=unit_rows)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            ids, null = np.asarray(batch.column(0).fill_null(np.iinfo(np.int64).min)), np.asarray(batch.column(0).is_null())
            order = np.lexsort((np.arange(len(ids)), ids, ~null))
            data, at = raw(batch.column(1).take(pa.array(order)))
            columns = [ids[order].tobytes(), null[order].astype(np.uint8).tobytes(), at[1:].tobytes(), data.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([part << 33 | k], pa.int64()), *(pa.array([x], pa.binary()) for x in columns)], ["unit", "ids", "nulls", "ends", "data"])

    packed = docs.select(F.col(doc_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(lean(run), _UNIT)
    path = scratch_path(spark, "suffix-units")
    # few rows to a row group: readers hold one at a time
    packed.write.option("parquet.block.row.count.limit", 4).option("compression", "zstd").parquet(path)
    small_batches(spark)
    return spark.read.schema(_UNIT).parquet(path)


class Unit:
    def __init__(self, ids, nulls, ends, data):
        self.ids, self.nulls = np.frombuffer(ids, dtype="<i8"), np.frombuffer(nulls, dtype=bool)
        self.ends, self.data = np.frombuffer(ends, dtype="<i8"), np.frombuffer(data, dtype=np.uint8)
        self.starts = np.concatenate(([0], self.ends[:-1]))


def _unit_rows(batch: pa.RecordBatch):
    for unit, *columns in zip(*(batch.column(batch.schema.names.index(c)) for c in ("unit", "ids", "nulls", "ends", "data")), strict=True):
        yield unit.as_py(), Unit(*(memoryview(c.as_buffer()) for c in columns))


# ---- which anchors the table has more than once ----------------------------


def _told(hash_bits: int):
    """Each unit's distinct hashes by their upper bits, and how many anchors have them (255 for more)."""

    def run(batches):
        for batch in batches:
            for unit, own in _unit_rows(batch):
                found, n = np.unique(anchors(own.data, own.ends)[0], return_counts=True)
                if not len(found):
                    continue
                n = np.minimum(n, 255).astype(np.uint8)
                part = (found >> np.uint64(64 - hash_bits)).astype(np.int64) if hash_bits else np.zeros(len(found), dtype=np.int64)
                edges = np.flatnonzero(np.diff(part, prepend=-1))
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)], strict=True):
                    columns = [pa.array([int(part[a])]), pa.array([unit]), pa.array([found[a:b].tobytes()], pa.binary()), pa.array([n[a:b].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "unit", "hashes", "counts"])

    return run


def _answered(hot: int):
    """For each unit's hashes whether the table has them more than once, and ``hot`` times, as bits."""

    def run(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), dtype="<u8") for x in table["hashes"]]
        n = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint8) for x in table["counts"]]).astype(np.int64)
        _, index = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(index), dtype=np.int64)
        np.add.at(total, index, n)
        total = total[index]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        bits = lambda flags: [np.packbits(x).tobytes() for x in np.split(flags, ends)]
        return pa.table(
            {
                "unit": table["unit"], "part": table["part"], "size": pa.array([len(k) for k in keys], pa.int64()), "again": pa.array(bits(total > 1), pa.binary()),
                "hot": pa.array(bits(total >= hot), pa.binary()), "places": pa.array([int(x[y > 1].sum()) for x, y in zip(np.split(n, ends), np.split(total, ends), strict=True)], pa.int64()),
            }
        )

    return run


_ANSWER = "unit long, part long, size long, again binary, hot binary, places long"


def _joined(rows: DataFrame, answers: DataFrame, size: int, limit: int) -> DataFrame:
    """Units with what came back for them: broadcast if that is small, by a shuffle otherwise."""
    return rows.join(F.broadcast(answers) if size <= limit else answers.hint("shuffle_merge"), "unit", "left")


# ---- spans -----------------------------------------------------------------

#: kind 0: spans to be sorted; kind 1: bytes of a unit to remove.
_SPANS = "kind int, part long, salt long, unit long, hashes binary, docs binary, places binary, offsets binary, firsts binary, lasts binary, texts binary"
_NAMES = [x.split()[0] for x in _SPANS.split(", ")]


class Spans:
    """Places of anchors with the bytes their strings span: hash, document, place, and in the document the anchor, the first string and the last."""

    dtypes = ("<u8", "<i8", "<i8", "<i8", "<i8", "<i8")

    def __init__(self, columns, texts: list[bytes]):
        self.hash, self.doc, self.place, self.anchor, self.first, self.last = columns
        self.texts = texts

    @classmethod
    def read(cls, table: pa.Table) -> Spans:
        columns = [np.concatenate([np.frombuffer(x.as_py(), dtype=d) for x in table[c]]) for c, d in zip(_NAMES[4:10], cls.dtypes, strict=True)]
        data, ends = b"".join(x.as_py() for x in table["texts"]), np.cumsum(columns[5] - columns[4] + SIZE).tolist()
        return cls(columns, [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])

    def rows(self, kind_part, salt: int, unit: int) -> pa.Table:
        """The spans by part, a row for each."""
        order = np.argsort(kind_part, kind="stable")
        edges = np.flatnonzero(np.diff(kind_part[order], prepend=-1))
        rows = []
        for own in np.split(order, edges[1:]) if len(order) else []:
            columns = [np.ascontiguousarray(c[own].astype(d)).tobytes() for c, d in zip((self.hash, self.doc, self.place, self.anchor, self.first, self.last), self.dtypes, strict=True)]
            rows.append((0, int(kind_part[own[0]]), salt, unit, *columns, b"".join(self.texts[i] for i in own.tolist())))
        return _span_rows(rows)


def _span_rows(rows: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 7]
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _NAMES)


def _removed(unit_of: np.ndarray, docs: np.ndarray, starts: np.ndarray, stops: np.ndarray, part: int) -> list[tuple]:
    """Rows of bytes to remove, one for each unit: document of the unit, from, to."""
    order = np.argsort(unit_of, kind="stable")
    edges = np.flatnonzero(np.diff(unit_of[order], prepend=-1))
    none = b""
    return [
        (1, part, 0, int(unit_of[own[0]]), none, docs[own].astype("<i8").tobytes(), none, starts[own].astype("<i8").tobytes(), stops[own].astype("<i8").tobytes(), none, none)
        for own in (np.split(order, edges[1:]) if len(order) else [])
    ]


def _spans(parts: int, fan_in: int):
    """Spans of anchors that the table has more than once, by task; those that an earlier one of the unit equals are removed at once."""

    def run(batches):
        for batch in batches:
            replies = batch.column(batch.schema.names.index("answers"))
            for (unit, own), reply in zip(_unit_rows(batch), replies, strict=True):
                if not reply.is_valid:
                    continue
                h, anchor, first, last = anchors(own.data, own.ends)
                keys, index = np.unique(h, return_inverse=True)
                again, hot = _flags(reply.as_py(), len(keys))
                some = np.flatnonzero(again[index])
                h, anchor, first, last, hot = h[some], anchor[some], first[some], last[some], hot[index[some]]
                if hot.any():  # each string a span, told by its own hash
                    n = np.where(hot, last - first + 1, 1)
                    row = np.repeat(np.arange(len(h)), n)
                    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    hot = hot[row]
                    h, anchor, first, last = h[row], np.where(hot, at, anchor[row]), np.where(hot, at, first[row]), np.where(hot, at, last[row])
                data = own.data.tobytes()
                seen, fresh = {}, np.ones(len(h), dtype=bool)
                for i, (a, b, c) in enumerate(zip(first.tolist(), last.tolist(), (anchor - first).tolist(), strict=True)):
                    fresh[i] = seen.setdefault((c, data[a : b + SIZE]), i) == i
                doc = np.searchsorted(own.ends, first, side="right")
                old = np.flatnonzero(~fresh)
                a, b, d = first[old], last[old] + SIZE, doc[old]
                a, b, d = merged(a, b, d)
                out = _removed(np.full(len(a), unit), d, a - own.starts[d], b - own.starts[d], -1 - unit % 256)
                if out:
                    yield from _span_rows(out).to_batches()
                new = np.flatnonzero(fresh)
                h, anchor, first, last, hot, doc = (x[new] for x in (h, anchor, first, last, hot, doc))
                texts = [data[a : b + SIZE] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                if hot.any():
                    h = h.copy()
                    for i in np.flatnonzero(hot).tolist():
                        h[i] = int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little")
                base = own.starts[doc]
                spans = Spans((h, own.ids[doc], (np.int64(unit) << _PLACE_BITS) | doc, anchor - base, first - base, last - base), texts)
                part = (h % np.uint64(parts)).astype(np.int64) + np.where(hot, parts, 0)
                for some, salt in ((~hot, 0), (hot, _number(unit) // fan_in)):
                    if some.any():
                        k = np.flatnonzero(some)
                        own_spans = Spans([c[k] for c in (spans.hash, spans.doc, spans.place, spans.anchor, spans.first, spans.last)], [texts[i] for i in k.tolist()])
                        yield from own_spans.rows(part[k], salt, unit).to_batches()

    return run


def _number(unit: int) -> int:
    """Units in about one sequence: tasks have few each."""
    return (unit >> 33) + ((unit & ((1 << 33) - 1)) * 7919)


def _flags(reply: list[dict], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits for each of a unit's distinct hashes in order, from its answers by part."""
    reply = sorted(reply, key=lambda x: x["part"])
    both = [np.concatenate([np.unpackbits(np.frombuffer(x[c], dtype=np.uint8), count=x["size"]) for x in reply]).astype(bool) for c in ("again", "hot")]
    if len(both[0]) != n:
        raise ValueError("answers that are not of this unit")
    return both[0], both[1]


def merged(starts: np.ndarray, stops: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document joined where they overlap or touch."""
    if not len(starts):
        return starts, stops, docs
    order = np.lexsort((starts, docs))
    starts, stops, docs = starts[order], stops[order], docs[order]
    shift = (docs - docs[0]) * (int(stops.max()) + 2)  # documents apart, so that one running maximum serves all
    a, b = starts + shift, np.maximum.accumulate(stops + shift)
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] > b[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(a)) - 1
    return starts[head], b[last] - shift[last], docs[head]


# ---- sorting ---------------------------------------------------------------


def _class_at(shared: np.ndarray, depth: int) -> np.ndarray:
    """For each slot of a sorted list where those begin that share its first ``depth`` bytes."""
    return np.maximum.accumulate(np.where(shared < depth, np.arange(len(shared)), 0))


def _kept_slots(order: np.ndarray, shared: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted list with only the strings in ``keep``: what neighbours share is the least of what lay between them."""
    slots = np.flatnonzero(keep[order])
    return order[slots], np.minimum.reduceat(shared[: slots[-1] + 1], np.concatenate(([0], slots[:-1] + 1)))


def repeats(spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(span, first, last, whole): strings of spans that an earlier span of the list has too, as runs; spans that bring nothing new."""
    n = len(spans.hash)
    rank = np.empty(n, dtype=np.int64)
    rank[np.lexsort((spans.first, spans.place, spans.doc))] = np.arange(n)
    group = np.unique(spans.hash, return_inverse=True)[1]
    lead = (spans.anchor - spans.first).tolist()
    right = [t[k:] for t, k in zip(spans.texts, lead, strict=True)]
    left = [t[:k][::-1] for t, k in zip(spans.texts, lead, strict=True)]
    sides = []
    for strings in (left, right):
        order, shared = sort(group, strings)
        sizes = np.fromiter(map(len, strings), dtype=np.int64, count=n)[order]
        same = np.zeros(n, dtype=bool)  # equal to the string before
        same[1:] = (shared[1:] == sizes[1:]) & (sizes[1:] == sizes[:-1])
        name = np.empty(n, dtype=np.int64)
        name[order] = np.cumsum(~same)
        sides.append((order, shared, name))
    # spans alike on both sides: the earliest stands for all
    by = np.lexsort((rank, sides[1][2], sides[0][2]))
    new = np.ones(n, dtype=bool)
    new[1:] = (sides[0][2][by][1:] != sides[0][2][by][:-1]) | (sides[1][2][by][1:] != sides[1][2][by][:-1])
    stands = np.zeros(n, dtype=bool)
    stands[by[new]] = True
    alike = np.flatnonzero(~stands)
    found = [(alike, spans.first[alike], spans.last[alike])]
    # anchors with several different spans: string by string
    mixed = stands & (np.bincount(group[stands], minlength=group.max() + 1)[group] > 1)
    if mixed.any():
        sides = [_kept_slots(order, shared, mixed) for order, shared, _ in sides]
        member = np.flatnonzero(mixed)
        number = np.zeros(n, dtype=np.int64)
        number[member] = np.arange(len(member))
        lead, low = spans.anchor[member] - spans.first[member], spans.anchor[member] - spans.last[member]
        gone = np.zeros((len(member), SPAN + 2), dtype=bool)
        for j in range(int(lead.max()) + 1):
            own = np.flatnonzero((low <= j) & (j <= lead))
            names = []
            for (order, shared), depth in zip(sides, (j, SIZE - j), strict=True):
                name = np.empty(len(member), dtype=np.int64)
                name[number[order]] = _class_at(shared, depth)
                names.append(name[own])
            by = np.lexsort((rank[member[own]], names[1], names[0]))
            again = np.zeros(len(own), dtype=bool)
            again[1:] = (names[0][by][1:] == names[0][by][:-1]) & (names[1][by][1:] == names[1][by][:-1])
            gone[own[by[again]], j] = True
        edges = np.diff(gone.astype(np.int8), axis=1, prepend=0)
        row, a = np.nonzero(edges == 1)
        b = np.nonzero(edges == -1)[1] - 1
        who = member[row]
        found.append((who, spans.anchor[who] - b, spans.anchor[who] - a))
        # all its strings are earlier spans' own
        n_gone, n_own = gone.sum(axis=1), lead - low + 1
        alike = np.concatenate((alike, member[n_gone == n_own]))
    whole = np.zeros(n, dtype=bool)
    whole[alike] = True
    span, first, last = (np.concatenate([f[i] for f in found]) for i in range(3))
    return span, first, last, whole


def _sorted(parts: int, survivors: bool):
    """Bytes to remove, by unit; with ``survivors`` also the spans of hot strings that stand for others in the next round."""

    def run(table: pa.Table) -> pa.Table:
        if table["kind"][0].as_py():  # already known
            return table.select(_NAMES)
        part = table["part"][0].as_py()
        spans = Spans.read(table)
        span, first, last, whole = repeats(spans)
        place = spans.place[span]
        out = _removed(place >> _PLACE_BITS, place & ((1 << _PLACE_BITS) - 1), first, last + SIZE, part)
        tables = [_span_rows(out)]
        if survivors and part >= parts:
            k = np.flatnonzero(~whole)
            rest = Spans([c[k] for c in (spans.hash, spans.doc, spans.place, spans.anchor, spans.first, spans.last)], [spans.texts[i] for i in k.tolist()])
            tables.append(rest.rows(np.full(len(k), part), table["salt"][0].as_py(), -1))
        return pa.concat_tables(tables)

    return run


# ---- the whole -------------------------------------------------------------


def _cleaned(with_text: bool):
    def run(batches):
        for batch in batches:
            spans = batch.column(batch.schema.names.index("spans"))
            for (_, own), gone in zip(_unit_rows(batch), spans, strict=True):
                n = len(own.data)
                edges = np.zeros(n + 1, dtype=np.int32)
                for x in gone.as_py() if gone.is_valid else []:
                    d, a, b = (np.frombuffer(x[c], dtype="<i8") for c in ("docs", "offsets", "firsts"))
                    np.add.at(edges, own.starts[d] + a, 1)
                    np.add.at(edges, own.starts[d] + b, -1)
                out = np.cumsum(edges[:-1]) > 0
                begins = out.copy()
                begins[1:] &= ~out[:-1]
                head = own.starts[own.starts < own.ends]
                begins[head] = out[head]
                count = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[np.concatenate(([0], own.ends))])  # noqa: E731, B023
                removed, n_spans, size = count(out), count(begins), own.ends - own.starts
                kept, ends = own.data[~out].tobytes(), np.cumsum(size - removed).tolist()
                texts = [kept[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                columns = [
                    pa.array(own.ids, mask=own.nulls), pa.array(size), pa.array(removed), pa.array(n_spans),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts if with_text else [None] * len(texts), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _merged_of_unit(table: pa.Table) -> pa.Table:
    d, a, b = (np.concatenate([np.frombuffer(x.as_py(), dtype="<i8") for x in table[c]]) for c in ("docs", "offsets", "firsts"))
    a, b, d = merged(a, b, d)
    return pa.table({"unit": table["unit"][:1], "docs": pa.array([d.tobytes()], pa.binary()), "offsets": pa.array([a.tobytes()], pa.binary()), "firsts": pa.array([b.tobytes()], pa.binary())})


def deduplicated(
    docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot: int = HOT, fan_in: int = FAN_IN,
    broadcast_bytes: int = BROADCAST_BYTES, unit_rows: int = 16_384,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; ``kept`` is null unless ``with_text``."""
    packed = units(docs, doc_col, text_col, unit_rows)
    n_bytes, n_units = packed.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)), F.count("*")).first()
    bits = max(0, (n_bytes // (SPAN // 2 * COUNTED)).bit_length())
    told = packed.mapInArrow(lean(_told(bits)), "part long, unit long, hashes binary, counts binary")
    answers = materialize(told.groupBy("part").applyInArrow(_answered(hot), _ANSWER), "suffix-answers")
    size, places = answers.agg(F.coalesce(F.sum(F.octet_length("again") * 2), F.lit(0)), F.coalesce(F.sum("places"), F.lit(0))).first()
    parts = max(1, places * (SIZE + SPAN // 2) // PART_BYTES + 1)
    by_unit = answers.groupBy("unit").agg(F.collect_list(F.struct("part", "size", "again", "hot")).alias("answers"))
    spans = _joined(packed, by_unit, size, broadcast_bytes).mapInArrow(lean(_spans(parts, fan_in)), _SPANS)
    gone = None
    salts = -(-(n_units * 2) // fan_in) if places else 1
    while True:
        more = salts > 1
        found = spans.groupBy("part", "salt").applyInArrow(_sorted(parts, more), _SPANS)
        found = materialize(found, "suffix-found")
        own = found.where("kind = 1").select("unit", "docs", "offsets", "firsts")
        gone = own if gone is None else gone.unionByName(own)
        if not more or found.where("kind = 0").limit(1).count() == 0:
            break
        salts = -(-salts // fan_in)
        # the last round gathers what is left of a string: one span for each group of units
        spans = found.where("kind = 0").withColumn("salt", F.floor(F.col("salt") / fan_in) if salts > 1 else F.lit(0).cast("long"))
    gone = materialize(gone.groupBy("unit").applyInArrow(_merged_of_unit, "unit long, docs binary, offsets binary, firsts binary"), "suffix-gone")
    size = gone.agg(F.coalesce(F.sum(F.octet_length("docs") * 3), F.lit(0))).first()[0]
    by_unit = gone.groupBy("unit").agg(F.collect_list(F.struct("docs", "offsets", "firsts")).alias("spans"))
    return _joined(packed, by_unit, size, broadcast_bytes).mapInArrow(
        lean(_cleaned(with_text)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
