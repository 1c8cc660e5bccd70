"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's symbols start as its characters; adjacent pairs that form a piece wait on
an agenda ordered by score, then position, and the best pair is joined until none
is left. As no piece has a word boundary after another character, the agenda never
looks past the end of a word with its leading spaces: each distinct word is
encoded once. Short words run in lockstep as rows of a matrix (each round joins
every word's best pair), long ones on a heap.

Decoding joins the surfaces of words, which their own ids give; no run of byte
pieces leaves a word. Every Arrow batch is then checked against the sentencepiece
library, which encodes and decodes the same whole texts: ``agrees`` says whether
ids and text are the same. The ids and text that come out are the agenda's own.

Null texts count as empty: the end id alone. Rows are encoded one by one, so ties
and repeated rows are of no account; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, text_or_empty
from .word_ids import WordIds, placed, raw, runs, slices

SPACE_MARK = "▁"
NONE = np.iinfo(np.int32).max
#: Words of at most so many symbols run in lockstep, by width of matrix.
WIDTHS = (8, 16, 32)
# Kinds of pieces in a vocabulary file.
NORMAL, USER, BYTE = 1, 4, 6
#: Bytes of texts whose words are looked up at a time.
SLICE_BYTES = 4 << 20
SLOT_BITS = 20


class Agenda:
    """The merges of a vocabulary, and the words it has encoded so far."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.name != "identity" or norm.remove_extra_whitespaces or any(p.type == USER for p in model.pieces):
            raise ValueError("a vocabulary with the identity normaliser and no user-defined pieces is needed")
        self.prefix = SPACE_MARK if norm.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        normal = [i for i, p in enumerate(model.pieces) if p.type == NORMAL]
        self.bytes_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes_id.items()}
        self.is_byte = np.zeros(len(self.pieces), dtype=bool)
        self.is_byte[list(self.byte_of)] = True
        self.unknown, self.end = self.library.unk_id(), self.library.eos_id()
        self.surface = pa.array([p.replace(SPACE_MARK, " ").encode() for p in self.pieces], pa.binary())
        self.decimal = pa.array([str(i).encode() for i in range(len(self.pieces))], pa.binary())
        #: by code point, -1 where not yet met
        self.of_point = np.full(0x110000, -1, dtype=np.int32)
        #: symbol numbers: pieces by id, then characters that are no piece
        self.symbol = {self.pieces[i]: i for i in normal}
        self.fallback: dict[int, tuple[int, ...]] = {}
        for ch in sorted({c for i in normal for c in self.pieces[i]}):
            self._symbol_of(ch)
        ranks = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in normal}, reverse=True))}
        rows = [
            (self._key(self.symbol[p[:k]], self.symbol[p[k:]]), ranks[model.pieces[i].score], i)
            for i in normal
            for p in (self.pieces[i],)
            for k in range(1, len(p))
            if p[:k] in self.symbol and p[k:] in self.symbol
        ]
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.merged = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        self.pair = {int(k): (int(r), int(m)) for k, r, m in table}
        slot = self._slot(self.keys)
        self.slots = np.zeros(1 << SLOT_BITS, dtype=np.int32)
        self.slots[slot] = np.arange(len(self.keys))
        self.crowded = np.zeros(1 << SLOT_BITS, dtype=bool)
        self.crowded[slot[self.slots[slot] != np.arange(len(self.keys))]] = True
        if not self.prefix or SPACE_MARK not in self.symbol:
            raise ValueError("a vocabulary with a space as a piece, which puts one before each text, is needed")
        self.mark = self.of_point[0x20] = self.of_point[ord(SPACE_MARK)] = self.symbol[SPACE_MARK]
        self.cuts_at_space = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", self.pieces[i]) for i in normal)
        self.words = WordIds(self._learn)

    @staticmethod
    def _key(left: int, right: int) -> int:
        return left << 32 | right

    def _symbol_of(self, ch: str) -> int:
        s = self.symbol.get(ch)
        if s is None:
            s = self.symbol[ch] = len(self.pieces) + len(self.fallback)
            raw = ch.encode("utf-8", "surrogatepass")
            self.fallback[s] = tuple(self.bytes_id[b] for b in raw) if self.bytes_id else (self.unknown,)
        return s

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; NONE where it is no piece. Ends, which are -1, make no key."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        at = self.slots[slot]
        hit = self.keys[at] == key
        rest = np.flatnonzero(~hit & self.crowded[slot])  # slots that several keys share
        at[rest] = np.minimum(np.searchsorted(self.keys, key[rest]), len(self.keys) - 1)
        hit[rest] = self.keys[at[rest]] == key[rest]
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def _lockstep(self, symbols: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of words of at most ``width`` symbols, which follow one another, and how many each has."""
        n = len(lengths)
        rows = np.repeat(np.arange(n), lengths)
        sym = np.full((n, width + 1), -1, dtype=np.int32)  # the last column stands for both ends
        sym[rows, np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = symbols
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
        rank, into = self._looked_up(sym[:, :-2].ravel(), sym[:, 1:-1].ravel())
        rank = np.hstack([rank.reshape(n, width - 1), np.full((n, 2), NONE, dtype=np.int32)])
        into = np.hstack([into.reshape(n, width - 1), np.zeros((n, 2), dtype=np.int32)])
        live = np.arange(n)
        while len(live):
            at = rank[live].argmin(axis=1)  # of equal ranks the first
            some = rank[live, at] != NONE
            live, at = live[some], at[some]
            if not len(live):
                break
            gone = after[live, at]
            sym[live, at] = into[live, at]
            sym[live, gone] = -1
            rank[live, gone] = NONE
            nxt = np.minimum(after[live, gone], width)
            after[live, at] = nxt
            before[live, nxt] = at
            rank[live, at], into[live, at] = self._looked_up(sym[live, at], sym[live, nxt])
            prev = before[live, at]
            has = prev >= 0
            rows, prev, at = live[has], prev[has], at[has]
            rank[rows, prev], into[rows, prev] = self._looked_up(sym[rows, prev], sym[rows, at])
        stays = sym >= 0
        return sym[stays], stays.sum(axis=1)

    def _heap(self, symbols: list[int]) -> list[int]:
        """Final symbols of one word, by a heap of (rank, place)."""
        n = len(symbols)
        sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def propose(i: int, j: int) -> None:
            if i >= 0 and j < n and (found := self.pair.get(self._key(sym[i], sym[j]))):
                heapq.heappush(agenda, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, i, left, right, piece = heapq.heappop(agenda)
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue  # one of the two has been joined since
            sym[i], sym[j] = piece, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            propose(before[i], i)
            propose(i, after[i])
        return [s for s in sym if s >= 0]

    def _symbols(self, text: str) -> np.ndarray:
        """The symbols of a text's characters."""
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        found = self.of_point[points]
        if (found < 0).any():
            for point in np.unique(points[found < 0]).tolist():
                self.of_point[point] = self._symbol_of(chr(point))
            found = self.of_point[points]
        return found

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, a space before each, one word after another, and how many each has."""
        data, at = raw(new)
        before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at]
        lengths = np.diff(before) + 1
        starts = np.cumsum(lengths) - lengths
        symbols = np.full(int(lengths.sum()), self.mark, dtype=np.int32)
        symbols[runs(starts + 1, lengths - 1)] = self._symbols(data.tobytes().decode())
        groups, low = [], 0
        for width in WIDTHS:
            some = np.flatnonzero((lengths > low) & (lengths <= width))
            if len(some):
                own = symbols[runs(starts[some], lengths[some])]
                groups.append((some, *self._spelled(*self._lockstep(own, lengths[some], width))))
            low = width
        some = np.flatnonzero(lengths > low)
        if len(some):
            found = [np.array(self._heap(symbols[a : a + n].tolist()), dtype=np.int32) for a, n in zip(starts[some].tolist(), lengths[some].tolist(), strict=True)]
            groups.append((some, *self._spelled(np.concatenate(found), np.array([len(x) for x in found], dtype=np.int64))))
        return placed(len(new), groups)

    def _spelled(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words, ``counts`` to each, as ids: characters that are no piece become byte pieces."""
        odd = np.flatnonzero(symbols >= len(self.pieces))
        if not len(odd):
            return symbols, counts
        spelled = [self.fallback[x] for x in symbols[odd].tolist()]
        n = np.ones(len(symbols), dtype=np.int64)
        n[odd] = [len(x) for x in spelled]
        ids = np.repeat(symbols, n)
        ids[runs((np.cumsum(n) - n)[odd], n[odd])] = list(chain.from_iterable(spelled))
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))]
        return ids, np.diff(ends)

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Stretches that merges never leave, the space before each left out, and how many each text has.

        A stretch is a run of spaces and what follows it; the space put before each text belongs to the first.
        """
        data, at = raw(texts)
        first = np.zeros(len(data) + 1, dtype=bool)
        if self.cuts_at_space:
            space = data == 0x20
            first[1:-1] = space[1:] & ~space[:-1]
        head = at[:-1][np.diff(at) > 0]
        first[head] = True
        starts = np.flatnonzero(first[:-1])
        counts = np.diff(np.searchsorted(starts, at))
        led = np.ones(len(starts), dtype=np.int64)
        led[np.searchsorted(starts, head)] = 0
        ends = np.append(starts[1:], len(data))[: len(starts)]
        sizes = ends - starts - led
        return slices(data[runs(starts + led, sizes)], np.concatenate(([0], np.cumsum(sizes)))), counts

    def _surfaces(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The text of each word of ids, the space before it included: pieces joined, runs of byte pieces read as UTF-8."""
        ends = np.concatenate(([0], np.cumsum(sizes)))
        text = pc.binary_join(_lists(ends, self.surface.take(pa.array(ids))), b"")
        odd = np.diff(np.concatenate(([0], np.cumsum(self.is_byte[ids])))[ends]) > 0
        if odd.any():
            own = [self._joined(ids[ends[i] : ends[i + 1]].tolist()).encode() for i in np.flatnonzero(odd).tolist()]
            text = pc.replace_with_mask(text, pa.array(odd), pa.array(own, pa.binary()))
        return text

    def encode(self, texts: pa.Array):
        """(ids, decimal ids joined by a space, decoded text) of each of an Arrow array of texts without nulls, without an end id."""
        _, at = raw(texts)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE_BYTES, side="right")) - 1)
            part = texts[a:b]
            if pc.any(pc.match_substring(part, SPACE_MARK)).as_py():  # the mark itself stands for a space
                part = pc.replace_substring(part, SPACE_MARK, " ")
            words, counts = self._cut(part)
            index, ids, sizes = self.words.distinct(words)
            ends, of_word = np.concatenate(([0], np.cumsum(counts))), pa.array(index)
            decimal = pc.binary_join(_lists(np.concatenate(([0], np.cumsum(sizes))), self.decimal.take(pa.array(ids))), b" ")
            n = sizes[index]
            whole = ids[runs((np.cumsum(sizes) - sizes)[index], n)]
            yield from zip(
                np.split(whole, np.concatenate(([0], np.cumsum(n)))[ends[1:-1]]),
                pc.binary_join(_lists(ends, decimal.take(of_word)), b" ").to_pylist(),
                (x[1:] for x in pc.binary_join(_lists(ends, self._surfaces(ids, sizes).take(of_word)), b"").to_pylist()),
                strict=True,
            )
            a = b

    def _joined(self, ids: list[int]) -> str:
        """Pieces joined, runs of byte pieces read as UTF-8, marks as spaces."""
        parts, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                parts.append(_utf8(bytes(run)))
                run.clear()
            if i != self.end:
                parts.append(self.pieces[i])
        if run:
            parts.append(_utf8(bytes(run)))
        return "".join(parts).replace(SPACE_MARK, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of any ids, the space put before it removed."""
        text = self._joined(ids)
        first = next((i for i in ids if i != self.end), self.end)
        return text[1:] if self.pieces[first].startswith(SPACE_MARK) else text


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _utf8(raw: bytes) -> str:
    """Bytes as text, each byte that is no UTF-8 as a replacement mark."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_agendas: dict[str, Agenda] = {}


def agenda(path: str) -> Agenda:
    """This worker's agenda; its words outlive a task."""
    if path not in _agendas:
        _agendas[path] = Agenda(path)
    return _agendas[path]


def encode(docs: DataFrame, model_path: str, doc_col="doc_id", text_col="text", with_text: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded, decoded_sha256, agrees).

    ``ids`` are little-endian 32-bit numbers with the end id; without ``with_text``
    ids and decoded are null. ``agrees``: the library gives the same ids and text.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        own = agenda(model_path)
        end = np.array([own.end], dtype="<i4")
        last = str(own.end).encode()
        for batch in batches:
            rows, texts = [], batch.column(1)
            theirs = own.library.encode(texts.to_pylist(), add_eos=True, num_threads=1)
            decoded = own.library.decode(theirs, num_threads=1)
            for k, (ids, decimal, text) in enumerate(own.encode(texts)):
                ids = np.concatenate((ids, end))
                same = len(ids) == len(theirs[k]) and (ids == np.array(theirs[k], dtype="<i4")).all() and text == decoded[k].encode()
                rows.append(
                    (
                        len(ids),
                        ids.tobytes() if with_text else None,
                        hashlib.sha256(decimal + b" " + last if decimal else last).hexdigest(),
                        text.decode() if with_text else None,
                        hashlib.sha256(text).hexdigest(),
                        bool(same),
                    )
                )
            types = [pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            names = ["n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256", "agrees"]
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *names]
            )

    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        lean(run),
        "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded string, decoded_sha256 string, agrees boolean",
    )
