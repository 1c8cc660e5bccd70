"""Byte-level BPE ids by the tokenizers library, one encoding for each distinct word.

Byte-level BPE first cuts a text into words by a fixed pattern and never merges
across them, so equal words have equal ids. A batch's words are cut out of its
UTF-8 bytes by comparing neighbours' character classes; a worker keeps the ids of
words it has met and hands the library only new ones, many to a call. Texts with
characters for which the cut could depend on the library's Unicode tables, or
with a special token, go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .word_ids import WordIds, placed, raw, slices

# Letters and numbers up to U+024F, as Unicode classes them, and the other characters cut here.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_OTHERS = "\x21-\x7e¡-¬®-ɏ"
_LAST = 0x24F
LETTER, NUMBER, OTHER, BLANK, ODD = range(5)
#: Bytes of texts whose words are looked up at a time, and words to one call of the library.
SLICE_BYTES, CALL_WORDS = 4 << 20, 400


def _classes() -> np.ndarray:
    """The class of each code point up to U+027F."""
    def one(ch: str) -> int:
        for kind, pattern in ((LETTER, _LETTERS), (NUMBER, _NUMBERS), (OTHER, _OTHERS), (BLANK, "\t\n\r ")):
            if ord(ch) <= _LAST and re.match(f"[{pattern}]", ch):
                return kind
        return ODD

    return np.array([one(chr(i)) for i in range(0x280)], dtype=np.uint8)


_CLASS = _classes()
_BYTE_CLASS = np.concatenate((_CLASS[:128], np.full(128, ODD, dtype=np.uint8)))


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    kind = _BYTE_CLASS[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))  # two bytes, up to U+027F
    point = (data[lead].astype(np.int32) & 0x1F) << 6 | (data[lead + 1] & 0x3F)
    kind[lead] = kind[lead + 1] = _CLASS[point]
    return kind


def word_starts(data: np.ndarray, kind: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where words begin, given bytes, their classes and where texts begin (with the end of the last).

    A word is a contraction, a run of one class with one space before it, or white space; of
    white space before a word the last character is left to stand alone or to lead the word.
    """
    n = len(data)
    change = np.empty(n + 1, dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[texts] = True
    first = change.copy()
    heads = np.flatnonzero(change[1:n] & (kind[1:] != BLANK) & (kind[:-1] == BLANK)) + 1
    new_text = np.zeros(n + 1, dtype=bool)
    new_text[texts] = True
    heads = heads[~new_text[heads]]
    first[heads - 1] = True
    first[heads] = data[heads - 1] != 0x20
    # contractions: an apostrophe alone, not led by a space, and the letters after it
    marks = np.flatnonzero((data[: n - 1] == 0x27) & first[: n - 1] & change[1:n] & (kind[1:] == LETTER))
    marks = marks[~new_text[marks + 1]]
    one = data[marks + 1]
    two = data[np.minimum(marks + 2, n - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
    pair = (marks + 2 < n) & ~new_text[np.minimum(marks + 2, n)]
    pair &= ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
    first[marks[short | pair] + 1] = False
    first[marks[short] + 2] = True
    first[marks[pair & ~short] + 3] = True
    return np.flatnonzero(first[:n])


class WordEncoder:
    """Little-endian unsigned 32-bit ids of texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.starts_word = np.array(
            [(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)], dtype=bool
        )
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.words = WordIds(self._learn)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<i4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: pa.Array, mark: bytes, ends_of) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words, and how many each has, from texts of many words with ``mark`` after each; ``ends_of`` ids tells words apart."""
        at = np.append(np.arange(0, len(words), CALL_WORDS), len(words))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), words), mark).to_pylist()
        ids = np.concatenate(self._whole([(t + mark).decode() for t in texts]))
        found = ends_of(ids)
        return None if found is None or len(found[1]) != len(words) else found

    def _led(self, ids: np.ndarray):
        """Words that a space leads: each begins with an id that does."""
        at = np.flatnonzero(self.starts_word[ids])
        return ids, np.diff(at, append=len(ids))

    def _bare(self, ids: np.ndarray):
        """Words without white space, a line feed after each."""
        stop = ids == self.line_feed[0]
        return ids[~stop], np.diff(np.flatnonzero(stop), prepend=-1) - 1

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = raw(new)
        size, blank = np.diff(at), _BYTE_CLASS[data] == BLANK
        second = np.minimum(at[:-1] + 1, len(data) - 1)
        led = (data[at[:-1]] == 0x20) & (size > 1) & ~blank[second]
        bare = ~blank[at[:-1]]
        groups, left = [], ~led & ~bare
        for some, mark, ends_of, fits in ((led, b"", self._led, True), (bare, b"\n", self._bare, len(self.line_feed) == 1)):
            places = np.flatnonzero(some)
            found = self._together(new.filter(pa.array(some)), mark, ends_of) if fits and len(places) else None
            if found is None:  # none, or a vocabulary without that property
                left |= some
            else:
                groups.append((places, *found))
        if left.any():
            own = self._whole([w.decode() for w in new.filter(pa.array(left)).to_pylist()])
            groups.append((np.flatnonzero(left), np.concatenate(own), np.array([len(x) for x in own], dtype=np.int64)))
        return placed(len(new), groups)

    def _odd(self, data: np.ndarray, kind: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which texts must go to the library whole."""
        places = np.flatnonzero(kind == ODD)
        raw_bytes = data.tobytes()
        for s in self.special:
            found = [m.start() for m in re.finditer(re.escape(s), raw_bytes)]
            places = np.concatenate((places, np.array(found, dtype=np.int64)))
        odd = np.zeros(len(at) - 1, dtype=bool)
        odd[np.searchsorted(at, places, side="right") - 1] = True
        return odd

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        data, at = raw(texts)
        if not len(data):
            return [np.zeros(0, dtype="<i4")] * len(texts)
        kind = byte_classes(data)
        odd = self._odd(data, kind, at)
        if odd.any():
            whole = iter(self._whole(texts.filter(pa.array(odd)).to_pylist()))
            rest = iter(self._slice(texts.filter(pa.array(~odd))))
            return [next(whole if x else rest) for x in odd.tolist()]
        starts = word_starts(data, kind, at)
        counts = np.diff(np.searchsorted(starts, at))
        return self.words.of(slices(data, np.append(starts, len(data))), counts)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of an Arrow array without nulls."""
        out: list[np.ndarray] = []
        _, at = raw(texts)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE_BYTES, side="right")) - 1)
            out += self._slice(texts[a:b])
            a = b
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder; its words outlive a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
