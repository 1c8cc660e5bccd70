"""Ids of texts whose words are encoded independently: each distinct word once.

Words stay slices of an Arrow buffer from the batch they came in to the vocabulary
of words already met; Python objects are made of new words only, if at all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts without nulls, and where each begins, with the end of the last."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype="<i4")[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Words that follow one another in ``data`` as an array of binary values, without a copy."""
    at = offsets.astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i] + sizes[i]`` for each i, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def placed(n: int, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of ``n`` words in order, and how many each has, from groups (places of words, their ids, how many each)."""
    sizes = np.zeros(n, dtype=np.int64)
    for places, _, counts in groups:
        sizes[places] = counts
    starts = np.cumsum(sizes) - sizes
    ids = np.zeros(int(sizes.sum()), dtype="<i4")
    for places, own, counts in groups:
        ids[runs(starts[places], counts)] = own
    return ids, sizes


class WordIds:
    """Remembers words and their ids, and asks ``learn`` for new words only.

    ``learn`` takes distinct words as a binary array and returns their ids, one word after
    another, and how many each has. ``remembered`` bounds the bytes of words and ids kept:
    beyond it, only the words of the latest batch stay, or none where they alone are more.
    """

    def __init__(self, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], remembered: int = 16 << 20):
        self.learn, self.remembered = learn, remembered
        self._keep(pa.array([], pa.binary()), np.zeros(0, dtype="<i4"), np.zeros(0, dtype=np.int64))

    def _keep(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.words, self.ids, self.sizes = words, ids, sizes
        self.starts = np.cumsum(sizes) - sizes

    @property
    def kept_bytes(self) -> int:
        return self.words.nbytes + self.ids.nbytes + self.sizes.nbytes + self.starts.nbytes

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, ids, sizes): each word's number, and the ids of the numbered words with how many each has."""
        coded = words.dictionary_encode()
        named, index = coded.dictionary, np.asarray(coded.indices)
        at = np.array(pc.fill_null(pc.index_in(named, value_set=self.words), -1))
        new = named.filter(pa.array(at < 0))
        if len(new):
            ids, sizes = self.learn(new)
            at[at < 0] = len(self.words) + np.arange(len(new))
            self._keep(pa.concat_arrays([self.words, new]), np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes)))
        sizes = self.sizes[at]
        ids = self.ids[runs(self.starts[at], sizes)]
        if self.kept_bytes > self.remembered:
            small = named.nbytes + ids.nbytes + 2 * sizes.nbytes <= self.remembered
            self._keep(*((named, ids, sizes) if small else (named[:0], ids[:0], sizes[:0])))
        return index, ids, sizes

    def of(self, words: pa.Array, counts: np.ndarray) -> list[np.ndarray]:
        """The ids of each text, whose words follow one another, ``counts`` of them to a text."""
        index, ids, sizes = self.distinct(words)
        n = sizes[index]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = ids[runs((np.cumsum(sizes) - sizes)[index], n)]
        return np.split(ids, ends[np.cumsum(counts)[:-1]]) if len(counts) else []
