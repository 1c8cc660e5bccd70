"""Deep-shallow sorting of byte strings within groups, with common prefix lengths.

Multikey quicksort first, to a shallow depth, on characters of eight bytes: each round
sorts what is still equal by its next character. What shares the whole shallow prefix
goes into blind tries, which keep only the places where strings differ: a string goes
down by these places alone, is compared once with a string it meets there, and takes
its own place above. Walking a trie gives the order, and between neighbours the length
of the prefix they share.
"""

from __future__ import annotations

import numpy as np

#: Bytes sorted by quicksort.
SHALLOW = 32
END = -1


def common(a: bytes, b: bytes) -> int:
    """How many bytes two strings begin with alike."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class Node:
    """A place where strings differ, and what follows by the byte they have there."""

    __slots__ = ("depth", "kids")

    def __init__(self, depth: int, kids: dict):
        self.depth, self.kids = depth, kids


class BlindTrie:
    def __init__(self):
        self.members: dict[bytes, list[int]] = {}
        self.root: Node | bytes | None = None

    def add(self, s: bytes, member: int) -> None:
        same = self.members.get(s)
        if same is not None:
            same.append(member)
            return
        self.members[s] = [member]
        if self.root is None:
            self.root = s
            return
        path, at = [], self.root
        while type(at) is Node:
            path.append(at)
            kids = at.kids
            at = kids.get(s[at.depth] if at.depth < len(s) else END)
            if at is None:  # any string below tells how far down s belongs
                at = next(iter(kids.values()))
                while type(at) is Node:
                    at = next(iter(at.kids.values()))
                break
        other, n = at, common(s, at)
        own = s[n] if n < len(s) else END
        k = next((k for k, node in enumerate(path) if node.depth >= n), len(path))
        if k < len(path) and path[k].depth == n:
            path[k].kids[own] = s
            return
        below = path[k] if k < len(path) else other
        node = Node(n, {(other[n] if n < len(other) else END): below, own: s})
        if k == 0:
            self.root = node
        else:
            up = path[k - 1]
            up.kids[s[up.depth] if up.depth < len(s) else END] = node

    def walk(self):
        """(members, prefix shared with the string before) in order."""
        if self.root is None:
            return
        stack = [(self.root, 0)]
        while stack:
            at, shared = stack.pop()
            if type(at) is not Node:
                yield self.members[at], shared
                continue
            kids = sorted(at.kids.items(), reverse=True)
            stack += [(kid, at.depth) for _, kid in kids[:-1]]
            stack.append((kids[-1][1], shared))


def _characters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as a number that orders them."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64)


def sort(groups: np.ndarray, strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): strings by (group, bytes), and how long a prefix each shares with the one before in order.

    The first of a group shares -1; equal strings share their length.
    """
    n = len(strings)
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=n)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(strings) + bytes(shallow + 8), dtype=np.uint8)
    order = np.argsort(groups, kind="stable")
    shared = np.zeros(n, dtype=np.int64)
    first = np.ones(n, dtype=bool)
    first[1:] = groups[order][1:] != groups[order][:-1]
    shared[first] = -1
    # slots that are not yet told from a neighbour
    live = _unsettled(np.arange(n), first)
    for depth in range(0, shallow, 8):
        if not len(live):
            break
        own = order[live]
        group = np.cumsum(first[live])
        left = np.clip(sizes[own] - depth, 0, 8)
        char = _characters(data, starts[own] + np.minimum(depth, sizes[own]))
        char = np.where(left < 8, char & ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> (left * 8).astype(np.uint64) % np.uint64(64)), char)
        char[left == 0] = 0
        by = np.lexsort((left, char, group))
        order[live] = own[by]
        char, left, group = char[by], left[by], group[by]
        differ = np.ones(len(live), dtype=bool)
        differ[1:] = (char[1:] != char[:-1]) | (left[1:] != left[:-1])
        new = differ & ~first[live]
        k = np.flatnonzero(new)
        same = _same_bytes(char[k] ^ char[k - 1])
        shared[live[k]] = depth + np.minimum(same, np.minimum(left[k], left[k - 1]))
        first[live[k]] = True
        ended = (left < 8) & ~first[live]  # equal to the string before, whole
        shared[live[ended]] = sizes[order[live[ended]]]
        live = _unsettled(live[left == 8], first)
    for group in np.split(live, np.flatnonzero(first[live])[1:]) if len(live) else []:
        trie = BlindTrie()
        for i in order[group].tolist():
            trie.add(strings[i], i)
        slot = int(group[0])
        kept = shared[slot]
        for members, prefix in trie.walk():
            order[slot : slot + len(members)] = members
            shared[slot] = prefix
            shared[slot + 1 : slot + len(members)] = len(strings[members[0]])
            slot += len(members)
        shared[int(group[0])] = kept
    return order, shared


def _same_bytes(differences: np.ndarray) -> np.ndarray:
    """Leading bytes of eight that are zero."""
    return (np.ascontiguousarray(differences.astype(">u8")).view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1) + 8 * (differences == 0)


def _unsettled(live: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Those of the slots ``live`` that belong to groups of more than one."""
    if not len(live):
        return live
    head = first[live]
    last = np.append(head[1:], True)
    return live[~(head & last)]
