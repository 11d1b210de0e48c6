"""Deep-shallow sorting of suffixes.

Suffixes are rows of bytes of bounded depth, in groups that are sorted apart.
Multikey quicksort on eight bytes at a time orders them to a shallow depth: only
rows that are still equal go on to the next eight bytes.  What is equal to that
depth has a long common prefix and is ordered by a blind trie: a new suffix goes
down by branching bytes alone, is compared once with the leaf that it reaches,
and is hung in at the depth where the two differ.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24


class BlindTrie:
    """Orders byte strings of one length; equal strings share a leaf."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # leaf: [text, rows]; inner: (depth, {byte: child})

    def insert(self, text: bytes, row: int) -> None:
        if self.root is None:
            self.root = [text, [row]]
            return
        node, path = self.root, []
        while type(node) is tuple:  # blind: only the branching byte is looked at
            path.append(node)
            child = node[1].get(text[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        if node[0] == text:
            node[1].append(row)
            return
        x = int.from_bytes(node[0], "big") ^ int.from_bytes(text, "big")
        depth, leaf = len(text) - (x.bit_length() + 7) // 8, [text, [row]]
        above = None
        for inner in path:  # the first node at or below the differing byte
            if inner[0] >= depth:
                break
            above = inner
        else:
            inner = None
        if inner is not None and inner[0] == depth:
            inner[1][text[depth]] = leaf
            return
        below = self.root if above is None else above[1][text[above[0]]]
        split = (depth, {node[0][depth]: below, text[depth]: leaf})
        if above is None:
            self.root = split
        else:
            above[1][text[above[0]]] = split

    def rows(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.extend(node[1])
        return out


def sort_suffixes(group: np.ndarray, text: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``text`` (n x depth bytes) by (group, bytes), and
    the common prefix of each row with the one before it in that order (0 at
    the start of a group)."""
    n, depth = text.shape
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = -(-depth // 8) * 8
    padded = np.zeros((n, width), dtype=np.uint8)
    padded[:, :depth] = text
    words = padded.view(">u8")
    order = np.argsort(group, kind="stable")
    sorted_group = group[order]
    start = np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]])
    for level in range(min(shallow, width) // 8):
        # rows that share all bytes so far with a neighbour
        tied = ~start | np.append(~start[1:], False)
        at = np.flatnonzero(tied)
        if not len(at):
            break
        word, part = words[order[at], level].astype(np.uint64), np.cumsum(start)[at]
        again = np.lexsort((word, part))
        order[at], word, part = order[at[again]], word[again], part[again]
        start[at[1:]] |= (word[1:] != word[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(start)
    length = np.diff(np.append(first, n))
    if shallow < depth:
        for s, m in zip(first[length > 1].tolist(), length[length > 1].tolist()):
            rows = order[s:s + m]
            rest = text[rows, shallow:]
            if (rest == rest[0]).all():
                continue
            trie, data, step = BlindTrie(), rest.tobytes(), depth - shallow
            for i, row in enumerate(rows.tolist()):
                trie.insert(data[i * step:(i + 1) * step], row)
            order[s:s + m] = trie.rows()
    common = np.zeros(n, dtype=np.int64)
    for s in range(1, n, 1 << 16):
        e = min(s + (1 << 16), n)
        differ = text[order[s:e]] != text[order[s - 1:e - 1]]
        common[s:e] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    sorted_group = group[order]
    common[1:][sorted_group[1:] != sorted_group[:-1]] = 0
    return order, common
