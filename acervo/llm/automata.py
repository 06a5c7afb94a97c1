"""Levenshtein automata that run down tries, for many words and many tries at once.

A forest holds a trie for each shard in arrays, level by level. The automaton of a bound is the table of what a band of
the alignment table (with swaps of neighbouring letters) can become, made once from the recurrence. A search is a frontier of
(word, trie node, state of the automaton): each level takes all its members to the children of their nodes, and members
whose band is beyond the bound leave.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

#: Longest word in a forest: its letters are the bits of one integer.
LONGEST = 56
_CODES = np.zeros(256, dtype=np.uint8)
for _at, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789"):
    _CODES[_c] = _at + 1
_LETTERS = 37


@dataclass(frozen=True)
class Automaton:
    """step[state, seen] is the next state, -1 beyond the bound; value[state, o] the distance in the cell o off the diagonal."""

    most: int
    step: np.ndarray
    value: np.ndarray


@cache
def automaton(most: int) -> Automaton:
    """The automaton of optimal string alignment up to `most`. A state is the band of a column and what a swap would give in the next one."""
    k, far = most, most + 1
    band = range(-k, k + 1)
    start = (tuple(o if o >= 0 else far for o in band), (far,) * len(band))
    states, queue, steps = {start: 0}, [start], []
    while queue:
        column, pending = queue.pop(0)
        row = []
        for bits in range(1 << (2 * k + 3)):
            seen = lambda o, bits=bits: bits >> (o + k + 1) & 1
            new: list[int] = []
            for o in band:
                at = o + k
                best = column[at] + (not seen(o))
                if o < k:
                    best = min(best, column[at + 1] + 1)
                if new:
                    best = min(best, new[-1] + 1)
                if seen(o - 1):
                    best = min(best, pending[at])
                new.append(min(far, best))
            after = (tuple(new), tuple(min(far, column[o + k] + 1) if seen(o + 1) else far for o in band))
            if min(*after[0], *after[1]) > k:
                row.append(-1)
                continue
            if after not in states:
                states[after] = len(states)
                queue.append(after)
            row.append(states[after])
        steps.append(row)
    return Automaton(most, np.array(steps, dtype=np.int32), np.array([s[0] for s in states], dtype=np.int8))


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths) of words of at most LONGEST letters and digits."""
    if not words:
        return np.zeros((0, 1), dtype=np.uint8), np.zeros(0, dtype=np.int64)
    raw = np.array([w.encode("ascii") for w in words])
    codes = _CODES[raw.view(np.uint8).reshape(len(words), -1)]
    return codes, np.count_nonzero(codes, axis=1)


class Forest:
    """Tries of shards; `shards` and `words` are parallel, no word twice in a shard."""

    def __init__(self, shards: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort([*(codes[:, j] for j in range(codes.shape[1] - 1, -1, -1)), shards])
        self.row = order
        shards, codes, lengths = shards[order], codes[order], lengths[order]
        n, depth = codes.shape
        edge = np.ones(n, dtype=bool)
        edge[1:] = shards[1:] != shards[:-1]
        self.roots = shards[edge]
        starts = np.flatnonzero(edge)
        self.levels = []
        char = np.zeros(len(starts), dtype=np.uint8)
        for d in range(depth + 1):
            ends = np.append(np.flatnonzero(edge), n)
            upto = ends[np.searchsorted(ends, starts, side="right")] if len(starts) else starts
            ends_here = np.where(lengths[starts] == d, starts, -1) if len(starts) else starts
            below = np.zeros(0, dtype=np.int64)
            if d < depth:
                edge = edge.copy()
                edge[1:] |= codes[1:, d] != codes[:-1, d]
                below = np.flatnonzero(edge & (codes[:, d] > 0))
            self.levels.append((char, ends_here, np.searchsorted(below, starts), np.searchsorted(below, upto)))
            if not len(below):
                break
            starts, char = below, codes[below, d]

    def near(self, shards: np.ndarray, codes: np.ndarray, lengths: np.ndarray, most: int, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, words, distances) of the words within `most` of each query in its shard, by position."""
        machine = automaton(most)
        root = np.searchsorted(self.roots, shards)
        known = np.flatnonzero((root < len(self.roots)) & (self.roots[np.minimum(root, len(self.roots) - 1)] == shards)) if len(self.roots) else np.zeros(0, dtype=np.int64)
        mask = np.uint64((1 << (2 * most + 3)) - 1)
        for begin in range(0, len(known), block):
            mine = known[begin : begin + block]
            places = np.zeros((len(mine), _LETTERS), dtype=np.uint64)
            for at in range(codes.shape[1]):
                places[np.arange(len(mine)), codes[mine, at]] |= np.uint64(1 << at)
            places[:, 0] = 0
            size = lengths[mine]
            q, node, state = np.arange(len(mine)), root[mine], np.zeros(len(mine), dtype=np.int32)
            for d, (_, ends_here, low, high) in enumerate(self.levels):
                off = size[q] - d
                done = np.flatnonzero((ends_here[node] >= 0) & (np.abs(off) <= most))
                value = machine.value[state[done], off[done] + most]
                done, value = done[value <= most], value[value <= most]
                if len(done):
                    yield mine[q[done]], self.row[ends_here[node[done]]], value
                counts = high[node] - low[node]
                total = int(counts.sum())
                if not total:
                    break
                member = np.repeat(np.arange(len(q)), counts)
                child = low[node][member] + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
                seen = places[q[member], self.levels[d + 1][0][child]]
                shift = d - most - 1
                seen = (seen >> np.uint64(shift) if shift >= 0 else seen << np.uint64(-shift)) & mask
                after = machine.step[state[member], seen.astype(np.int64)]
                alive = np.flatnonzero(after >= 0)
                q, node, state = q[member[alive]], child[alive], after[alive]
