"""A minimal acyclic transducer: words of bytes that share prefixes and suffixes, with additive outputs.

The output of a word is its place among the sorted words: each arc adds the number of words that sort before those
behind it. The arcs are one sorted array of (state, byte), so that many words are looked up side by side, and all
arrays lie in one file that is memory-mapped.
"""

from __future__ import annotations

from array import array
from itertools import chain

import numpy as np

_FIELDS = (("key", np.uint64), ("target", np.int32), ("output", np.int32), ("final", np.uint8), ("first", np.int64), ("ids", np.uint32))


def compile_words(words: list[bytes], ids: list[list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the automaton of sorted distinct words; the ids of word i are ids[first[i]:first[i + 1]]."""
    register: dict[bytes, int] = {}  # a state's arcs as bytes, its number; in order of their numbers
    behind = array("i")  # words behind each state
    path: list[dict[int, int]] = [{}]

    def freeze(node: dict[int, int]) -> int:
        arcs = sorted(node.items())
        packed = array("i", chain.from_iterable(arcs)).tobytes()
        if (state := register.get(packed)) is None:
            state = register[packed] = len(register)
            behind.append(sum(1 if b < 0 else behind[t] for b, t in arcs))
        return state

    previous = b""
    for word in words:
        shared = 0
        for a, b in zip(previous, word, strict=False):
            if a != b:
                break
            shared += 1
        while len(path) - 1 > shared:
            node = path.pop()
            path[-1][previous[len(path) - 1]] = freeze(node)
        path += [{} for _ in range(len(word) - shared)]
        path[-1][-1] = -1
        previous = word
    while len(path) > 1:
        node = path.pop()
        path[-1][previous[len(path) - 1]] = freeze(node)
    root = freeze(path[0])
    # the root becomes state 0
    number = {root: 0, 0: root} if root else {}
    key, target, output = array("Q"), array("i"), array("i")
    final = np.zeros(len(behind), np.uint8)
    for state, packed in enumerate(register):
        arcs, s, before = array("i", packed), number.get(state, state), 0
        for byte, to in zip(arcs[::2], arcs[1::2], strict=True):
            if byte < 0:
                final[s], before = 1, 1
            else:
                key.append(s << 8 | byte)
                target.append(number.get(to, to))
                output.append(before)
                before += behind[to]
    order = np.argsort(np.array(key, np.uint64))
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return {
        "key": np.array(key, np.uint64)[order], "target": np.array(target, np.int32)[order], "output": np.array(output, np.int32)[order],
        "final": final, "first": np.concatenate(([0], np.cumsum(counts))), "ids": np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())),
    }


def to_bytes(arrays: dict[str, np.ndarray]) -> list[bytes]:
    """One file: the lengths of the arrays, then the arrays, each from a multiple of 8 bytes."""
    parts = [np.array([len(arrays[name]) for name, _ in _FIELDS], np.int64).tobytes()]
    for name, kind in _FIELDS:
        raw = arrays[name].astype(kind).tobytes()
        parts.append(raw + bytes(-len(raw) % 8))
    return parts


class Automaton:
    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        at = 8 * len(_FIELDS)
        for (name, kind), n in zip(_FIELDS, raw[:at].view(np.int64), strict=True):
            size = int(n) * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + size].view(kind))
            at += size + -size % 8

    def places(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each word data[start:end], or -1 if it isn't in the lexicon."""
        place = np.full(len(start), -1, np.int64)
        if not len(self.key):
            return place
        alive = np.arange(len(start))
        state, total, at = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), start.copy()
        while len(alive):
            done = at == end[alive]
            ended = done & (self.final[state] == 1)
            place[alive[ended]] = total[ended]
            alive, state, total, at = alive[~done], state[~done], total[~done], at[~done]
            want = state.astype(np.uint64) << np.uint64(8) | data[at]
            arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            found = self.key[arc] == want
            alive, arc = alive[found], arc[found]
            state, total, at = self.target[arc].astype(np.int64), total[found] + self.output[arc], at[found] + 1
        return place
