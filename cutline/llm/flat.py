"""Many texts as one numpy array: runs of bytes, their hashes, and which hashes repeat."""

from __future__ import annotations

import numpy as np

#: The rolling hash is a polynomial in a fixed, arbitrary base modulo this prime: modulo a power of two, texts exist that collide for every base.
PRIME = (1 << 61) - 1
_BASE = 0x1B3F7A6D2C94E851
_LOW30, _LOW31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)
_P = np.uint64(PRIME)
_UP = np.ones(1, np.uint64)
_DOWN = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _reduced(x: np.ndarray) -> np.ndarray:
    """x below 2**64 modulo PRIME."""
    x = (x & _P) + (x >> _61)
    return np.minimum(x, x - _P)  # x - PRIME wraps round to a larger number where x is below it


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for a and b below PRIME."""
    a_high, a_low, b_high, b_low = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a_low * b_high + a_high * b_low
    return _reduced(np.uint64(2) * a_high * b_high + (middle >> _30) + ((middle & _LOW30) << _31) + a_low * b_low)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the hash's base and of its inverse, modulo PRIME."""
    global _UP, _DOWN
    while len(_UP) < n:
        both = []
        for powers, base in ((_UP, _BASE), (_DOWN, pow(_BASE, -1, PRIME))):
            both.append(np.concatenate((powers, _product(powers, np.uint64(pow(base, len(powers), PRIME))))))
        _UP, _DOWN = both
    return _UP[:n], _DOWN[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial hash of bytes or code points, and what shifts a span's sum to position 0."""
    up, down = _powers(len(data) + 1)
    value = data.astype(np.uint64) + np.uint64(1)
    high = value * (up[:-1] >> _31)
    term = _reduced((high >> _30) + ((high & _LOW30) << _31) + value * (up[:-1] & _LOW31))
    high, low = np.cumsum(term >> _31, dtype=np.uint64), np.cumsum(term & _LOW31, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    sums[1:] = _reduced((high >> _30) + ((high & _LOW30) << _31) + low)
    return sums, down


def span_hashes(roll: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: 61 bits of the polynomial and the lowest three of the length, mixed."""
    sums, down = roll
    h = _product(_reduced(sums[end] + (_P - sums[start])), down[start])
    return mix(h | (end - start).astype(np.uint64) << _61)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    return edge[0::2], edge[1::2]


def repeated(h: np.ndarray) -> np.ndarray:
    """Which of ``h`` occur twice or more."""
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(h), bool)
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    return twice[at] == h


def earlier(h: np.ndarray) -> np.ndarray:
    """Which of ``h`` equal one that comes before."""
    order = np.argsort(h, kind="stable")
    out = np.zeros(len(h), bool)
    out[order[1:]] = h[order[1:]] == h[order[:-1]]
    return out


class Flat:
    """The UTF-8 bytes of some texts, each followed by a line feed."""

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.n = len(parts)
        self.data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        self.start = np.zeros(self.n, np.int64)
        lengths = np.fromiter(map(len, parts), np.int64, self.n)
        np.cumsum(lengths[:-1] + 1, out=self.start[1:])
        self.end = self.start + lengths
        self.roll = rolling(self.data)
        #: Code points before each byte.
        self.points = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=self.points[1:])

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, "right") - 1

    def count(self, mask: np.ndarray) -> np.ndarray:
        """Bytes of each text under the mask."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.end] - sums[self.start]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each run without ASCII white space."""
        s, e = runs(~SPACE[self.data])
        return s, e, self.doc_of(s)


def gram_hashes(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows of n words of one text, and the windows' hashes; equal windows of two texts differ."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = len(h) - n + 1
    total = np.zeros(last, np.uint64)
    for i in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + h[i : last + i]
    at = np.flatnonzero(doc[n - 1 :] == doc[:last])
    return at, mix(total[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))


def covered(n_words: int, at: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of n words that begins at one of ``at``."""
    change = np.bincount(at, minlength=n_words + 1)[: n_words + 1].astype(np.int64)
    change -= np.bincount(at + n, minlength=n_words + 1)[: n_words + 1]
    return np.cumsum(change[:-1]) > 0


def grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of one member of each group of equal hashes, and the group of each hash."""
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def gather(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[first[i] : first[i] + counts[i]] of all i, end to end."""
    ends = np.cumsum(counts)
    return values[np.repeat(first - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
