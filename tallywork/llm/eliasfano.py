"""Elias-Fano coded monotone sequences and bit-packed integers in numpy, read at any place without decoding the rest."""

from __future__ import annotations

import numpy as np

U8, U64 = np.uint8, np.uint64
#: SELECT[k, b]: place of the k-th one bit of byte b, from its low end (8: there is none).
SELECT = np.full((8, 256), 8, U8)
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        SELECT[_k, _b] = _i


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The low `bits` bits (57 at most) of each value, one after another, as bytes, with eight bytes or more to spare."""
    n = len(values)
    words = np.zeros(-(-n * bits // 64) + 1, U64)
    if n and bits:
        v = values.astype(U64) & U64((1 << bits) - 1)
        at = np.arange(n, dtype=np.int64) * bits
        word, off = at >> 6, (at & 63).astype(U64)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[first]] = np.bitwise_or.reduceat(v << off, first)
        over = np.flatnonzero(off > U64(64 - bits))
        words[word[over] + 1] |= v[over] >> (U64(64) - off[over])
    return words.view(U8)


def unpack(raw: np.ndarray, bits: int, i: np.ndarray) -> np.ndarray:
    """The packed values at the places i."""
    if not bits:
        return np.zeros(len(i), U64)
    at = i * bits
    window = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    return (window[at >> 3] >> (at & 7).astype(U64)) & U64((1 << bits) - 1)


def successor(raw: np.ndarray, bits: int, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each run [lo, hi) of ascending packed values, the place of the first that is at least x (hi: none is)."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        a, b = lo[open_], hi[open_]
        mid = (a + b) >> 1
        less = unpack(raw, bits, mid) < x[open_]
        a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
        lo[open_], hi[open_] = a, b
        open_ = open_[a < b]
    return lo


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of integers below universe: length and low bits' width, low bits, high bits, ones ahead of each 64 of them."""
    n = len(values)
    bits = max(0, (int(universe) // max(1, n)).bit_length() - 1)
    length = n + (int(universe) >> bits) + 2
    marks = np.zeros(length + -length % 64, bool)
    marks[(values >> U64(bits)).astype(np.int64) + np.arange(n)] = True
    upper = np.packbits(marks, bitorder="little").view("<u8")
    ones = np.cumsum(np.bitwise_count(upper), dtype=np.int64)
    return {"head": np.array([n, bits], "<u8"), "low": pack(values, bits), "upper": upper, "ones": np.concatenate(([0], ones[:-1])).astype("<u4")}


class Sequence:
    """A coded sequence over arrays that may be memory-mapped."""

    def __init__(self, head, low, upper, ones):
        self.n, self.bits = int(head[0]), int(head[1])
        self.low, self.upper, self.ones = low, upper, ones

    def get(self, i: np.ndarray) -> np.ndarray:
        """Elements by index: a bisection over the counts of ones, then a select inside 64 bits."""
        word = np.searchsorted(self.ones, i.astype(np.uint32), side="right") - 1
        left = i - self.ones[word]
        tail = self.upper[word].view(U8).reshape(-1, 8)
        counts = np.cumsum(np.bitwise_count(tail), axis=1, dtype=U8)
        b = (counts <= left[:, None]).sum(axis=1)
        rows = np.arange(len(i))
        left = left - np.where(b > 0, counts[rows, b - 1], 0)
        at = word * 64 + b * 8 + SELECT[left, tail[rows, b]]
        return ((at - i).astype(U64) << U64(self.bits)) | unpack(self.low, self.bits, i)

    def runs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements at ascending places i, which may repeat, and those after them."""
        if not len(i):
            return i, i
        at = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        n = np.diff(np.append(at, len(i)))
        return np.repeat(self.get(i[at]).astype(np.int64), n), np.repeat(self.get(i[at] + 1).astype(np.int64), n)
