"""Elias-Fano sequences and the levels of an n-gram trie made of them, kept in memory-mapped files."""

from __future__ import annotations

import os

import numpy as np

_COUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_SELECT = np.zeros((256, 8), np.uint8)  # place of the r-th set bit of a byte
for _b in range(256):
    for _r, _p in enumerate([p for p in range(8) if _b >> p & 1]):
        _SELECT[_b, _r] = _p


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits of numbers one behind the other."""
    out = []
    for i in range(0, len(values), 1 << 16):
        raw = values[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        out.append(np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little"))
    data = np.concatenate([np.zeros(0, np.uint8), *out])
    return np.concatenate([data, np.zeros(16 + (-len(data)) % 8, np.uint8)]).view("<u8")


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary.

    ``words`` are the unary bits (for every high value a one per element, then a zero), ``ones`` how many ones lie
    before each word, ``low`` the packed low bits.
    """

    def __init__(self, words: np.ndarray, ones: np.ndarray, low: np.ndarray, n: int, bits: int):
        self.words, self.ones, self.low, self.n, self.bits = words, ones, low, n, bits

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(bits)).astype(np.int64)
        flags = np.zeros(((n + (top >> bits) + 1) // 64 + 2) * 64, bool)
        flags[high + np.arange(n)] = True
        words = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.uint32 if n < 1 << 32 else np.int64)
        return cls(words, ones, _packed(values, bits), n, bits)

    def mapped(self, folder: str, name: str) -> EliasFano:
        """The same sequence from files mapped into memory."""
        parts = []
        for part, array in (("words", self.words), ("ones", self.ones), ("low", self.low)):
            path = os.path.join(folder, f"{name}.{part}")
            array.tofile(path)
            parts.append(np.memmap(path, array.dtype, "r"))
        return EliasFano(*parts, self.n, self.bits)

    @property
    def size(self) -> int:
        return self.words.nbytes + self.ones.nbytes + self.low.nbytes

    def _in_word(self, word: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Place of the r-th set bit of each word."""
        raw = word.astype("<u8").view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(_COUNT[raw], axis=1, dtype=np.int64)
        byte = (upto <= r[:, None]).sum(1)
        at = np.arange(len(r))
        before = np.where(byte > 0, upto[at, np.maximum(byte - 1, 0)], 0)
        return byte * 8 + _SELECT[raw[at, byte], r - before]

    def _one(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, k, "right") - 1
        return word * 64 + self._in_word(self.words[word], k - self.ones[word].astype(np.int64))

    def _zero(self, k: np.ndarray) -> np.ndarray:
        zeros = np.arange(len(self.ones)) * 64 - self.ones.astype(np.int64)
        word = np.searchsorted(zeros, k, "right") - 1
        return word * 64 + self._in_word(~self.words[word], k - zeros[word])

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if self.bits == 0:
            return np.zeros(len(i), np.uint64)
        bit = i * self.bits
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        value = self.low[word] >> off
        more = np.where(off > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(off, np.uint64(1))), np.uint64(0))
        return (value | more) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at some places."""
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((self._one(i) - i).astype(np.uint64) << np.uint64(self.bits)) | self._lows(i)

    def successor(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For every x the place of the first element not below it (within ``[lo, hi)``) and whether that is x itself.

        The high part gives the bucket; the few low parts in it are searched by halving.
        """
        if not len(x) or not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        last = np.int64(len(self.words) * 64 - self.n - 1)
        h = np.minimum(x >> np.uint64(self.bits), np.uint64(last)).astype(np.int64)
        a = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) - (h - 1), 0)
        b = self._zero(h) - h
        if lo is not None:
            a, b = np.maximum(a, lo), np.minimum(b, hi)
        end = b.copy()
        want = x & np.uint64((1 << self.bits) - 1)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self._lows(mid) < want[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
            open_ = open_[a[open_] < b[open_]]
        inside = a < end
        same = np.zeros(len(x), bool)
        same[inside] = self._lows(a[inside]) == want[inside]
        return a, same & ((x >> np.uint64(self.bits)) <= np.uint64(last))


class Quantiser:
    """Positive numbers in 255 steps of their logarithm; code 0 is 'none'."""

    def __init__(self, values: np.ndarray):
        logs = np.log10(values[values > 0])
        self.low, self.high = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)

    @property
    def step(self) -> float:
        return (self.high - self.low) / 254 or 1.0

    def codes(self, values: np.ndarray) -> np.ndarray:
        logs = np.log10(np.where(values > 0, values, 1))
        return np.where(values > 0, 1 + np.rint((logs - self.low) / self.step), 0).astype(np.uint8)

    def table(self) -> np.ndarray:
        return np.concatenate([[0.0], 10 ** (self.low + self.step * np.arange(255))])


class Level:
    """A shard's part of a level: the nodes below its nodes of the level above.

    ``contexts`` are the numbers of those nodes in rising order, ``pointers`` where the successors of each begin,
    ``successors`` the successors' words, made one rising sequence by adding each context's place.  ``shares`` are the
    codes of the discounted probabilities, ``rests`` those of what the discount leaves to the lower order.
    """

    def __init__(self, contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, discount: float, rest: Quantiser, share: Quantiser, folder: str, name: str):
        """``contexts``, ``words`` and ``counts`` (> 0) of all different n-grams, sorted by context and word."""
        own, first, size = np.unique(contexts, return_index=True, return_counts=True)
        index = np.repeat(np.arange(len(own)), size)
        total = np.add.reduceat(counts, first).astype(np.float64) if len(own) else np.zeros(0)
        self.top = int(words.max()) if len(words) else 0
        self.bits = np.uint64(self.top.bit_length())
        self.contexts = EliasFano.build(own).mapped(folder, name + ".contexts")
        self.pointers = EliasFano.build(np.concatenate([first, [len(words)]])).mapped(folder, name + ".pointers")
        self.successors = EliasFano.build((index.astype(np.uint64) << self.bits) | words.astype(np.uint64)).mapped(folder, name + ".successors")
        codes = {"shares": share.codes((counts - discount) / total[index] if len(own) else total), "rests": rest.codes(discount * size / total if len(own) else total)}
        for part, array in codes.items():
            path = os.path.join(folder, f"{name}.{part}")
            np.concatenate([array, np.zeros(1, np.uint8)]).tofile(path)
            setattr(self, part, np.memmap(path, np.uint8, "r"))

    def look_up(self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the rest of every context and of the share of every successor, and the successor's place (-1: none).

        ``sizes`` successors follow each context.
        """
        i, known = self.contexts.successor(contexts.astype(np.uint64))
        i = np.where(known, i, 0)
        rests = np.where(known, self.rests[i], 0).astype(np.uint8)
        if not known.any():
            return rests, np.zeros(len(words), np.uint8), np.full(len(words), -1, np.int64)
        lo, hi = self.pointers.get(i).astype(np.int64), self.pointers.get(i + 1).astype(np.int64)
        of = np.repeat(np.arange(len(contexts)), sizes)
        x = (i.astype(np.uint64) << self.bits)[of] | np.minimum(words, self.top).astype(np.uint64)
        at, found = self.successors.successor(x, lo[of], hi[of])
        found &= known[of] & (words <= self.top)
        return rests, np.where(found, self.shares[np.where(found, at, 0)], 0).astype(np.uint8), np.where(found, at, -1)
