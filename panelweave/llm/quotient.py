"""Counting quotient filters over packed n-grams, without loss.

An n-gram of word ids of b bits is one number of n * b bits.  A Feistel network permutes these
numbers, so that they spread evenly and can be turned back.  The leading bits of a permuted number are
its quotient, the others its remainder, which is kept in full: a filter is the number of
entries of each quotient, the sorted remainders and their counters, and nothing is lost.
The first bits of the quotient name a segment; segments of different filters are
merged on their own.

Numbers are held as a few arrays of 64-bit limbs, the most significant first, so any id width works.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
#: Odd multipliers of a common 64-bit mixing function.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: A counter below this value takes one byte; larger ones follow apart.
SMALL = 255


def _mask(bits: int) -> np.uint64:
    return U((1 << bits) - 1)


@dataclass(frozen=True)
class Layout:
    """How an n-gram is packed: n words of `bits` bits each."""

    n: int
    bits: int

    @property
    def widths(self) -> list[int]:
        """Widths of the limbs: two at least, since the permutation works on one by the others."""
        total = max(self.n * self.bits, 2)
        limbs = max(2, -(-total // 60))
        return [total // limbs + (i < total % limbs) for i in range(limbs)]

    def _places(self):
        """Limb, word, and by how much the word's bits move to the left in the limb (negative: to the right)."""
        end = sum(self.widths)
        for i, width in enumerate(self.widths):
            end -= width
            for j in range(self.n):
                low = (self.n - 1 - j) * self.bits - end
                if -self.bits < low < width:
                    yield i, j, low

    def pack(self, words: list[np.ndarray]) -> list[np.ndarray]:
        """Permuted limbs of the n-grams whose k-th words are words[k]."""
        limbs = [np.zeros(len(words[0]), U) for _ in self.widths]
        for i, j, low in self._places():
            value = words[j].astype(U)
            limbs[i] |= (value << U(low) if low >= 0 else value >> U(-low)) & _mask(self.widths[i])
        for k in range(2 * len(limbs)):
            self._round(limbs, k)
        return limbs

    def unpack(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        """The words of permuted limbs."""
        limbs = [x.copy() for x in limbs]
        for k in reversed(range(2 * len(limbs))):
            self._round(limbs, k)
        words = [np.zeros(len(limbs[0]), U) for _ in range(self.n)]
        for i, j, low in self._places():
            words[j] |= (limbs[i] >> U(low) if low >= 0 else limbs[i] << U(-low)) & _mask(self.bits)
        return words

    def _round(self, limbs: list[np.ndarray], k: int) -> None:
        """Change one limb by a mixture of the others; doing it again undoes it."""
        at = k % len(limbs)
        mixed = np.full(len(limbs[0]), U(k + 1))
        for i, limb in enumerate(limbs):
            if i != at:
                mixed = (mixed ^ limb) * U(MIX[0])
                mixed = (mixed ^ (mixed >> U(30))) * U(MIX[1])
                mixed = (mixed ^ (mixed >> U(27))) * U(MIX[2])
                mixed ^= mixed >> U(31)
        limbs[at] ^= mixed & _mask(self.widths[at])

    def leading(self, limbs: list[np.ndarray], bits: int) -> np.ndarray:
        """The first bits of permuted numbers; at most those of the first limb."""
        return (limbs[0] >> U(self.widths[0] - bits)).astype("i8")

    def most_leading(self) -> int:
        return self.widths[0]


def order(limbs: list[np.ndarray], widths: list[int]) -> np.ndarray:
    """What sorts numbers; one sort where they fit into 64 bits."""
    if sum(widths) <= 64:
        whole = limbs[0]
        for limb, width in zip(limbs[1:], widths[1:]):
            whole = (whole << U(width)) | limb
        return np.argsort(whole, kind="stable")
    return np.lexsort(limbs[::-1])


def distinct(limbs: list[np.ndarray], layout: Layout) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """What sorts the numbers, where each different one starts in that order, and the different ones."""
    by = order(limbs, layout.widths)
    limbs = [x[by] for x in limbs]
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.any([x[1:] != x[:-1] for x in limbs], axis=0)
    starts = np.flatnonzero(new)
    return by, starts, [x[starts] for x in limbs]


@dataclass
class Filter:
    """One segment: bits of its own quotients, entries per quotient, remainders and counters as bytes."""

    bits: int
    runs: bytes
    remainders: bytes
    small: bytes
    large: bytes

    @staticmethod
    def of(limbs: list[np.ndarray], counts: np.ndarray, layout: Layout, lead: int) -> Filter:
        """The filter of sorted different numbers that agree in their first `lead` bits."""
        widths = layout.widths
        bits = min(max(len(counts).bit_length() - 1, 0), widths[0] - lead)
        own = layout.leading(limbs, lead + bits) & ((1 << bits) - 1)
        runs = np.bincount(own, minlength=1 << bits)
        runs = runs.astype("u1" if runs.max(initial=0) < 256 else "<u4")
        rest = [limbs[0] & _mask(widths[0] - lead - bits), *limbs[1:]]
        left = [widths[0] - lead - bits, *widths[1:]]
        parts = [x.astype(">u8").view("u1").reshape(-1, 8)[:, 8 - -(-w // 8):] for x, w in zip(rest, left)]
        small = np.minimum(counts, SMALL).astype("u1")
        return Filter(bits, runs.tobytes(), np.ascontiguousarray(np.concatenate(parts, axis=1)).tobytes(), small.tobytes(),
                      counts[small == SMALL].astype("<i8").tobytes())

    def entries(self, layout: Layout, segment: int, lead: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The sorted permuted numbers, whole, and their counts."""
        widths = layout.widths
        runs = np.frombuffer(self.runs, "u1" if len(self.runs) == 1 << self.bits else "<u4")
        own = np.repeat(np.arange(len(runs), dtype="u8"), runs)
        counts = np.frombuffer(self.small, "u1").astype("i8")
        counts[counts == SMALL] = np.frombuffer(self.large, "<i8")
        left = [widths[0] - lead - self.bits, *widths[1:]]
        sizes = [-(-w // 8) for w in left]
        data = np.frombuffer(self.remainders, "u1").reshape(len(counts), sum(sizes))
        limbs, at = [], 0
        for size in sizes:
            wide = np.zeros((len(counts), 8), "u1")
            wide[:, 8 - size:] = data[:, at:at + size]
            limbs.append(wide.reshape(-1).view(">u8").astype(U))
            at += size
        limbs[0] = limbs[0] | ((U(segment) << U(self.bits)) | own) << U(left[0])
        return limbs, counts


def segments(limbs: list[np.ndarray], counts: np.ndarray, layout: Layout, lead: int):
    """(segment, filter) of sorted different numbers."""
    segment = layout.leading(limbs, lead)
    cuts = np.r_[np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]), len(segment)] if len(segment) else np.array([0])
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(segment[a]), Filter.of([x[a:b] for x in limbs], counts[a:b], layout, lead)


def merge(filters: list[Filter], layout: Layout, segment: int, lead: int):
    """Different numbers of several filters of one segment, their summed counts, and per filter which of them it holds."""
    parts = [f.entries(layout, segment, lead) for f in filters]
    sizes = [len(c) for _, c in parts]
    limbs = [np.concatenate(x) for x in zip(*(p for p, _ in parts))]
    counts = np.concatenate([c for _, c in parts])
    by, starts, found = distinct(limbs, layout)
    sums = np.add.reduceat(counts[by], starts) if len(by) else counts
    number = np.empty(len(by), "i8")
    number[by] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(by)]))
    return found, sums, np.split(number, np.cumsum(sizes)[:-1])
