"""Golomb-coded sets in numpy: sorted hashes, compressed gaps, blocks that are decoded only when probed."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 128
INDEX_BITS = 104  # of a block: 8 bytes first value, 1 byte count, 4 bytes offset


def reduce_hashes(h: np.ndarray, modulus: int) -> np.ndarray:
    """Hashes reduced to 0..modulus-1."""
    return ((h.astype(np.int64).view(np.uint64) >> np.uint64(1)) % np.uint64(max(1, modulus))).astype(np.int64)


@dataclass
class GolombSet:
    """first: first value of each block; count: its values; start: byte offset of its gaps in payload."""

    r: int
    first: np.ndarray
    count: np.ndarray
    start: np.ndarray
    payload: np.ndarray

    @property
    def size(self) -> int:
        return int(self.count.sum())

    @property
    def bits(self) -> int:
        """Bits of the gaps and of the block index."""
        return 8 * len(self.payload) + INDEX_BITS * len(self.first)

    @classmethod
    def encode(cls, values: np.ndarray, r: int) -> GolombSet:
        """values: sorted and distinct. A gap g is coded as g >> r ones, a zero and the r low bits."""
        n = len(values)
        blocks = -(-n // BLOCK)
        count = np.full(blocks, BLOCK)
        if n:
            count[-1] = n - BLOCK * (blocks - 1)
        gap = np.diff(values, prepend=0)
        inner = np.arange(n) % BLOCK != 0
        q = np.where(inner, gap >> r, 0)
        length = np.where(inner, q + 1 + r, 0)
        size = -(-np.add.reduceat(length, np.arange(0, n, BLOCK)) // 8) if n else np.zeros(0, np.int64)
        start = np.concatenate([[0], np.cumsum(size)])
        before = np.cumsum(length) - length
        at = before - np.repeat(before[::BLOCK], count) + 8 * np.repeat(start[:-1], count)
        at, q, low = at[inner], q[inner], gap[inner] & ((1 << r) - 1)
        edge = np.zeros(8 * start[-1] + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + q, -1)
        bits = np.cumsum(edge)[:-1].astype(np.uint8)
        for b in range(r):
            bits[at + q + 1 + b] = (low >> (r - 1 - b)) & 1
        return cls(r, values[::BLOCK].astype(np.int64), count.astype(np.int64), start[:-1].astype(np.int64), np.packbits(bits))

    def decode(self, blocks: np.ndarray | None = None) -> np.ndarray:
        """Values of the given ascending blocks (default: all), in order."""
        blocks = np.arange(len(self.first)) if blocks is None else blocks
        if not len(blocks):
            return np.zeros(0, np.int64)
        end = np.append(self.start[1:], len(self.payload))
        size = (end - self.start)[blocks]
        at = 8 * (np.cumsum(size) - size)
        take = np.repeat(self.start[blocks] - at // 8, size) + np.arange(size.sum())
        bits = np.unpackbits(self.payload[take])
        zeros = np.append(np.flatnonzero(bits == 0), len(bits))
        out = np.empty((len(blocks), BLOCK), np.int64)
        out[:, 0] = self.first[blocks]
        n = self.count[blocks]
        weights = 1 << np.arange(self.r - 1, -1, -1)
        for i in range(1, int(n.max())):
            live = np.flatnonzero(n > i)
            stop = zeros[np.searchsorted(zeros, at[live])]
            low = bits[stop[:, None] + 1 + np.arange(self.r)] @ weights if self.r else 0
            out[live, i] = out[live, i - 1] + ((stop - at[live]) << self.r) + low
            at[live] = stop + 1 + self.r
        return out[np.arange(BLOCK) < n[:, None]]

    def contains(self, values: np.ndarray) -> np.ndarray:
        """Whether each value is in the set; only the blocks that may hold one are decoded."""
        if not len(self.first) or not len(values):
            return np.zeros(len(values), bool)
        block = np.searchsorted(self.first, values, "right") - 1
        some = block >= 0
        there = self.decode(np.unique(block[some]))
        if not len(there):
            return some
        at = np.minimum(np.searchsorted(there, values), len(there) - 1)
        return some & (there[at] == values)


def rice_parameter(values: int, modulus: int) -> int:
    """Low bits r that code the gaps of so many values in 0..modulus-1 in the fewest bits."""
    return _best_rice(np.array([max(1, values) / max(1, modulus)]))[0][0]


def _best_rice(density: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each density of occupied places: the best r, and its mean bits a gap (ones, zero and low bits)."""
    r = np.arange(40)
    stay = np.power(1 - np.minimum(density[:, None], 1 - 1e-9), np.exp2(r))  # chance that a gap spans 2^r places
    cost = r + 1 + stay / (1 - np.minimum(stay, 1 - 1e-12))
    best = cost.argmin(1)
    return best, cost[np.arange(len(best)), best]


_RANGES = np.unique([c << j for j in range(56) for c in range(1 if j == 0 else 32, 64)])


def target_range(keys: int, bits: float, most_bits: int) -> int:
    """Largest range, at most keys << most_bits, whose Golomb-coded set of that many hashes fits the bits; 0 if none does.

    A range below the number of keys is allowed: hashes then share places, the set is denser and wrong more often.
    """
    if keys < 1 or bits < INDEX_BITS + 8:
        return 0
    ranges = _RANGES[_RANGES <= keys << most_bits]
    for some in (ranges[-1:], ranges):  # mostly the largest fits
        held = np.maximum(1, some * -np.expm1(-keys / some))
        need = held * _best_rice(held / some)[1] + np.ceil(held / BLOCK) * (INDEX_BITS + 8)
        fits = np.flatnonzero(1.02 * need + 3 * np.sqrt(need) <= bits)
        if len(fits):
            return int(some[fits[-1]])
    return 0


def bounded_set(hashes: np.ndarray, bits: float, most_bits: int) -> tuple[GolombSet | None, int]:
    """Set of the distinct hashes within the bits, and its range; None and 0 if the bits hold no set."""
    modulus = target_range(len(hashes), bits, most_bits)
    while modulus:
        values = np.unique(reduce_hashes(hashes, modulus))
        s = GolombSet.encode(values, rice_parameter(len(values), modulus))
        if s.bits <= bits:
            return s, modulus
        modulus = modulus * 15 // 16
    return None, 0


class GrowingSet:
    """A set of hashes that arrive in batches, as Golomb-coded runs that are merged like those of a log.

    Runs and the open batch never take more than ``bits``. When they would, the range is halved and the runs are
    coded anew; bits that hold no set make a set that answers yes to everything (``modulus`` 0).
    """

    def __init__(self, expected: int, bits: float, most_bits: int, batch: int, runs: int):
        self.batch = max(1, min(expected, batch, max(16, int(bits // 512))))
        self.room = bits - 64 * self.batch  # the open batch holds 64-bit numbers
        self.modulus = target_range(expected, self.room, most_bits)
        self.most_runs, self.runs, self.peak_bits = runs, [], 0

    def probe(self, hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Answers for a batch, in order, and the chance of each to be a yes for a new hash; those not known are added."""
        if not self.modulus:
            return np.ones(len(hashes), bool), np.ones(len(hashes))
        values = reduce_hashes(hashes, self.modulus)
        found = np.zeros(len(values), bool)
        for run in self.runs:
            found |= run.contains(values)
        open_ = np.flatnonzero(~(found | known))
        fresh = np.zeros(len(values), bool)
        distinct, first = np.unique(values[open_], return_index=True)
        fresh[open_[first]] = True
        found[open_] = ~fresh[open_]
        held = sum(r.size for r in self.runs) + np.cumsum(fresh) - fresh
        chance = held / self.modulus
        self._add(distinct)
        return found, chance

    def _add(self, values: np.ndarray) -> None:
        if len(values):
            self.runs.append(GolombSet.encode(values, rice_parameter(len(values), self.modulus)))
        while self.runs and (len(self.runs) > self.most_runs or sum(r.bits for r in self.runs) > self.room):
            if len(self.runs) == 1:  # one run and still too large
                self.modulus = self.modulus // 2 if self.modulus % 2 == 0 else 0
            if not self.modulus:
                self.runs = []
                return
            values = np.unique(np.concatenate([r.decode() for r in self.runs]) % self.modulus)
            self.runs = [GolombSet.encode(values, rice_parameter(len(values), self.modulus))]
        self.peak_bits = max(self.peak_bits, sum(r.bits for r in self.runs) + 64 * self.batch)
