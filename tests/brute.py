"""Plain-Python versions that the tests compare against."""

from __future__ import annotations

import random
from collections import Counter

COMP = str.maketrans("ACGT", "TGCA")
NORM = str.maketrans("acgtuU", "ACGTTT")


def stored_key(w: str) -> str:
    return min(w[::-1], w.translate(COMP))


def count_reads(reads, k: int) -> Counter:
    out: Counter = Counter()
    for r in reads:
        if r is None:
            continue
        s = r.translate(NORM)
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if not set(w) - set("ACGT"):
                out[stored_key(w)] += 1
    return out


def pack(key: str) -> int:
    v = 0
    for c in key:
        v = v * 4 + "ACGT".index(c)
    v <<= 64 - 2 * len(key)
    return v - (1 << 64) if v >= 1 << 63 else v


def bases(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("ACGT") for _ in range(n))


FIXTURE = ["ACGTACGTNACGTA", "ttacguacg", "CGTACGTAA", "GG", "", "ACGT\rACGT"]

SIGHTINGS = "sighting_id long, read_id long, pos int, window_text string, kmer_data long, sample_id string, lane int, seen_at timestamp, loaded_at timestamp"
