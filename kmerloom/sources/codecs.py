"""Binary layouts of keys: byte-packed first sightings and fixed records of repeats.

A key of k bases is 1, 2 or 4 words of 64 bits, 2 bits a base, left-aligned, unused bits zero. ``low`` holds
full words as native little-endian numbers and, of the last partial word, only its most significant bytes,
least significant of these first. ``root`` records are the native words, a 32-bit count and 4 bytes of padding.
"""

from __future__ import annotations

import numpy as np

from kmerloom.functions.sequence import packed_bytes, words_for_k

_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def keys_to_words(keys: list[str], k: int) -> np.ndarray:
    """uint64 words (keys x words) of key texts of k bases."""
    n, words = len(keys), words_for_k(k)
    if any(len(x) != k for x in keys):
        raise ValueError(f"every key must have {k} bases")
    raw = np.frombuffer("".join(keys).encode(), np.uint8).reshape(n, k)
    lut = np.full(256, 4, np.uint8)
    lut[_LETTERS] = np.arange(4)
    codes = lut[raw]
    if (codes > 3).any():
        raise ValueError("keys must hold A, C, G and T only")
    out = np.zeros((n, words), np.uint64)
    for j in range(k):
        out[:, j // 32] |= codes[:, j].astype(np.uint64) << np.uint64(62 - 2 * (j % 32))
    return out


def words_to_keys(words: np.ndarray, k: int) -> list[str]:
    """Key texts of uint64 words (keys x words)."""
    if not len(words):
        return []
    codes = np.empty((len(words), k), np.uint8)
    for j in range(k):
        codes[:, j] = (words[:, j // 32] >> np.uint64(62 - 2 * (j % 32))) & np.uint64(3)
    text = _LETTERS[codes].tobytes().decode()
    return [text[a : a + k] for a in range(0, len(text), k)]


def mask_words(words: np.ndarray, k: int) -> np.ndarray:
    """Words with the bits beyond k bases set to zero."""
    out = words.copy()
    for w in range(out.shape[1]):
        bases = min(32, max(0, k - 32 * w))
        keep = ((1 << (2 * bases)) - 1) << (64 - 2 * bases) if bases else 0
        out[:, w] &= np.uint64(keep)
    return out


def pack_low(words: np.ndarray, k: int) -> bytes:
    """Byte-packed keys; bits beyond k bases are dropped."""
    words = mask_words(np.asarray(words, np.uint64), k)
    full, size = k // 32, packed_bytes(k)
    raw = np.ascontiguousarray(words.astype("<u8")).view(np.uint8).reshape(len(words), -1)
    out = np.empty((len(words), size), np.uint8)
    out[:, : 8 * full] = raw[:, : 8 * full]
    tail = size - 8 * full
    if tail:
        out[:, 8 * full :] = raw[:, 8 * full + 8 - tail : 8 * full + 8]
    return out.tobytes()


def unpack_low(data: bytes, k: int) -> np.ndarray:
    """uint64 words of byte-packed keys."""
    size, full = packed_bytes(k), k // 32
    if len(data) % size:
        raise ValueError(f"{len(data)} bytes are no whole number of {size}-byte keys")
    rows = np.frombuffer(data, np.uint8).reshape(-1, size)
    raw = np.zeros((len(rows), 8 * words_for_k(k)), np.uint8)
    raw[:, : 8 * full] = rows[:, : 8 * full]
    tail = size - 8 * full
    if tail:
        raw[:, 8 * full + 8 - tail : 8 * full + 8] = rows[:, 8 * full :]
    return raw.view("<u8").astype(np.uint64)


def root_record(k: int) -> np.dtype:
    return np.dtype([("key", "<u8", (words_for_k(k),)), ("count", "<u4"), ("pad", "V4")])


def pack_root(words: np.ndarray, counts: np.ndarray, k: int) -> bytes:
    counts = np.asarray(counts, np.int64)
    if len(counts) and (counts.min() < 0 or counts.max() > 2**32 - 1):
        raise ValueError("counts must fit 32 bits")
    out = np.zeros(len(counts), root_record(k))
    out["key"], out["count"] = mask_words(np.asarray(words, np.uint64), k), counts
    return out.tobytes()


def unpack_root(data: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    kind = root_record(k)
    if len(data) % kind.itemsize:
        raise ValueError(f"{len(data)} bytes are no whole number of {kind.itemsize}-byte records")
    rows = np.frombuffer(data, kind)
    return rows["key"].astype(np.uint64).reshape(len(rows), -1), rows["count"].astype(np.int64)
