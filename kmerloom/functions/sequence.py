"""Column functions over bases, windows and stored keys.

A stored key is the smaller of ``reverse(w)`` and ``complement(w)`` of a window ``w``. In packed form
it has 2 bits a base (A=0, C=1, G=2, T=3), left-aligned in 64 bits, so a packed key can be negative.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
BLANKS = " \t\r\n"
MAX_PACKED_K = 31


def normalize_bases(seq: Column) -> Column:
    """Upper-case A, C, G, T and read U as T; every other byte stays as it is (ASCII only)."""
    return F.translate(seq, "acgtuU", "ACGTTT")


def clean_window(text: Column) -> Column:
    """Window text without blanks and carriage returns at its ends, normalised."""
    return normalize_bases(F.btrim(text, F.lit(BLANKS)))


def is_kmer(text: Column, k: int) -> Column:
    """True if text is exactly k bases; null stays null."""
    return text.rlike(f"\\A[ACGT]{{{k}}}\\z")


def complement(window: Column) -> Column:
    return F.translate(window, "ACGT", "TGCA")


def reverse_complement(window: Column) -> Column:
    return F.reverse(complement(window))


def canonical(window: Column) -> Column:
    """Textbook canonical form: smaller of the window and its reverse complement."""
    return F.least(window, reverse_complement(window))


def stored_key(window: Column) -> Column:
    return F.least(F.reverse(window), complement(window))


def base_code(text: Column) -> Column:
    """Base-4 number of a text of at most 31 bases."""
    return F.conv(F.translate(text, BASES, "0123"), 4, 10).cast("bigint")


def pack_key(key: Column, k: int) -> Column:
    """Packed stored key of a key text of k bases."""
    if not 1 <= k <= MAX_PACKED_K:
        raise ValueError(f"k must be 1..{MAX_PACKED_K} for packed keys")
    return F.shiftleft(base_code(key), 64 - 2 * k)


def left_aligned_text(packed: Column, k: int) -> Column:
    """Text of the k bases in the high bits of a number, four bases a look-up in the table of all such texts."""
    table = F.expr("split('" + ",".join(map("".join, product(BASES, repeat=4))) + "', ',')")  # folded to a constant
    parts = []
    for at in range(0, k, 4):
        text = F.get(table, F.shiftrightunsigned(packed, 56 - 2 * at).bitwiseAND(255).cast("int"))
        parts.append(text if at + 4 <= k else F.substring(text, 1, k - at))
    return F.concat(*parts)


def unpack_key(packed: Column, k: int) -> Column:
    """Key text of a packed stored key; bits below the k bases are ignored."""
    if not 1 <= k <= MAX_PACKED_K:
        raise ValueError(f"k must be 1..{MAX_PACKED_K} for packed keys")
    return left_aligned_text(packed, k)


def shift_bases_left(packed: Column, bases: int) -> Column:
    """Packed number without its first bases, zeros (A) coming in at the end."""
    return F.shiftleft(packed, 2 * bases)


def shift_bases_right(packed: Column, bases: int) -> Column:
    """Packed number with zeros (A) before its first base."""
    return F.shiftrightunsigned(packed, 2 * bases)


def packed_root(packed: Column) -> Column:
    """Root number (0..255) of a packed key: its first 4 bases."""
    return F.shiftrightunsigned(packed, 56).cast("int")


def root_text(root: Column) -> Column:
    return F.translate(F.lpad(F.conv(root.cast("string"), 10, 4), 4, "0"), "0123", BASES)


def root_number(key: Column) -> Column:
    """Root number of a key text of 4 bases or more."""
    return F.conv(F.translate(F.substring(key, 1, 4), BASES, "0123"), 4, 10).cast("int")


def node_prefix(key: Column, depth: int) -> Column:
    """The two bases that choose a child at tree depth 0, 1 or 2 below the root prefix."""
    return F.substring(key, 5 + 2 * depth, 2)


def packed_bytes(k: int) -> int:
    """Bytes of one byte-packed key of k bases."""
    if not 1 <= k <= 128:
        raise ValueError("k must be 1..128")
    return 8 * (k // 32) + (2 * (k % 32) + 7) // 8


def words_for_k(k: int) -> int:
    """64-bit words of a key in memory: 1, 2 or 4."""
    if not 1 <= k <= 128:
        raise ValueError("k must be 1..128")
    return 1 if k <= 32 else 2 if k <= 64 else 4
