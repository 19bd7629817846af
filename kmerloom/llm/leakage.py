"""Evaluation texts inside training documents: rare n-gram seeds and Smith-Waterman alignment (problem 7).

Words are the longest runs of ``[A-Za-z0-9_]`` without case. Every window of ``run`` words of an item holds
``run - n + 1`` seeds (n-grams); the one found in the fewest documents is its rare seed. A document with
the whole window has this seed, so candidates are complete. An edited copy may have lost just that seed; the
report also takes the seeds of a window found in at most ``WITHIN`` times as many documents, or in few, so that edited copies
do not depend on how often their item leaked, while sentences that many documents share stay out.

The corpus is read twice, hashed with array operations. The first pass leaves only numbers of documents by
seed; the second leaves the passages around rare seeds, at most ``WITHIN`` times the documents of the rarest
seed of each window. Passages are aligned to their items.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.session import materialize

RUN = 15
SEED = 6
SLACK = 20
RARE_DOCS = 20
WITHIN = 2.0
CHUNK_BYTES = 1 << 20
LONG_BYTES = 8 << 20
ITEM_BLOCK_CHARS = 32 << 20
MOST_SIEVE = 1 << 25
MATCH, MISMATCH, GAP = 2, -1, -1

_WORD = re.compile(r"[A-Za-z0-9_]+")
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd multipliers
_MASK = (1 << 64) - 1


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _codes() -> np.ndarray:
    """Code of each byte: 0 outside words, else one code for both cases."""
    lut = np.zeros(256, np.uint64)
    for b in range(128):
        c = chr(b)
        if c.isalnum() or c == "_":
            lut[b] = ord(c.lower())
    return lut


def _powers(p: int, n: int) -> np.ndarray:
    out = np.full(n, p, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHasher:
    """Word and n-gram hashes of byte texts by array operations."""

    def __init__(self) -> None:
        self.codes = _codes()
        self.up = self.down = np.zeros(0, np.uint64)

    def words(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of every word of buf, whose last byte is outside words."""
        code = self.codes[buf]
        inside = np.concatenate([[False], code > 0])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        if len(self.up) <= len(buf):
            self.up = _powers(_P, len(buf) + 1)
            self.down = _powers(pow(_P, -1, 1 << 64), len(buf) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * self.up[: len(buf)], dtype=np.uint64)])
        h = (total[end] - total[start]) * self.down[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return start, end, h ^ (h >> np.uint64(32))

    @staticmethod
    def ngrams(h: np.ndarray, n: int) -> np.ndarray:
        if len(h) < n:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(_Q) + h[k : k + len(out)]
        return out


@dataclass
class SeedIndex:
    """Seeds of a block of items: sorted distinct hashes and, for each, its (item, position) pairs.

    texts are the items' words with blanks between. 8 bytes a seed and 12 a pair: some 3 bytes a character of the items.
    """

    n: int
    ids: list[int]
    texts: list[str]
    lengths: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray
    owner: np.ndarray
    position: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[int, str]], n: int) -> SeedIndex:
        hasher, hashes, owner, position, texts, lengths = WordHasher(), [], [], [], [], []
        for i, (_, text) in enumerate(items):
            words = words_of(text)
            texts.append(" ".join(words))
            lengths.append(len(words))
            g = hasher.ngrams(hasher.words(np.frombuffer((texts[-1] + " ").encode(), np.uint8))[2], n)
            hashes.append(g)
            owner.append(np.full(len(g), i, np.int32))
            position.append(np.arange(len(g), dtype=np.int64))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        distinct, at = np.unique(h[order], return_index=True)
        pick = lambda x, kind: (np.concatenate(x) if x else np.zeros(0, kind))[order]
        return cls(n, [i for i, _ in items], texts, np.array(lengths, np.int64), distinct, np.append(at, len(h)), pick(owner, np.int32), pick(position, np.int64))

    @property
    def overlap(self) -> int:
        """Words that two parts of a long text share, so that the longest passage stands in one of them."""
        return int(self.lengths.max(initial=0)) + 2 * SLACK + self.n

    def rare(self, count: np.ndarray, run: int, within: float = 1.0, few: int = 0) -> SeedIndex:
        """Index of the (item, position) pairs that are rare in some window of ``run`` words of their item; count: documents of each seed.

        Rare is the seed of the window in the fewest documents (the first of several), and any in at most ``few`` documents or, if
        ``within`` is above 1, in at most so many times as many as that one.
        """
        seed = np.repeat(np.arange(len(self.hashes)), np.diff(self.offsets))  # of every pair
        kept = np.zeros(len(seed), bool)
        order = np.lexsort((self.position, self.owner))
        bounds = np.searchsorted(self.owner[order], np.arange(len(self.lengths) + 1))
        for i in np.flatnonzero(self.lengths >= run):
            mine = order[bounds[i] : bounds[i + 1]]
            n = np.lib.stride_tricks.sliding_window_view(count[seed[mine]], run - self.n + 1)
            kept[mine[np.arange(len(n)) + n.argmin(1)]] = True
            if within > 1 or few:
                at = np.flatnonzero(n <= np.maximum(few, within * n.min(1, keepdims=True)))
                kept[mine[at // n.shape[1] + at % n.shape[1]]] = True
        left, at = np.unique(seed[kept], return_index=True)
        return SeedIndex(self.n, self.ids, self.texts, self.lengths, self.hashes[left], np.append(at, kept.sum()), self.owner[kept], self.position[kept])


def _seed_hits(hashes: np.ndarray, n: int) -> Callable[[list[bytes]], tuple | None]:
    """Function of a chunk of texts: its bytes, word bounds, first byte of every text, and the word, seed and text of every hit."""
    hasher = WordHasher()
    size = min(MOST_SIEVE, 1 << max(16, (16 * len(hashes)).bit_length()))
    sieve = np.zeros(size, bool)
    sieve[(hashes & np.uint64(size - 1)).astype(np.int64)] = True

    def find(texts: list[bytes]) -> tuple | None:
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        start, end, h = hasher.words(buf)
        g = hasher.ngrams(h, n)
        maybe = np.flatnonzero(sieve[(g & np.uint64(size - 1)).astype(np.int64)])
        if not len(maybe) or not len(hashes):
            return None
        at = np.minimum(np.searchsorted(hashes, g[maybe]), len(hashes) - 1)
        hit = hashes[at] == g[maybe]
        word, seed = maybe[hit], at[hit]
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        doc = np.searchsorted(begin, start[word], "right") - 1
        whole = end[word + n - 1] <= begin[doc + 1]
        return (buf, start, end, begin, word[whole], seed[whole], doc[whole]) if whole.any() else None

    return find


def _parts(text: bytes, overlap: int) -> Iterator[tuple[bytes, int]]:
    """Parts of a long text, cut between words, and the number of words before each; ``overlap`` words stand in two parts."""
    codes, pos, before, size = _codes(), 0, 0, LONG_BYTES
    raw = np.frombuffer(text, np.uint8)
    while True:
        inside = codes[raw[pos : pos + size]] > 0
        more = pos + size < len(raw)
        if more:
            outside = np.flatnonzero(~inside)
            inside = inside[: outside[-1] + 1] if len(outside) else inside[:0]
        starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
        if more and len(starts) <= 2 * overlap:  # too few words to go on from: a larger part
            size *= 2
            continue
        yield text[pos : pos + len(inside)], before
        if not more:
            return
        before += len(starts) - overlap
        pos, size = pos + int(starts[-overlap]), LONG_BYTES


def _chunks(batch: pa.RecordBatch, overlap: int) -> Iterator[tuple[list, list[bytes], list[int]]]:
    """Ids, texts and words before them in chunks of about ``CHUNK_BYTES``.

    A text of more than ``LONG_BYTES`` comes in parts that share ``overlap`` words, enough for any passage: memory does not grow with it.
    """
    ids, texts, before, size = [], [], [], 0
    for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
        for part, words in _parts(text, overlap) if len(text) > LONG_BYTES else [(text, 0)]:
            if ids and size + len(part) > CHUNK_BYTES:
                yield ids, texts, before
                ids, texts, before, size = [], [], [], 0
            ids.append(i)
            texts.append(part)
            before.append(words)
            size += len(part)
    if ids:
        yield ids, texts, before


def _readable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def seed_documents(docs: DataFrame, index: SeedIndex) -> np.ndarray:
    """Number of documents (or parts of long ones) of every seed of the index: no text leaves the scan, and the driver gets 16 bytes a seed at most."""
    hashes, n, overlap = index.hashes, index.n, index.overlap

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _seed_hits(hashes, n)
        for batch in batches:
            parts = [np.unique(np.stack(hits[:-3:-1]), axis=1)[1] for _, texts, _ in _chunks(batch, overlap) if (hits := find(texts))]
            seed, count = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(seed.astype(np.int64)), pa.array(count.astype(np.int64))], ["seed", "n"])

    rows = _readable(docs).mapInArrow(scan, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(hashes), np.int64)
    out[rows["seed"].to_numpy()] = rows["n"].to_numpy()
    return out


def find_passages(docs: DataFrame, index: SeedIndex) -> DataFrame:
    """doc_id, item (number in the index), at (word number), words: the passages of docs (doc_id, text) around seed hits."""
    hashes, n, longest, offsets, owner, position = index.hashes, index.n, index.lengths, index.offsets, index.owner, index.position
    overlap = index.overlap

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _seed_hits(hashes, n)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "item", "at", "words")}
            for ids, texts, before in _chunks(batch, overlap):
                if hits := find(texts):
                    cut_passages(ids, before, *hits, out)
            if out["item"]:
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema({"doc_id": pa.int64(), "item": pa.int32(), "at": pa.int64(), "words": pa.string()}))

    def cut_passages(ids, before, buf, start, end, begin, word, seed, doc, out) -> None:
        first = np.searchsorted(start, begin)  # first word of every document
        # a hit counts for every item that the seed is rare in
        times = offsets[seed + 1] - offsets[seed]
        line = np.repeat(offsets[seed], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        word, seed, doc = (np.repeat(x, times) for x in (word, seed, doc))
        item, pos = owner[line], position[line]
        order = np.lexsort((word, item, doc))
        word, seed, doc, item, pos = (x[order] for x in (word, seed, doc, item, pos))
        reach = longest[item] + SLACK
        new = np.ones(len(word), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] - word[:-1] > reach[1:])
        edges = np.append(np.flatnonzero(new), len(word))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            d, i = doc[a], item[a]
            lo = max(first[d], int((word[a:b] - pos[a:b]).min()) - SLACK)
            hi = min(first[d + 1], int((word[a:b] - pos[a:b]).max()) + longest[i] + SLACK)
            raw = buf[start[lo] : end[hi - 1]].tobytes().decode("utf-8", "replace")
            for k, v in zip(out, (ids[d], int(i), before[d] + int(lo - first[d]), " ".join(words_of(raw))), strict=True):
                out[k].append(v)

    return _readable(docs).mapInArrow(scan, "doc_id bigint, item int, at bigint, words string")


def align(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman score and longest common run of one item with each line of passages (padded with -1)."""
    p, length = passages.shape
    column = np.arange(length + 1, dtype=np.int32) * -GAP
    score = np.zeros((p, length + 1), np.int32)
    run = np.zeros((p, length + 1), np.int32)
    best, longest = np.zeros(p, np.int32), np.zeros(p, np.int32)
    for w in item:
        same = passages == w
        step = np.where(same, MATCH, MISMATCH)
        base = np.maximum(score + GAP, 0)
        np.maximum(base[:, 1:], score[:, :-1] + step, out=base[:, 1:])
        score = np.maximum.accumulate(base + column, axis=1) - column
        nxt = np.zeros_like(run)
        nxt[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        run = nxt
        np.maximum(best, score.max(1), out=best)
        np.maximum(longest, run.max(1), out=longest)
    return best, longest


def align_passages(passages: DataFrame, index: SeedIndex) -> DataFrame:
    """doc_id, item_id, at, run, score, share of every passage; equal passages of a batch are aligned once.

    run is the longest common run of words, share the score over the score of the whole item.
    """
    ids, whole, lengths = index.ids, index.texts, index.lengths

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, at = batch.column("doc_id").to_pylist(), batch.column("at").to_pylist()
            items, texts = batch.column("item").to_pylist(), batch.column("words").to_pylist()
            todo: dict[int, dict[str, int]] = {}
            for i, t in zip(items, texts, strict=True):
                todo.setdefault(i, {})[t] = -1
            done: dict[tuple[int, str], tuple[int, int]] = {}
            for i, group in todo.items():
                words = whole[i].split(" ")
                number = {w: k for k, w in enumerate(dict.fromkeys(words))}
                item = np.array([number[w] for w in words], np.int32)
                split = sorted(((t, t.split(" ")) for t in group), key=lambda x: len(x[1]))
                a = 0
                while a < len(split):
                    # passages of similar length together, about a million cells at once
                    b = a + 1
                    while b < len(split) and b - a < 256 and len(split[b][1]) * (b + 1 - a) <= 1 << 18:
                        b += 1
                    part = split[a:b]
                    grid = np.full((len(part), len(part[-1][1])), -1, np.int32)
                    for k, (_, ws) in enumerate(part):
                        grid[k, : len(ws)] = [number.get(w, -1) for w in ws]
                    for (t, _), s, r in zip(part, *align(item, grid), strict=True):
                        done[i, t] = int(s), int(r)
                    a = b
            result = [done[i, t] for i, t in zip(items, texts, strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": docs, "item_id": [ids[i] for i in items], "at": at, "run": [r for _, r in result],
                    "score": [s for s, _ in result], "share": [s / (MATCH * int(lengths[i])) for i, (s, _) in zip(items, result, strict=True)],
                },
                schema=pa.schema({"doc_id": pa.int64(), "item_id": pa.int64(), "at": pa.int64(), "run": pa.int32(), "score": pa.int32(), "share": pa.float64()}),
            )

    return passages.select("doc_id", "item", "at", "words").mapInArrow(score, "doc_id bigint, item_id bigint, at bigint, run int, score int, share double")


def leaked_passages(docs: DataFrame, items: DataFrame, run: int = RUN, n: int = SEED, edited: bool = False) -> DataFrame:
    """doc_id, item_id, at, run, score, share of every passage of docs that holds a rare seed of an item.

    The rarest seed of every window finds all passages with ``run`` words of an item. ``edited`` takes more seeds of each
    window, for copies that were changed.
    Items are a stated query set: they are taken in blocks of at most ``ITEM_BLOCK_CHARS`` characters (or one
    item), each set against all documents. Items shorter than ``run`` words, null texts and null ids have no
    result; repeated items count once; empty tables give no rows.
    """
    if not 1 <= n <= run:
        raise ValueError("n must be 1..run")
    items = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // ITEM_BLOCK_CHARS))
    parts = []
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        index = SeedIndex.build([(r["item_id"], r["text"]) for r in mine], n)
        counts = seed_documents(docs, index)
        rare = index.rare(counts, run, *((WITHIN, RARE_DOCS) if edited else ()))
        passages = materialize(find_passages(docs, rare), "passages")
        parts.append(materialize(align_passages(passages, rare), "aligned"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leaked_documents(docs: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """item_id, doc_id: the document holds ``run`` or more consecutive words of the item."""
    return leaked_passages(docs, items, run).where(F.col("run") >= run).select(F.col("item_id").cast("int").alias("item_id"), "doc_id").distinct()


def leak_report(docs: DataFrame, items: DataFrame, run: int = RUN, share: float = 0.5) -> DataFrame:
    """item_id, suite, exact_docs, edited_docs, best_share of every item.

    exact_docs hold ``run`` consecutive words; edited_docs do not, but align with at least ``share`` of the item.
    """
    by_doc = leaked_passages(docs, items, run, edited=True).groupBy("item_id", "doc_id").agg(F.max("run").alias("run"), F.max("share").alias("share"))
    found = by_doc.groupBy("item_id").agg(
        F.count(F.when(F.col("run") >= run, 1)).alias("exact_docs"),
        F.count(F.when((F.col("run") < run) & (F.col("share") >= share), 1)).alias("edited_docs"),
        F.max("share").alias("best_share"),
    )
    base = items.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min("suite").alias("suite"))
    return base.join(found, "item_id", "left").select(
        "item_id", "suite", F.coalesce("exact_docs", F.lit(0)).alias("exact_docs"), F.coalesce("edited_docs", F.lit(0)).alias("edited_docs"), F.coalesce("best_share", F.lit(0.0)).alias("best_share")
    )
