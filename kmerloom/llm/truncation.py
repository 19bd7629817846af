"""Texts that were cut off: tries of words and of token sequences, combined with length evidence (problem 8).

Trie evidence. A vocabulary of the corpus is counted over all texts; its trie is a table of nodes (prefix, count of the
most frequent word below). A text whose final word is unknown, or far rarer than a word it is a proper
prefix of, was cut in a word. The same is asked one level up, where a word or number is one letter of the
alphabet, and every mark and line start another: the last ``CONTEXT`` tokens of a text are looked up among
all the corpus's token sequences. Where a sequence is common but texts hardly ever end with it, it is known only as the
beginning of longer ones, and the text was cut in a line or between lines. Both are learnt from the
corpus; no rule of any language is built in.

Length evidence. A length that many texts of one source share exactly (a field limit, in characters or bytes, before an
ellipsis mark), or a source whose texts end at multiples of a transfer block.

Texts without a final newline are cut if either evidence says so. Texts with one are cut if their final sequence is
known only as a beginning, or if they have exactly the length of a limit and their end is no usual one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.session import materialize, require_columns

#: Marks that a channel puts where it cut a text.
ELLIPSES = ("...", "…", "[more]", "[truncated]", "[...]")
BLOCK = 512
LEAST_AT_LIMIT = 3
LIMIT_SHARE = 0.5
NEIGHBOURS = 32
RARITY = 0.01
LEAST_KNOWN = 5
NODE_LETTERS = 64
CONTEXT = 6
LEAST_CONTEXT = 200
SELDOM = 0.5
CHUNK_BYTES = 1 << 20
LONG_BYTES = 8 << 20
LOOK_BYTES = 1 << 16

_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\WA-Z\d_]+")
_NO_LETTER = re.compile(r"[\W\d_]")
_LINE, _INDENTED = 1, 2  # tokens of a new line without and with blanks at its start


def subwords(token: str) -> list[str]:
    """Lower-case parts of a token of letters: camel case is split."""
    if token.islower() or token.istitle():
        return [token.lower()]
    return [x.lower() for x in _CAMEL.findall(token)]


def strip_ellipsis(text: str) -> tuple[str, bool]:
    for mark in ELLIPSES:
        if text.endswith(mark):
            cut = text[: -len(mark)]
            return (cut[:-1] if mark[0] == "[" and cut.endswith(" ") else cut), True
    return text, False


def final_token(text: str) -> str:
    """The letters, digits and underscores that end the text, read from its end."""
    at = len(text)
    while at and (text[at - 1] == "_" or text[at - 1].isalnum()):
        at -= 1
    return text[at:]


def final_word(text: str) -> str | None:
    """Last part of the word that ends the text; None if no word does, or a number.

    A single capital that ends a word in camel case is told from the letter by a leading dot.
    """
    token = final_token(text)
    if not token or token[0].isdigit():
        return None
    parts = subwords(_NO_LETTER.split(token)[-1])
    if not parts:
        return None
    return "." + parts[-1] if len(parts) > 1 and len(parts[-1]) == 1 else parts[-1]


def _byte_kinds() -> np.ndarray:
    """Kind of each byte: 0 blanks, letter for letters, _ and bytes beyond ASCII, digit for digits, newline, else the byte itself."""
    kind = np.arange(256, dtype=np.int64)
    for b in range(256):
        if b >= 128 or chr(b).isalpha() or b == ord("_"):
            kind[b] = ord("a")
        elif chr(b).isdigit():
            kind[b] = ord("9")
        elif b <= 32:
            kind[b] = ord("\n") if b == ord("\n") else 0
    return kind


_KINDS = _byte_kinds()


def token_contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last ``CONTEXT`` tokens up to each token of the texts as one number, the text of each, and its place there.

    A word (letters, digits, _) is a token by its first letter's kind, a number another, every mark its own;
    a new line is one by whether blanks follow; empty lines and what is blank at a text's end are none.
    """
    buf = np.frombuffer(b"".join(b"\n" + t for t in texts) + b"\n\n", np.uint8)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    kind = _KINDS[buf]
    word = (kind == ord("a")) | (kind == ord("9"))
    starts = kind > 0
    starts[1:] &= ~(word[1:] & word[:-1])
    at = np.flatnonzero(starts[:-1])
    token = kind[at]
    new = token == ord("\n")
    after = buf[at + 1]
    token[new] = np.where((after[new] == 32) | (after[new] == 9), _INDENTED, _LINE)
    last = np.append(new[1:], True)
    at, token = at[~(new & last)], token[~(new & last)]
    doc = np.searchsorted(begin, at, "right") - 1
    first = np.searchsorted(doc, doc)
    context, place = np.zeros(len(token), np.int64), np.arange(len(token))
    for j in range(CONTEXT):
        before = np.where(place - j >= first, token[np.maximum(place - j, 0)], 0)
        context |= before << (8 * j)
    return context, doc, at - begin[doc] - 1


def long_contexts(text: bytes) -> Iterator[np.ndarray]:
    """token_contexts of one text in parts, so that memory does not grow with it.

    A part ends after a mark and begins ``LOOK_BYTES`` earlier, where the tokens before it are found (should ``CONTEXT`` tokens take more
    room than that, those furthest back are seen in part).
    """
    raw, start = np.frombuffer(text, np.uint8), 0
    while start < len(text):
        end = start + LONG_BYTES
        if end < len(text):
            kind = _KINDS[raw[max(start, end - LOOK_BYTES) : end]]
            marks = np.flatnonzero((kind > 0) & (kind != ord("a")) & (kind != ord("9")) & (kind != ord("\n")))
            end = max(start, end - LOOK_BYTES) + int(marks[-1]) + 1 if len(marks) else end
        head = max(0, start - LOOK_BYTES)
        context, _, at = token_contexts([text[head:end]])
        yield context[at >= (start - head if start else -1)]
        start = end


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """First number and bytes of the texts, in chunks of about ``CHUNK_BYTES``; a longer text is a chunk of its own."""
    part, size, a = [], 0, 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if part and len(raw) >= CHUNK_BYTES:
            yield a, part
            part, size, a = [], 0, i
        part.append(raw)
        size += len(raw)
        if size >= CHUNK_BYTES:
            yield a, part
            part, size, a = [], 0, i + 1
    if part:
        yield a, part


def term_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """word, context, n from one scan: in about how many texts each word occurs before the final word (context null), and how
    often each sequence of ``CONTEXT`` tokens occurs in the texts (word null). Null texts have none.

    Of sequences a task leaves few rows however much it read, as their alphabet is small.
    """
    kinds = pa.schema({"word": pa.string(), "context": pa.int64(), "n": pa.int64()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        contexts: Counter[int] = Counter()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for text in texts:
                if text:
                    text = strip_ellipsis(text)[0]
                    words.update(set(_WORD.findall(text[: len(text) - len(final_token(text))])))
            for _, part in _chunks(texts):
                for found in long_contexts(part[0]) if len(part) == 1 else [token_contexts(part)[0]]:
                    context, n = np.unique(found, return_counts=True)
                    contexts.update(dict(zip(context.tolist(), n.tolist(), strict=True)))
            if len(words) + len(contexts) > 200_000:
                yield rows(words, contexts)
                words, contexts = Counter(), Counter()
        yield rows(words, contexts)

    def rows(words: Counter[str], contexts: Counter[int]) -> pa.RecordBatch:
        parts: Counter[str] = Counter()
        for token, n in words.items():
            found = subwords(token)
            for w in found:
                parts["." + w if len(w) == 1 and len(found) > 1 else w] += n
        none = [None] * max(len(parts), len(contexts))
        return pa.RecordBatch.from_pydict(
            {"word": [*parts, *none[: len(contexts)]], "context": [*none[: len(parts)], *contexts], "n": [*parts.values(), *contexts.values()]}, schema=kinds
        )

    counts = docs.select(column).mapInArrow(count, "word string, context bigint, n bigint")
    return counts.groupBy("word", "context").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """word, n of term_counts."""
    return counts.where(F.col("word").isNotNull()).select("word", "n")


def sequences(counts: DataFrame) -> DataFrame:
    """context, occ of term_counts."""
    return counts.where(F.col("context").isNotNull()).select("context", F.col("n").alias("occ"))


def words_below(words: DataFrame, finals: DataFrame) -> DataFrame:
    """final, below: the largest count of a known word that final (with its column prefix) is a proper prefix of.

    Prefixes of up to ``NODE_LETTERS`` letters are nodes of the words' trie; longer ones are compared with the words that
    share their first letters, so that no word is too long.
    """
    known = words.where((F.length("word") > 1) & (F.col("n") >= LEAST_KNOWN))
    inner = F.least(F.length("word") - 1, F.lit(NODE_LETTERS))
    cut = F.transform(F.sequence(F.lit(1), inner), lambda i: F.col("word").substr(F.lit(1), i))
    nodes = known.select(F.explode(cut).alias("prefix"), "n").groupBy("prefix").agg(F.max("n").alias("below"))
    long = known.where(F.length("word") > NODE_LETTERS + 1).select(F.substring("word", 1, NODE_LETTERS).alias("head"), "word", "n")
    rest = finals.where(F.length("prefix") > NODE_LETTERS).withColumn("head", F.substring("prefix", 1, NODE_LETTERS)).join(long, "head")
    rest = rest.where(F.startswith("word", "prefix") & (F.length("word") > F.length("prefix"))).groupBy("final").agg(F.max("n").alias("below"))
    return finals.join(nodes, "prefix").select("final", "below").unionByName(rest)


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest, chars and bytes (without an ellipsis mark), marked, ended, final, context and own of every text.

    context is the token sequence that ends the text (null without a token), own its occurrences in the text.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("chars", "bytes", "marked", "ended", "final")}
            texts = batch.column("text").to_pylist()
            for text in texts:
                body, marked = strip_ellipsis(text)
                out["chars"].append(len(body))
                out["bytes"].append(len(body.encode("utf-8", "surrogatepass")))
                out["marked"].append(marked)
                out["ended"].append(not text or text[-1] in "\r\n")
                out["final"].append(final_word(body))
            final, own = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for a, part in _chunks(texts):
                if len(part) == 1:
                    total: Counter[int] = Counter()
                    for found in long_contexts(part[0]):
                        context, n = np.unique(found, return_counts=True)
                        total.update(dict(zip(context.tolist(), n.tolist(), strict=True)))
                        final[a] = found[-1] if len(found) else final[a]
                    own[a] = total[int(final[a])]
                    continue
                context, doc, _ = token_contexts(part)
                end = np.searchsorted(doc, np.arange(len(part)), "right") - 1
                some = np.flatnonzero(np.isin(np.arange(len(part)), doc))
                final[a + some] = context[end[some]]
                own[a : a + len(part)] = np.bincount(doc[context == final[a + doc]], minlength=len(part))
            cols = [batch.column(c) for c in ("doc_id", "source", "digest")]
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
            cols += [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]
            cols += [pa.array(final, mask=final == 0), pa.array(own)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "source", "digest", *out, "context", "own"])

    rows = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), source_label().alias("source"), F.xxhash64("text").alias("digest"), "text"
    )
    schema = "doc_id bigint, source string, digest bigint, chars bigint, bytes bigint, marked boolean, ended boolean, final string, context bigint, own bigint"
    return rows.mapInArrow(features, schema)


def source_label():
    """Source without case and blanks; null is a source of its own, the empty text."""
    return F.coalesce(F.lower(F.btrim("source", F.lit(" \t\r\n"))), F.lit(""))


def length_limits(features: DataFrame) -> DataFrame:
    """source, unit, length: lengths at which texts of a source pile up.

    At least ``LEAST_AT_LIMIT`` different texts have exactly this length, and these are at least
    ``LIMIT_SHARE`` of the texts within ``NEIGHBOURS`` of it.
    """
    units = F.array(
        F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))
    )
    texts = features.groupBy("source", "digest", "chars", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    at = texts.select("source", F.explode(units).alias("u")).groupBy("source", "u.unit", "u.length").agg(F.count(F.lit(1)).alias("n"))
    at = at.withColumn("cell", F.floor(F.col("length") / NEIGHBOURS))
    peaks = at.where(F.col("n") >= LEAST_AT_LIMIT)
    near = at.select("source", "unit", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"), F.col("length").alias("other"), F.col("n").alias("m"))
    return (
        peaks.join(near, ["source", "unit", "cell"])
        .where(F.abs(F.col("length") - F.col("other")) <= NEIGHBOURS)
        .groupBy("source", "unit", "length")
        .agg(F.max("n").alias("n"), F.sum("m").alias("m"))
        .where(F.col("n") >= LIMIT_SHARE * F.col("m"))
        .select("source", "unit", "length")
    )


def full_blocks() -> Column:
    """Whether a text ends at a multiple of the transfer block, in characters or bytes."""
    return (F.col("chars") > 0) & ((F.col("chars") % BLOCK == 0) | (F.col("bytes") % BLOCK == 0))


def block_sources(rows: DataFrame) -> DataFrame:
    """Sources whose texts without final newline end at multiples of a transfer block far more often than by chance."""
    counts = rows.where(~F.col("ended")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("full"), 1)).alias("k"))
    return counts.where((F.col("k") >= LEAST_AT_LIMIT) & (F.col("k") > F.col("n") * (8.0 / BLOCK))).select("source")


def final_sequences(features: DataFrame, counts: DataFrame) -> DataFrame:
    """digest, beginning, usual of every text whose final token sequence stands in other texts.

    Other texts are all but the copies of this one. ``beginning``: they hold the sequence ``LEAST_CONTEXT`` times and end with it at
    most ``SELDOM`` times as often as with a sequence on average, so that it is known only as the beginning of longer
    ones. ``usual``: some end with it, and more often than with one on average.
    """
    texts = features.where(F.col("context").isNotNull()).groupBy("digest", "context", "own").agg(F.count(F.lit(1)).alias("copies"))
    texts = materialize(texts, "texts")
    ends = texts.groupBy("context").agg(F.sum("copies").alias("ends"))  # a row a sequence
    known = counts.join(ends, "context", "left").withColumn("ends", F.coalesce("ends", F.lit(0)))
    total = known.agg(F.sum("ends"), F.sum("occ")).first()
    rate = (total[0] or 0) / max(1, total[1] or 0)
    occ, ends = F.col("occ") - F.col("own") * F.col("copies"), F.col("ends") - F.col("copies")
    rows = texts.join(known, "context").withColumns({"occ": occ, "ends": ends}).where("occ > 0 OR ends > 0")
    few = F.col("ends") <= F.col("occ") * (SELDOM * rate)
    return rows.select("digest", ((F.col("occ") >= LEAST_CONTEXT) & few).alias("beginning"), ((F.col("ends") > 0) & (F.col("ends") > F.col("occ") * rate)).alias("usual"))


def judged_texts(docs: DataFrame) -> DataFrame:
    """doc_id, source, word, line, partial (either), limit, block, ended, truncated of every text that is not null.

    Texts without doc_id are judged too; an empty text is complete; repeated rows are judged alike.
    """
    require_columns(docs, ("doc_id", "text", "source"))
    features = materialize(text_features(docs), "features")
    terms = materialize(term_counts(docs), "terms")
    words = vocabulary(terms)
    lines = materialize(final_sequences(features, sequences(terms)), "lines")
    finals = features.where(F.col("final").isNotNull() & ~F.col("ended")).select("final", F.regexp_replace("final", "^[.]", "").alias("prefix")).distinct()
    partial = (
        words_below(words, finals)
        .join(words.select(F.col("word").alias("final"), "n"), "final", "left")
        .where(F.coalesce("n", F.lit(0)) < F.col("below") * RARITY)
        .select("final", F.lit(True).alias("partial"))
    )
    limits = materialize(length_limits(features), "limits")
    chars = limits.where(F.col("unit") == "chars").select("source", F.col("length").alias("chars"), F.lit(True).alias("at_chars"))
    # a cut in the middle of a character leaves up to 3 bytes less
    short = F.explode(F.sequence(F.lit(0), F.lit(3)))
    size = limits.where(F.col("unit") == "bytes").select("source", "length", short.alias("less"))
    size = size.groupBy("source", (F.col("length") - F.col("less")).alias("bytes")).agg(F.min("less").alias("less"))
    # texts that end in no word get keys of their own: one null key for all would fill one task
    own = F.concat(F.lit("#"), F.col("digest").cast("string"))
    features = features.withColumn("final", F.when(F.col("ended"), own).otherwise(F.coalesce("final", own)))
    rows = features.join(partial, "final", "left").join(chars, ["source", "chars"], "left").join(size, ["source", "bytes"], "left")
    rows = rows.join(lines, "digest", "left")
    no = F.lit(False)
    at_chars, plain = F.coalesce("at_chars", no), ~F.col("marked")
    rows = rows.select(
        "doc_id", "source", "ended", full_blocks().alias("full"),
        (F.coalesce("partial", no) & ~F.col("ended") & plain).alias("word"),
        (F.coalesce("beginning", no) & plain).alias("line"), F.coalesce("usual", no).alias("usual"),
        (at_chars | (F.col("less").isNotNull() & plain)).alias("limit"),
        (at_chars | (F.coalesce(F.col("less") == 0, no) & plain)).alias("exact"),
    )
    rows = materialize(rows.withColumn("partial", F.col("word") | F.col("line")), "rows")
    blocks = block_sources(rows.where(~F.col("limit"))).withColumn("blocked", F.lit(True))
    rows = rows.join(blocks, "source", "left").withColumn("block", F.coalesce("blocked", no) & F.col("full")).drop("blocked", "full")
    whole = F.col("partial") | (F.col("exact") & ~F.col("usual"))
    return rows.withColumn("truncated", F.when(F.col("ended"), whole).otherwise(F.col("limit") | F.col("block") | F.col("partial")))


def truncated_documents(docs: DataFrame) -> DataFrame:
    """doc_id of the documents whose text is cut off."""
    return judged_texts(docs).where("truncated").select("doc_id").distinct()


def truncation_report(docs: DataFrame) -> DataFrame:
    """source, documents, truncated, share, and the truncated by evidence (a text may have several) for each source."""
    of = lambda c: F.count(F.when(F.col("truncated") & F.col(c), 1)).alias(f"by_{c}")
    return judged_texts(docs).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("truncated"), 1)).alias("truncated"), F.avg(F.col("truncated").cast("double")).alias("share"),
        of("word"), of("line"), of("limit"), of("block"),
    )
