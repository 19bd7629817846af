import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.llm import leakage

VOCAB = [f"w{i}" for i in range(60)] + ["Alpha", "beta_2", "GAMMA"]
SEPARATORS = [" ", "\n", ", ", "-", " é ", "\u212a", "🧪", "\r\n  "]


def text(rng, words):
    return "".join(w + rng.choice(SEPARATORS) for w in words)


def brute(docs, items, run):
    split = lambda t: [w.lower() for w in re.findall("[A-Za-z0-9_]+", t or "")]
    grams = lambda t: {tuple(w[i : i + run]) for w in [split(t)] for i in range(len(w) - run + 1)}
    have = [(i, grams(t)) for i, t in items if i is not None]
    return {(i, d) for d, t in docs if d is not None for g in [grams(t)] for i, x in have if g & x}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    opening = rng.choices(VOCAB, k=10)
    items = [(i, text(rng, opening + rng.choices(VOCAB, k=rng.randrange(6, 60)))) for i in range(12)]
    items += [(20, "too short"), (21, None), (None, items[0][1]), items[1]]
    docs = []
    for d in range(120):
        words = rng.choices(VOCAB, k=rng.randrange(0, 120))
        if rng.random() < 0.5:
            w = [x.upper() if rng.random() < 0.3 else x for x in re.findall("[A-Za-z0-9_]+", rng.choice(items[:12])[1])]
            a = rng.randrange(len(w))
            words[len(words) // 2 : len(words) // 2] = w[a : a + rng.choice([5, 14, 15, 16, 80])]
        docs.append((d, text(rng, words)))
    docs += [(200, None), (201, ""), (202, "   "), (203, items[0][1] * 40), (204, "x " * 50_000 + items[2][1]), (None, items[3][1])]
    docs += [(300 + i, items[4][1]) for i in range(60)]  # one item in a third of all documents
    return docs, items


@pytest.mark.parametrize("n", [3, 6, 15])
def test_equals_brute_force(spark, corpus, n):
    docs, items = corpus
    df = spark.createDataFrame([(*r, "s") for r in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items, "item_id int, text string")
    got = leakage.leaked_passages(df, it, 15, n).where("run >= 15").select("item_id", "doc_id").distinct()
    assert {(r.item_id, r.doc_id) for r in got.collect()} == brute(docs, items, 15)


def test_small_chunks_and_item_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(leakage, "CHUNK_BYTES", 100)
    monkeypatch.setattr(leakage, "ITEM_BLOCK_CHARS", 1500)
    docs, items = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id int, text string")
    assert {(r.item_id, r.doc_id) for r in leakage.leaked_documents(df, it).collect()} == brute(docs, items, 15)


def test_long_texts_in_parts(spark, corpus, monkeypatch):
    """Parts of long texts share enough words: the passages found, and their places, are those of whole texts."""
    docs, items = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id int, text string")
    best = lambda: {(r.item_id, r.doc_id, r.run, r.share) for r in leakage.leaked_passages(df, it).groupBy("item_id", "doc_id").agg(F.max("run").alias("run"), F.max("share").alias("share")).collect()}
    want = best()
    monkeypatch.setattr(leakage, "LONG_BYTES", 300)
    assert best() == want
    parts = list(leakage._parts(b" ".join(b"w%d" % i for i in range(500)), 12))
    assert len(parts) > 5
    for text, before in parts:
        assert text.split()[0] == b"w%d" % before and text.split() == [b"w%d" % (before + j) for j in range(len(text.split()))]
    assert parts[-1][1] + len(parts[-1][0].split()) == 500 and list(leakage._parts(b"x" * 1000, 5)) == [(b"x" * 1000, 0)]


def test_edited_copy_is_reported(spark):
    rng = random.Random(5)
    words = [f"u{i}" for i in range(80)]
    edited = [x for i, w in enumerate(words) for x in ([] if i % 11 == 5 else ["new", w] if i % 13 == 7 else [w])]
    docs = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(words)), (3, text(rng, rng.choices(VOCAB, k=90)))], "doc_id long, text string")
    items = spark.createDataFrame([(7, "set", " ".join(words)), (8, "set", "nothing at all")], "item_id int, suite string, text string")
    rows = {r.item_id: r for r in leakage.leak_report(docs, items).collect()}
    assert (rows[7].exact_docs, rows[7].edited_docs, rows[7].best_share) == (1, 1, 1.0)
    assert (rows[8].exact_docs, rows[8].edited_docs, rows[8].best_share) == (0, 0, 0.0)


def test_edited_copy_is_reported_however_often_its_item_leaked(spark):
    """More exact copies than RARE_DOCS; the seeds that the edited copy holds are also those of a second item."""
    words = [f"u{i}" for i in range(80)]
    edited = " ".join(x for i, w in enumerate(words) for x in ([] if i % 11 == 5 else ["new", w] if i % 13 == 7 else [w]))
    copies = 3 * leakage.RARE_DOCS
    docs = spark.createDataFrame([(d, " ".join(words)) for d in range(copies)] + [(1000, edited)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "set", " ".join(words)), (8, "set", " ".join(words) + " tail")], "item_id int, suite string, text string")
    rows = {r.item_id: r for r in leakage.leak_report(docs, items).collect()}
    assert {i: (r.exact_docs, r.edited_docs) for i, r in rows.items()} == {7: (copies, 1), 8: (copies, 1)}


@pytest.mark.parametrize("copies", [0, 60])
def test_planted_edited_copies_are_found(spark, copies):
    """A word in about nine is replaced, dropped or new: at least nine of ten such copies are found, whether the item leaked or not."""
    rng = random.Random(copies)
    opening = [f"o{i}" for i in range(12)]
    items = {i: opening + [f"i{i}_{rng.randrange(40)}" for _ in range(rng.randrange(60, 120))] for i in range(10)}
    docs, planted = [], set()
    for i, words in items.items():
        docs += [" ".join(words)] * copies
        for _ in range(12):
            copy = [x for w in words for x in ([w] if rng.random() > 0.11 else rng.choice([[], [f"n{rng.random()}"], [w, "added"]]))]
            around = rng.choices(VOCAB, k=rng.randrange(100))
            planted.add((i, len(docs)))
            docs.append(" ".join([*around, *copy, *around]))
    docs += [" ".join(opening + rng.choices(VOCAB, k=30)) for _ in range(400)]  # the shared opening alone is no leak
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id int, text string")
    rows = leakage.leaked_passages(df, it, edited=True).groupBy("item_id", "doc_id").agg({"share": "max"}).collect()
    found = {(r.item_id, r.doc_id) for r in rows if r["max(share)"] >= 0.5}
    assert len(found & planted) >= 0.9 * len(planted) and len(found) <= len(planted) + 10 * copies
    if copies:  # sentences shared by many documents make no passages
        assert len(rows) <= 1.1 * (10 * copies + len(planted))


def test_no_nested_loops_in_written_steps(spark, corpus, monkeypatch):
    from kmerloom.llm import leakage as mod

    plans, write = [], mod.materialize

    def spy(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(mod, "materialize", spy)
    docs, items = corpus
    mod.leaked_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()
    assert plans and not any("NestedLoop" in p or "Cartesian" in p for p in plans)


def plain_smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_plain_version():
    rng = np.random.default_rng(2)
    for _ in range(20):
        item = rng.integers(0, 6, rng.integers(1, 25)).astype(np.int32)
        grid = rng.integers(-1, 6, (4, 30)).astype(np.int32)
        grid[0, :3] = item[:3] if len(item) >= 3 else grid[0, :3]
        score, run = leakage.align(item, grid)
        for line, s, r in zip(grid, score, run, strict=True):
            assert s == plain_smith_waterman(item.tolist(), [x if x >= 0 else -9 for x in line.tolist()])
            longest = max(k for k in range(len(item) + 1) if any((item[i : i + k] == line[j : j + k]).all() for i in range(len(item) - k + 1) for j in range(len(line) - k + 1)))
            assert r == longest


def test_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id int, suite string, text string")
    one = spark.createDataFrame([(1, "s", "a " * 20)], "item_id int, suite string, text string")
    assert leakage.leaked_documents(docs, one).count() == 0
    assert leakage.leaked_documents(spark.createDataFrame([(1, "a " * 20)], "doc_id long, text string"), items).count() == 0
    assert leakage.leak_report(docs, one).count() == 1
    with pytest.raises(ValueError):
        leakage.leaked_passages(docs, one, 3, 4)
