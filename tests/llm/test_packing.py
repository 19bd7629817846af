import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.llm import packing

SPECS = "spec_id int, capacity int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 90))
def test_bins_hold(sizes, capacity):
    out = packing.best_two_fit(np.array(sizes, np.int64), capacity)
    used = np.bincount(out, weights=sizes) if sizes else np.zeros(0)
    assert len(out) == len(sizes) and (used <= capacity).all()
    assert sorted(set(out.tolist())) == list(range(len(used)))


def test_smallest_gives_way_to_two():
    """6 + 3 leaves 1; 3 gives way to 2 + 2, which fills the container."""
    out = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert len({out[0], out[2], out[3]}) == 1 and out[1] != out[0]


def test_fill_beats_first_fit_decreasing():
    rng = np.random.default_rng(0)
    sizes = rng.integers(5, 60, 3000)
    bins = packing.best_two_fit(sizes, 100).max() + 1
    loads: list[int] = []
    for s in sorted(sizes, reverse=True):
        for i, x in enumerate(loads):
            if x + s <= 100:
                loads[i] += s
                break
        else:
            loads.append(s)
    assert sizes.sum() / (bins * 100) > 0.995 and bins <= len(loads)


def check(spark, rows, specs):
    df = spark.createDataFrame(rows, "doc_id long, size long, spec_id string, block int")
    got = packing.pack(df, spark.createDataFrame(specs, SPECS)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.spec_id].append(r)
    for spec, cap in {s for s in specs if s[0] is not None and s[1] and s[1] > 0}:
        used, parts = defaultdict(int), defaultdict(list)
        for r in by[spec]:
            used[r.container] += r.size
            parts[r.doc_id].append((r.start, r.size, r.piece, r.pieces))
        assert max(used.values(), default=0) <= cap
        for doc, size, *_ in rows:
            if size is None or sum(d == doc for d, *_ in rows) > 1:
                continue
            p = sorted(parts[doc])
            assert sum(x[1] for x in p) == size and [x[2] for x in p] == list(range(len(p)))
            assert len(p) == max(1, -(-size // cap)) and all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:], strict=False))
    return got


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, int(rng.expovariate(1 / 60)), "x", 1) for i in range(800)] + [(900, 100_000, "x", 1), (901, None, "x", 1), (902, 0, "x", 1), (7, 7, "x", 1)]
    got = check(spark, rows, [(1, 100), (2, 512), (2, 512), (3, 0), (None, 9), (4, None)])
    assert {r.spec_id for r in got} == {1, 2}
    split = {(r.spec_id, r.doc_id) for r in packing.split_documents(spark.createDataFrame(got)).collect()}
    assert split == {(s, d) for s, c in ((1, 100), (2, 512)) for d, n, *_ in rows if n and n > c}
    fill = {r.spec_id: r.fill for r in packing.fill_report(spark.createDataFrame(got), spark.createDataFrame([(1, 100), (2, 512)], SPECS)).collect()}
    assert all(0.97 < f <= 1 for f in fill.values())


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_BINS", 5)
    got = check(spark, [(i, 1 + i % 40, "x", 0) for i in range(500)], [(1, 64)])
    assert len({r.container >> 32 for r in got}) > 10


def test_nothing(spark):
    items, specs = spark.createDataFrame([], "doc_id long, size long"), spark.createDataFrame([(1, 10)], SPECS)
    assert packing.pack(items, specs).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 5)], "doc_id long, size long"), specs.limit(0)).count() == 0
    assert packing.pack(spark.createDataFrame([(None, 25), (1, 5)], "doc_id long, size long"), specs).count() == 4


def test_token_counts(spark):
    texts = ["a b_1+é\t\r\n🧪x", "", None, "word " * 20_000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select("i", packing.code_token_count(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [None if t is None else len(re.findall(packing.CODE_TOKEN, t)) for t in texts]
    tokenizers = pytest.importorskip("tokenizers")
    coder = tokenizers.Tokenizer.from_file(f"{packing.TOKENIZER_DIR}/byte_bpe_50k.json")
    coder.encode_special_tokens = True
    got = [r.n for r in df.select("i", packing.bpe_token_count(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [None if t is None else len(coder.encode(t, add_special_tokens=False).ids) for t in texts]
