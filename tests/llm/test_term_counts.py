import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from brute import SIGHTINGS, bases, pack, stored_key
from pyspark.sql import functions as F

from kmerloom.llm import sighting_counts, term_counts
from kmerloom.llm.term_counts import TermCountStore, mark_terms

TYPES = "record long, item long, term string"


def state(items):
    """term -> (occurrences, records)."""
    occ, rec = Counter(), defaultdict(set)
    for record, term in items.values():
        if term is not None:
            occ[term] += 1
            if record is not None:
                rec[term].add(record)
    return {t: (n, len(rec[t])) for t, n in occ.items()}


def stored(store):
    return {r.term: (r.occ, r.rec) for r in store.counts().collect()}


def test_loads_equal_recount(spark):
    rng = random.Random(4)
    store, items = TermCountStore(spark), {}
    for load in range(4):
        changes = []
        for _ in range(120):
            item = rng.randrange(150)
            term = rng.choice(["a", "a", "a", "b", "c", f"t{rng.randrange(30)}", None])
            # an item stays in its record, but for some that move
            record = None if item % 17 == 0 else item % 20 if rng.random() < 0.9 else rng.randrange(20)
            if all(c[1] != item for c in changes):
                changes.append((record, item, term))
        for record, item, term in changes:
            items[item] = (record, term)
        before = stored(store) if load else {}
        deltas = {r.term: (r.d_occ, r.d_rec) for r in store.apply(spark.createDataFrame(changes, TYPES)).collect()}
        after = state(items)
        assert stored(store) == after
        for t in set(before) | set(after):
            b, a = before.get(t, (0, 0)), after.get(t, (0, 0))
            assert deltas.get(t, (0, 0)) == (a[0] - b[0], a[1] - b[1])


def files(store):
    """Data files of the store and their times."""
    root = Path(store.path.removeprefix("file:").replace("//", "/"))
    return {str(p): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_persistence(spark):
    store = TermCountStore(spark)
    store.apply(spark.createDataFrame([(1, i, f"t{i}") for i in range(40)], TYPES))
    again = TermCountStore(spark, store.path)
    assert again.manifest == store.manifest
    again.apply(spark.createDataFrame([(2, 100, "t3")], TYPES))
    assert stored(again)["t3"] == (2, 2)
    assert again.apply(spark.createDataFrame([(2, 100, "t3")], TYPES)).count() == 0  # delivered again
    with pytest.raises(RuntimeError):
        store.apply(spark.createDataFrame([(3, 200, "t4")], TYPES))  # does not know of the other's loads
    assert stored(TermCountStore(spark, store.path)) == stored(again)
    again.apply(spark.createDataFrame([(None, i, None) for i in [*range(40), 100]], TYPES))
    assert stored(again) == {}
    with pytest.raises(ValueError):
        again.apply(spark.createDataFrame([("1", 1, "t")], "record string, item long, term string"))
    with pytest.raises(ValueError):
        again.apply(spark.range(1))


def test_small_load_rewrites_nothing(spark):
    """A load of one in a hundred adds files and leaves all others; its tasks are not bound to a number of buckets."""
    store = TermCountStore(spark)
    store.apply(spark.range(5000).selectExpr("id div 7 AS record", "id AS item", "concat('t', id % 1500) AS term"))
    before = files(store)
    store.apply(spark.range(0, 5000, 100).selectExpr("id div 7 AS record", "id AS item", "'changed' AS term"))
    after = files(store)
    assert all(after.get(p) == t for p, t in before.items()) and len(after) > len(before)
    assert stored(store)["changed"] == (50, 50) and len(store.manifest["counts"]) == 2


@pytest.mark.parametrize("rows", [4_000_000, 60])
def test_compaction_and_buckets(spark, monkeypatch, rows):
    """Merged pieces and ledgers in buckets of records give the same counts as a recount."""
    monkeypatch.setattr(term_counts, "LEDGER_ROWS", rows)
    monkeypatch.setattr(term_counts, "COMPACT_PIECES", 2)
    rng = random.Random(rows)
    store, items = TermCountStore(spark), {}
    for load in range(4):
        changes = {rng.randrange(400): rng.choice(["a", "b", f"t{rng.randrange(50)}", None]) for _ in range(300 if not load else 20)}
        rows_ = [(None if i % 17 == 0 else i % 30, i, t) for i, t in changes.items()]
        items.update({i: (r, t) for r, i, t in rows_})
        store.apply(spark.createDataFrame(rows_, TYPES))
        assert stored(store) == state(items)
    assert len(store.manifest["counts"]) <= 2 and (store.manifest["ledger"][0]["buckets"] > 1) == (rows == 60)
    left = len(files(store))
    assert store.vacuum() > 0 and len(files(store)) < left and stored(store) == state(items)


@pytest.mark.parametrize("step", ["ledger", "counts", "commit"])
def test_a_lost_load_can_be_made_again(spark, monkeypatch, step):
    store = TermCountStore(spark)
    store.apply(spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], TYPES))
    load = spark.createDataFrame([(1, 1, "z"), (2, 3, "x")], TYPES)
    write = TermCountStore._write

    def broken_write(self, part, rows):
        out = write(self, part, rows)
        if part == step:
            raise OSError("lost")
        return out

    def broken_commit(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(TermCountStore, "_write", broken_write)
        if step == "commit":
            m.setattr(TermCountStore, "_commit", broken_commit)
        with pytest.raises(OSError):
            store.apply(load)
    want = {"x": (1, 1), "y": (1, 1)}
    assert stored(store) == want == stored(TermCountStore(spark, store.path))
    store.apply(load)
    assert stored(store) == {"x": (1, 1), "y": (1, 1), "z": (1, 1)} == stored(TermCountStore(spark, store.path))
    assert store.vacuum() >= 0


def test_item_that_moved_away_is_gone(spark):
    """Its old record must not count it when that record changes later."""
    store, items = TermCountStore(spark), {}
    for load in ([(1, 1, "x"), (2, 5, "y")], [(2, 1, "x")], [(1, 2, "x")], [(1, 1, "x")], [(2, 3, "x"), (1, 1, None)], [(1, 2, None)]):
        items.update({i: (r, t) for r, i, t in load})
        store.apply(spark.createDataFrame(load, TYPES))
        assert stored(store) == state(items)


def test_first_load_edge_cases(spark):
    store = TermCountStore(spark)
    rows = [(1, None, "x"), (None, 1, "x"), (1, 2, "x"), (1, 2, "x"), (1, 3, None), (2, 4, ""), (2, 5, "y" * 50_000)]
    store.apply(spark.createDataFrame([(*r, 7) for r in rows], TYPES + ", occ int"))
    assert stored(store) == {"x": (2, 1), "": (1, 1), "y" * 50_000: (1, 1)}
    empty = TermCountStore(spark)
    assert empty.apply(spark.createDataFrame([], TYPES)).count() == 0
    assert stored(empty) == {}
    empty.apply(spark.createDataFrame([(1, 1, "z")], TYPES))
    assert stored(empty) == {"z": (1, 1)}


def test_marks(spark):
    c = spark.createDataFrame([("a", 9, 1), ("b", 2, 2), ("c", 9, 5)], "term string, occ long, rec long")
    assert {(r.term, r.mark) for r in mark_terms(c, 2, 5).collect()} == {("a", "rare"), ("a", "common"), ("c", "common")}
    assert mark_terms(c, None, None).count() == 0


def test_sightings(spark):
    rng = random.Random(6)
    pool = [stored_key(bases(rng, 21)) for _ in range(30)]
    rows = []
    for i in range(500):
        key = pool[0] if rng.random() < 0.33 else rng.choice(pool)
        late = rng.random() < 0.1
        rows.append((i, i // 7, 0, None, pack(key), "s", 1, "2026-03-02 00:00:00", "2026-03-09 00:00:00" if late else "2026-03-01 00:00:00" if i % 11 else None))
    rows.append((1000, 1, 0, key, None, None, None, None, "2026-03-09 00:00:00"))
    keys = {r[0]: (r[1], r[4]) for r in rows[:-1]} | {1000: (1, pack(stored_key(key)))}
    rows += [(*r[:8], "2026-03-10 00:00:00") for r in rows[::5]]
    df = spark.createDataFrame(rows, SIGHTINGS.replace("timestamp", "string")).withColumns({c: F.to_timestamp(c) for c in ("seen_at", "loaded_at")})
    want = {t: v for t, v in state(keys).items()}
    got = {pack(r.kmer): (r.sightings, r.reads) for r in sighting_counts.kmer_frequencies(df).collect()}
    assert got == want
    params = spark.createDataFrame([(21, 9, 40), (31, 1, 1)], "k int, min_count long, max_count long")
    marks = {(pack(r.kmer), r.mark) for r in sighting_counts.marked_kmers(df, params).collect()}
    assert marks == {(t, "rare") for t, (_, r) in want.items() if r < 9} | {(t, "common") for t, (o, _) in want.items() if o > 40}
    assert sighting_counts.marked_kmers(df, params.where("k = 5")).count() == 0
    assert sighting_counts.kmer_frequencies(df.limit(0)).count() == 0
