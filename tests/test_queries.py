import os

import pytest
from oracle_check import SMALL, no_product, same_as_oracle

from kmerloom.plans import counter_queries
from kmerloom.plans.oracle import ORACLE
from kmerloom.plans.queries import QUERIES
from kmerloom.sources import tables

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_oracle(spark, name):
    same_as_oracle(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", ["p1_found", "p1_prefix_load", "kmer_counts_reads_k21", "low_root_full_outer_merge", "count_lookup", "spectrum_legacy"])
def test_plans(spark, name):
    no_product(QUERIES[name](spark, SMALL))


def test_scan_reads_only_what_it_needs(spark):
    plan = QUERIES["kmer_counts_reads_k21"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<read_id:bigint,seq:string>" in plan and "IsNotNull(read_id)" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["freq", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("lost", ["kmer", "root = 200", "root between 64 and 255"])
def test_round_trip_shows_what_is_lost(spark, monkeypatch, lost):
    """A loss in the low piece, or in roots that do not begin with A, is seen."""
    want = {(r.kmer, r.cnt) for r in counter_queries.counts(spark, SMALL).collect()}
    query = QUERIES["parquet_merge_round_trip"]
    assert {(r.kmer, r.cnt) for r in query(spark, SMALL).collect()} == want
    read = tables.read_counts

    def damaged(spark, path):
        low, root = read(spark, path)
        return (low.where("kmer >= 'C'"), root) if lost == "kmer" else (low, root.where(f"not ({lost})"))

    monkeypatch.setattr(tables, "read_counts", damaged)
    assert {(r.kmer, r.cnt) for r in query(spark, SMALL).collect()} != want
