"""Oracle SQL (DuckDB) of the core queries."""

from kmerloom.plans.counter_oracle import ORACLE as COUNTER
from kmerloom.plans.sighting_sql import USABLE

_OWNED = f"""WITH {USABLE},
plan AS (SELECT root, min(prefix_owners) AS owner FROM prefix_plan WHERE root IS NOT NULL GROUP BY root),
owned AS (
  SELECT u.*, left(kmer, 4) AS prefix, p.owner FROM usable u LEFT JOIN plan p
  ON p.root = 64 * (strpos('ACGT', kmer[1]) - 1) + 16 * (strpos('ACGT', kmer[2]) - 1) + 4 * (strpos('ACGT', kmer[3]) - 1) + strpos('ACGT', kmer[4]) - 1)"""

_LOAD = "count(*) AS sightings, count(DISTINCT read_id) AS reads, count(DISTINCT kmer) AS distinct_keys FROM owned"

ORACLE = {
    "p1_found": f"""WITH {USABLE}
SELECT left(kmer, 4) AS prefix FROM usable GROUP BY 1 HAVING count(*) >= 0.04 * (SELECT count(*) FROM usable)""",
    "p1_prefix_load": f"{_OWNED} SELECT prefix, owner, {_LOAD} GROUP BY prefix, owner",
    "p1_owner_load": f"{_OWNED} SELECT owner, {_LOAD} GROUP BY owner",
    **COUNTER,
}
