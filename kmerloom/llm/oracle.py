"""Oracle SQL (DuckDB) of the problems tagged llm, where SQL can express them."""

from kmerloom.plans.sighting_sql import CLEAN, USABLE

_TOP = f"""WITH {USABLE},
heap AS (SELECT item_id, min(upper(item_key)) AS kmer FROM heap_items
         WHERE item_key IS NOT NULL AND item_id IS NOT NULL GROUP BY item_id),
counts AS (
  SELECT 'kmer_sightings' AS src, kmer, count(*) AS n FROM usable GROUP BY kmer
  UNION ALL SELECT 'heap_items', kmer, count(*) FROM heap GROUP BY kmer),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY n DESC, kmer) AS INTEGER) AS rank FROM counts)
SELECT @COLS FROM ranked WHERE rank <= CASE src WHEN 'heap_items' THEN 10 ELSE 20 END"""

_ARRIVALS = f"""WITH cleaned AS (
  SELECT arrival_id, lower(trim(form)) AS form, {CLEAN.format('canonical_kmer')} AS w FROM kmer_arrivals WHERE arrival_id IS NOT NULL),
keyed AS (
  SELECT DISTINCT arrival_id, CASE WHEN form = 'window' THEN least(reverse(w), translate(w, 'ACGT', 'TGCA')) ELSE w END AS kmer
  FROM cleaned WHERE regexp_full_match(w, '[ACGT]{{21}}')),
firsts AS (SELECT kmer, min(arrival_id) AS first_id FROM keyed GROUP BY kmer),
low AS (SELECT DISTINCT {CLEAN.format('kmer')} AS kmer FROM low_keys),
seen AS (SELECT DISTINCT arrival_id FROM keyed JOIN firsts USING (kmer)
WHERE first_id < arrival_id OR kmer IN (SELECT kmer FROM low WHERE kmer IS NOT NULL))"""

_COUNTS = f"""WITH {USABLE},
counts AS (SELECT kmer, count(*) AS sightings, count(DISTINCT read_id) AS reads FROM usable GROUP BY kmer)"""

_DIMENSIONS = ("seen_day", "sample_id", "lane", "prefix")
_CUBE_NAME = "coalesce(nullif(concat_ws('+', " + ", ".join(f"CASE WHEN grouping({d}) = 0 THEN '{d}' END" for d in _DIMENSIONS) + "), ''), 'all')"

_SIZES = """WITH sizes AS (
  SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\r\\n]')) AS size FROM documents WHERE text IS NOT NULL),
specs AS (SELECT DISTINCT spec_id, capacity FROM pack_specs)"""

_RUNS = """WITH doc_words AS (
  SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: lower(w)) AS ws FROM documents),
doc_runs AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 14], ' ') AS run
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 13)) AS i FROM doc_words WHERE len(ws) >= 15)),
item_words AS (
  SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: lower(w)) AS ws FROM eval_items),
item_runs AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:i + 14], ' ') AS run
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 13)) AS i FROM item_words WHERE len(ws) >= 15)),
leaks AS (SELECT DISTINCT item_id, doc_id FROM item_runs JOIN doc_runs USING (run))"""

ORACLE = {
    "p2_found": _TOP.replace("@COLS", "src, kmer"),
    "p2_topk": _TOP.replace("@COLS", "src, kmer, n, rank"),
    "p2_iceberg_counts": f"WITH {USABLE} SELECT kmer, count(*) AS n FROM usable GROUP BY kmer HAVING count(*) >= 100",
    "p3_found": f"""WITH {USABLE}
SELECT CASE WHEN grouping(seen_day) = 1 THEN '*' ELSE CAST(seen_day AS VARCHAR) END AS seen_day, sample_id
FROM usable WHERE seen_day IS NOT NULL AND sample_id IS NOT NULL
GROUP BY GROUPING SETS ((seen_day, sample_id), (sample_id))
HAVING count(*) >= 50 AND count(DISTINCT kmer) >= 0.75 * count(*)""",
    "p4_kmer_frequencies": f"{_COUNTS} SELECT kmer, sightings, reads FROM counts",
    "p4_found": f"""{_COUNTS},
bounds AS (SELECT max(min_count) AS lo, min(max_count) AS hi FROM run_params WHERE k = 21)
SELECT kmer, 'rare' AS mark FROM counts, bounds WHERE reads < lo
UNION ALL SELECT kmer, 'common' FROM counts, bounds WHERE sightings > hi""",
    "p5_found": f"{_ARRIVALS} SELECT arrival_id FROM seen",
    "p5_filter_audit": f"""{_ARRIVALS},
olds AS (SELECT left(kmer, 4) AS prefix, count(*) AS old_keys FROM low WHERE regexp_full_match(kmer, '[ACGT]{{21}}') GROUP BY 1),
ids AS (SELECT DISTINCT arrival_id, left(kmer, 4) AS prefix FROM keyed),
news AS (SELECT prefix, count(*) AS arrivals, count(s.arrival_id) AS seen FROM ids LEFT JOIN seen s USING (arrival_id) GROUP BY prefix)
SELECT prefix, coalesce(old_keys, 0) AS old_keys, coalesce(arrivals, 0) AS arrivals, coalesce(seen, 0) AS seen, true AS within_grant, true AS as_expected
FROM olds FULL OUTER JOIN news USING (prefix)""",
    "p3_cube_bounds": f"""WITH {USABLE},
known AS (SELECT coalesce(CAST(seen_day AS VARCHAR), '?') AS seen_day, coalesce(sample_id, '?') AS sample_id,
                 coalesce(CAST(lane AS VARCHAR), '?') AS lane, left(kmer, 4) AS prefix FROM usable),
cube AS (SELECT {_CUBE_NAME} AS "grouping", count(*) AS n FROM known GROUP BY CUBE (seen_day, sample_id, lane, prefix) HAVING count(*) > 0)
SELECT "grouping", count(*) AS groups, CAST(sum(n) AS BIGINT) AS sightings, true AS within FROM cube GROUP BY 1""",
    "p6_found": f"{_SIZES} SELECT spec_id, doc_id FROM sizes JOIN specs ON size > capacity",
    "p6_pack_check": f"""{_SIZES}
SELECT spec_id, count(*) AS documents, CAST(sum(size) AS BIGINT) AS tokens, count(*) FILTER (size > capacity) AS split,
       true AS in_capacity, true AS in_order, true AS well_filled FROM sizes, specs GROUP BY spec_id""",
    "p7_found": f"{_RUNS} SELECT item_id, doc_id FROM leaks",
    "p7_exact_leaks": f"""{_RUNS},
items AS (SELECT item_id, min(suite) AS suite FROM eval_items WHERE item_id IS NOT NULL GROUP BY item_id),
found AS (SELECT item_id, count(*) AS exact_docs FROM leaks GROUP BY item_id)
SELECT item_id, suite, coalesce(exact_docs, 0) AS exact_docs FROM items LEFT JOIN found USING (item_id)""",
}
