"""Oracle SQL (DuckDB) shared by the queries over sightings."""

CLEAN = "translate(trim({0}, chr(32) || chr(9) || chr(10) || chr(13)), 'acgtuU', 'ACGTTT')"

USABLE = f"""
texts AS (
  SELECT sighting_id, read_id, lane, CAST(seen_at AS DATE) AS seen_day,
         upper(trim(sample_id, chr(32) || chr(9) || chr(10) || chr(13))) AS sample_id, kmer_data,
         {CLEAN.format('window_text')} AS w
  FROM kmer_sightings WHERE sighting_id IS NOT NULL),
keyed AS (
  SELECT *, CASE
    WHEN kmer_data IS NOT NULL THEN array_to_string(list_transform(range(0, 21),
      lambda i: ['A', 'C', 'G', 'T'][((kmer_data >> (62 - 2 * i)) & 3) + 1]), '')
    WHEN regexp_full_match(w, '[ACGT]{{21}}') THEN least(reverse(w), translate(w, 'ACGT', 'TGCA')) END AS kmer
  FROM texts),
usable AS (
  SELECT sighting_id, min(read_id) AS read_id, min(kmer) AS kmer, min(seen_day) AS seen_day,
         min(sample_id) AS sample_id, min(lane) AS lane
  FROM keyed WHERE kmer IS NOT NULL GROUP BY sighting_id)
"""
