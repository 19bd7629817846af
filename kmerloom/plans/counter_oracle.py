"""Oracle SQL (DuckDB) of the k-mer counter's own operators."""

from kmerloom.plans.sighting_sql import CLEAN

READS = "SELECT read_id, min(seq) AS seq FROM fastq_reads WHERE read_id IS NOT NULL GROUP BY read_id"
TEXT = "SELECT doc_id, text AS seq FROM documents"
HEXN = "SELECT translate(md5(CAST(l_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq FROM lineitem"
WIDE = "SELECT {} AS seq FROM orders".format(
    " || ".join(f"translate(md5(CAST(o_custkey AS VARCHAR) || '{x}'), '0123456789abcdef', 'ACGTACGTACGTACGT')" for x in "abcde")
)
RUNS = "unnest(string_split_regex(translate(seq, 'acgtuU', 'ACGTTT'), '[^ACGT]+'))"


def windows(source: str, k: int, keep: str = "") -> str:
    """CTEs reads, runs, windows (w) and keys (kmer)."""
    also = f"{keep}, " if keep else ""
    return f"""reads AS ({source}),
runs AS (SELECT {also}{RUNS} AS run FROM reads),
windows AS (SELECT {also}substring(run, i, {k}) AS w FROM
  (SELECT {also}run, unnest(range(1, length(run) - {k} + 2)) AS i FROM runs WHERE length(run) >= {k})),
keys AS (SELECT {also}w, least(reverse(w), translate(w, 'ACGT', 'TGCA')) AS kmer FROM windows)"""


def counts(source: str = READS, k: int = 21) -> str:
    return f"{windows(source, k)},\ncounts AS (SELECT kmer, count(*) AS cnt FROM keys GROUP BY kmer)"


ROOT = "(64 * (strpos('ACGT', kmer[1]) - 1) + 16 * (strpos('ACGT', kmer[2]) - 1) + 4 * (strpos('ACGT', kmer[3]) - 1) + strpos('ACGT', kmer[4]) - 1)"

PIECES = f"""low AS (SELECT DISTINCT {CLEAN.format('kmer')} AS kmer FROM low_keys WHERE kmer IS NOT NULL),
root AS (SELECT * FROM (SELECT {CLEAN.format('kmer')} AS kmer, max(cnt) AS cnt FROM root_counts WHERE kmer IS NOT NULL GROUP BY 1) WHERE cnt IS NOT NULL),
merged AS (SELECT coalesce(l.kmer, r.kmer) AS kmer, coalesce(r.cnt, 0) + CASE WHEN l.kmer IS NULL THEN 0 ELSE 1 END AS cnt
  FROM low l FULL OUTER JOIN root r ON l.kmer = r.kmer)"""

WANTED = f"""texts AS (SELECT {CLEAN.format('canonical_kmer')} AS w, lower(trim(form)) AS form FROM kmer_arrivals),
wanted AS (SELECT DISTINCT CASE WHEN form = 'window' THEN least(reverse(w), translate(w, 'ACGT', 'TGCA')) ELSE w END AS kmer FROM texts
  WHERE regexp_full_match(w, '[ACGT]{{21}}'))"""

ROOTS = f"""roots AS (SELECT CAST(g.root AS INTEGER) AS root, greatest(coalesce(n, 0), 1000) AS n
  FROM (SELECT unnest(range(0, 256)) AS root) g LEFT JOIN (SELECT {ROOT} AS root, sum(cnt) AS n FROM counts GROUP BY 1) p ON g.root = p.root)"""


def _with(body: str, select: str) -> str:
    return f"WITH {body}\n{select}"


def _dense(table: str, lo: int, hi: int) -> str:
    return f"""SELECT g.freq, coalesce(s.n, 0) AS n FROM (SELECT unnest(range({lo}, {hi + 1})) AS freq) g
LEFT JOIN (SELECT cnt AS freq, count(*) AS n FROM {table} GROUP BY cnt) s ON g.freq = s.freq"""


#: Byte j of a packed key: four bases, the last byte filled up with A.
_BYTE = "printf('%02x', CAST(" + " + ".join(f"{4 ** (3 - i)} * (strpos('ACGT', rpad(kmer, 24, 'A')[4 * j + {i + 1}]) - 1)" for i in range(4)) + " AS INTEGER))"

_ALL = "SELECT kmer, cnt FROM counts"
_COUNT_SOURCES = {
    "kmer_counts_reads_k21": (READS, 21), "kmer_counts_reads_k21_sql": (READS, 21), "kmer_counts_reads_k31": (READS, 31),
    "kmer_counts_text_k3": (TEXT, 3), "kmer_counts_text_k4": (TEXT, 4), "kmer_counts_hexn_k11": (HEXN, 11), "kmer_counts_wide_k1": (WIDE, 1),
    "kmer_counts_wide_k32": (WIDE, 32), "kmer_counts_wide_k33": (WIDE, 33), "kmer_counts_wide_k64": (WIDE, 64), "kmer_counts_wide_k65": (WIDE, 65),
    "kmer_counts_wide_k128": (WIDE, 128),
}

ORACLE = {
    **{name: _with(counts(*spec), _ALL) for name, spec in _COUNT_SOURCES.items()},
    "fastq_source_reads": "SELECT coalesce(seq, '') AS seq, count(*) AS n FROM fastq_reads GROUP BY 1",
    "fastq_split_reads": """SELECT '@' || coalesce(header, '') AS header, coalesce(seq, '') AS seq, coalesce(qual, '') AS qual, count(*) AS n
FROM fastq_reads GROUP BY 1, 2, 3""",
    "fastq_sampling_scan": "SELECT true AS complete, true AS within",
    "base_runs": f"""WITH reads AS ({READS}), runs AS (SELECT read_id, {RUNS} AS run FROM reads)
SELECT read_id, count(*) AS runs, CAST(sum(length(run)) AS BIGINT) AS bases, CAST(max(length(run)) AS BIGINT) AS longest
FROM runs WHERE length(run) >= 1 GROUP BY read_id""",
    "invalid_base_stats": f"""WITH reads AS ({READS})
SELECT read_id, CAST(length(coalesce(seq, '')) AS BIGINT) AS length,
       CAST(length(regexp_replace(coalesce(seq, ''), '[ACGTUacgtu]', '', 'g')) AS BIGINT) AS invalid FROM reads""",
    "kmer_windows": _with(windows(READS, 21, "read_id"), "SELECT read_id, count(*) AS windows, min(w) AS least, max(w) AS greatest FROM windows GROUP BY read_id"),
    "reverse_complement": f"""WITH reads AS ({READS}), runs AS (SELECT read_id, {RUNS} AS run FROM reads)
SELECT DISTINCT read_id, run, reverse(translate(run, 'ACGT', 'TGCA')) AS revcomp FROM runs WHERE length(run) >= 21""",
    "canonical_key": _with(
        windows(READS, 21), "SELECT DISTINCT w AS window, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS canonical, kmer FROM keys"
    ).replace("AS window,", 'AS "window",'),
    "kmers_of_read": _with(windows(READS, 21, "read_id"), "SELECT read_id, kmer, count(*) AS n FROM keys GROUP BY read_id, kmer"),
    "sql_kmers_table_function": _with(
        windows("SELECT DISTINCT upper(item_key) AS seq FROM heap_items", 11), "SELECT kmer, count(*) AS n FROM keys GROUP BY kmer"
    ),
    "packed_key_hex": _with(
        counts(),
        f"""SELECT kmer, list_aggregate(list_transform(range(0, 11), lambda i: substring('0123456789ABCDEF',
  4 * (strpos('ACGT', kmer[2 * i + 1]) - 1) + CASE WHEN i = 10 THEN 0 ELSE strpos('ACGT', kmer[2 * i + 2]) - 1 END + 1, 1)), 'string_agg', '')
  || '00000' AS word, CAST({ROOT} AS INTEGER) AS root, kmer AS again FROM counts""",
    ),
    "kmer_counts_min_max": _with(counts(), f"{_ALL} WHERE cnt BETWEEN 2 AND 50"),
    "kmer_counts_compat": _with(counts(), "SELECT kmer, CASE WHEN cnt = 1 OR cnt - 1 BETWEEN 2 AND 50 THEN cnt ELSE 1 END AS cnt FROM counts"),
    "low_first_sightings": _with(counts(), "SELECT kmer FROM counts"),
    "low_bin_round_trip": _with(counts(), "SELECT kmer FROM counts"),
    "root_repeats": _with(counts(), f"SELECT CAST({ROOT} AS INTEGER) AS root, kmer, cnt - 1 AS cnt FROM counts WHERE cnt >= 2"),
    "root_bin_round_trip": _with(counts(), f"SELECT CAST({ROOT} AS INTEGER) AS root, kmer, cnt - 1 AS cnt FROM counts WHERE cnt >= 2"),
    "parquet_round_trip": _with(counts(), "SELECT kmer, cnt - 1 AS cnt FROM counts WHERE cnt >= 2"),
    "parquet_merge_round_trip": _with(counts(), "SELECT kmer, cnt FROM counts"),
    "low_root_full_outer_merge": _with(PIECES, "SELECT kmer, cnt FROM merged"),
    "low_minus_root": _with(PIECES, "SELECT kmer FROM low WHERE kmer NOT IN (SELECT kmer FROM root)"),
    "distinct_root_keys": f"SELECT DISTINCT {CLEAN.format('kmer')} AS kmer FROM root_counts WHERE kmer IS NOT NULL",
    "count_lookup": _with(f"{PIECES},\n{WANTED}", "SELECT w.kmer, coalesce(m.cnt, 0) AS cnt FROM wanted w LEFT JOIN merged m ON w.kmer = m.kmer"),
    "kmer_membership": _with(f"{PIECES},\n{WANTED}", "SELECT kmer FROM wanted WHERE kmer IN (SELECT kmer FROM low)"),
    "kmer_totals": _with(
        counts(),
        """SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total, count(*) AS distinct_keys, count(*) FILTER (cnt >= 2) AS repeated_keys,
       coalesce(max(cnt), 0) AS largest FROM counts""",
    ),
    "top_kmers": _with(counts(), f"{_ALL} ORDER BY cnt DESC, kmer LIMIT 50"),
    "sorted_export": _with(counts(), "SELECT kmer, cnt, row_number() OVER (ORDER BY kmer) AS rank FROM counts"),
    "postprocess_final_root": _with(PIECES, f"SELECT CAST({ROOT} AS INTEGER) AS root, kmer, cnt FROM root"),
    "spectrum_reads_k21": _with(counts(), "SELECT cnt AS freq, count(*) AS n FROM counts GROUP BY cnt"),
    "spectrum_precise": _with(PIECES, "SELECT cnt AS freq, count(*) AS n FROM merged GROUP BY cnt"),
    "spectrum_ranged_dense": _with(PIECES, _dense("merged", 3, 400)),
    "spectrum_approximate": _with(PIECES, _dense("root", 1, 400)),
    "spectrum_legacy": _with(
        PIECES,
        """SELECT freq, count(*) AS n FROM (SELECT cnt + 1 AS freq FROM root
UNION ALL SELECT 1 FROM low WHERE kmer NOT IN (SELECT kmer FROM root)) GROUP BY freq""",
    ),
    "root_prefix_counts": _with(counts(), "SELECT left(kmer, 4) AS prefix, CAST(sum(cnt) AS BIGINT) AS n FROM counts GROUP BY 1"),
    **{
        f"node_prefix_counts_d{x}": _with(
            counts(), f"SELECT left(kmer, 4) AS prefix, substring(kmer, {5 + 2 * x}, 2) AS node, CAST(sum(cnt) AS BIGINT) AS n FROM counts GROUP BY 1, 2"
        )
        for x in (0, 1, 2)
    },
    "prefix_floor_avg": _with(f"{counts()},\n{ROOTS}", "SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) // 256 AS BIGINT) AS average FROM roots"),
    "bloom_capacity": _with(
        f"{counts()},\n{ROOTS},\nsized AS (SELECT root, n, CAST(floor((60000000 // 3) * (CAST(n AS DOUBLE) / (SELECT sum(n) FROM roots)) * 4.81 / 64) AS BIGINT) AS words FROM roots)",
        "SELECT root, CAST(n AS BIGINT) AS n, CAST(greatest(1 << length(bin(greatest(words, 1) - 1)), 32768) AS BIGINT) AS capacity FROM sized",
    ),
    "prefix_owner_totals": _with(
        f"{counts()},\n{ROOTS}", "SELECT CAST(12 AS BIGINT) AS owners, count(*) AS prefixes, CAST(sum(n) AS BIGINT) AS load FROM roots"
    ),
    "prefix_load_order": _with(
        f"{counts()},\n{ROOTS}", "SELECT root, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY n DESC, root) AS INTEGER) AS turn FROM roots"
    ),
    "packed_shifts": _with(PIECES, "SELECT kmer, substring(kmer, 2) || 'A' AS shorter, 'A' || kmer AS longer FROM low"),
    "observed_totals": _with(counts(), "SELECT CAST(sum(cnt) AS BIGINT) AS total, count(*) AS distinct_keys FROM counts"),
    "sampled_prefix_counts": _with(
        counts("SELECT seq FROM fastq_reads"), "SELECT left(kmer, 4) AS prefix, CAST(sum(cnt) AS BIGINT) AS n FROM counts GROUP BY 1"
    ),
    "low_packed_read": _with(
        counts(),
        f"""SELECT list_aggregate(list_transform([5, 4, 3, 2, 1, 0], lambda j: {_BYTE}), 'string_agg', '') AS record FROM counts""",
    ),
    "spectrum_text": _with(PIECES, _dense("merged", 1, 400)),
    "histogram_text": _with(
        PIECES,
        """SELECT freq AS count, count(*) AS num_kmers FROM (SELECT cnt + 1 AS freq FROM root
UNION ALL SELECT 1 FROM low WHERE kmer NOT IN (SELECT kmer FROM root)) GROUP BY freq""",
    ),
    "final_low_sorted": _with(PIECES, "SELECT kmer, row_number() OVER (ORDER BY kmer) AS place FROM low WHERE kmer NOT IN (SELECT kmer FROM root)"),
    "final_root_sorted": _with(PIECES, f"SELECT CAST({ROOT} AS INTEGER) AS root, kmer, cnt, row_number() OVER (ORDER BY kmer) AS place FROM root"),
    "prefix_owner_lpt": f"""WITH RECURSIVE {counts()},
{ROOTS},
turns AS MATERIALIZED (SELECT root, n, row_number() OVER (ORDER BY n DESC, root) AS turn FROM roots),
step AS (
  SELECT CAST(0 AS BIGINT) AS turn, CAST(NULL AS INTEGER) AS root, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS owner,
         list_transform(range(0, 12), lambda x: CAST(0 AS BIGINT)) AS loads
  UNION ALL
  SELECT t.turn, t.root, CAST(t.n AS BIGINT), CAST(list_position(loads, list_min(loads)) - 1 AS BIGINT),
         list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN CAST(x + t.n AS BIGINT) ELSE x END)
  FROM step s JOIN turns t ON t.turn = s.turn + 1)
SELECT root, n, CAST(owner AS INTEGER) AS owner FROM step WHERE turn > 0""",
    "streaming_kmer_counts": _with(counts("SELECT seq FROM fastq_reads", 11), _ALL),
    "streaming_windowed_counts": _with(
        windows("SELECT strftime(run_ts, '%Y-%m-%d') AS day, seq FROM fastq_reads WHERE run_ts IS NOT NULL", 5, "day"), "SELECT day, kmer, count(*) AS cnt FROM keys GROUP BY day, kmer"
    ),
}
