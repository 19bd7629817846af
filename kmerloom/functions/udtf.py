"""SQL surface: the table function kmers(seq, k) and the scalar functions, all as SQL expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

PIECE = 1000  # windows of a piece, so that no substring is sought far into a long sequence


def register_sql(spark: SparkSession) -> None:
    """Register the table function kmers(seq, k) and the SQL functions revcomp, canonical_kmer and stored_kmer.

    kmers gives pos (0-based) and the stored key of every window of k bases; a null sequence or k, or a k below 1, gives none.
    """
    for name, body in (
        ("revcomp", "reverse(translate(w, 'ACGT', 'TGCA'))"),
        ("canonical_kmer", "least(w, reverse(translate(w, 'ACGT', 'TGCA')))"),
        ("stored_kmer", "least(reverse(w), translate(w, 'ACGT', 'TGCA'))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(w STRING) RETURNS STRING RETURN {body}")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION kmers(seq STRING, k INT) RETURNS TABLE(pos INT, kmer STRING)
RETURN SELECT a + i - 2, least(reverse(w), translate(w, 'ACGT', 'TGCA')) FROM (
  SELECT a, i, substring(t, i, n) AS w, n FROM (
    SELECT p.a AS a, p.t AS t, p.n AS n, explode(sequence(1, length(p.t) - p.n + 1)) AS i FROM (
      SELECT explode(filter(transform(sequence(1, greatest(length(seq) - k + 1, 1), {PIECE}),
        a -> named_struct('a', a, 't', translate(substring(seq, a, {PIECE - 1} + k), 'acgtuU', 'ACGTTT'), 'n', k)), p -> p.n >= 1 AND length(p.t) >= p.n)) AS p)))
WHERE w RLIKE concat('^[ACGT]{{', n, '}}$')""")
