"""Query 8: all documents mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import mixing

QUERY = "op8_pareto_mixing"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words that the mix takes of it."""
    return mixing.mix(mixing.sizes_of(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, sum((200 + least(size, 800)) * size)::BIGINT AS weighed FROM sized GROUP BY source),
ranked AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
  1.5::DOUBLE * sum(source_size) OVER () AS total FROM per),
levels AS (SELECT *, 2.0::DOUBLE * source_size AS cap, sum(weight) OVER () AS weights FROM ranked),
spread AS (SELECT *, (total - coalesce(sum(cap) OVER w, 0)) / (weights - coalesce(sum(weight) OVER w, 0)) AS level FROM levels
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, weighed, least(cap, coalesce(min_by(level, cap / weight) FILTER (level <= cap / weight) OVER (), 1e300) * weight) AS target FROM spread),
chances AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.weighed,
  CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size + 1e-12), 2) ELSE 0 END AS whole,
  (('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
odds AS (SELECT *, greatest(0, target - whole * source_size) AS wanted,
  least(greatest(CASE WHEN weighed > 0 THEN greatest(0, target - whole * source_size) * (200 + least(size, 800)) / weighed ELSE 0 END, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS p FROM chances),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (p / (1 - p)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM odds)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (least(whole + CASE WHEN wanted > before AND before + size / 2.0::DOUBLE <= wanted THEN 1 ELSE 0 END, 2) * size)::BIGINT AS taken
FROM placed
"""
