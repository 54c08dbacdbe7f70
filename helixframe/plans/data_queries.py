"""Queries of the general training-data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import packed, periods, rejects


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/anno_mirna_lines.parquet")
    return rejects.parse_lines(table, "raw_line", ["line_id"], rejects.SRNA_LINES)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that fail to parse, with the reason."""
    return _lines(spark, sf).where("reason is not null").select("line_id", "reason")


def p1_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The loaded lines."""
    return _lines(spark, sf).where("reason is null").select("line_id", "record.name", "record.sequence")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of every attribute field."""
    return packed.unpack_values(spark.read.parquet(f"{sf}/gff_features.parquet"), "attributes", ["row_id"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of exons and the gaps between them."""
    exons = spark.read.parquet(f"{sf}/gff_features.parquet").where(F.col("feature") == "exon").where(F.col("strand").isin("+", "-"))
    return periods.periods_and_gaps(exons, ["chromosome", "strand"], "start", "stop", max_gap=10_000)


_LINE_PARTS = r"""
WITH l AS (
  SELECT line_id, CASE WHEN raw_line LIKE '%' || chr(13) THEN left(raw_line, length(raw_line) - 1) ELSE raw_line END AS t
  FROM anno_mirna_lines WHERE raw_line IS NOT NULL),
k AS (
  SELECT line_id, t, regexp_full_match(t, '(?s)("([^"]|"")*"|[^"\t]*)(\t("([^"]|"")*"|[^"\t]*))*') AS sane
  FROM l WHERE NOT regexp_full_match(t, '\s*') AND NOT regexp_matches(t, '^\s*#')),
c AS (
  SELECT line_id, sane, regexp_extract_all('	' || t, '(?s)\t("(?:[^"]|"")*"|[^"\t]*)', 1) AS f FROM k),
u AS (
  SELECT line_id, sane, len(f) AS n,
    regexp_replace(CASE WHEN f[1] LIKE '"%' THEN replace(substr(f[1], 2, length(f[1]) - 2), '""', '"') ELSE f[1] END, '^\s+|\s+$', '', 'g') AS a,
    regexp_replace(CASE WHEN f[2] LIKE '"%' THEN replace(substr(f[2], 2, length(f[2]) - 2), '""', '"') ELSE f[2] END, '^\s+|\s+$', '', 'g') AS b
  FROM c),
r AS (
  SELECT line_id, a, b, CASE WHEN NOT sane THEN 'quoting' WHEN n <> 2 THEN 'column_count'
    WHEN lower(a) = 'name' AND lower(b) = 'sequence' THEN 'header'
    WHEN NOT regexp_full_match(b, '[ACGTUNacgtun]{15,35}') THEN 'invalid_value' END AS reason
  FROM u)
"""

SQL = {
    "p1_found": _LINE_PARTS + "SELECT line_id, reason FROM r WHERE reason <> 'header'",
    "p1_rows": _LINE_PARTS + "SELECT line_id, a AS name, b AS sequence FROM r WHERE reason IS NULL",
    "p2_found": r"""
WITH p AS (
  SELECT row_id, unnest(x) AS piece, generate_subscripts(x, 1) AS i FROM (
    SELECT row_id, regexp_extract_all(attributes, '(?s)(?:[^;&"]|"(?:[^"]|"")*")+') AS x
    FROM gff_features WHERE attributes IS NOT NULL AND trim(attributes) NOT IN ('', '.'))),
t AS (SELECT row_id, i, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS piece FROM p),
m AS (
  SELECT row_id, i, piece, regexp_matches(piece, '(?s)^(?:[^="]|"(?:[^"]|"")*")*=') AS eq,
    regexp_extract(piece, '(?s)^((?:[^="]|"(?:[^"]|"")*")*)=(.*)$', ['k', 'v']) AS e,
    regexp_extract(piece, '(?s)^(\S+)\s+(.*)$', ['k', 'v']) AS s
  FROM t WHERE piece <> ''),
kv AS (SELECT row_id, i, trim(CASE WHEN eq THEN e.k ELSE s.k END) AS k, CASE WHEN eq THEN e.v ELSE s.v END AS v FROM m),
v AS (
  SELECT row_id, i, k, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM (
    SELECT row_id, i, k, regexp_extract_all(v, '(?s)(?:[^,|"]|"(?:[^"]|"")*")+') AS x FROM kv)),
w AS (SELECT row_id, i, j, k, regexp_replace(v, '^\s+|\s+$', '', 'g') AS v FROM v),
q AS (
  SELECT row_id, i, j, k, CASE WHEN v LIKE '"%"' THEN replace(substr(v, 2, length(v) - 2), '""', '"') ELSE v END AS v FROM w)
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY i, j) AS INTEGER) AS value_pos, k AS attr_key, v AS attr_value
FROM q WHERE v <> ''""",
    "p4_found": """
WITH x AS (
  SELECT DISTINCT chromosome, strand, start, stop FROM gff_features
  WHERE feature = 'exon' AND strand IN ('+', '-') AND start <= stop),
f AS (
  SELECT *, max(stop) OVER (PARTITION BY chromosome, strand ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x),
g AS (
  SELECT *, sum(CASE WHEN m IS NULL OR start > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chromosome, strand ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS b FROM f),
k AS (SELECT chromosome, strand, min(start) AS start, max(stop) AS stop FROM g GROUP BY chromosome, strand, b),
n AS (SELECT *, lead(start) OVER (PARTITION BY chromosome, strand ORDER BY start) AS nx FROM k)
SELECT chromosome, strand, 'block' AS kind, start, stop FROM k
UNION ALL SELECT chromosome, strand, 'gap', stop + 1, nx - 1 FROM n WHERE nx - stop - 1 BETWEEN 1 AND 10000""",
}

QUERIES = {"p1_found": p1_found, "p1_rows": p1_rows, "p2_found": p2_found, "p4_found": p4_found}
