"""Genome-shaped views over the general tables, in Spark and as SQL text for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name of a view to its SQL, valid in both engines; a view may use those before it.
VIEWS = {
    "v_end": """SELECT l_returnflag AS chrom, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_partkey AS pos,
      sum(l_quantity) AS value FROM lineitem WHERE l_quantity >= 45 GROUP BY 1, 2, 3""",
    "v_body": """SELECT l_returnflag AS chrom, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_partkey AS pos,
      sum(l_quantity) AS value FROM lineitem WHERE l_quantity < 45 GROUP BY 1, 2, 3""",
    "v_uug": """SELECT l_returnflag AS chrom, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_partkey AS pos,
      sum(l_quantity) AS value FROM lineitem WHERE l_quantity >= 45 AND l_discount >= 0.05 GROUP BY 1, 2, 3""",
    "v_sample": """SELECT l_returnflag AS chrom, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_partkey AS pos,
      concat('s', l_suppkey % 3) AS sample, sum(l_quantity) AS value FROM lineitem WHERE l_quantity >= 45 GROUP BY 1, 2, 3, 4""",
    "v_feat": """SELECT event_id, event_type AS chrom, CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand, user_id,
      CAST({minute} AS BIGINT) AS start, CAST({minute} + 1 + floor(value) AS BIGINT) AS {end}, value AS score FROM events""",
    "v_point": """SELECT event_id, event_type AS chrom, CASE WHEN user_id % 3 = 0 THEN '+' ELSE '-' END AS strand,
      CAST({minute} AS BIGINT) AS start, CAST({minute} + 1 AS BIGINT) AS {end}, value AS score FROM events""",
    "v_run": """SELECT chrom, strand, pos AS start, pos + 1 + CAST(value AS BIGINT) % 3 AS {end}, value FROM v_end""",
    "v_exon": """SELECT o_custkey AS gene, o_orderkey AS tx, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'c' AS chrom,
      l_partkey * 60 AS start, l_partkey * 60 + CAST(min(l_quantity) AS BIGINT) AS {end}
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4, 5""",
    "v_gff_exon": """SELECT row_id, chromosome AS chrom, strand, start - 1 AS start, stop AS {end} FROM gff_features
      WHERE feature = 'exon' AND strand IN ('+', '-') AND start <= stop""",
}
_MINUTE = {
    "spark": "(unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) div 60000000",
    "duckdb": "(epoch_us(ts) - 1704067200000000) // 60000000",
}
TABLES = ["lineitem", "orders", "events", "documents", "gff_features", "detected_sites", "srna_targets", "srna_precursors", "anno_mirna", "customer", "part", "supplier"]


def _names(text: str) -> list[str]:
    return [v for v in VIEWS if v in text]


def with_views(sql: str) -> str:
    """SQL for DuckDB: ``sql`` after the definitions of the views that it names."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for v in VIEWS:
            if v in text and v not in wanted:
                need(VIEWS[v])
                wanted.append(v)

    need(sql)
    body = sql.strip()
    ctes = ", ".join(f"{v} AS ({VIEWS[v].format(minute=_MINUTE['duckdb'], end=chr(34) + 'end' + chr(34))})" for v in wanted)
    if not ctes:
        return body
    return f"WITH {ctes}, {body[4:].lstrip()}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A view, or a table, as a DataFrame; the tables are read as they are."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf}/{name}.parquet")
    text = VIEWS[name].format(minute=_MINUTE["spark"], end="end")
    tables = {n: view(spark, sf, n) for n in [*VIEWS, *TABLES] if n in text.replace(f"AS {n}", "") and n != name}
    # named arguments keep the views out of the session's catalog
    for n in tables:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(text, **{n: d for n, d in tables.items() if f"{{{n}}}" in text})
