"""Queries of the operators that read bases, with their SQL; documents play chromosomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import annotation, genome
from helixframe.plans.analysis_queries import _EX, _exons
from helixframe.plans.sequence_queries import orf_sql
from helixframe.plans.views import view, with_views

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = lambda spark, sf: f(lambda v: view(spark, sf, v))
        if sql is not None:
            SQL[name] = with_views(sql)
        return f
    return add


_G = "g AS (SELECT doc_id AS chrom, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM documents)"
_E = """e AS (SELECT chrom, CASE WHEN chrom % 2 = 0 THEN '+' ELSE '-' END AS strand, chrom AS tx, 0 AS start, length(seq) // 3 AS "end" FROM g
  UNION ALL SELECT chrom, CASE WHEN chrom % 2 = 0 THEN '+' ELSE '-' END, chrom, length(seq) // 2, length(seq) FROM g)"""
_TXSEQ = """t AS (SELECT chrom AS tx, substr(seq, 1, length(seq) // 3) || substr(seq, length(seq) // 2 + 1) AS s FROM g WHERE length(seq) > 0),
q AS (SELECT tx, CASE WHEN tx % 2 = 0 THEN s ELSE reverse(translate(s, 'ACGT', 'TGCA')) END AS seq FROM t)"""


def _genome(v):
    return v("documents").select(F.col("doc_id").alias("chrom"), F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "").alias("seq"))


def _doc_exons(v):
    n = F.length("seq")
    ends = F.array(F.struct(F.lit(0).alias("start"), F.floor(n / 3).cast("int").alias("end")), F.struct(F.floor(n / 2).cast("int").alias("start"), n.alias("end")))
    return _genome(v).select("chrom", F.when(F.col("chrom") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("chrom").alias("tx"), F.inline(ends))


@query("seq_transcripts", f"WITH {_G}, {_TXSEQ} SELECT tx, seq FROM q")
def _(v):
    return genome.transcript_sequences(_doc_exons(v), genome.tiles(_genome(v), 64), 64).select("tx", "seq")


@query("seq_coding_parts", f"""WITH {_G}, {_TXSEQ}, z AS (SELECT tx AS doc_id, seq FROM q), {orf_sql('z')}
SELECT z.doc_id AS tx, substr(seq, 1, o.start) AS utr5, substr(seq, o.start + 1, o."end" - o.start) AS cds, substr(seq, o."end" + 1) AS utr3 FROM z JOIN orf o USING (doc_id)""")
def _(v):
    return genome.coding_parts(genome.transcript_sequences(_doc_exons(v), genome.tiles(_genome(v), 64), 64))


@query("seq_g_content", f"WITH {_G}, {_TXSEQ} SELECT tx, (length(seq) - length(replace(seq, 'G', ''))) / length(seq) AS share FROM q")
def _(v):
    return genome.base_share(_doc_exons(v), genome.tiles(_genome(v), 64), "tx", "G", 64)


@query("seq_bases_at", f"""WITH {_G}, p AS (SELECT doc_id AS chrom, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, n_chars // 40 AS pos FROM documents WHERE n_chars IS NOT NULL)
SELECT p.chrom, p.strand, p.pos, CASE WHEN strand = '-' THEN translate(substr(seq, pos + 1, 1), 'ACGT', 'TGCA') ELSE substr(seq, pos + 1, 1) END AS base FROM p JOIN g USING (chrom) WHERE substr(seq, pos + 1, 1) <> ''""")
def _(v):
    p = v("documents").where("n_chars is not null").select(F.col("doc_id").alias("chrom"), F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"), F.floor(F.col("n_chars") / 40).alias("pos"))
    return genome.bases_at(p, genome.tiles(_genome(v), 64), 64)


@query("seq_base_frequencies", f"""WITH {_G}, p AS (SELECT doc_id AS chrom, n_chars // 40 AS pos FROM documents WHERE n_chars IS NOT NULL), b AS (SELECT substr(seq, pos + 1, 1) AS base FROM p JOIN g USING (chrom) WHERE substr(seq, pos + 1, 1) <> '')
SELECT base, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM b GROUP BY 1""")
def _(v):
    p = v("documents").where("n_chars is not null").select(F.col("doc_id").alias("chrom"), F.lit("+").alias("strand"), F.floor(F.col("n_chars") / 40).alias("pos"))
    return genome.base_frequencies(p, genome.tiles(_genome(v), 64), 64)


@query("rd_subset", """SELECT DISTINCT e.chrom, e.strand, e.pos FROM v_end e JOIN v_run r ON e.chrom = r.chrom AND e.strand = r.strand AND e.pos >= r.start AND e.pos < r."end" WHERE r.value > 100""")
def _(v):
    return genome.reads_in(v("v_end"), v("v_run").where("value > 100"), one_each=True, order="value").select("chrom", "strand", "pos")


@query("tx_end_groups", f"""WITH {_EX}, t AS (SELECT chrom, strand, gene, tx, CASE WHEN strand = '-' THEN -max("end") ELSE min(start) END AS e FROM x GROUP BY 1, 2, 3, 4),
n AS (SELECT *, CASE WHEN e - lag(e) OVER (PARTITION BY chrom, strand, gene ORDER BY e, tx) <= 50 THEN 0 ELSE 1 END AS new FROM t)
SELECT gene, tx, CAST(sum(new) OVER (PARTITION BY chrom, strand, gene ORDER BY e, tx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "group" FROM n""")
def _(v):
    return genome.end_groups(annotation.transcripts(_exons(v))).select("gene", "tx", "group")


@query("duplex_best", """SELECT target_transcript AS transcript, slice_site AS slice, min(allen_score) AS allen, arg_min(srna, (allen_score, srna)) AS query FROM detected_sites WHERE srna IS NOT NULL AND allen_score IS NOT NULL AND NOT isnan(allen_score) GROUP BY 1, 2""")
def _(v):
    d = v("detected_sites").where("srna is not null and allen_score is not null and not isnan(allen_score)").select(F.col("srna").alias("query"), F.col("target_transcript").alias("transcript"), F.col("slice_site").alias("slice"), F.col("allen_score").alias("allen"))
    return genome.best_duplex(d).select("transcript", "slice", "allen", "query")


@query("rd_transfer_weights", """WITH a AS (SELECT l_partkey, l_extendedprice AS weight, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_discount >= 0.05),
b AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) SELECT b.l_partkey AS pos, count(a.weight) AS matched, count(*) AS n, sum(coalesce(a.weight, 1)) AS weight FROM b LEFT JOIN a ON a.l_partkey = b.l_partkey AND a.n = b.n GROUP BY 1""")
def _(v):
    li = v("lineitem")
    a = li.where("l_discount >= 0.05").select(F.col("l_partkey").alias("pos"), (-F.col("l_extendedprice")).alias("weight"), F.struct("l_orderkey", "l_linenumber").alias("o"))
    b = li.select(F.col("l_partkey").alias("pos"), F.struct("l_orderkey", "l_linenumber").alias("o"))
    return genome.transfer_weights(a, b, ["pos"], "o").groupBy("pos").agg(F.count_if(F.col("weight") < 0).alias("matched"), F.count(F.lit(1)).alias("n"), F.sum(F.abs("weight")).alias("weight"))
