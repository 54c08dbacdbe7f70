"""Queries of annotation, quantification, statistics, reads and bias, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import annotation, bias, coverage, intervals, quant, reads, shards, signal, stats
from helixframe.plans.views import view, with_views
from helixframe.session import materialize

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = lambda spark, sf: f(lambda v: view(spark, sf, v))
        if sql is not None:
            SQL[name] = with_views(sql)
        return f
    return add


# --- annotation: exons of the feature table, with gene and transcript taken from the attributes ---

_TX = r"VX[0-9A-Z]G[0-9]+\.[0-9]+"
_EX = rf"""x AS (SELECT DISTINCT chromosome AS chrom, strand, regexp_extract(attributes, 'VX[0-9A-Z]G[0-9]+', 0) AS gene,
  regexp_extract(attributes, '{_TX}', 0) AS tx, start - 1 AS start, stop AS "end" FROM gff_features
  WHERE feature = 'exon' AND strand IN ('+', '-') AND start <= stop AND regexp_extract(attributes, '{_TX}', 0) <> '')"""
_POINT = """f AS (SELECT row_id AS fid, chromosome AS chrom, CASE WHEN row_id % 5 = 0 THEN '-' ELSE '+' END AS strand, start + row_id % 900 AS start, start + row_id % 900 + 1 AS "end"
  FROM gff_features WHERE start IS NOT NULL AND chromosome IS NOT NULL AND start > 0)"""


def _exons(v):
    g = v("gff_features").where("feature = 'exon' and strand in ('+', '-') and start <= stop")
    tx = F.regexp_extract("attributes", _TX, 0)
    return g.where(tx != "").select(F.col("chromosome").alias("chrom"), "strand", F.regexp_extract("attributes", "VX[0-9A-Z]G[0-9]+", 0).alias("gene"), tx.alias("tx"), (F.col("start") - 1).alias("start"), F.col("stop").alias("end")).distinct()


def _points(v):
    at = F.col("start") + F.col("row_id") % 900
    return v("gff_features").where("start > 0 and chromosome is not null").select(
        F.col("row_id").alias("fid"), F.col("chromosome").alias("chrom"), F.when(F.col("row_id") % 5 == 0, "-").otherwise("+").alias("strand"), at.alias("start"), (at + 1).alias("end"))


_TERM = """t AS (SELECT chrom, strand, gene, tx, CASE WHEN strand = '+' THEN arg_min(start, (start, "end")) ELSE arg_max(start, ("end", start)) END AS start,
  CASE WHEN strand = '+' THEN arg_min("end", (start, "end")) ELSE max("end") END AS "end" FROM x GROUP BY 1, 2, 3, 4)"""
_SINGLE = "g1 AS (SELECT gene FROM (SELECT gene, tx, count(*) AS n FROM (SELECT DISTINCT gene, tx, start, \"end\" FROM x) GROUP BY 1, 2) GROUP BY gene HAVING max(n) = 1)"


@query("tx_terminal_exon", f"WITH {_EX}, {_TERM} SELECT * FROM t")
def _(v):
    return annotation.terminal_exons(_exons(v))


@query("tx_single_exon", f"WITH {_EX}, {_SINGLE} SELECT x.* FROM x WHERE gene IN (SELECT gene FROM g1)")
def _(v):
    return annotation.single_exon_genes(_exons(v))


_CHAIN = """i AS (SELECT *, lead(start) OVER (PARTITION BY chrom, strand, gene, tx ORDER BY start, "end") AS nx FROM x),
c AS (SELECT chrom, strand, gene, tx, min(start) AS start, max("end") AS "end", count(*) AS exons, coalesce(string_agg(CAST("end" AS VARCHAR) || '-' || CAST(nx AS VARCHAR), ',' ORDER BY start, "end") FILTER (WHERE nx IS NOT NULL), '') AS chain FROM i GROUP BY 1, 2, 3, 4)"""


@query("tx_intron_chain", f"WITH {_EX}, {_CHAIN} SELECT chrom || ':' || strand || ':' || chain AS chain, count(*) AS n, min(start) AS first, max(\"end\") AS last FROM c GROUP BY 1")
def _(v):
    return annotation.transcripts(_exons(v)).groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("end").alias("last"))


@query("tx_same_chain", f"""WITH {_EX}, {_CHAIN} SELECT a.gene, a.tx AS a_tx, b.tx AS b_tx, a.start - b.start AS d_start, a."end" - b."end" AS d_end, CAST(a.exons - b.exons AS INTEGER) AS d_exons
FROM c a JOIN c b ON a.gene = b.gene AND a.chrom = b.chrom AND a.strand = b.strand AND a.tx < b.tx AND a.start < b."end" AND b.start < a."end" WHERE a.chain = b.chain""")
def _(v):
    return annotation.compare_transcripts(annotation.transcripts(_exons(v))).where("same_chain and a_tx < b_tx").select("gene", "a_tx", "b_tx", "d_start", "d_end", "d_exons")


_PAIR = """t AS (SELECT chrom, strand, gene, tx, min(start) AS start, max("end") AS "end", list({'s': start, 'e': "end"} ORDER BY start, "end") AS ex FROM x GROUP BY 1, 2, 3, 4),
k AS (SELECT *, [{'l': ex[i].e, 'r': ex[i + 1].s} FOR i IN range(1, len(ex))] AS ins FROM t),
p AS (SELECT a.gene, a.tx AS a_tx, b.tx AS b_tx, a.start AS s, a."end" AS e, b.start AS bs, b."end" AS be, a.ex AS ax, b.ex AS bx, a.ins AS ai, b.ins AS bi
  FROM k a JOIN k b ON a.gene = b.gene AND a.chrom = b.chrom AND a.strand = b.strand AND a.tx <> b.tx AND a.start < b."end" AND b.start < a."end"),
r AS (SELECT gene, a_tx, b_tx, len(list_intersect(ai, bi)) = greatest(len(ai), len(bi)) AS same_chain,
  list_has_all(bi, ai) AND s > bs AND e < be AND len([i FOR i IN bi IF (s > i.l AND s < i.r) OR (e > i.l AND e < i.r)]) = 0
    AND len([i FOR i IN bi IF NOT list_contains(ai, i) AND len([y FOR y IN ax IF y.s < i.l AND y.e > i.r]) > 0]) = 0 AS truncation,
  len([y FOR y IN bx IF y.s <= s AND e <= y.e]) > 0 AS contained,
  (ax[1].s < bx[1].e AND bx[1].s < ax[1].e) OR (ax[-1].s < bx[-1].e AND bx[-1].s < ax[-1].e) AS terminal,
  s - bs AS d_start, e - be AS d_end, CAST(len(ax) - len(bx) AS INTEGER) AS d_exons FROM p)"""


@query("tx_compare", f"WITH {_EX}, {_PAIR} SELECT * FROM r")
def _(v):
    return annotation.compare_transcripts(annotation.transcripts(_exons(v)))


@query("tx_mergeable", f"WITH {_EX}, {_PAIR} SELECT gene, a_tx, b_tx FROM r WHERE (same_chain AND terminal AND a_tx < b_tx) OR truncation OR contained")
def _(v):
    return annotation.mergeable(annotation.compare_transcripts(annotation.transcripts(_exons(v))), "any").select("gene", "a_tx", "b_tx")


@query("tx_contained", f"""WITH {_EX}, {_CHAIN} SELECT DISTINCT a.gene, a.tx AS a_tx, b.tx AS b_tx FROM c a JOIN c b ON a.gene = b.gene AND a.chrom = b.chrom AND a.strand = b.strand AND a.tx <> b.tx
JOIN x ON x.gene = b.gene AND x.tx = b.tx AND x.chrom = b.chrom AND x.strand = b.strand AND x.start <= a.start AND a."end" <= x."end\"""")
def _(v):
    return annotation.compare_transcripts(annotation.transcripts(_exons(v))).where("contained").select("gene", "a_tx", "b_tx")


@query("tx_clip", f"WITH {_EX} SELECT gene, tx, count(*) AS n, CAST(sum(least(\"end\", 400000) - greatest(start, 50000)) AS BIGINT) AS bases FROM x WHERE least(\"end\", 400000) > greatest(start, 50000) GROUP BY 1, 2")
def _(v):
    t = annotation.clip_exons(annotation.transcripts(_exons(v)), F.lit(50_000), F.lit(400_000))
    return t.select("gene", "tx", F.explode("exons").alias("x")).groupBy("gene", "tx").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x.end") - F.col("x.start")).alias("bases"))


@query("tx_flanks", f"""WITH {_EX}, {_TERM} SELECT gene, tx, CASE WHEN strand = '-' THEN "end" - 1 ELSE start END - 100 AS start, CASE WHEN strand = '-' THEN "end" - 1 ELSE start END + 101 AS "end"
FROM t WHERE CASE WHEN strand = '-' THEN "end" - 1 ELSE start END >= 100""")
def _(v):
    return annotation.flanks(annotation.terminal_exons(_exons(v)), 100).select("gene", "tx", "start", "end")


@query("tx_liftover", f"""WITH {_EX}, k AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY tx ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum("end" - start) OVER (PARTITION BY tx) AS total FROM x), {_POINT}
SELECT k.tx, f.fid, CAST(CASE WHEN k.strand = '-' THEN total - 1 - (before + f.start - k.start) ELSE before + f.start - k.start END AS BIGINT) AS tx_pos
FROM k JOIN f ON f.chrom = k.chrom AND f.strand = k.strand AND f.start >= k.start AND f.start < k."end\"""")
def _(v):
    ex = _exons(v)
    cov = _points(v).select("chrom", "strand", F.col("start").alias("pos"), F.col("fid").alias("value"))
    return coverage.to_transcripts(cov, ex).select("tx", F.col("value").alias("fid"), "tx_pos")


_CLASS = f"""WITH {_EX}, {_TERM}, {_SINGLE}, {_POINT},
ex AS (SELECT DISTINCT chrom, strand, start, "end", gene FROM x), t1 AS (SELECT DISTINCT chrom, strand, start, "end", gene FROM t),
s AS (SELECT DISTINCT fid FROM f JOIN x ON f.chrom = x.chrom AND f.strand = x.strand AND f.start < x."end" AND x.start < f."end" WHERE x.gene IN (SELECT gene FROM g1)),
p AS (SELECT DISTINCT f.* FROM f JOIN t1 ON f.chrom = t1.chrom AND f.strand = t1.strand AND f.start < t1."end" AND t1.start < f."end"),
d AS (SELECT DISTINCT fid FROM f JOIN ex ON f.chrom = ex.chrom AND f.strand = ex.strand AND f.start < ex."end" AND ex.start < f."end"
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.chrom = f.chrom AND p.start = f.start)),
u AS (SELECT DISTINCT f.fid FROM f JOIN t1 ON f.chrom = t1.chrom AND f.strand = t1.strand AND (f.strand = '+' AND t1.start >= f."end" AND t1.start - f."end" + 1 <= 500 OR f.strand = '-' AND t1."end" <= f.start AND f.start - t1."end" + 1 <= 500)
  WHERE f.fid NOT IN (SELECT fid FROM p)),
o AS (SELECT max(code) AS code, fid FROM (SELECT fid, 7 AS code FROM s UNION ALL SELECT fid, 6 FROM p UNION ALL SELECT fid, 5 FROM d UNION ALL SELECT fid, 4 FROM u) GROUP BY fid)
"""


@query("cls_sense_labels", _CLASS + "SELECT fid, CAST(code AS INTEGER) AS code FROM o WHERE code >= 4")
def _(v):
    return annotation.classify(_points(v), _exons(v)).where("code >= 4").select("fid", "code")


# nearest exons on each side of what meets none, of which those with the least number win; numbers are made from the exon itself
_SIDES = """SELECT fid, max(CASE WHEN side = 'l' THEN gene END) AS l, max(CASE WHEN side = 'r' THEN gene END) AS r FROM (
  SELECT fid, side, gene, row_number() OVER (PARTITION BY fid, side ORDER BY gap, eid) AS n FROM (
    SELECT f.fid, n.gene, n.eid, CASE WHEN n."end" <= f.start THEN 'l' ELSE 'r' END AS side, CASE WHEN n."end" <= f.start THEN f.start - n."end" ELSE n.start - f."end" END AS gap
    FROM {} f JOIN ne n ON f.chrom = n.chrom AND f.strand = n.strand
    WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.chrom = f.chrom AND ex.strand = f.strand AND ex.start < f."end" AND f.start < ex."end"))) WHERE n = 1 GROUP BY fid"""
_TREE = _CLASS.rstrip() + f""",
ne AS (SELECT *, CAST('0x' || substr(md5(chrom || strand || '|' || start || '|' || "end" || '|' || gene), 1, 15) AS BIGINT) AS eid FROM ex),
c3 AS (SELECT fid FROM ({_SIDES.format('f')}) WHERE l = r),
sense AS (SELECT fid, code FROM o UNION ALL SELECT fid, 3 FROM c3),
rest AS (SELECT fid, chrom, CASE WHEN strand = '+' THEN '-' ELSE '+' END AS strand, start, "end" FROM f WHERE fid NOT IN (SELECT fid FROM sense)),
c2 AS (SELECT DISTINCT rest.fid FROM rest JOIN ex ON rest.chrom = ex.chrom AND rest.strand = ex.strand AND rest.start < ex."end" AND ex.start < rest."end"),
c1 AS (SELECT fid FROM ({_SIDES.format('rest')}) WHERE l = r),
every AS (SELECT fid, code FROM sense UNION ALL SELECT fid, 2 FROM c2 UNION ALL SELECT fid, 1 FROM c1 UNION ALL SELECT fid, 0 FROM f),
best AS (SELECT fid, CAST(max(code) AS INTEGER) AS code FROM every GROUP BY fid),
lab AS (SELECT fid, code, ['N', 'IA', 'A', 'I', 'U', 'D', 'P', 'S'][code + 1] AS label FROM best)
"""


@query("cls_decision_tree", _TREE + "SELECT fid, code, label FROM lab")
def _(v):
    return annotation.classify(_points(v), _exons(v))


_UUG = "j AS (SELECT e.chrom, e.strand, e.pos, e.value AS total, coalesce(u.value, 0) AS uug FROM v_end e LEFT JOIN v_uug u ON e.chrom = u.chrom AND e.strand = u.strand AND e.pos = u.pos)"


def _uug(v):
    return v("v_end").withColumnRenamed("value", "total").join(v("v_uug").withColumnRenamed("value", "uug"), ["chrom", "strand", "pos"], "left").na.fill(0.0, ["uug"])


@query("cls_capped", f"WITH {_UUG} SELECT chrom, strand, pos, uug / total AS share, uug / total >= 0.4 AS capped FROM j WHERE total >= 50")
def _(v):
    return annotation.split_capped(_uug(v), 0.4, 50).select("chrom", "strand", "pos", "share", "capped")


@query("cls_auto_cutoff", f"""WITH {_UUG}, b AS (SELECT unnest(range(0, 101)) AS bin), h AS (SELECT b.bin, count(j.total) AS n FROM b LEFT JOIN j ON b.bin = least(floor(uug / total * 100), 100) WHERE b.bin < 25 GROUP BY 1)
SELECT avg(bin) / 100 AS cutoff FROM h WHERE n = (SELECT min(n) FROM h)""")
def _(v):
    return annotation.auto_cutoff(_uug(v))


@query("tx_dominant", 'SELECT gene, arg_max(tx, (total, -tx)) AS tx, max(total) AS total FROM (SELECT gene, tx, CAST(sum("end" - start) AS DOUBLE) AS total FROM v_exon GROUP BY 1, 2) GROUP BY 1')
def _(v):
    t = v("v_exon").groupBy("gene", "tx").agg(F.sum(F.col("end") - F.col("start")).cast("double").alias("total"))
    return annotation.dominant_transcript(t)


# --- quantification ---

_QUANT = 'q AS (SELECT gene, tx, CAST(count(*) AS DOUBLE) AS reads, CAST(sum("end" - start) AS BIGINT) AS length FROM v_exon GROUP BY 1, 2)'


def _quant(v):
    return v("v_exon").groupBy("gene", "tx").agg(F.count(F.lit(1)).cast("double").alias("reads"), F.sum(F.col("end") - F.col("start")).alias("length"))


@query("q_gene_rollup", f"WITH {_QUANT} SELECT CAST(gene AS VARCHAR) AS gene, sum(reads) AS reads, max(length) AS length FROM q GROUP BY 1")
def _(v):
    return quant.gene_rollup(_quant(v).withColumn("name", F.concat_ws(".", "gene", "tx")))


@query("q_tpm", f"WITH {_QUANT}, k AS (SELECT *, CASE WHEN length > 0 THEN reads * 1000 / length ELSE 0 END AS rpk FROM q) SELECT tx, rpk, reads * 1e6 / sum(reads) OVER () AS rpm, rpk * 1e6 / sum(rpk) OVER () AS tpm FROM k")
def _(v):
    return quant.normalise(_quant(v)).select("tx", "rpk", "rpm", "tpm")


@query("q_scale_ratio", f"""WITH {_QUANT}, g AS (SELECT gene, sum(reads) AS reads, max(length) AS length FROM q GROUP BY 1), k AS (SELECT *, CASE WHEN length > 0 THEN reads * 1000 / length ELSE 0 END AS rpk FROM g),
b AS (SELECT *, rpk * 1e6 / (SELECT sum(rpk) FROM k) AS tpm FROM k), e AS (SELECT o_custkey AS gene, count(*) AS e FROM orders GROUP BY 1)
SELECT least(10.0, 2 * 200 * 1e6 / sum(length * tpm) * sum(b.reads) / sum(e.e)) AS scale FROM e JOIN b USING (gene)""")
def _(v):
    g = quant.normalise(_quant(v).groupBy("gene").agg(F.sum("reads").alias("reads"), F.max("length").alias("length")))
    e = v("orders").groupBy(F.col("o_custkey").alias("gene")).agg(F.count(F.lit(1)).alias("reads"))
    return quant.scale_ratio(e, g)


@query("meta_stretch", f"""WITH c AS (SELECT event_type AS tx, user_id AS tx_pos, sum(value) AS value FROM events GROUP BY 1, 2), l AS (SELECT tx, max(tx_pos) + 1 AS length FROM c GROUP BY 1), d AS (SELECT tx, sum(value) AS d FROM c GROUP BY 1)
SELECT CAST(least(floor(tx_pos * 20 / length), 19) AS INTEGER) AS bin, sum(value / d) AS signal, count(DISTINCT tx) AS transcripts FROM c JOIN l USING (tx) JOIN d USING (tx) GROUP BY 1""")
def _(v):
    c = v("events").groupBy(F.col("event_type").alias("tx"), F.col("user_id").alias("tx_pos")).agg(F.sum("value").alias("value"))
    return quant.stretch_profile(c, c.groupBy("tx").agg((F.max("tx_pos") + 1).alias("length")), 20)


@query("meta_distance", """WITH s AS (SELECT chrom || strand AS ref, pos FROM v_uug), c AS (SELECT chrom || strand AS ref, pos, sum(value) AS value FROM v_end GROUP BY 1, 2), o AS (SELECT CAST(unnest(range(-50, 51)) AS INTEGER) AS diff)
SELECT diff, sum(coalesce(value, 0)) AS total, avg(coalesce(value, 0)) AS mean FROM s CROSS JOIN o LEFT JOIN c ON c.ref = s.ref AND c.pos = s.pos + diff GROUP BY 1""")
def _(v):
    ref = F.concat("chrom", "strand").alias("ref")
    return quant.distance_profile(v("v_uug").select(ref, "pos"), v("v_end").select(ref, "pos", "value"))


@query("meta_distance_by_score", """SELECT CASE WHEN allen_score <= 2 THEN 'low' WHEN allen_score <= 4 THEN 'middle' ELSE 'high' END AS bucket, sample_name, count(*) AS n, sum(coalesce(slice_site_rpm, 0)) AS total
FROM detected_sites WHERE allen_score BETWEEN 0 AND 6 AND NOT isnan(allen_score) AND NOT isnan(coalesce(slice_site_rpm, 0)) GROUP BY 1, 2""")
def _(v):
    d = v("detected_sites").where("allen_score between 0 and 6 and not isnan(allen_score) and not isnan(coalesce(slice_site_rpm, 0D))")
    b = F.when(F.col("allen_score") <= 2, "low").when(F.col("allen_score") <= 4, "middle").otherwise("high")
    return d.groupBy(b.alias("bucket"), "sample_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("slice_site_rpm", F.lit(0.0))).alias("total"))


@query("motif_enrich", """WITH k AS (SELECT substr(regexp_replace(upper(sequence), '[^ACGTU]', '', 'g'), 1, 3) AS motif, name LIKE 'miR%' AS positive FROM anno_mirna WHERE sequence IS NOT NULL AND name IS NOT NULL),
c AS (SELECT motif, count(*) FILTER (WHERE positive) AS p, count(*) FILTER (WHERE NOT positive) AS b FROM k GROUP BY 1)
SELECT motif, (p / (SELECT sum(p) FROM c)) / nullif(b / (SELECT sum(b) FROM c), 0) AS ratio FROM c""")
def _(v):
    k = v("anno_mirna").where("sequence is not null and name is not null").select(F.substring(F.regexp_replace(F.upper("sequence"), "[^ACGTU]", ""), 1, 3).alias("motif"), F.col("name").startswith("miR").alias("positive"))
    return quant.motif_enrichment(k)


_EDGE = """e AS (SELECT gene, start AS x FROM v_exon UNION SELECT gene, "end" FROM v_exon), c AS (SELECT gene, x, lead(x) OVER (PARTITION BY gene ORDER BY x) AS y FROM e),
j AS (SELECT c.gene, c.x AS start, c.y AS "end", count(DISTINCT v.tx) AS txs FROM c JOIN v_exon v ON c.gene = v.gene AND v.start <= c.x AND c.y <= v."end" WHERE y IS NOT NULL GROUP BY 1, 2, 3)"""


@query("q_edges", f"WITH {_EDGE} SELECT gene, start, \"end\", CAST(txs AS INTEGER) AS n FROM j")
def _(v):
    return quant.edges(v("v_exon"), ["gene"]).select("gene", "start", "end", F.size("txs").alias("n"))


@query("q_isoforms")
def _(v):
    e = quant.edges(v("v_exon"), ["gene"]).withColumn("reads", (F.col("end") - F.col("start")) * F.size("txs").cast("double"))
    return quant.isoform_reads(e, "gene")


# --- statistics and the cleavage test ---

_SITES = """d AS (SELECT site_id, sample_name, split_part(srna, '_shuffled', 1) AS family, srna LIKE '%_shuffled%' AS control, target_transcript, slice_site, allen_score, slice_site_rpm, fold_change
  FROM detected_sites WHERE srna IS NOT NULL AND fold_change IS NOT NULL AND NOT isnan(fold_change) AND allen_score IS NOT NULL AND NOT isnan(allen_score))"""


def _sites(v):
    d = v("detected_sites").where("srna is not null and fold_change is not null and not isnan(fold_change) and allen_score is not null and not isnan(allen_score)")
    return d.select("site_id", "sample_name", F.substring_index("srna", "_shuffled", 1).alias("family"), F.col("srna").contains("_shuffled").alias("control"), "target_transcript", "slice_site", "allen_score", "slice_site_rpm", "fold_change")


def _p_values(v):
    s = _sites(v)
    test, null = s.where("not control"), s.where("control")
    out = stats.ecdf(stats.ecdf(test, null, ["family"], "fold_change", "below"), null, ["family"], "allen_score", "p_allen")
    return out.withColumn("p_fc", 1 - F.col("below")).withColumn("p", stats.fisher(F.col("p_fc"), F.col("p_allen")))


_PVALUES = f"""{_SITES}, n AS (SELECT family, fold_change, allen_score FROM d WHERE control),
nf AS (SELECT family, fold_change AS v, count(*) AS k FROM n GROUP BY 1, 2), na AS (SELECT family, allen_score AS v, count(*) AS k FROM n GROUP BY 1, 2), nt AS (SELECT family, count(*) AS t FROM n GROUP BY 1),
tf AS (SELECT family, v, sum(CASE WHEN kf <= v THEN k END) AS c FROM (SELECT t.family, t.fold_change AS v, nf.v AS kf, nf.k FROM (SELECT DISTINCT family, fold_change FROM d WHERE NOT control) t JOIN nf ON t.family = nf.family) GROUP BY 1, 2),
ta AS (SELECT family, v, sum(CASE WHEN kf <= v THEN k END) AS c FROM (SELECT t.family, t.allen_score AS v, na.v AS kf, na.k FROM (SELECT DISTINCT family, allen_score FROM d WHERE NOT control) t JOIN na ON t.family = na.family) GROUP BY 1, 2),
p AS (SELECT d.*, 1 - coalesce(tf.c, 0) / nt.t AS p_fc, coalesce(ta.c, 0) / nt.t AS p_allen FROM d LEFT JOIN nt ON d.family = nt.family LEFT JOIN tf ON d.family = tf.family AND d.fold_change = tf.v LEFT JOIN ta ON d.family = ta.family AND d.allen_score = ta.v WHERE NOT control),
fi AS (SELECT *, CASE WHEN p_fc * p_allen = 0 THEN 0 ELSE p_fc * p_allen * (1 - ln(p_fc * p_allen)) END AS p FROM p)"""


@query("st_ecdf", f"WITH {_PVALUES} SELECT site_id, p_fc, p_allen FROM p")
def _(v):
    return _p_values(v).select("site_id", "p_fc", "p_allen")


@query("st_fisher", f"WITH {_PVALUES} SELECT site_id, p FROM fi")
def _(v):
    return _p_values(v).select("site_id", "p")


_BH = "b AS (SELECT *, least(1.0, min(adj_p_val * m / r) OVER (PARTITION BY sample_name ORDER BY adj_p_val DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS fdr FROM (SELECT *, count(*) OVER (PARTITION BY sample_name) AS m, count(*) OVER (PARTITION BY sample_name ORDER BY adj_p_val RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM detected_sites WHERE adj_p_val IS NOT NULL AND NOT isnan(adj_p_val)))"


@query("st_bh", f"WITH {_BH} SELECT site_id, fdr FROM b")
def _(v):
    return stats.benjamini_hochberg(v("detected_sites").where("adj_p_val is not null and not isnan(adj_p_val)"), ["sample_name"], "adj_p_val").select("site_id", "fdr")


_FLANK = """s AS (SELECT site_id, sample_name, target_transcript, slice_site, CASE WHEN isnan(slice_site_rpm) THEN NULL ELSE slice_site_rpm END AS rpm FROM detected_sites),
q AS (SELECT DISTINCT sample_name, target_transcript, slice_site FROM s WHERE slice_site IS NOT NULL AND sample_name IS NOT NULL AND target_transcript IS NOT NULL),
m AS (SELECT q.sample_name, q.target_transcript, q.slice_site, max(s.rpm) AS flank FROM q JOIN s USING (sample_name, target_transcript)
  WHERE s.slice_site <> q.slice_site AND abs(s.slice_site - q.slice_site) <= 50 GROUP BY 1, 2, 3)"""


@query("st_fold_change", f"WITH {_FLANK} SELECT s.site_id, (s.rpm + 1) / (coalesce(m.flank, 0) + 1) AS fc FROM s LEFT JOIN m USING (sample_name, target_transcript, slice_site)")
def _(v):
    """Signal of a site over the highest one elsewhere within 50 bases of its transcript."""
    d = v("detected_sites").select("site_id", "sample_name", "target_transcript", "slice_site", F.nanvl("slice_site_rpm", F.lit(None)).alias("rpm"))
    by = ["sample_name", "target_transcript"]
    places = d.where("slice_site is not null").groupBy(*by, "slice_site").agg(F.max("rpm").alias("rpm"))
    # a place does not count for itself, so its neighbours are taken from each side
    near = shards.around(places, by, "slice_site", 50, {"all": F.collect_list(F.struct("rpm", "slice_site"))})
    flank = near.select(*by, "slice_site", F.array_max(F.transform(F.filter("all", lambda x: x["slice_site"] != F.col("slice_site")), lambda x: x["rpm"])).alias("flank"))
    return d.join(flank, [*by, "slice_site"], "left").select("site_id", stats.fold_change(F.col("rpm"), F.coalesce("flank", F.lit(0.0))).alias("fc"))


@query("st_ks", f"""WITH {_SITES}, c AS (SELECT fold_change AS v, count(*) FILTER (WHERE control) AS a, count(*) FILTER (WHERE NOT control) AS b FROM d GROUP BY 1),
r AS (SELECT sum(a) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) / (SELECT sum(a) FROM c) AS x, sum(b) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) / (SELECT sum(b) FROM c) AS y FROM c), z AS (SELECT max(abs(x - y)) AS distance, (SELECT sum(a) FROM c) AS na, (SELECT sum(b) FROM c) AS nb FROM r)
SELECT distance, least(1, greatest(0, 2 * (SELECT sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * na * nb / (na + nb) * distance * distance)) FROM (SELECT unnest(range(1, 101)) AS k)))) AS p FROM z""")
def _(v):
    return stats.ks_distance(_sites(v), "control", "fold_change").select("distance", "p")


@query("st_welch", f"""WITH {_SITES}, s AS (SELECT avg(fold_change) FILTER (WHERE control) AS ma, avg(fold_change) FILTER (WHERE NOT control) AS mb, var_samp(fold_change) FILTER (WHERE control) / count(*) FILTER (WHERE control) AS va,
  var_samp(fold_change) FILTER (WHERE NOT control) / count(*) FILTER (WHERE NOT control) AS vb, count(*) FILTER (WHERE control) AS na, count(*) FILTER (WHERE NOT control) AS nb FROM d) SELECT (ma - mb) / sqrt(va + vb) AS t, pow(va + vb, 2) / (va * va / (na - 1) + vb * vb / (nb - 1)) AS df FROM s""")
def _(v):
    return stats.welch_t(_sites(v), "control", "fold_change").select("t", "df")


@query("st_replicate_summary", f"WITH {_SITES} SELECT family, sum(CAST(round(fold_change * 10000) AS BIGINT)) / count(*) / 10000 AS mean, coalesce(stddev_samp(fold_change), 0) AS sd, count(DISTINCT sample_name) >= 2 AS voted FROM d WHERE NOT control GROUP BY 1")
def _(v):
    return _sites(v).where("not control").groupBy("family").agg((F.sum(F.round(F.col("fold_change") * 10000).cast("bigint")) / F.count(F.lit(1)) / 10000).alias("mean"), F.coalesce(F.stddev_samp("fold_change"), F.lit(0.0)).alias("sd"), (F.countDistinct("sample_name") >= 2).alias("voted"))


@query("st_interaction_matrix", f"""WITH {_SITES} SELECT sample_name, family || ':' || target_transcript AS interaction, least(5, coalesce(sum(slice_site_rpm), 0)) AS value
FROM d WHERE NOT control AND NOT isnan(coalesce(slice_site_rpm, 0)) GROUP BY 1, 2""")
def _(v):
    s = _sites(v).where("not control and not isnan(coalesce(slice_site_rpm, 0D))")
    return s.groupBy("sample_name", F.concat("family", F.lit(":"), "target_transcript").alias("interaction")).agg(F.least(F.lit(5.0), F.coalesce(F.sum("slice_site_rpm"), F.lit(0.0))).alias("value"))


@query("st_verified", """SELECT d.site_id, CASE WHEN EXISTS (SELECT 1 FROM srna_targets t WHERE lower(trim(t.validated)) = 'yes' AND substr(t.srna, 1, 6) = substr(d.srna, 1, 6) AND t.targetagi = split_part(d.target_transcript, '.', 1)) THEN 'yes' ELSE 'no' END AS verified FROM detected_sites d""")
def _(v):
    t = v("srna_targets").where(F.lower(F.trim("validated")) == "yes").select(F.substring("srna", 1, 6).alias("f"), F.col("targetagi").alias("a")).distinct().withColumn("hit", F.lit("yes"))
    d = v("detected_sites").select("site_id", F.substring("srna", 1, 6).alias("f"), F.substring_index("target_transcript", ".", 1).alias("a"))
    return d.join(t, ["f", "a"], "left").select("site_id", F.coalesce("hit", F.lit("no")).alias("verified"))


@query("st_no_self_hits", """SELECT d.site_id FROM detected_sites d JOIN (SELECT DISTINCT srna, precursor FROM srna_precursors WHERE precursor IS NOT NULL) p ON split_part(d.srna, '_shuffled', 1) = p.srna
GROUP BY d.site_id HAVING bool_and(p.precursor <> split_part(d.target_transcript, '.', 1))""")
def _(v):
    p = v("srna_precursors").where("precursor is not null").distinct()
    d = v("detected_sites").select("site_id", F.substring_index("srna", "_shuffled", 1).alias("srna"), F.substring_index("target_transcript", ".", 1).alias("agi"))
    return d.join(p, "srna").groupBy("site_id").agg(F.every(F.col("precursor") != F.col("agi")).alias("ok")).where("ok").select("site_id")


@query("st_significant", "SELECT site_id FROM detected_sites WHERE fold_change > 1 AND NOT isnan(fold_change) AND adj_p_val < 0.05 AND slice_site_rpm > 0.1 AND NOT isnan(slice_site_rpm)")
def _(v):
    return v("detected_sites").where("fold_change > 1 and not isnan(fold_change) and adj_p_val < 0.05 and slice_site_rpm > 0.1 and not isnan(slice_site_rpm)").select("site_id")


@query("st_best_window", """WITH a AS (SELECT target_transcript || ':' || slice_site AS slice_id, min(adj_p_val) AS p FROM detected_sites WHERE right(sample_name, 1) IN ('1', '3', '5', '7', '9') GROUP BY 1), b AS (SELECT target_transcript || ':' || slice_site AS slice_id, min(adj_p_val) AS p FROM detected_sites WHERE right(sample_name, 1) NOT IN ('1', '3', '5', '7', '9') GROUP BY 1)
SELECT coalesce(a.slice_id, b.slice_id) AS slice_id, a.p AS p_x, b.p AS p_y, CASE WHEN coalesce(a.p, 2) <= coalesce(b.p, 2) THEN 'x' ELSE 'y' END AS best FROM a FULL JOIN b ON a.slice_id = b.slice_id""")
def _(v):
    d = v("detected_sites").withColumn("slice_id", F.concat("target_transcript", F.lit(":"), F.col("slice_site").cast("string")))
    # all samples in two halves stand for two window sizes
    odd = F.substring("sample_name", -1, 1).isin("1", "3", "5", "7", "9")
    a, b = (d.where(own).groupBy("slice_id").agg(F.min("adj_p_val").alias(c)) for own, c in ((odd, "p_x"), (~odd, "p_y")))
    return a.join(b, "slice_id", "full").withColumn("best", F.when(F.coalesce("p_x", F.lit(2.0)) <= F.coalesce("p_y", F.lit(2.0)), "x").otherwise("y"))


def spaced_sql(sites: str) -> str:
    """Greedy spacing of ``sites``, rows numbered ``n`` within ``g``, with ``x`` and ``site_id``: the kept ones as ``kept``."""
    return f"""{sites},
step AS (SELECT g, n, [x] AS xs, [site_id] AS ids FROM ranked WHERE n = 1
  UNION ALL SELECT r.g, r.n, CASE WHEN ok THEN list_append(xs, x) ELSE xs END, CASE WHEN ok THEN list_append(ids, site_id) ELSE ids END
  FROM (SELECT r.g, r.n, r.x, r.site_id, s.xs, s.ids, len([k FOR k IN s.xs IF abs(k - r.x) <= 5]) = 0 AS ok FROM step s JOIN ranked r ON r.g = s.g AND r.n = s.n + 1) r),
kept AS (SELECT unnest(ids) AS site_id FROM (SELECT ids, row_number() OVER (PARTITION BY g ORDER BY n DESC) AS back FROM step) WHERE back = 1)"""


_RANKED = """ranked AS (SELECT sample_name || '|' || target_transcript AS g, slice_site AS x, site_id, row_number() OVER (PARTITION BY sample_name, target_transcript
  ORDER BY allen_score, CASE WHEN isnan(slice_site_rpm) THEN 0 WHEN slice_site_rpm IS NULL THEN 2 ELSE 1 END, slice_site_rpm DESC, family, site_id) AS n FROM {} WHERE slice_site IS NOT NULL)"""


@query("st_spaced_sites", "WITH RECURSIVE " + spaced_sql(f"{_SITES}, " + _RANKED.format("(SELECT * FROM d WHERE NOT control)")) + " SELECT site_id FROM kept")
def _(v):
    s = _sites(v).where("not control and slice_site is not null")
    return stats.spaced(s, ["sample_name", "target_transcript"], "slice_site", [F.col("allen_score").asc(), F.col("slice_site_rpm").desc(), F.col("family").asc(), F.col("site_id").asc()]).select("site_id")


@query("st_gene_sets", """SELECT gene FROM (SELECT sample_name, split_part(target_transcript, '.', 1) AS gene FROM detected_sites WHERE sample_name IS NOT NULL)
GROUP BY gene HAVING count(DISTINCT sample_name) = (SELECT count(DISTINCT sample_name) FROM detected_sites)""")
def _(v):
    d = v("detected_sites").where("sample_name is not null").select("sample_name", F.substring_index("target_transcript", ".", 1).alias("gene"))
    samples = d.agg(F.countDistinct("sample_name").alias("samples"))
    found = d.groupBy("gene").agg(F.countDistinct("sample_name").alias("n"))
    return found.crossJoin(F.broadcast(samples)).where("n = samples").select("gene")  # one row


@query("st_study_union", "SELECT count(DISTINCT target_transcript || ':' || slice_site) AS sites, count(*) AS n FROM detected_sites WHERE adj_p_val < 0.05 AND sample_name IS NOT NULL")
def _(v):
    d = v("detected_sites").where("adj_p_val < 0.05 and sample_name is not null").withColumn("site", F.concat("target_transcript", F.lit(":"), F.col("slice_site").cast("string")))
    return d.agg(F.countDistinct("site").alias("sites"), F.count(F.lit(1)).alias("n"))


@query("st_coordinate_sort", "SELECT chrom, strand, pos, row_number() OVER (PARTITION BY chrom, strand ORDER BY pos) AS place FROM v_end")
def _(v):
    return shards.numbered(v("v_end").select("chrom", "strand", "pos"), ["chrom", "strand"], ["pos"], "place")


# --- reads and bias ---

_MULTI = "m AS (SELECT l_orderkey AS read, l_returnflag AS chrom, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_partkey AS pos, 1.0 AS weight, count(*) OVER (PARTITION BY l_orderkey) AS n_map FROM lineitem)"


def _multi(v):
    from pyspark.sql import Window

    return v("lineitem").select(F.col("l_orderkey").alias("read"), F.col("l_returnflag").alias("chrom"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), F.col("l_partkey").alias("pos"),
                                F.lit(1.0).alias("weight"), F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("n_map"))


def _unique(m):
    return m.where("n_map = 1").groupBy("chrom", "strand", "pos").agg(F.sum("weight").alias("value"))


@query("rd_allocate_round", f"""WITH {_MULTI}, u AS (SELECT chrom, strand, pos, sum(weight) AS value FROM m WHERE n_map = 1 GROUP BY 1, 2, 3),
l AS (SELECT m.*, coalesce(a.value, 0) AS own, coalesce(b.value, 0) AS other FROM m LEFT JOIN u a ON m.chrom = a.chrom AND m.strand = a.strand AND m.pos = a.pos
  LEFT JOIN u b ON m.chrom = b.chrom AND m.strand <> b.strand AND m.pos = b.pos WHERE m.n_map > 1),
w AS (SELECT *, sum(own) OVER (PARTITION BY read) AS s, sum(other) OVER (PARTITION BY read) AS t FROM l)
SELECT read, chrom, strand, pos, CASE WHEN s > 0 THEN own / s WHEN t > 0 THEN other / t END AS share FROM w""")
def _(v):
    m = _multi(v)
    return reads.allocate(m.where("n_map > 1"), _unique(m)).select("read", "chrom", "strand", "pos", "share")


@query("rd_mm_rescue")
def _(v):
    m = _multi(v)
    return reads.rescue(_unique(m), m.where("n_map > 1"))


@query("rd_max_per_position", """SELECT chrom, strand, pos, read FROM (SELECT l_returnflag AS chrom, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_partkey AS pos, l_orderkey AS read,
  row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_partkey ORDER BY l_orderkey) AS n FROM lineitem) WHERE n <= 5""")
def _(v):
    return reads.max_per_position(_multi(v), 5, ["chrom", "strand", "pos"], ["read"]).select("chrom", "strand", "pos", "read")


@query("rd_size_classes", "SELECT l_partkey AS pos, count(*) FILTER (WHERE l_quantity < 20) AS short, count(*) FILTER (WHERE l_quantity >= 20) AS long FROM lineitem GROUP BY 1")
def _(v):
    return v("lineitem").groupBy(F.col("l_partkey").alias("pos")).agg(F.count_if(F.col("l_quantity") < 20).alias("short"), F.count_if(F.col("l_quantity") >= 20).alias("long"))


_CLEAN = "regexp_replace(upper(sequence), '[^ACGTU]', '', 'g')"


def _srna(v):
    return v("anno_mirna").where("sequence is not null").select("rec_id", F.regexp_replace(F.upper("sequence"), "[^ACGTU]", "").alias("seq"))


_KMER = f"k AS (SELECT rec_id, CAST(i - 1 AS INTEGER) AS rel_pos, substr(substr(s, 1, 10), i, 2) AS kmer FROM (SELECT rec_id, {_CLEAN} AS s, unnest(range(1, least(length({_CLEAN}), 10))) AS i FROM anno_mirna WHERE sequence IS NOT NULL))"


@query("bias_kmer", f"WITH {_KMER} SELECT rel_pos, kmer, count(*) / sum(count(*)) OVER (PARTITION BY rel_pos) AS freq FROM k GROUP BY 1, 2")
def _(v):
    return bias.kmer_bias(_srna(v), 2, 10)


@query("bias_baseline", f"WITH b AS (SELECT substr(s, i, 2) AS kmer FROM (SELECT {_CLEAN} AS s, unnest(range(1, length({_CLEAN}))) AS i FROM anno_mirna WHERE sequence IS NOT NULL)) SELECT kmer, count(*) / (SELECT count(*) FROM b) AS freq FROM b GROUP BY 1")
def _(v):
    return bias.baseline_kmers(_srna(v), 2)


@query("bias_weight", f"""WITH {_KMER}, f AS (SELECT rel_pos, kmer, count(*) / sum(count(*)) OVER (PARTITION BY rel_pos) AS freq FROM k GROUP BY 1, 2),
b AS (SELECT substr(s, i, 2) AS kmer FROM (SELECT {_CLEAN} AS s, unnest(range(1, length({_CLEAN}))) AS i FROM anno_mirna WHERE sequence IS NOT NULL)), a AS (SELECT kmer, count(*) / (SELECT count(*) FROM b) AS freq FROM b GROUP BY 1)
SELECT rec_id, exp(sum(ln(a.freq / f.freq))) AS weight FROM k JOIN f USING (rel_pos, kmer) JOIN a USING (kmer) GROUP BY 1""")
def _(v):
    s = _srna(v)
    return bias.bias_weight(s, bias.kmer_bias(s, 2, 10), bias.baseline_kmers(s, 2), "rec_id", 2, 10)


@query("bias_neighbours", "SELECT chrom, strand, pos, value / avg(value) OVER (PARTITION BY chrom, strand ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS relative FROM v_end")
def _(v):
    return bias.neighbour_relative(v("v_end"), ["chrom", "strand"]).select("chrom", "strand", "pos", "relative")


@query("bias_density", "SELECT chrom, strand, pos, count(*) OVER (PARTITION BY chrom, strand ORDER BY pos RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS near FROM v_end")
def _(v):
    return bias.density(v("v_end"), ["chrom", "strand"]).select("chrom", "strand", "pos", "near")


@query("bias_corr", "SELECT 'l_quantity' AS i, 'l_extendedprice' AS j, abs(corr(l_quantity, l_extendedprice)) AS abs_corr FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', abs(corr(l_quantity, l_tax)) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', abs(corr(l_extendedprice, l_tax)) FROM lineitem")
def _(v):
    return bias.tile_correlation(v("lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


@query("bias_pileup", """WITH a AS (SELECT u.chrom, u.strand, u.pos AS site, e.value FROM v_uug u JOIN v_end e ON u.chrom = e.chrom AND u.strand = e.strand AND e.pos BETWEEN u.pos - 5 AND u.pos + 5),
m AS (SELECT chrom, strand, site, arg_max(value, (n, value)) AS mode FROM (SELECT chrom, strand, site, value, count(*) AS n FROM a GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
SELECT a.chrom, a.strand, a.site, min(value) AS least, quantile_cont(value, 0.5) AS median, avg(value) AS mean, any_value(mode) AS mode FROM a JOIN m USING (chrom, strand, site) GROUP BY 1, 2, 3""")
def _(v):
    return bias.pileup(v("v_uug"), v("v_end"), ["chrom", "strand"])


@query("bias_sampled_baseline", """WITH d AS (SELECT chrom, strand, pos, count(*) OVER (PARTITION BY chrom, strand ORDER BY pos RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS near FROM v_end),
o AS (SELECT *, pos + unnest(range(-25, 26)) AS place FROM d)
SELECT chrom, strand, place AS "at" FROM o WHERE place >= 0 AND CAST('0x' || substr(md5('11|' || chrom || '|' || strand || '|' || pos || '|' || place), 1, 12) AS BIGINT) / 281474976710656.0 < 0.2 * near / 51""")
def _(v):
    return bias.sampled_baseline(v("v_end"), ["chrom", "strand"], 0.2, 11)


# --- composed: features of the end library after subtracting the body library ---

_KERNEL = signal.kernel("laplace", 3, 3)


def feature_calling(v):
    """Mask, scale, subtract, smooth, find islands and their peaks, and keep those with enough reads."""
    f = v("v_feat").withColumn("chrom", F.when(F.col("event_id") % 3 == 0, "A").when(F.col("event_id") % 3 == 1, "N").otherwise("R"))
    end = materialize(coverage.mask(v("v_end"), f, "up").select("chrom", "strand", "pos", "value"), "end")  # read three times
    body = v("v_body")
    # both sums in one row
    totals = end.agg(F.sum("value").alias("e")).crossJoin(body.agg(F.sum("value").alias("b")))
    total = totals.first()
    scale = min(10.0, float(total["b"]) / float(total["e"])) if total["e"] else 10.0
    signal_ = coverage.combine([(end, scale), (body, -1.0)])
    smooth = signal.convolve(signal_, _KERNEL)
    found = signal.islands(smooth, 0.0, 3)
    peaks = signal.feature_values(signal.in_features(end, found))
    return peaks.where(F.col("total") * 1e6 / F.lit(float(total["e"] or 1)) >= 20).select("chrom", "strand", "start", "end", "peak")


@query("flagship_feature_calling", "WITH mk AS (SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN 'A' WHEN event_id % 3 = 1 THEN 'N' ELSE 'R' END AS chrom, strand, CASE WHEN strand = '+' THEN \"end\" ELSE start - 1 END AS pos FROM v_feat), "
       "en AS (SELECT e.* FROM v_end e ANTI JOIN mk ON e.chrom = mk.chrom AND e.strand = mk.strand AND e.pos = mk.pos), "
       "sc AS (SELECT least(10.0, (SELECT sum(value) FROM v_body) / (SELECT sum(value) FROM en)) AS scale), "
       "c AS (SELECT chrom, strand, pos, sum(x) AS value FROM (SELECT chrom, strand, pos, value * scale AS x FROM en, sc UNION ALL SELECT chrom, strand, pos, -value FROM v_body) GROUP BY 1, 2, 3 HAVING sum(x) <> 0), "
       "s AS (SELECT chrom, strand, pos + o AS pos FROM c, (VALUES " + ", ".join(f"({x}, CAST({w!r} AS DOUBLE))" for x, w in _KERNEL) + ") k(o, w) WHERE pos + o >= 0 GROUP BY 1, 2, 3 HAVING sum(value * w) > 1e-9), "
       "g AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom, strand ORDER BY pos) AS g FROM s), i AS (SELECT chrom, strand, min(pos) AS start, max(pos) + 1 AS \"end\" FROM g GROUP BY chrom, strand, g HAVING count(*) >= 3), "
       "x AS (SELECT i.*, e.pos, e.value FROM i JOIN en e ON e.chrom = i.chrom AND e.strand = i.strand AND e.pos >= i.start AND e.pos < i.\"end\") "
       "SELECT chrom, strand, start, \"end\", arg_max(pos, (value, pos)) AS peak FROM x GROUP BY 1, 2, 3, 4 HAVING sum(value) * 1e6 / (SELECT sum(value) FROM en) >= 20")
def _(v):
    return feature_calling(v)
