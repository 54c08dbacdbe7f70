"""Queries over written text formats, streams, consensus features and composed pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import annotation, consensus, coverage, intervals, quant, signal, stats
from helixframe.plans.analysis_queries import _EX, _POINT, _TREE, _RANKED, _exons, _points, spaced_sql
from helixframe.plans.views import view, with_views
from helixframe.session import materialize, shared_folder
from helixframe.sources import formats, sinks
from helixframe.streaming import signals

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_views(sql)
        return f
    return add


_RUNS = """SELECT chrom, strand, min(pos) AS start, max(pos) + 1 AS "end", value FROM (
  SELECT chrom, strand, pos, value, pos - row_number() OVER (PARTITION BY chrom, strand, value ORDER BY pos) AS g FROM v_end) GROUP BY chrom, strand, value, g"""


@query("io_bedgraph_round_trip", f"SELECT chrom, strand, start, \"end\", value FROM ({_RUNS})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    runs = coverage.encode_runs(view(spark, sf, "v_end"))
    parts = []
    for strand in "+-":  # a file holds one strand
        path = shared_folder(spark, "bedgraph")
        sinks.write_bedgraph(runs.where(F.col("strand") == strand), path)
        parts.append(formats.read_bedgraph(spark, path, strand))
    return parts[0].unionByName(parts[1]).select("chrom", "strand", "start", "end", "value")


@query("io_fasta_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS name, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents WHERE text IS NOT NULL AND length(regexp_replace(upper(text), '[^ACGT]', '', 'g')) > 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "fasta")
    seqs = view(spark, sf, "documents").select(F.col("doc_id").alias("name"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq")).where("length(seq) > 0")
    sinks.write_fasta(seqs, path)
    return formats.read_fasta(spark, path)


@query("io_bed_round_trip", "SELECT chrom, start, \"end\", CAST(event_id AS VARCHAR) AS name, strand FROM v_feat")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "bed")
    sinks.write_bed(view(spark, sf, "v_feat").withColumn("name", F.col("event_id")), path)
    return formats.read_bed(spark, path).select("chrom", "start", "end", "name", "strand")


@query("io_gff_round_trip", f"WITH {_EX} SELECT chrom, strand, gene, tx, start, \"end\" FROM x")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "gff")
    sinks.write_gff(_exons(lambda n: view(spark, sf, n)), path)
    return formats.gff_exons(formats.read_gff(spark, path)).select("chrom", "strand", "gene", "tx", "start", "end")


@query("io_sam_decode")
def _(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws("\t", "l_orderkey", F.when(F.col("l_linestatus") == "O", "0").otherwise("16"), "l_returnflag", F.col("l_partkey") + 1, F.lit("60"),
                       F.concat(F.col("l_quantity").cast("int"), F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("A"), F.lit("I"), F.concat(F.lit("XW:f:"), F.col("l_discount")))
    path = shared_folder(spark, "sam")
    view(spark, sf, "lineitem").select(line.alias("value")).write.text(path)
    return formats.read_sam(spark, path).groupBy("chrom", "strand").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("segments")[0]["end"] - F.col("segments")[0]["start"]).alias("bases"))


SQL["io_sam_decode"] = "SELECT l_returnflag AS chrom, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS bases FROM lineitem GROUP BY 1, 2"


@query("stream_convolve", "SELECT chrom, strand, pos + o AS pos, sum(value * w) AS value FROM v_end, (VALUES " + ", ".join(f"({x}, CAST({w!r} AS DOUBLE))" for x, w in signal.kernel("laplace", 3, 3)) + ") k(o, w) WHERE pos + o >= 0 GROUP BY 1, 2, 3 HAVING sum(value * w) > 1e-9")
def _(spark: SparkSession, sf: str) -> DataFrame:
    source = shared_folder(spark, "stream")
    view(spark, sf, "v_end").select("chrom", "strand", "pos", F.col("value").cast("double")).repartition(3).write.parquet(source)
    stream = signals.convolve_stream(signals.read_coverage(spark, source), signal.kernel("laplace", 3, 3))
    out = shared_folder(spark, "smooth")
    # a complete result is replaced batch by batch in the shared folder; it is never held by the driver
    q = stream.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", shared_folder(spark, "state")).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@query("stream_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = shared_folder(spark, "counts")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    path = f"{sf}/events.parquet"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf) if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    counts = signals.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", late="3650 days")
    q = counts.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", shared_folder(spark, "state")).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("cmp_consensus")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.consensus(view(spark, sf, "v_feat"), ["chrom", "strand"])


@query("cmp_class_counts", _TREE + "SELECT label, count(*) AS n FROM lab GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    v = lambda n: view(spark, sf, n)
    return annotation.classify(_points(v), _exons(v)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("cmp_cap_masking", "SELECT e.chrom, e.strand, e.pos, e.value FROM v_end e ANTI JOIN (SELECT e.chrom, e.strand, e.pos FROM v_end e JOIN v_uug u ON e.chrom = u.chrom AND e.strand = u.strand AND e.pos = u.pos WHERE u.value / e.value >= 0.5) c ON e.chrom = c.chrom AND e.strand = c.strand AND e.pos = c.pos")
def _(spark: SparkSession, sf: str) -> DataFrame:
    end, uug = view(spark, sf, "v_end"), view(spark, sf, "v_uug").withColumnRenamed("value", "uug")
    joined = end.withColumnRenamed("value", "total").join(uug, ["chrom", "strand", "pos"], "left").na.fill(0.0, ["uug"])
    capped = annotation.split_capped(joined, 0.5).where("capped").select("chrom", "strand", F.col("pos").alias("start"), F.col("pos").alias("end"))
    return coverage.mask(end, capped, "inside").select("chrom", "strand", "pos", "value")


_TEST = """d AS (SELECT *, split_part(srna, '_shuffled', 1) AS family, srna LIKE '%_shuffled%' AS control FROM detected_sites WHERE srna IS NOT NULL AND NOT coalesce(isnan(fold_change), false) AND NOT coalesce(isnan(allen_score), false)),
nf AS (SELECT family, fold_change AS v, count(*) AS k FROM d WHERE control AND fold_change IS NOT NULL GROUP BY 1, 2), na AS (SELECT family, allen_score AS v, count(*) AS k FROM d WHERE control AND allen_score IS NOT NULL GROUP BY 1, 2),
tf AS (SELECT family, sum(k) AS t FROM nf GROUP BY 1), ta AS (SELECT family, sum(k) AS t FROM na GROUP BY 1),
cf AS (SELECT t.family, t.v, coalesce(sum(nf.k), 0) AS c FROM (SELECT DISTINCT family, fold_change AS v FROM d WHERE NOT control AND fold_change IS NOT NULL) t LEFT JOIN nf ON t.family = nf.family AND nf.v <= t.v GROUP BY 1, 2),
ca AS (SELECT t.family, t.v, coalesce(sum(na.k), 0) AS c FROM (SELECT DISTINCT family, allen_score AS v FROM d WHERE NOT control AND allen_score IS NOT NULL) t LEFT JOIN na ON t.family = na.family AND na.v <= t.v GROUP BY 1, 2),
pv AS (SELECT d.*, 1 - cf.c / tf.t AS p_fc, ca.c / ta.t AS p_allen, CASE WHEN d.family LIKE 'TAS%' THEN 'tas' ELSE 'mir' END AS kind FROM d LEFT JOIN tf ON d.family = tf.family LEFT JOIN ta ON d.family = ta.family
  LEFT JOIN cf ON d.family = cf.family AND d.fold_change = cf.v LEFT JOIN ca ON d.family = ca.family AND d.allen_score = ca.v WHERE NOT control),
fp AS (SELECT *, CASE WHEN p_fc * p_allen = 0 THEN 0 ELSE p_fc * p_allen * (1 - ln(p_fc * p_allen)) END AS p FROM pv),
rk AS (SELECT *, count(p) OVER (PARTITION BY kind, sample_name) AS m, count(p) OVER (PARTITION BY kind, sample_name ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM fp WHERE p IS NOT NULL),
bh AS (SELECT *, least(1.0, min(p * m / r) OVER (PARTITION BY kind, sample_name ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS fdr FROM rk),
hits AS (SELECT * FROM bh WHERE fold_change > 1 AND fdr < 0.05 AND (slice_site_rpm > 0.1 OR isnan(slice_site_rpm)))"""


@query("cmp_cleavage_test", "WITH RECURSIVE " + spaced_sql(f"{_TEST}, " + _RANKED.format("hits")) + """
SELECT site_id, sample_name, family, target_transcript, slice_site, fold_change, p, fdr, coalesce(interaction, family || ':' || target_transcript) AS interaction FROM hits WHERE site_id IN (SELECT site_id FROM kept)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Test sites against their shuffled controls: p-values, their combination, false discovery rate, spacing and report columns."""
    d = view(spark, sf, "detected_sites").where("srna is not null and not isnan(fold_change) and not isnan(allen_score)")
    d = d.withColumn("family", F.substring_index("srna", "_shuffled", 1)).withColumn("control", F.col("srna").contains("_shuffled"))
    test, null = d.where("not control"), d.where("control")
    p = stats.ecdf(stats.ecdf(test, null, ["family"], "fold_change", "below"), null, ["family"], "allen_score", "p_allen")
    p = p.withColumn("p", stats.fisher(1 - F.col("below"), F.col("p_allen"))).withColumn("kind", F.when(F.col("family").startswith("TAS"), "tas").otherwise("mir"))
    q = materialize(stats.benjamini_hochberg(p, ["kind", "sample_name"], "p"), "tested")
    hits = q.where("fold_change > 1 and fdr < 0.05 and slice_site_rpm > 0.1")
    kept = stats.spaced(hits.where("slice_site is not null"), ["sample_name", "target_transcript"], "slice_site", [F.col("allen_score").asc(), F.col("slice_site_rpm").desc(), F.col("family").asc(), F.col("site_id").asc()])
    return kept.select("site_id", "sample_name", "family", "target_transcript", "slice_site", "fold_change", "p", "fdr", F.coalesce("interaction", F.concat_ws(":", "family", "target_transcript")).alias("interaction"))


@query("cmp_transcript_coverage", f"""WITH {_EX}, {_POINT}, k AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY tx ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum("end" - start) OVER (PARTITION BY tx) AS total FROM x),
l AS (SELECT k.gene, k.tx, CAST(CASE WHEN k.strand = '-' THEN total - 1 - (before + f.start - k.start) ELSE before + f.start - k.start END AS BIGINT) AS tx_pos FROM k JOIN f ON f.chrom = k.chrom AND f.strand = k.strand AND f.start >= k.start AND f.start < k."end"),
g AS (SELECT DISTINCT gene, tx FROM x), t AS (SELECT g.gene, l.tx, count(*) AS n FROM (SELECT tx FROM l) l JOIN g USING (tx) GROUP BY 1, 2),
w AS (SELECT tx FROM (SELECT tx, row_number() OVER (PARTITION BY gene ORDER BY n DESC, tx) AS i FROM t) WHERE i = 1)
SELECT tx, tx_pos, CAST(count(*) AS DOUBLE) AS value FROM l WHERE tx IN (SELECT tx FROM w) GROUP BY 1, 2""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Genome coverage in the coordinates of each gene's dominant transcript."""
    v = lambda n: view(spark, sf, n)
    exons = _exons(v)
    cov = _points(v).select("chrom", "strand", F.col("start").alias("pos"), F.lit(1.0).alias("value"))
    lifted = materialize(coverage.to_transcripts(cov, exons), "lifted")
    totals = lifted.groupBy("tx").agg(F.sum("value").alias("total")).join(exons.select("gene", "tx").distinct(), "tx")
    return lifted.join(annotation.dominant_transcript(totals).select("gene", "tx"), "tx", "left_semi").groupBy("tx", "tx_pos").agg(F.sum("value").alias("value"))


@query("cmp_gene_counts", """WITH r AS (SELECT DISTINCT chrom, strand, gene, start, "end" FROM v_exon), f AS (SELECT DISTINCT r.gene, e.event_id, e.score FROM r JOIN v_feat e ON e.strand = r.strand AND e.start * 3 < r."end" AND r.start < e.start * 3 + 1)
SELECT gene, count(*) AS n FROM f GROUP BY 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ex = view(spark, sf, "v_exon").select("chrom", "strand", "gene", "start", "end").distinct()
    pts = view(spark, sf, "v_feat").select(F.lit("c").alias("chrom"), "strand", (F.col("start") * 3).alias("start"), (F.col("start") * 3 + 1).alias("end"), "event_id")
    return intervals.overlap_join(pts, ex, ["chrom", "strand"], width=256).select(F.col("b_gene").alias("gene"), F.col("a_event_id").alias("e")).distinct().groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


@query("cmp_rescale_bandwidth", """WITH s AS (SELECT chrom || strand AS ref, pos FROM v_uug), c AS (SELECT chrom || strand AS ref, pos, sum(value) AS value FROM v_end GROUP BY 1, 2), o AS (SELECT CAST(unnest(range(-50, 51)) AS INTEGER) AS diff),
m AS (SELECT diff, avg(coalesce(value, 0)) AS mean FROM s CROSS JOIN o LEFT JOIN c ON c.ref = s.ref AND c.pos = s.pos + diff GROUP BY 1), t AS (SELECT sum(greatest(mean, 0)) AS t FROM m),
h AS (SELECT h, sum(greatest(mean, 0)) AS inside FROM m, (SELECT unnest(range(0, 51)) AS h) WHERE diff BETWEEN -h AND h GROUP BY 1)
SELECT 1 / t AS scale, (SELECT CAST(least(30, greatest(1, min(h))) AS INTEGER) FROM h, t WHERE inside >= 0.6827 * t) AS bandwidth FROM t""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Scale at which the mean end profile has unit area, and the half-window that holds 68.27 % of it."""
    v = lambda n: view(spark, sf, n)
    ref = F.concat("chrom", "strand").alias("ref")
    profile = quant.distance_profile(v("v_uug").select(ref, "pos"), v("v_end").select(ref, "pos", "value")).orderBy("diff").toPandas()  # 101 rows
    return spark.createDataFrame([(stats.unit_scale(profile["mean"].tolist()), stats.bandwidth_of(profile["mean"]))], "scale double, bandwidth int")
