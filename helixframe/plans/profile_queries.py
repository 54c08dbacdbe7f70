"""Queries of meta-profiles, feature values, untemplated bases, names and bias groups, and of formats written and read again, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import duplex
from helixframe.functions import sequence as S
from helixframe.operators import annotation, bias, coverage, genome, intervals, quant, reads, signal, stats
from helixframe.plans.analysis_queries import _EX, _POINT, _SITES, _TREE, _exons, _multi, _points, _sites
from helixframe.plans.base_queries import _genome
from helixframe.plans.genome_queries import _ISLAND, _MERGE, _inside, kernel_sql
from helixframe.plans.sequence_queries import _MISS, _MISS_BACK, _SEQ
from helixframe.plans.views import view, with_views
from helixframe.session import shared_folder
from helixframe.sources import formats, sinks

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = lambda spark, sf: f(lambda v: view(spark, sf, v))
        if sql is not None:
            SQL[name] = with_views(sql)
        return f
    return add


# --- meta-profiles ---

_COV = "c AS (SELECT event_type AS tx, user_id AS tx_pos, sum(value) AS value FROM events GROUP BY 1, 2), l AS (SELECT tx, max(tx_pos) + 1 AS length FROM c GROUP BY 1)"


def _tx_cov(v):
    c = v("events").groupBy(F.col("event_type").alias("tx"), F.col("user_id").alias("tx_pos")).agg(F.sum("value").alias("value"))
    return c, c.groupBy("tx").agg((F.max("tx_pos") + 1).alias("length"))


@query("meta_align_left", f'WITH {_COV} SELECT tx_pos AS "offset", sum(value) / (SELECT count(*) FROM l) AS signal FROM c WHERE tx_pos < 500 GROUP BY 1')
def _(v):
    return quant.align_profile(*_tx_cov(v), "left", 500, "mean")


@query("meta_align_right", f'WITH {_COV} SELECT tx_pos - length + 1 AS "offset", sum(value) AS signal FROM c JOIN l USING (tx) GROUP BY 1')
def _(v):
    return quant.align_profile(*_tx_cov(v), "right")


@query("meta_align_max", f'WITH {_COV}, d AS (SELECT tx, max(abs(value)) AS d FROM c GROUP BY 1 HAVING max(abs(value)) > 0) SELECT tx_pos AS "offset", sum(value / d) / (SELECT count(*) FROM d) AS signal FROM c JOIN d USING (tx) GROUP BY 1')
def _(v):
    return quant.align_profile(*_tx_cov(v), "left", norm="max")


_CV = "cv AS (SELECT chrom, strand, start AS pos, count(*) AS value FROM f GROUP BY 1, 2, 3)"
_ALONG = """k AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY tx ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum("end" - start) OVER (PARTITION BY tx) AS total FROM {pieces}),
h AS (SELECT k.tx, cv.chrom, cv.strand, cv.pos, cv.value, CAST(CASE WHEN k.strand = '-' THEN total - 1 - (before + cv.pos - k.start) ELSE before + cv.pos - k.start END AS BIGINT) AS tx_pos
  FROM k JOIN cv ON cv.chrom = k.chrom AND cv.strand {same} k.strand AND cv.pos >= k.start AND cv.pos < k."end")"""


def _cov(v):
    return _points(v).groupBy("chrom", "strand", F.col("start").alias("pos")).agg(F.count(F.lit(1)).alias("value"))


@query("meta_antisense", f"WITH {_EX}, {_POINT}, {_CV}, {_ALONG.format(pieces='x', same='<>')} SELECT tx, tx_pos, value FROM h")
def _(v):
    return quant.profile_signal(_cov(v), _exons(v).drop("gene"), antisense=True)


@query("meta_no_doubles", f"WITH {_EX}, {_POINT}, {_CV}, {_ALONG.format(pieces='x', same='=')} SELECT tx, tx_pos, value FROM (SELECT *, row_number() OVER (PARTITION BY chrom, strand, pos ORDER BY tx, tx_pos) AS n FROM h) WHERE n = 1")
def _(v):
    return quant.profile_signal(_cov(v), _exons(v).drop("gene"), doubles=False)


@query("meta_buffer", f"""WITH {_EX}, {_POINT}, {_CV}, s AS (SELECT chrom, strand, tx, min(start) AS start, max("end") AS "end" FROM x GROUP BY 1, 2, 3),
b AS (SELECT * FROM s UNION ALL SELECT chrom, strand, tx, start - 50, start FROM s UNION ALL SELECT chrom, strand, tx, "end", "end" + 50 FROM s), {_ALONG.format(pieces='b', same='=')} SELECT tx, tx_pos, value FROM h""")
def _(v):
    return quant.profile_signal(_cov(v), quant.positions_of(_exons(v), splice=False, buffer=50))


_BUCKET = "CASE WHEN allen_score <= 2 THEN '0-2' WHEN allen_score <= 4 THEN '2-4' ELSE '4-6' END"


@query("meta_distance_score", f"""WITH d AS (SELECT sample_name, target_transcript, slice_site, allen_score, CASE WHEN isnan(slice_site_rpm) THEN NULL ELSE slice_site_rpm END AS rpm FROM detected_sites WHERE sample_name IS NOT NULL AND target_transcript IS NOT NULL AND slice_site IS NOT NULL),
c AS (SELECT sample_name, target_transcript, slice_site AS pos, sum(rpm) AS value FROM d GROUP BY 1, 2, 3),
s AS (SELECT *, {_BUCKET} AS bucket FROM d WHERE allen_score BETWEEN 0 AND 6 AND NOT isnan(allen_score)), a AS (SELECT * FROM s UNION ALL SELECT * REPLACE ('0-6' AS bucket) FROM s),
o AS (SELECT unnest(range(-50, 51)) AS diff),
m AS (SELECT a.sample_name, a.bucket, o.diff, avg(coalesce(c.value, 0)) AS mean FROM a CROSS JOIN o LEFT JOIN c ON c.sample_name = a.sample_name AND c.target_transcript = a.target_transcript AND c.pos = a.slice_site + o.diff GROUP BY 1, 2, 3)
SELECT bucket, CAST(diff AS INTEGER) AS diff, avg(mean) AS mean, coalesce(stddev_samp(mean), 0) AS sd FROM m GROUP BY 1, 2""")
def _(v):
    """The profile around sites of each range of scores and of all of them, for every sample, then mean and deviation over samples."""
    d = v("detected_sites").where("sample_name is not null and target_transcript is not null and slice_site is not null").select("sample_name", F.concat_ws("|", "sample_name", "target_transcript").alias("ref"), F.col("slice_site").alias("pos"), "allen_score", F.nanvl("slice_site_rpm", F.lit(None)).alias("value"))
    s = d.where("allen_score between 0 and 6 and not isnan(allen_score)")
    own = F.when(F.col("allen_score") <= 2, "0-2").when(F.col("allen_score") <= 4, "2-4").otherwise("4-6")
    s = s.select("sample_name", "ref", "pos", F.explode(F.array(own, F.lit("0-6"))).alias("bucket"))
    profile = quant.distance_profile_by(s, d, ["sample_name", "bucket"])
    return profile.groupBy("bucket", "diff").agg(F.avg("mean").alias("mean"), F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("sd"))


# --- values of features ---

@query("sig_byrank", f"""WITH {_ISLAND}, r AS (SELECT *, row_number() OVER t AS n, sum(value) OVER (t ROWS UNBOUNDED PRECEDING) AS run, sum(value) OVER (PARTITION BY chrom, strand, start) AS total FROM x WINDOW t AS (PARTITION BY chrom, strand, start ORDER BY value DESC, pos DESC)),
e AS (SELECT *, min(CASE WHEN run >= total * 0.9 - 1e-9 THEN n END) OVER (PARTITION BY chrom, strand, start) AS enough FROM r), l AS (SELECT *, max(CASE WHEN n = enough THEN value END) OVER (PARTITION BY chrom, strand, start) AS least FROM e)
SELECT chrom, strand, start, "end", string_agg(CAST(pos - start AS VARCHAR), ',' ORDER BY n) AS score FROM l WHERE value >= least GROUP BY 1, 2, 3, 4""")
def _(v):
    return signal.feature_score(_inside(v), "byrank")


@query("sig_allvalues", f"""WITH {_ISLAND}, r AS (SELECT *, value / sum(value) OVER (PARTITION BY chrom, strand, start) AS s FROM x)
SELECT chrom, strand, start, "end", coalesce(string_agg(CAST(pos - start AS VARCHAR) || ':' || CAST(CAST(round(s, 2) AS DOUBLE) AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE s >= 0.01 AND round(s, 2) > 0), '0:0') AS score FROM r GROUP BY 1, 2, 3, 4""")
def _(v):
    return signal.feature_score(_inside(v), "allvalues")


@query("sig_rpm", f"""WITH {_ISLAND} SELECT chrom, strand, start, "end", round(sum(value) * 1e6 / 12345678, 2) AS score FROM x GROUP BY 1, 2, 3, 4""")
def _(v):
    return signal.feature_score(_inside(v), "rpm", 12_345_678).withColumn("score", F.col("score").cast("double"))


# --- reads, names, labels ---

@query("rd_untemplated", """WITH m AS (SELECT l_returnflag AS chrom, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_partkey AS pos, 0.5 AS weight, substr('ACGT', l_linenumber % 4 + 1, 1) AS nuc, count(*) OVER (PARTITION BY l_orderkey) AS n_map FROM lineitem)
SELECT chrom, strand, pos, nuc, CAST(sum(CASE WHEN n_map = 1 THEN 1 ELSE weight END) AS DOUBLE) AS n FROM m GROUP BY 1, 2, 3, 4""")
def _(v):
    from pyspark.sql import Window

    m = v("lineitem").select(F.col("l_returnflag").alias("chrom"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), F.col("l_partkey").alias("pos"), F.lit(0.5).alias("weight"),
                             F.expr("substring('ACGT', cast(l_linenumber % 4 + 1 as int), 1)").alias("nuc"), F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("n_map"))
    return reads.untemplated_counts(m)


@query("rd_first", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1000")
def _(v):
    """A limit that is the feature: a trial on the first reads."""
    return reads.first_reads(v("lineitem").select("l_orderkey", "l_linenumber"), 1000, ["l_orderkey", "l_linenumber"])


@query("cls_label_counts", _TREE + "SELECT f.chrom, lab.label, count(*) AS n FROM lab JOIN f USING (fid) WHERE label IN ('P', 'I', 'U', 'D') GROUP BY 1, 2")
def _(v):
    labelled = annotation.keep_labels(annotation.classify(_points(v), _exons(v)))
    return labelled.join(_points(v).select("fid", "chrom"), "fid").groupBy("chrom", "label").agg(F.count(F.lit(1)).alias("n"))


@query("tx_named", f"""WITH {_EX} SELECT gene, tx, start, "end" + 1 AS "end", '5P.' || row_number() OVER (PARTITION BY strand ORDER BY chrom, start, "end", gene, tx) AS name FROM x""")
def _(v):
    named = annotation.name_in_order(_exons(v), "5P", ["strand"], ["chrom", "start", "end", "gene", "tx"])
    return annotation.buffer_right(named).select("gene", "tx", "start", "end", "name")


@query("st_interaction_spine", f"""WITH {_SITES}, k AS (SELECT sample_name, family, target_transcript, family || ':' || target_transcript AS interaction, CASE WHEN isnan(slice_site_rpm) THEN NULL ELSE slice_site_rpm END AS rpm, fold_change FROM d WHERE NOT control AND target_transcript IS NOT NULL AND sample_name IS NOT NULL),
sp AS (SELECT DISTINCT interaction, family, target_transcript FROM k WHERE fold_change > 1), sa AS (SELECT DISTINCT sample_name FROM k), su AS (SELECT sample_name, interaction, sum(rpm) AS rpm FROM k GROUP BY 1, 2),
t AS (SELECT DISTINCT substr(srna, 1, 6) AS f, targetagi AS a FROM srna_targets WHERE lower(trim(validated)) = 'yes')
SELECT sp.interaction, sa.sample_name, least(5, coalesce(su.rpm, 0)) AS value, EXISTS (SELECT 1 FROM t WHERE t.f = substr(sp.family, 1, 6) AND t.a = split_part(sp.target_transcript, '.', 1)) AS validated
FROM sp CROSS JOIN sa LEFT JOIN su ON su.sample_name = sa.sample_name AND su.interaction = sp.interaction""")
def _(v):
    """Every interaction with a fold change above 1 in any sample, in every sample: its signal up to 5 (0 without any), and whether it is validated."""
    s = _sites(v).where("not control and target_transcript is not null and sample_name is not null").withColumn("interaction", F.concat("family", F.lit(":"), "target_transcript"))
    spine = s.where("fold_change > 1").select("interaction", F.substring("family", 1, 6).alias("f"), F.substring_index("target_transcript", ".", 1).alias("a")).distinct()
    samples = s.select("sample_name").distinct().agg(F.collect_list("sample_name").alias("samples"))  # one row, as long as the study has samples
    t = v("srna_targets").where(F.lower(F.trim("validated")) == "yes").select(F.substring("srna", 1, 6).alias("f"), F.col("targetagi").alias("a")).distinct().withColumn("validated", F.lit(True))
    each = spine.join(t, ["f", "a"], "left").crossJoin(F.broadcast(samples)).select("interaction", F.coalesce("validated", F.lit(False)).alias("validated"), F.explode("samples").alias("sample_name"))
    sums = s.groupBy("sample_name", "interaction").agg(F.sum(F.nanvl("slice_site_rpm", F.lit(None))).alias("rpm"))
    return each.join(sums, ["sample_name", "interaction"], "left").select("interaction", "sample_name", F.least(F.lit(5.0), F.coalesce("rpm", F.lit(0.0))).alias("value"), "validated")


@query("st_votes", "SELECT target_transcript || ':' || slice_site AS site, count(DISTINCT sample_name) AS samples FROM detected_sites WHERE adj_p_val < 0.05 AND target_transcript IS NOT NULL AND slice_site IS NOT NULL GROUP BY 1 HAVING count(DISTINCT sample_name) >= 2")
def _(v):
    d = v("detected_sites").where("adj_p_val < 0.05 and target_transcript is not null and slice_site is not null")
    return d.groupBy(F.concat("target_transcript", F.lit(":"), F.col("slice_site").cast("string")).alias("site")).agg(F.countDistinct("sample_name").alias("samples")).where("samples >= 2")


@query("q_scale_tables", """WITH q AS (SELECT tx, CAST(count(*) AS DOUBLE) AS reads, CAST(sum("end" - start) AS BIGINT) AS length FROM v_exon GROUP BY 1),
b AS (SELECT *, reads * 1000 / length * 1e6 / sum(reads * 1000 / length) OVER () AS norm FROM q WHERE length > 0)
SELECT 200 * 1e6 / sum(length * norm) * sum(reads) / (SELECT count(*) FROM orders) AS scale FROM b WHERE reads > 0 AND norm > 0""")
def _(v):
    q = v("v_exon").groupBy("tx").agg(F.count(F.lit(1)).cast("double").alias("reads"), F.sum(F.col("end") - F.col("start")).alias("length")).where("length > 0")
    body = quant.normalise(q).withColumn("norm", F.col("tpm"))
    end = v("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("reads")).withColumn("norm", F.lit(1.0))
    return quant.scale_ratio_tables(end, body)


@query("seq_motif_tiles", f"WITH {_SEQ}, p AS (SELECT doc_id, seq, unnest(range(1, length(seq) - 6)) AS i FROM s) SELECT doc_id AS chrom, i - 1 AS start, i + 7 AS \"end\", '+' AS strand FROM p WHERE {_MISS} <= 1 UNION ALL SELECT doc_id, i - 1, i + 7, '-' FROM p WHERE {_MISS_BACK} <= 1")
def _(v):
    return genome.motif_scan(genome.tiles(_genome(v), 64), "GTYRACGA", 1, 64)


# --- sequence bias ---

def _reads(v):
    return v("anno_mirna").where("sequence is not null").select("rec_id", F.regexp_replace(F.upper("sequence"), "[^ACGTU]", "").alias("seq"))


_READS = "rs AS (SELECT rec_id, regexp_replace(upper(sequence), '[^ACGTU]', '', 'g') AS s FROM anno_mirna WHERE sequence IS NOT NULL)"
_FREQ = "kf AS (SELECT p AS rel_pos, substr(s, p + 1, 2) AS kmer, count(*) / sum(count(*)) OVER (PARTITION BY p) AS freq FROM (SELECT substr(s, 1, 10) AS s, unnest(range(0, 9)) AS p FROM rs) WHERE length(substr(s, p + 1, 2)) = 2 GROUP BY 1, 2)"


@query("bias_deviation", f"""WITH {_READS}, {_FREQ}, al AS (SELECT rel_pos, i, substr(kmer, i, 1) AS base, sum(freq) AS f FROM (SELECT *, unnest([1, 2]) AS i FROM kf) GROUP BY 1, 2, 3),
sp AS (SELECT rel_pos, base, sqrt(greatest(sum(f * f) / 2 - pow(sum(f) / 2, 2), 0)) AS d FROM al GROUP BY 1, 2) SELECT CAST(rel_pos AS INTEGER) AS rel_pos, sum(d) / 4 AS deviation FROM sp GROUP BY 1""")
def _(v):
    return bias.allele_deviation(bias.kmer_bias(_reads(v), 2, 10), 2)


@query("bias_grouped_weight", f"""WITH {_READS}, {_FREQ}, bl AS (SELECT kmer, count(*) / sum(count(*)) OVER () AS freq FROM (SELECT substr(s, i, 2) AS kmer FROM (SELECT s, unnest(range(1, length(s))) AS i FROM rs)) GROUP BY 1),
tl AS (SELECT rec_id, g, t AS rel_pos, substr(s, t + 1, 2) AS kmer FROM rs, (VALUES (0, 0), (0, 4), (1, 2)) v(g, t)),
mg AS (SELECT rec_id, g, avg(bl.freq / kf.freq) AS m FROM tl JOIN kf USING (rel_pos, kmer) JOIN bl USING (kmer) GROUP BY 1, 2)
SELECT rs.rec_id, coalesce(w, 1) AS weight FROM rs LEFT JOIN (SELECT rec_id, exp(sum(ln(m))) AS w FROM mg GROUP BY 1) USING (rec_id)""")
def _(v):
    s = _reads(v)
    return bias.grouped_weight(s, bias.kmer_bias(s, 2, 10), bias.baseline_kmers(s, 2), [[0, 4], [2]], "rec_id", 2)


@query("bias_correct")
def _(v):
    return bias.correct_bias(_reads(v), "rec_id", 2, 10, fold=1.2)


# --- formats: written, then read by the reader ---

def round_trip(name, sql):
    def add(f):
        QUERIES[name] = lambda spark, sf: f(spark, lambda v: view(spark, sf, v), shared_folder(spark, name))
        SQL[name] = with_views(sql)
        return f
    return add


_FQ = "fq AS (SELECT doc_id, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM documents), fr AS (SELECT 'r' || doc_id AS read_id, seq, repeat('@', length(seq)) AS qual, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM fq WHERE length(seq) > 0)"


def _fastq(v):
    s = v("documents").select("doc_id", F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "").alias("seq")).where("length(seq) > 0")
    return s.orderBy("doc_id").select(F.concat(F.lit("r"), "doc_id").alias("read_id"), "seq", F.lit("+").alias("plus"), F.expr("repeat('@', length(seq))").alias("qual"))


@round_trip("io_fastq_round_trip", f"WITH {_FQ} SELECT read_id, seq, qual, number FROM fr")
def _(spark, v, path):
    sinks.write_fastq(_fastq(v).coalesce(1), path)
    return formats.read_fastq(spark, path).select("read_id", "seq", "qual", "number")


@round_trip("io_fastq_pairs", f"WITH {_FQ} SELECT a.read_id, b.seq AS seq2 FROM fr a JOIN fr b ON b.number = a.number + 1 WHERE a.number % 2 = 0 AND length(a.seq) >= 12 AND length(b.seq) >= 12")
def _(spark, v, path):
    sinks.write_fastq(_fastq(v).coalesce(1), path)
    return formats.filter_pairs(*formats.split_interleaved(formats.read_fastq(spark, path)), 12).select("read_id", "seq2")


@round_trip("io_multi_bedgraph", "SELECT chrom, pos AS start, pos + 1 AS \"end\", sample AS key, value FROM v_sample WHERE strand = '+' AND value > 0")
def _(spark, v, path):
    wide = v("v_sample").where("strand = '+'").groupBy("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")).pivot("sample", ["s0", "s1", "s2"]).agg(F.sum("value")).na.fill(0)
    sinks.write_multi_bedgraph(wide, ["s0", "s1", "s2"], path)
    return formats.read_multi_bedgraph(spark, path)


@round_trip("io_bed12", "SELECT 'c' AS chrom, '+' AS strand, CAST(event_id AS VARCHAR) AS tx, CAST(n AS INTEGER) AS number, start + (n - 1) * 200 AS start, start + (n - 1) * 200 + 50 AS \"end\" FROM (SELECT event_id, start, unnest([1, 2, 3]) AS n FROM v_feat)")
def _(spark, v, path):
    line = F.concat_ws("\t", F.lit("c"), "start", F.col("start") + 450, "event_id", F.lit("0"), F.lit("+"), "start", "start", F.lit("0"), F.lit("3"), F.lit("50,50,50,"), F.lit("0,200,400,"))
    v("v_feat").select(line.alias("value")).write.text(path)
    return formats.read_bed12(spark, path)


@round_trip("io_wig", "SELECT chrom, pos, value FROM v_end WHERE strand = '+'")
def _(spark, v, path):
    sinks.write_wig(v("v_end").where("strand = '+'").select("chrom", "pos", F.col("value").cast("double").alias("value")), path)
    return formats.read_wig(spark, path)


@round_trip("io_quant_table", "SELECT CAST(o_custkey AS VARCHAR) AS gene, CAST(count(*) AS DOUBLE) AS reads, CAST(100 AS BIGINT) AS length FROM orders GROUP BY 1")
def _(spark, v, path):
    v("orders").groupBy(F.col("o_custkey").cast("string").alias("gene")).agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws("\t", "gene", "n", F.lit("100"), F.lit("0.5"), F.lit("0.25")).alias("value")).write.text(path)
    return formats.read_quant(spark, path).select("gene", "reads", "length")


@round_trip("io_bed_by_name", "SELECT CAST(user_id AS VARCHAR) AS name, arg_max(start, (start, \"end\")) AS start, arg_max(\"end\", (start, \"end\")) AS \"end\" FROM v_feat GROUP BY 1")
def _(spark, v, path):
    sinks.write_bed(v("v_feat").withColumn("name", F.col("user_id")), path)
    bed = formats.read_bed(spark, path)
    return formats.bed_by_name(bed.withColumn("o", F.struct("start", "end")), "o")


@round_trip("io_sam_lengths", "SELECT 'c' || p_partkey AS chrom, p_partkey * 10 AS length FROM part")
def _(spark, v, path):
    v("part").select(F.concat(F.lit("@SQ\tSN:c"), "p_partkey", F.lit("\tLN:"), F.col("p_partkey") * 10).alias("value")).write.text(path)
    return reads.sam_lengths(spark.read.text(path))


@round_trip("io_junction_bed", "SELECT 'c' AS chrom, l_partkey AS start, l_partkey + l_suppkey + 1 AS \"end\", l_partkey || '-' || (l_partkey + l_suppkey) AS name, '+' AS strand, count(*) AS score FROM lineitem GROUP BY 1, 2, 3, 4, 5")
def _(spark, v, path):
    j = v("lineitem").select(F.lit("c").alias("chrom"), F.col("l_partkey").alias("left"), (F.col("l_partkey") + F.col("l_suppkey")).alias("right"), F.lit("+").alias("strand"), F.lit(1).alias("n"))
    sinks.write_bed(sinks.junction_bed(j), path)
    return formats.read_bed(spark, path).select("chrom", "start", "end", "name", "strand", F.col("score").cast("bigint").alias("score"))


@round_trip("io_gff_quoted", "SELECT event_id, 'a; b ' || event_id AS note FROM v_feat")
def _(spark, v, path):
    """Attributes with a semicolon inside quotes."""
    line = F.concat_ws("\t", F.lit("c"), F.lit("s"), F.lit("exon"), F.lit("1"), F.lit("2"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID="), "event_id", F.lit(';Note="a; b '), "event_id", F.lit('"')))
    v("v_feat").select(line.alias("value")).write.text(path)
    g = formats.read_gff(spark, path)
    return g.select(F.col("attributes")["ID"].cast("bigint").alias("event_id"), F.col("attributes")["Note"].alias("note"))


@query("rd_duplicated", "SELECT l_orderkey, CAST(l_quantity / 10 AS DOUBLE) AS weight, count(*) AS n FROM (SELECT l_orderkey, l_quantity, unnest(range(0, CAST(round_even(l_quantity / 10.0, 0) AS BIGINT))) FROM lineitem) GROUP BY 1, 2")
def _(v):
    r = v("lineitem").select("l_orderkey", (F.col("l_quantity") / 10).cast("double").alias("weight"))
    return sinks.duplicate_by_weight(r).groupBy("l_orderkey", "weight").agg(F.count(F.lit(1)).alias("n"))


@query("rd_min_match", """WITH m AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS n, count(*) OVER (PARTITION BY l_orderkey) AS n_map FROM lineitem)
SELECT l_orderkey, l_linenumber FROM m WHERE CASE WHEN n_map = 1 THEN n > 16 ELSE n >= 16 END""")
def _(v):
    from pyspark.sql import Window

    r = v("lineitem").select("l_orderkey", "l_linenumber", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("l_quantity").cast("bigint").alias("end"))).alias("segments"), F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("n_map"))
    return reads.min_match(r, 16).select("l_orderkey", "l_linenumber")


@query("rd_untemplated_filter", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' AND substr('ACGTGG', l_linenumber % 6 + 1, 1) = 'G' OR l_linestatus <> 'O' AND l_linenumber % 6 = 1""")
def _(v):
    """Reads with one clipped letter: at the left on +, and its complement at the right on -."""
    letter = F.expr("substring('ACGTGG', cast(l_linenumber % 6 + 1 as int), 1)")
    plus = F.col("l_linestatus") == "O"
    r = v("lineitem").select("l_orderkey", "l_linenumber", F.when(plus, "+").otherwise("-").alias("strand"), F.when(plus, "1S4M").otherwise("4M1S").alias("cigar"), F.when(plus, F.concat(letter, F.lit("AAAA"))).otherwise(F.concat(F.lit("AAAA"), letter)).alias("seq"))
    return reads.untemplated_filter(r, "G").select("l_orderkey", "l_linenumber")


@round_trip("io_fasta_tiles", f"WITH {_SEQ} SELECT CAST(doc_id AS VARCHAR) AS chrom, CAST(unnest(range(0, (length(seq) + 15) // 16)) AS INTEGER) AS tile, unnest([substr(seq, 16 * t + 1, 16) FOR t IN range(0, (length(seq) + 15) // 16)]) AS seq FROM s WHERE length(seq) > 0")
def _(spark, v, path):
    """Sequences in lines of 10 letters, read as tiles of 16."""
    lines = F.array_join(F.regexp_extract_all("seq", F.lit(".{1,10}"), F.lit(0)), "\n")
    sinks.write_fasta(_genome(v).where("length(seq) > 0").select(F.col("chrom").alias("name"), lines.alias("seq")), path)
    return formats.read_fasta_tiles(spark, path, 16)


@round_trip("io_gtf_round_trip", f"WITH {_EX} SELECT chrom, strand, gene, tx, start, \"end\" FROM x")
def _(spark, v, path):
    sinks.write_gtf(_exons(v), path)
    return formats.gff_exons(formats.read_gff(spark, path)).select("chrom", "strand", "gene", "tx", "start", "end")


@round_trip("io_motifs", "SELECT 'm' || p_partkey AS name, 'ACGT' || p_partkey AS pattern, CAST(p_partkey % 3 AS INTEGER) AS mismatches FROM part UNION ALL SELECT 'm' || p_partkey, 'NN', 0 FROM part")
def _(spark, v, path):
    v("part").select(F.concat(F.lit("m"), "p_partkey", F.lit(" ACGT"), "p_partkey", F.lit(",NN "), F.col("p_partkey") % 3, F.lit(",0")).alias("value")).write.text(path)
    return formats.read_motifs(spark, path)


@round_trip("io_kmer_table", "SELECT CAST(n_nationkey AS INTEGER) AS rel_pos, k AS kmer, CAST(n_nationkey * f AS DOUBLE) AS freq FROM nation, (VALUES ('AA', 0.5), ('AC', 0.25)) t(k, f)")
def _(spark, v, path):
    v("nation").select(F.col("n_nationkey").alias("pos"), (F.col("n_nationkey") * 0.5).alias("AA"), (F.col("n_nationkey") * 0.25).alias("AC")).write.csv(path, header=True)
    return formats.read_kmer_table(spark, path)


@round_trip("io_duplexes", "SELECT site_id AS slice, split_part(srna, '_shuffled', 1) AS family, allen_score AS allen FROM detected_sites WHERE srna IS NOT NULL AND target_transcript IS NOT NULL AND allen_score <= 6 AND NOT isnan(allen_score) AND site_id % 10 >= 7")
def _(spark, v, path):
    d = v("detected_sites").where("srna is not null and target_transcript is not null").withColumn("ratio", F.col("site_id") % 10 / 10)
    line = F.concat_ws("\t", "srna", "target_transcript", F.lit("1"), F.lit("21"), "site_id", F.lit("-30"), F.lit("-20"), "ratio", F.coalesce(F.col("allen_score").cast("string"), F.lit("NA")), F.lit("p"), F.lit("u"), F.lit("s"), F.lit("q"))
    d.select(line.alias("value")).write.text(path)
    return formats.read_duplexes(spark, path).where("not isnan(allen)").select("slice", "family", "allen")


@round_trip("io_sample_sheet", "SELECT CAST(s_suppkey AS INTEGER) AS \"row\", 's' || s_suppkey AS sample FROM supplier WHERE s_suppkey % 2 = 0")
def _(spark, v, path):
    line = F.concat_ws(" ", "s_suppkey", F.lit("dir"), F.lit("a.fq,b.fq"), F.concat(F.lit("s"), "s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, "BODY").otherwise("5P"), F.lit("lib"), F.lit("PE"), F.lit("x,y"))
    v("supplier").select(line.alias("value")).write.text(path)
    return formats.sample_of(formats.read_sample_sheet(spark, path), sample_type="BODY").select("row", "sample")


@query("iv_keep_ids", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(v):
    ids = v("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return intervals.keep_ids(v("orders"), ids, "o_custkey").select("o_orderkey")


@query("iv_merge_collapse", _MERGE.format(op=">") + """
SELECT r.chrom, r.strand, r.start, r."end", string_agg(CAST(e.event_id AS VARCHAR), ',' ORDER BY e.event_id) AS collapsed, min(e.event_id) AS least
FROM v_feat e JOIN r ON e.chrom = r.chrom AND e.strand = r.strand AND e.start >= r.start AND e.start < r."end" GROUP BY 1, 2, 3, 4""")
def _(v):
    return intervals.merge_collapse(v("v_feat"), ["chrom", "strand"], "event_id")


@query("st_min_max", "SELECT event_id, coalesce((value - min(value) OVER (PARTITION BY event_type)) / nullif(max(value) OVER (PARTITION BY event_type) - min(value) OVER (PARTITION BY event_type), 0), 0) AS scaled FROM events")
def _(v):
    return stats.min_max(v("events"), "value", ["event_type"]).select("event_id", "scaled")


@query("st_unique_names", "SELECT site_id, common_name || CASE WHEN k > 1 THEN '.' || (k - 1) ELSE '' END AS common_name FROM (SELECT site_id, common_name, row_number() OVER (PARTITION BY common_name ORDER BY site_id) AS k FROM detected_sites WHERE common_name IS NOT NULL)")
def _(v):
    return stats.unique_names(v("detected_sites").where("common_name is not null").select("site_id", "common_name"), "common_name", ["site_id"])


@query("st_validated_prefix", """SELECT d.site_id, EXISTS (SELECT 1 FROM srna_targets t WHERE lower(trim(t.validated)) = 'yes' AND t.targetagi = split_part(d.target_transcript, '.', 1)
  AND substr(t.srna, 1, CASE WHEN d.srna LIKE 'TAS%' THEN 4 ELSE 6 END) = substr(d.srna, 1, CASE WHEN d.srna LIKE 'TAS%' THEN 4 ELSE 6 END)) AS validated FROM detected_sites d WHERE d.srna IS NOT NULL AND d.target_transcript IS NOT NULL""")
def _(v):
    """Validated targets by the first 6 letters of a small RNA's name, or 4 for TAS families."""
    t = v("srna_targets").where(F.lower(F.trim("validated")) == "yes").select("srna", F.col("targetagi").alias("agi"))
    t = t.select("agi", F.explode(F.array(F.substring("srna", 1, 4), F.substring("srna", 1, 6))).alias("prefix")).distinct().withColumn("hit", F.lit(True))
    prefix = F.when(F.col("srna").startswith("TAS"), F.substring("srna", 1, 4)).otherwise(F.substring("srna", 1, 6))
    d = v("detected_sites").where("srna is not null and target_transcript is not null").select("site_id", prefix.alias("prefix"), F.substring_index("target_transcript", ".", 1).alias("agi"))
    return d.join(t, ["prefix", "agi"], "left").select("site_id", F.coalesce("hit", F.lit(False)).alias("validated"))


@query("seq_which", f"WITH {_SEQ} SELECT doc_id, coalesce(array_to_string([i - 1 FOR i IN range(1, length(seq) + 1) IF substr(seq, i, 1) = 'G'], ','), '') AS g, CAST(length(seq) - length(replace(seq, 'G', '')) AS INTEGER) AS n FROM s")
def _(v):
    letters = F.filter(F.split("seq", ""), lambda x: x != "")
    return _genome(v).select(F.col("chrom").alias("doc_id"), F.array_join(F.transform(S.which(letters, F.lit("G")), lambda i: i.cast("string")), ",").alias("g"), (F.size(letters) - F.size(S.notwhich(letters, F.lit("G")))).alias("n"))


@query("rd_softclip_policy", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber % 6 <> 5 OR l_linestatus <> 'O' AND FALSE")
def _(v):
    """Reads clipped at the 5' end only, by letters other than N; minus reads are clipped at the 3' end here."""
    letter = F.expr("substring('ACGTGN', cast(l_linenumber % 6 + 1 as int), 1)")
    r = v("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), F.lit("1S4M").alias("cigar"), F.concat(letter, F.lit("AAAA")).alias("seq"))
    return reads.softclip_policy(r, "5p").select("l_orderkey", "l_linenumber")


@query("rd_softclip_rescue", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN '1,2' WHEN l_linenumber % 3 = 1 THEN '2' ELSE '' END AS mapped, CASE WHEN l_linenumber % 3 = 0 THEN 'A' WHEN l_linenumber % 3 = 1 THEN 'AC' ELSE 'ACG' END AS untemplated FROM lineitem""")
def _(v):
    """The clip ACG beside genomes that agree with two, one or none of its letters, from the mapped end on."""
    genome_ = F.when(F.col("l_linenumber") % 3 == 0, "TCG").when(F.col("l_linenumber") % 3 == 1, "ATG").otherwise("ACT")
    r = v("lineitem").select("l_orderkey", "l_linenumber", S.rescue_softclip(F.lit("ACG"), genome_, F.lit("left")).alias("x"))
    return r.select("l_orderkey", "l_linenumber", F.array_join(F.transform("x.mapped", lambda i: i.cast("string")), ",").alias("mapped"), F.col("x.untemplated").alias("untemplated"))


@query("rd_bed_rows", """SELECT l_orderkey, l_linenumber, l_partkey AS start, l_partkey + 9 AS "end", 'AAAA.CCC' AS sequence, 'G' AS head, 'TT' AS tail FROM lineitem""")
def _(v):
    """Reads of two segments with clips at both ends."""
    cigar = F.lit("1S4M2N3M2S")
    r = v("lineitem").select("l_orderkey", "l_linenumber", F.lit("c").alias("chrom"), F.lit("+").alias("strand"), F.lit(1.0).alias("weight"), F.struct("l_orderkey", "l_linenumber").alias("read_id"), cigar.alias("cigar"), F.lit("GAAAACCCTT").alias("seq"),
                             F.lit("AAAACCC").alias("mapped_seq"), S.cigar_segments(F.col("l_partkey"), cigar).alias("segments"))
    return sinks.read_bed_rows(r).select("read_id.l_orderkey", "read_id.l_linenumber", "start", "end", "sequence", "head", "tail")


@query("seq_substrings_of", f"WITH {_SEQ} SELECT doc_id, CAST(len(list_distinct([substr(seq, i, 4) FOR i IN range(1, length(seq) - 2)])) AS INTEGER) AS n FROM s")
def _(v):
    return _genome(v).select(F.col("chrom").alias("doc_id"), S.substrings_of(F.col("seq"), 4).alias("n"))


@query("seq_simplify", "SELECT doc_id, lower(regexp_replace(text, '[.'':,\\-;_!/\"\\n\\t*()?{}\\[\\]#@%$ 0-9]', '', 'g')) AS plain FROM documents WHERE text IS NOT NULL")
def _(v):
    return v("documents").where("text is not null").select("doc_id", S.simplify(F.col("text"), keep_digits=False).alias("plain"))


_BRAX = "b AS (SELECT site_id, site_id % 3 AS a, site_id % 4 AS b FROM detected_sites)"


def _structures(v):
    """Two pairs with a loop on each side: a letters on the transcript, b on the query."""
    a, b = F.col("site_id") % 3, F.col("site_id") % 4
    loop = lambda c, n: F.expr(f"repeat('{c}', cast({n} as int))")
    return v("detected_sites").select("site_id", F.concat(F.lit("("), loop(".", "site_id % 3"), F.lit("(")).alias("target"), F.concat(F.lit(")"), loop(".", "site_id % 4"), F.lit(")")).alias("query"),
                                      F.concat(F.lit("A"), loop("G", "site_id % 3"), F.lit("C")).alias("t_seq"), F.concat(F.lit("G"), loop("U", "site_id % 4"), F.lit("U")).alias("q_seq"), a.alias("a"), b.alias("b"))


@query("duplex_gaps", f"WITH {_BRAX} SELECT site_id, '(' || repeat('.', a) || repeat('-', greatest(b - a, 0)) || '(' AS target, ')' || repeat('-', greatest(a - b, 0)) || repeat('.', b) || ')' AS query, 'A' || repeat('G', a) || repeat('-', greatest(b - a, 0)) || 'C' AS t_seq, 'G' || repeat('-', greatest(a - b, 0)) || repeat('U', b) || 'U' AS q_seq FROM b")
def _(v):
    return _structures(v).select("site_id", duplex.gap_structure("target", "query", "t_seq", "q_seq").alias("g")).select("site_id", "g.*")


@query("duplex_pad", f"WITH {_BRAX} SELECT site_id, repeat('.', b) || '(' || repeat('.', a) || '(' || repeat('.', 2) AS target, '..' || ')' || repeat('.', b) || ')' || repeat('.', b) AS query, 100 - b AS t_start, CAST(202 AS BIGINT) AS t_stop FROM b")
def _(v):
    s = _structures(v)
    n = F.length("query")
    padded = duplex.pad_structure("target", "query", F.lit(100), F.lit(200), F.lit(3), n + 2, n + 2 + F.col("b"))
    return s.select("site_id", padded.alias("p")).select("site_id", "p.target", "p.query", "p.t_start", "p.t_stop")


@query("duplex_trim", f"WITH {_BRAX} SELECT site_id, repeat('.', least(a, 1)) || '(' || repeat('.', least(b, 2)) AS target, 100 + greatest(a - 1, 0) AS t_start, 200 - greatest(b - 2, 0) AS t_stop FROM b")
def _(v):
    s = v("detected_sites").select("site_id", F.expr("concat(repeat('.', cast(site_id % 3 as int)), '(', repeat('.', cast(site_id % 4 as int)))").alias("target"), F.lit("..).").alias("query"))
    return s.select("site_id", duplex.trim_structure("target", "query", F.lit(100), F.lit(200)).alias("p")).select("site_id", "p.target", "p.t_start", "p.t_stop")


@query("tx_slices", f"""WITH {_EX}, k AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY tx ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum("end" - start) OVER (PARTITION BY tx) AS t FROM x),
p AS (SELECT *, CASE WHEN strand = '-' THEN t - 400 ELSE 100 END AS lo, CASE WHEN strand = '-' THEN t - 100 ELSE 400 END AS hi FROM k)
SELECT chrom, strand, gene, tx, CAST(start + greatest(lo - b, 0) AS BIGINT) AS start, CAST(start + least(hi - b, "end" - start) AS BIGINT) AS "end" FROM p WHERE greatest(lo - b, 0) < least(hi - b, "end" - start)""")
def _(v):
    ex = _exons(v)
    return annotation.slice_transcripts(ex, ex.select("tx").distinct().select("tx", F.lit(100).alias("t_start"), F.lit(400).alias("t_end")))


_WIDE = signal.kernel("laplace", 15, 3)


@query("sig_convolve_wide", f"SELECT chrom, strand, pos + o AS pos, sum(value * w) AS value FROM v_end, {kernel_sql(_WIDE)} WHERE pos + o >= 0 GROUP BY 1, 2, 3 HAVING sum(value * w) > 1e-9")
def _(v):
    """The kernel's usual width, 91 positions."""
    return signal.convolve(v("v_end"), _WIDE)


@query("duplex_best_energy", """SELECT target_transcript AS transcript, slice_site AS slice, arg_max(site_id, (1 / (1 + allen_score), -site_id)) AS query FROM detected_sites WHERE allen_score IS NOT NULL AND NOT isnan(allen_score) GROUP BY 1, 2""")
def _(v):
    d = v("detected_sites").where("allen_score is not null and not isnan(allen_score)").select(F.col("site_id").alias("query"), F.col("target_transcript").alias("transcript"), F.col("slice_site").alias("slice"), (1 / (1 + F.col("allen_score"))).alias("mfe_ratio"))
    return genome.best_duplex(d, "energy").select("transcript", "slice", "query")


@query("cmp_capped_features", f"""WITH {_ISLAND}, t AS (SELECT x.chrom, x.strand, x.start, x."end", sum(x.value) AS total, sum(coalesce(u.value, 0)) AS uug FROM x LEFT JOIN v_uug u ON x.chrom = u.chrom AND x.strand = u.strand AND x.pos = u.pos GROUP BY 1, 2, 3, 4),
b AS (SELECT unnest(range(0, 101)) AS bin), h AS (SELECT b.bin, count(t.total) AS n FROM b LEFT JOIN t ON b.bin = least(floor(uug / total * 100), 100) WHERE b.bin < 25 GROUP BY 1), c AS (SELECT avg(bin) / 100 AS cutoff FROM h WHERE n = (SELECT min(n) FROM h))
SELECT chrom, strand, start, "end", uug / total AS share, uug / total >= (SELECT cutoff FROM c) AS capped FROM t WHERE total >= 1""")
def _(v):
    """Features of the end library parted by their share of untemplated G, at the cutoff that the shares themselves suggest."""
    f = signal.islands(v("v_end"), 47, 2)
    by = ["chrom", "strand", "start", "end"]
    uug = signal.in_features(v("v_uug"), f).groupBy(*by).agg(F.sum("value").alias("uug"))
    totals = signal.in_features(v("v_end"), f).groupBy(*by).agg(F.sum("value").alias("total")).join(uug, by, "left").na.fill(0.0, ["uug"])
    cutoff = annotation.auto_cutoff(totals)
    split = totals.where("total >= 1").withColumn("share", F.col("uug") / F.col("total")).crossJoin(F.broadcast(cutoff))  # one row
    return split.select(*by, "share", (F.col("share") >= F.col("cutoff")).alias("capped"))


@query("rd_trimmed", """WITH r AS (SELECT doc_id, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS s FROM documents),
c AS (SELECT doc_id, s, CASE WHEN instr(s, 'ACTG') > 0 THEN instr(s, 'ACTG') WHEN right(s, 3) = 'ACT' AND length(s) >= 3 THEN length(s) - 2 WHEN instr(s, 'TTT') > 0 THEN instr(s, 'TTT') ELSE 0 END AS a FROM r)
SELECT doc_id, CASE WHEN a > 0 THEN substr(s, 1, a - 1) ELSE s END AS seq FROM c WHERE length(CASE WHEN a > 0 THEN substr(s, 1, a - 1) ELSE s END) >= 16""")
def _(v):
    fq = _genome(v).select(F.col("chrom").alias("doc_id"), "seq", F.col("seq").alias("qual"))
    return formats.trim_adapter(fq, ["ACTG", "TTT"], 16).select("doc_id", "seq")


@query("tx_end_group_table", f"""WITH {_EX}, t AS (SELECT chrom, strand, gene, tx, min(start) AS start, max("end") AS "end", CASE WHEN strand = '-' THEN -min(start) ELSE max("end") END AS e FROM x GROUP BY 1, 2, 3, 4),
n AS (SELECT *, CASE WHEN e - lag(e) OVER (PARTITION BY chrom, strand, gene ORDER BY e, tx) <= 50 THEN 0 ELSE 1 END AS new FROM t),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY chrom, strand, gene ORDER BY e, tx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp, abs(e) AS place FROM n)
SELECT chrom, strand, gene, grp AS "group", string_agg(tx, ',' ORDER BY tx) AS txs, min(place) AS first, max(place) AS last FROM g GROUP BY 1, 2, 3, 4""")
def _(v):
    """Groups of 3' ends."""
    return genome.end_group_table(annotation.transcripts(_exons(v)), 50, "3p")


@query("rd_size_class_table", "SELECT l_partkey, count(*) FILTER (WHERE l_quantity < 10) AS c0, count(*) FILTER (WHERE l_quantity >= 10 AND l_quantity < 30) AS c1, count(*) FILTER (WHERE l_quantity >= 30) AS c2 FROM lineitem GROUP BY 1")
def _(v):
    return reads.size_classes(v("lineitem"), F.col("l_quantity"), [10, 30], ["l_partkey"])


@query("st_histogram", "SELECT CAST(b AS INTEGER) AS bin, count(allen_score) AS n FROM (SELECT unnest(range(0, 12)) AS b) LEFT JOIN (SELECT * FROM detected_sites WHERE allen_score BETWEEN 0 AND 6 AND NOT isnan(allen_score)) d ON least(floor(allen_score * 2), 11) = b GROUP BY 1")
def _(v):
    return stats.histogram(v("detected_sites"), "allen_score", 12, 0, 6)


@query("cnt_feature_lengths", "SELECT user_id, count(*) AS length FROM (SELECT DISTINCT user_id, chrom, strand, unnest(range(start, \"end\")) AS pos FROM v_feat) GROUP BY 1")
def _(v):
    return coverage.feature_lengths(v("v_feat"), "user_id")


@round_trip("io_mate_pairs", "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS read_id, l_partkey AS pos, l_partkey + 100 AS pos2, l_linenumber % 2 = 1 AS \"primary\" FROM lineitem WHERE l_linenumber <= 2")
def _(spark, v, path):
    """Both mates of two alignments of a read, the second one secondary, paired again by the place each gives of the other."""
    li = v("lineitem").where("l_linenumber <= 2")
    extra = F.when(F.col("l_linenumber") % 2 == 1, 0).otherwise(256)
    line = lambda flag, a, b: F.concat_ws("\t", "l_orderkey", (extra + flag).cast("string"), F.lit("c"), (a + 1).cast("string"), F.lit("60"), F.lit("50M"), F.lit("="), (b + 1).cast("string"), F.lit("0"), F.lit("*"), F.lit("*"))
    p = F.col("l_partkey")
    li.select(F.explode(F.array(line(1 + 64 + 32, p, p + 100), line(1 + 128 + 16, p + 100, p))).alias("value")).write.text(path)
    # two lines of an order at the same place would be four pairs, so doubles are counted once each way
    return reads.pair_mates(formats.read_sam(spark, path)).select("read_id", "pos", "pos2", "primary").distinct()


@round_trip("io_fasta_bad_names", "SELECT 'd ' || doc_id AS name FROM documents WHERE text IS NOT NULL")
def _(spark, v, path):
    sinks.write_fasta(v("documents").where("text is not null").select(F.concat(F.lit("d "), "doc_id").alias("name"), F.lit("ACGT").alias("seq")), path)
    return formats.fasta_name_errors(spark, path)


@round_trip("io_layout_errors", "SELECT CAST(s_suppkey AS INTEGER) AS \"row\" FROM supplier WHERE s_suppkey % 2 = 1")
def _(spark, v, path):
    line = F.concat_ws(" ", "s_suppkey", F.lit("dir"), F.lit("a.fq,b.fq"), F.lit("s"), F.lit("BODY"), F.lit("lib"), F.when(F.col("s_suppkey") % 2 == 0, "PE").otherwise("SE"), F.lit("x"))
    v("supplier").select(line.alias("value")).write.text(path)
    return formats.check_layout(formats.read_sample_sheet(spark, path)).select("row")


@query("rd_softclip_bases", "SELECT l_partkey - 2 + i AS pos, ['G', 'A', 'T'][i + 1] AS base, count(*) AS n FROM (SELECT l_partkey, unnest([0, 1]) AS i FROM lineitem) GROUP BY 1, 2 UNION ALL SELECT l_partkey + 4, 'T', count(*) FROM lineitem GROUP BY 1")
def _(v):
    """Two bases clipped at the left and one at the right of four that are mapped."""
    cigar = F.lit("2S4M1S")
    bases = S.softclip_positions(cigar, F.lit("GACCCCT"), S.cigar_segments(F.col("l_partkey"), cigar))
    return v("lineitem").select(F.inline(bases)).groupBy("pos", "base").agg(F.count(F.lit(1)).alias("n"))


@round_trip("io_pileup", "SELECT l_returnflag AS chrom, l_partkey AS site, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, v, path):
    sinks.write_pileup(v("lineitem").groupBy(F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("site")).agg(F.count(F.lit(1)).alias("n")), path, ["chrom", "site", "n"])
    return spark.read.csv(path, header=True, schema="chrom string, site bigint, n bigint")
