"""Queries of the sequence, alignment and duplex functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import coverage
from helixframe.plans.views import view, with_views

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = lambda spark, sf: f(lambda v: view(spark, sf, v))
        if sql is not None:
            SQL[name] = with_views(sql)
        return f
    return add


_SEQ = "s AS (SELECT doc_id, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM documents)"
_RC = "reverse(translate({}, 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN'))"


def _seq(v):
    return v("documents").select("doc_id", F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "").alias("seq"))


@query("seq_revcomp", f"WITH {_SEQ} SELECT doc_id, {_RC.format('seq')} AS rc, translate(seq, 'ACGT', 'TGCA') AS c FROM s")
def _(v):
    return _seq(v).select("doc_id", S.revcomp(F.col("seq")).alias("rc"), S.complement(F.col("seq")).alias("c"))


@query("seq_revcomp_iupac", "SELECT doc_id, " + _RC.format("upper(regexp_replace(coalesce(text, ''), '[^ACGTURYSWKMBDHVNacgturyswkmbdhvn]', '', 'g'))") + " AS rc FROM documents")
def _(v):
    return v("documents").select("doc_id", S.revcomp(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTURYSWKMBDHVNacgturyswkmbdhvn]", "")).alias("rc"))


@query("seq_kmers", f"WITH {_SEQ}, k AS (SELECT substr(seq, i, 4) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 2)) AS i FROM s)) SELECT kmer, count(*) AS n FROM k GROUP BY 1")
def _(v):
    return _seq(v).select(F.explode(S.kmers(F.col("seq"), 4)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query("seq_all_kmers", "SELECT a || b || c AS kmer FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS a), (SELECT unnest(['A', 'C', 'G', 'T']) AS b), (SELECT unnest(['A', 'C', 'G', 'T']) AS c)")
def _(v):
    return v("region").agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*[F.lit(k) for k in S.all_kmers(3)])).alias("kmer"))


_MISS = " + ".join(f"CASE WHEN substr(seq, i + {k}, 1) IN ({', '.join(repr(b) for b in S.IUPAC[c])}) THEN 0 ELSE 1 END" for k, c in enumerate("GTYRACGA"))


_MISS_BACK = " + ".join(f"CASE WHEN substr(seq, i + {k}, 1) IN ({', '.join(repr(b) for b in S.IUPAC[c])}) THEN 0 ELSE 1 END" for k, c in enumerate("TCGTYRAC"))


@query("seq_motif_scan", f"WITH {_SEQ}, p AS (SELECT doc_id, seq, unnest(range(1, length(seq) - 6)) AS i FROM s) SELECT doc_id, CAST(i - 1 AS INTEGER) AS at, '+' AS strand FROM p WHERE {_MISS} <= 1 UNION ALL SELECT doc_id, CAST(i - 1 AS INTEGER), '-' FROM p WHERE {_MISS_BACK} <= 1")
def _(v):
    return _seq(v).select("doc_id", F.inline(S.motif_hits_both(F.col("seq"), "GTYRACGA", 1)))


@query("seq_motif_regex", f"WITH {_SEQ} SELECT doc_id, CAST(len(regexp_extract_all(seq, 'GT[CT][AG]AC')) AS INTEGER) AS n FROM s")
def _(v):
    return _seq(v).select("doc_id", F.regexp_count(F.col("seq"), F.lit(S.iupac_regex("GTYRAC"))).alias("n"))


_CODON = "map {" + ", ".join(f"'{k}': '{a}'" for k, a in S.CODONS.items()) + "}"


@query("seq_translate", f"WITH {_SEQ} SELECT doc_id, coalesce(array_to_string([({_CODON})[substr(seq, i, 3)] FOR i IN range(1, length(seq) - 1, 3)], ''), '') AS aa FROM s")
def _(v):
    return _seq(v).select("doc_id", S.translate_codons(F.col("seq")).alias("aa"))


@query("seq_degeneracy", "WITH d AS (SELECT doc_id, regexp_replace(upper(coalesce(text, '')), '[^ACGTRYN]', '', 'g') AS seq FROM documents) SELECT doc_id, coalesce(array_to_string([CASE WHEN substr(seq, i, 1) = 'N' THEN 4 WHEN substr(seq, i, 1) IN ('R', 'Y') THEN 2 ELSE 1 END FOR i IN range(1, length(seq) + 1)], ','), '') AS each FROM d")
def _(v):
    s = v("documents").select("doc_id", F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGTRYN]", "").alias("seq"))
    return s.select("doc_id", F.array_join(F.transform(S.degeneracy(F.col("seq")), lambda x: x.cast("string")), ",").alias("each"))


def orf_sql(table: str) -> str:
    """``orf``: the longest reading frame of ``seq`` of each ``doc_id`` of ``table``."""
    return f"""fr AS (SELECT doc_id, f, coalesce(array_to_string([({_CODON})[substr(seq, i, 3)] FOR i IN range(f + 1, length(seq) - 1, 3)], ''), '') AS aa FROM (SELECT doc_id, seq, unnest([0, 1, 2]) AS f FROM {table})),
pt AS (SELECT doc_id, f, aa, i, part, sum(length(part) + 1) OVER (PARTITION BY doc_id, f ORDER BY i) - length(part) - 1 AS ahead FROM (SELECT doc_id, f, aa, unnest(string_split(aa, '*')) AS part, generate_subscripts(string_split(aa, '*'), 1) AS i FROM fr)),
mt AS (SELECT *, instr(part, 'M') AS m FROM pt),
rk AS (SELECT doc_id, substr(part, m) AS aa, f + 3 * (ahead + m - 1) AS start, ahead + length(part) >= length(aa) AS stopless, f + 3 * (ahead + length(part)) AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY length(part) - m DESC, f, i) AS n FROM mt WHERE m > 0),
orf AS (SELECT d.doc_id, coalesce(rk.aa, '') AS aa, CAST(coalesce(start, 0) AS INTEGER) AS start, CAST(coalesce(stop + CASE WHEN stopless THEN 0 ELSE 3 END, 0) AS INTEGER) AS "end", coalesce(stopless, false) AS stopless FROM (SELECT doc_id FROM {table}) d LEFT JOIN rk ON rk.doc_id = d.doc_id AND rk.n = 1)"""


@query("seq_orf", f"WITH {_SEQ}, {orf_sql('s')} SELECT * FROM orf")
def _(v):
    return _seq(v).select("doc_id", S.longest_orf("seq").alias("o")).select("doc_id", "o.aa", "o.start", "o.end", "o.stopless")


# common prefixes of neighbouring sorted suffixes
_LCP = """sf AS (SELECT doc_id, substr(seq, i) AS t FROM (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM s)),
nb AS (SELECT doc_id, t, lag(t) OVER (PARTITION BY doc_id ORDER BY t) AS p FROM sf),
lc AS (SELECT doc_id, coalesce(len([k FOR k IN range(1, least(length(t), length(p)) + 1) IF substr(t, 1, k) = substr(p, 1, k)]), 0) AS l FROM nb),
ic AS (SELECT s.doc_id, s.seq, coalesce(round(c, 4), 0) AS complexity FROM s LEFT JOIN (SELECT doc_id, sum(ln((l + 2) / (l + 1))) / ln(5) AS c FROM lc GROUP BY 1) USING (doc_id))"""


@query("seq_icomplexity", f"WITH {_SEQ}, {_LCP} SELECT doc_id, complexity FROM ic")
def _(v):
    return _seq(v).select("doc_id", S.icomplexity("seq").alias("complexity"))


@query("seq_complexity_filter", f"WITH {_SEQ}, {_LCP} SELECT doc_id, seq FROM ic WHERE length(seq) > 0 AND complexity / length(seq) >= 0.3")
def _(v):
    return _seq(v).where("length(seq) > 0").where(S.icomplexity("seq") / F.length("seq") >= 0.3).select("doc_id", "seq")


@query("seq_complexity_table", f"WITH {_SEQ}, {_LCP} SELECT round_even(complexity / length(seq), 2) AS bin, count(*) AS n FROM ic WHERE length(seq) > 0 GROUP BY 1")
def _(v):
    return _seq(v).where("length(seq) > 0").groupBy(F.bround(S.icomplexity("seq") / F.length("seq"), 2).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("seq_distinct_substrings", f"""WITH {_SEQ}, b AS (SELECT doc_id, substr(seq, i, k) AS t FROM (SELECT doc_id, seq, i, unnest(range(1, length(seq) - i + 2)) AS k FROM (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM s)))
SELECT s.doc_id, coalesce(n, 0) AS n FROM s LEFT JOIN (SELECT doc_id, count(DISTINCT t) AS n FROM b GROUP BY 1) USING (doc_id)""")
def _(v):
    return _seq(v).select("doc_id", S.substring_count("seq").alias("n"))


@query("seq_shuffle", """WITH r AS (SELECT rec_id, unnest(range(1, 4)) AS set_id, sequence FROM anno_mirna WHERE sequence IS NOT NULL)
SELECT rec_id, CAST(set_id AS INTEGER) AS set_id, coalesce(array_to_string([x.c FOR x IN list_sort([{'k': md5((7 + set_id) || '|' || sequence || '|' || i), 'c': substr(sequence, i, 1)} FOR i IN range(1, length(sequence) + 1)])], ''), '') AS shuffled FROM r""")
def _(v):
    return v("anno_mirna").where("sequence is not null").select("rec_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("set_id"), "sequence").select("rec_id", "set_id", S.shuffle_sequence(F.col("sequence"), F.col("set_id") + 7).alias("shuffled"))


@query("seq_gc", f"WITH {_SEQ} SELECT doc_id, length(regexp_replace(seq, '[^GC]', '', 'g')) / nullif(length(seq), 0) AS gc FROM s")
def _(v):
    return _seq(v).select("doc_id", S.gc_content(F.col("seq")).alias("gc"))


@query("seq_min_length", f"WITH {_SEQ} SELECT doc_id, seq FROM s WHERE length(seq) >= 16")
def _(v):
    return _seq(v).where("length(seq) >= 16")


@query("seq_lengths", f"WITH {_SEQ} SELECT CAST(sum(length(seq)) AS BIGINT) AS total, CAST(least(14, floor(log2(sum(length(seq))) / 2 - 1)) AS BIGINT) AS index_size, count(*) AS n FROM s")
def _(v):
    return _seq(v).agg(F.sum(F.length("seq")).alias("total"), F.least(F.lit(14), F.floor(F.log2(F.sum(F.length("seq"))) / 2 - 1)).alias("index_size"), F.count(F.lit(1)).alias("n"))


# --- alignments ---

_CIGAR = "concat(l_linenumber, 'S', CAST(l_quantity AS INTEGER), 'M', l_suppkey, 'N20M')"


def _cigar(v):
    return v("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("pos"), F.expr(_CIGAR).alias("cigar"))


@query("cigar_segments", """
SELECT l_orderkey, l_linenumber, l_partkey AS seg_start, l_partkey + CAST(l_quantity AS BIGINT) AS seg_end FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey + CAST(l_quantity AS BIGINT) + l_suppkey, l_partkey + CAST(l_quantity AS BIGINT) + l_suppkey + 20 FROM lineitem""")
def _(v):
    return _cigar(v).select("l_orderkey", "l_linenumber", F.inline(S.cigar_segments(F.col("pos"), F.col("cigar")))).toDF("l_orderkey", "l_linenumber", "seg_start", "seg_end")


@query("cigar_junctions", "SELECT l_partkey + CAST(l_quantity AS BIGINT) AS l, l_partkey + CAST(l_quantity AS BIGINT) + l_suppkey - 1 AS r, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(v):
    return _cigar(v).select(F.inline(S.cigar_junctions(F.col("pos"), F.col("cigar")))).groupBy(F.col("left").alias("l"), F.col("right").alias("r")).agg(F.count(F.lit(1)).alias("n"))


@query("cigar_coverage", """SELECT pos, count(*) AS n FROM (SELECT unnest(range(l_partkey, l_partkey + CAST(l_quantity AS BIGINT))) AS pos FROM lineitem
  UNION ALL SELECT unnest(range(l_partkey + CAST(l_quantity AS BIGINT) + l_suppkey, l_partkey + CAST(l_quantity AS BIGINT) + l_suppkey + 20)) FROM lineitem) GROUP BY 1""")
def _(v):
    segments = _cigar(v).select(F.lit(0).alias("all"), F.inline(S.cigar_segments(F.col("pos"), F.col("cigar"))), F.lit(1).alias("value"))
    return coverage.expand_runs(segments, ["all"]).select("pos", F.col("value").alias("n"))


@query("cigar_softclip", "SELECT l_linenumber AS clip, count(*) AS n FROM lineitem GROUP BY 1")
def _(v):
    return _cigar(v).groupBy(S.softclip(F.col("cigar"), "left").alias("clip")).agg(F.count(F.lit(1)).alias("n"))


@query("sam_flags", "SELECT " + ", ".join(f"(l_partkey & {1 << i}) <> 0 AS {n}" for i, n in enumerate(S.FLAG_BITS)) + ", count(*) AS n FROM lineitem GROUP BY ALL")
def _(v):
    return v("lineitem").select(S.flag_bits(F.col("l_partkey")).alias("f")).groupBy(*[f"f.{n}" for n in S.FLAG_BITS]).agg(F.count(F.lit(1)).alias("n"))


# --- duplexes: each small RNA against an altered perfect target ---

_DUPLEX = "r AS (SELECT rec_id, regexp_replace(sequence, '[ \\n\\r\\t]', '', 'g') AS s FROM anno_mirna), q AS (SELECT rec_id, replace(upper(s), 'T', 'U') AS q FROM r WHERE regexp_full_match(s, '[ACGTUacgtu]+')), d AS (SELECT rec_id, q, replace(translate(q, 'ACGU', 'UGCA'), 'UGA', 'UUC') AS t FROM q)"
_PAIRCOST = "CASE WHEN substr(q, i, 1) || substr(t, i, 1) IN ('AU', 'UA', 'GC', 'CG') THEN 0.0 WHEN substr(q, i, 1) || substr(t, i, 1) IN ('GU', 'UG') THEN 0.5 ELSE 1.0 END"


def _duplex(v):
    s = F.regexp_replace("sequence", "[ \\n\\r\\t]", "")
    q = v("anno_mirna").where(s.rlike("^[ACGTUacgtu]+$")).select("rec_id", F.replace(F.upper(s), F.lit("T"), F.lit("U")).alias("q"))
    return q.withColumn("t", F.replace(F.translate("q", "ACGU", "UGCA"), F.lit("UGA"), F.lit("UUC")))


@query("duplex_allen", f"WITH {_DUPLEX} SELECT rec_id, CAST(sum({_PAIRCOST} * CASE WHEN i BETWEEN 2 AND 12 THEN 2 ELSE 1 END) AS DOUBLE) AS allen FROM (SELECT *, unnest(range(1, length(q) + 1)) AS i FROM d) GROUP BY 1")
def _(v):
    return _duplex(v).select("rec_id", S.allen_score(F.col("q"), F.col("t")).alias("allen"))


@query("duplex_slice_site", f"WITH {_DUPLEX} SELECT rec_id, 1000 + rec_id - least(10, length(q)) + 1 AS slice FROM d")
def _(v):
    return _duplex(v).select("rec_id", S.slice_site(F.col("q"), F.col("t"), F.col("rec_id") + 1000).alias("slice"))


@query("duplex_pairing", f"WITH {_DUPLEX} SELECT rec_id, string_agg(CASE WHEN {_PAIRCOST} = 0 THEN '|' WHEN {_PAIRCOST} = 0.5 THEN 'o' ELSE 'x' END, '' ORDER BY i) AS marks FROM (SELECT *, unnest(range(1, length(q) + 1)) AS i FROM d) GROUP BY 1")
def _(v):
    return _duplex(v).select("rec_id", S.pairing(F.col("q"), F.col("t")).alias("marks"))


@query("duplex_qc", f"WITH {_DUPLEX} SELECT count(*) AS n FROM d WHERE length(q) BETWEEN 15 AND 26")
def _(v):
    return _duplex(v).where(S.duplex_ok(F.col("q"), F.col("t")) & F.length("q").between(15, 26)).agg(F.count(F.lit(1)).alias("n"))


@query("duplex_regions", f"""WITH {_DUPLEX}, m AS (SELECT rec_id, length(q) AS n, i, {_PAIRCOST} >= 1 AS open FROM (SELECT *, unnest(range(1, length(q) + 1)) AS i FROM d)),
g AS (SELECT rec_id, n, i, i - row_number() OVER (PARTITION BY rec_id ORDER BY i) AS g FROM m WHERE open)
SELECT rec_id, CAST(min(i) AS INTEGER) AS start, CAST(max(i) AS INTEGER) AS "end", CASE WHEN min(i) = 1 THEN 'UP5' WHEN max(i) = any_value(n) THEN 'UP3' ELSE 'SIL' END AS kind FROM g GROUP BY rec_id, g""")
def _(v):
    return _duplex(v).select("rec_id", F.inline(S.pairing_regions(F.col("q"), F.col("t"))))
