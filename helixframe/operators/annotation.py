"""Genes, transcripts and exons: terminal exons, intron chains, comparisons, classification of features.

Exons are rows of chrom, strand, gene, tx, start, end (half-open).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.intervals import _nearest_before, overlap_join
from helixframe.operators.periods import SHARD
from helixframe.operators.shards import numbered
from helixframe.session import materialize

# Labels of the classes, by code.
LABELS = {7: "S", 6: "P", 5: "D", 4: "U", 3: "I", 2: "A", 1: "IA", 0: "N"}


def transcripts(exons: DataFrame) -> DataFrame:
    """One row a transcript: bounds, exons in order, and the intron chain as text."""
    t = exons.groupBy("chrom", "strand", "gene", "tx").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons")
    )
    introns = F.zip_with(F.slice("exons", 1, F.size("exons") - 1), F.slice("exons", 2, F.size("exons")), lambda a, b: F.struct(a["end"].alias("left"), b["start"].alias("right")))
    t = t.withColumn("introns", F.when(F.size("exons") > 1, introns).otherwise(F.array().cast("array<struct<left:bigint,right:bigint>>")))
    chain = F.array_join(F.transform("introns", lambda x: F.concat_ws("-", x["left"], x["right"])), ",")
    return t.withColumn("chain", F.concat_ws(":", "chrom", "strand", chain))


def terminal_exons(exons: DataFrame) -> DataFrame:
    """The 5' exon of every transcript."""
    first = F.when(F.col("strand") == "-", F.struct((-F.col("end")).alias("k"), (-F.col("start")).alias("l"))).otherwise(F.struct(F.col("start").alias("k"), F.col("end").alias("l")))
    best = F.min_by(F.struct("start", "end"), first)
    return exons.groupBy("chrom", "strand", "gene", "tx").agg(best.alias("e")).select("chrom", "strand", "gene", "tx", "e.start", "e.end")


def single_exon_genes(exons: DataFrame) -> DataFrame:
    """Exons of the genes whose transcripts all have one exon."""
    sizes = exons.groupBy("gene", "tx").agg(F.countDistinct("start", "end").alias("n")).groupBy("gene").agg(F.max("n").alias("n")).where("n = 1")
    return exons.join(sizes.select("gene"), "gene", "left_semi").select(*exons.columns)


def _overlaps(a: str, b: str) -> Column:
    return (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def compare_transcripts(t: DataFrame) -> DataFrame:
    """Pairs of overlapping transcripts of a gene, each in both orders, with how ``a`` relates to ``b``.

    ``same_chain``: equal introns.  ``truncation``: the introns of a are some
    successive ones of b, its ends lie strictly inside b's, and none of them in an
    intron of b.  ``contained``: a lies within one exon of b.  ``terminal``: the
    first or the last exons overlap.  Then the differences of the ends and counts.
    """
    a, b = t.alias("a"), t.alias("b")
    p = a.join(b, (F.col("a.gene") == F.col("b.gene")) & (F.col("a.chrom") == F.col("b.chrom")) & (F.col("a.strand") == F.col("b.strand")) & (F.col("a.tx") != F.col("b.tx")) & _overlaps("a", "b"))
    ai, bi = F.col("a.introns"), F.col("b.introns")
    shared = F.size(F.array_intersect(ai, bi))
    in_intron = F.exists(bi, lambda i: ((F.col("a.start") > i["left"]) & (F.col("a.start") < i["right"])) | ((F.col("a.end") > i["left"]) & (F.col("a.end") < i["right"])))
    retained = F.exists(F.array_except(bi, ai), lambda i: F.exists(F.col("a.exons"), lambda x: (x["start"] < i["left"]) & (x["end"] > i["right"])))
    subset = F.size(F.array_except(ai, bi)) == 0
    contained = F.exists(F.col("b.exons"), lambda x: (x["start"] <= F.col("a.start")) & (F.col("a.end") <= x["end"]))

    def touch(x: Column, y: Column) -> Column:
        return (x["start"] < y["end"]) & (y["start"] < x["end"])

    terminal = touch(F.element_at("a.exons", 1), F.element_at("b.exons", 1)) | touch(F.element_at("a.exons", -1), F.element_at("b.exons", -1))
    return p.select(
        F.col("a.gene").alias("gene"), F.col("a.tx").alias("a_tx"), F.col("b.tx").alias("b_tx"),
        (shared == F.greatest(F.size(ai), F.size(bi))).alias("same_chain"),
        (subset & (F.col("a.start") > F.col("b.start")) & (F.col("a.end") < F.col("b.end")) & ~in_intron & ~retained).alias("truncation"),
        contained.alias("contained"), terminal.alias("terminal"),
        (F.col("a.start") - F.col("b.start")).alias("d_start"), (F.col("a.end") - F.col("b.end")).alias("d_end"), (F.size("a.exons") - F.size("b.exons")).alias("d_exons"),
    )


def mergeable(pairs: DataFrame, mode: str = "strict") -> DataFrame:
    """Pairs whose ``a`` may be merged into ``b``: equal chains that touch at an end (once, the first name as ``a``), and for ``any`` truncations and contained ones too."""
    keep = F.col("same_chain") & F.col("terminal") & (F.col("a_tx") < F.col("b_tx"))
    return pairs.where(keep if mode == "strict" else keep | F.col("truncation") | F.col("contained"))


def slice_transcripts(exons: DataFrame, parts: DataFrame) -> DataFrame:
    """Exons cut to ``parts`` (``tx``, ``t_start``, ``t_end``) given in transcript coordinates along the strand: a coding part, or what lies before or after it."""
    own = Window.partitionBy("tx")
    length = F.col("end") - F.col("start")
    e = exons.withColumn("_b", F.coalesce(F.sum(length).over(own.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_t", F.sum(length).over(own))
    j = e.join(parts.select("tx", "t_start", "t_end"), "tx")
    minus = F.col("strand") == "-"
    lo = F.when(minus, F.col("_t") - F.col("t_end")).otherwise(F.col("t_start"))
    hi = F.when(minus, F.col("_t") - F.col("t_start")).otherwise(F.col("t_end"))
    cut = j.withColumn("_lo", F.greatest(lo - F.col("_b"), F.lit(0))).withColumn("_hi", F.least(hi - F.col("_b"), length)).where("_lo < _hi")
    return cut.withColumn("end", F.col("start") + F.col("_hi")).withColumn("start", F.col("start") + F.col("_lo")).select(*exons.columns)


def clip_exons(t: DataFrame, start: Column, end: Column) -> DataFrame:
    """Exons cut to new bounds; what lies outside is dropped."""
    cut = F.transform("exons", lambda x: F.struct(F.greatest(x["start"], start).alias("start"), F.least(x["end"], end).alias("end")))
    return t.withColumn("exons", F.filter(cut, lambda x: x["start"] < x["end"]))


def flanks(features: DataFrame, distance: int, end: str = "5p") -> DataFrame:
    """``distance`` to each side of the 5' or 3' end; dropped if it would begin before 0."""
    at = F.when((F.col("strand") == "-") == F.lit(end == "5p"), F.col("end") - 1).otherwise(F.col("start"))
    return features.withColumn("_at", at).withColumn("start", F.col("_at") - distance).withColumn("end", F.col("_at") + distance + 1).drop("_at").where("start >= 0")


def dominant_transcript(totals: DataFrame) -> DataFrame:
    """Per gene the transcript of the highest coverage above 0; of equals the first by name."""
    ranked = totals.where("total > 0").withColumn("_r", -F.row_number().over(Window.partitionBy("gene").orderBy("tx")))
    best = F.max_by(F.struct("tx", "total"), F.struct("total", "_r"))
    return ranked.groupBy("gene").agg(best.alias("b")).select("gene", "b.tx", "b.total")


def _flip(df: DataFrame) -> DataFrame:
    return df.withColumn("strand", F.when(F.col("strand") == "+", "-").otherwise("+"))


def classify(features: DataFrame, exons: DataFrame, upstream: int = 500, width: int = 1024) -> DataFrame:
    """Label of every feature (``fid``, chrom, strand, start, end) by its nearest annotation; the highest code wins.

    7 S in a single-exon gene; 6 P in a 5' exon; 5 D in another exon, unless the
    feature meets one labelled P on either strand; 4 U at most ``upstream`` before a
    5' exon; 3 I between exons of one gene; 2 A across an exon of the other strand; 1
    IA between exons of one gene of the other strand; 0 N.
    """
    keys = ["chrom", "strand"]
    # each of these is read by several rules
    f = materialize(features.select("fid", *keys, "start", "end"), "features")
    exons = materialize(exons.select(*keys, "gene", "tx", "start", "end"), "exons")
    # the exon's number settles ties; made from the exon itself, it is the same on every run
    text = F.concat(F.col("chrom"), F.col("strand"), F.lit("|"), F.col("start"), F.lit("|"), F.col("end"), F.lit("|"), F.col("gene"))
    named_exons = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint").alias("eid")
    ex = materialize(exons.select(*keys, "start", "end", "gene").distinct().select("*", named_exons), "exons")
    first = terminal_exons(exons).select(*keys, "start", "end", "gene").distinct().select("*", named_exons)

    def within(a: DataFrame, b: DataFrame, on: list[str] = keys) -> DataFrame:
        return overlap_join(a, b.select(*keys, "start", "end"), on, how="left_semi", width=width).select("fid")

    def side(a: DataFrame, b: DataFrame, left: bool) -> DataFrame:
        """The nearest row of ``b`` to the left or right of each row of ``a``, which overlaps none."""
        at, edge = (F.col("start"), F.col("end")) if left else (-F.col("end"), -F.col("start"))
        x = a.select(*keys, at.alias("at"), F.col("fid").alias("a_id"))
        y = b.select(*keys, edge.alias("at"), F.col("eid").alias("ord"), F.col("eid").alias("b_id"))
        return _nearest_before(x, y, keys, SHARD).select(F.col("a_id").alias("fid"), F.col("b_id").alias("eid"), "gap")

    def between(a: DataFrame) -> DataFrame:
        genes = ex.select("eid", "gene").distinct()
        left, right = (side(a, ex, way).join(genes, "eid").select("fid", F.col("gene").alias(f"g{int(way)}")) for way in (True, False))
        return left.join(right, "fid").where("g0 = g1").select("fid")

    s, p = within(f, single_exon_genes(exons)), materialize(within(f, first), "codes")
    in_exon = materialize(within(f, ex), "codes")
    labelled_p = f.join(p, "fid", "left_semi")
    clear = overlap_join(f.join(in_exon, "fid", "left_semi"), labelled_p.select("chrom", "start", "end"), ["chrom"], how="left_anti", width=width).select("fid")
    free = f.join(p, "fid", "left_anti")
    ahead = side(free.where("strand = '+'"), first, False).unionByName(side(free.where("strand = '-'"), first, True))
    u = ahead.where(F.col("gap") <= upstream).select("fid")
    i = between(f.join(in_exon, "fid", "left_anti"))
    parts = [(s, 7), (p, 6), (clear, 5), (u, 4), (i, 3)]
    sense = materialize(reduce(DataFrame.unionByName, [d.select("fid", F.lit(code).alias("code")) for d, code in parts]), "codes")
    rest = materialize(_flip(f.join(sense, "fid", "left_anti")), "features")
    across = materialize(within(rest, ex), "codes")
    anti = across.select("fid", F.lit(2).alias("code")).unionByName(between(rest.join(across, "fid", "left_anti")).select("fid", F.lit(1).alias("code")))
    best = sense.unionByName(anti).groupBy("fid").agg(F.max("code").alias("code"))
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return f.join(best, "fid", "left").select("fid", F.coalesce("code", F.lit(0)).alias("code")).withColumn("label", F.element_at(labels, F.col("code")))


def split_capped(totals: DataFrame, cutoff: float, least: float = 1) -> DataFrame:
    """``capped`` for features whose share of untemplated G (``uug`` of ``total``) reaches the cutoff; few reads drop out."""
    return totals.where(F.col("total") >= least).withColumn("share", F.col("uug") / F.col("total")).withColumn("capped", F.col("share") >= cutoff)


def auto_cutoff(totals: DataFrame, bins: int = 101) -> DataFrame:
    """Mean of the emptiest bins in the lowest quarter of the histogram of shares; one row."""
    share = F.col("uug") / F.col("total")
    spine = totals.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    counts = totals.where("total > 0").groupBy(F.least(F.floor(share * (bins - 1)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    h = spine.join(counts, "bin", "left").na.fill(0, ["n"]).where(F.col("bin") < bins // 4)
    return h.withColumn("low", F.min("n").over(Window.partitionBy())).where("n = low").agg((F.avg("bin") / (bins - 1)).alias("cutoff"))


def keep_labels(labelled: DataFrame, labels: str = "PIUD") -> DataFrame:
    """Features with one of the one-letter labels, as gene counts of capped ends take them."""
    return labelled.where(F.col("label").isin(*labels))


def name_in_order(features: DataFrame, prefix: str, by: list[str] = [], order: list[str] = ["chrom", "start", "end"], name: str = "name") -> DataFrame:
    """``name``: ``prefix.N``, N being the place of a feature in ``order``, for each of ``by`` from 1 on."""
    rows = features if by else features.withColumn("_all", F.lit(0))
    out = numbered(rows, by or ["_all"], order, "_place").withColumn(name, F.concat(F.lit(f"{prefix}."), F.col("_place").cast("string")))
    return out.drop("_place", "_all")


def buffer_right(features: DataFrame, by: int = 1) -> DataFrame:
    """End, and peak if there is one, moved to the right; the start stays."""
    out = features.withColumn("end", F.col("end") + by)
    return out.withColumn("peak", F.col("peak") + by) if "peak" in features.columns else out
