"""Bases of a genome beside positions, features and transcripts.

A genome is held in tiles, rows of chrom, tile, seq, so that no task needs a whole
chromosome and a position finds its base by an equi join on the tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import sequence as S

#: Bases of a tile.
TILE = 4096


def tiles(genome: DataFrame, size: int = TILE) -> DataFrame:
    """chrom, tile, seq of a table of chrom, seq; each sequence is gone through once. Long ones are better read as tiles, see ``formats.read_fasta_tiles``."""
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return genome.select("chrom", F.posexplode(pieces).alias("tile", "seq"))


def bases_at(points: DataFrame, tiled: DataFrame, size: int = TILE) -> DataFrame:
    """``points`` (chrom, strand, pos, ...) with ``base``, complemented on the minus strand; positions outside drop out."""
    p = points.withColumn("tile", F.floor(F.col("pos") / size).cast("int"))
    j = p.join(tiled.withColumnRenamed("seq", "_seq"), ["chrom", "tile"])
    base = F.substring("_seq", (F.pmod("pos", F.lit(size)) + 1).cast("int"), F.lit(1))
    out = j.withColumn("base", F.when(F.col("strand") == "-", S.complement(base)).otherwise(F.upper(base)))
    return out.where("base <> ''").select(*points.columns, "base")


def interval_sequences(rows: DataFrame, tiled: DataFrame, key: str, size: int = TILE) -> DataFrame:
    """``key`` and ``seq`` of intervals (chrom, start, end): the pieces of their tiles, joined in order."""
    first, last = F.floor(F.col("start") / size).cast("int"), F.floor((F.col("end") - 1) / size).cast("int")
    each = rows.where("start < end").select(key, "chrom", "start", "end", F.explode(F.sequence(first, last)).alias("tile"))
    j = each.join(tiled, ["chrom", "tile"])
    lo = F.greatest(F.col("start") - F.col("tile") * size, F.lit(0))
    hi = F.least(F.col("end") - F.col("tile") * size, F.lit(size))
    part = F.substring("seq", (lo + 1).cast("int"), (hi - lo).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("tile", part.alias("s"))))
    return j.groupBy(key, "start", "end").agg(F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("seq")).select(key, "start", "end", "seq")


def transcript_sequences(exons: DataFrame, tiled: DataFrame, size: int = TILE) -> DataFrame:
    """tx, strand, seq: exons joined in order, reverse complement on the minus strand."""
    pieces = interval_sequences(exons.select("chrom", "start", "end", F.struct("tx", "strand").alias("k")), tiled, "k", size)
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "seq")))
    t = pieces.groupBy("k").agg(F.array_join(F.transform(ordered, lambda x: x["seq"]), "").alias("seq"))
    return t.select("k.tx", "k.strand", F.when(F.col("k.strand") == "-", S.revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


def base_share(features: DataFrame, tiled: DataFrame, key: str, base: str = "G", size: int = TILE) -> DataFrame:
    """Share of ``base`` in each feature, read along its strand."""
    named = features.select("chrom", "start", "end", F.struct(key, "strand").alias("k"))
    seq = interval_sequences(named, tiled, "k", size)
    along = F.when(F.col("k.strand") == "-", S.complement(F.col("seq"))).otherwise(F.col("seq"))
    count = F.length(along) - F.length(F.replace(along, F.lit(base), F.lit("")))
    return seq.groupBy(F.col(f"k.{key}").alias(key)).agg((F.sum(count) / F.sum(F.length("seq"))).alias("share"))


def base_frequencies(points: DataFrame, tiled: DataFrame, size: int = TILE) -> DataFrame:
    """Share of each base at ``points``."""
    c = bases_at(points, tiled, size).groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a few rows


def motif_scan(tiled: DataFrame, motif: str, most: int, size: int = TILE) -> DataFrame:
    """chrom, start, end, strand of the hits of an IUPAC motif on both strands, with at most ``most`` substitutions; one a span and strand.

    A tile is read with the first letters of the next, so hits over a border are found once.
    """
    k = len(motif)
    head = tiled.select("chrom", (F.col("tile") - 1).alias("tile"), F.substring("seq", 1, k - 1).alias("_next"))
    whole = tiled.join(head, ["chrom", "tile"], "left").select("chrom", "tile", F.concat("seq", F.coalesce("_next", F.lit(""))).alias("seq"))
    hits = whole.select("chrom", (F.col("tile").cast("bigint") * size).alias("_o"), F.inline(S.motif_hits_both(F.col("seq"), motif, most)))
    return hits.select("chrom", (F.col("_o") + F.col("at")).alias("start"), (F.col("_o") + F.col("at") + k).alias("end"), "strand").distinct()


def coding_parts(sequences: DataFrame) -> DataFrame:
    """tx, and the parts before, in and after the longest reading frame."""
    o = sequences.select("tx", "seq", S.longest_orf("seq").alias("o"))
    return o.select("tx", F.substring("seq", F.lit(1), F.col("o.start")).alias("utr5"), F.substring("seq", F.col("o.start") + 1, F.col("o.end") - F.col("o.start")).alias("cds"),
                    F.substring("seq", F.col("o.end") + 1, F.length("seq")).alias("utr3"))


def reads_in(reads: DataFrame, exons: DataFrame, one_each: bool = False, order: str = "read_id") -> DataFrame:
    """Reads (chrom, strand, pos) whose first base lies in an exon; with ``one_each`` the first read of a position."""
    from helixframe.operators.intervals import overlap_join

    points = reads.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + 1)
    kept = overlap_join(points, exons.select("chrom", "strand", "start", "end"), ["chrom", "strand"], how="left_semi", a_levels=(0,)).drop("start", "end")
    if one_each:
        w = Window.partitionBy("chrom", "strand", "pos").orderBy(order)
        kept = kept.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return kept


def end_groups(transcripts: DataFrame, reach: int = 50, side: str = "5p") -> DataFrame:
    """``group``: transcripts of a gene whose 5' (or 3p: 3') ends follow each other within ``reach``, numbered along the strand."""
    minus, five = F.col("strand") == "-", side == "5p"
    end = F.when(minus, -F.col("end" if five else "start")).otherwise(F.col("start" if five else "end"))
    w = Window.partitionBy("chrom", "strand", "gene").orderBy("_e", "tx")
    t = transcripts.withColumn("_e", end).withColumn("_n", F.when(F.col("_e") - F.lag("_e").over(w) <= reach, 0).otherwise(1))
    return t.withColumn("group", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_e", "_n")


def end_group_table(transcripts: DataFrame, reach: int = 50, side: str = "5p") -> DataFrame:
    """One row a group of ends: gene, group, its transcripts in order of name, and the first and last place of the end on the genome."""
    at = F.when((F.col("strand") == "-") == F.lit(side == "5p"), F.col("end")).otherwise(F.col("start"))
    g = end_groups(transcripts, reach, side).withColumn("_at", at)
    return g.groupBy("chrom", "strand", "gene", "group").agg(F.array_join(F.array_sort(F.collect_list("tx")), ",").alias("txs"), F.min("_at").alias("first"), F.max("_at").alias("last"))


def best_duplex(duplexes: DataFrame, by: str = "allen") -> DataFrame:
    """The best duplex of each transcript and slice site: least score, or highest energy ratio; then by query name."""
    if by == "allen":
        rank = F.struct(F.col("allen").isNull().alias("none"), "allen", "query")
        best = F.min_by(F.struct("*"), rank)
    else:
        best = F.min_by(F.struct("*"), F.struct((-F.col("mfe_ratio")).alias("r"), F.col("query")))
    return duplexes.groupBy("transcript", "slice").agg(best.alias("b")).select("b.*")


def transfer_weights(weights: DataFrame, reads: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Weights to reads of the same keys, the n-th to the n-th; reads without one have weight 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    a = weights.select(*keys, F.row_number().over(w).alias("_n"), "weight")
    return reads.withColumn("_n", F.row_number().over(w)).join(a, [*keys, "_n"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).drop("_n")
