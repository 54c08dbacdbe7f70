"""Aligned reads: decoding, filters, end and junction counts, multimapper rescue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.session import materialize


def decode_sam(lines: DataFrame, text: str = "value") -> DataFrame:
    """Alignment lines to columns; header lines are skipped.

    Position is 0-based; ``weight`` is the tag XW, 1 without it; ``strand`` is that
    of the fragment, so the second mate is turned round; ``primary`` excludes
    secondary and supplementary lines.  Tags are kept whole; of a tag given twice
    the first counts.
    """
    f = F.split(F.col(text), "\t")
    body = lines.where(~F.col(text).startswith("@") & (F.size(f) >= 11))
    given = F.transform(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substr(t, F.lit(6)).alias("v")))
    firsts = F.filter(given, lambda t, i: (i == 0) | ~F.exists(F.slice(given, 1, i), lambda before: before["k"] == t["k"]))
    tags = F.map_from_entries(firsts)
    out = body.select(
        F.get(f, F.lit(0)).alias("read_id"), F.get(f, F.lit(1)).cast("int").alias("flag"), F.get(f, F.lit(2)).alias("chrom"), (F.get(f, F.lit(3)).cast("bigint") - 1).alias("pos"), F.get(f, F.lit(4)).cast("int").alias("mapq"),
        F.get(f, F.lit(5)).alias("cigar"), F.get(f, F.lit(6)).alias("mate_chrom"), (F.get(f, F.lit(7)).cast("bigint") - 1).alias("mate_pos"), F.get(f, F.lit(9)).alias("seq"), F.get(f, F.lit(10)).alias("qual"), tags.alias("tags"),
    ).withColumn("bits", S.flag_bits(F.col("flag"))).where(~F.col("bits.unmapped"))
    turned = F.col("bits.reverse") != F.col("bits.second")
    return out.select(
        "*", F.when(turned, "-").otherwise("+").alias("strand"), F.coalesce(F.element_at("tags", "XW").cast("double"), F.lit(1.0)).alias("weight"),
        (~F.col("bits.secondary") & ~F.col("bits.supplementary")).alias("primary"), S.cigar_segments(F.col("pos"), F.col("cigar")).alias("segments"),
    )


def sam_lengths(lines: DataFrame, text: str = "value") -> DataFrame:
    """Chromosome lengths from the header."""
    return lines.where(F.col(text).startswith("@SQ")).select(F.regexp_extract(text, "SN:([^\t]+)", 1).alias("chrom"), F.regexp_extract(text, "LN:([0-9]+)", 1).cast("bigint").alias("length"))


def untemplated_filter(reads: DataFrame, base: str) -> DataFrame:
    """Reads whose clipped base next to the mapped 5' end is ``base``."""
    left, right = S.softclip(F.col("cigar"), "left"), S.softclip(F.col("cigar"), "right")
    plus = (F.col("strand") == "+") & (left > 0) & (F.substring("seq", left, F.lit(1)) == base)
    minus = (F.col("strand") == "-") & (right > 0) & (S.complement(F.substring("seq", F.length("seq") - right + 1, F.lit(1))) == base)
    return reads.where(plus | minus)


def softclip_policy(reads: DataFrame, allowed: str = "both", bases: str = "ACGT") -> DataFrame:
    """Reads whose clips are at the allowed end (none, 5p, 3p, both), of the allowed bases only."""
    left, right = S.softclip(F.col("cigar"), "left"), S.softclip(F.col("cigar"), "right")
    five, three = F.when(F.col("strand") == "+", left).otherwise(right), F.when(F.col("strand") == "+", right).otherwise(left)
    ok = {"none": (five == 0) & (three == 0), "5p": three == 0, "3p": five == 0, "both": F.lit(True)}[allowed]
    clipped = F.concat(F.substring("seq", F.lit(1), left), F.when(right > 0, F.substring("seq", F.length("seq") - right + 1, right)).otherwise(""))
    return reads.where(ok & (F.regexp_replace(clipped, f"[{bases}]", "") == ""))


def pair_mates(reads: DataFrame) -> DataFrame:
    """Alignments of both mates that belong together: each gives the place of the other.

    ``read_id``, chrom, ``pos`` and ``pos2`` (of the first and the second mate), their
    ``segments`` and ``segments2``, and ``primary``; a place taken by several
    alignments of a mate gives several pairs.
    """
    one = reads.where("bits.paired and bits.first").select("read_id", "chrom", "pos", F.col("mate_pos").alias("pos2"), "segments", "primary")
    two = reads.where("bits.paired and bits.second").select("read_id", "chrom", F.col("pos").alias("pos2"), F.col("mate_pos").alias("pos"), F.col("segments").alias("segments2"), F.col("primary").alias("_p"))
    return one.join(two, ["read_id", "chrom", "pos", "pos2"]).withColumn("primary", F.col("primary") & F.col("_p")).drop("_p")


def size_classes(reads: DataFrame, size: Column, bounds: list[int], by: list[str]) -> DataFrame:
    """Reads by ``by`` and class of ``size``: ``c0`` below the first bound, ``c1`` below the second, and so on."""
    edges = [None, *bounds, None]
    counts = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        own = F.lit(True)
        own = own if lo is None else own & (size >= lo)
        own = own if hi is None else own & (size < hi)
        counts.append(F.count_if(own).alias(f"c{i}"))
    return reads.groupBy(*by).agg(*counts)


def untemplated_counts(reads: DataFrame, base: str = "nuc") -> DataFrame:
    """Reads by 5' position and untemplated base: unique ones (``n_map`` 1) count 1, others their ``weight``."""
    own = F.when(F.col("n_map") == 1, 1.0).otherwise(F.col("weight"))
    return reads.where(F.col(base).isNotNull()).groupBy("chrom", "strand", "pos", base).agg(F.sum(own).alias("n"))


def first_reads(reads: DataFrame, most: int, order: list[str]) -> DataFrame:
    """The first ``most`` reads in ``order``, for a trial run on part of a library."""
    return reads.orderBy(*order).limit(most)


def min_match(reads: DataFrame, least: int = 16) -> DataFrame:
    """Unique reads need more than ``least`` matched bases, multimappers as many."""
    matched = F.aggregate("segments", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return reads.where(F.when(F.col("n_map") == 1, matched > least).otherwise(matched >= least))


def max_per_position(reads: DataFrame, most: int, keys: list[str], order: list[str]) -> DataFrame:
    """The first ``most`` reads of every position."""
    return reads.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def junction_strand(junctions: DataFrame, left: str = "left_bases", right: str = "right_bases") -> DataFrame:
    """Strand of a splice junction from the two bases at each end of the intron; ``.`` if they are no known pair."""
    pair = F.concat(F.upper(left), F.upper(right))
    return junctions.withColumn("strand", F.when(pair.isin("GTAG", "GCAG", "ATAC"), "+").when(pair.isin("CTAC", "CTGC", "GTAT"), "-").otherwise("."))


def _mapped(locations: DataFrame) -> Column:
    """All mapped positions of a location: those of ``segments`` (half-open), each once; without them its first base."""
    if "segments" not in locations.columns:
        return F.array("pos")
    whole = F.filter("segments", lambda x: x["start"] < x["end"])
    bases = F.array_distinct(F.flatten(F.transform(whole, lambda x: F.sequence(x["start"], x["end"] - 1))))
    return F.when(F.col("segments").isNull(), F.array("pos")).otherwise(bases)


def _location_mass(locations: DataFrame, cov: DataFrame) -> DataFrame:
    """Mass of every location: coverage of its own and of the other strand, summed over all its mapped positions."""
    other = cov.withColumn("strand", F.when(F.col("strand") == "+", "-").otherwise("+")).withColumnRenamed("value", "_o")
    own = cov.withColumnRenamed("value", "_m")
    if "segments" not in locations.columns:
        j = locations.join(own, ["chrom", "strand", "pos"], "left").join(other, ["chrom", "strand", "pos"], "left")
        return j.na.fill(0.0, ["_m", "_o"])
    # equal places have equal mass, so each is summed once, whatever the number of reads
    place = ["chrom", "strand", "pos", "segments"]
    each = locations.select(*place).distinct().select(*place, F.explode(_mapped(locations)).alias("_at"))
    for part in (own, other):
        each = each.join(part.withColumnRenamed("pos", "_at"), ["chrom", "strand", "_at"], "left")
    mass = each.groupBy(*place).agg(F.sum("_m").alias("_m"), F.sum("_o").alias("_o"))
    renamed = mass.select(*[F.col(c).alias(f"_{c}") for c in place], "_m", "_o")
    on = F.lit(True)
    for c in place:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return locations.join(renamed, on, "left").drop(*[f"_{c}" for c in place]).na.fill(0.0, ["_m", "_o"])


def allocate(locations: DataFrame, cov: DataFrame, opposite: bool = True) -> DataFrame:
    """One round: the share of each location of a read (``read``, chrom, strand, pos, weight) by the frozen coverage.

    A location of more than one base has its ``segments`` (array of half-open ``start``, ``end``) beside ``pos``.
    Mass on the own strand decides, else that on the other one if allowed; a read without any has null shares.
    """
    w = Window.partitionBy("read")
    m = _location_mass(locations, cov).withColumn("_s", F.sum("_m").over(w)).withColumn("_t", F.sum("_o").over(w))
    share = F.when(F.col("_s") > 0, F.col("_m") / F.col("_s"))
    if opposite:
        share = share.when(F.col("_t") > 0, F.col("_o") / F.col("_t"))
    return m.select(*locations.columns, share.alias("share"))


def rescue(unique: DataFrame, multi: DataFrame, rounds: int | None = None, opposite: bool = True) -> DataFrame:
    """Coverage after sharing out multimappers: ``multi`` has a row a location with ``n_map``, and ``segments`` if longer than a base.

    Reads are taken by ascending multiplicity.  In each round all reads that have
    mass are shared out by the coverage frozen before it, over all their mapped
    positions; reads without mass wait for the next round.  When a round shares
    nothing, or after ``rounds`` if given, what is left is spread evenly.  Rounds are
    parallel, so the result is not that of a read-by-read sweep.  Every round is
    written to the shared folder.
    """
    own = ["chrom", "strand", "pos"]
    given = [unique.select(*own, "value")]  # coverage of the rounds so far, one table a round; put together after each level

    def total() -> DataFrame:
        return reduce(DataFrame.unionByName, given).groupBy(*own).agg(F.sum("value").alias("value")) if len(given) > 1 else given[0]

    levels = [r.n_map for r in multi.select("n_map").distinct().orderBy("n_map").collect()]  # few small numbers
    for level in levels:
        waiting = multi.where(F.col("n_map") == level)
        done_rounds = 0
        while rounds is None or done_rounds < rounds:
            counts = Observation()  # taken while the round is written
            shared = allocate(waiting, total(), opposite).observe(counts, F.count_if(F.col("share").isNotNull()).alias("done"), F.count_if(F.col("share").isNull()).alias("left"))
            shared = materialize(shared, "rescue")
            found = counts.get
            if not found["done"]:
                break
            done = shared.where("share is not null")
            given.append(done.select("chrom", "strand", F.explode(_mapped(done)).alias("pos"), (F.col("weight") * F.col("share")).alias("value")).where("value <> 0"))
            waiting = shared.where("share is null").drop("share")
            if not found["left"]:
                break
            done_rounds += 1
        given.append(waiting.select("chrom", "strand", F.explode(_mapped(waiting)).alias("pos"), (F.col("weight") / level).alias("value")))
        given = [materialize(total().where("value <> 0"), "coverage")]
    return given[0]
