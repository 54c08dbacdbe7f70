"""Sequence bias: k-mer frequencies, weights relative to neighbours, tile correlation, pileups."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators.periods import SHARD
from helixframe.operators.shards import around


def kmer_bias(seqs: DataFrame, k: int, reach: int, seq: str = "seq") -> DataFrame:
    """Frequency of each k-mer at each position from the start, up to ``reach``: rel_pos, kmer, freq."""
    head = seqs.select(F.explode(F.transform(S.kmers(F.substring(seq, 1, reach), k), lambda x, i: F.struct(i.alias("rel_pos"), x.alias("kmer")))).alias("x"))
    c = head.groupBy("x.rel_pos", "x.kmer").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy("rel_pos"))).select("rel_pos", "kmer", "freq")


def bias_weight(seqs: DataFrame, bias: DataFrame, baseline: DataFrame, key: str, k: int, reach: int, seq: str = "seq") -> DataFrame:
    """Weight of each read: the product over its positions of baseline / bias."""
    parts = seqs.select(key, F.explode(F.transform(S.kmers(F.substring(seq, 1, reach), k), lambda x, i: F.struct(i.alias("rel_pos"), x.alias("kmer")))).alias("x")).select(key, "x.rel_pos", "x.kmer")
    j = parts.join(bias.withColumnRenamed("freq", "b"), ["rel_pos", "kmer"]).join(baseline.withColumnRenamed("freq", "a"), "kmer")
    return j.groupBy(key).agg(F.exp(F.sum(F.log(F.col("a") / F.col("b")))).alias("weight"))


def allele_deviation(bias: DataFrame, k: int) -> DataFrame:
    """``rel_pos``, ``deviation``: spread of the frequency of a base over the k places of a tile, mean over the bases."""
    places = bias.select("rel_pos", "freq", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("i"), "kmer")
    alleles = places.groupBy("rel_pos", "i", F.substring("kmer", F.col("i"), F.lit(1)).alias("base")).agg(F.sum("freq").alias("f"))
    # a base that does not occur at a place has frequency 0 there
    spread = alleles.groupBy("rel_pos", "base").agg(F.sqrt(F.greatest(F.sum(F.col("f") * F.col("f")) / k - F.pow(F.sum("f") / k, 2), F.lit(0.0))).alias("d"))
    return spread.groupBy("rel_pos").agg((F.sum("d") / 4).alias("deviation"))


def biased_tiles(deviation: list[tuple[int, float]], k: int, fold: float = 5.0) -> list[int]:
    """Places of tiles that do not overlap and deviate more than ``fold`` times as much as the first one, taken from left to right."""
    limit = dict(deviation)[min(p for p, _ in deviation)] * fold
    out: list[int] = []
    for place, d in sorted(deviation):
        if d > limit and (not out or place >= out[-1] + k):
            out.append(place)
    return out


def tile_groups(tiles: list[int], correlation: dict[tuple[int, int], float], least: float = 0.15) -> list[list[int]]:
    """Tiles put together with the first tile left that they correlate with by more than ``least``."""
    left, out = sorted(tiles), []
    while left:
        first = left[0]
        group = [t for t in left if t == first or correlation.get((first, t), 0.0) > least]
        out.append(group)
        left = [t for t in left if t not in group]
    return out


def grouped_weight(seqs: DataFrame, bias: DataFrame, baseline: DataFrame, groups: list[list[int]], key: str, k: int, seq: str = "seq") -> DataFrame:
    """Weight of each read: the product over groups of tiles of the mean of baseline / bias; tiles without a ratio above 0 do not count.

    Reads too short for a tile, or with letters other than A, C, G and T there, lack that tile.
    """
    tiles = [(g, t) for g, group in enumerate(groups) for t in group]
    if not tiles:
        return seqs.select(key, F.lit(1.0).alias("weight"))
    entries = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(t).alias("rel_pos"), F.substring(seq, t + 1, k).alias("kmer")) for g, t in tiles])
    parts = seqs.select(key, F.inline(entries)).where(F.length("kmer") == k)
    ratios = bias.withColumnRenamed("freq", "b").join(baseline.withColumnRenamed("freq", "a"), "kmer").select("rel_pos", "kmer", (F.col("a") / F.col("b")).alias("ratio")).where("ratio > 0")
    means = parts.join(ratios, ["rel_pos", "kmer"]).groupBy(key, "g").agg(F.avg("ratio").alias("m"))
    out = means.groupBy(key).agg(F.exp(F.sum(F.log("m"))).alias("weight"))
    return seqs.select(key).join(out, key, "left").select(key, F.coalesce("weight", F.lit(1.0)).alias("weight"))


def correct_bias(seqs: DataFrame, key: str, k: int, reach: int, seq: str = "seq", fold: float = 5.0, least: float = 0.15) -> DataFrame:
    """The whole correction: k-mer frequencies by place, baseline, biased tiles, their groups by correlation, and the weight of each read.

    Runs jobs when called; the driver receives a number a place and one a pair of tiles.
    """
    bias, baseline = kmer_bias(seqs, k, reach, seq), baseline_kmers(seqs, k, seq)
    tiles = biased_tiles([(r.rel_pos, r.deviation) for r in allele_deviation(bias, k).collect()], k, fold)
    correlation = {}
    if len(tiles) > 1:
        names = [f"t{t}" for t in tiles]
        wide = seqs.select(*[F.log(F.substring(seq, t + 1, k).isin(*_common(bias, t)).cast("double") + 1).alias(n) for t, n in zip(tiles, names)])
        correlation = {(int(r.i[1:]), int(r.j[1:])): r.abs_corr or 0.0 for r in tile_correlation(wide, names).collect()}
    return grouped_weight(seqs, bias, baseline, tile_groups(tiles, correlation, least), key, k, seq)


def _common(bias: DataFrame, place: int) -> list[str]:
    """The k-mers of a place that are more frequent than the mean there, of at most 4 ** k."""
    at = bias.where(F.col("rel_pos") == place)
    mean = at.agg(F.avg("freq")).first()[0]
    return [r.kmer for r in at.where(F.col("freq") > mean).collect()]


def baseline_kmers(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Frequency of k-mers anywhere: kmer, freq."""
    c = seqs.select(F.explode(S.kmers(F.col(seq), k)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    return c.crossJoin(F.broadcast(total)).select("kmer", (F.col("n") / F.col("t")).alias("freq"))  # one row


def neighbour_relative(cov: DataFrame, keys: list[str], reach: int = 10, shard: int = SHARD) -> DataFrame:
    """Value over the mean of the covered positions within ``reach``, its own included."""
    out = around(cov, keys, "pos", reach, {"_mean": F.avg("value")}, shard)
    return out.withColumn("relative", F.col("value") / F.col("_mean")).drop("_mean")


def density(cov: DataFrame, keys: list[str], reach: int = 25, shard: int = SHARD) -> DataFrame:
    """Covered positions within ``reach`` of each."""
    return around(cov, keys, "pos", reach, {"near": F.count(F.lit(1))}, shard)


def sampled_baseline(cov: DataFrame, keys: list[str], share: float, seed: int, reach: int = 25) -> DataFrame:
    """Positions near covered ones, drawn by hash in proportion to the density of coverage there."""
    d = density(cov, keys, reach).select(*keys, "pos", "near", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("o")).withColumn("at", F.col("pos") + F.col("o"))
    text = F.concat_ws("|", F.lit(str(seed)), *keys, "pos", "at")
    u = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint") / float(1 << 48)
    return d.where(u < share * F.col("near") / (2 * reach + 1)).where("at >= 0").select(*keys, "at")


def tile_correlation(wide: DataFrame, tiles: list[str]) -> DataFrame:
    """Absolute correlation of every pair of columns, in one aggregation: i, j, abs_corr."""
    pairs = list(itertools.combinations(tiles, 2))
    row = wide.agg(*[F.abs(F.corr(a, b)).alias(f"{a}|{b}") for a, b in pairs])
    entries = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"`{a}|{b}`").alias("abs_corr")) for a, b in pairs])
    return row.select(F.inline(entries))


def pileup(sites: DataFrame, cov: DataFrame, keys: list[str], reach: int = 5) -> DataFrame:
    """Least, median, mean and mode of the values within ``reach`` of each site."""
    around = sites.select(*keys, F.col("pos").alias("site"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("o")).withColumn("pos", F.col("site") + F.col("o"))
    j = around.join(cov, [*keys, "pos"])
    stats = j.groupBy(*keys, "site").agg(F.min("value").alias("least"), F.percentile("value", F.lit(0.5)).alias("median"), F.avg("value").alias("mean"))
    common = j.groupBy(*keys, "site", "value").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys, "site").agg(F.max_by("value", F.struct("n", "value")).alias("mode"))
    return stats.join(common, [*keys, "site"])
