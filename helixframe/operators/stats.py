"""Empirical distributions, combined p-values, false discovery rates, spacing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.shards import carried, numbered, ranged, running_sum

#: Salts over which rows of one place are cut before they meet.
SALTS = 32


def fold_change(site: Column, flank: Column) -> Column:
    """(site + 1) / (flank + 1); null where either is null or NaN."""
    return (F.nanvl(site, F.lit(None)) + 1) / (F.nanvl(flank, F.lit(None)) + 1)


def fisher(p: Column, q: Column) -> Column:
    """Fisher's combination of two p-values (chi square, 4 degrees of freedom, in closed form); 0 if one is 0."""
    t = p * q
    return F.when(t == 0, F.lit(0.0)).otherwise(t * (1 - F.log(t)))


def ecdf(test: DataFrame, null: DataFrame, by: list[str], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """``test`` with ``name``: the share of ``null`` values of the same ``by`` that are at most the row's; null without any.

    Both sides are first counted by distinct value, map-side, so that equal values of
    a hot group take one row; the running count works on range partitions.
    """
    counts = null.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    asked = test.where(F.col(value).isNotNull()).select(*by, value).distinct().withColumn("_n", F.lit(0).cast("bigint"))
    every = counts.unionByName(asked).groupBy(*by, value).agg(F.sum("_n").alias("_n"))
    run = running_sum(every, by, value, "_n", "_c", partitions)
    shares = run.select(*by, value, F.when(F.col("total__c") > 0, F.col("_c") / F.col("total__c")).alias(name))
    return test.join(shares, [*by, value], "left")


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, name: str = "fdr", partitions: int | None = None) -> DataFrame:
    """Adjusted p-values within ``by``; null p stays null.

    Ranks come from counts by distinct p in range partitions, which follow the
    values wherever they crowd; across partitions one row is carried.
    """
    counts = df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    r = carried(ranged(counts, by, ["_v"], partitions), by, {"_before": "_n"})
    inner = Window.partitionBy(*by, "_p").orderBy("_v")
    rank = F.sum("_n").over(inner.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    raw = r.withColumn("_q", F.col("_v") * F.col("total__before") / rank)
    least = raw.groupBy(*by, "_p").agg(F.min("_q").alias("_l"))
    # from the greatest value down, for a frame that ends at the last row costs the square of the rows
    outer = Window.partitionBy(*by).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    later = least.withColumn("_later", F.min("_l").over(outer)).drop("_l")
    down = Window.partitionBy(*by, "_p").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, 0)
    done = raw.join(later, [*by, "_p"]).select(*by, F.col("_v").alias(p), F.least(F.lit(1.0), F.min("_q").over(down), F.col("_later")).alias(name))
    return df.join(done, [*by, p], "left")


def spaced(df: DataFrame, by: list[str], pos: str, order: list[Column], gap: int = 5) -> DataFrame:
    """Greedy choice per ``by``: in ``order``, a row is kept if it lies more than ``gap`` from all kept ones.

    Of rows at one place only the first can be kept, so each place is cut to one row,
    by salts first.  Places are then parted at holes wider than ``gap``, which no
    choice crosses; each cluster is settled on its own.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
    for extra in ([salt], []):
        df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by, pos, *extra).orderBy(*order))).where("_r = 1").drop("_r")
    w = Window.partitionBy(*by).orderBy(pos)
    cut = df.withColumn("_new", F.when(F.col(pos) - F.lag(pos).over(w) <= gap, 0).otherwise(1))
    cut = cut.withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = cut.withColumn("_o", F.row_number().over(Window.partitionBy(*by, "_k").orderBy(*order)))
    places = F.array_sort(F.collect_list(F.struct("_o", F.col(pos).cast("bigint").alias("x"))))
    empty = F.array().cast("array<struct<_o:int,x:bigint>>")
    kept = F.aggregate(places, empty, lambda acc, s: F.when(F.exists(acc, lambda k: F.abs(k["x"] - s["x"]) <= gap), acc).otherwise(F.concat(acc, F.array(s))))
    chosen = ranked.groupBy(*by, "_k").agg(kept.alias("kept")).select(*by, "_k", F.explode("kept").alias("c")).select(*by, "_k", F.col("c._o").alias("_o"))
    return ranked.join(chosen, [*by, "_k", "_o"]).select(*df.columns)


def ks_distance(df: DataFrame, group: str, value: str, partitions: int | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of the two values of boolean ``group``, with its asymptotic p-value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(group).alias("a"), F.count_if(~F.col(group)).alias("b"))
    r = carried(ranged(counts.withColumn("_g", F.lit(0)), ["_g"], [value], partitions), ["_g"], {"xa": "a", "xb": "b"})
    w = Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    d = r.select((F.sum("a").over(w) + F.col("xa")).alias("ca"), (F.sum("b").over(w) + F.col("xb")).alias("cb"), F.col("total_xa").alias("na"), F.col("total_xb").alias("nb"))
    out = d.agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("distance"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    root = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))) * F.col("distance")
    terms = [((-1) ** (k - 1)) * F.exp(-2 * k * k * root * root) for k in range(1, 101)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return out.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * total)))


def welch_t(df: DataFrame, group: str, value: str) -> DataFrame:
    """Welch's t statistic and degrees of freedom for the two values of boolean ``group``."""
    a, b = F.when(F.col(group), F.col(value)), F.when(~F.col(group), F.col(value))
    s = df.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), (F.var_samp(a) / F.count(a)).alias("va"), (F.var_samp(b) / F.count(b)).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    t = (F.col("ma") - F.col("mb")) / F.sqrt(F.col("va") + F.col("vb"))
    df_ = (F.col("va") + F.col("vb")) ** 2 / (F.col("va") ** 2 / (F.col("na") - 1) + F.col("vb") ** 2 / (F.col("nb") - 1))
    return s.select(t.alias("t"), df_.alias("df"))


def unit_scale(values: list[float]) -> float:
    """Scale at which the positive part of a profile sums to 1; infinite without any."""
    total = math.fsum(v for v in values if v > 0)
    return 1 / total if total else math.inf


def bandwidth_of(profile: pd.Series, share: float = 0.6827, least: int = 1, most: int = 30) -> int:
    """Smallest half-window around the middle that holds ``share`` of the positive signal."""
    values = profile.clip(lower=0).tolist()
    middle, total = len(values) // 2, sum(values)
    for h in range(len(values)):
        if math.fsum(values[max(0, middle - h) : middle + h + 1]) >= share * total:
            return min(most, max(least, h))
    return most


def min_max(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:
    """``df`` with ``scaled``: the value between the least (0) and the greatest (1) of its group; 0 where all are equal."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    out = df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))  # one row
    return out.withColumn("scaled", F.coalesce((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0)), F.lit(0.0))).drop("_lo", "_hi")


def unique_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Names made unique in ``order``: the first of equals as it is, the others with .1, .2 and so on."""
    rows = numbered(df, [name], order, "_k")
    return rows.withColumn(name, F.when(F.col("_k") > 1, F.concat(F.col(name), F.lit("."), (F.col("_k") - 1).cast("string"))).otherwise(F.col(name))).drop("_k")


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """``bin`` (from 0) and ``n`` of values from ``low`` to ``high``, both included; bins without any have 0."""
    at = F.least(F.floor((F.col(value) - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    counts = df.where(F.col(value).between(low, high) & ~F.isnan(F.col(value).cast("double"))).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
