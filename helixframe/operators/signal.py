"""Signal processing on coverage: kernels, islands, peaks, trimming, periods."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.operators.coverage import KEYS
from helixframe.operators.periods import SHARD, _shard, merge_periods
from helixframe.operators.shards import around, numbered


def kernel(shape: str = "laplace", bandwidth: float = 15, sigma: float = 3) -> list[tuple[int, float]]:
    """(offset, weight) over offsets up to bandwidth * sigma, weights summing to 1."""
    reach = int(bandwidth * sigma)
    weigh = {
        "laplace": lambda x: math.exp(-abs(x) / bandwidth) / (2 * bandwidth),
        "gauss": lambda x: math.exp(-(x**2) / (2 * bandwidth) ** 2) / (math.sqrt(2 * math.pi) * bandwidth),
    }[shape]
    raw = [(x, weigh(x)) for x in range(-reach, reach + 1)]
    total = sum(w for _, w in raw)
    return [(x, w / total) for x, w in raw]


def convolve_rows(cov: DataFrame, weights: list[tuple[int, float]], keys: list[str] = KEYS, snap: float = 1e-9) -> DataFrame:
    """The convolution as one aggregation, for streams: a row for each position and offset, which combine before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(x).cast("bigint").alias("o"), F.lit(w).alias("w")) for x, w in weights])
    spread = cov.select(*keys, "pos", "value", F.inline(pairs)).select(*keys, (F.col("pos") + F.col("o")).alias("pos"), (F.col("value") * F.col("w")).alias("value"))
    return spread.where("pos >= 0").groupBy(*keys, "pos").agg(F.sum("value").alias("value")).where(F.col("value") > snap)


def convolve(cov: DataFrame, weights: list[tuple[int, float]], keys: list[str] = KEYS, snap: float = 1e-9, shard: int = 1 << 16) -> DataFrame:
    """Sum of value x weight at every position in reach; negative positions and values up to ``snap`` are dropped.

    Positions are summed first, so a group is at most a shard of the axis with the
    reach of the kernel on both sides; each is one dense array.
    """
    reach = max(abs(x) for x, _ in weights)
    dense = np.zeros(2 * reach + 1)
    for x, w in weights:
        dense[reach + x] += w
    shard = max(shard, reach)
    summed = cov.groupBy(*keys, "pos").agg(F.sum(F.col("value").cast("double")).alias("value"))
    place, home = F.pmod("pos", F.lit(shard)), _shard(F.col("pos"), shard)
    copies = F.filter(F.array(home, F.when(place < reach, home - 1), F.when(place >= shard - reach, home + 1)), lambda h: h.isNotNull())
    spread = summed.select(*keys, "pos", "value", F.explode(copies).alias("h"))
    schema = T.StructType([*[f for f in spread.schema.fields if f.name in keys], T.StructField("pos", T.LongType()), T.StructField("value", T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        first = table.column("h")[0].as_py() * shard
        line = np.zeros(shard + 2 * reach)
        line[table.column("pos").to_numpy() - (first - reach)] = table.column("value").to_numpy()
        out = np.convolve(line, dense, "valid")
        at = np.nonzero(out > snap)[0]
        at = at[at + first >= 0]
        columns = [table.column(k).combine_chunks().take(pa.array(np.zeros(len(at), np.int64))) for k in keys]
        return pa.Table.from_arrays([*columns, pa.array(at + first), pa.array(out[at])], names=[*keys, "pos", "value"])

    return spread.groupBy(*keys, "h").applyInArrow(run, schema)


def islands(cov: DataFrame, threshold: float = 0.0, min_length: int = 1, keys: list[str] = KEYS) -> DataFrame:
    """Maximal runs of positions with value above ``threshold``: ``start``, ``end``."""
    above = cov.where(F.col("value") > threshold).select(*keys, F.col("pos").alias("s"), F.col("pos").alias("e"))
    runs = merge_periods(above, keys, "s", "e")
    return runs.where(F.col("stop") - F.col("start") + 1 >= min_length).select(*keys, "start", (F.col("stop") + 1).alias("end"))


def in_features(cov: DataFrame, features: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Positions of ``cov`` inside each feature: keys, ``start``, ``end``, ``pos``, ``value``."""
    from helixframe.operators.intervals import overlap_join

    points = cov.select(*keys, F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value")
    hits = overlap_join(points, features.select(*keys, "start", "end"), keys, a_levels=(0,))
    return hits.select(*[F.col(f"a_{k}").alias(k) for k in keys], F.col("b_start").alias("start"), F.col("b_end").alias("end"), F.col("a_start").alias("pos"), F.col("a_value").alias("value"))


def feature_values(inside: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Sum, mean and max of the values of a feature, and its dominant peak: the highest, of equals the rightmost."""
    return inside.groupBy(*keys, "start", "end").agg(
        F.sum("value").alias("total"), F.avg("value").alias("mean"), F.max("value").alias("high"), F.max(F.struct("value", "pos")).alias("top")
    ).withColumn("peak", F.col("top.pos")).drop("top")


def local_maxima(inside: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Last position of each plateau that is higher than what comes before and after it in its feature."""
    f = Window.partitionBy(*keys, "start", "end").orderBy("pos")
    steps = inside.withColumn("before", F.lag("value").over(f))
    steps = steps.withColumn("plateau", F.sum(F.when(F.col("before") == F.col("value"), 0).otherwise(1)).over(f))
    flat = steps.groupBy(*keys, "start", "end", "plateau").agg(F.max("pos").alias("pos"), F.first("value").alias("value"))
    g = Window.partitionBy(*keys, "start", "end").orderBy("plateau")
    flat = flat.withColumn("p", F.lag("value").over(g)).withColumn("n", F.lead("value").over(g))
    return flat.where("(p is null or p < value) and n < value").select(*keys, "start", "end", "pos", "value")


def secondary_peaks(maxima: DataFrame, most: int = 9, keys: list[str] = KEYS) -> DataFrame:
    """The peaks after the highest, by height, as a comma list; ``-`` without any."""
    w = Window.partitionBy(*keys, "start", "end").orderBy(F.desc("value"), F.desc("pos"))
    ranked = maxima.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most + 1)
    rest = F.array_sort(F.collect_list(F.when(F.col("r") > 1, F.struct("r", "pos"))))
    joined = F.array_join(F.transform(rest, lambda x: x["pos"].cast("string")), ",")
    return ranked.groupBy(*keys, "start", "end").agg(F.when(joined == "", "-").otherwise(joined).alias("secondary"))


def trim(inside: DataFrame, fraction: float, keys: list[str] = KEYS) -> DataFrame:
    """Narrowest bounds holding the fewest top positions that reach ``fraction`` of a feature's total.

    ``n`` is that number; positions as high as the n-th stay, so ties are kept whole.
    """
    own = Window.partitionBy(*keys, "start", "end")
    top = own.orderBy(F.desc("value"), F.desc("pos"))
    positive = inside.where("value > 0")
    r = positive.withColumn("n", F.row_number().over(top)).withColumn("run", F.sum("value").over(top.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("total", F.sum("value").over(own)).withColumn("enough", F.min(F.when(F.col("run") >= F.col("total") * fraction - 1e-9, F.col("n"))).over(own))
    r = r.withColumn("least", F.max(F.when(F.col("n") == F.col("enough"), F.col("value"))).over(own)).where("value >= least")
    return r.groupBy(*keys, "start", "end").agg(F.min("pos").alias("new_start"), (F.max("pos") + 1).alias("new_end"), F.max("enough").alias("n"))


def rank_values(inside: DataFrame, fraction: float = 0.9, keys: list[str] = KEYS) -> DataFrame:
    """``score``: offsets of the fewest top positions that reach ``fraction`` of a feature's total, highest first, later of equals first; as high as the last stay."""
    own = Window.partitionBy(*keys, "start", "end")
    top = own.orderBy(F.desc("value"), F.desc("pos"))
    r = inside.where("value > 0").withColumn("_n", F.row_number().over(top)).withColumn("_run", F.sum("value").over(top.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("_total", F.sum("value").over(own))
    r = r.withColumn("_last", F.max(F.when(F.col("_run") - F.col("value") < F.col("_total") * fraction - 1e-9, F.struct("_n", "value"))).over(own)["value"]).where("value >= _last")
    listed = F.array_sort(F.collect_list(F.struct("_n", (F.col("pos") - F.col("start")).alias("x"))))
    return r.groupBy(*keys, "start", "end").agg(F.array_join(F.transform(listed, lambda x: x["x"].cast("string")), ",").alias("score"))


def all_values(inside: DataFrame, least: float = 0.01, keys: list[str] = KEYS) -> DataFrame:
    """``score``: offset:share of the positions with at least ``least`` of a feature's total, shares to two digits; ``0:0`` without any."""
    own = Window.partitionBy(*keys, "start", "end")
    r = inside.withColumn("_s", F.col("value") / F.sum("value").over(own)).withColumn("_r", F.round("_s", 2))
    entry = F.concat((F.col("pos") - F.col("start")).cast("string"), F.lit(":"), F.col("_r").cast("string"))
    listed = F.array_sort(F.collect_list(F.when((F.col("_s") >= least) & (F.col("_r") > 0), F.struct("pos", entry.alias("e")))))
    joined = F.array_join(F.transform(listed, lambda x: x["e"]), ",")
    return r.groupBy(*keys, "start", "end").agg(F.when(joined == "", "0:0").otherwise(joined).alias("score"))


def feature_score(inside: DataFrame, mode: str = "sum", reads: float | None = None, keys: list[str] = KEYS) -> DataFrame:
    """``score`` of each feature as text: sum, rpm (of ``reads``, two digits), period, byrank or allvalues; any other mode is sum."""
    if mode == "period":
        return period_scores(inside, keys=keys).select(*keys, "start", "end", F.col("period").cast("string").alias("score"))
    if mode == "byrank":
        return rank_values(inside, keys=keys)
    if mode == "allvalues":
        return all_values(inside, keys=keys)
    total = F.sum("value")
    return inside.groupBy(*keys, "start", "end").agg((F.round(total * 1e6 / reads, 2) if mode == "rpm" else total).cast("string").alias("score"))


def period_scores(inside: DataFrame, most: int | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Best period of each feature: mean signal at multiples of p from the peak, times its share; of equals the longer p.

    Periods go up to the length of the feature, or to ``most`` if given.  A position counts for the divisors of its
    distance from the peak only, so a feature of length L gives about L log L rows and not L * L.
    """
    own = Window.partitionBy(*keys, "start", "end")
    x = inside.withColumn("peak", F.max(F.struct("value", "pos")).over(own)["pos"]).withColumn("total", F.sum("value").over(own))
    limit = (F.col("end") - F.col("start")).cast("int") if most is None else F.least(F.lit(most), (F.col("end") - F.col("start")).cast("int"))
    x = x.withColumn("far", F.abs(F.col("pos") - F.col("peak")).cast("int")).withColumn("limit", limit)
    low = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.sqrt("far")).cast("int"))), lambda k: F.col("far") % k == 0)
    divisors = F.array_distinct(F.concat(low, F.transform(low, lambda k: F.call_function("div", F.col("far"), k).cast("int"))))
    periods = F.when(F.col("far") == 0, F.sequence(F.lit(1), F.col("limit"))).otherwise(F.filter(divisors, lambda k: k <= F.col("limit")))
    x = x.select("*", F.explode(periods).alias("p"))
    spots = F.floor((F.col("end") - 1 - F.col("peak")) / F.col("p")) + F.floor((F.col("peak") - F.col("start")) / F.col("p")) + 1
    s = x.groupBy(*keys, "start", "end", "p").agg(F.sum("value").alias("hit"), F.max(spots).alias("spots"), F.max("total").alias("total"))
    s = s.withColumn("score", F.col("hit") / F.col("spots") * F.col("hit") / F.col("total"))
    return s.groupBy(*keys, "start", "end").agg(F.max_by("p", F.struct("score", "p")).alias("period"), F.max("score").alias("score"))


def flank_windows(sites: DataFrame, reach: int) -> DataFrame:
    """The windows before and after each site ``s``: ``[s-W, e-2)``, or ``[0, e-1)`` near the start, and ``[s+2, e+W)``."""
    s, e = F.col("start"), F.col("end")
    up = F.struct(F.lit("up").alias("side"), F.when(s - reach < 0, 0).otherwise(s - reach).alias("w_start"), F.when(s - reach < 0, e - 1).otherwise(e - 2).alias("w_end"))
    down = F.struct(F.lit("down").alias("side"), (s + 2).alias("w_start"), (e + reach).alias("w_end"))
    return sites.select("*", F.inline(F.array(up, down)))


def moving_average(df: DataFrame, by: list[str], order: str, value: str, reach: int, shard: int = SHARD, partitions: int | None = None) -> DataFrame:
    """Mean over ``reach`` rows to each side. Rows are numbered, and numbers put in shards, so no window holds a group."""
    rows = numbered(df, by, [order], "_number", partitions)
    return around(rows, by, "_number", reach, {"smooth": F.avg(value)}, shard).drop("_number")
