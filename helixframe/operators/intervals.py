"""Interval joins on half-open intervals ``[start, end)``.

Spark has no interval join of its own: a range condition alone becomes a nested
loop.  Here both sides are put into bins and joined on equal bins.  There are three
bin widths; each interval uses the least that covers it with few bins, and a pair
of intervals meets at the wider of their two widths, with the pair of widths as
part of the key.  So a long interval is not copied into thousands of bins, and a
wide bin does not compare short intervals with each other.  The pair is kept in
the bin of its first shared position only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.periods import SHARD, _shard, merge_periods
from helixframe.operators.shards import numbered

#: Least bin width, the factor to the next, and the number of widths.
WIDTH, FACTOR, LEVELS = 1024, 64, 3


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _level(width: int) -> Column:
    length = F.col("end") - F.col("start")
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(length <= 4 * width * FACTOR**k, k).otherwise(out)
    return out


def _meeting(la: Column, lb: Column, w: Column) -> Callable[[Column], Column]:
    return lambda b: F.struct(la.alias("_la"), lb.alias("_lb"), b.alias("_bin"), w.alias("_w"))


def _binned(df: DataFrame, side: str, width: int, others: tuple[int, ...]) -> DataFrame:
    """A row for each (own level, other level, bin) in which a row can meet the other side."""
    df = df.where("start < end").withColumn("_l", _level(width))
    parts = []
    for other in others:
        level = F.greatest("_l", F.lit(other))
        w = F.element_at(F.array(*[F.lit(width * FACTOR**k) for k in range(LEVELS)]), level + 1)
        bins = F.sequence(_div(F.col("start"), w), _div(F.col("end") - 1, w))
        mine, theirs = (F.col("_l"), F.lit(other)) if side == "a" else (F.lit(other), F.col("_l"))
        parts.append(F.transform(bins, _meeting(mine, theirs, w)))
    return df.select("*", F.inline(F.flatten(F.array(*parts)))).drop("_l")


def overlap_join(
    a: DataFrame, b: DataFrame, keys: list[str], width: int = WIDTH, how: str = "inner", a_levels: tuple[int, ...] = tuple(range(LEVELS)), b_levels: tuple[int, ...] = tuple(range(LEVELS))
) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` that share a position, with equal ``keys``.

    Columns come out as ``a_*`` and ``b_*``.  ``how``: inner, left_semi or
    left_anti (rows of ``a``, as given).  Empty intervals and null keys meet nothing.
    ``a_levels`` and ``b_levels`` tell which bin widths a side can have: where all of
    its intervals have up to 4 ``width`` bases, (0,), so that the other side's rows
    are not copied for wider ones.
    """
    # whether a row meets anything depends on its keys and ends only
    x = _binned(a if how == "inner" else a.select(*keys, "start", "end").distinct(), "a", width, b_levels)
    y = _binned(b if how == "inner" else b.select(*keys, "start", "end").distinct(), "b", width, a_levels)
    on = F.lit(True)
    x = x.toDF(*[c if c in ("_la", "_lb", "_bin", "_w") else f"a_{c}" for c in x.columns])
    y = y.drop("_w").toDF(*[f"{c}_" if c in ("_la", "_lb", "_bin") else f"b_{c}" for c in y.drop("_w").columns])
    for k in keys:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    on = on & (F.col("_la") == F.col("_la_")) & (F.col("_lb") == F.col("_lb_")) & (F.col("_bin") == F.col("_bin_"))
    touch = (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))
    if how == "inner":
        first = _div(F.greatest("a_start", "b_start"), F.col("_w")) == F.col("_bin")
        return x.join(y, on & touch & first).drop("_la", "_lb", "_bin", "_w", "_la_", "_lb_", "_bin_")
    same = [*keys, "start", "end"]
    hits = x.join(y, on & touch, "left_semi").select(*[F.col(f"a_{c}").alias(c) for c in same]).distinct()
    return a.join(hits, same, how).select(*a.columns)


def map_overlaps(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, value: str, how: str = "max", width: int = WIDTH) -> DataFrame:
    """``a_id`` and the max, min, sum or count of ``value`` over the overlapping rows of ``b``; 0 without any."""
    pairs = overlap_join(a.select(*keys, "start", "end", a_id), b.select(*keys, "start", "end", F.col(value).alias("_v")), keys, width)
    got = pairs.groupBy(F.col(f"a_{a_id}").alias(a_id)).agg(getattr(F, how)("b__v").alias("mapped"))
    return a.select(a_id).join(got, a_id, "left").select(a_id, F.coalesce("mapped", F.lit(0)).alias("mapped"))


def covered_sum(features: DataFrame, runs: DataFrame, keys: list[str], name: str, width: int = WIDTH) -> DataFrame:
    """Per feature ``name`` the sum of ``runs.value`` over its positions; features without coverage have 0."""
    pairs = overlap_join(features.select(*keys, "start", "end", name), runs.select(*keys, "start", "end", "value"), keys, width)
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    got = pairs.groupBy(F.col(f"a_{name}").alias(name)).agg(F.sum(F.col("b_value") * shared).alias("total"))
    return features.select(name).distinct().join(got, name, "left").select(name, F.coalesce("total", F.lit(0.0)).alias("total"))


def subtract(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, width: int = WIDTH) -> DataFrame:
    """What is left of each interval of ``a`` outside all of ``b``: ``keys``, ``a_id``, ``start``, ``end``."""
    cut = overlap_join(a.select(*keys, "start", "end", a_id), b.select(*keys, "start", "end"), keys, width)
    cut = cut.select(*[F.col(f"a_{k}").alias(k) for k in keys], F.col(f"a_{a_id}").alias(a_id), F.col("a_start").alias("s"), F.col("a_end").alias("e"),
                     F.greatest("a_start", "b_start").alias("c"), F.least("a_end", "b_end").alias("d"))
    # sentinels: the interval's own ends; a row without cutters passes whole
    ends = a.where("start < end").select(*keys, a_id, F.col("start").alias("s"), F.col("end").alias("e"), F.col("end").alias("c"), F.col("end").alias("d"))
    w = Window.partitionBy(*keys, a_id, "s", "e").orderBy("c", "d").rowsBetween(Window.unboundedPreceding, -1)
    pieces = cut.unionByName(ends).distinct().withColumn("p", F.coalesce(F.max("d").over(w), F.col("s")))
    return pieces.where("p < c").select(*keys, a_id, F.col("p").alias("start"), F.col("c").alias("end"))


def merge(df: DataFrame, keys: list[str], book_ended: bool = True) -> DataFrame:
    """Maximal runs per ``keys``: ``start``, ``end``; intervals that only touch merge if ``book_ended``."""
    closed = df.select(*keys, "start", (F.col("end") - 1).alias("stop"))
    out = merge_periods(closed, keys, "start", "stop", adjoin=1 if book_ended else 0)
    return out.select(*keys, "start", (F.col("stop") + 1).alias("end"))


def cluster(df: DataFrame, keys: list[str], book_ended: bool = True, width: int = WIDTH) -> DataFrame:
    """Every row with ``c_start``, ``c_end`` of the merged run that it lies in."""
    runs = merge(df, keys, book_ended)
    points = df.withColumn("_s", F.col("start")).withColumn("_e", F.col("end")).withColumn("end", F.col("start") + 1)
    out = overlap_join(points, runs, keys, width, a_levels=(0,))
    kept = [F.col(f"a_{c}").alias(c) for c in df.columns if c not in ("start", "end")]
    return out.select(*kept, F.col("a__s").alias("start"), F.col("a__e").alias("end"), F.col("b_start").alias("c_start"), F.col("b_end").alias("c_end"))


def merge_collapse(df: DataFrame, keys: list[str], column: str, book_ended: bool = True) -> DataFrame:
    """Merged runs with ``collapsed``, the values of ``column`` of the rows in each, sorted and joined by commas, and the ``least`` of them."""
    c = cluster(df.select(*keys, "start", "end", F.col(column).alias("_v")), keys, book_ended)
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_v")), lambda x: x.cast("string")), ",")
    return c.groupBy(*keys, F.col("c_start").alias("start"), F.col("c_end").alias("end")).agg(text.alias("collapsed"), F.min("_v").alias("least"))


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is in a list of ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi").select(*df.columns)


def _nearest_before(a: DataFrame, b: DataFrame, keys: list[str], shard: int) -> DataFrame:
    """For (keys, a_id, at) of ``a`` the last (at, ord, b_id) of ``b`` with ``b.at <= a.at``; among equals the least ord.

    Works within shards of the axis; what comes before a shard is one row a shard.
    """
    x = a.select(*keys, "at", F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("ord"), F.col("a_id"), F.lit(None).cast("bigint").alias("b_id"))
    y = b.select(*keys, "at", F.lit(0).alias("kind"), F.col("ord"), F.lit(None).cast("bigint").alias("a_id"), F.col("b_id"))
    both = x.unionByName(y).withColumn("h", _shard(F.col("at"), shard))
    hit = F.when(F.col("kind") == 0, F.struct("at", "ord", "b_id"))
    w = Window.partitionBy(*keys, "h").orderBy("at", "kind", F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("hit", F.last(hit, ignorenulls=True).over(w)).where("kind = 1").select(*keys, "h", "a_id", "at", "hit")
    best = F.max(F.when(F.col("kind") == 0, F.struct(F.col("at"), (-F.col("ord")).alias("o"), F.col("b_id"))))
    edge = both.groupBy(*keys, "h").agg(best.alias("m"))
    before = Window.partitionBy(*keys).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.select(*keys, "h", F.last("m", ignorenulls=True).over(before).alias("m"))
    out = inside.join(carry, [*keys, "h"], "left")
    found = F.coalesce("hit", F.struct(F.col("m.at").alias("at"), (-F.col("m.o")).alias("ord"), F.col("m.b_id").alias("b_id")))
    return out.select("a_id", "at", found.alias("f")).where("f.b_id is not null").select("a_id", F.col("f.b_id").alias("b_id"), F.col("f.ord").alias("ord"), (F.col("at") - F.col("f.at") + 1).alias("gap"))


def nearest(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, b_id: str, direction: str = "any", strand: str | None = None, width: int = WIDTH, shard: int = SHARD) -> DataFrame:
    """The nearest row of ``b`` for each row of ``a`` that has one: ``a_id``, ``b_id``, ``distance``.

    Overlap is distance 0, touching is 1.  ``direction`` "ahead" or "behind" keeps
    overlaps and the rows of ``b`` ahead of (behind) ``a`` along ``strand``, a
    column of ``a``; the distance of a row ahead is negative.  Ties go to the
    least ``b_id``.  Rows of ``a`` with no such ``b`` are left out.
    """
    flip = F.lit(False) if strand is None else F.coalesce(F.col(strand) == "-", F.lit(False))
    x = a.where("start < end").select(*keys, "start", "end", F.col(a_id).cast("bigint").alias("a_id"), flip.alias("flip"))
    y = b.where("start < end").select(*keys, "start", "end", F.col(b_id).cast("bigint").alias("b_id"))
    over = overlap_join(x, y, keys, width).groupBy(F.col("a_a_id").alias("a_id")).agg(F.min("b_b_id").alias("b_id"))
    found = [over.select("a_id", "b_id", F.lit(0).cast("bigint").alias("distance"))]
    left_of, right_of = ("~flip", "flip") if direction == "behind" else ("flip", "~flip")
    lefts = x if direction == "any" else x.where(F.expr(left_of.replace("~", "not ")))
    rights = x if direction == "any" else x.where(F.expr(right_of.replace("~", "not ")))
    sign = -1 if direction == "ahead" else 1
    before = _nearest_before(lefts.withColumn("at", F.col("start")), y.withColumn("at", F.col("end")).withColumn("ord", F.col("b_id")), keys, shard)
    after = _nearest_before(rights.withColumn("at", -F.col("end")), y.withColumn("at", -F.col("start")).withColumn("ord", F.col("b_id")), keys, shard)
    found += [d.select("a_id", "b_id", (F.col("gap") * sign).alias("distance")) for d in (before, after)]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    best = every.groupBy("a_id").agg(F.min_by(F.struct("b_id", "distance"), F.struct(F.abs("distance").alias("d"), F.col("b_id"))).alias("n"))
    return best.select(F.col("a_id").alias(a_id), F.col("n.b_id").alias(b_id), F.col("n.distance").alias("distance"))


SELECTORS = ("first", "last", "left", "right", "upstream", "downstream", "highscore", "lowscore")


def _preference(df: DataFrame, select: str, order: list[str], score: str, strand: str) -> list[Column]:
    place = F.struct(*order)
    along = F.when(F.col(strand) == "-", -F.col("end")).otherwise(F.col("start")) if strand in df.columns else F.col("start")
    return {
        "first": [place.asc()], "last": [F.desc(place)], "left": [F.col("start").asc(), place.asc()], "right": [F.desc("end"), place.asc()],
        "upstream": [along.asc(), place.asc()], "downstream": [F.desc(along), place.asc()], "highscore": [F.desc(score), place.asc()], "lowscore": [F.col(score).asc(), place.asc()],
    }[select]


def deduplicate(df: DataFrame, by: list[str], select: str = "first", order: list[str] | None = None, score: str = "score", strand: str = "strand", only_unique: bool = False) -> DataFrame:
    """One row of all rows with equal keys ``by``, wherever they stand.

    ``select``: first or last (in ``order``), left or right (by position), upstream
    or downstream (along the strand), highscore or lowscore.  ``only_unique`` keeps
    only keys with one row.
    """
    own = Window.partitionBy(*by)
    out = df.withColumn("_r", F.row_number().over(own.orderBy(*_preference(df, select, order or ["start", "end"], score, strand))))
    if only_unique:
        out = out.withColumn("_n", F.count(F.lit(1)).over(own)).where("_n = 1").drop("_n")
    return out.where("_r = 1").drop("_r")


def deduplicate_runs(
    df: DataFrame, by: list[str], sequence: list[str], within: list[str] = [], select: str = "first", score: str = "score", strand: str = "strand", only_unique: bool = False, partitions: int | None = None
) -> DataFrame:
    """One row of every run of equal keys ``by`` among rows that follow each other in ``sequence`` (which has no ties) in a group of ``within``.

    A key that comes back after another one begins a run of its own.  Rows are numbered
    without a window over a group; a run is where the number within the key lags
    behind by the same distance.  ``select`` is as in ``deduplicate``.
    """
    rows = df if within else df.withColumn("_all", F.lit(0))
    group = within or ["_all"]
    rows = numbered(rows, group, sequence, "_at", partitions)
    rows = numbered(rows, [*group, *by], sequence, "_in", partitions).withColumn("_run", F.col("_at") - F.col("_in"))
    out = deduplicate(rows, [*group, *by, "_run"], select, ["_at"], score, strand, only_unique)
    return out.select(*df.columns)


