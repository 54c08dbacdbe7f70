"""Windows over long or hot groups, taken apart into shards.

Two forms.  Rows of a group are ranged by value: a range partition holds a stretch of
the order, and what lies before it is one carried row a partition and group.  Or
positions lie on an axis: a shard holds a stretch of the axis, and rows within reach
of a border are copied to the shard beyond it.  Either way no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.periods import SHARD, _shard
from helixframe.session import materialize, partitions_for

#: Bytes of input for one range partition.
PARTITION_BYTES = 64 << 20


def ranged(df: DataFrame, by: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` with ``_p``, the number of the range partition of (``by``, ``order``) that a row is in.

    Written once into the shared folder, so that the numbers stay as they are.
    """
    count = partitions or partitions_for(df, PARTITION_BYTES)
    return materialize(df.repartitionByRange(count, *by, *order).withColumn("_p", F.spark_partition_id()), "ranged")


def _join_on(by: list[str], a: DataFrame, b: DataFrame) -> Column:
    on = a["_p"] == b["_p"]
    for c in by:
        on = on & a[c].eqNullSafe(b[c])
    return on


def carried(r: DataFrame, by: list[str], sums: dict[str, str]) -> DataFrame:
    """``r`` (of ``ranged``) with, for each name in ``sums``, the sum of its column over the partitions before, and ``total_`` + name."""
    each = r.groupBy(*by, "_p").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    own = Window.partitionBy(*by)
    for n in sums:
        each = each.withColumn(f"total_{n}", F.sum(n).over(own)).withColumn(n, F.coalesce(F.sum(n).over(before), F.lit(0)))
    return r.join(each, _join_on(by, r, each), "left").select(r["*"], *[each[c] for n in sums for c in (n, f"total_{n}")])


def running_sum(df: DataFrame, by: list[str], order: str, value: str, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` up to and with the row in ``order``, and ``total_name`` of the group; ``order`` has no ties."""
    r = carried(ranged(df, by, [order], partitions), by, {"_carry": value})
    local = F.sum(value).over(Window.partitionBy(*by, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn(name, local + F.col("_carry")).withColumnRenamed("total__carry", f"total_{name}").drop("_carry", "_p")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "number", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``, the place of each row of its group in ``order``, from 1 on."""
    r = ranged(df.withColumn("_one", F.lit(1).cast("bigint")), by, order, partitions)
    local = F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order))
    return carried(r, by, {"_carry": "_one"}).withColumn(name, local + F.col("_carry")).drop("_carry", "total__carry", "_one", "_p")


def around(df: DataFrame, by: list[str], at: str, reach: int, results: dict[str, Column], shard: int = SHARD) -> DataFrame:
    """``df`` with each of ``results``, an aggregate over the rows of ``by`` within ``reach`` of the row's ``at``, its own included.

    A row within reach of the border of its shard is copied to the neighbour, where it counts but is not given out.
    """
    shard = max(shard, reach)
    place = F.pmod(at, F.lit(shard))
    home = _shard(F.col(at), shard)
    rows = [F.struct(home.alias("_h"), F.lit(True).alias("_own"))]
    left = F.when(place < reach, F.struct((home - 1).alias("_h"), F.lit(False).alias("_own")))
    right = F.when(place >= shard - reach, F.struct((home + 1).alias("_h"), F.lit(False).alias("_own")))
    copies = F.filter(F.array(*rows, left, right), lambda x: x.isNotNull())
    spread = df.select("*", F.inline(copies))
    w = Window.partitionBy(*by, "_h").orderBy(at).rangeBetween(-reach, reach)
    return spread.select("*", *[c.over(w).alias(n) for n, c in results.items()]).where("_own").drop("_h", "_own")
