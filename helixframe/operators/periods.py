"""Overlapping and gapped intervals per entity: continuous blocks and the gaps between.

Two-level merge for huge entities.  Intervals are clipped into shards of the
axis and merged within each shard; only coverage that touches a shard boundary is
stitched per entity, at most two pieces a shard.  An interval over many shards is
not expanded: its two ends are clipped, and the whole shards between are carried
as counts of opening and closing spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.session import materialize

#: Length of a shard of the axis.
SHARD = 1 << 18


def _shard(position: Column, length: int) -> Column:
    """Number of the shard of ``position``, rounded down for negatives too, without doubles."""
    return F.call_function("div", position - F.pmod(position, F.lit(length)), F.lit(length))


def _islands(df: DataFrame, by: list[str], adjoin: int) -> DataFrame:
    """Merge rows (s, e) that overlap or adjoin within ``by``."""
    w = Window.partitionBy(*by).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("opens", F.when(before.isNull() | (F.col("s") > before + adjoin), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    on = F.lit(True)
    for c in by:
        on = on & a[c].eqNullSafe(b[c])
    return on


def merge_periods(df: DataFrame, keys: list[str], start: str, stop: str, shard: int = SHARD, adjoin: int = 1) -> DataFrame:
    """Maximal runs of closed intervals that overlap or directly adjoin, per ``keys``.

    Returns ``keys`` + ``start`` + ``stop``.  ``adjoin`` is the step to the next
    position (0: only shared positions merge; positions then lie within 2^62).  Defined cases: rows with a null
    or reversed interval give nothing; a null key is an entity of its own;
    repeats and ties change nothing; an empty table gives none; further columns
    are ignored.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    if adjoin == 0:
        # on doubled positions neighbours lie two apart, so only shared positions adjoin and a cut at a border still does
        doubled = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keys, ks)], *[(F.col(f"`{c}`").cast("bigint") * 2).alias(a) for c, a in ((start, "s"), (stop, "e"))])
        out = merge_periods(doubled, ks, "s", "e", 2 * shard)
        return out.select(*[F.col(k).alias(c) for c, k in zip(keys, ks)], *[F.call_function("div", F.col(c), F.lit(2)).alias(c) for c in ("start", "stop")])
    base = df.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(keys, ks)],
        F.col(f"`{start}`").cast("bigint").alias("s"), F.col(f"`{stop}`").cast("bigint").alias("e"),
    ).where("s <= e")
    base = base.withColumn("h0", _shard(F.col("s"), shard)).withColumn("h1", _shard(F.col("e"), shard))
    none = F.lit(None).cast("bigint")

    def row(h: Column, s: Column, e: Column, d: int) -> Column:
        return F.struct(h.alias("h"), s.alias("s"), e.alias("e"), F.lit(d).alias("d"))

    head = row(F.col("h0"), F.col("s"), F.least(F.col("e"), (F.col("h0") + 1) * shard - 1), 0)
    tail = row(F.col("h1"), F.col("h1") * shard, F.col("e"), 0)
    # whole shards under a long interval, as an opening and a closing count
    opens, closes = row(F.col("h0") + 1, none, none, 1), row(F.col("h1"), none, none, -1)
    parts = F.when(F.col("h0") == F.col("h1"), F.array(head)).when(F.col("h0") + 1 == F.col("h1"), F.array(head, tail)).otherwise(F.array(head, tail, opens, closes))
    # one row a start: a shard has at most as many rows as positions, whatever the input holds
    pieces = base.select(*ks, F.inline(parts)).groupBy(*ks, "h", "s").agg(F.max("e").alias("e"), F.sum("d").alias("d"))
    pieces = materialize(pieces, "pieces")  # read by the local merge and by the count of spans
    local = _islands(pieces.where("s is not null").select(*ks, "h", "s", "e"), [*ks, "h"], adjoin)

    steps = pieces.groupBy(*ks, "h").agg(F.sum("d").alias("d"), F.max(F.when(F.col("s").isNotNull(), 1).otherwise(0)).alias("has"))
    along = Window.partitionBy(*ks).orderBy("h")
    steps = steps.withColumn("depth", F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.withColumn("next", F.lead("h").over(along)).where("depth > 0")
    spans = steps.select(*ks, (F.col("h") * shard).alias("s"), (F.col("next") * shard - 1).alias("e"))
    full = steps.where("has = 1").select(*ks, "h")

    touches = (F.pmod("s", F.lit(shard)) == 0) | (F.pmod("e", F.lit(shard)) == shard - 1)
    inner = local.where(~touches)
    inner = inner.join(full, _same(inner, full, [*ks, "h"]), "left_anti").select(*ks, "s", "e")
    stitched = _islands(local.where(touches).select(*ks, "s", "e").unionByName(spans), ks, adjoin)
    out = stitched.select(*ks, "s", "e").unionByName(inner)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keys, ks)], F.col("s").alias("start"), F.col("e").alias("stop"))


def period_gaps(blocks: DataFrame, keys: list[str], max_gap: int | None = None, shard: int = SHARD) -> DataFrame:
    """The positions between successive ``blocks`` (disjoint, with ``start`` and ``stop``) per ``keys``.

    Gaps inside a shard come from a window over that shard; gaps between shards
    come from one summary row a shard, so no window holds an entity's blocks.
    """
    b = blocks.select(*keys, "start", "stop", _shard(F.col("start"), shard).alias("_h"))
    w = Window.partitionBy(*keys, "_h").orderBy("start")
    inside = b.select(*keys, F.lag("stop").over(w).alias("_p"), F.col("start").alias("_n"))
    edges = b.groupBy(*keys, "_h").agg(F.min("start").alias("_n"), F.max("stop").alias("_m"))
    across = edges.select(*keys, F.lag("_m").over(Window.partitionBy(*keys).orderBy("_h")).alias("_p"), "_n")
    gaps = inside.unionByName(across).where("_p is not null and _n > _p + 1")
    if max_gap is not None:
        gaps = gaps.where(F.col("_n") - F.col("_p") - 1 <= max_gap)
    return gaps.select(*keys, (F.col("_p") + 1).alias("start"), (F.col("_n") - 1).alias("stop"))


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, stop: str, max_gap: int | None = None, shard: int = SHARD) -> DataFrame:
    """``keys``, ``kind`` (block or gap), ``start``, ``stop``; see the two functions above."""
    blocks = materialize(merge_periods(df, keys, start, stop, shard), "blocks")  # read twice
    gaps = period_gaps(blocks, keys, max_gap, shard)
    return blocks.select(*keys, F.lit("block").alias("kind"), "start", "stop").unionByName(
        gaps.select(*keys, F.lit("gap").alias("kind"), "start", "stop")
    )
