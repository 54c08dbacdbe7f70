"""Per-base coverage: expansion, combination, run-length encoding, masks, normalisation, liftover.

``cov`` tables hold one row a covered position: keys, ``pos`` (0-based), ``value``;
absent positions are 0.  ``runs`` hold half-open ``start``, ``end`` of equal value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.intervals import overlap_join
from helixframe.operators.periods import SHARD, _shard

KEYS = ["chrom", "strand"]


def segment_runs(segments: DataFrame, keys: list[str] = KEYS, shard: int = SHARD) -> DataFrame:
    """Runs covered by half-open segments (``start``, ``end``, ``value``), with the summed value of those that cover them.

    A segment is two steps, up at its start and down at its end; steps are summed by
    position, and added up within shards of the axis with one carried row a shard.
    So the rows follow the ends of segments and not the bases.  A count of open
    segments goes along, so that rounding leaves no run where nothing lies.
    """
    step = F.array(F.struct(F.col("start").alias("pos"), F.col("value").alias("v"), F.lit(1).alias("n")), F.struct(F.col("end").alias("pos"), (-F.col("value")).alias("v"), F.lit(-1).alias("n")))
    steps = segments.where("start < end").select(*keys, F.inline(step)).groupBy(*keys, "pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    steps = steps.withColumn("h", _shard(F.col("pos"), shard))
    local = Window.partitionBy(*keys, "h").orderBy("pos")
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    inside = steps.select(*keys, "h", "pos", F.lead("pos").over(local).alias("next"), F.sum("v").over(upto).alias("v"), F.sum("n").over(upto).alias("n"))
    along = Window.partitionBy(*keys).orderBy("h")  # one row a shard
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    edges = steps.groupBy(*keys, "h").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.min("pos").alias("first"))
    edges = edges.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("h").alias("_h"), F.lead("first").over(along).alias("_next"), F.sum("v").over(before).alias("_v"), F.sum("n").over(before).alias("_n"))
    on = F.col("h") == F.col("_h")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = inside.join(edges, on)
    return out.where(F.col("n") + F.coalesce("_n", F.lit(0)) > 0).select(*keys, F.col("pos").alias("start"), F.coalesce("next", "_next").alias("end"), (F.col("v") + F.coalesce("_v", F.lit(0))).alias("value"))


def expand_runs(runs: DataFrame, keys: list[str] = KEYS, on_overlap: str = "sum", order: str | None = None, shard: int = SHARD) -> DataFrame:
    """Runs to positions.  Zero values are skipped; positions given twice add up, or the last in ``order`` wins."""
    there = runs.where("value <> 0 and start < end")
    positions = F.explode(F.sequence("start", F.col("end") - 1)).alias("pos")
    if on_overlap == "sum":
        return segment_runs(there, keys, shard).select(*keys, positions, "value")
    return there.select("*", positions).groupBy(*keys, "pos").agg(F.max_by("value", order or "start").alias("value"))


def combine(parts: list[tuple[DataFrame, float]], keys: list[str] = KEYS) -> DataFrame:
    """Weighted sum of coverages; a position absent from a part counts 0 there. Zero sums are dropped."""
    scaled = [df.select(*keys, "pos", (F.col("value") * scale).alias("value")) for df, scale in parts]
    return reduce(DataFrame.unionByName, scaled).groupBy(*keys, "pos").agg(F.sum("value").alias("value")).where("value <> 0")


def _equal_runs(c: DataFrame, keys: list[str], shard: int, values: list[str] = ["value"]) -> DataFrame:
    """Maximal runs of successive positions of equal ``values``, found within shards and joined across their borders."""
    c = c.withColumn("h", _shard(F.col("pos"), shard))
    w = Window.partitionBy(*keys, "h", *values).orderBy("pos")
    local = c.withColumn("g", F.col("pos") - F.row_number().over(w)).groupBy(*keys, "h", *values, "g").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    touches = (F.pmod("start", F.lit(shard)) == 0) | (F.pmod("end", F.lit(shard)) == 0)
    edge = local.where(touches)
    v = Window.partitionBy(*keys, *values).orderBy("start")
    edge = edge.withColumn("opens", F.when(F.col("start") == F.lag("end").over(v), 0).otherwise(1)).withColumn("g", F.sum("opens").over(v))
    joined = edge.groupBy(*keys, *values, "g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    columns = [*keys, "start", "end", *values]
    return local.where(~touches).select(*columns).unionByName(joined.select(*columns))


def encode_runs(cov: DataFrame, keys: list[str] = KEYS, digits: int | None = 2, shard: int = SHARD) -> DataFrame:
    """Positions to maximal runs of equal (rounded) value; zeros are dropped, negatives kept.

    Runs are found within shards of the axis and joined across their borders, so
    no window holds a whole chromosome.
    """
    value = F.bround("value", digits) if digits is not None else F.col("value")
    return _equal_runs(cov.withColumn("value", value).where("value <> 0"), keys, shard)


def pivot_runs(cov: DataFrame, key: str, names: list[str], keys: list[str] = KEYS, shard: int = SHARD) -> DataFrame:
    """Several coverages side by side, one column for each of ``names``; maximal runs of equal rows."""
    wide = cov.groupBy(*keys, "pos").pivot(key, names).agg(F.sum("value")).na.fill(0.0, names)
    inner = [f"v{i}" for i in range(len(names))]
    out = _equal_runs(wide.select(*keys, "pos", *[F.col(f"`{n}`").alias(i) for n, i in zip(names, inner)]), keys, shard, inner)
    return out.select(*keys, "start", "end", *[F.col(i).alias(n) for n, i in zip(names, inner)])


def end_counts(reads: DataFrame, end: str = "5p", keys: list[str] = KEYS) -> DataFrame:
    """Weight of reads (``start``, ``end``, ``weight``) at their 5' or 3' base."""
    first = (F.col("strand") == "+") if end == "5p" else (F.col("strand") == "-")
    return reads.groupBy(*keys, F.when(first, F.col("start")).otherwise(F.col("end") - 1).alias("pos")).agg(F.sum("weight").alias("value"))


def body_coverage(reads: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Summed weight of the reads over each base."""
    return expand_runs(reads.withColumnRenamed("weight", "value"), keys)


def rpm(cov: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Value per million; ``total`` is a one-row table with ``total``, else the sum of ``cov``."""
    total = total if total is not None else cov.agg(F.sum("value").alias("total"))
    return cov.join(F.broadcast(total.select("total"))).withColumn("rpm", F.col("value") * 1e6 / F.col("total")).drop("total")  # one row


def mask_positions(mask: DataFrame, mode: str) -> DataFrame:
    """Masked positions of BED features: ``inside`` (closed end), or the one base ``up`` or ``down`` stream."""
    plus = F.col("strand") == "+"
    if mode == "inside":
        return mask.select("chrom", "strand", "start", (F.col("end") + 1).alias("end"))
    at = F.when(plus, F.col("end")).otherwise(F.col("start") - 1) if mode == "up" else F.when(plus, F.col("start") - 1).otherwise(F.col("end"))
    return mask.select("chrom", "strand", at.alias("start"), (at + 1).alias("end"))


def mask(cov: DataFrame, features: DataFrame, mode: str = "inside", keys: list[str] = KEYS) -> DataFrame:
    """Coverage outside the masked positions. Masks of one base meet it by position, others by their bins."""
    if mode != "inside":
        at = mask_positions(features, mode).select(*keys, F.col("start").alias("pos")).distinct()
        return cov.join(at, [*keys, "pos"], "left_anti")
    points = cov.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + 1)
    return overlap_join(points, mask_positions(features, mode), keys, how="left_anti", a_levels=(0,)).drop("start", "end")


def feature_matrix(features: DataFrame, cov: DataFrame, sample: str, samples: list[str], name: str = "name", keys: list[str] = KEYS) -> DataFrame:
    """Feature by sample: coverage summed over the union of positions of the intervals of a name."""
    from helixframe.operators.intervals import merge

    points = cov.select(*keys, F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value", F.col(sample).alias("_sample"))
    pairs = overlap_join(merge(features, [*keys, name]), points, keys, b_levels=(0,))
    wide = pairs.groupBy(F.col(f"a_{name}").alias(name)).pivot("b__sample", samples).agg(F.sum("b_value"))
    return features.select(name).distinct().join(wide, name, "left").na.fill(0.0, samples)


def feature_lengths(features: DataFrame, name: str = "name", keys: list[str] = KEYS) -> DataFrame:
    """Bases under the union of the intervals of each name, beside a count matrix."""
    from helixframe.operators.intervals import merge

    return merge(features.select(*keys, "start", "end", name), [*keys, name]).groupBy(name).agg(F.sum(F.col("end") - F.col("start")).alias("length"))


def to_transcripts(cov: DataFrame, exons: DataFrame) -> DataFrame:
    """Genome to transcript coordinates: ``tx``, ``tx_pos``, ``value``.

    ``exons``: chrom, strand, tx, start, end (half-open).  A base in several
    isoforms gives several rows; minus transcripts are reversed.
    """
    w = Window.partitionBy("tx").orderBy("start", "end")
    own = Window.partitionBy("tx")
    length = F.col("end") - F.col("start")
    e = exons.withColumn("before", F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum(length).over(own))
    points = cov.select("chrom", "strand", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value")
    hits = overlap_join(points, e, KEYS, a_levels=(0,))
    along = F.col("b_before") + F.col("a_start") - F.col("b_start")
    return hits.select(F.col("b_tx").alias("tx"), F.when(F.col("a_strand") == "-", F.col("b_total") - 1 - along).otherwise(along).alias("tx_pos"), F.col("a_value").alias("value"))
