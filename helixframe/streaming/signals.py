"""Structured Streaming forms.

The originals of these operators are single-pass programs over sorted files; here a
stream of files is aggregated with state kept by Spark.  Event-time windows are an
extension beyond them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from helixframe.operators import signal


def read_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of Parquet files of coverage positions."""
    return spark.readStream.schema("chrom string, strand string, pos long, value double").parquet(folder)


def convolve_stream(cov: DataFrame, weights: list[tuple[int, float]]) -> DataFrame:
    """The convolution so far; late and repeated positions add up, so the order of the input does not matter."""
    return signal.convolve_rows(cov, weights)


def convolve_sorted(cov: DataFrame, weights: list[tuple[int, float]], snap: float = 1e-9) -> DataFrame:
    """The convolution of a stream whose positions come in order for each ``chrom`` and ``strand``, in append mode.

    The state of a strand is the positions within twice the reach of the kernel; what
    no later position can change is given out.  A row with a null ``pos`` ends its
    strand and gives out the rest.  A position below one of an earlier batch is an error.
    """
    offsets, shares = np.array([x for x, _ in weights]), np.array([w for _, w in weights])
    reach = int(np.abs(offsets).max())

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        positions, values, done, top = state.get if state.exists else ([], [], -(2**62), -(2**62))
        batch = pd.concat(list(parts))
        ends = bool(batch["pos"].isna().any())
        batch = batch.dropna(subset=["pos"])
        new = batch["pos"].to_numpy(np.int64)
        if len(new) and new.min() < top:
            raise ValueError(f"positions of {key} are not in order: {new.min()} after {top}")
        at, value = np.concatenate([np.array(positions, np.int64), new]), np.concatenate([np.array(values, float), batch["value"].to_numpy(float)])
        top = int(max(top, new.max())) if len(new) else top
        limit = 2**62 if ends else top - reach
        spread = (at[:, None] + offsets[None]).ravel()
        sums = (value[:, None] * shares[None]).ravel()
        own = (spread >= max(done, 0)) & (spread < limit)
        places, where = np.unique(spread[own], return_inverse=True)
        total = np.bincount(where, sums[own], len(places))
        keep = at >= limit - reach
        state.update((at[keep].tolist(), value[keep].tolist(), max(done, limit), top))
        good = total > snap
        yield pd.DataFrame({"chrom": key[0], "strand": key[1], "pos": places[good], "value": total[good]})

    return cov.groupBy("chrom", "strand").applyInPandasWithState(
        step, "chrom string, strand string, pos long, value double", "positions array<long>, vals array<double>, done long, top long", "append", GroupStateTimeout.NoTimeout
    )


def group_reads(lines: DataFrame) -> DataFrame:
    """Alignments of each read id so far, wherever in the stream they stand."""
    return lines.groupBy("read_id").agg(F.collect_list("line").alias("lines"), F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by event-time window and key; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and give its result as a table in memory (for tests and small results)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
