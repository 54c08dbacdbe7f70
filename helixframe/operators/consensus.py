"""Consensus of overlapping features of several samples.

Features are put into overlap groups relationally.  A group whose features share a
position is one consensus.  Any other group is settled by itself: its distinct
starts and ends are weighed by how many features use them, and edges are taken
from left to right by count, then score, then position.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.intervals import cluster


def _resolve(starts: list[int], ends: list[int], counts: list[int], scores: list[float]) -> list[tuple[int, int, int, float]]:
    weight = {(s, e): (n, x) for s, e, n, x in zip(starts, ends, counts, scores)}
    out: list[tuple[int, int, int, float]] = []
    at = min(starts)
    rest = dict(weight)
    while rest:
        first = min((e for s, e in rest if s >= at), default=None)
        if first is None:
            break
        # the candidates that begin before the first end: they exclude each other
        rivals = {k: v for k, v in rest.items() if at <= k[0] < first}
        best = max(rivals, key=lambda k: (rivals[k][0], rivals[k][1], -k[0], k[1]))
        out.append((*best, int(rivals[best][0]), float(rivals[best][1])))
        at = best[1]
        rest = {k: v for k, v in rest.items() if k[0] >= at}
    return out


def consensus(features: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """``keys``, start, end, ``n`` features behind it and their summed score."""
    c = cluster(features.select(*keys, "start", "end", F.coalesce(F.col(score), F.lit(0.0)).cast("double").alias("score")), keys, book_ended=False)
    group = [*keys, "c_start"]
    bounds = c.groupBy(*group).agg(F.max("start").alias("s"), F.min("end").alias("e"), F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))
    simple = bounds.where("s < e").select(*keys, "start", "end", "n", "score")
    # equal intervals are counted before the group is gathered, so copies do not swell it
    hard = c.join(bounds.where("s >= e").select(*group), group, "left_semi").groupBy(*group, "start", "end").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _resolve(pdf["start"].tolist(), pdf["end"].tolist(), pdf["n"].tolist(), pdf["score"].tolist())
        out = pd.DataFrame(rows, columns=["start", "end", "n", "score"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    kinds = ", ".join(f"{k} {features.schema[k].dataType.simpleString()}" for k in keys)
    return simple.unionByName(hard.groupBy(*group).applyInPandas(run, f"{kinds}, start bigint, end bigint, n bigint, score double"))
