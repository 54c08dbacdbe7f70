import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import annotation, bias, consensus, quant, reads, stats


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", p) for p in (0.01, 0.02, 0.03, 0.5)] + [("b", None), ("b", 0.2)], "g string, p double")
    out = stats.benjamini_hochberg(df, ["g"], "p").collect()
    assert sorted((r.g, r.p or -1, r.fdr and round(r.fdr, 9)) for r in out) == [("a", 0.01, 0.04), ("a", 0.02, 0.04), ("a", 0.03, 0.04), ("a", 0.5, 0.5), ("b", -1, None), ("b", 0.2, 0.2)]
    rng = random.Random(3)
    ps = [round(rng.random() ** 3, 3) for _ in range(500)]
    got = {r.p: r.fdr for r in stats.benjamini_hochberg(spark.createDataFrame([("x", p) for p in ps], "g string, p double"), ["g"], "p").collect()}
    order, least, want = sorted(ps), 1.0, {}
    for rank in range(len(ps), 0, -1):
        least = min(least, order[rank - 1] * len(ps) / rank)
        want[order[rank - 1]] = least
    assert all(math.isclose(got[p], want[p]) for p in ps)


def test_ecdf_and_fisher(spark):
    null = spark.createDataFrame([("s", v) for v in (1.0, 2.0, 2.0, 4.0)], "k string, x double")
    test = spark.createDataFrame([("s", 2.0), ("s", 0.5), ("t", 1.0)], "k string, x double")
    out = {(r.k, r.x): r.p for r in stats.ecdf(test, null, ["k"], "x", "p").collect()}
    assert out == {("s", 2.0): 0.75, ("s", 0.5): 0.0, ("t", 1.0): None}
    row = spark.range(1).select(stats.fisher(F.lit(0.01), F.lit(0.2)).alias("a"), stats.fisher(F.lit(0.0), F.lit(0.2)).alias("b"), stats.fold_change(F.lit(3.0), F.lit(1.0)).alias("c")).first()
    assert math.isclose(row.a, 0.0144292162, rel_tol=1e-8) and row.b == 0 and row.c == 2


def test_spacing_against_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(400), rng.randrange(9), i) for i in range(200)]
    got = stats.spaced(spark.createDataFrame(rows, "g string, x long, s int, i int"), ["g"], "x", [F.col("s").asc(), F.col("i").asc()])
    kept = []
    for g, x, s, i in sorted(rows, key=lambda r: (r[2], r[3])):
        if all(h != g or abs(x - y) > 5 for h, y, _ in kept):
            kept.append((g, x, i))
    assert sorted(r.i for r in got.collect()) == sorted(k[2] for k in kept)


def exons(spark, rows):
    return spark.createDataFrame(rows, "chrom string, strand string, gene string, tx string, start long, end long")


def test_classes(spark):
    ex = exons(spark, [
        ("c", "+", "one", "one.1", 100, 200), ("c", "+", "two", "two.1", 2000, 2100), ("c", "+", "two", "two.1", 3000, 3100),
        ("c", "-", "three", "three.1", 6000, 6100), ("c", "-", "three", "three.1", 7000, 7100),
    ])
    points = [("S", 150, "+"), ("P", 2050, "+"), ("D", 3050, "+"), ("U", 1700, "+"), ("I", 2500, "+"), ("A", 6050, "+"), ("IA", 6500, "+"), ("N", 5000, "-"), ("N", 9000, "+")]
    f = spark.createDataFrame([(i, "c", s, at, at + 1) for i, (_, at, s) in enumerate(points)], "fid long, chrom string, strand string, start long, end long")
    got = {r.fid: r.label for r in annotation.classify(f, ex).collect()}
    assert [got[i] for i in range(len(points))] == [p[0] for p in points]


def test_transcript_relations(spark):
    ex = exons(spark, [
        ("c", "+", "g", "a", 10, 20), ("c", "+", "g", "a", 30, 40), ("c", "+", "g", "b", 5, 20), ("c", "+", "g", "b", 30, 50), ("c", "+", "g", "d", 12, 18),
    ])
    t = annotation.transcripts(ex)
    got = {(r.a_tx, r.b_tx): r for r in annotation.compare_transcripts(t).collect()}
    assert got["a", "b"].same_chain and got["a", "b"].truncation and not got["a", "b"].contained
    assert not got["a", "d"].same_chain and not got["b", "d"].contained
    assert {(r.a_tx, r.b_tx) for r in annotation.mergeable(annotation.compare_transcripts(t)).collect()} == {("a", "b")}
    assert {r.tx: r.start for r in annotation.terminal_exons(ex).collect()} == {"a": 10, "b": 5, "d": 12}


def test_normalisation_and_scale(spark):
    q = spark.createDataFrame([("A", 10.0, 1000), ("B", 10.0, 500)], "gene string, reads double, length long")
    assert {r.gene: round(r.tpm, 3) for r in quant.normalise(q).collect()} == {"A": 333333.333, "B": 666666.667}
    body = spark.createDataFrame([("A", 500.0, 1000, 1e6)], "gene string, reads double, length long, tpm double")
    end = spark.createDataFrame([("A", 100.0), ("Z", 9.0)], "gene string, reads double")
    assert math.isclose(quant.scale_ratio(end, body).first().scale, 2.0)


def test_isoforms_follow_unique_edges(spark):
    ex = spark.createDataFrame([("g", "a", 0, 100), ("g", "b", 50, 200)], "gene string, tx string, start long, end long")
    e = quant.edges(ex, ["gene"])
    assert sorted((r.start, r.end, r.txs) for r in e.collect()) == [(0, 50, ["a"]), (50, 100, ["a", "b"]), (100, 200, ["b"])]
    r = e.withColumn("reads", F.when(F.size("txs") == 2, 60.0).when(F.col("start") == 0, 100.0).otherwise(100.0))
    got = {x.tx: x.reads for x in quant.isoform_reads(r).collect()}
    assert math.isclose(sum(got.values()), 260) and got["a"] > 100 + 30


def test_rescue_gives_all_weight(spark):
    unique = spark.createDataFrame([("c", "+", 1, 3.0), ("c", "+", 2, 1.0)], "chrom string, strand string, pos long, value double")
    multi = spark.createDataFrame([("r", "c", "+", 1, 1.0, 2), ("r", "c", "+", 2, 1.0, 2), ("s", "c", "+", 8, 1.0, 2), ("s", "c", "+", 9, 1.0, 2)], "read string, chrom string, strand string, pos long, weight double, n_map int")
    got = {r.pos: r.value for r in reads.rescue(unique, multi).collect()}
    assert got == {1: 3.75, 2: 1.25, 8: 0.5, 9: 0.5}


def test_consensus(spark):
    rows = [("c", 0, 10, 1.0), ("c", 2, 12, 1.0), ("c", 20, 30, 1.0), ("c", 20, 30, 2.0), ("c", 25, 40, 1.0), ("c", 32, 45, 9.0)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, score double")
    got = sorted((r.start, r.end, r.n) for r in consensus.consensus(df, ["chrom"]).collect())
    assert got[0] == (0, 12, 2) and (20, 30, 2) in got and (32, 45, 1) in got and len(got) == 3


def test_bias_of_uniform_reads_is_one(spark):
    s = spark.createDataFrame([(i, k) for i, k in enumerate(["ACAC", "CACA"])], "id long, seq string")
    w = bias.bias_weight(s, bias.kmer_bias(s, 1, 4), bias.baseline_kmers(s, 1), "id", 1, 4)
    assert all(math.isclose(r.weight, 1.0) for r in w.collect())


@pytest.mark.parametrize("values,want", [([0, 0, 1, 0, 0], 1), ([1, 1, 1, 1, 1], 2)])
def test_bandwidth(values, want):
    import pandas as pd

    assert stats.bandwidth_of(pd.Series(values)) == want
