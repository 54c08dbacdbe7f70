from helixframe.operators import coverage


def test_runs_of_equal_rows_cross_shard_borders(spark):
    rows = [("c", "+", p, s, v) for p in range(3, 40) for s, v in (("a", 1.0), ("b", 2.0 if p < 35 else 3.0))] + [("c", "+", p, "a", 1.0) for p in (47, 49, 64)] + [("c", "-", p, "b", 2.0) for p in (15, 16)]
    cov = spark.createDataFrame(rows, "chrom string, strand string, pos long, sample string, value double")
    got = sorted(tuple(r) for r in coverage.pivot_runs(cov, "sample", ["a", "b"], shard=16).collect())
    assert got == [("c", "+", 3, 35, 1.0, 2.0), ("c", "+", 35, 40, 1.0, 3.0), ("c", "+", 47, 48, 1.0, 0.0), ("c", "+", 49, 50, 1.0, 0.0), ("c", "+", 64, 65, 1.0, 0.0), ("c", "-", 15, 17, 0.0, 2.0)]


def test_runs_of_equal_rows_cross_the_default_border(spark):
    at = coverage.SHARD
    cov = spark.createDataFrame([("c", "+", at + o, "a", 1.0) for o in range(-3, 3)], "chrom string, strand string, pos long, sample string, value double")
    assert [tuple(r) for r in coverage.pivot_runs(cov, "sample", ["a"]).collect()] == [("c", "+", at - 3, at + 3, 1.0)]
