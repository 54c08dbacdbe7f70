from pyspark.sql import functions as F

from helixframe.operators import reads

LOCATION = "read string, chrom string, strand string, pos long, segments array<struct<start:long,end:long>>, weight double, n_map int"


def test_mass_is_summed_over_all_segments(spark):
    cov = spark.createDataFrame([("c", "+", 12, 2.0), ("c", "+", 21, 1.0), ("c", "+", 51, 1.0), ("c", "-", 10, 9.0)], "chrom string, strand string, pos long, value double")
    rows = [("r", "c", "+", 10, [(10, 13), (20, 22)], 1.0, 2), ("r", "c", "+", 50, [(50, 53)], 1.0, 2), ("s", "c", "+", 51, None, 1.0, 2), ("s", "c", "+", 70, [(70, 72)], 1.0, 2)]
    got = {(r.read, r.pos): r.share for r in reads.allocate(spark.createDataFrame(rows, LOCATION), cov).collect()}
    assert got == {("r", 10): 0.75, ("r", 50): 0.25, ("s", 51): 1.0, ("s", 70): 0.0}


def test_rescue_goes_on_until_a_round_shares_nothing(spark):
    unique = spark.createDataFrame([("c", "+", 0, 1.0)], "chrom string, strand string, pos long, value double")
    rows = []
    for i in range(7):  # each read gains mass from the one before
        rows += [(f"r{i}", "c", "+", i, [(i, i + 2)], 1.0, 2), (f"r{i}", "c", "+", 1000 + 10 * i, [(1000 + 10 * i, 1002 + 10 * i)], 1.0, 2)]
    got = {r.pos: r.value for r in reads.rescue(unique, spark.createDataFrame(rows, LOCATION)).where(F.col("value") > 0).collect()}
    assert got == {0: 2.0, **{i: 2.0 for i in range(1, 7)}, 7: 1.0}
