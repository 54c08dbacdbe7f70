from helixframe.operators import signal
from helixframe.streaming import signals


def test_stream_equals_batch(spark, tmp_path):
    cov = spark.createDataFrame([("c", "+", p, float(p % 5 + 1)) for p in range(40)], "chrom string, strand string, pos long, value double")
    folder = str(tmp_path / "in")
    cov.repartition(4).write.parquet(folder)
    weights = signal.kernel("laplace", 2, 2)
    out = signals.run_to_table(signals.convolve_stream(signals.read_coverage(spark, folder), weights), "smooth", str(tmp_path / "state"))
    want = {r.pos: round(r.value, 9) for r in signal.convolve(cov, weights).collect()}
    assert {r.pos: round(r.value, 9) for r in out.collect()} == want


def test_reads_are_grouped_wherever_they_stand(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "read_id string, line string")
    assert {r.read_id: r.n for r in signals.group_reads(df).collect()} == {"a": 2, "b": 1}


def test_a_sorted_stream_is_convolved_with_bounded_state(spark, tmp_path):
    import random

    from helixframe.operators import signal
    from helixframe.streaming import signals

    rng = random.Random(2)
    weights = signal.kernel("laplace", 3, 3)
    rows = sorted((p, rng.choice("+-"), float(rng.randrange(1, 9))) for p in rng.sample(range(400), 150))
    source = tmp_path / "in"
    for k in range(5):
        part = [("c", s, p, v) for p, s, v in rows[k * 30 : k * 30 + 30]] + ([("c", "+", None, None), ("c", "-", None, None)] if k == 4 else [])
        spark.createDataFrame(part, "chrom string, strand string, pos long, value double").coalesce(1).write.mode("append").parquet(str(source))
        import time

        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema("chrom string, strand string, pos long, value double").option("maxFilesPerTrigger", 1).parquet(str(source))
    out = signals.run_to_table(signals.convolve_sorted(stream, weights), "sorted_smooth", str(tmp_path / "state"), "append").collect()
    whole = spark.createDataFrame([("c", s, p, v) for p, s, v in rows], "chrom string, strand string, pos long, value double")
    expected = {(r.strand, r.pos): r.value for r in signal.convolve(whole, weights).collect()}
    got = {(r.strand, r.pos): r.value for r in out}
    assert len(out) == len(got) and set(got) == set(expected) and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
