import random

import pytest

from helixframe.operators import coverage, signal


def brute(segments):
    out = {}
    for k, s, e, v in segments:
        for p in range(s, e):
            out[k, p] = out.get((k, p), 0) + v
    return out


@pytest.mark.parametrize("shard", [1, 16, 1 << 18])
def test_segments_over_shard_borders(spark, shard):
    rng = random.Random(shard)
    rows = [(rng.choice(["hot", "hot", "a", None]), s := rng.randrange(-50, 300), s + rng.choice([0, 1, 5, 40, 200]), float(rng.choice([1, 2, 0.1, -1]))) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, start long, end long, value double")
    runs = coverage.segment_runs(df, ["k"], shard).collect()
    got = {}
    for r in runs:
        assert r.start < r.end
        for p in range(r.start, r.end):
            assert (r.k, p) not in got
            got[r.k, p] = r.value
    expected = brute(rows)
    assert set(got) == set(expected) and all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in got)
    assert coverage.segment_runs(df.limit(0), ["k"], shard).count() == 0


def test_plans_explode_no_segment_before_the_sum(spark):
    df = spark.createDataFrame([("a", 0, 10**9, 1.0)], "k string, start long, end long, value double")
    runs = coverage.segment_runs(df, ["k"])
    assert [(r.start, r.end, r.value) for r in runs.collect()] == [(0, 10**9, 1.0)]
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan


@pytest.mark.parametrize("shard", [1, 7, 1 << 16])
def test_convolution_over_shard_borders(spark, shard):
    rng = random.Random(shard)
    weights = signal.kernel("laplace", 4, 3)
    rows = [("c", rng.randrange(0, 200), float(rng.randrange(1, 9))) for _ in range(60)] + [("d", 10**9, 5.0)]
    df = spark.createDataFrame(rows, "k string, pos long, value double")
    expected = {}
    for k, p, v in rows:
        for o, w in weights:
            expected[k, p + o] = expected.get((k, p + o), 0) + v * w
    expected = {k: v for k, v in expected.items() if k[1] >= 0 and v > 1e-9}
    for f in (lambda: signal.convolve(df, weights, ["k"], shard=shard), lambda: signal.convolve_rows(df, weights, ["k"])):
        got = {(r.k, r.pos): r.value for r in f().collect()}
        assert set(got) == set(expected) and all(got[k] == pytest.approx(expected[k]) for k in got)
    skewed = {(r.k, r.pos): r.value for r in signal.convolve(df, [(2, 1.0)], ["k"], shard=max(shard, 2)).collect()}
    assert skewed["d", 10**9 + 2] == pytest.approx(5.0) and len(skewed) == len({(k, p) for k, p, _ in rows})
    assert signal.convolve(df.limit(0), weights, ["k"]).count() == 0
