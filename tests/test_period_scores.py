import random

from helixframe.operators import signal


def brute(start, end, values):
    peak = max(values, key=lambda p: (values[p], p))
    total = sum(values.values())
    scores = []
    for p in range(1, end - start + 1):
        hit = sum(v for at, v in values.items() if (at - peak) % p == 0)
        scores.append((hit / ((end - 1 - peak) // p + (peak - start) // p + 1) * hit / total, p))
    return max(scores)


def test_periods_above_thirty_are_tried(spark):
    rng = random.Random(6)
    features = {(0, 200): {p: 9.0 for p in range(10, 200, 41)}, (300, 425): {p: float(rng.randint(1, 50)) for p in range(300, 425)}, (500, 501): {500: 2.0}}
    rows = [("c", "+", s, e, p, v) for (s, e), values in features.items() for p, v in values.items()]
    inside = spark.createDataFrame(rows, "chrom string, strand string, start long, end long, pos long, value double")
    got = {(r.start, r.end): (r.score, r.period) for r in signal.period_scores(inside).collect()}
    want = {k: brute(*k, v) for k, v in features.items()}
    assert want[0, 200][1] == 41 and {k: p for k, (_, p) in got.items()} == {k: p for k, (_, p) in want.items()}
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
