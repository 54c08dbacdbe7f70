import random

from helixframe.operators import periods


def brute(rows):
    out = {}
    for k, s, e in rows:
        if s is not None and e is not None and s <= e:
            out.setdefault(k, []).append((s, e))
    blocks, gaps = [], []
    for k, own in out.items():
        merged = []
        for s, e in sorted(own):
            if merged and s <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        blocks += [(k, s, e) for s, e in merged]
        gaps += [(k, a[1] + 1, b[0] - 1) for a, b in zip(merged, merged[1:])]
    return sorted(blocks, key=repr), sorted(gaps, key=repr)


def check(spark, rows, shard, **kw):
    df = spark.createDataFrame(rows, "k string, start long, stop long").withColumnRenamed("start", "e").withColumnRenamed("stop", "s")
    out = periods.periods_and_gaps(df, ["k"], "e", "s", shard=shard, **kw).collect()
    blocks = sorted(((r.k, r.start, r.stop) for r in out if r.kind == "block"), key=repr)
    gaps = sorted(((r.k, r.start, r.stop) for r in out if r.kind == "gap"), key=repr)
    return blocks, gaps


def test_random_intervals_with_small_shards(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(600):
        s = rng.randint(-500, 4000)
        rows.append((rng.choice(["a", "a", "a", "b", None]), s, s + rng.choice([0, 3, 9, 15, 16, 40, 300])))
    rows += [("c", 0, 15), ("c", 16, 31), ("c", 33, 40), ("d", 1, 10_000), ("d", 40, 50), ("d", 10_002, 10_003), ("e", 5, 4), ("e", None, 4), ("e", 4, None)]
    rows += rows[:50]
    assert check(spark, rows, 16) == brute(rows)


def test_gap_limit_and_empty_table(spark):
    rows = [("a", 1, 5), ("a", 10, 12), ("a", 100, 110)]
    assert check(spark, rows, 1 << 18, max_gap=4)[1] == [("a", 6, 9)]
    df = spark.createDataFrame([], "k string, start long, stop long")
    assert periods.periods_and_gaps(df, ["k"], "start", "stop").count() == 0


def test_huge_coordinates(spark):
    rows = [("a", 2**60, 2**60 + 5), ("a", 2**60 + 6, 2**60 + 7), ("a", -(2**60), 2**59)]
    assert check(spark, rows, 1 << 18) == brute(rows)


def test_strict_merge_over_shard_borders(spark):
    rng = random.Random(5)
    rows = [("a", s, s + rng.choice([0, 1, 3, 15, 16, 40])) for s in (rng.randint(-500, 4000) for _ in range(150))]
    rows += [("b", 0, 15), ("b", 16, 31), ("c", 10, 20), ("c", 20, 100), ("c", 101, 101), ("d", 1, 1000), ("e", 15, 16), ("e", 17, 40), ("f", 5, 4), ("f", None, 4), (None, 7, 33)]
    want = []
    for k, s, e in sorted((r for r in rows if r[1] is not None and r[1] <= r[2]), key=lambda r: (r[0] or "", r[1], r[2])):
        if want and want[-1][0] == k and s <= want[-1][2]:
            want[-1][2] = max(want[-1][2], e)
        else:
            want.append([k, s, e])
    df = spark.createDataFrame(rows, "k string, start long, stop long")
    got = periods.merge_periods(df, ["k"], "start", "stop", shard=16, adjoin=0).collect()
    assert sorted(([r.k, r.start, r.stop] for r in got), key=repr) == sorted(want, key=repr)
