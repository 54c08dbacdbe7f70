import random

from pyspark.sql import functions as F

from helixframe.operators import intervals


def table(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start long, end long, id long")


def random_rows(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randint(0, 9000)
        out.append((rng.choice("ab"), s, s + rng.choice([0, 1, 5, 40, 700, 20_000]), i))
    return out


def overlap(a, b):
    return a[0] == b[0] and a[1] < b[2] and b[1] < a[2] and a[1] < a[2] and b[1] < b[2]


def test_overlaps_of_short_and_long_intervals(spark):
    x, y = random_rows(1, 200), random_rows(2, 200)
    a, b = table(spark, x), table(spark, y)
    expected = sorted((p[3], q[3]) for p in x for q in y if overlap(p, q))
    pairs = intervals.overlap_join(a, b, ["chrom"], width=4)
    assert sorted((r.a_id, r.b_id) for r in pairs.collect()) == expected
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    anti = intervals.overlap_join(a, b, ["chrom"], how="left_anti", width=4)
    assert sorted(r.id for r in anti.collect()) == sorted({p[3] for p in x} - {i for i, _ in expected})


def test_book_ended_rows_merge_but_do_not_overlap(spark):
    a, b = table(spark, [("a", 10, 20, 1)]), table(spark, [("a", 19, 25, 1), ("a", 20, 30, 2)])
    assert [r.b_id for r in intervals.overlap_join(a, b, ["chrom"]).collect()] == [1]
    m = table(spark, [("a", 0, 5, 1), ("a", 5, 8, 2), ("a", 9, 12, 3)])
    assert sorted((r.start, r.end) for r in intervals.merge(m, ["chrom"]).collect()) == [(0, 8), (9, 12)]
    assert sorted((r.start, r.end) for r in intervals.merge(m, ["chrom"], book_ended=False).collect()) == [(0, 5), (5, 8), (9, 12)]


def test_subtract_and_its_complement_cover_the_interval(spark):
    x, y = random_rows(3, 60), random_rows(4, 40)
    out = intervals.subtract(table(spark, x), table(spark, y), ["chrom"], "id", width=4).collect()
    left = {}
    for r in out:
        left.setdefault(r.id, set()).update(range(r.start, r.end))
    for c, s, e, i in x:
        cut = {p for q in y if q[0] == c for p in range(max(s, q[1]), min(e, q[2]))}
        assert left.get(i, set()) == set(range(s, e)) - cut


def test_nearest_with_small_shards(spark):
    x, y = random_rows(5, 150), random_rows(6, 12)
    y = [r for r in y if r[1] < r[2]]
    got = {r.id: (r.b, r.distance) for r in intervals.nearest(table(spark, x), table(spark, y).withColumnRenamed("id", "b"), ["chrom"], "id", "b", width=4, shard=64).collect()}
    for c, s, e, i in x:
        best = None
        for d, t, u, j in y:
            if d == c and s < e:
                gap = 0 if s < u and t < e else s - u + 1 if u <= s else t - e + 1
                best = min(best or (gap, j), (gap, j))
        assert got.get(i) == (best and (best[1], best[0]))


def test_run_encoding_and_masks(spark):
    from helixframe.operators import coverage

    cov = spark.createDataFrame([("c", "+", p, v) for p, v in [(5, 2.0), (6, 2.0), (7, 3.0), (9, 3.0), (10, 0.0), (63, 1.0), (64, 1.0), (65, -1.0)]], "chrom string, strand string, pos long, value double")
    runs = coverage.encode_runs(cov, shard=64)
    assert sorted((r.start, r.end, r.value) for r in runs.collect()) == [(5, 7, 2.0), (7, 8, 3.0), (9, 10, 3.0), (63, 65, 1.0), (65, 66, -1.0)]
    back = coverage.expand_runs(runs)
    assert sorted((r.pos, r.value) for r in back.collect()) == sorted((r.pos, r.value) for r in cov.where("value <> 0").collect())
    site = spark.createDataFrame([("c", "+", 5, 7)], "chrom string, strand string, start long, end long")
    assert sorted(r.pos for r in coverage.mask(cov, site, "inside").collect()) == [9, 10, 63, 64, 65]
    assert 7 not in [r.pos for r in coverage.mask(cov, site, "up").collect()]


def test_kernels_and_trim(spark):
    from helixframe.operators import signal

    assert [round(w, 6) for _, w in signal.kernel("laplace", 1, 3)] == [0.023641, 0.064262, 0.174681, 0.474833, 0.174681, 0.064262, 0.023641]
    assert [round(w, 6) for _, w in signal.kernel("gauss", 1, 3)] == [0.030078, 0.104984, 0.222250, 0.285375, 0.222250, 0.104984, 0.030078]
    rows = [("c", "+", 0, 5, p, v) for p, v in enumerate([0.0, 1.0, 6.0, 3.0, 0.0])]
    inside = spark.createDataFrame(rows, "chrom string, strand string, start long, end long, pos long, value double")
    assert [(r.new_start, r.new_end, r.n) for r in signal.trim(inside, 0.5).collect()] == [(2, 3, 1)]
    assert [(r.new_start, r.new_end, r.n) for r in signal.trim(inside, 1.0).collect()] == [(1, 4, 3)]
    rows = [("c", "+", 0, 6, p, v) for p, v in enumerate([1.0, 3.0, 3.0, 2.0, 4.0, 1.0])]
    inside = spark.createDataFrame(rows, "chrom string, strand string, start long, end long, pos long, value double")
    assert sorted(r.pos for r in signal.local_maxima(inside).collect()) == [2, 4]
    assert inside.agg(F.sum("value")).first()[0] == 14


def test_runs_of_equal_keys_are_told_apart(spark):
    rows = [(i, k, i * 10, i * 10 + 5, "+", float(i % 4)) for i, k in enumerate("aabbbaac" * 20)]
    df = spark.createDataFrame(rows, "id long, k string, start long, end long, strand string, score double")
    got = sorted(r.id for r in intervals.deduplicate_runs(df, ["k"], ["start"], partitions=6).collect())
    assert got == [i for i, (_, k, *_) in enumerate(rows) if i == 0 or rows[i - 1][1] != k]
    alone = [r.id for r in intervals.deduplicate_runs(df, ["k"], ["start"], only_unique=True, partitions=6).collect()]
    assert sorted(alone) == [i for i, (_, k, *_) in enumerate(rows) if k == "c"]
    high = {r.id for r in intervals.deduplicate_runs(df, ["k"], ["start"], select="highscore", partitions=6).collect()}
    assert {1, 3} <= high and len(high) == len(got)
