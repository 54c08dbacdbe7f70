import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import bias, shards, signal, stats


def rows(n, seed, groups=("hot",) * 8 + ("a", None)):
    rng = random.Random(seed)
    return [(rng.choice(groups), rng.randrange(-40, 400), float(rng.randrange(9)), i) for i in range(n)]


def test_numbers_and_running_sums_of_a_hot_group(spark):
    data = rows(900, 1)
    df = spark.createDataFrame(data, "g string, pos long, v double, id long")
    got = {r.id: (r.number, r.run, r.total_run) for r in shards.numbered(shards.running_sum(df, ["g"], "id", "v", "run", 7), ["g"], ["pos", "id"], partitions=9).collect()}
    for g in {r[0] for r in data}:
        own = [r for r in data if r[0] == g]
        for n, r in enumerate(sorted(own, key=lambda r: (r[1], r[3])), 1):
            assert got[r[3]] == (n, sum(x[2] for x in own if x[3] <= r[3]), sum(x[2] for x in own))
    assert shards.numbered(df.limit(0), ["g"], ["pos"]).count() == 0


@pytest.mark.parametrize("shard", [1, 8, 64])
def test_neighbours_over_shard_borders(spark, shard):
    data = list({(g, p): (g, p, v, i) for g, p, v, i in rows(400, 2)}.values())
    df = spark.createDataFrame(data, "g string, pos long, value double, id long")
    near = {r.id: r.near for r in bias.density(df, ["g"], 6, shard).collect()}
    relative = {r.id: r.relative for r in bias.neighbour_relative(df.where("value > 0"), ["g"], 6, shard).collect()}
    smooth = {r.id: r.smooth for r in signal.moving_average(df, ["g"], "pos", "value", 3, shard, 5).collect()}
    for g, p, v, i in data:
        own = sorted((x[1], x[2]) for x in data if x[0] == g)
        assert near[i] == sum(abs(x - p) <= 6 for x, _ in own)
        if v:
            mine = [y for x, y in own if abs(x - p) <= 6 and y]
            assert relative[i] == pytest.approx(v * len(mine) / sum(mine))
        at = own.index((p, v))
        part = [y for _, y in own[max(0, at - 3) : at + 4]]
        assert smooth[i] == pytest.approx(sum(part) / len(part))


def test_distributions_of_one_hot_group(spark):
    rng = random.Random(5)
    data = [("hot", rng.choice([None, *[rng.random() ** 6 for _ in range(5)]]), i % 3 == 0, i) for i in range(600)]
    df = spark.createDataFrame(data, "g string, p double, control boolean, id long")
    test, null = df.where("not control"), df.where("control")
    controls = [p for _, p, c, _ in data if c and p is not None]
    for r in stats.ecdf(test, null, ["g"], "p", "share", 6).collect():
        assert r.share == (None if r.p is None else pytest.approx(sum(x <= r.p for x in controls) / len(controls)))
    known = sorted(p for _, p, _, _ in data if p is not None)
    for r in stats.benjamini_hochberg(df, ["g"], "p", partitions=6).collect():
        if r.p is not None:
            expected = min(1.0, min(q * len(known) / sum(x <= q for x in known) for q in known if q >= r.p))
            assert r.fdr == pytest.approx(expected)
        else:
            assert r.fdr is None
    out = stats.ks_distance(df, "control", "p", 6).first()
    others = [p for _, p, c, _ in data if not c and p is not None]
    assert out.distance == pytest.approx(max(abs(sum(x <= v for x in controls) / len(controls) - sum(x <= v for x in others) / len(others)) for v in known))


def test_spacing_with_all_rows_at_one_place(spark):
    rng = random.Random(7)
    data = [("t", 50 if i % 2 else rng.randrange(200), rng.randrange(30), i) for i in range(500)]
    df = spark.createDataFrame(data, "t string, pos long, score long, id long")
    got = sorted(r.id for r in stats.spaced(df, ["t"], "pos", [F.col("score").asc(), F.col("id").asc()]).collect())
    kept = []
    for _, p, _, i in sorted(data, key=lambda r: (r[2], r[3])):
        if all(abs(p - q) > 5 for q, _ in kept):
            kept.append((p, i))
    assert got == sorted(i for _, i in kept)
