import math
import random

import pyarrow as pa
import pytest

from helixframe.llm import topn


def brute(rows, n):
    groups = {}
    for g, a, b, i in rows:
        groups.setdefault(g, []).append((a is None or math.isnan(a), 0 if a is None or math.isnan(a) else a, b is None, 0 if b is None else -b, i))
    return sorted(((g, r, k[-1]) for g, own in groups.items() for r, k in enumerate(sorted(own)[:n], 1)), key=repr)


@pytest.mark.parametrize("buckets", [1, 5])
def test_against_sorting(spark, buckets):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", "", None, "ü"]), rng.choice([None, float("nan"), 0.0, -0.0, 1.5, 2.5, -3.0]), rng.choice([None, 1, 2, 3]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "grp string, score double, rpm long, id long").repartition(7)
    out = topn.top_n(df, ["grp"], [("score", False), ("rpm", True)], "id", 5, buckets=buckets).collect()
    assert sorted(((r.grp, r.rank_no, r.id) for r in out), key=repr) == brute(rows, 5)


def test_repeated_rows_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([("a", 1.0, 1, 7), ("a", 1.0, 1, 7), ("a", 2.0, 2, 7)], "grp string, score double, id int, rank_no int")
    out = topn.top_n(df, ["grp"], [("score", False)], "id", 2).collect()
    assert [(r.rank_no, r.id) for r in out] == [(1, 1), (2, 1)]
    assert topn.top_n(df.limit(0), ["grp"], [("score", False)], "id", 2).count() == 0
    with pytest.raises(TypeError):
        topn.top_n(df, ["id"], [("grp", False)], "id", 1)


SCHEMA = pa.schema([("g", pa.string()), ("v", pa.int64())])


def blocks(rows, size=3):
    return [topn.pack_rows(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + size]), SCHEMA)], schema=SCHEMA)) for at in range(0, len(rows), size)]


def cursor(rows):
    return topn.RunCursor(blocks(rows), 1, SCHEMA)


@pytest.mark.parametrize("count", [1, 2, 3, 6, 9])
def test_loser_tree_merges_and_seeks(count):
    rng = random.Random(count)
    runs = [sorted((rng.choice("abcd"), rng.randrange(99)) for _ in range(rng.randrange(0, 40))) for _ in range(count)]
    merged = [k for _, k in topn.merge_runs([cursor(r) for r in runs], 1, 4)]
    expected = []
    for g in "abcd":
        expected += sorted(k for r in runs for k in r if k[0] == g)[:4]
    assert merged == expected


def test_many_runs_of_one_hot_group_stay_small():
    merge = topn.BucketMerge(1, 5, SCHEMA, fan_in=16)
    rng = random.Random(4)
    rows, held = [], 0
    for run in range(2000):
        own = sorted(("hot", rng.randrange(10**9)) for _ in range(5))
        if run % 3 == 0:
            own = sorted([*own, ("cold%d" % run, 1)])
        rows += own
        merge.add(blocks(own, 4096))
        held = max(held, sum(len(b) for level in merge.levels for r in level for b in r))
    assert max(map(len, merge.levels)) < 16
    # 667 cold rows, and five of the hot group in each waiting run
    assert held < 667 * 40 + 3 * 16 * 2000
    out = [k for _, k in merge.finish()]
    assert out == sorted(k for k in rows if k[0] != "hot")[:667] + sorted(k for k in rows if k[0] == "hot")[:5]


def test_many_partitions_and_a_small_fan_in(spark):
    rng = random.Random(6)
    rows = [("hot" if i % 3 else "g%d" % rng.randrange(40), rng.choice([None, 0.5, rng.random()]), None, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "grp string, score double, rpm long, id long").repartition(60)
    out = topn.top_n(df, ["grp"], [("score", False), ("rpm", True)], "id", 5, buckets=3, fan_in=4).collect()
    assert sorted(((r.grp, r.rank_no, r.id) for r in out), key=repr) == brute(rows, 5)


def test_ids_that_are_null_or_strings(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 1.0, 5), ("a", 0.5, None), ("a", 1.0, 2**63 - 1)], "grp string, score double, id long")
    assert [(r.rank_no, r.id) for r in topn.top_n(df, ["grp"], [("score", False)], "id", 9).orderBy("rank_no").collect()] == [(1, None), (2, 5), (3, 2**63 - 1), (4, None)]
    df = spark.createDataFrame([("a", 1.0, "y"), ("a", 1.0, "x"), ("a", 1.0, None), ("a", 1.0, "10")], "grp string, score double, id string")
    assert [r.id for r in topn.top_n(df, ["grp"], [("score", False)], "id", 3).orderBy("rank_no").collect()] == ["10", "x", "y"]
