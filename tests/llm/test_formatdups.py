import random

import pytest

from helixframe.llm import formatdups


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_against_grouping(spark, partitions):
    rng = random.Random(partitions)
    names = ["miR1", "MIR-1", " mir 1", "miR2", "acgt", "ACGT", "acgu", "", "-", None, "ıK", "x" * 5000]
    rows = [(i, rng.choice(names + ["miR1"] * 12), rng.choice(["ACGT", "acgt ", "miR1", None, "TTT"] + ["a-c-g-t"] * 8), 1) for i in rng.sample(range(9999), 700)]
    df = spark.createDataFrame(rows, "rec_id long, name string, sequence string, first_id int")
    groups = {}
    for i, a, b, _ in rows:
        if a is not None and b is not None:
            key = tuple(sorted("".join(c for c in v if c.isascii() and c.isalnum()).lower() for v in (a, b)))
            groups.setdefault(key, []).append(i)
    expected = sorted((min(own), i) for own in groups.values() for i in own)
    out = formatdups.same_records(df, ["name", "sequence"], "rec_id", partitions)
    assert sorted(tuple(r) for r in out.collect()) == expected
    counts = formatdups.collapse(df, ["name", "sequence"], "rec_id", partitions)
    assert sorted(tuple(r) for r in counts.collect()) == sorted((min(own), len(own)) for own in groups.values())


def test_one_key_over_all_partitions_and_empty_table(spark):
    df = spark.range(1000).selectExpr("id as rec_id", "'a' as name", "'b' as sequence")
    out = formatdups.same_records(df, ["name", "sequence"], "rec_id", 9)
    assert {r.first_id for r in out.collect()} == {0} and out.count() == 1000
    assert formatdups.same_records(df.limit(0), ["name", "sequence"], "rec_id").count() == 0


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "x-1", "y"), ("a", "Y", "X1"), (None, "x1", "y"), ("c", "x1", "z")], "id string, name string, sequence string")
    assert sorted(tuple(r) for r in formatdups.same_records(df, ["name", "sequence"], "id", 2).collect()) == [("a", "a"), ("a", "b"), ("c", "c")]
    assert sorted(tuple(r) for r in formatdups.collapse(df, ["name", "sequence"], "id", 2).collect()) == [("a", 2), ("c", 1)]
    assert formatdups.collapse(df.limit(0), ["name", "sequence"], "id").count() == 0
