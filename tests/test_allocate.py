import __spark_entry__ as entry


def test_reads_of_every_multiplicity_get_shares(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").count()
    got = entry.queries()["rd_allocate_round"](spark, sf).groupBy("read").count()
    many = lines.where("count > 1")
    assert many.where("count > 2").count() > 0
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in many.collect())
