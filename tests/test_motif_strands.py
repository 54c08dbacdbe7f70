from pyspark.sql import functions as F

from helixframe.functions import sequence as S


def test_motif_is_found_on_both_strands(spark):
    df = spark.createDataFrame([(1, "AAGTCAACGATT"), (2, "AATCGTTGACTT"), (3, "GTAC"), (4, "")], "id int, s string")
    hits = {r.id: sorted((h["at"], h["strand"]) for h in r.h) for r in df.select("id", S.motif_hits_both(F.col("s"), "GTYRACGA", 0).alias("h")).collect()}
    assert hits == {1: [(2, "+")], 2: [(2, "-")], 3: [], 4: []}
