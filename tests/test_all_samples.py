from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_every_sample_is_counted(spark, sf):
    sites, q = spark.read.parquet(f"{sf}/detected_sites.parquet"), entry.queries()
    assert q["st_study_union"](spark, sf).first().n == sites.where("adj_p_val < 0.05 and sample_name is not null").count()
    kept = sites.where("srna is not null and srna not like '%_shuffled%' and not isnan(fold_change) and not isnan(allen_score) and not isnan(coalesce(slice_site_rpm, 0D))")
    got = q["st_interaction_matrix"](spark, sf)
    assert got.agg(F.countDistinct("sample_name")).first()[0] == kept.agg(F.countDistinct("sample_name")).first()[0] > 2
