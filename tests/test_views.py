from rolescope.session import configure
from rolescope.workload import views


def test_payloads_of_one_small_file_are_many_tasks(spark, tmp_path):
    """One file of parts makes ten times as many postings; they are not one task's work."""
    spark.range(400).selectExpr("id AS p_partkey", "'a ring' AS p_name", "'Brand#1' AS p_brand", "'LARGE' AS p_type", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    configure(spark)
    for view in (views.payload_v, views.details_v):
        rows = view(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() >= 8 and rows.count() in (400, 2000)
