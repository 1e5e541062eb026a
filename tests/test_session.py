import os

from weftgrid.session import delete_written, materialize, shared_folder, spread, written_folders


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first.startswith(f"{named}/x-") and first != second


def test_spread_leaves_wide_scans_alone(spark, tmp_path):
    spark.range(0, 100, 1, 1).write.parquet(str(tmp_path / "narrow"))
    spark.range(0, 100, 1, 1).write.mode("append").parquet(str(tmp_path / "narrow"))
    narrow = spark.read.parquet(str(tmp_path / "narrow"))
    assert spread(narrow, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, spark.sparkContext.defaultParallelism + 1)
    assert spread(wide, "id") is wide


def test_intermediate_tables_are_listed_and_deleted(spark):
    before = written_folders(spark)
    copy = materialize(spark.range(5), "copy")
    new = [f for f in written_folders(spark) if f not in before]
    assert copy.count() == 5 and len(new) == 1 and os.path.isdir(new[0])
    assert delete_written(spark, new) == 1 and not os.path.exists(new[0])
    assert written_folders(spark) == before and delete_written(spark, new) == 0
