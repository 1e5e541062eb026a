import os

import pytest
from pyspark.sql import functions as F

from weftgrid.sources import cellstore
from weftgrid.sources.cellstore import read_cells, write_cells

CELLS = [("row5", "f1", "q1", "value5"), ("row6", "f1", "q1", "value6"), ("a\tb", "f\n", "\\", "\\t\r\\\\N"), ("", "", "", ""),
         ("n", "f", "q", None), (None, None, None, None), ("é漢", "f", "q", "x" * 5000), ("N", "N", "\\N", "\\\\"), ("z\\", "\\n", "t\\t", "\n\n")]


def frame(spark, rows):
    return spark.createDataFrame(rows, cellstore.SCHEMA)


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "\\N", "N", "a\\tb", "\t\n\r", "\\\t\\\\n", "x\\\\\\", "plain", None])
def test_fields(text):
    coded = cellstore._encode(text)
    assert "\t" not in coded and "\n" not in coded and cellstore._decode(coded) == text


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_round_trip_in_ranges(spark, tmp_path, rows, size):
    path = write_cells(frame(spark, CELLS).repartition(3), str(tmp_path / "c"))
    if size == 1:
        small = [c for c in CELLS if c[3] is None or len(c[3]) < 100]
        path = write_cells(frame(spark, small).coalesce(1), str(tmp_path / "s"))
        assert rows(read_cells(spark, path, size)) == rows(frame(spark, small))
    else:
        assert rows(read_cells(spark, path, size)) == rows(frame(spark, CELLS))
    assert not [f for f in os.listdir(path) if f.startswith("_")]


def test_append_overwrite_and_nothing(spark, tmp_path, rows):
    path = str(tmp_path / "c")
    write_cells(frame(spark, CELLS[:2]), path)
    write_cells(frame(spark, CELLS[2:4]), path)
    assert read_cells(spark, path).count() == 4
    write_cells(frame(spark, CELLS[:1]), path, overwrite=True)
    assert rows(read_cells(spark, path)) == [CELLS[0]]
    write_cells(frame(spark, []), path, overwrite=True)
    assert read_cells(spark, path).count() == 0


def test_a_failed_task_leaves_nothing(spark, tmp_path, rows):
    path = str(tmp_path / "c")
    write_cells(frame(spark, CELLS[:2]), path)
    bad = spark.range(1000).repartition(4).select(
        F.col("id").cast("string").alias("row"), F.lit("f").alias("family"), F.lit("q").alias("qualifier"),
        F.when(F.col("id") == 777, F.raise_error(F.lit("bad cell"))).otherwise(F.lit("v")).alias("value"))
    with pytest.raises(Exception, match="bad cell"):
        write_cells(bad, path, overwrite=True)
    assert rows(read_cells(spark, path)) == sorted(CELLS[:2])
    assert not [f for f in os.listdir(path) if f.startswith("_")]


def test_missing_columns(spark, tmp_path):
    spark.dataSource.register(cellstore.CellSource)
    with pytest.raises(Exception, match="cells need the columns"):
        spark.range(3).write.format("cells").mode("append").save(str(tmp_path / "c"))
