import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from weftgrid.operators import columns
from weftgrid.operators.ranking import global_rank
from weftgrid.session import materialize

TEXTS = ["a,b,c,d", "q,w", "", ",", "x,,y,", "é,ü,ß", "none", None, "a;b,c", ",,,"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").persist()


def split(df, *how):
    made = columns.split_column(df, "t", *how)
    return [tuple(r)[1:] for r in made.orderBy("i").collect()]


def padded(parts, n):
    return tuple(parts + [None] * (n - len(parts)))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_split_by_characters(texts, n):
    assert split(texts, n, "begin", "char", ",") == [
        padded([None] * n if t is None else t.split(",", n - 1), n) for t in TEXTS]
    assert split(texts, n, "end", "char", ",") == [
        padded([None] * n if t is None else t.rsplit(",", n - 1), n) for t in TEXTS]


@pytest.mark.parametrize("width", [1, 2, 3])
def test_split_by_length(texts, width):
    def left(t):
        return tuple(None if t is None or i * width >= len(t) else t[i * width:(i + 1) * width] for i in range(3))
    def right(t):
        return tuple(None if t is None or i * width >= len(t) else t[max(len(t) - (i + 1) * width, 0):len(t) - i * width]
                     for i in range(3))
    assert split(texts, 3, "begin", "length", str(width)) == [left(t) for t in TEXTS]
    assert split(texts, 3, "end", "length", width) == [right(t) for t in TEXTS]


def test_split_by_length_example(spark):
    df = spark.createDataFrame([(0, "abcdefghij")], "i int, t string")
    assert split(df, 3, "begin", "length", 3) == [("abc", "def", "ghi")]
    assert split(df, 3, "end", "length", 3) == [("hij", "efg", "bcd")]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab|.*\\é ", max_size=8), min_size=1, max_size=8), st.sampled_from(["|", ".", "*", "\\", "ab"]))
def test_pieces_rejoin_to_the_source(spark, texts, separator):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for start in ("begin", "end"):
        pieces = split(df, 3, start, "char", separator)
        assert [separator.join(p for p in row if p is not None) for row in pieces] == texts


def test_split_takes_free_names(spark):
    df = spark.createDataFrame([("a-b", 1)], "t string, t1 int")
    assert columns.split_column(df, "t", 2, "begin", "char", "-").columns == ["t1", "t2", "t3"]


def test_split_rejects_unknown_methods(texts):
    with pytest.raises(ValueError):
        columns.split_column(texts, "t", 2, "middle", "char", ",")


def test_absent_columns_are_errors_where_a_step_would_be_lost(texts):
    for made in (columns.rename(texts, "zz", "y"), columns.drop(texts, "zz")):
        assert made.columns == texts.columns
    for step in (columns.to_text, columns.sort, columns.expand_vector):
        with pytest.raises(ValueError, match="no column zz"):
            step(texts, "zz")
    for lost in (lambda: columns.filter_rows(texts, "zz", "=", 1), lambda: columns.apply(texts, "zz", F.upper),
                 lambda: columns.split_column(texts, "zz", 2, "begin", "char", " ")):
        with pytest.raises(ValueError, match="no column zz"):
            lost()


def test_filters(spark, rows):
    df = spark.createDataFrame([(1, "cat"), (2, "concat"), (3, None), (None, "dog")], "n int, s string")
    def kept(*how):
        return [r[0] for r in rows(columns.filter_rows(df, *how))]
    assert kept("n", ">=", "2") == [2, 3]
    assert kept("n", "!=", 2) == [1, 3]
    assert kept("n", "<", 2.5) == [1, 2]
    assert kept("s", "=", "cat") == [1]
    assert kept("s", "like", "c_t") == [1, 2]
    assert kept("s", "is null") == [3]
    assert kept("n", "is not null") == [1, 2, 3]
    assert kept("s", "=", 'x" OR "1"="1') == []
    with pytest.raises(ValueError):
        kept("s", "; drop", "x")
    with pytest.raises(ValueError):
        kept("n", "like", "1")


def test_exclusions_read_null_as_text(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert rows(columns.exclude_values(df, "s", ["a", "null"])) == [("b",)]
    assert rows(columns.keep_values(df, "s", ["a", "null"])) == [("a",), (None,)]
    many = ["a", "null", *map(str, range(columns.LONG_LIST))]
    assert rows(columns.exclude_values(df, "s", many)) == [("b",)]


def test_convert_to_text(spark, rows):
    df = spark.createDataFrame([(1, [1, 2]), (None, None)], "n int, a array<int>")
    assert rows(columns.to_text(columns.to_text(df, "n"), "a")) == [("", ""), ("1", "[1,2]")]


def test_expand_vectors(spark, rows):
    df = spark.createDataFrame([(Vectors.sparse(4, {2: 5.0}),), (Vectors.dense(1, 2, 3, 4),)], ["v"])
    assert rows(columns.expand_vector(df, "v", 4)) == [(0.0, 0.0, 5.0, 0.0), (1.0, 2.0, 3.0, 4.0)]
    assert columns.to_text(df, "v").first()[0] == "[0.0,0.0,5.0,0.0]"


def test_sort_spreads_a_frequent_value(spark):
    df = spark.range(0, 4000, 1, 4).selectExpr("id", "if(id % 10 < 9, 'same', string(id)) AS v")
    ordered = columns.sort(df, "v")
    values = [r["v"] for r in ordered.collect()]
    assert values == sorted(values)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        holders = columns.sort(df, "v").where("v = 'same'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert holders > 1


def test_sorted_copies_are_all_there(spark, monkeypatch):
    monkeypatch.setattr(columns, "RUN", 7)
    df = spark.range(0, 1000, 1, 4).selectExpr("if(id % 3 = 0, null, id % 5) AS v", "'x' AS s")
    ordered = [tuple(r) for r in columns.sort_copies(df, "v").collect()]
    assert [r[0] for r in ordered] == sorted((r[0] for r in df.collect()), key=lambda v: (v is not None, v))
    assert len(ordered) == 1000
    assert columns.sort_copies(df, "v", ascending=False).first()["v"] == 4


def test_sort_null_order(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "n int")
    assert [r[0] for r in columns.sort(df, "n").collect()] == [None, 1, 2]
    assert [r[0] for r in columns.sort(df, "n", ascending=False).collect()] == [2, 1, None]


def test_cells_round_trip(spark, rows):
    df = spark.createDataFrame([("r5", "v5", None), ("r6", "v6", "w6")], "row string, q1 string, q2 string")
    cells = columns.to_cells(df, "row")
    assert rows(cells) == [("r5", "f1", "q1", "v5"), ("r6", "f1", "q1", "v6"), ("r6", "f1", "q2", "w6")]
    assert rows(columns.from_cells(cells, ["q1", "q2"])) == rows(df)


def test_schema_listing_ignores_case(spark):
    df = spark.createDataFrame([], "b int, A string, C double")
    assert [tuple(r) for r in columns.schema_listing(df).collect()] == [("A", "string"), ("b", "int"), ("C", "double")]


def test_ranks_of_a_large_frame_equal_the_window(spark, rows):
    df = spark.range(0, 5000, 1, 5).selectExpr("id", "id % 7 AS g")
    order = [F.desc("g"), F.asc("id")]
    small = global_rank(df, order, "place")
    large = global_rank(df, order, "place", small_rows=100)
    assert "Window" not in large._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert rows(small.select("id", "g", "place")) == rows(large.select("id", "g", "place"))


def test_apply_takes_expressions_and_pandas_udfs(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n long, s string")

    @F.pandas_udf("long")
    def doubled(values: pd.Series) -> pd.Series:
        return values * 2

    assert [r["n"] for r in columns.apply(df, "n", doubled).orderBy("n").collect()] == [2, 4]
    assert [r["s"] for r in columns.apply(df, "s", F.upper).orderBy("n").collect()] == ["A", "B"]


def test_materialised_copies_keep_untyped_columns(spark, rows):
    df = spark.createDataFrame([(1, "a")], "n int, s string").select("n", F.lit(None).alias("nothing"), "s")
    copy = materialize(df, "copy")
    assert copy.dtypes == df.dtypes and rows(copy) == rows(df)
