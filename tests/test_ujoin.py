import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgrid.operators.ujoin import common_type, key_profile, match_count, schema_difference, schema_union, shared_columns, ujoin, ujoin_all
from weftgrid.sources.readers import empty_frame


@pytest.fixture(scope="module")
def abc(spark):
    return spark.createDataFrame([("a1", "b1", "c1"), ("a2", "b2", "c2")], "a string, b string, c string")


@pytest.fixture(scope="module")
def bcde(spark):
    return spark.createDataFrame([("b2", "c2", "d2", "e2"), ("b3", "c3", "d3", "e3")],
                                 "b string, c string, d string, e string")


def test_shared_then_disjoint_columns(spark, rows, abc, bcde):
    fg = spark.createDataFrame([("f4", "g4"), ("f5", "g5")], "f string, g string")
    fused = ujoin(ujoin(abc, bcde), fg)
    assert fused.columns == list("abcdefg")
    assert rows(fused) == sorted([
        ("a1", "b1", "c1", None, None, None, None),
        ("a2", "b2", "c2", "d2", "e2", None, None),
        (None, "b3", "c3", "d3", "e3", None, None),
        (None, None, None, None, None, "f4", "g4"),
        (None, None, None, None, None, "f5", "g5"),
    ], key=repr)


def test_schema_sets_keep_order(abc, bcde):
    assert shared_columns(abc, bcde) == ["b", "c"]
    assert schema_union(abc, bcde) == list("abcde")
    assert schema_difference(bcde, abc) == ["d", "e"]


def test_null_keys_never_match(spark, rows):
    left = spark.createDataFrame([(1, "x", None), (2, "y", "k")], "a int, b string, c string")
    right = spark.createDataFrame([("x", None, 9), ("y", "k", 8)], "b string, c string, d int")
    assert rows(ujoin(left, right)) == sorted(
        [(1, "x", None, None), (None, "x", None, 9), (2, "y", "k", 8)], key=repr)


def test_empty_grid_adopts_the_other_frame(spark, rows, abc):
    assert rows(ujoin(empty_frame(spark), abc)) == rows(abc)
    assert rows(ujoin(abc, empty_frame(spark))) == rows(abc)


def test_zero_rows(rows, abc, bcde):
    fused = ujoin(abc.where("false"), bcde)
    assert fused.columns == list("abcde")
    assert [r[1:] for r in rows(fused)] == rows(bcde)


def test_many_frames_in_any_order(spark, rows):
    frames = {
        "r": spark.createDataFrame([("a1", "b1")], "a string, b string"),
        "s": spark.createDataFrame([("b1", "c1")], "b string, c string"),
        "t": spark.createDataFrame([("c1", "d1")], "c string, d string"),
        "z": spark.createDataFrame([("q1",)], "q string"),
    }
    results = [rows(ujoin_all({n: frames[n] for n in order}).select(*"abcdq")) for order in ("rstz", "rtsz", "ztsr", "tzrs")]
    assert results[0] == sorted([("a1", "b1", "c1", "d1", None), (None, None, None, None, "q1")], key=repr)
    assert all(r == results[0] for r in results)


@pytest.mark.parametrize("a, b, expected", [
    (T.IntegerType(), T.StringType(), T.StringType()),
    (T.IntegerType(), T.LongType(), T.LongType()),
    (T.LongType(), T.FloatType(), T.StringType()),
    (T.IntegerType(), T.FloatType(), T.DoubleType()),
    (T.ShortType(), T.FloatType(), T.FloatType()),
    (T.DecimalType(10, 2), T.DecimalType(8, 4), T.DecimalType(12, 4)),
    (T.DecimalType(10, 2), T.IntegerType(), T.DecimalType(12, 2)),
    (T.DecimalType(38, 18), T.DecimalType(38, 0), T.StringType()),
    (T.DateType(), T.TimestampType(), T.TimestampType()),
    (T.BooleanType(), T.IntegerType(), T.StringType()),
    (T.NullType(), T.IntegerType(), T.IntegerType()),
])
def test_common_type(a, b, expected):
    assert common_type(a, b) == expected
    assert common_type(b, a) == expected


def test_text_and_number_keys_compare_as_text(spark, rows):
    left = spark.createDataFrame([("1", "l"), ("x", "m")], "k string, a string")
    right = spark.createDataFrame([(1, "r"), (2, "s")], "k int, b string")
    assert rows(ujoin(left, right)) == sorted([("1", "l", "r"), ("x", "m", None), ("2", None, "s")], key=repr)


def brute_force(left, right, shared):
    """Full outer natural join of lists of dicts."""
    def key(row):
        return tuple(row[c] for c in shared)
    out, used = [], set()
    for row in left:
        hits = [i for i, other in enumerate(right) if None not in key(row) and key(row) == key(other)]
        used.update(hits)
        out += [row | right[i] for i in hits] or [row]
    return out + [other for i, other in enumerate(right) if i not in used]


def skewed_sides(seed):
    """Keys with NULLs; one key holds a third of each side, others are frequent on one side only."""
    rng = random.Random(seed)
    def side(name, size, extra):
        pick = [7] * (size // 3) + [extra] * (size // 4) + [rng.choice([None, *range(12)]) for _ in range(size // 2)]
        return [{"k": k, "j": rng.choice(["x", "x", "y", None]) if k != 7 else "x", name: i} for i, k in enumerate(pick)]
    return side("a", 60, 100), side("b", 45, 200)


@pytest.mark.parametrize("seed", range(3))
def test_hot_keys_take_their_own_branch_with_the_same_result(spark, rows, seed):
    left, right = skewed_sides(seed)
    schema = "k int, j string, {0} int"
    frames = [spark.createDataFrame([tuple(r.values()) for r in side], schema.format(n)).repartition(4)
              for side, n in ((left, "a"), (right, "b"))]
    expected = sorted([(r["k"], r["j"], r.get("a"), r.get("b")) for r in brute_force(left, right, ["k", "j"])], key=repr)
    assert rows(ujoin(*frames)) == rows(ujoin(*frames, profile=False)) == expected
    assert key_profile(*frames, ["k", "j"], 10)
    assert key_profile(*frames, ["k", "j"], 1000) == []
    assert rows(ujoin(*frames, hot_min_rows=10)) == expected
    counted = match_count(*frames).first()
    assert counted["total"] == len(expected)
    assert counted["matched"] == sum(r[2] is not None and r[3] is not None for r in expected)


def test_skewed_inner_part_is_split(spark, forced_skew):
    """The branch of a hot key is an inner join whose skewed partitions adaptive execution splits."""
    left = spark.range(0, 40000, 1, 8).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS a", "repeat(md5(string(id)), 2) AS pad")
    right = spark.range(0, 400, 1, 2).selectExpr("id AS k", "id AS b")
    fused = ujoin(left, right, hot_min_rows=1000)
    matched = fused.where("a is not null and b is not null").select("k").distinct().count()
    assert fused.count() == 40000 + 400 - matched
    kept = fused.where("b is not null or a is not null")
    kept.collect()
    assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()


def test_keys_with_many_matches_or_a_small_share_take_the_branch(spark, rows, monkeypatch):
    """A key counts by its rows or by rows times rows, whatever share of a side it is."""
    from weftgrid.operators import ujoin as module

    left = spark.range(0, 20000).selectExpr("if(id < 20, 7, id) AS k", "id AS a")
    right = spark.range(0, 3000).selectExpr("if(id < 30, 7, id + 50000) AS k", "id AS b")
    plain = rows(ujoin(left, right, profile=False))
    assert key_profile(left, right, ["k"], 1000) == []
    assert len(key_profile(left, right, ["k"], 20)) >= 1  # 0.1 % of a side
    monkeypatch.setattr(module, "HOT_MIN_PAIRS", 600)
    assert len(key_profile(left, right, ["k"], 1000)) == 1  # 20 x 30 matches
    assert rows(ujoin(left, right, hot_min_rows=1000)) == plain and len(plain) == 600 + 19980 + 2970


def test_rows_without_a_key_are_spread(spark):
    left = spark.range(0, 5000, 1, 4).selectExpr("if(id % 2 = 0, NULL, id) AS k", "id AS a")
    right = spark.range(0, 50).selectExpr("if(id % 2 = 0, NULL, id) AS k", "id AS b")
    fused = ujoin(left, right)
    assert fused.columns == ["k", "a", "b"]
    assert fused.where("k IS NULL").count() == 2525 and fused.where("a IS NOT NULL AND b IS NOT NULL").count() == 25
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = fused.select("k", F.spark_partition_id().alias("p")).where("k IS NULL").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in found) < 1500


def test_numbers_are_compared_exactly(spark, rows):
    big = spark.createDataFrame([(9007199254740993, 1), (5, 2), (7, 3)], "k bigint, a int")
    real = spark.createDataFrame([(9007199254740992.0, 1), (5.0, 2), (7.5, 3)], "k double, b int")
    assert rows(ujoin(big, real)) == [("5", 2, 2), ("7", 3, None), ("7.5", None, 3), ("9007199254740992", None, 1), ("9007199254740993", 1, None)]
    fine = spark.sql("SELECT CAST('1.5' AS decimal(38,18)) AS k, 1 AS a")
    wide = spark.sql("SELECT CAST(x AS decimal(38,0)) AS k, y AS b FROM VALUES ('99999999999999999999999999999999999999', 1), ('2', 2) t(x, y)")
    assert rows(ujoin(fine, wide)) == [("1.5", 1, None), ("2", None, 2), ("99999999999999999999999999999999999999", None, 1)]


def test_names_are_compared_as_the_session_does(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "ID int, x string")
    right = spark.createDataFrame([(2, "c")], "id int, y string")
    fused = ujoin(left, right)
    assert fused.columns == ["ID", "x", "y"] and rows(fused) == [(1, "a", None), (2, "b", "c")]


def test_equal_numbers_of_any_type_meet(spark, rows):
    for text, small in (("0.000015", "decimal(20,6)"), ("100000000000000000000", "decimal(38,0)"), ("-0.5", "decimal(30,20)"), ("0", "decimal(30,20)"),
                        ("123456789012.25", "decimal(38,10)"), ("1E-18", "decimal(38,18)"), ("1200", "bigint"), ("-1200", "decimal(38,5)")):
        left = spark.sql(f"SELECT cast('{text}' AS {small}) AS k, 1 AS a")
        right = spark.sql(f"SELECT cast('{text}' AS double) AS k, 2 AS b")
        for pair in ((left, right), (right, left)):
            assert rows(ujoin(*pair).select("a", "b")) == [(1, 2)], text
    left = spark.sql("SELECT cast(k AS decimal(38,20)) AS k, k AS a FROM VALUES ('1.5'), ('15'), ('0.15'), ('150') AS t(k)")
    right = spark.sql("SELECT cast(k AS double) AS k, k AS b FROM VALUES ('1.5'), ('15'), ('0.15'), ('150'), ('NaN'), ('-Infinity') AS t(k)")
    got = ujoin(left, right)
    assert got.where("a = b").count() == 4 and got.count() == 6
    assert {r["k"] for r in got.collect()} == {"1.5", "15", "0.15", "150", "NaN", "-Infinity"}
