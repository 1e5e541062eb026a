import random

import pytest

from weftgrid.operators.profile import describe, describe_all, histogram


def counts(df, column="v"):
    return [(r["low"], r["high"], r["n"]) for r in histogram(df, column).orderBy("bucket").collect()]


def test_whole_numbers_keep_their_tail(spark):
    df = spark.range(10).selectExpr("id AS v")
    assert [tuple(r) for r in histogram(df, "v", 3).orderBy("bucket").select("label", "n").collect()] == [
        ("[-1, 2)", 2), ("[2, 5)", 3), ("[5, 8)", 3), ("[8, 11]", 2)]
    assert sum(n for _, _, n in counts(df)) == 10


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("dtype", ["bigint", "int", "double", "decimal(12,2)", "string"])
def test_counts_sum_and_match_brute_force(spark, seed, dtype):
    rng = random.Random(seed)
    size = rng.choice([1, 2, 30, 300])
    if dtype == "string":
        values = [rng.choice([None, "pre" + "".join(rng.choice("abcxyzé") for _ in range(rng.randint(0, 4)))]) for _ in range(size)]
    else:
        values = [rng.choice([None, rng.randint(-50, 1000), rng.randint(0, 5)]) for _ in range(size)]
    df = spark.createDataFrame([(v,) for v in values], "v string" if dtype == "string" else "v bigint")
    df = df.selectExpr(f"cast(v AS {dtype}) AS v")
    kept = [v for v in values if v is not None]
    found = histogram(df, "v").orderBy("bucket").collect()
    assert sum(r["n"] for r in found) == len(kept)
    if dtype != "string":
        for place, r in enumerate(found):
            last = place == len(found) - 1
            assert r["n"] == sum(float(r["low"]) <= v < float(r["high"]) or (last and v == r["high"]) for v in kept)
            assert r["label"].endswith("]" if last else ")")


def test_empty_and_null_columns_have_no_buckets(spark):
    df = spark.createDataFrame([(None, None, None)], "i int, d double, s string")
    for column in "ids":
        assert histogram(df, column).collect() == []
        assert histogram(df.where("false"), column).collect() == []
    assert tuple(describe(df, "i").first()) == (0, None, None, None, None)


def test_one_value(spark):
    df = spark.createDataFrame([(5, 5.0, "same"), (5, 5.0, "same")], "i int, d double, s string")
    for column in "ids":
        found = histogram(df, column).collect()
        assert sum(r["n"] for r in found) == 2
    assert [r["n"] for r in histogram(df, "s").collect()] == [2]


def test_prefix_equal_to_the_least_value(spark):
    df = spark.createDataFrame([("ab",), ("abc",), ("abd",)], "s string")
    assert sum(r["n"] for r in histogram(df, "s").collect()) == 3


def test_text_labels(spark):
    df = spark.createDataFrame([("Party A",), ("Party B",), ("Party C",)], "s string")
    assert [r["label"] for r in histogram(df, "s").orderBy("bucket").collect()] == ["[Party A, Party B)", "[Party B, Party C]"]


def test_describe(spark):
    df = spark.createDataFrame([(1, "b", "7"), (3, "a", "9"), (None, None, None)], "n int, s string, t string")
    assert tuple(describe(df, "n").first()) == (2, 2.0, 2 ** 0.5, 1, 3)
    assert tuple(describe(df, "s").first()) == (2, None, None, "a", "b")
    assert tuple(describe(df, "t").first())[:2] == (2, 8.0)
    assert [r["column"] for r in describe_all(df).collect()] == ["n", "s", "t"]


def test_boolean_has_no_histogram(spark):
    with pytest.raises(ValueError):
        histogram(spark.createDataFrame([(True,)], "b boolean"), "b")


def test_histogram_of_all_bigints(spark):
    df = spark.createDataFrame([(-(1 << 63),), ((1 << 63) - 1,), (0,), (None,)], "v bigint")
    found = histogram(df, "v").collect()
    assert sum(r["n"] for r in found) == 3
    assert all(a["high"] == b["low"] for a, b in zip(found, found[1:])) or len(found) > 1


def test_histogram_counts_infinity_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "v double")
    found = sorted(histogram(df, "v").collect(), key=lambda r: r["bucket"])
    assert sum(r["n"] for r in found) == 6
    assert [(r["label"], r["n"]) for r in found if r["low"] is None] == [("-Infinity", 1), ("Infinity", 1), ("NaN", 2)]
    only = histogram(df.where("isnan(v)"), "v").collect()
    assert [(r["bucket"], r["label"], r["n"]) for r in only] == [(0, "NaN", 2)]


def test_decimal_buckets_hold_numbers_of_any_size(spark):
    for values in ([1e17], [1e17, 1e17 + 16], [-1e300, 1e17, 3.0], [1.7e308, -1.7e308, 0.0], [1.7976931348623157e308] * 3, [5e-324, 1e300, -2.0], [-4e15, -4e15 + 1]):
        for most in (1, 3, 20):
            found = histogram(spark.createDataFrame([(v,) for v in values + [None]], "v double"), "v", most).orderBy("bucket").collect()
            assert sum(r["n"] for r in found) == len(values)
            assert len(found) == min(most, len(values))
            largest = 1.7976931348623157e308
            assert all((r["low"] < r["high"] or r["low"] == largest) and abs(r["low"]) <= largest >= abs(r["high"]) for r in found)
            assert found[0]["low"] <= min(values) and max(values) <= found[-1]["high"]
