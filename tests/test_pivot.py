import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgrid.functions.numbers import bin_down, date_text, integer_text, num, number_text, percent_text
from weftgrid.functions.ordering import listed_order, natural_order
from weftgrid.operators import pivot as pv


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [("e", "1", 2.0, 4.0), ("e", "2", 3.0, 0.0), ("w", "1", None, 1.0), (None, "2", 5.0, 5.0), ("w", "1", 7.0, 2.0)],
        "side string, lot string, x double, y double").persist()


def grid(df, *args):
    return {(r["side"], r["lot"]): r["value"] for r in pv.pivot(df, ["side"], ["lot"], *args).collect()}


def test_seventeen_aggregators():
    assert len(pv.AGGREGATOR_NAMES) == 17


def test_counts_and_totals(sales):
    assert grid(sales) == {
        ("e", "1"): 1, ("e", "2"): 1, ("w", "1"): 2, ("null", "2"): 1, ("e", None): 2, ("w", None): 2, ("null", None): 1,
        (None, "1"): 3, (None, "2"): 2, (None, None): 5}


def test_empty_sums_and_averages(sales):
    missing = sales.where("x is null")
    assert grid(missing, "Sum", ["x"])[("w", "1")] == 0.0
    assert grid(missing, "Average", ["x"])[("w", "1")] is None
    assert grid(missing, "Minimum", ["x"])[("w", "1")] is None
    assert grid(sales, "Average", ["x"])[("w", "1")] == 7.0
    assert grid(sales, "Sum over Sum", ["x", "y"])[("e", "2")] is None


def test_cells_add_up_to_totals(sales):
    for aggregator, values in (("Count", []), ("Sum", ["y"])):
        cells = grid(sales, aggregator, values)
        for key in {k for k, _ in cells if k is not None}:
            assert math.isclose(cells[(key, None)], sum(v for (r, c), v in cells.items() if r == key and c is not None))
        assert math.isclose(cells[(None, None)], sum(v for (r, c), v in cells.items() if r is not None and c is not None))


@pytest.mark.parametrize("scope, level", [("Total", "cell"), ("Rows", "cell"), ("Columns", "cell")])
def test_fractions_sum_to_one(sales, scope, level):
    found = pv.pivot(sales, ["side"], ["lot"], f"Count as Fraction of {scope}").where(F.col("level") == level)
    by = {"Total": [], "Rows": ["side"], "Columns": ["lot"]}[scope]
    assert all(math.isclose(r["s"], 1.0) for r in found.groupBy(*by).agg(F.sum("value").alias("s")).collect())


def test_bounds_enclose_the_ratio(spark):
    df = spark.createDataFrame([("a", "b", 30.0, 100.0)], "side string, lot string, x double, y double")
    low, high = (grid(df, f"80% {b} Bound", ["x", "y"])[("a", "b")] for b in ("Lower", "Upper"))
    z = 1.2815515655446004
    centre, spread = (0.3 + z * z / 200) / (1 + z * z / 100), z * math.sqrt(0.3 * 0.7 / 100 + z * z / 40000) / (1 + z * z / 100)
    assert math.isclose(low, centre - spread, rel_tol=1e-9) and math.isclose(high, centre + spread, rel_tol=1e-9)


def test_unique_values(sales):
    assert grid(sales, "Count Unique Values", ["x"])[("w", "1")] == 2
    assert grid(sales, "List Unique Values", ["lot"])[(None, None)] == "1, 2"
    assert grid(sales, "List Unique Values", ["side"])[(None, None)] == ", e, w"


def test_without_rows_or_columns(sales):
    assert {(r["side"], r["value"]) for r in pv.pivot(sales, ["side"], []).collect()} == {("e", 2), ("w", 2), ("null", 1), (None, 5)}
    assert [r["value"] for r in pv.pivot(sales, [], []).collect()] == [5]
    assert {(r["lot"], r["level"]) for r in pv.pivot(sales, [], ["lot"]).collect()} == {("1", "col"), ("2", "col"), (None, "total")}


def test_wide_layout(sales):
    wide = {r["side"]: (r["1"], r["2"], r["Totals"]) for r in pv.pivot_wide(sales, ["side"], ["lot"], "Sum", ["y"]).collect()}
    assert wide == {"e": (4.0, 0.0, 4.0), "w": (3.0, None, 3.0), "null": (None, 5.0, 5.0), "Totals": (7.0, 5.0, 12.0)}


def test_wide_layout_is_bounded(spark):
    with pytest.raises(ValueError):
        pv.pivot_wide(spark.range(300).selectExpr("1 AS r", "id AS c"), ["r"], ["c"])


def test_numbers_are_read_from_the_front(spark):
    texts = ["12abc", " -3.5e2x", ".5", "abc", "", None, "+7", "1.2.3", "Infinity!"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(num("t", T.StringType())).collect()] == [
        12.0, -350.0, 0.5, None, None, None, 7.0, 1.2, math.inf]


def test_display(spark):
    values = [1234567.891, 0.0, None, float("nan"), float("inf"), -0.125, 2.5, 1.005]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    shown = [tuple(r) for r in df.select(number_text(F.col("x")), integer_text(F.col("x")), percent_text(F.col("x"))).collect()]
    assert [s[0] for s in shown] == ["1,234,567.89", "", "", "", "", "-0.13", "2.50", "1.00"]
    assert shown[6][1:] == ("3", "250.0%")


def test_derived_attributes(spark):
    df = spark.createDataFrame([("2016-06-01 07:08:09", -7.0)], "t string, x double")
    assert df.select(date_text(F.col("t"), "%d/%m/%y %n %w%x %H:%M:%S%%z")).first()[0] == "01/06/2016 Jun Wed3 07:08:09%%z"
    assert df.select(bin_down(F.col("x"), 5)).first()[0] == -5.0


def test_key_order(spark):
    keys = ["b10", "b9", "a", "B1", "10", "9", "b007", "null"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.orderBy(*natural_order(F.col("k"))).collect()] == ["9", "10", "a", "b007", "B1", "b9", "b10", "null"]
    assert [r[0] for r in df.orderBy(*listed_order(F.col("k"), ["null", "a"])).collect()][:3] == ["null", "a", "9"]


def test_scales(spark):
    df = spark.createDataFrame([("r", "1", 1.0), ("r", "2", 3.0), ("s", "1", 5.0)], "side string, lot string, x double")
    long = pv.pivot(df, ["side"], ["lot"], "Sum", ["x"])
    cells = {(r["side"], r["lot"]): (r["heat"], r["bar"]) for r in pv.scale_cells(long, ["side"], ["lot"]).where("level = 'cell'").collect()}
    assert cells[("r", "1")][0] == 0.0 and cells[("s", "1")][0] == 1.0
    assert math.isclose(cells[("r", "2")][1], 300 / 7)
    by_row = pv.scale_cells(long, ["side"], ["lot"], "row").where("level = 'cell'")
    assert {r["heat"] for r in by_row.where("side = 'r'").collect()} == {0.0, 1.0}


def test_sorted_grid(spark):
    df = spark.createDataFrame([("k10", "x"), ("k9", "y"), ("k9", "x")], "side string, lot string")
    ordered = pv.sort_keys(pv.pivot(df, ["side"], ["lot"]), ["side", "lot"], {"lot": ["y"]})
    assert [(r["side"], r["lot"]) for r in ordered.collect()] == [
        ("k9", "y"), ("k9", "x"), ("k9", None), ("k10", "x"), ("k10", None), (None, "y"), (None, "x"), (None, None)]


def test_wide_keys_that_read_alike_stay_apart(spark, rows):
    df = spark.createDataFrame([("r", "a-b", "c", 1.0), ("r", "a", "b-c", 5.0), ("Totals", "a", "b-c", 1.0), ("r", "Totals", "x", 2.0)],
                               "r string, c string, d string, v double")
    wide = pv.pivot_wide(df, ["r"], ["c", "d"], "Sum", ["v"])
    assert sorted(wide.columns) == sorted(["r", "a-b-c", "a-b-c_2", "Totals-x", "Totals"])
    found = rows(wide.select("r", "`a-b-c`", "`a-b-c_2`", "`Totals-x`", "Totals"))
    assert sorted([sorted(r[1:3], key=repr) + list(r[3:]) for r in found if r[0] == "r"]) == [[1.0, 5.0, 2.0, 8.0]]
    assert sorted(r[4] for r in found if r[0] == "Totals") == [1.0, 9.0]  # the row named so, and the totals
    single = pv.pivot_wide(df, ["r"], ["c"], "Sum", ["v"])
    assert "Totals" in single.columns and "Totals_2" in single.columns


def test_keys_that_are_not_listed_are_errors(spark):
    df = spark.createDataFrame([("r", "x", 1.0), ("r", "z", 7.0)], "r string, c string, v double")
    assert pv.pivot_wide(df, ["r"], ["c"], "Sum", ["v"], column_values=["x", "z"]).first()["Totals"] == 8.0
    with pytest.raises(Exception, match="not listed"):
        pv.pivot_wide(df, ["r"], ["c"], "Sum", ["v"], column_values=["x"]).collect()


def test_lists_of_any_length(spark, monkeypatch):
    from weftgrid.operators import pivot as pv
    data = [("a", str(i % 7), str(i % 40)) for i in range(300)] + [("b", "1", None), ("b", "1", ""), (None, "2", "x")]
    df = spark.createDataFrame(data, "r string, c string, v string").repartition(4)
    blocks = {}
    for x in pv.unique_blocks(df, ["r"], ["c"], "v", 9).collect():
        blocks.setdefault((x["r"], x["c"], x["level"]), {})[x["block"]] = x["values"]
    whole = blocks[None, None, "total"]
    assert sorted(whole) == list(range(len(whole))) and all(len(v) == 9 for b, v in whole.items() if b < len(whole) - 1)
    assert sum((whole[b] for b in sorted(whole)), []) == sorted([str(i) for i in range(40)] + ["", "", "x"])
    assert blocks["b", "1", "cell"] == {0: ["", ""]}
    short = {tuple(x[:3]): x["value"] for x in pv.pivot(df, ["r"], ["c"], "List Unique Values", ["v"]).collect()}
    monkeypatch.setattr(pv, "LIST_LIMIT", 5)
    monkeypatch.setattr(pv, "LIST_BLOCK", 4)
    assert {tuple(x[:3]): x["value"] for x in pv.pivot(df, ["r"], ["c"], "List Unique Values", ["v"]).collect()} == short


@pytest.mark.parametrize("rows, cols", [(["r"], ["c"]), (["r"], []), ([], ["c"]), ([], []), (["r", "c"], [])])
def test_unique_values_are_counted_once_in_totals(spark, rows, cols):
    import random
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3]), rng.choice([None, *range(12)])) for _ in range(150)]
    df = spark.createDataFrame(data, "r string, c int, v int").repartition(3)
    made = pv.pivot(df, rows, cols, "Count Unique Values", ["v"])
    names, expected = [*rows, *cols], {}
    for r, c, v in data:
        own = {"r": "null" if r is None else r, "c": str(c)}
        for level in {"cell" if rows and cols else "row" if rows else "col" if cols else "total", *(["row"] if rows else []), *(["col"] if cols else []), "total"}:
            shown = {"cell": names, "row": rows, "col": cols, "total": []}[level]
            expected.setdefault((*[own[k] if k in shown else None for k in names], level), set()).add(v)
    assert {tuple(x[:-1]): x["value"] for x in made.collect()} == {k: len(v) for k, v in expected.items()}
    assert pv.pivot(df.limit(0), rows, cols, "Count Unique Values", ["v"]).count() == 0
    plan = pv.pivot(df, ["r"], ["c"], "Count Unique Values", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "_box" not in plan and "Window" in plan
