"""Pivot grid: row keys x column keys x aggregator, with totals, on the whole data.

The data is grouped once by all keys (partial sums leave the scan already small);
row totals, column totals and the grand total are rolled up from those cells with
grouping sets, never from the rows again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgrid.functions.numbers import num
from weftgrid.functions.ordering import listed_order, natural_order
from weftgrid.operators.ranking import global_rank

WIDE_LIMIT = 200        # most column keys of a wide layout
LIST_LIMIT = 10_000     # most distinct values listed without blocks
LIST_BLOCK = 1_000      # values of a block

# 80% two-sided bound of a ratio.
Z80 = 1.2815515655446004


@dataclass(frozen=True)
class Aggregator:
    """``parts`` are computed per cell and merged by ``merge`` for totals; ``value`` reads the result."""

    inputs: int
    parts: Callable[[list[Column]], dict[str, Column]]
    merge: dict[str, Callable[[str], Column]]
    value: Callable[[], Column]


def _sum_or_zero(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0.0))


def _ratio_parts(v: list[Column]) -> dict[str, Column]:
    return {"a": _zero(F.sum(v[0])), "b": _zero(F.sum(v[1]))}


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _bound80(sign: int) -> Column:
    """Wilson bound of a/b seen as a success ratio."""
    a, b = F.col("a"), F.nullif(F.col("b"), F.lit(0.0))
    z2 = Z80 * Z80
    spread = F.sqrt(z2 / 4 / (b * b) + a * (1 - a / b) / (b * b))
    bound = (z2 / 2 / b + a / b + sign * Z80 * spread) / (1 + z2 / b)
    return F.when(~F.isnan(bound), bound)


_SUMS = {"a": F.sum, "b": F.sum}
COUNT = Aggregator(0, lambda v: {"n": F.count("*")}, {"n": F.sum}, lambda: F.col("n"))
SUM = Aggregator(1, lambda v: {"s": _zero(F.sum(v[0]))}, {"s": _sum_or_zero}, lambda: F.col("s"))

AGGREGATORS: dict[str, Aggregator] = {
    "Count": COUNT,
    "Sum": SUM,
    "Integer Sum": Aggregator(1, SUM.parts, SUM.merge, lambda: F.round("s", 0)),
    "Average": Aggregator(1, lambda v: {"s": F.sum(v[0]), "k": F.count(v[0])}, {"s": F.sum, "k": F.sum},
                          lambda: F.try_divide("s", "k")),
    "Minimum": Aggregator(1, lambda v: {"m": F.min(v[0])}, {"m": F.min}, lambda: F.col("m")),
    "Maximum": Aggregator(1, lambda v: {"m": F.max(v[0])}, {"m": F.max}, lambda: F.col("m")),
    "Sum over Sum": Aggregator(2, _ratio_parts, _SUMS, lambda: F.try_divide("a", "b")),
    "80% Upper Bound": Aggregator(2, _ratio_parts, _SUMS, lambda: _bound80(1)),
    "80% Lower Bound": Aggregator(2, _ratio_parts, _SUMS, lambda: _bound80(-1)),
}
FRACTIONS: dict[str, tuple[str, str]] = {
    f"{base} as Fraction of {scope}": (base, scope)
    for base in ("Sum", "Count") for scope in ("Total", "Rows", "Columns")
}
DISTINCT = ("Count Unique Values", "List Unique Values")
AGGREGATOR_NAMES = [*AGGREGATORS, *DISTINCT, *FRACTIONS]


def pivot(df: DataFrame, rows: Sequence[str], cols: Sequence[str], aggregator: str = "Count",
          values: Sequence[str] = ()) -> DataFrame:
    """Long pivot grid: key columns, ``level`` (``cell``, ``row``, ``col``, ``total``) and ``value``.

    Keys are text and NULL reads ``"null"``; the key columns a total spans are NULL.
    """
    if aggregator in FRACTIONS:
        base, scope = FRACTIONS[aggregator]
        return _fraction(pivot(df, rows, cols, base, values), rows, cols, scope)
    if aggregator in DISTINCT:
        listed = aggregator.startswith("List")
        return (_list_unique if listed else _count_unique)(df, rows, cols, values[0])
    spec = AGGREGATORS[aggregator]
    if len(values) < spec.inputs:
        raise ValueError(f"{aggregator} needs {spec.inputs} value column(s)")
    inputs = [num(v, df.schema[v].dataType) for v in values[: spec.inputs]]
    keys = [*rows, *cols]
    cells = _keyed(df, keys, {f"_in{i}": c for i, c in enumerate(inputs)})
    parts = spec.parts([F.col(f"_in{i}") for i in range(spec.inputs)])
    cells = cells.groupBy(*keys).agg(*[c.alias(p) for p, c in parts.items()])
    merged = _levels(cells, rows, cols, [spec.merge[p](p).alias(p) for p in parts])
    return merged.select(*keys, "level", spec.value().alias("value"))


def _keyed(df: DataFrame, keys: Sequence[str], extra: dict[str, Column]) -> DataFrame:
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("null")).alias(k) for k in keys]
    return df.select(*texts, *[c.alias(n) for n, c in extra.items()])


def _levels(df: DataFrame, rows: Sequence[str], cols: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregate every level of the grid by grouping sets and name the level."""
    keys = [*rows, *cols]
    if not keys:
        return df.agg(*aggregates).withColumn("level", F.lit("total"))
    sets = [list(s) for s in dict.fromkeys([(*rows, *cols), tuple(rows), tuple(cols), ()])]
    has_rows = F.grouping(rows[0]) == 0 if rows else F.lit(False)
    has_cols = F.grouping(cols[0]) == 0 if cols else F.lit(False)
    level = (
        F.when(has_rows & has_cols, "cell").when(has_rows, "row").when(has_cols, "col").otherwise("total")
    )
    return df.groupingSets(sets, *keys).agg(level.alias("level"), *aggregates)


def unique_values(df: DataFrame, rows: Sequence[str], cols: Sequence[str], value: str) -> DataFrame:
    """The distinct values of every cell and total, one row each: the form without a size limit."""
    keys = [*rows, *cols]
    cells = _keyed(df, keys, {"_value": F.col(value)}).distinct()
    sets = [list(s) for s in dict.fromkeys([(*rows, *cols), tuple(rows), tuple(cols), ()])]
    has_rows = F.grouping(rows[0]) == 0 if rows else F.lit(False)
    has_cols = F.grouping(cols[0]) == 0 if cols else F.lit(False)
    level = F.when(has_rows & has_cols, "cell").when(has_rows, "row").when(has_cols, "col").otherwise("total")
    # NULL is a value of its own here, so it must not look like the NULL of a grouping set.
    boxed = cells.select(*keys, F.struct("_value").alias("_box"))
    grouped = boxed.groupingSets([[*s, "_box"] for s in sets], *keys, "_box").agg(level.alias("level"))
    return grouped.select(*keys, "level", F.col("_box")["_value"].alias("value"))


def _count_unique(df: DataFrame, rows: Sequence[str], cols: Sequence[str], value: str) -> DataFrame:
    """NULL counts as one value.

    The distinct values of the cells are dealt by value; there a value counts for a total in its first cell only, so the
    totals follow from one row per cell.
    """
    keys = [*rows, *cols]
    cells = _keyed(df, keys, {"_value": F.col(value)}).distinct()

    def first(within: Sequence[str]) -> Column:
        rest = [k for k in keys if k not in within]
        order = Window.partitionBy("_value", *within).orderBy(*(rest or ["_value"]))
        return (F.row_number().over(order) == 1).cast("long")

    told = cells.withColumns({"_row": first(rows), "_col": first(cols), "_total": first([])})
    # One row per cell.
    counts = told.groupBy(*keys).agg(F.count("*").alias("_cell"), *[F.sum(c).alias(c) for c in ("_row", "_col", "_total")])
    sums = [F.sum(c).alias(c) for c in ("_cell", "_row", "_col", "_total")]
    value_of = F.when(F.col("level") == "cell", F.col("_cell")).when(F.col("level") == "row", F.col("_row")).when(
        F.col("level") == "col", F.col("_col")).otherwise(F.col("_total"))
    return _levels(counts, rows, cols, sums).where("_cell > 0").select(*keys, "level", value_of.alias("value"))


def unique_blocks(df: DataFrame, rows: Sequence[str], cols: Sequence[str], value: str, size: int = LIST_BLOCK) -> DataFrame:
    """The sorted distinct values of every cell and total as numbered blocks of ``size`` texts, whatever their number.

    All values are put in one order by keys and text, spread over range partitions; a
    cell's blocks count from its first place, so no task sorts a whole cell.
    """
    keys = [*rows, *cols, "level"]
    text = F.coalesce(F.col("value").cast("string"), F.lit(""))
    found = unique_values(df, rows, cols, value).select(*keys, F.struct("value").alias("_box"), text.alias("_text"))
    ranked = global_rank(found, [*[F.col(k).asc_nulls_first() for k in keys], F.col("_text"), F.col("_box")], "_rank")
    ranked = ranked.drop("_box")
    first = ranked.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("_rank").alias("_first"))
    placed = ranked.join(first, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    block = F.floor((F.col("_rank") - F.col("_first")) / size)
    return placed.groupBy(*keys, block.alias("block")).agg(F.sort_array(F.collect_list("_text")).alias("values"))


def _list_unique(df: DataFrame, rows: Sequence[str], cols: Sequence[str], value: str, separator: str = ", ") -> DataFrame:
    """Sorted distinct values of a cell as one text.

    The column's distinct values are counted first: beyond ``LIST_LIMIT`` the texts are put
    together from sorted blocks.  ``unique_blocks`` keeps them apart, for cells that
    outgrow a row.
    """
    if df.select(value).distinct().limit(LIST_LIMIT + 1).count() > LIST_LIMIT:
        blocks = unique_blocks(df, rows, cols, value).withColumn("_part", F.struct("block", F.array_join("values", separator).alias("t")))
        lists = blocks.groupBy(*rows, *cols, "level").agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
        return lists.select(*rows, *cols, "level", F.array_join(F.col("_parts.t"), separator).alias("value"))
    found = unique_values(df, rows, cols, value)
    text = F.coalesce(F.col("value").cast("string"), F.lit(""))
    return found.groupBy(*rows, *cols, "level").agg(
        F.array_join(F.sort_array(F.collect_list(text)), separator).alias("value"))


def _fraction(grid: DataFrame, rows: Sequence[str], cols: Sequence[str], scope: str) -> DataFrame:
    """Divide every level by the total of its scope.

    The totals are rows of the grid already: the grand total is one value, row and
    column totals join back on their keys.
    """
    keys = {"Total": [], "Rows": list(rows), "Columns": list(cols)}[scope]
    levels = {"Total": ["total"], "Rows": ["row", "total"], "Columns": ["col", "total"]}[scope]
    if not keys:
        whole = grid.where("level = 'total'").select("value").scalar()
        return grid.withColumn("value", F.try_divide(F.col("value").cast("double"), whole))
    totals = grid.where(F.col("level").isin(levels)).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("value").alias("_whole"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return (
        grid.join(totals, same, "left")
        .withColumn("value", F.try_divide(F.col("value").cast("double"), F.col("_whole")))
        .select(*rows, *cols, "level", "value")
    )


def _heading_key(cols: Sequence[str]) -> Column:
    """The column key as one text that no other key has: a JSON array of its parts."""
    return F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]))


def _found_keys(df: DataFrame, cols: Sequence[str], limit: int) -> list[tuple[str, str]]:
    """Key and heading (parts joined by ``-``, numbered if two keys would read alike) in natural order."""
    heading = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])
    keys = df.select(_heading_key(cols).alias("k"), heading.alias("h")).distinct().limit(limit + 1)
    found = [(r["k"], r["h"]) for r in keys.orderBy(*natural_order(F.col("h")), "k").collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} column keys: use the long form")
    return found


def _numbered(headings: Sequence[str], taken: Sequence[str]) -> list[str]:
    seen, out = {t.lower() for t in taken}, []
    for heading in headings:
        name, n = heading, 1
        while name.lower() in seen:
            n += 1
            name = f"{heading}_{n}"
        seen.add(name.lower())
        out.append(name)
    return out


def column_keys(df: DataFrame, cols: Sequence[str], limit: int = WIDE_LIMIT) -> list[str]:
    """Headings of the distinct column keys (joined by ``-``) in natural order; an error beyond ``limit``."""
    return [heading for _, heading in _found_keys(df, cols, limit)]


def pivot_wide(df: DataFrame, rows: Sequence[str], cols: Sequence[str], aggregator: str = "Count",
               values: Sequence[str] = (), column_values: Sequence[str | Sequence[str]] | None = None,
               totals: bool = True) -> DataFrame:
    """Wide pivot grid: one row per row key, one column per column key, optional totals.

    Pass ``column_values`` when the keys are known (the value of a single column attribute, or a sequence with one
    value per attribute); a key that is not among them makes the job fail.  Otherwise they are looked up first.
    Keys are told apart by all their parts and totals by their level, whatever the values look like; headings that
    would read alike are numbered, and a data column ``Totals`` comes before the totals.
    """
    shown = F.lit(True) if totals else F.col("level").isin("cell", *([] if cols else ["row"]))
    grid = pivot(df, rows, cols, aggregator, values).where(shown)
    total_row = F.col("level").isin("col", "total") if rows else F.lit(False)
    row_keys = [F.when(total_row, "Totals").otherwise(F.col(r)).alias(r) for r in rows]
    if not cols:
        return grid.select(*row_keys, F.col("value").alias(aggregator))
    if column_values is None:
        found = _found_keys(df, cols, WIDE_LIMIT)
    else:
        listed = [(v,) if isinstance(v, str) else tuple(v) for v in column_values]
        found = [(json.dumps(v, ensure_ascii=False, separators=(",", ":")), "-".join(v)) for v in listed]
    known = [key for key, _ in found]
    key = F.col("_key")
    checked = F.when(key.isin([*known, ""]), key).otherwise(F.raise_error(F.concat(F.lit("column key not listed: "), key)))
    column_key = F.when(F.col("level").isin("cell", "col"), _heading_key(cols)).otherwise("")
    spread = grid.select(*row_keys, total_row.alias("_total"), column_key.alias("_key"), "value").withColumn("_key", checked)
    wide = spread.groupBy(*rows, "_total").pivot("_key", known + ([""] if totals else [])).agg(F.max("value"))
    headings = _numbered([h for _, h in found] + (["Totals"] if totals else []), rows)
    return wide.drop("_total").toDF(*rows, *headings)


def sort_keys(grid: DataFrame, keys: Sequence[str], listed: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Order a grid by its keys: natural order, or the listed values of a key first; totals come last."""
    order = []
    for key in keys:
        value = F.col(key)
        order.append((value.isNull() | (value == "Totals")).asc())
        order += listed_order(value, listed[key]) if listed and key in listed else natural_order(value)
    return grid.orderBy(*order)


def scale_cells(grid: DataFrame, rows: Sequence[str], cols: Sequence[str], scope: str = "all") -> DataFrame:
    """Heat and bar positions of a long grid's values.

    ``heat`` is the place between the least and greatest finite value of the scope
    (``all`` cells, each ``row`` or each ``col``); ``bar`` is 100 x / (1.4 max).  Row totals
    and column totals are scales of their own; the grand total has none.
    """
    keys = {"all": [], "row": list(rows), "col": list(cols)}[scope]
    number = F.col("value").cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    shaded = grid.where("level <> 'total'").withColumn("_x", finite)
    # Totals form one scope each, whatever their keys.
    scoped = shaded.withColumns({f"_{k}": F.when(F.col("level") == "cell", F.col(k)) for k in keys})
    marks = ["level", *[f"_{k}" for k in keys]]
    ends = scoped.groupBy(*marks).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    ends = ends.select(*[F.col(m).alias(f"_at_{m}") for m in marks], "_lo", "_hi")
    if not keys:
        ends = F.broadcast(ends)  # one row per level: at most three
    same = [F.col(m).eqNullSafe(F.col(f"_at_{m}")) for m in marks]
    x = F.col("_x")
    return scoped.join(ends, same, "left").select(
        *rows, *cols, "level", "value",
        F.try_divide(x - F.col("_lo"), F.col("_hi") - F.col("_lo")).alias("heat"),
        F.try_divide(100 * x, F.lit(1.4) * F.col("_hi")).alias("bar"),
    )
