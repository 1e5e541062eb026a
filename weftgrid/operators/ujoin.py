"""u-join: fuse two frames on the columns they share, keeping every row of both.

* shared columns: full outer equi-join on all of them, shared values coalesced;
* no shared column: the schemas are disjoint and the result is their union;
* an empty grid (no columns) adopts the other frame.

Column order is the left order followed by the right-only columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgrid.functions.rows import bound
from weftgrid.session import materialize

HOT_MIN_ROWS = 5_000_000  # rows of a key on one side that are worth a branch of their own
HOT_MIN_PAIRS = 50_000_000  # ... or matches of a key
SKETCHES = 64           # heavy-hitter sketches per side, each for a range of key hashes
SKETCH_KEYS = 64        # keys one sketch tracks
SKETCH_TOP = 8          # most frequent keys read from one sketch


def _folded(df: DataFrame) -> dict[str, str]:
    """Column names by the form in which the session compares them."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    return {c if exact else c.lower(): c for c in df.columns}


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Names in both frames, in left order and spelling; case matters only if it does to the session."""
    other = _folded(right)
    return [c for name, c in _folded(left).items() if name in other]


def schema_union(left: DataFrame, right: DataFrame) -> list[str]:
    return left.columns + schema_difference(right, left)


def schema_difference(left: DataFrame, right: DataFrame) -> list[str]:
    """Names of ``left`` that ``right`` lacks, in left order."""
    other = _folded(right)
    return [c for name, c in _folded(left).items() if name not in other]


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type both sides of a shared column are widened to before comparison."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        digits = [_digits(t) for t in (a, b)]
        if None not in digits:  # whole numbers and decimals
            whole, scale = (max(pair) for pair in zip(*digits))
            if not any(isinstance(t, T.DecimalType) for t in (a, b)):
                return a if digits[0] >= digits[1] else b
            return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
        if all(d is None or sum(d) <= 15 for d in digits):
            # A double holds 15 digits, a float 7.
            small = all(isinstance(t, T.FloatType) or (d is not None and sum(d) <= 5) for t, d in zip((a, b), digits))
            return T.FloatType() if small else T.DoubleType()
        return T.StringType()  # such numbers are compared as text, see _as_text
    if {type(a), type(b)} <= {T.DateType, T.TimestampType, T.TimestampNTZType}:
        return b if isinstance(a, T.DateType) else a
    return T.StringType()


def _digits(dtype: T.DataType) -> tuple[int, int] | None:
    """Digits before and after the point that a type may hold; None for floating point."""
    if isinstance(dtype, T.DecimalType):
        return dtype.precision - dtype.scale, dtype.scale
    whole = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}.get(type(dtype))
    return None if whole is None else (whole, 0)


def _as_text(value: Column, dtype: T.DataType) -> Column:
    """A number as plain decimal text that is the same for the same number of any type: no exponent, no zeros behind the last digit."""
    text = value.cast("string")
    if not (isinstance(dtype, T.FloatType | T.DoubleType) or (isinstance(dtype, T.DecimalType) and dtype.scale)):
        return text
    form = r"^(-?)(\d*)\.?(\d*)(?:E([+-]?\d+))?$"

    def parts(whole: Column, fraction: Column, exponent: Column) -> Column:
        """Digits without zeros at either end, and how many stand before the point: negative for zeros after it."""
        written = F.concat(whole, fraction)
        first = F.ltrim(written, F.lit("0"))
        moved = F.when(exponent == "", 0).otherwise(exponent.cast("int"))
        return F.struct(F.rtrim(first, F.lit("0")).alias("digits"),
                        (F.length(whole) + moved - (F.length(written) - F.length(first))).alias("point"))

    def written(sign: Column, digits: Column, point: Column) -> Column:
        n = F.length(digits)
        return (
            F.when(digits == "", "0")
            .when(point <= 0, F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= n, F.concat(sign, digits, F.repeat(F.lit("0"), point - n)))
            .otherwise(F.concat(sign, digits.substr(F.lit(1), point), F.lit("."), digits.substr(point + 1, n))))

    plain = bound(text, lambda t: bound(
        parts(*[F.regexp_extract(t, form, i) for i in (2, 3, 4)]), lambda p: written(F.regexp_extract(t, form, 1), p["digits"], p["point"])))
    return F.when(text.rlike(form), plain).otherwise(text)  # NaN and the infinities stay


def ujoin(left: DataFrame, right: DataFrame, *, profile: bool = True, hot_min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """u-join of two frames.

    One full outer join does it, unless keys are so uneven that a task would drown:
    Spark cannot split a skewed partition of a full outer join.  Rows with a NULL in
    a shared column, which cannot match and would all hash to one place, are spread by
    a hash of the row that joins the keys.  One pass over the key columns (left out by
    ``profile=False``) looks for keys with very many rows or matches; their rows take a
    branch that can be split (``_join_hot``).  The result does not depend on what the pass finds.
    """
    if not left.columns:
        return right
    if not right.columns:
        return left
    keys = shared_columns(left, right)
    if not keys:
        return left.unionByName(right, allowMissingColumns=True)

    spelled = {_folded(right)[name]: c for name, c in _folded(left).items() if name in _folded(right)}
    left, right = _widen(left, right.withColumnsRenamed(spelled), keys)
    hot = key_profile(left, right, keys, hot_min_rows) if profile else []
    names = schema_union(left, right)
    parts = []
    if hot:
        is_hot = F.coalesce(F.xxhash64(*keys).isin(hot) & _has_keys(keys), F.lit(False))
        parts += _join_hot(left.where(is_hot), right.where(is_hot), keys)
        left, right = left.where(~is_hot), right.where(~is_hot)
    parts.insert(0, _full_join(left, right, keys))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*names)


def _full_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on the keys; rows without a key are spread by one more join column."""
    if not any(side.schema[k].nullable for side in (left, right) for k in keys):
        return left.join(right, list(keys), "full")
    spread = "_spread"
    while spread in left.columns or spread in right.columns:
        spread += "_"
    salted = [
        side.withColumn(spread, F.when(_has_keys(keys), F.lit(0).cast("bigint")).otherwise(F.xxhash64(*_hashable(side))))
        for side in (left, right)]
    return salted[0].join(salted[1], [*keys, spread], "full").drop(spread)


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]


def _has_keys(keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])


def key_profile(left: DataFrame, right: DataFrame, keys: Sequence[str], min_rows: int) -> list[int]:
    """Hashes of the keys whose work is worth a branch of its own.

    That is a key with at least ``min_rows`` rows on a side, or whose rows on both
    sides make ``HOT_MIN_PAIRS`` matches.  Each task sends a few sketches of fixed
    size, which different tasks merge, and at most ``SKETCHES * SKETCH_TOP`` keys per
    side come back.  A collision or a miss only changes which branch does the work.
    """
    key_hash = F.when(_has_keys(keys), F.xxhash64(*keys))
    sides = [side.select(F.lit(i).alias("side"), key_hash.alias("h")).where("h is not null") for i, side in enumerate((left, right))]
    found = sides[0].unionByName(sides[1]).groupBy("side", F.pmod("h", F.lit(SKETCHES)).alias("sketch")).agg(
        F.expr(f"approx_top_k(h, {SKETCH_TOP}, {SKETCH_KEYS})").alias("top")).collect()
    counts: list[dict[int, int]] = [{}, {}]
    for row in found:
        counts[row["side"]].update({item["item"]: item["count"] for item in row["top"] or []})
    return sorted(
        h for h in counts[0].keys() | counts[1].keys()
        if max(counts[0].get(h, 0), counts[1].get(h, 0)) >= min_rows
        or counts[0].get(h, 0) * counts[1].get(h, 0) >= HOT_MIN_PAIRS)


def _widen(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    targets = {k: common_type(left.schema[k].dataType, right.schema[k].dataType) for k in keys}
    return _retyped(left, targets), _retyped(right, targets)


def _retyped(side: DataFrame, targets: Mapping[str, T.DataType]) -> DataFrame:
    """``side`` with its columns among ``targets`` in these types."""
    def widened(k: str, target: T.DataType) -> Column:
        dtype = side.schema[k].dataType
        as_text = isinstance(target, T.StringType) and isinstance(dtype, T.NumericType)
        return _as_text(F.col(k), dtype) if as_text else F.col(k).cast(target)

    return side.withColumns({k: widened(k, t) for k, t in targets.items() if k in side.columns and side.schema[k].dataType != t})


def _join_hot(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[DataFrame]:
    """Full outer join of the hot rows, in parts Spark can spread.

    The inner join's skewed partitions are split by adaptive execution on either
    side.  The unmatched rows come from anti joins against the distinct hot keys
    of the other side: about one per hash found, so they are broadcast and the rows
    themselves never move.
    """
    left_keys, right_keys = (side.select(*keys).distinct() for side in (left, right))
    return [
        left.join(right, list(keys), "inner"),
        left.join(F.broadcast(right_keys), list(keys), "left_anti"),
        right.join(F.broadcast(left_keys), list(keys), "left_anti"),
    ]


def ujoin_all(frames: Mapping[str, DataFrame], **options) -> DataFrame:
    """u-join of many named frames whose result does not depend on the given order.

    Frames that share columns, directly or through others, form a component.
    Within it the next frame is always one that shares a column with what is
    already joined: most shared columns first, then by name.  Components have
    disjoint schemas and are unioned, best connected first.

    A partial result is written out before the next join: looking at its keys and
    splitting its rows must not run the joins before it again.
    """
    waiting = {name: df for name, df in sorted(frames.items()) if df.columns}
    fused: list[DataFrame] = []
    while waiting:
        first = max(waiting, key=lambda name: _links(waiting[name], [d for n, d in waiting.items() if n != name]))
        joined, is_base = waiting.pop(first), True
        while True:
            linked = {name: len(shared_columns(joined, df)) for name, df in waiting.items()}
            if not any(linked.values()):
                break
            name = max(linked, key=linked.get)
            joined = ujoin(joined if is_base else materialize(joined, "u-join"), waiting.pop(name), **options)
            is_base = False
        fused.append(joined)
    if not fused:
        return next(iter(frames.values()))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fused)


def _links(df: DataFrame, others: Sequence[DataFrame]) -> int:
    seen = {c for other in others for c in other.columns}
    return sum(c in seen for c in df.columns)


def match_count(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many rows the u-join will hold, from key counts only (no row is multiplied).

    One row: ``matched, left_only, right_only, total``.
    """
    keys = shared_columns(left, right)
    left, right = _widen(left, right, keys)
    counts = [side.groupBy(*keys).agg(F.count("*").alias(n)) for side, n in ((left, "_l"), (right, "_r"))]
    per_key = counts[0].join(counts[1], keys, "full")
    n_left, n_right = (F.coalesce(F.col(c), F.lit(0)) for c in ("_l", "_r"))
    sums = per_key.agg(
        F.coalesce(F.sum(n_left * n_right), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.when(n_right == 0, n_left)), F.lit(0)).alias("left_only"),
        F.coalesce(F.sum(F.when(n_left == 0, n_right)), F.lit(0)).alias("right_only"),
    )
    return sums.withColumn("total", F.expr("matched + left_only + right_only"))
