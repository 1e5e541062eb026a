import random
from itertools import permutations, product

import pytest

from weftgrid.operators.disjunction import connected_subsets, full_disjunction, subset_sizes
from weftgrid.operators.ujoin import ujoin, ujoin_all


def brute(frames):
    """Tries all sets of rows, one or none of each frame."""
    names = sorted(frames)
    rows = {n: [dict(zip(frames[n][0], r)) for r in frames[n][1]] for n in names}
    columns = []
    for n in names:
        columns += [c for c in frames[n][0] if c not in columns]
    share = {(a, b): [c for c in frames[a][0] if c in frames[b][0]] for a in names for b in names if a != b}

    def fits(a, r, b, q):
        return all(r[c] is not None and r[c] == q[c] for c in share[a, b])

    def connected(chosen):
        seen, todo = set(), [next(iter(chosen))]
        while todo:
            a = todo.pop()
            if a not in seen:
                seen.add(a)
                todo += [b for b in chosen if b != a and share[a, b]]
        return len(seen) == len(chosen)

    good = []
    for pick in product(*[[None, *range(len(rows[n]))] for n in names]):
        chosen = {n: i for n, i in zip(names, pick) if i is not None}
        if chosen and connected(chosen) and all(fits(a, rows[a][i], b, rows[b][j]) for a, i in chosen.items() for b, j in chosen.items() if a < b):
            good.append(chosen)
    whole = [g for g in good if not any(len(h) > len(g) and g.items() <= h.items() for h in good)]
    out = []
    for g in whole:
        merged = dict.fromkeys(columns)
        for n, i in g.items():
            merged.update({c: v for c, v in rows[n][i].items() if v is not None})
        out.append(tuple(merged[c] for c in columns))
    return columns, sorted(out, key=repr)


def made(spark, frames):
    return {n: spark.createDataFrame(rows, ", ".join(f"{c} int" for c in columns)) for n, (columns, rows) in frames.items()}


def test_the_three_frames_in_every_order(spark, rows):
    frames = {"R": (["a", "b"], [(1, 1)]), "S": (["b", "c"], [(1, 1)]), "T": (["c", "d"], [(1, 1)])}
    spark_frames = made(spark, frames)
    for order in permutations("RST"):
        got = full_disjunction({n: spark_frames[n] for n in order})
        assert got.columns == ["a", "b", "c", "d"] and rows(got) == [(1, 1, 1, 1)]
    # Without S's row for T the fused rows are those of the sets that are left.
    frames["S"] = (["b", "c"], [(1, 2)])
    assert rows(full_disjunction(made(spark, frames))) == sorted([(1, 1, 2, None), (None, None, 1, 1)], key=repr)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("shape", [
    {"R": "ab", "S": "bc", "T": "cd"}, {"R": "ab", "S": "bc", "T": "ca"}, {"H": "abc", "I": "ax", "J": "by"}, {"R": "ab", "S": "bcd", "T": "dc", "U": "e"}])
def test_against_all_sets_of_rows(spark, rows, shape, seed):
    rng = random.Random(seed)
    frames = {
        n: (list(columns), [tuple(rng.choice([None, 1, 1, 2, 3]) for _ in columns) for _ in range(rng.choice([0, 3, 5]))])
        for n, columns in shape.items()}
    columns, want = brute(frames)
    given = made(spark, frames)
    got = full_disjunction(given)
    assert (got.columns, rows(got)) == (columns, want)
    assert rows(full_disjunction(dict(reversed(given.items())))) == want


def test_two_frames_are_a_u_join(spark, rows):
    left = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (4, "w"), (4, "w")], "k int, l string")
    right = spark.createDataFrame([(1, "p"), (1, "p"), (5, "q"), (None, "z")], "K int, r string")
    assert rows(full_disjunction({"l": left, "r": right})) == rows(ujoin(left, right))


def test_types_names_and_empty_frames(spark, rows):
    a = spark.createDataFrame([(1, 2), (3, 4)], "k bigint, x int")
    b = spark.createDataFrame([(1.0, 5)], "K double, y int")
    c = spark.createDataFrame([], "k int, z int")
    got = full_disjunction({"a": a, "b": b, "c": c, "none": spark.createDataFrame([], "")})
    assert got.columns == ["k", "x", "y", "z"] and got.count() == 2
    assert rows(got.select("x", "y")) == sorted([(2, 5), (4, None)], key=repr)
    apart = full_disjunction({"a": a.select("x"), "b": b.select("y")})
    assert rows(apart) == sorted([(2, None), (4, None), (None, 5)], key=repr)


def test_number_of_sets():
    chain = {i: {j for j in (i - 1, i + 1) if 0 <= j < 6} for i in range(6)}
    assert len(connected_subsets(chain)) == 21
    with pytest.raises(ValueError):
        connected_subsets({i: set(range(12)) - {i} for i in range(12)}, 1000)


def test_sizes_of_sets(spark, rows):
    frames = made(spark, {"R": (["a", "b"], [(1, 1), (2, 2)]), "S": (["b", "c"], [(1, 1), (9, 9)])})
    assert rows(subset_sizes(frames, full_disjunction(frames))) == [("R", 1), ("R,S", 1), ("S", 1)]


def test_uneven_keys_are_split(spark, rows, forced_skew):
    left = spark.range(4000).selectExpr("cast(case when id < 3000 then 1 else id end as int) AS k", "cast(id as int) AS l")
    right = spark.range(50).selectExpr("cast(id as int) AS k", "cast(id as int) AS r")
    third = spark.range(20).selectExpr("cast(id as int) AS r", "cast(id as int) AS t")
    got = full_disjunction({"l": left, "r": right, "t": third})
    assert rows(got.groupBy("k").count()) == rows(ujoin_all({"l": left, "r": right, "t": third}).groupBy("k").count())
