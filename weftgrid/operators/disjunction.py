"""Full disjunction: what many frames say together, whatever the order in which they are given.

A set of rows, at most one of each frame, is *consistent* when any two of its rows whose frames share columns agree in all of
them (NULL agrees with nothing), and *connected* when its frames hang together by shared columns.  The full disjunction has a
row for every consistent connected set that no further row can join, with NULL in the columns of frames that it lacks.
For two frames it is their u-join.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgrid.operators.ujoin import _retyped, common_type, schema_difference, shared_columns
from weftgrid.session import materialize


def connected_subsets(neighbours: Mapping[str, set[str]], most: int | None = None) -> list[tuple[str, ...]]:
    """Sets of names that hang together, the smaller ones first, each sorted by name; more than ``most`` are an error."""
    layers = [{frozenset([n]) for n in neighbours}]
    count = len(layers[0])
    while layers[-1]:
        layers.append({s | {n} for s in layers[-1] for m in s for n in neighbours[m] - s})
        count += len(layers[-1])
        if most is not None and count > most:
            raise ValueError(f"more than {most} connected sets of frames: raise max_sets to join them all")
    return [tuple(sorted(s)) for layer in layers for s in sorted(layer, key=sorted)]


def _last(names: tuple[str, ...], known: Mapping[tuple[str, ...], DataFrame]) -> str:
    """The last name without which the others still hang together."""
    return next(n for n in reversed(names) if tuple(m for m in names if m != n) in known)


def full_disjunction(frames: Mapping[str, DataFrame], max_sets: int = 1024) -> DataFrame:
    """Full disjunction of named frames; neither order nor names matter to the rows.

    Every connected set of frames is one inner join more than a smaller set, so no set is joined twice, and an uneven
    key is split by adaptive execution, which it can't be in a full outer join.  A joined row stays if no frame
    beside it has a row that fits: one anti join a neighbour, on its distinct keys.  Joins that others go on from are
    written out once.

    Shared columns are compared as in ``ujoin``: numbers of any type by their value.  Repeated rows are sets of their own and
    stay; a NULL in a shared column fits nothing.  Frames without columns add nothing.  There is one join per
    connected set, of which a chain of n frames has n (n + 1) / 2 and a star more than 2^(n - 1); ``max_sets``
    bounds them.
    """
    held = {name: df for name, df in sorted(frames.items()) if df.columns}
    if not held:
        return next(iter(frames.values()))
    order: list[str] = []
    types: dict = {}
    spelled: dict[str, str] = {}
    exact = next(iter(held.values())).sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    fold = (lambda c: c) if exact else str.lower
    # The columns in the order of the names of their frames, in the spelling and type that all frames have in common.
    for name, df in held.items():
        df = df.withColumnsRenamed({c: spelled[fold(c)] for c in df.columns if fold(c) in spelled})
        for field in df.schema.fields:
            spelled.setdefault(fold(field.name), field.name)
            types[field.name] = common_type(types[field.name], field.dataType) if field.name in types else field.dataType
        order += [c for c in df.columns if c not in order]
        held[name] = df
    held = {name: _retyped(df, types) for name, df in held.items()}
    neighbours = {n: {m for m in held if m != n and shared_columns(held[n], held[m])} for n in held}
    sets = connected_subsets(neighbours, max_sets)
    inner = {s[:i] + s[i + 1:] for s in sets for i in range(len(s))}
    joined: dict[tuple[str, ...], DataFrame] = {}
    parts = []
    for names in sets:
        if len(names) == 1:
            here = held[names[0]]
        else:
            one = _last(names, joined)
            rest = joined[tuple(n for n in names if n != one)]
            here = rest.join(held[one], shared_columns(rest, held[one]), "inner")
            if names in inner:
                here = materialize(here, "disjunction")
        joined[names] = here
        whole = here
        for other in sorted({m for n in names for m in neighbours[n]} - set(names)):
            keys = shared_columns(whole, held[other])
            whole = whole.join(held[other].select(*keys).distinct(), keys, "left_anti")
        parts.append(whole)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*order)


def subset_sizes(frames: Mapping[str, DataFrame], result: DataFrame) -> DataFrame:
    """How many rows of a full disjunction have values of each set of frames' own columns: ``sources``, ``n``.

    A frame counts as present where one of the columns that only it has is not NULL.
    """
    own = {}
    for name, df in sorted(frames.items()):
        others = [o for n, o in frames.items() if n != name]
        mine = [c for c in df.columns if all(c in schema_difference(df, o) for o in others)]
        if mine:
            own[name] = mine
    present = F.array_compact(F.array(*[
        F.when(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns]), F.lit(name)) for name, columns in own.items()]))
    return result.groupBy(F.array_join(present, ",").alias("sources")).agg(F.count(F.lit(1)).alias("n"))
