"""Array helpers: pairs of an array's elements, and several arrays as one
sorted set.  They work inside a row, so arrays should be short lists such as
the shards of a pool; pairs of rows are joins (``operators.audit``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def element_pairs(values: Column) -> Column:
    """``array<struct<a, b>>``: every two elements once, in the array's order.
    NULL gives NULL, fewer than two elements give an empty array."""
    def after(a: Column, i: Column) -> Column:
        return F.transform(F.slice(values, i + 2, F.greatest(F.size(values), F.lit(1))),
                           lambda b: F.struct(a.alias("a"), b.alias("b")))

    return F.flatten(F.transform(values, after))


def sorted_set(*arrays: Column) -> Column:
    """The distinct non-NULL elements of all ``arrays``, ascending; a NULL array
    counts as empty."""
    lists = F.flatten(F.array(*[F.coalesce(a, F.array()) for a in arrays]))
    return F.array_sort(F.array_distinct(F.array_compact(lists)))


def expand_roles(roles: Column, groups: dict[str, list[str]]) -> Column:
    """Lower-case role names, a name in ``groups`` standing for its members;
    each name once, in order of first appearance."""
    def members(name: Column) -> Column:
        out = F.array(name)
        for group, names in groups.items():
            out = F.when(name == group, F.array(*[F.lit(n) for n in names])).otherwise(out)
        return out

    return F.array_distinct(F.flatten(F.transform(F.transform(roles, lambda r: F.lower(r)), members)))
