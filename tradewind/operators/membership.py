"""Keep parents by their children, and children by their parents.

The three functions differ in which side may repeat a key, because that decides
how a very frequent key has to be shuffled:

* ``where_children`` - parents are unique, children repeat.  The children are
  reduced to one row per key with a map-side partial aggregate before the
  shuffle, so a hot key costs one row per task.
* ``children_of`` - children repeat, parents are unique.  A plain semi join:
  adaptive execution splits a hot partition of the left side.
* ``children_by_value`` - both may repeat.  The keys are reduced per salt
  first, which collapses a hot key but keeps a shuffle below the join, so that
  adaptive execution can still split the other side.

None of them hints a broadcast; Spark decides that from the size it measures.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def matched(rows: DataFrame, keys: DataFrame, on: str | list[str], how: str = "left_semi"):
    """A semi or anti join on equal names that keeps the column order."""
    return rows.join(keys, on, how).select(*[f"`{c}`" for c in rows.columns])


@dataclass(frozen=True)
class ChildTest:
    """At least ``at_least`` child rows satisfy ``predicate`` (any row if None).

    ``wanted=False`` asks for the opposite.
    """

    predicate: Column | None = None
    at_least: int = 1
    wanted: bool = True


def where_children(
    parents: DataFrame, children: DataFrame, on: str, tests: Sequence[ChildTest]
) -> DataFrame:
    """Parents whose children pass every test.

    All tests on one child table share one scan, one aggregate and one join.
    """
    if not tests:
        return parents
    predicates = [t.predicate for t in tests]
    if all(p is not None for p in predicates):
        relevant = predicates[0]
        for p in predicates[1:]:
            relevant = relevant | p
        children = children.where(relevant)

    if len(tests) == 1 and tests[0].at_least <= 1:
        keys = children.select(on).distinct()
        return matched(parents, keys, on, "left_semi" if tests[0].wanted else "left_anti")

    counts = children.groupBy(on).agg(
        *[
            F.count_if(F.lit(True) if t.predicate is None else t.predicate).alias(f"_{i}")
            for i, t in enumerate(tests)
        ]
    )
    reached = [F.col(f"_{i}") >= t.at_least for i, t in enumerate(tests)]
    if any(t.wanted for t in tests):
        for t, r in zip(tests, reached):
            counts = counts.where(r if t.wanted else ~r)
        return matched(parents, counts.select(on), on)
    unwanted = reached[0]
    for r in reached[1:]:
        unwanted = unwanted | r
    return matched(parents, counts.where(unwanted).select(on), on, "left_anti")


def children_of(
    children: DataFrame, parents: DataFrame, on: str, key: str | None = None
) -> DataFrame:
    """Children whose ``on`` is a ``key`` of the parents (unique there)."""
    return matched(children, parents.select(F.col(key or on).alias(on)), on)


def children_by_value(
    children: DataFrame,
    parents: DataFrame,
    on: str,
    key: str,
    spread: str,
    how: str = "left_semi",
) -> DataFrame:
    """Rows whose ``on`` occurs as ``key`` on the other side, repeated or not.

    ``spread`` is a column of the other side that tells rows of one key apart.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).alias("_salt")
    keys = (
        parents.select(F.col(key).alias(on), salt)
        .where(F.col(on).isNotNull())
        .distinct()
        .select(on)
    )
    return matched(children, keys, on, how)
