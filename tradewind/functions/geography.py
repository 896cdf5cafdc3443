"""Postcode to department."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: At most so many ranges stand in front of a join; more are drawn together into one.
MOST_RANGES = 32

# The beginnings of Corsican postcodes.
CORSICAN = {"2A": ("200", "201"), "2B": ("202", "206")}


def department_of(postcode: Column, corsica: bool = False) -> Column:
    """First two characters of a postcode, or three for overseas (97, 98).

    With ``corsica`` the Corsican postcodes map to ``2A`` (200, 201) and
    ``2B`` (202, 206), the codes the department map lists.
    """
    two = F.substring(postcode, 1, 2)
    three = F.substring(postcode, 1, 3)
    code = F.when(two.isin("97", "98"), three)
    if corsica:
        for department, beginnings in CORSICAN.items():
            code = code.when(three.isin(*beginnings), department)
    return code.otherwise(two)


def _after(beginning: str) -> str | None:
    """The least text after all texts with this beginning, in byte order; None if there is none."""
    for i in range(len(beginning) - 1, -1, -1):
        following = ord(beginning[i]) + 1
        if following == 0xD800:  # the surrogates are no characters
            following = 0xE000
        if following <= 0x10FFFF:
            return beginning[:i] + chr(following)
    return None


def postcode_ranges(departments: Iterable[str], corsica: bool = False) -> list[tuple[str, str | None]]:
    """Ranges of postcodes, from (included) to (excluded, or None), that hold every postcode of the departments.

    A department's postcodes begin with its code; Corsican ones, where they are
    read so, with others.  Ranges that overlap or touch are merged.  They may hold
    other postcodes too, so the test of the department itself stays behind them.
    """
    beginnings = {d for d in departments if d is not None}
    if corsica:
        beginnings |= {b for d in beginnings & set(CORSICAN) for b in CORSICAN[d]}
    merged: list[tuple[str, str | None]] = []
    for low, high in sorted(((b, _after(b)) for b in beginnings), key=lambda r: r[0].encode()):
        if merged and (merged[-1][1] is None or low.encode() <= merged[-1][1].encode()):
            before, end = merged.pop()
            if end is not None and high is not None:
                high = max(end, high, key=str.encode)
            else:
                high = None
            merged.append((before, high))
        else:
            merged.append((low, high))
    if len(merged) > MOST_RANGES:
        merged = [(merged[0][0], merged[-1][1])]
    return merged


def within_ranges(postcode: Column, ranges: list[tuple[str, str | None]]) -> Column:
    """Comparisons of the bare column, which reach the files' statistics."""
    tests = [(postcode >= low) if high is None else (postcode >= low) & (postcode < high) for low, high in ranges]
    return reduce(Column.__or__, tests) if tests else F.lit(False)
