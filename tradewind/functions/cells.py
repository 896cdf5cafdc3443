"""Values and headers that are safe to open in a spreadsheet."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that start a formula, and the control characters
# (all but tab, line feed and carriage return) that are removed.
FORMULA_START = "=+-@\t\r\n"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


# How doubles and decimals show a power of ten: sign, digits, fraction, power.
_POWER = r"^(-?)([0-9]+)(?:\.([0-9]+))?E([+-]?[0-9]+)$"


def free_name(name: str, columns: Sequence[str]) -> str:
    """``name``, longer if a column has it already."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain_number(text: Column) -> Column:
    """The text of a number without a power of ten, all its digits kept: ``1.2E7`` is ``12000000.0``."""
    sign, lead = F.regexp_extract(text, _POWER, 1), F.regexp_extract(text, _POWER, 2)
    fraction = F.regexp_replace(F.regexp_extract(text, _POWER, 3), "0+$", "")
    power = F.regexp_extract(text, _POWER, 4).cast("int")
    digits, places = F.concat(lead, fraction), F.length(fraction)
    split = F.length(lead) + power
    whole = F.when(text.contains("."), F.lit(".0")).otherwise(F.lit(""))
    large = F.concat(digits, F.repeat(F.lit("0"), power - places), whole)
    middle = F.concat(F.substring(digits, F.lit(1), split), F.lit("."), F.substring(digits, split + 1, F.length(digits)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -split), digits)
    plain = F.when(power >= places, large).when(split > 0, middle).otherwise(small)
    # Few numbers hold an E, and only those are taken apart.
    return F.when(text.contains("E") & text.rlike(_POWER), F.concat(sign, plain)).otherwise(text)


def _guard(text: Column) -> Column:
    risky = F.ascii(text).isin([ord(c) for c in FORMULA_START])
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)


def _strip(text: Column) -> Column:
    """Rewrites only the rare value that holds a control character."""
    return F.when(text.rlike(CONTROL), F.regexp_replace(text, CONTROL, "")).otherwise(text)


def csv_safe_value(value: Column, legacy_order: bool = False) -> Column:
    """Text that no spreadsheet runs as a formula; NULL becomes ``''``.

    Control characters go first, then a leading formula character gets an
    apostrophe.  ``legacy_order`` guards before stripping, so that a formula
    behind a control character is let through.  Numbers are written without a
    power of ten.
    """
    text = value.cast("string")
    text = F.when(F.typeof(value).rlike("^(double|float|decimal)"), plain_number(text)).otherwise(text)
    text = F.coalesce(text, F.lit(""))
    return _strip(_guard(text)) if legacy_order else _guard(_strip(text))


def csv_safe_cells(df: DataFrame, legacy_order: bool = False) -> DataFrame:
    """Every column as safe text.

    Control characters are looked for once per row, in all its text together.
    Numbers and times hold none, but a number can be negative.  Fractional
    numbers are written without a power of ten.
    """
    plain = (T.NumericType, T.DatetimeType, T.BooleanType)
    values = {}
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            value = value.cast("int")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(value)
        text = value.cast("string")
        values[f.name] = plain_number(text) if isinstance(f.dataType, T.FractionalType) else text
    texts = [values[f.name] for f in df.schema.fields if not isinstance(f.dataType, plain)]
    flag = free_name("_dirty", df.columns)
    dirty = F.concat_ws("", *texts).rlike(CONTROL) if texts else F.lit(False)

    def cell(f: T.StructField) -> Column:
        text = F.coalesce(values[f.name], F.lit(""))
        if isinstance(f.dataType, plain):
            safe = _guard(text)
        elif legacy_order:
            safe = F.when(F.col(flag), _strip(_guard(text))).otherwise(_guard(text))
        else:
            safe = _guard(F.when(F.col(flag), _strip(text)).otherwise(text))
        return safe.alias(f.name)

    return df.withColumn(flag, dirty).select([cell(f) for f in df.schema.fields])


def clean_header(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_]", "_", name)


def csv_header_clean(df: DataFrame) -> DataFrame:
    """Rename columns to letters, digits and ``_``; a collision is an error."""
    names = [clean_header(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"columns collide after cleaning: {', '.join(clashes)}")
    return df.toDF(*names)
