"""Canonical text of published tables, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exact_decimal(value: Column, places: int = 6) -> Column:
    """The value with so many places; one that would lose digits is an error."""
    kept = value.cast(f"decimal(38,{places})")
    lossy = F.raise_error(F.concat(F.lit("digits would be lost: "), value.cast("string")))
    return F.when(value.isNull() | (kept.cast("decimal(38,18)") == value.cast("decimal(38,18)")), kept).otherwise(lossy)


def fixed_point(value: Column) -> Column:
    """A double with 15 places as its bits say, ties to even, without trailing zeros; below 2**63, or else an error.

    The fraction is a whole number of 2**-60, so its places are those of an exact quotient.
    """
    size = F.abs(value)
    whole = F.floor(size).cast("long")
    product = F.floor((size - whole) * float(1 << 60)).cast("long").cast("decimal(20,0)") * F.lit(10**15).cast("decimal(16,0)")
    scale = F.lit(1 << 60).cast("decimal(20,0)")
    rest = product % scale
    down = ((product - rest) / scale).cast("long")
    up = (rest * 2 > scale) | ((rest * 2 == scale) & (down % 2 == 1))
    places = down + up.cast("long")
    full = places == 10**15
    digits = F.concat((whole + full.cast("long")).cast("string"), F.lit("."), F.lpad(F.when(full, 0).otherwise(places).cast("string"), 15, "0"))
    text = F.regexp_replace(digits, r"\.?0+$", "")
    return F.when((value < 0) & (text != "0"), F.concat(F.lit("-"), text)).otherwise(text)


def cell(value: Column, kind: T.DataType) -> Column:
    """NA for null; numbers with a fraction in fixed point (see ``fixed_point``); other values as they are.

    Numbers that aren't finite are errors; text with a comma, quote or line feed is quoted.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        wide = value.cast("double")
        bad = F.raise_error(F.lit("only finite numbers can be published")).cast("string")
        text = F.when(wide.isNull(), F.lit(None)).when(F.isnan(wide) | (F.abs(wide) == float("inf")), bad).otherwise(fixed_point(wide))
    else:
        plain = value.cast("string")
        text = F.when(plain.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(plain)
    return F.coalesce(text, F.lit("NA"))


def csv_line(schema: T.StructType, columns: Sequence[str]) -> Column:
    """One line of a canonical CSV, without its line feed."""
    return F.concat_ws(",", *[cell(F.col(f"`{c}`"), schema[c].dataType) for c in columns])
