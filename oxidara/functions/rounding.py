"""Rounding of a double's exact binary value to decimal digits, ties to the even digit.

``round`` of Spark and DuckDB works on the shortest decimal text of a double: 2.675 becomes 2.68, though the double lies below it.  Here x * 10**digits is
split without error into a rounded product and its remainder (the halves of both factors are multiplied apart), so it is known on which side of a tie
the exact value lies.  Plain arithmetic of columns: no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double of 53 bits into two of 26.
_SPLITTER = float((1 << 27) + 1)
#: From here on a double is whole, or its product with the power of ten is beyond exact whole numbers: it stays as it is.
_WHOLE = float(1 << 52)


def half_even_sql(x: str, digits: int) -> str:
    """The rounded value as SQL text over x, a name or a short expression; the same text works in Spark and in DuckDB."""
    scale = 10.0**digits
    high = _SPLITTER * scale - (_SPLITTER * scale - scale)
    low = scale - high
    number = lambda v: f"CAST('{v!r}' AS DOUBLE)"
    product = f"({x} * {number(scale)})"
    x_high = f"({number(_SPLITTER)} * {x} - ({number(_SPLITTER)} * {x} - {x}))"
    x_low = f"({x} - {x_high})"
    error = f"((({x_high} * {number(high)} - {product}) + {x_high} * {number(low)} + {x_low} * {number(high)}) + {x_low} * {number(low)})"
    whole = f"CAST(floor({product}) AS DOUBLE)"
    side = f"(({product} - {whole} - {number(0.5)}) + {error})"
    odd = f"({whole} - 2 * CAST(floor({whole} / 2) AS DOUBLE))"
    rounded = f"({whole} + CASE WHEN {side} > 0 THEN 1 WHEN {side} < 0 THEN 0 ELSE {odd} END) / {number(scale)}"
    return f"CASE WHEN abs({x}) * {number(scale)} < {number(_WHOLE)} THEN {rounded} ELSE {x} END"


def half_even(value: Column, digits: int) -> Column:
    """The rounded value as a column; null, NaN and infinity stay as they are."""
    scale = 10.0**digits
    high = _SPLITTER * scale - (_SPLITTER * scale - scale)
    low = scale - high

    def rounded(x: Column) -> Column:
        product = x * F.lit(scale)
        x_high = F.lit(_SPLITTER) * x - (F.lit(_SPLITTER) * x - x)
        x_low = x - x_high
        error = ((x_high * F.lit(high) - product) + x_high * F.lit(low) + x_low * F.lit(high)) + x_low * F.lit(low)
        whole = F.floor(product).cast("double")
        side = (product - whole - F.lit(0.5)) + error
        odd = whole - 2 * F.floor(whole / 2).cast("double")
        return F.when(F.abs(product) < _WHOLE, (whole + F.when(side > 0, F.lit(1.0)).when(side < 0, F.lit(0.0)).otherwise(odd)) / F.lit(scale)).otherwise(x)

    return F.element_at(F.transform(F.array(value.cast("double")), rounded), 1)
