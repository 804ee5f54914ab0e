"""Column expressions shared by all operators. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that count as a number.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_PATTERN = r"^\s*[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
# Fixed value: the white space a text is stripped of.
SPACE = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
         "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """A double whose NaN became NULL, so that every aggregate skips it."""
    x = _col(c).cast("double")
    return F.when(~F.isnan(x), x)


def num(c: Column | str) -> Column:
    return _col(c).cast("double")


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(_col(c).cast("double"), digits) + F.lit(0.0)


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, NULL where the divisor is zero or NULL."""
    return F.when(bottom != 0, top / bottom)


def strip_text(c: Column | str) -> Column:
    """All leading and trailing white space removed, tabs and line ends included."""
    return F.btrim(_col(c), F.lit(SPACE))


def norm_text(c: Column | str) -> Column:
    """Comparison key of a text: stripped, case folded, NULL when nothing is left."""
    folded = F.replace(F.lower(strip_text(c)), F.lit("ß"), F.lit("ss"))
    return F.when(folded != "", folded)


def is_blank(c: Column | str) -> Column:
    """True for a present text of white space only."""
    return F.coalesce(strip_text(c) == "", F.lit(False))


def parse_number(c: Column | str) -> Column:
    """The number a text spells, NULL for blank, `nan` and anything else."""
    x = _col(c)
    sign = F.when(x.contains("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        F.when(x.rlike(NUMBER_PATTERN), x.try_cast("double"))
        .when(x.rlike(INFINITY_PATTERN), sign * F.lit(float("inf")))
    )


def to_text(c: Column | str) -> Column:
    return _col(c).cast("string")
