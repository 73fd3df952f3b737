"""Numeric column expressions with the null, NaN and zero rules that measurement reports need."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """The value as double; null where it isn't a number or is NaN."""
    d = as_col(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def finite(c: Column | str) -> Column:
    """True for finite numbers, false for null, NaN and infinities."""
    d = as_col(c).try_cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < INF), F.lit(False))


def stripped(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c).cast("string"), r"^\s+|\s+$", "")


def missing(c: Column | str) -> Column:
    """Null, NaN and blank texts are missing."""
    t = stripped(c)
    return t.isNull() | (t == "") | (t == "NaN")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation as an aggregate; null if either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def linear_rgb(c: Column | str) -> Column:
    """The linear value of an sRGB code 0..255, clipped to 0..1."""
    x = F.least(F.greatest(as_col(c) / 255.0, F.lit(0.0)), F.lit(1.0))
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def guarded(value: Column, rules: Mapping[str, Column]) -> Column:
    """``value``, but the query fails with the first message whose condition holds."""
    for message, broken in reversed(list(rules.items())):
        value = F.when(broken, F.raise_error(F.lit(message)).cast("double")).otherwise(value)
    return value


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of ``one``, a table of one row such as a total, on every row: a scalar subquery, not a join."""
    whole = one.select(F.struct(*one.columns)).scalar().alias("_beside")
    return df.select("*", whole).select(*df.columns, *(F.col(f"_beside.{c}").alias(c) for c in one.columns))


def rounded(df: DataFrame, places: int = 6, keep: Sequence[str] = ()) -> DataFrame:
    """Every double column rounded, for comparison between engines."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))
