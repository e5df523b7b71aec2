"""Values written as text in many spellings, read as one type. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of the two logical values.
TRUE = ["t", "true", "yes", "y", "1", "on"]
FALSE = ["f", "false", "no", "n", "0", "off"]

_NUMBER = r"^([+-]?(?:\d+[.,]?\d*|[.,]\d+)(?:[EeDd][+-]?\d+)?)"
# a unit follows after a blank, or directly if it is a sign or one of these
_UNIT = r"(?:\s+[A-Za-zµ%°\"'][A-Za-z0-9µ%°\"'/^²]*|%|°[CF]?|s|ms|sec|mm|cm|m|C|K|ADU|e|deg|arcsec|mag)?$"


def bare(text: Column) -> Column:
    """The text without outer quotes and blanks."""
    return F.regexp_replace(text, r"^[\s\u00a0'\"]+|[\s\u00a0'\"]+$", "")


def _digits(text: Column) -> Column:
    t = bare(text)
    return F.translate(F.when(t.rlike(_NUMBER + _UNIT), F.regexp_extract(t, _NUMBER, 1)), ",Dd", ".EE")


def number(text: Column) -> Column:
    """The one finite number a text states: decimal comma, Fortran exponent, sign and a following unit allowed; else null."""
    v = _digits(text).try_cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def whole(text: Column) -> Column:
    """As `number`, for values without a fraction that fit a bigint, exactly."""
    v, exact = number(text), _digits(text).try_cast("decimal(38,6)")
    return F.when((v == F.floor(v)) & (exact == F.floor(exact)), exact.try_cast("bigint"))


def with_readings(df: DataFrame, text: str) -> DataFrame:
    """df with _bare, _num and _int: what `bare`, `number` and `whole` make of a column, each worked out once in a projection of its own."""
    df = df.withColumn("_bare", bare(F.col(text)))
    df = df.withColumn("_digits", F.translate(F.when(F.col("_bare").rlike(_NUMBER + _UNIT), F.regexp_extract("_bare", _NUMBER, 1)), ",Dd", ".EE"))
    v, exact = F.col("_digits").try_cast("double"), F.col("_digits").try_cast("decimal(38,6)")
    df = df.withColumn("_num", F.when(F.abs(v) < float("inf"), v)).withColumn("_exact", exact)
    return df.withColumn("_int", F.when((F.col("_num") == F.floor("_num")) & (F.col("_exact") == F.floor("_exact")), F.col("_exact").try_cast("bigint"))).drop("_digits", "_exact")


def of_bare(bare_text: Column) -> Column:
    """As `logical`, of a text without outer quotes and blanks."""
    t = F.lower(bare_text)
    return F.when(t.isin(TRUE), True).when(t.isin(FALSE), False)


def plain_number(text: Column) -> Column:
    """A number that is all of a text, blanks aside, in the usual notation; else null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def logical(text: Column) -> Column:
    t = F.lower(bare(text))
    return F.when(t.isin(TRUE), True).when(t.isin(FALSE), False)


def folded(text: Column) -> Column:
    """Text for comparison: without case, outer quotes and blanks."""
    return F.upper(bare(text))
