"""Numbers as texts of reports; a missing value reads `missing`."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _or_missing(value: Column, text: Column) -> Column:
    return F.when(value.isNull(), "missing").otherwise(text)


def _fixed(value: Column, digits: int) -> Column:
    return F.replace(F.format_number(value.cast("double"), digits), F.lit(","), F.lit(""))


def _signed(text: Column) -> Column:
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))


def integer(value: Column) -> Column:
    """Thousands parted by commas."""
    return _or_missing(value, F.format_number(value.cast("long"), 0))


def decimal(value: Column, digits: int = 4) -> Column:
    return _or_missing(value, _fixed(value, digits))


def percent(value: Column) -> Column:
    return _or_missing(value, F.concat(_fixed(value * 100, 2), F.lit("%")))


def delta(value: Column) -> Column:
    return _or_missing(value, _signed(_fixed(value, 4)))


def percent_delta(value: Column) -> Column:
    return _or_missing(value, F.concat(_signed(_fixed(value * 100, 2)), F.lit(" pp")))


def integer_range(least: Column, most: Column) -> Column:
    return F.when(least.isNull(), "missing").when(least == most, integer(least)).otherwise(F.concat(integer(least), F.lit("-"), integer(most)))
