"""Typed getters over JSON texts; a field of another type is an error, never a silent null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What the type of a JSON value may be called for each getter.
_KINDS = {"string": "STRING", "long": "BIGINT|BOOLEAN", "double": "BIGINT|BOOLEAN|DOUBLE|FLOAT|DECIMAL.*", "array": "ARRAY.*", "object": "OBJECT.*"}


def _parsed(source: Column | str) -> Column:
    return F.parse_json(F.col(source) if isinstance(source, str) else source)


def _typed(value: Column, kind: str, name: str, optional: bool, take: Column) -> Column:
    of = F.schema_of_variant(value)
    none = value.isNull() | (of == "VOID")
    wrong = F.raise_error(F.concat(F.lit(f"{name}: a {kind} is expected, not "), F.coalesce(of, F.lit("nothing"))))
    fits = F.when(of.rlike(f"^({_KINDS[kind]})$"), take).otherwise(wrong)
    return F.when(none, F.lit(None) if optional else wrong).otherwise(fits)


def field(source: Column | str, name: str, kind: str, optional: bool = False) -> Column:
    """The field of a JSON object as a string, long or double, or as the JSON text of an array or object.

    true and false count as 1 and 0 where a number is wanted. With optional, null and
    missing fields are null; else they are errors, as are all fields of another type.
    """
    path = "$." + name
    value = F.try_variant_get(_parsed(source), path, "variant")
    kinds = {"string": "string", "long": "bigint", "double": "double"}
    take = F.to_json(value) if kind in ("array", "object") else F.try_variant_get(_parsed(source), path, kinds[kind])
    return _typed(value, kind, name, optional, take)


def count_of(source: Column | str, name: str) -> Column:
    """How many a field tells of: the size of an array, or an integer itself; null or missing gives null, any other type is an error."""
    parsed, path = _parsed(source), "$." + name
    value = F.try_variant_get(parsed, path, "variant")
    of = F.schema_of_variant(value)
    wrong = F.raise_error(F.concat(F.lit(f"{name}: an array or integer is expected, not "), of)).cast("long")
    size = F.size(F.try_variant_get(parsed, path, "array<variant>")).cast("long")
    return F.when(value.isNull() | (of == "VOID"), F.lit(None).cast("long")).when(of.startswith("ARRAY"), size).when(of.rlike("^(BIGINT|BOOLEAN)$"), F.try_variant_get(parsed, path, "bigint")).otherwise(wrong)
