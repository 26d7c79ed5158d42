"""Column functions shared by the operators; every one is a native Spark expression."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F, types as T


def hash_unit(*key: str | Column) -> Column:
    """Uniform value in [0, 1) that depends on the row key only.

    Unlike ``rand`` it does not change with the partition layout, so a lost
    task recomputes exactly the same rows.  The first 32 bits of MD5 are used
    because every SQL engine can reproduce them.
    """
    digest = F.md5(F.concat_ws("|", *key).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_percent(*key: str | Column) -> Column:
    """Integer in 0..99 from the row key."""
    digest = F.md5(F.concat_ws("|", *key).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def flag(condition: Column) -> Column:
    """1 where the condition holds; 0 where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def or_zero(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, 0.0 when the denominator is zero."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def literal_map(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])


def look_up(value: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Value of a small driver-side mapping; the default (or null) where it has no such key."""
    fallback = F.lit(None) if default is None else default
    if not mapping:
        return fallback
    return F.coalesce(F.try_element_at(literal_map(mapping), value), fallback)


def class_name(index: Column, names: Mapping[int, str]) -> Column:
    """Display name of a class index, the index as text when it has none."""
    as_int = index.cast("int")
    return look_up(as_int, names, as_int.cast("string")).cast("string")


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.CharType, T.VarcharType))


def is_time(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def quoted(name: str) -> str:
    """Column reference that survives brackets, slashes and dots in the name."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """SQL literal of a text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column(name: str) -> Column:
    return F.col(quoted(name))
