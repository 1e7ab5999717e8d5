"""Rules over declared column types, as SQL over their text."""

from __future__ import annotations

from pyspark.sql import types as T

# Declared types that are widened, and type texts that cannot be converted.
WIDENED_TO_INT = ("tinyint", "smallint")
WIDENED_TO_STRING = ("char(", "varchar(")
UNSUPPORTED = ("uniontype<", "interval ")


def _either(tests: list[str]) -> str:
    return f"({' OR '.join(tests)})"


def _is_small_integer(dtype: str) -> str:
    return f"{dtype} IN ({', '.join(map(repr, WIDENED_TO_INT))})"


def _is_sized_text(dtype: str) -> str:
    return _either([f"startswith({dtype}, '{prefix}')" for prefix in WIDENED_TO_STRING])


def _mentions(dtype: str, texts: tuple[str, ...]) -> str:
    return _either([f"contains({dtype}, '{text}')" for text in texts])


def normalized_type(dtype: str) -> str:
    """The type a column has after a rewrite; used to compare schemas."""
    lowered = f"lower({dtype})"
    return (
        f"CASE WHEN {_is_small_integer(lowered)} THEN 'int' "
        f"WHEN {_is_sized_text(lowered)} THEN 'string' ELSE {lowered} END"
    )


def normalized_field(dtype: T.DataType) -> str:
    """The same rule for a type of a DataFrame schema."""
    if isinstance(dtype, (T.ByteType, T.ShortType)):
        return "int"
    if isinstance(dtype, (T.CharType, T.VarcharType)):
        return "string"
    return dtype.simpleString().lower()


def cast_target(dtype: str) -> str:
    """The type a column must be cast to, or NULL where it stays as it is."""
    lowered = f"lower(trim({dtype}))"
    return (
        f"CASE WHEN {_is_small_integer(lowered)} THEN 'int' "
        f"WHEN {_is_sized_text(lowered)} THEN 'string' END"
    )


def type_blocker(name: str, dtype: str) -> str:
    """Why a column cannot be converted, or NULL where it can."""
    lowered = f"lower(trim({dtype}))"
    label = f"concat({name}, ':', {dtype})"
    return f"""CASE
        WHEN {_is_small_integer(lowered)} OR {_is_sized_text(lowered)} THEN NULL
        WHEN {_mentions(lowered, UNSUPPORTED)} THEN {label}
        WHEN {_mentions(lowered, WIDENED_TO_INT + WIDENED_TO_STRING)}
        THEN concat('nested conversion required for ', {label}) END"""


def column_casts(columns: str) -> str:
    """``array<struct<name,dtype>>`` of the needed casts, in column order."""
    cast = f"struct(c.name AS name, {cast_target('c.dtype')} AS dtype)"
    return f"filter(transform({columns}, c -> {cast}), c -> c.dtype IS NOT NULL)"


def column_blockers(columns: str) -> str:
    """``array<string>`` of the reasons that forbid an automatic conversion, in column order."""
    return f"array_compact(transform({columns}, c -> {type_blocker('c.name', 'c.dtype')}))"
