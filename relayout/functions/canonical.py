"""Comparable forms of column values, generated from a schema as SQL expressions.

Two forms with the same notion of equality are used:

* ``text_form`` renders a value as text that is comparable across column types.
* ``hash_arguments`` feeds values to a hash in their own type, with no text at all for
  flat columns. It is used wherever both sides of a comparison have the same type, which
  is the normal case, and costs a fraction of rendering every value.

Both keep NULL apart from every real value, ``-0.0`` apart from ``0.0``, keep
microseconds at any depth, and ignore the order of map entries.

Expressions refer to columns by position, as ``by_position`` names them, so no column name
can be mistaken for a table or a struct. A wide table is one expression text, not thousands
of column objects.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Renderings of floating point numbers and of points in time.
FLOAT_FORMAT = "%.17g"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
TIMESTAMP_NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

# One mask carries the NULL flags of this many values; bit 63 is the sign bit.
_MASK_BITS = 63

_FLOATING = (T.FloatType, T.DoubleType)
_SMALL_INTEGERS = (T.ByteType, T.ShortType)
_HASHED_AS_IS = (
    T.BooleanType, T.IntegerType, T.LongType, T.DecimalType, T.StringType, T.BinaryType,
    T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType,
)

_JSON_OPTIONS = (
    "map('ignoreNullFields', 'false', "
    f'\'timestampFormat\', "{TIMESTAMP_FORMAT}", \'timestampNTZFormat\', "{TIMESTAMP_NTZ_FORMAT}")'
)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col(quote(name))


def by_position(df: DataFrame) -> DataFrame:
    """The same rows with columns named ``_0``, ``_1``, …"""
    return df.toDF(*[f"_{position}" for position in range(len(df.columns))])


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_holds_map(field.dataType) for field in dtype)
    return False


def order_maps(value: str, dtype: T.DataType, depth: int = 0) -> str:
    """Replace each map, at any depth, by its entries as an array sorted by key."""
    if not _holds_map(dtype):
        return value
    item = f"x{depth}"
    if isinstance(dtype, T.MapType):
        inner = order_maps(f"{item}.value", dtype.valueType, depth + 1)
        left, right = f"l{depth}", f"r{depth}"
        order = f"CASE WHEN {left}.key < {right}.key THEN -1 WHEN {left}.key > {right}.key THEN 1 ELSE 0 END"
        entries = f"array_sort(map_entries({value}), ({left}, {right}) -> {order})"
        return f"transform({entries}, {item} -> struct({item}.key AS key, {inner} AS value))"
    if isinstance(dtype, T.ArrayType):
        return f"transform({value}, {item} -> {order_maps(item, dtype.elementType, depth + 1)})"
    members = [
        f"{order_maps(f'{value}.{quote(f.name)}', f.dataType, depth)} AS {quote(f.name)}" for f in dtype
    ]
    return f"CASE WHEN {value} IS NOT NULL THEN struct({', '.join(members)}) END"


def text_form(value: str, dtype: T.DataType) -> str:
    """Text that is equal exactly where two values are equal; NULL stays NULL."""
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return f"to_json({order_maps(value, dtype)}, {_JSON_OPTIONS})"
    if isinstance(dtype, _FLOATING):
        printed = f"format_string('{FLOAT_FORMAT}', CAST({value} AS DOUBLE))"
        return f"CASE WHEN {value} IS NOT NULL THEN {printed} END"
    if isinstance(dtype, T.TimestampType):
        return f'date_format({value}, "{TIMESTAMP_FORMAT}")'
    return f"CAST({value} AS STRING)"


def canonical_rows(df: DataFrame) -> DataFrame:
    """Every column of a table as comparable text under its own name."""
    return by_position(df).selectExpr(
        *[
            f"{text_form(f'_{position}', field.dataType)} AS {quote(field.name)}"
            for position, field in enumerate(df.schema)
        ]
    )


def _zero_text(value: str) -> str:
    """Text for zeros only: the hash itself does not see the sign of a zero."""
    return f"CASE WHEN {value} = 0 THEN CAST({value} AS STRING) END"


def _array_parts(value: str, element: T.DataType) -> list[str]:
    """Length, then which places hold NULL or a zero (only if any does), then the elements."""
    if isinstance(element, _FLOATING):
        # False only if the array holds neither NULL nor zero: one cheap pass over the array.
        zero = f"CAST(0 AS {element.simpleString()})"
        marked = f"coalesce(array_contains({value}, {zero}), true)"
        mark = f"CASE WHEN x IS NULL THEN 'null' ELSE coalesce({_zero_text('x')}, '') END"
    else:
        marked = f"exists({value}, x -> x IS NULL)"
        mark = "CASE WHEN x IS NULL THEN 'null' ELSE '' END"
    marks = f"CASE WHEN {marked} THEN transform({value}, x -> {mark}) END"
    return [f"size({value})", marked, marks, value]


def _parts(value: str, dtype: T.DataType) -> tuple[list[str], list[str]]:
    """Values to flag if NULL, and hashable parts of one value in its own type."""
    if isinstance(dtype, _FLOATING):
        return [value], [value, _zero_text(value)]
    if isinstance(dtype, _SMALL_INTEGERS):
        return [value], [f"CAST({value} AS INT)"]
    if isinstance(dtype, _HASHED_AS_IS):
        return [value], [value]
    if isinstance(dtype, T.StructType):
        flagged, values = [value], []
        for member in dtype:
            inner_flagged, inner_values = _parts(f"{value}.{quote(member.name)}", member.dataType)
            flagged += inner_flagged
            values += inner_values
        return flagged, values
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, _HASHED_AS_IS + _FLOATING):
        return [value], _array_parts(value, dtype.elementType)
    return [value], [text_form(value, dtype)]


def hash_arguments(schema: T.StructType, as_text: Collection[int] = ()) -> list[str]:
    """Arguments for a row hash: NULL masks of fixed length first, then the values.

    The hash skips NULL arguments, so the masks are what tells ``(NULL, 1)`` from ``(1, NULL)``.
    ``as_text`` lists positions whose type differs on the other side of a comparison.
    """
    flagged: list[str] = []
    values: list[str] = []
    for position, field in enumerate(schema):
        value = f"_{position}"
        if position in as_text:
            flagged.append(value)
            values.append(text_form(value, field.dataType))
        else:
            inner_flagged, inner_values = _parts(value, field.dataType)
            flagged += inner_flagged
            values += inner_values
    return _masks(flagged) + values


def _masks(flagged: Sequence[str]) -> list[str]:
    return [
        " | ".join(
            f"CASE WHEN {value} IS NULL THEN {1 << bit}L ELSE 0L END"
            for bit, value in enumerate(flagged[start : start + _MASK_BITS])
        )
        for start in range(0, len(flagged), _MASK_BITS)
    ]
