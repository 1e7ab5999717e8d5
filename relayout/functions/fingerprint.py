"""Order-independent fingerprints: row count plus exact sums of two independent row hashes."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relayout.functions.canonical import by_position, hash_arguments, quote

_SALT = "relayout-second-hash"
_HASHES = ("hash_a", "hash_b")
MEASURES = ("row_count", *_HASHES)

# A 64-bit hash is summed as four 16-bit pieces in long buffers, which is several times
# cheaper than a 38-digit decimal per row and exact up to 2**47 rows in one group.
_PIECE_BITS = 16
_PIECES = 64 // _PIECE_BITS


def row_hashes(
    df: DataFrame, keys: Sequence[str] = (), as_text: Collection[int] = (), unhashed: int = 0
) -> DataFrame:
    """The key columns and both hashes of every row; the last ``unhashed`` columns may be keys, but are not hashed."""
    hashed = T.StructType(df.schema.fields[: len(df.columns) - unhashed])
    arguments = ", ".join(hash_arguments(hashed, as_text))
    return by_position(df).selectExpr(
        *[f"_{df.columns.index(key)} AS {quote(key)}" for key in keys],
        f"xxhash64({arguments}) AS hash_a",
        f"xxhash64('{_SALT}', {arguments}) AS hash_b",
    )


def _piece(name: str, index: int) -> str:
    """Piece ``index``, counted from the low end; the top piece keeps the sign."""
    shifted = f"shiftright({name}, {index * _PIECE_BITS})"
    return shifted if index == _PIECES - 1 else f"{shifted} & {(1 << _PIECE_BITS) - 1}"


def _joined(name: str) -> str:
    """The exact sum of a hash, put together from the sums of its pieces."""
    weighted = [
        f"CAST({name}_{index} AS DECIMAL(20,0)) * CAST({1 << (index * _PIECE_BITS)}L AS DECIMAL(15,0))"
        for index in range(_PIECES)
    ]
    return f"CAST({' + '.join(weighted)} AS DECIMAL(38,0)) AS {name}"


def _measures() -> list[Column]:
    sums = [f"sum({_piece(name, index)}) AS {name}_{index}" for name in _HASHES for index in range(_PIECES)]
    return [F.expr(measure) for measure in ("count(1) AS row_count", *sums)]


def fingerprint(
    df: DataFrame, keys: Sequence[str] = (), as_text: Collection[int] = (), unhashed: int = 0
) -> DataFrame:
    """Row count and hash sums, for the whole table or for each value of ``keys``.

    An empty table gives zero rows and NULL sums.
    """
    key_names = [quote(key) for key in keys]
    return (
        row_hashes(df, keys, as_text, unhashed)
        .groupBy(*key_names)
        .agg(*_measures())
        .selectExpr(*key_names, "row_count", *map(_joined, _HASHES))
    )


def observed(df: DataFrame, observation: Observation, as_text: Collection[int] = ()) -> DataFrame:
    """The rows of df; whatever job reads them leaves their fingerprint in the observation."""
    arguments = ", ".join(hash_arguments(df.schema, as_text))
    named = by_position(df)
    hashed = named.selectExpr(
        "*", f"xxhash64({arguments}) AS hash_a", f"xxhash64('{_SALT}', {arguments}) AS hash_b"
    ).observe(observation, *_measures())
    return hashed.select(*named.columns).toDF(*df.columns)


def observed_fingerprint(spark: SparkSession, observation: Observation) -> DataFrame:
    """``fingerprint`` of what a finished job has read, from its observation."""
    kinds = ", ".join(f"{name}_{index} bigint" for name in _HASHES for index in range(_PIECES))
    found = observation.get
    names = ["row_count", *[f"{name}_{index}" for name in _HASHES for index in range(_PIECES)]]
    row = spark.createDataFrame([tuple(found[name] for name in names)], f"row_count bigint, {kinds}")
    return row.selectExpr("row_count", *map(_joined, _HASHES))


def total_fingerprint(per_key: DataFrame) -> DataFrame:
    """Fingerprint of the whole table from the fingerprints of its parts; reads no data again."""
    sums = [F.expr(f"CAST(sum({name}) AS DECIMAL(38,0)) AS {name}") for name in _HASHES]
    return per_key.agg(F.expr("coalesce(sum(row_count), 0L) AS row_count"), *sums)
