"""Which rows differ: from partitions that differ to ranges of the row hash that differ, to rows.

Two pruned passes over the partitions that differ, and no join of the tables. The first counts and sums row hashes by range of
the hash, as many ranges as leave some hundred rows in each; rows that both sides have fall into the same ranges, so only a
range with a row too few or too many differs. The second reads the rows of those ranges alone and compares how many copies
of each row the sides have. What is shuffled is a line per range and task, then the rows of ranges that differ.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayout.functions.canonical import column
from relayout.functions.fingerprint import row_hashes
from relayout.operators.compare import compare_contents, mismatches, schema_details

#: Rows that a range of the hash holds, on average, and the most bits that a range is named by.
RANGE_ROWS, RANGE_BITS = 256, 24
_SIDES = {"source": 1, "target": -1}


def differing_rows(source: DataFrame, target: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The rows that one side has more copies of: ``side``, ``copies`` (how many more) and all columns.

    Both sides must have the same columns and types. NULL keys are a partition like others; equal rows count as often as
    they occur. Rows are told apart by both hashes, 128 bits.
    """
    if found := schema_details(source.schema, target.schema):
        raise ValueError(f"rows of different schemas are not compared: {found}")
    names = [f"__{i}" for i in range(len(source.columns))]
    places = [source.columns.index(key) for key in keys]
    sides = {"source": source.toDF(*names), "target": target.toDF(*names)}
    if keys:
        parts = mismatches(compare_contents(source, target, keys))
        differing = parts.select(*[column(key).alias(f"__k{i}") for i, key in enumerate(keys)])
        largest = parts.agg(F.max(F.greatest("source_row_count", "target_row_count"))).first()[0] or 0
        same = [F.col(names[place]).eqNullSafe(F.col(f"__k{i}")) for i, place in enumerate(places)]
        sides = {side: df.join(differing, same, "left_semi") for side, df in sides.items()}
    else:
        largest = max(df.count() for df in sides.values())
    bits = min(RANGE_BITS, max(0, math.ceil(math.log2(largest / RANGE_ROWS)))) if largest > RANGE_ROWS else 0
    marked = {side: _marked(df, bits, [names[place] for place in places]) for side, df in sides.items()}
    by = ["__range", *[f"__p{i}" for i in range(len(places))]]
    lines = [
        df.groupBy(*by).agg(
            *[F.sum(F.lit(sign) * part).alias(name) for name, part in _pieces().items()]
        )
        for (_, df), sign in zip(marked.items(), _SIDES.values())
    ]
    apart = lines[0].unionByName(lines[1]).groupBy(*by).agg(*[F.sum(name).alias(name) for name in _pieces()])
    ranges = apart.where(" OR ".join(f"{name} <> 0" for name in _pieces())).select(
        *[F.col(name).alias(f"__of{i}") for i, name in enumerate(by)]
    )
    inside = [F.col(name).eqNullSafe(F.col(f"__of{i}")) for i, name in enumerate(by)]
    rows = [
        df.join(ranges, inside, "left_semi").select("hash_a", "hash_b", F.lit(sign).alias("n"), F.struct(*names).alias("row"))
        for df, sign in zip(marked.values(), _SIDES.values())
    ]
    counted = rows[0].unionByName(rows[1]).groupBy("hash_a", "hash_b")
    surplus = counted.agg(F.sum("n").alias("n"), F.any_value("row").alias("row")).where("n <> 0")
    return surplus.select(
        F.when(F.col("n") > 0, "source").otherwise("target").alias("side"), F.abs("n").alias("copies"),
        *[F.col(f"row.{name}").alias(given) for name, given in zip(names, source.columns)],
    )


def _marked(df: DataFrame, bits: int, keys: list[str]) -> DataFrame:
    """The rows with both hashes, the range of the first one, and their partition's values."""
    hashed = row_hashes(df, df.columns)
    place = F.shiftrightunsigned("hash_a", 64 - bits) if bits else F.lit(0).cast("long")
    return hashed.select("*", place.alias("__range"), *[F.col(key).alias(f"__p{i}") for i, key in enumerate(keys)])


def _pieces() -> dict[str, Column]:
    """Number of rows, and their hashes in pieces whose sums stay exact."""
    found = {"__n": F.lit(1).cast("long")}
    for name in ("hash_a", "hash_b"):
        found[f"__{name}_low"] = F.col(name).bitwiseAND(F.lit(0xFFFFFFFF))
        found[f"__{name}_high"] = F.shiftright(name, 32)
    return found
