"""Matches of patterns with their positions, by DataFrame functions only and in time linear in their number.

A position is the sum of all lengths before it. An array that grows by one element is copied whole, so sums are made
for blocks of matches, then for the blocks' totals. Each step is a projection of its own, so nothing is computed twice.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"
#: Matches whose lengths are summed together.
BLOCK = 64
#: Code points kept before and after a match.
BEFORE, AFTER = 32, 16


def _cut(text: Column, pattern: str, guard: str) -> Column:
    """gap and value: the pieces between leftmost non-overlapping matches, and these; null without the guard."""
    pieces = F.struct(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
    )
    return F.when(text.rlike(guard), pieces)


def _running(numbers: Column) -> Column:
    """0, and the sums of the first 1, 2, ... numbers."""
    start = F.array(F.lit(0))
    return F.aggregate(numbers, start, lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))


def with_spans(docs: DataFrame, text: str, patterns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The rows without their text, with an array of SPAN for each name of ``patterns``: pattern and guard.

    The guard is a pattern, cheaper to look for, that every text with a match of use has somewhere.
    """
    rest = [name for name in docs.columns if name != text]
    cut = docs.select(*rest, *[_cut(F.col(text), *patterns[name]).alias(name) for name in patterns])
    # a match and the piece before it, in code points; the last piece has no match behind it
    sizes = {
        f"{name}__sizes": F.when(
            F.size(f"{name}.value") > 0,
            F.zip_with(F.col(f"{name}.value"), F.slice(f"{name}.gap", 1, F.size(f"{name}.value")),
                       lambda value, gap: F.length(value) + F.length(gap)),
        )
        for name in patterns
    }
    sized = cut.withColumns(sizes)

    def blocks(name: str) -> Column:
        sizes = F.col(f"{name}__sizes")
        numbers = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))
        return F.transform(numbers, lambda b: _running(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))

    summed = sized.withColumns({f"{name}__blocks": blocks(name) for name in patterns})
    offsets = summed.withColumns(
        {
            f"{name}__offsets": _running(F.transform(f"{name}__blocks", lambda sums: F.element_at(sums, -1)))
            for name in patterns
        }
    )

    def spans(name: str) -> Column:
        sums = F.col(f"{name}__blocks")
        before = F.flatten(
            F.zip_with(
                sums, F.slice(f"{name}__offsets", 1, F.size(sums)),
                lambda block, offset: F.transform(F.slice(block, 1, F.size(block) - 1), lambda at: at + offset),
            )
        )
        gaps, values = F.col(f"{name}.gap"), F.col(f"{name}.value")
        n = F.size(values)
        parts = F.arrays_zip(
            before.alias("at"), F.slice(gaps, 1, n).alias("gap"), values.alias("value"), F.slice(gaps, 2, n).alias("next")
        )

        def span(part: Column) -> Column:
            start = part["at"] + F.length(part["gap"])
            return F.struct(
                start.alias("start"), (start + F.length(part["value"])).alias("end"), part["value"].alias("value"),
                F.right(part["gap"], F.lit(BEFORE)).alias("before"), F.left(part["next"], F.lit(AFTER)).alias("after"),
            )

        none = F.array().cast(f"array<{SPAN}>")
        return F.when(F.col(f"{name}__sizes").isNotNull(), F.transform(parts, span)).otherwise(none).alias(name)

    return offsets.select(*rest, *[spans(name) for name in patterns])
