"""Names of tables and the names derived from them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of derived tables, and what a plain identifier looks like.
BACKUP_SUFFIX = "_BACKUP_"
STAGING_SUFFIX = "__ice"
LEGACY_SUFFIX = "__legacy"
FAILED_INFIX = "__failed_"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"

# Our own, for compaction: the folder beside a table's and its packed copy, and what it replaced.
COMPACTED_SUFFIX = "__compact"
UNCOMPACTED_SUFFIX = "__precompact"

_TABLE = re.compile(rf"({IDENTIFIER})\.({IDENTIFIER})")


def matches_fully(value: Column, pattern: str) -> Column:
    """Whole-text match; ``$`` alone would accept a trailing newline."""
    return value.rlike(rf"\A(?:{pattern})\z")


def is_identifier(value: Column) -> Column:
    return matches_fully(value, IDENTIFIER)


def is_table_name(value: Column) -> Column:
    """Exactly two plain identifiers joined by a dot."""
    return matches_fully(value, rf"{IDENTIFIER}\.{IDENTIFIER}")


def quoted(name: str) -> str:
    """A checked identifier, quoted for SQL."""
    if not re.fullmatch(IDENTIFIER, name):
        raise ValueError(f"not a plain identifier: {name!r}")
    return f"`{name}`"


def quoted_table(name: str) -> str:
    """A checked ``db.table`` name, quoted for SQL."""
    found = _TABLE.fullmatch(name)
    if not found:
        raise ValueError(f"not a plain database.table name: {name!r}")
    return ".".join(map(quoted, found.groups()))


def run_suffix(run_id: Column) -> Column:
    return F.replace(F.lower(run_id), F.lit("-"), F.lit("_"))


def derived_names(table: Column, run_id: Column, sandbox: Column) -> dict[str, Column]:
    """Every name a migration may give to a table, its copies and its backups."""
    flat = F.replace(table, F.lit("."), F.lit("__"))
    return {
        "staging": F.concat(table, F.lit(STAGING_SUFFIX)),
        "legacy": F.concat(table, F.lit(LEGACY_SUFFIX)),
        "backup": F.concat(table, F.lit(BACKUP_SUFFIX)),
        "failed": F.concat(table, F.lit(FAILED_INFIX), run_suffix(run_id)),
        "sandbox": F.concat(sandbox, F.lit("."), flat, F.lit("__"), run_suffix(run_id)),
    }


def failed_name(table: str, run_id: str) -> str:
    return f"{table}{FAILED_INFIX}{run_id.lower().replace('-', '_')}"


def sandbox_name(sandbox: str, table: str, run_id: str) -> str:
    quoted_table(table)
    return f"{sandbox}.{table.replace('.', '__')}__{run_id.lower().replace('-', '_')}"
