"""Carry out plan rows: dry runs in a sandbox, governed cutovers, compaction and rollback."""

from __future__ import annotations

import time
import uuid
from collections.abc import Collection, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from relayout.functions import naming as N
from relayout.functions.canonical import column
from relayout.functions.fingerprint import fingerprint, observed_fingerprint
from relayout.functions.layout import parse_casts, parse_partition_spec
from relayout.operators import gates as G
from relayout.operators import publish as P
from relayout.operators.compare import WIDE_TABLES, validate
from relayout.operators.known import Store, current_files, digest, knowable
from relayout.operators.rewrite import (
    TARGET_FILE_BYTES,
    pack_partitions,
    packable,
    packed_copy,
    rewrite_table,
    rows_out_of_sight,
    scattered,
)
from relayout.session import scratch_folder, sql_settings
from relayout.sources.catalog import describe_table, partition_places
from relayout.sources.evidence import EvidenceFile
from relayout.sources.manifest import files_by_partition, list_files, relative_path
from relayout.sources.store import default_filesystem

RESULT_SCHEMA = (
    "run_id string, table string, strategy string, mode string, status string, "
    "source_rows bigint, target_rows bigint, seconds double, state string, note string"
)


def new_run_id() -> str:
    return f"run-{uuid.uuid4().hex[:12]}"


@dataclass(frozen=True)
class RunOptions:
    """How to run a plan. ``journal`` and ``validations`` are folders of evidence.

    ``default_filesystem``: where target locations must lie; blank takes the session's. ``fingerprints``: a folder
    where fingerprints of files are kept from run to run; blank keeps them for the run.
    """

    journal: str
    validations: str
    run_id: str
    execute: bool = False
    auto_rollback: bool = False
    stop_on_error: bool = False
    require_ticket: bool = True
    sandbox: str = "relayout_sandbox"
    max_partitions: int | None = None
    default_filesystem: str = ""
    fmt: str = "parquet"
    target_file_bytes: int = TARGET_FILE_BYTES
    fingerprints: str = ""


def same_columns(source: DataFrame, target: DataFrame, derived: Sequence[str]) -> DataFrame:
    """The target without derived columns and in the source's order, where it has exactly its columns.

    File tables store partition columns last; that is no difference in content.
    """
    kept = [name for name in target.columns if name not in derived]
    if sorted(map(str.lower, kept)) != sorted(map(str.lower, source.columns)):
        return target
    return target.select(*map(column, source.columns))


def validate_tables(
    spark: SparkSession,
    source: str,
    target: str,
    partitions: Sequence[str] = (),
    max_partitions: int | None = None,
    derived: Sequence[str] | None = None,
    validations: str = "",
    run_id: str = "",
    store: Store | None = None,
    totals: DataFrame | None = None,
) -> dict:
    """The verdict on two tables by name; ``derived`` allows a rewrite's column order and additions.

    With ``validations``, a folder of evidence, the verdict is recorded there under the run. With a ``store``, only files
    that it does not know are read. ``totals`` is a fingerprint of the source from elsewhere, which is believed as far as
    it agrees with the target: sums observed by a job whose tasks ran twice may be too high, so the source
    is read before anything is found to differ. Partitions are not compared by totals.
    """
    left, right = spark.table(source), spark.table(target)
    if derived is not None:
        right = same_columns(left, right, derived)
    known = {name for name in (source, target) if store and knowable(spark, name)}

    def fingerprints(df: DataFrame, keys: Sequence[str], as_text: Collection[int]) -> DataFrame:
        name = source if df is left else target
        if df is left and totals is not None and not keys:
            return totals
        return store.fingerprints(name, df, keys, as_text) if name in known else fingerprint(df, keys, as_text)

    with sql_settings(spark, WIDE_TABLES):
        verdict = validate(left, right, partitions, max_partitions, fingerprints).first().asDict()
        if not verdict["ok"] and totals is not None and not partitions:
            totals = None
            verdict = validate(left, right, partitions, max_partitions, fingerprints).first().asDict()
    if validations:
        EvidenceFile(spark, validations, run_id or new_run_id()).validation(source, target, verdict)
    return verdict


class _TableRun:
    """One plan row on its way through a run."""

    def __init__(self, spark: SparkSession, row: dict, options: RunOptions):
        self.spark, self.row, self.options = spark, row, options
        self.table = row["table"]
        # a file of its own for each table's steps: no other writer touches it
        self.journal = EvidenceFile(spark, options.journal, options.run_id)
        self.validations = EvidenceFile(spark, options.validations, options.run_id)
        self.store = Store(spark, options.fingerprints or f"{scratch_folder(spark)}/fingerprints")
        self.copied: tuple[tuple, DataFrame] | None = None
        self.partitions = [name for name in row["partitions"].split(";") if name]
        self.file_format = row["format"] if row["format"] in ("parquet", "orc") else ""
        self.result = {
            "run_id": options.run_id,
            "table": self.table,
            "strategy": row["strategy"].strip().lower(),
            "mode": "execute" if options.execute else "dry-run",
        }

    def record(self, state: str, **extras: object) -> None:
        self.journal.event(self.table, state, **extras)

    def finish(self, status: str, state: str, note: str, **extras: object) -> None:
        self.result.update(status=status, state=state, note=note)
        self.record(state, **extras)

    def check(
        self, source: str, target: str, derived: Sequence[str] = (), totals: DataFrame | None = None
    ) -> dict:
        """Validate, leave evidence, and fail where both sides only look empty."""
        verdict = validate_tables(
            self.spark, source, target, self.partitions, self.options.max_partitions, derived,
            store=self.store, totals=totals,
        )
        if verdict["ok"] and not verdict["target_rows"]:
            if rows_out_of_sight(self.spark, source, self.file_format or self.options.fmt):
                verdict["ok"] = False
                verdict["details"] = [*verdict["details"], f"no rows read, but {source} has data files"]
        self.validations.validation(source, target, verdict)
        self.result.update(
            source_rows=verdict["source_rows"], target_rows=verdict["target_rows"]
        )
        return verdict

    def rewrite(self, target: str, location: str) -> list[str]:
        """Copy the table; what the copy read is the source's fingerprint, as long as its files stay as they are."""
        size_gb = float(self.row.get("size_gb") or 0)
        observation = Observation()
        files = digest(current_files(self.spark, self.table)) if knowable(self.spark, self.table) else None
        derived = rewrite_table(
            self.spark, self.table, target, self.row["spec"], self.row["casts"], location,
            self.options.fmt, int(size_gb * 1024**3), self.options.target_file_bytes,
            small_files=self.row["compact"] != "N", observation=observation,
        )
        if files is not None:
            self.copied = files, observed_fingerprint(self.spark, observation)
        return derived

    def totals(self, table: str) -> DataFrame | None:
        """The fingerprint of what was copied, if the table still has exactly the files that were there before."""
        if self.copied and digest(current_files(self.spark, table)) == self.copied[0]:
            return self.copied[1]
        return None

    def dry_run(self) -> None:
        target = N.sandbox_name(self.options.sandbox, self.table, self.options.run_id)
        P.create_namespace(self.spark, self.options.sandbox)
        derived: list[str] = []
        if self.result["strategy"] == "migrate":
            P.share_files(self.spark, self.table, target, self.file_format)
        else:
            derived = self.rewrite(target, location="")
        self.record("SANDBOX_CREATED", target=target)
        verdict = self.check(self.table, target, derived, self.totals(self.table))
        note = "; ".join(verdict["details"]) or f"the sandbox copy is {target}"
        if verdict["ok"]:
            self.finish("DRY_RUN_VALIDATED", "SANDBOX_VALIDATED", note, target=target)
        else:
            self.finish("VALIDATION_FAILED", "SANDBOX_VALIDATION_FAILED", note, target=target)

    def execute_in_place(self) -> None:
        backup = f"{self.table}{N.BACKUP_SUFFIX}"
        P.convert_in_place(self.spark, self.table, backup, self.file_format, self.record)
        verdict = self.check(backup, self.table)
        details = "; ".join(verdict["details"])
        if verdict["ok"]:
            note = f"{backup} has the same files: keep it, and delete none of them"
            self.finish("CUTOVER_VALIDATED", "CUTOVER_VALIDATED", note, backup=backup)
        elif self.options.auto_rollback:
            P.undo_in_place(self.spark, self.table, backup, self.record)
            self.finish("AUTO_ROLLED_BACK", "AUTO_ROLLED_BACK", details, reason=details)
        else:
            note = f"{details}; the old entry is {backup}"
            self.finish("VALIDATION_FAILED", "ROLLBACK_REQUIRED", note, backup=backup)

    def execute_rewrite(self) -> None:
        staging, legacy = f"{self.table}{N.STAGING_SUFFIX}", f"{self.table}{N.LEGACY_SUFFIX}"
        derived = self.rewrite(staging, self.row["target_location"].strip())
        self.record("CTAS_CREATED", target=staging)
        verdict = self.check(self.table, staging, derived, self.totals(self.table))
        if not verdict["ok"]:
            note = f"{'; '.join(verdict['details'])}; the copy is kept as {staging}"
            self.finish("VALIDATION_FAILED", "CTAS_VALIDATION_FAILED", note, target=staging)
            return
        self.record("CTAS_VALIDATED", target=staging)
        P.swap(self.spark, self.table, staging, legacy, self.record)
        # Validated again after the swap: a write that slipped past the freeze shows up here.
        # Files that were read before and did not change are not read again.
        verdict = self.check(legacy, self.table, derived, self.totals(legacy))
        details = "; ".join(verdict["details"])
        if verdict["ok"]:
            note = f"keep {legacy} for as long as a way back is wanted"
            self.finish("CUTOVER_VALIDATED", "CUTOVER_VALIDATED", note, legacy=legacy)
        elif self.options.auto_rollback:
            failed = N.failed_name(self.table, self.options.run_id)
            P.undo_swap(self.spark, self.table, legacy, failed, self.record)
            note = f"{details}; the replaced table is kept as {failed}"
            self.finish("AUTO_ROLLED_BACK", "AUTO_ROLLED_BACK", note, failed_target=failed)
        else:
            note = f"{details}; the old table is {legacy}"
            self.finish("VALIDATION_FAILED", "ROLLBACK_REQUIRED", note, legacy=legacy)

    def run(self) -> None:
        N.quoted_table(self.table)
        started = time.monotonic()
        self.record("STARTED", strategy=self.result["strategy"], mode=self.result["mode"])
        route = self.row["route"]
        if route == "SKIPPED":
            self.result.update(status="SKIPPED", state="SKIPPED", note=self.row["note"])
            return
        if route == G.MANUAL_STATUS:
            self.finish(G.MANUAL_STATUS, G.MANUAL_STATUS, self.row["note"])
            return
        if route not in ("migrate", "ctas"):
            raise ValueError(route)
        if self.row["refusal"]:
            raise ValueError(self.row["refusal"])
        if not self.options.execute:
            self.dry_run()
        elif route == "migrate":
            self.execute_in_place()
        else:
            self.execute_rewrite()
        self.result["seconds"] = round(time.monotonic() - started, 1)


def _checked(plan: DataFrame, options: RunOptions, filesystem: str) -> DataFrame:
    """Add route, first refusal, casts and partition spec to every plan row, in one job."""
    casts = parse_casts(F.coalesce("cast_columns", F.lit("")))
    spec = parse_partition_spec(F.coalesce("target_partition_spec", F.lit("")))
    location = F.trim(F.coalesce("target_location", F.lit("")))
    refusals = [
        spec["error"],
        casts["error"],
        G.location_refusal(location, options.default_filesystem or filesystem),
    ]
    if options.execute:
        refusals = [G.execute_refusal(options.require_ticket), *refusals, G.inplace_refusal()]
    return plan.withColumns(
        {
            "route": G.route(),
            "refusal": F.coalesce(*refusals),
            "casts": F.map_from_entries(casts["casts"]),
            "spec": spec["expressions"],
        }
    )


def select_plan(spark: SparkSession, plan: DataFrame, only: str = "") -> DataFrame:
    """The plan rows of a comma-separated list of tables; all rows if the list is empty."""
    wanted = sorted({name.strip() for name in only.split(",")} - {""})
    if not wanted:
        return plan
    # a filter, not a join: it keeps the order of the plan, in which the rows will run
    names = spark.createDataFrame([(name,) for name in wanted], "table string")
    missing = [row["table"] for row in G.missing_rows(plan, names).collect()]
    if missing:
        raise ValueError(f"the plan has no rows for: {missing}")
    return plan.where(F.col("table").isin(*wanted))


def run_plan(spark: SparkSession, plan: DataFrame, options: RunOptions) -> DataFrame:
    """Run the rows one after another and return one result row per table.

    A table that fails is recorded and the run goes on, unless it should stop at the first error.
    The loop is on the driver since every step changes the catalogue; each step is a Spark job.
    """
    selected = G.approved(plan) if options.execute else plan
    results = []
    for row in _checked(selected.na.fill(""), options, default_filesystem(spark)).toLocalIterator():
        step = _TableRun(spark, row.asDict(), options)
        try:
            step.run()
        except Exception as failure:
            step.finish("FAILED", "FAILED", str(failure), error=str(failure))
        results.append(step.result)
        if options.stop_on_error and step.result["status"] == "FAILED":
            break
    if options.execute and not results:
        raise ValueError(G.NO_APPROVED_ROWS)
    return spark.createDataFrame(results, RESULT_SCHEMA)


def rollback(spark: SparkSession, table: str, strategy: str, journal: str, run_id: str = "") -> str:
    """Put back the table a cutover replaced; returns what was done."""
    record = partial(EvidenceFile(spark, journal, run_id or new_run_id()).event, table)
    if strategy == "migrate":
        backup = f"{table}{N.BACKUP_SUFFIX}"
        P.undo_in_place(spark, table, backup, record)
        note = f"{table} is {backup} again"
    elif strategy == "ctas":
        legacy, failed = f"{table}{N.LEGACY_SUFFIX}", N.failed_name(table, new_run_id())
        P.undo_swap(spark, table, legacy, failed, record)
        note = f"{table} is {legacy} again; the replaced table is kept as {failed}"
    else:
        raise ValueError(f"no such strategy: {strategy}")
    record("OPERATOR_ROLLBACK_COMPLETE", note=note)
    return note


def compact_table(
    spark: SparkSession,
    table: str,
    target_file_bytes: int = TARGET_FILE_BYTES,
    max_partitions: int | None = None,
    record: P.Record = P.no_record,
) -> dict:
    """Pack the files of a table's scattered partitions, prove the new ones equal, and switch to them.

    Which partitions are scattered is read from the file manifest, without a look at any row. Of a partitioned table only the catalogue's location of each packed partition changes; its other
    partitions, properties and comment are untouched. A table without partitions is swapped for a packed
    copy with the same properties and comment. Old files are kept for a way back; the journal says where.
    A run that stops half-way leaves every partition with either its old or its proved new files; ``recover`` then
    completes or undoes it. A run can be repeated, and finds nothing to do where files are good.
    """
    keys = packable(spark, table)["partitions"]
    chosen = scattered(files_by_partition(spark, table, keys), target_file_bytes).collect()
    size = sum(row["bytes"] for row in chosen)
    found = {"compacted": len(chosen), "bytes": size}
    if not chosen:
        record("NOTHING_TO_COMPACT")
        return {"ok": True, "details": [], **found}
    name = uuid.uuid4().hex[:12]
    if keys:
        parts = {row["partition"]: Row(**{key: row[key] for key in keys}) for row in chosen}
        return _compact_partitions(spark, table, parts, name, target_file_bytes, max_partitions, record) | found
    copy = f"{table}{N.COMPACTED_SUFFIX}_{name}"
    packed_copy(spark, table, copy, size, target_file_bytes)
    P.copied_properties(spark, table, copy)
    verdict = validate_tables(spark, table, copy)
    if not verdict["ok"]:
        raise RuntimeError(f"{'; '.join(verdict['details'])}; the packed copy is kept as {copy}")
    P.swap(spark, table, copy, f"{table}{N.UNCOMPACTED_SUFFIX}_{name}", record)
    return verdict | found


def _compact_partitions(
    spark: SparkSession, table: str, parts: dict[str, Row], name: str, target_file_bytes: int,
    max_partitions: int | None, record: P.Record,
) -> dict:
    described = describe_table(spark, table)
    keys = described["partitions"]
    folder = f"{described['location'].rstrip('/')}{N.COMPACTED_SUFFIX}/{name}"
    rows = list(parts.values())
    pack_partitions(spark, table, rows, folder, target_file_bytes)
    whole = spark.table(table)
    packed = spark.read.schema(whole.schema).format(described["provider"]).load(folder)
    listed = spark.createDataFrame(rows, whole.select(*map(column, keys)).schema)
    with sql_settings(spark, WIDE_TABLES):
        verdict = validate(
            _in_partitions(whole, listed, keys), packed.select(*map(column, whole.columns)), keys, max_partitions
        )
        verdict = verdict.first().asDict()
    if not verdict["ok"]:
        raise RuntimeError(f"{'; '.join(verdict['details'])}; packed files kept in {folder}")
    record("COMPACTION_VALIDATED", folder=folder, partitions=len(parts))
    # files without rows are not written again: such a partition stays where it is
    made = {row[0] for row in list_files(spark, [(table, "", folder)]).select(_folder_below()).distinct().collect()}
    now = {shown: place for shown, place in partition_places(spark, table) if shown in parts and shown in made}
    P.switch_partitions(spark, table, now, folder, record)
    return verdict


def _folder_below() -> Column:
    return F.regexp_replace(relative_path(), "/[^/]*$", "")


def _in_partitions(df: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the listed partitions; the scan is pruned to them at run time."""
    names = [f"__{i}" for i in range(len(keys))]
    other = listed.toDF(*names)
    same = [column(key).eqNullSafe(F.col(name)) for key, name in zip(keys, names)]
    return df.join(other, same, "left_semi")


def optimize(
    spark: SparkSession,
    plan: DataFrame,
    journal: str,
    run_id: str = "",
    target_file_bytes: int = TARGET_FILE_BYTES,
    max_partitions: int | None = None,
) -> int:
    """Compact the approved rows marked for it; returns the number of failures."""
    run_id = run_id or new_run_id()
    failures, seen = 0, 0
    for row in G.to_compact(plan).select("table").toLocalIterator():
        seen += 1
        table = row["table"]
        record = partial(EvidenceFile(spark, journal, run_id).event, table)
        try:
            compact_table(spark, table, target_file_bytes, max_partitions, record)
        except Exception as failure:
            failures += 1
            record("OPTIMIZE_FAILED", error=str(failure))
        else:
            record("OPTIMIZE_COMPLETE")
    if not seen:
        raise ValueError(G.NO_COMPACT_ROWS)
    return failures
