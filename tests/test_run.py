"""Publication, plan runs and rollback, with failures put in on purpose."""

import pytest
from pyspark.sql import functions as F

from relayout.operators import publish as P
from relayout.operators.classify import plan_fields
from relayout.plans import migrate as M
from relayout.sources.catalog import table_exists
from relayout.sources.evidence import latest_state, read_journal, read_validations


@pytest.fixture
def options(tmp_path, database, spark):
    yield M.RunOptions(
        journal=f"{tmp_path}/journal",
        validations=f"{tmp_path}/validations",
        run_id="RUN-1",
        execute=True,
        sandbox=f"{database}_sandbox",
    )
    spark.sql(f"DROP DATABASE IF EXISTS {database}_sandbox CASCADE")


def fill(spark, table, **writer):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    target = rows.write.option("path", writer["path"]) if "path" in writer else rows.write
    if "by" in writer:
        target = target.partitionBy(writer["by"])
    target.saveAsTable(table)


def plan(spark, *rows):
    base = {
        "approved": "Y", "writer_freeze_ticket": "CHG1", "schema_compatible": "Y", "format": "parquet",
        "target_format_version": "2", "note": "n", "source_type": "MANAGED", "strategy": "ctas",
    }
    full = [base | row for row in rows]
    return plan_fields(
        spark.createDataFrame(full, ", ".join(f"{n} string" for n in sorted({k for r in full for k in r})))
    )


def run(spark, options, *rows, **changes):
    options = M.RunOptions(**{**options.__dict__, **changes})
    return {r["table"].split(".")[1]: r for r in M.run_plan(spark, plan(spark, *rows), options).collect()}


def states(spark, options):
    journal = read_journal(spark, options.journal)
    return [r["state"] for r in journal.orderBy("seq").collect()]


def names(spark, database):
    return sorted(t["tableName"] for t in spark.sql(f"SHOW TABLES IN {database}").collect() if not t["isTemporary"])


def test_swap_and_back(spark, database):
    t = f"{database}.t"
    fill(spark, t, by="k")
    fill(spark, f"{t}__ice")
    seen = []
    P.swap(spark, t, f"{t}__ice", f"{t}__legacy", lambda state, **extras: seen.append(state))
    assert seen == ["MOVES_INTENDED", "SOURCE_RENAMED", "TARGET_RENAMED"]
    assert names(spark, database) == ["t", "t__legacy"]
    assert spark.table(f"{t}__legacy").count() == 100
    fill(spark, f"{t}__ice")
    with pytest.raises(RuntimeError, match="earlier legacy table"):
        P.swap(spark, t, f"{t}__ice", f"{t}__legacy")
    P.undo_swap(spark, t, f"{t}__legacy", f"{t}__failed_x")
    assert names(spark, database) == ["t", "t__failed_x", "t__ice"]
    with pytest.raises(RuntimeError, match="must both exist"):
        P.undo_swap(spark, t, f"{t}__legacy", f"{t}__failed_y")


def test_a_swap_with_nothing_changes_nothing(spark, database):
    t, seen = f"{database}.t", []
    fill(spark, t)
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        P.swap(spark, t, f"{t}__ice", f"{t}__legacy", lambda state, **extras: seen.append(state))
    assert names(spark, database) == ["t"] and spark.table(t).count() == 100
    assert seen == []


STEPS = ["follow", "journal 1", "second rename", "second follow", "journal 2"]


def fails_at(monkeypatch, step, seen):
    """Make one step of a cutover fail; returns the journal's function."""
    follow, rename, counts = P.follow_rename, P.rename, {"follow": 0, "rename": 0, "journal": 0}

    def check(kind, nth, name):
        counts[kind] += 1
        if step == name and counts[kind] == nth:
            raise RuntimeError(f"no {name}")

    def following(*args):
        check("follow", 1, "follow")
        if step == "second follow" and counts["follow"] == 2:
            raise RuntimeError("no second follow")
        follow(*args)

    def renaming(*args):
        check("rename", 2, "second rename")
        rename(*args)

    def record(state, **extras):
        if state.endswith("_INTENDED"):
            return
        check("journal", 1, "journal 1")
        if step == "journal 2" and counts["journal"] == 2:
            raise RuntimeError("no journal 2")
        seen.append(state)

    monkeypatch.setattr(P, "follow_rename", following)
    monkeypatch.setattr(P, "rename", renaming)
    return record


@pytest.mark.parametrize("step", STEPS)
def test_a_swap_that_fails_anywhere_leaves_both_names(spark, database, monkeypatch, step):
    t, seen = f"{database}.t", []
    fill(spark, t, by="k")
    spark.range(7).withColumn("k", F.lit(1)).write.partitionBy("k").saveAsTable(f"{t}__ice")
    record = fails_at(monkeypatch, step, seen)
    with pytest.raises(RuntimeError, match=f"no {step}"):
        P.swap(spark, t, f"{t}__ice", f"{t}__legacy", record)
    monkeypatch.undo()
    assert names(spark, database) == ["t", "t__ice"]
    assert spark.table(t).count() == 100 and spark.table(f"{t}__ice").count() == 7
    if step != "follow":  # nothing was renamed then
        assert seen[-1] == "CUTOVER_AUTO_ROLLED_BACK"


@pytest.mark.parametrize("step", ["follow", "second rename", "second follow"])
def test_an_undo_that_fails_anywhere_leaves_both_names(spark, database, monkeypatch, step):
    t = f"{database}.t"
    fill(spark, t, by="k")
    fill(spark, f"{t}__legacy", by="k")
    fails_at(monkeypatch, step, [])
    with pytest.raises(RuntimeError, match=f"no {step}"):
        P.undo_swap(spark, t, f"{t}__legacy", f"{t}__failed_x")
    monkeypatch.undo()
    assert names(spark, database) == ["t", "t__legacy"]
    assert spark.table(t).count() == spark.table(f"{t}__legacy").count() == 100


@pytest.mark.parametrize("step", ["follow", "journal 1"])
def test_a_conversion_that_fails_anywhere_leaves_the_name(spark, database, tmp_path, monkeypatch, step):
    t, seen = f"{database}.t", []
    fill(spark, t, path=f"{tmp_path}/t", by="k")
    record = fails_at(monkeypatch, step, seen)
    with pytest.raises(RuntimeError, match=f"no {step}"):
        P.convert_in_place(spark, t, f"{t}_BACKUP_", record=record)
    monkeypatch.undo()
    assert names(spark, database) == ["t"] and spark.table(t).count() == 100


def test_the_legacy_table_is_not_repaired(spark, database):
    """A folder nobody registered stays unregistered, a registered one without files stays registered."""
    t = f"{database}.t"
    fill(spark, t, by="k")
    spark.sql(f"ALTER TABLE {t} ADD PARTITION (k = 77)")
    spark.sql(f"ALTER TABLE {t} DROP PARTITION (k = 2)")
    location = spark.sql(f"DESCRIBE EXTENDED {t}").where("col_name = 'Location'").first()["data_type"]
    spark.range(3).write.parquet(f"{location}/k=99")
    shown = sorted(r[0] for r in spark.sql(f"SHOW PARTITIONS {t}").collect())
    count = spark.table(t).count()
    fill(spark, f"{t}__ice")
    P.swap(spark, t, f"{t}__ice", f"{t}__legacy")
    assert sorted(r[0] for r in spark.sql(f"SHOW PARTITIONS {t}__legacy").collect()) == shown == ["k=0", "k=1", "k=77"]
    assert spark.table(f"{t}__legacy").count() == count


def test_conversion_keeps_partitions_elsewhere_and_properties(spark, database, tmp_path):
    t = f"{database}.t"
    spark.sql(
        f"CREATE TABLE {t} (id BIGINT, k STRING) USING parquet PARTITIONED BY (k) LOCATION '{tmp_path}/t'"
        " COMMENT 'what it is' TBLPROPERTIES ('owner_team' = 'x''y')"
    )
    spark.range(4).withColumn("k", F.lit("a")).write.insertInto(t)
    spark.range(6).write.parquet(f"{tmp_path}/elsewhere")
    spark.sql(f"ALTER TABLE {t} ADD PARTITION (k = 'b/c') LOCATION '{tmp_path}/elsewhere'")
    P.share_files(spark, t, f"{t}_sandbox")
    P.convert_in_place(spark, t, f"{t}_BACKUP_")
    for name in (t, f"{t}_sandbox", f"{t}_BACKUP_"):
        assert {r["k"]: r["count"] for r in spark.table(name).groupBy("k").count().collect()} == {"a": 4, "b/c": 6}
        row = spark.sql(f"DESCRIBE EXTENDED {name}")
        assert row.where("col_name = 'Comment'").first()["data_type"] == "what it is"
        assert "owner_team=x'y" in row.where("col_name = 'Table Properties'").first()["data_type"]


def test_failed_undo_is_undone(spark, database, monkeypatch):
    t = f"{database}.t"
    fill(spark, t)
    fill(spark, f"{t}__legacy")
    rename = P.rename

    def failing(spark, old, new):
        if old.endswith("__legacy"):
            raise RuntimeError("no")
        rename(spark, old, new)

    monkeypatch.setattr(P, "rename", failing)
    with pytest.raises(RuntimeError, match="no"):
        P.undo_swap(spark, t, f"{t}__legacy", f"{t}__failed_x")
    assert names(spark, database) == ["t", "t__legacy"]


def test_in_place_and_back(spark, database, tmp_path):
    t = f"{database}.t"
    fill(spark, t, path=f"{tmp_path}/t", by="k")
    P.convert_in_place(spark, t, f"{t}_BACKUP_")
    assert spark.table(t).count() == spark.table(f"{t}_BACKUP_").count() == 100
    with pytest.raises(RuntimeError, match="earlier backup"):
        P.convert_in_place(spark, t, f"{t}_BACKUP_")
    P.undo_in_place(spark, t, f"{t}_BACKUP_")
    assert names(spark, database) == ["t"] and spark.table(t).count() == 100


def test_in_place_refuses_managed_tables(spark, database):
    fill(spark, f"{database}.t")
    fill(spark, f"{database}.b")
    with pytest.raises(RuntimeError, match="external table"):
        P.convert_in_place(spark, f"{database}.t", f"{database}.t_BACKUP_")
    with pytest.raises(RuntimeError, match="would delete its files"):
        P.undo_in_place(spark, f"{database}.t", f"{database}.b")
    assert spark.table(f"{database}.t").count() == 100


def test_failed_conversion_restores_the_name(spark, database, tmp_path, monkeypatch):
    t = f"{database}.t"
    fill(spark, t, path=f"{tmp_path}/t")

    def failing(*args):
        raise RuntimeError("no")

    monkeypatch.setattr(P, "share_files", failing)
    with pytest.raises(RuntimeError, match="no"):
        P.convert_in_place(spark, t, f"{t}_BACKUP_")
    assert names(spark, database) == ["t"]


def test_dry_run_changes_no_source(spark, database, options, tmp_path):
    fill(spark, f"{database}.m")
    fill(spark, f"{database}.e", path=f"{tmp_path}/e", by="k")
    rows = [
        {"table": f"{database}.m", "target_partition_spec": "k", "target_location": f"{tmp_path}/never"},
        {"table": f"{database}.e", "strategy": "migrate", "partitions": "k", "approved": "N"},
    ]
    found = run(spark, options, *rows, execute=False)
    assert {r["status"] for r in found.values()} == {"DRY_RUN_VALIDATED"}
    assert found["m"]["note"] == f"the sandbox copy is {options.sandbox}.{database}__m__run_1"
    assert names(spark, database) == ["e", "m"]
    assert not (tmp_path / "never").exists()
    again = run(spark, options, *rows, execute=False)
    assert {r["status"] for r in again.values()} == {"FAILED"}


def test_execute(spark, database, options, tmp_path):
    fill(spark, f"{database}.m", by="k")
    fill(spark, f"{database}.e", path=f"{tmp_path}/e", by="k")
    rows = [
        {"table": f"{database}.m", "partitions": "k", "target_partition_spec": "bucket(2,id);k",
         "cast_columns": "k:string", "target_location": f"{tmp_path}/new"},
        {"table": f"{database}.e", "strategy": "migrate", "partitions": "k", "source_type": "EXTERNAL"},
        {"table": f"{database}.x", "strategy": "hive_ctas"},
        {"table": f"{database}.y", "strategy": "manual"},
        {"table": f"{database}.z", "approved": "N"},
    ]
    found = run(spark, options, *rows)
    assert {name: r["status"] for name, r in found.items()} == {
        "m": "VALIDATION_FAILED", "e": "CUTOVER_VALIDATED", "x": "MANUAL_ACTION_REQUIRED", "y": "SKIPPED",
    }
    # A bigint key cast to string is a schema change, so the staging table is kept for a look.
    assert "type of k differs: bigint -> string" in found["m"]["note"]
    assert names(spark, database) == ["e", "e_backup_", "m", "m__ice"]
    assert read_validations(spark, options.validations).count() == 2


def test_execute_rewrite_and_rollback(spark, database, options):
    t = f"{database}.m"
    fill(spark, t, by="k")
    found = run(spark, options, {"table": t, "partitions": "k", "target_partition_spec": "bucket(2,id);k"})
    assert (found["m"]["status"], found["m"]["source_rows"]) == ("CUTOVER_VALIDATED", 100)
    assert states(spark, options) == [
        "STARTED", "CTAS_CREATED", "CTAS_VALIDATED", "MOVES_INTENDED", "SOURCE_RENAMED", "TARGET_RENAMED",
        "CUTOVER_VALIDATED",
    ]
    assert spark.table(t).count() == 100
    note = M.rollback(spark, t, "ctas", options.journal, "RB-1")
    assert note.startswith(f"{t} is {t}__legacy again; the replaced table is kept as {t}__failed_")
    assert spark.table(t).columns == ["id", "k"] and spark.table(t).count() == 100
    last = latest_state(read_journal(spark, options.journal)).collect()
    assert [(r["run_id"], r["state"]) for r in last] == [
        ("RB-1", "OPERATOR_ROLLBACK_COMPLETE"), ("RUN-1", "CUTOVER_VALIDATED"),
    ]


@pytest.mark.parametrize("auto", [True, False])
@pytest.mark.parametrize("strategy", ["ctas", "migrate"])
def test_failed_check_after_cutover(spark, database, options, tmp_path, monkeypatch, strategy, auto):
    t = f"{database}.t"
    fill(spark, t, path=f"{tmp_path}/t")
    real = M.validate_tables

    def late_write(spark, source, target, *rest, **named):
        verdict = real(spark, source, target, *rest, **named)
        if target == t:
            verdict |= {"ok": False, "details": ["late write"]}
        return verdict

    monkeypatch.setattr(M, "validate_tables", late_write)
    row = {"table": t, "strategy": strategy, "source_type": "EXTERNAL"}
    found = run(spark, options, row, auto_rollback=auto)["t"]
    kept = f"{t}__legacy" if strategy == "ctas" else f"{t}_BACKUP_"
    if auto:
        assert (found["status"], found["state"]) == ("AUTO_ROLLED_BACK", "AUTO_ROLLED_BACK")
        assert not table_exists(spark, kept)
        assert table_exists(spark, f"{t}__failed_run_1") == (strategy == "ctas")
    else:
        assert (found["status"], found["state"]) == ("VALIDATION_FAILED", "ROLLBACK_REQUIRED")
        assert table_exists(spark, kept)
    assert found["note"].startswith("late write") and spark.table(t).count() == 100


@pytest.mark.parametrize(
    "changes, message",
    [
        ({"target_format_version": "1"}, "target_format_version must be 2"),
        ({"writer_freeze_ticket": " "}, "writer_freeze_ticket is required"),
        ({"cast_columns": "k:date"}, "no automatic cast to: 'date'"),
        ({"cast_columns": "x:int"}, "columns to cast that the table lacks"),
        ({"target_partition_spec": "day(k)"}, "no such partition transform"),
        ({"target_location": "data"}, "must be an absolute"),
        ({"strategy": "migrate"}, "only permitted for source_type=EXTERNAL"),
        ({"strategy": "drop"}, "no such strategy"),
        ({"table": "t"}, "not a plain database.table name"),
    ],
)
def test_refusals_change_nothing(spark, database, options, changes, message):
    fill(spark, f"{database}.t")
    results = M.run_plan(spark, plan(spark, {"table": f"{database}.t"} | changes), options).collect()
    assert results[0]["status"] == "FAILED" and message in results[0]["note"]
    assert names(spark, database) == ["t"]


def test_stop_on_error_and_nothing_approved(spark, database, options):
    rows = [{"table": f"{database}.a"}, {"table": f"{database}.b"}]
    assert list(run(spark, options, *rows)) == ["a", "b"]
    assert len(run(spark, options, *rows, stop_on_error=True)) == 1
    with pytest.raises(ValueError, match="No approved rows selected"):
        run(spark, options, {"table": f"{database}.a", "approved": "N"})


def test_both_sides_only_look_empty(spark, database, options, tmp_path):
    """An external table whose partitions are not registered must not pass as an empty one."""
    spark.range(10).withColumn("k", F.lit(1)).write.partitionBy("k").parquet(f"{tmp_path}/t")
    spark.sql(
        f"CREATE TABLE {database}.t (id BIGINT, k INT) USING parquet PARTITIONED BY (k) LOCATION '{tmp_path}/t'"
    )
    found = run(spark, options, {"table": f"{database}.t"})["t"]
    assert found["status"] == "VALIDATION_FAILED" and "has data files" in found["note"]


def test_select_plan(spark):
    rows = plan(spark, {"table": "db.a"}, {"table": "db.b"})
    assert M.select_plan(spark, rows, "").count() == 2
    assert [r["table"] for r in M.select_plan(spark, rows, " db.b ,").collect()] == ["db.b"]
    many = plan(spark, *({"table": f"db.t{i}"} for i in range(8)))
    picked = M.select_plan(spark, many, "db.t7,db.t0,db.t5,db.t1").collect()
    assert [r["table"] for r in picked] == ["db.t0", "db.t1", "db.t5", "db.t7"]  # as in the plan
    with pytest.raises(ValueError, match=r"\['db.c', 'db.d'\]"):
        M.select_plan(spark, rows, "db.d,db.a,db.c")


def test_optimize(spark, database, options):
    fill(spark, f"{database}.t")
    rows = plan(
        spark, {"table": f"{database}.t", "compact": "y"}, {"table": f"{database}.gone", "compact": "Y"},
        {"table": f"{database}.t", "compact": "N"},
    )
    assert M.optimize(spark, rows, options.journal, "OPT-1") == 1
    last = {r["table"]: r["state"] for r in latest_state(read_journal(spark, options.journal)).collect()}
    assert last == {f"{database}.t": "OPTIMIZE_COMPLETE", f"{database}.gone": "OPTIMIZE_FAILED"}
    with pytest.raises(ValueError, match="No approved compact=Y rows"):
        M.optimize(spark, rows.where("compact = 'N'"), options.journal)
