"""Catalogue, files, plan files and evidence."""

import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor

import pytest

from relayout.operators.classify import PLAN_FIELDS, plan_fields
from relayout.plans.inventory import assess, inventory
from relayout.sources import catalog as S
from relayout.sources import evidence as E
from relayout.sources import files as FS
from relayout.sources import plan_file as P
from workload.lifecycle import plan_file_round_trip


def rows(df, *names):
    return sorted(tuple(row[name] for name in names) for row in df.collect())


def test_list_tables(spark, database):
    spark.sql(f"CREATE TABLE {database}.t (a INT) USING parquet")
    spark.sql(f"CREATE VIEW {database}.v AS SELECT 1 AS a")
    spark.range(1).createOrReplaceTempView("not_listed")
    found = S.list_tables(spark, f" {database}, ,")
    assert rows(found, "table_name") == [(f"{database}.t",), (f"{database}.v",)]
    with pytest.raises(ValueError, match="not a plain identifier"):
        S.list_tables(spark, "a; DROP")


def test_describe_keeps_declared_types(spark, database):
    spark.sql(
        f"CREATE TABLE {database}.t (a SMALLINT, b CHAR(5), c VARCHAR(9), s STRUCT<x: SMALLINT>, p STRING)"
        " USING parquet PARTITIONED BY (p) TBLPROPERTIES ('transactional' = 'false')"
    )
    row = S.describe_table(spark, f"{database}.t")
    assert row["columns"] == [
        ("a", "smallint"), ("b", "char(5)"), ("c", "varchar(9)"), ("s", "struct<x:smallint>"),
        ("p", "string"),
    ]
    assert (row["partitions"], row["type_raw"], row["provider"]) == (["p"], "MANAGED", "parquet")
    assert row["table_properties"] == "[transactional=false]"
    assert row["location"].endswith("/t")


def test_a_broken_table_becomes_an_error_row(spark, database, monkeypatch):
    spark.sql(f"CREATE TABLE {database}.good (a INT) USING orc")
    spark.sql(f"CREATE TABLE {database}.bad (a INT) USING orc")
    describe = S.describe_table

    def failing(spark, table):
        if table.endswith("bad"):
            raise ValueError("no permission\nand more")
        return describe(spark, table)

    monkeypatch.setattr(S, "describe_table", failing)
    found = inventory(spark, database)
    assert rows(found, "table", "strategy", "note") == [
        (f"{database}.bad", "manual", "inventory error: no permission\nand more"),
        (f"{database}.good", "ctas", "MANAGED table is not eligible for in-place migrate"),
    ]


def test_measured_directories(spark, tmp_path):
    deep = tmp_path / "t" / "p=1" / "q=x y"
    deep.mkdir(parents=True)
    (deep / "one").write_bytes(b"x" * 1000)
    (tmp_path / "t" / "two").write_bytes(b"x" * 24)
    (tmp_path / "t_2").mkdir()
    (tmp_path / "t_2" / "three").write_bytes(b"x")
    (tmp_path / "empty").mkdir()
    tables = spark.createDataFrame(
        [
            ("t", f"{tmp_path}/t/"), ("inside", f"file:{tmp_path}/t/p=1"), ("same", f"file://{tmp_path}/t"), ("t_2", f"file:{tmp_path}/t_2"),
            ("empty", f"{tmp_path}/empty"), ("gone", f"{tmp_path}/gone"), ("view", ""), ("none", None),
        ],
        "table_name string, location string",
    )
    facts = FS.measure_locations(spark, tables)
    found = {r["table_name"]: (r["bytes"], r["files"], r["error"]) for r in facts.collect()}
    assert "gone" in found["gone"][2] and found.pop("gone")[:2] == (None, None)
    assert found == {
        "t": (1024, 2, None),
        "same": (1024, 2, None),
        "inside": (1000, 1, None),
        "t_2": (1, 1, None),
        "empty": (0, 0, None),
        "view": (None, None, FS.NO_LOCATION),
        "none": (None, None, FS.NO_LOCATION),
    }


def test_all_files_count_and_bad_locations_stay_alone(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    for name, size in (("a", 10), ("empty", 0), ("_SUCCESS", 0), (".hidden", 3), (".a.crc", 8)):
        (folder / name).write_bytes(b"x" * size)
    for i in range(300):
        (folder / f"p={i}" / "q=1" / "r=2").mkdir(parents=True)
        (folder / f"p={i}" / "q=1" / "r=2" / "f").write_bytes(b"xy")
    tables = spark.createDataFrame(
        [("t", str(folder)), ("p", f"{folder}/p=7"), ("odd", "nosuch://x/y"), ("gone", f"file:{tmp_path}/gone"),
         ("below", f"{folder}/none")],
        "table_name string, location string",
    )
    found = {r["table_name"]: r for r in FS.measure_locations(spark, tables).collect()}
    assert (found["t"]["bytes"], found["t"]["files"], found["t"]["error"]) == (613, 304, None)
    assert (found["p"]["bytes"], found["p"]["files"]) == (2, 1)
    assert all(found[name]["error"] and found[name]["files"] is None for name in ("odd", "gone", "below"))


def test_outermost():
    assert FS.outermost(["file:/a/b", "file:///a/", "file:/ab", "hdfs://n/a", "hdfs://n/a/b/c"]) == [
        "file:/a", "file:/ab", "hdfs://n/a",
    ]


def test_sizes_judge_the_rounded_average(spark):
    mib = 1 << 20
    facts = spark.createDataFrame(
        [("a", int(63.96 * mib), 1), ("b", int(63.94 * mib), 1), ("empty", 0, 0), ("none", None, None)],
        "table_name string, bytes bigint, files bigint",
    )
    assert rows(FS.table_sizes(facts).na.fill(-1.0), "table_name", "avg_file_mb", "compact") == [
        ("a", 64.0, "N"), ("b", 63.9, "Y"), ("empty", 0.0, "Y"), ("none", -1.0, None),
    ]


def test_plan_round_trip(spark, tmp_path):
    plan = plan_fields(
        spark.createDataFrame(
            [("db.t", 'quotes " and, commas\nand lines', 1.5), ("db.u", "", None)],
            "table string, note string, size_gb double",
        )
    )
    P.write_plan(plan, f"{tmp_path}/plan")
    read = P.read_plan(spark, f"{tmp_path}/plan")
    assert read.columns == list(PLAN_FIELDS)
    assert rows(read, "table", "note", "size_gb") == [
        ("db.t", 'quotes " and, commas\nand lines', "1.5"), ("db.u", "", ""),
    ]


def test_large_plan_is_several_files(spark, tmp_path):
    plan = spark.range(20_000).selectExpr("concat('db.t', id) AS table", "concat('a\n', sha2(string(id), 256)) AS note")
    P.write_plan(plan, f"{tmp_path}/small")
    P.write_plan(plan, f"{tmp_path}/large", file_bytes=64 * 1024)
    small, large = (P.read_plan(spark, f"{tmp_path}/{name}") for name in ("small", "large"))
    assert len(small.inputFiles()) == 1 and len(large.inputFiles()) > 3
    order = [row["table"] for row in small.select("table").collect()]
    assert order == [f"db.t{n}" for n in range(20_000)]  # a plan is run in its order
    assert small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()


def test_plan_round_trip_query_reads_its_files(spark, sf_dir):
    plan = plan_file_round_trip(spark, sf_dir)
    assert plan.inputFiles()  # not rows that went through the driver
    assert plan.count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()


def test_plan_without_columns(spark, tmp_path):
    (tmp_path / "plan.csv").write_text("table,strategy\ndb.t,ctas\n")
    with pytest.raises(ValueError, match="source_type.*note"):
        P.read_plan(spark, str(tmp_path / "plan.csv"))
    (tmp_path / "empty.csv").write_text(",".join(PLAN_FIELDS) + "\n")
    with pytest.raises(ValueError, match="lacks columns"):
        P.read_plan(spark, str(tmp_path / "empty.csv"))


def test_journal(spark, tmp_path):
    path = f"{tmp_path}/journal"
    E.append_journal(spark, path, "R1", "db.t", "STARTED", mode="execute")
    E.append_journal(spark, path, "R1", "db.t", "FAILED", error="x")
    E.append_journal(spark, path, "R1", "db.s", "STARTED")
    E.append_journal(spark, path, "R0", "db.t", "STARTED")
    journal = E.read_journal(spark, path)
    last = E.latest_state(journal).collect()
    assert [(r["run_id"], r["table"], r["state"]) for r in last] == [
        ("R0", "db.t", "STARTED"), ("R1", "db.s", "STARTED"), ("R1", "db.t", "FAILED"),
    ]
    assert last[2]["extras"] == {"error": "x"}
    assert last[2]["timestamp_utc"].endswith("+00:00")


def test_no_event_is_lost_between_writers(spark, tmp_path):
    """Threads of one session and other processes, all into one journal; every event that returned is read back."""
    path = f"{tmp_path}/journal"

    def write(name, events=12):
        mine = E.EvidenceFile(spark, path, "RUN/1 x")
        for i in range(events):
            mine.event(f"db.{name}", f"S{i}")

    code = (
        "import sys; from types import SimpleNamespace as N; from relayout.sources import evidence as E\n"
        "conf = N(get=lambda k: 'file:///')\n"
        "spark = N(sparkContext=N(_jsc=N(hadoopConfiguration=lambda: conf)))\n"
        "for i in range(20): E.append_journal(spark, sys.argv[1], 'RUN/1 x', sys.argv[2], f'S{i}')\n"
    )
    others = [subprocess.Popen([sys.executable, "-c", code, path, f"db.p{i}"]) for i in range(2)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, ["a", "b", "c"]))
    assert [other.wait() for other in others] == [0, 0]
    counts = {r["table"]: r["count"] for r in E.read_journal(spark, path).groupBy("table").count().collect()}
    assert counts == {"db.a": 12, "db.b": 12, "db.c": 12, "db.p0": 20, "db.p1": 20}
    assert {r["run_id"] for r in E.read_journal(spark, path).collect()} == {"RUN/1 x"}


def test_malformed_journal_line(spark, tmp_path):
    good = '{"run_id":"R1","table":"db.t","state":"STARTED","seq":1}'
    (tmp_path / "journal.json").write_text(good + "\n{broken\n")
    path = str(tmp_path / "journal.json")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        E.read_journal(spark, path).collect()
    assert rows(E.malformed_lines(spark, path), "line") == [("{broken",)]


def test_assessment_is_written(spark, database, tmp_path):
    spark.sql(f"CREATE TABLE {database}.t USING parquet AS SELECT 1 AS a")
    spark.sql(f"CREATE VIEW {database}.v AS SELECT 1 AS a")
    found = assess(spark, database)
    assert [(r["table"], r["risk_score"], r["risk_band"]) for r in found.tables.collect()] == [
        (f"{database}.t", 65, "high"), (f"{database}.v", 10, "moderate"),
    ]
    assert [tuple(r) for r in found.strategies.collect()] == [("ctas", 1), ("skip", 1)]
    found.write(f"{tmp_path}/report", database)
    summary = spark.read.json(f"{tmp_path}/report/summary").first()
    assert (summary["objects_scanned"], summary["databases"]) == (2, database)
    table = spark.read.json(f"{tmp_path}/report/tables").where("strategy = 'ctas'").first()
    assert table["facts"]["files"] >= 1 and table["risk_reasons"][0].startswith("MANAGED")
    assert P.read_plan(spark, f"{tmp_path}/report/plan").count() == 2


def test_unreadable_directory_leaves_the_table_to_review(spark, database, tmp_path):
    (tmp_path / "x").mkdir()
    spark.range(1).write.parquet(f"{tmp_path}/x/data")
    spark.sql(f"CREATE TABLE {database}.t (id BIGINT) USING parquet LOCATION '{tmp_path}/x/data'")
    spark.sql(f"CREATE TABLE {database}.u (id BIGINT) USING parquet LOCATION '{tmp_path}/x/data'")
    spark.sql(f"ALTER TABLE {database}.u SET LOCATION '{tmp_path}/x/gone'")
    found = {r["table"][len(database) + 1 :]: r for r in inventory(spark, database, with_size=True).collect()}
    assert (found["t"]["strategy"], found["t"]["compact"]) == ("migrate", "Y")
    assert found["u"]["strategy"] == "manual" and found["u"]["note"].startswith("inventory error: ")


@pytest.mark.parametrize("entries", [1, 40, 10**6])
def test_folders_of_any_shape(spark, tmp_path, monkeypatch, entries):
    """Very many folders below one, a deep chain, and a file in each: listed by many tasks, each folder once."""
    monkeypatch.setattr(FS, "_FIRST_ENTRIES", entries)
    wide, deep = tmp_path / "a" / "b", tmp_path / "deep"
    for i in range(700):
        (wide / f"k={i}").mkdir(parents=True)
        (wide / f"k={i}" / "f").write_text("x" * (i % 9))
    for i in range(60):
        deep /= str(i)
    deep.mkdir(parents=True)
    tasks = []
    spread = FS._spread
    monkeypatch.setattr(FS, "_spread", lambda df, n: tasks.append(out := spread(df, n)) or out)
    found = FS.list_folders(spark, [str(tmp_path)]).collect()
    assert len(found) == len({r["directory"] for r in found}) == 1 + 2 + 700 + 61
    assert sum(r["files"] for r in found) == 700 and sum(r["bytes"] for r in found) == sum(i % 9 for i in range(700))
    most = max(df.rdd.getNumPartitions() for df in tasks)
    assert (most >= 20) == (entries < 100) and len(tasks) <= 12
    assert FS.list_folders(spark, []).count() == 0
