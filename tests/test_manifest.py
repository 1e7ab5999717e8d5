"""File manifests, sizes by the catalogue's places, segmented evidence and recovery."""

import json

import pytest
from pyspark.sql import functions as F

from relayout.operators import publish as P
from relayout.plans.inventory import inventory
from relayout.plans.migrate import compact_table
from relayout.plans.recover import open_operations, recover
from relayout.sources import evidence as E
from relayout.sources import files as FS
from relayout.sources import manifest as MF
from relayout.sources.catalog import describe_table, partition_places


def split(spark, table, path, values="id % 3"):
    rows = spark.range(0, 300, 1, 10).selectExpr("id", f"CASE {values} WHEN 0 THEN 'a=/\\' é+%' WHEN 1 THEN 'b' END AS k")
    rows.write.partitionBy("k").option("path", path).saveAsTable(table)


def test_manifest_of_a_partitioned_table(spark, database, tmp_path):
    """Every file that a scan reads, with its partition's value; a place elsewhere counts, unregistered folders do not."""
    table = f"{database}.t"
    split(spark, table, f"{tmp_path}/t")
    spark.range(5).write.parquet(f"{tmp_path}/elsewhere")
    spark.sql(f"ALTER TABLE {table} ADD PARTITION (k = 'c') LOCATION '{tmp_path}/elsewhere'")
    spark.range(5).write.parquet(f"{tmp_path}/t/k=unknown")
    files = MF.data_files(MF.table_files(spark, [table]))
    read = {r[0].split("/")[-1] for r in spark.table(table).select(F.input_file_name()).distinct().collect()}
    assert read <= {r["path"].split("/")[-1] for r in files.collect()}
    assert files.count() == files.select(MF.relative_path()).distinct().count()
    per = {r["k"]: r for r in MF.files_by_partition(spark, table, ["k"]).collect()}
    assert set(per) == {"a=/' é+%", "b", None, "c"}
    rows = spark.table(table).select("k", F.input_file_name()).distinct().groupBy("k").agg(F.count("*").alias("n")).collect()
    assert all(per[r["k"]]["files"] >= r["n"] for r in rows) and all(r["bytes"] > 0 for r in per.values())


def test_manifest_reads_no_rows_and_reports_what_cannot_be_listed(spark, database, tmp_path):
    spark.sql(f"CREATE TABLE {database}.t (id BIGINT) USING parquet LOCATION '{tmp_path}/gone'")
    (tmp_path / "x.parquet").write_text("no parquet file at all")
    found = MF.list_files(spark, [("a", "", str(tmp_path)), ("b", "", f"{tmp_path}/gone"), ("c", "", "nosuch://x")])
    rows = {r["table_name"]: r for r in found.collect()}
    assert rows["a"]["bytes"] == 22 and rows["a"]["modified"] > 0 and rows["b"]["error"] and rows["c"]["error"]
    with pytest.raises(Exception, match="not listed"):
        MF.data_files(found).collect()
    assert MF.list_files(spark, []).count() == 0


def test_inventory_after_compaction(spark, database, tmp_path):
    """New files count, replaced ones count apart, and nothing is left to compact."""
    table = f"{database}.t"
    split(spark, table, f"{tmp_path}/t")
    plan = inventory(spark, database, with_size=True).first()
    assert plan["compact"] == "Y"
    compact_table(spark, table)
    row = describe_table(spark, table)
    tables = spark.createDataFrame(
        [(table, row["location"], row["partitions"])], "table_name string, location string, partitions array<string>"
    )
    facts = FS.measure_tables(spark, tables).first()
    listed = MF.table_files(spark, [table]).agg(F.count("path"), F.sum("bytes")).first()
    assert (facts["files"], facts["bytes"]) == tuple(listed) and facts["places"] == 3
    assert facts["replaced_files"] >= 30 and facts["replaced_bytes"] > 0
    assert inventory(spark, database, with_size=True).first()["compact"] == "N"


def test_partitions_without_folders_hold_nothing(spark, database, tmp_path):
    spark.sql(
        f"CREATE TABLE {database}.t (id BIGINT, k INT) USING parquet PARTITIONED BY (k) LOCATION '{tmp_path}/t'"
    )
    (tmp_path / "t").mkdir()
    spark.sql(f"ALTER TABLE {database}.t ADD PARTITION (k = 1) LOCATION '{tmp_path}/none'")
    tables = [(f"{database}.t", f"{tmp_path}/t", ["k"]), ("x.gone", f"{tmp_path}/gone", []), ("x.view", "", [])]
    tables = spark.createDataFrame(tables, "table_name string, location string, partitions array<string>")
    found = {r["table_name"]: r for r in FS.measure_tables(spark, tables).collect()}
    assert (found[f"{database}.t"]["files"], found[f"{database}.t"]["error"]) == (0, None)
    assert found["x.gone"]["error"].startswith("location not found") and found["x.view"]["error"] == FS.NO_LOCATION


def test_evidence_is_written_a_logarithmic_number_of_times(spark, tmp_path, monkeypatch):
    written = []
    real = E.write_whole
    monkeypatch.setattr(E, "write_whole", lambda uri, text: (written.append(text.count("\n")), real(uri, text)))
    monkeypatch.setattr(E, "FAN", 4)
    mine = E.EvidenceFile(spark, f"{tmp_path}/journal", "R")
    for i in range(1000):
        mine.event("db.t", f"S{i}")
        if i in (0, 3, 4, 15, 16, 700):
            assert E.read_journal(spark, f"{tmp_path}/journal").count() == i + 1
    assert sum(written) <= 1000 * 6  # 4^5 > 1000: a record is in six files at most, one after another
    assert len(list((tmp_path / "journal/run_id=R").iterdir())) <= 2 * 5 * 4
    states = [r["state"] for r in E.read_journal(spark, f"{tmp_path}/journal").orderBy("seq").collect()]
    assert states == [f"S{i}" for i in range(1000)]


def test_ten_thousand_events(spark, tmp_path):
    mine = E.EvidenceFile(spark, f"{tmp_path}/journal", "R")
    for i in range(10_000):
        mine.event("db.t", "S")
    assert E.read_journal(spark, f"{tmp_path}/journal").agg(F.count_distinct("seq")).first()[0] == 10_000


def test_only_open_intentions_are_recovered(spark, tmp_path):
    path = f"{tmp_path}/journal"
    one = E.EvidenceFile(spark, path, "R1")
    one.event("db.a", "MOVES_INTENDED", operation="swap", moves="[]")
    one.event("db.a", "TARGET_RENAMED")
    one.event("db.b", "CONVERSION_INTENDED")
    one.event("db.b", "CUTOVER_AUTO_ROLLED_BACK")
    one.event("db.c", "STARTED")
    one.event("db.d", "SWITCH_INTENDED", places=json.dumps({}), folder="x")
    assert [r["table"] for r in open_operations(E.read_journal(spark, path)).collect()] == ["db.d"]


@pytest.mark.parametrize("forward", [True, False])
def test_half_switched_partitions(spark, database, tmp_path, forward):
    """Some partitions switched, one of them dropped since: the others end in one of two states, any number of times."""
    table = f"{database}.t"
    split(spark, table, f"{tmp_path}/t")
    before = dict(partition_places(spark, table))
    journal = f"{tmp_path}/journal"
    record = E.EvidenceFile(spark, journal, "R")
    compact_table(spark, table)
    after = dict(partition_places(spark, table))
    folder = after["k=b"].removesuffix("/k=b")
    P.set_places(spark, table, {"k=b": before["k=b"]})
    record.event(table, "SWITCH_INTENDED", folder=folder, places=json.dumps(before))
    spark.sql(f"ALTER TABLE {table} DROP PARTITION (k = 'b')")
    found = recover(spark, journal, forward).first()
    assert found["state"] == ("COMPACTED" if forward else "UNCOMPACTED")
    wanted = {shown: place for shown, place in (after if forward else before).items() if shown != "k=b"}
    assert dict(partition_places(spark, table)) == wanted
    assert recover(spark, journal, forward).count() == 0 and spark.table(table).count() == 200
