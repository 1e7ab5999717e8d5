"""Validation by kept fingerprints of files, and fingerprints observed by the write."""

import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from relayout.functions.fingerprint import fingerprint, observed, observed_fingerprint
from relayout.operators import known as K
from relayout.operators.compare import validate
from relayout.plans import migrate as M
from relayout.plans.migrate import validate_tables
from relayout.session import sql_settings
from relayout.sources.catalog import describe_table
from tests.test_run import options, run  # noqa: F401
from workload import lifecycle


def fill(spark, table, by=()):
    rows = spark.range(0, 400, 1, 4).selectExpr("id", "CAST(id % 3 AS STRING) AS k", "CASE WHEN id % 5 > 0 THEN id / 7 END AS v")
    rows.write.partitionBy(*by).saveAsTable(table)


def spoil(spark, table):
    """Make every data file unreadable without a change of size or time."""
    top = describe_table(spark, table)["location"].removeprefix("file:")
    for folder, _, names in os.walk(top):
        for name in names:
            if name.startswith("part-"):
                path = f"{folder}/{name}"
                facts = os.stat(path)
                with open(path, "r+b") as out:
                    out.write(b"\0" * facts.st_size)
                os.utime(path, ns=(facts.st_atime_ns, facts.st_mtime_ns))
                crc = f"{folder}/.{name}.crc"
                if os.path.exists(crc):
                    os.remove(crc)


@pytest.mark.parametrize("by", [(), ("k",)])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_known_files_are_not_read(spark, database, tmp_path, by, keys):
    one, two = f"{database}.one", f"{database}.two"
    fill(spark, one, by)
    fill(spark, two)
    store = K.Store(spark, f"{tmp_path}/store")
    first = validate_tables(spark, one, two, keys, derived=(), store=store)
    assert first == validate_tables(spark, one, two, keys, derived=()) and first["ok"]
    read = store.hashed
    spoil(spark, one)
    assert validate_tables(spark, one, two, keys, derived=(), store=store) == first and store.hashed == read
    spark.sql(f"ALTER TABLE {two} RENAME TO {two}_new")
    assert validate_tables(spark, one, f"{two}_new", keys, derived=(), store=store) == first and store.hashed == read


def test_changed_files_are_read(spark, database, tmp_path):
    one, two = f"{database}.one", f"{database}.two"
    fill(spark, one, ("k",))
    fill(spark, two, ("k",))
    store = K.Store(spark, f"{tmp_path}/store")
    assert validate_tables(spark, one, two, ["k"], store=store)["ok"]
    read = store.hashed
    spark.sql(f"INSERT INTO {two} VALUES (1000, 0.5, '1')")
    found = validate_tables(spark, one, two, ["k"], store=store)
    assert not found["ok"] and found["target_rows"] == 401 and store.hashed == read + 1
    spark.sql(f"ALTER TABLE {two} DROP PARTITION (k = '1')")
    found = validate_tables(spark, one, two, ["k"], store=store)
    assert not found["ok"] and found["target_rows"] == 267 and store.hashed == read + 1


def test_many_new_files_and_empty_ones(spark, database, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "_NAMED_FILES", 2)
    one = f"{database}.one"
    fill(spark, one)
    spark.range(0).selectExpr("id", "'x' AS k", "0D AS v").write.mode("append").insertInto(one)
    store = K.Store(spark, f"{tmp_path}/store")
    df = spark.table(one)
    for _ in range(2):
        got = store.fingerprints(one, df, ["k"]).orderBy("k").collect()
        assert got == fingerprint(df, ["k"]).orderBy("k").collect()
    assert store.hashed == K.current_files(spark, one).count()


def test_what_a_write_reads_is_its_fingerprint(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).selectExpr("id", "CASE WHEN id % 3 > 0 THEN id / 7 END AS v", "array(id) AS a")
    seen = Observation()
    observed(df, seen).write.parquet(f"{tmp_path}/t")
    assert observed_fingerprint(spark, seen).collect() == fingerprint(df).collect()
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1000


def test_totals_that_are_too_high_are_not_believed(spark, database):
    fill(spark, f"{database}.one")
    fill(spark, f"{database}.two")
    wrong = fingerprint(spark.table(f"{database}.one")).withColumn("row_count", F.col("row_count") + 5)
    assert validate_tables(spark, f"{database}.one", f"{database}.two", totals=wrong)["ok"]


def test_a_cutover_reads_each_file_once(spark, database, options, monkeypatch):  # noqa: F811
    """The copy reads the source, the first validation the copy, the second one nothing."""
    table = f"{database}.t"
    fill(spark, table)
    hashed = []
    swap = M.P.swap

    def spoiling(spark_, source, target, legacy, record):
        swap(spark_, source, target, legacy, record)
        spoil(spark, source)
        spoil(spark, legacy)

    monkeypatch.setattr(M.P, "swap", spoiling)
    real = K.Store.fingerprints
    monkeypatch.setattr(K.Store, "fingerprints", lambda self, name, *rest: (hashed.append(name), real(self, name, *rest))[1])
    found = run(spark, options, {"table": table, "strategy": "ctas"})["t"]
    assert found["status"] == "CUTOVER_VALIDATED" and found["source_rows"] == 400
    assert hashed == [f"{table}__ice", table]  # the source is known from the copy both times


def test_rows_of_new_tables_are_not_asked_for_their_files_names(spark, database, tmp_path, monkeypatch):
    table, plans = f"{database}.one", []
    fill(spark, table, ("k",))

    def seen(df, *arguments, **options):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return fingerprint(df, *arguments, **options)

    monkeypatch.setattr(K, "fingerprint", seen)
    store = K.Store(spark, f"{tmp_path}/store")
    found = store.fingerprints(table, spark.table(table), ["k"])
    wanted = fingerprint(spark.table(table), ["k"])
    assert found.exceptAll(wanted).isEmpty() and found.count() == 3
    assert plans and not any("url_decode" in plan or "regexp_replace" in plan for plan in plans)


def test_files_of_a_large_copy_have_the_advisory_size(spark, tmp_path):
    given = spark.range(0, 40_000, 1, 8).selectExpr("id", "sha2(string(id), 256) AS code")
    given.write.parquet(f"{tmp_path}/lineitem.parquet")
    with lifecycle.scratch(spark, str(tmp_path)) as work:
        few = work.copy("lineitem", "few", at_least=3)
        with sql_settings(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}):
            many = work.copy("lineitem", "many", at_least=3)
        files = [len(spark.table(name).inputFiles()) for name in (few, many)]
        assert files[0] == 3 and files[1] > 3
        assert validate(given, spark.table(many)).first()["ok"]
