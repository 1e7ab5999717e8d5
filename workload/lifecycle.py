"""Checks that change tables: each copies given tables into a scratch database and works on the copies.

The jobs run when the query is built, since each step changes the catalogue. What comes back are contents of the
tables as they are afterwards, a few numbers per partition and column that plain SQL computes from the given
tables, and verdicts on the tables and on damaged copies of them. The scratch database is dropped again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from relayout.functions.fingerprint import fingerprint
from relayout.operators import publish as P
from relayout.operators.classify import PLAN_FIELDS, classify
from relayout.operators.known import Store
from relayout.operators.rewrite import OPEN_FILES, rewrite_table
from relayout.plans.inventory import assess, inventory
from relayout.plans.migrate import RunOptions, compact_table, rollback, run_plan, validate_tables
from relayout.session import scratch_folder, ship, sql_settings
from relayout.sources import catalog as S
from relayout.sources.evidence import latest_state, read_journal, read_validations
from relayout.sources.files import measure_locations, measure_tables, table_sizes
from relayout.sources.plan_file import read_plan, write_plan, write_results
from relayout.sources.store import opened
from workload import estate
from workload.fixtures import TABLES, as_sql, load

#: Columns of the tables whose contents are returned: how each is turned into whole numbers.
COLUMNS = {
    "lineitem": {
        "l_orderkey": "whole", "l_partkey": "whole", "l_suppkey": "whole", "l_linenumber": "whole",
        "l_quantity": "cents", "l_extendedprice": "cents", "l_discount": "cents", "l_tax": "cents",
        "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time",
    },
    "orders": {
        "o_orderkey": "whole", "o_custkey": "whole", "o_orderstatus": "text", "o_totalprice": "cents",
        "o_orderdate": "time", "o_orderpriority": "text",
    },
    "customer": {
        "c_custkey": "whole", "c_name": "text", "c_nationkey": "whole", "c_acctbal": "cents", "c_mktsegment": "text",
    },
    "documents": {"doc_id": "whole", "text": "text", "lang": "text", "source": "text", "n_chars": "whole"},
}
CONTENTS = "scenario string, part string, measured string, n bigint, lo bigint, hi bigint, total bigint"


class Scratch:
    """A database of copies in the session's warehouse; evidence lies in its folder and goes with it."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf
        self.name = f"relayout_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE DATABASE {self.name}")
        described = spark.sql(f"DESCRIBE DATABASE {self.name}").where("info_name = 'Location'")
        self.folder = described.first()["info_value"].rstrip("/")

    def table(self, name: str) -> str:
        return f"{self.name}.{name}"

    def copy(self, given: str, name: str, *partition_by: str, files: int = 0, at_least: int = 0) -> str:
        """A managed copy, in a number of files or in ``at_least`` as many; each of a large table is as large as Spark's
        advisory size of a task.
        """
        rows, settings = load(self.spark, self.sf, given), dict(OPEN_FILES)
        if partition_by:
            rows = rows.hint("rebalance", *partition_by)
        elif files:
            rows = rows.repartition(files)
        elif at_least:
            rows = rows.hint("rebalance", at_least)
            settings |= {
                "spark.sql.adaptive.enabled": "true",
                "spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
            }
        writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
        with sql_settings(self.spark, settings):
            writer.saveAsTable(self.table(name))
        return self.table(name)

    def external(self, given: str, name: str, *partition_by: str) -> str:
        """An external table over the files of a managed copy, which are dropped with the copy."""
        owner = self.copy(given, f"{name}_owner", *partition_by)
        P.share_files(self.spark, owner, self.table(name))
        return self.table(name)

    def spread(self, name: str) -> str:
        """An external copy of lineitem by l_returnflag, one partition stored elsewhere, with properties."""
        table = self.table(name)
        rows = load(self.spark, self.sf, "lineitem")
        with sql_settings(self.spark, OPEN_FILES):
            rows.where("l_returnflag <> 'R'").write.partitionBy("l_returnflag").option(
                "path", f"{self.folder}/{name}_files"
            ).saveAsTable(table)
        elsewhere = f"{self.folder}/{name}_elsewhere"
        rows.where("l_returnflag = 'R'").drop("l_returnflag").write.parquet(elsewhere)
        self.spark.sql(f"ALTER TABLE {table} ADD PARTITION (l_returnflag = 'R') LOCATION '{elsewhere}'")
        self.spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('owner_team' = 'loads', 'comment' = 'line items')")
        return table

    def damaged(self, given: str) -> str:
        """A copy with as many rows, of which the one with the least first column differs."""
        first = next(iter(COLUMNS[given]))
        rows = load(self.spark, self.sf, given)
        least = rows.agg(F.min(first)).first()[0]
        other = F.when(F.col(first) == least, -1 - F.col(first)).otherwise(F.col(first))
        rows.withColumn(first, other).write.saveAsTable(self.table(f"damaged_{given}"))
        return self.table(f"damaged_{given}")


@contextmanager
def scratch(spark: SparkSession, sf: str) -> Iterator[Scratch]:
    work = Scratch(spark, sf)
    try:
        yield work
    finally:
        spark.sql(f"DROP DATABASE {work.name} CASCADE")


def _whole(name: str, kind: str) -> Column:
    if kind == "cents":
        return F.round(F.col(name) * 100).cast("bigint")
    if kind == "text":
        return F.length(name).cast("bigint")
    if kind == "time":
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)")
    return F.col(name).cast("bigint")


def contents(df: DataFrame, given: str, scenario: str, key: str = "") -> DataFrame:
    """Number, least, greatest and sum of every column, per value of the key."""
    measured = [
        F.struct(
            F.lit(name).alias("measured"), F.count(name).alias("n"), F.min(_whole(name, kind)).alias("lo"),
            F.max(_whole(name, kind)).alias("hi"), F.sum(_whole(name, kind)).alias("total"),
        )
        for name, kind in COLUMNS[given].items()
    ]
    part = F.col(key).cast("string") if key else F.lit("")
    grouped = df.groupBy(part.alias("part")).agg(F.array(*measured).alias("measures"))
    return grouped.select(F.lit(scenario).alias("scenario"), "part", F.inline("measures"))


def _contents_sql(given: str, scenario: str, key: str = "") -> str:
    whole = {
        "cents": "CAST(round({0} * 100) AS BIGINT)", "text": "length({0})", "time": "CAST(epoch({0}) AS BIGINT)",
        "whole": "{0}",
    }
    part = f"CAST({key} AS VARCHAR)" if key else "''"
    return " UNION ALL ".join(
        f"""SELECT '{scenario}' AS scenario, {part} AS part, '{name}' AS measured, count({name}) AS n,
            CAST(min({whole[kind].format(name)}) AS BIGINT) AS lo,
            CAST(max({whole[kind].format(name)}) AS BIGINT) AS hi,
            CAST(sum({whole[kind].format(name)}) AS BIGINT) AS total
        FROM {{{given}}} GROUP BY 2"""
        for name, kind in COLUMNS[given].items()
    )


def _fact(spark: SparkSession, scenario: str, name: str, n: int, lo: int = 0, hi: int = 0) -> DataFrame:
    """A number of its own among the contents."""
    return spark.createDataFrame([(scenario, "", name, int(n), int(lo), int(hi), 0)], CONTENTS)


def _fact_sql(scenario: str, name: str, n: str, lo: str = "0", hi: str = "0") -> str:
    return f"""SELECT '{scenario}' AS scenario, '' AS part, '{name}' AS measured, CAST({n} AS BIGINT) AS n,
        CAST({lo} AS BIGINT) AS lo, CAST({hi} AS BIGINT) AS hi, CAST(0 AS BIGINT) AS total"""


def _judged(work: Scratch, given: str, scenario: str, table: str, keys: list[str], derived=()) -> DataFrame:
    """The verdicts on a table against the given one, and against a damaged copy of it."""
    facts = []
    for name, other in (("as given", work.copy(given, f"given_{given}")), ("as damaged", work.damaged(given))):
        found = validate_tables(work.spark, other, table, keys, derived=derived)
        facts.append(_fact(work.spark, scenario, name, found["ok"], found["source_rows"], found["target_rows"]))
    return reduce(DataFrame.unionByName, facts)


def _judged_sql(given: str, scenario: str) -> str:
    count = f"(SELECT count(*) FROM {{{given}}})"
    return " UNION ALL ".join(
        _fact_sql(scenario, name, n, count, count) for name, n in (("as given", "1"), ("as damaged", "0"))
    )


def _collected(frames: list[DataFrame]) -> DataFrame:
    """The rows, computed while the scratch tables are there."""
    spark = frames[0].sparkSession
    rows = reduce(DataFrame.unionByName, [f.selectExpr(*CONTENTS_NAMES) for f in frames]).collect()
    return spark.createDataFrame(rows, CONTENTS)


CONTENTS_NAMES = [field.split(" ")[0] for field in CONTENTS.split(", ")]


def catalog_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every table of a database with its strategy and row count."""
    with scratch(spark, sf) as work:
        for given in TABLES:
            work.copy(given, given)
        spark.sql(f"CREATE VIEW {work.table('v')} AS SELECT * FROM {work.table('nation')}")
        found = classify(S.scan_catalog(spark, work.name)).select("table_name", "source_type", "strategy")
        names = [row["table_name"] for row in S.list_tables(spark, work.name).collect()]
        counted = reduce(
            DataFrame.unionByName,
            [
                fingerprint(spark.table(name)).select(F.lit(name).alias("table_name"), "row_count")
                for name in names
            ],
        )
        joined = found.join(counted, "table_name", "full_outer").withColumn(
            "table_name", F.substring_index("table_name", ".", -1)
        )
        return spark.createDataFrame(joined.collect(), joined.schema)


def catalog_describe(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of described tables as declared, with the rows that hold a value in each."""
    with scratch(spark, sf) as work:
        work.copy("orders", "orders", "o_orderstatus")
        spark.sql(
            f"CREATE TABLE {work.table('typed')} (k SMALLINT, code CHAR(10), name VARCHAR(25), "
            "s STRUCT<x: SMALLINT>) USING parquet"
        )
        load(spark, sf, "customer").select(
            F.col("c_nationkey").cast("smallint"),
            "c_mktsegment",
            "c_name",
            F.struct(F.col("c_nationkey").cast("smallint").alias("x")),
        ).write.insertInto(work.table("typed"))
        described = S.scan_catalog(spark, work.name)
        filled = []
        for name in ("orders", "typed"):
            table = spark.table(work.table(name))
            counts = F.array(
                *[F.struct(F.lit(c).alias("name"), F.count(c).alias("n_filled")) for c in table.columns]
            )
            filled.append(
                table.agg(counts.alias("counts")).select(
                    F.lit(work.table(name)).alias("table_name"), F.inline("counts")
                )
            )
        columns = described.select("table_name", "partitions", F.inline("columns"))
        joined = columns.join(filled[0].unionByName(filled[1]), ["table_name", "name"]).select(
            F.substring_index("table_name", ".", -1).alias("table_name"),
            "name",
            "dtype",
            F.array_contains("partitions", F.col("name")).alias("is_partition"),
            "n_filled",
        )
        return spark.createDataFrame(joined.collect(), joined.schema)


def directory_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Folders measured whose files are known: a file per supplier, in a folder per nation.

    A file has as many bytes as its supplier's key modulo 50: some are empty, and names of some are hidden.
    """
    with scratch(spark, sf) as work:
        ship(spark)
        base = f"{work.folder}/measured"

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, path = opened(base)
            for batch in batches:
                for key, nation in zip(batch.column("s_suppkey").to_pylist(), batch.column("s_nationkey").to_pylist()):
                    folder = f"{path}/n{nation}/{'deep/er' if key % 3 else '.'}"
                    store.create_dir(folder, recursive=True)
                    name = f"{'_' if key % 7 == 0 else '.' if key % 11 == 0 else ''}{key}"
                    with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                        out.write(b"x" * (key % 50))
                yield batch

        suppliers = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
        suppliers.mapInArrow(write, suppliers.schema).write.format("noop").mode("overwrite").save()
        nations = load(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("n"))
        located = nations.select(
            F.col("n").alias("table_name"), F.concat(F.lit(f"{base}/n"), "n").alias("location")
        ).unionByName(nations.select(F.concat("n", F.lit("_bad")), F.concat(F.lit("nosuch://n"), "n")).toDF("table_name", "location"))
        facts = measure_locations(spark, located).select(
            "table_name", "bytes", "files", F.col("error").isNotNull().alias("failed")
        )
        return spark.createDataFrame(facts.collect(), facts.schema)


def rewrite_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    with scratch(spark, sf) as work:
        source, target = work.copy("orders", "orders"), work.table("orders_by_year")
        spec = ["o_orderstatus", "years(o_orderdate)", "bucket(4,o_custkey)"]
        derived = rewrite_table(spark, source, target, spec)
        small, cast = work.copy("customer_small", "customer_small"), work.table("customer_cast")
        rewrite_table(spark, small, cast, casts={"c_nationkey": "int"})
        return _collected(
            [
                contents(spark.table(target), "orders", "partitioned", "o_orderstatus"),
                contents(spark.table(cast), "customer", "cast", "c_mktsegment"),
                _judged(work, "orders", "partitioned", target, ["o_orderstatus"], derived),
                _judged(work, "customer", "cast", cast, ["c_mktsegment"]),
            ]
        )


def _files(spark: SparkSession, table: str, where: str = "true") -> set[str]:
    return {row[0] for row in spark.table(table).where(where).select(F.input_file_name()).distinct().collect()}


def _sizes(spark: SparkSession, table: str) -> Row:
    """Files, bytes, files that nothing refers to any more, and whether an inventory would compact the table."""
    columns = "table_name string, location string, partitions array<string>"
    row = S.describe_table(spark, table)
    tables = spark.createDataFrame([(table, row["location"], row["partitions"])], columns)
    return table_sizes(measure_tables(spark, tables)).first()


def compact_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Scattered files packed, good ones left alone, and a second run that finds nothing to do."""
    with scratch(spark, sf) as work:
        flat, split = work.copy("documents", "documents", files=20), work.table("lineitem")
        lines = load(spark, sf, "lineitem")
        lines.where("l_returnflag <> 'R'").repartition(6).write.partitionBy("l_returnflag").saveAsTable(split)
        good = lines.where("l_returnflag = 'R'").coalesce(1)
        good.select(spark.table(split).columns).write.insertInto(split)
        spark.sql(f"ALTER TABLE {split} SET TBLPROPERTIES ('owner_team' = 'loads')")
        kept, before = _files(spark, split, "l_returnflag = 'R'"), len(_files(spark, split))
        sizes = [_sizes(spark, split)]
        first = {table: compact_table(spark, table) for table in (flat, split)}
        again = {table: compact_table(spark, table) for table in (flat, split)}
        sizes.append(_sizes(spark, split))
        old, new = sizes
        replaced = new["replaced_files"] - old["replaced_files"] - 1  # and the mark of the new files' own job
        facts = [
            _fact(spark, "split", "measured files now, before", new["files"], old["files"]),
            _fact(spark, "split", "to compact now, before", new["compact"] == "Y", old["compact"] == "Y"),
            _fact(spark, "split", "files replaced", replaced),
            _fact(spark, "split", "fewer bytes", 0 < new["bytes"] < old["bytes"]),
            _fact(spark, "flat", "files", len(_files(spark, flat)), 20),
            _fact(spark, "split", "files", len(_files(spark, split)), before),
            _fact(spark, "split", "good files kept", kept == _files(spark, split, "l_returnflag = 'R'")),
            _fact(spark, "split", "property kept", "owner_team" in S.describe_table(spark, split)["table_properties"]),
        ]
        for scenario, table in (("flat", flat), ("split", split)):
            facts.append(_fact(spark, scenario, "packed, packed again", first[table]["compacted"], again[table]["compacted"]))
        return _collected(
            [
                *facts,
                contents(spark.table(flat), "documents", "flat"),
                contents(spark.table(split), "lineitem", "split", "l_returnflag"),
                _judged(work, "documents", "flat", flat, []),
                _judged(work, "lineitem", "split", split, ["l_returnflag"]),
            ]
        )


def _properties(spark: SparkSession, scenario: str, table: str) -> DataFrame:
    row = S.describe_table(spark, table)
    comment = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Comment'").first()
    kept = "owner_team=loads" in row["table_properties"] and comment and comment["data_type"] == "line items"
    return _fact(spark, scenario, "properties kept", bool(kept))


def snapshot_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Sandbox tables over the source's own files, one with a partition stored elsewhere."""
    with scratch(spark, sf) as work:
        split, flat = work.spread("split"), work.external("orders", "flat")
        P.share_files(spark, split, work.table("split_sandbox"))
        P.share_files(spark, flat, work.table("flat_sandbox"))
        return _collected(
            [
                contents(spark.table(work.table("split_sandbox")), "lineitem", "split", "l_returnflag"),
                contents(spark.table(work.table("flat_sandbox")), "orders", "flat"),
                _properties(spark, "split", work.table("split_sandbox")),
                _judged(work, "lineitem", "split", work.table("split_sandbox"), ["l_returnflag"]),
                _judged(work, "orders", "flat", work.table("flat_sandbox"), []),
            ]
        )


def _steps(steps: Callable[[Scratch], dict[str, Callable[[], str]]], properties: bool):
    """A query that runs catalogue steps on a copy of lineitem and returns what the tables hold after each."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        with scratch(spark, sf) as work:
            found = []
            for scenario, change in steps(work).items():
                table = change()
                rows = contents(spark.table(table), "lineitem", scenario, "l_returnflag")
                found.append(spark.createDataFrame(rows.collect(), rows.schema))
                if properties:
                    found.append(_properties(spark, scenario, table))
            found.append(_judged(work, "lineitem", "last", table, ["l_returnflag"]))
            return _collected(found)

    return query


def _steps_sql(*scenarios: str, properties: bool) -> str:
    rows = [_contents_sql("lineitem", scenario, "l_returnflag") for scenario in scenarios]
    rows += [_fact_sql(scenario, "properties kept", "1") for scenario in scenarios if properties]
    return as_sql(" UNION ALL ".join([*rows, _judged_sql("lineitem", "last")]))


def _inplace_steps(work: Scratch) -> dict[str, Callable[[], str]]:
    table = work.spread("t")
    backup = f"{table}_BACKUP_"

    def convert() -> str:
        P.convert_in_place(work.spark, table, backup)
        return table

    return {"converted": convert, "backup": lambda: backup}


def _inplace_rollback_steps(work: Scratch) -> dict[str, Callable[[], str]]:
    steps = _inplace_steps(work)

    def undo() -> str:
        table = steps["converted"]()
        rollback(work.spark, table, "migrate", f"{work.folder}/_journal")
        return table

    return {"restored": undo}


def _swap_steps(work: Scratch) -> dict[str, Callable[[], str]]:
    table = work.copy("lineitem", "t", "l_linestatus")
    staging, legacy = f"{table}__ice", f"{table}__legacy"

    def publish() -> str:
        rewrite_table(work.spark, table, staging, ["l_returnflag"])
        P.swap(work.spark, table, staging, legacy)
        return table

    return {"published": publish, "legacy": lambda: legacy}


def _swap_rollback_steps(work: Scratch) -> dict[str, Callable[[], str]]:
    steps = _swap_steps(work)

    def undo() -> str:
        table = steps["published"]()
        rollback(work.spark, table, "ctas", f"{work.folder}/_journal")
        return table

    return {"restored": undo}


def _run(spark: SparkSession, sf: str, execute: bool) -> DataFrame:
    """Plan a database with one table per strategy, run the plan, and join results, evidence and contents.

    One row's cast changes a type, which must fail its check; ``rows_now`` and ``cents_now`` are counted in
    the tables that the run has left, not taken from its verdicts.
    """
    with scratch(spark, sf) as work:
        work.spread("external_split")
        work.copy("customer_small", "managed_small")
        work.copy("customer", "retyped")
        spark.sql(f"CREATE VIEW {work.table('v')} AS SELECT * FROM {work.table('managed_small')}")
        plan = inventory(spark, work.name, with_size=True)
        casts = F.when(F.col("table").endswith(".retyped"), "c_nationkey:string").otherwise(F.col("cast_columns"))
        plan = plan.withColumns(
            {"approved": F.lit("Y"), "writer_freeze_ticket": F.lit("CHG1"), "cast_columns": casts}
        )
        options = RunOptions(
            journal=f"{work.folder}/_journal", validations=f"{work.folder}/_validations",
            run_id="RUN-1", execute=execute, sandbox=f"{work.name}_sandbox",
        )
        spark.sql(f"CREATE DATABASE {options.sandbox}")
        try:
            results = run_plan(spark, plan, options)
            states = latest_state(read_journal(spark, options.journal)).select(
                "table", F.col("state").alias("last_state")
            )
            checks = (
                read_validations(spark, options.validations)
                .groupBy(F.regexp_replace("source", "(__legacy|_BACKUP_)$", "").alias("table"))
                .agg(F.count(F.lit(1)).alias("validations"), F.bool_and("validation.ok").alias("all_ok"))
            )
            now = _now(spark, work, options, execute)
            report = results.join(states, "table", "left").join(checks, "table", "left")
            report = report.join(now, "table", "left").select(
                F.substring_index("table", ".", -1).alias("table"), "strategy", "mode", "status", "state",
                "source_rows", "target_rows", "last_state", "validations", "all_ok", "rows_now", "cents_now",
            )
            return spark.createDataFrame(report.collect(), report.schema)
        finally:
            spark.sql(f"DROP DATABASE {options.sandbox} CASCADE")


def _now(spark: SparkSession, work: Scratch, options: RunOptions, execute: bool) -> DataFrame:
    money = {"external_split": "l_extendedprice", "managed_small": "c_acctbal", "retyped": "c_acctbal"}
    found = []
    for name, column in money.items():
        made = f"{options.sandbox}.{work.name}__{name}__run_1"
        rows = spark.table(work.table(name) if execute else made)
        found.append(
            rows.agg(
                F.lit(work.table(name)).alias("table"), F.count(F.lit(1)).alias("rows_now"),
                F.sum(_whole(column, "cents")).alias("cents_now"),
            )
        )
    rows = reduce(DataFrame.unionByName, found).collect()
    return spark.createDataFrame(rows, found[0].schema)


def run_dry(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, execute=False)


def run_execute(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, execute=True)


def plan_file_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The estate's plan written for editing, and read back; its rows stay in the shared scratch folder."""
    path = f"{scratch_folder(spark)}/plan"
    write_plan(estate.build_plan(spark, sf), path)
    return read_plan(spark, path)


#: Columns that a plan file has lost, by scenario.
LOST = {"none": (), "one": ("approved",), "several": ("table", "strategy")}


def plan_lacks_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The estate's plan written without some of its columns, and what reading it says."""
    with scratch(spark, sf) as work:
        plan, found = estate.build_plan(spark, sf), []
        for scenario, lost in LOST.items():
            path = f"{work.folder}/_plan_{scenario}"
            plan.select(*[name for name in PLAN_FIELDS if name not in lost]).write.options(
                header=True, multiLine=True, escape='"'
            ).csv(path)
            try:
                found.append((scenario, "", read_plan(spark, path).count()))
            except ValueError as failure:
                found.append((scenario, str(failure), 0))
        return spark.createDataFrame(found, "scenario string, refused string, n_rows bigint")


def result_file_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Results of a run written as a report, and counted from it."""
    with scratch(spark, sf) as work:
        rows = load(spark, sf, "results").select(
            F.lit("R1").alias("run_id"), F.col("table_name").alias("table"), F.lit("ctas").alias("strategy"),
            F.lit("execute").alias("mode"), "status", F.lit(7).alias("source_rows"), F.lit(7).alias("target_rows"),
            F.lit(1.5).alias("seconds"), F.col("status").alias("state"),
            F.concat(F.lit('a "note", with\nlines of '), "table_name").alias("note"),
        )
        write_results(rows, f"{work.folder}/_results")
        read = spark.read.options(header=True, multiLine=True, escape='"').csv(f"{work.folder}/_results")
        found = read.groupBy("status", "source_rows", "seconds").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.length("note")).alias("note_chars")
        )
        return spark.createDataFrame(found.collect(), found.schema)


def assess_database(spark: SparkSession, sf: str) -> DataFrame:
    """A database of copies assessed, the report written, and its parts read back."""
    with scratch(spark, sf) as work:
        for given in TABLES:
            work.copy(given, given)
        spark.sql(f"CREATE VIEW {work.table('v')} AS SELECT * FROM {work.table('nation')}")
        folder = f"{work.folder}/_report"
        assess(spark, work.name).write(folder, work.name)
        summary = spark.read.json(f"{folder}/summary").first()
        known = bool(summary["databases"] == work.name and summary["scope"] and len(summary["limits"]) >= 3)
        tables = spark.read.json(f"{folder}/tables")
        counted = reduce(
            DataFrame.unionByName,
            [spark.table(work.table(n)).agg(F.lit(work.table(n)).alias("table"), F.count(F.lit(1)).alias("n_rows"))
             for n in (*TABLES, "v")],
        )
        planned = read_plan(spark, f"{folder}/plan").select("table", F.col("strategy").alias("planned"))
        found = tables.join(planned, "table").join(counted, "table").select(
            F.substring_index("table", ".", -1).alias("table"), "strategy", "planned", "risk_band",
            (F.col("facts.files") > 0).alias("has_files"), "n_rows",
            F.lit(summary["objects_scanned"]).alias("objects"), F.lit(known).alias("scope_known"),
        )
        return spark.createDataFrame(found.collect(), found.schema)


def validate_with_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on two tables by name, as their evidence records them."""
    with scratch(spark, sf) as work:
        table, path = work.copy("lineitem", "lineitem", "l_returnflag"), f"{work.folder}/_validations"
        for run, other in (("V1", work.copy("lineitem", "same")), ("V2", work.damaged("lineitem"))):
            validate_tables(spark, other, table, ["l_returnflag"], derived=(), validations=path, run_id=run)
        found = read_validations(spark, path).select(
            "run_id", F.substring_index("source", ".", -1).alias("source"), "validation.ok", "validation.source_rows",
            "validation.target_rows", "validation.schema_ok", "validation.global_hash_ok", "validation.partition_ok",
            F.size("validation.details").alias("n_details"),
            F.col("timestamp_utc").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$").alias("utc"),
        )
        return spark.createDataFrame(found.collect(), found.schema)


def validate_again(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables validated four times with kept fingerprints: a file is read when it is new, and never again."""
    with scratch(spark, sf) as work:
        one, other = work.copy("lineitem", "one", "l_returnflag"), work.copy("lineitem", "other", at_least=3)
        store, found, read = Store(spark, f"{work.folder}/_fingerprints"), [], 0
        for scenario in ("first", "again", "changed", "renamed"):
            if scenario == "changed":
                spark.table(other).limit(1).write.insertInto(other)
            if scenario == "renamed":
                spark.sql(f"ALTER TABLE {other} RENAME TO {other}_new")
                other = f"{other}_new"
            seen = validate_tables(spark, one, other, ["l_returnflag"], derived=(), store=store)
            found.append(_fact(spark, scenario, "verdict", seen["ok"], seen["source_rows"], seen["target_rows"]))
            if scenario != "first":
                found.append(_fact(spark, scenario, "files read", store.hashed - read))
            read = store.hashed
        return _collected(found)


QUERIES = {
    "catalog_scan": catalog_scan,
    "catalog_describe": catalog_describe,
    "directory_sizes": directory_sizes,
    "rewrite_roundtrip": rewrite_roundtrip,
    "compact_roundtrip": compact_roundtrip,
    "snapshot_verdict": snapshot_verdict,
    "inplace_roundtrip": _steps(_inplace_steps, properties=True),
    "rollback_inplace": _steps(_inplace_rollback_steps, properties=True),
    "publish_swap": _steps(_swap_steps, properties=False),
    "rollback_swap": _steps(_swap_rollback_steps, properties=False),
    "run_dry": run_dry,
    "run_execute": run_execute,
    "plan_file_round_trip": plan_file_round_trip,
    "plan_lacks_columns": plan_lacks_columns,
    "result_file_round_trip": result_file_round_trip,
    "assess_database": assess_database,
    "validate_with_evidence": validate_with_evidence,
    "validate_again": validate_again,
}


def _run_sql(migrated: tuple[str, str, int], rewritten: tuple[str, str, int], failed: str, mode: str) -> str:
    rows = [
        ("external_split", "migrate", "lineitem", "l_extendedprice", *migrated, "true"),
        ("managed_small", "ctas", "customer", "c_acctbal", *rewritten, "true"),
        ("retyped", "ctas", "customer", "c_acctbal", "VALIDATION_FAILED", failed, 1, "false"),
    ]
    found = [
        f"""SELECT '{table}' AS "table", '{strategy}' AS strategy, '{mode}' AS mode, '{status}' AS status,
            '{state}' AS state, count(*) AS source_rows, count(*) AS target_rows, '{state}' AS last_state,
            CAST({n} AS BIGINT) AS validations, {ok} AS all_ok, count(*) AS rows_now,
            CAST(sum(CAST(round({money} * 100) AS BIGINT)) AS BIGINT) AS cents_now
        FROM {{{given}}}"""
        for table, strategy, given, money, status, state, n, ok in rows
    ]
    found.append(f"SELECT 'v', 'skip', '{mode}', 'SKIPPED', 'SKIPPED', NULL, NULL, 'STARTED', NULL, NULL, NULL, NULL")
    return as_sql(" UNION ALL ".join(found))


_LINES = "(SELECT count(*) FROM {lineitem})"

ORACLE = {
    "validate_again": as_sql(
        " UNION ALL ".join(
            [
                _fact_sql("first", "verdict", "1", _LINES, _LINES),
                _fact_sql("again", "verdict", "1", _LINES, _LINES),
                _fact_sql("again", "files read", "0"),
                _fact_sql("changed", "verdict", "0", _LINES, f"1 + {_LINES}"),
                _fact_sql("changed", "files read", "1"),
                _fact_sql("renamed", "verdict", "0", _LINES, f"1 + {_LINES}"),
                _fact_sql("renamed", "files read", "0"),
            ]
        )
    ),
    "catalog_scan": " UNION ALL ".join(
        [
            f"""SELECT '{name}' AS table_name, 'MANAGED' AS source_type, 'ctas' AS strategy,
                count(*) AS row_count FROM {name}"""
            for name in TABLES
        ]
        + ["SELECT 'v', 'VIEW', 'skip', count(*) FROM nation"]
    ),
    "catalog_describe": """
        WITH o AS (SELECT count(*) AS n FROM orders), c AS (SELECT count(*) AS n FROM customer)
        SELECT 'orders' AS table_name, name, dtype, name = 'o_orderstatus' AS is_partition, n AS n_filled
        FROM o, (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_totalprice', 'double'),
                        ('o_orderdate', 'timestamp_ntz'), ('o_orderpriority', 'string'),
                        ('o_orderstatus', 'string')) AS t(name, dtype)
        UNION ALL
        SELECT 'typed', name, dtype, false, n
        FROM c, (VALUES ('k', 'smallint'), ('code', 'char(10)'), ('name', 'varchar(25)'),
                        ('s', 'struct<x:smallint>')) AS t(name, dtype)""",
    "directory_sizes": """
        SELECT CAST(n_nationkey AS VARCHAR) AS table_name,
            CASE WHEN count(s_suppkey) > 0 THEN CAST(sum(s_suppkey % 50) AS BIGINT) END AS bytes,
            nullif(count(s_suppkey), 0) AS files, count(s_suppkey) = 0 AS failed
        FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey
        UNION ALL SELECT n_nationkey || '_bad', NULL, NULL, true FROM nation""",
    "rewrite_roundtrip": as_sql(
        " UNION ALL ".join(
            [
                _contents_sql("orders", "partitioned", "o_orderstatus"),
                _contents_sql("customer", "cast", "c_mktsegment"),
                _judged_sql("orders", "partitioned"),
                _judged_sql("customer", "cast"),
            ]
        )
    ),
    "compact_roundtrip": as_sql(
        " UNION ALL ".join(
            [
                _fact_sql("flat", "files", "1", "20"),
                _fact_sql(
                    "split", "files", "(SELECT count(DISTINCT l_returnflag) FROM {lineitem})",
                    "(SELECT 6 * (count(DISTINCT l_returnflag) - 1) + 1 FROM {lineitem})",
                ),
                _fact_sql(
                    "split", "measured files now, before", "(SELECT count(DISTINCT l_returnflag) FROM {lineitem})",
                    "(SELECT 6 * (count(DISTINCT l_returnflag) - 1) + 1 FROM {lineitem})",
                ),
                _fact_sql("split", "to compact now, before", "0", "1"),
                _fact_sql("split", "files replaced", "(SELECT 6 * (count(DISTINCT l_returnflag) - 1) FROM {lineitem})"),
                _fact_sql("split", "fewer bytes", "1"),
                _fact_sql("split", "good files kept", "1"),
                _fact_sql("split", "property kept", "1"),
                _fact_sql("flat", "packed, packed again", "1"),
                _fact_sql(
                    "split", "packed, packed again", "(SELECT count(DISTINCT l_returnflag) - 1 FROM {lineitem})"
                ),
                _contents_sql("documents", "flat"),
                _contents_sql("lineitem", "split", "l_returnflag"),
                _judged_sql("documents", "flat"),
                _judged_sql("lineitem", "split"),
            ]
        )
    ),
    "snapshot_verdict": as_sql(
        " UNION ALL ".join(
            [
                _contents_sql("lineitem", "split", "l_returnflag"),
                _contents_sql("orders", "flat"),
                _fact_sql("split", "properties kept", "1"),
                _judged_sql("lineitem", "split"),
                _judged_sql("orders", "flat"),
            ]
        )
    ),
    "inplace_roundtrip": _steps_sql("converted", "backup", properties=True),
    "rollback_inplace": _steps_sql("restored", properties=True),
    "publish_swap": _steps_sql("published", "legacy", properties=False),
    "rollback_swap": _steps_sql("restored", properties=False),
    "run_dry": _run_sql(
        ("DRY_RUN_VALIDATED", "SANDBOX_VALIDATED", 1), ("DRY_RUN_VALIDATED", "SANDBOX_VALIDATED", 1),
        "SANDBOX_VALIDATION_FAILED", "dry-run",
    ),
    "run_execute": _run_sql(
        ("CUTOVER_VALIDATED", "CUTOVER_VALIDATED", 1), ("CUTOVER_VALIDATED", "CUTOVER_VALIDATED", 2),
        "CTAS_VALIDATION_FAILED", "execute",
    ),
    "plan_file_round_trip": "SELECT " + ", ".join(
        f"""coalesce(CAST("{name}" AS VARCHAR), '') AS "{name}" """ for name in PLAN_FIELDS
    ) + f" FROM ({estate.ORACLE['build_plan']})",
    "plan_lacks_columns": " UNION ALL ".join(
        "SELECT '{0}' AS scenario, '{1}' AS refused, {2} AS n_rows FROM ({3})".format(
            scenario,
            f"the plan lacks columns: {[name for name in PLAN_FIELDS if name in lost]}".replace("'", "''") if lost else "",
            "CAST(0 * count(*) AS BIGINT)" if lost else "count(*)",
            estate.ORACLE["build_plan"],
        )
        for scenario, lost in LOST.items()
    ),
    "result_file_round_trip": as_sql(
        """SELECT status, '7' AS source_rows, '1.5' AS seconds, count(*) AS n,
            CAST(sum(24 + length(table_name)) AS BIGINT) AS note_chars
        FROM {results} GROUP BY 1"""
    ),
    "assess_database": " UNION ALL ".join(
        [
            f"""SELECT '{name}' AS "table", 'ctas' AS strategy, 'ctas' AS planned, 'high' AS risk_band,
                true AS has_files, count(*) AS n_rows, CAST({len(TABLES) + 1} AS BIGINT) AS objects,
                true AS scope_known FROM {name}"""
            for name in TABLES
        ]
        + [
            f"""SELECT 'v', 'skip', 'skip', 'moderate', NULL, count(*), {len(TABLES) + 1}, true FROM nation"""
        ]
    ),
    "validate_with_evidence": as_sql(
        " UNION ALL ".join(
            f"""SELECT '{run}' AS run_id, '{source}' AS source, {ok} AS ok, count(*) AS source_rows,
                count(*) AS target_rows, true AS schema_ok, {ok} AS global_hash_ok, {ok} AS partition_ok,
                {n} AS n_details, true AS utc FROM {{lineitem}}"""
            for run, source, ok, n in (("V1", "same", "true", 0), ("V2", "damaged_lineitem", "false", 2))
        )
    ),
}
