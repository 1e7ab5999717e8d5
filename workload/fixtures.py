"""Derived inputs as SQL that both engines run unchanged; ``{name}`` stands for an input."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

FIXTURES = {
    "lineitem_reordered": """
        SELECT * FROM {lineitem} WHERE l_returnflag = 'R'
        UNION ALL SELECT * FROM {lineitem} WHERE l_returnflag <> 'R' OR l_returnflag IS NULL""",
    "lineitem_bad": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
               CASE WHEN l_returnflag = 'R' AND l_orderkey % 1009 = 5 THEN l_tax + 1 ELSE l_tax END AS l_tax,
               l_returnflag, l_linestatus, l_shipdate
        FROM {lineitem}
        WHERE NOT (l_returnflag = 'A' AND l_linestatus = 'F' AND l_orderkey % 997 = 3)""",
    "mult_a": "SELECT * FROM {events} UNION ALL SELECT * FROM {events} WHERE event_id = 1",
    "mult_b": "SELECT * FROM {events} UNION ALL SELECT * FROM {events} WHERE event_id = 2",
    "events_swap": """
        SELECT event_id, ts,
               CASE event_id WHEN 1 THEN (SELECT max(user_id) FROM {events} WHERE event_id = 2)
                             WHEN 2 THEN (SELECT max(user_id) FROM {events} WHERE event_id = 1)
                             ELSE user_id END AS user_id,
               event_type, value, props
        FROM {events}""",
    "events_us": """
        SELECT event_id,
               CASE WHEN event_id % 100 = 3 THEN ts + INTERVAL 1 MICROSECOND ELSE ts END AS ts,
               user_id, event_type, value, props
        FROM {events}""",
    "marker_null": """
        SELECT event_id,
               CASE WHEN event_id = 5 THEN CAST(NULL AS STRING) ELSE event_type END AS event_type
        FROM {events}""",
    "marker_text": """
        SELECT event_id,
               CASE WHEN event_id = 5 THEN '<NULL>' ELSE event_type END AS event_type
        FROM {events}""",
    "events_nullkey": """
        SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type, value, props
        FROM {events}""",
    "events_nullkey_bad": """
        SELECT event_id, ts, user_id, event_type,
               CASE WHEN event_type IS NULL THEN value + 1 ELSE value END AS value, props
        FROM {events_nullkey}""",
    "customer_small": """
        SELECT c_custkey, c_name, CAST(c_nationkey AS SMALLINT) AS c_nationkey, c_acctbal, c_mktsegment
        FROM {customer}""",
    "customer_renamed": """
        SELECT c_custkey, c_name AS name, c_nationkey, c_acctbal, c_mktsegment FROM {customer}""",
    "customer_retyped": """
        SELECT c_custkey, c_name, CAST(c_nationkey AS STRING) AS c_nationkey, c_acctbal, c_mktsegment
        FROM {customer}""",
    "estate": """
        SELECT concat('db', CAST(p_partkey % 5 AS STRING), '.t', CAST(p_partkey AS STRING)) AS table_name,
               CASE p_partkey % 7 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'MANAGED' ELSE 'EXTERNAL' END AS type_raw,
               CASE p_partkey % 11 WHEN 0 THEN 'lake' WHEN 1 THEN 'parquet' WHEN 2 THEN 'orc'
                                   WHEN 3 THEN 'avro' ELSE 'hive' END AS provider,
               CASE p_partkey % 4 WHEN 0 THEN 'ParquetHiveSerDe' WHEN 1 THEN 'OrcSerde'
                                  WHEN 2 THEN 'AvroSerDe' ELSE 'LazySimpleSerDe' END AS serde,
               CASE p_partkey % 13 WHEN 0 THEN '[transactional=true]' WHEN 1 THEN '[table_type=LAKE]'
                                   WHEN 2 THEN '[TRANSLATED_TO_EXTERNAL=TRUE]' ELSE '[]' END AS table_properties,
               CASE p_partkey % 17 WHEN 0 THEN '8' WHEN 1 THEN '0' ELSE '' END AS num_buckets,
               CASE p_partkey % 19 WHEN 0 THEN 'smallint' WHEN 1 THEN 'char(3)' WHEN 2 THEN 'struct<a:smallint>'
                                   WHEN 3 THEN 'uniontype<int,string>' WHEN 4 THEN 'interval day to second'
                                   ELSE 'bigint' END AS col_type,
               CASE WHEN p_partkey % 7 = 0 THEN ''
                    ELSE concat('/wh/src', CAST(p_partkey % 23 AS STRING)) END AS location,
               CASE WHEN p_partkey % 3 = 0 THEN 'p' ELSE '' END AS partition_name,
               CASE WHEN p_partkey % 41 = 0 THEN 'no permission' END AS error,
               p_partkey AS n
        FROM {part}""",
    "files": """
        SELECT concat('/wh/', source, '/lang=', lang, '/', CAST(doc_id AS STRING)) AS path,
               n_chars * 28000 AS length
        FROM {documents}""",
    "plan": """
        SELECT concat('db.t', CAST(p_partkey AS STRING)) AS table_name,
               CASE p_partkey % 5 WHEN 0 THEN 'skip' WHEN 1 THEN 'manual' WHEN 2 THEN 'hive_ctas'
                                  WHEN 3 THEN 'ctas' ELSE 'migrate' END AS strategy,
               CASE WHEN p_partkey % 13 = 0 THEN 'MANAGED' ELSE 'EXTERNAL' END AS source_type,
               CASE WHEN p_partkey % 2 = 0 THEN 'Y' ELSE 'N' END AS approved,
               CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE 'CHG1' END AS writer_freeze_ticket,
               CASE WHEN p_partkey % 7 = 0 THEN 'N' ELSE 'Y' END AS schema_compatible,
               CASE WHEN p_partkey % 11 = 0 THEN '1' ELSE '2' END AS target_format_version,
               CASE WHEN p_partkey % 4 < 2 THEN 'Y' ELSE 'N' END AS compact,
               CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'a:int' WHEN 2 THEN 'a:int;b:STRING'
                                  WHEN 3 THEN 'a' WHEN 4 THEN 'a:bigint' ELSE 'a b:int' END AS cast_columns,
               CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'region' WHEN 2 THEN 'days(ts); region'
                                  WHEN 3 THEN 'bucket(16, id)' WHEN 4 THEN 'TRUNCATE(4,name)'
                                  WHEN 5 THEN 'bucket(0,id)' WHEN 6 THEN 'day(ts)'
                                  ELSE 'x) DROP' END AS target_partition_spec,
               CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '/data/t' WHEN 2 THEN 'hdfs://ns1/data/t'
                                  WHEN 3 THEN 'hdfs://other/data/t' WHEN 4 THEN 'data/t'
                                  ELSE 'hdfs://ns1' END AS target_location,
               CASE p_partkey % 8 WHEN 0 THEN 'db.t' WHEN 1 THEN 'db' WHEN 2 THEN 'db.t.x' WHEN 3 THEN 'db.t-1'
                                  WHEN 4 THEN '1db.t' WHEN 5 THEN 'db.' WHEN 6 THEN '_d._t1'
                                  ELSE concat('db.t', chr(10)) END AS typed_name,
               p_partkey AS n
        FROM {part}""",
    "names": "SELECT concat('db.t', CAST(s_suppkey * 50 AS STRING)) AS table_name FROM {supplier}",
    "journal": """
        SELECT concat('R', CAST(conv_id % 10 AS STRING)) AS run_id,
               concat('db.t', CAST(conv_id AS STRING)) AS table_name, turn AS seq,
               CASE turn % 5 WHEN 0 THEN 'STARTED' WHEN 1 THEN 'SANDBOX_CREATED'
                             WHEN 2 THEN 'SANDBOX_VALIDATED' WHEN 3 THEN 'CUTOVER_VALIDATED'
                             ELSE 'FAILED' END AS state
        FROM {conversations}""",
    "results": """
        SELECT concat('db.t', CAST(p_partkey AS STRING)) AS table_name,
               CASE p_partkey % 6 WHEN 0 THEN 'CUTOVER_VALIDATED' WHEN 1 THEN 'FAILED'
                                  WHEN 2 THEN 'VALIDATION_FAILED' WHEN 3 THEN 'AUTO_ROLLED_BACK'
                                  WHEN 4 THEN 'MANUAL_ACTION_REQUIRED' ELSE 'SKIPPED' END AS status
        FROM {part}""",
}

_INPUT = re.compile(r"\{(\w+)\}")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived input built from the given ones."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = FIXTURES[name]
    inputs = {used: load(spark, sf_dir, used) for used in set(_INPUT.findall(text))}
    return spark.sql(text, **inputs)


def as_sql(text: str) -> str:
    """The same text for a plain SQL engine: inputs become table names or subqueries."""
    return _INPUT.sub(
        lambda m: m[1] if m[1] in TABLES else f"({as_sql(FIXTURES[m[1]])})", text
    )
