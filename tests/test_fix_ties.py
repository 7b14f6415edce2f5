"""Fixes that stand at the same place of a site: the first text is the same however the table is split."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from pagegauge.operators import sites
from pagegauge.plans import ORACLE, QUERIES

_SCHEMA = "site int, factor_id string, description string, layer string, points int, ord int"


def test_the_least_of_equals_is_the_first(spark):
    head = "x" * 50
    rows = [(1, "f", head + text, "access", 5, 1) for text in ("two", "one", "three")]
    for n in (1, 3):
        fixes = spark.createDataFrame(rows, _SCHEMA).repartition(n)
        assert sites.priority_fixes(fixes, "site", ("ord",)).first()["description"] == head + "one"


def test_the_row_that_stands_first_in_the_table_counts(spark, tmp_path):
    row = "CAST(7 AS BIGINT) AS l_orderkey, CAST(3 AS BIGINT) AS l_suppkey, 1 AS l_linenumber, CAST(10 AS DOUBLE) AS l_quantity, 'R' AS l_returnflag"
    lines = spark.sql(f"SELECT id, {row}, CASE WHEN id = 0 THEN 'O' ELSE 'F' END AS l_linestatus FROM range(1000)").coalesce(1).sortWithinPartitions("id").drop("id")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    (want,) = con.execute(ORACLE["a6_priority_fixes"]).fetchall()
    got = QUERIES["a6_priority_fixes"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [want] and " O " in want[2]
