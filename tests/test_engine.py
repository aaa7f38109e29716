"""The tool API (X1) over a small corpus and catalog."""

import pytest
from pyspark.sql import functions as F

from procweave.operators import catalog as C
from procweave.plans.engine import Engine

PROCS = [
    ("APP.MAIN_PROC", "CREATE PROCEDURE main_proc AS BEGIN sub_proc(1); SELECT o.status FROM orders o; END;"),
    ("APP.SUB_PROC", "CREATE PROCEDURE sub_proc(p IN NUMBER) AS BEGIN UPDATE orders SET status = p WHERE id = 1; END;"),
]
COLS = "table_schema string, table_name string, column_name string, ordinal int, data_type string, char_len int, " \
       "num_precision int, num_scale int, is_nullable string, column_default string, comment string"


@pytest.fixture(scope="module")
def engine(spark):
    procs = spark.createDataFrame(PROCS, "name string, source_code string")
    cols = spark.createDataFrame([("APP", "ORDERS", "STATUS", 1, "varchar", 10, None, None, "YES", None, None),
                                  ("APP", "ORDERS", "ID", 2, "integer", None, None, None, "NO", None, None)], COLS)
    docs = spark.createDataFrame([("APP.MAIN_PROC", "procedure", "main", [1.0, 0.0]), ("APP.SUB_PROC", "procedure", "sub", [0.0, 1.0]),
                                  ("APP.ORDERS", "table", "orders", [0.7, 0.7])],
                                 "node_id string, node_type string, text string, embedding array<float>")
    nums = spark.range(50).withColumn("v", F.col("id") % 7)
    return Engine(spark, procedures=procs, catalog={"columns": cols}, documents=docs, tables={"nums": nums})


def test_procedure_and_crawl(engine):
    rows = engine.query_procedure("main_proc".upper(), include_callers=True).collect()
    rels = {(r["rel"], r["target"]) for r in rows}
    assert ("called_procedures", "APP.SUB_PROC") in rels and ("called_tables", "APP.ORDERS") in rels
    crawl = {(r["node"], r["depth"]) for r in engine.crawl_procedure("MAIN_PROC").collect()}
    assert ("APP.SUB_PROC", 1) in crawl and ("APP.ORDERS", 1) in crawl


def test_field_tools(engine):
    usage = engine.analyze_field("status").filter("part = 'usage'").collect()
    assert {(r["proc"], r["operation"]) for r in usage} == {("APP.MAIN_PROC", "read"), ("APP.SUB_PROC", "write")}
    trace = engine.trace_field_flow("status", "MAIN_PROC").collect()
    kinds = {(r["kind"], r["procedure"]) for r in trace}
    assert ("source", "APP.SUB_PROC") in kinds and ("destination", "APP.MAIN_PROC") in kinds


def test_query_tools(engine):
    assert engine.execute_query("SELECT id FROM nums", limit=3).count() == 3
    assert engine.sample_table_data("nums", limit=5).count() == 5
    stats = engine.get_field_statistics("nums", "v").first()
    assert (stats["total_count"], stats["distinct_count"]) == (50, 7)
    assert '"success": true' in Engine.to_json(engine.execute_query("SELECT 1 AS x"))


def test_search_tools(engine):
    hits = engine.semantic_search_procedures([1.0, 0.0], top_k=5, threshold=0.0).collect()
    assert [r["node_id"] for r in hits] == ["APP.MAIN_PROC"]      # threshold 0 keeps cos >= 0.5 only
    tables = engine.semantic_search_tables([1.0, 0.0], top_k=5, threshold=-5.0).collect()
    assert [r["node_id"] for r in tables] == ["APP.ORDERS"]        # out-of-range threshold -> 0.0
    hyb = engine.hybrid_search([1.0, 0.0], top_k=1).collect()
    assert {r["edge_type"] for r in hyb} == {"calls", "accesses"}


def test_catalog_helpers(spark):
    cols = spark.createDataFrame([("APP", "ORDERS", "STATUS", 1, "varchar", 10, None, None, "YES", None, None)], COLS)
    assert C.field_definition(cols, "ORDERS", "status").count() == 1
    assert C.limit_entities(spark.createDataFrame([("b",), ("a",)], "name string"), 1).first()["name"] == "a"
