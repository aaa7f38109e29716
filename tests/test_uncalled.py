"""Functions that the queries do not reach: readers as SQL, stores, exports, sections."""

import json

from pyspark.sql import functions as F

from procweave.operators import lineage as LN
from procweave.operators import model_steps as L
from procweave.operators import vector as V
from procweave.plans import jobs
from procweave.sinks import reports as RP
from procweave.sources import jdbc, stores


def test_readers_ask_their_dialect(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(jdbc, "read_query", lambda spark, url, query, options=None, session_init=None: asked.append((query, options, session_init)))
    jdbc.list_objects(spark, "jdbc:x", "oracle", "APP")
    assert "all_objects" in asked[0][0] and asked[0][0].count("= 'APP'") == 2 and asked[0][1]["driver"].startswith("oracle")
    jdbc.read_ddl(spark, "jdbc:x", "oracle")
    assert "GET_DDL" in asked[1][0] and "SET_TRANSFORM_PARAM" in asked[1][2]
    monkeypatch.setattr(jdbc, "DIALECTS", dict(jdbc.DIALECTS))
    jdbc.register_dialect(jdbc.Dialect(name="own", driver="d", default_schema_dropped=None, procedures="", columns="", keys="", indexes="", tables="",
                                       extra={"objects": "SELECT 1 WHERE s {schema_cond}"}))
    assert "own" in jdbc.available_dialects()
    jdbc.list_objects(spark, "jdbc:x", "own")
    assert asked[2][0] == "SELECT 1 WHERE s IS NOT NULL" and asked[2][1] == {"driver": "d"}


def test_postgresql_falls_back_to_the_routine_text():
    text = jdbc.DIALECTS["postgresql"].sql("procedures", "app")
    assert "COALESCE(NULLIF(pg_get_functiondef(p.oid), ''), (SELECT r.routine_definition FROM information_schema.routines r " in text
    assert "r.specific_name = p.proname || '_' || p.oid" in text and text.endswith("n.nspname = 'app'")
    assert "schemata" in jdbc.DIALECTS["postgresql"].sql("schemas", None)
    assert "NOT IN" not in jdbc.DIALECTS["mysql"].sql("columns", "s")


def test_schemas_for_the_message(spark):
    tables = spark.createDataFrame([("app", "t"), ("app", "u"), ("hr", "v")], "table_schema string, table_name string")
    schemas = spark.createDataFrame([("app",), ("empty",), ("a_new",)], "table_schema string")
    assert [r[0] for r in jdbc.schemas_with_tables(tables).collect()] == ["app", "hr"]
    assert [tuple(r) for r in jdbc.schema_overview(tables, schemas).collect()] == [("app", 2), ("hr", 1), ("a_new", 0), ("empty", 0)]
    assert jdbc.missing_schema_message(tables, schemas, "empty") == "no tables found in schema 'empty'; schemas with tables: app, hr"
    assert jdbc.missing_schema_message(tables.limit(0), schemas, "x") == (
        "no tables found in schema 'x'; schemas without tables: a_new, app, empty; schema 'x' does not exist")
    assert "has no schemas" in jdbc.missing_schema_message(tables.limit(0), schemas.limit(0), "x")


def test_graph_documents_and_cleared_stores(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"metadata": {}, "nodes": [{"id": "a", "type": "table"}, {"id": "b", "type": "view"}],
                                                 "edges": [{"source": "b", "target": "a"}]}, indent=1))
    nodes, edges = stores.load_graph_json(spark, str(tmp_path / "g.json"))
    assert {r.id for r in nodes.collect()} == {"a", "b"} and [tuple(r) for r in edges.select("source", "target").collect()] == [("b", "a")]
    stores.save_graph(nodes, edges, str(tmp_path / "s"))
    stores.clear_graph(spark, str(tmp_path / "s"), "id string", "source string, target string")
    nodes, edges = stores.load_graph(spark, str(tmp_path / "s"))
    assert nodes.count() == edges.count() == 0


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    out = str(tmp_path / "p")
    RP.export_partitioned(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), out, "k")
    RP.export_partitioned(spark.createDataFrame([("b", 3)], "k string, v int"), out, "k")
    assert {(r.k, r.v) for r in spark.read.json(out).collect()} == {("a", 1), ("b", 3)}


def test_dependencies_united(spark):
    rows = spark.createDataFrame([(["A", "B"], ["B", "C"]), (["A"], None), ([], ["X"])], "r array<string>, l array<string>")
    assert [sorted(x[0]) for x in rows.select(L.union_dependencies(F.col("r"), F.col("l"))).collect()] == [["A", "B", "C"], ["A"], ["X"]]


def test_export_sections(spark):
    procs = spark.createDataFrame([("A", None, "CREATE PROCEDURE A AS BEGIN EXEC B; END;"), ("B", None, "CREATE PROCEDURE B AS BEGIN NULL; END;")],
                                  "name string, schema string, source_code string")
    metrics = spark.createDataFrame([("1", "x", 10, 5, 15, True), ("2", "x", 20, 5, 25, False)],
                                    "request_id string, operation string, tokens_in long, tokens_out long, tokens_total long, use_toon boolean")
    assert "token_totals" not in jobs.analyze_procedures(procs)
    sections = jobs.analyze_procedures(procs, metrics)
    assert sections["token_totals"].first().total_tokens == 40 and sections["token_requests"].count() == 2
    assert sections["token_comparison"].first().overall_savings_percent == 40.0
    assert [tuple(r) for r in sections["hierarchy"].collect()] == [(0, "B"), (1, "A")]
    objects = spark.createDataFrame([("S", "tables", "T", "CREATE TABLE T (ID NUMBER)"), ("S", "views", "V", "CREATE VIEW V AS SELECT * FROM T"),
                                     ("S", "tables", "LONE", "CREATE TABLE LONE (ID NUMBER)")], "schema string, obj_type string, name string, ddl string")
    found = jobs.relationship_map(objects, "2024-01-01")
    assert found["top_referenced"].where("rank = 1").first().name == "T" and found["top_referencing"].where("rank = 1").first().name == "V"
    assert [r.name for r in found["isolated"].collect()] == ["LONE"] and found["relations_by_type"].count() >= 1


def test_previews(spark):
    rows = spark.createDataFrame([("x" * 200,), ("y" * 201,), ("",), (None,)], "t string").select(V.preview("t").alias("p")).collect()
    assert [r.p for r in rows] == ["x" * 200, "y" * 200 + "...", "", None]


def test_fields_traced_together_equal_single_traces(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("B", "X")], "src string, dst string")
    usage = spark.createDataFrame([("A", "F", "read", "select", "c", None), ("B", "F", "write", "update", "c", None), ("C", "G", "transform", "transform", None, "UPPER(G)"),
                                   ("C", "F", "read", "select", "c", None), ("C", "F", "read", "select", "d", None)],
                                  "proc string, field string, operation string, kind string, context string, transformation string")
    columns = spark.createDataFrame([("s", "t", "f", "int"), ("s", "t", "g", "text")], "table_schema string, table_name string, column_name string, data_type string")
    access = spark.createDataFrame([("B", "s.t"), ("C", "s.t")], "src string, dst string")
    starts = spark.createDataFrame([("A",), ("C",)], "root string")
    for depth in (None, 1):
        many = LN.trace_fields(edges, usage, starts, depth, access, columns)
        for field in ("F", "G"):
            one = LN.trace(edges, usage, starts, field, depth, access, columns)
            got = many.where(F.col("field") == field)
            assert sorted(map(str, got.select(one.columns).collect())) == sorted(map(str, one.collect()))
    info = {r.column_info for r in many.where("operation = 'read_from_table' AND field = 'G'").collect()}
    assert info == {'{"data_type":"text"}'}
    only = LN.trace_fields(edges, usage, starts, None, access, columns, spark.createDataFrame([("g",)], "field string"))
    assert {r.field for r in only.collect()} == {"G"}
