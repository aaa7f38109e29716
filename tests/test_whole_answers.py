"""Whole answers (no silent cuts), resolved table names, reader texts and shapes, session settings left alone."""

import re

import pytest
from pyspark.sql import functions as F

from procweave.functions import extract as X
from procweave.operators import cache as CA
from procweave.operators import catalog as C
from procweave.operators import graph as G
from procweave.operators import lineage as LN
from procweave.operators import model_steps as L
from procweave.operators import vector as V
from procweave.plans.engine import Engine
from procweave.sinks import reports as RP
from procweave.sources import jdbc as J


def test_long_signature_is_read_whole(spark):
    params = ", ".join(f"p_long_parameter_name_{i} IN NUMBER" for i in range(30))
    df = spark.createDataFrame([(f"CREATE PROCEDURE p ({params}) AS BEGIN NULL; END;",)], "code string")
    got = df.select(F.size(X.signature_parameters("code")).alias("all"), F.size(X.signature_parameters("code", max_chars=500)).alias("cut")).first()
    assert (got["all"], got["cut"]) == (30, 0)
    long_context = "SELECT " + ", ".join(f"column_number_{i}" for i in range(30)) + " FROM t"
    ctx = spark.createDataFrame([(long_context,)], "code string").select(X.select_fields("code")[0]["context"].alias("c")).first()["c"]
    assert len(ctx) > 100


def test_documents_and_prompts_are_whole(spark):
    row = spark.range(1).select(
        F.lit("APP.P").alias("id"), F.lit("APP").alias("schema"), F.lit("P").alias("short_name"), F.lit("x" * 5000).alias("source_code"),
        F.array(*[F.struct(F.lit(f"p{i}").alias("name"), F.lit("IN").alias("direction"), F.lit("INT").alias("type")) for i in range(12)]).alias("parameters"),
        F.array(*[F.lit(f"C{i:02d}") for i in range(20)]).alias("calls"), F.array(*[F.lit(f"T{i:02d}") for i in range(20)]).alias("tables"),
        F.lit(3).alias("complexity_score"))
    text = V.code_document(row).first()["text"]
    assert "p11 IN INT" in text and "C19" in text and "T19" in text and text.endswith("x" * 5000)
    cut = V.code_document(row, 10, 15, 15, 2000).first()["text"]
    assert "p10" not in cut and "C15" not in cut and cut.endswith("...")
    assert row.select(L.prompt("complexity", code=F.col("source_code")).alias("p")).first()["p"].endswith("x" * 5000)


def test_model_and_encoder_batches_leave_the_session_alone(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    df = spark.createDataFrame([(f"p{i}",) for i in range(13)], "prompt string").coalesce(1)

    def client(prompts):
        assert len(prompts) <= 4
        return [p.upper() for p in prompts]

    out = L.call_model(df, client, batch_size=4)
    assert {r.response for r in out.collect()} == {f"P{i}" for i in range(13)} and spark.conf.get(key) == before

    def failing(prompts):
        if any(p == "p5" for p in prompts):
            raise ValueError("e" * 900)
        return list(prompts)

    errors = {r.prompt: r.error for r in L.call_model(df, failing, batch_size=4).collect() if r.error}
    assert errors == {"p5": "e" * 900}
    V.embed_with(df.withColumnRenamed("prompt", "text"), lambda t: [[1.0] * 4] * len(t), "text", 4, batch_size=3).collect()
    assert spark.conf.get(key) == before


def test_diagrams_open_with_the_init_block_and_are_whole(spark):
    procs = spark.createDataFrame([(f"P{i:03d}", 3, 0) for i in range(70)], "proc string, complexity_score int, level int")
    edges = spark.createDataFrame([("P000", "P001")], "src string, dst string")
    lines = RP.call_diagram(procs, edges).orderBy("section", "sort_key").collect()
    assert lines[0]["line"].startswith("```mermaid\n%%{init: {") and lines[0]["line"].endswith("}}%%\ngraph TD")
    assert sum(r["section"] == 1 for r in lines) == 70
    assert RP.call_diagram(procs, edges, 50).filter("section = 1").count() == 50
    assert RP.hierarchy_diagram(procs, edges).filter("section = 0").first()["line"] == lines[0]["line"]


def test_flowchart_ends_with_the_logic_text(spark):
    an = spark.createDataFrame([("P", 4, [], ["C"], ["T"], "Moves orders.")],
                               "proc string, complexity_score int, signature_parameters array<struct<name:string,type:string,direction:string,position:int>>, "
                               "calls array<string>, tables array<string>, business_logic string")
    levels = spark.createDataFrame([("P", 2)], "node string, level int")
    lines = [r["line"] for r in RP.flowcharts(an, levels).orderBy("section", "sort_key").collect()]
    assert lines[-1].endswith("## Lógica de Negócio\n\nMoves orders.\n") and any("Proc_C" in x for x in lines) and any("Table_T" in x for x in lines)


def test_late_mermaid_fence_is_rewritten(spark):
    doc = "# Title\n" + "text " * 100 + "\n```mermaid\nerDiagram\n  A ||--o{ B : x\n```\n"
    row = RP.add_mermaid_init(spark.createDataFrame([(doc,)], "content string")).first()
    assert row["updated"] and "%%{init:" in row["new_content"]


def test_source_priority_keeps_the_chosen_row(spark):
    cache = spark.createDataFrame([("A", "from cache")], "name string, code string")
    files = spark.createDataFrame([("A", "from file", 1), ("B", "file b", 2)], "name string, code string, size int")
    got = {r["name"]: (r["source"], r["code"], r["size"]) for r in CA.prefer_sources([("cache", cache), ("file", files)]).collect()}
    assert got == {"A": ("cache", "from cache", None), "B": ("file", "file b", 2)}
    ties = spark.createDataFrame([("u", 5, "a"), ("u", 5, "b"), ("u", 4, "z")], "k string, ts int, v string")
    assert CA.keep_latest(ties, "k", "ts").first()["v"] == "b"


def test_table_sources_of_a_schema_qualified_catalog(spark):
    procs = spark.createDataFrame([("P1", "S", "CREATE PROCEDURE p1 AS BEGIN SELECT status FROM t_1; END;")], "name string, schema string, source_code string")
    columns = spark.createDataFrame([("app", "t_1", "Status", 1), ("ops", "t_1", "id", 1)], "table_schema string, table_name string, column_name string, ordinal int")
    for c, v in (("data_type", "varchar"), ("is_nullable", "YES"), ("column_default", None), ("comment", None)):
        columns = columns.withColumn(c, F.lit(v).cast("string"))
    for c in ("char_len", "num_precision", "num_scale"):
        columns = columns.withColumn(c, F.lit(None).cast("int"))
    engine = Engine(spark, procs, {"columns": columns})
    rows = engine.trace_field_flow("status", "P1").filter("operation = 'read_from_table'").collect()
    assert [r["detail"] for r in rows] == ["app.t_1 (table)"]
    # a catalog without key rows answers too; each column once
    info = engine.query_table("app.t_1").filter("kind = 'column'").collect()
    assert len(info) == 1 and info[0]["value"].startswith("Status varchar")
    parts = engine.analyze_field("status", table="app.t_1").collect()
    assert {r["part"] for r in parts} >= {"usage", "definition"}
    assert [r["context"] for r in parts if r["part"] == "definition"] == ["app.t_1 varchar"]
    assert not [r for r in engine.analyze_field("status", table="ops.t_1").collect() if r["part"] == "definition"]


def test_envelope_says_when_rows_are_left_out(spark):
    import json

    out = json.loads(Engine.to_json(spark.range(5), max_rows=3))
    assert out["success"] and len(out["data"]) == 3 and out["truncated"]
    assert not json.loads(Engine.to_json(spark.range(3), max_rows=3))["truncated"]


def test_names_in_many_schemas_resolve_to_one(spark):
    tables = spark.createDataFrame([(f"S{i:03d}.T",) for i in range(200)] + [("A.U",)], "table string")
    fks = spark.createDataFrame([("X", f"C{i}", "S150.T" if i % 2 else "ZZ.T", f"fk{i}", "a", "b") for i in range(40)],
                                "table_schema string, table_name string, referenced_table string, constraint_name string, columns string, referenced_columns string")
    got = C.resolve_fk_targets(fks, tables)
    assert {(r["src"], r["dst"]) for r in got.collect()} == {("X.C%d" % i, "S150.T" if i % 2 else "S000.T") for i in range(40)}
    nodes = tables.select(F.col("table").alias("id"), F.lit("table").alias("node_type"), F.split("table", r"\.")[0].alias("schema"), F.split("table", r"\.")[1].alias("name"))
    names = spark.createDataFrame([("T",), ("a.u",), ("none",)], "name string")
    assert {(r["name"], r["resolved_id"]) for r in G.resolve_names(names, nodes, "table", ignore_case=True).collect()} == {("T", "S000.T"), ("a.u", "A.U")}


def test_neighbours_are_listed_whole(spark):
    edges = spark.createDataFrame([("H", f"N{i:02d}", "calls") for i in range(30)], "src string, dst string, edge_type string")
    ids = spark.createDataFrame([("H",)], "node_id string")
    assert V.neighbours(edges, ids).count() == 30 and {r["n_neighbours"] for r in V.neighbours(edges, ids, 10).collect()} == {30}
    assert V.neighbours(edges, ids, 10).count() == 10


def test_reader_texts():
    assert "LISTAGG" not in J.ORACLE.procedures and "type = 'PROCEDURE'" in J.ORACLE.procedures
    assert "prokind = 'p'" in J.POSTGRESQL.procedures and "JOIN pg_namespace n ON n.oid = p.pronamespace " in J.POSTGRESQL.procedures
    assert "LEFT JOIN" not in J.POSTGRESQL.procedures
    assert "ROUTINE_TYPE = 'PROCEDURE'" in J.MSSQL.procedures and "ROUTINE_TYPE = 'PROCEDURE'" in J.MYSQL.procedures
    assert "sys.foreign_key_columns" in J.MSSQL.keys and "position_in_unique_constraint" not in J.MSSQL.keys
    assert len(re.findall(r"SUM\(", J.MSSQL.stats)) == 2 and J.MSSQL.stats.count("GROUP BY") == 2
    assert "= DATABASE()" in J.MYSQL.sql("procedures", None) and "= 'shop'" in J.MYSQL.sql("procedures", "shop")
    for what in ("objects", "ddl"):
        text = J.ORACLE.sql(what, "APP")
        assert "'indexes'" in text and "'constraints'" in text and text.count("= 'APP'") == 2


def test_reader_shapes(spark):
    lines = spark.createDataFrame([("S", "P", i, f"line {i}\n") for i in (3, 1, 2)], "schema string, name string, line int, text string")
    assert J.procedure_keys(J.join_source_lines(lines), "oracle").first()["source_code"] == "line 1\nline 2\nline 3\n"
    defs = spark.createDataFrame([("s", "t", "pk_t", 'CREATE UNIQUE INDEX pk_t ON s.t USING btree (id, "Name")')],
                                 "table_schema string, table_name string, index_name string, indexdef string")
    rows = J.catalog_shapes({"indexes": defs}, "postgresql")["indexes"]
    keys = spark.createDataFrame([("s", "t", "pk_t", "PRIMARY KEY")], "table_schema string, table_name string, constraint_name string, constraint_type string")
    index = C.assemble_indexes(rows, keys).first()
    assert (index["columns"], index["is_unique"], index["is_primary"], index["index_type"]) == ("id, Name", True, True, "btree")
    procs = spark.createDataFrame([("Sales.Load",), ("Load2",)], "name string")
    assert J.find_in_database(procs, "LOAD").count() == 1


def test_field_sources_name_tables(spark):
    usage = spark.createDataFrame([("P", "STATUS", "write", "update", None, None)],
                                  "proc string, field string, operation string, kind string, context string, transformation string")
    columns = spark.createDataFrame([("app", "t", "status")], "table_schema string, table_name string, column_name string")
    assert {(r["source_type"], r["name"]) for r in LN.sources(usage, columns).collect()} == {("procedure", "P"), ("table", "app.t")}


def test_field_usage_reads_the_corpus_once(spark, sf_small):
    from procweave.plans.queries import QUERIES

    for key, most in (("field_usage", 1), ("graph_nodes", 1)):
        plan = QUERIES[key](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") <= most, key


@pytest.mark.parametrize("limit", [0, -3])
def test_limits_are_refused_not_changed(spark, limit):
    from procweave.operators import profile as PR

    with pytest.raises(ValueError):
        PR.sample_rows(spark.range(5), limit=limit)
    assert PR.sample_rows(spark.range(300), limit=200).count() == 200


def test_field_nodes_belong_to_their_tables(spark):
    columns = spark.createDataFrame([("app", "t", "id", "int", True, False), ("app", "t", "name", "text", False, False), ("ops", "u", "id", "int", True, False)],
                                    "table_schema string, table_name string, column_name string, data_type string, is_primary_key boolean, is_foreign_key boolean")
    nodes, edges = G.field_graph(columns)
    assert {r["id"] for r in nodes.collect()} == {"app.t.id", "app.t.name", "ops.u.id"}
    got = {(r["field"], r["relationship"], r["target"]) for r in G.field_relationships(nodes, edges, "id").collect()}
    assert got == {("id", "field_of_table", "app.t"), ("id", "field_of_table", "ops.u")}
    an = spark.createDataFrame([("P", "S", "P", "S.P", ["Q"], ["T"], 1)],
                               "proc string, schema string, short_name string, id string, calls array<string>, tables array<string>, complexity_score int")
    all_nodes, all_edges = G.build_graph(an, columns=columns)
    assert all_nodes.filter("node_type = 'field'").count() == 3 and all_edges.filter("edge_type = 'belongs_to'").count() == 3
