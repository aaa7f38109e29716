"""Catalog assembly, FK levels on the star schema, relationship-map traps."""

from pyspark.sql import functions as F

from procweave.operators import catalog as C
from procweave.operators import relmap as RM
from procweave.operators import traversal as TR  # noqa: F401

COLS = "table_schema string, table_name string, column_name string, ordinal int, data_type string, char_len int, " \
       "num_precision int, num_scale int, is_nullable string, column_default string, comment string"
KEYS = "constraint_name string, constraint_type string, table_schema string, table_name string, column_name string, " \
       "ordinal int, ref_schema string, ref_table string, ref_column string, delete_rule string, update_rule string"


def test_type_text_dialects(spark):
    df = spark.createDataFrame([
        ("s", "t", "a", 1, "varchar", 10, None, None, "YES", None, None),
        ("s", "t", "b", 2, "numeric", None, 10, 0, "NO", None, None),
        ("s", "t", "c", 3, "numeric", None, 10, 2, "NO", None, None),
        ("s", "t", "d", 4, "NUMBER", None, None, 0, "NO", None, None)], COLS)
    got = {d: [r[0] for r in df.select(C.type_text(d)).collect()] for d in ("postgresql", "mssql", "oracle")}
    assert got["postgresql"] == ["varchar(10)", "numeric(10)", "numeric(10,2)", "NUMBER"]
    assert got["mssql"] == ["varchar(10)", "numeric(10,0)", "numeric(10,2)", "NUMBER"]
    assert got["oracle"][3] == "NUMBER"


def test_ddl_and_composite_fk(spark):
    cols = spark.createDataFrame([
        ("s", "orders", "id", 1, "integer", None, None, None, "NO", None, None),
        ("s", "orders", "cust_a", 2, "integer", None, None, None, "YES", None, None),
        ("s", "orders", "cust_b", 3, "integer", None, None, None, "YES", "0", None)], COLS)
    keys = spark.createDataFrame([
        ("pk_o", "PRIMARY KEY", "s", "orders", "id", 1, None, None, None, None, None),
        ("fk_c", "FOREIGN KEY", "s", "orders", "cust_a", 1, "s", "cust", "a", "NO_ACTION", "CASCADE"),
        ("fk_c", "FOREIGN KEY", "s", "orders", "cust_b", 2, "s", "cust", "b", "NO_ACTION", "CASCADE")], KEYS)
    fks = C.foreign_keys(keys).collect()
    assert [(r["columns"], r["referenced_columns"], r["on_delete"]) for r in fks] == [("cust_a, cust_b", "a, b", "NO ACTION")]
    assert len(C.foreign_keys(keys, compat=True).collect()) == 1
    assert C.foreign_keys(keys, compat=True).first()["columns"].count(",") == 3  # 2x2 pairs: rows multiply
    ddl = C.table_ddl(C.assemble_columns(cols, keys), C.foreign_keys(keys)).first()["ddl"]
    assert ddl == ("CREATE TABLE s.orders (\n    id integer NOT NULL,\n    cust_a integer,\n    cust_b integer DEFAULT 0"
                   "\n,\n    PRIMARY KEY (id)\n,\n    CONSTRAINT fk_c FOREIGN KEY (cust_a, cust_b) REFERENCES s.cust (a, b)"
                   " ON DELETE NO ACTION ON UPDATE CASCADE\n\n);")


def test_star_schema_levels(spark):
    fk = [("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"),
          ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier")]
    tables = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
    nodes = spark.createDataFrame([(t,) for t in tables], "node string")
    e = spark.createDataFrame(fk, "src string, dst string")
    got = {r["node"]: r["level"] for r in TR.dependency_levels(nodes, e).collect()}
    assert got == {"region": 0, "nation": 1, "customer": 2, "supplier": 2, "part": 0, "orders": 3, "lineitem": 4}
    referenced = {d for _, d in fk}
    compat = {t: (1 if t in referenced else 0) for t in tables}
    assert compat == {"region": 1, "nation": 1, "customer": 1, "supplier": 1, "part": 1, "orders": 1, "lineitem": 0}


def test_fk_target_resolution(spark):
    fks = spark.createDataFrame([("s", "a", "fk1", "x", "public.users", "id"), ("s", "b", "fk2", "x", "users", "id")],
                                "table_schema string, table_name string, constraint_name string, columns string, "
                                "referenced_table string, referenced_columns string")
    tables = spark.createDataFrame([("app.users",), ("s.a",), ("s.b",)], "table string")
    got = {r["src"]: r["dst"] for r in C.resolve_fk_targets(fks, tables).collect()}
    assert got == {"s.a": "app.users", "s.b": "app.users"}
    lit = {r["src"]: r["dst"] for r in C.resolve_fk_targets(fks, tables, compat=True).collect()}
    assert lit == {"s.a": "app.users"}   # undotted target not resolved in the literal mode


def test_relmap_traps(spark):
    objs = spark.createDataFrame([
        ("X", "tables", "ORDERS", 'CREATE TABLE ORDERS (C NUMBER, CONSTRAINT F FOREIGN KEY (C) REFERENCES "X"."CUSTOMERS" (ID))'),
        ("X", "tables", "CUSTOMERS", "CREATE TABLE CUSTOMERS (ID NUMBER)"),
        ("X", "procedures", "PURGE", "CREATE PROCEDURE PURGE AS BEGIN DELETE FROM ORDERS; END;"),
        ("X", "triggers", "T1", "CREATE OR REPLACE TRIGGER T1 BEFORE INSERT ON ORDERS BEGIN NULL; END;"),
        ("X", "triggers", "T2", "CREATE TRIGGER T2 BEFORE INSERT ON CUSTOMERS BEGIN NULL; END;"),
    ], "schema string, obj_type string, name string, ddl string")
    rels = RM.relations(objs)
    got = sorted((r["source"], r["target"], r["type"]) for r in rels.collect())
    # quoted schema: \w+ stops at the quote, captures X which is no object -> dropped
    assert ("ORDERS", "CUSTOMERS", "FOREIGN_KEY") not in got
    # DELETE FROM also matches FROM
    assert ("PURGE", "ORDERS", "DELETE_FROM") in got and ("PURGE", "ORDERS", "SELECT_FROM") in got
    # CREATE OR REPLACE TRIGGER never matches CREATE\s+TRIGGER
    assert ("T2", "CUSTOMERS", "TRIGGER_ON") in got and not any(s == "T1" for s, _, _ in got)
    deg = RM.degrees(objs, rels)
    assert {r["name"] for r in RM.isolated(deg).collect()} == {"T1"}
    counts = {r["obj_type"]: r["count"] for r in RM.object_counts(objs).collect()}
    assert counts["tables"] == 2 and counts["triggers"] == 2 and counts["views"] == 0 and counts["total"] == 5


def test_markdown_report_structure(spark):
    from procweave.sinks import reports as RP
    objs = spark.createDataFrame([
        ("X", "tables", "A", "CREATE TABLE A (ID NUMBER)"),
        ("X", "views", "V", "CREATE VIEW V AS SELECT * FROM A"),
        ("X", "sequences", "S", "CREATE SEQUENCE S"),
    ], "schema string, obj_type string, name string, ddl string")
    rels = RM.relations(objs)
    lines = [r["line"] for r in RP.markdown_report(objs, rels, RM.degrees(objs, rels), "2024-01-01 00:00:00")
             .orderBy("section", "sort_key").collect()]
    text = "\n".join(lines)
    assert text.startswith("# Mapa de Relacionamentos - Schema: X\n\n**Gerado em:** 2024-01-01 00:00:00")
    assert "- **Total de objetos:** 3\n- **Total de relacionamentos:** 2" in text
    assert "| Tables | 1 |" in lines and "| Views | 1 |" in lines and "| Constraints | 0 |" in lines
    assert "| A | 1 |" in lines                       # most referenced (distinct pairs)
    assert "\n### Objetos Isolados (1)\n" in lines and "S" in lines
    assert "| SELECT_FROM | 1 |" in lines and "| VIEW_DEPENDS | 1 |" in lines
    assert "| V | SELECT_FROM | A |" in lines


def test_index_definition_parsing(spark):
    defs = spark.createDataFrame([("CREATE UNIQUE INDEX ix_a ON s.t USING btree (\"Col A\", col_b)",),
                                  ("CREATE INDEX ix_b ON s.t USING btree (col_c)",)], "indexdef string")
    rows = C.index_columns_from_definition(defs).collect()
    assert [(r["columns"], r["is_unique"]) for r in rows] == [(["Col A", "col_b"], True), (["col_c"], False)]


def test_crawl_table_columns_and_field_source_caps(spark):
    from procweave.operators import lineage as LN
    calls = spark.createDataFrame([("A", "B")], "src string, dst string")
    tabs = spark.createDataFrame([("A", "S.T1"), ("B", "S.T2")], "src string, dst string")
    cols = spark.createDataFrame([("S.T1", "X"), ("S.T1", "Y")], "table string, column_name string")
    got = {r["node"]: r["columns"] for r in TR.crawl(calls, spark.createDataFrame([("A",)], "root string"), 5, tabs, cols)
           .filter("node_type = 'table'").collect()}
    assert got == {"S.T1": 2, "S.T2": 0}
    usage = spark.createDataFrame([(f"P{i:02d}", "F", "read" if i < 10 else "write") for i in range(12)],
                                  "proc string, field string, operation string")
    assert LN.sources(usage).count() == 2
    assert LN.sources(usage, max_results=10, compat=True).count() == 0   # cut before the write test


def test_relmap_schema_qualified_mode(spark):
    objs = spark.createDataFrame([
        ("X", "tables", "ORDERS", 'CREATE TABLE ORDERS (C NUMBER REFERENCES "X"."CUSTOMERS" (ID))'),
        ("X", "tables", "CUSTOMERS", "CREATE TABLE CUSTOMERS (ID NUMBER)"),
        ("X", "views", "V", "CREATE VIEW V AS SELECT * FROM X.ORDERS JOIN CUSTOMERS ON 1 = 1"),
    ], "schema string, obj_type string, name string, ddl string")
    literal = {(r["source"], r["target"], r["type"]) for r in RM.relations(objs).collect()}
    qualified = {(r["source"], r["target"], r["type"]) for r in RM.relations(objs, compat=False).collect()}
    assert ("ORDERS", "CUSTOMERS", "FOREIGN_KEY") not in literal
    assert ("ORDERS", "CUSTOMERS", "FOREIGN_KEY") in qualified
    assert ("V", "ORDERS", "SELECT_FROM") in qualified and ("V", "ORDERS", "SELECT_FROM") not in literal
    assert ("V", "CUSTOMERS", "JOIN") in literal and ("V", "CUSTOMERS", "JOIN") in qualified


def test_placeholder_ddl(spark):
    cols = spark.createDataFrame([("s", "t", "a", 1, "integer", None, None, None, "NO", None, None)], COLS)
    keys = spark.createDataFrame([], KEYS)
    ddl = C.table_ddl(C.assemble_columns(cols, keys), C.foreign_keys(keys), style="placeholder").first()["ddl"]
    assert ddl == "-- DDL para s.t\n-- (Reconstruído a partir de metadados)"


def test_key_marks_of_a_column(spark):
    cols = spark.createDataFrame([("s", "t", c, i) for i, c in enumerate("abcde")], "table_schema string, table_name string, column_name string, ordinal int")
    cols = cols.selectExpr("*", "'integer' AS data_type", "CAST(NULL AS INT) AS char_len", "CAST(NULL AS INT) AS num_precision",
                           "CAST(NULL AS INT) AS num_scale", "'NO' AS is_nullable", "CAST(NULL AS STRING) AS column_default")
    keys = spark.createDataFrame(
        [("PK", "PRIMARY KEY", "a", None, None, None), ("PK", "PRIMARY KEY", "b", None, None, None), ("F2", "FOREIGN KEY", "b", "s", "y", "k2"),
         ("F1", "FOREIGN KEY", "b", "s", "x", "k1"), ("F3", "FOREIGN KEY", "c", None, "z", None), ("U", "UNIQUE", "d", None, None, None)],
        "constraint_name string, constraint_type string, column_name string, ref_schema string, ref_table string, ref_column string")
    keys = keys.selectExpr("*", "'s' AS table_schema", "'t' AS table_name")
    got = {r.column_name: (r.is_primary_key, r.is_foreign_key, r.foreign_key_table, r.foreign_key_column)
           for r in C.assemble_columns(cols, keys).collect()}
    assert got == {"a": (True, False, None, None), "b": (True, True, "s.x", "k1"), "c": (False, True, "z", None),
                   "d": (False, False, None, None), "e": (False, False, None, None)}
    assert C.assemble_columns(cols, keys.limit(0)).filter("is_primary_key or is_foreign_key").count() == 0
