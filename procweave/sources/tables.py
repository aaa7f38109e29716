"""Readers for the driver's Parquet tables and the corpora Spark derives from them.

The driver tables hold no procedure code, so code operators run on a derived
corpus: one procedure text per ``orders`` row, built by a SQL expression that
gives byte-identical text in Spark and in DuckDB. The work therefore grows
with ``orders``. Catalog operators run on a catalog derived from
``lineitem`` the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.session import spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: Rows of a table in one task of CPU-heavy work (a text and its regexes cost up to about a millisecond a row).
TASK_ROWS = 50_000


def read_table(spark: SparkSession, sf_dir: str, name: str, deal: bool = True) -> DataFrame:
    """One driver table; spread over all cores when it arrives as fewer splits
    than the default parallelism (each test file is a single row group) or as so
    few that a task would have more than :data:`TASK_ROWS` rows of text to work
    on. The dimension tables ``region`` and ``nation`` are left as they are, and with
    ``deal=False`` any table (light per-row work that reads single columns)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, TASK_ROWS) if deal and name not in ("region", "nation") else df


# Procedure text per orders row. Procedure n calls P(n/2) and, for status F,
# P(n/3): callees are always smaller, so the call graph is acyclic. The same
# expression runs unchanged in DuckDB, which is what the oracles use.
# Some procedures have a signature of over 500 characters (42 parameters) or a
# body of over 4,000, longer than any cut the analysed tool makes.
_MANY_PARAMETERS = "".join(f", p_extra_{i} IN NUMBER" for i in range(1, 41))
CORPUS_TEXT_SQL = (
    "'CREATE OR REPLACE PROCEDURE P' || CAST(o_orderkey AS VARCHAR(20)) || ' (p_id IN NUMBER, p_out OUT VARCHAR2' || "
    f"CASE WHEN o_orderkey % 97 = 5 THEN '{_MANY_PARAMETERS}' ELSE '' END || ') AS' || chr(10) || "
    "repeat(' NULL; -- step' || chr(10), CASE WHEN o_orderkey % 101 = 7 THEN 300 ELSE 0 END) || "
    "' v_total NUMBER;' || chr(10) || 'BEGIN' || chr(10) || "
    "CASE WHEN o_orderkey > 0 THEN ' CALL P' || CAST(CAST(FLOOR(o_orderkey/2.0) AS BIGINT) AS VARCHAR(20)) || '();' || chr(10) ELSE '' END || "
    "CASE WHEN o_orderkey > 2 AND o_orderstatus = 'F' THEN ' EXEC P' || CAST(CAST(FLOOR(o_orderkey/3.0) AS BIGINT) AS VARCHAR(20)) || ';' || chr(10) ELSE '' END || "
    "' SELECT o.status, UPPER(o.name) AS nm FROM T_' || substr(o_orderpriority,1,1) || ' o JOIN T_CUST c ON c.id = o.id;' || chr(10) || "
    "' UPDATE T_' || CAST(o_custkey % 7 AS VARCHAR(20)) || ' SET total = v_total, status = 1 WHERE id = p_id;' || chr(10) || "
    "repeat(' IF v_total > 0 THEN NULL; END IF;' || chr(10), CAST(o_orderkey % 5 AS INT)) || "
    "repeat(' LOOP EXIT; END LOOP;' || chr(10), CAST(o_orderkey % 3 AS INT)) || "
    "'EXCEPTION WHEN OTHERS THEN NULL;' || chr(10) || 'END;'"
)
CORPUS_NAME_SQL = "'P' || CAST(o_orderkey AS VARCHAR(20))"


def procedure_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``procedures(name, schema, source_code)`` derived from ``orders``.

    Names carry no schema, like file-loaded procedures, so ``schema`` is NULL
    and the qualified id becomes ``UNKNOWN.<name>``.
    """
    orders = read_table(spark, sf_dir, "orders")
    return orders.selectExpr(f"{CORPUS_NAME_SQL} AS name",
                             "CAST(NULL AS STRING) AS schema",
                             f"{CORPUS_TEXT_SQL} AS source_code")


def procedure_corpus_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus plus one back edge: P0 also calls the largest procedure.

    The extra call closes cycles through P0, which every procedure reaches.
    """
    base = procedure_corpus(spark, sf_dir)
    # scalar subquery: Spark evaluates it once and plugs the value in
    top = read_table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).scalar()
    return base.select(
        "name", "schema",
        F.when(F.col("name") == "P0",
               F.concat(F.col("source_code"), F.lit("\n CALL P"), top.cast("string"), F.lit("();")))
        .otherwise(F.col("source_code")).alias("source_code"))


#: Calls that close nested cycles with shared edges: every tenth procedure n also calls P(2n) and P(6n), from which
#: P(n) is reached again over one, two or three calls.
CYCLES_TEXT_SQL = (
    f"{CORPUS_TEXT_SQL} || CASE WHEN o_orderkey % 10 = 3 THEN chr(10) || ' CALL P' || CAST(o_orderkey * 2 AS VARCHAR(20)) || '();' || chr(10) || "
    "' CALL P' || CAST(o_orderkey * 6 AS VARCHAR(20)) || '();' ELSE '' END"
)


def procedure_corpus_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with many small components of nested cycles (:data:`CYCLES_TEXT_SQL`)."""
    return read_table(spark, sf_dir, "orders").selectExpr(f"{CORPUS_NAME_SQL} AS name", "CAST(NULL AS STRING) AS schema", f"{CYCLES_TEXT_SQL} AS source_code")


# ---------------------------------------------------------------- catalog
def catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with (l_orderkey, l_linenumber) made unique: keep the first row by
    (l_partkey, l_suppkey, l_quantity, l_extendedprice).

    A ``min(struct)`` aggregate instead of a ranking window: it combines
    map-side, so a key holding a third of all rows is pre-reduced before the
    shuffle instead of being sorted in one task. A query with several consumers
    writes these rows once and hands them to the ``catalog_*`` readers as ``lines``;
    each of them then reads the columns it needs. Equal rows in these columns are decided
    by the others in table order, as far as the last one that any reader uses.
    """
    li = read_table(spark, sf_dir, "lineitem")
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rest = [c for c in li.columns if c not in order + ["l_orderkey", "l_linenumber"]]
    used = ["l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    rest = rest[:max(rest.index(c) for c in used) + 1]
    best = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*order, *rest)).alias("b"))
    return best.select("l_orderkey", "l_linenumber", "b.*")


def catalog_columns(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """``information_schema.columns``-shaped rows, one per column.

    Table ``S<k % 5>.T<k>`` for ``l_orderkey`` k, column ``C<l_linenumber>``,
    type by ``l_linenumber % 4``: varchar(n), numeric(p,s), integer, date;
    nullable when ``l_linestatus = 'O'``.
    """
    li = catalog_lines(spark, sf_dir) if lines is None else lines
    t = F.col("l_linenumber") % 4
    return li.select(
        F.concat(F.lit("S"), (F.col("l_orderkey") % 5).cast("string")).alias("table_schema"),
        F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("table_name"),
        F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("column_name"),
        F.col("l_linenumber").cast("int").alias("ordinal"),
        F.when(t == 0, "varchar").when(t == 1, "numeric").when(t == 2, "integer").otherwise("date").alias("data_type"),
        F.when(t == 0, F.col("l_quantity").cast("int") + 1).cast("int").alias("char_len"),
        F.when(t == 1, F.lit(12)).cast("int").alias("num_precision"),
        F.when(t == 1, (F.col("l_partkey") % 3).cast("int")).cast("int").alias("num_scale"),
        F.when(F.col("l_linestatus") == "O", "YES").otherwise("NO").alias("is_nullable"),
        F.when(t == 2, F.lit("0")).cast("string").alias("column_default"),
        F.lit(None).cast("string").alias("comment"),
    )


def catalog_key_rows(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Key-constraint rows (constraints x key usage x referenced columns x rules).

    Line 1 of an order is the primary key ``PK_T<k>(C1)``; line 2 is a foreign
    key ``FK_T<k>(C2)`` to ``S<j % 5>.T<j>(C1)`` with ``j = floor(k / 2)``,
    which is missing when order j has no line items.
    """
    li = (catalog_lines(spark, sf_dir) if lines is None else lines).filter(F.col("l_linenumber").isin(1, 2))
    k = F.col("l_orderkey")
    j = F.floor(k / 2).cast("bigint")
    is_pk = F.col("l_linenumber") == 1
    return li.select(
        F.when(is_pk, F.concat(F.lit("PK_T"), k.cast("string"))).otherwise(F.concat(F.lit("FK_T"), k.cast("string"))).alias("constraint_name"),
        F.when(is_pk, "PRIMARY KEY").otherwise("FOREIGN KEY").alias("constraint_type"),
        F.concat(F.lit("S"), (k % 5).cast("string")).alias("table_schema"),
        F.concat(F.lit("T"), k.cast("string")).alias("table_name"),
        F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("column_name"),
        F.lit(1).cast("int").alias("ordinal"),
        F.when(~is_pk, F.concat(F.lit("S"), (j % 5).cast("string"))).alias("ref_schema"),
        F.when(~is_pk, F.concat(F.lit("T"), j.cast("string"))).alias("ref_table"),
        F.when(~is_pk, F.lit("C1")).alias("ref_column"),
        F.when(~is_pk, F.when(F.col("l_returnflag") == "R", "CASCADE").otherwise("NO_ACTION")).alias("delete_rule"),
        F.when(~is_pk, F.when(F.col("l_returnflag") == "A", "SET_NULL").otherwise("NO_ACTION")).alias("update_rule"),
    )


def catalog_index_rows(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Index-column rows: one index per (table, l_returnflag) over that flag's
    columns in ordinal order, unique for flag N. The flag-N index is named
    ``PK_T<k>_N`` so that the primary-key name test (P33) can mark it."""
    li = catalog_lines(spark, sf_dir) if lines is None else lines
    k = F.col("l_orderkey")
    return li.select(
        F.concat(F.lit("S"), (k % 5).cast("string")).alias("table_schema"),
        F.concat(F.lit("T"), k.cast("string")).alias("table_name"),
        F.when(F.col("l_returnflag") == "N", F.concat(F.lit("PK_T"), k.cast("string"), F.lit("_N")))
         .otherwise(F.concat(F.lit("IX_T"), k.cast("string"), F.lit("_"), F.col("l_returnflag"))).alias("index_name"),
        F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("column_name"),
        F.col("l_linenumber").cast("int").alias("position"),
        (F.col("l_returnflag") == "N").alias("is_unique"),
        F.lit("btree").alias("index_type"),
    )


# ---------------------------------------------------------------- DDL objects
# One DDL text per row of part / supplier / nation / region / customer, in the
# nine object kinds of a schema export. Names are upper case like Oracle's.
# Together they produce all twelve relation types; the SQL runs unchanged in
# DuckDB (oracles).
DDL_OBJECTS_SQL = {
    "tables": ("part", "'TB_' || CAST(p_partkey AS VARCHAR(20))",
               "'CREATE TABLE TB_' || CAST(p_partkey AS VARCHAR(20)) || ' (' || chr(10) || '  ID NUMBER PRIMARY KEY,' || chr(10) || "
               "'  PARENT_ID NUMBER REFERENCES TB_' || CAST(CAST(FLOOR(p_partkey / 2.0) AS BIGINT) AS VARCHAR(20)) || '(ID),' || chr(10) || "
               "'  SIZE_' || CAST(p_size AS VARCHAR(20)) || ' NUMBER' || chr(10) || ')'"),
    "views": ("part", "'V_' || CAST(p_partkey AS VARCHAR(20))",
              "'CREATE VIEW V_' || CAST(p_partkey AS VARCHAR(20)) || ' AS SELECT * FROM TB_' || CAST(p_partkey AS VARCHAR(20)) || "
              "' T JOIN TB_' || CAST(p_size AS VARCHAR(20)) || ' S ON S.ID = T.ID'"),
    "procedures": ("supplier", "'PR_' || CAST(s_suppkey AS VARCHAR(20))",
                   "'CREATE PROCEDURE PR_' || CAST(s_suppkey AS VARCHAR(20)) || ' AS' || chr(10) || 'BEGIN' || chr(10) || "
                   "'  INSERT INTO TB_' || CAST(s_suppkey % 200 AS VARCHAR(20)) || ' (ID) VALUES (SEQ_' || CAST(s_nationkey AS VARCHAR(20)) || '.NEXTVAL);' || chr(10) || "
                   "'  UPDATE TB_' || CAST((s_suppkey * 3) % 200 AS VARCHAR(20)) || ' SET ID = 1;' || chr(10) || "
                   "'  DELETE FROM TB_' || CAST((s_suppkey * 7) % 200 AS VARCHAR(20)) || ';' || chr(10) || "
                   "'  PR_' || CAST(CAST(FLOOR(s_suppkey / 2.0) AS BIGINT) AS VARCHAR(20)) || '(1);' || chr(10) || "
                   "'  EXEC FN_' || CAST(s_nationkey AS VARCHAR(20)) || ';' || chr(10) || 'END;'"),
    "functions": ("nation", "'FN_' || CAST(n_nationkey AS VARCHAR(20))",
                  "'CREATE FUNCTION FN_' || CAST(n_nationkey AS VARCHAR(20)) || ' RETURN NUMBER IS' || chr(10) || "
                  "'BEGIN' || chr(10) || '  RETURN seq_' || CAST(n_nationkey AS VARCHAR(20)) || '.currval;' || chr(10) || 'END;'"),
    "packages": ("region", "'PKG_' || CAST(r_regionkey AS VARCHAR(20))",
                 "'CREATE PACKAGE PKG_' || CAST(r_regionkey AS VARCHAR(20)) || ' AS' || chr(10) || "
                 "'  PROCEDURE PR_' || CAST(r_regionkey AS VARCHAR(20)) || ';' || chr(10) || "
                 "'  FUNCTION FN_' || CAST(r_regionkey AS VARCHAR(20)) || ' RETURN NUMBER;' || chr(10) || 'END;'"),
    "triggers": ("nation", "'TRG_' || CAST(n_nationkey AS VARCHAR(20))",
                 "CASE WHEN n_nationkey % 2 = 0 THEN 'CREATE TRIGGER TRG_' ELSE 'CREATE OR REPLACE TRIGGER TRG_' END || "
                 "CAST(n_nationkey AS VARCHAR(20)) || ' BEFORE INSERT ON TB_' || CAST(n_nationkey AS VARCHAR(20)) || chr(10) || "
                 "'FOR EACH ROW' || chr(10) || 'BEGIN' || chr(10) || '  PR_' || CAST(n_nationkey AS VARCHAR(20)) || '(0);' || chr(10) || 'END;'"),
    "sequences": ("nation", "'SEQ_' || CAST(n_nationkey AS VARCHAR(20))",
                  "'CREATE SEQUENCE SEQ_' || CAST(n_nationkey AS VARCHAR(20)) || ' START WITH 1 INCREMENT BY 1'"),
    "indexes": ("customer", "'IX_' || CAST(c_custkey AS VARCHAR(20))",
                "'CREATE INDEX IX_' || CAST(c_custkey AS VARCHAR(20)) || ' ON TB_' || CAST(c_custkey % 200 AS VARCHAR(20)) || ' (ID)'"),
    "constraints": ("supplier", "'FK_' || CAST(s_suppkey AS VARCHAR(20))",
                    "'ALTER TABLE TB_' || CAST(s_suppkey % 200 AS VARCHAR(20)) || ' ADD CONSTRAINT FK_' || CAST(s_suppkey AS VARCHAR(20)) || "
                    "' FOREIGN KEY (PARENT_ID) REFERENCES TB_' || CAST((s_suppkey + 1) % 200 AS VARCHAR(20)) || ' (ID)'"),
}


def ddl_objects(spark: SparkSession, sf_dir: str, schema: str = "APP") -> DataFrame:
    """``objects(schema, obj_type, name, ddl)`` derived from the driver tables."""
    frames = []
    for kind, (table, name_sql, ddl_sql) in DDL_OBJECTS_SQL.items():
        frames.append(read_table(spark, sf_dir, table).selectExpr(
            f"'{schema}' AS schema", f"'{kind}' AS obj_type", f"{name_sql} AS name", f"{ddl_sql} AS ddl"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------- query log, token metrics, responses
QUERY_TEXT_SQL = (
    "CASE event_id % 8 "
    "WHEN 0 THEN 'SELECT * FROM ' || event_type || ' WHERE id = ' || CAST(user_id AS VARCHAR(20)) "
    "WHEN 1 THEN 'select user_id, value from ' || event_type || ' limit ' || CAST(event_id % 3000 AS VARCHAR(20)) "
    "WHEN 2 THEN '-- report' || chr(10) || 'SELECT count(*) FROM ' || event_type || ';' "
    "WHEN 3 THEN 'SELECT * FROM ' || event_type || '; DELETE FROM ' || event_type "
    "WHEN 4 THEN 'DELETE FROM ' || event_type || ' WHERE id = ' || CAST(user_id AS VARCHAR(20)) "
    "WHEN 5 THEN 'SELECT TOP 5 * FROM ' || event_type "
    "WHEN 6 THEN 'SELECT a.updated_at FROM ' || event_type || ' a /* drop later */ JOIN users u ON u.id = a.user_id' "
    "ELSE 'SELECT 1; -- done' || chr(10) || 'SELECT 2' END"
)


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``queries(id, sql)``: one query text per event, eight shapes (allowed, banned, commented, multi)."""
    return read_table(spark, sf_dir, "events").selectExpr("event_id AS id", f"{QUERY_TEXT_SQL} AS sql")


def token_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token_metrics(request_id, operation, tokens_in, tokens_out, tokens_total, timestamp, use_toon)`` from events."""
    ev = read_table(spark, sf_dir, "events")
    tin = F.floor("value").cast("bigint")
    tout = (F.col("event_id") % 100).cast("bigint")
    return ev.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("operation"),
                     tin.alias("tokens_in"), tout.alias("tokens_out"), (tin + tout).alias("tokens_total"),
                     F.col("ts").alias("timestamp"), ((F.col("event_id") % 2) == 0).alias("use_toon"))


RESPONSE_JSON_SQL = (
    "CASE event_id % 5 "
    "WHEN 0 THEN '{\"llm_output\": {\"token_usage\": {\"prompt_tokens\": ' || CAST(event_id % 1000 AS VARCHAR(20)) || "
    "', \"completion_tokens\": ' || CAST(user_id AS VARCHAR(20)) || '}}}' "
    "WHEN 1 THEN '{\"response_metadata\": {\"token_usage\": {\"promptTokens\": ' || CAST(event_id % 1000 AS VARCHAR(20)) || "
    "', \"completionTokens\": ' || CAST(user_id AS VARCHAR(20)) || ', \"totalTokens\": ' || CAST(event_id % 1000 + user_id + 1 AS VARCHAR(20)) || '}}}' "
    "WHEN 2 THEN '{\"llm_output\": {\"usage\": {\"input_tokens\": ' || CAST(event_id % 1000 AS VARCHAR(20)) || "
    "', \"output_tokens\": ' || CAST(user_id AS VARCHAR(20)) || '}}}' "
    "WHEN 3 THEN '{\"generations\": [[{\"text\": \"x\"}, {\"response_metadata\": {\"token_usage\": {\"inputTokens\": ' || "
    "CAST(event_id % 1000 AS VARCHAR(20)) || ', \"outputTokens\": ' || CAST(user_id AS VARCHAR(20)) || '}}}]]}' "
    "ELSE '{\"llm_output\": {\"token_usage\": {}}, \"kwargs\": {\"token_usage\": {\"prompt_tokens\": 0, \"input_tokens\": ' || "
    "CAST(event_id % 1000 AS VARCHAR(20)) || ', \"total_tokens\": 7}}}' END"
)


def llm_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``responses(request_id, response)``: provider response documents in five layouts."""
    return read_table(spark, sf_dir, "events").selectExpr("event_id AS request_id", f"{RESPONSE_JSON_SQL} AS response")


# ---------------------------------------------------------------- second code corpus
# One loader procedure per deduplicated lineitem row: INSERT column lists,
# nested commas in SELECT lists, MERGE / DELETE, dotted package calls, a call
# inside a comment, CURSOR / WHILE / CASE. Same text in Spark and DuckDB.
LOADER_NAME_SQL = "'LOAD_' || l_returnflag || '_' || CAST(l_orderkey AS VARCHAR(20)) || '_' || CAST(l_linenumber AS VARCHAR(20))"
LOADER_TEXT_SQL = (
    "'CREATE OR REPLACE PROCEDURE pkg_load.load_' || lower(l_returnflag) || '_' || CAST(l_orderkey AS VARCHAR(20)) || '_' || "
    "CAST(l_linenumber AS VARCHAR(20)) || ' IS' || chr(10) || "
    "'  l_qty NUMBER;' || chr(10) || '  v_x VARCHAR2(30);' || chr(10) || "
    "'  CURSOR c_lines IS SELECT l.qty, NVL(l.price, 0) AS price, ROUND(l.tax, 2) tax_r, discount d FROM s' || "
    "CAST(l_suppkey % 10 AS VARCHAR(20)) || '.lines l;' || chr(10) || 'BEGIN' || chr(10) || "
    "'  /* audit: CALL legacy_hook */' || chr(10) || "
    "'  INSERT INTO stage_' || l_linestatus || ' (qty, price, ship_' || CAST(l_linenumber AS VARCHAR(20)) || ') VALUES (l_qty, 1, 2);' || chr(10) || "
    "CASE WHEN l_quantity > 25 THEN '  DELETE FROM archive_' || l_returnflag || ' WHERE id = ' || CAST(l_partkey AS VARCHAR(20)) || ';' || chr(10) ELSE '' END || "
    "CASE WHEN l_discount > 0.05 THEN '  MERGE INTO totals_' || CAST(l_linenumber AS VARCHAR(20)) || ' t USING dual ON (1 = 1);' || chr(10) ELSE '' END || "
    "'  WHILE l_qty < ' || CAST(l_linenumber AS VARCHAR(20)) || ' LOOP l_qty := l_qty + 1; END LOOP;' || chr(10) || "
    "'  pkg_util.log_item(' || CAST(l_partkey AS VARCHAR(20)) || ', SUBSTR(name, 1, 3));' || chr(10) || "
    "'  SELECT LOWER(name), CONCAT(first_name, last_name), REPLACE(code, x, y), CASE WHEN a > 1 THEN 1 ELSE 0 END INTO v_x FROM part_' || "
    "CAST(l_partkey % 100 AS VARCHAR(20)) || ';' || chr(10) || "
    "'  UPDATE s' || CAST(l_suppkey % 10 AS VARCHAR(20)) || '.lines l SET l.qty = l_qty, price = TRIM(price) WHERE id = 1;' || chr(10) || "
    "CASE WHEN l_tax > 0.04 THEN '  IF l_qty > 0 THEN NULL; END IF;' || chr(10) ELSE '' END || "
    "'END;'"
)


def loader_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``procedures(name, schema, source_code)``: one loader procedure per line item."""
    return catalog_lines(spark, sf_dir).selectExpr(
        f"{LOADER_NAME_SQL} AS name", "CAST(NULL AS STRING) AS schema", f"{LOADER_TEXT_SQL} AS source_code")
