"""Catalog and procedure-source readers over JDBC, by dialect.

The original asks the database 3-5 questions *per table* (N+1 round trips).
Here each question is asked once for the whole schema, as a set-based query
read by ``spark.read.jdbc``; assembly (joins, ordered lists, type text, DDL)
then happens in Spark (:mod:`procweave.operators.catalog`). The schema
predicate sits in the pushed SQL (F2). Questions are asked as ``dbtable``
subqueries, so a large listing can be split across tasks with
``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``
passed in ``options``.

The SQL below is written against each product's documented catalog views;
the column names it returns are the shapes the catalog operators expect.
No database is reachable in tests: the builders are tested as text and the
assembly on frames of the same shape.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@dataclass
class Dialect:
    name: str
    driver: str
    default_schema_dropped: str | None
    procedures: str
    columns: str
    keys: str
    indexes: str
    tables: str
    stats: str = ""
    extra: dict = field(default_factory=dict)
    #: schema predicate when the caller names none
    any_schema: str = "IS NOT NULL"

    def sql(self, what: str, schema: str | None) -> str:
        text = getattr(self, what) if hasattr(self, what) else self.extra[what]
        cond = f"= {_lit(schema)}" if schema else self.any_schema
        return text.replace("{schema_cond}", cond)


POSTGRESQL = Dialect(
    name="postgresql", driver="org.postgresql.Driver", default_schema_dropped="public",
    procedures=(
        # the definition, else the routine's own text; a specific name is the name with the oid
        "SELECT n.nspname AS schema, p.proname AS name, "
        "COALESCE(NULLIF(pg_get_functiondef(p.oid), ''), (SELECT r.routine_definition FROM information_schema.routines r "
        "WHERE r.specific_schema = n.nspname AND r.specific_name = p.proname || '_' || p.oid)) AS source_code "
        "FROM pg_proc p JOIN pg_namespace n ON n.oid = p.pronamespace "
        "WHERE p.prokind = 'p' AND n.nspname NOT IN ('pg_catalog', 'information_schema') AND n.nspname {schema_cond}"),
    columns=(
        "SELECT table_schema, table_name, column_name, ordinal_position AS ordinal, data_type, "
        "character_maximum_length AS char_len, numeric_precision AS num_precision, numeric_scale AS num_scale, "
        "is_nullable, column_default, NULL AS comment FROM information_schema.columns "
        "WHERE table_schema NOT IN ('pg_catalog', 'information_schema') AND table_schema {schema_cond}"),
    keys=(
        "SELECT tc.constraint_name, tc.constraint_type, tc.table_schema, tc.table_name, ku.column_name, "
        "ku.ordinal_position AS ordinal, ccu.table_schema AS ref_schema, ccu.table_name AS ref_table, "
        "ccu.column_name AS ref_column, rc.delete_rule, rc.update_rule "
        "FROM information_schema.table_constraints tc "
        "JOIN information_schema.key_column_usage ku ON ku.constraint_schema = tc.constraint_schema "
        " AND ku.constraint_name = tc.constraint_name "
        "LEFT JOIN information_schema.referential_constraints rc ON rc.constraint_schema = tc.constraint_schema "
        " AND rc.constraint_name = tc.constraint_name "
        "LEFT JOIN information_schema.key_column_usage ccu ON ccu.constraint_schema = rc.unique_constraint_schema "
        " AND ccu.constraint_name = rc.unique_constraint_name AND ccu.ordinal_position = ku.position_in_unique_constraint "
        "WHERE tc.constraint_type IN ('PRIMARY KEY', 'FOREIGN KEY') AND tc.table_schema {schema_cond}"),
    indexes=(
        "SELECT schemaname AS table_schema, tablename AS table_name, indexname AS index_name, indexdef "
        "FROM pg_indexes WHERE schemaname {schema_cond}"),
    tables=(
        "SELECT table_schema, table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE' "
        "AND table_schema NOT IN ('pg_catalog', 'information_schema') AND table_schema {schema_cond}"),
    stats=(
        "SELECT schemaname AS table_schema, relname AS table_name, n_live_tup AS row_count, "
        "pg_size_pretty(pg_total_relation_size(relid)) AS table_size FROM pg_stat_user_tables WHERE schemaname {schema_cond}"),
    extra={
        # Every schema, with tables or not
        "schemas": ("SELECT schema_name AS table_schema FROM information_schema.schemata "
                    "WHERE schema_name NOT IN ('pg_catalog', 'information_schema', 'pg_toast') AND schema_name {schema_cond}"),
    },
)

ORACLE = Dialect(
    name="oracle", driver="oracle.jdbc.OracleDriver", default_schema_dropped=None,
    # one row per source line: a text has no length limit, lines are joined in Spark
    procedures=(
        "SELECT owner AS schema, name, line, text FROM all_source "
        "WHERE type = 'PROCEDURE' AND owner {schema_cond}"),
    columns=(
        "SELECT owner AS table_schema, table_name, column_name, column_id AS ordinal, data_type, "
        "CASE WHEN data_precision IS NULL AND data_scale IS NULL THEN data_length END AS char_len, "
        "data_precision AS num_precision, data_scale AS num_scale, "
        "CASE nullable WHEN 'Y' THEN 'YES' ELSE 'NO' END AS is_nullable, NULL AS column_default, NULL AS comment "
        "FROM all_tab_columns WHERE owner {schema_cond}"),
    keys=(
        "SELECT c.constraint_name, CASE c.constraint_type WHEN 'P' THEN 'PRIMARY KEY' ELSE 'FOREIGN KEY' END AS constraint_type, "
        "c.owner AS table_schema, c.table_name, cc.column_name, cc.position AS ordinal, "
        "r.owner AS ref_schema, r.table_name AS ref_table, rcc.column_name AS ref_column, c.delete_rule, NULL AS update_rule "
        "FROM all_constraints c JOIN all_cons_columns cc ON cc.owner = c.owner AND cc.constraint_name = c.constraint_name "
        "LEFT JOIN all_constraints r ON r.owner = c.r_owner AND r.constraint_name = c.r_constraint_name "
        "LEFT JOIN all_cons_columns rcc ON rcc.owner = r.owner AND rcc.constraint_name = r.constraint_name "
        " AND rcc.position = cc.position "
        "WHERE c.constraint_type IN ('P', 'R') AND c.owner {schema_cond}"),
    indexes=(
        "SELECT i.table_owner AS table_schema, i.table_name, i.index_name, ic.column_name, ic.column_position AS position, "
        "CASE i.uniqueness WHEN 'UNIQUE' THEN 1 ELSE 0 END AS is_unique, i.index_type "
        "FROM all_indexes i JOIN all_ind_columns ic ON ic.index_owner = i.owner AND ic.index_name = i.index_name "
        "WHERE i.index_type <> 'LOB' AND i.table_owner {schema_cond}"),
    tables=(
        "SELECT owner AS table_schema, table_name FROM all_tables "
        "WHERE owner NOT IN ('SYS', 'SYSTEM', 'SYSAUX') AND owner {schema_cond}"),
    stats=(
        "SELECT owner AS table_schema, table_name, num_rows AS row_count, "
        "ROUND(blocks * 8192 / 1024 / 1024, 2) || ' MB' AS table_size FROM all_tables WHERE owner {schema_cond}"),
    extra={
        # The nine object kinds in one listing
        "objects": (
            "SELECT owner AS schema, CASE object_type WHEN 'INDEX' THEN 'indexes' ELSE LOWER(object_type) || 's' END AS obj_type, "
            "object_name AS name FROM all_objects "
            "WHERE object_type IN ('TABLE', 'VIEW', 'PROCEDURE', 'FUNCTION', 'PACKAGE', 'TRIGGER', 'SEQUENCE', 'INDEX') "
            "AND owner {schema_cond} "
            "UNION ALL SELECT owner, 'constraints', constraint_name FROM all_constraints "
            "WHERE constraint_type IN ('P', 'U', 'R', 'C', 'V', 'O') AND owner {schema_cond}"),
        # DDL text per object (storage / tablespace / segment clauses off
        # through the session's transform parameters)
        "ddl": (
            "SELECT owner AS schema, CASE object_type WHEN 'INDEX' THEN 'indexes' ELSE LOWER(object_type) || 's' END AS obj_type, "
            "object_name AS name, DBMS_METADATA.GET_DDL(object_type, object_name, owner) AS ddl FROM all_objects "
            "WHERE object_type IN ('TABLE', 'VIEW', 'PROCEDURE', 'FUNCTION', 'PACKAGE', 'TRIGGER', 'SEQUENCE', 'INDEX') "
            "AND owner {schema_cond} "
            "UNION ALL SELECT owner, 'constraints', constraint_name, DBMS_METADATA.GET_DDL("
            "CASE constraint_type WHEN 'R' THEN 'REF_CONSTRAINT' ELSE 'CONSTRAINT' END, constraint_name, owner) FROM all_constraints "
            "WHERE constraint_type IN ('P', 'U', 'R', 'C') AND owner {schema_cond}"),
        "ddl_session_init": (
            "BEGIN "
            "DBMS_METADATA.SET_TRANSFORM_PARAM(DBMS_METADATA.SESSION_TRANSFORM, 'STORAGE', false); "
            "DBMS_METADATA.SET_TRANSFORM_PARAM(DBMS_METADATA.SESSION_TRANSFORM, 'TABLESPACE', false); "
            "DBMS_METADATA.SET_TRANSFORM_PARAM(DBMS_METADATA.SESSION_TRANSFORM, 'SEGMENT_ATTRIBUTES', false); "
            "END;"),
    },
)

MSSQL = Dialect(
    name="mssql", driver="com.microsoft.sqlserver.jdbc.SQLServerDriver", default_schema_dropped="dbo",
    procedures=(
        "SELECT r.ROUTINE_SCHEMA AS [schema], r.ROUTINE_NAME AS name, m.definition AS source_code "
        "FROM INFORMATION_SCHEMA.ROUTINES r "
        "JOIN sys.sql_modules m ON m.object_id = OBJECT_ID(QUOTENAME(r.ROUTINE_SCHEMA) + '.' + QUOTENAME(r.ROUTINE_NAME)) "
        "WHERE r.ROUTINE_TYPE = 'PROCEDURE' AND r.ROUTINE_SCHEMA {schema_cond}"),
    columns=(
        "SELECT TABLE_SCHEMA AS table_schema, TABLE_NAME AS table_name, COLUMN_NAME AS column_name, "
        "ORDINAL_POSITION AS ordinal, DATA_TYPE AS data_type, CHARACTER_MAXIMUM_LENGTH AS char_len, "
        "NUMERIC_PRECISION AS num_precision, NUMERIC_SCALE AS num_scale, IS_NULLABLE AS is_nullable, "
        "COLUMN_DEFAULT AS column_default, NULL AS comment FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_SCHEMA {schema_cond}"),
    keys=(
        "SELECT k.name AS constraint_name, 'PRIMARY KEY' AS constraint_type, s.name AS table_schema, t.name AS table_name, "
        "c.name AS column_name, ic.key_ordinal AS ordinal, NULL AS ref_schema, NULL AS ref_table, NULL AS ref_column, "
        "NULL AS delete_rule, NULL AS update_rule "
        "FROM sys.key_constraints k JOIN sys.tables t ON t.object_id = k.parent_object_id JOIN sys.schemas s ON s.schema_id = t.schema_id "
        "JOIN sys.index_columns ic ON ic.object_id = k.parent_object_id AND ic.index_id = k.unique_index_id "
        "JOIN sys.columns c ON c.object_id = ic.object_id AND c.column_id = ic.column_id "
        "WHERE k.type = 'PK' AND s.name {schema_cond} "
        "UNION ALL SELECT f.name, 'FOREIGN KEY', s.name, t.name, c.name, fc.constraint_column_id, rs.name, rt.name, rc.name, "
        "f.delete_referential_action_desc, f.update_referential_action_desc "
        "FROM sys.foreign_keys f JOIN sys.foreign_key_columns fc ON fc.constraint_object_id = f.object_id "
        "JOIN sys.tables t ON t.object_id = fc.parent_object_id JOIN sys.schemas s ON s.schema_id = t.schema_id "
        "JOIN sys.columns c ON c.object_id = fc.parent_object_id AND c.column_id = fc.parent_column_id "
        "JOIN sys.tables rt ON rt.object_id = fc.referenced_object_id JOIN sys.schemas rs ON rs.schema_id = rt.schema_id "
        "JOIN sys.columns rc ON rc.object_id = fc.referenced_object_id AND rc.column_id = fc.referenced_column_id "
        "WHERE s.name {schema_cond}"),
    indexes=(
        "SELECT s.name AS table_schema, t.name AS table_name, i.name AS index_name, c.name AS column_name, "
        "ic.key_ordinal AS position, i.is_unique, i.type_desc AS index_type "
        "FROM sys.indexes i JOIN sys.tables t ON t.object_id = i.object_id JOIN sys.schemas s ON s.schema_id = t.schema_id "
        "JOIN sys.index_columns ic ON ic.object_id = i.object_id AND ic.index_id = i.index_id "
        "JOIN sys.columns c ON c.object_id = ic.object_id AND c.column_id = ic.column_id "
        "WHERE i.name IS NOT NULL AND s.name {schema_cond}"),
    tables=("SELECT TABLE_SCHEMA AS table_schema, TABLE_NAME AS table_name FROM INFORMATION_SCHEMA.TABLES "
            "WHERE TABLE_TYPE = 'BASE TABLE' AND TABLE_SCHEMA {schema_cond}"),
    # rows and pages are summed apart: a partition has several allocation units
    stats=("SELECT s.name AS table_schema, t.name AS table_name, r.row_count, "
           "CAST(a.pages * 8 / 1024 AS VARCHAR(20)) + ' MB' AS table_size "
           "FROM sys.tables t JOIN sys.schemas s ON s.schema_id = t.schema_id "
           "JOIN (SELECT object_id, SUM(rows) AS row_count FROM sys.partitions WHERE index_id IN (0, 1) GROUP BY object_id) r "
           "ON r.object_id = t.object_id "
           "JOIN (SELECT p.object_id, SUM(u.total_pages) AS pages FROM sys.partitions p "
           "JOIN sys.allocation_units u ON u.container_id = p.partition_id GROUP BY p.object_id) a ON a.object_id = t.object_id "
           "WHERE s.name {schema_cond}"),
)

MYSQL = Dialect(
    name="mysql", driver="com.mysql.cj.jdbc.Driver", default_schema_dropped=None, any_schema="= DATABASE()",
    procedures=("SELECT ROUTINE_SCHEMA AS `schema`, ROUTINE_NAME AS name, ROUTINE_DEFINITION AS source_code "
                "FROM information_schema.ROUTINES WHERE ROUTINE_TYPE = 'PROCEDURE' AND ROUTINE_SCHEMA {schema_cond}"),
    columns=POSTGRESQL.columns.replace("table_schema NOT IN ('pg_catalog', 'information_schema') AND ", ""),
    keys=(
        "SELECT tc.CONSTRAINT_NAME AS constraint_name, tc.CONSTRAINT_TYPE AS constraint_type, tc.TABLE_SCHEMA AS table_schema, "
        "tc.TABLE_NAME AS table_name, ku.COLUMN_NAME AS column_name, ku.ORDINAL_POSITION AS ordinal, "
        "ku.REFERENCED_TABLE_SCHEMA AS ref_schema, ku.REFERENCED_TABLE_NAME AS ref_table, ku.REFERENCED_COLUMN_NAME AS ref_column, "
        "rc.DELETE_RULE AS delete_rule, rc.UPDATE_RULE AS update_rule "
        "FROM information_schema.TABLE_CONSTRAINTS tc JOIN information_schema.KEY_COLUMN_USAGE ku "
        " ON ku.CONSTRAINT_SCHEMA = tc.CONSTRAINT_SCHEMA AND ku.CONSTRAINT_NAME = tc.CONSTRAINT_NAME AND ku.TABLE_NAME = tc.TABLE_NAME "
        "LEFT JOIN information_schema.REFERENTIAL_CONSTRAINTS rc ON rc.CONSTRAINT_SCHEMA = tc.CONSTRAINT_SCHEMA "
        " AND rc.CONSTRAINT_NAME = tc.CONSTRAINT_NAME "
        "WHERE tc.CONSTRAINT_TYPE IN ('PRIMARY KEY', 'FOREIGN KEY') AND tc.TABLE_SCHEMA {schema_cond}"),
    indexes=("SELECT TABLE_SCHEMA AS table_schema, TABLE_NAME AS table_name, INDEX_NAME AS index_name, COLUMN_NAME AS column_name, "
             "SEQ_IN_INDEX AS position, NON_UNIQUE = 0 AS is_unique, INDEX_TYPE AS index_type "
             "FROM information_schema.STATISTICS WHERE TABLE_SCHEMA {schema_cond}"),
    tables=("SELECT TABLE_SCHEMA AS table_schema, TABLE_NAME AS table_name FROM information_schema.TABLES "
            "WHERE TABLE_TYPE = 'BASE TABLE' AND TABLE_SCHEMA {schema_cond}"),
    stats=("SELECT TABLE_SCHEMA AS table_schema, TABLE_NAME AS table_name, TABLE_ROWS AS row_count, "
           "CONCAT(ROUND((DATA_LENGTH + INDEX_LENGTH) / 1024 / 1024, 2), ' MB') AS table_size "
           "FROM information_schema.TABLES WHERE TABLE_SCHEMA {schema_cond}"),
)

DIALECTS: dict[str, Dialect] = {d.name: d for d in (POSTGRESQL, ORACLE, MSSQL, MYSQL)}


def register_dialect(d: Dialect) -> None:
    """Add or replace a dialect."""
    DIALECTS[d.name] = d


def available_dialects() -> list[str]:
    return sorted(DIALECTS)


def read_query(spark: SparkSession, url: str, query: str, options: dict | None = None,
               session_init: str | None = None) -> DataFrame:
    """One JDBC query as a DataFrame: a ``dbtable`` subquery, which Spark may read in
    several tasks when ``options`` name a partition column."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q")
    if session_init:
        r = r.option("sessionInitStatement", session_init)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r.load()


def read_catalog(spark: SparkSession, url: str, dialect: str, schema: str | None = None,
                 options: dict | None = None) -> dict[str, DataFrame]:
    """Every catalog frame of one database in set-based queries."""
    d = DIALECTS[dialect]
    opts = {"driver": d.driver, **(options or {})}
    out = {}
    for what in ("tables", "columns", "keys", "indexes", "stats"):
        sql = d.sql(what, schema)
        if sql:
            out[what] = read_query(spark, url, sql, opts)
    return catalog_shapes(out, dialect)


def catalog_shapes(frames: dict[str, DataFrame], dialect: str) -> dict[str, DataFrame]:
    """Dialect rows in the shapes the catalog operators take (PostgreSQL index
    definitions become index-column rows)."""
    if dialect == "postgresql" and "indexes" in frames:
        from procweave.operators.catalog import index_rows_from_definitions

        return {**frames, "indexes": index_rows_from_definitions(frames["indexes"])}
    return frames


def list_objects(spark: SparkSession, url: str, dialect: str = "oracle", schema: str | None = None,
                 options: dict | None = None) -> DataFrame:
    """Objects of the nine kinds as ``(schema, obj_type, name)``."""
    d = DIALECTS[dialect]
    return read_query(spark, url, d.sql("objects", schema), {"driver": d.driver, **(options or {})})


def read_ddl(spark: SparkSession, url: str, dialect: str = "oracle", schema: str | None = None,
             options: dict | None = None) -> DataFrame:
    """Objects with their DDL text as ``(schema, obj_type, name, ddl)``, without
    storage clauses (set on the session before the query)."""
    d = DIALECTS[dialect]
    return read_query(spark, url, d.sql("ddl", schema), {"driver": d.driver, **(options or {})}, d.extra.get("ddl_session_init"))


def join_source_lines(lines: DataFrame) -> DataFrame:
    """S3: ``(schema, name, line, text)`` rows joined to one text per procedure, in line order."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    return lines.groupBy("schema", "name").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("source_code"))


def read_procedures(spark: SparkSession, url: str, dialect: str, schema: str | None = None,
                    options: dict | None = None, connected_database: str | None = None) -> DataFrame:
    """Procedure sources as ``(name, schema, source_code)`` with the
    dialect's key rule (Oracle keeps ``OWNER.NAME``; PostgreSQL drops
    ``public``; SQL Server drops ``dbo``; MySQL drops the connected database),
    empty sources removed (F1)."""
    d = DIALECTS[dialect]
    df = read_query(spark, url, d.sql("procedures", schema), {"driver": d.driver, **(options or {})})
    if "line" in {c.lower() for c in df.columns}:
        df = join_source_lines(df)
    return procedure_keys(df, dialect, connected_database)


def procedure_keys(df: DataFrame, dialect: str, connected_database: str | None = None) -> DataFrame:
    """Apply the per-dialect naming rule to ``(schema, name, source_code)`` rows."""
    dropped = DIALECTS[dialect].default_schema_dropped if dialect != "mysql" else connected_database
    s = F.col("schema")
    keep_schema = s.isNotNull() & (F.lit(dropped).isNull() | (s != F.lit(dropped)))
    return (df.filter(F.trim(F.coalesce("source_code", F.lit(""))) != "")
            .select(F.when(keep_schema, F.concat_ws(".", s, F.col("name"))).otherwise(F.col("name")).alias("name"),
                    "source_code"))


def find_in_database(procs: DataFrame, name: str) -> DataFrame:
    """``upper(key) = upper(name)`` or key ending with ``.name``."""
    return procs.filter((F.upper("name") == name.upper()) | F.upper("name").endswith("." + name.upper()))


def schemas_with_tables(tables: DataFrame) -> DataFrame:
    """Schemas that hold tables, ordered (for the 'schema not found' message)."""
    return tables.select("table_schema").distinct().orderBy("table_schema")


def schema_overview(tables: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every schema as ``(table_schema, n_tables)``, those with tables first, each by name."""
    n = tables.groupBy("table_schema").agg(F.count(F.lit(1)).cast("bigint").alias("n_tables"))
    return (schemas.select("table_schema").distinct().join(n, "table_schema", "full")
            .select("table_schema", F.coalesce("n_tables", F.lit(0)).cast("bigint").alias("n_tables"))
            .orderBy(F.col("n_tables") == 0, "table_schema"))


def missing_schema_message(tables: DataFrame, schemas: DataFrame, wanted: str, most: int = 1000) -> str:
    """The message when a schema has no tables: what there is instead (at most ``most`` names), and whether it exists."""
    seen = schema_overview(tables, schemas)
    filled = [r["table_schema"] for r in seen.where("n_tables > 0").limit(most).collect()]
    every = [r["table_schema"] for r in seen.limit(most).collect()]
    text = f"no tables found in schema '{wanted}'"
    if filled:
        text += f"; schemas with tables: {', '.join(filled)}"
    elif every:
        text += f"; schemas without tables: {', '.join(every)}"
    else:
        text += "; the database has no schemas"
    return text if not seen.where(F.col("table_schema") == wanted).isEmpty() else f"{text}; schema '{wanted}' does not exist"
