"""Catalog assembly: columns, keys, indexes, type text, DDL, table scores and FK levels.

Inputs are information-schema-shaped frames (see
:mod:`procweave.sources.tables` / :mod:`procweave.sources.jdbc`):

* ``columns(table_schema, table_name, column_name, ordinal, data_type,
  char_len, num_precision, num_scale, is_nullable, column_default, comment)``
* ``key_rows(constraint_name, constraint_type, table_schema, table_name,
  column_name, ordinal, ref_schema, ref_table, ref_column, delete_rule, update_rule)``
* ``index_rows(table_schema, table_name, index_name, column_name, position,
  is_unique, index_type)``

The original runs 3-5 catalog queries per table (N+1); here every table is
assembled at once by set-based joins keyed by (schema, table[, constraint]).
Per-table lists (PK columns, index columns, FK columns) are ordered string
aggregations over one table's rows, bounded by that table's width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.functions import scoring


def table_key(schema_col: str = "table_schema", name_col: str = "table_name", drop_schema: str | None = None):
    """Table key as the loaders build it: ``schema.table``; ``drop_schema``
    (``public`` for PostgreSQL, ``dbo`` for SQL Server) gives the bare name."""
    s, n = F.col(schema_col), F.col(name_col)
    full = F.concat_ws(".", s, n)
    if drop_schema is None:
        return full
    return F.when(s == drop_schema, n).otherwise(full)


def type_text(dialect: str = "postgresql", data_type="data_type", char_len="char_len",
              precision="num_precision", scale="num_scale"):
    """Full column type text per dialect.

    postgresql: ``type(len)``, else ``type(p,s)`` when scale is non-zero, else ``type(p)``;
    mssql / mysql: as postgresql but a scale of 0 is kept;
    oracle: with a length, ``(p,s)`` when scale is set (precision printed even
    when null, as ``None``), else ``(p)``, else ``(len)``.
    """
    t, ln, p, s = F.col(data_type), F.col(char_len), F.col(precision), F.col(scale)
    truthy = lambda c: c.isNotNull() & (c != 0)
    if dialect == "postgresql":
        return (F.when(truthy(ln), F.format_string("%s(%d)", t, ln))
                .when(truthy(p), F.when(truthy(s), F.format_string("%s(%d,%d)", t, p, s))
                      .otherwise(F.format_string("%s(%d)", t, p)))
                .otherwise(t))
    if dialect in ("mssql", "mysql"):
        return (F.when(truthy(ln), F.format_string("%s(%d)", t, ln))
                .when(truthy(p), F.when(s.isNotNull(), F.format_string("%s(%d,%d)", t, p, s))
                      .otherwise(F.format_string("%s(%d)", t, p)))
                .otherwise(t))
    if dialect == "oracle":
        length = F.coalesce(ln, p)
        return (F.when(truthy(length),
                       F.when(s.isNotNull(), F.concat(t, F.lit("("), F.coalesce(p.cast("string"), F.lit("None")),
                                                      F.lit(","), s.cast("string"), F.lit(")")))
                       .when(p.isNotNull(), F.format_string("%s(%d)", t, p))
                       .otherwise(F.format_string("%s(%d)", t, ln)))
                .otherwise(t))
    raise ValueError(f"unknown dialect {dialect!r}")


def primary_keys(key_rows: DataFrame) -> DataFrame:
    """(table_schema, table_name, constraint_name, pk_columns) ordered by ordinal."""
    pk = key_rows.filter(F.col("constraint_type") == "PRIMARY KEY")
    return (pk.groupBy("table_schema", "table_name", "constraint_name")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column_name"))),
                                          lambda x: x["column_name"]), ", ").alias("pk_columns")))


def foreign_keys(key_rows: DataFrame, compat: bool = False) -> DataFrame:
    """A16 + J3 + P42: one row per FK constraint.

    Columns are paired by ordinal and joined on (schema, table, constraint),
    so composite keys stay composite. Referential actions get ``_`` -> space.
    ``compat=True`` reproduces the name-only join, where every key column
    pairs with every referenced column of the constraint (rows multiply).
    """
    fk = key_rows.filter(F.col("constraint_type") == "FOREIGN KEY")
    keys = ["table_schema", "table_name", "constraint_name"]
    if compat:
        left = fk.select("constraint_name", "table_schema", "table_name", "column_name", "ordinal",
                         "ref_schema", "ref_table", "delete_rule", "update_rule")
        right = fk.select("constraint_name", F.col("ref_column").alias("rc"), F.col("ordinal").alias("rord"))
        fk = left.join(right, "constraint_name").withColumnRenamed("rc", "ref_column")
        pair = F.struct("ordinal", "rord", "column_name", "ref_column")
    else:
        pair = F.struct("ordinal", "column_name", "ref_column")
    g = fk.groupBy(*keys).agg(
        F.sort_array(F.collect_list(pair)).alias("pairs"),
        F.first("ref_schema", ignorenulls=True).alias("ref_schema"),
        F.first("ref_table", ignorenulls=True).alias("ref_table"),
        F.first("delete_rule", ignorenulls=True).alias("delete_rule"),
        F.first("update_rule", ignorenulls=True).alias("update_rule"))
    return g.select(
        *keys,
        F.array_join(F.transform("pairs", lambda p: p["column_name"]), ", ").alias("columns"),
        F.concat_ws(".", "ref_schema", "ref_table").alias("referenced_table"),
        F.array_join(F.transform("pairs", lambda p: p["ref_column"]), ", ").alias("referenced_columns"),
        F.translate("delete_rule", "_", " ").alias("on_delete"),
        F.translate("update_rule", "_", " ").alias("on_update"))


def assemble_columns(columns: DataFrame, key_rows: DataFrame, dialect: str = "postgresql") -> DataFrame:
    """Columns left-joined to PK membership and to the *first* FK of
    each column (by constraint name), with the full type text."""
    keys = ["table_schema", "table_name", "column_name"]
    kind = F.col("constraint_type")
    first = F.struct("constraint_name", "ref_schema", "ref_table", "ref_column")
    # one pass over the constraint rows for both kinds of key
    marks = (key_rows.filter(kind.isin("PRIMARY KEY", "FOREIGN KEY")).groupBy(*keys)
             .agg(F.max(kind == "PRIMARY KEY").alias("is_primary_key"), F.min(F.when(kind == "FOREIGN KEY", first)).alias("f"))
             .select(*keys, "is_primary_key",
                     F.when(F.col("f").isNotNull(), F.concat_ws(".", "f.ref_schema", "f.ref_table")).alias("foreign_key_table"),
                     F.col("f.ref_column").alias("foreign_key_column")))
    out = columns.join(marks, keys, "left")
    return out.select(
        "table_schema", "table_name", "column_name", "ordinal",
        type_text(dialect).alias("data_type"),
        (F.col("is_nullable") == "YES").alias("nullable"),
        F.col("column_default").alias("default_value"),
        F.coalesce("is_primary_key", F.lit(False)).alias("is_primary_key"),
        F.col("foreign_key_table").isNotNull().alias("is_foreign_key"),
        "foreign_key_table", "foreign_key_column")


def assemble_indexes(index_rows: DataFrame, key_rows: DataFrame) -> DataFrame:
    """J4 + A15 + P33: one row per index, columns in position order; primary
    when the name of a PK constraint of the same table is a substring of the
    index name (the PK-name join is an equi-join per table, then ``contains``)."""
    keys = ["table_schema", "table_name", "index_name"]
    g = index_rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "column_name"))),
                                 lambda x: x["column_name"]), ", ").alias("columns"),
        F.max(F.col("is_unique").cast("int")).cast("boolean").alias("is_unique"),
        F.first("index_type", ignorenulls=True).alias("index_type"))
    pkn = (key_rows.filter(F.col("constraint_type") == "PRIMARY KEY")
           .select("table_schema", "table_name", F.col("constraint_name").alias("pk_name")).distinct())
    prim = (g.select(*keys).join(pkn, ["table_schema", "table_name"])
            .filter(F.col("index_name").contains(F.col("pk_name")))
            .select(*keys).distinct().withColumn("is_primary", F.lit(True)))
    return (g.join(prim, keys, "left")
            .select(*keys, "columns", "is_unique", F.coalesce("is_primary", F.lit(False)).alias("is_primary"), "index_type"))


def index_columns_from_definition(defs: DataFrame, def_col: str = "indexdef") -> DataFrame:
    """P33 on PostgreSQL ``pg_indexes`` rows: columns between the first ``(``
    and ``)``, unquoted; unique when the text contains ``UNIQUE``."""
    inner = F.regexp_extract(F.col(def_col), r"\(([^)]*)\)", 1)
    cols = F.transform(F.split(inner, ","), lambda c: F.regexp_replace(F.trim(c), '"', ""))
    return defs.select("*", cols.alias("columns"), F.upper(F.col(def_col)).contains("UNIQUE").alias("is_unique"))


def index_rows_from_definitions(defs: DataFrame, def_col: str = "indexdef") -> DataFrame:
    """PostgreSQL ``pg_indexes`` rows as index-column rows, the shape that
    :func:`assemble_indexes` takes (one row per column, ``USING`` method as type)."""
    parsed = index_columns_from_definition(defs, def_col)
    method = F.nullif(F.regexp_extract(F.col(def_col), r"(?i)\bUSING\s+(\w+)", 1), F.lit(""))
    return parsed.select("table_schema", "table_name", "index_name", F.posexplode("columns").alias("pos", "column_name"),
                         "is_unique", method.alias("index_type")).select(
        "table_schema", "table_name", "index_name", "column_name", (F.col("pos") + 1).alias("position"), "is_unique", "index_type")


def table_ddl(cols: DataFrame, fks: DataFrame, style: str = "postgresql") -> DataFrame:
    """CREATE TABLE text per table from assembled columns and FKs.

    Column definitions are ordered by ordinal; FK constraints by name.
    ``style='mssql'`` brackets identifiers; ``style='placeholder'`` gives the
    fixed fallback text of the Oracle and MySQL loaders.
    """
    if style == "placeholder":
        from procweave.functions import constants as K
        head, tail = K.PLACEHOLDER_DDL.split("{schema}")[0], K.PLACEHOLDER_DDL.split("{table}")[1]
        tables = cols.select("table_schema", "table_name").distinct()
        return tables.select("table_schema", "table_name", F.concat(F.lit(head), F.col("table_schema"), F.lit("."),
                                                                    F.col("table_name"), F.lit(tail)).alias("ddl"))
    q = (lambda c: F.concat(F.lit("["), c, F.lit("]"))) if style == "mssql" else (lambda c: c)
    coldef = F.concat(F.lit("    "), q(F.col("column_name")), F.lit(" "), F.col("data_type"),
                      F.when(~F.col("nullable"), F.lit(" NOT NULL")).otherwise(F.lit("")),
                      F.when(F.col("default_value").isNotNull() & (F.col("default_value") != ""),
                             F.concat(F.lit(" DEFAULT "), F.col("default_value"))).otherwise(F.lit("")))
    per_table = cols.groupBy("table_schema", "table_name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", coldef.alias("d")))),
                                 lambda x: x["d"]), ",\n").alias("col_defs"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("is_primary_key"), F.struct("ordinal", q(F.col("column_name")).alias("c"))))),
                                 lambda x: x["c"]), ", ").alias("pk_cols"))
    if style == "mssql":
        fk_cols = F.concat(F.lit("["), F.regexp_replace("columns", ", ", "], ["), F.lit("]"))
        ref_cols = F.concat(F.lit("["), F.regexp_replace("referenced_columns", ", ", "], ["), F.lit("]"))
        name = F.concat(F.lit("["), F.col("constraint_name"), F.lit("]"))
    else:
        fk_cols, ref_cols, name = F.col("columns"), F.col("referenced_columns"), F.col("constraint_name")
    fk_line = F.concat(F.lit(",\n    CONSTRAINT "), name, F.lit(" FOREIGN KEY ("), fk_cols, F.lit(")"),
                       F.lit(" REFERENCES "), F.col("referenced_table"), F.lit(" ("), ref_cols, F.lit(")"),
                       F.when(F.col("on_delete").isNotNull(), F.concat(F.lit(" ON DELETE "), F.col("on_delete"))).otherwise(F.lit("")),
                       F.when(F.col("on_update").isNotNull(), F.concat(F.lit(" ON UPDATE "), F.col("on_update"))).otherwise(F.lit("")))
    fk_text = fks.groupBy("table_schema", "table_name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("constraint_name", fk_line.alias("l")))),
                                 lambda x: x["l"]), "\n").alias("fk_text"))
    head = (F.concat(F.lit("CREATE TABLE ["), F.col("table_schema"), F.lit("].["), F.col("table_name"), F.lit("] ("))
            if style == "mssql" else F.concat(F.lit("CREATE TABLE "), F.col("table_schema"), F.lit("."), F.col("table_name"), F.lit(" (")))
    pk_part = F.when(F.col("pk_cols") != "", F.concat(F.lit("\n,\n    PRIMARY KEY ("), F.col("pk_cols"), F.lit(")"))).otherwise(F.lit(""))
    fk_part = F.when(F.col("fk_text").isNotNull(), F.concat(F.lit("\n"), F.col("fk_text"))).otherwise(F.lit(""))
    ddl = F.concat(head, F.lit("\n"), F.col("col_defs"), pk_part, fk_part, F.lit("\n\n);"))
    return per_table.join(fk_text, ["table_schema", "table_name"], "left").select("table_schema", "table_name", ddl.alias("ddl"))


def table_summary(cols: DataFrame, fks: DataFrame, idx: DataFrame) -> DataFrame:
    """Per table, column / FK / index counts and the complexity score."""
    keys = ["table_schema", "table_name"]
    c = cols.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_columns"))
    f = fks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_fks"))
    i = idx.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_indexes"))
    out = (c.join(f, keys, "left").join(i, keys, "left")
           .select(*keys, F.col("n_columns").cast("bigint"),
                   F.coalesce("n_fks", F.lit(0)).cast("bigint").alias("n_fks"),
                   F.coalesce("n_indexes", F.lit(0)).cast("bigint").alias("n_indexes")))
    return out.withColumn("complexity_score", scoring.table_complexity("n_columns", "n_fks", "n_indexes"))


def table_statistics(summary: DataFrame) -> DataFrame:
    """A2: table count, average complexity, total FKs, total indexes."""
    return summary.agg(F.count(F.lit(1)).cast("bigint").alias("total_tables"),
                       F.round(F.avg("complexity_score"), 6).alias("avg_complexity"),
                       F.coalesce(F.sum("n_fks"), F.lit(0)).cast("bigint").alias("total_foreign_keys"),
                       F.coalesce(F.sum("n_indexes"), F.lit(0)).cast("bigint").alias("total_indexes"))


def resolve_fk_targets(fks: DataFrame, tables: DataFrame, compat: bool = False) -> DataFrame:
    """FK edges (src, dst, constraint_name, columns, referenced_columns)
    whose target exists among ``tables(table)``.

    Exact key first; else, for a dotted target, the smallest table whose last
    segment equals the target's last segment. The original does not resolve
    an undotted target against ``schema.table`` keys (``compat=True``); by
    default undotted targets are resolved on the last segment as well.
    """
    t = tables.select(F.col("table").alias("cand")).distinct()
    # one candidate per last segment: a name that many schemas have stays one row
    t_short = t.groupBy(F.substring_index("cand", ".", -1).alias("short")).agg(F.min("cand").alias("dst"))
    e = fks.select(F.concat_ws(".", "table_schema", "table_name").alias("src"), F.col("referenced_table").alias("target"),
                   "constraint_name", "columns", "referenced_columns")
    looked = e.distinct().join(t, e["target"] == t["cand"], "left")
    exact = looked.filter(F.col("cand").isNotNull()).withColumn("dst", F.col("cand"))
    # only targets without an exact table take the last-segment path
    rest = looked.filter(F.col("cand").isNull() & (F.col("target").contains(".") if compat else F.lit(True)))
    by_short = rest.withColumn("short", F.substring_index("target", ".", -1)).join(t_short, "short")
    columns = ["src", "dst", "constraint_name", "columns", "referenced_columns"]
    return exact.select(*columns).unionByName(by_short.select(*columns))


def field_definition(cols: DataFrame, table: str, field: str, case_sensitive: bool = False) -> DataFrame:
    """One column's assembled definition inside a table (key ``schema.table`` or bare name)."""
    key = F.concat_ws(".", "table_schema", "table_name")
    tmatch = (key == table) | (F.col("table_name") == table)
    fmatch = (F.col("column_name") == field) if case_sensitive else (F.upper("column_name") == field.upper())
    return cols.filter(tmatch & fmatch)


def limit_entities(df: DataFrame, n: int | None, key: str = "name") -> DataFrame:
    """L3: the first ``n`` entities by key, applied before any analysis (pushed
    into the plan as a top-n instead of loading everything first)."""
    return df if n is None else df.orderBy(key).limit(n)


def attach_stats(tables: DataFrame, stats: DataFrame) -> DataFrame:
    """Table list left-joined to the dialect's statistics rows
    (``row_count``, human-readable ``table_size``); missing stats stay NULL."""
    keys = ["table_schema", "table_name"]
    return tables.join(stats.select(*keys, "row_count", "table_size"), keys, "left")
