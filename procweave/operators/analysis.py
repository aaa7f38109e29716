"""Static analysis of a procedure corpus as one DataFrame projection.

Input: ``procedures(name, source_code[, schema])`` where ``name`` is the
procedure key as loaded (``OWNER.NAME`` or a bare upper name). Output keeps
one row per procedure with arrays for the per-procedure sets; the long forms
(edges, field usage) explode them. Nothing here shuffles: it is a map-only
stage over the corpus, so it scales with the number of input splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.functions import constants as K
from procweave.functions import extract as X
from procweave.functions.scoring import counted_complexity


def split_qualified(key) -> tuple:
    """(schema, short name) of a key split at the first dot; UNKNOWN without dot (P20)."""
    c = F.col(key) if isinstance(key, str) else key
    has_dot = F.instr(c, ".") > 0
    schema = F.when(has_dot, F.substring_index(c, ".", 1)).otherwise(F.lit(K.UNKNOWN_SCHEMA))
    short = F.when(has_dot, F.regexp_replace(c, r"^[^.]*\.", "")).otherwise(c)
    return schema, short


def with_identity(procs: DataFrame) -> DataFrame:
    """Add ``proc`` (key), ``schema``, ``short_name`` and graph ``id`` = schema.short_name."""
    key = F.col("name")
    if "schema" in procs.columns:
        key = F.when(F.col("schema").isNotNull() & (F.col("schema") != ""),
                     F.concat_ws(".", F.col("schema"), F.col("name"))).otherwise(F.col("name"))
    df = procs.withColumn("proc", key)
    schema, short = split_qualified("proc")
    df = df.withColumn("schema", schema).withColumn("short_name", short)
    return df.withColumn("id", F.concat_ws(".", "schema", "short_name"))


def non_empty(procs: DataFrame, code_col: str = "source_code") -> DataFrame:
    """keep only procedures whose code has a non-blank character."""
    return procs.filter(F.col(code_col).rlike(r"\S"))


def analyze(procs: DataFrame, variant: str = "static", code_col: str = "source_code") -> DataFrame:
    """Full static analysis per procedure (P17 + P18 + P14).

    Columns: proc, schema, short_name, id, source_code, calls, tables,
    select_fields, insert_fields, update_fields, transformations, parameters,
    signature_parameters, variables, control, lines, complexity_score.
    """
    code = F.col(code_col)
    df = with_identity(non_empty(procs, code_col))
    return df.select(
        "proc", "schema", "short_name", "id", code.alias("source_code"),
        X.called_procedures(code, variant).alias("calls"),
        X.called_tables(code, variant).alias("tables"),
        X.select_fields(code).alias("select_fields"),
        X.insert_fields(code).alias("insert_fields"),
        X.update_fields(code).alias("update_fields"),
        X.transformations(code).alias("transformations"),
        X.parameters(code).alias("parameters"),
        X.signature_parameters(code).alias("signature_parameters"),
        X.variables(code).alias("variables"),
        X.control_counts(code).alias("control"),
        X.line_count(code).cast("bigint").alias("lines"),
        counted_complexity(code).alias("complexity_score"),
    )


def call_edges(analysis: DataFrame, drop_self: bool = False) -> DataFrame:
    """G1: one row per (proc, callee). Self-calls kept unless ``drop_self``."""
    e = analysis.select("proc", "id", F.explode_outer("calls").alias("callee")).filter(F.col("callee").isNotNull())
    if drop_self:
        e = e.filter(F.col("callee") != F.col("proc"))
    return e


def table_edges(analysis: DataFrame) -> DataFrame:
    return (analysis.select("proc", "id", F.explode_outer("tables").alias("table_name"))
            .filter(F.col("table_name").isNotNull()))


def field_usage(analysis: DataFrame) -> DataFrame:
    """P11 in long form: (proc, field, operation, kind, context, transformation, seq).

    ``seq`` orders rows inside a procedure as the original appends them:
    select reads, insert writes, update writes, then transformations.
    Duplicates are kept, as in the original operation lists.
    """
    # one projection and one explode: the four lists become one tagged array, the
    # extraction runs once per procedure
    parts = [("select_fields", "read", "select"), ("insert_fields", "write", "insert"),
             ("update_fields", "write", "update"), ("transformations", "transform", "transform")]
    none = F.lit(None).cast("string")

    def tagged(i, column, operation, kind):
        moved = column == "transformations"
        return F.transform(F.col(column), lambda u, pos: F.struct(
            u["field"].alias("field"), F.lit(operation).alias("operation"), F.lit(kind).alias("kind"),
            (none if moved else u["context"]).alias("context"), (u["transformation"] if moved else none).alias("transformation"),
            (F.lit(i << 32) + pos).cast("bigint").alias("seq")))

    rows = F.concat(*[tagged(i, *p) for i, p in enumerate(parts)])
    return (analysis.select("proc", F.explode_outer(rows).alias("u")).filter(F.col("u").isNotNull())
            .select("proc", "u.field", "u.operation", "u.kind", "u.context", "u.transformation", "u.seq"))


def field_usage_one(usage: DataFrame, field: str, procedure: str | None = None,
                    case_sensitive: bool = False) -> DataFrame:
    """Usage rows of one field, optionally of procedures whose
    key ends with ``procedure``. The field is upper-cased like the original
    lookup; ``case_sensitive=False`` also upper-cases the stored side."""
    target = field.upper()
    stored = F.col("field") if case_sensitive else F.upper(F.col("field"))
    out = usage.filter(stored == F.lit(target))
    if procedure:
        out = out.filter(F.col("proc").endswith(procedure))
    return out


def parameter_rows(analysis: DataFrame, form: str = "static") -> DataFrame:
    """Parameters in long form (P13 or P14 with position W5)."""
    if form == "static":
        return analysis.select("proc", F.posexplode_outer("parameters").alias("pos", "p")).filter(F.col("pos").isNotNull()).select(
            "proc", F.col("p.name").alias("param_name"), F.col("p.direction").alias("direction"),
            F.col("p.type").alias("param_type"), (F.col("pos") + 1).cast("bigint").alias("seq"))
    return analysis.select("proc", F.explode_outer("signature_parameters").alias("p")).filter(F.col("p").isNotNull()).select(
        "proc", F.col("p.name").alias("param_name"), F.col("p.direction").alias("direction"),
        F.col("p.type").alias("param_type"), F.col("p.position").cast("bigint").alias("position"))


GRAPH_COLUMNS = ["proc", "schema", "short_name", "id", "calls", "tables", "complexity_score"]
CALL_COLUMNS = ["proc", "schema", "short_name", "id", "calls", "complexity_score"]
USAGE_COLUMNS = ["select_fields", "insert_fields", "update_fields", "transformations"]


def shared(analysis: DataFrame, columns: list[str] | None = None, tag: str = "analysis") -> DataFrame:
    """Write the analysis once (without the source text) for plans with several consumers.

    Graph building reads the analysis for nodes, call edges and name
    resolution; without this each consumer would re-run every regex over the
    corpus. Only the requested columns are computed and written (under the
    shared checkpoint folder), so all consumers scan the extracted result.
    """
    from procweave.session import materialize

    cols = columns or GRAPH_COLUMNS
    return materialize(analysis.select(*cols), tag)
