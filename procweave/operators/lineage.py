"""Field lineage: trace, sources, destinations, flow, field analysis.

Built on the field-usage rows of :func:`procweave.operators.analysis.field_usage`
(``proc, field, operation, kind, context, transformation``) and the crawl.
Every function answers for all fields at once unless a field is given, so
the lineage of a whole corpus is a few joins and aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.operators import traversal as TR
from procweave.session import few, materialize


def _norm(field: str | None, case_sensitive: bool):
    if field is None:
        return None
    return field if case_sensitive else field.upper()


def usage_summary(usage: DataFrame, field: str | None = None, case_sensitive: bool = False) -> DataFrame:
    """A17 per field: procedures using it, how many read / write / transform it."""
    u = usage if field is None else usage.filter(F.col("field") == _norm(field, case_sensitive))
    per = u.groupBy("field", "proc").agg(
        F.max((F.col("operation") == "read").cast("int")).alias("r"),
        F.max((F.col("operation") == "write").cast("int")).alias("w"),
        F.max((F.col("operation") == "transform").cast("int")).alias("t"))
    return per.groupBy("field").agg(
        F.count(F.lit(1)).cast("bigint").alias("procedures"),
        F.sum("r").cast("bigint").alias("read_by"),
        F.sum("w").cast("bigint").alias("written_by"),
        F.sum("t").cast("bigint").alias("transformed_by"))


def sources(usage: DataFrame, columns: DataFrame | None = None, field: str | None = None,
            case_sensitive: bool = False, max_results: int | None = None, compat: bool = False) -> DataFrame:
    """(field, source_type, name) - procedures writing the field, and
    tables having a column of that name (J10). The original cuts the usage
    list to 10 before testing for writes (L7); here the answer is whole and a
    caller may ``limit`` it."""
    u = usage if field is None else usage.filter(F.col("field") == _norm(field, case_sensitive))
    if compat and max_results is not None:
        # L7 literal form: the first max_results procedures using the field
        # (ordered by name here) are tested for writes, and the whole list is cut again
        from pyspark.sql import Window
        users = u.select("field", "proc").distinct()
        w = Window.partitionBy("field").orderBy("proc")
        first = users.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_results).drop("_r")
        u = u.join(first, ["field", "proc"], "left_semi")
    procs = (u.filter(F.col("operation") == "write").select("field", F.lit("procedure").alias("source_type"),
                                                            F.col("proc").alias("name")).distinct())
    if columns is None:
        return _cap(procs, max_results)
    col_name = F.col("column_name") if case_sensitive else F.upper("column_name")
    fields = u.select("field").distinct()
    tabs = (columns.select(col_name.alias("field"), F.concat_ws(".", "table_schema", "table_name").alias("name"))
            .join(fields, "field", "left_semi").select("field", F.lit("table").alias("source_type"), "name").distinct())
    return _cap(procs.unionByName(tabs), max_results)


def _cap(df: DataFrame, n: int | None) -> DataFrame:
    """Optional per-field cap (procedures first, then tables, by name): a
    ranking filter, which Spark pre-limits per map task."""
    if n is None:
        return df
    from pyspark.sql import Window
    w = Window.partitionBy("field").orderBy(F.desc(F.col("source_type") == "procedure"), "name")
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def destinations(usage: DataFrame, field: str | None = None, case_sensitive: bool = False) -> DataFrame:
    """(field, name) of procedures reading the field."""
    u = usage if field is None else usage.filter(F.col("field") == _norm(field, case_sensitive))
    return u.filter(F.col("operation") == "read").select("field", F.col("proc").alias("name")).distinct()


def flow(usage: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """G13 totals per field: number of sources (as :func:`sources`) and destinations (as :func:`destinations`).

    The usage rows are read once: a procedure's operations on a field are put together first, then the procedures are counted.
    """
    per = usage.groupBy("field", "proc").agg(F.max(F.col("operation") == "write").alias("writes"), F.max(F.col("operation") == "read").alias("reads"))
    # a usage without a field has neither
    counted = per.groupBy("field").agg(F.count(F.when(F.col("writes") & F.col("field").isNotNull(), 1)).alias("w"),
                                       F.count(F.when(F.col("reads") & F.col("field").isNotNull(), 1)).cast("bigint").alias("total_destinations"))
    if columns is None:
        return counted.select("field", F.col("w").cast("bigint").alias("total_sources"), "total_destinations")
    having = (columns.select(F.upper("column_name").alias("field"), F.concat_ws(".", "table_schema", "table_name").alias("name")).distinct()
              .groupBy("field").agg(F.count(F.lit(1)).alias("t")))
    return (counted.join(having, "field", "left")
            .select("field", (F.col("w") + F.coalesce("t", F.lit(0))).cast("bigint").alias("total_sources"), "total_destinations"))


def trace(call_edges: DataFrame, usage: DataFrame, starts: DataFrame, field: str, max_depth: int | None = 10,
          table_edges: DataFrame | None = None, columns: DataFrame | None = None,
          case_sensitive: bool = False) -> DataFrame:
    """Rows ``(root, kind, procedure, operation, depth, detail)`` for a field.

    Walks callees from each start (breadth first, shortest depth, see
    :func:`procweave.operators.traversal.crawl`); every reached procedure
    using the field gives one ``step`` per operation (duplicates kept),
    ``source`` when it writes, ``destination`` when it reads, and each
    distinct transformation once; accessed tables that have the column give
    a ``source`` ``TABLE (table)`` step at the procedure's depth.
    """
    f = _norm(field, case_sensitive)
    # few procedures are reached or many: written, so that their number is known, and what they do with the field once
    reach = few(materialize(TR.crawl(call_edges, starts, max_depth).filter(F.col("node_type") == "procedure")
                            .select("root", F.col("node").alias("proc"), "depth"), "trace-r"))
    u = usage.filter(F.col("field") == f)
    hit = materialize(reach.join(u, "proc").select("root", "proc", "depth", "operation", "transformation"), "trace-h")
    steps = hit.select("root", F.lit("step").alias("kind"), F.col("proc").alias("procedure"), "operation", "depth",
                       F.lit(None).cast("string").alias("detail"))
    ops = hit.groupBy("root", "proc", "depth").agg(F.collect_set("operation").alias("ops"))
    src = ops.filter(F.array_contains("ops", "write")).select(
        "root", F.lit("source").alias("kind"), F.col("proc").alias("procedure"), F.lit("write").alias("operation"),
        "depth", F.lit(None).cast("string").alias("detail"))
    dst = ops.filter(F.array_contains("ops", "read")).select(
        "root", F.lit("destination").alias("kind"), F.col("proc").alias("procedure"), F.lit("read").alias("operation"),
        "depth", F.lit(None).cast("string").alias("detail"))
    trans = (hit.filter(F.col("operation") == "transform").groupBy("root", "transformation")
             .agg(F.min("depth").alias("depth"))
             .select("root", F.lit("transformation").alias("kind"), F.lit(None).cast("string").alias("procedure"),
                     F.lit("transform").alias("operation"), "depth", F.col("transformation").alias("detail")))
    out = steps.unionByName(src).unionByName(dst).unionByName(trans)
    if table_edges is not None and columns is not None:
        col_name = F.col("column_name") if case_sensitive else F.upper("column_name")
        has_col = columns.filter(col_name == f).select(F.concat_ws(".", "table_schema", "table_name").alias("table")).distinct()
        t = table_edges.select(F.col("src").alias("proc"), F.col("dst").alias("table")).join(has_col, "table")
        tab = reach.join(t, "proc").select(
            "root", F.lit("source").alias("kind"), F.col("proc").alias("procedure"),
            F.lit("read_from_table").alias("operation"), "depth", F.concat(F.col("table"), F.lit(" (table)")).alias("detail"))
        out = out.unionByName(tab)
    return out


def trace_fields(call_edges: DataFrame, usage: DataFrame, starts: DataFrame, max_depth: int | None = None,
                 table_edges: DataFrame | None = None, columns: DataFrame | None = None, fields: DataFrame | None = None,
                 case_sensitive: bool = False) -> DataFrame:
    """G10/J10 for many fields and many starts at once: (root, field, kind, procedure, operation, depth, detail, column_info).

    One crawl of ``starts(root)`` serves all fields (``fields(field)``, else every field in ``usage``). Rows are those of
    :func:`trace`; a table source also tells what the catalog knows of the column (``column_info``, a JSON object
    of the columns that ``columns`` has beside the names).
    """
    wanted = (usage if fields is None else fields).select("field").distinct()
    if not case_sensitive and fields is not None:
        wanted = wanted.select(F.upper("field").alias("field")).distinct()
    reach = few(materialize(TR.crawl(call_edges, starts, max_depth).filter(F.col("node_type") == "procedure")
                            .select("root", F.col("node").alias("proc"), "depth"), "trace-r"))
    hit = materialize(reach.join(usage if fields is None else usage.join(wanted, "field", "left_semi"), "proc")
                      .select("root", "proc", "depth", "field", "operation", "transformation"), "trace-h")
    text = F.lit(None).cast("string")

    def row(frame: DataFrame, kind: str, procedure, operation, detail, info=text) -> DataFrame:
        return frame.select("root", "field", F.lit(kind).alias("kind"), procedure.alias("procedure"), operation.alias("operation"), "depth",
                            detail.alias("detail"), info.alias("column_info"))

    proc = F.col("proc")
    used = (hit.groupBy("root", "field", "proc", "depth")
            .agg(F.max(F.col("operation") == "write").alias("writes"), F.max(F.col("operation") == "read").alias("reads")))
    changed = (hit.filter(F.col("operation") == "transform").groupBy("root", "field", "transformation").agg(F.min("depth").alias("depth")))
    out = (row(hit, "step", proc, F.col("operation"), text)
           .unionByName(row(used.filter("writes"), "source", proc, F.lit("write"), text))
           .unionByName(row(used.filter("reads"), "destination", proc, F.lit("read"), text))
           .unionByName(row(changed, "transformation", text, F.lit("transform"), F.col("transformation"))))
    if table_edges is None or columns is None:
        return out
    named = F.col("column_name") if case_sensitive else F.upper("column_name")
    more = [c for c in columns.columns if c not in ("table_schema", "table_name", "column_name")]
    known = (columns.select(named.alias("field"), F.concat_ws(".", "table_schema", "table_name").alias("table"),
                            (F.to_json(F.struct(*more)) if more else text).alias("info")).join(wanted, "field", "left_semi").distinct())
    known = few(materialize(known, "trace-k"))  # a table's name may stand in every access
    accessed = table_edges.select(F.col("src").alias("proc"), F.col("dst").alias("table")).distinct().join(known, "table")
    return out.unionByName(row(reach.join(accessed, "proc"), "source", proc, F.lit("read_from_table"), F.concat("table", F.lit(" (table)")), F.col("info")))
