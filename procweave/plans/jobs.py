"""End-to-end jobs: fast code index, table catalog analysis, relationship map (V3, 3.2, 3.4).

Each job is one lazy plan from the source to the written outputs; the only
materialisations are the writes and the per-round state of iterative steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.operators import analysis as A
from procweave.operators import catalog as C
from procweave.operators import graph as G
from procweave.operators import relmap as RM
from procweave.operators import tokens as TK
from procweave.operators import traversal as TR
from procweave.operators import vector as V
from procweave.sinks import reports as RP
from procweave.session import materialize
from procweave.sources import stores


def fast_index(procs: DataFrame, out: str | None = None, dim: int = 64, encoder=None) -> dict[str, DataFrame]:
    """V3: procedures -> static analysis -> complexity -> documents ->
    embeddings -> graph -> statistics. With ``out`` the documents, graph and
    statistics are written there (Parquet)."""
    an = A.analyze(procs)
    docs = V.code_document(an)
    docs = V.embed_with(docs, encoder, "text", dim) if encoder else V.embed_hashing(docs, "text", dim)
    nodes, edges = G.build_graph(an)
    statistics = an.agg(F.count(F.lit(1)).cast("bigint").alias("indexed_count"),
                        F.round(F.avg("complexity_score"), 2).alias("avg_complexity")).select(
        "*", an.select(F.explode_outer("calls").alias("v")).agg(F.countDistinct("v").cast("bigint")).scalar().alias("procedures_extracted"),
        an.select(F.explode_outer("tables").alias("v")).agg(F.countDistinct("v").cast("bigint")).scalar().alias("tables_extracted"))
    result = {"documents": docs, "nodes": nodes, "edges": edges, "statistics": statistics}
    if out:
        p = out.rstrip("/")
        docs.write.mode("overwrite").parquet(f"{p}/documents")
        stores.save_graph(nodes, edges, f"{p}/graph")
        statistics.write.mode("overwrite").parquet(f"{p}/statistics")
    return result


def token_sections(metrics: DataFrame) -> dict[str, DataFrame]:
    """The token section of an export: statistics, every request, and the comparison of the compact format."""
    return {"token_totals": TK.totals(metrics), "token_overall": TK.overall(metrics), "token_by_operation": TK.by_operation(metrics),
            "token_requests": metrics, "token_comparison": TK.compare_overall(metrics), "token_comparison_by_operation": TK.compare_by_operation(metrics)}


def analyze_procedures(procs: DataFrame, token_metrics: DataFrame | None = None) -> dict[str, DataFrame]:
    """Procedure analysis (K1 sections): per-procedure facts with levels, hierarchy rows, statistics, and, where
    model requests were metered, their token sections."""
    an = A.analyze(procs)
    nodes = an.select(F.col("proc").alias("node"))
    e = A.call_edges(an).select(F.col("proc").alias("src"), F.col("callee").alias("dst"))
    lv = TR.dependency_levels(nodes, e)
    per = an.join(lv.select(F.col("node").alias("proc"), "level", "in_cycle"), "proc", "left")
    stats = per.agg(F.count(F.lit(1)).cast("bigint").alias("total_procedures"),
                    F.avg("complexity_score").alias("avg_complexity"),
                    F.coalesce(F.max("level"), F.lit(0)).cast("bigint").alias("max_dependency_level"))
    return {"procedures": per.drop("source_code"), "hierarchy": TR.hierarchy(lv), "statistics": stats,
            **(token_sections(token_metrics) if token_metrics is not None else {})}


def analyze_tables(columns: DataFrame, key_rows: DataFrame, index_rows: DataFrame,
                   dialect: str = "postgresql", level_mode: str = "longest_path") -> dict[str, DataFrame]:
    """Table catalog analysis (K2 sections): assembled columns, keys, indexes,
    DDL, complexity, FK graph and table levels."""
    cols = C.assemble_columns(columns, key_rows, dialect)
    fks = C.foreign_keys(key_rows)
    idx = C.assemble_indexes(index_rows, key_rows)
    summary = C.table_summary(columns, fks, idx)
    tables = columns.select(F.concat_ws(".", "table_schema", "table_name").alias("table")).distinct()
    fk_edges = C.resolve_fk_targets(fks, tables)
    if level_mode == "compat":
        ref = fk_edges.select(F.col("dst").alias("table")).distinct().withColumn("r", F.lit(1))
        levels = tables.join(ref, "table", "left").select("table", F.coalesce("r", F.lit(0)).cast("bigint").alias("level"))
    else:
        lv = TR.dependency_levels(tables.select(F.col("table").alias("node")), fk_edges.select("src", "dst"))
        levels = lv.select(F.col("node").alias("table"), "level")
    return {"columns": cols, "foreign_keys": fks, "indexes": idx, "ddl": C.table_ddl(cols, fks),
            "summary": summary, "statistics": C.table_statistics(summary), "fk_edges": fk_edges, "levels": levels}


def relationship_map(objects: DataFrame, generated_at: str) -> dict[str, DataFrame]:
    """Relationship map (K3, K12, K13): relations, degrees, the ten most referenced and most referencing objects,
    isolated objects, relations by type, DOT and Markdown lines, all schemas at once."""
    rels = materialize(RM.relations(objects), "relations")  # many consumers: extract once
    deg = RM.degrees(objects, rels)
    deg = materialize(deg, "degrees")
    return {"relations": rels, "degrees": deg, "object_counts": RM.object_counts(objects),
            "top_referenced": RM.top_nodes(deg, "in_degree"), "top_referencing": RM.top_nodes(deg, "out_degree"),
            "isolated": RM.isolated(deg), "relations_by_type": RM.relations_by_type(rels),
            "dot": RM.dot_lines(objects, rels), "markdown": RP.markdown_report(objects, rels, deg, generated_at)}
