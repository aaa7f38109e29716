"""The tool surface as one object: eleven functions that return DataFrames.

``Engine(spark, procedures=..., catalog=..., documents=...)`` holds the
inputs; each tool builds a plan over them. ``to_json`` wraps a result in the
``{success, data}`` / ``{success, error}`` envelope for callers that want
text. Lookups use the name resolution of the graph (exact id first, then
``.name`` suffix / bare name, smallest id).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.functions import constants as K
from procweave.operators import analysis as A
from procweave.operators import catalog as C
from procweave.operators import graph as G
from procweave.operators import lineage as LN
from procweave.operators import profile as PR
from procweave.operators import traversal as TR
from procweave.operators import vector as V


KEY_ROWS = ("constraint_name string, constraint_type string, table_schema string, table_name string, column_name string, "
            "ordinal int, ref_schema string, ref_table string, ref_column string, delete_rule string, update_rule string")


def _positive(k: int) -> int:
    if int(k) < 1:
        raise ValueError("top_k must be at least 1")
    return int(k)


class Engine:
    def __init__(self, spark: SparkSession, procedures: DataFrame | None = None,
                 catalog: dict[str, DataFrame] | None = None, documents: DataFrame | None = None,
                 tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.analysis = A.analyze(procedures) if procedures is not None else None
        self.catalog = catalog or {}
        self.documents = documents
        for name, df in (tables or {}).items():
            df.createOrReplaceTempView(name)
        self._tables = tables or {}
        tnodes = None
        if self.catalog.get("columns") is not None:
            tnodes = self.catalog["columns"].select(
                F.concat_ws(".", "table_schema", "table_name").alias("id"), F.lit("table").alias("node_type"),
                F.col("table_schema").alias("schema"), F.col("table_name").alias("name")).distinct()
        nodes, edges = (G.build_graph(self.analysis, tnodes) if self.analysis is not None else (tnodes, None))
        if tnodes is not None:
            if self.catalog.get("keys") is not None:
                tables_df = tnodes.select(F.col("id").alias("table"))
                fk = C.resolve_fk_targets(C.foreign_keys(self.catalog["keys"]), tables_df).select(
                    "src", "dst", F.lit("references").alias("edge_type"), F.lit("foreign_key").alias("relationship"))
                edges = fk if edges is None else edges.unionByName(fk)
        self.nodes, self.edges = nodes, edges

    def _resolve(self, name: str, node_type: str) -> DataFrame:
        return G.find_node(self.nodes, name, node_type)

    # 1
    def query_procedure(self, name: str, include_dependencies: bool = True, include_callers: bool = False) -> DataFrame:
        rid = self._resolve(name, "procedure").select(F.col("resolved_id").alias("id"))
        base = self.nodes.join(rid, "id", "left_semi").select("id", "name", "schema", "complexity_score") \
            .withColumn("rel", F.lit("self")).withColumn("target", F.lit(None).cast("string"))
        out = base
        if include_dependencies:
            ctx = G.procedure_context(self.nodes, self.edges).join(rid, "id", "left_semi")
            out = out.unionByName(ctx, allowMissingColumns=True)
        if include_callers:
            cl = G.callers(self.edges, rid).select("id", F.lit("callers").alias("rel"), F.col("caller").alias("target"))
            out = out.unionByName(cl, allowMissingColumns=True)
        return out

    # 2
    def query_table(self, name: str, include_columns: bool = True, include_relationships: bool = True) -> DataFrame:
        rid = self._resolve(name, "table")
        t = rid.select(F.col("resolved_id").alias("table"))
        out = t.select("table", F.lit("self").alias("kind"), F.lit(None).cast("string").alias("value"))
        if include_columns and self.catalog.get("columns") is not None:
            keys = self.catalog.get("keys")
            if keys is None:  # a catalog without key rows: no column is marked
                keys = self.spark.createDataFrame([], KEY_ROWS)
            cols = C.assemble_columns(self.catalog["columns"], keys).dropDuplicates(["table_schema", "table_name", "column_name"])
            cols = cols.withColumn("table", F.concat_ws(".", "table_schema", "table_name")).join(t, "table", "left_semi")
            out = out.unionByName(cols.select("table", F.lit("column").alias("kind"),
                                              F.concat_ws(" ", "column_name", "data_type").alias("value")))
        if include_relationships:
            rel = self.edges.join(t.select(F.col("table").alias("src")), "src", "left_semi") \
                .select(F.col("src").alias("table"), F.col("relationship").alias("kind"), F.col("dst").alias("value"))
            out = out.unionByName(rel)
        return out

    # 3
    def analyze_field(self, field: str, procedure: str | None = None, table: str | None = None) -> DataFrame:
        """Rows ``(part, proc, field, operation, kind, context, transformation)``: the
        usage of the field, its definition in the catalog (``definition``: table and
        type) and the key relationships of its tables (``relationship``). ``table``
        restricts definitions and relationships to that table."""
        parts = []
        empty = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
        if self.analysis is not None:
            usage = A.field_usage_one(A.field_usage(self.analysis), field, procedure)
            parts.append(usage.drop("seq").select(F.lit("usage").alias("part"), "proc", "field", "operation", "kind", "context", "transformation"))
        if self.catalog.get("columns") is not None:
            cols = self.catalog["columns"].filter(F.upper("column_name") == field.upper()) \
                .withColumn("table", F.concat_ws(".", "table_schema", "table_name"))
            if table is not None:
                cols = cols.join(self._resolve(table, "table").select(F.col("resolved_id").alias("table")), "table", "left_semi")
            cols = cols.select("table", "column_name", "data_type").distinct()
            parts.append(cols.select(F.lit("definition").alias("part"), *empty("proc"), F.col("column_name").alias("field"),
                                     *empty("operation"), F.lit("column").alias("kind"),
                                     F.concat_ws(" ", "table", "data_type").alias("context"), *empty("transformation")))
            if self.edges is not None:
                ends = cols.select("table").distinct()
                fk = self.edges.filter(F.col("edge_type") == "references").select("src", "dst", "relationship").distinct()
                rel = (fk.join(ends.select(F.col("table").alias("src")), "src", "left_semi")
                       .unionByName(fk.join(ends.select(F.col("table").alias("dst")), "dst", "left_semi"))).distinct()
                parts.append(rel.select(F.lit("relationship").alias("part"), *empty("proc"), F.lit(field.upper()).alias("field"),
                                        *empty("operation"), F.col("relationship").alias("kind"),
                                        F.concat_ws(" -> ", "src", "dst").alias("context"), *empty("transformation")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # 4
    def trace_field_flow(self, field: str, start_procedure: str, max_depth: int = 10) -> DataFrame:
        calls = self.edges.filter(F.col("edge_type") == "calls").select("src", "dst")
        tabs = self.edges.filter(F.col("edge_type") == "accesses").select("src", "dst")
        rid = self._resolve(start_procedure, "procedure").select(F.col("resolved_id").alias("root"))
        usage = A.field_usage(self.analysis).join(self.analysis.select("proc", "id"), "proc").drop("proc") \
            .withColumnRenamed("id", "proc")
        return LN.trace(calls, usage, rid, field, max_depth, tabs, self.catalog.get("columns"))

    # 5
    def crawl_procedure(self, name: str, max_depth: int = 5, include_tables: bool = True) -> DataFrame:
        calls = self.edges.filter(F.col("edge_type") == "calls").select("src", "dst")
        tabs = self.edges.filter(F.col("edge_type") == "accesses").select("src", "dst") if include_tables else None
        rid = self._resolve(name, "procedure").select(F.col("resolved_id").alias("root"))
        return TR.crawl(calls, rid, max_depth, tabs)

    # 6
    def execute_query(self, query: str, limit: int = K.DEFAULT_QUERY_LIMIT) -> DataFrame:
        return PR.guarded_query(self.spark, query, limit)

    # 7
    def sample_table_data(self, table: str, limit: int = K.DEFAULT_SAMPLE, columns: list[str] | None = None) -> DataFrame:
        return PR.sample_rows(self._tables[table], columns, limit)

    # 8
    def get_field_statistics(self, table: str, field: str) -> DataFrame:
        return PR.field_profile(self._tables[table], [field])

    # 9, 10
    def semantic_search_tables(self, query_vec, top_k: int = 5, threshold: float = 0.0) -> DataFrame:
        return self._semantic(query_vec, top_k, threshold, "table")

    def semantic_search_procedures(self, query_vec, top_k: int = 5, threshold: float = 0.0) -> DataFrame:
        return self._semantic(query_vec, top_k, threshold, "procedure")

    def _semantic(self, query_vec, top_k, threshold, node_type):
        hits = V.search(self.documents, V.query_vector(query_vec), _positive(top_k), threshold, id_col="node_id",
                        type_col="node_type", node_type=node_type)
        return hits.join(self.documents.select("node_id", V.preview("text").alias("preview")), "node_id", "left")

    # 11
    def hybrid_search(self, query_vec, top_k: int = 5) -> DataFrame:
        return V.hybrid_search(self.documents, self.edges, V.query_vector(query_vec), _positive(top_k))

    @staticmethod
    def to_json(df: DataFrame, max_rows: int = K.MAX_QUERY_LIMIT) -> str:
        """Envelope for text callers: at most ``max_rows`` rows, and ``truncated``
        says whether there are more (larger results are written, not collected)."""
        try:
            rows = [r.asDict(recursive=True) for r in df.limit(max_rows + 1).collect()]
            return json.dumps({"success": True, "data": rows[:max_rows], "truncated": len(rows) > max_rows},
                              default=str, ensure_ascii=False)
        except Exception as ex:  # noqa: BLE001
            return json.dumps({"success": False, "error": str(ex)}, ensure_ascii=False)
