"""End-to-end plans on the sf0.001 tables: fast index, procedure and table analysis, relationship map."""

import tempfile

from pyspark.sql import functions as F

from procweave.plans import jobs as P
from procweave.sinks import reports as RP
from procweave.sources import stores
from procweave.sources import tables as S


def test_fast_index_writes_everything(spark, sf_small):
    out = tempfile.mkdtemp(prefix="pw-fast-")
    res = P.fast_index(S.procedure_corpus(spark, sf_small), out)
    stats = spark.read.parquet(f"{out}/statistics").first()
    n = spark.read.parquet(f"{sf_small}/orders.parquet").count()
    assert stats["indexed_count"] == n and stats["procedures_extracted"] > 0
    docs = spark.read.parquet(f"{out}/documents")
    assert docs.count() == n and len(docs.first()["embedding"]) == 64
    nodes, edges = stores.load_graph(spark, f"{out}/graph")
    assert nodes.count() == n and edges.filter("edge_type = 'calls'").count() > 0
    assert set(res) == {"documents", "nodes", "edges", "statistics"}


def test_procedure_and_table_analysis(spark, sf_small):
    procs = P.analyze_procedures(S.procedure_corpus(spark, sf_small))
    st = procs["statistics"].first()
    assert st["total_procedures"] == procs["procedures"].count() and st["max_dependency_level"] > 0
    out = tempfile.mkdtemp(prefix="pw-k1-")
    RP.export_sections(procs, out)
    assert spark.read.parquet(f"{out}/hierarchy").count() == st["total_procedures"]

    tabs = P.analyze_tables(S.catalog_columns(spark, sf_small), S.catalog_key_rows(spark, sf_small),
                            S.catalog_index_rows(spark, sf_small))
    assert tabs["ddl"].filter(F.col("ddl").startswith("CREATE TABLE S")).count() == tabs["summary"].count()
    lv = {r["level"] for r in tabs["levels"].collect()}
    assert 0 in lv and max(lv) >= 1
    compat = P.analyze_tables(S.catalog_columns(spark, sf_small), S.catalog_key_rows(spark, sf_small),
                              S.catalog_index_rows(spark, sf_small), level_mode="compat")["levels"]
    assert {r["level"] for r in compat.collect()} <= {0, 1}


def test_relationship_map_outputs(spark, sf_small):
    res = P.relationship_map(S.ddl_objects(spark, sf_small), "2024-01-01 00:00:00")
    types = {r["type"] for r in res["relations"].select("type").distinct().collect()}
    assert types == {"FOREIGN_KEY", "SELECT_FROM", "JOIN", "INSERT_INTO", "UPDATE", "DELETE_FROM", "TRIGGER_ON",
                     "CALLS", "USES_SEQUENCE", "VIEW_DEPENDS", "CONTAINS_PROCEDURE", "CONTAINS_FUNCTION"}
    out = tempfile.mkdtemp(prefix="pw-dot-")
    RP.write_lines(res["dot"].drop("schema"), f"{out}/dot", single_file=True)
    text = "".join(r["value"] + "\n" for r in spark.read.text(f"{out}/dot").collect())
    assert text.startswith("digraph Relationships {") and text.rstrip().endswith("}")
