"""Registered queries: one callable per operator family, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (or the corpora Spark derives from
them) in full, so its work grows with the data. Output columns are scalar
and aliased so they line up with the DuckDB oracles in :mod:`procweave.plans.oracles`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.functions.scoring import complexity_class
from procweave.operators import analysis as A
from procweave.operators import cycles as CY
from procweave.operators import graph as G
from procweave.operators import reach as RE
from procweave.operators import traversal as TR
from procweave.operators import vector_index as VI
from procweave.session import job_dir, materialize
from procweave.sinks import file_tree as FT
from procweave.sinks.bucket_store import BucketStore
from procweave.sources.tables import procedure_corpus, procedure_corpus_cycles, procedure_corpus_cyclic, read_table
from procweave.streaming import keyed_graph as KG

QUERIES: dict = {}


def register(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def corpus_analysis(spark: SparkSession, sf_dir: str, variant: str = "static") -> DataFrame:
    return A.analyze(procedure_corpus(spark, sf_dir), variant)


# ------------------------------------------------------------- extraction
@register("proc_calls")
def proc_calls(spark, sf_dir):
    an = corpus_analysis(spark, sf_dir)
    return A.call_edges(an).select("proc", "callee")


@register("proc_calls_basic")
def proc_calls_basic(spark, sf_dir):
    an = corpus_analysis(spark, sf_dir, "basic")
    return A.call_edges(an).select("proc", "callee")


@register("proc_tables")
def proc_tables(spark, sf_dir):
    return A.table_edges(corpus_analysis(spark, sf_dir)).select("proc", "table_name")


@register("proc_tables_basic")
def proc_tables_basic(spark, sf_dir):
    return A.table_edges(corpus_analysis(spark, sf_dir, "basic")).select("proc", "table_name")


@register("proc_complexity")
def proc_complexity(spark, sf_dir):
    an = corpus_analysis(spark, sf_dir)
    return an.select("proc", "complexity_score", complexity_class("complexity_score").alias("complexity_class"), "lines")


@register("top_called")
def top_called(spark, sf_dir):
    return G.top_called_procedures(A.shared(corpus_analysis(spark, sf_dir), A.CALL_COLUMNS), 10)


@register("proc_select_fields")
def proc_select_fields(spark, sf_dir):
    an = corpus_analysis(spark, sf_dir)
    return an.select("proc", F.explode_outer("select_fields").alias("u")).filter(F.col("u").isNotNull()).select("proc", "u.field", "u.context")


@register("proc_update_fields")
def proc_update_fields(spark, sf_dir):
    an = corpus_analysis(spark, sf_dir)
    return an.select("proc", F.explode_outer("update_fields").alias("u")).filter(F.col("u").isNotNull()).select("proc", "u.field", "u.context")


@register("proc_transforms")
def proc_transforms(spark, sf_dir):
    an = corpus_analysis(spark, sf_dir)
    return an.select("proc", F.explode_outer("transformations").alias("u")).filter(F.col("u").isNotNull()).select("proc", "u.field", "u.transformation")


@register("field_usage")
def field_usage(spark, sf_dir):
    return A.field_usage(corpus_analysis(spark, sf_dir)).drop("seq")


@register("field_usage_one")
def field_usage_one(spark, sf_dir):
    """Usage rows of field ``total`` (looked up upper-case) in procedures whose key ends with 7."""
    usage = A.field_usage(corpus_analysis(spark, sf_dir))
    return A.field_usage_one(usage, "total", procedure="7").drop("seq")


@register("proc_params")
def proc_params(spark, sf_dir):
    return A.parameter_rows(corpus_analysis(spark, sf_dir), "static")


@register("proc_signature_params")
def proc_signature_params(spark, sf_dir):
    return A.parameter_rows(corpus_analysis(spark, sf_dir), "signature")


@register("proc_variables")
def proc_variables(spark, sf_dir):
    return corpus_analysis(spark, sf_dir).select("proc", F.explode_outer("variables").alias("variable")).filter(F.col("variable").isNotNull())


@register("proc_control")
def proc_control(spark, sf_dir):
    """P16 long form: (proc, structure, n) for every structure that occurs."""
    an = corpus_analysis(spark, sf_dir)
    kinds = ["if", "loop", "for", "while", "case", "exception"]
    st = F.explode(F.array(*[F.struct(F.lit(k.upper()).alias("structure"), F.col(f"control.{k}").alias("n"))
                             for k in kinds])).alias("s")
    return an.select("proc", st).select("proc", "s.structure", "s.n").filter("n > 0")


def _levels(spark, sf_dir, cyclic=False, compat=False, extra_columns=()):
    procs = procedure_corpus_cyclic(spark, sf_dir) if cyclic else procedure_corpus(spark, sf_dir)
    an = A.shared(A.analyze(procs), A.CALL_COLUMNS + list(extra_columns))
    nodes = an.select(F.col("proc").alias("node"))
    edges = A.call_edges(an).select(F.col("proc").alias("src"), F.col("callee").alias("dst"))
    return TR.dependency_levels(nodes, edges, drop_self=True, compat=compat), an


@register("proc_levels")
def proc_levels(spark, sf_dir):
    lv, _ = _levels(spark, sf_dir)
    return lv.select(F.col("node").alias("proc"), "level")


@register("hierarchy")
def hierarchy_rows(spark, sf_dir):
    """Level -> its procedures in order of name: a row per procedure with its position in the level's list, beside
    the level's number of procedures, first and last name."""
    lv, _ = _levels(spark, sf_dir)
    placed = RE.numbered(lv.select("level", F.col("node").alias("proc")).orderBy("level", "proc"), "hierarchy")
    of = placed.groupBy("level").agg(F.count(F.lit(1)).cast("bigint").alias("n_procedures"), F.min("proc").alias("first_name"),
                                     F.max("proc").alias("last_name"), F.min("number").alias("first"))
    return (placed.join(F.broadcast(of.withColumnRenamed("level", "_level")), F.col("level").eqNullSafe(F.col("_level")))
            .select("level", "n_procedures", "first_name", "last_name", (F.col("number") - F.col("first") + 1).alias("position"), "proc"))


@register("hierarchy_rows")
def hierarchy_names(spark, sf_dir):
    """Every procedure under its level."""
    lv, _ = _levels(spark, sf_dir)
    return TR.hierarchy(lv).select("level", F.col("node").alias("proc"))


@register("proc_statistics")
def proc_statistics(spark, sf_dir):
    """A1: total procedures, average complexity, maximum dependency level."""
    lv, an = _levels(spark, sf_dir)
    s = an.agg(F.count(F.lit(1)).cast("bigint").alias("total_procedures"),
               F.round(F.avg("complexity_score"), 6).alias("avg_complexity"))
    m = lv.agg(F.coalesce(F.max("level"), F.lit(0)).cast("bigint")).scalar()
    return s.select("*", m.alias("max_dependency_level"))


@register("index_statistics")
def index_statistics(spark, sf_dir):
    """A3: indexed count, distinct callees and tables over the corpus, avg complexity (2 dp)."""
    an = corpus_analysis(spark, sf_dir)
    calls = an.select(F.explode_outer("calls").alias("v")).agg(F.countDistinct("v").cast("bigint")).scalar()
    tabs = an.select(F.explode_outer("tables").alias("v")).agg(F.countDistinct("v").cast("bigint")).scalar()
    base = an.agg(F.count(F.lit(1)).cast("bigint").alias("indexed_count"),
                  F.round(F.avg("complexity_score"), 2).alias("avg_complexity"))
    return base.select("*", calls.alias("procedures_extracted"), tabs.alias("tables_extracted"))


@register("cycle_members")
def cycle_members(spark, sf_dir):
    """G17 on the corpus with one back edge (P0 -> largest procedure)."""
    an = A.shared(A.analyze(procedure_corpus_cyclic(spark, sf_dir)), A.CALL_COLUMNS)
    nodes = an.select(F.col("proc").alias("node"))
    edges = A.call_edges(an).select(F.col("proc").alias("src"), F.col("callee").alias("dst"))
    return TR.cycle_members(nodes, edges, drop_self=True).select(F.col("node").alias("proc"), "scc_size")


@register("proc_levels_cyclic")
def proc_levels_cyclic(spark, sf_dir):
    """G16 default mode on the cyclic corpus: acyclic nodes get levels, the rest in_cycle."""
    lv, _ = _levels(spark, sf_dir, cyclic=True)
    return lv.select(F.col("node").alias("proc"), "level", "in_cycle")


def _nested_cycles(spark, sf_dir):
    an = A.shared(A.analyze(procedure_corpus_cycles(spark, sf_dir)), ["proc", "id", "calls"])
    return an.select(F.col("proc").alias("node")), A.call_edges(an).select(F.col("proc").alias("src"), F.col("callee").alias("dst"))


@register("cycle_paths")
def cycle_paths(spark, sf_dir):
    """Every elementary cycle of up to eight procedures, written out, on the corpus of nested cycles."""
    found = CY.cycle_paths(*_nested_cycles(spark, sf_dir))
    return found.select("start", "length", F.array_join(F.concat("path", F.array("start")), " -> ").alias("cycle"))


@register("proc_levels_condensed")
def proc_levels_condensed(spark, sf_dir):
    """G16 on the corpus of nested cycles: every procedure has a level, a component counting as one node."""
    return CY.condensed_levels(*_nested_cycles(spark, sf_dir)).withColumnRenamed("node", "proc")


def _graph(spark, sf_dir):
    an = A.shared(corpus_analysis(spark, sf_dir))
    nodes, edges = G.build_graph(an)
    return an, nodes, edges


@register("graph_nodes")
def graph_nodes(spark, sf_dir):
    return G.procedure_nodes(corpus_analysis(spark, sf_dir))  # one consumer: nothing is written


@register("graph_edges")
def graph_edges(spark, sf_dir):
    _, _, edges = _graph(spark, sf_dir)
    return edges


@register("graph_statistics")
def graph_statistics(spark, sf_dir):
    _, nodes, edges = _graph(spark, sf_dir)
    return G.statistics(nodes, edges)


@register("callers")
def callers_all(spark, sf_dir):
    """G6 for every procedure: (id, caller) over resolved call edges (self-calls included)."""
    _, nodes, edges = _graph(spark, sf_dir)
    return G.callers(edges, nodes.filter(F.col("node_type") == "procedure").select("id"))


@register("proc_context")
def proc_context(spark, sf_dir):
    _, nodes, edges = _graph(spark, sf_dir)
    return G.procedure_context(nodes, edges)


@register("total_dependencies")
def total_dependencies(spark, sf_dir):
    """Out-edge count per procedure node (calls + accesses, with multiplicity)."""
    _, nodes, edges = _graph(spark, sf_dir)
    p = nodes.filter(F.col("node_type") == "procedure").select(F.col("id").alias("src"))
    return (p.join(edges, "src", "left").groupBy(F.col("src").alias("id"))
            .agg(F.count("dst").cast("bigint").alias("total_dependencies")))


def _crawl_inputs(spark, sf_dir):
    _, nodes, edges = _graph(spark, sf_dir)
    calls = edges.filter(F.col("edge_type") == "calls").select("src", "dst")
    tabs = edges.filter(F.col("edge_type") == "accesses").select("src", "dst")
    # the query set: every procedure whose number is divisible by 100, against the whole graph
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    roots = nodes.filter((F.col("node_type") == "procedure") & (number % 100 == 0)).select(F.col("id").alias("root"))
    return calls, tabs, roots


@register("crawl")
def crawl_all(spark, sf_dir):
    """The whole reach of every procedure of the query set."""
    calls, tabs, roots = _crawl_inputs(spark, sf_dir)
    return TR.crawl(calls, roots, None, tabs)


@register("crawl_summary")
def crawl_summary_all(spark, sf_dir):
    calls, tabs, roots = _crawl_inputs(spark, sf_dir)
    return TR.crawl_summary(TR.crawl(calls, roots, 5, tabs))  # the tool's default depth


@register("impact")
def impact_all(spark, sf_dir):
    calls, tabs, roots = _crawl_inputs(spark, sf_dir)
    return TR.impact(calls, tabs, roots, 3)


def _reach_inputs(spark, sf_dir, procs=None):
    an = A.shared(A.analyze(procs) if procs is not None else corpus_analysis(spark, sf_dir))
    nodes, edges = G.build_graph(an)
    ends = nodes.filter(F.col("node_type") == "procedure").select(F.col("id").alias("node"), "complexity_score")
    return ends, edges.filter(F.col("edge_type") == "calls").select("src", "dst"), edges.filter(F.col("edge_type") == "accesses").select("src", "dst")


@register("crawl_summary_all")
def crawl_summary_every(spark, sf_dir):
    """A20 of every procedure to the tool's default depth 5."""
    return RE.reach_counts(*_reach_inputs(spark, sf_dir), 5).withColumnRenamed("node", "root")


@register("crawl_summary_whole")
def crawl_summary_whole(spark, sf_dir):
    """A20 of every procedure over its whole reach, on the corpus of nested cycles."""
    return RE.reach_counts(*_reach_inputs(spark, sf_dir, procedure_corpus_cycles(spark, sf_dir))).withColumnRenamed("node", "root")


@register("impact_all")
def impact_every(spark, sf_dir):
    """A21 of every procedure to the tool's default depth 3."""
    return RE.impact_all(*_reach_inputs(spark, sf_dir), 3)


@register("impact_whole")
def impact_whole(spark, sf_dir):
    """A21 of every procedure over its whole reach, on the condensed graph of the corpus of nested cycles."""
    nodes, calls, tables = _reach_inputs(spark, sf_dir, procedure_corpus_cycles(spark, sf_dir))
    return RE.impact_all(nodes, calls, tables, None, CY.components(nodes, calls))


@register("crawl_tree")
def crawl_tree(spark, sf_dir):
    """The dependency tree, to depth 5, of every procedure of the query set (numbers divisible by 100)."""
    nodes, calls, tables = _reach_inputs(spark, sf_dir)
    roots = nodes.filter(F.regexp_extract("node", r"(\d+)$", 1).cast("bigint") % 100 == 0).select(F.col("node").alias("root"))
    columns = S.catalog_columns(spark, sf_dir).select(F.concat(F.lit("T_"), F.substring("table_name", 2, 30)).alias("table"))
    return RE.crawl_tree(nodes, calls, tables, roots, 5, columns)


# ------------------------------------------------------------- catalog
from procweave.operators import catalog as C  # noqa: E402
from procweave.sources import tables as S  # noqa: E402


def _catalog(spark, sf_dir, lines=None):
    cols = S.catalog_columns(spark, sf_dir, lines)
    keys = S.catalog_key_rows(spark, sf_dir, lines)
    idx_rows = S.catalog_index_rows(spark, sf_dir, lines)
    return cols, keys, idx_rows


def _catalog_lines_once(spark, sf_dir):
    """The catalog's rows written once, for queries that assemble several parts of it."""
    from procweave.session import materialize
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus"]
    return materialize(S.catalog_lines(spark, sf_dir).select(*columns), "catalog-lines")


@register("catalog_columns")
def catalog_columns(spark, sf_dir):
    cols, keys, _ = _catalog(spark, sf_dir)
    return C.assemble_columns(cols, keys).withColumn("ordinal", F.col("ordinal").cast("bigint"))


@register("field_nodes")
def field_nodes(spark, sf_dir):
    """A node for each catalog column."""
    cols, keys, _ = _catalog(spark, sf_dir)
    return G.field_graph(C.assemble_columns(cols, keys))[0]


@register("field_relationships")
def field_relationships(spark, sf_dir):
    """The tables that every field name belongs to."""
    cols, keys, _ = _catalog(spark, sf_dir)
    nodes, edges = G.field_graph(C.assemble_columns(cols, keys))
    return G.field_relationships(nodes, edges)


@register("table_info")
def table_info(spark, sf_dir):
    """G5 for every table: its columns with types, then its foreign keys (table, kind, value)."""
    cols, keys, _ = _catalog(spark, sf_dir)
    key = F.concat_ws(".", "table_schema", "table_name").alias("table")
    columns = C.assemble_columns(cols, keys).select(key, F.lit("column").alias("kind"), F.concat_ws(" ", "column_name", "data_type").alias("value"))
    _, e = _fk_graph(spark, sf_dir)
    return columns.unionByName(e.select(F.col("src").alias("table"), F.lit("foreign_key").alias("kind"), F.col("dst").alias("value")))


@register("catalog_pk")
def catalog_pk(spark, sf_dir):
    _, keys, _ = _catalog(spark, sf_dir)
    return C.primary_keys(keys)


@register("catalog_fks")
def catalog_fks(spark, sf_dir):
    _, keys, _ = _catalog(spark, sf_dir)
    return C.foreign_keys(keys)


@register("catalog_indexes")
def catalog_indexes(spark, sf_dir):
    _, keys, idx_rows = _catalog(spark, sf_dir)
    return C.assemble_indexes(idx_rows, keys)


@register("type_text")
def type_text_all(spark, sf_dir):
    cols, _, _ = _catalog(spark, sf_dir)
    return cols.select("table_schema", "table_name", "column_name",
                       *[C.type_text(d).alias(d) for d in ("postgresql", "mssql", "mysql", "oracle")])


@register("table_ddl")
def table_ddl(spark, sf_dir):
    cols, keys, _ = _catalog(spark, sf_dir)
    return C.table_ddl(C.assemble_columns(cols, keys), C.foreign_keys(keys))


def _summary(spark, sf_dir, lines=None):
    cols, keys, idx_rows = _catalog(spark, sf_dir, lines)
    return C.table_summary(cols, C.foreign_keys(keys), C.assemble_indexes(idx_rows, keys))


@register("table_complexity")
def table_complexity(spark, sf_dir):
    return _summary(spark, sf_dir)


@register("table_statistics")
def table_statistics(spark, sf_dir):
    return C.table_statistics(_summary(spark, sf_dir))


def _fk_graph(spark, sf_dir, compat=False, lines=None):
    cols, keys, _ = _catalog(spark, sf_dir, lines)
    tables = cols.select(F.concat_ws(".", "table_schema", "table_name").alias("table")).distinct()
    return tables, C.resolve_fk_targets(C.foreign_keys(keys), tables, compat=compat)


@register("fk_edges")
def fk_edges(spark, sf_dir):
    _, e = _fk_graph(spark, sf_dir)
    return e


@register("table_levels")
def table_levels(spark, sf_dir):
    """G18 longest-path mode: level = longest FK chain down to a table without FKs."""
    tables, e = _fk_graph(spark, sf_dir, lines=_catalog_lines_once(spark, sf_dir))
    lv = TR.dependency_levels(tables.select(F.col("table").alias("node")), e.select("src", "dst"))
    return lv.select(F.col("node").alias("table"), "level")


@register("table_levels_compat")
def table_levels_compat(spark, sf_dir):
    """G18 compat mode: 1 when some table references it, else 0."""
    tables, e = _fk_graph(spark, sf_dir)
    referenced = e.select(F.col("dst").alias("table")).distinct().withColumn("r", F.lit(1))
    return (tables.join(referenced, "table", "left")
            .select("table", F.coalesce("r", F.lit(0)).cast("bigint").alias("level")))


# ------------------------------------------------------------- relationship map
from procweave.operators import relmap as RM  # noqa: E402


def _rels(spark, sf_dir):
    from procweave.session import materialize
    objs = materialize(S.ddl_objects(spark, sf_dir), "objects")  # read by relations, name joins and node lists
    return objs, RM.relations(objs)


def _degrees(spark, sf_dir):
    from procweave.session import materialize
    objs, r = _rels(spark, sf_dir)
    return RM.degrees(objs, materialize(r, "relations"))  # extracted once for both directions


@register("relations")
def relations(spark, sf_dir):
    _, r = _rels(spark, sf_dir)
    return r.drop("ord")


@register("relations_by_type")
def relations_by_type(spark, sf_dir):
    _, r = _rels(spark, sf_dir)
    return RM.relations_by_type(r)


@register("degrees")
def degrees(spark, sf_dir):
    return _degrees(spark, sf_dir)


@register("top_referenced")
def top_referenced(spark, sf_dir):
    return RM.top_nodes(_degrees(spark, sf_dir), "in_degree")


@register("top_referencing")
def top_referencing(spark, sf_dir):
    return RM.top_nodes(_degrees(spark, sf_dir), "out_degree")


@register("isolated_objects")
def isolated_objects(spark, sf_dir):
    return RM.isolated(_degrees(spark, sf_dir))


@register("object_counts")
def object_counts(spark, sf_dir):
    return RM.object_counts(S.ddl_objects(spark, sf_dir))


@register("package_contains")
def package_contains(spark, sf_dir):
    _, r = _rels(spark, sf_dir)
    return r.filter(F.col("type").isin("CONTAINS_PROCEDURE", "CONTAINS_FUNCTION")).drop("ord")


@register("sequence_uses")
def sequence_uses(spark, sf_dir):
    _, r = _rels(spark, sf_dir)
    return r.filter(F.col("type") == "USES_SEQUENCE").drop("ord")


@register("view_depends")
def view_depends(spark, sf_dir):
    _, r = _rels(spark, sf_dir)
    return r.filter(F.col("type") == "VIEW_DEPENDS").drop("ord")


@register("dot_lines")
def dot_lines(spark, sf_dir):
    objs, r = _rels(spark, sf_dir)
    return RM.dot_lines(objs, r).select("schema", F.col("section").cast("bigint").alias("section"), "line")


# ------------------------------------------------------------- profiles, samples, guarded SQL
from procweave.operators import profile as PR  # noqa: E402
from procweave.operators import tokens as TK  # noqa: E402


@register("field_profile_lineitem")
def field_profile_lineitem(spark, sf_dir):
    li = S.read_table(spark, sf_dir, "lineitem", deal=False)
    return PR.field_profile(li, li.columns)


@register("field_profile_orders")
def field_profile_orders(spark, sf_dir):
    o = S.read_table(spark, sf_dir, "orders", deal=False)
    return PR.field_profile(o, o.columns)


@register("sample_orders")
def sample_orders(spark, sf_dir):
    o = S.read_table(spark, sf_dir, "orders")
    return PR.sample_rows(o, ["o_orderkey", "o_orderstatus", "o_totalprice"], limit=10, order_by=["o_orderkey"])


@register("guarded_sql")
def guarded_sql(spark, sf_dir):
    S.read_table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    q = ("-- priorities\nSELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total "
         "FROM orders GROUP BY o_orderpriority;")
    return PR.guarded_query(spark, q, limit=100)


@register("sql_audit")
def sql_audit(spark, sf_dir):
    return PR.audit_queries(S.query_log(spark, sf_dir)).select("id", "allowed", "error")


@register("limit_policy")
def limit_policy(spark, sf_dir):
    return PR.audit_queries(S.query_log(spark, sf_dir)).select("id", "limited_sql")


# ------------------------------------------------------------- token metrics
@register("token_totals")
def token_totals(spark, sf_dir):
    return TK.totals(S.token_metrics(spark, sf_dir))


@register("token_by_operation")
def token_by_operation(spark, sf_dir):
    return TK.by_operation(S.token_metrics(spark, sf_dir))


@register("token_overall")
def token_overall(spark, sf_dir):
    return TK.overall(S.token_metrics(spark, sf_dir))


@register("token_compare")
def token_compare(spark, sf_dir):
    return TK.compare_by_operation(S.token_metrics(spark, sf_dir))


@register("token_compare_overall")
def token_compare_overall(spark, sf_dir):
    return TK.compare_overall(S.token_metrics(spark, sf_dir))


@register("token_usage_json")
def token_usage_json(spark, sf_dir):
    r = S.llm_responses(spark, sf_dir)
    u = TK.parse_usage(TK.usage_from_response("response"))
    return r.select("request_id", u.alias("u")).select("request_id", "u.*")


# ------------------------------------------------------------- vector search
from procweave.operators import vector as V  # noqa: E402

# The default threshold 0.0 keeps only near-duplicates under squared-L2
# similarity on these unit vectors (cos >= 0.5); -1 keeps the ranking whole.
SEARCH_THRESHOLD = -1.0


def _embeddings(spark, sf_dir):
    return S.read_table(spark, sf_dir, "embeddings")


def _query_vec(emb, vec_id=0):
    """The query embedding: one stored vector, read as a parameter."""
    return V.query_vector(emb.filter(F.col("vec_id") == vec_id).select("embedding").first()["embedding"])


@register("semantic_topk")
def semantic_topk(spark, sf_dir):
    emb = _embeddings(spark, sf_dir)
    return V.search(emb, _query_vec(emb), k=10, threshold=SEARCH_THRESHOLD, id_col="vec_id")


@register("cosine_topk")
def cosine_topk(spark, sf_dir):
    emb = _embeddings(spark, sf_dir)
    return V.search(emb, _query_vec(emb), k=10, threshold=SEARCH_THRESHOLD, metric="cosine", id_col="vec_id")


@register("semantic_topk_multi")
def semantic_topk_multi(spark, sf_dir):
    """Top-5 neighbours of every vector whose id is divisible by 100, among all vectors."""
    emb = _embeddings(spark, sf_dir)
    queries = emb.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return V.search_many(emb, queries, k=5, threshold=SEARCH_THRESHOLD, id_col="vec_id")


@register("semantic_topk_nodes")
def semantic_topk_nodes(spark, sf_dir):
    """The same search over string node ids, by cosine, as graph documents are searched."""
    emb = _embeddings(spark, sf_dir).select(F.concat(F.lit("APP.N"), F.col("vec_id").cast("string")).alias("node_id"), "vec_id", "embedding")
    queries = emb.filter(F.col("vec_id") % 100 == 0).select(F.col("node_id").alias("query_id"), "embedding")
    return V.search_many(emb, queries, k=3, threshold=SEARCH_THRESHOLD, id_col="node_id")


@register("semantic_topk_indexed")
def semantic_topk_indexed(spark, sf_dir):
    """V4 by an index: the exact answer of ``semantic_topk_multi`` from the cells that can hold it."""
    emb = _embeddings(spark, sf_dir)
    queries = emb.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return VI.CellIndex.build(emb, "vec_id").search(queries, 5, exact=True, threshold=SEARCH_THRESHOLD)


@register("semantic_index_recall")
def semantic_index_recall(spark, sf_dir):
    """Recall of the index's nearest cells against the exact answer, measured on the query set: whether it reaches 0.9."""
    emb = _embeddings(spark, sf_dir)
    queries = emb.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    index = VI.CellIndex.build(emb, "vec_id")
    found = VI.recall(index.search(queries, 5), index.search(queries, 5, exact=True), "vec_id")
    return found.select("queries", "neighbours", (F.col("recall") >= 0.9).alias("recall_reached"))


@register("pooled_embeddings")
def pooled_embeddings(spark, sf_dir):
    """V1: unit vectors of whole documents, pooled over windows of 512 tokens (a row per axis)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = VI.embed_long(docs, lambda w: V.embed_with(w, VI.token_hash_encoder(16), dim=16), "doc_id", size=512)
    return out.select("doc_id", F.posexplode("embedding").alias("axis", "v")).select("doc_id", F.col("axis").cast("bigint").alias("axis"), F.round("v", 4).alias("value"))


@register("bucket_upsert")
def bucket_upsert(spark, sf_dir):
    """K6 as a bucketed store: orders, then a commit that replaces one key in ten and deletes another."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    store = BucketStore(spark, f"{job_dir(spark)}/store-{uuid.uuid4().hex}", "o_orderkey", 16)
    store.upsert(orders)
    changed = orders.filter("o_orderkey % 10 = 3").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_custkey") + 1).alias("o_custkey"))
    store.upsert(changed, orders.filter("o_orderkey % 10 = 7"))
    return store.read()


@register("index_upkeep")
def index_upkeep(spark, sf_dir):
    """V2 + V6: what a sync does to an index of an older state of the corpus (some nodes missing, changed, gone since)."""
    docs = V.code_document(corpus_analysis(spark, sf_dir)).select("node_id", "node_type", "text")
    docs = materialize(docs.withColumn("n", F.regexp_extract("node_id", r"(\d+)$", 1).cast("bigint")), "nodes")
    now = docs.select("node_id", "node_type", "text")
    before = (docs.filter("n % 3 <> 0").select("node_id", "node_type", F.when(F.col("n") % 5 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text")).alias("text"))
              .unionByName(docs.filter("n % 7 = 0").select(F.concat("node_id", F.lit(".GONE")).alias("node_id"), "node_type", "text")))
    store = BucketStore(spark, f"{job_dir(spark)}/index-{uuid.uuid4().hex}", "node_id", 16)

    def embed(frame):
        return V.embed_hashing(frame, dim=16)

    VI.sync_index(before, store, embed, "2024-01-01")
    return VI.sync_index(now, store, embed, "2024-01-02")


@register("hybrid_search")
def hybrid_search(spark, sf_dir):
    """Embeddings attached to corpus procedures (vec i -> procedure Pi), searched
    with vec 0 and expanded with call-graph neighbours in both directions."""
    emb = _embeddings(spark, sf_dir)
    docs = emb.select(F.concat(F.lit("UNKNOWN.P"), F.col("vec_id").cast("string")).alias("node_id"), "embedding")
    _, _, edges = _graph(spark, sf_dir)
    return V.hybrid_search(docs, edges, _query_vec(emb), k=5, threshold=SEARCH_THRESHOLD)


@register("code_documents")
def code_documents(spark, sf_dir):
    return V.code_document(corpus_analysis(spark, sf_dir)).select("node_id", "text", "code_length")


@register("vector_statistics")
def vector_statistics(spark, sf_dir):
    return V.statistics(V.code_document(corpus_analysis(spark, sf_dir)))


# ------------------------------------------------------------- model steps
from procweave.operators import cache as CA  # noqa: E402
from procweave.operators import model_steps as L  # noqa: E402

PARSE_RESPONSE_SQL = (
    "CASE p_partkey % 4 "
    "WHEN 0 THEN '{\"TB_' || CAST(p_partkey AS VARCHAR(20)) || '\": \"' || p_type || '\"}' "
    "WHEN 1 THEN '```json' || chr(10) || '{\"TB_' || CAST(p_partkey AS VARCHAR(20)) || '\": \"' || p_type || "
    "'\", \"V_' || CAST(p_partkey AS VARCHAR(20)) || '\": \"view of ' || p_brand || '\"}' || chr(10) || '```' "
    "WHEN 2 THEN '  ```' || chr(10) || '{\"TB_' || CAST(p_partkey AS VARCHAR(20)) || '\": \"' || p_name || '\"}' || chr(10) || '```  ' "
    "ELSE '{\"TB_' || CAST(p_partkey AS VARCHAR(20)) || '\": ' END"
)
NOISY_JSON_SQL = (
    "CASE event_id % 3 WHEN 0 THEN 'see {not json} then ' || props || ' and {\"n\": {\"k\": 1}}' "
    "WHEN 1 THEN 'result: ' || props ELSE 'nothing here {x' END"
)
SCORE_RESPONSE_SQL = (
    "CASE o_orderkey % 3 WHEN 0 THEN 'Score: ' || CAST(o_orderkey % 12 AS VARCHAR(20)) || ' of 10' "
    "WHEN 1 THEN 'It is fairly complex' ELSE 'I rate it ' || CAST(o_orderkey % 11 AS VARCHAR(20)) || '/10' END"
)


@register("llm_prompts")
def llm_prompts(spark, sf_dir):
    procs = procedure_corpus(spark, sf_dir)
    return procs.select(F.col("name").alias("proc"), L.prompt("complexity", code=F.col("source_code")).alias("prompt"))


def _catalog_tables(spark, sf_dir):
    cols = S.catalog_columns(spark, sf_dir)
    return (cols.groupBy("table_schema", "table_name").agg(F.count(F.lit(1)).cast("bigint").alias("n_columns"))
            .select(F.col("table_name").alias("table"), F.concat_ws(".", "table_schema", "table_name").alias("full_name"),
                    "n_columns", F.substring("table_name", 2, 20).cast("bigint").alias("k")))


def _batched_tables(spark, sf_dir):
    t = _catalog_tables(spark, sf_dir)
    # buckets of about 50 tables by key: their number grows with the catalog
    return L.assign_batches(t, "table", 5, bucket=F.floor(F.col("k") / 50))


@register("llm_batches")
def llm_batches(spark, sf_dir):
    return _batched_tables(spark, sf_dir).select("table", "batch_id", "batch_pos")


@register("llm_parse")
def llm_parse(spark, sf_dir):
    part = S.read_table(spark, sf_dir, "part")
    r = part.selectExpr("p_partkey", f"{PARSE_RESPONSE_SQL} AS response")
    return r.select("p_partkey", F.explode(L.parse_object("response")).alias("key", "purpose"))


@register("llm_first_json")
def llm_first_json(spark, sf_dir):
    ev = S.read_table(spark, sf_dir, "events").selectExpr("event_id", f"{NOISY_JSON_SQL} AS text")
    return ev.select("event_id", L.first_json_object("text").alias("obj"))


@register("llm_score")
def llm_score(spark, sf_dir):
    o = S.read_table(spark, sf_dir, "orders")
    r = o.selectExpr(f"{S.CORPUS_NAME_SQL} AS proc", f"{S.CORPUS_TEXT_SQL} AS code", f"{SCORE_RESPONSE_SQL} AS response")
    return r.select("proc", L.score_from_response("response", F.col("code")).alias("score"))


@register("purpose_match")
def purpose_match(spark, sf_dir):
    bt = _batched_tables(spark, sf_dir)
    k = F.col("k")
    answers = bt.filter(k % 4 != 3).select(
        "batch_id",
        F.when(k % 4 == 0, F.col("full_name")).when(k % 4 == 1, F.col("table"))
         .otherwise(F.concat(F.lit("purpose of "), F.col("table"))).alias("key"),
        F.concat(F.lit("stores rows of "), F.col("table")).alias("purpose"))
    return L.match_purposes(bt, answers)


# ------------------------------------------------------------- caches and upserts
@register("cache_key")
def cache_key_q(spark, sf_dir):
    c = S.read_table(spark, sf_dir, "customer")
    cfg = c.select("c_custkey", F.lower("c_mktsegment").alias("db_type"),
                   F.concat(F.lit("h"), F.col("c_nationkey").cast("string")).alias("host"),
                   F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 5000)).alias("port"),
                   F.lit("db").alias("database"), F.when(F.col("c_custkey") % 3 != 0, F.lit("app")).alias("schema"),
                   F.col("c_name").alias("user"))
    return cfg.select("c_custkey", CA.cache_key("db_type", "host", "port", "database", "schema", "user").alias("cache_key"))


@register("cache_misses")
def cache_misses(spark, sf_dir):
    t = _catalog_tables(spark, sf_dir).select(F.col("full_name").alias("table"), "k")
    cache = (t.filter(F.col("k") % 3 == 0)
             .select("table", F.when(F.col("k") % 2 == 0, F.lit("1.0")).otherwise(F.lit("0.9")).alias("cache_version")))
    miss = CA.cache_misses(t.select("table"), cache)
    return miss.select("table", CA.safe_name(F.concat(F.col("table"), F.lit("/ddl"))).alias("file_name"))


@register("source_priority")
def source_priority(spark, sf_dir):
    procs = procedure_corpus(spark, sf_dir).withColumn("k", F.substring("name", 2, 20).cast("bigint"))
    text = lambda label: F.concat(F.lit(f"-- {label}\n"), F.col("source_code")).alias("source_code")
    cache = procs.filter(F.col("k") % 5 == 0).select("name", text("cache"))
    files = procs.filter(F.col("k") % 3 == 0).select("name", text("file"))
    db = procs.select("name", "source_code")
    return CA.prefer_sources([("cache", cache), ("file", files), ("database", db)], "name")


@register("latest_upsert")
def latest_upsert(spark, sf_dir):
    o = S.read_table(spark, sf_dir, "orders")
    existing = o.select(F.concat(F.lit("UNKNOWN.P"), F.col("o_orderkey").cast("string")).alias("node_id"),
                        F.lit(1).cast("bigint").alias("version"))
    incoming = o.filter((F.col("o_orderkey") % 4 == 0) | (F.col("o_orderkey") % 50 == 1)).select(
        F.concat(F.when(F.col("o_orderkey") % 50 == 1, F.lit("NEW.P")).otherwise(F.lit("UNKNOWN.P")),
                 F.col("o_orderkey").cast("string")).alias("node_id"),
        F.lit(2).cast("bigint").alias("version"))
    return CA.upsert(existing, incoming, "node_id")


@register("keep_latest")
def keep_latest_q(spark, sf_dir):
    """Last event per user by timestamp (dict overwrite order)."""
    ev = S.read_table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "event_id")
    return CA.keep_latest(ev, "user_id", "ts").select("user_id", "event_type", "event_id")


@register("stale_nodes")
def stale_nodes(spark, sf_dir):
    o = S.read_table(spark, sf_dir, "orders")
    nodes = o.select(F.concat(F.lit("UNKNOWN.P"), F.col("o_orderkey").cast("string")).alias("node_id"),
                     F.col("o_orderdate").alias("updated_at"))
    return V.stale(nodes, F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")).select("node_id")


# ------------------------------------------------------------- reports
from procweave.sinks import reports as RP  # noqa: E402


def _procs_with_levels(spark, sf_dir, extra_columns=()):
    lv, an = _levels(spark, sf_dir, extra_columns=extra_columns)
    procs = an.select("proc", "complexity_score").join(lv.select(F.col("node").alias("proc"), "level"), "proc")
    edges = A.call_edges(an).select(F.col("proc").alias("src"), F.col("callee").alias("dst"))
    return procs, edges, an, lv


@register("mermaid_lines")
def mermaid_lines(spark, sf_dir):
    procs, edges, _, _ = _procs_with_levels(spark, sf_dir)
    return RP.call_diagram(procs, edges).select(F.col("section").cast("bigint").alias("section"), "line")


@register("mermaid_hierarchy_lines")
def mermaid_hierarchy_lines(spark, sf_dir):
    procs, edges, _, _ = _procs_with_levels(spark, sf_dir)
    return RP.hierarchy_diagram(procs, edges).select(F.col("section").cast("bigint").alias("section"), "line")


@register("flowchart_lines")
def flowchart_lines(spark, sf_dir):
    _, _, an, lv = _procs_with_levels(spark, sf_dir, ["tables", "signature_parameters"])
    return RP.flowcharts(an, lv).select("proc", F.col("section").cast("bigint").alias("section"), "line")


@register("mermaid_er_lines")
def mermaid_er_lines(spark, sf_dir):
    from procweave.session import materialize
    lines = _catalog_lines_once(spark, sf_dir)
    cols, keys, _ = _catalog(spark, sf_dir, lines)
    _, e = _fk_graph(spark, sf_dir, lines=lines)
    # both are read by the choice of tables, by the boxes and by the links
    e = materialize(e, "fk-edges")
    columns = materialize(C.assemble_columns(cols, keys), "catalog-columns")
    return RP.er_diagram(columns, e).select(F.col("section").cast("bigint").alias("section"), "line")


@register("report_lines")
def report_lines(spark, sf_dir):
    from procweave.session import materialize
    objs, r = _rels(spark, sf_dir)
    r = materialize(r, "relations")  # read by six report sections: extract once
    return RP.markdown_report(objs, r, RM.degrees(objs, r), generated_at="2024-01-01 00:00:00").select(
        "schema", F.col("section").cast("bigint").alias("section"), "line")


# ------------------------------------------------------------- token windows (T2 batch form)
from procweave.streaming import tokens as TS  # noqa: E402


@register("token_windows")
def token_windows(spark, sf_dir):
    w = TS.windowed(S.token_metrics(spark, sf_dir), "1 hour")
    # window bounds as text so both engines report the same type
    return w.withColumn("window_start", F.col("window_start").cast("string")) \
            .withColumn("window_end", F.col("window_end").cast("string"))


# ------------------------------------------------------------- field lineage
from procweave.operators import lineage as LN  # noqa: E402


def _usage(spark, sf_dir):
    return A.field_usage(corpus_analysis(spark, sf_dir))


def _access_catalog(spark, sf_dir):
    """Columns of the tables that the corpus reads and writes, in two schemas: every
    table has ID and TOTAL, some have STATUS (mixed case, as a catalog may hold it)."""
    o = S.read_table(spark, sf_dir, "orders")
    t = o.select((F.col("o_custkey") % 7).cast("string").alias("k")).union(
        o.select(F.substring("o_orderpriority", 1, 1).alias("k"))).distinct()
    schema = F.when(F.col("k").isin("0", "2", "4", "6"), F.lit("app")).otherwise(F.lit("ops"))
    cols = F.array(F.lit("id"), F.lit("Total"), F.when(F.col("k").isin("1", "2", "5"), F.lit("STATUS")))
    return (t.select(schema.alias("table_schema"), F.concat(F.lit("t_"), "k").alias("table_name"), F.explode(cols).alias("column_name"))
            .filter(F.col("column_name").isNotNull()))


@register("field_sources")
def field_sources(spark, sf_dir):
    # read for the writers and for the fields: extracted once
    usage = materialize(_usage(spark, sf_dir).select("field", "proc", "operation"), "usage")
    return LN.sources(usage, _access_catalog(spark, sf_dir))


@register("field_destinations")
def field_destinations(spark, sf_dir):
    return LN.destinations(_usage(spark, sf_dir))


@register("field_flow")
def field_flow(spark, sf_dir):
    return LN.flow(_usage(spark, sf_dir), _access_catalog(spark, sf_dir))


@register("analyze_field")
def analyze_field(spark, sf_dir):
    return LN.usage_summary(_usage(spark, sf_dir))


@register("trace_field")
def trace_field(spark, sf_dir):
    """G10 for field STATUS from the procedure of the largest order key, to its whole
    reach, with the accessed tables that have the column (names resolved against the catalog)."""
    an = A.shared(corpus_analysis(spark, sf_dir), A.GRAPH_COLUMNS + A.USAGE_COLUMNS)
    columns = _access_catalog(spark, sf_dir)
    tables = columns.select(F.concat_ws(".", "table_schema", "table_name").alias("id"), F.lit("table").alias("node_type"),
                            F.col("table_schema").alias("schema"), F.col("table_name").alias("name")).distinct()
    access = G.resolve_access(A.table_edges(an).select(F.col("proc").alias("src"), F.col("table_name").alias("dst")), tables)
    usage = A.field_usage(an)
    edges = A.call_edges(an).select(F.col("proc").alias("src"), F.col("callee").alias("dst"))
    top = S.read_table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).scalar()
    starts = spark.range(1).select(F.concat(F.lit("P"), top.cast("string")).alias("root"))
    return LN.trace(edges, usage, starts, "status", None, access, columns)


# ------------------------------------------------------------- second corpus (loaders)
def loader_analysis(spark, sf_dir):
    return A.analyze(S.loader_corpus(spark, sf_dir))


@register("loader_calls")
def loader_calls(spark, sf_dir):
    return A.call_edges(loader_analysis(spark, sf_dir)).select("proc", "callee")


@register("loader_tables")
def loader_tables(spark, sf_dir):
    return A.table_edges(loader_analysis(spark, sf_dir)).select("proc", "table_name")


@register("proc_insert_fields")
def proc_insert_fields(spark, sf_dir):
    an = loader_analysis(spark, sf_dir)
    return an.select("proc", F.explode_outer("insert_fields").alias("u")).filter(F.col("u").isNotNull()) \
        .select("proc", "u.field", "u.context")


@register("loader_field_usage")
def loader_field_usage(spark, sf_dir):
    return A.field_usage(loader_analysis(spark, sf_dir)).drop("seq")


@register("loader_complexity")
def loader_complexity(spark, sf_dir):
    an = loader_analysis(spark, sf_dir)
    return an.select("proc", "complexity_score", "lines", F.col("control.if").alias("n_if"),
                     F.col("control.loop").alias("n_loop"), F.col("control.while").alias("n_while"),
                     F.col("control.case").alias("n_case"))


@register("loader_variables")
def loader_variables(spark, sf_dir):
    return loader_analysis(spark, sf_dir).select("proc", F.explode_outer("variables").alias("variable")) \
        .filter(F.col("variable").isNotNull())


@register("node_documents")
def node_documents(spark, sf_dir):
    """Embedding text of every graph node of the corpus graph."""
    _, nodes, edges = _graph(spark, sf_dir)
    return V.node_document(nodes, edges).select("node_id", "node_type", "text")


@register("mermaid_table_hierarchy_lines")
def mermaid_table_hierarchy_lines(spark, sf_dir):
    from procweave.session import materialize
    lines = _catalog_lines_once(spark, sf_dir)
    tables, e = _fk_graph(spark, sf_dir, lines=lines)
    e = materialize(e, "fk-edges")  # read by the levels and by two sections
    lv = TR.dependency_levels(tables.select(F.col("table").alias("node")), e.select("src", "dst"))
    levels = lv.select(F.col("node").alias("table"), "level")
    summary = materialize(_summary(spark, sf_dir, lines), "table-summary")
    return RP.table_hierarchy_diagram(levels, summary, e).select(
        F.col("section").cast("bigint").alias("section"), "line")


# ------------------------------------------------------------- whole answers beside the single ones above
@register("trace_field_all")
def trace_field_all(spark, sf_dir):
    """Every field, traced from every procedure of the query set (numbers divisible by 100) over its whole
    reach, with the columns of the accessed tables."""
    an = A.shared(corpus_analysis(spark, sf_dir), A.GRAPH_COLUMNS + A.USAGE_COLUMNS)
    columns = _access_catalog(spark, sf_dir).withColumn("data_type", F.when(F.upper("column_name") == "STATUS", "text").otherwise("numeric"))
    tables = columns.select(F.concat_ws(".", "table_schema", "table_name").alias("id"), F.lit("table").alias("node_type"),
                            F.col("table_schema").alias("schema"), F.col("table_name").alias("name")).distinct()
    access = G.resolve_access(A.table_edges(an).select(F.col("proc").alias("src"), F.col("table_name").alias("dst")), tables)
    edges = A.call_edges(an).select(F.col("proc").alias("src"), F.col("callee").alias("dst"))
    starts = an.filter(F.substring("proc", 2, 20).cast("bigint") % 100 == 0).select(F.col("proc").alias("root"))
    return LN.trace_fields(edges, A.field_usage(an), starts, None, access, columns)


@register("field_sources_first")
def field_sources_first(spark, sf_dir):
    """Of every field the first ten procedures using it, by name, tested for writes."""
    return LN.sources(_usage(spark, sf_dir), max_results=10, compat=True)


@register("node_documents_full")
def node_documents_full(spark, sf_dir):
    """Documents of tables (purpose, columns, foreign keys, logic) and of procedures with their parameters."""
    cols, keys, _ = _catalog(spark, sf_dir)
    key = F.concat_ws(".", "table_schema", "table_name")
    k = F.substring("table_name", 2, 20).cast("bigint")
    tables = cols.select("table_schema", "table_name").distinct().select(
        key.alias("id"), F.lit("table").alias("node_type"), F.col("table_schema").alias("schema"), F.col("table_name").alias("name"),
        (k % 11).alias("complexity_score"), F.when(k % 3 == 0, F.concat(F.lit("Keeps "), "table_name")).alias("business_purpose"),
        F.when(k % 4 == 1, F.concat(F.lit("Filled once for "), "table_name")).alias("business_logic"))
    procs = corpus_analysis(spark, sf_dir).select("id", F.lit("procedure").alias("node_type"), "schema", F.col("short_name").alias("name"),
                                                  F.col("complexity_score").cast("bigint").alias("complexity_score"), "parameters")
    _, e = _fk_graph(spark, sf_dir)
    columns = cols.select(key.alias("table"), "ordinal", "column_name", "data_type")
    return V.node_document(tables.unionByName(procs, allowMissingColumns=True), e.select("src", "dst", F.lit("references").alias("edge_type")),
                           columns).select("node_id", "node_type", "text")


@register("llm_prompts_all")
def llm_prompts_all(spark, sf_dir):
    """The prompts of the other three templates: logic and dependencies of procedures, purpose of tables."""
    procs = procedure_corpus(spark, sf_dir)
    out = None
    for kind in ("business_logic", "dependencies"):
        part = procs.select(F.lit(kind).alias("kind"), "name", L.prompt(kind, name=F.col("name"), code=F.col("source_code")).alias("prompt"))
        out = part if out is None else out.unionByName(part)
    cols, keys, _ = _catalog(spark, sf_dir)
    names = cols.groupBy("table_schema", "table_name").agg(F.sort_array(F.collect_list(F.struct("ordinal", "column_name"))).alias("c"))
    ddl = C.table_ddl(C.assemble_columns(cols, keys), C.foreign_keys(keys)).join(names, ["table_schema", "table_name"])
    full = F.concat_ws(".", "table_schema", "table_name")
    text = L.prompt("table_purpose", name=full, ddl=F.col("ddl"), columns=F.transform("c", lambda x: x["column_name"]))
    return out.unionByName(ddl.select(F.lit("table_purpose").alias("kind"), full.alias("name"), text.alias("prompt")))


@register("merged_dependencies")
def merged_dependencies(spark, sf_dir):
    """Callees found by the patterns united with a model's list where it gave one (every other procedure)."""
    an = corpus_analysis(spark, sf_dir)
    n = F.substring("proc", 2, 20).cast("bigint")
    answer = F.when(n % 2 == 0, F.array(F.concat(F.lit("MODEL_"), (n % 13).cast("string")), F.lit("P1")))
    return an.select("proc", F.explode(L.union_dependencies(F.col("calls"), answer)).alias("callee"))


@register("document_previews")
def document_previews(spark, sf_dir):
    """The preview shown beside each whole document."""
    return S.read_table(spark, sf_dir, "documents").select("doc_id", V.preview("text").alias("preview"))


@register("non_empty_procedures")
def non_empty_procedures(spark, sf_dir):
    """procedures whose text has more than white space."""
    o = S.read_table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 4 == 0, "").when(F.col("o_orderkey") % 4 == 1, " \n\t ").when(F.col("o_orderkey") % 4 == 2, F.lit(None)).otherwise("x")
    return A.non_empty(o.select("o_orderkey", text.alias("source_code"))).select("o_orderkey")


@register("ddl_files")
def ddl_files(spark, sf_dir):
    """One file per object, written by the file-tree sink and read back."""
    folder = f"{job_dir(spark)}/ddl-{uuid.uuid4().hex}"
    files = FT.export_files(S.ddl_objects(spark, sf_dir))
    FT.write_files(files, folder)
    return FT.read_files(files, folder)


@register("graph_stream")
def graph_stream(spark, sf_dir):
    """The graph that a stream of procedure versions leaves (older texts, the corpus, deletions and late files, out of order)."""
    n = F.substring("name", 2, 20).cast("bigint")
    now = procedure_corpus(spark, sf_dir).select("name", "source_code", F.lit("2024-01-03").cast("timestamp").alias("modified_at"))
    older = procedure_corpus_cycles(spark, sf_dir).filter(n % 3 != 1)
    versions = (now.filter(n % 5 != 0)
                .unionByName(older.select("name", "source_code", F.when(n % 5 == 0, "2024-01-04").otherwise("2024-01-01").cast("timestamp").alias("modified_at")))
                .unionByName(now.filter(n % 7 == 0).select("name", F.lit("").alias("source_code"), F.lit("2024-01-05").cast("timestamp").alias("modified_at"))))
    folder = f"{job_dir(spark)}/stream-{uuid.uuid4().hex}"
    # a version is in any of the files and a micro-batch takes a few of them: no order of times is kept
    versions.repartition(6, F.xxhash64("name", "modified_at")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(versions.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    KG.start(stream, f"{folder}/log", f"{folder}/state").awaitTermination()
    return KG.current(spark.read.parquet(f"{folder}/log"))
