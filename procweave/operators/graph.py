"""Knowledge graph as two DataFrames: ``nodes`` and ``edges``.

``nodes(id, node_type, schema, name, complexity_score)`` and
``edges(src, dst, edge_type, relationship)``. An edge may point at a name
that is no node (an implicit, untyped endpoint); statistics count such
endpoints as ``unknown``.

Name resolution (J6/G3): extracted callees are bare upper names while node
ids are ``schema.name``. :func:`resolve_names` maps each distinct name to one
node: the exact id of the right type first, else the smallest id whose
``.suffix`` or ``name`` equals it. It is an equi-join on precomputed keys plus
a ``min(struct)`` aggregate (map-side partial), never a theta join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.functions.scoring import complexity_class
from procweave.session import few, materialize


def procedure_nodes(analysis: DataFrame) -> DataFrame:
    return analysis.select(
        "id", F.lit("procedure").alias("node_type"), "schema", F.col("short_name").alias("name"),
        F.col("complexity_score").cast("bigint").alias("complexity_score"))


def _suffix_keys(id_col: str = "id") -> DataFrame:
    """Every '.'-suffix of an id: 'A.B.C' -> ['B.C', 'C']."""
    parts = F.split(F.col(id_col), r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))),
                       lambda i: F.array_join(F.slice(parts, i, n), "."))


def resolve_names(names: DataFrame, nodes: DataFrame, node_type: str | None = "procedure",
                  name_col: str = "name", ignore_case: bool = False) -> DataFrame:
    """(name, resolved_id). Unresolved names are absent (left-join to keep them).

    The node side is reduced to one id per key before the join, so a name that
    exists in thousands of schemas costs one row; ``ignore_case`` compares
    upper-cased names (extracted table names are upper-case, a catalog's keys
    need not be).
    """
    fold = (lambda c: F.upper(c)) if ignore_case else (lambda c: c)
    cand = nodes if node_type is None else nodes.filter(F.col("node_type") == node_type)
    wanted = names.select(F.col(name_col).alias("_n"), fold(F.col(name_col)).alias("_q")).distinct()
    exact = cand.select(F.col("id").alias("_q"), F.col("id").alias("rid"), F.lit(0).alias("prio"))
    by_suffix = (cand.select(F.explode(_suffix_keys("id")).alias("_q"), F.col("id").alias("rid"))
                 .withColumn("prio", F.lit(1)))
    by_name = cand.select(F.col("name").alias("_q"), F.col("id").alias("rid"), F.lit(1).alias("prio"))
    keys = (exact.unionByName(by_suffix).unionByName(by_name).withColumn("_q", fold(F.col("_q")))
            .groupBy("_q").agg(F.min(F.struct("prio", "rid")).alias("b")))
    return wanted.join(keys, "_q").select(F.col("_n").alias(name_col), F.col("b.rid").alias("resolved_id"))


def resolve_access(access: DataFrame, nodes: DataFrame) -> DataFrame:
    """Access edges whose extracted table names are replaced by the table node they
    mean (names without a node stay)."""
    # a few names stand in all rows: written first, so that no row is dealt by its name while they are few
    r = materialize(resolve_names(access.select(F.col("dst").alias("name")), nodes, "table", ignore_case=True), "access-r")
    r = few(r)
    others = [c for c in access.columns if c != "dst"]
    return (access.join(r, access["dst"] == r["name"], "left")
            .select(*others, F.coalesce("resolved_id", "dst").alias("dst")).select(access.columns))


def build_graph(analysis: DataFrame, table_nodes: DataFrame | None = None,
                fk_edges: DataFrame | None = None, resolve: bool = True, columns: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from a static analysis (and optionally a catalog).

    ``resolve=True`` points call edges at resolved node ids (G3), and access
    edges at the table nodes where a catalog is given;
    ``resolve=False`` keeps the bare names as the original does. ``columns``
    (assembled catalog columns) adds the field nodes and their edges.
    """
    nodes = procedure_nodes(analysis)
    if table_nodes is not None:
        nodes = nodes.unionByName(table_nodes, allowMissingColumns=True)
    calls = analysis.select(F.col("id").alias("src"), F.explode_outer("calls").alias("dst")).filter(F.col("dst").isNotNull())
    if resolve:
        r = resolve_names(calls.select(F.col("dst").alias("name")), nodes, "procedure")
        calls = (calls.join(r, calls.dst == r.name, "left")
                 .select("src", F.coalesce("resolved_id", "dst").alias("dst")))
    calls = calls.select("src", "dst", F.lit("calls").alias("edge_type"), F.lit("procedure_call").alias("relationship"))
    edges = calls
    if "tables" in analysis.columns:
        access = analysis.select(F.col("id").alias("src"), F.explode_outer("tables").alias("dst"),
                                 F.lit("accesses").alias("edge_type"), F.lit("table_access").alias("relationship")) \
            .filter(F.col("dst").isNotNull())
        if resolve and table_nodes is not None:
            access = resolve_access(access, nodes)
        edges = calls.unionByName(access)
    if fk_edges is not None:
        edges = edges.unionByName(fk_edges.select("src", "dst", "edge_type", "relationship"))
    if columns is not None:
        fields, belongs = field_graph(columns)
        nodes = nodes.unionByName(fields.select("id", "node_type", "schema", "name"), allowMissingColumns=True)
        edges = edges.unionByName(belongs)
    return nodes, edges


def field_graph(columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Field nodes and their ``belongs_to`` edges from assembled catalog columns.

    Nodes ``(id, node_type, schema, name, data_type, is_primary_key,
    is_foreign_key)`` with id ``schema.table.column``; one edge per field to its
    table.
    """
    table = F.concat_ws(".", "table_schema", "table_name")
    f = columns.select(F.concat_ws(".", table, F.col("column_name")).alias("id"), F.lit("field").alias("node_type"),
                       F.col("table_schema").alias("schema"), F.col("column_name").alias("name"), "data_type",
                       "is_primary_key", "is_foreign_key", table.alias("_table")).dropDuplicates(["id"])
    edges = f.select(F.col("id").alias("src"), F.col("_table").alias("dst"), F.lit("belongs_to").alias("edge_type"),
                     F.lit("field_of_table").alias("relationship"))
    return f.drop("_table"), edges


def field_relationships(nodes: DataFrame, edges: DataFrame, field: str | None = None) -> DataFrame:
    """``(field, relationship, target)`` over the out-edges of the field nodes (of one field name, or all)."""
    f = nodes.filter(F.col("node_type") == "field")
    if field is not None:
        f = f.filter(F.col("name") == field)
    return (f.select(F.col("id").alias("src"), F.col("name").alias("field")).join(edges, "src")
            .select("field", F.coalesce("relationship", F.lit("unknown")).alias("relationship"), F.col("dst").alias("target")).distinct())


def find_node(nodes: DataFrame, name: str, node_type: str | None = None) -> DataFrame:
    """J6 for one name: at most one row (exact id first, then suffix/name, smallest id)."""
    q = nodes.sparkSession.createDataFrame([(name,)], "name string")
    return resolve_names(q, nodes, node_type)


def callers(edges: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Distinct (id, caller) over ``calls`` in-edges of each target id."""
    t = target_ids.select(F.col("id").alias("dst"))
    return (edges.filter(F.col("edge_type") == "calls").join(t, "dst")
            .select(F.col("dst").alias("id"), F.col("src").alias("caller")).distinct())


def procedure_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G4 in long form: (id, rel, target) for calls and accesses of every procedure."""
    p = nodes.filter(F.col("node_type") == "procedure").select(F.col("id").alias("src"))
    e = edges.filter(F.col("edge_type").isin("calls", "accesses"))
    return (e.join(p, "src", "left_semi")
            .select(F.col("src").alias("id"),
                    F.when(F.col("edge_type") == "calls", "called_procedures").otherwise("called_tables").alias("rel"),
                    F.col("dst").alias("target")).distinct())


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A4: rows (kind, key, n): totals, nodes by type, edges by type.

    Implicit endpoints (edge ends that are no node) count as type ``unknown``.
    """
    implicit = (edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
                .join(nodes.select("id"), "id", "left_anti").withColumn("node_type", F.lit(None).cast("string")))
    all_nodes = nodes.select("id", "node_type").unionByName(implicit)
    by_type = (all_nodes.groupBy(F.coalesce("node_type", F.lit("unknown")).alias("key"))
               .agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("node_type")))
    by_edge = (edges.groupBy(F.coalesce("edge_type", F.lit("unknown")).alias("key"))
               .agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("edge_type")))
    totals = (all_nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit("nodes").alias("key"), "n")
              .unionByName(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit("edges").alias("key"), "n")))
    return totals.unionByName(by_type).unionByName(by_edge).select("kind", "key", F.col("n").cast("bigint").alias("n"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """in/out degree per node on *distinct* (src, dst), 0 for nodes without edges.

    Both counts are partial aggregates before the shuffle, so a hot node
    (called by a third of the corpus) costs one combined row per map task.
    """
    d = edges.select("src", "dst").distinct()
    ind = d.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    outd = d.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    ids = nodes.select("id").distinct()
    return (ids.join(ind, "id", "left").join(outd, "id", "left")
            .select("id", F.coalesce("in_degree", F.lit(0)).cast("bigint").alias("in_degree"),
                    F.coalesce("out_degree", F.lit(0)).cast("bigint").alias("out_degree")))


def top_by(deg: DataFrame, col: str, n: int = 10) -> DataFrame:
    """L1: top-n by a count, ties broken by id (TakeOrderedAndProject, no global sort)."""
    return deg.orderBy(F.desc(col), F.asc("id")).limit(n)


def isolated(deg: DataFrame) -> DataFrame:
    """Nodes with total degree 0."""
    return deg.filter((F.col("in_degree") + F.col("out_degree")) == 0).select("id")


def top_called_procedures(analysis: DataFrame, n: int = 10, drop_self: bool = True) -> DataFrame:
    """Flagship slice: most-called known procedures with their complexity.

    calls (P1) -> resolve (G3) -> keep edges into known procedures (J5) ->
    distinct pairs -> in-degree (A6) -> top-n (L1), joined to complexity (P18).
    """
    nodes, edges = build_graph(analysis)
    calls = edges.filter(F.col("edge_type") == "calls")
    if drop_self:
        calls = calls.filter(F.col("src") != F.col("dst"))
    procs = nodes.select(F.col("id").alias("dst"), F.col("name"), F.col("complexity_score"))
    known = calls.join(procs.select("dst"), "dst", "left_semi").select("src", "dst").distinct()
    ind = known.groupBy("dst").agg(F.count(F.lit(1)).alias("callers"))
    top = ind.join(procs, "dst").select(
        F.col("name"), F.col("callers").cast("bigint").alias("callers"),
        F.col("complexity_score"), complexity_class("complexity_score").alias("complexity_class"))
    return top.orderBy(F.desc("callers"), F.asc("name")).limit(n)
