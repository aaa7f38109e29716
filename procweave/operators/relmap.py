"""Relationship map over exported DDL objects.

Input ``objects(schema, obj_type, name, ddl)`` where ``obj_type`` is one of
the nine export kinds. All schemas run in one job: ``schema`` is a key
column everywhere. Relations are extracted per object in one projection
(twelve relation types), exploded with their position so that the
original "last attribute wins" order can be reproduced with ``max_by``
instead of a sequential loop, and kept only when the target is a known
object name (J5, a semi join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.functions import constants as K
from procweave.functions.extract import extract_all

def _kind_idx(c):
    """Position of an object kind in the export order (later kinds win on name clashes)."""
    return F.create_map(*[x for i, k in enumerate(K.OBJECT_KINDS) for x in (F.lit(k), F.lit(i))])[c]


def _flagged(p: str) -> str:
    # applied to upper-cased text with IGNORECASE | MULTILINE; '.' stops at '\n' only
    return "(?id)" + p


def _normalize(c):
    """Strip blanks and quotes, upper."""
    return F.upper(F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", ""))


_NAME = r"[\"']?(\w+)[\"']?"
_QUALIFIED_NAME = r"[\"']?(?:\w+[\"']?\s*\.\s*[\"']?)?(\w+)[\"']?"


def _table_refs(upper_ddl, name_upper, compat: bool = True):
    """Table references of the eight DDL patterns. ``compat=True`` keeps the
    literal patterns (a quoted ``"SCHEMA"."TABLE"`` captures SCHEMA);
    ``compat=False`` skips an optional schema part and captures the table."""
    def tagged(typ):
        return lambda x: F.struct(_normalize(x).alias("target"), F.lit(typ).alias("type"))

    pats = [(p if compat else p.replace(_NAME, _QUALIFIED_NAME), t) for p, t in K.MAPPER_TABLE_PATTERNS]
    parts = [F.transform(extract_all(upper_ddl, _flagged(pat), 1), tagged(typ)) for pat, typ in pats]
    arr = F.concat(*parts)
    return F.filter(arr, lambda s: (s["target"] != "") & (s["target"] != name_upper))


def relations(objects: DataFrame, compat: bool = True) -> DataFrame:
    """G19-G24 + J5: (schema, source, target, type, source_type, ord).

    ``ord`` orders relations as the original appends them (kind, object,
    stage, position); it decides the DiGraph edge label (last wins) and the
    report's first-100 list. Duplicates are kept (the relation list is not
    a set); calls are deduplicated per object as in the original.
    ``compat=False`` lets table references carry a (quoted) schema part.
    """
    up = F.upper(F.col("ddl"))
    name_up = F.upper(F.col("name"))
    kw = F.array(*[F.lit(k) for k in K.MAPPER_KEYWORDS])
    refs = _table_refs(up, name_up, compat)

    explicit = F.transform(extract_all(up, _flagged(K.MAPPER_CALL_EXPLICIT), 2), _normalize)
    explicit = F.filter(explicit, lambda x: ~F.array_contains(kw, x) & (x != name_up) & (x != ""))
    # possessive form of the fixed pattern: same matches, no backtracking into the name
    paren = F.transform(extract_all(up, K.MAPPER_CALL_PAREN.replace("]*)\\s*\\(", "]*+)\\s*+\\("), 1), _normalize)
    paren = F.filter(paren, lambda x: ~F.array_contains(kw, x) & (x != name_up) & (F.length(x) >= K.MAPPER_CALL_MIN_LEN))
    calls = F.when(F.col("obj_type").isin(*K.CALLER_KINDS), F.array_distinct(F.concat(explicit, paren))) \
        .otherwise(F.array().cast("array<string>"))

    seqs = F.transform(extract_all(F.col("ddl"), "(?i)" + K.MAPPER_SEQUENCE, 1), _normalize)
    seqs = F.filter(seqs, lambda x: (x != "") & (x != name_up))

    empty = F.array().cast("array<string>")
    pkg = F.col("obj_type") == "packages"
    procs_in_pkg = F.when(pkg, F.transform(extract_all(up, _flagged(K.MAPPER_PACKAGE_PROC), 1), _normalize)).otherwise(empty)
    funcs_in_pkg = F.when(pkg, F.transform(extract_all(up, _flagged(K.MAPPER_PACKAGE_FUNC), 1), _normalize)).otherwise(empty)

    def tag(arr, stage_no, typ=None):
        if typ is None:  # refs carry their own type
            return F.transform(arr, lambda s: F.struct(s["target"].alias("target"), s["type"].alias("type"),
                                                       F.lit(stage_no).alias("stage")))
        return F.transform(arr, lambda x: F.struct(x.alias("target"), F.lit(typ).alias("type"), F.lit(stage_no).alias("stage")))

    # every relation of an object in one array, in the order the original appends them
    all_rels = F.concat(
        tag(refs, 0), tag(calls, 1, "CALLS"), tag(seqs, 2, "USES_SEQUENCE"),
        tag(F.transform(F.filter(refs, lambda r: F.col("obj_type") == "views"), lambda r: r["target"]), 3, "VIEW_DEPENDS"),
        tag(procs_in_pkg, 4, "CONTAINS_PROCEDURE"), tag(funcs_in_pkg, 5, "CONTAINS_FUNCTION"))
    rels = (objects.select("schema", F.col("name").alias("source"), F.col("obj_type").alias("source_type"),
                           _kind_idx(F.col("obj_type")).alias("kind_idx"), F.posexplode_outer(all_rels).alias("pos", "r"))
            .filter(F.col("pos").isNotNull())
            .select("schema", "source", F.col("r.target").alias("target"), F.col("r.type").alias("type"), "source_type",
                    F.struct("kind_idx", "source", F.col("r.stage").alias("stage"), "pos").alias("ord")))

    # J5 + J11 in one join: a relation survives when its target is an object
    # name; package members must be an object of that kind
    names = objects.groupBy("schema", F.col("name").alias("target")).agg(
        F.max((F.col("obj_type") == "procedures").cast("int")).alias("is_proc"),
        F.max((F.col("obj_type") == "functions").cast("int")).alias("is_func"))
    kept = rels.join(names, ["schema", "target"]).filter(
        F.when(F.col("type") == "CONTAINS_PROCEDURE", F.col("is_proc") == 1)
         .when(F.col("type") == "CONTAINS_FUNCTION", F.col("is_func") == 1)
         .otherwise(F.lit(True)))
    return kept.select("schema", "source", "target", "type", "source_type", "ord")


def graph_nodes(objects: DataFrame) -> DataFrame:
    """Mapper nodes: every object name; a name in several kinds takes the last kind."""
    return (objects.select("schema", "name", _kind_idx(F.col("obj_type")).alias("k"), "obj_type")
            .groupBy("schema", "name").agg(F.max_by("obj_type", "k").alias("node_type")))


def graph_edges(rels: DataFrame) -> DataFrame:
    """DiGraph edges: one per (source, target), label of the last relation added."""
    return (rels.groupBy("schema", "source", "target")
            .agg(F.max_by("type", "ord").alias("relationship")))


def degrees(objects: DataFrame, rels: DataFrame) -> DataFrame:
    """in/out degree per node on distinct pairs, 0 for nodes without edges."""
    e = rels.select("schema", "source", "target").distinct()
    ind = e.groupBy("schema", F.col("target").alias("name")).agg(F.count(F.lit(1)).alias("in_degree"))
    outd = e.groupBy("schema", F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("out_degree"))
    return (graph_nodes(objects).join(ind, ["schema", "name"], "left").join(outd, ["schema", "name"], "left")
            .select("schema", "name", "node_type",
                    F.coalesce("in_degree", F.lit(0)).cast("bigint").alias("in_degree"),
                    F.coalesce("out_degree", F.lit(0)).cast("bigint").alias("out_degree")))


def top_nodes(deg: DataFrame, by: str = "in_degree", n: int = K.REPORT_TOP_N) -> DataFrame:
    """L1 per schema: top-n by degree, ties by name. A ranking window per
    schema: WindowGroupLimit keeps only n rows per schema in each map task
    before the shuffle, so even a schema holding most objects stays cheap."""
    from pyspark.sql import Window
    w = Window.partitionBy("schema").orderBy(F.desc(by), F.asc("name"))
    return (deg.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select("schema", F.col("rank").cast("bigint").alias("rank"), "name", F.col(by).alias("count")))


def isolated(deg: DataFrame) -> DataFrame:
    """Objects with no incoming or outgoing relation."""
    return deg.filter((F.col("in_degree") + F.col("out_degree")) == 0).select("schema", "name", "node_type")


def relations_by_type(rels: DataFrame) -> DataFrame:
    """Relation count per type on the full (non-distinct) list."""
    return rels.groupBy("schema", "type").agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def object_counts(objects: DataFrame) -> DataFrame:
    """Objects per kind for all nine kinds (zeros included) plus a
    ``total`` row, per schema: one conditional aggregation, then unpivoted."""
    per = objects.select("schema", "obj_type", "name").distinct()
    agg = per.groupBy("schema").agg(
        *[F.count(F.when(F.col("obj_type") == k, 1)).alias(k) for k in K.OBJECT_KINDS],
        F.count(F.when(F.col("obj_type").isin(*K.OBJECT_KINDS), 1)).alias("total"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("obj_type"), F.col(k).cast("bigint").alias("count"))
                               for k in K.OBJECT_KINDS + ["total"]]))
    return agg.select("schema", rows.alias("r")).select("schema", "r.obj_type", "r.count")


def dot_lines(objects: DataFrame, rels: DataFrame) -> DataFrame:
    """Graphviz DOT as (schema, section, sort_key, line) rows.

    Sections: 0 header, 1 nodes, 2 edges, 3 footer. Write with
    ``orderBy("section", "sort_key")`` per schema.
    """
    colors = F.create_map(*[x for k, v in K.DOT_COLORS.items() for x in (F.lit(k), F.lit(v))])
    nodes = graph_nodes(objects)
    node_lines = nodes.select(
        "schema", F.lit(1).alias("section"), F.col("name").alias("sort_key"),
        F.format_string('  "%s" [fillcolor=%s, label="%s"];', F.col("name"),
                        F.coalesce(colors[F.col("node_type")], F.lit("white")),
                        F.replace(F.col("name"), F.lit("_"), F.lit("\\n"))).alias("line"))
    edges = graph_edges(rels)
    edge_lines = edges.select(
        "schema", F.lit(2).alias("section"), F.concat_ws("\u0001", "source", "target").alias("sort_key"),
        F.format_string('  "%s" -> "%s" [label="%s"];', "source", "target",
                        F.coalesce("relationship", F.lit("RELATED"))).alias("line"))
    schemas = objects.select("schema").distinct()
    head = schemas.select("schema", F.lit(0).alias("section"), F.lit("").alias("sort_key"),
                          F.lit('digraph Relationships {\n  rankdir=LR;\n  node [shape=box, style=filled];\n').alias("line"))
    foot = schemas.select("schema", F.lit(3).alias("section"), F.lit("").alias("sort_key"), F.lit("\n}").alias("line"))
    return head.unionByName(node_lines).unionByName(edge_lines).unionByName(foot)
