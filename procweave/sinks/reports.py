"""Report sinks as line frames: Mermaid, Markdown, JSON/Parquet exports.

Every report is a DataFrame of ``(section, sort_key, line)`` rows built with
string functions; writing it is ``orderBy(section, sort_key)`` then
``write.text``. Reports are whole unless a number asks for the first nodes or
relations, and stay
distributed: the ordered write produces range-partitioned files in order,
and nothing is collected on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procweave.functions import constants as K
from procweave.functions.extract import cut
from procweave.functions.scoring import complexity_class


def mermaid_id(c) -> Column:
    """Node id with ``.``, ``-`` and blanks replaced by ``_``."""
    return F.translate(F.col(c) if isinstance(c, str) else c, ".- ", "___")


def mermaid_label(c) -> Column:
    """Label with ``"`` -> ``'``, ``[`` -> ``(``, ``]`` -> ``)``."""
    return F.translate(F.col(c) if isinstance(c, str) else c, '"[]', "'()")


def _line(section: int, key, text) -> list[Column]:
    return [F.lit(section).alias("section"), (key if isinstance(key, Column) else F.lit(key)).alias("sort_key"),
            text.alias("line")]


def _order_key(column: str, df: DataFrame) -> Column:
    """A struct of numbers and names as text that sorts the same way."""
    parts = [F.lpad(F.col(f"{column}.{f.name}").cast("string"), 20, "0") if f.dataType.typeName() in ("integer", "long", "short", "byte")
             else F.col(f"{column}.{f.name}") for f in df.schema[column].dataType.fields]
    return F.concat_ws("\u0001", *parts)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "section int, sort_key string, line string")


def call_diagram(procs: DataFrame, edges: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """K7: Mermaid call graph of all graph nodes, or of the first ``max_nodes`` (by name).

    ``procs(proc, complexity_score, level)``, ``edges(src, dst)`` with
    procedure keys. Graph nodes are procedures and callees; only procedure
    nodes get a line; edges are kept when both ends are among the chosen
    nodes. (The original takes the first nodes in insertion order.)
    """
    spark = procs.sparkSession
    p, e = procs, edges.select("src", "dst").distinct()
    if max_nodes is not None:
        nodes = procs.select(F.col("proc").alias("node")).union(edges.select("src")).union(edges.select("dst")).distinct()
        chosen = nodes.orderBy("node").limit(max_nodes)
        p = procs.join(chosen.select(F.col("node").alias("proc")), "proc", "left_semi")
        e = (e.join(chosen.select(F.col("node").alias("src")), "src", "left_semi")
             .join(chosen.select(F.col("node").alias("dst")), "dst", "left_semi"))
    label = mermaid_label(F.concat(F.col("proc"), F.lit("\\n[Nível "), F.col("level").cast("string"),
                                   F.lit(", Complex: "), F.col("complexity_score").cast("string"), F.lit("]")))
    node_lines = p.select(*_line(1, F.col("proc"), F.concat(F.lit("    "), mermaid_id("proc"), F.lit('["'), label,
                                                              F.lit('"]:::'), complexity_class("complexity_score"))))
    edge_lines = e.select(*_line(2, F.concat_ws("\u0001", "src", "dst"),
                                 F.concat(F.lit("    "), mermaid_id("src"), F.lit(" --> "), mermaid_id("dst"))))
    head = _frame(spark, [(0, "", "```mermaid\n" + K.MERMAID_INIT_FLOWCHART + "\ngraph TD")])
    foot = _frame(spark, [(3, "", K.MERMAID_CLASS_DEFS)])
    return head.unionByName(node_lines).unionByName(edge_lines).unionByName(foot)


def hierarchy_diagram(procs: DataFrame, edges: DataFrame) -> DataFrame:
    """K8: every procedure by level, with its edges to other analysed procedures."""
    spark = procs.sparkSession
    lvl = procs.filter(F.col("level").isNotNull())
    key = F.concat(F.lpad(F.col("level").cast("string"), 20, "0"), F.lit("\u0001"), F.col("proc"))
    label = mermaid_label(F.concat(F.col("proc"), F.lit("\\n[Nível "), F.col("level").cast("string"),
                                   F.lit(", Complex: "), F.col("complexity_score").cast("string"), F.lit("]")))
    node_lines = lvl.select(*_line(1, F.concat(key, F.lit("\u0000")),
                                   F.concat(F.lit("    "), mermaid_id("proc"), F.lit('["'), label, F.lit('"]:::'),
                                            complexity_class("complexity_score"))))
    internal = (edges.select("src", "dst").distinct()
                .join(procs.select(F.col("proc").alias("dst")), "dst", "left_semi")
                .join(lvl.select(F.col("proc").alias("src"), "level"), "src"))
    ekey = F.concat(F.lpad(F.col("level").cast("string"), 20, "0"), F.lit("\u0001"), F.col("src"), F.lit("\u0001"), F.col("dst"))
    edge_lines = internal.select(*_line(1, ekey, F.concat(F.lit("    "), mermaid_id("src"), F.lit(" --> "), mermaid_id("dst"))))
    head = _frame(spark, [(0, "", "```mermaid\n" + K.MERMAID_INIT_FLOWCHART + "\ngraph TD")])
    foot = _frame(spark, [(3, "", K.MERMAID_CLASS_DEFS)])
    return head.unionByName(node_lines).unionByName(edge_lines).unionByName(foot)


def flowcharts(analysis: DataFrame, levels: DataFrame) -> DataFrame:
    """K9: one Mermaid flowchart per procedure, all at once, keyed by ``proc``.

    Rows ``(proc, section, sort_key, line)``; parameters use the signature
    form (P14), callees and tables the static sets; the text under the logic
    heading is the ``business_logic`` column where the analysis has one. All
    lines of a procedure come from one array, so the analysis is read once.
    """
    a = analysis.join(levels.select(F.col("node").alias("proc"), "level"), "proc", "left")
    quote = lambda c: F.translate(c, '"', "'")
    line = lambda section, key, text: F.struct(*_line(section, key, text))
    none = F.array().cast("array<struct<section:int,sort_key:string,line:string>>")
    logic = F.coalesce(F.col("business_logic"), F.lit("")) if "business_logic" in analysis.columns else F.lit("")

    def listed(column, section, opening, one):
        lines = F.concat(F.array(line(section, "", opening)), F.transform(F.col(column), one))
        return F.when(F.size(column) > 0, lines).otherwise(none)

    head = F.array(line(0, "", F.concat(
        F.lit("# Flowchart: "), F.col("proc"), F.lit("\n\n**Complexidade:** "), F.col("complexity_score").cast("string"),
        F.lit("/10\n**Nível de Dependência:** "), F.coalesce(F.col("level").cast("string"), F.lit("0")),
        F.lit("\n\n```mermaid\n" + K.MERMAID_INIT_FLOWCHART + "\nflowchart TD\n    Start([Início: "), quote(F.col("proc")),
        F.lit("])"))))
    params = listed("signature_parameters", 1, F.concat(
        F.lit("    Params[Parâmetros: "), F.size("signature_parameters").cast("string"), F.lit("]\n    Start --> Params")),
        lambda p: line(2, F.lpad(p["position"].cast("string"), 20, "0"), F.concat(
            F.lit("    Params --> P"), p["position"].cast("string"), F.lit('["'), quote(p["name"]), F.lit(": "),
            F.translate(quote(p["type"]), "- ", "__"), F.lit(" ("), p["direction"], F.lit(')"]'))))
    calls = listed("calls", 3, F.lit("    Procs[Procedures Chamadas]\n    Start --> Procs"),
                   lambda c: line(4, c, F.concat(F.lit("    Procs --> Proc_"), mermaid_id(c), F.lit('["'), quote(c), F.lit('"]'))))
    tables = listed("tables", 5, F.lit("    Tables[Tabelas Acessadas]\n    Start --> Tables"),
                    lambda t: line(6, t, F.concat(F.lit("    Tables --> Table_"), mermaid_id(t), F.lit('["'), quote(t), F.lit('"]'))))
    tail = F.array(line(7, "", F.concat(F.lit("    End([Fim])\n    Start --> End\n```\n\n## Lógica de Negócio\n\n"), logic, F.lit("\n"))))
    return a.select("proc", F.explode(F.concat(head, params, calls, tables, tail)).alias("l")).select("proc", "l.*")


def er_diagram(cols: DataFrame, fk_edges: DataFrame, max_nodes: int | None = None, max_columns: int | None = None,
               type_chars: int | None = None) -> DataFrame:
    """Mermaid ER of all tables: PK columns first, then the others by
    ordinal; type cut at ``(``, blanks/hyphens to ``_``; PK / FK marks.

    ``max_nodes`` keeps the first tables by key, ``max_columns`` the first
    columns of a table (at most 3 of them as PK columns and 5 others, as the
    original picks them), ``type_chars`` cuts the type text (``K.ER_*``).
    """
    spark = cols.sparkSession
    c = cols.withColumn("table", F.concat_ws(".", "table_schema", "table_name"))
    chosen = c.select("table").distinct()
    if max_nodes is not None:
        chosen = chosen.orderBy("table").limit(max_nodes)
        c = c.join(chosen, "table", "left_semi")
    c = c.withColumn("pk_rank", F.when(F.col("is_primary_key"), F.row_number().over(
        Window.partitionBy("table", "is_primary_key").orderBy("ordinal")))).withColumn(
        "pos", F.row_number().over(Window.partitionBy("table").orderBy("ordinal")))
    pk_pick = F.col("pk_rank").isNotNull() if max_columns is None else F.col("pk_rank") <= K.ER_MAX_PK
    picked = c if max_columns is None else c.filter(pk_pick | (F.col("pos") <= K.ER_FIRST_COLUMNS))
    # order: PK columns first (by PK rank), then the columns that are not PK picks
    picked = picked.withColumn("o", F.when(pk_pick, F.col("pk_rank").cast("bigint")).otherwise(F.lit(1 << 32) + F.col("pos")))
    if max_columns is not None:
        picked = picked.withColumn("k", F.row_number().over(Window.partitionBy("table").orderBy("o"))).filter(F.col("k") <= max_columns)
    typ = cut(F.translate(F.trim(F.substring_index("data_type", "(", 1)), "- ", "__"), type_chars)
    col_lines = picked.select(*_line(1, F.concat(F.col("table"), F.lit("\u0001"), F.lpad(F.col("o").cast("string"), 20, "0")),
                                     F.concat(F.lit("        "), F.col("column_name"), F.lit(" "), typ,
                                              F.when(F.col("is_primary_key"), F.lit(" PK")).otherwise(F.lit("")),
                                              F.when(F.col("is_foreign_key"), F.lit(" FK")).otherwise(F.lit("")))))
    open_lines = chosen.select(*_line(1, F.concat(F.col("table"), F.lit("\u0000")),
                                      F.concat(F.lit("    "), mermaid_id("table"), F.lit(" {"))))
    close_lines = chosen.select(*_line(1, F.concat(F.col("table"), F.lit("\u0002")), F.lit("    }")))
    e = (fk_edges.select("src", "dst").distinct()  # both ends must be tables of the diagram
         .join(chosen.select(F.col("table").alias("src")), "src", "left_semi")
         .join(chosen.select(F.col("table").alias("dst")), "dst", "left_semi"))
    rel_lines = e.select(*_line(2, F.concat_ws("\u0001", "src", "dst"),
                                F.concat(F.lit("    "), mermaid_id("src"), F.lit(" ||--o{ "), mermaid_id("dst"),
                                         F.lit(' : "foreign_key"'))))
    head = _frame(spark, [(0, "", "```mermaid\n" + K.MERMAID_INIT_ER + "\nerDiagram")])
    foot = _frame(spark, [(3, "", "```")])
    return head.unionByName(open_lines).unionByName(col_lines).unionByName(close_lines).unionByName(rel_lines).unionByName(foot)


def markdown_report(schema_objects: DataFrame, rels: DataFrame, deg: DataFrame, generated_at: str,
                    max_relations: int | None = None, top_n: int = K.REPORT_TOP_N) -> DataFrame:
    """Relationship report lines per schema: statistics, objects per
    kind, top referenced / referencing, isolated objects, relations per type
    and all relations, or the first ``max_relations`` (in extraction order)."""
    from procweave.operators import relmap as RM

    counts = RM.object_counts(schema_objects)
    schemas = schema_objects.select("schema").distinct()
    n_rel = rels.groupBy("schema").agg(F.count(F.lit(1)).alias("n_rel"))
    total = counts.filter(F.col("obj_type") == "total").select("schema", F.col("count").alias("n_obj"))
    head = schemas.join(total, "schema").join(n_rel, "schema", "left").select(
        "schema", *_line(0, "", F.concat(
            F.lit(K.REPORT_TITLE), F.col("schema"),
            F.lit(K.REPORT_STATISTICS.format(generated_at=generated_at)),
            F.col("n_obj").cast("string"), F.lit(K.REPORT_TOTAL_RELATIONS),
            F.coalesce(F.col("n_rel"), F.lit(0)).cast("string"),
            F.lit(K.REPORT_BY_KIND))))
    kind_idx = F.create_map(*[x for i, k in enumerate(K.OBJECT_KINDS) for x in (F.lit(k), F.lit(i))])
    kinds = counts.filter(F.col("obj_type") != "total").select(
        "schema", *_line(1, F.lpad(kind_idx[F.col("obj_type")].cast("string"), 20, "0"),
                         F.concat(F.lit("| "), F.initcap("obj_type"), F.lit(" | "), F.col("count").cast("string"), F.lit(" |"))))
    top_in = RM.top_nodes(deg, "in_degree", top_n).select(
        "schema", *_line(3, F.lpad(F.col("rank").cast("string"), 20, "0"),
                         F.concat(F.lit("| "), F.col("name"), F.lit(" | "), F.col("count").cast("string"), F.lit(" |"))))
    top_out = RM.top_nodes(deg, "out_degree", top_n).select(
        "schema", *_line(5, F.lpad(F.col("rank").cast("string"), 20, "0"),
                         F.concat(F.lit("| "), F.col("name"), F.lit(" | "), F.col("count").cast("string"), F.lit(" |"))))
    heads = schemas.select("schema", *_line(2, "", F.lit(K.REPORT_TOP_REFERENCED))) \
        .unionByName(schemas.select("schema", *_line(4, "", F.lit(K.REPORT_TOP_REFERENCING))))
    iso = RM.isolated(deg).select("schema", *_line(7, F.col("name"), F.col("name")))
    iso_head = (RM.isolated(deg).groupBy("schema").agg(F.count(F.lit(1)).alias("n"))
                .select("schema", *_line(6, "", F.concat(F.lit(K.REPORT_ISOLATED), F.col("n").cast("string"), F.lit(")\n")))))
    by_type = RM.relations_by_type(rels).select(
        "schema", *_line(9, F.concat(F.lpad((F.lit((1 << 63) - 1) - F.col("count")).cast("string"), 20, "0"), F.col("type")),
                         F.concat(F.lit("| "), F.col("type"), F.lit(" | "), F.col("count").cast("string"), F.lit(" |"))))
    bt_head = schemas.select("schema", *_line(8, "", F.lit(K.REPORT_BY_TYPE)))
    w = Window.partitionBy("schema").orderBy("ord")
    row = F.concat(F.lit("| "), F.col("source"), F.lit(" | "), F.col("type"), F.lit(" | "), F.col("target"), F.lit(" |"))
    if max_relations is None:
        # the extraction order as a sort key: no ranking window over a schema's relations
        first = rels.select("schema", *_line(11, _order_key("ord", rels), row))
    else:
        first = (rels.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max_relations)
                 .select("schema", *_line(11, F.lpad(F.col("r").cast("string"), 20, "0"), row)))
    r_head = schemas.select("schema", *_line(10, "", F.lit(K.REPORT_RELATIONS)))
    more = n_rel.filter(F.col("n_rel") > (F.lit(max_relations) if max_relations is not None else F.col("n_rel"))).select(
        "schema", *_line(12, "", F.concat(F.lit(K.REPORT_SHOWN.format(shown=max_relations)), F.col("n_rel").cast("string"), F.lit(K.REPORT_SHOWN_END))))
    out = head
    for f in (kinds, heads, top_in, top_out, iso_head, iso, bt_head, by_type, r_head, first, *([more] if max_relations is not None else [])):
        out = out.unionByName(f)
    return out


def write_lines(lines: DataFrame, path: str, keys: tuple = ("section", "sort_key"), single_file: bool = False) -> None:
    """Write a line frame in order. ``single_file`` only for capped reports."""
    ordered = lines.orderBy(*keys).select("line")
    if single_file:
        ordered = ordered.coalesce(1)
    ordered.write.mode("overwrite").text(path)


def export_sections(frames: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """K1-K4: one dataset per section (procedures, hierarchy, statistics, nodes, edges ...)."""
    for name, df in frames.items():
        df.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/{name}")


def export_partitioned(df: DataFrame, path: str, key: str, fmt: str = "json") -> None:
    """One partition per key (cache entry per table, DDL per object kind),
    replacing only the partitions present in ``df`` (dynamic overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).format(fmt).save(path)


# ------------------------------------------------------------- K15
_DIAGRAM_PATTERNS = [
    (r"(?i)```mermaid\s*\n\s*(erDiagram)", "er"),
    (r"(?i)```mermaid\s*\n\s*(graph\s+(TD|LR|TB|RL))", "graph"),
    (r"(?i)```mermaid\s*\n\s*(flowchart\s+(TD|LR|TB|RL))", "flowchart"),
]


def add_mermaid_init(docs: DataFrame, content_col: str = "content") -> DataFrame:
    """Markdown files that open a Mermaid fence anywhere get
    the init block of their diagram type inserted after the fence, unless an
    init block is already there. Adds ``diagram_type``, ``updated`` and
    ``new_content``; write ``new_content`` to a new directory."""
    c = F.col(content_col)
    is_mermaid = c.contains("```mermaid")
    kind = F.coalesce(*[F.when(c.rlike(p), F.lit(k)) for p, k in _DIAGRAM_PATTERNS])
    line = F.coalesce(*[F.when(c.rlike(p), F.regexp_extract(c, p, 1)) for p, _ in _DIAGRAM_PATTERNS])
    init = F.when(kind == "er", F.lit(K.MERMAID_INIT_ER + "\n")).otherwise(F.lit(K.MERMAID_INIT_FLOWCHART + "\n"))
    # the first diagram line is matched literally (quoted), like re.escape
    pattern = F.concat(F.lit(r"(?i)```mermaid\s*\n\s*(\Q"), line, F.lit(r"\E)"))
    new = F.regexp_replace(c, pattern, F.concat(F.lit("```mermaid\n"), F.regexp_replace(init, r"([\\$])", r"\\$1"), F.lit("$1")))
    eligible = is_mermaid & ~c.contains("%%{init:") & kind.isNotNull()
    return docs.select("*", F.when(eligible, kind).alias("diagram_type"),
                       (eligible & (new != c)).alias("updated"),
                       F.when(eligible, new).otherwise(c).alias("new_content"))


def table_hierarchy_diagram(levels: DataFrame, summary: DataFrame, fk_edges: DataFrame) -> DataFrame:
    """Mermaid graph with one subgraph per FK level; node label carries
    complexity and FK count, class by complexity; every FK edge drawn.

    ``levels(table, level)``, ``summary(table_schema, table_name, n_fks,
    complexity_score)``, ``fk_edges(src, dst)``.
    """
    spark = levels.sparkSession
    s = summary.select(F.concat_ws(".", "table_schema", "table_name").alias("table"), "n_fks", "complexity_score")
    t = levels.filter(F.col("level").isNotNull()).join(s, "table")
    lv = F.lpad(F.col("level").cast("string"), 20, "0")
    opens = levels.filter(F.col("level").isNotNull()).select("level").distinct().select(
        *_line(1, F.concat(lv, F.lit("\u0000")), F.concat(F.lit("    subgraph Level"), F.col("level").cast("string"),
                                                          F.lit('["Nível '), F.col("level").cast("string"), F.lit('"]'))))
    closes = levels.filter(F.col("level").isNotNull()).select("level").distinct().select(
        *_line(1, F.concat(lv, F.lit("\u0002")), F.lit("    end")))
    label = mermaid_label(F.concat(F.col("table"), F.lit("\\n[Complex: "), F.col("complexity_score").cast("string"),
                                   F.lit(", FKs: "), F.col("n_fks").cast("string"), F.lit("]")))
    nodes = t.select(*_line(1, F.concat(lv, F.lit("\u0001"), F.col("table")),
                            F.concat(F.lit("        "), mermaid_id("table"), F.lit('["'), label, F.lit('"]:::'),
                                     complexity_class("complexity_score"))))
    edges = fk_edges.select(*_line(2, F.concat_ws("\u0001", "src", "dst"),
                                   F.concat(F.lit("    "), mermaid_id("src"), F.lit(" --> "), mermaid_id("dst"))))
    head = _frame(spark, [(0, "", "```mermaid\n" + K.MERMAID_INIT_FLOWCHART + "\ngraph TD")])
    foot = _frame(spark, [(3, "", K.MERMAID_CLASS_DEFS)])
    return head.unionByName(opens).unionByName(nodes).unionByName(closes).unionByName(edges).unionByName(foot)
