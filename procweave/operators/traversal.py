"""Iterative graph jobs: dependency levels, cycles, crawl, impact.

All of them are loops of DataFrame joins. Each round's
state is written once under the session's checkpoint directory
(:func:`procweave.session.materialize`) so lineage stays short and a lost
executor only costs the current round. Frontiers are joined without
broadcast hints: AQE measures them at runtime and turns the join into a
broadcast hash join only when the measured size is under the threshold.
Everything is keyed by node (and by root for multi-root walks), so a hot
callee is a skewed join key that AQE's skew-join splitting handles; nothing
collects a group into one task.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.session import BUCKET_ROWS, FEW_ROWS, bucketed, few, materialize, partitioned


def internal_edges(nodes: DataFrame, edges: DataFrame, drop_self: bool) -> DataFrame:
    e = edges.select("src", "dst")
    if drop_self:
        e = e.filter(F.col("src") != F.col("dst"))
    n = nodes.select(F.col("node"))
    e = e.join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")
    e = e.join(n.withColumnRenamed("node", "src"), "src", "left_semi")
    return e.select("src", "dst").distinct()


#: Level of a node on or above a cycle while levels are computed.
_ENDLESS = 1 << 61

#: Layers that are taken off one by one before the rest is contracted.
LAYERS = 32

#: A layer of more nodes is sent to the edges, which lie dealt by callee; a smaller one Spark may broadcast.
WIDE_LAYER = 100_000


def _longest_paths(nodes: DataFrame, e: DataFrame, tag: str) -> DataFrame:
    """(node, level): number of edges of the longest path from a node, NULL on or above a cycle.

    The first :data:`LAYERS` layers are taken off from below: a round joins the edges,
    which stay as they were written and carry the number of edges of their source, with the nodes
    finished last, and adds up per caller how many of its edges are met. The edges lie dealt by
    callee, so a round moves the nodes finished last and the edges met, each once in all rounds,
    however many rounds there are. Written per round
    are only the callers met: those now finished, which are the next layer, and those that wait for
    more. A wide graph of few layers is done then, and nothing was rewritten on the way. If
    a layer is empty, every node left waits for others that do too: on or above a cycle.
    What is left after the last of these layers (long chains) goes to :func:`_contracted`.
    """
    outs = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    total = nodes.count()
    edges = bucketed(e.select("src", "dst").join(outs, "src"), "dst", 2 * total, f"{tag}-e")
    frontier = materialize(nodes.select("node").join(edges.select(F.col("src").alias("node")), "node", "left_anti")
                           .select("node", F.lit(0).cast("bigint").alias("level")), f"{tag}-l")
    done, waiting, size = [frontier], None, frontier.count()
    for _ in range(LAYERS):
        last = frontier.select(F.col("node").alias("dst"), "level")
        met = (edges.join(last.hint("shuffle_hash") if size > WIDE_LAYER else last, "dst")
               .select(F.col("src").alias("node"), "n", F.lit(1).cast("bigint").alias("got"), (F.col("level") + 1).alias("level")))
        if waiting is not None:
            met = met.unionByName(waiting)
        state = (met.groupBy("node").agg(F.max("n").alias("n"), F.sum("got").alias("got"), F.max("level").alias("level"))
                 .withColumn("full", F.col("got") >= F.col("n")))
        # two folders, so that a small layer is known as small and broadcast before any edge is dealt
        path = partitioned(state, "full", f"{tag}-l")
        frontier, waiting = path[True].select("node", "level"), path[False].select("node", "n", "got", "level")
        size = frontier.count()
        if not size:
            frontier = None
            break
        done.append(frontier)
    levels = _union(done, nodes.select("node", F.lit(0).cast("bigint").alias("level")))
    left = nodes.select("node").where("node IS NOT NULL").join(levels.select("node"), "node", "left_anti")
    if frontier is None:
        return levels.unionByName(left.select("node", F.lit(None).cast("bigint").alias("level")))
    # what callers learn from the last layer, whose edges leave too
    learnt = (edges.join(frontier.select(F.col("node").alias("dst"), "level"), "dst").select(F.col("src").alias("node"), (F.col("level") + 1).alias("level"))
              .unionByName(waiting.select("node", "level")).groupBy("node").agg(F.max("level").alias("level")))
    left = materialize(left.join(learnt, "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("known")), f"{tag}-w")
    if left.isEmpty():
        return levels
    open_edges = edges.join(levels.select(F.col("node").alias("dst")), "dst", "left_anti")
    return levels.unionByName(_contracted(left, open_edges, total, tag))


def _contracted(known: DataFrame, e: DataFrame, total: int, tag: str) -> DataFrame:
    """(node, level) of what :func:`_longest_paths` leaves: ``known(node, known)`` with least levels, edges among them.

    What a node still waits for is kept as weighted edges, what it already knows as a
    least level. A round has two steps. Edges into the nodes finished last (those
    without edges) leave; their callers learn ``level + weight``. Then every node with a
    single edge, the function ``max(known, level(target) + weight)``, is put in place of
    itself in its callers, all at once: a chain of n single calls halves each round
    (about log2 n rounds), and a layer of finished nodes leaves in the same rounds.
    Parallel edges keep the heaviest. A path that comes back to its start or gets longer
    than the number of nodes (``total``) is endless. If nothing finished and no edge moved, every node
    left waits for others that do too: on or above a cycle.

    Written per round: the unfinished nodes and their edges, both shrinking.
    """
    edges = materialize(e.select("src", "dst", F.lit(1).cast("bigint").alias("w")), f"{tag}-e")
    live = known.select("node", "known")
    endless = F.col("known") >= _ENDLESS
    done, finished = [], None
    while True:
        if finished is not None:
            met = edges.join(finished.select(F.col("node").alias("dst"), F.col("known").alias("level")), "dst", "left")
            learnt = (met.where("level IS NOT NULL").groupBy(F.col("src").alias("node"))
                      .agg(F.least(F.max(F.col("level") + F.col("w")), F.lit(_ENDLESS)).alias("learnt")))
            live = live.join(learnt, "node", "left").select("node", F.greatest("known", F.coalesce("learnt", F.lit(0))).alias("known"))
            edges = met.where("level IS NULL").select("src", "dst", "w")
        out = (edges.groupBy(F.col("src").alias("node"))
               .agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("target"), F.max("w").alias("step")))
        state = materialize(live.join(out, "node", "left")
                            .select("node", "known", F.when(endless, 0).otherwise(F.coalesce("n", F.lit(0))).alias("n"), "target", "step"), f"{tag}-s")
        finished = state.where("n = 0").select("node", "known")
        done.append(finished.select("node", F.when(~endless, F.col("known")).alias("level")))
        live = state.where("n > 0").select("node", "known")
        if live.isEmpty():
            break
        single = state.where("n = 1").select(F.col("node").alias("dst"), "known", "target", "step")
        seen = edges.join(live.select(F.col("node").alias("src")), "src", "left_semi").join(single, "dst", "left")
        moved = seen.select("src", F.coalesce("target", "dst").alias("to"), (F.col("w") + F.coalesce("step", F.lit(0))).alias("w"),
                            (F.col("known") + F.col("w")).alias("known"), F.col("target").isNotNull().alias("moved"))
        back = (F.col("to") == F.col("src")) | (F.col("w") > total)
        moved = moved.select("src", F.when(~back, F.col("to")).alias("dst"), "w",
                             F.when(back, F.lit(_ENDLESS)).otherwise(F.col("known")).alias("known"), "moved")
        step = materialize(moved.groupBy("src", "dst").agg(F.max("w").alias("w"), F.max("known").alias("known"), F.max("moved").alias("moved")), f"{tag}-e")
        if finished.isEmpty() and step.where("moved").isEmpty():
            done.append(live.select("node", F.lit(None).cast("bigint").alias("level")))
            break
        edges = step.where("dst IS NOT NULL").select("src", "dst", "w")
        learnt = step.where("known IS NOT NULL").groupBy(F.col("src").alias("node")).agg(F.max("known").alias("learnt"))
        live = live.join(learnt, "node", "left").select("node", F.greatest("known", F.coalesce("learnt", F.lit(0))).alias("known"))
    return _union(done, known.select("node", F.col("known").alias("level")))


def _union(frames, schema_df: DataFrame) -> DataFrame:
    if not frames:
        return schema_df.limit(0)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def dependency_levels(nodes: DataFrame, edges: DataFrame, drop_self: bool = True,
                      compat: bool = False) -> DataFrame:
    """(node, level, in_cycle) for every node in ``nodes(node)``.

    level = 1 + max(level of internal callees), 0 without internal callees
    (callees outside ``nodes`` are ignored). Nodes on or above a cycle get
    ``level`` NULL and ``in_cycle`` true. ``compat=True`` gives every node
    level 0 as soon as any cycle exists (the intent of the original error
    handler). Self-calls are dropped by default (a signature ``name(``
    matches the call pattern).
    """
    nodes = materialize(nodes.select("node").distinct(), "levels-n")
    e = internal_edges(nodes, edges, drop_self)
    result = _longest_paths(nodes, e, "levels").withColumn("in_cycle", F.col("level").isNull())
    if compat:
        if not result.where("in_cycle").isEmpty():
            result = result.select("node", F.lit(0).cast("bigint").alias("level"), F.lit(False).alias("in_cycle"))
    return result


def hierarchy(levels: DataFrame) -> DataFrame:
    """(level, node) rows ordered by level then name. Kept as rows,
    never as one list per level, because a level can hold millions of names."""
    return levels.filter(F.col("level").isNotNull()).select("level", "node").orderBy("level", "node")


#: Tables of one round each that are read as one before they are put together.
ROUND_TABLES = 16


def _dealt(e: DataFrame, key: str, tag: str) -> DataFrame:
    """Edges written once, dealt by ``key`` on disk if they are many."""
    e = materialize(e, tag)
    n = e.count()
    return bucketed(e, key, n, tag) if n > BUCKET_ROWS else e


def _better(rows: DataFrame, known: list[DataFrame], total: int, tag: str) -> DataFrame:
    """The rows (node, c), written, for whose node the ``known`` rows (node, c), ``total`` in number, hold no ``c`` as small.

    Of much that is known nothing moves: the rows are written first and, if few, go to it.
    """
    if not known:
        return materialize(rows, tag)
    held = _union(known, rows)
    if total <= FEW_ROWS:
        held = F.broadcast(held.groupBy("node").agg(F.min("c").alias("_c")))
        return materialize(rows.join(held, "node", "left").where("_c IS NULL OR c < _c").select("node", "c"), tag)
    rows = materialize(rows, tag)
    beaten = held.join(few(rows).select("node", F.col("c").alias("_c")), "node").where("c <= _c").select("node")
    return materialize(rows.join(beaten, "node", "left_anti"), tag)


def _with_round(known: list[DataFrame], rows: DataFrame, tag: str) -> list[DataFrame]:
    """The tables of ``known`` and one more; of many rounds they are put together now and then, so that plans stay short."""
    known = [*known, rows]
    return known if len(known) < ROUND_TABLES else [materialize(_union(known, rows).groupBy("node").agg(F.min("c").alias("c")), tag)]


def _components_of(pairs) -> list[tuple]:
    """(node, least node of its strongly connected component) of every end of ``pairs``, by a walk without recursion (Tarjan)."""
    after: dict = {}
    for src, dst in pairs:
        after.setdefault(src, []).append(dst)
        after.setdefault(dst, [])
    index, low, open_nodes, held, out = {}, {}, [], set(), []
    for start in after:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        open_nodes.append(start)
        held.add(start)
        way = [(start, iter(after[start]))]
        while way:
            node, rest = way[-1]
            for target in rest:
                if target not in index:
                    index[target] = low[target] = len(index)
                    open_nodes.append(target)
                    held.add(target)
                    way.append((target, iter(after[target])))
                    break
                if target in held:
                    low[node] = min(low[node], index[target])
            else:
                way.pop()
                if way:
                    low[way[-1][0]] = min(low[way[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(open_nodes.pop())
                        held.discard(members[-1])
                    least = min(members)
                    out += [(m, least) for m in members]
    return out


def _scc_at_once(e: DataFrame) -> DataFrame:
    """(node, scc) of at most :data:`FEW_ROWS` edges, in one task: rounds over so few cost more than they do."""
    kind = e.schema["src"].dataType

    def walk(batches):
        import pyarrow as pa

        held = [b for b in batches]
        if held:
            edges = pa.Table.from_batches(held)
            found = _components_of(zip(edges.column("src").to_pylist(), edges.column("dst").to_pylist()))
            at = edges.schema.field("src").type
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], at), pa.array([c for _, c in found], at)], ["node", "scc"])

    return e.select("src", "dst").coalesce(1).mapInArrow(walk, f"node {kind.simpleString()}, scc {kind.simpleString()}")


def _min_label_scc(e: DataFrame, tag: str) -> DataFrame:
    """Strongly connected components by forward/backward colouring.

    Repeats: propagate the minimum id forward to a fixpoint (colour); each
    colour's own node is a root; walk backwards from it inside its colour;
    what is reached is its component. Edges between colours are removed,
    since a component has one colour, and edges of assigned nodes and of nodes left without
    an edge in or out, which are components of one. Exact.

    A round of colours moves the nodes whose colour changed and writes them only: the edges lie dealt by
    caller, and what a node has learnt is kept as one table per round. The walk goes in the same way over the edges
    inside colours, dealt by callee. When at most :data:`FEW_ROWS` edges are left, one task does them.
    Returns (node, scc) of every node of a component of more than one, and of some others, each named by itself.
    """
    found = []
    e = _dealt(e, "src", f"{tag}-e")
    while not e.isEmpty():
        if e.count() <= FEW_ROWS:
            return _union([*found, _scc_at_once(e)], e)
        # (node, c): callers' names smaller than the node's own, to be passed on
        learnt, known = e.where("src < dst").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("c")), []
        total = 0
        while True:
            learnt = _better(learnt, known, total, f"{tag}-c")
            size = learnt.count()
            if not size:
                break
            total += size
            known = _with_round(known, learnt, f"{tag}-c")
            last = learnt.select(F.col("node").alias("src"), "c")
            learnt = (e.join(last.hint("shuffle_hash") if size > WIDE_LAYER else last, "src").where("c < dst")
                      .groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("c")))
        if known:
            colour = materialize(_union(known, e).groupBy("node").agg(F.min("c").alias("c")), f"{tag}-c")
        else:  # every edge leads to a smaller name
            break
        # a node that learnt nothing has its own name
        same = (e.join(colour.select(F.col("node").alias("src"), F.col("c").alias("_s")), "src", "left")
                .join(colour.select(F.col("node").alias("dst"), F.col("c").alias("_d")), "dst", "left")
                .select("src", "dst", F.coalesce("_d", "dst").alias("c"), F.coalesce("_s", "src").alias("_s")).where("c = _s").drop("_s"))
        same = _dealt(same, "dst", f"{tag}-e")
        # backward walk from each root inside its colour
        frontier = materialize(same.where("dst = c").select(F.col("dst").alias("node"), "c").distinct(), f"{tag}-r")
        reached, size = [frontier], frontier.count()
        total = size
        while size:
            last = frontier.select(F.col("node").alias("dst"))
            step = same.join(last.hint("shuffle_hash") if size > WIDE_LAYER else last, "dst").select(F.col("src").alias("node"), "c").distinct()
            frontier = _better(step, reached, total, f"{tag}-r")
            size = frontier.count()
            total += size
            if size:
                reached = _with_round(reached, frontier, f"{tag}-r")
        done = _union(reached, same)
        found.append(done.select("node", F.col("c").alias("scc")))
        left = materialize(same.select("src", "dst").join(done.select(F.col("node").alias("dst")), "dst", "left_anti")
                           .join(done.select(F.col("node").alias("src")), "src", "left_anti"), f"{tag}-e")
        e = _dealt(left.join(left.select(F.col("dst").alias("src")), "src", "left_semi")
                   .join(left.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"), "src", f"{tag}-e")
    return _union(found, e.select(F.col("src").alias("node"), F.col("src").alias("scc")))


def cycle_core(nodes: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) on or between cycles, of distinct nodes and edges among them without self-calls, both written.

    Nodes without a level forward lie on or above a cycle, without one backward
    too on or between cycles. The side on which more nodes end goes first, so that the other one's rounds read less.
    """
    def among(edges: DataFrame, kept: DataFrame) -> DataFrame:
        return (edges.join(kept.select(F.col("node").alias("src")), "src", "left_semi")
                .join(kept.select(F.col("node").alias("dst")), "dst", "left_semi"))

    callers, callees = e.agg(F.approx_count_distinct("src"), F.approx_count_distinct("dst")).first()
    for forward, tag in sorted([(True, "cyc-f"), (False, "cyc-b")], reverse=callers <= callees):
        turned = e if forward else e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        nodes = materialize(_longest_paths(nodes, turned, tag).where("level IS NULL").select("node"), "cyc-a")
        e = materialize(among(e, nodes).select("src", "dst"), "cyc-e")
    return nodes, e


def core_members(e: DataFrame) -> DataFrame:
    """(node, scc, scc_size) of every node on a cycle of more than one, from the edges of :func:`cycle_core`."""
    comps = materialize(_min_label_scc(e, "scc"), "scc-m")
    sizes = comps.groupBy("scc").agg(F.count(F.lit(1)).alias("scc_size")).where("scc_size > 1")
    return comps.join(sizes, "scc").select("node", "scc", F.col("scc_size").cast("bigint"))


def cycle_members(nodes: DataFrame, edges: DataFrame, drop_self: bool = False) -> DataFrame:
    """(node, scc, scc_size) for every node lying on a directed cycle.

    Exact components are computed on what is on or between cycles
    only, which is small unless most of the graph is cyclic. A node
    with a self-call counts as a cycle of one unless ``drop_self``.
    """
    nodes = materialize(nodes.select("node").distinct(), "cyc-n")
    members = core_members(cycle_core(nodes, materialize(internal_edges(nodes, edges, drop_self=True), "cyc-e"))[1])
    if not drop_self:
        selfish = (edges.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("node")).distinct()
                   .join(nodes, "node", "left_semi"))
        singles = (selfish.join(members.select("node"), "node", "left_anti")
                   .select("node", F.col("node").alias("scc"), F.lit(1).cast("bigint").alias("scc_size")))
        members = members.unionByName(singles)
    return members


def crawl(call_edges: DataFrame, roots: DataFrame, max_depth: int | None = 5,
          table_edges: DataFrame | None = None, table_columns: DataFrame | None = None) -> DataFrame:
    """Rows (root, node, node_type, depth) reached from each root.

    Breadth-first by shortest depth, procedures at depth 0..max_depth (None:
    the whole reach),
    tables of every reached procedure at its depth + 1, each table once per
    root at its smallest depth. Unresolved callees count as found and are not
    expanded (they have no out-edges). The original walks depth-first with a
    global visited set, so when the depth limit binds it can cut a node first
    met on a long path; this walk returns the same set whenever the limit
    does not bind and a deterministic superset when it does. Many roots run
    at once, keyed by root.
    """
    e = call_edges.select("src", "dst").distinct()
    e = materialize(e, "crawl-e")
    n = e.count()
    if n > BUCKET_ROWS:  # dealt by caller once, so that a wide frontier moves and the edges do not
        e = bucketed(e, "src", n, "crawl-e")
    frontier = materialize(roots.select("root", F.col("root").alias("node"), F.lit(0).cast("bigint").alias("depth")),
                           "crawl-f")
    parts = [frontier]
    visited = frontier.select("root", "node")
    size = total = frontier.count()
    for d in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        last = F.broadcast(frontier) if size <= FEW_ROWS else frontier.hint("shuffle_hash")
        nxt = (last.join(e, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
               .join(F.broadcast(visited) if total <= FEW_ROWS else visited, ["root", "node"], "left_anti")
               .withColumn("depth", F.lit(d).cast("bigint")))
        nxt = materialize(nxt, "crawl-f")
        size = nxt.count()
        if not size:
            break
        total += size
        parts.append(nxt)
        visited = visited.unionByName(nxt.select("root", "node"))
        frontier = nxt
    procs = _union(parts, frontier).withColumn("node_type", F.lit("procedure"))
    out = procs.select("root", "node", "node_type", "depth")
    if table_edges is not None:
        t = table_edges.select(F.col("src").alias("node"), F.col("dst").alias("table")).distinct()
        tabs = (procs.join(t, "node").groupBy("root", "table").agg((F.min("depth") + 1).alias("depth"))
                .select("root", F.col("table").alias("node"), F.lit("table").alias("node_type"),
                        F.col("depth").cast("bigint")))
        if table_columns is not None:
            # Column count of each reached table from its metadata, 0 when unknown
            n = table_columns.groupBy(F.col("table").alias("node")).agg(F.count(F.lit(1)).cast("bigint").alias("columns"))
            tabs = tabs.join(n, "node", "left").withColumn("columns", F.coalesce("columns", F.lit(0)).cast("bigint"))
            out = out.withColumn("columns", F.lit(None).cast("bigint"))
        out = out.unionByName(tabs)
    return out


def crawl_summary(crawled: DataFrame) -> DataFrame:
    """Per root, procedures and tables found and the true maximum depth."""
    return crawled.groupBy("root").agg(
        F.count(F.when(F.col("node_type") == "procedure", 1)).cast("bigint").alias("procedures_found"),
        F.count(F.when(F.col("node_type") == "table", 1)).cast("bigint").alias("tables_found"),
        F.max(F.when(F.col("node_type") == "procedure", F.col("depth"))).cast("bigint").alias("depth_reached"))


def impact(call_edges: DataFrame, table_edges: DataFrame, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """Per procedure, callers, dependencies (crawl incl. itself),
    affected tables and ``total_impact_score = callers + dependencies``,
    with the impact class of P36 on the dependency count."""
    from procweave.functions.scoring import impact_class

    c = crawl(call_edges, roots, max_depth, table_edges)
    summ = crawl_summary(c)
    callers = (call_edges.select("src", "dst").distinct().join(roots.select(F.col("root").alias("dst")), "dst", "left_semi")
               .groupBy(F.col("dst").alias("root")).agg(F.count(F.lit(1)).alias("caller_count")))
    out = (roots.select("root").join(summ, "root", "left").join(callers, "root", "left")
           .select("root",
                   F.coalesce("caller_count", F.lit(0)).cast("bigint").alias("caller_count"),
                   F.coalesce("procedures_found", F.lit(0)).cast("bigint").alias("dependency_count"),
                   F.coalesce("tables_found", F.lit(0)).cast("bigint").alias("affected_table_count")))
    return (out.withColumn("total_impact_score", F.col("caller_count") + F.col("dependency_count"))
               .withColumn("impact_class", impact_class("dependency_count")))
