"""Reach counts, dependency trees, cycle listing, condensed levels, contraction."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from procweave.operators import cycles as CY
from procweave.operators import reach as RE
from procweave.operators import traversal as TR


def nodes_df(spark, names, complexity=None):
    return spark.createDataFrame([(n, (complexity or {}).get(n, 1)) for n in names], "node string, complexity_score long")


def edges_df(spark, pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def random_graph(seed, size=14, edges=24):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(size)]
    calls = {(rng.choice(names), rng.choice([*names, "ext1", "ext2"])) for _ in range(edges)}
    tables = {(rng.choice(names), f"t{rng.randrange(70)}") for _ in range(edges)}
    return names, calls, tables


def brute_depths(root, calls, limit=None):
    depth, frontier = {root: 0}, [root]
    for d in itertools.count(1) if limit is None else range(1, limit + 1):
        frontier = sorted({b for a, b in calls if a in frontier and b not in depth})
        if not frontier:
            break
        depth |= {n: d for n in frontier}
    return depth


@pytest.mark.parametrize("limit", [None, 0, 2])
def test_reach_counts_match_brute_force(spark, limit):
    names, calls, tables = random_graph(3, 90, 150)
    got = {r.node: (r.procedures_found, r.tables_found, r.depth_reached)
           for r in RE.reach_counts(nodes_df(spark, names), edges_df(spark, calls), edges_df(spark, tables), limit).collect()}
    for n in names:
        depth = brute_depths(n, calls, limit)
        assert got[n] == (len(depth), len({t for p, t in tables if p in depth}), max(depth.values())), n


def test_condensed_reach_and_impact(spark):
    names, calls, tables = random_graph(5, 40, 70)
    nodes, c, t = nodes_df(spark, names), edges_df(spark, calls), edges_df(spark, tables)
    got = {r.root: r for r in RE.impact_all(nodes, c, t, None, CY.components(nodes, c)).collect()}
    assert any(n for n, m in itertools.combinations(names, 2) if m in brute_depths(n, calls) and n in brute_depths(m, calls))
    for n in names:
        depth = brute_depths(n, calls)
        callers = len({a for a, b in calls if b == n})
        assert (got[n].caller_count, got[n].dependency_count, got[n].affected_table_count, got[n].total_impact_score) == (
            callers, len(depth), len({x for p, x in tables if p in depth}), callers + len(depth))


def test_whole_reach_puts_a_node_together_once(spark, monkeypatch):
    """no round rewrites what all nodes reach; components too large to be taken apart give the same."""
    monkeypatch.setattr(RE, "propagate", None)
    monkeypatch.setattr(RE, "SMALL", 2)
    ring = [f"r{i}" for i in range(5)]
    calls = {("top", "r0"), ("top", "x"), ("x", "y"), ("y", "x"), ("y", "out"), ("r3", "low"), ("low", "ext"), ("r1", "r1"),
             *zip(ring, [*ring[1:], ring[0]])}
    names = sorted({n for pair in calls for n in pair} - {"ext"})
    tables = {("low", "t1"), ("r4", "t2"), ("x", "t1"), ("y", "t3")}
    nodes, c, t = nodes_df(spark, names), edges_df(spark, calls), edges_df(spark, tables)
    got = {r.node: (r.procedures_found, r.tables_found, r.depth_reached) for r in RE.reach_counts(nodes, c, t).collect()}
    impact = {r.root: (r.dependency_count, r.affected_table_count) for r in RE.impact_all(nodes, c, t, None, CY.components(nodes, c)).collect()}
    for n in names:
        depth = brute_depths(n, calls)
        want = (len(depth), len({x for p, x in tables if p in depth}))
        assert (got[n], impact[n]) == ((*want, max(depth.values())), want), n


def test_reach_of_empty_graphs(spark):
    none = edges_df(spark, [])
    assert RE.reach_counts(nodes_df(spark, []), none, none).count() == 0
    one = RE.reach_counts(nodes_df(spark, ["a"]), none, none).collect()
    assert [(r.procedures_found, r.tables_found, r.depth_reached) for r in one] == [(1, 0, 0)]


def test_numbers_are_dense_and_in_order(spark):
    frame = spark.range(1000).select(F.concat(F.lit("x"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("name")).repartition(7)
    got = RE.numbered(frame.orderBy("name"), "t").orderBy("number").collect()
    assert [(r.name, r.number) for r in got] == [(f"x{i:05d}", i) for i in range(1000)]


def brute_tree(root, nodes, calls, tables, limit, columns):
    """The rows by breadth-first search with first paths."""
    order = {n: sorted({b for a, b in calls if a == n}) for n in {a for a, _ in calls} | set(nodes)}
    uses = {n: sorted({b for a, b in tables if a == n}) for n in nodes}
    place, frontier = {root: ()}, [root]
    for _ in range(limit):
        found = {}
        for n in frontier:
            for i, m in enumerate(order.get(n, [])):
                if m not in place:
                    found[m] = min(found.get(m, (10 ** 9,) * 99), place[n] + (i,))
        place |= found
        frontier = list(found)
    text = lambda p: "/".join(map(str, p))
    rows = {(text(place[root]), None, 0, "procedure", root, 0, root in nodes, False, None if root in nodes else RE.NOT_FOUND, nodes.get(root), None)}
    seen_tables = {}
    for n in sorted((n for n in place if n in nodes), key=lambda n: (len(place[n]), place[n])):
        above, depth = place[n], len(place[n]) + 1
        for i, m in enumerate(order.get(n, [])):
            first = place.get(m) == above + (i,)
            rows.add((text(above + (i,)), text(above), i, "procedure", m, depth, first and m in nodes, depth > limit,
                      RE.NOT_FOUND if first and m not in nodes else None, nodes.get(m) if first else None, None))
        for i, t in enumerate(uses[n], len(order.get(n, []))):
            if seen_tables.setdefault(t, n) == n:
                rows.add((text(above + (i,)), text(above), i, "table", t, depth, False, False, None, None, columns.get(t, 0)))
    return rows


@pytest.mark.parametrize("limit", [1, 3, 9])
def test_crawl_tree_matches_brute_force(spark, limit):
    names, calls, tables = random_graph(11, 16, 34)
    score = {n: i for i, n in enumerate(names)}
    columns = {f"t{i}": i % 4 for i in range(0, 70, 2)}
    cols = spark.createDataFrame([(t, k) for t, n in columns.items() for k in range(n)], "table string, k int")
    roots = [names[0], names[5], "ext1"]
    got = RE.crawl_tree(nodes_df(spark, names, score), edges_df(spark, calls), edges_df(spark, tables),
                        spark.createDataFrame([(r,) for r in roots], "root string"), limit, cols)
    by_root = {}
    for r in got.collect():
        by_root.setdefault(r.root, set()).add((r.path, r.parent_path, r.seq, r.node_type, r.name, r.depth, r.expanded, r.truncated, r.error, r.complexity_score, r.columns))
    for root in roots:
        assert by_root[root] == brute_tree(root, score, calls, tables, limit, columns)


def test_nested_tree_of_a_cycle(spark):
    rows = RE.crawl_tree(nodes_df(spark, "AB", {"A": 3, "B": 5}), edges_df(spark, [("A", "B"), ("B", "A"), ("B", "X")]), edges_df(spark, [("B", "T")]),
                         spark.createDataFrame([("A",)], "root string"), 5).collect()
    assert RE.nested_tree([r.asDict() for r in rows]) == {
        "name": "A", "depth": 0, "type": "procedure", "complexity_score": 3, "dependencies": [
            {"name": "B", "depth": 1, "type": "procedure", "complexity_score": 5, "dependencies": [
                {"name": "A", "depth": 2, "type": "procedure", "truncated": False, "dependencies": []},
                {"name": "X", "depth": 2, "type": "procedure", "error": RE.NOT_FOUND, "dependencies": []},
                {"name": "T", "depth": 2, "type": "table", "columns": 0, "dependencies": []}]}]}


def brute_cycles(names, calls, limit):
    out = set()

    def grow(path):
        for a, b in calls:
            if a == path[-1]:
                if b == path[0] and len(path) > 1:
                    out.add(tuple(path))
                elif b in names and b > path[0] and b not in path and len(path) < limit:
                    grow([*path, b])
    for n in names:
        grow([n])
    return out


@pytest.mark.parametrize(("seed", "limit"), [(1, 8), (2, 3)])
def test_cycle_paths_match_brute_force(spark, seed, limit):
    names, calls, _ = random_graph(seed, 9, 22)
    calls |= {("n01", "n01")}
    got = CY.cycle_paths(nodes_df(spark, names), edges_df(spark, calls), limit, drop_self=False).collect()
    want = brute_cycles(names, calls, limit)
    assert {tuple(r.path) for r in got} == want | {(a,) for a, b in calls if a == b} and len(got) == len({tuple(r.path) for r in got})
    assert want and all(r.start == r.path[0] and r.length == len(r.path) for r in got)


def test_cycle_paths_without_cycles(spark):
    assert CY.cycle_paths(nodes_df(spark, "ABC"), edges_df(spark, [("A", "B"), ("B", "C")])).count() == 0
    assert CY.cycle_paths(nodes_df(spark, []), edges_df(spark, [])).count() == 0


def test_condensed_levels(spark):
    pairs = [("A", "B"), ("B", "C"), ("C", "B"), ("C", "D"), ("D", "E"), ("F", "A"), ("E", "X"), ("G", "G"), ("H", "F"), ("H", "D")]
    got = {r.node: (r.level, r.in_cycle, r.component_size) for r in CY.condensed_levels(nodes_df(spark, "ABCDEFGH"), edges_df(spark, pairs)).collect()}
    assert got == {"E": (0, False, 1), "D": (1, False, 1), "B": (2, True, 2), "C": (2, True, 2), "A": (3, False, 1), "F": (4, False, 1),
                   "G": (0, False, 1), "H": (5, False, 1)}


def test_levels_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    rounds = []
    original = TR.materialize
    monkeypatch.setattr(TR, "materialize", lambda frame, tag="": (rounds.append(tag), original(frame, tag))[1])
    name = lambda c: F.concat(F.lit("N"), F.lpad(c.cast("string"), 5, "0"))
    nodes = spark.range(10_000).select(name(F.col("id")).alias("node"))
    edges = spark.range(9_999).select(name(F.col("id")).alias("src"), name(F.col("id") + 1).alias("dst"))
    levels = TR.dependency_levels(nodes, edges)
    wrong = levels.where(F.col("level") + F.substring("node", 2, 5).cast("bigint") != 9_999)
    assert levels.count() == 10_000 and wrong.count() == 0 and levels.where("in_cycle").count() == 0
    assert sum(tag.endswith("-s") for tag in rounds) < 40


@pytest.mark.parametrize("seed", range(3))
def test_levels_by_contraction_match_longest_paths(spark, seed):
    names, calls, _ = random_graph(seed, 25, 32)
    calls = {(a, b) for a, b in calls if a != b and b in names}
    endless = {n for n in names if any(n in brute_depths(m, calls) and m != n or (m, n) in calls and m == n or m in {x for a, x in calls if a == n} and n in brute_depths(m, calls)
                                       for m in names if m in brute_depths(n, calls))}
    above = {n for n in names if set(brute_depths(n, calls)) & endless}

    def level(n):
        return max((level(b) + 1 for a, b in calls if a == n), default=0)

    got = {r.node: (r.level, r.in_cycle) for r in TR.dependency_levels(nodes_df(spark, names), edges_df(spark, calls)).collect()}
    assert got == {n: (None, True) if n in above else (level(n), False) for n in names}


def test_hierarchy_lists_names_by_level(spark):
    levels = TR.dependency_levels(nodes_df(spark, "ABC"), edges_df(spark, [("A", "B"), ("B", "C")]))
    assert [tuple(r) for r in TR.hierarchy(levels).collect()] == [(0, "C"), (1, "B"), (2, "A")]


def members_of(spark, names, calls):
    return {r.node: (r.scc, r.scc_size) for r in TR.cycle_members(nodes_df(spark, names), edges_df(spark, calls), drop_self=True).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_wide_graphs_match_reachability(spark, monkeypatch, seed):
    """edges dealt on disk, wide rounds and rounds put together give the same components."""
    for module, name, value in [(TR, "BUCKET_ROWS", 5), (TR, "WIDE_LAYER", 1), (TR, "FEW_ROWS", 2 * seed), (TR, "ROUND_TABLES", 2)]:
        monkeypatch.setattr(module, name, value)
    monkeypatch.setattr("procweave.session.FEW_ROWS", seed)
    names, calls, _ = random_graph(seed + 20, 40, 56)
    reach = {n: set(brute_depths(n, [c for c in calls if c[1] in names])) for n in names}
    groups = {n: {m for m in reach[n] if n in reach[m]} for n in names}
    want = {n: (min(g), len(g)) for n, g in groups.items() if len(g) > 1}
    assert want and members_of(spark, names, calls) == want


def test_colours_are_written_for_changed_nodes_only(spark, monkeypatch):
    """a round of colours wrote every node on or between cycles, however few had changed."""
    written = []
    original = TR.materialize

    def counted(frame, tag=""):
        out = original(frame, tag)
        if tag == "scc-c":
            written.append(out.count())
        return out

    monkeypatch.setattr(TR, "materialize", counted)
    chain = ["a0", "a1", *(f"b{i:02d}" for i in range(6)), "c0", "c1"]
    pairs = [(f"x{i:03d}", f"y{i:03d}") for i in range(300)]
    calls = [*zip(chain, chain[1:]), ("a1", "a0"), ("c1", "c0"), *pairs, *((b, a) for a, b in pairs)]
    names = {n for c in calls for n in c}
    assert members_of(spark, names, calls) == {n: (min(p), 2) for p in [("a0", "a1"), ("c0", "c1"), *pairs] for n in p}
    assert sum(written) < 3 * len(names)


def test_cycle_paths_count_internal_calls_once(spark, monkeypatch):
    """the calls among the nodes were put together twice, for the listing and for its components."""
    found = []
    original = TR.internal_edges
    for module in (CY, TR):
        monkeypatch.setattr(module, "internal_edges", lambda *a, **k: (found.append(1), original(*a, **k))[1])
    got = CY.cycle_paths(nodes_df(spark, "ABCD"), edges_df(spark, [("A", "B"), ("B", "A"), ("B", "C"), ("C", "C"), ("C", "X")])).collect()
    assert [(r.start, r.path) for r in got] == [("A", ["A", "B"])] and len(found) == 1
