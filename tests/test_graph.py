"""Graph shapes (cycle, chain, diamond, wide, orphan), levels, crawl, cycles, resolution."""

import pytest
from pyspark.sql import functions as F

from procweave.operators import graph as G
from procweave.operators import traversal as TR


def edges_df(spark, pairs):
    return spark.createDataFrame(pairs or [("_", "_")], "src string, dst string").filter(F.col("src") != "_")


def nodes_df(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def crawl_count(spark, pairs, root, depth=25):
    c = TR.crawl(edges_df(spark, pairs), spark.createDataFrame([(root,)], "root string"), depth)
    return c.filter("node_type = 'procedure'").count(), c.agg(F.max("depth")).first()[0]


SHAPES = {
    "cycle2": ([("A", "B"), ("B", "A")], "A", 2),
    "cycle3": ([("A", "B"), ("B", "C"), ("C", "A")], "A", 3),
    "diamond": ([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")], "A", 4),
    "wide": ([("MAIN", f"SUB_{i}") for i in range(20)], "MAIN", 21),
    "orphan": ([], "ALONE", 1),
}


@pytest.mark.parametrize("shape", list(SHAPES))
def test_crawl_shapes(spark, shape):
    pairs, root, expected = SHAPES[shape]
    assert crawl_count(spark, pairs, root)[0] == expected


def test_chain_true_depth_and_limit(spark):
    chain = [(f"P{i}", f"P{i + 1}") for i in range(20)]
    n, depth = crawl_count(spark, chain, "P0", 25)
    assert (n, depth) == (21, 20)
    short = [(f"P{i}", f"P{i + 1}") for i in range(14)]
    assert crawl_count(spark, short, "P0", 5) == (6, 5)


def test_crawl_monotone_in_depth(spark):
    pairs = [("A", "B"), ("B", "C"), ("A", "C"), ("C", "D"), ("D", "E")]
    sizes = [crawl_count(spark, pairs, "A", d)[0] for d in range(0, 5)]
    assert sizes == sorted(sizes) and sizes[-1] == 5


def test_levels_chain_and_diamond(spark):
    chain = [(f"P{i}", f"P{i + 1}") for i in range(20)]
    lv = TR.dependency_levels(nodes_df(spark, [f"P{i}" for i in range(21)]), edges_df(spark, chain))
    got = {r["node"]: r["level"] for r in lv.collect()}
    assert got["P0"] == 20 and got["P20"] == 0
    dia = TR.dependency_levels(nodes_df(spark, "ABCD"), edges_df(spark, SHAPES["diamond"][0]))
    assert {r["node"]: r["level"] for r in dia.collect()} == {"A": 2, "B": 1, "C": 1, "D": 0}


def test_levels_invariant_and_external_callees(spark):
    pairs = [("A", "B"), ("B", "C"), ("A", "X_EXTERNAL"), ("C", "C")]
    lv = TR.dependency_levels(nodes_df(spark, "ABC"), edges_df(spark, pairs))
    got = {r["node"]: r["level"] for r in lv.collect()}
    assert got == {"A": 2, "B": 1, "C": 0}   # self-call dropped, external ignored
    for s, d in [("A", "B"), ("B", "C")]:
        assert got[s] > got[d]


def test_levels_with_cycle(spark):
    pairs = [("A", "B"), ("B", "A"), ("C", "A"), ("D", "E")]
    lv = {r["node"]: (r["level"], r["in_cycle"]) for r in
          TR.dependency_levels(nodes_df(spark, "ABCDE"), edges_df(spark, pairs)).collect()}
    assert lv["E"] == (0, False) and lv["D"] == (1, False)
    assert lv["A"][1] and lv["B"][1] and lv["C"][1]
    compat = TR.dependency_levels(nodes_df(spark, "ABCDE"), edges_df(spark, pairs), compat=True)
    assert {r["level"] for r in compat.collect()} == {0}


def test_cycle_members_exact(spark):
    # two cycles joined by a bridge node X that is on no cycle
    pairs = [("A", "B"), ("B", "A"), ("B", "X"), ("X", "C"), ("C", "D"), ("D", "C"), ("S", "A"), ("D", "Z")]
    m = {r["node"]: r["scc_size"] for r in TR.cycle_members(nodes_df(spark, "ABCDXSZ"), edges_df(spark, pairs)).collect()}
    assert m == {"A": 2, "B": 2, "C": 2, "D": 2}


def test_resolve_names_priority(spark):
    nodes = spark.createDataFrame(
        [("S1.P", "procedure", "S1", "P"), ("A.P", "procedure", "A", "P"), ("P", "procedure", "UNKNOWN", "P2"),
         ("S1.T", "table", "S1", "T")], "id string, node_type string, schema string, name string")
    names = spark.createDataFrame([("P",), ("S1.P",), ("Q",), ("T",)], "name string")
    got = {r["name"]: r["resolved_id"] for r in G.resolve_names(names, nodes, "procedure").collect()}
    assert got == {"P": "P", "S1.P": "S1.P"}   # exact id wins; tables not candidates
    names2 = spark.createDataFrame([("P2",)], "name string")
    assert G.resolve_names(names2, nodes).first()["resolved_id"] == "P"


def test_degrees_sum_invariant(spark):
    pairs = [("A", "B"), ("A", "B"), ("B", "C"), ("C", "A")]
    nodes = spark.createDataFrame([(n,) for n in "ABCD"], "id string")
    d = G.degrees(nodes, edges_df(spark, pairs))
    s = d.agg(F.sum("in_degree"), F.sum("out_degree")).first()
    assert s[0] == s[1] == 3
    assert [r["id"] for r in G.isolated(d).collect()] == ["D"]


def test_layers_are_taken_off_before_anything_is_contracted(spark, monkeypatch):
    """A wide graph of few layers, a cycle above it and a node without a name need no contraction."""
    def refuse(*_):
        raise AssertionError("contracted")

    monkeypatch.setattr(TR, "_contracted", refuse)
    pairs = [(f"P{i}", f"P{i // k}") for i in range(1, 40) for k in (2, 3)] + [("X", "Y"), ("Y", "X"), ("Z", "X"), ("Y", "P1")]
    nodes = nodes_df(spark, [f"P{i}" for i in range(40)] + ["X", "Y", "Z", None])
    got = [(r["node"], r["level"]) for r in TR.dependency_levels(nodes, edges_df(spark, pairs)).collect()]
    want = {f"P{i}": i.bit_length() for i in range(40)} | {"X": None, "Y": None, "Z": None, None: 0}
    assert len(got) == len(want) and dict(got) == want


def test_layers_and_contraction_meet(spark, monkeypatch):
    """What the last layer leaves keeps the levels it has learnt."""
    monkeypatch.setattr(TR, "LAYERS", 2)
    pairs = [(f"P{i}", f"P{i - 1}") for i in range(1, 9)] + [("P8", "P1"), ("Q", "P2"), ("Q", "P7"), ("R", "P1")]
    got = {r["node"]: r["level"] for r in TR.dependency_levels(nodes_df(spark, [f"P{i}" for i in range(9)] + ["Q", "R"]), edges_df(spark, pairs)).collect()}
    assert got == {f"P{i}": i for i in range(9)} | {"Q": 8, "R": 2}
