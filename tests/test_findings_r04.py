"""Findings of round 4: whole lists, and the same rows with less work at size."""

import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from procweave.functions import constants as K
from procweave.functions import extract as X
from procweave.functions.scoring import code_complexity, counted_complexity
from procweave.operators import analysis as A
from procweave.operators import cycles as CY
from procweave.operators import lineage as LN
from procweave.operators import reach as RE
from procweave.operators import traversal as TR


def orders_at(spark, folder, keys, status="O"):
    rows = [(k, k, status if isinstance(status, str) else status(k), 1.0, "1-URGENT") for k in keys]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_hierarchy_lists_every_name_of_a_level(spark, tmp_path):
    """F8: of a level's list only the count and the first and last name were given."""
    got = E.queries()["hierarchy"](spark, orders_at(spark, tmp_path, [0, 1, 2, 3, 4, 5, 6, 7, 90])).collect()
    lists = {0: ["P0", "P90"], 1: ["P1"], 2: ["P2", "P3"], 3: ["P4", "P5", "P6", "P7"]}
    assert sorted((r.level, r.position, r.proc) for r in got) == [(n, i, p) for n, names in lists.items() for i, p in enumerate(names, 1)]
    assert all((r.n_procedures, r.first_name, r.last_name) == (len(lists[r.level]), lists[r.level][0], lists[r.level][-1]) for r in got)


# ------------------------------------------------------------------ extraction and field flow

def test_keywords_are_counted_in_capitals(spark):
    """seven patterns that ignore case went over every place of a text."""
    rng = random.Random(4)
    words = ["if", " IF ", "ıf", "Loop", "\nloop ", "FOR", "for ", "while", "case ", "CURSOR", "curſor", "exception;", "END IF", "é", "_", "1", " ", " ", "\n", "ﬁ"]
    texts = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(300)]
    frame = spark.createDataFrame(texts, "i int, code string")
    found = frame.select("i", X.control_counts("code").alias("n"), X.line_count("code").alias("lines"), counted_complexity("code").alias("score"), code_complexity("code").alias("plain"),
                         *[F.regexp_count("code", F.lit(rf"(?i)\b{k}\b")).alias(f"_{k.lower()}") for k in K.CONTROL_KINDS])
    for row in found.collect():
        assert all(row.n[k.lower()] == row[f"_{k.lower()}"] for k in K.CONTROL_KINDS), texts[row.i]
        assert row.score == row.plain and row.lines == texts[row.i][1].count("\n") + 1, texts[row.i]
    none = spark.sql("SELECT CAST(NULL AS STRING) AS code").select(X.control_counts("code").alias("n"), X.line_count("code").alias("lines"), counted_complexity("code").alias("score")).first()
    assert none.n["if"] is None and none.n["loop"] is None and none.lines is None and none.score == K.COMPLEXITY_MAX_SCORE
    procs = frame.select(F.col("i").cast("string").alias("name"), F.col("code").alias("source_code"))
    plan = A.analyze(procs).select("control", "complexity_score", "lines")._jdf.queryExecution().optimizedPlan().toString()
    assert "(?i)" not in plan


def test_field_flow_reads_the_usage_once(spark, tmp_path):
    """the usage rows were taken from the texts four times."""
    rows = [("A", "p1", "write"), ("A", "p1", "write"), ("A", "p2", "read"), ("A", "p1", "read"), ("B", "p3", "transform"), (None, "p3", "write"), ("C", None, "read")]
    spark.createDataFrame(rows, "field string, proc string, operation string").write.parquet(f"{tmp_path}/usage")
    usage = spark.read.parquet(f"{tmp_path}/usage")
    columns = spark.createDataFrame([("s", "t", "a"), ("s", "t", "A"), ("s", "u", "A"), ("s", "u", "z"), (None, "u", "b")], "table_schema string, table_name string, column_name string")
    got = LN.flow(usage, columns)
    assert {tuple(r) for r in got.collect()} == {("A", 3, 2), ("B", 1, 0), (None, 0, 0), ("C", 0, 1)}
    assert {tuple(r) for r in LN.flow(usage).collect()} == {("A", 1, 2), ("B", 0, 0), (None, 0, 0), ("C", 0, 1)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


# ------------------------------------------------------------------ whole reach

def frames(spark, calls, tables=()):
    names = sorted({n for c in calls for n in c})
    return (names, spark.createDataFrame([(n, 1) for n in names], "node string, complexity_score long"), spark.createDataFrame(sorted(calls), "src string, dst string"),
            spark.createDataFrame(sorted(tables), "src string, dst string"))


def reach_of(calls):
    after = {}
    for a, b in calls:
        after.setdefault(a, set()).add(b)
    out = {}
    for root in {n for c in calls for n in c}:
        depth, last, d = {root: 0}, {root}, 0
        while last:
            d, last = d + 1, {b for a in last for b in after.get(a, ())} - set(depth)
            depth |= dict.fromkeys(last, d)
        out[root] = depth
    return out


def test_whole_reach_is_kept_in_few_words(spark, monkeypatch):
    """a word was kept for nearly every node reached, and what nodes without a caller reach was written too."""
    calls = {(f"p{n:03d}", f"p{n // d:03d}") for n in range(1, 500) for d in (2, 3) if d == 2 or n % 3 == 0} | {("p011", "p022"), ("p003", "p499")}
    names, nodes, c, t = frames(spark, calls, {(f"p{n:03d}", f"t{n % 7}") for n in range(0, 500, 3)})
    want = reach_of(calls)
    kept, settle = [], RE.settle

    def counted(*args):
        kept.append(settle(*args))
        return kept[-1]

    monkeypatch.setattr(RE, "settle", counted)
    got = {r.node: (r.procedures_found, r.depth_reached) for r in RE.reach_counts(nodes, c, t).collect()}
    assert got == {n: (len(want[n]), max(want[n].values())) for n in names}
    impact = {r.root: r.dependency_count for r in RE.impact_all(nodes, c, t, None, CY.components(nodes, c)).collect()}
    assert impact == {n: len(want[n]) for n in names}
    words = kept[1].where("word >= 0")
    assert words.count() < sum(map(len, want.values())) / 3
    files = [f for f in kept[1].inputFiles() if "/impact-r-" in f]
    stored = {r.node for r in spark.read.parquet(*files).select("node").distinct().collect()}
    assert 0 < len(stored) < kept[1].select("node").distinct().count() * 2 / 3


def test_few_edges_are_walked_in_one_task(spark, monkeypatch):
    """components of few edges took as many rounds as their longest way."""
    ring = [f"r{i}" for i in range(9)]
    calls = {*zip(ring, [*ring[1:], ring[0]]), ("r3", "a"), ("a", "b"), ("b", "a"), ("b", "c")}
    _, nodes, c, _ = frames(spark, calls)
    monkeypatch.setattr(TR, "_better", None)  # a round of colours
    assert {r.node: r.scc for r in TR.cycle_members(nodes, c).collect()} == {**dict.fromkeys(ring, "r0"), "a": "a", "b": "a"}


def test_transformed_fields_are_found_in_capitals(spark):
    """seven patterns that ignore case went over every place of a text."""
    rng = random.Random(7)
    words = ["upper(", "Lower (", "TRIM( ", "subſtr(", "SUBSTR(", "concat\n(", "Replace(", "cast(", "a", "Field_1", "ı", "é", "1", ")", " ", ",", "x.y", "("]
    texts = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(300)]
    frame = spark.createDataFrame(texts, "i int, code string")
    for row in frame.select("i", X.transformations("code").alias("found")).collect():
        want = [(m.upper(), f"{fn}({m.upper()})") for fn in K.TRANSFORM_FUNCS for m in re.findall(K.TRANSFORM_PATTERN.format(func=fn), texts[row.i][1], re.ASCII)]
        assert [tuple(f) for f in row.found] == want, texts[row.i]
    plan = frame.select(X.transformations("code"))._jdf.queryExecution().optimizedPlan().toString()
    assert "(?i)" not in plan
    assert spark.sql("SELECT CAST(NULL AS STRING) AS code").select(X.transformations("code").alias("found")).first()["found"] is None
