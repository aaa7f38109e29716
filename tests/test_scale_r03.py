"""Operators at size: the same rows with less work (round 3)."""

import random
import re

from pyspark.sql import functions as F

from procweave.functions import constants as K
from procweave.functions import extract as X
from procweave.functions.scoring import code_complexity
from procweave.operators import traversal as TR
from procweave.session import bucketed
from procweave.sinks import file_tree as FT


# ------------------------------------------------------------------ extraction

def test_scores_and_calls_equal_separate_patterns_in_fewer_passes(spark):
    rng = random.Random(3)
    words = ["a", "P1", "1a", "12", "_", ".", "x.y", "(", "(", " ", "\n", "\t", "CALL ", "exec ", "Execute\n", "recall ", "if", " IF ", "Loop", "\nloop ", "CURSOR", "exception;", "END IF", "é", "NULL", "SUM("]
    texts = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(25)))) for i in range(400)]
    frame = spark.createDataFrame(texts, "i int, code string")
    got = frame.select("i", X.called_procedures("code").alias("calls"), code_complexity("code").alias("score")).collect()
    for row in got:
        text = texts[row.i][1]
        names = [m.upper() for p in K.CALL_PATTERNS[:2] for m in re.findall(p, text, re.ASCII)]
        assert row.calls == list(dict.fromkeys(n for n in names if "." in n or n not in K.SQL_BUILTINS)), text
        score = float(1 + min((text.count("\n") + 1) // K.COMPLEXITY_LINES_THRESHOLD, K.COMPLEXITY_LINES_MAX_BONUS))
        for word, weight in (("IF", K.COMPLEXITY_IF_WEIGHT), ("LOOP", K.COMPLEXITY_LOOP_WEIGHT), ("CURSOR", K.COMPLEXITY_CURSOR_WEIGHT), ("EXCEPTION", K.COMPLEXITY_EXCEPTION_WEIGHT)):
            score += len(re.findall(rf"(?i)\b{word}\b", text)) * weight
        assert row.score == min(int(score), K.COMPLEXITY_MAX_SCORE), text
    plan = frame.select(code_complexity("code").alias("score"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_\w+\(", plan)) == 1  # was one pass over the text per keyword


# ------------------------------------------------------------------ levels

def test_wide_layers_meet_edges_where_they_lie(spark, monkeypatch):
    edges = {(f"P{n}", f"P{n // d}") for n in range(1, 200) for d in (2, 3) if d == 2 or n % 4 == 0}
    nodes = spark.createDataFrame([(f"P{n}",) for n in range(200)], "node string")
    level = {"P0": 0}
    for n in range(1, 200):
        level[f"P{n}"] = 1 + max(level[d] for s, d in edges if s == f"P{n}" and d != s)
    frame = spark.createDataFrame(sorted(edges), "src string, dst string")
    monkeypatch.setattr(TR, "WIDE_LAYER", 0)
    assert {r.node: r.level for r in TR.dependency_levels(nodes, frame).collect()} == level
    lying = bucketed(frame, "dst", 200, "test-e")
    joined = lying.join(nodes.withColumnRenamed("node", "dst").hint("shuffle_hash"), "dst")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and joined.count() == len(edges)  # was two: the edges were dealt again in every round


# ------------------------------------------------------------------ file tree

def test_files_are_read_back_by_their_paths(spark, tmp_path):
    rows = [("a/t/X.sql", "é\n"), ("a/t/X.sql", "é\n"), ("b/t/Y.sql", ""), ("b/u/Z.gz", "z")]
    files = spark.createDataFrame(rows, "path string, content string").repartition(3)
    folder = str(tmp_path / "out")
    FT.write_files(files, folder)
    back = FT.read_files(files, folder)
    assert sorted(map(tuple, back.collect())) == sorted(set(rows))
    assert "FileScan" not in back._jdf.queryExecution().executedPlan().toString()  # was a listing of every file on the driver


def test_commit_holds_the_files_of_one_task(tmp_path, monkeypatch):
    writer = FT.FileTreeWriter(str(tmp_path), ["path", "content"])
    messages = [writer.write(iter([(f"k/{task}-{i}.sql", "x") for i in range(5)])) for task in range(4)]
    held = []

    class Pool(FT.ThreadPoolExecutor):
        def map(self, fn, moves):
            held.append(len(moves))
            return super().map(fn, moves)

    monkeypatch.setattr(FT, "ThreadPoolExecutor", Pool)
    writer.commit(messages)
    assert held == [5] * 4 and len(list((tmp_path / "k").iterdir())) == 20  # was one list of all 20
