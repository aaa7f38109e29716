"""Bucketed store, vector index, upkeep, pooled embeddings, file trees, keyed stream state."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from procweave.operators import vector as V
from procweave.operators import vector_index as VI
from procweave.sinks import file_tree as FT
from procweave.sinks.bucket_store import BucketStore, CommitConflict
from procweave.streaming import keyed_graph as KG


def files(folder):
    return {os.path.relpath(os.path.join(d, f), folder): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc")}


# ------------------------------------------------------------------ bucketed store

def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), "k", 8)
    with pytest.raises(FileNotFoundError):
        store.read()
    store.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    before, held = files(tmp_path / "data"), store.manifest()["files"]
    store.upsert(spark.createDataFrame([(3, "b"), (999, "c")], "k long, v string"), spark.createDataFrame([(3,), (7,)], "k long").where("k = 7"))
    after = store.manifest()["files"]
    changed = {b for b in after if after[b] != held.get(b)}
    assert 1 <= len(changed) <= 3
    assert all(files(tmp_path / "data")[f] == t for f, t in before.items())  # nothing is written over
    want = {(i, "a") for i in range(200) if i not in (3, 7)} | {(3, "b"), (999, "c")}
    assert {tuple(r) for r in store.read().collect()} == want and store.read().count() == len(want)
    gone = store.vacuum()
    assert len(gone) == 0 or store.read().count() == len(want)


def test_failed_run_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = BucketStore(spark, str(tmp_path), "k", 4)
    store.upsert(spark.createDataFrame([(1, "a"), (2, "a")], "k long, v string"), marks={"m": "1"})
    monkeypatch.setattr(store, "_commit", lambda manifest: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.upsert(spark.createDataFrame([(1, "b")], "k long, v string"), marks={"m": "2"})
    fresh = BucketStore(spark, str(tmp_path), "k")
    assert {tuple(r) for r in fresh.read().collect()} == {(1, "a"), (2, "a")} and fresh.marks() == {"m": "1"}
    assert len(fresh.vacuum()) == 1 and fresh.read().count() == 2


def test_of_two_writers_one_is_told(spark, tmp_path):
    one, two = BucketStore(spark, str(tmp_path), "k", 4), BucketStore(spark, str(tmp_path), "k", 4)
    one.upsert(spark.createDataFrame([(1, "a")], "k long, v string"))
    seen = two.manifest()
    one.upsert(spark.createDataFrame([(2, "a")], "k long, v string"))
    with pytest.raises(CommitConflict):
        two._commit(seen | {"number": seen["number"] + 1})
    assert two.read().count() == 2


def test_store_takes_new_columns_and_empties(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), "k", 4)
    store.upsert(spark.createDataFrame([], "k string, v int"))
    assert store.read().count() == 0
    store.upsert(spark.createDataFrame([("a", 1), (None, 2)], "k string, v int"))
    store.upsert(spark.createDataFrame([("b", 3, "x")], "k string, v int, w string"), spark.createDataFrame([("a",)], "k string"))
    assert {tuple(r) for r in store.read().collect()} == {(None, 2, None), ("b", 3, "x")}


# ------------------------------------------------------------------ vector index

def vectors(spark, n, dim=8, seed=1, clusters=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, dim))
    data = centre[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, dim))
    data[: n // 3] = data[0]  # a third of the rows are copies
    return data, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, embedding array<double>").repartition(5)


def brute_top(data, queries, k):
    out = {}
    for q in queries:
        d = ((data - data[q]) ** 2).sum(axis=1)
        out[q] = sorted(range(len(data)), key=lambda i: (round(d[i], 12), i))[:k]
    return out


@pytest.mark.parametrize(("cells", "rows", "asked"), [(None, 20_000, 2_000), (9, 50, 3), (1, 20_000, 2_000)])
def test_indexed_search_is_exact(spark, monkeypatch, cells, rows, asked):
    monkeypatch.setattr(VI, "BLOCK_ROWS", rows)
    monkeypatch.setattr(VI, "BLOCK_QUERIES", asked)
    data, frame = vectors(spark, 600)
    queries = frame.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = VI.CellIndex.build(frame, cells=cells)
    assert index.sizes.sum() == 600
    got = {}
    for r in index.search(queries, 7, probes=1, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == brute_top(data, range(0, 600, 50), 7)


def test_recall_of_nearest_cells(spark):
    _, frame = vectors(spark, 1500, clusters=30)
    queries = frame.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = VI.CellIndex.build(frame)
    row = VI.recall(index.search(queries, 5), index.search(queries, 5, exact=True)).first()
    assert row.queries == 75 and row.neighbours == 375 and row.recall >= 0.9


def test_recall_on_the_tables(spark):
    from procweave.plans.queries import QUERIES
    assert QUERIES["semantic_index_recall"](spark, "/root/testdata/sf0.1").first().recall_reached


def test_index_is_stored_and_opened(spark, tmp_path):
    data, frame = vectors(spark, 200)
    VI.CellIndex.build(frame, path=str(tmp_path))
    again = VI.CellIndex.open(spark, str(tmp_path))
    one = spark.createDataFrame([("q", data[5].tolist())], "query_id string, embedding array<double>")
    got = [r.id for r in again.search(one, 3, exact=True).orderBy("rank").collect()]
    assert got == brute_top(data, [5], 3)[5]


def test_index_of_an_empty_table(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    one = spark.createDataFrame([(1, [0.0])], "query_id long, embedding array<double>")
    assert VI.CellIndex.build(none).search(one, 3, exact=True).count() == 0


def test_second_sync_embeds_nothing(spark, tmp_path):
    embedded = []

    def embed(frame):
        embedded.append(frame.count())
        return V.embed_hashing(frame, dim=8)

    docs = spark.createDataFrame([("a", "procedure", "one two"), ("b", "table", "three"), ("c", "table", None)], "node_id string, node_type string, text string")
    store = BucketStore(spark, str(tmp_path), "node_id", 4)
    assert {tuple(r) for r in VI.sync_index(docs, store, embed, "2024-01-01").collect()} == {("new", "procedure", 1), ("new", "table", 2)}
    number = store.manifest()["number"]
    assert VI.sync_index(docs, store, embed, "2024-01-01").count() == 0  # the mark is not older
    assert VI.sync_index(docs, store, embed).where("action <> 'unchanged'").count() == 0
    assert embedded == [3] and store.manifest()["number"] == number
    before = files(tmp_path / "data")
    new = docs.where("node_id <> 'b'").withColumn("text", F.when(F.col("node_id") == "a", "one changed").otherwise(F.col("text")))
    done = {tuple(r) for r in VI.sync_index(new, store, embed, "2024-01-03").collect()}
    assert done == {("changed", "procedure", 1), ("deleted", "table", 1), ("unchanged", "table", 1)}
    assert embedded == [3, 1] and store.marks()["last_indexed"] == "2024-01-03"
    assert {(r.node_id, r.text) for r in store.read().collect()} == {("a", "one changed"), ("c", None)}
    assert all(files(tmp_path / "data")[f] == t for f, t in before.items())


def test_pooled_vectors_equal_one_mean_over_all_tokens(spark):
    rng = random.Random(4)
    texts = [(1, " ".join(f"t{rng.randrange(50)}" for _ in range(1300))), (2, "one"), (3, ""), (4, None), (5, "a b " * 256), (6, "x " * 513)]
    frame = spark.createDataFrame(texts, "id long, text string")
    got = {r.id: np.array(r.embedding) for r in VI.embed_long(frame, lambda w: V.embed_with(w, VI.token_hash_encoder(16), dim=16), size=512).collect()}
    windows = {r.id: r.n for r in VI.text_windows(frame, size=512).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert windows == {1: 3, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2}
    for i, text in texts:
        whole = VI.token_hash_encoder(16)([text or ""])[0]
        length = np.linalg.norm(whole)
        assert np.allclose(got[i], whole / length if length else whole, atol=1e-6), i


# ------------------------------------------------------------------ file tree

def test_a_file_per_object(spark, tmp_path):
    rows = [("APP", "tables", "T1", "CREATE TABLE T1"), ("APP", "procedures", "P/1", "é"), ("HR", "functions", "F", ""), ("HR", "other", "X", "x"), ("HR", "views", "V", None)]
    frame = spark.createDataFrame(rows, "schema string, obj_type string, name string, ddl string").repartition(3)
    FT.write_files(FT.export_files(frame), str(tmp_path / "out"))
    FT.write_files(FT.export_files(frame.where("name = 'T1'").withColumn("ddl", F.lit("CREATE TABLE T1 (B)"))), str(tmp_path / "out"))
    found = {os.path.relpath(os.path.join(d, f), tmp_path / "out"): open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(tmp_path / "out") for f in names}
    assert found == {"APP/tables/T1.sql": "CREATE TABLE T1 (B)", "APP/procedures/P_1.prc": "é", "HR/functions/F.fnc": ""}


def test_failed_export_leaves_the_tree(spark, tmp_path):
    out = str(tmp_path / "out")
    FT.write_files(spark.createDataFrame([("a.sql", "1")], "path string, content string"), out)
    bad = spark.createDataFrame([("b.sql", "2"), ("../c.sql", "3")], "path string, content string").repartition(2)
    with pytest.raises(Exception, match="leads out of"):
        FT.write_files(bad, out)
    assert os.listdir(out) == ["a.sql"] and not (tmp_path / "c.sql").exists()


def test_another_attempt_leaves_no_double(tmp_path):
    """Two attempts of one task stage the same row; Spark reports one of them."""
    writer = FT.FileTreeWriter(str(tmp_path), ["path", "content"])
    writer.write(iter([("x/a.sql", "lost attempt"), ("x/only_lost.sql", "y")]))
    writer.commit([writer.write(iter([("x/a.sql", "1")])), None])
    assert [(d, f) for d, _, names in os.walk(tmp_path) for f in names] == [(str(tmp_path / "x"), "a.sql")]
    assert (tmp_path / "x" / "a.sql").read_text() == "1"


# ------------------------------------------------------------------ keyed stream state

def test_stream_emits_changes_only(spark, tmp_path):
    drop, out, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "check")
    drop.mkdir()
    clock = time.time() - 10_000

    def put(folder, name, text, at):
        (drop / folder).mkdir(exist_ok=True)
        path = drop / folder / f"{name}.prc"
        path.write_text(text)
        os.utime(path, (clock + at, clock + at))

    def run():
        KG.start(KG.file_versions(spark, str(drop)), out, check).awaitTermination()
        log = spark.read.parquet(out)
        last = log.agg(F.max("batch_id")).first()[0]
        return ({(r.id.split(".")[-1], r.dst, r.edge_type, r.change) for r in log.where(F.col("batch_id") == last).collect() if r.edge_type != "node"},
                {(r.id.split(".")[-1], r.dst.split(".")[-1], r.edge_type) for r in KG.current(log).collect()})

    def body(name, *calls):
        return f"CREATE PROCEDURE {name} AS BEGIN\n" + "".join(f" EXEC {c};\n" for c in calls) + "END;"

    put("1", "a", body("A", "B", "C"), 100)
    put("1", "b", body("B"), 100)
    changed, now = run()
    assert {("A", "B", "calls", "added"), ("A", "C", "calls", "added")} <= changed
    assert {("A", "A", "node"), ("B", "B", "node"), ("A", "B", "calls"), ("A", "C", "calls")} <= now
    # a newer version, an older one of another file, and a replay
    put("2", "a", body("A", "C", "D"), 200)
    put("2", "b", body("B", "OLD"), 50)
    changed, now = run()
    assert {c for c in changed if c[0] == "A"} == {("A", "B", "calls", "removed"), ("A", "D", "calls", "added")} and not {c for c in changed if c[0] == "B"}
    assert not {n for n in now if "OLD" in n}
    size = spark.read.parquet(out).count()
    put("3", "a", body("A", "C", "D"), 200)
    run()
    assert spark.read.parquet(out).count() == size
    # deletion, then an older version too late, then a new one
    put("4", "a", "  \n", 300)
    _, now = run()
    assert not {n for n in now if n[0] == "A"} and ("B", "B", "node") in now
    put("5", "a", body("A", "LATE"), 250)
    _, now = run()
    assert not {n for n in now if n[0] == "A"}
    put("6", "a", body("A", "E"), 400)
    _, now = run()
    assert {n for n in now if n[0] == "A" and n[2] != "accesses"} == {("A", "A", "node"), ("A", "E", "calls")}
