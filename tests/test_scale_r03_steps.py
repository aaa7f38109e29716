"""Steps mended after FINDINGS_r03: hot names, wide crawls, the keyed graph stream."""

from pyspark.sql import functions as F

from procweave.operators import graph as G
from procweave.operators import traversal as TR
from procweave.streaming import keyed_graph as KG


def test_few_table_names_deal_no_rows(spark):
    """accesses are not sent to the task of their table's name while there are few names."""
    access = spark.createDataFrame([(f"p{i}", "T_CUST" if i % 2 else "T_A") for i in range(40)], "src string, dst string")
    tables = spark.createDataFrame([("app.t_a", "table", "app", "t_a")], "id string, node_type string, schema string, name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = G.resolve_access(access, tables)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert {(r.src, r.dst) for r in got.collect()} == {(f"p{i}", "T_CUST" if i % 2 else "app.t_a") for i in range(40)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_wide_crawl_leaves_the_edges_where_they_are(spark, monkeypatch):
    """edges dealt by caller, and frontiers too large to broadcast, give the same reach."""
    pairs = [(f"n{i}", f"n{i // 2}") for i in range(1, 16)] + [("n3", "n15"), ("n0", "n0")]
    edges, roots = spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("n15",), ("n2",)], "root string")
    plain = {tuple(r) for r in TR.crawl(edges, roots, None).collect()}
    monkeypatch.setattr(TR, "BUCKET_ROWS", 0)
    monkeypatch.setattr(TR, "FEW_ROWS", 0)
    assert {tuple(r) for r in TR.crawl(edges, roots, None).collect()} == plain
    assert {(n, d) for r, n, _, d in plain if r == "n15"} == {("n15", 0), ("n7", 1), ("n3", 2), ("n1", 3), ("n0", 4)}


def test_stream_state_is_joined_and_written_whole_at_times(spark, tmp_path, monkeypatch):
    """the newest version counts over many batches, with the versions held written whole every second batch."""
    monkeypatch.setattr(KG, "WHOLE", 2)
    versions = [(f"P{i % 3}", "" if (i * 5) % 7 == 0 else f"CREATE PROCEDURE P{i % 3} AS BEGIN\n EXEC C{i};\nEND;", (i * 11) % 17) for i in range(14)]
    schema = "name string, source_code string, at int"
    for n, v in enumerate(versions):
        (spark.createDataFrame([v], schema).select("name", "source_code", F.timestamp_seconds("at").alias("modified_at"))
         .coalesce(1).write.mode("append").parquet(str(tmp_path / "in")))
    read = spark.readStream.schema("name string, source_code string, modified_at timestamp").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    KG.start(read, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    got = {(r.id, r.dst, r.edge_type) for r in KG.current(spark.read.parquet(str(tmp_path / "log"))).collect()}
    want = set()
    for name in {v[0] for v in versions}:
        text = max((v for v in versions if v[0] == name), key=lambda v: v[2])[1]
        want |= {(f"UNKNOWN.{name}", f"UNKNOWN.{name}", "node"), (f"UNKNOWN.{name}", text.split("EXEC ")[1].split(";")[0], "calls")} if text else set()
    assert {g for g in got if g[2] == "node" or g[1].startswith("C") and g[1][1:].isdigit()} == want
