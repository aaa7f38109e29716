"""Vector search against brute force; file sources; stores; streaming; engine."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from procweave.operators import vector as V
from procweave.sinks import reports as RP
from procweave.sources import files as FS
from procweave.sources import jdbc as J
from procweave.sources import stores


def _vectors(spark, n=200, d=16, seed=7):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m, spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(n)], "id long, embedding array<float>")


def test_search_many_equals_brute_force(spark):
    m, df = _vectors(spark)
    m32 = m.astype(np.float32).astype(np.float64)
    queries = df.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    got = V.search_many(df.repartition(5), queries, k=3, threshold=-1.0, digits=None, max_bytes=7 * 200).collect()
    got = {(r["query_id"], r["rank"]): r["id"] for r in got}
    for q in range(0, 200, 10):
        sims = 1 - ((m32 - m32[q]) ** 2).sum(axis=1)
        order = sorted(range(200), key=lambda i: (-sims[i], i))[:3]
        assert [got[(q, r)] for r in (1, 2, 3)] == order


def test_single_search_and_threshold(spark):
    m, df = _vectors(spark)
    q = V.query_vector(m[5].astype(np.float32))
    top = V.search(df, q, k=5, threshold=-1.0).collect()
    assert top[0]["id"] == 5 and top[0]["similarity"] == pytest.approx(1.0, abs=1e-4)
    only_self = V.search(df, q, k=5, threshold=0.999).collect()
    assert [r["id"] for r in only_self] == [5]


def test_hashing_embedding_and_hybrid(spark):
    docs = spark.createDataFrame([("A", "procedure", "orders totals"), ("B", "procedure", "orders items"),
                                  ("C", "table", "customer names")], "node_id string, node_type string, text string")
    emb = V.embed_hashing(docs, "text", dim=32)
    vec = emb.filter("node_id = 'A'").first()["embedding"]
    assert len(vec) == 32 and abs(sum(x * x for x in vec) - 1) < 1e-5
    edges = spark.createDataFrame([("A", "B", "calls"), ("A", "T1", "accesses"), ("C", "A", "calls")],
                                  "src string, dst string, edge_type string")
    h = V.hybrid_search(emb, edges, V.query_vector(vec), k=1, threshold=-1.0).collect()
    assert {(r["node_id"], r["edge_type"], r["other"], r["pos"], r["n_neighbours"]) for r in h} == \
        {("A", "calls", "B", 1, 2), ("A", "calls", "C", 2, 2), ("A", "accesses", "T1", 1, 1)}

    def enc(texts):
        return np.ones((len(texts), 4)) / 2.0
    out = V.embed_with(docs, enc, "text", dim=4).collect()
    assert all(list(r["embedding"]) == [0.5] * 4 for r in out)


def test_file_sources_and_rewrite(spark):
    root = tempfile.mkdtemp(prefix="pw-src-")
    os.makedirs(f"{root}/a/b")
    open(f"{root}/main_proc.prc", "w").write("  CREATE PROCEDURE main_proc AS BEGIN sub_proc(); END;  \n")
    open(f"{root}/a/b/sub_proc.prc", "w").write("CREATE PROCEDURE sub_proc AS BEGIN NULL; END;")
    open(f"{root}/a/empty.prc", "w").write("   \n")
    open(f"{root}/a/notes.txt", "w").write("ignored")
    procs = FS.load_procedures(spark, root)
    got = {r["name"]: r["source_code"] for r in procs.collect()}
    assert set(got) == {"MAIN_PROC", "SUB_PROC"} and got["MAIN_PROC"].startswith("CREATE")
    assert FS.find_procedure(procs, "sub_proc").first()["name"] == "SUB_PROC"
    with pytest.raises(FileNotFoundError):
        FS.load_procedures(spark, root, "fnc")

    tree = tempfile.mkdtemp(prefix="pw-ddl-")
    for kind, name, ext in [("tables", "ORDERS", ".sql"), ("procedures", "P1", ".prc"), ("procedures", "P2", ".sql"),
                            ("functions", "F1", ".fnc")]:
        os.makedirs(f"{tree}/APP/{kind}", exist_ok=True)
        open(f"{tree}/APP/{kind}/{name}{ext}", "w").write(f"-- {name}")
    objs = {(r["schema"], r["obj_type"], r["name"]) for r in FS.read_ddl_tree(spark, tree).collect()}
    assert objs == {("APP", "tables", "ORDERS"), ("APP", "procedures", "P1"), ("APP", "functions", "F1")}

    md = spark.createDataFrame([("x.md", "# T\n```mermaid\ngraph TD\n A --> B\n```"),
                                ("y.md", "```mermaid\n%%{init: {}}%%\nerDiagram\n```"),
                                ("z.md", "no diagram")], "file_path string, content string")
    res = {r["file_path"]: r for r in RP.add_mermaid_init(md).collect()}
    assert res["x.md"]["updated"] and "'curve': 'basis'" in res["x.md"]["new_content"]
    assert res["x.md"]["new_content"].endswith("}}%%\ngraph TD\n A --> B\n```")
    assert not res["y.md"]["updated"] and not res["z.md"]["updated"]


def test_graph_store_roundtrip(spark):
    path = tempfile.mkdtemp(prefix="pw-store-")
    nodes = spark.createDataFrame([("S.P", "procedure")], "id string, node_type string")
    edges = spark.createDataFrame([("S.P", "T", "accesses")], "src string, dst string, edge_type string")
    stores.save_graph(nodes, edges, path, {"source": "test"})
    n2, e2 = stores.load_graph(spark, path)
    assert n2.count() == 1 and e2.first()["dst"] == "T"
    meta = spark.read.parquet(f"{path}/metadata").first()
    assert (meta["node_count"], meta["edge_count"], meta["source"]) == (1, 1, "test")
    cache = tempfile.mkdtemp(prefix="pw-cache-")
    stores.save_table_cache(spark.createDataFrame([("k1", "t1", "ddl")], "cache_key string, table string, ddl string"), cache)
    assert stores.load_table_cache(spark, cache, "k1").count() == 1


def test_jdbc_builders():
    for name in J.available_dialects():
        d = J.DIALECTS[name]
        for what in ("procedures", "columns", "keys", "indexes", "tables"):
            sql = d.sql(what, "APP")
            assert "{schema_cond}" not in sql and "= 'APP'" in sql
    assert "IS NOT NULL" in J.ORACLE.sql("objects", None)


def test_dialect_key_rules(spark):
    rows = spark.createDataFrame([("public", "p1", "x"), ("sales", "p2", "y"), ("dbo", "p3", " ")],
                                 "schema string, name string, source_code string")
    pg = {r["name"] for r in J.procedure_keys(rows, "postgresql").collect()}
    assert pg == {"p1", "sales.p2"}   # public dropped; blank source removed
    ms = {r["name"] for r in J.procedure_keys(rows, "mssql").collect()}
    assert ms == {"public.p1", "sales.p2"}
    my = {r["name"] for r in J.procedure_keys(rows, "mysql", connected_database="sales").collect()}
    assert my == {"public.p1", "p2"}


def test_incremental_index_stream(spark):
    from procweave.streaming import incremental
    src = tempfile.mkdtemp(prefix="pw-stream-")
    out = tempfile.mkdtemp(prefix="pw-out-")
    ck = tempfile.mkdtemp(prefix="pw-ck-")
    open(f"{src}/a.prc", "w").write("CREATE PROCEDURE a AS BEGIN b(); SELECT x FROM t1; END;")
    q = incremental.start(spark, src, out, ck)
    q.awaitTermination(120)
    open(f"{src}/b.prc", "w").write("CREATE PROCEDURE b AS BEGIN UPDATE t2 SET y = 1; END;")
    q = incremental.start(spark, src, out, ck)
    q.awaitTermination(120)
    docs, edges = incremental.current(spark, out)
    assert {r["node_id"] for r in docs.collect()} == {"UNKNOWN.A", "UNKNOWN.B"}
    assert ("UNKNOWN.A", "B") in {(r["src"], r["dst"]) for r in edges.filter("edge_type = 'calls'").collect()}
    # a changed procedure arrives as a new file (new drop folder): it replaces the old version
    os.makedirs(f"{src}/v2")
    open(f"{src}/v2/a.prc", "w").write("CREATE PROCEDURE a AS BEGIN c(); END;")
    q = incremental.start(spark, src, out, ck)
    q.awaitTermination(120)
    docs, edges = incremental.current(spark, out)
    assert docs.count() == 2
    calls = {(r["src"], r["dst"]) for r in edges.filter("edge_type = 'calls'").collect()}
    assert ("UNKNOWN.A", "C") in calls and ("UNKNOWN.A", "B") not in calls


def test_token_stream(spark, sf_small):
    from procweave.sources.tables import token_metrics
    from procweave.streaming import tokens as TS
    tmp = tempfile.mkdtemp(prefix="pw-tok-")
    token_metrics(spark, sf_small).write.mode("overwrite").parquet(f"{tmp}/in")
    schema = spark.read.parquet(f"{tmp}/in").schema
    st = spark.readStream.schema(schema).parquet(f"{tmp}/in")
    q = TS.stream(st, "1 hour", "10 minutes").writeStream.outputMode("append").format("memory") \
        .queryName("tok_windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    streamed = spark.sql("SELECT * FROM tok_windows")
    batch = TS.windowed(spark.read.parquet(f"{tmp}/in").withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    # append mode emits only windows closed by the watermark: a subset of the batch answer, all equal
    assert streamed.count() > 0
    assert streamed.exceptAll(batch).count() == 0


def test_catalog_sql_on_information_schema(spark):
    """The PostgreSQL-dialect catalog SQL runs on DuckDB's standard information_schema;
    its rows go through the same assembly as the JDBC frames."""
    import duckdb
    from procweave.operators import catalog as C
    con = duckdb.connect()
    con.execute("CREATE SCHEMA app")
    con.execute("CREATE TABLE app.customers (id INTEGER PRIMARY KEY, name VARCHAR(40) NOT NULL, score DECIMAL(10,2))")
    con.execute("CREATE TABLE app.orders (id INTEGER PRIMARY KEY, cust INTEGER REFERENCES app.customers(id), total DOUBLE)")

    def frame(what, schema):
        res = con.execute(J.POSTGRESQL.sql(what, "app"))
        return spark.createDataFrame(res.fetchall(), schema)

    cols = frame("columns", "table_schema string, table_name string, column_name string, ordinal int, data_type string, "
                            "char_len int, num_precision int, num_scale int, is_nullable string, column_default string, comment string")
    keys = frame("keys", "constraint_name string, constraint_type string, table_schema string, table_name string, "
                         "column_name string, ordinal int, ref_schema string, ref_table string, ref_column string, "
                         "delete_rule string, update_rule string")
    assembled = {r["column_name"]: r for r in C.assemble_columns(cols, keys).filter("table_name = 'orders'").collect()}
    assert assembled["id"]["is_primary_key"] and assembled["cust"]["foreign_key_table"] == "app.customers"
    fks = C.foreign_keys(keys).collect()
    assert [(r["columns"], r["referenced_table"], r["referenced_columns"]) for r in fks] == [("cust", "app.customers", "id")]
    tables = spark.createDataFrame([("app.customers",), ("app.orders",)], "table string")
    assert [(r["src"], r["dst"]) for r in C.resolve_fk_targets(C.foreign_keys(keys), tables).collect()] == \
        [("app.orders", "app.customers")]


def test_token_stream_drops_late_rows(spark):
    """Append mode with a watermark: a window is emitted once, after the
    watermark passes its end; rows older than the watermark are dropped."""
    import datetime as dt
    from procweave.streaming import tokens as TS
    src = tempfile.mkdtemp(prefix="pw-late-src-")
    out = tempfile.mkdtemp(prefix="pw-late-out-")
    ck = tempfile.mkdtemp(prefix="pw-late-ck-")
    schema = "request_id long, operation string, tokens_in long, tokens_out long, tokens_total long, timestamp timestamp, use_toon boolean"

    def batch(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{src}/{name}")

    t0 = dt.datetime(2024, 1, 1, 0, 5)
    batch([(1, "op", 10, 5, 15, t0, True), (2, "op", 20, 5, 25, t0 + dt.timedelta(minutes=10), False)], "b1")
    batch([(3, "op", 1, 1, 2, t0 + dt.timedelta(hours=3), True)], "b2")   # moves the watermark past 01:00

    def run():
        st = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        q = TS.start_to_table(st, out, ck, "1 hour", "10 minutes", available_now=True)
        q.awaitTermination(180)

    run()
    batch([(4, "op", 1000, 0, 1000, t0 + dt.timedelta(minutes=1), True)], "b3")   # late: before the watermark
    run()
    run()   # a further trigger lets the watermark close what is due
    got = {(str(r["window_start"]), r["requests"], r["tokens_total"]) for r in spark.read.parquet(out).collect()}
    assert ("2024-01-01 00:00:00", 2, 40) in got           # the late row was not added
    assert all(total != 1040 for _, _, total in got)
