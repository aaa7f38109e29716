"""SQL guard, limit policy, token metrics, profiles, model steps, caches."""

import pytest
from pyspark.sql import functions as F

from procweave.functions import constants as K
from procweave.functions.sqlguard import apply_limit_policy, float_text, guard_error
from procweave.operators import cache as CA
from procweave.operators import model_steps as L
from procweave.operators import profile as PR
from procweave.operators import tokens as TK


@pytest.mark.parametrize("q,err", [
    ("SELECT * FROM users WHERE id = 1", None),
    ("select * from users", None),
    ("SELECT u.id FROM users u JOIN orders o ON o.uid = u.id", None),
    ("-- comment\nSELECT * FROM users /* note */", None),
    ("DELETE FROM users", K.GUARD_MSG_NOT_SELECT),
    ("UPDATE users SET a = 1", K.GUARD_MSG_NOT_SELECT),
    ("DROP TABLE users", K.GUARD_MSG_NOT_SELECT),
    ("SELECT * FROM users; DELETE FROM users", "Comando 'DELETE' não é permitido por segurança"),
    ("SELECT 1; SELECT 2", K.GUARD_MSG_MULTI),
    ("SELECT updated_at FROM t", None),
])
def test_guard(spark, q, err):
    assert spark.range(1).select(guard_error(F.lit(q)).alias("e")).first()["e"] == err


@pytest.mark.parametrize("q,out", [
    ("SELECT * FROM users LIMIT 2000", "SELECT * FROM users LIMIT 1000"),
    ("SELECT * FROM users LIMIT 20", "SELECT * FROM users LIMIT 20"),
    ("SELECT * FROM users;", "SELECT * FROM users LIMIT 100"),
    ("SELECT TOP 5 * FROM users", "SELECT TOP 5 * FROM users"),
])
def test_limit_policy(spark, q, out):
    mx = 100 if q.endswith(";") else 1000
    assert spark.range(1).select(apply_limit_policy(F.lit(q), mx).alias("q")).first()["q"] == out


def test_float_text_matches_python(spark):
    vals = [757703674.73, 5.0, 0.1 + 0.2, 1e-5, 1.5e16, -2.5, 123.456]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert [r[0] for r in df.select(float_text("x")).collect()] == [str(v) for v in vals]


def test_token_compare(spark):
    m = spark.createDataFrame([(1, "op1", 100, 50, 150, True), (2, "op1", 200, 100, 300, False),
                               (3, "op2", 10, 10, 20, True)],
                              "request_id long, operation string, tokens_in long, tokens_out long, tokens_total long, use_toon boolean")
    r = TK.compare_by_operation(m).collect()
    assert [(x["operation"], x["with_toon"], x["without_toon"], x["savings_percent"], x["savings_tokens"]) for x in r] == \
        [("op1", 150, 300, 50.0, 150)]
    o = TK.compare_overall(m).first()
    assert (o["with_toon_tokens"], o["without_toon_tokens"], o["overall_savings_tokens"]) == (170, 300, 130)
    never = TK.compare_overall(m.withColumn("use_toon", F.lit(False))).first()
    assert never["with_toon_tokens"] is None and never["overall_savings_percent"] is None
    always = TK.compare_overall(m.withColumn("use_toon", F.lit(True))).first()
    assert always["note"] is not None and always["without_toon_tokens"] is None


def test_usage_parsing(spark):
    docs = ['{"llm_output": {"token_usage": {"prompt_tokens": 0, "input_tokens": 7, "completion_tokens": 3}}}',
            '{"llm_output": {"token_usage": {}}, "response_metadata": {"token_usage": {"promptTokens": 2, "totalTokens": 9}}}',
            '{"generations": [[{"response_metadata": {}}, {"response_metadata": {"token_usage": {"inputTokens": 4}}}]]}']
    df = spark.createDataFrame([(d,) for d in docs], "r string")
    got = [tuple(x) for x in df.select(TK.parse_usage(TK.usage_from_response("r")).alias("u")).select("u.*").collect()]
    assert got == [(7, 3, 10), (2, 0, 9), (4, 0, 4)]


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b"), (None, "a")], "n int, s string")
    rows = {r["field_name"]: r for r in PR.field_profile(df, ["n", "s"]).collect()}
    assert (rows["n"]["total_count"], rows["n"]["non_null_count"], rows["n"]["null_count"], rows["n"]["distinct_count"]) == (4, 3, 1, 2)
    assert rows["n"]["avg_value"] == pytest.approx(5 / 3, abs=1e-6)
    assert rows["s"]["avg_value"] is None and rows["s"]["min_value"] == "a"
    approx = PR.field_profile(df, ["n"], exact=False).first()
    assert approx["distinct_count"] == 2


def test_sample_and_guarded_query(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 1.5)
    s = PR.sample_rows(df, ["id", "v"], limit=1000, order_by=["id"]).collect()
    assert len(s) == 500 and s[1]["v"] == "1.5"  # the limit asked for, not a smaller one
    df.createOrReplaceTempView("nums")
    assert PR.guarded_query(spark, "SELECT id FROM nums", limit=5).count() == 5
    with pytest.raises(ValueError):
        PR.guarded_query(spark, "DROP TABLE nums")


def test_model_steps(spark):
    df = spark.createDataFrame([("P1", "BEGIN IF x THEN NULL; END IF; END;"), ("P2", "BEGIN NULL; END;")],
                               "name string, code string")
    p = df.select("name", L.prompt("complexity", code=F.col("code")).alias("prompt"))
    out = L.call_model(p, L.stub_client).collect()
    assert all(r["response"].startswith("Complexity") and r["error"] is None for r in out)

    def flaky(prompts):
        if len(prompts) > 1:
            raise RuntimeError("batch too large")
        if "P2" in prompts[0] or "NULL; END;" == prompts[0][-10:]:
            raise RuntimeError("bad prompt")
        return ["7"]
    res = L.call_model(df.select("name", F.col("code").alias("prompt")), flaky).collect()
    assert [(r["response"], r["error"] is not None) for r in res] == [("7", False), (None, True)]
    scored = spark.createDataFrame([("Score 11, maybe 4", "x"), ("no number", "IF IF")], "r string, c string")
    assert [x[0] for x in scored.select(L.score_from_response("r", F.col("c"))).collect()] == [4, 2]
    j = spark.createDataFrame([("```json\n{\"a\": \"x\"}\n```",), ("see {bad} and {\"k\": {\"n\": 1}}",)], "t string")
    assert j.select(L.parse_object("t")).first()[0] == {"a": "x"}
    assert j.select(L.first_json_object("t")).collect()[1][0] == '{"k": {"n": 1}}'


def test_purpose_match(spark):
    bt = spark.createDataFrame([("b1", "users", "public.users", 4), ("b1", "orders", "public.orders", 2),
                                ("b1", "items", "public.items", 3)], "batch_id string, table string, full_name string, n_columns long")
    ans = spark.createDataFrame([("b1", "public.users", "people"), ("b1", "orders_table", "sales")],
                                "batch_id string, key string, purpose string")
    got = {r["table"]: r["purpose"] for r in L.match_purposes(bt, ans).collect()}
    assert got == {"users": "people", "orders": "sales", "items": "Tabela items com 3 colunas"}


def test_caches(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "table string")
    cache = spark.createDataFrame([("a", "1.0"), ("b", "0.9")], "table string, cache_version string")
    assert sorted(r[0] for r in CA.cache_misses(wanted, cache).collect()) == ["b", "c"]
    assert CA.cache_misses(wanted, cache, force_update=True).count() == 3
    key = spark.range(1).select(CA.cache_key(F.lit("postgresql"), F.lit("h"), F.lit(None), F.lit("db"), F.lit(None), F.lit("u"))).first()[0]
    import hashlib
    assert key == hashlib.sha256("postgresql|h||db||u".encode()).hexdigest()[:16]


def test_source_priority_and_stats(spark):
    from procweave.operators import catalog as C
    cache = spark.createDataFrame([("A", "c")], "name string, code string")
    files = spark.createDataFrame([("A", "f"), ("B", "f")], "name string, code string")
    db = spark.createDataFrame([("A", "d"), ("B", "d"), ("C", "d")], "name string, code string")
    frames = [("cache", cache), ("file", files), ("database", db)]
    got = {r["name"]: r["source"] for r in CA.prefer_sources(frames).collect()}
    assert got == {"A": "cache", "B": "file", "C": "database"}
    forced = {r["name"]: r["source"] for r in CA.prefer_sources(frames, force_refresh=True).collect()}
    assert forced == {"A": "file", "B": "file", "C": "database"}
    tables = spark.createDataFrame([("s", "t1"), ("s", "t2")], "table_schema string, table_name string")
    stats = spark.createDataFrame([("s", "t1", 10, "1 MB")], "table_schema string, table_name string, row_count long, table_size string")
    rows = {r["table_name"]: (r["row_count"], r["table_size"]) for r in C.attach_stats(tables, stats).collect()}
    assert rows == {"t1": (10, "1 MB"), "t2": (None, None)}
