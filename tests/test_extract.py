"""Static analysis goldens on hand-written procedures (counts worked out by hand)."""

import pytest
from pyspark.sql import functions as F

from procweave.functions import extract as X
from procweave.functions.scoring import code_complexity
from procweave.operators import analysis as A

ORDERS_PROC = """CREATE OR REPLACE PROCEDURE sync_orders(p_id IN NUMBER, p_msg OUT VARCHAR2, p_flag INOUT VARCHAR2) AS
  v_total NUMBER;
  v_name VARCHAR2(100);
  CURSOR c_items IS SELECT * FROM order_items;
BEGIN
  -- IF comments count too
  SELECT o.amount, UPPER(name) AS nm INTO v_total FROM orders o JOIN customers c ON c.id = o.cid;
  IF v_total > 0 THEN
    FOR rec IN c_items LOOP
      UPDATE order_history SET last_seen = SYSDATE, status = 'X' WHERE id = rec.id;
    END LOOP;
  END IF;
  pkg_audit.log_event(p_id);
  CALL notify_team;
  INSERT INTO audit_log (event, created_at) VALUES ('sync', SYSDATE);
EXCEPTION
  WHEN OTHERS THEN
    RAISE_APPLICATION_ERROR(-20001, 'failed');
END;"""

SIMPLE_PROC = """CREATE PROCEDURE simple_proc AS
BEGIN
  DELETE FROM stale_rows;
  MERGE INTO targets t USING sources s ON (t.id = s.id);
END;"""


@pytest.fixture(scope="module")
def analysed(spark):
    df = spark.createDataFrame([("SYNC_ORDERS", ORDERS_PROC), ("SIMPLE_PROC", SIMPLE_PROC)], "name string, source_code string")
    return {r["proc"]: r for r in A.analyze(df).collect()}


def test_calls(analysed):
    calls = set(analysed["SYNC_ORDERS"]["calls"])
    # name( matches: SYNC_ORDERS (signature), VARCHAR2(100), PKG_AUDIT.LOG_EVENT, AUDIT_LOG (, VALUES (,
    # RAISE_APPLICATION_ERROR; UPPER( is a built-in; CALL notify_team; IN ( none
    assert calls == {"SYNC_ORDERS", "VARCHAR2", "PKG_AUDIT.LOG_EVENT", "NOTIFY_TEAM", "AUDIT_LOG", "VALUES",
                     "RAISE_APPLICATION_ERROR"}
    assert "UPPER" not in calls


def test_tables(analysed):
    assert set(analysed["SYNC_ORDERS"]["tables"]) == {"ORDER_ITEMS", "ORDERS", "CUSTOMERS", "V_TOTAL", "ORDER_HISTORY", "AUDIT_LOG"}
    assert set(analysed["SIMPLE_PROC"]["tables"]) == {"STALE_ROWS", "TARGETS"}


def test_fields(analysed):
    r = analysed["SYNC_ORDERS"]
    assert [s["field"] for s in r["select_fields"]] == ["AMOUNT", "NAME"]
    # first SELECT * FROM order_items gives '*' which is dropped
    assert [s["field"] for s in r["update_fields"]] == ["LAST_SEEN", "STATUS"]
    assert [s["field"] for s in r["insert_fields"]] == ["EVENT", "CREATED_AT"]
    assert [t["transformation"] for t in r["transformations"]] == ["UPPER(NAME)"]


def test_parameters_and_variables(analysed):
    r = analysed["SYNC_ORDERS"]
    got = [(p["name"], p["direction"], p["type"]) for p in r["parameters"]]
    # FOR rec IN c_items is the known false parameter
    assert got == [("p_id", "IN", "NUMBER"), ("p_msg", "OUT", "VARCHAR2"), ("p_flag", "INOUT", "VARCHAR2)"),  # the type class takes the ")"
                   ("rec", "IN", "C_ITEMS")]
    sig = [(p["name"], p["direction"], p["type"], p["position"]) for p in r["signature_parameters"]]
    assert sig == [("p_id", "IN", "NUMBER", 1), ("p_msg", "OUT", "VARCHAR2", 2), ("p_flag", "IN OUT", "VARCHAR2", 3)]
    assert set(r["variables"]) == {"V_TOTAL", "V_NAME"}


def test_control_and_complexity(analysed):
    c = analysed["SYNC_ORDERS"]["control"]
    assert (c["if"], c["loop"], c["for"], c["exception"]) == (3, 2, 1, 1)
    # 1 + 0 + 3*0.5 + 2*0.7 + 1*0.8 + 1*0.3 = 5.0 -> 5
    assert analysed["SYNC_ORDERS"]["complexity_score"] == 5
    assert analysed["SIMPLE_PROC"]["complexity_score"] == 1


def test_complexity_float_trap(spark):
    code = "LOOP LOOP LOOP EXCEPTION EXCEPTION EXCEPTION"
    assert spark.range(1).select(code_complexity(F.lit(code)).alias("c")).first()["c"] == 3


@pytest.mark.parametrize("expr,expected", [
    ("o.status", "STATUS"), ("name n", "NAME"), ("UPPER(name) AS nm", "NAME"), ("SUM(valor)", "VALOR"),
    ("nome INTO p_name", "NOME"), ("amount x", "AMOUNT"), ("total as t", None), ("discount d", None),
    ("UPPER(o.name) AS nm", None), ("COUNT(*) INTO v", None), ("NVL(x, 0)", None), ("1", None), ("*", None),
])
def test_clean_field_name(spark, expr, expected):
    got = spark.createDataFrame([(expr,)], "e string").select(X.clean_field_name("e").alias("f")).first()["f"]
    assert got == expected


def test_split_top_level_commas(spark):
    df = spark.createDataFrame([("a, f(x, g(y, z)), b",), ("x,,y",)], "t string")
    got = [r["p"] for r in df.select(X.split_top_level_commas("t").alias("p")).collect()]
    assert got == [["a", "f(x, g(y, z))", "b"], ["x", "", "y"]]


def test_signature_strict_mode(spark):
    df = spark.createDataFrame([("PROCEDURE p(n INT, m IN OUT INTEGER)",)], "c string")
    lit = df.select(X.signature_parameters("c").alias("p")).first()["p"]
    strict = df.select(X.signature_parameters("c", strict=True).alias("p")).first()["p"]
    assert [(p["type"], p["direction"]) for p in lit] == [("T", "IN"), ("TEGER", "IN OUT")]
    assert [(p["type"], p["direction"]) for p in strict] == [("INT", "IN"), ("INTEGER", "IN OUT")]


def test_field_usage_long_form(spark, analysed):
    df = spark.createDataFrame([("SYNC_ORDERS", ORDERS_PROC)], "name string, source_code string")
    usage = A.field_usage(A.analyze(df))
    ops = sorted((r["field"], r["operation"]) for r in usage.collect())
    assert ("NAME", "read") in ops and ("NAME", "transform") in ops and ("EVENT", "write") in ops
    one = A.field_usage_one(usage, "status").collect()
    assert [(r["operation"], r["kind"]) for r in one] == [("write", "update")]


def test_loader_corpus_expectations(spark, sf_small):
    from procweave.sources.tables import loader_corpus
    an = A.analyze(loader_corpus(spark, sf_small)).filter("source_code LIKE '%MERGE INTO%'").limit(1).collect()[0]
    calls = set(an["calls"])
    assert {"LEGACY_HOOK", "PKG_UTIL.LOG_ITEM", "VALUES", "ON"} <= calls        # comment text counts too
    assert not calls & {"NVL", "ROUND", "LOWER", "CONCAT", "REPLACE", "TRIM", "SUBSTR"}
    assert [s["field"] for s in an["select_fields"]] == ["QTY", "NAME"]        # nested commas kept whole
    assert [s["field"] for s in an["insert_fields"]][:2] == ["QTY", "PRICE"]
    assert [s["field"] for s in an["update_fields"]] == ["QTY", "PRICE"]
    assert sorted(t["transformation"] for t in an["transformations"]) == \
        ["CONCAT(FIRST_NAME)", "LOWER(NAME)", "REPLACE(CODE)", "SUBSTR(NAME)", "TRIM(PRICE)"]
    assert set(an["variables"]) == {"L_QTY", "V_X"}
    assert any(t.startswith("TOTALS_") for t in an["tables"]) and "V_X" in an["tables"]


def test_call_patterns_start_an_attempt_per_identifier_only(spark):
    """Attempts behind a letter are cut off and patterns whose matches another one finds are left out: same names."""
    import re

    from procweave.functions import constants as K
    texts = ["CALL x; a.b.c (1) 9abc(2) _q9.z( upper(name) a.9b(3) pkg.run(x.y(1)) éa(1)", "delete from t merge into s from from u FROM a.DELETE FROM x join j",
             "aaaaaaaa.bbbbbbbb" * 3 + "(", "f (g(h ( i", "a1.b (c2.d( e.f.g.h(", "insert into into q.r values"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.called_procedures("t").alias("c"), X.called_tables("t").alias("u")).collect()
    for row in got:
        def plain(patterns):
            return list(dict.fromkeys(m.upper() for p in patterns for m in re.findall(p, row.t, re.ASCII)))
        assert row.c == [x for x in plain(K.CALL_PATTERNS) if "." in x or x not in K.SQL_BUILTINS]
        assert row.u == plain(K.TABLE_PATTERNS)
    assert all(p.startswith("(?i)(?<![a-z_])") for p in map(X._fast_call_pattern, K.CALL_PATTERNS[1:]))
    assert X._uncovered(K.CALL_PATTERNS) == K.CALL_PATTERNS[:2] and X._uncovered(K.TABLE_PATTERNS_SHORT) == K.TABLE_PATTERNS_SHORT[:3]


def test_a_table_is_dealt_by_its_rows(spark, tmp_path):
    """Tasks of text work keep their size as the table grows."""
    from procweave.sources import tables as S
    spark.range(S.TASK_ROWS * 6 + 1).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    assert S.read_table(spark, str(tmp_path), "orders").rdd.getNumPartitions() == 7
    assert S.read_table(spark, str(tmp_path), "orders", deal=False).rdd.getNumPartitions() < 7
