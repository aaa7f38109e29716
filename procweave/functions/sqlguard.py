"""SQL guard, LIMIT policy and value stringification as column expressions.

Re-aimed from a per-request check to a classifier over a *column* of query
texts, so a whole query log can be audited in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from procweave.functions import constants as K
from procweave.functions.extract import _col


def clean_sql(query) -> Column:
    """Drop ``--`` line comments and ``/* */`` block comments, collapse whitespace."""
    q = F.regexp_replace(_col(query), r"(?md)--.*?$", "")
    q = F.regexp_replace(q, r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(F.regexp_replace(q, r"\s+", " "), r"^ | $", "")


def guard_error(query) -> Column:
    """NULL when the query is an allowed single SELECT, else the message.

    Order as in the original: not a SELECT, then the first banned word in
    list order, then a second statement.
    """
    c = clean_sql(query)
    up = F.upper(c)
    # literal patterns, one per word, so each is compiled once per task
    first_banned = F.coalesce(*[F.when(up.rlike(rf"\b{k}\b"), F.lit(k)) for k in K.GUARD_BANNED])
    statements = F.split(c, ";")
    tail = F.slice(statements, F.lit(2), F.size(statements))
    multi = F.exists(tail, lambda p: (F.trim(p) != "") & ~F.trim(p).startswith("--"))
    return (F.when(~c.rlike(r"(?i)^\s*SELECT\s+"), F.lit(K.GUARD_MSG_NOT_SELECT))
            .when(first_banned.isNotNull(),
                  F.concat(F.lit(K.GUARD_MSG_BANNED.split("{kw}")[0]), first_banned, F.lit(K.GUARD_MSG_BANNED.split("{kw}")[1])))
            .when(multi, F.lit(K.GUARD_MSG_MULTI)))


def apply_limit_policy(query, max_limit: int = K.MAX_QUERY_LIMIT) -> Column:
    """Cap an existing LIMIT (every occurrence), keep TOP n, else append LIMIT."""
    q = _col(query)
    up = F.upper(q)
    existing = F.regexp_extract(up, r"\bLIMIT\s+(\d+)", 1)
    capped = F.regexp_replace(q, r"(?i)\bLIMIT\s+\d+", f"LIMIT {max_limit}")
    appended = F.concat(F.regexp_replace(F.regexp_replace(q, r"\s+$", ""), r";+$", ""), F.lit(f" LIMIT {max_limit}"))
    return (F.when(up.rlike(r"\bLIMIT\s+\d+"),
                   F.when(existing.cast("double") > F.lit(float(max_limit)), capped).otherwise(q))
            .when(up.rlike(r"\bTOP\s+\d+"), q)
            .otherwise(appended))


def float_text(c) -> Column:
    """A DOUBLE as Python's ``str(float)`` writes it: shortest round-trip
    digits, plain notation for 1e-4 <= |x| < 1e16, else ``1e-05`` style."""
    x = _col(c).cast("double")
    java = x.cast("string")
    mant = F.regexp_replace(F.regexp_extract(java, r"^(-?[0-9.]+)E(-?[0-9]+)$", 1), r"\.0$", "")
    exp = F.regexp_extract(java, r"E(-?[0-9]+)$", 1).cast("int")
    sci = F.concat(mant, F.lit("e"), F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(exp).cast("string"), 2, "0"))
    plain = F.regexp_replace(x.cast("decimal(38,21)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    special = F.when(F.isnan(x), F.lit("nan")).when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf"))
    big_or_tiny = (F.abs(x) >= 1e16) | ((x != 0) & (F.abs(x) < 1e-4))
    return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(special, F.when(big_or_tiny, sci).otherwise(plain)))


def to_text(df, c: str) -> Column:
    """One column as text the way the original stringifies values."""
    t = dict(df.dtypes)[c]
    if t in ("double", "float"):
        return float_text(F.col(c)).alias(c)
    return F.col(c).cast("string").alias(c)


def all_to_string(df):
    """Every column as string, NULL kept."""
    return df.select(*[to_text(df, c) for c in df.columns])
