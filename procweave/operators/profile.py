"""Field profiles, samples and guarded queries on real tables.

Every profile is one aggregation pass over the table for all requested
columns together, unpivoted to a row per column, and one distinct pass per
column that reads that column only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.functions import constants as K
from procweave.functions.sqlguard import all_to_string, apply_limit_policy, float_text, guard_error


def field_profile(df: DataFrame, columns: list[str], exact: bool = True, avg_digits: int = 6) -> DataFrame:
    """A12 + A13: per column total, non-null, null, distinct, min, max, avg.

    ``exact=False`` uses ``approx_count_distinct`` (HyperLogLog++), which is
    the right choice at 100 TB. min/max are reported as strings (values are
    returned as text, P39); avg is over a DOUBLE ``try_cast`` so that text
    columns give NULL instead of failing.
    """
    types = dict(df.dtypes)
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")

    def text(v, t):
        return float_text(v) if t in ("float", "double") else v.cast("string")

    def avg_of(c, t):
        if t in ("float", "double"):
            # exact sum over DECIMAL: a DOUBLE sum depends on the order of the
            # partial sums, which can flip the rounded average at a tie
            return F.avg(F.expr(f"try_cast(`{c}` AS DECIMAL(38,10))"))
        if t in numeric or t.startswith("decimal"):
            return F.avg(F.col(c).cast("double"))
        if t == "string":
            return F.avg(F.expr(f"try_cast(`{c}` AS DOUBLE)"))
        return F.lit(None).cast("double")  # dates, timestamps, booleans: no average

    aggs = [F.count(F.lit(1)).alias("__total")]
    for c in columns:
        t = types[c]
        aggs += [F.count(F.col(c)).alias(f"{c}__nn"), text(F.min(F.col(c)), t).alias(f"{c}__min"),
                 text(F.max(F.col(c)), t).alias(f"{c}__max"), avg_of(c, t).alias(f"{c}__avg")]
        if not exact:
            aggs.append(F.approx_count_distinct(F.col(c)).alias(f"{c}__dc"))
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("field_name"),
                 F.col("__total").cast("bigint").alias("total_count"),
                 F.col(f"{c}__nn").cast("bigint").alias("non_null_count"),
                 (F.col("__total") - F.col(f"{c}__nn")).cast("bigint").alias("null_count"),
                 (F.lit(None) if exact else F.col(f"{c}__dc")).cast("bigint").alias("distinct_count"),
                 F.col(f"{c}__min").alias("min_value"), F.col(f"{c}__max").alias("max_value"),
                 F.round(F.col(f"{c}__avg"), avg_digits).cast("double").alias("avg_value"))
        for c in columns]))
    profile = one.select(rows.alias("r")).select("r.*")
    if not exact:
        return profile
    # distinct values column by column: each reads its column only and combines
    # map-side, instead of one Expand that multiplies every row by the columns
    distinct = None
    for c in columns:
        n = (df.select(F.col(c).alias("v")).filter(F.col("v").isNotNull()).distinct()
             .agg(F.lit(c).alias("field_name"), F.count(F.lit(1)).cast("bigint").alias("distinct_count")))
        distinct = n if distinct is None else distinct.unionByName(n)
    order = profile.columns
    return profile.drop("distinct_count").join(distinct, "field_name").select(order)


def sample_rows(df: DataFrame, columns: list[str] | None = None, limit: int = K.DEFAULT_SAMPLE,
                order_by: list[str] | None = None) -> DataFrame:
    """L4: the first ``limit`` rows of the chosen columns, as text.

    With ``order_by`` the sample is deterministic (TakeOrderedAndProject:
    a per-partition top-n, no full sort).
    """
    n = int(limit)
    if n < 1:
        raise ValueError("limit must be at least 1")
    out = df.select(*(columns or df.columns))
    if order_by:
        out = out.orderBy(*order_by)
    return all_to_string(out.limit(n))


def guarded_query(spark: SparkSession, query: str, limit: int = K.DEFAULT_QUERY_LIMIT) -> DataFrame:
    """Run a user SELECT after the guard, its first ``limit`` rows, values as text."""
    n = int(limit)
    if n < 1:
        raise ValueError("limit must be at least 1")
    check = spark.range(1).select(guard_error(F.lit(query)).alias("e")).first()["e"]
    if check is not None:
        raise ValueError(check)
    return all_to_string(spark.sql(query.rstrip().rstrip(";")).limit(n))


def audit_queries(queries: DataFrame, text_col: str = "sql", max_limit: int = K.MAX_QUERY_LIMIT) -> DataFrame:
    """P37 + P38 over a query log: allowed flag, error message, rewritten text."""
    err = guard_error(F.col(text_col))
    return queries.select("*", err.isNull().alias("allowed"), err.alias("error"),
                          apply_limit_policy(F.col(text_col), max_limit).alias("limited_sql"))
