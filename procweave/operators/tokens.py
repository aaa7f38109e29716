"""Model-token metrics.

Input ``token_metrics(request_id, operation, tokens_in, tokens_out,
tokens_total, timestamp, use_toon)``. Each row carries its own operation,
so attribution cannot mix between concurrent requests. All aggregates are
hash aggregates with map-side partials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(m: DataFrame) -> DataFrame:
    """Prompt, completion and total tokens over all requests (0 when empty)."""
    return m.agg(F.coalesce(F.sum("tokens_in"), F.lit(0)).cast("bigint").alias("prompt_tokens"),
                 F.coalesce(F.sum("tokens_out"), F.lit(0)).cast("bigint").alias("completion_tokens"),
                 F.coalesce(F.sum("tokens_total"), F.lit(0)).cast("bigint").alias("total_tokens"))


def by_operation(m: DataFrame, digits: int = 6) -> DataFrame:
    """Per operation count, sums and per-request averages."""
    return m.groupBy("operation").agg(
        F.count(F.lit(1)).cast("bigint").alias("count"),
        F.sum("tokens_in").cast("bigint").alias("tokens_in"),
        F.sum("tokens_out").cast("bigint").alias("tokens_out"),
        F.sum("tokens_total").cast("bigint").alias("tokens_total"),
        F.round(F.avg("tokens_in"), digits).alias("avg_tokens_in"),
        F.round(F.avg("tokens_out"), digits).alias("avg_tokens_out"),
        F.round(F.avg("tokens_total"), digits).alias("avg_tokens_total"))


def overall(m: DataFrame, digits: int = 6) -> DataFrame:
    """A10: request count and averages per request (0 when empty)."""
    return m.agg(F.count(F.lit(1)).cast("bigint").alias("total_requests"),
                 F.round(F.coalesce(F.avg("tokens_in"), F.lit(0.0)), digits).alias("avg_prompt_tokens"),
                 F.round(F.coalesce(F.avg("tokens_out"), F.lit(0.0)), digits).alias("avg_completion_tokens"),
                 F.round(F.coalesce(F.avg("tokens_total"), F.lit(0.0)), digits).alias("avg_total_tokens"))


def compare_by_operation(m: DataFrame, digits: int = 6) -> DataFrame:
    """A11 + J14 + U3: operations measured both with and without the compact
    format, with savings; conditional aggregation + HAVING instead of two
    grouped frames and a join."""
    g = m.groupBy("operation").agg(
        F.sum(F.when(F.col("use_toon"), F.col("tokens_total"))).alias("with_toon"),
        F.sum(F.when(~F.col("use_toon"), F.col("tokens_total"))).alias("without_toon"),
        F.count(F.when(F.col("use_toon"), 1)).alias("n_with"),
        F.count(F.when(~F.col("use_toon"), 1)).alias("n_without"))
    both = g.filter((F.col("n_with") > 0) & (F.col("n_without") > 0) & (F.col("without_toon") > 0))
    return both.select(
        "operation", F.col("with_toon").cast("bigint"), F.col("without_toon").cast("bigint"),
        F.round((F.col("without_toon") - F.col("with_toon")) / F.col("without_toon") * 100.0, digits).alias("savings_percent"),
        (F.col("without_toon") - F.col("with_toon")).cast("bigint").alias("savings_tokens"))


def compare_overall(m: DataFrame, digits: int = 6) -> DataFrame:
    """A11 overall: totals and counts with / without; NULL savings when the
    format was never used; a note when it was always used."""
    g = m.agg(F.sum(F.when(F.col("use_toon"), F.col("tokens_total"))).alias("w"),
              F.sum(F.when(~F.col("use_toon"), F.col("tokens_total"))).alias("wo"),
              F.count(F.when(F.col("use_toon"), 1)).alias("nw"),
              F.count(F.when(~F.col("use_toon"), 1)).alias("nwo"))
    used = F.col("nw") > 0
    has_without = F.col("nwo") > 0
    return g.select(
        F.when(used, F.coalesce("w", F.lit(0))).cast("bigint").alias("with_toon_tokens"),
        F.col("nw").cast("bigint").alias("with_toon_requests"),
        F.when(used & has_without, F.coalesce("wo", F.lit(0))).cast("bigint").alias("without_toon_tokens"),
        F.col("nwo").cast("bigint").alias("without_toon_requests"),
        F.when(used & has_without, F.when(F.coalesce("wo", F.lit(0)) > 0,
                                          F.round((F.col("wo") - F.col("w")) / F.col("wo") * 100.0, digits)).otherwise(F.lit(0.0)))
         .alias("overall_savings_percent"),
        F.when(used & has_without, (F.coalesce("wo", F.lit(0)) - F.coalesce("w", F.lit(0)))).cast("bigint").alias("overall_savings_tokens"),
        F.when(used & ~has_without, F.lit("TOON foi usado em todas as requisições. Não há comparação disponível."))
         .alias("note"))


# ------------------------------------------------------------- P29 / P30
def _first_nonzero(usage: Column, keys) -> Column:
    vals = [F.get_json_object(usage, f"$.{k}").cast("bigint") for k in keys]
    return F.coalesce(*[F.when(v != 0, v) for v in vals], F.lit(0).cast("bigint"))


def _nonempty_obj(js: Column) -> Column:
    return F.when(js.isNotNull() & (F.regexp_replace(js, r"\s", "") != "{}") & js.startswith("{"), js)


def usage_from_response(response) -> Column:
    """The usage object in priority order: llm_output.token_usage,
    kwargs.token_usage, response_metadata.token_usage, llm_output.usage /
    token_usage / tokenUsage, then the first generation carrying one."""
    r = F.col(response) if isinstance(response, str) else response
    gens = F.from_json(F.get_json_object(r, "$.generations"), "array<array<string>>")
    gen_usage = F.try_element_at(F.filter(F.transform(F.flatten(gens), lambda g: _nonempty_obj(
        F.get_json_object(g, "$.response_metadata.token_usage"))), lambda u: u.isNotNull()), F.lit(1))
    return F.coalesce(
        _nonempty_obj(F.get_json_object(r, "$.llm_output.token_usage")),
        F.when(F.get_json_object(r, "$.kwargs.token_usage").startswith("{"), F.get_json_object(r, "$.kwargs.token_usage")),
        _nonempty_obj(F.get_json_object(r, "$.response_metadata.token_usage")),
        F.when(F.get_json_object(r, "$.llm_output.usage").startswith("{"), F.get_json_object(r, "$.llm_output.usage")),
        F.when(F.get_json_object(r, "$.llm_output.tokenUsage").startswith("{"), F.get_json_object(r, "$.llm_output.tokenUsage")),
        gen_usage)


def parse_usage(usage) -> Column:
    """struct(prompt_tokens, completion_tokens, total_tokens) from a usage JSON object."""
    u = F.col(usage) if isinstance(usage, str) else usage
    p = _first_nonzero(u, ["prompt_tokens", "promptTokens", "input_tokens", "inputTokens"])
    c = _first_nonzero(u, ["completion_tokens", "completionTokens", "output_tokens", "outputTokens"])
    t_keys = [F.get_json_object(u, "$.total_tokens").cast("bigint"), F.get_json_object(u, "$.totalTokens").cast("bigint")]
    t = F.coalesce(*[F.when(v != 0, v) for v in t_keys], p + c)
    return F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens"), t.alias("total_tokens"))
