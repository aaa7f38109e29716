"""Language-model steps around the data: prompts, batches, calls, parsing.

Only the model call itself is Python (a user-supplied client run by
``mapInPandas`` on Arrow batches). Everything before it (text cuts, prompt
fill, batch numbering) and after it (fence stripping, JSON parsing, score
extraction, name matching, fallbacks) is native Spark expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procweave.functions import constants as K
from procweave.functions.extract import cut
from procweave.functions.scoring import code_complexity, repair_score

# Prompt templates (ours; the wording only steers the model). {code}, {name},
# {ddl}, {columns} are filled with whole texts, or cut ones when a number is given.
TEMPLATES = {
    "business_logic": "Describe the business logic of procedure {name}.\nCode:\n{code}",
    "dependencies": "List the procedures and tables used by this code as JSON.\nCode:\n{code}",
    "complexity": "Rate the complexity of this code from 1 to 10. Answer with the number.\nCode:\n{code}",
    "table_purpose": "Describe the purpose of table {name}.\nColumns: {columns}\nDDL:\n{ddl}",
}
JSON_OBJECT_PATTERN = r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"


def prompt(kind: str, name=None, code=None, ddl=None, columns=None, max_chars: int | None = None,
           max_columns: int | None = None) -> Column:
    """Fill a template with the code, DDL and column names; whole, or cut to
    ``max_chars`` characters (``K.MAX_CODE_LENGTH_*``) and ``max_columns`` names
    where a model's context asks for it."""
    parts = TEMPLATES[kind].split("{")
    out = [F.lit(parts[0])]
    values = {
        "name": name,
        "code": cut(code, max_chars) if code is not None else None,
        "ddl": cut(ddl, max_chars) if ddl is not None else None,
        "columns": F.array_join(columns if max_columns is None else F.slice(columns, 1, max_columns), ", ") if columns is not None else None,
    }
    for p in parts[1:]:
        key, rest = p.split("}", 1)
        out.append(F.coalesce(values[key], F.lit("")))
        out.append(F.lit(rest))
    return F.concat(*out)


def assign_batches(df: DataFrame, order_col: str, size: int = 5, bucket: Column | None = None,
                   n_buckets: int = 4096) -> DataFrame:
    """Groups of ``size`` rows for grouped prompts.

    Numbering runs inside buckets (``bucket`` column, e.g. a hash or key
    modulo), never over one global window, so a single task never has to
    rank the whole input. ``batch_id = bucket:floor((rank-1)/size)``.
    """
    b = bucket if bucket is not None else F.pmod(F.xxhash64(order_col), F.lit(n_buckets))
    w = Window.partitionBy("_bucket").orderBy(order_col)
    out = df.withColumn("_bucket", b).withColumn("_rn", F.row_number().over(w))
    return (out.withColumn("batch_id", F.concat_ws(":", F.col("_bucket").cast("string"),
                                                   F.floor((F.col("_rn") - 1) / size).cast("string")))
            .withColumn("batch_pos", ((F.col("_rn") - 1) % size).cast("int")).drop("_bucket", "_rn"))


def strip_fences(text) -> Column:
    """Trim; when it starts with ```, drop the first line and a closing ``` line."""
    t = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"^\s+|\s+$", "")
    body = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*(\n|$)", ""), r"\n\s*```\s*$", "")
    return F.when(t.startswith("```"), body).otherwise(t)


def parse_object(text) -> Column:
    """JSON object text -> map<string,string> (NULL when not an object)."""
    return F.from_json(strip_fences(text), "map<string,string>")


def first_json_object(text) -> Column:
    """First ``{...}`` (at most one nested level) that parses as JSON, else NULL."""
    t = F.col(text) if isinstance(text, str) else text
    cands = F.regexp_extract_all(t, F.lit(JSON_OBJECT_PATTERN), 0)
    return F.try_element_at(F.filter(cands, lambda c: F.try_parse_json(c).isNotNull()), F.lit(1))


def score_from_response(response, code) -> Column:
    """P25 + P26: score found in the model's text, else the code heuristic; out of 1..10 -> 5."""
    r = F.col(response) if isinstance(response, str) else response
    parsed = F.regexp_extract(r, K.SCORE_IN_TEXT_PATTERN, 1)
    return repair_score(F.coalesce(F.when(parsed != "", parsed.cast("bigint")), code_complexity(code)))


def union_dependencies(regex_deps, llm_deps) -> Column:
    """Regex set united with the model's list when the latter is present."""
    return F.when(llm_deps.isNotNull(), F.array_union(regex_deps, llm_deps)).otherwise(regex_deps)


def match_purposes(batch_tables: DataFrame, answers: DataFrame, n_columns_col: str = "n_columns") -> DataFrame:
    """Attach each table's purpose from its batch's parsed answer.

    ``batch_tables(batch_id, table, full_name, n_columns)``,
    ``answers(batch_id, key, purpose)``. Priority: key == full name, key ==
    table name, else the first key (by key order) where one name contains
    the other; the contains test only pairs rows of the same batch (an
    equi-join on ``batch_id`` bounds it by the batch size). Tables left
    without a purpose get the default sentence.
    """
    t = batch_tables.alias("t")
    a = answers.alias("a")
    j = t.join(a, "batch_id")
    prio = (F.when(F.col("a.key") == F.col("t.full_name"), 0)
            .when(F.col("a.key") == F.col("t.table"), 1)
            .when(F.col("t.table").contains(F.col("a.key")) | F.col("a.key").contains(F.col("t.table")), 2))
    cand = j.select("batch_id", "t.table", prio.alias("prio"), "a.key", "a.purpose").filter(F.col("prio").isNotNull())
    best = cand.groupBy("batch_id", "table").agg(F.min(F.struct("prio", "key", "purpose")).alias("b"))
    out = batch_tables.join(best, ["batch_id", "table"], "left")
    before, between, after = map(F.lit, K.DEFAULT_PURPOSE)
    default = F.concat(before, F.col("table"), between, F.col(n_columns_col).cast("string"), after)
    return out.select("batch_id", "table", F.coalesce(F.col("b.purpose"), default).alias("purpose"),
                      F.col("b.prio").isNull().alias("used_default"))


def call_model(df: DataFrame, client: Callable[[list[str]], list[str]], prompt_col: str = "prompt",
               out_col: str = "response", batch_size: int = 5) -> DataFrame:
    """X3 + X4: run a user model client over batches of ``batch_size`` prompts.

    The client takes a list of prompts and returns one text per prompt. A
    failing batch is retried prompt by prompt; a prompt that still fails gets
    NULL and its message in ``error``. Runs inside the tasks, so calls are
    spread over the cluster instead of a two-thread pool.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out_col}` string, `error` string"

    def run(batches):
        # cut into prompt batches here: the session's Arrow batch size stays as it is
        for pdf in (whole.iloc[s:s + batch_size] for whole in batches for s in range(0, len(whole), batch_size)):
            prompts = pdf[prompt_col].fillna("").tolist()
            try:
                res = list(client(prompts))
                if len(res) != len(prompts):
                    raise ValueError("client returned a different number of answers")
                errs = [None] * len(prompts)
            except Exception:  # noqa: BLE001 - fall back to single prompts
                res, errs = [], []
                for p in prompts:
                    try:
                        res.append(client([p])[0])
                        errs.append(None)
                    except Exception as ex:  # noqa: BLE001
                        res.append(None)
                        errs.append(str(ex))
            out = pdf.reset_index(drop=True)
            out[out_col] = pd.Series(res, dtype=object)
            out["error"] = pd.Series(errs, dtype=object)
            yield out
    return df.mapInPandas(run, schema)


def stub_client(prompts: list[str]) -> list[str]:
    """Deterministic offline client for tests: echoes a score and a summary."""
    return [f"Complexity {(len(p) % 10) + 1}. Summary: {p[:40]}" for p in prompts]
