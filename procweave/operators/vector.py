"""Embedding documents, exact vector search and hybrid graph search.

Similarity follows the vector store the original uses by default: squared L2
distance, ``similarity = 1 - distance`` (for unit vectors ``2cos - 1``);
``metric="cosine"`` gives cosine similarity.

* One query: similarity is a JVM-side higher-order expression over the
  embedding array; the top-k is ``orderBy(...).limit(k)`` which Spark runs as
  a per-partition top-k plus a small merge (no global sort).
* Many queries: the query set is counted and dealt into chunks of bounded
  bytes; each chunk is broadcast. Each task scores its documents against the
  broadcast query matrix with numpy and keeps only k candidates per query,
  so no (query, document) pair is ever materialised in Spark; a final
  ranking keeps k per query out of ``k x partitions`` candidates.
* Embedding: an offline hashing encoder (pyspark.ml, JVM only) by default;
  any model can be plugged in as a batch function run by ``mapInPandas``
  (Arrow batches of ``batch_size`` rows).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procweave.functions import constants as K
from procweave.functions.extract import cut


def _as_double_array(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(c, lambda x: x.cast("double"))


def l2_similarity(e, q) -> Column:
    """1 - sum((e_i - q_i)^2), summed left to right in DOUBLE."""
    diff = F.zip_with(_as_double_array(e), _as_double_array(q), lambda a, b: (a - b) * (a - b))
    return F.lit(1.0) - F.aggregate(diff, F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(e, q) -> Column:
    ea, qa = _as_double_array(e), _as_double_array(q)
    dot = F.aggregate(F.zip_with(ea, qa, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    ne = F.sqrt(F.aggregate(F.transform(ea, lambda a: a * a), F.lit(0.0), lambda acc, x: acc + x))
    nq = F.sqrt(F.aggregate(F.transform(qa, lambda a: a * a), F.lit(0.0), lambda acc, x: acc + x))
    return dot / (ne * nq)


def query_vector(values) -> Column:
    """A query embedding (one vector, parameter-sized) as a literal DOUBLE array."""
    return F.array(*[F.lit(float(v)) for v in values])


def search(docs: DataFrame, query_vec: Column, k: int = 5, threshold: float = 0.0, metric: str = "l2",
           id_col: str = "id", vec_col: str = "embedding", type_col: str | None = None,
           node_type: str | None = None, digits: int | None = 4) -> DataFrame:
    """V4/L2: top-k documents for one query vector (a Column, e.g. a scalar subquery).

    Filter on type and threshold first, then an exact top-k: no over-fetch.
    """
    d = docs
    if node_type is not None and type_col:
        d = d.filter(F.col(type_col) == node_type)
    sim = (l2_similarity if metric == "l2" else cosine_similarity)(F.col(vec_col), query_vec)
    scored = d.select(F.col(id_col).alias(id_col), sim.alias("similarity")).filter(F.col("similarity") >= threshold)
    top = scored.orderBy(F.desc("similarity"), F.asc(id_col)).limit(k)
    w = Window.orderBy(F.desc("similarity"), F.asc(id_col))  # k rows only
    out = top.withColumn("rank", F.row_number().over(w).cast("bigint"))
    if digits is not None:
        out = out.withColumn("similarity", F.round("similarity", digits))
    return out.select("rank", id_col, "similarity")


#: Cells of a (queries x documents) score matrix that a task holds at a time.
SCORE_CELLS = 2_000_000


def _score_partition(bq, k: int, threshold: float, metric: str, names: tuple[str, str, str]):
    query_name, id_name, vec_name = names

    def run(batches):
        qids, qmat = bq.value  # broadcast: shipped once per executor, not per task
        n_q = len(qids)
        rows = max(1, SCORE_CELLS // max(1, n_q))
        best_s = np.full((n_q, 0), -np.inf)
        best_i = np.zeros((n_q, 0), dtype=np.int64)  # positions in ``known``
        known = np.zeros(0, dtype=object)  # ids of the current candidates, ascending
        for pdf in (whole.iloc[s:s + rows] for whole in batches for s in range(0, len(whole), rows)):
            ids = pdf[id_name].to_numpy(dtype=object)
            mat = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec_name]])
            if metric == "l2":
                s = np.zeros((n_q, len(ids)))
                for j in range(mat.shape[1]):  # left-to-right sum, like the SQL form
                    diff = mat[None, :, j] - qmat[:, j, None]
                    s += diff * diff
                s = 1.0 - s
            else:
                s = (qmat @ mat.T) / (np.linalg.norm(qmat, axis=1)[:, None] * np.linalg.norm(mat, axis=1)[None, :])
            s = np.where(s >= threshold, s, -np.inf)
            merged, at = np.unique(np.concatenate([known, ids]), return_inverse=True)
            cand_s = np.concatenate([best_s, s], axis=1)
            cand_i = np.concatenate([at[:len(known)][best_i], np.broadcast_to(at[len(known):], s.shape)], axis=1)
            # order: similarity desc, id asc; keep k
            order = np.lexsort((cand_i, -cand_s), axis=1)[:, :k]
            best_s = np.take_along_axis(cand_s, order, axis=1)
            best_i = np.take_along_axis(cand_i, order, axis=1)
            kept, flat = np.unique(best_i, return_inverse=True)
            known, best_i = merged[kept], flat.reshape(best_i.shape)
        q, c = np.nonzero(np.isfinite(best_s))
        if len(q):
            yield pd.DataFrame({query_name: qids[q], id_name: known[best_i[q, c]], "similarity": best_s[q, c]})
    return run


def search_many(docs: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.0, metric: str = "l2",
                id_col: str = "id", vec_col: str = "embedding", max_bytes: int = 64 << 20,
                digits: int | None = 4) -> DataFrame:
    """Top-k per query for a set of query vectors ``queries(query_id, embedding)``; ids of any type.

    The query set is counted first and dealt by hash into as many chunks as
    keep a chunk's vectors under about ``max_bytes``; each chunk is broadcast
    and the documents are scored against it, so a broadcast stays bounded
    whatever the input. Repeated rows of the query set count once.
    """
    spark = docs.sparkSession
    q = queries.select("query_id", F.col(vec_col).alias("_qv")).distinct()
    size = q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("_qv")), F.lit(0))).first()
    chunks = max(1, -(-size[0] * (size[1] * 8 + 64) // max_bytes))
    d = docs.select(F.col(id_col), F.col(vec_col))
    schema = (f"query_id {q.schema['query_id'].dataType.simpleString()}, `{id_col}` {d.schema[id_col].dataType.simpleString()}, "
              "similarity double")
    cand = None
    for i in range(chunks):
        rows = q.filter(F.pmod(F.xxhash64("query_id", "_qv"), F.lit(chunks)) == i).collect()
        qids = np.empty(len(rows), dtype=object)
        qids[:] = [r["query_id"] for r in rows]
        qmat = np.array([np.asarray(r["_qv"], dtype=np.float64) for r in rows]).reshape(len(rows), -1)
        fn = _score_partition(spark.sparkContext.broadcast((qids, qmat)), k, threshold, metric, ("query_id", id_col, vec_col))
        part = d.mapInPandas(fn, schema)
        cand = part if cand is None else cand.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc(id_col))
    out = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    if digits is not None:
        out = out.withColumn("similarity", F.round("similarity", digits))
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), id_col, "similarity")


# ------------------------------------------------------------- embedding (V1)
def embed_hashing(df: DataFrame, text_col: str = "text", dim: int = 64, out_col: str = "embedding") -> DataFrame:
    """Offline encoder: lower-cased word tokens -> hashed term counts -> L2
    normalised dense ``array<float>``. Runs in the JVM (pyspark.ml)."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    tok = RegexTokenizer(inputCol="_text", outputCol="_tok", pattern=r"\W+", toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    norm = Normalizer(inputCol="_tf", outputCol="_nv", p=2.0)
    out = norm.transform(tf.transform(tok.transform(df.withColumn("_text", F.coalesce(text_col, F.lit(""))))))
    return out.withColumn(out_col, vector_to_array("_nv", "float32")).drop("_text", "_tok", "_tf", "_nv")


def embed_with(df: DataFrame, encoder: Callable[[list[str]], np.ndarray], text_col: str = "text",
               dim: int = 64, out_col: str = "embedding", batch_size: int = K.EMBED_BATCH) -> DataFrame:
    """Pluggable encoder hook: ``encoder(list_of_texts) -> (n, dim) array``,
    called once per ``batch_size`` rows inside the tasks."""
    schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, `{out_col}` array<float>"

    def run(batches):
        for whole in batches:  # cut into encoder batches here: the session's Arrow batch size stays as it is
            for s in range(0, len(whole), batch_size):
                pdf = whole.iloc[s:s + batch_size].copy()
                vecs = np.asarray(encoder(pdf[text_col].fillna("").tolist()), dtype=np.float32).reshape(len(pdf), dim)
                pdf[out_col] = list(vecs)
                yield pdf
    return df.mapInPandas(run, schema)


# ------------------------------------------------------------- documents
def _first(arr, n: int | None) -> Column:
    return arr if n is None else F.slice(arr, 1, n)


def _joined(arr, n: int | None) -> Column:
    return F.array_join(_first(F.sort_array(arr), n), ", ")


def code_document(analysis: DataFrame, max_params: int | None = None, max_callees: int | None = None,
                  max_tables: int | None = None, code_chars: int | None = None) -> DataFrame:
    """Embedding text of a procedure (name, schema, parameters, callees,
    tables, complexity, code), whole unless a number cuts a part
    (``K.DOC_*`` hold the original's numbers). Sets have no order in the
    original; here they are sorted."""
    params = F.transform(_first(F.col("parameters"), max_params),
                         lambda p: F.concat_ws(" ", p["name"], p["direction"], p["type"]))
    code = F.col("source_code")
    snippet = code if code_chars is None else F.when(
        F.length(code) > code_chars, F.concat(F.substring(code, 1, code_chars), F.lit("..."))).otherwise(code)
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Procedure: "), F.col("short_name")),
        F.concat(F.lit("Schema: "), F.col("schema")),
        F.when(F.size("parameters") > 0, F.concat(F.lit("Parameters: "), F.array_join(params, ", "))),
        F.when(F.size("calls") > 0, F.concat(F.lit("Calls: "), _joined(F.col("calls"), max_callees))),
        F.when(F.size("tables") > 0, F.concat(F.lit("Tables: "), _joined(F.col("tables"), max_tables))),
        F.concat(F.lit("Complexity: "), F.col("complexity_score").cast("string"), F.lit("/10")),
        F.concat(F.lit("\nCode:\n"), snippet))
    return analysis.select(F.col("id").alias("node_id"), F.lit("procedure").alias("node_type"),
                           "schema", F.col("short_name").alias("name"), text.alias("text"),
                           "complexity_score", F.size("calls").cast("bigint").alias("dependencies_count"),
                           F.size("tables").cast("bigint").alias("tables_count"),
                           F.length(code).cast("bigint").alias("code_length"))


def node_document(nodes: DataFrame, edges: DataFrame, columns: DataFrame | None = None, max_columns: int | None = None,
                  max_fks: int | None = None, logic_chars: int | None = None, max_params: int | None = None) -> DataFrame:
    """Embedding text of any graph node: type title, schema, purpose,
    columns (tables), FK targets, business logic, parameters, complexity when
    non-zero; whole unless a number cuts a part (``K.NODE_DOC_*``). Optional
    attributes are used when the node frame has them (``business_purpose``,
    ``business_logic``, ``parameters``); ``columns(table, column_name,
    data_type, ordinal)`` supplies table columns."""
    fk = (edges.filter(F.col("edge_type") == "references")
          .groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("fks")))
    n = nodes.join(fk, "id", "left")
    has = set(nodes.columns)
    if columns is not None:
        c = columns
        if max_columns is not None:
            # first columns by ordinal: a ranking filter, pre-limited per map task
            w = Window.partitionBy("table").orderBy("ordinal")
            c = c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_columns)
        c = (c.groupBy(F.col("table").alias("id"))
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column_name", "data_type"))),
                                           lambda x: F.concat_ws(" ", x["column_name"], x["data_type"])), ", ").alias("cols")))
        n = n.join(c, "id", "left")
    else:
        n = n.withColumn("cols", F.lit(None).cast("string"))
    purpose = F.col("business_purpose") if "business_purpose" in has else F.lit(None).cast("string")
    logic = F.col("business_logic") if "business_logic" in has else F.lit(None).cast("string")
    params = (F.array_join(F.transform(_first(F.col("parameters"), max_params), lambda p: p["name"]), ", ")
              if "parameters" in has else F.lit(None).cast("string"))
    title = F.concat(F.initcap(F.coalesce("node_type", F.lit("unknown"))), F.lit(": "), F.col("name"))
    text = F.concat_ws(
        "\n", title,
        F.when(F.col("schema").isNotNull(), F.concat(F.lit("Schema: "), F.col("schema"))),
        F.when(purpose.isNotNull() & (purpose != ""), F.concat(F.lit("Purpose: "), purpose)),
        F.when(F.col("cols").isNotNull(), F.concat(F.lit("Columns: "), F.col("cols"))),
        F.when(F.size(F.coalesce("fks", F.array())) > 0,
               F.concat(F.lit("References: "), F.array_join(_first(F.col("fks"), max_fks), ", "))),
        F.when(logic.isNotNull() & (logic != ""), F.concat(F.lit("Logic: "), cut(logic, logic_chars))),
        F.when(params.isNotNull() & (params != ""), F.concat(F.lit("Parameters: "), params)),
        F.when(F.coalesce("complexity_score", F.lit(0)) != 0,
               F.concat(F.lit("Complexity: "), F.col("complexity_score").cast("string"))))
    return n.select(F.col("id").alias("node_id"), "node_type", "schema", "name", text.alias("text"))


# ------------------------------------------------------------- hybrid
def neighbours(edges: DataFrame, ids: DataFrame, per_type: int | None = None) -> DataFrame:
    """J16 + A19: for each id, neighbours by edge type in both directions, in
    long form: a row per neighbour (``other``) with its number in name order
    (``pos``) and the neighbour count, so a hub's list is never one value.
    ``per_type`` keeps the first so many of each type."""
    ids = ids.select(F.col("node_id"))
    out_e = edges.select(F.col("src").alias("node_id"), "edge_type", F.col("dst").alias("other"))
    in_e = edges.select(F.col("dst").alias("node_id"), "edge_type", F.col("src").alias("other"))
    both = out_e.unionByName(in_e).join(ids, "node_id", "left_semi")
    counts = both.groupBy("node_id", "edge_type").agg(F.count(F.lit(1)).cast("bigint").alias("n_neighbours"))
    # with a rank filter Spark adds a partial WindowGroupLimit before the shuffle,
    # so a hub node ships at most per_type rows per map task
    w = Window.partitionBy("node_id", "edge_type").orderBy("other")
    listed = both.withColumn("pos", F.row_number().over(w).cast("bigint"))
    if per_type is not None:
        listed = listed.filter(F.col("pos") <= per_type)
    return listed.join(counts, ["node_id", "edge_type"])


def hybrid_search(docs: DataFrame, edges: DataFrame, query_vec: Column, k: int = 5, threshold: float = 0.0,
                  id_col: str = "node_id", vec_col: str = "embedding") -> DataFrame:
    """V5: semantic top-2k, first k of them, each expanded with its graph
    neighbours by edge type (rows ``(rank, node_id, similarity, edge_type,
    other, pos, n_neighbours)``)."""
    hits = search(docs, query_vec, 2 * k, threshold, id_col=id_col, vec_col=vec_col).filter(F.col("rank") <= k)
    nb = neighbours(edges, hits.select(F.col(id_col).alias("node_id")))
    return hits.withColumnRenamed(id_col, "node_id").join(nb, "node_id", "left")


def preview(text, n: int = K.PREVIEW_CHARS) -> Column:
    """First ``n`` characters plus '...' when longer (a preview beside the whole text)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


# ------------------------------------------------------------- upkeep (K6, V6, V7)
def stale(nodes: DataFrame, marker, ts_col: str = "updated_at") -> DataFrame:
    """V6: nodes changed after the last indexing marker (only those are re-embedded)."""
    m = F.lit(marker) if not isinstance(marker, Column) else marker
    return nodes.filter(F.col(ts_col) > m)


def statistics(docs: DataFrame) -> DataFrame:
    """V7: document count per node type and in total."""
    return (docs.groupBy(F.coalesce("node_type", F.lit("unknown")).alias("node_type"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("count")))
