"""Indexed vector search and the upkeep of an index (V1, V2, V4, V6).

* Search: vectors are dealt into cells around centroids. The centroids are
  fitted by k-means on a sample of about ``SAMPLE`` rows (chosen by a hash of the
  id, so the same rows every time); every row is then assigned and stored with
  its cell. A query looks into its nearest cells only; how many is measured when the
  index is built, from the exact neighbours of a small sample of rows. An exact answer needs the
  cells that the ball around the query's k-th hit so far can touch: distance to the centroid
  less the cell's radius; so the exact way probes a few more cells, not all.
  What is broadcast is the centroids: at most ``MAX_CELLS`` vectors.
* Large cells are split into blocks of rows, many queries of a cell into blocks of
  queries; a task holds one block of each and keeps k hits per query, so neither a cell
  with a third of the rows nor a popular one lands in one task.
* Upkeep: the stored marks are joined with the marks of the documents; only new and
  changed ones are embedded and written, gone ones deleted, in a bucketed store.
* Long texts: windows of so many tokens are encoded one by one and averaged by their
  token counts, which is mean pooling over all tokens without a cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procweave.session import materialize
from procweave.sinks.bucket_store import BucketStore

#: Rows that fit the centroids (about).
SAMPLE = 20_000
#: Most cells.
MAX_CELLS = 4096
#: Rows (about) whose exact neighbours set the number of cells a search looks into, their neighbours, and the recall aimed at.
CALIBRATION_ROWS = 200
CALIBRATION_K = 10
CALIBRATION_RECALL = 0.95
#: Rows and queries of a block.
BLOCK_ROWS = 20_000
BLOCK_QUERIES = 2_000


# ------------------------------------------------------------- cells
def fit_centroids(vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding", cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Centroids, by default one per square root of the rows, from a sample of about :data:`SAMPLE` rows."""
    rows = vectors.count()
    if not rows:
        return np.zeros((0, 0))
    cells = max(1, min(MAX_CELLS, cells or round(rows ** 0.5)))
    part = max(1, rows // SAMPLE)
    sample = vectors.where(F.pmod(F.xxhash64(id_col), F.lit(part)) == 0).select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    sample = materialize(sample, "centroids")
    # a sample of few rows may hold none of a tiny table's
    used = sample if not sample.isEmpty() else vectors.limit(1).select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(used) if cells > 1 else None
    if model is None:
        return np.array([used.select(Summarizer.mean(F.col("features"))).first()[0].toArray()])
    return np.array(model.clusterCenters())


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed coordinate by coordinate."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        diff = a[:, None, j] - b[None, :, j]
        out += diff * diff
    return out


def assign(vectors: DataFrame, centroids: np.ndarray, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, vector, cell, distance) of every row: its nearest centroid (the first of equals) and the distance to it."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for whole in batches:
            for s in range(0, len(whole), 4096):
                pdf = whole.iloc[s:s + 4096]
                d = _distances(_matrix(pdf[vec_col]), centres)
                cell = d.argmin(axis=1)
                yield pd.DataFrame({id_col: pdf[id_col], vec_col: pdf[vec_col], "cell": cell.astype("int32"), "distance": np.sqrt(d[np.arange(len(d)), cell])})

    data = vectors.select(id_col, F.col(vec_col).cast("array<double>").alias(vec_col)).where(F.col(vec_col).isNotNull())
    return data.mapInPandas(run, f"`{id_col}` {kind}, `{vec_col}` array<double>, cell int, distance double")


class CellIndex:
    """Vectors stored by cell, with the centroids and radii to search them."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, id_col: str, vec_col: str, probes: int | None = None):
        self.rows, self.centroids, self.id_col, self.vec_col, self.probes = rows, centroids, id_col, vec_col, probes
        self.sizes, self.radii = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
        for cell, n, radius in rows.groupBy("cell").agg(F.count(F.lit(1)), F.max("distance")).collect():  # a row per cell
            self.sizes[cell], self.radii[cell] = n, radius

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding", cells: int | None = None, path: str | None = None) -> CellIndex:
        """Fit, assign every row, and store the rows ordered by cell (under ``path``, else in the job's folder)."""
        centroids = fit_centroids(vectors, id_col, vec_col, cells)
        rows = assign(vectors, centroids, id_col, vec_col).repartitionByRange("cell", F.xxhash64(id_col)).sortWithinPartitions("cell")
        if path is None:
            index = cls(materialize(rows, "cells"), centroids, id_col, vec_col)
            index.probes = index._calibrated()
            return index
        rows.write.mode("overwrite").parquet(f"{path}/rows")
        spark = vectors.sparkSession
        index = cls(spark.read.parquet(f"{path}/rows"), centroids, id_col, vec_col)
        index.probes = index._calibrated()
        (spark.createDataFrame([(i, c.tolist(), index.probes) for i, c in enumerate(centroids)], "cell int, centroid array<double>, probes int")
         .write.mode("overwrite").parquet(f"{path}/centroids"))
        return index

    @classmethod
    def open(cls, spark, path: str, id_col: str = "id", vec_col: str = "embedding") -> CellIndex:
        stored = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        return cls(spark.read.parquet(f"{path}/rows"), np.array([r["centroid"] for r in stored]), id_col, vec_col, stored[0]["probes"] if stored else None)

    def _calibrated(self) -> int:
        """Cells to look into so that :data:`CALIBRATION_RECALL` of the sample's neighbours (other rows) are found."""
        total = int(self.sizes.sum())
        filled = int((self.sizes > 0).sum())
        if filled <= 1:
            return filled
        part = F.pmod(F.xxhash64(self.id_col, F.lit(1)), F.lit(max(1, total // CALIBRATION_ROWS))) == 0
        sample = self.rows.where(part).select(F.col(self.id_col).alias("query_id"), F.col(self.vec_col))
        hits = materialize(self.search(sample, CALIBRATION_K, probes=max(1, filled // 4), exact=True, digits=None), "sample").where(F.col("query_id") != F.col(self.id_col))
        found = (hits.select("query_id", self.id_col).join(self.rows.select(self.id_col, "cell"), self.id_col)
                 .join(sample.withColumnRenamed(self.vec_col, "_qv"), "query_id").select("_qv", "cell").toPandas())  # the sample's neighbours
        if not len(found):
            return filled
        d = _distances(_matrix(found["_qv"]), self.centroids)
        d[:, self.sizes == 0] = np.inf
        own = d[np.arange(len(d)), found["cell"].to_numpy()]
        place = (d < own[:, None]).sum(axis=1)
        return int(np.sort(place)[min(len(place) - 1, int(np.ceil(CALIBRATION_RECALL * len(place))))]) + 1

    # ------------------------------------------------------------- search
    def _probe(self, queries: DataFrame, probes: int | None, skip: int) -> DataFrame:
        """(query_id, vector, cell) to look into: the cells number ``skip`` to ``probes`` by distance, or, with
        ``probes=None``, those after ``skip`` that the ball of radius ``reach`` around the query may touch."""
        shared = queries.sparkSession.sparkContext.broadcast((self.centroids, self.radii, self.sizes > 0))
        kind = queries.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres, radii, filled = shared.value
            for whole in batches:
                for s in range(0, len(whole), 1024):
                    pdf = whole.iloc[s:s + 1024]
                    d = np.sqrt(_distances(_matrix(pdf["_qv"]), centres))
                    d[:, ~filled] = np.inf
                    order = np.argsort(d, axis=1, kind="stable")
                    place = np.empty_like(order)
                    np.put_along_axis(place, order, np.broadcast_to(np.arange(d.shape[1]), d.shape), axis=1)
                    if probes is not None:
                        wanted = (place >= skip) & (place < probes)
                    else:
                        reach = pdf["reach"].to_numpy(dtype=np.float64)[:, None]
                        wanted = (place >= skip) & (d - radii[None, :] <= reach * (1 + 1e-9) + 1e-9)
                    q, c = np.nonzero(wanted & np.isfinite(d))
                    if len(q):
                        yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy(dtype=object)[q], "_qv": pdf["_qv"].to_numpy()[q], "cell": c.astype("int32")})

        return queries.mapInPandas(run, f"query_id {kind}, _qv array<double>, cell int")

    def _hits(self, probed: DataFrame, k: int) -> DataFrame:
        """The best ``k`` (query_id, id, squared distance) per query of every block of rows."""
        spark = probed.sparkSession
        per_cell = probed.groupBy("cell").agg(F.count(F.lit(1)).alias("asked")).toPandas()  # a row per cell
        blocks = spark.createDataFrame(
            [(int(c), max(1, -(-int(self.sizes[c]) // BLOCK_ROWS)), max(1, -(-int(n) // BLOCK_QUERIES))) for c, n in zip(per_cell["cell"], per_cell["asked"])],
            "cell int, row_blocks int, query_blocks int")
        blocks = F.broadcast(blocks)  # at most MAX_CELLS rows
        rows = (self.rows.select(self.id_col, F.col(self.vec_col).alias("_v"), "cell").join(blocks, "cell")
                .select("cell", F.pmod(F.xxhash64(self.id_col), F.col("row_blocks")).cast("int").alias("row_block"),
                        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), F.col(self.id_col).alias("_id"), "_v"))
        asked = (probed.join(blocks, "cell")
                 .select("cell", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("row_block"),
                         F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("query_block"), "query_id", "_qv"))
        keys = ["cell", "row_block", "query_block"]

        def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "_id": [], "d": []})
            left = left.sort_values("_id", kind="stable")
            ids, rows_, out = left["_id"].to_numpy(dtype=object), _matrix(left["_v"]), []
            names, asked_ = right["query_id"].to_numpy(dtype=object), _matrix(right["_qv"])
            step = max(1, 2_000_000 // len(ids))
            for s in range(0, len(names), step):
                d = _distances(asked_[s:s + step], rows_)
                top = np.argsort(d, axis=1, kind="stable")[:, :k]  # equal distances by ascending id
                out.append(pd.DataFrame({"query_id": np.repeat(names[s:s + step], top.shape[1]), "_id": ids[top.ravel()], "d": np.take_along_axis(d, top, 1).ravel()}))
            return pd.concat(out)

        schema = f"query_id {probed.schema['query_id'].dataType.simpleString()}, _id {self.rows.schema[self.id_col].dataType.simpleString()}, d double"
        return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(lambda a, b: best(b, a), schema)

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, exact: bool = False, threshold: float | None = None,
               digits: int | None = 4) -> DataFrame:
        """Top-``k`` of ``queries(query_id, embedding)``: (query_id, rank, id, similarity), similarity 1 - squared distance.

        ``probes`` nearest cells are searched, by default as many as the calibration found; ``exact`` then adds every
        cell that can hold a nearer row.
        """
        filled = int((self.sizes > 0).sum())
        probes = min(filled, probes or self.probes or filled)
        asked = materialize(queries.select("query_id", F.col(self.vec_col).cast("array<double>").alias("_qv")).where("_qv IS NOT NULL").distinct(), "asked")
        order = Window.partitionBy("query_id").orderBy("d", "_id")

        def top(frame: DataFrame) -> DataFrame:
            return frame.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        if not filled:
            found = asked.limit(0).select("query_id", F.lit(1).alias("rank"), F.lit(None).cast(self.rows.schema[self.id_col].dataType).alias("_id"), F.lit(0.0).alias("d"))
        else:
            found = top(self._hits(materialize(self._probe(asked, probes, 0), "probe"), k))
        if exact and filled > probes:
            first = materialize(found, "hits")
            last = first.where(F.col("rank") == k).select("query_id", F.sqrt("d").alias("reach"))
            wider = asked.join(last, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
            more = materialize(self._probe(wider, None, probes), "probe")
            found = top(first.select("query_id", "_id", "d").unionByName(self._hits(more, k)))
        out = found.withColumn("similarity", 1.0 - F.col("d"))
        if threshold is not None:
            out = out.where(F.col("similarity") >= threshold)
        if digits is not None:
            out = out.withColumn("similarity", F.round("similarity", digits))
        return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), F.col("_id").alias(self.id_col), "similarity")


def recall(approximate: DataFrame, exact: DataFrame, id_col: str = "id") -> DataFrame:
    """One row (queries, neighbours, found, recall) of an approximate answer against the exact one."""
    hit = exact.select("query_id", id_col).join(approximate.select("query_id", id_col, F.lit(1).alias("hit")), ["query_id", id_col], "left")
    return hit.agg(F.count_distinct("query_id").cast("bigint").alias("queries"), F.count(F.lit(1)).cast("bigint").alias("neighbours"),
                   F.count("hit").cast("bigint").alias("found")).withColumn("recall", F.round(F.col("found") / F.col("neighbours"), 4))


# ------------------------------------------------------------- upkeep
def document_mark(text="text"):
    """Version mark of a document: a hash of the text that is embedded."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def index_changes(documents: DataFrame, stored: DataFrame | None) -> DataFrame:
    """(node_id, action): new, changed, deleted or unchanged, from ``documents(node_id, mark)`` and the stored marks."""
    if stored is None:
        return documents.select("node_id", F.lit("new").alias("action"))
    both = documents.select("node_id", "mark").join(stored.select("node_id", F.col("mark").alias("had")), "node_id", "full")
    action = (F.when(F.col("had").isNull(), "new").when(F.col("mark").isNull(), "deleted")
              .when(F.col("had") != F.col("mark"), "changed").otherwise("unchanged"))
    return both.select("node_id", action.alias("action"))


def sync_index(documents: DataFrame, store: BucketStore, embed: Callable[[DataFrame], DataFrame], updated_at: str | None = None) -> DataFrame:
    """V2 + V6: bring an index up to date and return (action, node_type, n) of what was done.

    ``documents(node_id, node_type, text, ...)`` are those of all graph nodes. Only new and changed ones pass
    ``embed`` (which adds ``embedding``) and are written; gone ones are deleted; buckets without any stay as
    they are. The time of the graph (``updated_at``) is kept as the mark ``last_indexed``; a store whose mark is
    not older answers at once with no rows. Nothing is written if nothing changed.
    """
    marks = store.marks()
    if updated_at is not None and marks.get("last_indexed", "") >= updated_at:
        return documents.limit(0).select(F.lit("").alias("action"), "node_type", F.lit(0).cast("bigint").alias("n"))
    current = documents.withColumn("mark", document_mark())
    has = store.manifest()["schema"] is not None
    stored = store.read() if has else None
    changes = materialize(index_changes(current, stored), "changes")
    fresh = current.join(changes.where("action IN ('new', 'changed')").select("node_id"), "node_id", "left_semi")
    kinds = current.select("node_id", "node_type")
    if has:
        kinds = kinds.unionByName(stored.select("node_id", "node_type").join(changes.where("action = 'deleted'"), "node_id", "left_semi"))
    # read off before the store changes under the plan
    done = materialize(changes.join(kinds, "node_id").groupBy("action", "node_type").agg(F.count(F.lit(1)).cast("bigint").alias("n")), "done")
    note = {} if updated_at is None else {"last_indexed": updated_at}
    if not done.where("action <> 'unchanged'").isEmpty():
        store.upsert(embed(fresh), changes.where("action = 'deleted'").select("node_id"), note)
    elif note:
        store.upsert(fresh.limit(0), None, note)
    return done


# ------------------------------------------------------------- long texts
#: Tokens of a window.
WINDOW_TOKENS = 512


def text_windows(texts: DataFrame, id_col: str = "id", text_col: str = "text", size: int = WINDOW_TOKENS, pattern: str = r"\S+") -> DataFrame:
    """(id, window, n_tokens, text): every text cut into windows of ``size`` tokens; a text without tokens has one, empty."""
    tokens = texts.select(id_col, F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(f"({pattern})"), 1).alias("_t"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_t") - 1, F.lit(0)), F.lit(size))
    cut = tokens.select(id_col, "_t", F.explode(starts).alias("_s"))
    part = cut.select(id_col, (F.col("_s") / size).cast("int").alias("window"), F.slice("_t", F.col("_s") + 1, size).alias("_w"))
    return part.select(id_col, "window", F.size("_w").cast("bigint").alias("n_tokens"), F.array_join("_w", " ").alias("text"))


def pool_windows(encoded: DataFrame, id_col: str = "id", vec_col: str = "embedding", normalise: bool = True) -> DataFrame:
    """(id, embedding): mean of the windows' vectors weighted by their tokens, by default to unit length.

    A partial aggregate per text (:class:`~pyspark.ml.stat.Summarizer`): a text of many windows combines before the
    shuffle. A text without tokens has the zero vector.
    """
    weighted = encoded.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"), F.greatest("n_tokens", F.lit(1)).cast("double").alias("_n"))
    pooled = weighted.groupBy(id_col).agg(vector_to_array(Summarizer.mean(F.col("_v"), F.col("_n"))).alias(vec_col))
    if not normalise:
        return pooled
    length = F.sqrt(F.aggregate(F.transform(vec_col, lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    return pooled.withColumn(vec_col, F.when(length > 0, F.transform(vec_col, lambda x: x / length)).otherwise(F.col(vec_col)))


def embed_long(texts: DataFrame, encode: Callable[[DataFrame], DataFrame], id_col: str = "id", text_col: str = "text", size: int = WINDOW_TOKENS) -> DataFrame:
    """V1: embeddings of whole texts: ``encode`` adds ``embedding`` to the windows, which are pooled."""
    return pool_windows(encode(text_windows(texts, id_col, text_col, size)), id_col)


def token_hash_encoder(dim: int = 16) -> Callable[[list[str]], np.ndarray]:
    """An offline encoder: the mean over a text's tokens of a unit vector each (axis and sign by the token's MD5)."""
    def encode(texts: list[str]) -> np.ndarray:
        import hashlib

        out = np.zeros((len(texts), dim))
        known: dict[str, tuple[int, int]] = {}
        for row, text in enumerate(texts):
            tokens = text.split()
            for t in tokens:
                if t not in known:
                    digest = hashlib.md5(t.encode()).hexdigest()
                    known[t] = int(digest[:2], 16) % dim, 1 if int(digest[2], 16) < 8 else -1
                axis, sign = known[t]
                out[row, axis] += sign
            out[row] /= max(1, len(tokens))
        return out
    return encode
