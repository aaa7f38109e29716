"""Ranked lexical search by norm buckets of impact vectors.

Every item is a query against every document; the answer is exact. A
document's vector has, for each term of the queries, the impact
``p = (1000000000 * tf) div (1000 * tf + 12 * m)``, a query's vector the term's
weight times its count; the score is their inner product in 64-bit integers.
For the bounds the root of a term's weight goes to both sides, which leaves
products as they are and evens out the lengths.

1. One pass over the texts gives the documents' term counts over the query terms,
   and from these the number of documents and words and the terms' weights.
2. Impact vectors are ordered by length (norm) over all documents, longest first, and
   stored; neighbours in that order are the buckets.
3. The longest hundredth of the documents is searched first; a query's k-th best score
   there is its starting threshold.
4. All buckets are searched. Cauchy-Schwarz (longest document of the bucket times the
   query's length) skips buckets. Inside a bucket, a document whose cosine must reach c
   has, at each of the query's heaviest coordinates, a normalised value of at least
   ``q c - sqrt((1 - q^2)(1 - c^2))`` and, if q < c, at most ``q c + sqrt(...)``; what is left is bounded by the partial product
   of those coordinates and Cauchy-Schwarz over the others. Survivors are rescored
   exactly in integers and raise the task's threshold.
5. Tasks give at most k rows a query; a ranking window keeps the best k of all.

Bounds are floats with a margin and only ever keep a document too many; a bound equal
to the threshold keeps the document, since a smaller id may win a tie.

Queries go in blocks of about ``BLOCK_TERMS`` (query, term) entries, counted before
anything is broadcast, so a broadcast has that bound however many queries there are
(a block repeats the pass over the texts). What reaches the driver is a block's
queries, its terms' document counts and its thresholds. Vectors and ordered buckets are
tables in the shared folder, so a lost executor repeats tasks only. Equal lengths (copies)
are dealt further by id: no range of the order grows with a group of copies.

Defined results: a null or empty text has no terms, and an item or document without
terms is in no answer; repeated documents are ranked row by row (equal scores and ids
in any order, their rows being equal), repeated items are answered once each; null ids
come before others; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, stage

TOP = 20
#: (query, term) entries of a block of queries.
BLOCK_TERMS = 500_000
#: Most documents of a bucket, and its postings (about; one document at least).
BUCKET = 4096
BUCKET_POSTINGS = 1 << 21
#: Heaviest coordinates of a query whose bounds are looked at.
FOCUS = 4
#: Share of the documents, the longest ones, that give the starting thresholds.
SEED_SHARE = 0.01
#: Relative margin of the float bounds.
MARGIN = 1e-9

# Term characters are 0-9, A-Z, a-z and all beyond ASCII: in UTF-8 every other byte parts terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Queries:
    """A block of queries over numbered terms: keys, and per query its term numbers, integer weights and bounds."""

    def __init__(self, keys: list, counts: list[dict[int, int]], weights: np.ndarray):
        self.keys, self.weights = keys, weights
        self.terms, self.factors, self.focus = [], [], []
        self.norm = np.zeros(len(keys))
        for number, count in enumerate(counts):
            t = np.fromiter(count.keys(), np.int64, len(count))
            c = np.fromiter(count.values(), np.int64, len(count))
            t, c = t[weights[t] > 0], c[weights[t] > 0]
            share = c * np.sqrt(weights[t])
            order = np.argsort(-share, kind="stable")
            self.terms.append(t[order])
            self.factors.append((c * weights[t])[order])
            self.norm[number] = math.sqrt(float((share ** 2).sum()))
            self.focus.append(share[order][:FOCUS])


class Bucket:
    """Documents of one bucket by descending length: postings per term with integer impacts."""

    def __init__(self, keys: pa.Array, norm: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        self.keys, self.norm = keys, norm
        rows = np.repeat(np.arange(len(norm)), sizes)
        order = np.argsort(terms, kind="stable")  # rows stay ascending inside a term
        self.rows, self.impacts = rows[order], impacts[order]
        self.numbers, first = np.unique(terms[order], return_index=True)
        self.bounds = np.append(first, len(terms))
        self.place = {t: i for i, t in enumerate(self.numbers.tolist())}
        self.key_rank = pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()

    def column(self, term: int, at: np.ndarray) -> np.ndarray:
        """Impacts of a term in the (ascending) rows ``at``."""
        out = np.zeros(len(at), np.int64)
        i = self.place.get(term)
        if i is not None:
            a, b = self.bounds[i], self.bounds[i + 1]
            rows = self.rows[a:b]
            where = np.minimum(np.searchsorted(rows, at), len(rows) - 1)
            hit = rows[where] == at
            out[hit] = self.impacts[a:b][where[hit]]
        return out

    def survivors(self, queries: Queries, q: int, least: int) -> np.ndarray:
        """Rows whose bound reaches ``least``."""
        length = queries.norm[q]
        # Cauchy-Schwarz document by document: a prefix, since lengths descend
        n = int(np.searchsorted(-self.norm, -least * (1 - MARGIN) / length, side="right"))
        at = np.arange(n)
        if not n or least <= 0:
            return at
        cosine = min(1.0, least * (1 - MARGIN) / (length * self.norm[0]))
        partial, seen, used = np.zeros(n), np.zeros(n), 0.0
        for term, share in zip(queries.terms[q][:FOCUS].tolist(), queries.focus[q].tolist()):
            root = math.sqrt(queries.weights[term])
            value = self.column(term, at) * root
            along = share / length
            swing = math.sqrt(max(0.0, 1 - along * along) * max(0.0, 1 - cosine * cosine))
            unit = value / self.norm[at]
            keep = unit >= along * cosine - swing - MARGIN
            if along < cosine:  # else the coordinate's own direction is near enough
                keep &= unit <= along * cosine + swing + MARGIN
            at, value, partial, seen = at[keep], value[keep], partial[keep], seen[keep]
            partial += share * value
            seen += value * value
            used += share * share
            rest = math.sqrt(max(0.0, length * length - used))
            bound = partial + rest * np.sqrt(np.maximum(0.0, self.norm[at] ** 2 - seen)) + MARGIN * length * self.norm[at]
            keep = bound * (1 + MARGIN) >= least
            at, partial, seen = at[keep], partial[keep], seen[keep]
            if not len(at):
                break
        return at

    def scores(self, queries: Queries, q: int, at: np.ndarray) -> np.ndarray:
        """Exact scores of rows."""
        out = np.zeros(len(at), np.int64)
        for term, factor in zip(queries.terms[q].tolist(), queries.factors[q].tolist()):
            out += factor * self.column(term, at)
        return out


class Best:
    """The best ``k`` (score, key) of every query, and the score a document must reach."""

    def __init__(self, queries: Queries, least: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.least = least.copy()
        self.rows: list[list[tuple]] = [[] for _ in queries.keys]

    def search(self, bucket: Bucket) -> None:
        queries = self.queries
        reach = queries.norm * bucket.norm[0] * (1 + MARGIN)
        for q in np.flatnonzero((reach >= self.least) & (queries.norm > 0)).tolist():
            at = bucket.survivors(queries, q, int(self.least[q]))
            if not len(at):
                continue
            score = bucket.scores(queries, q, at)
            good = np.flatnonzero(score >= max(1, self.least[q]))
            if len(good) > self.k:
                good = good[np.lexsort((bucket.key_rank[at[good]], -score[good]))[:self.k]]
            if len(good):
                new = zip(score[good].tolist(), bucket.keys.take(pa.array(at[good])).to_pylist())
                rows = sorted([*self.rows[q], *new], key=lambda r: (-r[0], r[1] is not None, r[1]))[:self.k]
                self.rows[q] = rows
                if len(rows) == self.k:
                    self.least[q] = max(self.least[q], rows[-1][0])


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(key, n, terms, tfs) of every document with a term; terms only those of ``vocabulary``, ascending."""
    kind = docs.schema["_key"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in chunks(batches, "_text", 4 << 20):
            sizes, terms, counts, n, rows = [], [], [], [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = terms_of(text or b"")
                if words:
                    found = Counter(map(number, words))
                    found.pop(None, None)
                    terms += found
                    counts += found.values()
                    sizes.append(len(found))
                    n.append(len(words))
                    rows.append(row)
            if rows:
                bounds = pa.array(np.cumsum([0, *sizes]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(n, pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(terms, pa.int32())),
                     pa.ListArray.from_arrays(bounds, pa.array(counts, pa.int64()))], names=["key", "n", "terms", "tfs"])

    return docs.mapInArrow(work, f"key {kind}, n long, terms array<int>, tfs array<long>")


def _impacts(vectors: DataFrame, n_docs: int, n_terms: int, weights) -> DataFrame:
    """(key, norm, terms, impacts) of every document whose vector has a length."""
    kind = vectors.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value.weights
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            terms, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            m = 75 + (25 * batch.column(1).to_numpy() * n_docs) // n_terms
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, sizes))
            keep = w[terms] > 0
            row = np.repeat(np.arange(len(sizes)), sizes)[keep]
            terms, impact = terms[keep], impact[keep]
            norm = np.sqrt(np.bincount(row, w[terms] * impact.astype(np.float64) ** 2, len(sizes)))
            some = np.flatnonzero(norm > 0)
            left = np.bincount(row, minlength=len(sizes))
            bounds = pa.array(np.cumsum(np.concatenate([[0], left])), pa.int32())
            rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(norm), pa.ListArray.from_arrays(bounds, pa.array(terms)),
                                               pa.ListArray.from_arrays(bounds, pa.array(impact))], names=["key", "norm", "terms", "impacts"])
            yield rows.take(pa.array(some))

    return vectors.mapInArrow(work, f"key {kind}, norm double, terms array<int>, impacts array<long>")


def _search(ordered: DataFrame, shared, least: np.ndarray, k: int, item_kind: str, bucket: int) -> DataFrame:
    """At most ``k`` rows (query, item, key, score) of every query and task."""
    kind = ordered.schema["key"].dataType.simpleString()
    start = ordered.sparkSession.sparkContext.broadcast(least)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best, key_type = Best(queries, start.value, k), pa.null()
        for batch in batches:
            key_type = batch.column(0).type
            bounds = batch.column(2).offsets.to_numpy()
            a = 0
            while a < batch.num_rows:
                b = int(np.searchsorted(bounds, bounds[a] + BUCKET_POSTINGS))
                part = batch.slice(a, max(1, min(bucket, b - a)))
                a += part.num_rows
                norm = part.column(1).to_numpy()
                order = np.argsort(-norm, kind="stable")  # a task may read more than one stretch of the order
                if (order[1:] < order[:-1]).any():
                    part, norm = part.take(pa.array(order)), norm[order]
                lists = part.column(2)
                best.search(Bucket(part.column(0), norm, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(),
                                   part.column(3).flatten().to_numpy()))
        rows = [(q, queries.keys[q], key, score) for q, found in enumerate(best.rows) for score, key in found]
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1]), pa.array(cols[2], key_type), pa.array(cols[3], pa.int64())],
                                             names=["query", "item", "key", "score"])

    return ordered.mapInArrow(work, f"query int, item {item_kind}, key {kind}, score long")


def _query_blocks(items: DataFrame, block_terms: int) -> Iterator[DataFrame]:
    """Tables (item, term, count, row) of the blocks of queries."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.regexp_extract_all(F.translate("_text", upper, lower), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    entries = stage(items.distinct().select("_item", F.xxhash64("_item", "_text").alias("row"), "_text")
                    .select("_item", "row", F.explode(words).alias("term")).groupBy("_item", "row", "term").count(), "queries")
    total = entries.count()
    blocks = max(1, -(-total // block_terms))
    while True:
        dealt = entries.withColumn("block", F.pmod(F.xxhash64("_item", "row"), F.lit(blocks)))
        most, queries = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_item", "row").alias("q")).agg(F.max("n"), F.max("q")).first()
        if (most or 0) <= 2 * block_terms or queries <= 1 or blocks >= total:
            break
        blocks *= 2
    for number in range(blocks):
        yield dealt.where(F.col("block") == number)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
           top: int = TOP, block_terms: int = BLOCK_TERMS, bucket: int = BUCKET) -> DataFrame:
    """One row per answer: item key, rank (from 1, highest score first, then smallest id), document key, score."""
    spark = docs.sparkSession
    data = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    wanted = items.select(F.col(item_key).alias("_item"), F.col(item_text).cast("string").alias("_text"))
    item_kind = wanted.schema["_item"].dataType.simpleString()
    found = []
    for block in _query_blocks(wanted, block_terms):
        entries = block.select("_item", "row", "term", "count").toArrow()
        if not entries.num_rows:
            continue
        vocabulary: dict[bytes, int] = {}
        counts: dict[tuple, dict[int, int]] = {}
        for item, row, term, count in zip(*(c.to_pylist() for c in entries.columns)):
            counts.setdefault((item, row), {})[vocabulary.setdefault(term.encode(), len(vocabulary))] = count
        vectors = stage(_vectors(data, vocabulary), "vectors")
        n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(vocabulary), np.int64)
        held = vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # at most the block's terms
        df[held.column(0).to_numpy()] = held.column(1).to_numpy()
        weights = np.array([weight(n_docs, int(d)) for d in df], np.int64)
        shared = spark.sparkContext.broadcast(Queries([i for i, _ in counts], list(counts.values()), weights))
        # longest first; equal lengths go on by id, so copies are dealt over many ranges
        impacts = stage(_impacts(vectors, n_docs, n_terms, shared), "impacts")
        by_length = [F.col("norm").desc(), F.xxhash64("key")]
        ordered = stage(impacts.repartitionByRange(*by_length).sortWithinPartitions(*by_length), "ordered")
        least = np.zeros(len(counts), np.int64)
        seed = ordered.agg(F.percentile_approx("norm", 1 - SEED_SHARE, 10_000)).first()[0]
        if seed is None:
            continue
        first = _top(_search(ordered.where(F.col("norm") >= seed), shared, least, top, item_kind, bucket), top)
        full = first.where(F.col("rank") == top).select("query", "score").toArrow()  # one row a query of the block
        least[full.column(0).to_numpy()] = full.column(1).to_numpy()
        found.append(_top(_search(ordered, shared, least, top, item_kind, bucket), top))
    if not found:
        kind = data.schema["_key"].dataType.simpleString()
        return spark.createDataFrame([], f"`{item_key}` {item_kind}, rank int, `{key}` {kind}, score long")
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out.select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("key"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
