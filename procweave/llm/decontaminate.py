"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared lower-cased with white space runs as one space. A benchmark
item is searched as probes: the whole item, or, if it is longer than ``PROBE``
characters, overlapping windows of that length. A probe of L characters is in a
document when it aligns to a stretch of it with at most e = rate * L edits.

By the q-gram lemma such a stretch shares at least T = L + 1 - q (e + 1) q-grams
with the probe, on diagonals that lie within e of each other. Shared q-grams are
counted per probe in diagonal bands of width 2 (e + 1) that overlap by half, so
one band holds them all; bands with fewer than T are dropped. The most frequent
q-grams of a probe may be left out of the index, each lowering its T by one, so
the bound stays exact. What is left is verified by a banded alignment (free
ends on the text side, all candidates of a batch at once).

The benchmark is read in shards of at most ``SHARD_CHARS`` characters (its size
is summed first); each shard's index is broadcast and the documents are scanned
once per shard. A probe too short for the lemma to ask for one shared q-gram at
its budget (13 to 15 characters at the default rate) is cut into e + 1 pieces,
one of which a match holds unchanged; the probe is aligned around every place of
a piece. A probe shorter than q is searched exactly.

Defined results: null and empty texts and items match nothing; repeated
documents and items are treated row by row; an empty benchmark marks nothing;
texts of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, free_name

Q = 8
RATE = 0.08
PROBE = 128
SHARD_CHARS = 16_000_000
CHUNK_CHARS = 1 << 20
MIN_SHARED = 6

_MUL = np.random.default_rng(77).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_TABLE_BITS = 21


def normalise(text: str) -> str:
    return " ".join(text.lower().replace("\0", " ").split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all Q-grams (Q = 8: three doublings)."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * _MUL[0]
    for k, size in enumerate((1, 2, 4)):
        if len(h) <= size:
            return h[:0]
        a = h[:-size] * _MUL[2 * k + 1]
        a ^= a >> np.uint64(31)
        h = a + h[size:] * _MUL[2 * k + 2]
    return h ^ (h >> np.uint64(29))


class Index:
    """Probes of a benchmark shard and their q-gram postings."""

    def __init__(self, items: list[tuple], rate: float = RATE, probe: int = PROBE):
        self.rows: list = []  # item of every probe
        self.texts: list[str] = []
        for n, (_, text) in enumerate(items):
            clean = normalise(text or "")
            if not clean:
                continue
            starts = [0] if len(clean) <= probe else [*range(0, len(clean) - probe, probe // 2), len(clean) - probe]
            for s in starts:
                self.rows.append(n)
                self.texts.append(clean[s:s + probe] if len(clean) > probe else clean)
        self.items = [i for i, _ in items]
        self.short = [p for p, t in enumerate(self.texts) if len(t) < Q]
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.where(sizes < Q, 0, (sizes * rate).astype(np.int64))
        # budgets for which the lemma asks for no shared q-gram: these probes are searched by (offset, piece)
        self.pieces: dict[int, list[tuple[int, str]]] = {}
        for p in np.flatnonzero((sizes >= Q) & (self.edits > sizes // Q - 1)).tolist():
            cuts = np.linspace(0, sizes[p], int(self.edits[p]) + 2).astype(int).tolist()
            self.pieces[p] = [(a, self.texts[p][a:b]) for a, b in zip(cuts, cuts[1:])]
        self.least = sizes + 1 - Q * (self.edits + 1)
        self.band = self.edits + 1
        grams = [_grams(_codes("" if p in self.pieces else t)) for p, t in enumerate(self.texts)]
        if grams:
            h = np.concatenate(grams)
            p = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            o = np.concatenate([np.arange(len(g)) for g in grams])
        else:
            h, p, o = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(h):
            _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
            common = counts[inverse]
            order = np.lexsort((-common, p))  # a probe's most frequent grams first
            rank = np.empty(len(h), np.int64)
            rank[order] = np.arange(len(h)) - np.searchsorted(p[order], p[order])
            spare = np.maximum(0, self.least - np.maximum(MIN_SHARED, self.least // 3))
            drop = (rank < spare[p]) & (common > 2)
            self.least = self.least - np.bincount(p[drop], minlength=len(self.texts))
            h, p, o = h[~drop], p[~drop], o[~drop]
        order = np.argsort(h, kind="stable")
        self.hashes, first = np.unique(h[order], return_index=True)
        self.bounds = np.concatenate([first, [len(h)]])
        self.probe, self.offset = p[order], o[order]
        self.seen = np.zeros(1 << _TABLE_BITS, bool)
        self.seen[(self.hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.gap = "\0" * (int(self.edits.max(initial=0)) + 2)

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, first diagonal of the band) of all bands that share enough q-grams."""
        none = np.zeros(0, np.int64)
        grams = _grams(codes)
        if not len(grams) or not len(self.hashes):
            return none, none
        at = np.flatnonzero(self.seen[(grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        place = np.searchsorted(self.hashes, grams[at])
        hit = self.hashes[np.minimum(place, len(self.hashes) - 1)] == grams[at]
        at, place = at[hit], place[hit]
        size = self.bounds[place + 1] - self.bounds[place]
        ends = np.cumsum(size)
        if not len(ends):
            return none, none
        post = np.repeat(self.bounds[place] - (ends - size), size) + np.arange(ends[-1])
        probe = self.probe[post]
        diagonal = np.repeat(at, size) - self.offset[post] + 2 * PROBE  # never negative
        band = diagonal // self.band[probe]
        width = np.int64(len(codes) + 4 * PROBE + 4)
        keys = np.concatenate([probe * width + band, probe * width + band - 1])
        # counts by a hashed key are never below the true ones: most bands go here
        slot = (keys.astype(np.uint64) * _MUL[7] >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        both = np.concatenate([probe, probe])
        keys = keys[np.bincount(slot, minlength=1 << _TABLE_BITS)[slot] >= self.least[both]]
        keys, counts = np.unique(keys, return_counts=True)
        probe, band = keys // width, keys % width
        enough = counts >= self.least[probe]
        probe, band = probe[enough], band[enough]
        return probe, band * self.band[probe] - 2 * PROBE

    def piece_candidates(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(probe, first diagonal of the band) around every place of a piece."""
        found: set[tuple[int, int]] = set()
        for p, pieces in self.pieces.items():
            for offset, piece in pieces:
                at = text.find(piece)
                while at >= 0:
                    found.add((p, at - offset - int(self.edits[p])))
                    at = text.find(piece, at + 1)
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    def verify(self, codes: np.ndarray, probe: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end of the match) of the best alignment within the band of each candidate."""
        n = len(probe)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.array([len(self.texts[p]) for p in probe])
        width = int(2 * self.band[probe].max()) + 1
        pattern = np.zeros((n, sizes.max()), np.uint32)
        for i, p in enumerate(probe):
            pattern[i, :sizes[i]] = _codes(self.texts[p])
        padded = np.concatenate([np.zeros(2 * PROBE, np.uint32), codes, np.zeros(width + int(sizes.max()) + 2 * PROBE, np.uint32)])
        lane = np.arange(width)
        far = np.int64(1 << 20)
        outside = lane[None, :] >= (2 * self.band[probe])[:, None]
        row = np.where(outside, far, 0)  # the alignment may start on any diagonal of the band
        best, end = np.full(n, far), np.zeros(n, np.int64)
        for j in range(sizes.max()):
            text = padded[(diagonal + 2 * PROBE + j)[:, None] + lane[None, :]]
            step = row + (text != pattern[:, j:j + 1])  # same diagonal
            skip = np.concatenate([row[:, 1:], np.full((n, 1), far)], axis=1) + 1  # a probe character left out
            row = np.minimum(step, skip)
            row = np.minimum(row, np.minimum.accumulate(row - lane, axis=1) + lane)  # text characters added
            row[outside] = far
            over = sizes == j + 1
            if over.any():
                least = row[over].argmin(axis=1)
                best[over] = row[over, least]
                end[over] = diagonal[over] + j + 1 + least
        return best, end


def _scan(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, from, to) of the best match of every item found in every normalised text."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}

    def add(row: int, p: int, edits: int, end: int) -> None:
        key, value = (row, index.rows[p]), (edits, max(0, end - len(index.texts[p])), end)
        if key not in found or value < found[key]:
            found[key] = value

    group: list[int] = []
    held = 0

    def run() -> None:
        starts, parts, at = [], [], 0
        for i in group:
            starts.append(at)
            parts.append(texts[i])
            at += len(texts[i]) + len(index.gap)
        codes = _codes(index.gap.join(parts))
        probe, diagonal = index.candidates(codes)
        for s in range(0, len(probe), 512):
            p, d = probe[s:s + 512], diagonal[s:s + 512]
            edits, end = index.verify(codes, p, d)
            for k in np.flatnonzero(edits <= index.edits[p]):
                which = int(np.searchsorted(starts, end[k] - 1, side="right")) - 1
                add(group[which], int(p[k]), int(edits[k]), int(end[k]) - starts[which])

    for i, text in enumerate(texts):
        for p in index.short:
            at = text.find(index.texts[p])
            if at >= 0:
                add(i, p, 0, at + len(index.texts[p]))
        if index.pieces and text:
            probe, diagonal = index.piece_candidates(text)
            codes = _codes(text) if len(probe) else None
            for s in range(0, len(probe), 512):
                p, d = probe[s:s + 512], diagonal[s:s + 512]
                edits, end = index.verify(codes, p, d)
                for k in np.flatnonzero(edits <= index.edits[p]):
                    add(i, int(p[k]), int(edits[k]), min(int(end[k]), len(text)))
        if len(text) >= Q:
            group.append(i)
            held += len(text)
        if held >= CHUNK_CHARS:
            run()
            group, held = [], 0
    if group:
        run()
    return [(row, item, *value) for (row, item), value in sorted(found.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
               item_text: str = "text", rate: float = RATE, shard_chars: int = SHARD_CHARS,
               carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per (document, item found): key, carried columns, item, edits, lo, hi (in the normalised text)."""
    spark = docs.sparkSession
    total = benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0
    shards = max(1, -(-total // shard_chars))
    names = [key, *carry]
    data = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.col(text).cast("string").alias("_text"))
    at, kept = len(names), [f"k{i}" for i in range(len(names))]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in data.schema.fields[:at])
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    item_kind = benchmark.schema[item].dataType.simpleString()
    out = None
    for shard in range(shards):
        own = items if shards == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(shards)) == shard)
        shared = spark.sparkContext.broadcast(Index([tuple(r) for r in own.collect()], rate))  # shard_chars characters

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in chunks(batches, "_text", 4 << 20):
                rows = _scan([normalise(t) if t else "" for t in batch.column(at).to_pylist()], index)
                if rows:
                    row, which, edits, lo, hi = zip(*rows)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(take) for c in batch.columns[:at]), pa.array([index.items[w] for w in which], pa.string()),
                         *(pa.array(c, pa.int64()) for c in (edits, lo, hi))], names=[*kept, "item", "edits", "lo", "hi"])

        part = data.mapInArrow(run, f"{kinds}, item string, edits long, lo long, hi long")
        out = part if out is None else out.unionByName(part)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], F.col("item").cast(item_kind).alias(item), "edits", "lo", "hi")


def judge(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row: key, contaminated, kept, n_items, items (ids, comma-joined), least_edits."""
    marked = docs.select(F.col(key), F.col(text), F.xxhash64(F.col(text)).alias("_llm_hash"))
    leaks = find_leaks(marked, benchmark, key, text, carry=("_llm_hash",), **options)
    item = options.get("item", "item_id")
    by_row = (leaks.select(F.col(key).alias("_k"), F.col("_llm_hash").alias("_h"), F.col(item).alias("_i"), "edits").distinct()
              .groupBy("_k", "_h").agg(F.countDistinct("_i").cast("long").alias("n_items"),
                                       F.array_join(F.array_sort(F.collect_set(F.col("_i"))).cast("array<string>"), ",").alias("items"),
                                       F.min("edits").alias("least_edits")))
    keyed = marked.select(key, "_llm_hash")
    joined = keyed.join(by_row, keyed[key].eqNullSafe(by_row["_k"]) & (keyed["_llm_hash"] == by_row["_h"]), "left")
    found = F.col("n_items").isNotNull()
    return joined.select(key, found.alias("contaminated"), (~found).alias("kept"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                         F.coalesce("items", F.lit("")).alias("items"), "least_edits")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    mark = free_name(docs)
    marked = docs.withColumn(mark, F.xxhash64(F.col(text)))
    leaks = (find_leaks(marked, benchmark, key, text, carry=(mark,), **options)
             .select(F.col(key).alias("k"), F.col(mark).alias("h")).distinct())
    return (marked.join(leaks, marked[key].eqNullSafe(leaks["k"]) & (marked[mark] == leaks["h"]), "left_anti")
            .select(*[marked[c] for c in docs.columns]))
