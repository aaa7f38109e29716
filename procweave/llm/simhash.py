"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints come from word shingles: XXH64 (seed 42) of each shingle's UTF-8
bytes, a bit set where over half of the hashes have it. Distinct fingerprints
that agree on two of four 16-bit bands meet in a bucket (two differing bits
spoil two bands at most, so any pair within radius 2 meets). In a bucket the
fingerprints are stored vertically: one machine word holds one bit of 64
fingerprints. A query's differences are added into carry-save counters (ones,
twos, over), 64 distances at a time, and a block of 64 is abandoned once all its
distances exceed the radius. A bucket yields a star per component, never its
pairs. A bucket of over ``BUCKET`` distinct fingerprints is not collected: its
members meet at their neighbours instead (two fingerprints differ in at most two
bits exactly if some value is within one bit of both; such a value has at most
65 neighbours), which is exact for any size. Components of the links are found
by star rounds.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; fewer words than a shingle give one shingle of all words; repeated
rows link at distance zero; a component's id is its smallest non-null id (null
if there is none). Texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, free_name, stage
from .components import components

SHINGLE = 3
RADIUS = 2
BANDS = 4
#: Most distinct fingerprints of a bucket that is compared by bit planes (memory of a task).
BUCKET = 4096

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # most significant first


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one UTF-8 text."""
    import xxhash

    words = raw.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1:].tolist())]), np.uint8)
    hashes = hashes.reshape(-1, 8)
    counts = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, fp): fp is the fingerprint as a signed long. A map without any shuffle."""
    names = [key, *carry]
    data = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.col(text).cast("string").alias("_text"))
    at, kept = len(names), [f"k{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text", 4 << 20):
            values = [fingerprint(t.as_py() or b"", shingle) for t in batch.column(at).cast(pa.binary())]
            fp = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], fp], names=[*kept, "fp"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in data.schema.fields[:at])
    out = data.mapInArrow(run, f"{kinds}, fp long")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "fp")


def bucket_links(buckets: list[np.ndarray], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Star links (smallest member, other member) of the components within each bucket of unsigned fingerprints."""
    if not buckets:
        return []
    # lanes: every bucket starts at a new word of 64 lanes
    words = [-(-len(b) // 64) for b in buckets]
    first = np.concatenate([[0], np.cumsum(words)])
    lanes = np.zeros(first[-1] * 64, np.uint64)
    valid = np.zeros(first[-1] * 64, bool)
    for b, w in zip(buckets, first):
        lanes[w * 64: w * 64 + len(b)] = b
        valid[w * 64: w * 64 + len(b)] = True
    pack = lambda x: np.packbits(x.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
    planes = [pack(((lanes >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)) for k in range(64)]
    alive = pack(valid)
    # queries against the words of their own bucket
    query = np.concatenate([np.repeat(np.arange(w * 64, w * 64 + len(b)), n) for b, w, n in zip(buckets, first, words)])
    block = np.concatenate([np.tile(np.arange(w, w + n), len(b)) for b, w, n in zip(buckets, first, words)])
    ones = np.zeros(len(query), np.uint64)
    twos, over = ones.copy(), ~alive[block]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for k in range(64):
        flip = ((lanes[query] >> np.uint64(k)) & np.uint64(1)) * full
        differs = planes[k][block] ^ flip
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if radius < 3:  # a count beyond the radius stays marked
            over |= (ones & twos) if radius == 2 else twos if radius == 1 else ones | twos
        if k % 8 == 7:
            left = over != full  # blocks with all distances beyond the radius are abandoned
            query, block, ones, twos, over = query[left], block[left], ones[left], twos[left], over[left]
    near = ~over
    own = (block == query >> 6) * (np.uint64(1) << (query & 63).astype(np.uint64))
    linked = (near & ~own) != 0
    touched = np.unique(np.searchsorted(first, block[linked], side="right") - 1)
    order_first = np.searchsorted(query, first * 64)  # queries stay in bucket order
    links: list[tuple[int, int]] = []
    for t in touched:
        lo, hi, n = order_first[t], order_first[t + 1], len(buckets[t])
        rows = np.zeros((n, words[t]), np.uint64)
        rows[query[lo:hi] - first[t] * 64, block[lo:hi] - first[t]] = near[lo:hi]
        todo = np.ones(n, bool)
        for i in range(n):
            if not todo[i]:
                continue
            reached = np.zeros(n, bool)
            frontier = np.array([i])
            while len(frontier):
                reached[frontier] = True
                mask = np.bitwise_or.reduce(rows[frontier], axis=0)
                bits = np.unpackbits(mask.view(np.uint8), bitorder="little")[:n].astype(bool)
                frontier = np.flatnonzero(bits & ~reached)
            members = np.flatnonzero(reached)
            todo[members] = False
            if len(members) > 1:
                group = buckets[t][members]
                root = int(group.min())
                links += [(root, int(x)) for x in group if int(x) != root]
    return links


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect exactly the components of "at most ``radius`` bits apart" over distinct ``fp`` values."""
    if not 0 <= radius <= 2:
        raise ValueError("a radius of 0, 1 or 2 is supported")
    width = 64 // BANDS
    band = [F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << width) - 1)) for k in range(BANDS)]
    keys = F.array(*[F.struct(F.lit(i * BANDS + j).alias("t"), F.shiftleft(band[i], width).bitwiseOR(band[j]).alias("key"))
                     for i in range(BANDS) for j in range(i + 1, BANDS)])
    rows = fps.select("fp").distinct().select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = rows.join(sizes, ["t", "key"])
    small = sized.where(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            flat, offsets = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64), col.offsets.to_numpy()
            offsets = offsets - offsets[0]
            group: list[np.ndarray] = []
            work, found = 0, []
            for s, e in zip(offsets[:-1], offsets[1:]):
                pairs = (e - s) * -(-(e - s) // 64)
                if group and work + pairs > 500_000:
                    found += bucket_links(group, radius)
                    group, work = [], 0
                group.append(flat[s:e])
                work += pairs
            found += bucket_links(group, radius)
            ends = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    near = small.select("fps").mapInArrow(compare, "a long, b long")
    # members of larger buckets: meet at values within one bit (both differ from it in at most one bit)
    large = sized.where(F.col("n") > bucket).select("fp").distinct()
    steps = [0] + [1 << k if k < 63 else -(1 << 63) for k in range(64)]
    reach = radius // 2 * 64 + 1 if radius != 1 else 65
    meet = large.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(s).cast("long")) for s in steps[:reach]])).alias("at"))
    root = meet.groupBy("at").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("at", "a")
    stars = meet.join(root, "at").select("a", F.col("fp").alias("b")).where("a <> b")
    if radius == 1:  # meeting at a neighbour means up to two bits: keep the true links only
        stars = meet.where("at <> fp").join(large.select(F.col("fp").alias("at")), "at").select(F.col("fp").alias("a"), F.col("at").alias("b"))
    return near.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, bucket: int = BUCKET, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: key, carried columns, ``fp``, ``root`` (a fingerprint per component), ``component_id``."""
    fps = stage(fingerprints(docs, key, text, shingle, carry), "simhash")
    roots = stage(components(links(fps, radius, bucket)), "simhash-roots")
    least = fps.groupBy("fp").agg(F.min(key).alias("_least"))
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(smallest, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    # a fingerprint that a third of all rows share is split by AQE's skew join
    return fps.join(by_fp, fps["fp"] == by_fp["_fp"]).select(key, *carry, "fp", "root", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id (then text hash) stays, once."""
    mark = free_name(docs)
    marked = docs.withColumn(mark, F.xxhash64(F.col(text)))
    found = near_duplicates(marked, key, text, carry=(mark,), **options)
    keepers = found.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"),
                                                       F.col(mark).alias("hash"))).alias("k"))
    keepers = keepers.select(F.col("k.id").alias("i"), F.col("k.hash").alias("h")).distinct()
    kept = marked.join(keepers, marked[key].eqNullSafe(keepers["i"]) & (marked[mark] == keepers["h"]), "left_semi")
    return kept.dropDuplicates([key, mark]).select(docs.columns)
