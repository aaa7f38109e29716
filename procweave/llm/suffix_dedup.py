"""Exact substring deduplication with a sparse, distributed suffix array over bytes.

A byte is removed when a ``span``-byte string (100) that covers it also starts
earlier: in a smaller document, or earlier in the same one. Texts are UTF-8
bytes; strings do not cross documents and are judged on the input.

Only sampled suffixes are sorted. Of every 100-byte string the 32-byte gram with
the least hash is its anchor (leftmost on ties), so equal strings have equal
anchors at equal places, and anchors lie about 35 bytes apart.

1. Per document block the distinct anchor hashes are sent to hash shards; a
   shard answers which of a block's anchors another block has too.
2. Blocks sort their own candidate strings and compare neighbours (the first of
   equal ones stays), and send out the stretch of strings around each anchor that
   other blocks have, one copy of each distinct string per block.
3. Sampled splitters over the gram's leading bytes range-partition these
   suffixes; a leading value that fills several ranges (a passage that a large
   part of the documents share) is dealt over all of them. Each bucket sorts its
   suffixes by multikey quicksort (eight bytes a key), the strings of equal
   grams over all 100 bytes, and compares neighbours in that order.
4. What was dealt over several buckets is compared across their boundaries: the
   strings still unmatched meet by their bytes, and all but the earliest are later.
5. The runs go back to their blocks, where the remaining bytes are put together.

No byte is removed on a hash: anchor hashes only choose what is compared, so a
collision compares a string too many. Blocks, shards and buckets are as many as the
counted bytes ask for (``BLOCK_BYTES``, ``SHARD_BYTES``, ``BUCKET_BYTES``), so none of
their tasks grows with the input.

Blocks are dealt by a hash of id and text, so no block, shard or bucket grows
with the copies of one text: identical strings are sent once per block.

Defined results: null text is empty; texts under 100 bytes lose nothing; rows of
equal id and text are one document (each such row gets its result); rows of
equal id and different text are ordered by text hash; a null id comes first; ids
may be of any type that Spark and Arrow order alike (numbers, strings, dates).
Texts of any length are judged whole, in segments. Extra columns may be carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, delete_staged, packed, stage, unpack

SPAN = 100
GRAM = 32
#: Rows and bytes of a document block (about; one document at least), and bytes hashed at a time.
BLOCK_ROWS = 1000
BLOCK_BYTES = 4 << 20
SEGMENT = 1 << 20
#: Bytes of text whose anchors one shard compares, and whose stretches one bucket sorts (about).
SHARD_BYTES = 256 << 20
BUCKET_BYTES = 16 << 20
#: Every so many anchors one is a sample for the splitters.
SAMPLE = 64

_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MUL = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_SHIFT = np.uint64(29)
_POS_BITS = np.uint64(21)  # a segment has under 2^21 positions


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _MUL[14]
    x ^= x >> _SHIFT
    x *= _MUL[15]
    x ^= x >> np.uint64(32)
    return x


def _levels(buf: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Hashes of all substrings of the length ``upto``, put together from halves."""
    out = {1: _TABLE[buf]}
    size, k = 1, 0
    while size < upto:
        h = out[size]
        joined = h[:-size] * _MUL[k]
        joined ^= joined >> _SHIFT
        joined += h[size:] * _MUL[k + 1]
        size, k = size * 2, k + 2
        out[size] = joined
        del out[size // 2]
    return out


def _anchors(levels: dict[int, np.ndarray], span: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hash by position, anchor position of the string at each start) of a segment."""
    grams = _mix(levels[GRAM])
    width = span - GRAM + 1
    key = (grams >> _POS_BITS << _POS_BITS) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[:len(key) - (width - size)], key[width - size:])
    return grams, (key & np.uint64((1 << 21) - 1)).astype(np.int64)


def _valid_starts(offsets: np.ndarray, n: int, span: int) -> np.ndarray:
    """Whether the string from each start lies in one document; ``offsets``: document bounds in the buffer."""
    ok = np.ones(n, bool)
    for e in offsets[1:]:
        ok[max(0, e - span + 1):e] = False
    return ok


def _concat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def _segments(buf: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray]]:
    for a in range(0, max(0, len(buf) - span + 1), SEGMENT):
        yield a, buf[a:a + SEGMENT + span - 1]


def _lead(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First eight bytes at the given positions as a signed long in byte order."""
    word = np.zeros(len(at), np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | buf[at + i]
    return (word ^ np.uint64(1 << 63)).view(np.int64)


def multikey_sort(words) -> tuple[np.ndarray, np.ndarray]:
    """(order, new group starts) of rows of 64-bit keys: sort by one key, then only ties by the next.

    ``words`` is a matrix, or (rows, keys, function) where the function gives the keys of one depth for given rows
    (None: all); a depth is looked up for rows still tied only, and groups whose rows all agree there are not sorted.
    """
    if isinstance(words, np.ndarray):
        matrix = words
        words = len(matrix), matrix.shape[1], lambda depth, rows: matrix[:, depth] if rows is None else matrix[rows, depth]
    n, depths, key = words
    first = key(0, None)
    order = np.argsort(first)
    first = first[order]
    opens = np.concatenate([[True], first[1:] != first[:-1]]) if n else np.zeros(0, bool)
    tied = None
    for depth in range(1, depths):
        if tied is None or depth in (2, 4, 8):  # rows whose group has others
            single = opens & np.append(opens[1:], True)
            tied = np.flatnonzero(~single)
        if not len(tied):
            break
        rows = order[tied]
        word = key(depth, rows)
        head = opens[tied]
        differs = word[1:] != word[:-1]
        differs &= ~head[1:]
        if not differs.any():
            continue
        group = np.cumsum(head) - 1
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][differs]] = True
        part = np.flatnonzero(mixed[group])
        g, w = group[part], word[part]
        ranked = np.lexsort((w, g))
        order[tied[part]] = rows[part][ranked]
        w = w[ranked]
        fresh = np.concatenate([[True], (w[1:] != w[:-1]) | (g[1:] != g[:-1])])
        opens[tied[part]] = fresh
    return order, opens


def _runs(starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte runs [from, to) covered by strings at ascending ``starts``; touching strings join."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > span)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + span


def _pairs(h: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, block) pairs by hash."""
    order = np.lexsort((b, h))
    h, b = h[order], b[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])]) if len(h) else np.zeros(0, bool)
    return h[new], b[new]


def block_anchor_hashes(texts: list[bytes], span: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per document: anchor hashes and leading words (with repeats)."""
    buf, offsets = _concat(texts)
    valid = _valid_starts(offsets, len(buf), span)
    doc, hashes, leads = [], [], []
    for a, seg in _segments(buf, span):
        levels = _levels(seg, GRAM)
        grams, anchor = _anchors(levels, span)
        at = np.unique(anchor[valid[a:a + len(anchor)]])
        doc.append(np.searchsorted(offsets, a + at, side="right") - 1)
        hashes.append(grams[at])
        leads.append(_lead(seg, at))
    if not doc:
        return [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * len(texts)
    d, h, w = map(np.concatenate, (doc, hashes, leads))
    bounds = np.searchsorted(d, np.arange(len(texts) + 1))
    return [(h[s:e], w[s:e]) for s, e in zip(bounds[:-1], bounds[1:])]


def compare_block(texts: list[bytes], shared: np.ndarray, span: int):
    """Within a block of documents in order: later strings, and stretches of strings that other blocks may have.

    Returns (document, from, to) of removed runs, and (document, start of the
    first string, number of strings, anchor position) of the stretches.
    """
    buf, offsets = _concat(texts)
    valid = _valid_starts(offsets, len(buf), span)
    at, own, placed = [], [], []
    for a, seg in _segments(buf, span):
        levels = _levels(seg, GRAM)
        grams, anchor = _anchors(levels, span)
        ok = valid[a:a + len(anchor)]
        placed.append(anchor.astype(np.int32))
        p = np.unique(anchor[ok])
        at.append(a + p)
        own.append(grams[p])
    empty = np.zeros(0, np.int64)
    if not at:
        return (empty,) * 3, (empty,) * 4, buf, offsets
    at, own = np.concatenate(at), np.concatenate(own)
    at, first = np.unique(at, return_index=True)
    own = own[first]
    _, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
    elsewhere = np.isin(own, shared)
    local = counts[inverse] > 1
    starts, owners = [], []
    number = np.cumsum(np.bincount(at, minlength=len(buf))) - 1  # of the anchor at or before each position
    for (a, seg), anchor in zip(_segments(buf, span), placed):
        lo, hi = np.searchsorted(at, (a, a + len(seg)))
        if not (elsewhere[lo:hi] | local[lo:hi]).any():
            continue
        owner = number[a + anchor]
        take = np.flatnonzero(valid[a:a + len(anchor)] & (elsewhere | local)[np.maximum(owner, 0)])
        starts.append(a + take)
        owners.append(owner[take])
    if not starts:
        return (empty,) * 3, (empty,) * 4, buf, offsets
    starts, owners = map(np.concatenate, (starts, owners))
    later = np.zeros(len(starts), bool)
    mine = np.flatnonzero(local[owners])  # a string whose gram the block has once is there once
    later[mine] = _later(buf, starts[mine], span)
    doc = lambda p: np.searchsorted(offsets, p, side="right") - 1
    removed = _doc_runs(starts[later], offsets, span)
    keep = ~later & elsewhere[owners]
    s, o = starts[keep], owners[keep]
    if not len(s):
        return removed, (empty,) * 4, buf, offsets
    opens = np.flatnonzero(np.concatenate([[True], (np.diff(s) != 1) | (np.diff(o) != 0)]))
    count = np.diff(np.concatenate([opens, [len(s)]]))
    return removed, (doc(s[opens]), s[opens], count, at[o[opens]]), buf, offsets


def _doc_runs(starts: np.ndarray, offsets: np.ndarray, span: int):
    """(document, from, to) in document positions of the runs that strings at ``starts`` cover."""
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    doc = np.searchsorted(offsets, starts, side="right") - 1
    cut = np.flatnonzero((np.diff(starts) > span) | (np.diff(doc) != 0))
    lo, hi = starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + span
    doc = doc[np.concatenate([[0], cut + 1])]
    return doc, lo - offsets[doc], hi - offsets[doc]


def _later(buf: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Of strings listed in order: whether an equal one is listed before, by sorting them and comparing neighbours."""
    later = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return later
    word = np.ndarray((len(buf) - 7,), ">i8", buf, strides=(1,))  # eight bytes from every place; any order groups equals
    depths = [*range(0, span - 8, 8), span - 8]
    order, opens = multikey_sort((len(starts), len(depths), lambda d, rows: word[(starts if rows is None else starts[rows]) + depths[d]].astype(np.int64)))
    heads = np.flatnonzero(opens)
    least = np.minimum.reduceat(order, heads)
    later[:] = True
    later[least] = False
    return later


def _blocked(docs: DataFrame, key: str, text: str, blocks: int, carry: tuple[str, ...] = ()) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hashed = F.xxhash64(F.col(key), body)
    return docs.select(F.pmod(hashed, F.lit(blocks)).cast("long").alias("block"), F.col(key).alias("doc"),
                       F.xxhash64(body).alias("row"), body.alias("body"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])


def _in_order(table: pa.Table) -> tuple[list, list, list[bytes]]:
    """(doc, row, bytes) of a block's distinct documents, in order; null ids first."""
    rows = {(d is not None, d, r): t for d, r, t in zip(
        table.column("doc").to_pylist(), table.column("row").to_pylist(), unpack(table.column("body").to_pylist()))}
    keys = sorted(rows)
    return [k[1] if k[0] else None for k in keys], [k[2] for k in keys], [rows[k] for k in keys]


def removed_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> tuple[DataFrame, int]:
    """Runs (block, doc, row, lo, hi) of removed bytes, written to the shared folder, and the number of blocks."""
    if span != SPAN:
        raise ValueError("strings of 100 bytes are supported")
    spark = docs.sparkSession
    n_rows, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()
    blocks = max(1, -(-n_rows // BLOCK_ROWS), -(-n_bytes // BLOCK_BYTES))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(partitions, -(-n_bytes // SHARD_BYTES))
    data = _blocked(docs, key, text, blocks)
    kind = data.schema["doc"].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        leads: list[np.ndarray] = []
        size = 0

        def send() -> pa.RecordBatch:
            h, b = _pairs(*map(np.concatenate, zip(*held)))
            shard = (h % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            h, b, shard = h[order], b[order], shard[order]
            at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            cuts = [*at.tolist(), len(h)]
            sample = np.concatenate(leads)[::SAMPLE].tolist()
            n = len(at)
            return pa.RecordBatch.from_arrays([
                pa.array(shard[at]),
                pa.array([h[s:e].tobytes() for s, e in zip(cuts, cuts[1:])], pa.binary()),
                pa.array([b[s:e].astype("<i4" if blocks < 1 << 31 else "<i8").tobytes() for s, e in zip(cuts, cuts[1:])], pa.binary()),
                pa.array([sample] + [[]] * (n - 1), pa.list_(pa.int64()))], names=["shard", "hashes", "blocks", "leads"])

        for batch in chunks(batches, "body", 4 << 20):
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            for (h, w), b in zip(block_anchor_hashes(texts, span), batch.column(0).to_pylist()):
                if len(h):
                    held.append((h, np.full(len(h), b, np.int64)))
                    leads.append(w)
                    size += len(h)
            if size > 3_000_000:
                yield send()
                held, leads, size = [], [], 0
        if size:
            yield send()

    sent = stage(data.mapInArrow(anchors, "shard long, hashes binary, blocks binary, leads array<long>"), "suffix-anchors")
    wide = blocks >= 1 << 31

    def answer(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()])
        b = np.concatenate([np.frombuffer(x, "<i8" if wide else "<i4") for x in table.column("blocks").to_pylist()])
        h, b = _pairs(h, b)
        group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1 if len(h) else b
        common = np.bincount(group)[group] > 1 if len(h) else np.zeros(0, bool)
        h, b = h[common], b[common]
        order = np.argsort(b, kind="stable")
        h, b = h[order], b[order]
        at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        cuts = [*at.tolist(), len(h)]
        return pa.table({"block": pa.array(b[at].astype(np.int64)),
                         "hashes": pa.array([h[s:e].tobytes() for s, e in zip(cuts, cuts[1:])], pa.binary())})

    common = sent.select("shard", "hashes", "blocks").groupBy("shard").applyInArrow(answer, "block long, hashes binary")
    # one row of splitters, whatever the input's size
    buckets = max(4 * max(2, partitions), -(-n_bytes // BUCKET_BYTES))  # a task takes its buckets one by one
    points = [i / buckets for i in range(1, buckets)]
    found = (sent.select(F.explode("leads").alias("lead"))
             .agg(F.percentile_approx("lead", points, max(20_000, 4 * buckets)).alias("s")).first()["s"])
    splitters = np.array(found or [], np.int64)

    def compare(block: pa.Table, answers: pa.Table) -> pa.Table:
        ids, rows, texts = _in_order(block)
        shared = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, "<u8") for x in answers.column("hashes").to_pylist()]]))
        (rd, lo, hi), (sd, start, count, at), buf, offsets = compare_block(texts, shared, span)
        number = block.column("block")[0].as_py() if len(block) else 0
        lead = _lead(buf, at)
        low, high = np.searchsorted(splitters, lead, side="left"), np.searchsorted(splitters, lead, side="right")
        own = np.array(rows, np.int64)
        several = high - low > 1
        deal = np.where(several, low + 1 + (own[sd] & 0x7FFFFFFF) % np.maximum(high - low, 1), low)
        n, m = len(rd), len(sd)
        raw = buf.tobytes()
        return pa.table({
            "bucket": pa.array(np.concatenate([number % buckets + np.zeros(n, np.int64), deal]).astype(np.int64)),
            "block": pa.array(np.full(n + m, number, np.int64)),
            "doc": pa.array([ids[d] for d in rd] + [ids[d] for d in sd], block.schema.field("doc").type),
            "row": pa.array(np.concatenate([own[rd], own[sd]]).astype(np.int64)),
            "lo": pa.array(np.concatenate([lo, start - offsets[sd]]).astype(np.int64)),
            "hi": pa.array(np.concatenate([hi, start - offsets[sd] + count - 1 + span]).astype(np.int64)),
            "anchor": pa.array(np.concatenate([np.full(n, -1), at - start]).astype(np.int32)),
            "dealt": pa.array(np.concatenate([np.zeros(n, bool), several])),
            "body": pa.array([b""] * n + [raw[s:s + c - 1 + span] for s, c in zip(start.tolist(), count.tolist())], pa.binary())})

    fields = f"bucket long, block long, doc {kind}, row long, lo long, hi long, anchor int, dealt boolean, body binary"
    suffixes = packed(data, "body").groupBy("block").cogroup(common.groupBy("block")).applyInArrow(compare, fields)

    def sort_bucket(table: pa.Table) -> pa.Table:
        anchor = table.column("anchor").to_numpy()
        local = anchor < 0
        names = ["block", "doc", "row", "lo", "hi"]
        done = table.select(names).filter(pa.array(local)).append_column("string", pa.nulls(int(local.sum()), pa.binary()))
        part = table.filter(pa.array(~local))
        n = len(part)
        if not n:
            return done
        # in document order, so that the first of equal strings is the earliest
        doc = pa.compute.rank(part.column("doc"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        part = part.take(pa.array(np.lexsort((part.column("lo").to_numpy(), part.column("row").to_numpy(), doc))))
        buf, offsets = _concat(part.column("body").to_pylist())
        anchor = part.column("anchor").to_numpy() + offsets[:-1]
        words = np.stack([_lead(buf, anchor + 8 * i) for i in range(GRAM // 8)], axis=1)
        order, opens = multikey_sort(words)
        grams = np.empty(n, np.int64)
        grams[order] = np.cumsum(opens) - 1
        several = np.bincount(grams)[grams] > 1
        dealt = part.column("dealt").to_numpy(zero_copy_only=False)
        valid = _valid_starts(offsets, len(buf), span)
        valid &= np.repeat(several | dealt, np.diff(offsets))  # a gram that nothing else here has needs no comparison
        starts = np.flatnonzero(valid)
        if not len(starts):
            return done
        later = _later(buf, starts, span)
        d, lo, hi = _doc_runs(starts[later], offsets, span)
        open_ = ~later & dealt[np.searchsorted(offsets, starts, side="right") - 1]
        p = starts[open_]
        pd = np.searchsorted(offsets, p, side="right") - 1
        base = part.column("lo").to_numpy()
        which = pa.array(np.concatenate([d, pd]))
        out = part.select(["block", "doc", "row"]).take(which)
        begin = np.concatenate([base[d] + lo, base[pd] + p - offsets[pd]])
        end = np.concatenate([base[d] + hi, base[pd] + p - offsets[pd] + span])
        mark = pa.array([None] * len(d) + [buf[x:x + span].tobytes() for x in p.tolist()], pa.binary())
        out = (out.append_column("lo", pa.array(begin)).append_column("hi", pa.array(end)).append_column("string", mark))
        return pa.concat_tables([done, out.cast(done.schema)])

    sorted_ = stage(suffixes.groupBy("bucket").applyInArrow(
        sort_bucket, f"block long, doc {kind}, row long, lo long, hi long, string binary"), "suffix-runs")
    delete_staged(sent)
    inside = sorted_.where("string is null").drop("string")
    across = sorted_.where("string is not null")
    place = F.struct(F.col("doc").isNotNull().alias("some"), "doc", "row", "lo")
    heads = across.groupBy("string").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("string", "head")
    later = across.withColumn("place", place).join(heads, "string").where("NOT place <=> head").select(inside.columns)
    return inside.unionByName(later), blocks


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, with_text: bool = False,
          carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans, kept_sha256 (kept text and runs), carried columns.

    ``kept_text`` is the remaining bytes as text; a character cut by a run is left out of it.
    """
    runs, blocks = removed_runs(docs, key, text, span)
    data = _blocked(docs, key, text, blocks, carry)
    carried = [f for f in data.schema.fields if f.name.startswith("c") and f.name[1:].isdigit()]

    names = [f.name for f in carried]

    def rebuild(block: pa.Table, runs: pa.Table) -> pa.Table:
        cuts: dict[tuple, list] = {}
        for d, r, lo, hi in zip(*(runs.column(c).to_pylist() for c in ("doc", "row", "lo", "hi"))):
            cuts.setdefault((d, r), []).append((lo, hi))
        out = []
        for d, r, raw in zip(block.column("doc").to_pylist(), block.column("row").to_pylist(),
                             unpack(block.column("body").to_pylist())):
            merged: list[list[int]] = []
            for lo, hi in sorted(cuts.get((d, r), ())):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            kept, at = [], 0
            for lo, hi in merged:
                kept.append(raw[at:lo])
                at = hi
            kept.append(raw[at:])
            rest = b"".join(kept)
            row = (len(raw), len(raw) - len(rest), len(merged), hashlib.sha256(rest).hexdigest())
            out.append((*row, rest.decode("utf-8", "ignore"), [{"lo": a, "hi": b} for a, b in merged]) if with_text else row)
        cols = list(zip(*out)) or [[]] * (6 if with_text else 4)
        made = {"n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()),
                "n_spans": pa.array(cols[2], pa.int64()), "kept_sha256": pa.array(cols[3], pa.string())}
        if with_text:
            made["kept_text"] = pa.array(cols[4], pa.string())
            made["spans"] = pa.array(cols[5], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
        return pa.table({**{c: block.column(c) for c in ["doc", *names]}, **made})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [data.schema["doc"], *carried]) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept_text string, spans array<struct<lo: long, hi: long>>" if with_text else ""
    out = packed(data, "body").groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(rebuild, schema)
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text", "spans"] * with_text]
    return out.select(F.col("doc").alias(key), *made, *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])
