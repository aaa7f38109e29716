"""Best-fit packing by hierarchical residuals.

Round 0 codes the documents where they are read: a document is one piece, or,
if it is longer than a sequence, a first piece of the rest and then whole
sequences. The pieces of a block go, longest first, each into the bin with the
least room that still holds it. Nearly full bins are done. Underfull bins are
the items of the next round: the bins of ``FAN_IN`` partitions meet in one, are
best-fitted as they are and leave nearly full bins behind, and so on up the
tree until one partition is left. A task gets at most about ``ITEMS`` bins: where
more are left than that, a level keeps so many partitions, and the rounds end
when a level saves less than ``LEAST_SAVING`` of its bins, so no task grows with
the data however badly lengths fit.

A bin carries its pieces (at most ``max_len``, since a piece has a token or more), so
only the few underfull bins are shuffled, dealt by a hash of the bin's number.
Every round is a table in the shared folder: a lost executor repeats tasks of one
round, and the numbers of bins that others have read do not change.

Token ids are those of :class:`~procweave.llm.packing.Encoder`.

Defined results: a null or empty text is one piece with the end id alone; repeated
rows are packed one by one; an empty table gives no pieces; texts of any length are
cut, never shortened; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, stage
from .packing import RANKS, Encoder

MAX_LEN = 1024
END = 2
#: Partitions whose underfull bins meet in one task of the next round.
FAN_IN = 8
#: Underfull bins a task gets at most (about).
ITEMS = 1 << 15
#: Tokens and pieces of a block of round 0.
BLOCK_TOKENS = 1 << 24
BLOCK_PIECES = 1 << 17
#: A level that saves a smaller part of its bins is the last.
LEAST_SAVING = 0.002


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers): each item, in order, goes to the bin with the least sufficient room."""
    rooms = 0  # bit r: a bin with room r is open
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    for item, size in enumerate(sizes):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = open_bins[room]
            number = stack.pop()
            if not stack:
                rooms ^= 1 << room
            bins[number].append(item)
            room -= size
        else:
            number, room = len(bins), capacity - size
            bins.append([item])
        if room:
            open_bins[room].append(number)
            rooms |= 1 << room
    return bins


def cut(tokens: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first are whole sequences."""
    first = tokens % max_len or max_len
    return [(0, min(first, tokens)), *((s, max_len) for s in range(first, tokens, max_len))]


def _bins(pieces: pa.StructArray, counts: np.ndarray, sizes: np.ndarray, ties: np.ndarray, capacity: int, number: int) -> pa.RecordBatch:
    """Best-fit items, longest first, given as consecutive runs of ``counts`` pieces; offsets are set anew."""
    begin = np.cumsum(counts) - counts
    order = np.lexsort((ties, -sizes))
    bins = best_fit(sizes[order].tolist(), capacity)
    items = order[np.array([i for b in bins for i in b], np.int64)] if bins else np.zeros(0, np.int64)
    n = counts[items]
    take = np.arange(n.sum()) + np.repeat(begin[items] - (np.cumsum(n) - n), n)
    flat = pieces.take(pa.array(take))
    per_bin = np.array([len(b) for b in bins], np.int64)
    ends = np.cumsum(n)[np.cumsum(per_bin) - 1] if bins else np.zeros(0, np.int64)
    fields = [flat.type.field(i) for i in range(flat.type.num_fields)]
    length = flat.field(flat.type.get_field_index("length")).to_numpy()
    before = np.cumsum(length) - length
    starts = np.concatenate([[0], ends])
    offset = before - np.repeat(before[starts[:-1]], np.diff(starts)) if len(length) else before
    values = [pa.array(offset) if f.name == "offset" else flat.field(i) for i, f in enumerate(fields)]
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(values, fields=fields))
    filled = np.add.reduceat(length, starts[:-1]) if bins else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(number + np.arange(len(bins))), pa.array(filled), lists], names=["bin", "size", "pieces"])


def _first_number(level: int) -> int:
    """Number of the first bin of this task: level, partition, number."""
    from pyspark import TaskContext

    return level << 56 | TaskContext.get().partitionId() << 32


def _local(docs: DataFrame, max_len: int, end: int, ranks: str, with_ids: bool) -> DataFrame:
    """Round 0: (bin, size, pieces) of every partition."""
    kind = docs.schema["_key"].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "offset"]
    schema = (f"bin long, size long, pieces array<struct<key: {kind}, piece: int, " + ", ".join(f"{n}: long" for n in names)
              + (", ids: array<int>" if with_ids else "") + ">>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number, key_type = Encoder(ranks, end), _first_number(0), None
        rows: list[tuple] = []
        ids_of: list[np.ndarray] = []
        tokens = 0

        def settle() -> pa.RecordBatch:
            cols = list(zip(*rows))
            length = np.array(cols[3])
            arrays = [pa.array(cols[0], key_type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:]),
                      pa.array(np.zeros(len(rows), np.int64))]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids_of)]), pa.int32()),
                                                       pa.array(np.concatenate(ids_of).astype(np.int32))))
            pieces = pa.StructArray.from_arrays(arrays, names=["key", "piece", *names, *["ids"] * with_ids])
            return _bins(pieces, np.ones(len(rows), np.int64), length, np.arange(len(rows)), max_len, number)

        for batch in chunks(batches, "_text", 4 << 20):
            key_type = batch.column(0).type
            for k, ids in zip(batch.column(0).to_pylist(), encode.batch(batch.column(1))):
                for piece, (start, length) in enumerate(cut(len(ids), max_len)):
                    own = ids[start:start + length]
                    rows.append((k, piece, start, length, zlib.crc32(own.astype("<u4").tobytes())))
                    if with_ids:
                        ids_of.append(own)
                tokens += len(ids)
                if tokens >= BLOCK_TOKENS or len(rows) >= BLOCK_PIECES:
                    out = settle()
                    yield out
                    number += out.num_rows
                    rows, ids_of, tokens = [], [], 0
        if rows:
            yield settle()

    return docs.mapInArrow(work, schema)


def _merge(bins: DataFrame, level: int, parts: int, max_len: int) -> DataFrame:
    """One round over underfull bins: ``parts`` partitions, each best-fitting its bins as items."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bins.schema.fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_pylist([])])
        if table.num_rows:
            lists = table.column("pieces").combine_chunks()
            yield _bins(lists.flatten(), np.diff(lists.offsets.to_numpy()), table.column("size").to_numpy(),
                        table.column("bin").to_numpy(), max_len, _first_number(level))

    dealt = bins.repartition(parts, F.xxhash64("bin", F.lit(level)))
    return dealt.mapInArrow(work, schema)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", max_len: int = MAX_LEN, end: int = END, ranks: str = RANKS,
         slack: int | None = None, with_ids: bool = True, items: int = ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset, sequence_length (and ids).

    A bin with at most ``slack`` places left (a 64th of ``max_len`` by default) is nearly full.
    """
    slack = max_len // 64 if slack is None else slack
    data = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    current = stage(_local(data, max_len, end, ranks, with_ids), "best-fit")
    done, level = [], 0
    underfull = F.col("size") < max_len - slack
    left, parts = current.where(underfull).agg(F.count(F.lit(1)), F.count_distinct(F.shiftright("bin", 32))).first()
    while left:
        level += 1
        least = -(-left // items)
        parts = max(least, -(-parts // fan_in))
        done.append(current.where(~underfull))
        current = stage(_merge(current.where(underfull), level, parts, max_len), "best-fit")
        after, bins = current.agg(F.count(F.when(underfull, 1)), F.count(F.lit(1))).first()
        if parts == 1 or (parts == least and left - bins < LEAST_SAVING * left) or level == 127:
            break
        left = after
    for table in done:
        current = current.unionByName(table)
    out = current.select(F.col("bin").alias("sequence_id"), F.col("size").alias("sequence_length"), F.inline("pieces"))
    order = ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "sequence_length", *["ids"] * with_ids]
    return out.select(order).withColumnRenamed("key", key)
