"""Packing: order-preserving window cuts by dynamic programming with a monotone queue.

The documents of a partition form one token stream in their order. A window may
be cut after a document (no penalty), after a sentence or line (a small
penalty) or, so that any text can be cut, at every ``GRID``-th token (a larger
penalty). A window of n tokens is padded to ``max_len`` unless n is a power of
two. The cuts minimise padding plus penalties:

    f(j) = penalty(j) + min( min over j - max_len <= i < j of f(i) + max_len - (j - i),
                             min over powers of two p of f(j - p) )

The first inner minimum is a sliding-window minimum of f(i) + i, kept in a
monotone queue, so a cut costs constant time. The stream is solved in blocks of
``BLOCK`` tokens: of each block the best path up to its last window is settled
and the rest opens the next block, so a task's memory is bounded by a block and
its longest document. No shuffle: a partition is packed where it is read, and a
lost task gives the same cuts and ids again.

Token ids are those of the ``tokenizers`` file ``byte_bpe_50k.json`` without
special tokens; they are computed with ``tiktoken`` over the same vocabulary
(the ids are equal, see the tests) through a bounded word table, followed by
id ``END``. A text is cut at the vocabulary's added tokens (``<|endoftext|>``), which
have ids of their own, as ``tokenizers`` does it.

Defined results: a null or empty text is one token (``END``); repeated rows are
packed one by one; an empty table gives no pieces; texts of any length are cut,
never shortened.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

MAX_LEN = 2048
END = 1
GRID = 128
BLOCK = 1 << 18
SENTENCE_PENALTY = 4.0
GRID_PENALTY = 48.0
RANKS = "byte_bpe_50k.tiktoken"
# The added tokens of the vocabulary.
ADDED = {"<|endoftext|>": 50256}
#: Most pieces of a task's word table (about 60 MB).
CACHE = 400_000

#: Any Unicode white space before a space.
_SPACE_BEFORE_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


class Encoder:
    """Batch encoder with a bounded word table; also tells where sentences end.

    A space after a non-space always starts a token, so a text falls apart
    before such spaces, and the pieces' ids do not depend on what is around
    them. New pieces of a batch are encoded in one call (each starts with the
    only space it has) and kept in the table.
    """

    def __init__(self, ranks: str = RANKS, end: int = END, added: dict[str, int] = ADDED):
        import base64
        import re

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(ranks), "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        size = max(*table.values(), *added.values()) + 1
        self.opens, self.closes = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in table.items():
            self.opens[i] = token[:1] == b" "
            self.closes[i] = token[-1:] in (b".", b"!", b"?") or b"\n" in token
        self.end = end
        self.added = dict(added)
        self.cuts = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self._reset()

    def _reset(self) -> None:
        self.words: dict[str, int] = {}
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def plain(self, text: str) -> np.ndarray:
        if self.cuts is None or not self.cuts.search(text):
            return np.array(self.encoding.encode_ordinary(text), np.uint32)
        parts = ([self.added[t]] if t in self.added else self.encoding.encode_ordinary(t) for t in self.cuts.split(text))
        return np.array([i for p in parts for i in p], np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        ids = self.plain(" " + " ".join(pieces))
        first = np.flatnonzero(self.opens[ids])
        n = len(self.words)
        self.words.update(zip(pieces, range(n, n + len(pieces))))
        self.starts = np.concatenate([self.starts[:-1], first + len(self.flat), [len(self.flat) + len(ids)]])
        self.flat = np.concatenate([self.flat, ids])

    def batch(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Ids of every text, each with the end id behind it."""
        array = pa.array(texts, pa.string()) if isinstance(texts, list) else pc.fill_null(texts.cast(pa.string()), "")
        if not len(array):
            return []
        # runs of white space are cut by what follows them, added tokens by nothing: such texts are encoded as one
        whole = pc.or_(pc.match_substring_regex(array, _SPACE_BEFORE_SPACE), pc.ends_with(array, " "))
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(array, token))
        whole = whole.to_numpy(zero_copy_only=False)
        pieces = pc.split_pattern(array, " ")
        offsets = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary
        inner = np.repeat(~whole, np.diff(offsets))
        inner[offsets[:-1]] = False  # a text's first piece has no space before it
        codes_in = codes[inner]
        used = np.unique(codes_in)
        found = names.take(pa.array(used)).to_pylist()
        unseen = [w for w in found if w not in self.words]
        if len(self.words) + len(unseen) > CACHE:
            self._reset()
            unseen = found
        if unseen:
            self._learn(unseen)
        word = np.zeros(len(names), np.int64)
        word[used] = [self.words[w] for w in found]
        code = word[codes_in]
        sizes = self.starts[code + 1] - self.starts[code]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[code] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        counts = np.where(whole, 0, np.diff(offsets) - 1)
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        first = names.take(pa.array(codes[offsets[:-1]])).to_pylist()
        end = np.array([self.end], np.uint32)
        return [np.concatenate([self.plain(array[i].as_py() if whole[i] else first[i]), ids[at[i]:at[i + 1]], end])
                for i in range(len(array))]

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Positions after the tokens that end a sentence or a line."""
        return np.flatnonzero(self.closes[ids[:-1]]) + 1


def best_cuts(cuts: list[tuple[int, float]], max_len: int, last: bool) -> list[int]:
    """Chosen window ends for ``cuts``, (position, penalty) ascending from 0 on, no gap over ``max_len``.

    With ``last`` the path ends at the last position; else at the best position
    of the last window's length.
    """
    powers = [1 << k for k in range(max_len.bit_length()) if 1 << k <= max_len]
    f, back = [0.0], [0]
    at: list[int | None] = [None] * (cuts[-1][0] + max_len + 1)  # cut number by position + max_len
    at[max_len] = 0
    queue: deque[tuple[int, float, int]] = deque([(0, 0.0, 0)])  # (position, f + position, index), values ascending
    pos = [0]
    for j, penalty in cuts:
        while queue[0][0] < j - max_len:
            queue.popleft()
        head = queue[0]
        best, origin = head[1] + max_len - j, head[2]
        shifted = j + max_len
        for p in powers:
            i = at[shifted - p]
            if i is not None and f[i] < best:
                best, origin = f[i], i
        best += penalty
        index = len(f)
        f.append(best)
        back.append(origin)
        pos.append(j)
        at[shifted] = index
        value = best + j
        while queue and queue[-1][1] >= value:
            queue.pop()
        queue.append((j, value, index))
    index = len(f) - 1
    if not last:
        tail = pos[-1] - max_len
        index = min((i for i in range(len(f) - 1, 0, -1) if pos[i] > tail), key=lambda i: (f[i] - pos[i] * 1e-3, -i))
    path = []
    while index:
        path.append(pos[index])
        index = back[index]
    return path[::-1]


def _block_cuts(docs: list[tuple], total: int) -> list[tuple[int, float]]:
    """(position, penalty) of all cut candidates of a block; ``docs``: (offset in block, document start, ids, sentence ends)."""
    cost = np.full(total + 1, np.inf)
    cost[GRID::GRID] = GRID_PENALTY
    for offset, begin, ids, ends in docs:
        cost[ends[np.searchsorted(ends, begin, side="right"):] + (offset - begin)] = SENTENCE_PENALTY
        cost[offset + len(ids) - begin] = 0.0
    at = np.flatnonzero(np.isfinite(cost))
    return list(zip(at.tolist(), cost[at].tolist()))


def pack_stream(docs: Iterator[tuple], max_len: int = MAX_LEN, block: int = BLOCK) -> Iterator[list[tuple]]:
    """Windows of a stream of (row, ids, sentence ends): lists of (row, start in document, ids of the piece, document ids)."""
    held: list[tuple] = []  # (offset, begin, ids, ends, row); the first may have begun in an earlier block
    total = 0

    def settle(last: bool) -> Iterator[list[tuple]]:
        nonlocal held, total
        path = best_cuts(_block_cuts([h[:4] for h in held], total), max_len, last)
        left, d = 0, 0
        for right in path:
            window = []
            while d < len(held):
                offset, begin, ids, _, row = held[d]
                lo, hi = max(left, offset), min(right, offset + len(ids) - begin)
                if hi > lo:
                    at = begin + lo - offset
                    window.append((row, at, ids[at:at + hi - lo], len(ids)))
                if offset + len(ids) - begin > right:
                    break
                d += 1
            yield window
            left = right
        rest = []
        for offset, begin, ids, ends, row in held[d:]:
            skip = max(0, left - offset)
            if begin + skip < len(ids):
                rest.append((offset + skip - left, begin + skip, ids, ends, row))
        held, total = rest, total - left

    for row, ids, ends in docs:
        held.append((total, 0, ids, ends, row))
        total += len(ids)
        if total >= block:
            yield from settle(False)
    if held:
        yield from settle(True)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", max_len: int = MAX_LEN, end: int = END,
         ranks: str = RANKS, block: int = BLOCK, with_ids: bool = True) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length (and ids).

    ``sequence_id`` is the partition's number times 2^32 plus the window's
    number; offsets in a sequence have no gaps.
    """
    data = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = data.schema["_key"].dataType.simpleString()
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]
    schema = f"_key {kind}, " + ", ".join(f"{n} long" for n in numbers) + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, key_type = Encoder(ranks, end), None  # of this task: a worker keeps no table between tasks
        sequence = TaskContext.get().partitionId() << 32

        def rows() -> Iterator[tuple]:
            nonlocal key_type
            for batch in chunks(batches, "_text", 4 << 20):
                key_type = batch.column(0).type
                for k, ids in zip(batch.column(0).to_pylist(), encode.batch(batch.column(1))):
                    yield k, ids, encode.sentence_ends(ids)

        def table(out: list[tuple], pieces: list) -> pa.RecordBatch:
            cols = list(zip(*out))
            arrays = [pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:])]
            if with_ids:
                bounds = np.cumsum([0, *map(len, pieces)])
                arrays.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(pieces).astype(np.int32))))
            return pa.RecordBatch.from_arrays(arrays, names=["_key", *numbers, *["ids"] * with_ids])

        out, pieces = [], []
        for window in pack_stream(rows(), max_len, block):
            offset, size = 0, sum(len(p[2]) for p in window)
            for k, start, ids, doc_tokens in window:
                out.append((k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, sequence, offset, size))
                if with_ids:
                    pieces.append(ids)
                offset += len(ids)
            sequence += 1
            if len(out) >= 4096:
                yield table(out, pieces)
                out, pieces = [], []
        if out:
            yield table(out, pieces)

    return data.mapInArrow(run, schema).withColumnRenamed("_key", key)
