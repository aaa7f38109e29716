"""Periodic runs of a text's words by suffix-tree longest common extensions.

A run is a stretch of words with smallest period q, at least ``max(min_length,
2 q)`` words long, that no neighbouring word extends. Every run holds a Lyndon
root: under one of the two orders of the alphabet the longest Lyndon word that
starts at some place of the run is as long as the period. So the steps are:

1. A suffix tree of the document (Ukkonen) and one of its reversal.
2. The Euler tour of a tree, kept as the shallowest node between neighbouring
   leaves under a sparse table, answers a lowest-common-ancestor question, and
   with it a longest common extension, in constant time.
3. Leaf orders of the forward tree under both orders of the alphabet give the
   next smaller suffix of every place, that is its longest Lyndon word [i, j).
4. Each such candidate is extended to the right from (i, j) in the forward tree
   and to the left from (i - 1, j - 1) in the reversal's; it is a run if both
   extensions together reach the length of the root.

Before the trees are built, words that no run can hold leave the document: a run
of length L >= max(12, 2 q) repeats ``L - q >= 6`` words at the distance q, so
each of its words is covered by a six-word gram that occurs twice in the run.
Stretches covered by repeated grams are found by sorting gram hashes (a
collision only keeps a stretch too many), again inside each stretch until
nothing changes. A document's remaining stretches are one string for the trees,
parted by symbols that occur once, which no run can hold.

Each document is worked on where it is read: no shuffle, and a lost task gives
the same rows again. Memory is that of an Arrow slice of about 4 MB of text or of
one longer document, and of the trees of one document's repeating stretches
(about 0.5 KB a word).

Defined results: a null or empty text has no words, no runs and an empty collapsed
text; repeated rows each get their row; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Runs shorter than this are not reported.
MIN_LENGTH = 12
_MIX = np.uint64(0x9E3779B97F4A7C15)


class SuffixTree:
    """Suffix tree of a list of integers 1 .. sigma - 1, closed by the terminal 0 (Ukkonen's construction)."""

    def __init__(self, symbols: list[int], sigma: int):
        text = [*symbols, 0]
        n = len(text)
        begin, end, link, edges = [0], [0], [0], {}
        leaf = []  # node of suffix 0, 1, ...: leaves appear in this order
        node = at = length = remaining = 0
        for i, c in enumerate(text):
            pending = 0
            remaining += 1
            while remaining:
                if not length:
                    at = i
                key = node * sigma + text[at]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(begin)
                    leaf.append(len(begin))
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    if pending:
                        link[pending] = node
                        pending = 0
                else:
                    b = begin[child]
                    size = end[child] - b
                    if length >= size:
                        node = child
                        at += size
                        length -= size
                        continue
                    if text[b + length] == c:
                        length += 1
                        if pending:
                            link[pending] = node
                        break
                    fork = len(begin)
                    begin += (b, i)
                    end += (b + length, n)
                    link += (0, 0)
                    leaf.append(fork + 1)
                    edges[key] = fork
                    edges[fork * sigma + c] = fork + 1
                    begin[child] = b + length
                    edges[fork * sigma + text[b + length]] = child
                    if pending:
                        link[pending] = fork
                    pending = fork
                remaining -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - remaining + 1
        self.n, self.sigma = n, sigma
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        self.parent, self.symbol = np.divmod(keys, sigma)
        self.child = np.fromiter(edges.values(), np.int64, len(edges))
        self.size = (np.array(end) - np.array(begin)).tolist()
        self.suffix = np.full(len(begin), -1)
        self.suffix[leaf] = np.arange(n)

    def leaves(self, descending: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in lexicographic order (the terminal is the least symbol in both orders), and the string
        depth of the lowest common ancestor of each leaf and the one before it."""
        symbol = (self.sigma - self.symbol) % self.sigma if descending else self.symbol
        order = np.argsort(self.parent * self.sigma + symbol)
        kids = self.child[order].tolist()
        bounds = np.searchsorted(self.parent[order], np.arange(len(self.size) + 1)).tolist()
        size, suffix = self.size, self.suffix.tolist()
        out, shared = [], []
        # (edge number, string depth of the parent); the tour's shallowest node since the last leaf is ``turn``
        stack = [(k, 0) for k in range(bounds[1] - 1, -1, -1)]
        turn = 0
        while stack:
            k, depth = stack.pop()
            node = kids[k]
            if depth < turn:
                turn = depth
            s = suffix[node]
            if s >= 0:
                out.append(s)
                shared.append(turn)
                turn = self.n
            else:
                depth += size[node]
                stack += [(e, depth) for e in range(bounds[node + 1] - 1, bounds[node] - 1, -1)]
        return np.array(out), np.array(shared, np.int32)


class Extension:
    """Longest common extensions of pairs of places, from a tree's leaf order."""

    def __init__(self, order: np.ndarray, shared: np.ndarray):
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.levels = [shared]
        step = 1
        while 2 * step <= len(shared):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-step], below[step:]))
            step *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extensions of the suffixes at ``a`` and ``b`` (a <> b)."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            table = self.levels[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """For every suffix the next one that is smaller; the last (the terminal) is its own."""
    n = len(rank)
    after = [n - 1] * n
    for i in range(n - 2, -1, -1):
        j, r = i + 1, rank[i]
        while rank[j] > r:
            j = after[j]
        after[i] = j
    return after


def runs(symbols: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all runs of an array of integers."""
    m = len(symbols)
    if m < 2:
        return np.zeros((0, 3), np.int64)
    values, codes = np.unique(symbols, return_inverse=True)
    codes, sigma = codes + 1, len(values) + 1
    tree = SuffixTree(codes.tolist(), sigma)
    order, shared = tree.leaves()
    ahead = Extension(order, shared)
    flipped = np.empty(m + 1, np.int64)
    flipped[tree.leaves(descending=True)[0]] = np.arange(m + 1)
    del tree
    back = Extension(*SuffixTree(codes[::-1].tolist(), sigma).leaves())
    i = np.tile(np.arange(m), 2)
    j = np.array(next_smaller(ahead.rank.tolist())[:-1] + next_smaller(flipped.tolist())[:-1])
    period = j - i
    right = ahead(i, j)
    left = back(m - i, m - j)
    start, length = i - left, left + period + right
    keep = length >= np.maximum(2 * period, min_length)
    found = np.stack([start[keep], period[keep], length[keep]], axis=1)
    return np.unique(found, axis=0)[:, [0, 2, 1]]


def repeating(codes: np.ndarray, bounds: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of ``codes`` (inside documents given by their ``bounds``) all of whose
    words are covered by grams that occur twice in the stretch."""
    total = len(codes)
    if total < gram:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.zeros(total - gram + 1, np.uint64)
    for k in range(gram):
        value = value * _MIX + codes[k:total - gram + 1 + k].astype(np.uint64)
        value ^= value >> np.uint64(29)
    starts, ends = bounds[:-1], bounds[1:]
    while True:
        wide = ends - starts >= gram + 1
        starts, ends = starts[wide], ends[wide]
        if not len(starts):
            return starts, ends
        counts = ends - starts - gram + 1
        number = np.repeat(np.arange(len(starts), dtype=np.uint64), counts)
        at = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        key = (value[at] ^ (number * _MIX)) * _MIX + number
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if not twice.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # covered places: a gram begins here and not at the end; stretches of two documents never join
        first, of = at[twice], number[twice]
        fresh = np.ones(len(first), bool)
        fresh[1:] = (of[1:] != of[:-1]) | (first[1:] > first[:-1] + gram)
        last = np.append(first[:-1][fresh[1:]], first[-1]) + gram
        new = first[fresh], last
        if len(new[0]) == len(starts) and (new[0] == starts).all() and (new[1] == ends).all():
            return starts, ends
        starts, ends = new


def document_runs(codes: np.ndarray, pieces: list[tuple[int, int]], min_length: int = MIN_LENGTH) -> np.ndarray:
    """Runs of a document that lie in its repeating stretches ``pieces`` (start, end), as one string."""
    parts, origin = [], []
    top = int(codes.max()) + 1
    for k, (a, b) in enumerate(pieces):
        parts += [codes[a:b], [top + k]]
        origin += [np.arange(a, b), [-1]]
    found = runs(np.concatenate(parts[:-1]), min_length)
    found[:, 0] = np.concatenate(origin[:-1])[found[:, 0]]
    return found


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Mask of the words that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per document: key, n_words, runs array<struct<start, length, period>> by start and period, and
    ``collapsed``, the words without the repetitions of each run's first period, joined by one space.

    Words are stretches without the six white-space characters of ASCII.
    """
    if min_length < 2:
        raise ValueError("a run has at least two words")
    gram = (min_length + 1) // 2
    data = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = data.schema["_key"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text", 4 << 20):
            words = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            bounds = np.cumsum([0, *map(len, words)])
            codes = pa.array([w for d in words for w in d], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
            starts, ends = repeating(codes, bounds, gram)
            wide = ends - starts >= min_length
            starts, ends = starts[wide], ends[wide]
            of = np.searchsorted(bounds, starts, side="right") - 1
            found = {}
            for d in np.unique(of).tolist():
                at = bounds[d]
                pieces = [(a - at, b - at) for a, b in zip(starts[of == d].tolist(), ends[of == d].tolist())]
                rows = document_runs(codes[at:bounds[d + 1]], pieces, min_length)
                if len(rows):
                    found[d] = rows
                    words[d] = [w for w, k in zip(words[d], kept_words(len(words[d]), rows).tolist()) if k]
            none = np.zeros((0, 3), np.int64)
            per = [found.get(d, none) for d in range(len(words))]
            flat = np.concatenate(per)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, per)]), pa.int32()),
                                             pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(run)))
            joined = pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), lists, joined],
                                             names=["_key", "n_words", "runs", "collapsed"])

    schema = f"_key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return data.mapInArrow(work, schema).withColumnRenamed("_key", key)
