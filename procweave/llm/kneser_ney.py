"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is a character 5-gram model per language, trained on all documents
with a trusted label except every ``HOLDOUT``-th, which only set thresholds.
Counts are gathered per task, summed by key, and turned into probabilities from
the lowest order up by joins sharded on the n-gram: an order's counts meet their
context totals and the next lower order's probabilities. Lower orders use
continuation counts; discounts D1, D2, D3+ come from counts of counts.

For scoring, the model's entries (every seen n-gram's probability, every seen
context's back-off weight) of a language are dealt into shards of at most about
``SHARD_ENTRIES`` entries by the two characters before the scored one, since a
character's probability needs only entries that share them (entries of shorter
contexts go into every shard). Documents and shards are joined in parts, each one
task: a part has one shard of one language, which is sent ahead, and a group of the
language's documents, which are scored as they come in; a document's log-probability
is the sum over shards. Groups have ``GROUP_RATIO`` times the bytes of the shard, so
sending it to each of them costs little beside the texts. Nothing of the model goes
through the driver or is broadcast. A hot language has many groups.

A document is kept when its per-character perplexity is at most the ``QUANTILE``
quantile of the held-out trusted documents of its language (so about
``1 - QUANTILE`` of the good documents are rejected, and from 20 held-out
documents on no single odd one sets the threshold; with fewer the highest does).

Defined results: null text counts as empty (its end is still scored); a null
language is a language of its own; a language without trusted text has null
perplexity and threshold, and a language without held-out text has a null
threshold: such documents are kept. Rows are scored one by one; repeated labels
count once (any untrusted one wins). Whole texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import chunks, delete_staged, packed, small, stage, unpack

ORDER = 5
HOLDOUT = 10
QUANTILE = 0.95
SHARD_ENTRIES = 8_000_000
CHUNK = 1 << 19
#: A part has at least so many bytes of text, and so many times the bytes of the model that it reads.
GROUP_BYTES, GROUP_RATIO, ENTRY_BYTES = 8 << 20, 8, 12
#: Noncharacters that stand for the begin and the end of a text.
BEGIN, FINISH = 0xFDD0, 0xFDD1

_MUL = np.random.default_rng(1995).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
#: Added by order, so that n-grams and contexts of different lengths have different keys.
_GRAM_ORDER = np.arange(ORDER + 1, dtype=np.uint64) * _MUL[10]
_CONTEXT_ORDER = np.arange(ORDER + 1, dtype=np.uint64) * _MUL[11] + np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= _MUL[14]
    x ^= x >> np.uint64(29)
    return x


def _lang_seed(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 7))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of padded texts in a row, and each text's start; the scored positions start ORDER - 1 later."""
    pad, end = chr(BEGIN) * (ORDER - 1), chr(FINISH)
    joined = "".join([pad + t + end for t in texts])
    sizes = np.array([len(t) + ORDER for t in texts], np.int64)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(sizes) - sizes


def _sums(codes: np.ndarray) -> list[np.ndarray]:
    """Unmixed hashes of the n-grams that end at each position, by order 1 .. ORDER (short at the front: wrong there)."""
    c = codes.astype(np.uint64) + np.uint64(1)
    out = [c * _MUL[0]]
    for k in range(1, ORDER):
        shifted = np.zeros_like(c)
        shifted[k:] = c[:-k]
        out.append(out[-1] + shifted * _MUL[k])
    return out


def _gram_key(total: np.ndarray, order: int, seed: np.uint64) -> np.ndarray:
    return _mix(total + seed + _GRAM_ORDER[order])


def _context_key(total: np.ndarray, order: int, seed: np.uint64) -> np.ndarray:
    return _mix(total + seed + _CONTEXT_ORDER[order])


def _scored(starts: np.ndarray, size: int) -> np.ndarray:
    ok = np.ones(size, bool)
    for k in range(ORDER - 1):
        ok[starts + k] = False
    return ok


def _by_lang(langs: list[str], texts: list[str]) -> Iterator[tuple[str, list[int], list[str]]]:
    """Groups of row numbers and texts of one language, of about CHUNK characters."""
    groups: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        groups.setdefault(lang, []).append(i)
    for lang, rows in groups.items():
        held, size = [], 0
        for i in rows:
            held.append(i)
            size += len(texts[i])
            if size >= CHUNK:
                yield lang, held, [texts[j] for j in held]
                held, size = [], 0
        if held:
            yield lang, held, [texts[j] for j in held]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, c): counts of all ORDER-grams of ``docs`` (columns lang and packed text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        size = 0

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, g, c = (np.concatenate(x) for x in zip(*held[lang]))
            h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return h, g[first], np.bincount(inverse, weights=c).astype(np.int64)

        def send() -> Iterator[pa.RecordBatch]:
            for lang in held:
                _, g, c = merged(lang)
                text = g.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                for s in range(0, len(c), 100_000):
                    e = min(len(c), s + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * (e - s)), pa.array([text[i * ORDER:(i + 1) * ORDER] for i in range(s, e)]),
                         pa.array(c[s:e])], names=["lang", "gram", "c"])

        for batch in chunks(batches, "text", 2 << 20):
            langs, texts = batch.column(0).to_pylist(), [t.decode() for t in unpack(batch.column(1).to_pylist())]
            for lang, _, group in _by_lang(langs, texts):
                codes, starts = _codes(group)
                at = np.flatnonzero(_scored(starts, len(codes)))
                h, first, counts = np.unique(_gram_key(_sums(codes)[-1][at], ORDER, np.uint64(0)), return_index=True, return_counts=True)
                at = at[first]
                own = held.setdefault(lang, [])
                own.append((h, np.stack([codes[at - k] for k in range(ORDER - 1, -1, -1)], axis=1), counts))
                size += len(h)
                if size > 2_000_000:
                    held.update({k: [merged(k)] for k in held})
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > 1_500_000:
                        yield from send()
                        held.clear()
                        size = 0
        yield from send()

    return (docs.select("lang", "text").mapInArrow(run, "lang string, gram string, c long")
            .groupBy("lang", "gram").agg(F.sum("c").alias("c")))


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified Kneser-Ney discounts of one order from its counts of counts."""
    n = [F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    out = counts.groupBy("lang").agg(*n)
    for k in (1, 2, 3):
        raw = F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))
        # too few counts of counts for an estimate: half of the count's usual discount
        out = out.withColumn(f"d{k}", F.least(F.greatest(F.coalesce(raw, F.lit(0.5 * k)), F.lit(0.05)), F.lit(k - 0.05)))
    return out.select("lang", "d1", "d2", "d3")


def model(counts: DataFrame) -> DataFrame:
    """(kind, n, lang, gram, value): ln p of every seen n-gram (kind ``p``) and ln back-off weight of every context (``b``).

    The context of length 0 has the weight of an unseen character (already
    divided by the number of characters).
    """
    tables = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = (tables[n + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram"))
                     .agg(F.count(F.lit(1)).alias("c")))
    lower, out = None, []
    for n in range(1, ORDER + 1):
        t = tables[n].withColumn("h", F.expr(f"substring(gram, 1, {n - 1})"))
        d = F.broadcast(discounts(tables[n]))  # a row for each language of the labels
        context = (t.groupBy("lang", "h").agg(
            F.sum("c").alias("total"), F.sum((F.col("c") == 1).cast("long")).alias("n1"),
            F.sum((F.col("c") == 2).cast("long")).alias("n2"), F.sum((F.col("c") > 2).cast("long")).alias("n3"))
            .join(d, "lang")
            .select("lang", "h", "total", "d1", "d2", "d3", "n1", "n2", "n3",
                    ((F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")).alias("weight")))
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        joined = t.join(context, ["lang", "h"])
        if n == 1:
            uniform = F.col("weight") / (F.col("n1") + F.col("n2") + F.col("n3") + 1)
            p = joined.select("lang", "gram", ((F.col("c") - cut) / F.col("total") + uniform).alias("p"))
            out.append(context.select(F.lit("b").alias("kind"), F.lit(0).alias("n"), "lang", F.col("h").alias("gram"), F.log(uniform).alias("value")))
        else:
            below = lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("q"))
            p = (joined.withColumn("tail", F.expr("substring(gram, 2)")).join(below, ["lang", "tail"])
                 .select("lang", "gram", ((F.col("c") - cut) / F.col("total") + F.col("weight") * F.col("q")).alias("p")))
            out.append(context.select(F.lit("b").alias("kind"), F.lit(n - 1).alias("n"), "lang", F.col("h").alias("gram"), F.log("weight").alias("value")))
        lower = stage(p, f"kneser-ney-{n}")
        out.append(lower.select(F.lit("p").alias("kind"), F.lit(n).alias("n"), "lang", "gram", F.log("p").alias("value")))
    entries = out[0]
    for part in out[1:]:
        entries = entries.unionByName(part)
    return entries


def _shares(docs: DataFrame, entries: DataFrame, shard_entries: int) -> DataFrame:
    """(lang, shards, groups, first): for every language of the model, the shards of its entries, the groups that its
    documents are dealt into, and its first part; shard s and group g meet in part ``first + s * groups + g``."""
    sizes = docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    held = entries.groupBy("lang").agg(F.count(F.lit(1)).alias("entries"))
    dealt = (held.join(sizes, "lang", "left").withColumn("shards", F.ceil(F.col("entries") / shard_entries))
             .withColumn("least", F.greatest(F.lit(GROUP_BYTES), GROUP_RATIO * ENTRY_BYTES * F.col("entries") / F.col("shards")))
             .withColumn("groups", F.greatest(F.lit(1), F.ceil(F.coalesce("bytes", F.lit(0)) / F.col("least")))))
    before = Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)  # a row for each language of the model
    first = F.coalesce(F.sum(F.col("shards") * F.col("groups")).over(before), F.lit(0))
    return dealt.select("lang", "shards", "groups", first.alias("first"))


def _entry_keys(entries: DataFrame) -> DataFrame:
    """(lang, shard, keys, logs): hashed entries (columns lang, shards, kind, n, gram, value), many a row; shard -1 goes to all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, n, lang, gram, of = (batch.column(i).to_pylist() for i in range(5))
            value = batch.column(5).to_numpy().astype(np.float32)
            groups: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(lang, kind, n, of)):
                groups.setdefault(k, []).append(i)
            found: dict[tuple, list[tuple]] = {}
            for (name, k, size, shards), rows in groups.items():
                seed = _lang_seed(name)
                codes = np.frombuffer("".join([gram[i] for i in rows]).encode("utf-32-le", "surrogatepass"), np.uint32)
                codes = codes.reshape(len(rows), size).astype(np.uint64) + np.uint64(1) if size else np.zeros((len(rows), 0), np.uint64)
                total = np.zeros(len(rows), np.uint64)
                for j in range(size):
                    total += codes[:, size - 1 - j] * _MUL[j]
                keys = _gram_key(total, size, seed) if k == "p" else _context_key(total, size, seed)
                last = size - 2 if k == "p" else size - 1  # the character before the scored one
                shard = _shard(codes[:, last], codes[:, last - 1], shards) if last >= 1 else np.full(len(rows), -1)
                for one in np.unique(shard).tolist():
                    found.setdefault((name, one), []).append((keys[shard == one], value[rows][shard == one]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()),
                 *(pa.array([np.concatenate([x[c] for x in parts]).tobytes() for parts in found.values()], pa.binary()) for c in (0, 1))],
                names=["lang", "shard", "keys", "logs"])

    return entries.select("kind", "n", "lang", "gram", "shards", "value").mapInArrow(run, "lang string, shard long, keys binary, logs binary")


def _shard(last: np.ndarray, before: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the two characters (code point + 1) before the scored one."""
    return (_mix(last * _MUL[12] + before * _MUL[13]) >> np.uint64(33)).astype(np.int64) % shards


class Table:
    """Key to value by one array access; keys that share a slot are in a sorted rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(10, int(2 * len(keys) + 1).bit_length()))
        slot = (keys >> self.shift).astype(np.int64)
        size = 1 << int(64 - int(self.shift))
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, np.nan, np.float32)
        self.keys[slot], self.values[slot] = keys, values  # of keys in one slot the last stays
        rest = self.keys[slot] != keys
        order = np.argsort(keys[rest])
        self.more, self.more_values = keys[rest][order], values[rest][order].astype(np.float32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN where there is none."""
        slot = (keys >> self.shift).astype(np.int64)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            out[miss] = np.nan
            if len(self.more):
                at = np.minimum(np.searchsorted(self.more, keys[miss]), len(self.more) - 1)
                hit = self.more[at] == keys[miss]
                out[miss[hit]] = self.more_values[at[hit]]
        return out


def log_probabilities(codes: np.ndarray, at: np.ndarray, seed: np.uint64, table: Table) -> np.ndarray:
    """ln p of the characters at the given positions."""
    sums = _sums(codes)
    out = np.zeros(len(at))
    left = np.arange(len(at))
    for n in range(ORDER, 0, -1):
        p = table.get(_gram_key(sums[n - 1][at[left]], n, seed))
        seen = ~np.isnan(p)
        out[left[seen]] += p[seen]
        left = left[~seen]
        if not len(left):
            return out
        before = at[left] - 1
        total = sums[n - 2][before] if n > 1 else np.zeros(len(left), np.uint64)
        weight = table.get(_context_key(total, n - 1, seed))
        out[left] += np.where(np.isnan(weight), 0.0, weight)
    return out


def score(docs: DataFrame, entries: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(columns of ``docs`` but text, n_tokens, log_p): ``docs`` has lang and text (neither null) and others that tell rows apart.

    A language's entries and documents meet in its parts: a part is one task, which reads its shard of the entries
    first and then scores its documents as they come. Without a model of its language a document's log_p is 0.
    """
    own = docs.withColumn("n_tokens", (F.length("text") + 1).cast("long"))
    others = [c for c in own.columns if c != "text"]
    shares = stage(_shares(docs, entries, shard_entries), "kneser-ney-shares")
    parts, most = shares.agg(F.sum(F.col("shards") * F.col("groups")), F.max("shards")).first()
    if not parts:
        return own.select(*others, F.lit(0.0).alias("log_p"))
    by_lang = small(shares)
    group = F.pmod(F.xxhash64(*others), F.col("groups"))
    texts = packed(own).join(by_lang, "lang", "left")
    texts = texts.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("shards"), F.lit(1)) - 1)))
    texts = texts.select(
        F.coalesce(F.col("first") + F.col("shard") * F.col("groups") + group, F.pmod(F.xxhash64(*others), F.lit(parts))).cast("int").alias("part"),
        F.lit(1).alias("kind"), *others, F.when(F.col("shards").isNotNull(), F.col("text")).alias("text"), "shards", "shard",
        *[F.lit(None).cast("binary").alias(c) for c in ("keys", "logs")])
    model_rows = _entry_keys(entries.join(by_lang, "lang")).join(by_lang, "lang")
    every = F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)
    model_rows = model_rows.withColumn("at", F.explode(F.when(F.col("shard") < 0, every).otherwise(F.array("shard"))))
    model_rows = model_rows.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).select(
        (F.col("first") + F.col("at") * F.col("groups") + F.col("group")).cast("int").alias("part"), F.lit(0).alias("kind"),
        *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in others], F.lit(None).cast("binary").alias("text"),
        *[F.lit(None).cast("long").alias(c) for c in ("shards", "shard")], "keys", "logs")
    met = model_rows.unionByName(texts).repartitionById(parts, "part").sortWithinPartitions("kind").drop("part")
    width = len(others)
    at_lang = 1 + others.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table = [(np.zeros(0, np.uint64), np.zeros(0, np.float32))], None
        for batch in chunks(batches, "text", 2 << 20):
            first = int(np.searchsorted(batch.column(0).to_numpy(), 1))
            held += [(np.frombuffer(k, np.uint64), np.frombuffer(v, np.float32)) for k, v in
                     zip(batch.column(width + 4)[:first].to_pylist(), batch.column(width + 5)[:first].to_pylist())]
            batch = batch.slice(first)
            if not batch.num_rows:
                continue
            if table is None:
                table, held = Table(*(np.concatenate(x) for x in zip(*held))), []
            log_p = np.zeros(batch.num_rows)
            body = batch.column(width + 1)
            with_model = np.flatnonzero(body.is_valid().to_numpy(zero_copy_only=False))
            texts = [t.decode() for t in unpack(body.drop_null().to_pylist())]
            langs = batch.column(at_lang).take(pa.array(with_model)).to_pylist()
            for lang, rows, group in _by_lang(langs, texts):
                codes, starts = _codes(group)
                ok = _scored(starts, len(codes))
                where = with_model[rows]
                shards, shard = (batch.column(width + c)[int(where[0])].as_py() for c in (2, 3))  # the same for all of a part
                if shards > 1:
                    c = codes.astype(np.uint64) + np.uint64(1)
                    ok[2:] &= _shard(c[1:-1], c[:-2], shards) == shard
                at = np.flatnonzero(ok)
                row = np.searchsorted(starts, at, side="right") - 1
                log_p[where] = np.bincount(row, weights=log_probabilities(codes, at, _lang_seed(lang), table), minlength=len(rows))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:1 + width], pa.array(log_p)], names=[*others, "log_p"])

    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in others)
    scored = met.mapInArrow(run, f"{kinds}, log_p double")
    return scored if most == 1 else scored.groupBy(*others).agg(F.sum("log_p").alias("log_p"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             quantile: float = QUANTILE, holdout: int = HOLDOUT, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """One row per input row: key, lang, n_tokens, perplexity, threshold, kept.

    ``labels`` has ``key``, ``quality`` and ``toxic``; trusted is quality 1 and not toxic.
    """
    trusted = (labels.select(F.col(key).alias("_key"), F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False)).alias("ok"))
               .groupBy("_key").agg(F.min("ok").alias("ok")).where("ok and _key is not null").select("_key"))
    held = F.pmod(F.xxhash64("_key"), F.lit(holdout)) == 0
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # a merge join at every size: which texts move does not depend on how many labels there are
    train = packed(rows).join(trusted.where(~held).hint("merge"), "_key", "left_semi").select("lang", "text")
    counts = stage(count_grams(train), "kneser-ney-counts")
    entries = stage(model(counts), "kneser-ney-model")
    numbered = rows.select("lang", "text", F.col("_key"), F.monotonically_increasing_id().alias("_row"))
    scored = stage(score(numbered, entries, shard_entries), "kneser-ney-scores")
    delete_staged(counts)
    known = entries.where("kind = 'b' and n = 0").select(F.col("lang").alias("_known"))
    per = scored.withColumn("perplexity", F.exp(-F.col("log_p") / F.col("n_tokens")))
    limits = (per.join(trusted.where(held), "_key", "left_semi").groupBy("lang")
              .agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(10000)).alias("threshold")))
    # a row for each language
    limits = small(known.join(limits, F.col("_known") == F.col("lang"), "left").select("_known", "threshold"))
    judged = per.join(limits, per["lang"] == limits["_known"], "left")
    known_lang = F.col("_known").isNotNull()
    return judged.select(F.col("_key").alias(key), F.col("lang"), "n_tokens",
                         F.when(known_lang, F.round("perplexity", 6)).alias("perplexity"), F.round("threshold", 6).alias("threshold"),
                         F.coalesce(~known_lang | (F.col("perplexity") <= F.col("threshold")), F.lit(True)).alias("kept"))
