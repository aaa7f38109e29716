"""Ranked search, periodic runs, best-fit packing."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from procweave.llm import best_fit, packing, periodic_runs, queries, ranked_search

EXTRA = "key string, size long, bin int, _key string, norm double, terms int, query int, runs int, collapsed int, offset int"


def docs(spark, rows, kind="long", parts=3):
    """Documents with extra columns whose names clash with columns the operators make."""
    data = [(i, t, "k", 1, 2, "x", 0.5, 3, 4, 5, 6, 7) for i, t in rows]
    frame = spark.createDataFrame(data, f"doc_id {kind}, text string, {EXTRA}")
    return frame.repartition(parts) if rows else frame


# ------------------------------------------------------------------ periodic runs

def brute_runs(words, least):
    numbers = {}
    words = [numbers.setdefault(w, len(numbers)) for w in words]
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q):
                part = words[i:i + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_document(text, least=12):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = brute_runs(words, least)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return len(words), found, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_random_strings():
    rng = random.Random(1)
    for _ in range(1500):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(45))]
        least = rng.choice([2, 5, 12])
        assert [tuple(r) for r in periodic_runs.runs(np.array(w, np.int64), least).tolist()] == brute_runs(w, least), (w, least)


def test_suffix_tree_orders_and_extensions():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 30))]
        order, shared = periodic_runs.SuffixTree(s, 4).leaves()
        assert order.tolist() == sorted(range(len(s) + 1), key=lambda i: s[i:])
        flipped = periodic_runs.SuffixTree(s, 4).leaves(descending=True)[0]
        assert flipped.tolist() == sorted(range(len(s) + 1), key=lambda i: [-c for c in s[i:]])
        a, b = zip(*[(i, j) for i in range(len(s) + 1) for j in range(len(s) + 1) if i != j])
        want = [next((k for k in range(len(s)) if s[i + k:i + k + 1] != s[j + k:j + k + 1] or i + k >= len(s)), 0) for i, j in zip(a, b)]
        assert periodic_runs.Extension(order, shared)(np.array(a), np.array(b)).tolist() == want


def periodic_rows():
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a " * 11), (4, "a " * 12), (5, "a\x0ba\x0ca\r" * 5), (6, "é x " * 30), (7, "a b\x00c " * 9)]
    for i in range(8, 70):
        words = [f"w{rng.randrange(rng.choice([2, 4, 30, 400]))}" for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(4)):  # repetitions, lines that come again elsewhere, nested ones
            a = rng.randrange(len(words))
            p = rng.randrange(1, 25)
            words[a:a] = words[a:a + p] * rng.randrange(1, 6) + words[a:a + p // 2]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(200, rows[-1][1]), (200, rows[-1][1]), (201, " ".join(f"x{rng.randrange(9)}" for _ in range(900))),
             (202, " ".join(["p q r s t u v w"] * 5000)), (203, "x" * 300_000 + " y" * 40)]
    return rows


@pytest.mark.parametrize("least", [12, 5])
def test_documents_match_brute_force(spark, least):
    rows = periodic_rows()
    got = periodic_runs.find_runs(docs(spark, rows), min_length=least)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    found = sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect())
    want = []
    for i, text in rows:
        if i == 202:  # one run over the whole text
            want.append((i, 40_000, [(0, 40_000, 8)], "p q r s t u v w"))
        else:
            want.append((i, *brute_document(text, least)))
    assert found == sorted(want)


def test_runs_of_empty_tables_and_other_ids(spark):
    assert periodic_runs.find_runs(docs(spark, [])).count() == 0
    one = periodic_runs.find_runs(docs(spark, [("u", "a b " * 20), (None, None)], "string")).collect()
    assert {(r.doc_id, r.n_words, len(r.runs), r.collapsed) for r in one} == {("u", 40, 1, "a b"), (None, 0, 0, "")}


def test_periodic_query_matches_brute_force(spark, sf_small):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf_small).collect()}
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    planted = 0
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            planted += 1
        _, found, kept = brute_document(" ".join(words))
        r = got[i]
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (
            len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4)), i
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert planted


# ------------------------------------------------------------------ best-fit packing

def test_best_fit_chooses_the_least_room():
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.randrange(1, 21) for _ in range(rng.randrange(40))]
        rooms, want = [], []
        for s in sizes:
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms[rooms.index(min(fits))] -= s
            else:
                rooms.append(20 - s)
            want.append(sorted(rooms))
        bins = best_fit.best_fit(sizes, 20)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert sorted(20 - sum(sizes[i] for i in b) for b in bins) == (want[-1] if want else [])


def test_cut_keeps_whole_sequences_at_the_end():
    assert best_fit.cut(1, 8) == [(0, 1)] and best_fit.cut(8, 8) == [(0, 8)]
    assert best_fit.cut(9, 8) == [(0, 1), (1, 8)] and best_fit.cut(16, 8) == [(0, 8), (8, 8)]


def default_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_bins(got, rows, max_len=1024, end=2):
    """Round trip: every document's ids come back once; sequences have no gaps."""
    tokenizer = default_tokenizer()
    want = Counter()
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        if len(ids) <= max_len:
            bounds = [(0, len(ids))]
        else:
            first = len(ids) % max_len or max_len
            bounds = [(0, first), *((s, max_len) for s in range(first, len(ids), max_len))]
        want += Counter((i, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(bounds))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= max_len and {r.sequence_length for r in pieces} == {at}
    return len(sequences)


def bin_rows(rng, n):
    rows = [(0, None), (1, ""), (2, "a<|endoftext|>b <|endoftext|>"), (3, "word " * 5000), (4, "é" * 3000), (4, "é" * 3000)]
    return rows + [(10 + i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 50, 200, 400])))) for i in range(n)]


@pytest.mark.parametrize(("items", "fan_in"), [(1 << 15, 8), (20, 2)])
def test_bins_round_trip(spark, items, fan_in):
    rows = bin_rows(random.Random(5), 400)
    pieces = best_fit.pack(docs(spark, rows, parts=5), items=items, fan_in=fan_in)
    got = pieces.collect()
    used = check_bins(got, rows)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    whole = len(best_fit.best_fit(sorted((r.length for r in got), reverse=True), 1024))  # all pieces at once
    assert used <= math.ceil(1.03 * whole)


def test_residual_rounds_save_bins(spark):
    rows = [(i, " ".join(["word"] * (150 + 37 * i % 300))) for i in range(300)]
    flat = best_fit._local(docs(spark, rows, parts=30).selectExpr("doc_id _key", "text _text"), 1024, 2, packing.RANKS, False)
    assert check_bins(best_fit.pack(docs(spark, rows, parts=30)).collect(), rows) < flat.count()


def test_bins_that_never_fit_end(spark):
    rows = [(i, " word" * 600) for i in range(120)]
    got = best_fit.pack(docs(spark, rows, parts=12), items=10, fan_in=2, with_ids=False).collect()
    assert check_bins(got, rows) == 120


def test_bins_of_empty_tables_and_other_ids(spark):
    assert best_fit.pack(docs(spark, [])).count() == 0
    got = best_fit.pack(docs(spark, [("u", "a b"), (None, None)], "string"), with_ids=False).collect()
    check_bins(got, [("u", "a b"), (None, None)])


def test_best_fit_query(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_best_fit(spark, sf_small).collect()
    used = check_bins(got, rows)
    assert used <= math.ceil(1.02 * sum(r.length for r in got) / 1024) + 1


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|>", "<|endoftext|>b", "a <|endoftext|> b  <|endoftext|><|endoftext|>c ", "<|endoftext|",
                                  "one two<|endoftext|> three\n\n<|endoftext|>\n four", "  <|endoftext|>  "])
def test_added_tokens_have_their_ids(text):
    want = default_tokenizer().encode(text, add_special_tokens=False).ids
    for near in ([text], ["plain words", text, ""]):
        assert packing.Encoder().batch(near)[near.index(text)].tolist() == [*want, packing.END]


# ------------------------------------------------------------------ ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_search(rows, items, top=20):
    bags = [(i, Counter(brute_terms(t))) for i, t in rows]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    out = []
    for item, text in items:
        query = Counter(brute_terms(text))
        scores = []
        for i, b in bags:
            m = 75 + (25 * sum(b.values()) * n) // total
            score = 0
            for t, c in query.items():
                if t in b:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in x for _, x in bags) + 1)))
                    score += c * w * ((10 ** 9 * b[t]) // (1000 * b[t] + 12 * m))
            if score > 0:
                scores.append((-score, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def search_rows(rng, n):
    rows = [(0, None), (1, ""), (2, "-- !!"), (3, "É é Ä x1 X1"), (4, "w1 " * 3000), (5, "w1_w2-w3")]
    rows += [(10 + i, " ".join(f"w{min(rng.randrange(300), rng.randrange(300))}" for _ in range(rng.choice([1, 5, 40, 300])))) for i in range(n)]
    rows += [(900 + i, "w1 w2 w7 w250 w251 w252") for i in range(60)] + [(905, "w1 w2 w7 w250 w251 w252")] * 3
    return rows


@pytest.mark.parametrize(("bucket", "block_terms"), [(4096, 500_000), (7, 500_000), (50, 25)])
def test_search_matches_brute_force(spark, bucket, block_terms):
    rng = random.Random(6)
    rows = search_rows(rng, 250)
    items = [(1, "w250 w251 W252"), (2, None), (3, ""), (4, "w1"), (5, "x1 é nowhere"), (5, "w3 w3 w9 w200"), (5, "w3 w3 w9 w200")]
    items += [(10 + i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 25)))) for i in range(12)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, query int")
    got = ranked_search.search(docs(spark, rows), frame, bucket=bucket, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(tuple(r) for r in got.collect()) == brute_search(rows, list(dict.fromkeys(items)))


def test_bounds_keep_every_document_that_reaches_the_threshold():
    rng = np.random.default_rng(7)
    weights = rng.integers(0, 8000, 40)
    counts = [{int(t): int(rng.integers(1, 4)) for t in rng.choice(40, rng.integers(1, 12), replace=False)} for _ in range(30)]
    asked = ranked_search.Queries(list(range(30)), counts, weights)
    import pyarrow as pa
    vectors = []
    for _ in range(200):
        t = np.sort(rng.choice(np.flatnonzero(weights), rng.integers(1, 15), replace=False))
        p = rng.integers(1, 900_000, len(t))
        vectors.append((math.sqrt(float((weights[t] * p.astype(float) ** 2).sum())), t, p))
    vectors.sort(key=lambda v: -v[0])
    bucket = ranked_search.Bucket(pa.array(range(200)), np.array([v[0] for v in vectors]), np.array([len(v[1]) for v in vectors]),
                                  np.concatenate([v[1] for v in vectors]), np.concatenate([v[2] for v in vectors]))
    pruned = 0
    for q, count in enumerate(counts):
        exact = np.array([sum(c * int(weights[t]) * int(p[list(ts).index(t)]) for t, c in count.items() if t in ts) for _, ts, p in vectors])
        for least in (1, *np.quantile(exact, [0.3, 0.8, 0.97, 1.0]).astype(int).tolist()):
            if least > 0:
                kept = bucket.survivors(asked, q, least)
                assert set(np.flatnonzero(exact >= least)) <= set(kept)
                assert bucket.scores(asked, q, kept).tolist() == exact[kept].tolist()
                pruned += 200 - len(kept)
    assert pruned > 5000


def test_search_of_empty_tables_and_other_ids(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    one = spark.createDataFrame([("q", "a b")], "item_id string, text string")
    assert ranked_search.search(docs(spark, []), one).count() == 0
    assert ranked_search.search(docs(spark, [(1, "a")]), none).count() == 0
    assert ranked_search.search(docs(spark, [(1, None)]), one).count() == 0
    got = ranked_search.search(docs(spark, [("v", "b c d e"), ("u", "b c d e"), (None, "b c d e"), ("w", "c d")], "string"), one).collect()
    assert [(r.rank, r.doc_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, None), (2, "u"), (3, "v")]
    assert dict(ranked_search.search(docs(spark, []), one).dtypes) == {"item_id": "string", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_search_query_has_its_columns(spark, sf_small):
    got = queries.op11_ranked_search(spark, sf_small)
    assert {"item_id", "rank", "doc_id", "score"} <= set(got.columns)
    assert got.where(F.col("score") <= 0).count() == 0
