"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Every text gets word, symbol, line and repetition counts in one projection. The
fixed base rule rejects very short and very repetitive texts. On top, one joint
rule per stratum (language) rejects a text when any measure (a ratio of counts)
is above that measure's cutoff. The cutoff vectors form one fixed sequence
(:func:`sequence`): each step tightens one measure by one place of its grid, in
the order of the places' share of the grid, so every step rejects all that the
step before rejects. For every step, the good holdout texts it rejects are
counted, and the step is admissible when the exact one-sided binomial
(Clopper-Pearson) test rejects "the false rejection rate is above ``risk``" at
level ``delta / families``; testing stops at the first failure (fixed-sequence
testing), which divides neither risk nor delta by measures or steps.

Families (Bonferroni) are the strata with enough good holdout texts to pass at
``delta`` when none is rejected (299 for 0.01 and 0.05) and, if there are others,
those others taken together as one more stratum. A stratum that is too small to
pass on its own at the level of a family belongs to the others too; it uses the steps
that their joint holdout admits, as far as they reject at most ``risk`` of its own good
holdout texts (it needs one at least). Labels of a stratum tested on its own lend the
others nothing. So with probability ``1 - delta`` the learned rules falsely reject at
most ``risk`` of the good texts in every stratum: each large one, and the others taken
as one. A stratum without proof keeps the base rule. Among admissible steps the one that rejects
most bad minus good holdout texts of the stratum is used (the most lenient of
equals), and none if that is not positive.

All labelled rows that pass the base rule are the holdout (nothing is fitted on
them except the choice that the test controls).

Defined results: null text counts as no words (``base_failed``); a null stratum
is its own stratum; rows are judged one by one, repeated rows too; repeated
labels of a document count once (the worst label wins); labels without a
document and null labels are ignored; with no labels only the base rule acts.
Only the key, text and stratum columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import free_name, small, stage

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RISK = 0.01
DELTA = 0.05

#: Grid of cutoffs by measure, lenient to strict.
GRIDS = {
    "symbols_per_word": (4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05),
    "chars_per_word": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0, 9.0, 8.0),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "bangs_per_word": (2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05),
}


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (several times)."""
    return F.transform(F.array(value), body)[0]


def _paired(step: int, words: Column):
    return lambda h: F.zip_with(h, F.slice(h, F.lit(step + 1), F.size(words)), lambda a, b: F.xxhash64(a, b))


def _repeat_words(words: Column) -> Column:
    """Words covered by WINDOW-word windows that occur twice or more, from 64-bit window hashes."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words: each pairs the one before with itself, ``step`` words on
        hashes = _let(hashes, _paired(step, words))
    hashes = F.slice(hashes, F.lit(1), F.size(words) - (WINDOW - 1))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            return F.sort_array(F.transform(F.filter(p, lambda x, i: (
                ((i > 0) & (F.get(p, i - 1)["h"] == x["h"])) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)))),
                lambda x: x["i"]))

        total = F.aggregate(
            _let(pairs, starts), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda acc, s: F.struct((s + WINDOW).alias("end"),
                                    (acc["n"] + (s + WINDOW - F.greatest(s, acc["end"])).cast("long")).alias("n")),
            lambda acc: acc["n"])
        # most texts repeat no window: they skip the sort
        return F.when(F.size(F.array_distinct(h)) < F.size(h), total).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) > WINDOW, _let(hashes, covered)).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
            carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts of every text: one projection, no shuffle."""
    carried = [f"_c{i}" for i in range(len(carry))]
    base = docs.select(F.col(key).alias("_key"), F.col(stratum).cast("string").alias("_stratum"),
                       *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    words = F.array_remove(F.split(F.col("_text"), SPACE + "+"), "")
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = base.select(
        "_key", "_stratum", *carried,
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"),
                                       F.length(F.array_join(w, "")).cast("long").alias("word_chars"))).alias("w"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(F.replace("_text", F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                       (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (counts.select("_key", "_stratum", *carried, "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines",
                          "w.n_repeat_words", "n_bangs", "l.n_lines")
            .withColumn("base_failed", failed))


def measures() -> dict[str, Column]:
    """Ratios that cutoffs apply to (0 where the denominator is 0)."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": per_word("n_symbols"),
        "chars_per_word": per_word("word_chars"),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "bangs_per_word": per_word("n_bangs"),
    }


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, taken back by the recurrence."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5))
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + i)
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p): the exact sum from term k downwards, until terms are below 1e-17 of it.

    Left of the mean terms fall at least by the ratio of the first two, so a
    few thousand terms are more than enough where k < n p; where k >= n p the
    value is at least 0.25 and 1 is returned (no test can pass there).
    """
    log_top = (_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    reach = F.least(k, F.ceil(12 * F.sqrt(n * p)) + 60)
    # each step: term(i - 1) = term(i) * i / (n - i + 1) * (1 - p) / p, relative to term k
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    steps = F.when(reach >= 1, F.sequence(F.lit(1).cast("long"), reach.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def add(acc: Column, j: Column) -> Column:
        i = k - j + 1
        t = acc["t"] * i / (n - i + 1) * ((1 - p) / p)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    total = F.aggregate(steps, start, add, lambda acc: acc["s"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_top) * total)


def sequence(grids=GRIDS) -> list[tuple[str, float]]:
    """The steps of the joint rule, lenient to strict: (measure, its cutoff from this step on)."""
    steps = [((i + 1) / len(grid), n, m, c) for n, (m, grid) in enumerate(grids.items()) for i, c in enumerate(grid)]
    return [(m, c) for _, _, m, c in sorted(steps)]


def choose_cutoffs(counts: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality",
                   risk: float = RISK, delta: float = DELTA, grids=GRIDS) -> DataFrame:
    """(_stratum, measure, cutoff): the chosen cutoffs, at most one per stratum and measure.

    ``counts`` comes from :func:`measure`; ``labels`` has ``key`` and ``good`` (1 / 0).
    """
    marks = (labels.select(F.col(key).alias("_key"), F.col(good).cast("int").alias("_good"))
             .where("_key is not null and _good is not null").groupBy("_key").agg(F.min("_good").alias("_good")))
    held = counts.where("not base_failed").select(
        "_key", "_stratum", *[c.alias(f"m_{m}") for m, c in measures().items() if m in grids])
    held = held.join(marks, "_key")
    # every labelled text adds to one cell: the first step of the sequence that rejects it, or the step behind the last
    order = sequence(grids)
    last = len(order)
    first = F.least(F.lit(last + 1), *[F.coalesce(F.get(
        F.array(*[F.lit(i + 1) for i, (name, _) in enumerate(order) if name == m]),
        sum([(F.col(f"m_{m}") <= c).cast("int") for c in grid], F.lit(0))), F.lit(last + 1)) for m, grid in grids.items()])
    cells = (held.select("_stratum", "_good", first.alias("step")).groupBy("_stratum", "step")
             .agg(F.sum((F.col("_good") == 1).cast("long")).alias("good"), F.sum((F.col("_good") == 0).cast("long")).alias("bad")))
    # every step is tested, also those that no labelled text lies between
    none = cells.select("_stratum").distinct().select(
        "_stratum", F.explode(F.sequence(F.lit(1), F.lit(last))).alias("step"), F.lit(0).alias("good"), F.lit(0).alias("bad"))
    whole = Window.partitionBy("_stratum")
    until = whole.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    tested = (cells.unionByName(none).groupBy("_stratum", "step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
              .withColumns({"n": F.sum("good").over(whole), "good": F.sum("good").over(until), "bad": F.sum("bad").over(until)})
              .where(F.col("step") <= last)
              .withColumn("p", binomial_tail(F.col("good").cast("double"), F.col("n").cast("double"), risk))
              .withColumn("worst", F.max("p").over(until)).withColumn("least", F.pow(F.lit(1 - risk), F.col("n"))))
    tested = stage(tested, "quality-steps")
    strata, alone = tested.where("step = 1").agg(
        F.count(F.lit(1)), F.coalesce(F.sum((F.col("least") <= delta).cast("long")), F.lit(0))).first()
    level = delta / max(1, alone + (strata > alone))
    if strata == alone and not tested.where(F.col("least") > level).isEmpty():  # some pass at delta, not at a family's level
        level = delta / (alone + 1)
    joint = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # a row per step
    pooled = (tested.where(F.col("least") > level).groupBy("step").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
              .withColumn("p", binomial_tail(F.col("good").cast("double"), F.col("n").cast("double"), risk))
              .withColumn("worst", F.max("p").over(joint)).where(F.col("worst") <= level).agg(F.max("step")).first()[0] or 0)
    own_rate = (F.col("n") > 0) & (F.col("good") <= risk * F.col("n"))
    passed = tested.where(F.when(F.col("least") <= level, F.col("worst") <= level).otherwise((F.col("step") <= pooled) & own_rate))
    gain = F.col("bad") - F.col("good")
    best = (passed.where(gain > 0).groupBy("_stratum")
            .agg(F.max(F.struct(gain.alias("gain"), (-F.col("step")).alias("s"))).alias("best")))
    vectors = F.array(*[F.struct(F.lit(m).alias("measure"), F.get(F.array(*[
        F.lit(min((c for name, c in order[:i + 1] if name == m), default=None)).cast("double") for i in range(last)]),
        -F.col("best.s") - 1).alias("cutoff")) for m in grids])
    return best.select("_stratum", F.explode(vectors).alias("v")).select("_stratum", "v.measure", "v.cutoff").where("cutoff is not null")


def apply_cutoffs(counts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``counts`` with ``kept``: not base_failed and no measure above its stratum's cutoff."""
    named = measures()
    one = (cutoffs.groupBy("_stratum").agg(*[F.min(F.when(F.col("measure") == m, F.col("cutoff"))).alias(f"c_{m}") for m in named])
           .withColumnRenamed("_stratum", "_cut_stratum"))
    rejected = F.lit(False)
    for m, value in named.items():
        rejected = rejected | F.coalesce(value > F.col(f"c_{m}"), F.lit(False))
    joined = counts.join(small(one), F.col("_stratum").eqNullSafe(F.col("_cut_stratum")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_cut_stratum", *[f"c_{m}" for m in named])


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
          risk: float = RISK, delta: float = DELTA, grids=GRIDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: key, carried columns, the counts, ``base_failed`` and ``kept``.

    The counts are written once to the shared folder (a few numbers per text),
    so choosing cutoffs and applying them do not read the texts twice.
    """
    counts = stage(measure(docs, key, text, stratum, carry), "quality")
    cutoffs = choose_cutoffs(counts, labels, key, risk=risk, delta=delta, grids=grids)
    return (apply_cutoffs(counts, cutoffs).drop("_stratum", "n_bangs", "n_lines").withColumnRenamed("_key", key)
            .select(key, *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
                    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", **options) -> DataFrame:
    """``docs`` without the rows that the rules reject."""
    # rows of one id are judged by their own text: the verdicts are joined on id and content
    mark = free_name(docs)
    marked = docs.withColumn(mark, F.xxhash64(text, stratum))
    verdicts = judge(marked, labels, key, text, stratum, carry=(mark,), **options).where("kept")
    verdicts = verdicts.select(F.col(key).alias("k"), F.col(mark).alias("h")).distinct()
    return (marked.join(verdicts, marked[key].eqNullSafe(verdicts["k"]) & (marked[mark] == verdicts["h"]), "left_semi")
            .select(*[marked[c] for c in docs.columns]))
