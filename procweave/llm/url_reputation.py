"""URL filter: rule list plus empirical-Bayes host reputation (DataFrame functions only).

Labelled page outcomes (good / bad) are counted per host. Host, registered
domain and suffix form a hierarchy; at each level a beta prior is centred on
the parent's posterior mean and its strength (the number of pseudo-pages) is
the method-of-moments estimate over all labelled children, so a host with few
labelled pages is pulled to its domain, a domain to its suffix, a suffix to the
overall rate. A page without a matching rule is blocked when the lower bound of its
host's bad rate exceeds ``max_bad_rate``: the ``LEVEL`` quantile of the host's beta
posterior, or its mean where a very skewed posterior has that below the quantile. The quantile comes from the posterior's mass on a fixed grid
(:func:`beta_quantile`), the same work for a host of one page and of a billion.

Suffixes are a table (column ``suffix``, as of the public suffix list without its
wildcards) of any size, joined with the hosts; without one they are the last label
and ``TWO_LABEL_SUFFIXES``.

Defined results: a null url, or one without ``://``, has empty host and path,
no rule, and is judged by the reputation of the empty host. Outcome rows with a
null page or value are ignored; repeated outcome rows of a page count once (bad
wins); repeated page rows are judged one by one. With no outcomes at all the
prior is even (0.5) and nothing is blocked. Extra input columns are dropped;
only the key and url columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stage

#: Fixed rules: (verdict, rule); a rule is host + path prefix.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Suffixes of two labels where no table of suffixes is given; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in")

#: Bounds of the intra-parent correlation estimate (prior strength is 1 / rho - 1).
RHO_MIN, RHO_MAX = 0.001, 0.9
#: The lower bound leaves this posterior mass below it.
LEVEL = 0.05
MAX_BAD_RATE = 0.5
#: Cells of the quantile's grid.
CELLS = 256
#: Labels of a host's longest possible suffix in a table of suffixes.
SUFFIX_LABELS = 5


def url_host(url: Column) -> Column:
    """Text between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domain_and_suffix(host: Column, two_label=TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain (one label below the suffix) and suffix; user info and port do not count."""
    bare = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":\d*$", "")
    last_two = F.substring_index(bare, ".", -2)
    wide = last_two.isin(*two_label)
    suffix = F.when(wide, last_two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(wide, F.substring_index(bare, ".", -3)).otherwise(last_two)
    return domain, suffix


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``hosts`` (column host, a row each) with domain and suffix; the longest listed suffix wins, else the last label."""
    if suffixes is None:
        domain, suffix = domain_and_suffix(F.col("host"))
        return hosts.select("*", domain.alias("domain"), suffix.alias("suffix"))
    labels = F.split(F.regexp_replace(F.regexp_replace("host", r"(?s)^.*@", ""), r":\d*$", ""), r"\.")
    listed = small(suffixes.select(F.lower("suffix").alias("_tail")).where("_tail is not null").distinct())
    lengths = F.sequence(F.lit(1), F.least(F.size("_labels"), F.lit(SUFFIX_LABELS)))
    tails = (hosts.select("host", labels.alias("_labels")).select("host", "_labels", F.explode(lengths).alias("_n"))
             .select("host", "_n", F.array_join(F.expr("slice(_labels, -_n, _n)"), ".").alias("_tail")))
    found = tails.join(listed, "_tail").groupBy("host").agg(F.max("_n").alias("_n"))
    cut = hosts.join(found, "host", "left").select(*hosts.columns, labels.alias("_labels"), F.coalesce("_n", F.lit(1)).alias("_n"))
    last = "array_join(slice(_labels, -least(size(_labels), {0}), least(size(_labels), {0})), '.')"
    return cut.select(*hosts.columns, F.expr(last.format("_n + 1")).alias("domain"), F.expr(last.format("_n")).alias("suffix"))


def beta_quantile(alpha: Column, beta: Column, level: float = LEVEL, cells: int = CELLS) -> Column:
    """The ``level`` quantile of the beta distribution, to about four digits.

    With u = ln(t / (1 - t)) the density is exp(alpha u - (alpha + beta) ln(1 + e^u)), smooth and with exponential
    tails; u = mode + sd * sinh(v) puts a grid of equal steps in v close around the mode and far into the tails.
    The masses of the cells are added up to the level, and the last cell is parted in proportion.
    """
    def bound(value: Column, use) -> Column:
        """``use`` of a value that is worked out once, not wherever it is named."""
        return F.transform(F.array(value), use)[0]

    def place(p: Column, i: Column) -> Column:
        return p["mode"] + p["sd"] * F.sinh(p["reach"] * (i * (2 / cells) - 1))

    def log_density(p: Column, u: Column) -> Column:
        return p["a"] * u - p["ab"] * (F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u))))

    def weight(p: Column, i: Column) -> Column:
        return F.exp(log_density(p, place(p, i)) - p["top"]) * F.cosh(p["reach"] * (i * (2 / cells) - 1))

    def step(state: Column, w: Column) -> Column:
        # a cell's mass is the mean of its two ends, in units of the step; the first weight ends no cell
        mass = F.when(state["i"] < 0, 0.0).otherwise((state["last"] + w) / 2)
        at = F.coalesce(state["at"], F.when(state["sum"] + mass >= state["goal"],
                                            state["i"] + F.when(mass > 0, (state["goal"] - state["sum"]) / mass).otherwise(1.0)))
        return F.struct((state["i"] + 1).alias("i"), w.alias("last"), (state["sum"] + mass).alias("sum"), at.alias("at"),
                        state["goal"].alias("goal"))

    def walk(p: Column, weights: Column) -> Column:
        goal = level * F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
        start = F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("last"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"),
                         goal.alias("goal"))
        return F.aggregate(weights, start, step, lambda s: 1 / (1 + F.exp(-place(p, F.greatest(s["at"], F.lit(0.0))))))

    numbers = F.sequence(F.lit(0), F.lit(cells))
    mode, sd = F.log(alpha / beta), F.sqrt(1 / alpha + 1 / beta)
    shape = F.struct(alpha.alias("a"), (alpha + beta).alias("ab"), mode.alias("mode"), sd.alias("sd"),
                     F.asinh(12 + 30 / (F.least(alpha, beta) * sd)).alias("reach"))  # less than e^-30 of the mass lies beyond
    return bound(shape, lambda q: bound(
        q.withField("top", log_density(q, q["mode"])),
        lambda p: bound(F.transform(numbers, lambda i: weight(p, i)), lambda weights: walk(p, weights))))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's host or a parent of it and whose path is a prefix."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, prefix = text.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + prefix)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def _spread_stats(children: DataFrame, parent: str, level: str) -> DataFrame:
    """One row: between-children sum of squares and its two coefficients, over labelled children."""
    labelled = children.where("n > 0")
    by_parent = (labelled.groupBy(parent)
                 .agg(F.sum("n").alias("pn"), F.sum("bad").alias("pbad"), F.count(F.lit(1)).alias("k"),
                      F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb")))
    p = F.col("pbad") / F.col("pn")
    # sum n_i (p_i - p)^2 = sum bad_i^2 / n_i - pbad^2 / pn
    return by_parent.agg(
        F.lit(level).alias("level"),
        F.sum(F.col("bb") - F.col("pbad") * F.col("pbad") / F.col("pn")).alias("s"),
        F.sum(p * (1 - p) * (F.col("pn") - F.col("nn") / F.col("pn"))).alias("a"),
        F.sum(p * (1 - p) * (F.col("k") - 1)).alias("b"),
        F.sum("pn").alias("n"), F.sum("pbad").alias("bad"))


def _strength(s, a, b) -> float:
    rho = RHO_MIN if s is None or a - b <= 0 else (s - b) / (a - b)
    return 1 / min(max(rho, RHO_MIN), RHO_MAX) - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame, key: str = "page_id", url: str = "url",
                    level: float = LEVEL, suffix_table: DataFrame | None = None) -> DataFrame:
    """Per host: labelled counts and posterior (alpha, beta, mean, lower bound) of the bad rate.

    ``outcomes`` has ``key`` and ``bad`` (0 / 1).
    """
    marks = (outcomes.select(F.col(key).alias("_key"), F.col("bad").cast("int").alias("_bad"))
             .where("_key is not null and _bad is not null").groupBy("_key").agg(F.max("_bad").alias("_bad")))
    keyed = pages.select(F.col(key).alias("_key"), url_host(F.col(url)).alias("host"))
    hosts = (keyed.join(marks, "_key", "left").groupBy("host")
             .agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad")))
    # a row per host, read five times from here on: the pages and outcomes are read once
    hosts = stage(with_domains(hosts, suffix_table).select("host", "n", "bad", "domain", "suffix"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # three rows of level totals, whatever the number of hosts
    stats = {r["level"]: r for r in _spread_stats(hosts, "domain", "host")
             .unionByName(_spread_stats(domains, "suffix", "domain"))
             .unionByName(_spread_stats(suffixes.withColumn("all", F.lit(1)), "all", "suffix")).collect()}
    top = stats["suffix"]
    overall = top["bad"] / top["n"] if top["n"] else 0.5
    k = {level: _strength(r["s"], r["a"], r["b"]) for level, r in stats.items()}

    def mean(prior: Column, level: str) -> Column:
        return (k[level] * prior + F.col("bad")) / (k[level] + F.col("n"))

    suffixes = suffixes.select("suffix", mean(F.lit(overall), "suffix").alias("suffix_mean"))
    domains = (domains.join(suffixes, "suffix")
               .select("domain", "suffix", mean(F.col("suffix_mean"), "domain").alias("domain_mean")))
    alpha = k["host"] * F.col("domain_mean") + F.col("bad")
    beta = k["host"] * (1 - F.col("domain_mean")) + F.col("n") - F.col("bad")
    post = hosts.join(domains, ["domain", "suffix"]).select("host", "n", "bad", alpha.alias("alpha"), beta.alias("beta"))
    # an overall rate of 0 or 1 leaves one of the two at zero: the whole mass is at that end
    lower = (F.when(F.col("alpha") <= 0, 0.0).when(F.col("beta") <= 0, 1.0)
             .otherwise(beta_quantile(F.col("alpha"), F.col("beta"), level)))
    mean_rate = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    return post.select("host", "n", "bad", "alpha", "beta", mean_rate.alias("mean"), F.least(lower, mean_rate).alias("lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, key: str = "page_id", url: str = "url", rules=RULES,
                max_bad_rate: float = MAX_BAD_RATE, level: float = LEVEL, suffix_table: DataFrame | None = None) -> DataFrame:
    """One row per page: key, host, path, rule, verdict (``allow`` / ``block``), posterior mean and lower bound."""
    host, path = url_host(F.col(url)), url_path(F.col(url))
    rated = host_reputation(pages, outcomes, key, url, level, suffix_table).select("host", "mean", "lower")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("lower") > max_bad_rate, F.lit("block")).otherwise(F.lit("allow"))
    # every host is in the rated table once; a hot host's pages are split by AQE's skew join
    return (pages.select(F.col(key), host.alias("host"), path.alias("path"))
            .join(rated, "host", "left")
            .select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"),
                    F.round("mean", 9).alias("bad_rate"), F.round("lower", 6).alias("bad_rate_lower")))
