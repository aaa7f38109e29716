"""Plain, slow versions of the operators for small inputs."""

import collections
import hashlib
import math
import re

import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def quality_counts(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def fingerprint(text):
    words = SPACE_WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, near):
    """Class number of every value under the closure of ``near``."""
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def repeats(rows, span=100):
    """{id: (bytes, removed, spans, sha256, kept bytes)} for (id, text) rows with distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - span + 1):
            w = raw[s:s + span]
            if w in seen:
                gone[s:s + span] = b"\1" * span
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for j in range(len(raw)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def least_edits(probe, text):
    """Fewest edits that turn ``probe`` into some stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(probe):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def kneser_ney(train, texts, order=5):
    """ln p of every text under an interpolated modified Kneser-Ney character model of ``train``."""
    begin, finish = "\ufdd0", "\ufdd1"
    pad = lambda t: begin * (order - 1) + t + finish
    counts = {order: collections.Counter()}
    for t in train:
        p = pad(t)
        counts[order].update(p[i - order + 1:i + 1] for i in range(order - 1, len(p)))
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    discount, context = {}, {}
    for n, table in counts.items():
        k = collections.Counter(table.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + 2 * k[2] else 0
        d = []
        for m in (1, 2, 3):
            raw = m - (m + 1) * y * k[m + 1] / k[m] if k[m] and k[1] else 0.5 * m
            d.append(min(max(raw, 0.05), m - 0.05))
        discount[n] = d
        for g, c in table.items():
            total, weight = context.get((n, g[:-1]), (0, 0.0))
            context[n, g[:-1]] = (total + c, weight + d[min(c, 3) - 1])

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        below = p(gram[1:])
        if (n, gram[:-1]) not in context:
            return below
        total, weight = context[n, gram[:-1]]
        c = counts[n].get(gram, 0)
        return (max(c - discount[n][min(c, 3) - 1], 0) / total if c else 0) + weight / total * below

    out = []
    for t in texts:
        x = pad(t)
        out.append(sum(math.log(p(x[i - order + 1:i + 1])) for i in range(order - 1, len(x))))
    return out


GRIDS = {
    "symbols": (4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05),
    "chars": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0, 9.0, 8.0),
    "lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "bangs": (2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05),
}


def quality_verdicts(rows, labels, risk=0.01, delta=0.05):
    """Verdict (kept) of every (id, text, stratum) row under the risk-controlled rules, and the number of rejecting steps by stratum."""
    counts = [quality_counts(t) for _, t, _ in rows]
    base_failed = [c[0] < 20 or 100 * c[4] > 30 * c[0] for c in counts]
    ratios = []
    for (_, text, _), c in zip(rows, counts):
        lines = [x for x in (text or "").split("\n") if SPACE_WORD.search(x)]
        ratios.append({"symbols": c[2] / max(c[0], 1), "chars": c[1] / max(c[0], 1), "lines": c[3] / max(len(lines), 1),
                       "bangs": (text or "").count("!") / max(c[0], 1)})
    order = sorted(((i + 1) / len(grid), number, name, cutoff) for number, (name, grid) in enumerate(GRIDS.items()) for i, cutoff in enumerate(grid))
    vectors = [{name: cutoff for _, _, name, cutoff in order[:k]} for k in range(len(order) + 1)]  # the last cutoff of a measure is its strictest

    def rejects(step, ratio):
        return any(ratio[name] > cutoff for name, cutoff in vectors[step].items())

    worst = {}
    for i, good in labels:
        if i is not None and good is not None:
            worst[i] = min(worst.get(i, good), good)
    held = [(stratum, worst[i], ratio) for (i, _, stratum), failed, ratio in zip(rows, base_failed, ratios) if not failed and i in worst]

    def rejected(strata, good, step):
        return sum(rejects(step, r) for s, g, r in held if s in strata and (g == 1) == good and g in (0, 1))

    def size(strata):
        return sum(g == 1 for s, g, _ in held if s in strata)

    def admitted(strata, level):
        """Steps that pass one after the other."""
        n, step = size(strata), 0
        while step < len(order):
            k = rejected(strata, True, step + 1)
            if sum(math.comb(n, j) * risk ** j * (1 - risk) ** (n - j) for j in range(k + 1)) > level:
                break
            step += 1
        return step

    strata = {s for s, _, _ in held}
    least = {s: (1 - risk) ** size({s}) for s in strata}
    alone = sum(v <= delta for v in least.values())
    level = delta / max(1, alone + (len(strata) > alone))
    if len(strata) == alone and any(v > level for v in least.values()):
        level = delta / (alone + 1)
    others = {s for s in strata if least[s] > level}
    together = admitted(others, level) if others else 0
    chosen = {}
    for s in strata:
        if s in others:
            steps = [k for k in range(1, together + 1) if size({s}) and rejected({s}, True, k) <= risk * size({s})]
        else:
            steps = list(range(1, admitted({s}, level) + 1))
        gains = [(rejected({s}, False, k) - rejected({s}, True, k), -k) for k in steps]
        if gains and max(gains)[0] > 0:
            chosen[s] = -max(gains)[1]
    kept = [not failed and not (s in chosen and rejects(chosen[s], ratio)) for (_, _, s), failed, ratio in zip(rows, base_failed, ratios)]
    return kept, chosen
