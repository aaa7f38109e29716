"""Licence scan: Aho-Corasick phrase search and a shunting-yard evaluation of licence expressions.

A text is lower-cased (A-Z), cut into words (ASCII letters and digits, and all
non-ASCII characters) and re-joined by single spaces; one Aho-Corasick automaton
over all notice phrases runs once over that string, so a phrase matches where
its words stand consecutively. Identifier tags (``SPDX-License-Identifier:``)
are found by a second automaton in the raw text; the expression behind a tag is
parsed by the shunting-yard algorithm (WITH binds before AND before OR) and
evaluated: an identifier has the openness of its family, OR takes the best, AND the
worst operand, WITH lifts the licence towards 1 by its exception's share (half way for
an exception that the table does not name). An expression ends at the
first token that cannot continue it, at the end of its line or at the next tag;
what follows is text. The score of a text is the worst value over its notices and
expressions (0 without any). A malformed expression (an operator without operand, an
open bracket) counts as AND of the identifiers in it; after an operand without
operator in a bracket these are the known ones up to the bracket's end. Every
expression is read once, so time grows with the length of a text however many tags a
line has.

Notices, openness and exceptions are tables (:class:`Licences`); the defaults are in this
module, others come as DataFrames through :func:`licences`. They go to every task, so
a table of more than ``MAX_TABLE`` rows is refused.

Defined results: rows of a table with a null are ignored, phrases are cut into words as
texts are, a phrase given several labels has them all, of a repeated name the smallest
value counts; a label without openness has ``UNKNOWN_OPENNESS``. A null or empty text has no words, no labels, score 0; repeated
rows are scanned one by one; texts of any length are scanned whole, in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Fixed base phrases and labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Further notices and their labels.
MORE_PHRASES = (
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd license", "bsd"),
    ("isc license", "isc"),
    ("the unlicense", "unlicense"),
    ("cc0", "cc0"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nd", "cc-by-nd"),
    ("all rights reserved", "proprietary"),
    ("boost software license", "bsl"),
    ("zlib license", "zlib"),
    ("artistic license", "artistic"),
    ("common development and distribution license", "cddl"),
    ("european union public licence", "eupl"),
    ("server side public license", "sspl"),
    ("business source license", "busl"),
    ("sil open font license", "ofl"),
    ("python software foundation license", "psf"),
    ("postgresql license", "postgresql"),
)

#: Clauses that stand in the licences' and notices' own wording, and the labels they prove.
CLAUSES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl"),
    ("has dedicated the work to the public domain by waiving all of his or her rights", "cc0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noderivatives 4 0 international license", "cc-by-nd"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications", "zlib"),
    ("boost software license version 1 0", "bsl"),
    ("no part of this publication may be reproduced", "proprietary"),
)

TAG = "spdx-license-identifier:"

#: Openness by label: 1 permissive, lower with each kind of condition.
OPENNESS = {
    "cc0": 1.0, "unlicense": 1.0, "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc-by": 0.9, "mpl": 0.6,
    "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.1,
    "proprietary": 0.0, "bsl": 1.0, "zlib": 1.0, "0bsd": 1.0, "ncsa": 1.0, "x11": 1.0, "psf": 1.0, "postgresql": 1.0,
    "ofl": 0.9, "artistic": 0.6, "cddl": 0.6, "eupl": 0.5, "sspl": 0.1, "busl": 0.1,
}
UNKNOWN_OPENNESS = 0.1

#: Share of the way to 1 by which an exception lifts a licence.
EXCEPTIONS = {
    "classpath-exception-2.0": 0.5, "gcc-exception-3.1": 0.5, "bison-exception-2.2": 0.5, "font-exception-2.0": 0.5,
    "linux-syscall-note": 0.5, "openjdk-assembly-exception-1.0": 0.5, "llvm-exception": 0.5,
}
OTHER_EXCEPTION = 0.5

#: Rows of a table that tasks may be sent: about 10 MB of phrases.
MAX_TABLE = 100_000


class Licences(NamedTuple):
    """The tables of a scan; base phrases come on top of ``phrases`` and always stay."""

    phrases: tuple[tuple[str, str], ...] = MORE_PHRASES + CLAUSES
    openness: dict[str, float] = OPENNESS
    exceptions: dict[str, float] = EXCEPTIONS


def _rows(frame: DataFrame, *columns: str) -> list[tuple]:
    rows = frame.select(*columns).dropna().distinct().limit(MAX_TABLE + 1).collect()  # refused beyond the bound
    if len(rows) > MAX_TABLE:
        raise ValueError(f"a table of {', '.join(columns)} may have at most {MAX_TABLE} rows")
    return sorted(tuple(r) for r in rows)


def _smallest(rows: list[tuple]) -> dict[str, float]:
    out: dict[str, float] = {}
    for name, value in rows:
        out[name.lower()] = min(float(value), out.get(name.lower(), float(value)))
    return out


def licences(phrases: DataFrame | None = None, openness: DataFrame | None = None, exceptions: DataFrame | None = None) -> Licences:
    """Tables of (phrase, label), (label, openness), (exception, lift) for a scan; what is not given is the default."""
    out = Licences()
    if phrases is not None:
        out = out._replace(phrases=tuple(_rows(phrases, "phrase", "label")))
    if openness is not None:
        out = out._replace(openness=_smallest(_rows(openness, "label", "openness")))
    if exceptions is not None:
        out = out._replace(exceptions=_smallest(_rows(exceptions, "exception", "lift")))
    return out


DEFAULT = Licences()

_DELIMS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKENS = re.compile(r"[()]|[^\s()]+")
#: Characters of comments and quotes around an expression; one behind an identifier ends it.
_AROUND = "*/#;,.-<>!\"'`"


def family(identifier: str, openness: dict[str, float] = OPENNESS) -> str:
    """Label of a lower-case identifier: the longest known label that starts it, else the identifier itself."""
    plain = known = identifier.rstrip("+")
    while known not in openness:
        cut = known.rfind("-")
        if cut < 0:
            return plain
        known = known[:cut]
    return known


def evaluate(text: str, start: int = 0, stop: int | None = None, tables: Licences = DEFAULT) -> tuple[set[str], float]:
    """(labels, openness) of the lower-case licence expression that begins at ``start``, by shunting-yard."""
    output: list[float] = []
    operators: list[str] = []
    labels: set[str] = set()
    openness = tables.openness
    depth, operand, broken, exception = 0, False, False, False  # operand: the last token completes one

    def apply(op: str) -> None:
        b, a = output.pop(), output.pop()
        output.append(max(a, b) if op == "or" else min(a, b) if op == "and" else a * (1 - b) + b)

    for m in _TOKENS.finditer(text, start, len(text) if stop is None else stop):
        token = m[0]
        if token in "()":
            depth += 1 if token == "(" else -1
            if broken:
                if depth <= 0:
                    break
            elif token == "(":
                if operand or exception:
                    break  # text in brackets behind an expression, or no exception's name
                operators.append(token)
            elif depth < 0 or not operand:
                broken = depth >= 0
                break
            else:
                while operators[-1] != "(":
                    apply(operators.pop())
                operators.pop()
            continue
        name = token.strip(_AROUND)
        if broken:
            if (label := family(name, openness)) in openness:
                labels.add(label)
        elif not name:
            if operand:
                break  # the end of a comment
        elif operand:
            if name in _PRECEDENCE and name == token:
                while operators and operators[-1] != "(" and _PRECEDENCE[operators[-1]] >= _PRECEDENCE[name]:
                    apply(operators.pop())
                operators.append(name)
                operand, exception = False, name == "with"
            elif operators and depth > 0:
                broken = True
                if (label := family(name, openness)) in openness:
                    labels.add(label)
            else:
                break
        elif name in _PRECEDENCE:
            broken = True
            break
        else:
            if exception:  # an exception's name, not a licence
                output.append(tables.exceptions.get(name, OTHER_EXCEPTION))
            else:
                label = family(name, openness)
                labels.add(label)
                output.append(openness.get(label, UNKNOWN_OPENNESS))
            operand, exception = True, False
            if not depth and not token.endswith(name) and not token.endswith(name + "+"):
                break  # punctuation behind it
    if broken or not operand or "(" in operators:
        return labels, min((openness.get(x, UNKNOWN_OPENNESS) for x in labels), default=0.0)
    while operators:
        apply(operators.pop())
    return labels, output[0]


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_DELIMS).split()


def _automata(tables: Licences = DEFAULT):
    import ahocorasick

    found: dict[str, list[tuple]] = {}
    for kind, phrases in (("base", BASE_PHRASES), ("more", tables.phrases)):
        for phrase, label in phrases:
            parts = _words(phrase)
            if parts:
                plain = b" ".join(parts).decode("latin-1")
                found.setdefault(plain, []).append((kind, label, len(plain)))
    words = ahocorasick.Automaton()
    for plain, values in found.items():
        words.add_word(f" {plain} ", values)
    words.make_automaton()
    tags = ahocorasick.Automaton()
    tags.add_word(TAG, TAG)
    tags.make_automaton()
    return words, tags


def scan_text(raw: bytes, words, tags, tables: Licences = DEFAULT) -> tuple:
    """(n_words, n_base, first, last, base labels, labels, score) of one UTF-8 text."""
    parts = raw.translate(_DELIMS).split()
    joined = (b" " + b" ".join(parts) + b" ").decode("latin-1")  # one character a byte: offsets stay simple
    base: set[str] = set()
    labels: set[str] = set()
    score, n_base, first, last = 1.0, 0, None, None
    seen_to, n_spaces = 0, 0
    for end, values in words.iter(joined):
        for kind, label, size in values:
            labels.add(label)
            score = min(score, tables.openness.get(label, UNKNOWN_OPENNESS))
            if kind == "base":
                start = end - size - 1  # the space before the phrase; word numbers are carried from match to match
                n_spaces += joined.count(" ", seen_to, start) if start >= seen_to else -joined.count(" ", start, seen_to)
                seen_to, at = start, n_spaces
                base.add(label)
                n_base += 1
                first = at if first is None else min(first, at)
                last = at if last is None else max(last, at)
    if " spdx license identifier " in joined:
        lower = raw.translate(_LOWER).decode("latin-1")
        ends = [end + 1 for end, _ in tags.iter(lower)]
        line = -1
        for end, following in zip(ends, [*(e - len(TAG) for e in ends[1:]), len(lower)]):
            if line < end:
                line = lower.find("\n", end)
                line = len(lower) if line < 0 else line
            found, value = evaluate(lower, end, min(line, following), tables)
            labels |= found
            if found:
                score = min(score, value)
    return len(parts), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score if labels else 0.0


SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", tables: Licences = DEFAULT) -> DataFrame:
    """One row per input row: the key and the scan's columns; a map without any shuffle."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tags = _automata(tables)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in chunks(batches, "_text", 4 << 20):
            texts = batch.column(1).cast(pa.binary())
            rows = [scan_text(t.as_py() or b"", words, tags, tables) for t in texts]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["_key", *names])

    data = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = data.schema["_key"].dataType.simpleString()
    return data.mapInArrow(run, f"_key {kind}, {SCHEMA}").withColumnRenamed("_key", key)
