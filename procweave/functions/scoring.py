"""Complexity scores and classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from procweave.functions import constants as K
from procweave.functions.extract import _bind, _col, capitals, extract_all, line_count, word_count


#: Keywords that add to the score; their lengths differ, so a match tells its keyword by its length.
_RATED = {"IF": K.COMPLEXITY_IF_WEIGHT, "LOOP": K.COMPLEXITY_LOOP_WEIGHT, "CURSOR": K.COMPLEXITY_CURSOR_WEIGHT, "EXCEPTION": K.COMPLEXITY_EXCEPTION_WEIGHT}
#: All of them as whole words in one pass over the text: a place is tested for a first letter, then for what must stand before it.
_RATED_PATTERN = "(?i)[ILCE](?:" + "|".join(rf"(?<=\b{w[0]}){w[1:]}" for w in _RATED) + r")\b"


def _rated_score(c, n: dict):
    """Score from the numbers of lines and of rated keywords. Summed in DOUBLE in the original order, then truncated, so that
    e.g. 3 LOOP + 3 EXCEPTION gives 3.9999999999999996 -> 3 exactly as the original float arithmetic does."""
    lines_bonus = F.least(F.floor(line_count(c) / F.lit(K.COMPLEXITY_LINES_THRESHOLD)),
                          F.lit(K.COMPLEXITY_LINES_MAX_BONUS)).cast("bigint")
    total = (F.lit(1).cast("bigint") + lines_bonus).cast("double")
    for word, weight in _RATED.items():
        total = total + n[word].cast("double") * F.lit(weight)
    return F.least(total.cast("bigint"), F.lit(K.COMPLEXITY_MAX_SCORE).cast("bigint"))


def code_complexity(code) -> Column:
    """Heuristic code complexity 1..10 (P18) of a text alone, in one pass."""
    c = _col(code)

    def rated(found):
        return _rated_score(c, {w: F.size(F.filter(found, lambda x: F.length(x) == len(w))) for w in _RATED})  # noqa: B023 - built at once

    return F.when(c.isNotNull(), _bind(extract_all(c, _RATED_PATTERN, 0), rated)).otherwise(F.lit(K.COMPLEXITY_MAX_SCORE).cast("bigint"))


def counted_complexity(code) -> Column:
    """:func:`code_complexity` from the counts of :func:`procweave.functions.extract.control_counts`, which are taken once if both are asked for."""
    c = _col(code)
    text = capitals(c)
    return _rated_score(c, {w: word_count(text, w) for w in _RATED})


def table_complexity(n_columns, n_fks, n_indexes) -> Column:
    """Table complexity (P19): 1 + min(cols//5,3) + min(fk,3) + min(idx*0.5,2), cap 10."""
    cols, fks, idx = _col(n_columns), _col(n_fks), _col(n_indexes)
    score = (F.lit(1).cast("double")
             + F.least(F.floor(cols / F.lit(5)), F.lit(3)).cast("double")
             + F.least(fks.cast("double"), F.lit(3.0))
             + F.least(idx.cast("double") * F.lit(0.5), F.lit(2.0)))
    return F.least(score.cast("bigint"), F.lit(10).cast("bigint"))


def repair_score(score) -> Column:
    """Out-of-range score -> 5."""
    s = _col(score)
    return F.when(s.between(1, K.COMPLEXITY_MAX_SCORE), s).otherwise(F.lit(K.SCORE_OUT_OF_RANGE_DEFAULT).cast("bigint"))


def complexity_class(score) -> Column:
    """high (>=8) / medium (>=5) / low."""
    s = _col(score)
    return (F.when(s >= K.COMPLEXITY_HIGH, F.lit("high"))
            .when(s >= K.COMPLEXITY_MEDIUM, F.lit("medium")).otherwise(F.lit("low")))


def impact_class(n_procedures) -> Column:
    """alta (>10) / média (>5) / baixa by procedures found."""
    n = _col(n_procedures)
    high, medium, low = K.IMPACT_LABELS
    return (F.when(n > K.IMPACT_HIGH_ABOVE, F.lit(high))
            .when(n > K.IMPACT_MEDIUM_ABOVE, F.lit(medium)).otherwise(F.lit(low)))
