"""Column functions by name, for plans that are put together from settings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column

from kalamos.functions import text as T
from kalamos.operators.lexicon import lookup_form, short_gloss

FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    f.__name__: f
    for f in (
        T.annotate_numbers, T.bracketed_gaps, T.break_comments, T.clean_translation, T.compose, T.genre_tag, T.lone_x, T.normalize_minimal, T.normalize_transliteration, T.open_brackets,
        T.open_insertions, T.plain_digits, T.plain_h, T.postprocess_translation, T.round_determinatives, T.shin, T.simple_brackets, T.tagged_sumerograms, T.whitespace, T.without_determinatives,
        T.without_errors, T.without_gap_tags, T.without_gaps, T.without_half_brackets, T.without_homophones, T.without_notation, lookup_form, short_gloss,
    )
}


def chained(column: Column, *names: str) -> Column:
    """The named functions, one after the other."""
    return reduce(lambda c, name: FUNCTIONS[name](c), names, column)
