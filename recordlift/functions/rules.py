"""Validation rules on normalised values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlift.functions.predicates import anything
from recordlift.functions.text import java_pattern, words

Rule = Callable[[Column], Column]


def rule(text: str) -> Rule:
    """not_empty, regex:P (whole value), word_count:a,b; a rule of another name accepts everything."""
    if text == "not_empty":
        return anything
    if text.startswith("regex:"):
        pattern = java_pattern(f"^(?:{text.removeprefix('regex:').strip()})\\z")
        return lambda v: F.rlike(v, F.lit(pattern))
    if text.startswith("word_count:"):
        low, high = map(int, text.split(":")[1].split(","))
        return lambda v: F.size(words(v)).between(low, high)
    return lambda v: F.lit(True)
