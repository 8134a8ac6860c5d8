"""Predicates on tokens: names and regular expressions joined by `|`."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlift.functions.text import NOT_WS, java_pattern

Predicate = Callable[[Column], Column]
# fixed values: superscript and subscript digits count as digits besides the decimal ones
DIGIT = r"\p{Nd}\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089"


def starts_upper(t: Column) -> Column:
    """Upper-case first letter once surrounding punctuation is off, and no digit anywhere."""
    core = F.btrim(t, F.lit(".,;:!?()[]{}"))
    return F.rlike(core, F.lit(rf"^\p{{IsUppercase}}[^{DIGIT}]*\z"))


def has_letter(t: Column) -> Column:
    return F.rlike(t, F.lit(r"\p{L}"))


def looks_like_number_colon_dot(t: Column) -> Column:
    return F.rlike(F.replace(t, F.lit(" "), F.lit("")), F.lit(r"^[0-9А-ЯЁ.:]+\z"))


def is_part_of_number_colon_dot(t: Column) -> Column:
    return looks_like_number_colon_dot(t) & F.rlike(t, F.lit(r"[0-9.:]"))


def anything(t: Column) -> Column:
    return F.rlike(t, F.lit(NOT_WS))


BUILT_IN: dict[str, Predicate] = {
    "starts_upper": starts_upper,
    "has_letter": has_letter,
    "looks_like_number_colon_dot": looks_like_number_colon_dot,
    "is_part_of_number_colon_dot": is_part_of_number_colon_dot,
    "any": anything,
}


def predicate(expression: str) -> Predicate:
    """The predicate of an expression such as "starts_upper | regex:^x". A `|` always separates."""
    parts: list[Predicate] = []
    for part in map(str.strip, expression.split("|")):
        if part.startswith("regex:"):
            pattern = java_pattern(part.removeprefix("regex:").strip())
            parts.append(lambda t, p=pattern: F.rlike(t, F.lit(p)))
        elif part in BUILT_IN:
            parts.append(BUILT_IN[part])
        else:
            raise ValueError(f"unknown predicate: {part!r}")
    return lambda t: reduce(lambda a, b: a | b, (p(t) for p in parts))
