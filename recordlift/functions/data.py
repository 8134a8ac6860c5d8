"""Predicates, rules and normalisation steps as rows of data, so that one expression serves any number of them.

A regular expression, a literal or a number is an argument in a column here, where predicates.py, rules.py and steps.py
build an expression for each. Both give the same results; what has no arguments is taken from those modules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlift.functions import predicates, steps
from recordlift.functions.text import NOT_WS, WS, java_pattern, java_template, let, quoted, strip, words

PREDICATE = "struct<kind: string, pattern: string>"
RULE = "struct<kind: string, pattern: string, low: int, high: int>"
STEP = "struct<op: string, a: string, b: string, n: int>"
_PATTERNS = {"has_letter": r"\p{L}", "any": NOT_WS}


def predicate_rows(expression: str) -> list[tuple[str, str | None]]:
    """The alternatives of an expression; ValueError for an unknown name."""
    predicates.predicate(expression)  # checks the names
    rows = []
    for part in map(str.strip, expression.split("|")):
        if part.startswith("regex:"):
            rows.append(("regex", java_pattern(part.removeprefix("regex:").strip())))
        else:
            rows.append(("regex", _PATTERNS[part]) if part in _PATTERNS else (part, None))
    return rows


def holds(token: Column, rows: Column) -> Column:
    """Whether any of the predicates holds; false for null rows."""
    named = ("starts_upper", "looks_like_number_colon_dot", "is_part_of_number_colon_dot")

    def one(p: Column) -> Column:
        out = F.when(p["kind"] == "regex", F.rlike(token, p["pattern"]))
        for name in named:
            out = out.when(p["kind"] == name, predicates.BUILT_IN[name](token))
        return F.coalesce(out, F.lit(False))

    return F.coalesce(F.exists(rows, one), F.lit(False))


def rule_row(text: str) -> tuple[str, str | None, int | None, int | None]:
    if text == "not_empty":
        return "regex", NOT_WS, None, None
    if text.startswith("regex:"):
        return "regex", java_pattern(f"^(?:{text.removeprefix('regex:').strip()})\\z"), None, None
    if text.startswith("word_count:"):
        low, high = map(int, text.split(":")[1].split(","))
        return "words", None, low, high
    return "all", None, None, None


def follows(value: Column, rule: Column) -> Column:
    """Whether a value follows the rule; true without a rule."""
    return F.when(rule["kind"] == "regex", F.rlike(value, rule["pattern"])).when(rule["kind"] == "words", F.size(words(value)).between(rule["low"], rule["high"])).otherwise(F.lit(True))


def step_rows(name: str, replacements: list[tuple[str, str]]) -> list[tuple[str, str | None, str | None, int | None]]:
    """A step as operations: op, two texts, a number. An unknown step has none."""
    regex = lambda pattern, template="": ("regex", pattern, template, None)
    replace = lambda old, new: ("replace", old, new, None)
    trimmed = regex(f"^{WS}+|{WS}+\\z")
    plain = {
        "strip": [trimmed], "remove_trailing_dot": [regex(r"\.+\z")], "remove_dots": [replace(".", "")], "remove_spaces": [replace(" ", "")], "collapse_spaces": [regex(f"{WS}+", " "), trimmed],
        "uppercase": [("upper", None, None, None)], "lowercase": [("lower", None, None, None)], "digits_only": [regex(r"[^\p{Nd}]")], "to_int": [("int", None, None, None)],
    }
    if name in plain:
        return plain[name]
    kind, _, rest = name.partition(":")
    if name == "apply_replacements":
        return [replace(old, new) for old, new in replacements]
    if kind == "replace_char" and "->" in rest:
        old, new = rest.removeprefix("internal:").split("->", 1)
        if rest.startswith("internal:"):
            return [regex(f"(?<={NOT_WS}){quoted(old)}(?={NOT_WS})", java_template(new))]
        return [replace(old, new)] if old else []
    keywords = "|".join(quoted(k.strip()) for k in rest.split(","))
    if kind == "replace_dot_before_keywords" and rest:
        return [regex(java_pattern(f"\\.(?={WS}*(?:{keywords})(?:\\.|\\b))", "iuU"), ",")]
    if kind == "replace_dot_after_keywords" and rest:
        return [regex(java_pattern(f"\\b({keywords})\\.(?=[{WS[1:-1]},]|\\z)", "iuU"), "$1")]
    if kind == "replace_space_before_keywords" and rest:
        return [regex(java_pattern(f"(?<=[^{WS[1:-1]},]){WS}+(?=(?:{keywords})\\b)", "iuU"), ", "), ("capitals", None, None, None)]
    if kind == "regex_sub" and "->" in rest:
        pattern, template = (x.strip() for x in rest.split("->", 1))
        return [regex(java_pattern(pattern), java_template(template))]
    if name.startswith("normalize_number"):
        given = name.split(":")
        decimal, thousands = given[1] if len(given) > 1 else ",", given[2] if len(given) > 2 else " "
        return [trimmed, *([replace(thousands, "")] if thousands else []), replace(" ", ""), *([replace(decimal, ".")] if decimal and decimal != "." else [])]
    if kind == "to_float":
        return [("float", None, None, int(rest))]
    if kind in ("pad_left", "pad_right"):
        n, _, char = rest.partition(":")
        return [(kind, char or "0", None, int(n))]
    return []


def normalised(value: Column, rows: Column, places: list[int]) -> Column:
    """The value after the operations in order and a last strip. `places` are the numbers of decimal places that any
    to_float among them asks for."""

    def one(v: Column, s: Column) -> Column:
        out = F.when(s["op"] == "regex", F.regexp_replace(v, s["a"], s["b"])).when(s["op"] == "replace", F.replace(v, s["a"], s["b"]))
        out = out.when(s["op"] == "upper", F.upper(v)).when(s["op"] == "lower", F.lower(v)).when(s["op"] == "int", steps.to_int(v)).when(s["op"] == "capitals", steps.capitals(v))
        for n in places:
            out = out.when((s["op"] == "float") & (s["n"] == n), steps.to_float(v, n))
        out = out.when((s["op"] == "pad_left") & (F.length(v) < s["n"]), F.lpad(v, s["n"], s["a"])).when((s["op"] == "pad_right") & (F.length(v) < s["n"]), F.rpad(v, s["n"], s["a"]))
        return out.otherwise(v)

    return strip(F.aggregate(rows, value, lambda v, s: let(v, lambda x: one(x, s))))
