"""Normalisation steps: each step of a pipeline is a function of Column to Column; an unknown step changes nothing."""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlift.functions.text import NOT_WS, WS, collapse, java_pattern, java_template, let, quoted, strip

Step = Callable[[Column], Column]
DEFAULT = ("strip", "collapse_spaces")
# fixed values: letters that are capitalised behind a comma: Cyrillic а to я, ё, and Latin a to z
CAPITALISED = "".join(map(chr, range(ord("а"), ord("я") + 1))) + "ё" + string.ascii_lowercase
_NUMBER = r"^[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+)?\z"
_SPLIT = 134217729.0


def _replace(v: Column, old: str, new: str) -> Column:
    return F.replace(v, F.lit(old), F.lit(new))


def _keywords(arguments: str) -> str:
    return "|".join(quoted(k.strip()) for k in arguments.split(","))


def _number(v: Column) -> Column:
    """The value as a double, null where it is no number; a comma is a decimal point."""
    text = strip(_replace(v, ",", "."))
    return let(text, lambda t: F.when(F.rlike(t, F.lit(_NUMBER)), _replace(t, "_", "").try_cast("double")))


def to_int(v: Column) -> Column:
    """Cut towards zero. A value outside the range of long stays as it is."""
    return let(_number(v), lambda x: F.coalesce(F.when(F.abs(x) < 9.2e18, x.cast("long").cast("string")), v))


def _scaled(x: Column, scale: float) -> Column:
    """round-half-even of the exact product x * scale, as a long. The rounding error of the product, found by
    splitting both factors, decides where the product looks like a tie."""

    def high(a: Column) -> Column:
        return a * _SPLIT - (a * _SPLIT - a)

    def decided(p: Column) -> Column:
        xh, sh = high(x), scale * _SPLIT - (scale * _SPLIT - scale)
        xl, sl = x - xh, scale - sh
        error = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
        low = F.floor(p)
        part = p - low
        up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(low, F.lit(2)) == 1))))
        return low + F.when(up, 1).otherwise(0)

    return let(x * F.lit(scale), decided)


def _fixed(k: Column, negative: Column, n: int) -> Column:
    """k / 10**n as the shortest decimal text."""
    digits = F.abs(k).cast("string")

    def text(d: Column) -> Column:
        whole = F.when(F.length(d) > n, F.substr(d, F.lit(1), F.length(d) - n)).otherwise(F.lit("0"))
        part = F.rtrim(F.right(F.lpad(d, F.greatest(F.length(d), F.lit(n)), F.lit("0")), F.lit(n)), F.lit("0"))
        plain = F.concat(whole, F.lit("."), F.when(part == "", "0").otherwise(part))
        lead = F.rtrim(d, F.lit("0"))
        power = F.lit(n + 1) - F.length(d)
        tiny = F.concat(F.substr(lead, F.lit(1), F.lit(1)), F.when(F.length(lead) > 1, F.concat(F.lit("."), F.substr(lead, F.lit(2), F.length(lead)))).otherwise(""), F.lit("e-"), F.lpad(power.cast("string"), F.lit(2), F.lit("0")))
        return F.concat(F.when(negative, "-").otherwise(""), F.when((d != "0") & (power > 4), tiny).otherwise(plain))

    return let(digits, text)


def to_float(v: Column, n: int) -> Column:
    """Rounded to n places, the exact binary value decides and ties go to even; n = 0 gives a whole number.

    Infinite values, numbers of 1e16 and above, and n outside 0 to 22 leave the value as it is."""
    if not 0 <= n <= 22:
        return v
    scale = float(10**n)

    def text(x: Column) -> Column:
        small = F.abs(x) * scale < 2.0**52
        if n == 0:
            return F.when(small, _scaled(x, scale).cast("string")).when(F.abs(x) < 9.2e18, x.cast("long").cast("string"))
        negative = F.startswith(strip(v), F.lit("-"))
        # beyond 2**52 places of the wanted size a double has no further digits to round away
        rest = F.rtrim(F.abs(x).cast("decimal(38,10)").cast("string"), F.lit("0"))
        rest = F.concat(F.when(negative, "-").otherwise(""), F.when(F.endswith(rest, F.lit(".")), F.concat(rest, F.lit("0"))).otherwise(rest))
        return F.when(small, let(_scaled(x, scale), lambda k: _fixed(k, negative, n))).when(F.abs(x) < 1e16, rest)

    return let(_number(v), lambda x: F.coalesce(text(x), v))


def _pad(v: Column, n: int, char: str, left: bool) -> Column:
    padded = F.lpad(v, F.lit(n), F.lit(char)) if left else F.rpad(v, F.lit(n), F.lit(char))
    return F.when(F.length(v) < n, padded).otherwise(v)


def _spaces_to_commas(v: Column, keywords: str) -> Column:
    """A comma before the keywords, then a capital behind every comma."""
    return capitals(F.regexp_replace(v, java_pattern(f"(?<=[^{WS[1:-1]},]){WS}+(?=(?:{keywords})\\b)", "iuU"), ", "))


def capitals(v: Column) -> Column:
    """A capital behind every comma and its white space, which becomes one space."""
    parts = F.split(v, f",{WS}+(?=[{CAPITALISED}])", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i > 0, F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.substr(p, F.lit(2), F.length(p)))).otherwise(p)), ", ")


def _number_text(v: Column, decimal: str, thousands: str) -> Column:
    v = strip(v)
    v = _replace(_replace(v, thousands, "") if thousands else v, " ", "")
    return _replace(v, decimal, ".") if decimal and decimal != "." else v


PLAIN: dict[str, Step] = {
    "strip": strip,
    "remove_trailing_dot": lambda v: F.rtrim(v, F.lit(".")),
    "remove_dots": lambda v: _replace(v, ".", ""),
    "remove_spaces": lambda v: _replace(v, " ", ""),
    "collapse_spaces": collapse,
    "uppercase": F.upper,
    "lowercase": F.lower,
    "digits_only": lambda v: F.regexp_replace(v, r"[^\p{Nd}]", ""),
    "to_int": to_int,
}


def step(name: str, replacements: list[tuple[str, str]] | None = None) -> Step:
    """The function of a step; arguments follow its name behind colons."""
    if name in PLAIN:
        return PLAIN[name]
    kind, _, rest = name.partition(":")
    if name == "apply_replacements":
        return lambda v: reduce(lambda x, pair: _replace(x, *pair), replacements or [], v)
    if kind == "replace_char" and "->" in rest:
        inner = rest.startswith("internal:")
        old, new = rest.removeprefix("internal:").split("->", 1)
        if inner:
            return lambda v: F.regexp_replace(v, f"(?<={NOT_WS}){quoted(old)}(?={NOT_WS})", java_template(new))
        return lambda v: _replace(v, old, new) if old else v
    if kind == "replace_dot_before_keywords" and rest:
        return lambda v: F.regexp_replace(v, java_pattern(f"\\.(?={WS}*(?:{_keywords(rest)})(?:\\.|\\b))", "iuU"), ",")
    if kind == "replace_dot_after_keywords" and rest:
        return lambda v: F.regexp_replace(v, java_pattern(f"\\b({_keywords(rest)})\\.(?=[{WS[1:-1]},]|\\z)", "iuU"), "$1")
    if kind == "replace_space_before_keywords" and rest:
        return lambda v: _spaces_to_commas(v, _keywords(rest))
    if kind == "regex_sub" and "->" in rest:
        pattern, template = (x.strip() for x in rest.split("->", 1))
        return lambda v: F.regexp_replace(v, java_pattern(pattern), java_template(template))
    if name.startswith("normalize_number"):
        given = name.split(":")
        return lambda v: _number_text(v, given[1] if len(given) > 1 else ",", given[2] if len(given) > 2 else " ")
    if kind == "to_float":
        return lambda v: to_float(v, int(rest))
    if kind in ("pad_left", "pad_right"):
        n, _, char = rest.partition(":")
        return lambda v: _pad(v, int(n), char or "0", kind == "pad_left")
    return lambda v: v


def normalizer(pipeline: list[str] | tuple[str, ...] = DEFAULT, replacements: list[tuple[str, str]] | None = None, joined: bool = False) -> Step:
    """The steps in order, then a last strip. joined: values are tokens joined by one space, so that first steps that
    take off white space leave them as they are."""
    names = list(pipeline)
    while joined and names and names[0] in DEFAULT:
        names.pop(0)
    steps = [step(name, replacements) for name in names]
    if joined and not steps:
        return lambda v: v
    return lambda v: strip(reduce(lambda x, s: s(x), steps, v))
