"""String functions with the Unicode behaviour that configurations rely on, from built-in functions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what counts as white space, as the inside of a regular-expression class
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS, NOT_WS = f"[{SPACE}]", f"[^{SPACE}]"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c, re.ASCII))
_UNEVEN = ("  ", *(c for c in _SPACES if c.isascii() and c != " "))
# fixed values: characters that cleaning deletes, and those whose runs become one space
INVISIBLE = r"[\ufeff\u200b\u200c\u200d\u00ad]"
_ODD_SPACE = r"  |[\ufeff\u200b\u200c\u200d\u00ad\u00a0\u2009\u202f\u2002\u2003\u2007\u2008\t\r\n]"
WIDE_SPACE = r"[\u00a0\u2009\u202f\u2002\u2003\u2007\u2008\t\r\n]+"
_BRACKETED = r"\[[^\[\]]*\]"


def let(value: Column, then) -> Column:
    """then(value) with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def quoted(literal: str) -> str:
    """A pattern for the literal itself."""
    return re.sub(r"([^\w\s])", r"\\\1", literal)


def java_pattern(pattern: str, flags: str = "U") -> str:
    """A pattern of Python's syntax for Spark's functions: Unicode classes, named groups, end of input."""
    p = re.sub(r"\(\?P<", "(?<", pattern)
    p = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", p)
    return f"(?{flags})" + p.replace(r"\Z", r"\z")


def java_template(template: str) -> str:
    """A replacement template of Python's syntax for regexp_replace."""
    out, i = [], 0
    while i < len(template):
        c = template[i]
        if c == "\\" and (m := re.match(r"\\g<(\w+)>", template[i:])):
            out.append(f"${m[1]}" if m[1].isdigit() else f"${{{m[1]}}}")
            i += m.end()
            continue
        if c == "\\" and i + 1 < len(template):
            d = template[i + 1]
            out.append(f"${d}" if d.isdigit() else {"n": "\n", "t": "\t", "r": "\r"}.get(d, "\\\\" if d == "\\" else "\\" + d))
            i += 2
            continue
        out.append("\\$" if c == "$" else c)
        i += 1
    return "".join(out)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def words(c: Column) -> Column:
    """The parts between white space, none of them empty."""
    return F.filter(F.split(c, f"{WS}+"), lambda x: x != "")


def letters(c: Column) -> Column:
    """Lower-cased letters, everything else left out."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}]", "")


def _ascii(c: Column) -> Column:
    return F.is_valid_utf8(c) & (F.length(c) == F.octet_length(c))


def _uneven(c: Column) -> Column:
    """Whether the text has more than ASCII and single spaces: a cheap test, before patterns with long classes. It has no
    pattern itself, since one with a negated class was slow in some runs."""
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(x)) for x in _UNEVEN), ~_ascii(c))


def normalize_whitespace(c: Column) -> Column:
    def single(x: Column) -> Column:
        shorter = F.regexp_replace(F.regexp_replace(x, INVISIBLE, ""), WIDE_SPACE, " ")
        return F.when(_uneven(x) & F.rlike(x, F.lit(_ODD_SPACE)), F.regexp_replace(shorter, " {2,}", " ")).otherwise(x)

    return strip(let(c, single))


def clean_text(c: Column) -> Column:
    """Bracketed parts, nested ones too, become a space; unbalanced brackets stay. Each round takes the innermost
    brackets of all groups, so as many rounds do work as brackets are nested; those after the last change nothing and
    cost nothing. A text without a bracket has none."""
    count = F.length(c) - F.length(F.replace(c, F.lit("["), F.lit("")))
    start = F.struct(c.alias("text"), F.lit(True).alias("more"))

    def innermost(acc: Column, _: Column) -> Column:
        return F.when(acc["more"], let(F.regexp_replace(acc["text"], _BRACKETED, " "), lambda t: F.struct(t.alias("text"), (t != acc["text"]).alias("more")))).otherwise(acc)

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), count)), start, innermost, lambda acc: acc["text"])
    return normalize_whitespace(F.when(F.contains(c, F.lit("[")), folded).otherwise(c))


def spaced(c: Column, split_by: str = "whitespace") -> Column:
    """The text's tokens with one space between each two; with whitespace_and_punctuation a comma behind another character
    is a token too."""
    if split_by == "whitespace_and_punctuation":
        # the comma first: in front, the look behind would be tried at every character
        c = F.regexp_replace(c, f",(?<={NOT_WS},) ?", " , ")
    return let(c, lambda x: F.when(_uneven(x), collapse(x)).otherwise(F.trim(x)))


def split_spaced(c: Column) -> Column:
    """The tokens of spaced()."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def letters_spaced(c: Column) -> Column:
    """letters() of each token of spaced(), in one pass over the text."""
    kept = lambda pattern: F.regexp_replace(F.lower(c), pattern, "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.when(_ascii(c), kept(r"[\x00-\x1f!-`{-\x7f]+")).otherwise(kept(r"[^ \p{L}]+")), " "))


def tokenize(c: Column, split_by: str = "whitespace") -> Column:
    """Tokens of the text, as spaced() has them."""
    return let(spaced(c, split_by), split_spaced)
