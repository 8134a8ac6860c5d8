"""Which encoding a file is in, told by statistics of its bytes, from built-in functions only.

A text is scored under each single-byte encoding by a bigram model: what follows what (a small letter behind a small
one, a capital at a word's start, a letter with an accent among plain ones), and how frequent the letter itself is. Only
runs with a byte of 0x80 or above tell encodings apart, so only they are looked at, with the character on either side.
The logarithms are summed over the whole file, and the confidence is the share that the best encoding has of all the
likelihoods, less where only few such bytes stand in the file. UTF-16 is told by its mark, or by the bytes that only the code units' upper halves have.

Everything is a function of one file's content: no shuffle, and usable on streams.
"""

from __future__ import annotations

import math
import unicodedata
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlift.functions.text import let

# fixed values: how often letters stand in Russian texts, in percent, and letters beyond ASCII in Western European ones
CYRILLIC = dict(
    zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (10.97, 8.45, 8.01, 7.35, 6.7, 6.26, 5.47, 4.73, 4.54, 4.4, 3.49, 3.21, 2.98, 2.81, 2.62, 2.01, 1.9, 1.74, 1.7, 1.65, 1.59, 1.44, 1.21, 0.97, 0.94, 0.73, 0.64, 0.48, 0.36, 0.32, 0.26, 0.04, 0.04), strict=True)
)
WESTERN = dict(zip("éäüöàèßáíóñçêåúøæôûîâëïãõìòùýÿ", (18, 12, 11, 9, 6, 5, 4, 5, 5, 5, 3, 3, 3, 3, 2, 2, 2, 1, 1, 1, 2, 1, 1, 2, 1, 0.5, 0.5, 0.5, 0.3, 0.1), strict=True))
# fixed values: Python's names of the encodings and the letters expected in each
SINGLE_BYTE = {"cp1251": CYRILLIC, "koi8-r": CYRILLIC, "cp866": CYRILLIC, "iso8859-5": CYRILLIC, "latin-1": WESTERN}
UTF_16 = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}
CONFIDENCE = 0.7
#: bytes beyond ASCII from which the statistics count in full
ENOUGH = 4

#: kinds of characters: no letter of ASCII, letter of ASCII, small letter, capital, other sign, no character
SPACE, ASCII, SMALL, CAPITAL, SIGN, NOTHING = range(6)
# fixed values: how likely a kind follows another, where one of the two is beyond ASCII
FOLLOWS_CYRILLIC = {
    SPACE: {SMALL: 0.55, CAPITAL: 0.35, SIGN: 0.1}, ASCII: {SMALL: 0.01, CAPITAL: 0.01, SIGN: 0.02}, SMALL: {SPACE: 0.17, ASCII: 0.003, SMALL: 0.8, CAPITAL: 0.005, SIGN: 0.01},
    CAPITAL: {SPACE: 0.1, ASCII: 0.003, SMALL: 0.7, CAPITAL: 0.18, SIGN: 0.01}, SIGN: {SPACE: 0.8, ASCII: 0.05, SMALL: 0.05, CAPITAL: 0.08, SIGN: 0.01},
}
FOLLOWS_WESTERN = {
    SPACE: {SMALL: 0.3, CAPITAL: 0.3, SIGN: 0.1}, ASCII: {SMALL: 0.6, CAPITAL: 0.03, SIGN: 0.02}, SMALL: {SPACE: 0.2, ASCII: 0.7, SMALL: 0.04, CAPITAL: 0.001, SIGN: 0.01},
    CAPITAL: {SPACE: 0.05, ASCII: 0.8, SMALL: 0.03, CAPITAL: 0.03, SIGN: 0.01}, SIGN: {SPACE: 0.8, ASCII: 0.1, SMALL: 0.02, CAPITAL: 0.05, SIGN: 0.01},
}
_LEAST = 1e-5
_HIGH = bytes(range(0x80, 0x100))


def _characters(encoding: str) -> list[str | None]:
    """The character of each byte; None where the encoding has none."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(None)
    return out


def _kind(c: str | None) -> int:
    if c is None or unicodedata.category(c) in ("Cc", "Cn", "Co") and ord(c) > 0x7F:
        return NOTHING
    if ord(c) < 0x80:
        return ASCII if c.isalpha() else SPACE
    return SMALL if c.islower() else CAPITAL if c.isupper() else SIGN


def model(encoding: str) -> tuple[list[int], list[float], list[float]]:
    """The kind of each byte; the logarithm of its frequency among those of its kind; that of each kind behind each."""
    letters = SINGLE_BYTE[encoding]
    total = sum(letters.values())
    chars = _characters(encoding)
    kinds = [_kind(c) for c in chars]

    def share(c: str | None, kind: int) -> float:
        if kind in (SPACE, ASCII):
            return 1.0  # told alike by all encodings
        if kind in (SMALL, CAPITAL):
            return max(letters.get(c.lower(), 0.0) / total, _LEAST)
        return 1e-2 if kind == SIGN else _LEAST

    follows = FOLLOWS_CYRILLIC if letters is CYRILLIC else FOLLOWS_WESTERN
    steps = [follows.get(a, {}).get(b, _LEAST) for a in range(6) for b in range(6)]
    return kinds, [math.log(share(c, k)) for c, k in zip(chars, kinds, strict=True)], [math.log(s) for s in steps]


def _literal(values: list, kind: str) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>")


def log_likelihoods(latin: Column) -> Column:
    """array<double> in the order of SINGLE_BYTE, from the bytes as the characters U+0000 to U+00FF."""
    runs = F.array_join(F.regexp_extract_all(latin, F.lit(r"([\x00-\x7f]?[\u0080-ÿ]+[\x00-\x7f]?)"), F.lit(1)), " ")
    codes = F.transform(F.split(runs, ""), F.ascii)

    def sums(c: Column) -> Column:
        # a character and the one before it in one number; two characters of ASCII are told alike by all
        pairs = F.filter(F.transform(c, lambda x, i: x + 256 * F.when(i == 0, 32).otherwise(F.get(c, i - 1))), lambda p: p.bitwiseAND(F.lit(0x8080)) != 0)
        return let(pairs, lambda ps: F.array(*(F.aggregate(ps, F.lit(0.0), partial(_added, *_pair_scores(e))) for e in SINGLE_BYTE)))

    return let(codes, sums)


def _pair_scores(encoding: str) -> tuple[list[int], list[float]]:
    """Where the scores of what stands behind each byte begin, and the scores: a row of 256 for each kind before."""
    kinds, letters, steps = model(encoding)
    return [256 * k for k in kinds], [letters[x] + steps[before * 6 + kinds[x]] for before in range(6) for x in range(256)]


def _added(begin: list[int], scores: list[float], acc: Column, pair: Column) -> Column:
    place = F.get(_literal(begin, "int"), F.shiftright(pair, 8)) + pair.bitwiseAND(F.lit(255))
    return acc + F.get(_literal(scores, "double"), place)


def _upper_halves(latin: Column, first: bool) -> Column:
    """The share of code units whose upper half is that of ASCII, Latin, Cyrillic or punctuation."""
    halves = F.regexp_replace(latin, r"(?s)(.)(.)", "$1" if first else "$2")
    usual = F.length(F.regexp_replace(halves, r"[^\x00\x04\x20]", ""))
    return F.when(F.pmod(F.length(latin), F.lit(2)) == 0, usual / F.greatest(F.length(halves), F.lit(1))).otherwise(0.0)


def utf_16(content: Column) -> Column:
    """utf-16-le or utf-16-be if the content begins with its mark or has the zeros of one of them; else null."""
    marked = reduce(lambda c, x: c.when(F.startswith(content, F.lit(x[1])), x[0]), UTF_16.items(), F)
    latin = F.decode(content, "iso-8859-1")
    little, big = _upper_halves(latin, False), _upper_halves(latin, True)
    told = F.when((little >= 0.9) & (little > big), "utf-16-le").when((big >= 0.9) & (big > little), "utf-16-be")
    # without a zero byte there is no ASCII in it, and text in any language has its spaces and signs there
    return marked.when(F.contains(content, F.lit(b"\x00")), told)


def guessed(content: Column) -> Column:
    """struct<encoding, confidence> of content that is not UTF-8: the most likely single-byte encoding."""
    latin = F.decode(content, "iso-8859-1")
    sums = log_likelihoods(latin)
    evidence = F.least(F.lit(1.0), F.length(F.regexp_replace(latin, r"[\x00-\x7f]", "")) / ENOUGH)
    names = F.array(*(F.lit(e) for e in SINGLE_BYTE))

    def best(s: Column) -> Column:
        top = F.array_max(s)
        share = F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return F.struct(F.get(names, F.array_position(s, top).cast("int") - 1).alias("encoding"), (evidence / share).alias("confidence"))

    return let(sums, best)


def single_byte(content: Column, encoding: str) -> Column:
    """The content under a single-byte encoding; bytes that it lacks become U+FFFD."""
    own = "".join(c if c is not None else "�" for c in _characters(encoding)[0x80:])
    latin = F.decode(content, "iso-8859-1")
    return latin if encoding == "latin-1" else F.translate(latin, _HIGH.decode("latin-1"), own)


def encoded(text: Column, encoding: str) -> Column:
    """The opposite of single_byte() for texts that the encoding can write: what tests and queries make files of."""
    if encoding in UTF_16:
        return F.encode(text, "UTF-16LE" if encoding == "utf-16-le" else "UTF-16BE")
    pairs = [(c, chr(b)) for b, c in enumerate(_characters(encoding)) if b >= 0x80 and c is not None]
    return F.encode(F.translate(text, "".join(c for c, _ in pairs), "".join(x for _, x in pairs)), "iso-8859-1")
