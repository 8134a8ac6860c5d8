import random
import re

import pytest
from pyspark.sql import functions as F

from recordlift.functions.predicates import predicate
from recordlift.functions.rules import rule
from recordlift.functions.steps import normalizer, step
from recordlift.functions.text import clean_text, java_template, letters, letters_spaced, spaced, split_spaced, tokenize, words
from recordlift.operators.tokens import classified
from recordlift.plans.config import compile_config
from tests.plain import edits


def applied(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


STEPS = [
    ("strip", "  a\x1c", "a"), ("remove_trailing_dot", "6.8...", "6.8"), ("remove_dots", "a.b.", "ab"), ("remove_spaces", "a b\tc", "ab\tc"), ("collapse_spaces", " a   b ", "a b"),
    ("uppercase", "аб ß", "АБ SS"), ("lowercase", "ДОМ", "дом"), ("digits_only", "٣a1-2", "٣12"),
    ("replace_char:.->:", "1.2", "1:2"), ("replace_char:internal:.->/", ".4.5. ", ".4/5. "), ("replace_char:internal:.->$1", "4.5", "4$15"), ("replace_char:.>/", "4.5", "4.5"), ("replace_char:->x", "ab", "ab"),
    ("replace_dot_before_keywords:дом,улица", "Тверь. Улица Мира. ДОМ. 5. домик", "Тверь, Улица Мира, ДОМ. 5. домик"),
    ("replace_dot_after_keywords:дом,улица", "Улица. Мира дом.5 ДОМ.", "Улица Мира дом.5 ДОМ"),
    ("replace_space_before_keywords:дом,корп", "Мира дом 5,  корп 2, ёлка домик", "Мира, Дом 5, Корп 2, Ёлка домик"),
    ("regex_sub:(\\w+) (\\w+) -> \\2-\\1", "а б", "б-а"), ("regex_sub:(?P<x>\\d)->[\\g<x>]", "a1", "a[1]"), ("regex_sub:nothing", "a", "a"),
    ("normalize_number", " 1 234,5 ", "1234.5"), ("normalize_number:;:.", "1.234;5", "1234.5"), ("normalize_number:.:", "1 2.5", "12.5"),
    ("to_int", "12,9", "12"), ("to_int", "-0.5", "0"), ("to_int", "1_0", "10"), ("to_int", "12d", "12d"), ("to_int", "1e3", "1000"), ("to_int", "", ""), ("to_int", "inf", "inf"),
    ("to_float:2", "2.675", "2.67"), ("to_float:1", "12.25", "12.2"), ("to_float:1", "12.35", "12.3"), ("to_float:0", "2.5", "2"), ("to_float:0", "3.5", "4"), ("to_float:2", "-0,001", "-0.0"), ("to_float:2", "12345678", "12345678.0"), ("to_float:6", "0.00001", "1e-05"), ("to_float:2", "x", "x"),
    ("pad_left:5", "12", "00012"), ("pad_left:2", "12345", "12345"), ("pad_right:5:x", "ab", "abxxx"), ("no_such_step", "a", "a"),
]


@pytest.fixture(scope="module")
def step_results(spark):
    one = spark.range(1).select(*(step(n)(F.lit(v)).alias(f"c{i}") for i, (n, v, _) in enumerate(STEPS)))
    return list(one.first())


@pytest.mark.parametrize("k", range(len(STEPS)), ids=lambda k: f"{STEPS[k][0]}-{k}")
def test_step(step_results, k):
    assert step_results[k] == STEPS[k][2]


def test_rounding_is_that_of_the_exact_binary_value(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 6):
        values = [rng.choice("-+ ")[:1].strip() + f"{rng.uniform(0, 10 ** rng.randrange(1, 9)):.{rng.randrange(0, 9)}f}" for _ in range(300)] + [f"{rng.randrange(10**5)}.{'5' if n == 0 else '0' * (n - 1) + '25'}" for _ in range(100)] + [f"{rng.randrange(1000) + 0.5 / 10**n!r}" for _ in range(100)]
        want = [str(int(round(float(v)))) if n == 0 else str(round(float(v), n)) for v in values]
        assert applied(spark, step(f"to_float:{n}"), values) == want


def test_normalizer(spark):
    f = normalizer(["uppercase", "apply_replacements", "remove_dots"], [("А", "Б"), ("Б", "В")])
    assert applied(spark, f, [" а.б. ", ""]) == ["ВВ", ""]
    assert java_template(r"a$\1\\") == r"a\$$1\\"


PREDICATES = [
    ("starts_upper", ["Дом", "(Дом)", '"Дом', "дом", "А1Б", "...", "", "А²"], [True, True, False, False, False, False, False, False]),
    ("has_letter", ["1а", "1", "-"], [True, False, False]),
    ("looks_like_number_colon_dot", ["59.34:А", "59.34а", "Ё", "Z", ""], [True, False, True, False, False]),
    ("is_part_of_number_colon_dot", ["59.", "АБ", "А:"], [True, False, True]),
    ("any", ["a", "  ", ""], [True, False, False]),
    ("regex: ^х\\w$ | starts_upper", ["хы", "хыы", "Ж"], [True, False, True]),
]


@pytest.mark.parametrize("expression, values, want", PREDICATES)
def test_predicate(spark, expression, values, want):
    assert applied(spark, predicate(expression), values) == want


def test_unknown_predicates():
    for bad in ("nope", "regex:a|b", ""):
        with pytest.raises(ValueError):
            predicate(bad)


def test_rules(spark):
    assert applied(spark, rule("regex:[а-я]+"), ["дом", "дом\n", "Дом"]) == [True, False, False]
    assert applied(spark, rule("word_count:2,3"), ["a", "a b", "a b c", "a b c d"]) == [False, True, True, False]
    assert applied(spark, rule("other"), [""]) == [True]


def test_text(spark):
    assert applied(spark, clean_text, ["a [x [y] z] b [[q]] c", "[1 2", "a﻿​b  c \t\n d", ""]) == ["a b c", "[1 2", "ab c d", ""]
    assert applied(spark, lambda c: tokenize(c, "whitespace_and_punctuation"), ["a,,b ,c"]) == [["a", ",", ",", "b", ",c"]]
    odd = "".join(c for c in map(chr, range(0x3100)) if c.isspace())
    assert applied(spark, words, ["x".join(odd), "", " "]) == [["x"] * (len(odd) - 1), [], []]


def test_brackets_nested_deeply(spark):
    deep = 10_500
    values = ["a " + "[" * deep + "x" + "]" * deep + " b", "[" * deep + "x] y", "c " + "[q] " * deep + "d", "[" * 3 + "]" * 5]
    assert applied(spark, clean_text, values) == ["a b", "[" * (deep - 1) + " y", "c d", "]]"]


def test_letters_of_all_tokens_in_one_pass(spark):
    """They stand beside their tokens, also where a token has none, for spaces and letters of any kind."""
    texts = ["", " ", "a", " Ab1, 23 c-D. ", "ΑΣ ΑΣ' Σ ΣΑ", "İx y  z\x1cÄ　\U0001d4d0b", "x,,y ,z, ,w,", "\U0001d4d0,b  ,c\n,d"]
    for split_by in ("whitespace", "whitespace_and_punctuation"):
        toks = applied(spark, lambda c, s=split_by: split_spaced(spaced(c, s)), texts)
        assert toks == applied(spark, lambda c, s=split_by: tokenize(c, s), texts)
        assert applied(spark, lambda c, s=split_by: letters_spaced(spaced(c, s)), texts) == applied(spark, lambda c, s=split_by: F.transform(tokenize(c, s), letters), texts)
        wanted = [re.sub(r"(?<=\S),", " , ", t) if split_by != "whitespace" else t for t in texts]
        assert toks == [t.split() for t in wanted]


def test_even_text_meets_no_pattern_before_it_is_split(spark, capsys):
    """Texts of ASCII and single spaces are told from others without a pattern, and split by one space."""
    spark.createDataFrame([("a",)], "v string").select(spaced(clean_text(F.col("v")))).explain(True)
    assert "^ -~" not in capsys.readouterr().out
    rng = random.Random(21)
    chars = "aB5.,[]\x00\x07\x1b\x7f\t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u2009\u3000\u200bяé😀" + " " * 12
    texts = ["".join(rng.choices(chars, k=rng.randrange(12))) for _ in range(3000)]
    got = applied(spark, tokenize, texts)
    assert got == [re.findall(r"[^\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", t) for t in texts]
    assert applied(spark, lambda c: letters_spaced(spaced(c)), texts) == [["".join(c for c in w.lower() if c.isalpha()) for w in g] for g in got]


def test_the_nearest_keyword(spark, capsys):
    """Distance first, then the order of the triggers; the same word is found without a distance."""
    raw = {"parser_name": "x", "csv_columns": ["a"], "max_distance": 2, "triggers": {k: {"aliases": v, "search_mode": "fuzzy", "csv_column": "a"} for k, v in {"a": ["prio", "pair"], "b": ["price", "prio"], "c": ["pri", "cell"]}.items()}}
    made = compile_config(raw)
    tried = ["prio", "price", "pri", "pair", "prie", "pric", "prioc", "pr", "p", "pairs", "cel", "cell", "cellar", "xprio", "", "pxrxixo"]

    def nearest(word):
        found = [(edits(word, a), i) for i, t in enumerate(made.triggers) for a in t.aliases if word and a[0] == word[0]]
        return min((f for f in found if f[0] <= 2), default=(0, -1))[1]

    assert applied(spark, lambda c: classified(c, c, made), tried) == list(map(nearest, tried))
    spark.createDataFrame([("a",)], "v string").select(classified(F.col("v"), F.col("v"), made)).explain(True)
    shown = capsys.readouterr().out
    assert "= prio)" in shown and "transform" not in shown
