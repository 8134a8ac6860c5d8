"""Keywords from a table of aliases: the same answers as with literals, and a plain version with every pair compared."""

import random

import pytest

from recordlift.operators import alias_index
from recordlift.operators.alias_index import deletions, looked_up, nearest
from recordlift.plans.config import NAME_KEY, compile_config
from recordlift.plans.parse import parse
from tests.registry import CONFIG, TEXT


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most, first", [(0, True), (1, True), (1, False), (2, True), (2, False)])
def test_nearest_against_all_pairs(spark, most, first):
    rng = random.Random(most)
    word = lambda: "".join(rng.choices("abж", k=rng.randrange(1, 6)))
    aliases = [(i % 7, i, word() + rng.choice(["", ".", "1"]), "fuzzy") for i in range(60)]
    words = sorted({word() for _ in range(200)} | {""})
    got = {r.word: (r.distance, r.trig, r.nth) for r in nearest(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(aliases, alias_index.ALIASES), most, first).collect()}
    wanted = {}
    for w in words:
        close = [(distance(w, own), t, n) for t, n, a, _ in aliases if (own := a.strip(".1")) and w and (not first or own[0] == w[0]) and distance(w, own) <= most]
        if close:
            wanted[w] = min(close)
    assert got == wanted


def test_deletions(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("aab", "")], "w string, e string").select(deletions(F.col("w"), 1).alias("a"), deletions(F.col("w"), 2).alias("b"), deletions(F.col("e"), 2).alias("c")).first()
    assert sorted(row.a) == ["aa", "aab", "ab"] and sorted(row.b) == ["a", "aa", "aab", "ab", "b"] and row.c == [""]


def test_exact_and_regex_hits_come_first(spark):
    aliases = spark.createDataFrame([(0, 0, "code", "fuzzy"), (1, 0, "coda", "exact"), (2, 0, "c-[0-9]+x", "regex"), (3, 0, "stopp", "fuzzy")], alias_index.ALIASES)
    tokens = spark.createDataFrame([(t,) for t in ("code", "Coda", "coda.", "C-12X", "c-12", "stop", "123", "", "codes", "code")], "token string")
    got = {r.token: r.trig for r in looked_up(tokens, aliases, frozenset({"stop"})).collect()}
    assert got == {"code": 0, "Coda": 1, "coda.": 1, "C-12X": 2, "codes": 0}


def test_records_are_those_of_literals(spark, monkeypatch):
    spec = compile_config(CONFIG)
    docs = spark.createDataFrame([(1, TEXT), (1, TEXT), (2, None), (None, TEXT[:200]), (3, "")], "doc_id long, text string")
    plain = sorted(map(str, parse(docs, spec).collect()))
    monkeypatch.setattr(alias_index, "LITERALS", 0)
    assert sorted(map(str, parse(docs, spec).collect())) == plain and plain


def test_ten_thousand_aliases(spark):
    code = lambda k: str(k).translate(str.maketrans("0123456789", "bcdfghjkmn"))
    raw = {NAME_KEY: "many", "csv_columns": ["a", "b"], "record_detection": {"trigger": "a"}, "triggers": {n: {"aliases": [f"{n}x{code(k)}" for k in range(5000)], "search_mode": "fuzzy"} for n in ("a", "b")}}
    docs = spark.createDataFrame([(k, f"ax{code(k)} one bx{code(k)}q two") for k in range(0, 5000, 250)], "doc_id long, text string")
    got = parse(docs, compile_config(raw)).collect()
    assert len(got) == 20 and {(r.a, r.b) for r in got} == {("one", "two")}


def test_aliases_of_a_table(spark):
    """Further aliases come as rows, also those of a trigger that the configuration lacks and of a regular expression."""
    raw = {NAME_KEY: "more", "csv_columns": ["a", "b", "c"], "record_detection": {"trigger": "a"}, "triggers": {"a": {"aliases": ["first"], "search_mode": "exact"}, "b": {"aliases": ["second"], "search_mode": "fuzzy"}, "c": {"aliases": ["c[0-9]"], "search_mode": "regex"}}}
    more = spark.createDataFrame([("a", "Anfang"), ("b", "zweiter"), ("b", "anfang"), ("c", "wort"), ("d", "wort"), (None, "wort"), ("a", None)], "trigger string, alias string")
    text = "anfang x wort zweitr. y C1 z  first u ANFANG, second v, zweiter w"
    got = parse(spark.createDataFrame([(1, text), (2, ""), (1, text)], "doc_id long, text string"), compile_config(raw), aliases=more).collect()
    assert sorted(((r.a, r.b, r.c) for r in got), key=str) == sorted(2 * [("x wort", "y", "z"), ("u", None, None), (None, "v, w", None)], key=str)


def test_a_word_that_is_an_alias_meets_no_other(spark):
    """Of the words only those that are no alias are searched, so a dense table gives one row for each word."""
    aliases = spark.createDataFrame([(0, k, f"x{a}{b}", "fuzzy") for k, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "abcdefgh")], alias_index.ALIASES)
    words = spark.createDataFrame([(f"x{a}{b}",) for a in "abcdefgh" for b in "abcdefgh"] + [("xaaa",)], "word string")
    got = nearest(words, aliases)
    assert {(r.word, r.distance) for r in got.collect()} == {(f"x{a}{b}", 0) for a in "abcdefgh" for b in "abcdefgh"} | {("xaaa", 1)}
