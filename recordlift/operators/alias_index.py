"""Keywords looked up in a table of aliases of any size.

A few aliases are literals of the plan (operators/tokens.py). Beyond that, the distinct words of the documents meet the
aliases in an equi-join: two words within an edit distance of d share what is left of each when at most d characters are
deleted, so those rests are the keys. A key has as many words of either side as an alphabet allows, whatever the size of
the corpus; pairs that meet are verified by their distance, and the least (distance, trigger, alias) is taken. Only the
distinct words are shuffled for that, and only tokens that are keywords meet their documents again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlift.functions.text import java_pattern, letters, letters_spaced, spaced, split_spaced
from recordlift.plans.config import Spec

#: aliases up to which a configuration's keywords are literals of the plan
LITERALS = 300
ALIASES = "trig int, nth int, alias string, mode string"


def deletions(word: Column, most: int) -> Column:
    """The word and what is left of it without up to `most` of its characters, each once."""

    def less_one(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda k: F.concat(F.substr(w, F.lit(1), k - 1), F.substr(w, k + 1)))

    found = level = F.array(word)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, less_one)))
        found = F.array_union(found, level)
    return found


def alias_table(spec: Spec, docs: DataFrame) -> DataFrame:
    """trig, nth, alias, mode of a configuration; a regular expression is a trigger's first alias."""
    rows = [(i, k, a, t.mode) for i, t in enumerate(spec.triggers) for k, a in enumerate(t.aliases[:1] if t.mode == "regex" else t.aliases)]
    return docs.sparkSession.createDataFrame(rows, ALIASES)


def all_aliases(spec: Spec, docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """alias_table() and, behind it, the aliases of a table (trigger, alias); regular expressions and triggers that the
    configuration doesn't have take none."""
    own = alias_table(spec, docs)
    if more is None:
        return own
    able = [(t.name, i, len(t.aliases), t.mode) for i, t in enumerate(spec.triggers) if t.mode != "regex"]
    if not able:
        return own
    of = F.create_map(*(F.lit(x) if k == 0 else F.struct(*(F.lit(v).alias(n) for v, n in zip(x, ("trig", "nth", "mode"), strict=True))) for t in able for k, x in enumerate((t[0], t[1:]))))
    placed = more.select(F.try_element_at(of, F.col("trigger")).alias("t"), "alias").where("t is not null and alias is not null")
    return own.unionByName(placed.select("t.trig", "t.nth", "alias", "t.mode"))


def nearest(words: DataFrame, aliases: DataFrame, max_distance: int = 1, require_first_char: bool = True) -> DataFrame:
    """word, distance, trig, nth: for each distinct word (lower-case letters) the nearest alias within the distance, the
    earlier trigger's and then the earlier alias among equals. Words without one have no row.

    A word that is an alias needs no search; only the others meet the rests of aliases."""
    own = aliases.select("trig", "nth", letters(F.col("alias")).alias("own")).where("own <> ''")
    own = own.groupBy("own").agg(F.min(F.struct("trig", "nth")).alias("t"))
    asked = words.where("word <> ''")
    same = asked.join(own.select(F.col("own").alias("word"), "t"), "word").select("word", F.lit(0).alias("distance"), "t.trig", "t.nth")
    if max_distance == 0:
        return same
    asked = asked.join(own.select(F.col("own").alias("word")), "word", "left_anti")
    keyed = own.select("t", "own", F.explode(deletions(F.col("own"), max_distance)).alias("key"))
    asked = asked.select("word", F.explode(deletions(F.col("word"), max_distance)).alias("key"))
    if require_first_char:
        # words that differ in their first letter never meet
        keyed, asked = keyed.withColumn("first", F.substring("own", 1, 1)), asked.withColumn("first", F.substring("word", 1, 1))
    pairs = asked.join(keyed, ["key", "first"] if require_first_char else ["key"])
    distance = F.levenshtein("word", "own", max_distance)
    close = pairs.select("word", distance.alias("distance"), "t.trig", "t.nth").where("distance >= 0")
    near = close.groupBy("word").agg(F.min(F.struct("distance", "trig", "nth")).alias("b")).select("word", "b.*")
    return same.unionByName(near)


def looked_up(tokens: DataFrame, aliases: DataFrame, stop: frozenset[str] = frozenset(), max_distance: int = 1, require_first_char: bool = True, patterns: list[tuple[int, str]] | None = None) -> DataFrame:
    """token, trig for those distinct tokens that are keywords: an exact or regular-expression hit of the first such
    trigger, else the nearest fuzzy alias. Stop words and tokens without letters are none. patterns, if given, are the
    regular expressions of `aliases`, which are read from there otherwise."""
    named = tokens.select("token").distinct().withColumn("word", letters(F.col("token"))).where("word <> ''")
    if stop:
        named = named.where(~F.col("word").isin(*stop))
    hits = named.join(aliases.where("mode = 'exact'").select(F.lower("alias").alias("word"), "trig"), "word").select("token", F.lit(0).alias("rank"), F.lit(0).alias("distance"), "trig", F.lit(0).alias("nth"))
    words = named.select("word").distinct()
    if max_distance >= 0:
        fuzzy = named.join(nearest(words, aliases.where("mode = 'fuzzy'"), max_distance, require_first_char), "word")
        hits = hits.unionByName(fuzzy.select("token", F.lit(1).alias("rank"), "distance", "trig", "nth"))
    # regular expressions are few: they are the configuration's own, one for each trigger
    if patterns is None:
        patterns = [(r.trig, r.alias) for r in aliases.where("mode = 'regex'").select("trig", "alias").toLocalIterator()]
    if patterns:
        first = F.coalesce(*(F.when(F.rlike("token", F.lit(java_pattern(f"^(?:{p})\\z", "iuU"))), i) for i, p in sorted(patterns)))
        hits = hits.unionByName(named.select("token", F.lit(0).alias("rank"), F.lit(0).alias("distance"), first.cast("int").alias("trig"), F.lit(0).alias("nth")).where("trig is not null"))
    return hits.groupBy("token").agg(F.min(F.struct("rank", "distance", "trig", "nth")).alias("b")).select("token", "b.trig")


def _positions(docs: DataFrame) -> DataFrame:
    """(digest, units, clean) -> digest, token, at: for each different unit with letters the places where it stands. Units
    are sorted within their document, so equal ones stand side by side, and no row is made for each place."""
    # no column is read inside a lambda function unless it is used twice: the optimizer would move its making in there
    of = F.transform(F.arrays_zip("units", "clean"), lambda u, i: F.struct(u["units"].alias("token"), i.cast("int").alias("pos"), u["clean"].alias("clean")))
    ordered = docs.select("digest", F.sort_array(F.filter(of, lambda e: e["clean"] != "")).alias("e"))
    begin = F.filter(F.transform("e", lambda e, k: F.when((k == 0) | (F.get(F.col("e"), F.greatest(k - 1, F.lit(0)))["token"] != e["token"]), k)), lambda k: k.isNotNull())
    runs = ordered.select("digest", "e", begin.alias("begin"))

    def run(s: Column, n: Column) -> Column:
        places = F.sequence(s, F.coalesce(F.get(F.col("begin"), n + 1), F.size("e")) - 1)
        return F.struct(F.get(F.col("e"), s)["token"].alias("token"), F.transform(places, lambda k: F.get(F.col("e"), k)["pos"]).alias("at"))

    return runs.select("digest", F.explode(F.transform("begin", run)).alias("r")).select("digest", "r.token", "r.at")


def with_triggers(docs: DataFrame, spec: Spec, split_by: str, aliases: DataFrame | None = None) -> DataFrame:
    """Adds the column trigs to (text, further columns): for each token the index of its trigger, -1 for none. aliases
    (trigger, alias) are further ones.

    A text's different words meet the keywords, with the places where they stand, and come back to the text by a digest
    of it. Only regular expressions ask for more of a token than its letters."""
    patterns = [(i, t.aliases[0]) for i, t in enumerate(spec.triggers) if t.mode == "regex"]
    lined = docs.select(_digest().alias("digest"), spaced(F.col("text"), split_by).alias("text"))
    clean = lined.select("digest", letters_spaced(F.col("text")).alias("clean"), (split_spaced if patterns else letters_spaced)(F.col("text")).alias("units"))
    placed = _positions(clean)
    keywords = looked_up(placed.select("token"), all_aliases(spec, docs, aliases), spec.stop, spec.max_distance, spec.require_first_char, patterns)
    hits = placed.join(keywords, "token").groupBy("digest").agg(F.collect_set(F.struct("at", "trig")).alias("hits"))
    each = F.flatten(F.transform("hits", lambda h: F.transform(h["at"], lambda pos: F.struct(pos.alias("pos"), h["trig"].alias("trig")))))
    hits = hits.select("digest", F.sort_array(each).alias("hits"))
    joined = docs.withColumn("digest", _digest()).join(hits, "digest", "left").drop("digest")
    none = F.lit(-1)

    def up_to(h: Column, k: Column) -> Column:
        """No triggers since the hit before, then the hit's."""
        before = F.coalesce(F.get(F.col("hits"), k - 1)["pos"], none)
        return F.concat(F.array_repeat(none, h["pos"] - before - 1), F.array(h["trig"]))

    return joined.withColumn("trigs", F.coalesce(F.flatten(F.transform("hits", up_to)), F.array().cast("array<int>"))).drop("hits")


def _digest() -> Column:
    """128 bits of the text's SHA-256."""
    return F.substring(F.unhex(F.sha2("text", 256)), 1, 16)


def many_aliases(spec: Spec) -> bool:
    return reduce(lambda n, t: n + len(t.aliases), spec.triggers, 0) > LITERALS
