"""Tokens with what the state machine needs to know of each: trigger, stop words, and the predicates' answers.

Everything here is a function of one document, so the plan stays without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlift.functions.predicates import Predicate
from recordlift.functions.text import java_pattern, letters, tokenize
from recordlift.plans.config import Spec, Trigger

NONE = -1


def _first_hit(tok: Column, clean: Column, spec: Spec) -> Column | None:
    """The first exact or regular-expression trigger that the token satisfies."""
    hits = []
    for i, t in enumerate(spec.triggers):
        if t.mode == "exact":
            hits.append(F.when(clean.isin(*{a.lower() for a in t.aliases}), i))
        elif t.mode == "regex":
            hits.append(F.when(F.rlike(tok, F.lit(java_pattern(f"^(?:{t.aliases[0]})\\z", "iuU"))), i))
    return F.coalesce(*hits) if hits else None


def _nearest(clean: Column, spec: Spec) -> Column | None:
    """The fuzzy trigger with the least edit distance, the earlier one among equals. Aliases that cannot match for
    their first letter are not compared."""
    n = len(spec.triggers)
    by_first: dict[str, list[tuple[int, str]]] = {}
    for i, t in enumerate(spec.triggers):
        for alias in t.aliases if t.mode == "fuzzy" else ():
            if own := "".join(c for c in alias.lower() if c.isalpha()):
                by_first.setdefault(own[0] if spec.require_first_char else "", []).append((i, own))
    if not by_first or spec.max_distance < 0:
        return None

    def least(aliases: list[tuple[int, str]]) -> Column:
        # most keywords have no typing error
        exact: dict[str, int] = {}
        for i, a in aliases:
            exact.setdefault(a, i)
        same = reduce(lambda c, x: c.when(clean == x[0], x[1]), exact.items(), F)
        distances = {(i, a): F.levenshtein(clean, F.lit(a), spec.max_distance) for i, a in aliases}
        if len({i for i, _ in distances}) == 1:  # no rank among aliases of one trigger
            return same.when(reduce(lambda a, b: a | b, (d >= 0 for d in distances.values())), aliases[0][0])
        # distance and trigger in one number; a distance of -1, beyond the one allowed, comes behind all others
        ranks = [F.pmod(d.cast("long"), F.lit(spec.max_distance + 2)) * n + i for (i, _), d in distances.items()]
        best = F.least(*ranks)
        return same.otherwise(F.when(best < (spec.max_distance + 1) * n, F.pmod(best, F.lit(n))))

    if not spec.require_first_char:
        return least(by_first[""])
    return reduce(lambda c, item: c.when(F.startswith(clean, F.lit(item[0])), least(item[1])), by_first.items(), F)


def classified(tok: Column, clean: Column, spec: Spec) -> Column:
    """Index of the token's trigger, -1 for none. An exact or regex hit comes before every fuzzy one."""
    answers = [a for a in (_first_hit(tok, clean, spec), _nearest(clean, spec)) if a is not None]
    barred = (clean == "") | (clean.isin(*spec.stop) if spec.stop else F.lit(False))
    return F.when(barred, NONE).otherwise(F.coalesce(*answers, F.lit(NONE))).cast("int")


def _mask(triggers: tuple[Trigger, ...], test) -> Column:
    """A bit for each trigger whose test, if it has one, holds."""
    long = lambda n: F.lit(n).cast("long")
    bits = [F.when(c, long(1 << i)).otherwise(long(0)) for i, t in enumerate(triggers) if (c := test(t)) is not None]
    return reduce(lambda a, b: a + b, bits) if bits else long(0)


def splitting(spec: Spec) -> str:
    """How texts are split: without record detection the tokenizer's setting has no effect."""
    return spec.split_by if spec.record_trigger is not None else "whitespace"


def annotated(text: Column, spec: Spec, trigs: Column | None = None) -> Column:
    """array<struct<i, tok, trig, gstop, stop, coll, mult, heur>>: trig is a trigger's index; gstop says that a word of
    the global stop list stands there; the others hold a bit for each trigger.

    trigs, if given, has the triggers looked up already; it may end behind the last keyword."""
    pairs = F.transform(tokenize(text, splitting(spec)), lambda t: F.struct(t.alias("tok"), letters(t).alias("clean")))
    return F.transform(pairs, lambda x, i: F.struct(i.cast("int").alias("i"), x["tok"].alias("tok"), *(c.alias(n) for n, c in _facts(x["tok"], x["clean"], i, spec, trigs).items())))


def _facts(tok: Column, clean: Column, i: Column, spec: Spec, trigs: Column | None) -> dict[str, Column]:
    holds = lambda p: None if p is None else p(tok)

    def guess(t: Trigger) -> Column | None:
        if t.detect is None:
            return None
        return t.detect(tok) & ~t.unless(tok) if t.unless else t.detect(tok)

    return {
        "trig": classified(tok, clean, spec) if trigs is None else F.coalesce(F.get(trigs, i), F.lit(NONE)).cast("int"),
        "gstop": clean.isin(*spec.stop) if spec.stop else F.lit(False),
        "stop": _mask(spec.triggers, lambda t: clean.isin(*t.stop) if t.stop else None),
        "coll": _mask(spec.triggers, lambda t: holds(t.collect)),
        "mult": _mask(spec.triggers, lambda t: holds(t.multi)),
        "heur": _mask(spec.triggers, guess),
    }


def noted(words: Column, clean: Column, spec: Spec, rules, trigs: Column | None = None) -> Column:
    """array<struct<i, trig, ...>>: what annotated() says of the tokens that can change the state machine's state, less
    their text and the members that the configuration never asks for. clean has the tokens' letters."""
    facts = lambda clean, i: _facts(F.get(words, i), clean, i, spec, trigs)
    notes = F.transform(clean, lambda clean, i: F.struct(i.cast("int").alias("i"), *(c.alias(n) for n, c in facts(clean, i).items() if n in rules.asked)))
    return F.filter(notes, rules.notable) if rules.only_notable else notes


def marked(text: Column, test: Predicate) -> Column:
    """Tokens of the text for which the predicate holds."""
    return F.filter(tokenize(text), test)

