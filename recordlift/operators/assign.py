"""The state machine that gives a record's tokens to fields, as one aggregate() over the token array.

The state holds the open field, the last closed one, where the open one began and how it was opened, and the closed
fields. A field's tokens are a range of the record less its stop words, so the state never copies tokens; lost
tokens and error codes follow from the ranges afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlift.functions.text import let
from recordlift.plans.config import Spec

#: how a field was opened: by its keyword, by its heuristic, by its heuristic with a collector
KEYWORD, GUESSED, COLLECTING = 0, 1, 2
OPENINGS = "array<struct<field: int, start: int, end: int, kind: int>>"


def _bit(mask: Column, field: Column) -> Column:
    """Whether the field's bit is set; false for no field."""
    return (field >= 0) & (F.call_function("shiftright", mask, F.greatest(field, F.lit(0))).bitwiseAND(F.lit(1).cast("long")) == 1)


def _table(values: list, kind: str, field: Column) -> Column:
    """values[field], for a field from -1 on: the first value stands for none."""
    return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), field + 1)


class Compiled:
    """What the machine asks of a configuration, as literals of the plan: a field is a bit of a long."""

    def __init__(self, spec: Spec):
        names = [t.name for t in spec.triggers]
        guessing = [i for i, t in enumerate(spec.triggers) if t.detect is not None]
        self._allowed = [sum(1 << h for h in guessing if spec.triggers[h].after in (None, f)) for f in (None, *names)]
        self._most = [0, *(t.collect_most for t in spec.triggers)]
        self._multi = sum(1 << i for i, t in enumerate(spec.triggers) if t.multi is not None)
        self._collecting = sum(1 << i for i, t in enumerate(spec.triggers) if t.collect is not None)
        self._global, self._own = bool(spec.stop), any(t.stop for t in spec.triggers)
        self.stopping = self._global or self._own
        self.guessing, self.collecting = bool(guessing), bool(self._collecting)
        #: without collectors and multi-token fields, only notable tokens can change the state
        self.only_notable = not self._multi and not self._collecting
        #: the members of a token's facts that this configuration needs
        given = {"trig": True, "gstop": self._global, "stop": self._own, "coll": not self.only_notable, "mult": not self.only_notable, "heur": self.guessing}
        self.asked = tuple(n for n, needed in given.items() if needed)

    def halting(self, t: Column) -> Column:
        """Stop words of any kind."""
        return reduce(lambda a, b: a | b, [*([t["gstop"]] if self._global else []), *([t["stop"] != 0] if self._own else [])], F.lit(False))

    def notable(self, t: Column) -> Column:
        """Keywords, stop words, and tokens that a heuristic may recognise."""
        found = t["trig"] >= 0
        found = found | self.halting(t) if self.stopping else found
        return found | (t["heur"] != 0) if self.guessing else found

    def stops(self, t: Column, field: Column) -> Column:
        """Stop words of all fields, and of this one."""
        return reduce(lambda a, b: a | b, [*([t["gstop"]] if self._global else []), *([_bit(t["stop"], field)] if self._own else [])], F.lit(False))

    def collects(self, t: Column, field: Column) -> Column:
        return _bit(t["coll"], field)

    def fits(self, t: Column, field: Column) -> Column:
        return _bit(t["mult"], field)

    def most(self, field: Column) -> Column:
        """How many tokens the field's collector takes."""
        return _table(self._most, "int", field)

    def is_multi(self, field: Column) -> Column:
        return _bit(F.lit(self._multi).cast("long"), field)

    def is_collecting(self, field: Column) -> Column:
        return _bit(F.lit(self._collecting).cast("long"), field)

    def able(self, t: Column, base: Column) -> Column:
        """The triggers whose heuristics recognise the token behind this field, as bits."""
        return t["heur"].bitwiseAND(_table(self._allowed, "long", base))

    def first(self, able: Column) -> Column:
        return F.bit_count(able.bitwiseAND(-able) - 1).cast("int")

    def guess(self, t: Column, base: Column) -> Column:
        """The first trigger whose heuristic recognises the token behind this field; -1 for none."""
        return let(self.able(t, base), lambda m: F.when(m == 0, F.lit(-1)).otherwise(self.first(m)))


def openings(toks: Column, spec: Spec) -> Column:
    """The fields of a record in the order they were closed: field, [start, end) in the document's tokens, kind."""
    return machine(toks, Compiled(spec))


def machine(toks: Column, rules, end: Column | None = None) -> Column:
    """The same for rules of any kind with Compiled's methods. Where `toks` is not every token of the record, `end` says
    where that ends."""
    none = F.lit(-1)
    end = F.coalesce(F.get(toks, F.lit(0))["i"], F.lit(0)) + F.size(toks) if end is None else end
    if rules.only_notable:
        return _simple(toks, rules, end)

    def opening(acc: Column, end: Column) -> Column:
        return F.array(F.struct(acc["cur"].alias("field"), acc["start"].alias("start"), end.alias("end"), acc["kind"].alias("kind")))

    def advance(acc: Column, t: Column) -> Column:
        in_collector = acc["kind"] == COLLECTING if rules.collecting else F.lit(False)
        stays = in_collector & (t["trig"] < 0) & (t["i"] - acc["start"] < rules.most(acc["cur"])) & rules.collects(t, acc["cur"])

        def chosen(s: Column) -> Column:
            # s: cur, the open field once a collector is left; last, the last closed one
            stopped = rules.stops(t, s["cur"]) if rules.stopping else F.lit(False)
            keyword = ~stopped & (t["trig"] >= 0)
            is_multi = rules.is_multi(s["cur"])
            accepted = ~stopped & ~keyword & is_multi & rules.fits(t, s["cur"])
            base = F.when(s["cur"] >= 0, s["cur"]).otherwise(s["last"])
            guess = F.when(stopped | keyword | accepted, none).otherwise(rules.guess(t, base)) if rules.guessing else none
            return F.struct(
                s["cur"].alias("cur"), keyword.alias("keyword"), guess.alias("guess"),
                (~stopped & ~keyword & is_multi & ~accepted).alias("rejected"),
            )

        def moved(d: Column) -> Column:
            left = in_collector
            opens = d["keyword"] | (d["guess"] >= 0)
            saved = (acc["cur"] >= 0) & (left | opens | d["rejected"])
            cur = F.when(d["keyword"], t["trig"]).when(d["guess"] >= 0, d["guess"]).when(d["rejected"], none).otherwise(d["cur"])
            start = F.when(d["keyword"], t["i"] + 1).when(d["guess"] >= 0, t["i"]).otherwise(acc["start"])
            kind = F.when(d["guess"] >= 0, F.when(rules.is_collecting(d["guess"]), COLLECTING).otherwise(GUESSED)).when(opens | left | d["rejected"], KEYWORD).otherwise(acc["kind"])
            return F.struct(
                cur.cast("int").alias("cur"), F.when(saved, acc["cur"]).otherwise(acc["last"]).cast("int").alias("last"), start.cast("int").alias("start"), kind.cast("int").alias("kind"),
                F.when(saved, F.concat(acc["done"], opening(acc, t["i"]))).otherwise(acc["done"]).alias("done"),
            )

        entered = F.struct(F.when(in_collector, none).otherwise(acc["cur"]).alias("cur"), F.when(in_collector, acc["cur"]).otherwise(acc["last"]).alias("last"))
        # most tokens just follow the open field, or none
        follows = ~in_collector & ~rules.notable(t) & ~rules.is_multi(acc["cur"])
        return F.when(follows | stays, acc).otherwise(let(let(entered, chosen), moved))

    zero, unset = F.lit(0).cast("int"), none.cast("int")
    start = F.struct(unset.alias("cur"), unset.alias("last"), zero.alias("start"), zero.alias("kind"), F.array().cast(OPENINGS).alias("done"))
    return F.aggregate(toks, start, advance, lambda acc: F.when(acc["cur"] >= 0, F.concat(acc["done"], opening(acc, end))).otherwise(acc["done"]))


def _simple(events: Column, rules, end: Column) -> Column:
    """The machine without collectors and multi-token fields: a field stays open until the next one, so the state is the
    open field and what was opened where; ends follow from the next opening."""

    def opened(acc: Column, t: Column, field: Column, start: Column, kind: int) -> Column:
        new = F.struct(field.alias("field"), start.alias("start"), t["i"].alias("end"), F.lit(kind).alias("kind"))
        return F.struct(field.alias("cur"), F.array_append(acc["done"], new).alias("done"))

    def step(acc: Column, t: Column) -> Column:
        cases = F.when(rules.stops(t, acc["cur"]), acc) if rules.stopping else F
        cases = cases.when(t["trig"] >= 0, opened(acc, t, t["trig"], t["i"] + 1, KEYWORD))
        if rules.guessing:
            able = rules.able(t, acc["cur"])
            cases = cases.when(able != 0, opened(acc, t, rules.first(able), t["i"], GUESSED))
        return cases.otherwise(acc)

    def ended(acc: Column) -> Column:
        of = acc["done"]
        return F.transform(of, lambda o, k: F.struct(o["field"].alias("field"), o["start"].alias("start"), F.coalesce(F.get(of, k + 1)["end"], end).alias("end"), o["kind"].alias("kind")))

    return F.aggregate(events, F.struct(F.lit(-1).alias("cur"), F.array().cast(OPENINGS).alias("done")), step, ended)


def assigned(records: DataFrame, spec: Spec) -> DataFrame:
    """Adds the column fields. It passes through a generator: a filter above it does not run the machine again."""
    if "notes" in records.columns:
        found = machine(F.col("notes"), Compiled(spec), F.col("base") + F.size("words"))
    else:
        found = openings(F.col("toks"), spec)
    return records.select("*", F.explode(F.array(found)).alias("fields"))
