"""Fields of a record to its columns: values normalised and validated, error codes gathered, each column by itself,
so that a query for one column computes that column only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlift.functions.text import let
from recordlift.operators.assign import COLLECTING, GUESSED, Compiled, _table
from recordlift.operators.segment import between
from recordlift.plans.config import Spec

VALUES = "array<struct<field: int, value: string>>"


@dataclass(frozen=True)
class Record:
    """Where a record's tokens stand: their text, what the machine knows of them, and the place of the first one."""

    words: Column
    notes: Column
    base: Column


def noted_record() -> Record:
    """A row of segment.cut()."""
    return Record(F.col("words"), F.col("notes"), F.col("base"))


def whole_record() -> Record:
    """A row of segment.segmented()."""
    toks = F.col("toks")
    return Record(toks["tok"], toks, F.coalesce(F.get(toks, F.lit(0))["i"], F.lit(0)))


def _stopped(t: Column, o: Column, rules: Compiled) -> Column:
    """Stop words are left out of a field, but not by a collector, and not the token that a heuristic recognised."""
    first = (o["kind"] == GUESSED) & (t["i"] == o["start"])
    return (o["kind"] != COLLECTING) & ~first & rules.stops(t, o["field"])


def _stops_within(o: Column, of: Record, rules: Compiled) -> Column:
    return F.filter(of.notes, lambda t: (t["i"] >= o["start"]) & (t["i"] < o["end"]) & _stopped(t, o, rules))


def raw_value(o: Column, of: Record, rules: Compiled, stopping: bool = True) -> Column:
    """The field's tokens; these have no white space, so neither has the value at its ends."""
    if not stopping:
        return F.array_join(between(of.words, o["start"] - of.base, o["end"] - of.base), " ")

    def kept(barred: Column) -> Column:
        places = F.filter(F.sequence(o["start"], o["end"] - 1), lambda k: ~F.array_contains(barred, k))
        return F.array_join(F.transform(places, lambda k: F.get(of.words, k - of.base)), " ")

    barred = F.transform(_stops_within(o, of, rules), lambda t: t["i"])
    return F.when(o["end"] > o["start"], let(barred, kept)).otherwise("")


def _owners(column: str, spec: Spec) -> list[int]:
    return [i for i, t in enumerate(spec.triggers) if t.column == column]


def _stoppable(own: list[int], spec: Spec) -> bool:
    return bool(spec.stop) or any(spec.triggers[i].stop for i in own)


def values_of(column: str, spec: Spec, of: Record | None = None) -> Column:
    """The values of one column in the order they were closed, empty ones left out."""
    own, of, rules = _owners(column, spec), of or whole_record(), Compiled(spec)

    def value(o: Column) -> Column:
        raw = raw_value(o, of, rules, _stoppable(own, spec))
        made = [spec.triggers[i].normalize(raw) for i in own]
        chosen = reduce(lambda c, x: c.when(o["field"] == x[0], x[1]), zip(own, made, strict=True), F) if len(own) > 1 else made[0]
        return F.struct(o["field"].alias("field"), chosen.alias("value"))

    mine = F.filter("fields", lambda o: o["field"].isin(*own))
    return F.filter(F.transform(mine, value), lambda v: v["value"] != "").cast(VALUES)


def _simple(own: list[int], spec: Spec) -> Column:
    """Whether the column of these triggers can be read without a list of values: its field was opened once at most,
    and no token of the record is a stop word that could be left out."""
    once = ~F.col("_again") if len(own) == 1 else F.lit(False)
    return once & ~F.col("_halted") if _stoppable(own, spec) else once


def only_value(own: int, spec: Spec, of: Record) -> Column:
    """The value of a field that was opened once, null for none."""
    nth = F.array_position(F.col("fields")["field"], F.lit(own)).cast("int") - 1
    start, end = (F.get(F.col("fields")[side], nth) for side in ("start", "end"))
    raw = F.array_join(F.slice(of.words, start - of.base + 1, end - start), " ")
    return F.when(nth >= 0, F.nullif(spec.triggers[own].normalize(raw), F.lit("")))


def _covered(place: Column) -> Column:
    return F.exists("fields", lambda o: (place >= o["start"]) & (place < o["end"]))


def _no_codes() -> Column:
    return F.array().cast("array<string>")


def _guess_codes(spec: Spec) -> Column:
    codes = [None, *(t.missing_code for t in spec.triggers)]
    if not any(codes):
        return _no_codes()
    found = F.transform(F.filter("fields", lambda o: o["kind"] >= GUESSED), lambda o: _table(codes, "string", o["field"]))
    return F.when(F.array_max(F.col("fields")["kind"]) >= GUESSED, found).otherwise(_no_codes())


def _stop_codes(spec: Spec, of: Record) -> Column:
    rules = Compiled(spec)
    if not rules.stopping:
        return _no_codes()
    codes = ["errSTOP", *(t.stop_code for t in spec.triggers)]
    able = [i for i, t in enumerate(spec.triggers) if spec.stop or t.stop]
    found = F.transform(F.filter("fields", lambda o: o["field"].isin(*able) & (F.size(_stops_within(o, of, rules)) > 0)), lambda o: _table(codes, "string", o["field"]))
    if spec.stop:
        outside = F.exists(of.notes, lambda t: t["gstop"] & ~_covered(t["i"]))
        found = F.concat(found, F.when(outside, F.array(F.lit("errSTOP"))).otherwise(_no_codes()))
    return F.when(F.col("_halted"), found).otherwise(_no_codes())


def _rule_codes(spec: Spec, held: dict[str, str]) -> list[Column]:
    """For each column with rules, the codes of values that break theirs (null for the others)."""

    def codes(column: str, name: str) -> Column | None:
        own = _owners(column, spec)
        checked = [(i, spec.triggers[i]) for i in own if spec.triggers[i].valid is not None]
        if not checked:
            return None

        def broken(v: Column) -> Column:
            return reduce(lambda c, x: c.when((v["field"] == x[0]) & ~x[1].valid(v["value"]), F.lit(x[1].valid_code)), checked, F)

        several = F.transform(name, broken)
        if len(own) > 1:
            return several
        t, only = checked[0][1], F.col(f"{name}_only")
        return F.when(~_simple(own, spec), several).when(only.isNotNull() & ~t.valid(only), F.array(F.lit(t.valid_code))).otherwise(_no_codes())

    return [c for column, name in held.items() if (c := codes(column, name)) is not None]


def with_columns(fields: DataFrame, spec: Spec, lost: bool = False) -> DataFrame:
    """doc_seq if given, doc_id, rec_idx, the declared columns and err (null: absent), and lost, the tokens without a field, if asked."""
    of, rules = noted_record(), Compiled(spec)
    held = {c: f"_values_{k}" for k, c in enumerate(dict.fromkeys(t.column for t in spec.triggers))}
    again = F.size(F.array_distinct(F.col("fields")["field"])) < F.size("fields")
    halted = F.exists("notes", rules.halting) if rules.stopping else F.lit(False)
    rows = fields.select("*", again.alias("_again"), halted.alias("_halted"))
    # a column's list of values where it may have several, else its only value
    lists, onlys = {}, {}
    for c, name in held.items():
        own = _owners(c, spec)
        lists[name] = F.when(~_simple(own, spec), values_of(c, spec, of)) if len(own) == 1 else values_of(c, spec, of)
        if len(own) == 1:
            onlys[f"{name}_only"] = F.when(_simple(own, spec), only_value(own[0], spec, of))
    rows = rows.select("*", *(x.alias(n) for n, x in (lists | onlys).items()))
    codes = F.sort_array(F.array_distinct(F.array_compact(F.concat(_guess_codes(spec), _stop_codes(spec, of), *_rule_codes(spec, held)))))
    # a column of its own, since it is used twice
    rows, codes = rows.withColumn("_codes", codes), F.col("_codes")

    def value(c: str) -> Column:
        if c not in held:
            return F.lit(None).cast("string")
        several = F.when(F.size(held[c]) > 0, F.array_join(F.transform(held[c], lambda v: v["value"]), " "))
        return F.coalesce(F.col(f"{held[c]}_only"), several) if f"{held[c]}_only" in onlys else several

    shown = {c: value(c) for c in spec.columns}
    shown["err"] = F.coalesce(F.when(F.size(codes) > 0, F.array_join(codes, "; ")), shown.get("err", F.lit(None).cast("string")))
    more = []
    if lost:
        taken = F.filter("notes", lambda t: ((t["trig"] >= 0) | (t["gstop"] if "gstop" in rules.asked else F.lit(False))) & ~_covered(t["i"]))
        covered = F.aggregate("fields", F.lit(0), lambda n, o: n + o["end"] - o["start"])

        def gone(barred: Column) -> Column:
            free = F.filter(F.transform("words", lambda w, k: F.struct((k + of.base).cast("int").alias("i"), w.alias("tok"))), lambda t: ~_covered(t["i"]) & ~F.array_contains(barred, t["i"]))
            # ranges of fields don't overlap
            return F.when(covered + F.size(barred) < F.size("words"), F.transform(free, lambda t: t["tok"])).otherwise(_no_codes())

        more = [let(F.transform(taken, lambda t: t["i"]), gone).alias("lost")]
    own = ["doc_seq", "doc_id", "rec_idx"] if "doc_seq" in fields.columns and "doc_seq" not in spec.output else ["doc_id", "rec_idx"]
    return rows.select(*own, *(shown[c].alias(c) for c in spec.output), *more)
