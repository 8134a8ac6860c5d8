"""Documents of many configurations in one plan: configurations are rows of a table, and each document names its own.

Triggers, predicates, rules and steps are data here, joined to the documents by the configuration's id, and the state
machine looks its transitions up in them. The plan's size depends neither on how many configurations there are nor on
how many triggers one has; results are those of parse() for each configuration. Its expressions are general ones, so a
configuration with much text of its own is faster with parse().

Before the marking of duplicates there is one join with the table of configurations, which Spark broadcasts if it is
small by its size. Documents of a configuration that isn't in the table, or without one, have no records.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlift.functions.data import PREDICATE, RULE, STEP, follows, holds, normalised, predicate_rows, rule_row, step_rows
from recordlift.functions.steps import DEFAULT
from recordlift.functions.text import clean_text, java_pattern, let, letters, strip, tokenize
from recordlift.operators.assign import COLLECTING, GUESSED, machine
from recordlift.operators.segment import slices
from recordlift.plans.config import in_order, validate_config

TRIGGER = (
    f"struct<name: string, col: string, mode: string, aliases: array<string>, pattern: string, stop: array<string>, stop_code: string, rule: {RULE}, rule_code: string, detect: array<{PREDICATE}>, "
    f"barred: array<{PREDICATE}>, after: int, missing_code: string, collect: array<{PREDICATE}>, most: int, multi: array<{PREDICATE}>, steps: array<{STEP}>>"
)
CONFIGS = (
    f"config_id string, trigs array<{TRIGGER}>, detection boolean, record_trig int, commas boolean, stops array<string>, max_distance int, same_first boolean, keep_lost boolean, fields array<string>, "
    "dup_key string, dup_code string, dup_case boolean"
)


def _trigger_row(name: str, t: dict[str, Any], names: list[str]) -> tuple:
    check, guess, collector, multi = (t.get(k) or {} for k in ("validation", "heuristics", "collector", "multi_token"))
    rows = lambda part, key: predicate_rows(part[key]) if key in part else None
    mode, aliases = t["search_mode"], [str(a) for a in t["aliases"]]
    own = [a.lower() for a in aliases] if mode == "exact" else ["".join(c for c in a.lower() if c.isalpha()) for a in aliases]
    detect, barred, after, missing = None, None, None, None
    if "detect_by" in guess:
        detect, barred, missing = rows(guess, "detect_by"), rows(guess, "unless"), guess.get("error_code", f"err{name.upper()}") or None
        wanted = guess.get("if_missing_after") or None
        # null: behind any field; -2: behind a field that there isn't
        after = None if wanted is None else names.index(wanted) if wanted in names else -2
    replacements = list((t.get("replacements") or {}).items())
    pipeline = (t.get("normalization") or {}).get("pipeline", list(DEFAULT))
    fits = (rows(multi, "token_rule") or predicate_rows("any")) if isinstance(multi, dict) and multi.get("enabled") else None
    return (
        name, t.get("csv_column", name), mode, [a for a in own if a], java_pattern(f"^(?:{aliases[0]})\\z", "iuU") if mode == "regex" else None, [w.lower() for w in t.get("stop_words") or []], t.get("stop_word_error", "errSTOP"),
        rule_row(check.get("rule", "")) if check else None, check.get("error_code", "errVAL"), detect, barred, after, missing, (rows(collector, "token_rule") or predicate_rows("any")) if collector else None, collector.get("max_tokens", 10), fits,
        [s for name_of in pipeline for s in step_rows(name_of, replacements)],
    )


def config_table(spark: SparkSession, configs: dict[str, dict[str, Any]]) -> DataFrame:
    """A row for each configuration by its id; ValueError with all problems of all of them. There is no limit on triggers."""
    found = [f"{key}: {p}" for key, raw in configs.items() for p in validate_config(raw, None)]
    if found:
        raise ValueError("\n".join(found))
    rows = []
    for key, raw in configs.items():
        triggers = in_order(raw["triggers"])
        names = [n for n, _ in triggers]
        dedup, detection = raw.get("dedup") or {}, raw.get("record_detection") or {}
        trigger = detection.get("trigger")
        rows.append((
            key, [_trigger_row(n, t, names) for n, t in triggers], trigger is not None, names.index(trigger) if trigger in names else -2, trigger is not None and (raw.get("tokenizer") or {}).get("split_by") == "whitespace_and_punctuation",
            [w.lower() for w in raw.get("stop_words", [])], int(raw.get("max_distance", 1)), raw.get("require_first_char", True), bool(raw.get("log_suspicious", False)), list(dict.fromkeys(raw["csv_columns"])),
            dedup.get("key"), dedup.get("error_code", "errDUP"), dedup.get("case_sensitive", False),
        ))
    return spark.createDataFrame(rows, CONFIGS)


_PROBLEMS = pa.schema([("config_id", pa.string()), ("nth", pa.int32()), ("problem", pa.string())])


def problems_of(configs: DataFrame) -> DataFrame:
    """(config_id, config as JSON) -> config_id, nth, problem: all that is wrong with each configuration; a text that is
    no JSON has one problem, a null text too. Configurations without a problem have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = validate_config(json.loads(text or ""), None)
                except ValueError:
                    found = ["the configuration is no JSON"]
                rows += [(key, k, p) for k, p in enumerate(found)]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PROBLEMS, strict=True)], schema=_PROBLEMS)

    return configs.select(F.col("config_id").cast("string").alias("config_id"), F.col("config").cast("string").alias("config")).mapInArrow(run, "config_id string, nth int, problem string")


def _indices(test) -> Column:
    """The triggers for which the test holds, in order."""
    return F.array_compact(F.transform("trigs", lambda t, k: F.when(test(t), k.cast("int"))))


def _classified(tok: Column, clean: Column) -> Column:
    def distance(t: Column) -> Column:
        alike = F.filter(t["aliases"], lambda a: ~F.col("same_first") | (F.substring(a, 1, 1) == F.substring(clean, 1, 1)))
        return F.array_min(F.transform(alike, lambda a: F.levenshtein(clean, a)))

    def candidate(t: Column, k: Column) -> Column:
        row = lambda rank, d: F.struct(F.lit(rank).alias("rank"), d.cast("int").alias("distance"), k.cast("int").alias("trig"))
        exact = (t["mode"] == "exact") & F.array_contains(t["aliases"], clean)
        regex = (t["mode"] == "regex") & F.rlike(tok, F.coalesce(t["pattern"], F.lit("")))
        near = F.when(t["mode"] == "fuzzy", distance(t))
        return F.when(exact | regex, row(0, F.lit(0))).when(near <= F.col("max_distance"), row(1, near))

    best = F.array_min(F.array_compact(F.transform("trigs", candidate)))
    return F.when((clean == "") | F.array_contains("stops", clean), F.lit(-1)).otherwise(F.coalesce(best["trig"], F.lit(-1)))


def _annotated(text: Column) -> Column:
    """The tokens as operators.tokens.annotated() has them, with lists of triggers in place of bits."""
    split = F.when(F.col("commas"), tokenize(text, "whitespace_and_punctuation")).otherwise(tokenize(text))
    pairs = F.transform(split, lambda t: F.struct(t.alias("tok"), letters(t).alias("clean")))

    def facts(x: Column, i: Column) -> Column:
        tok, clean = x["tok"], x["clean"]
        return F.struct(
            i.cast("int").alias("i"), tok.alias("tok"), _classified(tok, clean).alias("trig"), F.array_contains("stops", clean).alias("gstop"), _indices(lambda t: F.array_contains(t["stop"], clean)).alias("stop"),
            _indices(lambda t: holds(tok, t["collect"])).alias("coll"), _indices(lambda t: holds(tok, t["multi"])).alias("mult"), _indices(lambda t: holds(tok, t["detect"]) & ~holds(tok, t["barred"])).alias("heur"),
        )

    return F.transform(pairs, facts)


class Looked:
    """What the machine asks of a configuration, looked up in the document's own row."""

    only_notable = False
    stopping = guessing = collecting = True

    def _of(self, field: Column) -> Column:
        return F.get(F.col("trigs"), field)

    def notable(self, t: Column) -> Column:
        return (t["trig"] >= 0) | t["gstop"] | (F.size(t["stop"]) > 0) | (F.size(t["heur"]) > 0)

    def stops(self, t: Column, field: Column) -> Column:
        return t["gstop"] | F.array_contains(t["stop"], field)

    def collects(self, t: Column, field: Column) -> Column:
        return F.array_contains(t["coll"], field)

    def fits(self, t: Column, field: Column) -> Column:
        return F.array_contains(t["mult"], field)

    def most(self, field: Column) -> Column:
        return F.coalesce(self._of(field)["most"], F.lit(0))

    def is_multi(self, field: Column) -> Column:
        return F.coalesce(self._of(field)["multi"].isNotNull(), F.lit(False))

    def is_collecting(self, field: Column) -> Column:
        return F.coalesce(self._of(field)["collect"].isNotNull(), F.lit(False))

    def guess(self, t: Column, base: Column) -> Column:
        able = F.filter(t["heur"], lambda h: F.coalesce(self._of(h)["after"] == base, F.lit(True)))
        return F.coalesce(F.get(able, F.lit(0)), F.lit(-1))


def _stopped(t: Column, o: Column) -> Column:
    first = (o["kind"] == GUESSED) & (t["i"] == o["start"])
    return (o["kind"] != COLLECTING) & ~first & (t["gstop"] | F.array_contains(t["stop"], o["field"]))


def parse_many(docs: DataFrame, configs: DataFrame, lost: bool = False) -> DataFrame:
    """(doc_id, config_id, text) -> config_id, doc_id, rec_idx, cells (map of the configuration's columns that have a
    value), err and, if asked for, lost. `configs` is a table of config_table(), as it is or read from anywhere."""
    places = [r.n for r in configs.select(F.explode("trigs").alias("t")).select(F.explode("t.steps").alias("s")).where("s.op = 'float' and s.n between 0 and 22").select("s.n").distinct().toLocalIterator()]
    cleaned = docs.select("doc_id", "config_id", clean_text(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    given = cleaned.join(configs, "config_id")
    kept = [c for c in configs.columns if c not in ("detection", "record_trig", "commas", "max_distance", "same_first")]
    toks = given.select("doc_id", *configs.columns, _annotated(F.col("text")).alias("toks"))
    begin = F.transform(F.filter("toks", lambda t: t["trig"] == F.col("record_trig")), lambda t: t["i"])
    none = F.array().cast("array<int>")
    start_at = F.when(~F.col("detection"), F.array(F.lit(0))).when(F.size("toks") > 0, F.array_distinct(F.concat(F.array(F.lit(0)), begin))).otherwise(none)
    placed = toks.select("doc_id", *kept, "toks", start_at.alias("start_at"))
    records = placed.select("doc_id", *kept, F.posexplode(slices(F.col("toks"), F.col("start_at"))).alias("rec_idx", "toks"))
    opened = records.select("*", F.explode(F.array(machine(F.col("toks"), Looked()))).alias("opened"))

    base = F.coalesce(F.get(F.col("toks"), F.lit(0))["i"], F.lit(0))
    within = lambda o: F.slice(F.col("toks"), o["start"] - base + 1, o["end"] - o["start"])
    trigger = lambda o: F.get(F.col("trigs"), o["field"])

    def valued(o: Column) -> Column:
        raw = strip(F.array_join(F.transform(F.filter(within(o), lambda t: ~_stopped(t, o)), lambda t: t["tok"]), " "))
        value = normalised(raw, trigger(o)["steps"], places)
        return let(value, lambda v: F.struct(trigger(o)["col"].alias("col"), v.alias("value"), F.when(~follows(v, trigger(o)["rule"]), trigger(o)["rule_code"]).alias("code")))

    values = opened.select("*", F.filter(F.transform("opened", valued), lambda v: v["value"] != "").alias("held"))
    own = lambda c: F.filter("held", lambda v: v["col"] == c)
    cells = F.transform(F.filter("fields", lambda c: F.size(own(c)) > 0), lambda c: F.struct(c.alias("key"), F.array_join(F.transform(own(c), lambda v: v["value"]), " ").alias("value")))
    covered = lambda t: F.exists("opened", lambda o: (t["i"] >= o["start"]) & (t["i"] < o["end"]))
    guessed = F.transform(F.filter("opened", lambda o: o["kind"] >= GUESSED), lambda o: trigger(o)["missing_code"])
    inside = F.transform(F.filter("opened", lambda o: F.exists(within(o), lambda t: _stopped(t, o))), lambda o: trigger(o)["stop_code"])
    outside = F.when(F.exists("toks", lambda t: t["gstop"] & ~covered(t)), F.array(F.lit("errSTOP"))).otherwise(F.array().cast("array<string>"))
    codes = F.array_sort(F.array_distinct(F.array_compact(F.concat(guessed, inside, outside, F.transform("held", lambda v: v["code"])))))
    gone = F.filter("toks", lambda t: (t["trig"] < 0) & ~t["gstop"] & ~covered(t))
    shown = values.select(
        "config_id", "doc_id", "rec_idx", "dup_key", "dup_code", "dup_case", F.map_from_entries(cells).alias("cells"), codes.alias("codes"),
        F.when(F.col("keep_lost"), F.transform(gone, lambda t: t["tok"])).otherwise(F.array().cast("array<string>")).alias("lost"),
    )
    err = F.coalesce(F.when(F.size("codes") > 0, F.array_join("codes", "; ")), F.try_element_at("cells", F.lit("err")))
    rows = _marked(shown.withColumn("err", err))
    return rows.select("config_id", "doc_id", "rec_idx", F.map_filter("cells", lambda k, _: k != "err").alias("cells"), "err", *(["lost"] if lost else []))


def _marked(rows: DataFrame) -> DataFrame:
    """Duplicates within a document, by each configuration's own key; records with a blank key, or of a configuration
    without one, are exempt and dealt by their number."""
    text = strip(F.coalesce(F.try_element_at("cells", F.col("dup_key")), F.lit("")))
    keyed = rows.withColumn("key", F.when(F.col("dup_case"), text).otherwise(F.lower(text))).withColumn("alone", F.when(F.col("key") == "", F.col("rec_idx")))
    earlier = F.row_number().over(Window.partitionBy("config_id", "doc_id", "key", "alone").orderBy("rec_idx")) > 1
    again = keyed.withColumn("again", earlier & (F.col("key") != ""))
    code = F.filter(F.transform(F.split(F.coalesce("err", F.lit("")), ";"), strip), lambda c: c != "")
    marked = F.array_join(F.array_sort(F.array_distinct(F.concat(code, F.array("dup_code")))), "; ")
    return again.withColumn("err", F.when(F.col("again"), marked).otherwise(F.col("err")))
