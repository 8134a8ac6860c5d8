"""The configuration: checked as a whole, then compiled into a specification for the plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from recordlift.functions.predicates import Predicate, predicate
from recordlift.functions.rules import Rule, rule
from recordlift.functions.steps import DEFAULT, Step, normalizer

MODES, SPLITS = ("exact", "fuzzy", "regex"), ("whitespace", "whitespace_and_punctuation")
# fixed value: the key of a configuration's name
NAME_KEY = "parser_name"
#: a field is a bit of a long in the state machine
MOST_TRIGGERS = 62


@dataclass(frozen=True)
class Trigger:
    name: str
    mode: str
    aliases: tuple[str, ...]
    column: str
    normalize: Step
    stop: frozenset[str] = frozenset()
    stop_code: str = "errSTOP"
    valid: Rule | None = None
    valid_code: str = "errVAL"
    #: heuristic: recognises the field's first token where its keyword is missing
    detect: Predicate | None = None
    unless: Predicate | None = None
    after: str | None = None
    missing_code: str | None = None
    #: collector: what follows a token that the heuristic recognised
    collect: Predicate | None = None
    collect_most: int = 0
    #: multi-token: what follows while the field is open
    multi: Predicate | None = None


@dataclass(frozen=True)
class Spec:
    name: str
    columns: tuple[str, ...]
    triggers: tuple[Trigger, ...]
    max_distance: int = 1
    require_first_char: bool = True
    stop: frozenset[str] = frozenset()
    keep_lost: bool = False
    split_by: str = "whitespace"
    record_trigger: str | None = None
    dedup_key: str | None = None
    dedup_code: str = "errDUP"
    dedup_case: bool = False
    tests: tuple[dict[str, Any], ...] = ()
    version: str = "1.0"
    raw: dict[str, Any] = field(default_factory=dict, compare=False)

    @property
    def output(self) -> tuple[str, ...]:
        """Columns of a record: the declared ones, each once, and err."""
        return tuple(dict.fromkeys((*self.columns, "err")))


def _trigger_problems(name: str, t: Any, columns: list) -> list[str]:
    if not isinstance(t, dict):
        return [f"trigger {name!r} must be an object"]
    found = []
    if not isinstance(t.get("aliases"), list) or not t["aliases"]:
        found.append(f"trigger {name!r}: aliases must be a list that is not empty")
    if t.get("search_mode") not in MODES:
        found.append(f"trigger {name!r}: search_mode must be one of {', '.join(MODES)}")
    if "csv_column" in t and t["csv_column"] not in columns:
        found.append(f"trigger {name!r}: csv_column {t['csv_column']!r} is not in csv_columns")
    if not isinstance(t.get("stop_words", []), list):
        found.append(f"trigger {name!r}: stop_words must be a list")
    guess = t.get("heuristics")
    if isinstance(guess, dict) and not isinstance(guess.get("priority") or 0, int):
        found.append(f"trigger {name!r}: heuristics.priority must be a whole number")
    if isinstance(t.get("replacements"), dict) and "" in t["replacements"]:
        found.append(f"trigger {name!r}: replacements has an empty key")
    return found


def validate_config(raw: Any, most_triggers: int | None = MOST_TRIGGERS) -> list[str]:
    """All that is wrong with the configuration; empty if it can be compiled. Never raises."""
    if not isinstance(raw, dict):
        return ["the configuration must be an object"]
    found = [f"missing key: {k!r}" for k in (NAME_KEY, "csv_columns", "triggers") if k not in raw]
    columns = raw.get("csv_columns", [])
    if not isinstance(raw.get(NAME_KEY, ""), str):
        found.append(f"{NAME_KEY} must be a string")
    if not isinstance(columns, list) or not all(isinstance(c, str) for c in columns):
        found.append("csv_columns must be a list of strings")
        columns = []
    if "triggers" in raw:
        triggers = raw["triggers"]
        if not isinstance(triggers, dict) or not triggers:
            found.append("triggers must be an object that is not empty")
        else:
            if most_triggers is not None and len(triggers) > most_triggers:
                found.append(f"triggers: more than {most_triggers}")
            for name, t in triggers.items():
                found += _trigger_problems(name, t, columns)
    if "tokenizer" in raw:
        t = raw["tokenizer"]
        if not isinstance(t, dict):
            found.append("tokenizer must be an object")
        elif t.get("split_by") not in (None, *SPLITS):
            found.append(f"tokenizer.split_by must be one of {', '.join(SPLITS)}")
    if "dedup" in raw:
        d = raw["dedup"]
        if not isinstance(d, dict):
            found.append("dedup must be an object")
        elif "key" not in d:
            found.append("dedup: key is missing")
        elif d["key"] not in columns:
            found.append(f"dedup.key {d['key']!r} is not in csv_columns")
    if "tests" in raw:
        if not isinstance(raw["tests"], list):
            found.append("tests must be a list")
        else:
            for i, case in enumerate(raw["tests"]):
                if not isinstance(case, dict):
                    found.append(f"tests[{i}] must be an object")
                else:
                    found += [f"tests[{i}]: {k} is missing" for k in ("input", "expect") if k not in case]
    for key, kind, said in (("max_distance", int, "a whole number"), ("require_first_char", bool, "true or false"), ("stop_words", list, "a list")):
        if key in raw and not isinstance(raw[key], kind):
            found.append(f"{key} must be {said}")
    if "record_detection" in raw:
        r = raw["record_detection"]
        if not isinstance(r, dict):
            found.append("record_detection must be an object")
        else:
            if "trigger" not in r:
                found.append("record_detection: trigger is missing")
            if r.get("mode", "trigger") != "trigger":
                found.append("record_detection.mode can only be 'trigger'")
    return found


def _optional(rule_of: dict, key: str) -> Predicate | None:
    return predicate(rule_of[key]) if key in rule_of else None


def _compiled(name: str, t: dict) -> Trigger:
    check, guess, collector, multi = (t.get(k) or {} for k in ("validation", "heuristics", "collector", "multi_token"))
    more = {}
    if check:
        more |= {"valid": rule(check.get("rule", "")), "valid_code": check.get("error_code", "errVAL")}
    if "detect_by" in guess:
        more |= {"detect": predicate(guess["detect_by"]), "unless": _optional(guess, "unless"), "after": guess.get("if_missing_after") or None}
        more["missing_code"] = guess.get("error_code", f"err{name.upper()}") or None
    if collector:
        more |= {"collect": _optional(collector, "token_rule") or predicate("any"), "collect_most": collector.get("max_tokens", 10)}
    if isinstance(multi, dict) and multi.get("enabled"):
        more["multi"] = _optional(multi, "token_rule") or predicate("any")
    pipeline = (t.get("normalization") or {}).get("pipeline", list(DEFAULT))
    return Trigger(
        name, t.get("search_mode", "fuzzy"), tuple(t.get("aliases", [])), t.get("csv_column", name), normalizer(pipeline, list((t.get("replacements") or {}).items()), joined=True),
        frozenset(w.lower() for w in t.get("stop_words") or []), t.get("stop_word_error", "errSTOP"), **more,
    )


def in_order(triggers: dict[str, dict]) -> list[tuple[str, dict]]:
    """Triggers by their heuristics' priority (100 without one), equal ones as they were written."""

    def rank(item: tuple[str, dict]) -> int:
        priority = (item[1].get("heuristics") or {}).get("priority", 100)
        return 100 if priority is None else priority

    return sorted(triggers.items(), key=rank)


def compile_config(raw: dict[str, Any]) -> Spec:
    """The specification of a valid configuration; ValueError with all problems otherwise, or for an unknown predicate.

    Triggers stand in the order of their heuristics' priority (100 without one), equal ones as they were written.
    """
    if problems := validate_config(raw):
        raise ValueError("\n".join(problems))
    dedup, detection = raw.get("dedup") or {}, raw.get("record_detection") or {}
    if "detect_by" in (detection.get("continuation_heuristics") or {}):
        predicate(detection["continuation_heuristics"]["detect_by"])  # accepted and checked; it never changes a result
    return Spec(
        name=raw[NAME_KEY], columns=tuple(raw["csv_columns"]), triggers=tuple(_compiled(n, t) for n, t in in_order(raw["triggers"])),
        max_distance=raw.get("max_distance", 1), require_first_char=raw.get("require_first_char", True), stop=frozenset(w.lower() for w in raw.get("stop_words", [])),
        keep_lost=bool(raw.get("log_suspicious", False)), split_by=(raw.get("tokenizer") or {}).get("split_by") or "whitespace", record_trigger=detection.get("trigger"),
        dedup_key=dedup.get("key"), dedup_code=dedup.get("error_code", "errDUP"), dedup_case=dedup.get("case_sensitive", False), tests=tuple(raw.get("tests", [])), version=raw.get("version", "1.0"), raw=raw,
    )


def load_config(path: str) -> Spec:
    return compile_config(json.loads(Path(path).read_text(encoding="utf-8")))
