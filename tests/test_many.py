"""Many configurations in one plan, against parse() for each, and against the plain version beyond its limit of triggers."""

import random

import pytest

from recordlift.plans.config import NAME_KEY, compile_config
from recordlift.plans.many import config_table, parse_many
from recordlift.plans.parse import parse
from tests.registry import CONFIG, TEXT
from tests.test_extraction import base, trigger

WORDS = ["alpha", "alpa", "beta", "bet", "Beta.", "gamma", "stop", "Stop", "nope", "Xy", "Zed.", "q", "1", "2.5", "x7", "st9", "Up9", "a,b", "12,", "Город.", "1:2", "[x]"]
STEPS = [
    ["strip"], ["remove_trailing_dot", "uppercase"], ["remove_dots", "digits_only", "pad_left:4"], ["remove_spaces", "lowercase", "pad_right:6:x"], ["replace_char:.->/"], ["replace_char:internal:.->$1"], ["apply_replacements"],
    ["replace_dot_before_keywords:q,xy"], ["replace_dot_after_keywords:zed,beta"], ["replace_space_before_keywords:q,xy,zed"], ["regex_sub:([0-9])\\.([0-9]) -> \\2-\\1"], ["normalize_number"], ["normalize_number:;:."], ["to_int"], ["to_float:1"], ["to_float:0"], ["nothing"], [],
]


def configurations():
    made = {
        "plain": base(), "records": base(stop_words=["stop"], log_suspicious=True, record_detection={"trigger": "a"}, tokenizer={"split_by": "whitespace_and_punctuation"}), "nowhere": base(record_detection={"trigger": "zzz"}),
        "multi": trigger(trigger(base(stop_words=["stop"], log_suspicious=True), "a", multi_token={"enabled": True, "token_rule": "regex:[0-9]"}, stop_words=["nope", "beta"], stop_word_error="eA"), "b", heuristics={"if_missing_after": "a", "detect_by": "starts_upper", "priority": 5}, collector={"token_rule": "starts_upper | regex:^st", "max_tokens": 3}),
        "guess": trigger(trigger(base(log_suspicious=True, stop_words=["stop"]), "c", heuristics={"detect_by": "has_letter", "unless": "starts_upper", "error_code": "eC", "priority": 1}, csv_column="a"), "a", heuristics={"if_missing_after": "c", "detect_by": "any", "priority": 2}, collector={"max_tokens": 2}, validation={"rule": "word_count:2,3"}),
        "regex": trigger(trigger(base(log_suspicious=True, require_first_char=False, max_distance=2), "b", search_mode="exact"), "c", aliases=["x[0-9]+"], search_mode="regex", multi_token={"enabled": True}),
        "numbers": trigger(trigger(base(), "a", heuristics={"detect_by": "is_part_of_number_colon_dot", "error_code": ""}, validation={"rule": "regex:[0-9.]+", "error_code": "eN"}), "b", heuristics={"detect_by": "looks_like_number_colon_dot", "if_missing_after": "nobody"}),
        "twice": base(record_detection={"trigger": "a"}, dedup={"key": "a", "error_code": "again", "case_sensitive": True}), "harbour": CONFIG | {"dedup": {"key": "fracht"}},
        "errors": {NAME_KEY: "e", "csv_columns": ["err", "a.b", "a.b"], "triggers": {"err": {"aliases": ["alpha"], "search_mode": "fuzzy"}, "a.b": {"aliases": ["beta"], "search_mode": "fuzzy", "validation": {"rule": "none such"}}}},
    }
    for k, pipeline in enumerate(STEPS):
        made[f"steps{k}"] = trigger(base(), "a", normalization={"pipeline": pipeline}, replacements={"1": "one", "one q": "Q"})
    return made


def test_results_are_those_of_each_configuration(spark):
    configs = configurations()
    rng = random.Random(8)
    data = [(k, key, " ".join(rng.choices(WORDS, k=rng.randrange(0, 30)))) for k, key in enumerate(list(configs) * 6)]
    data += [(-1, "harbour", TEXT), (-2, "plain", None), (-3, "records", ""), (-4, "unknown", "alpha 1"), (-5, None, "alpha 1"), (None, "plain", "alpha 1"), (-6, "plain", "alpha " + "w " * 3000 + "beta 1")]
    docs = spark.createDataFrame(data, "doc_id long, config_id string, text string")
    got: dict[str, list] = {}
    for r in parse_many(docs, config_table(spark, configs), lost=True).collect():
        got.setdefault(r.config_id, []).append((r.doc_id, r.rec_idx, r.cells, r.err, r.lost))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert set(got) <= set(configs)
    for name, raw in configs.items():
        rows = parse(docs.where(docs.config_id == name), compile_config(raw), lost=True).collect()
        wanted = [(r[0], r[1], {c: v for c, v in zip(r.__fields__[2:], r[2:], strict=True) if v is not None and c not in ("err", "lost")}, r.err, r.lost) for r in rows]
        assert sorted(got.get(name, []), key=key) == sorted(wanted, key=key), name


def test_hundreds_of_configurations_and_of_triggers(spark):
    word = lambda k: "k" + str(k).translate(str.maketrans("0123456789", "abcdefghij"))
    configs = {f"c{c}": {NAME_KEY: "x", "csv_columns": ["v"], "triggers": {"v": {"aliases": [word(c)], "search_mode": "exact", "normalization": {"pipeline": [f"pad_left:{c % 7}"]}}}} for c in range(300)}
    configs["wide"] = {NAME_KEY: "w", "csv_columns": [f"t{k}" for k in range(100)], "triggers": {f"t{k}": {"aliases": [word(k)], "search_mode": "exact"} for k in range(100)}}
    docs = spark.createDataFrame([(c, f"c{c}", f"x {word(c)} {c}") for c in range(300)] + [(300, "wide", " ".join(f"{word(k)} {k}" for k in range(100)))], "doc_id long, config_id string, text string")
    rows = parse_many(docs, config_table(spark, configs))
    got = {r.doc_id: r.cells for r in rows.collect()}
    assert all(got[c] == {"v": str(c).rjust(c % 7, "0")} for c in range(300)) and got[300] == {f"t{k}": str(k) for k in range(100)}
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 400_000  # as large for one configuration


def test_problems_of_all_configurations(spark):
    with pytest.raises(ValueError) as problems:
        config_table(spark, {"good": base(), "bad": {}, "worse": base(max_distance="1")})
    assert len(str(problems.value).splitlines()) == 4 and "worse: max_distance" in str(problems.value)
    assert parse_many(spark.createDataFrame([], "doc_id long, config_id string, text string"), config_table(spark, {"a": base()})).count() == 0
    assert parse_many(spark.createDataFrame([(1, "a", "alpha 1")], "doc_id long, config_id string, text string"), config_table(spark, {})).count() == 0
