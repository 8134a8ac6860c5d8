import random

import pytest
from pyspark.sql import functions as F

from recordlift.plans.config import NAME_KEY, compile_config
from recordlift.plans.parse import parse, raw_records
from tests.plain import Plain
from tests.registry import CONFIG, ROWS, TEXT


def parsed(spark, texts, raw, lost=False):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return parse(docs, compile_config(raw), lost).orderBy("doc_id", "rec_idx")


def test_sample_registry(spark):
    got = [tuple(r)[2:] for r in parsed(spark, [TEXT], CONFIG).collect()]
    assert got == ROWS


def base(**more):
    return {NAME_KEY: "p", "csv_columns": ["a", "b", "c"], "triggers": {"a": {"aliases": ["alpha"], "search_mode": "fuzzy"}, "b": {"aliases": ["beta"], "search_mode": "fuzzy"}, "c": {"aliases": ["gamma"], "search_mode": "fuzzy"}}} | more


def one(spark, text, raw):
    return [{k: v for k, v in r.asDict().items() if v is not None and k not in ("doc_id", "rec_idx")} for r in parsed(spark, [text], raw).collect()]


def trigger(raw, name, **more):
    raw["triggers"][name] |= more
    return raw


@pytest.mark.parametrize(
    "text, raw, want",
    [
        ("", base(), [{}]),
        (None, base(), [{}]),
        ("", base(record_detection={"trigger": "a"}), []),
        ("x alpha 1 alpha 2", base(record_detection={"trigger": "a"}), [{}, {"a": "1"}, {"a": "2"}]),
        ("x y", base(record_detection={"trigger": "nowhere"}), [{}]),
        ("alpha 1 alpha 2", base(), [{"a": "1 2"}]),
        ("alpha beta 1", base(), [{"b": "1"}]),
        # a collector works only where a heuristic opened the field, and never drops stop words
        ("alpha 1 2", trigger(base(), "a", collector={"max_tokens": 1}), [{"a": "1 2"}]),
        ("beta 1 X stop y", trigger(base(stop_words=["stop"]), "a", heuristics={"if_missing_after": "b", "detect_by": "starts_upper", "error_code": "eA"}, collector={"max_tokens": 2}), [{"b": "1", "a": "X stop", "err": "eA"}]),
        ("beta 1 X y z", trigger(base(), "a", heuristics={"if_missing_after": "b", "detect_by": "starts_upper"}, collector={"max_tokens": 1}), [{"b": "1", "a": "X", "err": "errA"}]),
        # stop words: dropped, with the open field's code
        ("alpha 1 stop 2", base(stop_words=["STOP"]), [{"a": "1 2", "err": "errSTOP"}]),
        ("alpha 1 stop 2", trigger(base(stop_words=["stop"]), "a", stop_word_error="eS"), [{"a": "1 2", "err": "eS"}]),
        ("stop alpha 1", base(stop_words=["stop"]), [{"a": "1", "err": "errSTOP"}]),
        ("alpha 1 no beta no", trigger(base(), "a", stop_words=["no"]), [{"a": "1", "b": "no", "err": "errSTOP"}]),
        ("alpha 1 beta 2", trigger(base(), "a", stop_words=["beta"]), [{"a": "1 2", "err": "errSTOP"}]),
        # multi-token fields close at a token that does not fit, which then belongs to no field
        ("alpha 1 2 x 3", trigger(base(), "a", multi_token={"enabled": True, "token_rule": "regex:^[0-9]+$"}), [{"a": "1 2"}]),
        ("alpha 1 x y", trigger(trigger(base(), "a", multi_token={"enabled": True, "token_rule": "regex:^[0-9]+$"}), "b", heuristics={"if_missing_after": "a", "detect_by": "has_letter"}), [{"a": "1", "b": "x y", "err": "errB"}]),
        # exact before fuzzy; the earlier trigger among equals; without letters no trigger is tried
        ("alpha 1 beta 2", trigger(base(), "c", aliases=["beta"], search_mode="exact"), [{"a": "1", "c": "2"}]),
        ("betb 2", trigger(base(), "c", aliases=["betc"]), [{"b": "2"}]),
        ("betb 2", trigger(base(), "c", aliases=["betc"], heuristics={"priority": 1}), [{"c": "2"}]),
        ("12 x1 3", trigger(base(), "c", aliases=["x?[0-9]+"], search_mode="regex"), [{"c": "3"}]),
        ("x-y 1", trigger(base(), "c", aliases=["x-y"], search_mode="exact"), [{}]),
        ("elpha 1", base(), [{}]),
        ("elpha 1", base(require_first_char=False), [{"a": "1"}]),
        ("alxxa 1", base(max_distance=2), [{"a": "1"}]),
        ("alpha 1", trigger(base(), "a", validation={"rule": "regex:[a-z]+"}), [{"a": "1", "err": "errVAL"}]),
        ("alpha 1", trigger(base(), "a", validation={"rule": "regex:[0-9]"}), [{"a": "1"}]),
        ("alpha beta 1", trigger(base(), "a", validation={"rule": "not_empty"}), [{"b": "1"}]),
        # two triggers for one column, and a column that is not declared
        ("alpha 1 beta 2", trigger(base(), "b", csv_column="a"), [{"a": "1 2"}]),
        ("alpha 1, 2", base(record_detection={"trigger": "b"}, tokenizer={"split_by": "whitespace_and_punctuation"}), [{"a": "1 , 2"}]),
        ("alpha 1, 2", base(tokenizer={"split_by": "whitespace_and_punctuation"}), [{"a": "1, 2"}]),
        ("a [x [y] z] alpha [1 2", base(), [{"a": "[1 2"}]),
    ],
)
def test_branches(spark, text, raw, want):
    assert one(spark, text, raw) == want


def test_against_plain_version(spark):
    raws = [
        base(stop_words=["stop"], log_suspicious=True, record_detection={"trigger": "a"}),
        trigger(trigger(base(stop_words=["stop"], log_suspicious=True), "a", multi_token={"enabled": True, "token_rule": "regex:[0-9]"}, stop_words=["nope", "beta"], stop_word_error="eA"), "b", heuristics={"if_missing_after": "a", "detect_by": "starts_upper", "priority": 5}, collector={"token_rule": "starts_upper | regex:^st", "max_tokens": 3}),
        trigger(trigger(base(log_suspicious=True, stop_words=["stop"]), "c", heuristics={"detect_by": "has_letter", "unless": "starts_upper", "error_code": "eC", "priority": 1}, csv_column="a"), "a", heuristics={"if_missing_after": "c", "detect_by": "any", "priority": 2}, collector={"max_tokens": 2}, validation={"rule": "word_count:2,3"}),
        trigger(trigger(base(log_suspicious=True), "b", search_mode="exact"), "c", aliases=["x[0-9]+"], search_mode="regex", multi_token={"enabled": True}),
    ]
    rng = random.Random(5)
    vocabulary = ["alpha", "alpa", "beta", "bet", "Beta.", "gamma", "stop", "Stop", "nope", "Xy", "Zed.", "q", "1", "2.5", "x7", "st9", "Up9"]
    for raw in raws:
        texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 25))) for _ in range(150)]
        got: dict[int, list] = {}
        for r in parsed(spark, texts, raw, lost=True).collect():
            got.setdefault(r.doc_id, []).append(({c: r[c] for c in ("a", "b", "c", "err") if r[c] is not None}, r.lost))
        for i, text in enumerate(texts):
            assert got.get(i, []) == Plain(raw).records(text), (raw, text)


def test_long_record_without_detection(spark):
    text = "alpha " + " ".join(["w"] * 20_000) + " beta 1"
    row = parsed(spark, [text], base()).first()
    assert row.b == "1" and len(row.a) == 2 * 20_000 - 1


def test_plan_runs_the_machine_once_and_without_shuffle(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    rows = raw_records(docs, compile_config(CONFIG)).where(F.col("err").isNull())
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # one aggregate() for cleaning, one for the machine
    assert plan.count("aggregate(") == 2
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_plain_values_pass_no_regular_expression(spark):
    """What costs most for each token and value is only in the plan where the configuration asks for it."""
    from pyspark.sql import functions as F

    from recordlift.operators.assign import openings
    from recordlift.operators.records import values_of
    from recordlift.queries import spec

    toks, fields = (F.expr(f"cast(null as array<struct<{kind}>>)") for kind in ("i:int,tok:string,trig:int,gstop:boolean,stop:bigint,coll:bigint,mult:bigint,heur:bigint", "field:int,start:int,end:int,kind:int"))
    plan = lambda c: spark.range(0).select(toks.alias("toks"), fields.alias("fields")).select(c)._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace" not in plan(values_of("prio", spec()))
    assert "shiftright" not in plan(openings(F.col("toks"), spec()))


def test_notes_are_of_keywords_alone_where_nothing_else_is_asked(spark):
    """A token that changes no state has no note, and a record is cut from its document without its neighbours."""
    from recordlift.operators.segment import cut
    from recordlift.plans.parse import notes_of
    from recordlift.queries import spec

    docs = spark.createDataFrame([(1, "x cell 1. prio a b price 2 stat F cell 3. stat O P"), (2, "")], "doc_id long, text string")
    rows = notes_of(docs, spec())
    assert rows.schema["notes"].dataType.elementType.names == ["i", "trig"]
    got = cut(rows, spec()).orderBy("doc_id", "rec_idx").collect()
    assert [(r.doc_id, r.rec_idx, r.base, r.words, [n.i for n in r.notes]) for r in got] == [(1, 0, 0, ["x"], []), (1, 1, 1, "cell 1. prio a b price 2 stat F".split(), [1, 3, 6, 8]), (1, 2, 10, "cell 3. stat O P".split(), [10, 12])]


def test_values_of_fields_opened_once_and_twice(spark):
    """Stop words and repeated fields, alone and together, in records beside plain ones."""
    from recordlift.queries import spec

    made = spec(stop_words=["junk"], stat={"stop_words": ["void"], "stop_word_error": "errST"}, log_suspicious=True)
    texts = ["cell 1 stat A", "cell 2 stat A void B", "cell 3 stat A stat B void", "cell 4 junk stat", "cell 5 prio void stat C junk D", "cell 6 stat void", "junk y cell"]
    rows = parse(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), made, lost=True).orderBy("doc_id", "rec_idx").collect()
    assert [(r.cell, r.prio, r.stat, r.err, r.lost) for r in rows] == [
        ("1", None, "A", None, []), ("2", None, "A B", "errST", []), ("3", None, "A B", "errST", []), ("4", None, None, "errSTOP", []), ("5", "void", "C D", "errST", []), ("6", None, None, "errST", []),
        (None, None, None, "errSTOP", ["y"]), (None, None, None, None, []),
    ]
