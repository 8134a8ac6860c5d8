import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from recordlift.operators import profile
from recordlift.operators.duplicates import count_duplicates, mark_duplicates
from recordlift.operators.selftest import run_tests, test_totals
from recordlift.operators.trace import trace
from recordlift.plans.config import NAME_KEY, compile_config, load_config, validate_config
from recordlift.plans.parse import first_records, parse
from recordlift.sources.exports import write_csv, write_json, write_json_array, write_one_csv, write_one_json, write_parquet, write_xlsx
from recordlift.sources.files import read_files
from recordlift.streaming.records import stream_files, stream_records, write_records
from tests.registry import CONFIG, TEXT
from tests.test_extraction import base

test_totals.__test__ = False
DATA = "/root/testdata/sf0.001"


def test_config_problems():
    assert validate_config(CONFIG) == []
    assert len(validate_config([])) == 1
    assert len(validate_config({})) == 3
    bad = {
        NAME_KEY: 1, "csv_columns": 5, "triggers": {"a": 1, "b": {"aliases": [], "search_mode": "x", "csv_column": "z", "stop_words": 1, "heuristics": {"priority": "1"}}}, "tokenizer": {"split_by": "x"}, "dedup": {"key": "q"},
        "tests": [1, {}], "max_distance": "1", "require_first_char": 1, "stop_words": 1, "record_detection": {"mode": "x"},
    }
    assert len(validate_config(bad)) == 18
    with pytest.raises(ValueError):
        compile_config(bad)
    with pytest.raises(ValueError):
        compile_config(base(record_detection={"trigger": "a", "continuation_heuristics": {"detect_by": "nope"}}))


def test_config_file(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(CONFIG, ensure_ascii=False), encoding="utf-8")
    spec = load_config(str(path))
    assert [t.name for t in spec.triggers] == ["vermerk", "fracht", "tonnen", "siegel", "platz"]


def parsed(spark, texts, raw, **more):
    return parse(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), compile_config(raw), **more)


def test_statistics_of_the_sample(spark):
    spec = compile_config(CONFIG)
    rows = parsed(spark, [TEXT], CONFIG, lost=True).cache()
    assert tuple(profile.summary(rows).first()) == (5, 1, 4, 80.0, 0)
    assert [tuple(r) for r in profile.top_errors(rows).collect()] == [("geschwärzt", 3), ("keineZahl", 1), ("nurBuchstaben", 1)]
    assert {r.field: (r.filled, r.percent) for r in profile.field_fill(rows, spec).collect()}["siegel"] == (2, 40)
    assert [tuple(r) for r in profile.lost_tokens(rows).collect()] == [("Hafenbuch", 1)]
    empty = parsed(spark, [], CONFIG)
    assert tuple(profile.summary(empty).first()) == (0, 0, 0, 0.0, 0)
    assert {r.unique for r in profile.value_distribution(empty, spec).collect()} == {0}


def test_duplicates_stay_within_a_document(spark):
    raw = base(record_detection={"trigger": "a"}, dedup={"key": "a", "error_code": "twice"}, stop_words=["z"])
    rows = parsed(spark, ["alpha X alpha x z alpha alpha", "alpha x"], raw).orderBy("doc_id", "rec_idx")
    assert [r.err for r in rows.collect()] == [None, "errSTOP; twice", None, None, None]
    assert count_duplicates(rows, compile_config(raw)).first().duplicates == 1
    assert profile.summary(rows).first().duplicates == 0


def test_duplicates_keep_columns_of_any_name(spark):
    names = ["_key", "_alone", "_again", "key", "again", "record", "a.b"]
    triggers = {n: {"aliases": [a], "search_mode": "exact"} for n, a in zip(names, ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"], strict=True)}
    raw = {NAME_KEY: "p", "csv_columns": names, "triggers": triggers, "record_detection": {"trigger": "_key"}, "dedup": {"key": "key"}}
    rows = parsed(spark, ["alpha 1 beta 2 gamma 3 delta X eps 4 zeta 5 eta 6 alpha 7 delta x alpha 8 alpha 9"], raw).orderBy("rec_idx")
    assert [tuple(r)[2:] for r in rows.collect()] == [("1", "2", "3", "X", "4", "5", "6", None), ("7", None, None, "x", None, None, None, "errDUP"), ("8", *[None] * 7), ("9", *[None] * 7)]


def test_files_keep_the_order_of_the_list(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "2.txt").write_text(name)
        (tmp_path / name / "1.txt").write_text(name + "1")
    rows = read_files(spark, [str(tmp_path / "b"), str(tmp_path / "a")]).orderBy("doc_seq", "doc_id")
    assert [(r.doc_seq, r.text) for r in rows.collect()] == [(0, "b1"), (0, "b"), (1, "a1"), (1, "a")]


def test_unused_columns_are_not_computed(spark):
    """The window of duplicates keeps plain columns: statistics of errors need neither prices nor names."""
    columns = "doc_id long, rec_idx int, key string, unused string, err string"
    rows = spark.createDataFrame([(1, 0, "x", "y", None), (1, 1, "x", "y", None)], columns)
    raw = {NAME_KEY: "p", "csv_columns": ["key", "unused"], "triggers": base()["triggers"], "dedup": {"key": "key"}}
    marked = mark_duplicates(rows, compile_config(raw))
    plan = profile.summary(marked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unused") == 1 and "Window" in plan  # where the rows come from
    assert [r.err for r in marked.orderBy("rec_idx").collect()] == [None, "errDUP"]


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_order_of_documents_through_the_plan(spark, ranges):
    docs = spark.createDataFrame([(d % 3, f"d{d}", "x alpha %d alpha %d" % (d, d + 1)) for d in range(9)] + [(0, None, "alpha 9"), (1, "none", "")], "doc_seq int, doc_id string, text string")
    spec = compile_config(base(record_detection={"trigger": "a"}, log_suspicious=True, dedup={"key": "a"}))
    rows = parse(docs, spec, lost=True)
    assert rows.columns[:3] == ["doc_seq", "doc_id", "rec_idx"]
    order = lambda r: (r.doc_seq, r.doc_id is not None, r.doc_id or "", r.rec_idx)
    got = profile.numbered(rows, ranges).collect()
    assert [order(r) for r in sorted(got, key=lambda r: r.record_no)] == sorted(map(order, got)) and sorted(r.record_no for r in got) == list(range(28))
    assert [order(r) for r in profile.preview(rows, 5).collect()] == sorted(map(order, got))[:5]
    assert [order(r) for r in first_records(docs, spec, 5).collect()] == sorted(map(order, got))[:5]
    assert profile.lost_tokens(rows).first().token == "x"
    first = {r.value: r.seen.doc_seq for r in profile.value_counts(rows, spec).collect()}
    assert first["3"] == 0 and first["9"] == 0 and first["2"] == 1


@pytest.mark.parametrize("most", [1, 3, 7, 50])
def test_first_records_are_those_of_the_whole(spark, most):
    docs = spark.createDataFrame([(i, "alpha 1 alpha 2" if i % 3 == 0 else "") for i in range(12)], "doc_id long, text string")
    spec = compile_config(base(record_detection={"trigger": "a"}))
    assert first_records(docs, spec, most).collect() == profile.preview(parse(docs, spec), most).collect()


def test_trace(spark):
    raw = base(stop_words=["z"], triggers=base()["triggers"] | {"b": {"aliases": ["beta"], "search_mode": "fuzzy", "heuristics": {"if_missing_after": "a", "detect_by": "starts_upper"}, "collector": {"max_tokens": 2}}})
    docs = spark.createDataFrame([(1, "q z alpha 1 z Up two three gamma x")], "doc_id long, text string")
    got = trace(docs, compile_config(raw)).orderBy("tok_idx").collect()
    assert [(r.event, r.field) for r in got] == [("LOST", None), ("STOP", None), ("TRIGGER", "a"), ("ADD", "a"), ("STOP", "a"), ("HEUR", "b"), ("COLLECT", "b"), ("LOST", None), ("TRIGGER", "c"), ("ADD", "c")]
    assert {r.dropped for r in trace(docs, compile_config(raw), 4).collect()} == {6}


def test_self_tests(spark):
    cases = [
        {"description": "cargo", "input": "Platz 1. Fracht Eisen Erz. Tonnen 12,44", "expect": {"platz": "001", "fracht": "Erz", "tonnen": "12.4"}},
        {"input": "Platz 8 Platz 9 Z777 QRST Vermerk ok", "expect_record": -1, "expect": {"siegel": "QRST", "err": "nurBuchstaben"}},
        {"input": "Platz 3 Ladung Blau & Co", "expect": {"fracht": "Blau"}},
        {"input": "", "expect": {}},
    ]
    results = run_tests(spark, compile_config(CONFIG | {"tests": cases})).orderBy("nth").collect()
    assert [r.status for r in results] == ["pass", "pass", "fail", "fail"]
    assert [tuple(d) for d in results[2].details] == [("fracht", "Blau", "Blau & Co", False)]
    assert results[3].details[0].field == "(records)"
    assert tuple(test_totals(run_tests(spark, compile_config(CONFIG | {"tests": cases}))).first()) == (4, 2, 2)
    assert run_tests(spark, compile_config(CONFIG)).count() == 0


def test_files(spark, tmp_path):
    for name, data in {"a.txt": "Тест 1".encode("utf-8-sig"), "b.txt": "Тест 2".encode("cp1251"), "c.txt": b"\x98\xe9", "d.txt": b"", "e.txt": b"x" * 100}.items():
        (tmp_path / name).write_bytes(data)
    rows = {Path(r.doc_id).name: (r.text, r.encoding, r.odd_encoding) for r in read_files(spark, str(tmp_path), max_bytes=50).collect()}
    assert rows == {"a.txt": ("Тест 1", "utf-8-sig", False), "b.txt": ("Тест 2", "cp1251", True), "c.txt": ("\x98é", "latin-1", True)}


def test_large_files_are_read(spark, tmp_path):
    (tmp_path / "large.txt").write_bytes(b"x" * ((32 << 20) + 1))
    assert [Path(r.doc_id).name for r in read_files(spark, str(tmp_path)).select("doc_id").collect()] == ["large.txt"]


def test_exports(spark, tmp_path):
    spec = compile_config(base())
    rows = parsed(spark, ['alpha =1"x, beta y', "gamma z"], base()).coalesce(1).sortWithinPartitions("doc_id")
    write_csv(rows, str(tmp_path / "csv"), spec)
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_bytes().decode("utf-8") == '﻿a,b,c,err\r\n"\'=1""x,",y,,\r\n,,z,\r\n'
    write_json(rows, str(tmp_path / "json"), spec)
    (part,) = (tmp_path / "json").glob("part-*")
    assert [json.loads(x) for x in part.read_text().splitlines()] == [{"a": '=1"x,', "b": "y", "c": "", "err": ""}, {"a": "", "b": "", "c": "z", "err": ""}]
    write_json_array(rows, str(tmp_path / "array"), spec)
    (part,) = (tmp_path / "array").glob("part-*")
    assert part.read_text() == json.dumps([{"a": '=1"x,', "b": "y", "c": "", "err": ""}, {"a": "", "b": "", "c": "z", "err": ""}], indent=2) + "\n"
    write_json_array(rows.limit(0), str(tmp_path / "none"), spec)
    assert spark.read.schema("a string").option("multiLine", True).json(str(tmp_path / "none")).count() == 0
    write_parquet(rows, str(tmp_path / "parquet"), spec)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    assert write_xlsx(rows, str(tmp_path / "x.xlsx"), spec) in (True, False)


def test_one_file(spark, tmp_path):
    spec = compile_config(base(record_detection={"trigger": "a"}))
    texts = [f'alpha {k} beta "q,{k}" gamma =Ж' for k in range(40)]
    rows = parsed(spark, texts, base(record_detection={"trigger": "a"})).repartition(7)
    write_one_csv(rows, str(tmp_path / "x.csv"), spec)
    data = (tmp_path / "x.csv").read_bytes().decode("utf-8")
    assert data == "\ufeffa,b,c,err\r\n" + "".join(f'{k},"""q,{k}""",\'=Ж,\r\n' for k in range(40))
    write_one_json(rows, str(tmp_path / "x.json"), spec)
    text = (tmp_path / "x.json").read_text()
    assert text == json.dumps([{"a": str(k), "b": f'"q,{k}"', "c": "=Ж", "err": ""} for k in range(40)], indent=2, ensure_ascii=False)
    write_one_json(rows.limit(0), str(tmp_path / "none.json"), spec)
    assert (tmp_path / "none.json").read_text() == "[]"
    write_one_csv(rows.limit(0), str(tmp_path / "none.csv"), spec)
    assert (tmp_path / "none.csv").read_bytes() == b"\xef\xbb\xbfa,b,c,err\r\n"
    with pytest.raises(ValueError):
        write_one_csv(rows, str(tmp_path / "x.csv"), spec)
    assert {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"x.csv", "x.json", "none.json", "none.csv"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("alpha 1 alpha 1")
    (tmp_path / "in" / "b.txt").write_text("alpha 1")
    spec = compile_config(base(record_detection={"trigger": "a"}, dedup={"key": "a"}))
    rows = stream_records(stream_files(spark, str(tmp_path / "in")), spec)
    sink = lambda batch, n: batch.write.mode("append").parquet(str(tmp_path / "out"))
    write_records(rows, spec, sink, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("err") == "errDUP").count() == 1


@pytest.mark.parametrize("name", ["extract_mixed", "value_distribution", "lev_match", "step_to_float"])
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("orders", "part", "customer", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    order = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in got.select(order).collect()))) == sorted(map(str, want.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_digest_of_a_file_that_no_row_holds(spark, tmp_path):
    """Length and digest come from a stream; the reader of whole files refuses one beyond its limit."""
    import hashlib

    from recordlift.queries import _one_file

    data = "строка\n".encode() * 50_000
    (tmp_path / "one.txt").write_bytes(data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert [tuple(r) for r in _one_file(spark, str(tmp_path / "one.txt")).collect()] == [(len(data), hashlib.sha256(data).hexdigest())]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_totals_and_ranks_share_one_count_of_values(spark):
    """The records are parsed once for both, so no part of a parse is left in the plan."""
    from recordlift.operators.profile import value_distribution
    from recordlift.plans.parse import parse
    from recordlift.queries import spec

    docs = spark.createDataFrame([(1, "cell 1 stat A cell 2 stat A"), (2, "cell 2 stat B")], "doc_id long, text string")
    rows = value_distribution(parse(docs, spec()), spec())
    assert "levenshtein" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.field, r.unique, r.filled, [(x["value"], x["cnt"]) for x in r.repeated]) for r in rows.orderBy("field").collect()] == [("cell", 2, 3, [("2", 2)]), ("price", 0, 0, []), ("prio", 0, 0, []), ("stat", 2, 3, [("A", 2)])]


def test_trace_sorts_and_shuffles_nothing(spark):
    from recordlift.operators.trace import trace
    from recordlift.queries import spec

    docs = spark.createDataFrame([(1, "x cell 1 stat A cell 2 y"), (2, "")], "doc_id long, text string")
    rows = trace(docs, spec(), most=6)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    got = [(r.rec_idx, r.tok_idx, r.token, r.event, r.dropped) for r in rows.orderBy("rec_idx", "tok_idx").collect()]
    assert got == [(0, 0, "x", "LOST", 2), (1, 0, "cell", "TRIGGER", 2), (1, 1, "1", "ADD", 2), (1, 2, "stat", "TRIGGER", 2), (1, 3, "A", "ADD", 2), (2, 0, "cell", "TRIGGER", 2)]
