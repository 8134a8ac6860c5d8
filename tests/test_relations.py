"""Differences, subtotals and windows against plain versions."""

import random
from collections import Counter, defaultdict
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recordlift.operators import sessions as windows
from recordlift.operators.compare import changes, multiset_difference
from recordlift.operators.rollups import cube_sets, error_facts, rollup_sets, subtotals
from recordlift.plans.config import compile_config
from recordlift.plans.parse import parse
from recordlift.streaming.windows import stream_firsts, stream_sessions
from tests.test_extraction import base, trigger


def test_difference_counts_rows(spark):
    rng = random.Random(4)
    rows = lambda n: [(rng.choice([1, 2, None]), rng.choice(["x", None])) for _ in range(n)]
    a, b = rows(30), rows(25)
    before, after = spark.createDataFrame(a, "`k.1` int, v string"), spark.createDataFrame([(v, k) for k, v in b], "v string, `k.1` int")
    got = {tuple(r.row): r.n for r in multiset_difference(before, after).collect()}
    wanted = Counter(b)
    wanted.subtract(Counter(a))
    assert got == {k: n for k, n in wanted.items() if n}
    assert multiset_difference(before, before).count() == 0


def test_changes_by_field(spark):
    columns = "doc_id int, nth int, v string, w string"
    before = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", None), (2, 0, "c", "x"), (3, 0, "d", "x"), (3, 0, "d", "x"), (None, 0, "n", "x")], columns)
    after = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "B", "y"), (3, 0, "d", "x"), (3, 0, "e", "x"), (4, 0, "f", None), (None, 0, "n", "z")], columns)
    got = sorted(((r["keys"].doc_id, r["keys"].nth, r.change, r.field, r.before, r.after) for r in changes(before, after, ["doc_id", "nth"]).collect()), key=str)
    wanted = [(1, 1, "changed", "v", "b", "B"), (1, 1, "changed", "w", None, "y"), (2, 0, "removed", None, None, None), (3, 0, "changed", "v", "d", "e"), (4, 0, "added", None, None, None), (None, 0, "changed", "w", "x", "z")]
    assert got == sorted(wanted, key=str)
    assert changes(before, before, ["doc_id", "nth"]).count() == 0 and changes(before.limit(0), after.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("sets", [None, "cube"])
def test_subtotals(spark, sets):
    rng = random.Random(5)
    rows = [(rng.choice(["g", "h", None]), rng.choice(["f", None]), rng.choice("xyz"), rng.choice([1, 2, 3, None])) for _ in range(200)]
    columns = ["a", "b.c", "code"]
    chosen = cube_sets(columns) if sets else rollup_sets(columns)
    got = {tuple(r)[:4]: (r.cnt, r.distinct_doc_id) for r in subtotals(spark.createDataFrame(rows, "a string, `b.c` string, code string, doc_id int"), columns, "doc_id", cube_sets(columns) if sets else None).collect()}
    wanted = defaultdict(list)
    for r in rows:
        for s in chosen:
            key = tuple(x if c in s else None for c, x in zip(columns, r, strict=False))
            wanted[*key, sum(1 << (2 - i) for i, c in enumerate(columns) if c not in s)].append(r[3])
    assert got == {k: (len(v), len(set(v) - {None})) for k, v in wanted.items()}


def test_error_facts(spark):
    spec = compile_config(trigger(trigger(base(record_detection={"trigger": "a"}, dedup={"key": "a"}), "b", validation={"rule": "regex:[0-9]", "error_code": "eB"}), "c", stop_words=["no"], stop_word_error="eC"))
    rows = parse(spark.createDataFrame([(1, "alpha 1 beta x alpha 1 gamma no alpha 2 beta 3")], "doc_id long, text string"), spec)
    assert sorted((r.grp, r.field, r.code) for r in error_facts(rows, spec, F.col("doc_id")).collect()) == [("1", "a", "errDUP"), ("1", "b", "eB"), ("1", "c", "eC")]


def at(seconds):
    return datetime(2024, 1, 1, tzinfo=UTC).replace(tzinfo=None) + timedelta(seconds=seconds)


@pytest.mark.parametrize("reach", [64, 1, 3])
def test_sessions(spark, monkeypatch, reach):
    monkeypatch.setattr(windows, "RANGE", reach)
    rng = random.Random(6)
    events = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(0, 4000), 1.0) for _ in range(300)] + [(1, 7, 1.0)] * 3
    df = spark.createDataFrame([(u, at(t), v) for u, t, v in events] + [(1, None, 5.0)], "u int, t timestamp, v double")
    got = sorted(((r.u, r.session_start, r.session_end, r.n_events, r.total) for r in windows.sessions(df, "u", "t", 30_000_000, "v").collect()), key=str)
    wanted = []
    for user in {u for u, _, _ in events}:
        run = []
        for t in sorted(t for u, t, _ in events if u == user) + [10**9]:
            if run and t - run[-1] > 30:
                wanted.append((user, at(run[0]), at(run[-1]), len(run), float(len(run))))
                run = []
            run.append(t)
    assert got == sorted(wanted, key=str)
    assert windows.sessions(df.limit(0), "u", "t", 1_000_000).count() == 0


def streamed(spark, path, made):
    """What a query over files that arrive one by one has appended in the end."""
    stream = spark.readStream.schema("u int, t timestamp, v double, file string").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/in/*")
    made(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def arriving(spark, path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame([(u, at(t), 1.0, f"b{k}") for u, t in rows], "u int, t timestamp, v double, file string").coalesce(1).write.parquet(f"{path}/in/{k:03d}")


def test_streamed_sessions_are_those_of_the_batch(spark, tmp_path):
    arriving(spark, tmp_path, [[(1, 0), (2, 5), (1, 20)], [(1, 45), (2, 90), (1, 30)], [(2, 100), (1, 200)], [(9, 100_000)], [(1, 10), (9, 100_001)]])
    got = streamed(spark, tmp_path, lambda s: stream_sessions(s, "u", "t", "30 seconds", "60 seconds", "v")).collect()
    # the last batch's event for 1 is later than allowed, and 9 is not over yet
    assert sorted((r.u, r.session_start, r.session_end, r.n_events) for r in got) == [(1, at(0), at(75), 4), (1, at(200), at(230), 1), (2, at(5), at(35), 1), (2, at(90), at(130), 2)]


def test_streamed_firsts(spark, tmp_path):
    arriving(spark, tmp_path, [[(1, 0), (2, 5)], [(1, 10), (3, 20)], [(2, 50)], [(9, 100_000)], [(8, 100_001)], [(1, 100_005)]])
    got = streamed(spark, tmp_path, lambda s: stream_firsts(s, ["u"], "t", "600 seconds")).collect()
    # 1 is forgotten by the time it comes again, since a batch went by behind the watermark
    assert sorted((r.u, r.file) for r in got) == [(1, "b0"), (1, "b5"), (2, "b0"), (3, "b1"), (8, "b4"), (9, "b3")]


def test_both_sides_of_changes_meet_in_one_shuffle(spark):
    """Rows that differ are dealt by their keys once: one aggregation of lists, not two."""
    from recordlift.operators.compare import changes

    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "z"), (3, "y")], "k int, v string")
    rows = changes(a, b, ["k"])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
    assert sorted((r.keys_k, r.change, r.before, r.after) for r in rows.selectExpr("keys.k as keys_k", "change", "before", "after").collect()) == [(1, "changed", "x", "z"), (2, "removed", None, None), (3, "added", None, None)]
