"""A profile kept up to date, against that of all documents at once."""

import random

from recordlift.operators import profile
from recordlift.operators.incremental import ProfileTable
from recordlift.plans.config import compile_config
from recordlift.plans.parse import parse
from tests.test_extraction import base

SPEC = compile_config(base(record_detection={"trigger": "a"}, dedup={"key": "a"}, log_suspicious=True, stop_words=["stop"]))


def table(spark, data):
    return spark.createDataFrame(data, "doc_id string, text string")


def same(spark, kept, data):
    rows = parse(table(spark, data), SPEC, lost=True).cache()
    assert kept.summary().collect() == profile.summary(rows).collect()
    assert kept.top_errors().collect() == profile.top_errors(rows).collect()
    assert kept.lost_tokens().collect() == profile.lost_tokens(rows).collect()
    assert sorted(kept.value_distribution().collect()) == sorted(profile.value_distribution(rows, SPEC).collect())


def texts(seed, n):
    rng = random.Random(seed)
    return [(f"d{k}", " ".join(rng.choices(["alpha", "beta", "gamma", "stop", "q", "1", "2", "3"], k=rng.randrange(0, 25)))) for k in range(n)]


def test_only_what_is_new_is_parsed(spark, tmp_path):
    kept = ProfileTable(spark, str(tmp_path / "p"), SPEC)
    same(spark, kept, [])
    first = texts(1, 12) + [(None, "alpha 1"), ("empty", None)]
    assert kept.add(table(spark, first)) == 14
    same(spark, kept, first)
    assert kept.add(table(spark, first)) == 0 and kept._runs() == [0]
    second = first[:3] + [(d, f"{t} alpha 9") for d, t in first[3:6]] + first[6:12] + [(None, "alpha 2"), ("empty", "beta 1")] + [(f"x{d}", t) for d, t in texts(2, 5)]
    assert kept.add(table(spark, second)) == 3 + 2 + 5
    same(spark, kept, second)
    # back to the first versions
    assert kept.add(table(spark, first)) == 5
    same(spark, kept, first + second[-5:])
    kept.compact()
    same(spark, kept, first + second[-5:])
    assert kept.add(table(spark, first + second[-5:])) == 0


def test_a_run_that_failed_has_no_effect(spark, tmp_path):
    kept = ProfileTable(spark, str(tmp_path / "p"), SPEC)
    kept.add(table(spark, texts(3, 4)))
    kept._partial(table(spark, texts(4, 9)).selectExpr("doc_id", "text", "'v' as version")).write.parquet(str(tmp_path / "p" / "run-000001"))
    (tmp_path / "p" / "run-000001" / "_SUCCESS").unlink()
    same(spark, kept, texts(3, 4))
    assert kept.add(table(spark, texts(4, 9))) > 0 and kept._runs() == [0, 1]


def test_versions_given_and_repeated(spark, tmp_path):
    kept = ProfileTable(spark, str(tmp_path / "p"), SPEC)
    rows = spark.createDataFrame([("a", "alpha 1", "1"), ("a", "alpha 2 alpha 3", "2"), ("a", "alpha 2 alpha 3", "2"), ("b", "alpha 5", None)], "doc_id string, text string, version string")
    assert kept.add(rows) == 2
    same(spark, kept, [("a", "alpha 2 alpha 3"), ("b", "alpha 5")])


def test_partial_counts_are_taken_by_hash(spark, tmp_path):
    kept = ProfileTable(spark, str(tmp_path / "p"), SPEC)
    rows = kept._partial(table(spark, [("a", "alpha 1")]).selectExpr("doc_id", "text", "'v' as version"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
