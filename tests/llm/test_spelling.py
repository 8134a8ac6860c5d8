"""Spelling variants against plain versions: every pair compared, chains followed one by one."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from recordlift.llm import spelling
from tests.llm.corpus import FOLD, frame, with_oddities

DATA = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain_words(data, damage):
    counts = Counter()
    for d, t in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(data, damage=None):
    words = plain_words(data, damage)
    near = {w: [x for x in words if abs(len(w) - len(x)) < 2 and distance(w, x) == 1] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items())


def corpus(seed=4, alphabet="abÀÿ", sizes=(7, 8, 9)):
    """Few letters, so that words are close; counts that differ by tens; words that share halves."""
    rng = random.Random(seed)
    base = ["".join(rng.choices(alphabet, k=rng.choice(sizes))) for _ in range(60)]
    base += ["zzzz" + "".join(rng.choices(alphabet, k=4)) for _ in range(40)] + ["".join(rng.choices(alphabet, k=4)) + "zzzz" for _ in range(40)] + ["a" * k for k in range(6, 12)]
    texts = []
    for w in base:
        texts.append(" ".join([w if rng.random() < 0.9 else w.upper()] * rng.choice([1, 2, 2, 3, 30, 300])))
    texts += ["Ab1abcdefg abcdefg", "straße straßen Straßen straßes", "x" * 300, "x" * 300 + " " + "x" * 299, "y" * 50_000, None, "", "1 2 3"]
    return list(enumerate(texts))


@pytest.mark.parametrize("hot, per_shard, damage", [(256, 20_000, None), (3, 20_000, None), (0, 7, None), (256, 7, 2), (5, 11, 3)])
def test_variants(spark, hot, per_shard, damage):
    data = with_oddities(corpus())
    got = spelling.variants(frame(spark, data), damage=damage, hot=hot, per_shard=per_shard).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(map(tuple, got.collect())) == plain_variants(data, damage)


def test_chains_reach_their_root(spark):
    words = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    data = list(enumerate(" ".join([w] * n) for w, n in zip(words, (2, 20, 200, 2000, 20_000))))
    got = {r.word: r.root for r in spelling.variants(frame(spark, data)).collect()}
    assert got == dict.fromkeys(words, words[-1])


def test_one_edit():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(6))) for _ in range(2))
        assert spelling.one_edit(a, b) == (distance(a, b) == 1)


def test_tasks_flush_their_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 5)
    data = corpus(6)
    got = spelling.word_counts(frame(spark, data)).collect()
    assert {r.word: r.n for r in got} == plain_words(data, None)


def test_nothing(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, "short words only"), (2, None)])).count() == 0


def test_query_against_sql(spark):
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.op13_spelling(spark, DATA).collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        assert got == sorted((w, f or "", r, n, k, m or 0) for w, f, r, n, k, m in db.execute(spelling.OP13_SQL).fetchall())
    assert len(got) > 100


@pytest.mark.parametrize("most_sent", [spelling.MOST_SENT, 0])
def test_only_hot_halves_are_sent(spark, monkeypatch, most_sent):
    """Spark takes the tables for small, since it sizes them as compressed files or before an explode."""
    monkeypatch.setattr(spelling, "MOST_SENT", most_sent)
    sides = []
    monkeypatch.setattr(spelling, "stored", lambda rows, name, stored=spelling.stored: (sides.append((name, rows)), stored(rows, name))[1])
    data = corpus(5)
    got = spelling.variants(frame(spark, data), hot=3, per_shard=50).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(map(tuple, got.collect())) == plain_variants(data)
    plans = [(name, rows._jdf.queryExecution().sparkPlan().toString()) for name, rows in [*sides, ("roots", got)]]
    assert sum("SortMergeJoin" in plan for _, plan in plans) >= 3
    for name, plan in plans:
        sent = plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin")
        assert sent == (4 if name == "variants" and most_sent else 0), plan
