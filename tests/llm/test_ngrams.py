"""Scores of n-gram models: base and counts against plain versions, the filter against a plain table of levels."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from recordlift.llm import ngram_scores as ngrams
from tests.llm.corpus import FOLD, frame, plain_words, rows, with_oddities

DATA = "/root/testdata/sf0.001"
END = "\n"


def tokens(text):
    return [w.translate(FOLD) for w in plain_words(text)] + [END]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def plain_base(data):
    counts = Counter(w for d, t in data if not held(d) for w in tokens(t))
    total, types = sum(counts.values()), len(counts)
    out = []
    for d, t in data:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (types + 1))) for x in w)
        out.append((d, held(d), len(w), sum(counts[x] > 0 for x in w), total, base))
    return out


def plain_scores(data, mu):
    """The model with a table of levels in place of the filter."""
    counts = [Counter() for _ in range(3)]
    for d, t in data:
        if not held(d):
            w = tokens(t)
            for k in range(3):
                counts[k].update(tuple(w[i : i + k + 1]) for i in range(len(w) - k))
    total, types = sum(counts[0].values()), len(counts[0])

    def quantised(gram):
        c, least = counts[len(gram) - 1][gram], 1 if len(gram) == 1 else 2
        if c < least:
            return 0
        q = int(math.log2(c // least))
        return (least * 2**q + least * 2 ** (q + 1) - 1) / 2

    def bounded(gram):
        return quantised(gram) if len(gram) == 1 else min(quantised(gram), bounded(gram[:-1]), bounded(gram[1:]))

    def p(gram):
        if len(gram) == 1:
            return (quantised(gram) + 0.1) / (total + 0.1 * (types + 1))
        m = mu[len(gram) - 2]
        return (bounded(gram) + m * p(gram[1:])) / (bounded(gram[:-1]) + m)

    out = []
    for _, t in data:
        w = tokens(t)
        out.append(sum(math.log10(p(tuple(w[max(0, i - 2) : i + 1]))) for i in range(len(w))))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    return rows(seed, 80) + [(1000 + k, " ".join(rng.choices(["the", "The", "cat", "sat", "on", "mat", f"odd{k}", "ünder"], k=rng.randrange(1, 40)))) for k in range(60)]


def by_row(items):
    return sorted(items, key=lambda r: (r[0] is None, r[0] or 0, *r[1:4], round(r[5], 6)))


@pytest.mark.parametrize("settings", [{}, {"filter_bytes": 0, "part_bytes": 5000}, {"frequent": 3}, {"frequent": 0, "part_bytes": 1000}, {"filter_bytes": 0, "frequent": 10}])
def test_base_and_counts(spark, settings, monkeypatch):
    if "part_bytes" in settings:
        monkeypatch.setattr(ngrams, "CHUNK", 500)
    data = with_oddities(corpus())
    got = by_row(map(tuple, ngrams.score_texts(frame(spark, data), **settings).collect()))
    wanted = by_row(plain_base(data))
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    assert np.allclose([r[5] for r in got], [r[5] for r in wanted], rtol=1e-11, atol=1e-9)


def test_scores_are_those_of_the_levels(monkeypatch):
    """With filters so large that they have no false positives."""
    monkeypatch.setattr(ngrams, "BITS", 400)
    monkeypatch.setattr(ngrams, "PROBES", 12)
    data = corpus()
    training = pa.RecordBatch.from_pydict({"text": [(t or "").encode() for d, t in data if not held(d)]})
    counted = pa.Table.from_batches(list(ngrams._counting(3)(iter([training.slice(0, 40), training.slice(40)]))))
    parts = []
    for p in set(counted["part"].to_pylist()):
        parts += ngrams._adding(3)(counted.filter(pc.equal(counted["part"], p))).to_pylist()
    filters = ngrams.Filter({r["part"]: (r["bits"], r["n_bits"]) for r in parts}, 3)
    totals = ngrams.Totals(sum(r["tokens"] for r in parts), sum(r["types"] for r in parts))
    texts = [ngrams.tokens((t or "").encode()) for _, t in data]
    got = ngrams.log_probabilities(ngrams.Grams(texts, 3), filters.levels, totals, (4.0, 1.5))
    sums = np.add.reduceat(got, np.cumsum([0] + [len(t) for t in texts[:-1]]))
    assert np.allclose(sums, plain_scores(data, (4.0, 1.5)), rtol=1e-9)


def test_both_ways_give_equal_scores(spark, monkeypatch):
    data = with_oddities(corpus())
    whole = ngrams.score_texts(frame(spark, data), part_bytes=4000).collect()
    monkeypatch.setattr(ngrams, "CHUNK", 700)
    dealt = ngrams.score_texts(frame(spark, data), part_bytes=4000, filter_bytes=0).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score)
    for a, b in zip(sorted(whole, key=key), sorted(dealt, key=key), strict=True):
        assert a.doc_id == b.doc_id and math.isclose(a.score, b.score, rel_tol=1e-12) and a.n_known == b.n_known


def test_levels_and_false_positives():
    rng = np.random.default_rng(1)
    grams = ngrams.masked(rng.integers(1, 1 << 63, 200_000, np.uint64) * np.uint64(2), 4)
    counts = rng.geometric(0.4, len(grams)) * 2
    levels = ngrams.level_of(counts, 2)
    assert (levels == np.floor(np.log2(counts // 2)).astype(int) + 1).all()
    parts = {}
    for p in range(16):
        mine = grams >> np.uint64(60) == p
        parts[p] = ngrams.part_filter(grams[mine], levels[mine])
    held = ngrams.Filter(parts, 4)
    found = held.levels(grams)
    assert (found >= levels).all() and (found > levels).mean() < 0.02
    strangers = ngrams.masked(rng.integers(1, 1 << 63, 200_000, np.uint64), 4)
    assert (held.levels(strangers) > 0).mean() < 0.015
    assert ngrams.count_of(np.array([0, 1, 2, 3]), 1).tolist() == [0, 1, 2.5, 5.5]
    assert ngrams.count_of(np.array([1, 2]), 2).tolist() == [2.5, 5.5]


def test_packing():
    rng = np.random.default_rng(2)
    for bits in (2, 7, 16):
        grams = np.unique(ngrams.masked(rng.integers(0, 1 << 64, 5000, np.uint64), bits))
        edges = ngrams._by_part(grams, bits)
        for p in {0, 1, (1 << bits) - 1}:
            mine = grams[edges[p] : edges[p + 1]]
            assert (ngrams._unpacked(ngrams._packed(mine, bits), p, bits) == mine).all()


def test_model_is_better_than_its_base(spark):
    got = ngrams.op12_ngram_scores(spark, DATA).collect()
    held_rows = [r for r in got if r.held_out]
    assert len(held_rows) > 10
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)
    assert all(r.score < 0 for r in got)


def test_query_counts(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = by_row(map(tuple, ngrams.op12_ngram_scores(spark, DATA).collect()))
    wanted = by_row(plain_base(docs))
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    assert np.allclose([r[5] for r in got], [r[5] for r in wanted], rtol=1e-11)


def test_nothing(spark):
    assert ngrams.score_texts(frame(spark, [])).count() == 0
    assert [r.n_tokens for r in ngrams.score_texts(frame(spark, [(None, None)])).collect()] == [1]
