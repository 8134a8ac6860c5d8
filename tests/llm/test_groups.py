"""Sharding, near duplicates, toxicity, substrings, and the pipeline: against plain versions."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordlift.llm import near_dedup, sharding, substrings, toxicity
from tests.llm.corpus import FOLD, frame, plain_words, rows, with_oddities

DATA = "/root/testdata/sf0.001"


# --- 5 ---


def least_capacity(weights, shards):
    low, high = max(weights, default=0), sum(weights)
    while low < high:
        mid, used, room = (low + high) // 2, 1, 0
        for w in weights:
            if room + w > mid:
                used, room = used + 1, 0
            room += w
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards, detail", [(24, 8192), (3, 8192), (5, 4), (1, 8192)])
def test_sharding(spark, shards, detail):
    data = with_oddities(rows())
    got = sharding.shard(frame(spark, data), shards, detail).collect()
    assert len(got) == len(data)
    groups, first = defaultdict(int), {}
    for d, t in data:
        groups[t or ""] += len((t or "").encode()) + 8
        first[t or ""] = min(first.get(t or "", 1 << 62), -1 if d is None else d)
    order = sorted(groups, key=lambda t: (first[t], hashlib.sha256(t.encode()).digest()))
    load, slots = defaultdict(int), defaultdict(list)
    texts = {d: t or "" for d, t in data if d is not None}
    where = defaultdict(set)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        if r.doc_id is not None:
            where[texts[r.doc_id]].add(r.shard)
            assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 8, zlib.crc32(texts[r.doc_id].encode()))
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) == least_capacity([groups[t] for t in order], shards)
    placed = [next(iter(where[t])) for t in order if where[t]]
    assert placed == sorted(placed) and set(load) <= set(range(shards))


def test_sharding_of_nothing(spark):
    assert sharding.shard(frame(spark, [])).count() == 0


# --- 7 ---


def shingled(text, width):
    w = plain_words((text or "").translate(FOLD))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if w else set()


def plain_components(data, width, percent):
    sets = {d: shingled(t, width) for d, t in data}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return sorted((d, len(sets[d]), top(d), top(d) == d) for d in ids)


def family(seed, size):
    """Copies of one text with a few words changed each: some pairs are linked, some not."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(500)}" for _ in range(120)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    texts = [t for _, t in rows(n=40)] + family(1, 150) + family(2, 20) + [family(3, 1)[0]] * 200 + ["hello\x0bworld one", "HELLO world one", "É x y", "é x y"]
    data = list(enumerate(texts))
    got = sorted(map(tuple, near_dedup.find(frame(spark, data), width, 80).collect()))
    assert got == plain_components(data, width, 80)


def test_near_duplicates_of_odd_rows(spark):
    docs = frame(spark, with_oddities(rows(n=10)))
    got = near_dedup.find(docs).collect()
    assert len(got) == docs.count()
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    kept = near_dedup.dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and set(ids) == {r.doc_id for r in got if r.kept and r.doc_id is not None}
    assert near_dedup.find(frame(spark, [])).count() == 0 and near_dedup.dedup(frame(spark, [])).count() == 0


def test_exact_join_of_large_buckets(spark, monkeypatch):
    """With every bucket large and the estimate useless, the prefix join alone must find all links."""
    monkeypatch.setattr(near_dedup, "SMALL", 1)
    data = list(enumerate(family(5, 80) + family(6, 80)))
    assert sorted(map(tuple, near_dedup.find(frame(spark, data), 2, 80).collect())) == plain_components(data, 2, 80)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)]
    up = {x: x for e in edges for x in e}
    top = lambda x: x if up[x] == x else top(up[x])
    for a, b in edges:
        p, q = sorted((top(a), top(b)))
        up[q] = p
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == top(x) for x in up)


# --- 8 ---


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next_row(row, i, x, b)
    return row[-1]


def _next_row(old, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(new[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return new


def test_automata_against_edit_distances():
    rng = random.Random(9)
    terms = ["".join(rng.choices("abc", k=rng.randrange(3, 9))) for _ in range(12)]
    stems = ["caba", "bbca"]
    m = toxicity.Matcher(terms, stems)
    for _ in range(3000):
        w = "".join(rng.choices("abcd", k=rng.randrange(1, 10)))
        exact = w in terms or any(w.startswith(s) for s in stems)
        near = any(len(t) >= 5 and t[0] == w[0] and edits(t[1:], w[1:]) <= 1 for t in terms)
        assert m.match(w) == (1 if exact else 2 if near else 0), w


def test_quotation_counts_apart():
    m = toxicity.Matcher(["idiot"], [])
    f = lambda text: toxicity.features_of(text, m, {})
    plain, quoted, fuzzy = f("you idiot here now"), f('she said you "idiot" now'), f("you idjot here")
    assert plain[0] > 0 and plain[2] == 0
    assert quoted[0] == 0 and quoted[2] > 0
    assert fuzzy[3] > 0 and fuzzy[0] == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in got)
    said, true = sum(r.predicted for r in got), sum(r.toxic for r in got)
    print(len(got), hit, said, true)
    assert hit / max(1, said) >= 0.9 and hit / true >= 0.85


def test_toxicity_of_odd_rows(spark):
    data = with_oddities(rows(n=10))
    docs = frame(spark, data)
    labels = spark.createDataFrame([(0, 1), (0, 0), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert toxicity.reject(docs, model).columns == docs.columns
    none = toxicity.learn(docs, labels.where("toxic = 9"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), none).count() == 0


def osa(a, b):
    """Edits with swapped neighbours as one."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_disguised_terms():
    m = toxicity.Matcher(["idiot", "fool"], [], wide=True)
    for token in ("1diot", "*diot", "udiot", "diot", "idoit", "diiot", "id*ot", "i**ot", "(i***t)", "i.diot", "xidiot", "idiot*", "f**l", "*ool", "foo*"):
        assert m.match_token(token) == 2 or token == "idiot*" and m.match_token(token) == 1, token
    assert [m.match_token(t) for t in ("idiot!", "fol", "cool", "****", "***", "*", "", "ditoi", "tree", "a*")] == [1, 3, 3, 0, 0, 0, 0, 0, 0, 0]
    rng = random.Random(6)
    terms = ["".join(rng.choices("abc", k=rng.randrange(3, 9))) for _ in range(12)]
    m = toxicity.Matcher(terms, ["caba"], wide=True)
    for _ in range(3000):
        w = "".join(rng.choices("abcd", k=rng.randrange(1, 10)))
        near = [len(t) for t in terms if osa(t, w) <= 1]
        want = 1 if w in terms or w.startswith("caba") else 2 if max(near, default=0) >= 5 else 3 if near else 0
        assert m.match(w) == want, w
    # without a term at all: features of the disguised word are those of a hit
    m = toxicity.Matcher(["idiot"], [], wide=True)
    assert all(toxicity.features_of(f"you {t} here", m, {})[3] > 0 for t in ("*diot", "udiot", "idoit"))


def plain_code(token, words, stems):
    """What a token is, by comparing it with every term."""

    def alike(term, word):
        """Edits with swapped neighbours as one; a masking sign of the word stands for any letter."""
        d = {(i, -1): i + 1 for i in range(-1, len(term))} | {(-1, j): j + 1 for j in range(-1, len(word))}
        for i, x in enumerate(term):
            for j, y in enumerate(word):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y and y not in toxicity.MASKS))
                if i and j and x == word[j - 1] and term[i - 1] == y:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(term) - 1, len(word) - 1]

    def code(word):
        signs = sum(c in toxicity.MASKS for c in word)
        if not signs and (word in words or any(word.startswith(s) for s in stems)):
            return 1
        near = [t for t in words if abs(len(t) - len(word)) <= 1 and alike(t, word) <= 1]
        if signs:
            masked = any(len(t) == len(word) and all(x == y or y in toxicity.MASKS for x, y in zip(t, word)) for t in near)
            return 2 if signs < len(word) and (masked or 2 * signs < len(word) and any(len(t) >= 5 for t in near)) else 0
        return 2 if any(len(t) >= 5 for t in near) else 3 if near else 0

    codes = {code(toxicity.word_of(token))}
    if 1 not in codes:
        codes.add(code(toxicity.masked_of(token)))
    return min(codes - {0}, default=0)


def plain_score(text, model, codes):
    """The score from its definition: counts of plain, quoted, misspelled and short hits through the fitted weights."""
    tokens = (text or "").lower().split()
    found = [(i, codes(t)) for i, t in enumerate(tokens)]
    near = lambda i: tokens[max(0, i - 3) : i + 4]
    told = lambda i: any(set(t) & set('"“”„«»‹›') or re.sub(r"^\W+|\W+$", "", t) in toxicity.REPORTING for t in near(i))
    sure = [i for i, c in found if c == 1]
    quoted = [i for i in sure if told(i)]
    plain, fuzzy, short = len(sure) - len(quoted), sum(c == 2 for _, c in found), sum(c == 3 for _, c in found)
    kinds = {re.sub(r"^\W+|\W+$", "", tokens[i])[:4] for i, c in found if c in (1, 2)}
    f = [math.log(1 + plain), plain >= 2, math.log(1 + len(quoted)), math.log(1 + fuzzy), min(3, len(kinds)), min(1, 20 * len(sure) / max(1, len(tokens))), math.log(1 + short)]
    z = model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], f, strict=True))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_against_plain_version(spark):
    at = "/root/testdata/sf0.01"
    model = toxicity.learn(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    assert model.words and model.weights
    rng = random.Random(2)
    spoilt = [w[:k] + rng.choice(["", "*", "x", w[k : k + 1] * 2]) + w[k + 1 :] for w in model.words for k in range(len(w))]
    made = [(10_000 + i, " ".join(rng.choices([*model.words, *spoilt, "said", '"so', "tree", "****", "sun"], k=rng.randrange(0, 12)))) for i in range(150)]
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if len(r.text or "") < 4000] + made + [(None, None)]
    known = {}

    def codes(token):
        if token not in known:
            known[token] = plain_code(token, model.words, model.stems)
        return known[token]

    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(spark.createDataFrame(data, "doc_id long, text string"), model).collect()}
    for d, t in data:
        want = plain_score(t, model, codes)
        assert abs(got[d][0] - want) < 1e-9 and got[d][1] == int(want >= 0.7), t


def test_texts_that_are_no_utf8(spark):
    docs = spark.range(3).selectExpr("id as doc_id", "cast(X'41ff42' as string) as text", "cast(X'ff' as string) as lang")
    model = toxicity.Model(("idiot",), (), (0.0, *[1.0] * toxicity.N_FEATURES))
    assert toxicity.score(docs, model).count() == 3 and toxicity.reject(docs.select("doc_id", "text"), model).count() == 3


def labelled(spark, texts):
    """Documents (doc_id, text) and labels (doc_id, toxic) of (text, toxic), none of them held out."""
    ids = (i for i in range(10**6) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows_ = [(i, t, y) for i, (t, y) in zip(ids, texts)]
    full = spark.createDataFrame(rows_, "doc_id long, text string, toxic int")
    return full.select("doc_id", "text"), full.select("doc_id", "toxic")


def around(rng, word):
    own = lambda: "".join(rng.choices("aeiou", k=9))
    return f"{own()} {own()} {word} {own()} {own()}"


def test_lexicon_is_gathered_from_all_rows(spark):
    rng = random.Random(8)
    texts = [(around(rng, "zzgrumpf" if k % 20 == 0 else "tree"), int(k % 20 == 0)) for k in range(600)]
    docs, labels = labelled(spark, texts)
    model = toxicity.learn(docs, labels, max_rows=30)
    assert "zzgrumpf" in model.words


def test_a_lexicon_in_parts_scores_alike(spark, monkeypatch):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    whole, parts = (toxicity.learn(docs, labels, most_bytes=m) for m in (toxicity.LEXICON_BYTES, 30))
    assert not whole.more and len(parts.more) > 1
    assert sorted(w for words, _ in parts.lexicon() for w in words) == list(whole.words)
    data = frame(spark, with_oddities(rows()) + [(90, " ".join(whole.words)), (91, "f**l " + whole.words[0][:-1] + "x")])
    for table in (docs, data):
        want = sorted(map(str, toxicity.score(table, whole).collect()))
        assert sorted(map(str, toxicity.score(table, parts).collect())) == want
        assert sorted(map(str, toxicity.reject(table, parts).collect())) == sorted(map(str, toxicity.reject(table, whole).collect()))
    assert toxicity.score(docs.limit(0), parts).count() == 0
    # few tokens at a time, in this process
    monkeypatch.setattr(toxicity, "TOKENS", 50)
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows()])], names=["text"])
    each = [[f for _, own in toxicity.featured(iter([batch, batch]), "text", m) for f in own] for m in (whole, parts)]
    assert len(each[0]) == 2 * batch.num_rows and each[0] == each[1]


@pytest.mark.parametrize("part", [toxicity.PART, 2000])
def test_copies_do_not_displace_terms(spark, part):
    rng = random.Random(9)
    copied = [f"{''.join(rng.choices('bcdfgh', k=10))}" for _ in range(1800)]
    texts = [(" ".join([*copied, f"n{k}"]), 1) for k in range(12)] + [(around(rng, "zzgrumpf" if k % 10 == 0 else "tree"), int(k % 10 == 0)) for k in range(100)]
    model = toxicity.learn(*labelled(spark, texts), part=part)
    assert "zzgrumpf" in model.words and not set(copied[:-1]) & set(model.words)


# --- 10 ---


def plain_substrings(data):
    first, out = {}, []
    for d, t in data:
        w = plain_words(t)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    for d, t in data:
        w, gone = plain_words(t), set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches, bits", [(1, 3), (2, 16), (2, 17), (2, 18), (1, 22), (6, 3)])
def test_substrings(spark, batches, bits):
    texts = [t for _, t in rows(n=60 if bits < 9 else 3) if bits < 9 or len(t or "") < 5000] + family(11, 40 if bits < 9 else 4)
    data = list(enumerate(texts))
    index = substrings.FingerprintIndex(spark, cell_bits=bits, buckets=5, fanout=3)
    got = substrings.dedup_substrings(frame(spark, data), index, batches).collect()
    assert sorted(map(tuple, got)) == plain_substrings(data)
    assert len(index.runs) <= 3


def test_many_cells_of_small_shares(spark, monkeypatch):
    """As many cells as a corpus of over a terabyte has."""
    data = [(d, t) for d, t in enumerate(family(11, 6)) if len(t or "") < 3000] + [(999, "x" * 70_000)]
    monkeypatch.setattr(substrings, "SHARE", 1)
    made = []
    index = substrings.FingerprintIndex
    monkeypatch.setattr(substrings, "FingerprintIndex", lambda *a, **b: made.append(index(*a, **(b | {"buckets": 50}))) or made[-1])
    got = substrings.dedup_substrings(frame(spark, data)).collect()
    assert made[0].bits == 17 and made[0].precision == 64
    assert sorted(map(tuple, got)) == plain_substrings(data)


def test_substrings_of_odd_rows(spark):
    data = with_oddities(rows(n=10))
    got = substrings.dedup_substrings(frame(spark, data), texts=True).collect()
    assert len(got) == len(data)
    twice = [r for r in got if r.doc_id == 0]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert substrings.dedup_substrings(frame(spark, [])).count() == 0


def plain_with_history(batches, width=13):
    """Rows of the last batch: words that no window covers which an earlier batch has, or a smaller id of its own."""
    first, seen = {}, set()
    place = lambda d: -1 if d is None else d
    windows = lambda t: [tuple(plain_words(t)[i : i + width]) for i in range(len(plain_words(t)) - width + 1)]
    for batch in batches[:-1]:
        seen.update(w for _, t in batch for w in windows(t))
    for d, t in batches[-1]:
        for w in windows(t):
            first[w] = min(first.get(w, place(d)), place(d))
    out = []
    for d, t in batches[-1]:
        words, gone = plain_words(t), set()
        for i, w in enumerate(windows(t)):
            if w in seen or first[w] < place(d):
                gone |= set(range(i, i + width))
        out.append((d, len(words), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(words) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk, weak", [(substrings.CHUNK, False), (60, False), (400, True)])
def test_repeated_and_missing_ids(spark, monkeypatch, chunk, weak):
    """Rows that share or lack an id, also with history, many chunks, and fingerprints that nearly all agree."""
    # globals of the tasks' functions travel with them
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    if weak:
        hashes = substrings.window_hashes
        monkeypatch.setattr(substrings, "window_hashes", lambda words, width: hashes(words, width) & np.uint64(3 << 62))
    rng = random.Random(4)
    shared = [" ".join(rng.choices("abcdefgh", k=20)) for _ in range(4)]
    text = lambda: " ".join([rng.choice(shared), *rng.choices("abcdefgh", k=rng.randrange(0, 25)), rng.choice(shared)])
    batch = lambda: [(rng.choice([None, 1, 2, 2, 3, 50, 51, 52]), text()) for _ in range(25)]
    batches = [batch(), batch(), batch()]
    batches[1] += batches[1][:3]
    batches[2] += batches[2][:2] + batches[0][:2] + [(None, None), (3, "")]
    index = substrings.FingerprintIndex(spark, cell_bits=2, buckets=3, fanout=1)
    for k, rows_ in enumerate(batches):
        docs = spark.createDataFrame(rows_, "doc_id long, text string")
        got = substrings.strip_repeats(docs, index.add(docs), index).collect()
        assert sorted(map(tuple, got), key=str) == plain_with_history(batches[: k + 1])


def test_index_remembers_earlier_batches(spark):
    index = substrings.FingerprintIndex(spark, cell_bits=2, buckets=3, fanout=1)
    text = " ".join(f"q{i}" for i in range(30))
    removed = []
    for k in range(3):
        docs = spark.createDataFrame([(k, text if k != 1 else "a b c")], "doc_id long, text string")
        removed.append(substrings.strip_repeats(docs, index.add(docs), index).first().n_removed)
    assert removed == [0, 0, 30]


def test_cells_grow_with_the_index(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_CELL", 400)
    rng = random.Random(7)
    shared = [" ".join(rng.choices("abcdefgh", k=20)) for _ in range(30)]
    batches = [[(i, " ".join(rng.choices(shared, k=2) + rng.choices("abcdefgh", k=15))) for i in range(20)] for _ in range(4)]
    index = substrings.FingerprintIndex(spark, cell_bits=1, buckets=2, fanout=1)
    bits = []
    for k, rows_ in enumerate(batches):
        docs = spark.createDataFrame(rows_, "doc_id long, text string")
        found = index.add(docs)
        bits.append(index.bits)
        assert sorted(map(tuple, substrings.strip_repeats(docs, found, index).collect()), key=str) == plain_with_history(batches[: k + 1])
    assert bits[0] == 1 and bits == sorted(bits) and bits[-1] > 3


@pytest.mark.parametrize("fanout", [8, 1])
def test_equal_fingerprints_are_verified(spark, fanout):
    words = [f"v{i}" for i in range(27)]
    low = np.arange(5, dtype=np.uint64) << np.uint64(16)

    def cell(ids, values, checks, kind=0):
        packed = [zlib.compress(np.diff(np.array(ids, np.int64), prepend=0).tobytes()), zlib.compress(np.ones(len(ids), "<u4").tobytes())]
        data = substrings._pack6(values) if kind == 0 else zlib.compress(substrings._gaps(values))
        return (3, kind, *(packed if kind == 0 else (None, None)), data, np.array(checks, "<u4").tobytes())

    def joined(rows):
        return substrings._merge_join(1)(pa.Table.from_pylist([dict(zip(substrings._CELLS.names, r, strict=True)) for r in rows], schema=substrings._CELLS)).to_pylist()

    # documents 1 to 4 have one fingerprint, but only 1 and 3 the same words; a run knows the words of 4
    same = np.repeat(low[2:3], 4)
    run, *found = joined([cell([1, 2, 3, 4], same, [7, 8, 7, 9]), cell([], low[1:3], [9, 9], kind=1)])
    hit = [np.cumsum(np.frombuffer(zlib.decompress(r["ids"]), np.int64)).tolist() for r in found]
    assert hit == [[3, 4]]
    assert substrings._from_gaps(zlib.decompress(run["bits"])).tolist() == [int(low[2])] * 2 and np.frombuffer(run["checks"], "<u4").tolist() == [7, 8]
    # a check of its own for each window, and the whole path with compaction
    enc = [w.encode() for w in words]
    assert len({*substrings.window_checks(enc).tolist()}) == 15
    index = substrings.FingerprintIndex(spark, cell_bits=1, buckets=2, fanout=fanout)
    removed = []
    for k, text in enumerate([words, words[::-1], words]):
        docs = spark.createDataFrame([(k, " ".join(text))], "doc_id long, text string")
        removed.append(substrings.strip_repeats(docs, index.add(docs), index).first().n_removed)
    assert removed == [0, 0, 27]


# --- pipeline ---

ODD = ["a.b", "row", "id", "hash", "c0", "_number", "component"]


def odd_table(spark, data):
    """Columns with a dot and with names that stages might use, shared and missing ids."""
    made = [(i, t, *[f"{k}{c}" for c in ODD]) for k, (i, t) in enumerate(data)]
    return spark.createDataFrame(made, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in ODD))


def test_stages_keep_odd_columns(spark):
    from recordlift.llm import decontamination, secrets

    data = [(1, "a b c d e f"), (1, "z y x w v u"), (2, "a b c d e f"), (2, "a b c d e f g"), (3, None), (3, " "), (3, ""), (None, "a b c d e f"), (None, None), (4, "p q r s t u v w x y z one two three four"), (4, "other words")]
    docs = odd_table(spark, data)
    whole = {tuple(r) for r in docs.collect()}
    kept = near_dedup.dedup(docs)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} <= whole
    texts = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    # null and empty texts of an id are one text
    left = [(1, "a b c d e f"), (1, "z y x w v u"), (2, "a b c d e f g"), (3, " "), (3, ""), (None, "a b c d e f"), (None, ""), (4, data[9][1]), (4, "other words")]
    assert texts == sorted(left, key=str)
    benchmark = spark.createDataFrame([(7, "p q r s t u v w x y z one two")], "item_id long, text string")
    for size in (decontamination.MAX_BYTES, 100):
        clean = decontamination.clean(docs, benchmark, max_bytes=size)
        assert clean.columns == docs.columns and {tuple(r) for r in clean.collect()} == {r for r in whole if r[1] != data[9][1]}
    model = toxicity.Model(("zz",), (), (1.0,))
    assert toxicity.reject(docs, toxicity.Model((), (), ())).columns == docs.columns
    assert {tuple(r) for r in toxicity.reject(docs, toxicity.Model((), (), ())).collect()} == whole and model.words
    assert {tuple(r) for r in secrets.redact(docs).collect()} == whole




def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from recordlift.llm import secrets
    from tests.llm.test_texts import plain_contamination, plain_spans

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    benchmark = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    at = docs
    for name, stage in p.STAGES:
        out = stage(spark, at, DATA)
        rows_ = [(r.doc_id, r.text) for r in at.select("doc_id", "text").collect()]
        if name == "sentencepieces":
            assert out.count() == len(rows_) and out.where("not round_trip").isEmpty()
            break
        assert out.columns == docs.columns
        left = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            codes = functools.cache(lambda token: plain_code(token, model.words, model.stems))
            assert set(left) == {d for d, t in rows_ if not model.weights or plain_score(t, model, codes) < 0.7}
        elif name == "near_dedup":
            assert set(left) == {r[0] for r in plain_components(rows_, 5, 80) if r[3]}
        elif name == "decontamination":
            assert set(left) == {r[0] for r in plain_contamination(rows_, benchmark) if not r[5]}
        else:
            assert len(left) == len(rows_)
            for d, t in rows_:
                want, at_ = [], 0
                for start, _, _, end in plain_spans(t):
                    if start >= at_:
                        want += [t[at_:start], "[SECRET]"]
                    at_ = max(at_, end)
                assert left[d] == "".join(want) + t[at_:]
            assert secrets.RULES and out.where(F.col("n_chars") != F.length("text")).isEmpty()
        at = spark.createDataFrame(out.collect(), docs.schema)


def test_prefix_pairs_without_a_join_of_all_shingles(spark):
    """Rarity is counted in buckets: every pair that reaches the threshold is found."""
    rng = random.Random(5)
    base = [rng.getrandbits(62) for _ in range(40)]
    sets = [sorted({*rng.sample(base, rng.randrange(30, 41)), *(rng.getrandbits(62) for _ in range(rng.randrange(4)))}) for _ in range(60)]
    rows = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "node long, n long, s array<long>")
    assert near_dedup._frequencies(rows).sum() == sum(map(len, sets))
    got = {(r.a, r.b) for r in near_dedup.prefix_pairs(rows, rows, 0.8).collect()}
    wanted = {(i, j) for j in range(60) for i in range(j) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})}
    assert wanted and wanted <= got
    assert near_dedup.prefix_pairs(rows.limit(0), rows.limit(0), 0.8).count() == 0
