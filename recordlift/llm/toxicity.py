"""Toxicity scores from a learned lexicon, matched through Levenshtein automata.

Lexicon: words, and stems of 4 to 6 letters for languages that inflect, which stand in toxic training documents in
many different surroundings and hardly in others. Surroundings, not documents, are counted, so the words of a text
that was copied a thousand times do not become terms. Terms that stand in toxic documents at least four times as
often as in others are candidates, however many: their surroundings are counted and tested on Spark, for `PART` of
them at a time, and only terms that pass every test come to the driver. The lexicon is a trie; the Levenshtein automaton of every term
(one edit anywhere, swapped neighbours being one) is intersected with it on the fly: a state is a set of (trie node,
edits, letter awaited after a swap), made once when first reached, so a word is read once whatever the number of
terms. Signs that mask letters (f**l) stand for any letter. Matcher's default is narrower: same first letter, 5
letters or more, no swaps, no masks; learn() and score() use the wide one.

A lexicon of over `LEXICON_BYTES` is a trie for each part of it. A task then gathers the different tokens of many texts,
up to `TOKENS` bytes of them, and looks them up in one part after the other; the best code of any part counts, which
is what one trie of all terms gives. Parts come to the driver one at a time, in the terms' order.

Scores: a hit weighs as evidence of abuse or, where quotation marks or a reporting word stand within 3 words of it,
as quotation; a misspelled hit counts apart, and one of a term under 5 letters, which honest words often resemble,
apart from both, so that the fit decides what each is worth. The lexicon is gathered from all training rows. Only the logistic model
over the counts is fitted on a bounded sample of them (`max_rows`, by smallest hash of doc_id). Labels are taken only from
rows whose crc32(doc_id as text) mod 3 is not 1, and only texts are inputs of a score.

Defined results: null and empty texts have no words and the score of a document without a hit; a null doc_id is not
held out and never trains; bytes that are no UTF-8 become U+FFFD; labels that repeat a doc_id count as toxic if any does, null ones not at all; repeated
rows get equal scores; without labels of both kinds every score is 0; an empty table gives an empty result; further
columns are ignored by score() and kept by reject().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlift.llm.common import Table, documents, id_and_bytes, plainly_named, released, sliced, stored, texts_of

MAX_ROWS, THRESHOLD = 20_000, 0.7
#: candidate terms whose surroundings are counted in one pass
PART = 500_000
#: bytes of terms in one trie; one of random words took 160 times as much memory, without the automaton's states
LEXICON_BYTES = 2 << 20
#: bytes of different tokens, and of texts, that are looked up together where the lexicon has several parts
TOKENS, TEXTS = 24 << 20, 64 << 20
#: labels up to which their ids go to the texts instead of the texts to them; the rows are the same either way
SENT_LABELS = 5_000_000
#: entries of a task's table of counts before it is sent on
COUNTS = 150_000
#: bytes of a task's table of tokens
KNOWN = 112 << 20
#: members of all state sets of an automaton before it is begun anew
STATES = 300_000
STEMS = (4, 5, 6)
# fixed values: words that report speech
REPORTING = frozenset("said says wrote writes called calls quoted quote quotes word term sagte schrieb nannte zitat dit écrit appelé cita dijo llamó".split())
_QUOTES = '"“”„«»‹›'
_EDGES = re.compile(r"^\W+|\W+$")
MASKS = frozenset("*#$%@!•?_+×✱")
# signs that end a sentence or set off a word mask nothing at its end
_MASKED_EDGES = re.compile(r"^[^\w*#$%@•×✱]+|[^\w*#$%@•×✱]+$")


def word_of(token: str) -> str:
    return _EDGES.sub("", token)


def masked_of(token: str) -> str:
    """The token with the signs that may mask its first or last letters."""
    return _MASKED_EDGES.sub("", token)


class Matcher:
    """The lexicon's trie with lazily determinised Levenshtein automata."""

    def __init__(self, words: Sequence[str], stems: Sequence[str], edits: int = 1, wide: bool = False):
        self.edits, self.wide = edits, wide
        self.children: list[dict[str, int]] = [{}]
        self.word_end, self.stem_end, self.fuzzy = [False], [False], [False]
        for terms, ends in ((words, "word_end"), (stems, "stem_end")):
            for term in terms:
                node = 0
                for ch in term:
                    nxt = self.children[node].get(ch)
                    if nxt is None:
                        nxt = self.children[node][ch] = len(self.children)
                        self.children.append({})
                        self.word_end.append(False)
                        self.stem_end.append(False)
                        self.fuzzy.append(False)
                    node = nxt
                getattr(self, ends)[node] = True
                if ends == "word_end" and len(term) >= 5:
                    self.fuzzy[node] = True
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        #: for each state: the next one by letter; ends[state]: exact stem, exact word, long misspelled, short misspelled, masked
        self.step: list[dict[str, int]] = []
        self.ends: list[tuple[bool, bool, bool, bool, bool]] = []
        self.n_steps = self.n_members = 0
        self.start = self._known(self._closed({(0, 0, "")}))

    def _known(self, state: frozenset) -> int:
        got = self.ids.get(state)
        if got is None:
            got = self.ids[state] = len(self.sets)
            self.sets.append(state)
            self.n_members += len(state) + 10
            self.step.append({})
            ends = [(n, e) for n, e, wait in state if not wait]
            self.ends.append((
                any(e == 0 and self.stem_end[n] for n, e in ends), any(e == 0 and self.word_end[n] for n, e in ends),
                any(self.fuzzy[n] for n, _ in ends), self.wide and any(self.word_end[n] and not self.fuzzy[n] for n, _ in ends),
                any(e == 0 and self.word_end[n] for n, e in ends),
            ))
        return got

    def _closed(self, states: set[tuple[int, int, str]]) -> frozenset:
        """With letters of a term left out of the text; the first one only if wide."""
        todo = list(states)
        while todo:
            node, e, wait = todo.pop()
            if e < self.edits and (node or self.wide) and not wait:
                for child in self.children[node].values():
                    if (child, e + 1, "") not in states:
                        states.add((child, e + 1, ""))
                        todo.append((child, e + 1, ""))
        return frozenset(states)

    def _next(self, state: frozenset, ch: str) -> frozenset:
        out: set[tuple[int, int, str]] = set()
        mask = self.wide and ch in MASKS
        for node, e, wait in state:
            if wait:
                if ch == wait:
                    out.add((node, e, ""))
                continue
            own = self.children[node]
            if mask:
                out.update((c, e, "") for c in own.values())
            elif (child := own.get(ch)) is not None:
                out.add((child, e, ""))
            if e < self.edits and (node or self.wide):
                out.add((node, e + 1, ""))
                out.update((c, e + 1, "") for c in own.values())
                if self.wide:
                    out.update((second, e + 1, a) for a, c in own.items() if a != ch and (second := self.children[c].get(ch)) is not None)
        return self._closed(out)

    def match(self, word: str) -> int:
        """0: no term; 1: a term or a word that begins with a stem; 2: a misspelled or masked term; 3: a misspelled term of under 5 letters."""
        if self.n_steps > 200_000 or self.n_members > STATES:
            self._reset()
        state, stem = self.start, False
        signs = sum(ch in MASKS for ch in word) if self.wide else 0
        for ch in word:
            nxt = self.step[state].get(ch)
            if nxt is None:
                nxt = self.step[state][ch] = self._known(self._next(self.sets[state], ch))
                self.n_steps += 1
            state = nxt
            if not self.sets[state]:
                break
            stem = stem or self.ends[state][0]
        _, exact, long, short, masked = self.ends[state]
        if signs:
            # a mask in every place is no word; more edits beside masks only where most letters are there
            return 2 if signs < len(word) and (masked or long and 2 * signs < len(word)) else 0
        return 1 if stem or exact else 2 if long else 3 if short else 0

    def match_token(self, token: str) -> int:
        """The better of the token's word and, if wide, the word with its masking signs."""
        word = word_of(token)
        code = self.match(word)
        if self.wide and code != 1 and (other := masked_of(token)) != word:
            return min((c for c in (code, self.match(other)) if c), default=0)
        return code


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...]
    stems: tuple[str, ...]
    weights: tuple[float, ...]  # intercept first; empty: no evidence, score 0
    more: tuple[Broadcast, ...] = ()  # words and stems of the lexicon's further parts

    def lexicon(self) -> Iterator[tuple[Sequence[str], Sequence[str]]]:
        yield self.words, self.stems
        for part in self.more:
            yield part.value


class Told:
    """Codes of tokens, looked up in the lexicon's parts one after the other."""

    def __init__(self, tokens: set[str], model: Model):
        self.codes: dict[str, int] = {}
        for words, stems in model.lexicon():
            matcher = Matcher(words, stems, wide=True)
            for token in tokens:
                if code := matcher.match_token(token):
                    self.codes[token] = min(code, self.codes.get(token, code))

    def match_token(self, token: str) -> int:
        return self.codes.get(token, 0)


N_FEATURES = 7


def features_of(text: str, matcher: Matcher | Told, known: dict[str, int]) -> list[float]:
    tokens = text.lower().split()
    hits = []
    for i, token in enumerate(tokens):
        code = known.get(token)
        if code is None:
            code = known.recall(token, 2 * len(token)) if isinstance(known, Table) else None
            if code is None:
                code = matcher.match_token(token)
                if isinstance(known, Table):
                    known.keep(token, code, 2 * len(token))
                else:
                    known[token] = code
        if code:
            hits.append((i, code))
    plain = quoted = fuzzy = short = 0
    kinds = set()
    for i, code in hits:
        if code == 3:
            short += 1
            continue
        near = tokens[max(0, i - 3) : i + 4]
        if code == 2:
            fuzzy += 1
        elif any(q in t for t in near for q in _QUOTES) or any(word_of(t) in REPORTING for t in near):
            quoted += 1
        else:
            plain += 1
        kinds.add(word_of(tokens[i])[:4])
    return [math.log1p(plain), float(plain >= 2), math.log1p(quoted), math.log1p(fuzzy), float(min(3, len(kinds))), min(1.0, 20 * (plain + quoted) / max(1, len(tokens))), math.log1p(short)]


def _terms(word: str) -> list[str]:
    return ["=" + word] + [word[:k] for k in STEMS if len(word) > k]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sent(counts: Counter) -> Iterator[pa.RecordBatch]:
        for rows in batched(counts.items(), 20_000):
            terms, toxic, clean = zip(*((t, n if label else 0, 0 if label else n) for (t, label), n in rows), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], names=["term", "toxic", "clean"])

    counts: Counter = Counter()
    known = Table(KNOWN)

    def terms_of(token: str) -> list[str]:
        word = word_of(token)
        terms = _terms(word) if 3 <= len(word) <= 24 and word.isalpha() else []
        return known.keep(token, terms, 300)

    for whole in batches:
        for batch in sliced(whole):
            for label, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                found: set[str] = set()
                for token in set(text.lower().split()):
                    terms = known.get(token)
                    found.update(terms_of(token) if terms is None else terms)
                counts.update((t, label) for t in found)
                if len(counts) > COUNTS:
                    yield from sent(counts)
                    counts.clear()
    yield from sent(counts)
    released()


def _surroundings(wanted: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Table(KNOWN)

        def terms_of(token: str) -> list[str]:
            return known.keep(token, [t for t in _terms(word_of(token)) if t in wanted], 100)

        for whole in batches:
            for batch in sliced(whole):
                seen = set()
                for label, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                    tokens = ["", *text.lower().split(), ""]
                    for i, token in enumerate(tokens[1:-1], 1):
                        terms = known.get(token)
                        if terms := terms_of(token) if terms is None else terms:
                            around = xxhash.xxh64_intdigest(f"{word_of(tokens[i - 1])}\0{word_of(tokens[i + 1])}") >> 1
                            seen.update((t, label, around) for t in terms)
                terms, labels, around = zip(*seen, strict=True) if seen else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(labels, pa.int32()), pa.array(around, pa.int64())], names=["term", "label", "around"])
        released()

    return run


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """label, text, h of all labelled documents that are not held out, each text once; h is the smallest hash of doc_id."""
    usable = labels.where("doc_id is not null and toxic is not null").where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    if usable.count() <= SENT_LABELS:
        usable = F.broadcast(usable)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(usable, "doc_id").where("text is not null")
    return rows.groupBy(F.sha2("text", 256)).agg(F.max("label").alias("label"), F.first("text").alias("text"), F.min(F.xxhash64("doc_id")).alias("h")).select("label", "text", "h")


def _evidence(toxic: Column, clean: Column, share: float) -> Column:
    """Log-likelihood ratio of a term's counts against the share of toxic text."""
    n = toxic + clean
    got = lambda k, q: F.when(k > 0, k * F.log(k / (n * q))).otherwise(0.0)
    return 2 * (got(toxic, share) + got(clean, 1 - share))


def strong_terms(train: DataFrame, candidates: DataFrame, share: float, part: int = PART) -> DataFrame:
    """The candidates (term) whose distinct surroundings pass all tests."""
    found = candidates.limit(0)
    parts = candidates.count() // part + 1
    for k in range(parts):
        wanted = frozenset(r.term for r in candidates.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).toLocalIterator())
        if not wanted:
            continue
        around = train.mapInArrow(_surroundings(wanted), "term string, label int, around long").distinct()
        counts = around.groupBy("term").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean"))
        passed = counts.where("toxic >= 3 and toxic >= 4 * clean").where(_evidence(F.col("toxic"), F.col("clean"), share) >= 12).select("term")
        found = found.unionByName(stored(passed, "toxicity-strong"))
    return found


def lexicon_parts(strong: DataFrame, most_bytes: int) -> Iterator[tuple[list[str], list[str]]]:
    """Words and stems in parts of at most most_bytes, one at least. A stem that begins with another is left out: the
    other, which comes before it in order, finds whatever it finds."""
    words, stems, size, last = [], [], 0, None
    for (term,) in strong.orderBy("term").toLocalIterator():
        if term[0] != "=":
            if last and term.startswith(last):
                continue
            last = term
        own = len(term.encode())
        if size and size + own > most_bytes:
            yield words, stems
            words, stems, size = [], [], 0
        size += own
        if term[0] == "=":
            words.append(term[1:])
        else:
            stems.append(term)
    yield words, stems


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, part: int = PART, most_bytes: int = LEXICON_BYTES) -> Model:
    whole = stored(training_rows(docs, labels), "toxicity-train")
    train = whole.select("label", "text")
    sizes = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model((), (), ())
    share = sizes[1] / (sizes[0] + sizes[1])
    counts = train.mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    candidates = stored(counts.where("toxic >= 2 and toxic >= 4 * clean").select("term"), "toxicity-terms")
    parts = lexicon_parts(strong_terms(train, candidates, share, part), most_bytes)
    words, stems = next(parts)
    model = Model(tuple(words), tuple(stems), (), tuple(docs.sparkSession.sparkContext.broadcast(p) for p in parts))
    last = whole.select("h").orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    rows = whole.where(F.col("h") <= last).select("label", "text").mapInArrow(_featured_rows(model), "label int, f array<double>").collect()
    x, y = np.array([r.f for r in rows]), np.array([r.label for r in rows], float)
    return replace(model, weights=tuple(fit_logistic(x, y)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> list[float]:
    """Newton steps on the ridge-penalised log-likelihood; the intercept is not penalised."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + penalty * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w.tolist()


def _together(batches: Iterator[pa.RecordBatch], column: str | int) -> Iterator[tuple[list[pa.RecordBatch], set[str]]]:
    """Batches whose tokens are looked up together, and these tokens."""
    group, tokens, room, size = [], set(), TOKENS, 0
    for whole in batches:
        for batch in sliced(whole):
            for text in texts_of(batch.column(column)):
                new = set(text.lower().split()) - tokens
                room -= sum(map(len, new))
                tokens |= new
            group.append(batch)
            size += batch.nbytes
            if room < 0 or size > TEXTS:
                yield group, tokens
                group, tokens, room, size = [], set(), TOKENS, 0
    if group:
        yield group, tokens


def featured(batches: Iterator[pa.RecordBatch], column: str | int, model: Model) -> Iterator[tuple[pa.RecordBatch, Iterator[list[float]]]]:
    """Batches, each with the features of its texts."""
    known = Table(KNOWN)
    try:
        if model.more:
            for group, tokens in _together(batches, column):
                told = Told(tokens, model)
                for batch in group:
                    yield batch, (features_of(t, told, {}) for t in texts_of(batch.column(column)))
        else:
            matcher = Matcher(model.words, model.stems, wide=True)
            for whole in batches:
                for batch in sliced(whole):
                    yield batch, (features_of(t, matcher, known) for t in texts_of(batch.column(column)))
    finally:
        released(known)


def _featured_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, features in featured(batches, 1, model):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(features), pa.list_(pa.float64()))], names=["label", "f"])

    return run


def _scores(features: Iterator[list[float]], weights: tuple[float, ...]) -> list[float]:
    if not weights:
        return [0.0 for _ in features]
    sums = (weights[0] + sum(w * f for w, f in zip(weights[1:], own, strict=True)) for own in features)
    return [1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) for z in sums]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, features in featured(batches, 1, model):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(features, model.weights), pa.float64())], names=["doc_id", "score"])

    rows = id_and_bytes(docs).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, all columns kept."""
    plain, text = plainly_named(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, features in featured(batches, text, model):
            yield batch.filter(pa.array([s < threshold for s in _scores(features, model.weights)], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
