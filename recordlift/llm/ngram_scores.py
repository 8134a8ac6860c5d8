"""Language-model scores of whole texts from a log-frequency Bloom filter of n-gram counts.

Counting: each task sums up the n-grams of a chunk of training texts (orders 1 to 3; the end of a text is a token) and
sends them, sorted and packed, to parts by the leading bits of their hashes. A part of some 8 MB of text adds them up
and makes its share of the filter: a count c is quantised to level 1 + floor(log2(c / least)), and the n-gram is put in
once with each number from 1 to its level. N-grams of order 2 and 3 need two occurrences to be in the filter; words one.

Scoring: a level is found by probing 1, 2, ... until one is absent; n-grams whose own parts are absent count as absent,
which takes most false positives away. With c the mean of a level's counts and P0 the base's smoothing of single words,
    P(w | h) = (c(hw) + mu * P(w | shorter h)) / (c(h) + mu).

The filter grows with the corpus. Up to FILTER_BYTES it is broadcast and texts are scored where they are read. A larger
one isn't sent anywhere: the n-grams that a chunk of texts asks for travel to the filter's parts, and their levels back.
Both ways give the same scores.

The base score needs exact counts of all words. Those of the most frequent words (at most FREQUENT, from a histogram of
all counts) are broadcast; the rest of the tokens, each of a rare or unknown word, meet the exact counts in a join.

Words are told apart by 64 bits of hash, n-grams by 40 bits within their part. Parts are at most 2 ** 16; beyond 0.5 TB
of text they grow, and with them the memory of a task that adds one up.

Defined results: a null or empty text has one token, its end; a null doc_id counts as empty text in the hash that holds
rows out; rows that repeat or share an id each get their row and each count; only doc_id and text are read, so further
columns of any name do not matter; an empty table gives an empty result; without training texts all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlift.llm.common import WordHashes, bytes_of, documents, id_and_bytes, released, sliced, stored
from recordlift.llm.substrings import window_hashes

ORDER = 3
#: prior weight of the shorter history's probability, for histories of one and of two words
MU = (1000.0, 20.0)
ADDED = 0.1  #: what the base adds to each count
#: occurrences of a word, and of a longer n-gram, from which the filter holds it
LEAST = (1, 2)
#: bits of the filter for each entry, and hash functions: 0.9 % false positives for one probe
BITS, PROBES = 10, 5
FILTER_BYTES = 96 << 20
FREQUENT = 1 << 20
CHUNK = 1_000_000  #: tokens that a task counts at a time
PART_BYTES = 8 << 20
LOW = 40  #: bits that tell n-grams apart within a part
_END = np.uint64(xxhash.xxh64_intdigest(b"\n"))  # no word holds white space
_ODD, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_hashes = WordHashes()


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the words, A-Z in lower case, and the end."""
    return np.append(_hashes.of(text.lower().split()), _END)


def release() -> None:
    released(_hashes)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MORE
        return x ^ (x >> np.uint64(32))


def masked(grams: np.ndarray, part_bits: int) -> np.ndarray:
    """The bits of the hashes that parts keep."""
    gone = 64 - part_bits - LOW
    return grams >> np.uint64(gone) << np.uint64(gone) if gone > 0 else grams


class Grams:
    """The n-grams of several texts, one behind another: hashes of orders 1 to 3 that end at each token; 0 where a text
    has no such n-gram there."""

    def __init__(self, texts: list[np.ndarray], part_bits: int):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        ids = np.concatenate(texts)
        at = np.arange(len(ids)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.words = window_hashes(ids, 1)
        self.orders = [masked(self.words, part_bits)]
        for width in range(2, ORDER + 1):
            grams = np.zeros(len(ids), np.uint64)
            grams[width - 1 :] = masked(window_hashes(ids, width), part_bits)
            grams[at < width - 1] = 0
            self.orders.append(grams)


def positions(grams: np.ndarray, level: int, size: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
    """The bits of a level's entries in filters of the sizes given."""
    with np.errstate(over="ignore"):
        at = _mixed(grams + _ODD * np.uint64(level))
        step = _mixed(at) | np.uint64(1)
        for _ in range(PROBES):
            yield ((at >> np.uint64(32)) * size) >> np.uint64(32)
            at = at + step


def part_filter(grams: np.ndarray, levels: np.ndarray) -> tuple[bytes, int]:
    """The filter of one part, and its number of bits."""
    n_bits = 64 * -(-int(levels.sum()) * BITS // 64)
    bits = np.zeros(n_bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in positions(grams[levels >= level], level, np.uint64(n_bits)):
            bits[at.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes(), n_bits


class Filter:
    """The filter: parts one behind another, chosen by the leading bits of a hash."""

    def __init__(self, parts: dict[int, tuple[bytes, int]], part_bits: int):
        n = 1 << part_bits
        self.part_bits = part_bits
        self.sizes = np.array([parts.get(p, (b"", 0))[1] for p in range(n)], np.uint64)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int64)
        self.data = np.frombuffer(b"".join(parts[p][0] for p in sorted(parts)), np.uint8)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 for absent ones."""
        out = np.zeros(len(grams), np.uint8)
        part = (grams >> np.uint64(64 - self.part_bits)).astype(np.int64)
        left = np.flatnonzero((grams != 0) & (self.sizes[part] > 0))
        level = 0
        while len(left):
            level += 1
            own = part[left]
            inside = np.ones(len(left), bool)
            live = np.arange(len(left))
            for at in positions(grams[left], level, self.sizes[own]):
                bit = self.starts[own[live]] + at[live].astype(np.int64)
                hit = (self.data[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
                inside[live[~hit]] = False
                live = live[hit]
                if not len(live):
                    break
            left = left[inside]
            out[left] = level
        return out


def level_of(counts: np.ndarray, least: int) -> np.ndarray:
    """1 + floor(log2(count / least)); 0 below `least`."""
    return np.frexp(counts // least)[1].astype(np.int64)


def count_of(levels: np.ndarray, least: int) -> np.ndarray:
    """The mean of the counts that have this level."""
    low = least * np.exp2(levels.astype(np.float64) - 1)
    return np.where(levels > 0, (3 * low - 1) / 2, 0.0)


@dataclass(frozen=True)
class Totals:
    tokens: int
    types: int

    @property
    def scale(self) -> float:
        return self.tokens + ADDED * (self.types + 1)


def log_probabilities(grams: Grams, levels_of, totals: Totals, mu: tuple[float, ...] = MU) -> np.ndarray:
    """log10 P of each token behind up to two of its text."""
    words, inverse = np.unique(grams.orders[0], return_inverse=True)
    count = count_of(levels_of(words), LEAST[0])[inverse]
    p = (count + ADDED) / totals.scale
    history = count  # how often the n-gram of one order less stands, at each token
    for k, order in enumerate(grams.orders[1:]):
        # an n-gram is at most as frequent as the shorter one before it and the one within it
        before = np.concatenate(([0.0], history[:-1]))
        usable = (order != 0) & (before > 0) & (history > 0)
        own = np.zeros(len(order))
        own[usable] = count_of(levels_of(order[usable]), LEAST[1])
        own = np.minimum(own, np.minimum(before, history))
        p = np.where(order != 0, (own + mu[k] * p) / (before + mu[k]), p)
        history = own
    return np.log10(p)


# --- counting ------------------------------------------------------------------------------------------------------


def _planes(x: np.ndarray, width: int) -> bytes:
    """Numbers as planes of bytes, so that the shuffle's compression finds the empty ones."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _packed(grams: np.ndarray, part_bits: int) -> bytes:
    """Sorted masked hashes of one part, as gaps."""
    low = (grams << np.uint64(part_bits)) >> np.uint64(64 - LOW)
    return _planes(np.diff(low, prepend=np.uint64(0)), LOW // 8)


def _unpacked(data: bytes, part: int, part_bits: int) -> np.ndarray:
    low = np.cumsum(_from_planes(data, LOW // 8), dtype=np.uint64)
    return np.uint64(part << (64 - part_bits)) | (low << np.uint64(64 - LOW)) >> np.uint64(part_bits)


def _by_part(grams: np.ndarray, part_bits: int) -> np.ndarray:
    """Where each part begins in sorted hashes."""
    return np.searchsorted(grams >> np.uint64(64 - part_bits), np.arange((1 << part_bits) + 1, dtype=np.uint64))


_COUNTED = pa.schema([("part", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()), ("words", pa.binary()), ("word_counts", pa.binary())])
COUNTED = "part int, grams binary, counts binary, words binary, word_counts binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _counting(part_bits: int):
    """Rows of (text) -> a row for each chunk and part: the n-grams and the words of the chunk with their counts."""

    def flush(texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        made = Grams(texts, part_bits)
        texts.clear()
        longer = np.concatenate(made.orders[1:])
        grams, counts = np.unique(longer[longer != 0], return_counts=True)
        words, word_counts = np.unique(made.words, return_counts=True)
        a, b = _by_part(grams, part_bits), _by_part(words, part_bits)
        for first in range(0, 1 << part_bits, 1024):
            rows = []
            for p in range(first, min(first + 1024, 1 << part_bits)):
                if a[p] < a[p + 1] or b[p] < b[p + 1]:
                    x, y = slice(a[p], a[p + 1]), slice(b[p], b[p + 1])
                    rows.append((p, _packed(grams[x], part_bits), _planes(counts[x], 4), words[y].tobytes(), _planes(word_counts[y], 4)))
            if rows:
                yield _batch(rows, _COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, n = [], 0
        try:
            for whole in batches:
                for batch in sliced(whole):
                    for text in bytes_of(batch.column(0)):
                        texts.append(tokens(text))
                        n += len(texts[-1])
                        if n >= CHUNK:
                            yield from flush(texts)
                            n = 0
            if texts:
                yield from flush(texts)
        finally:
            release()

    return run


_PART = pa.schema([("part", pa.int32()), ("bits", pa.binary()), ("n_bits", pa.int64()), ("words", pa.binary()), ("word_counts", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()), ("histogram", pa.list_(pa.int64()))])
PART = "part int, bits binary, n_bits long, words binary, word_counts binary, tokens long, types long, histogram array<long>"
_STEPS = 40  #: counts that the histogram tells apart: 2 ** 0 to 2 ** 39


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _adding(part_bits: int):
    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        get = lambda name: table[name].to_pylist()
        words, word_counts = _added([np.frombuffer(x, np.uint64) for x in get("words")], [_from_planes(x, 4) for x in get("word_counts")])
        grams, counts = _added([_unpacked(x, part, part_bits) for x in get("grams")], [_from_planes(x, 4) for x in get("counts")])
        often = counts >= LEAST[1]
        grams, levels = np.concatenate((masked(words, part_bits), grams[often])), np.concatenate((level_of(word_counts, LEAST[0]), level_of(counts[often], LEAST[1])))
        bits, n_bits = part_filter(grams, levels)
        histogram = [int((word_counts >= 1 << k).sum()) for k in range(_STEPS)]
        row = (part, bits, n_bits, words.tobytes(), word_counts.tobytes(), int(word_counts.sum()), len(words), histogram)
        return pa.Table.from_batches([_batch([row], _PART)])

    return run


def count_parts(training: DataFrame, part_bits: int) -> DataFrame:
    """The filter and the exact counts of words, a row for each part, written to the shared folder."""
    counted = training.select("text").mapInArrow(_counting(part_bits), COUNTED)
    return stored(counted.groupBy("part").applyInArrow(_adding(part_bits), PART), "ngram-parts")


# --- scoring -------------------------------------------------------------------------------------------------------

_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("row", pa.binary()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
SCORED = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, row binary, rare array<long>, times array<long>"


def _row_key(doc_id: int | None, text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(f"{doc_id}:".encode() + text)


def _scored(docs: list[tuple[int | None, bytes, bool]], texts: list[np.ndarray], grams: Grams, levels_of, totals: Totals, words: np.ndarray, logs: np.ndarray, mu: tuple[float, ...]) -> pa.RecordBatch:
    """Scores of several texts; `words` (sorted) are those whose counts are at hand, as log10(count + ADDED)."""
    first = np.cumsum(grams.sizes) - grams.sizes
    score = np.add.reduceat(log_probabilities(grams, levels_of, totals, mu), first)
    own, inverse = np.unique(grams.words, return_inverse=True)
    at = np.minimum(np.searchsorted(words, own), max(len(words) - 1, 0))
    here = words[at] == own if len(words) else np.zeros(len(own), bool)
    value = np.where(here, logs[at], 0.0)[inverse] if len(words) else np.zeros(len(inverse))
    frequent = here[inverse]
    base = np.add.reduceat(value, first) - grams.sizes * np.log10(totals.scale)
    known = np.add.reduceat(frequent.astype(np.int64), first)
    rows = []
    for k, (doc_id, text, held_out) in enumerate(docs):
        n = int(grams.sizes[k])
        rare, times = [], []
        if known[k] < n:
            mine = slice(first[k], first[k] + n)
            ids, counts = np.unique(grams.words[mine][~frequent[mine]], return_counts=True)
            rare, times = ids.view(np.int64).tolist(), counts.tolist()
        rows.append((doc_id, held_out, n, int(known[k]), float(base[k]), float(score[k]), _row_key(doc_id, text) if rare else None, rare, times))
    return _batch(rows, _SCORED)


def _scoring(filter_sent, frequent_sent, totals: Totals, mu: tuple[float, ...]):
    """Rows of (doc_id, text, held_out) -> SCORED, with the whole filter at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, (words, logs) = filter_sent.value, frequent_sent.value
        try:
            for whole in batches:
                for batch in sliced(whole):
                    docs = list(zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), batch.column(2).to_pylist(), strict=True))
                    texts = [tokens(t) for _, t, _ in docs]
                    yield _scored(docs, texts, Grams(texts, held.part_bits), held.levels, totals, words, logs, mu)
        finally:
            release()

    return run


_ASKED = pa.schema([("chunk", pa.binary()), ("part", pa.int32()), ("grams", pa.binary()), ("texts", pa.binary()), ("size", pa.int64()), ("lengths", pa.binary()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))])
ASKED = "chunk binary, part int, grams binary, texts binary, size long, lengths binary, ids array<long>, held array<boolean>"


def _asking(part_bits: int):
    """Rows of (doc_id, text, held_out) -> for each chunk a row with its texts (part -1), and for each part a row with
    the n-grams whose levels it needs."""

    def flush(docs: list[tuple], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        grams = np.unique(np.concatenate(Grams(texts, part_bits).orders))
        grams = grams[grams != 0]
        data = b"".join(t for _, t, _ in docs)
        lengths = np.array([len(t) for _, t, _ in docs], np.int64).tobytes()
        chunk = xxhash.xxh3_128_digest(repr([(d, h) for d, _, h in docs]).encode() + lengths + data)
        yield _batch([(chunk, -1, None, pa.compress(data, codec="zstd", asbytes=True), len(data), lengths, [d for d, _, _ in docs], [h for _, _, h in docs])], _ASKED)
        edges = _by_part(grams, part_bits)
        rows = [(chunk, p, _packed(grams[a:b], part_bits), None, None, None, None, None) for p, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
        if rows:
            yield _batch(rows, _ASKED)
        docs.clear()
        texts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, texts, n = [], [], 0
        try:
            for whole in batches:
                for batch in sliced(whole):
                    for row in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                        docs.append(row)
                        texts.append(tokens(row[1]))
                        n += len(texts[-1])
                        if n >= CHUNK:
                            yield from flush(docs, texts)
                            n = 0
            if docs:
                yield from flush(docs, texts)
        finally:
            release()

    return run


_ANSWER = pa.schema([("chunk", pa.binary()), ("part", pa.int32()), ("grams", pa.binary()), ("levels", pa.binary())])


def _answering(part_bits: int):
    def run(asked: pa.Table, parts: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _ANSWER.empty_table()
        part = asked["part"][0].as_py()
        held = Filter({part: (parts["bits"][0].as_py(), parts["n_bits"][0].as_py())} if parts.num_rows else {}, part_bits)
        rows = [(chunk, part, data, held.levels(_unpacked(data, part, part_bits)).tobytes()) for chunk, data in zip(asked["chunk"].to_pylist(), asked["grams"].to_pylist(), strict=True)]
        return pa.Table.from_batches([_batch(rows, _ANSWER)])

    return run


def _scoring_chunks(part_bits: int, frequent_sent, totals: Totals, mu: tuple[float, ...]):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        words, logs = frequent_sent.value
        parts = sorted(dict(zip(answers["part"].to_pylist(), zip(answers["grams"].to_pylist(), answers["levels"].to_pylist(), strict=True), strict=True)).items())
        known = np.concatenate([_unpacked(g, p, part_bits) for p, (g, _) in parts])
        levels = np.concatenate([np.frombuffer(x, np.uint8) for _, (_, x) in parts])
        look_up = lambda grams: levels[np.searchsorted(known, grams)]
        out = []
        for data, size, lengths, ids, held in zip(*(chunks[c].to_pylist() for c in ("texts", "size", "lengths", "ids", "held")), strict=True):
            whole = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
            ends = np.cumsum(np.frombuffer(lengths, np.int64)).tolist()
            docs = [(d, whole[a:b], h) for d, h, a, b in zip(ids, held, [0, *ends], ends, strict=False)]
            texts = [tokens(t) for _, t, _ in docs]
            out.append(_scored(docs, texts, Grams(texts, part_bits), look_up, totals, words, logs, mu))
        release()
        return pa.Table.from_batches(out, _SCORED)

    return run


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (words, word_counts, above, below) -> (word, n) for counts in [above, below)."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        for words, counts, above, below in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = np.frombuffer(counts, np.int64)
            mine = (n >= above) & (n < below)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int64)[mine]), pa.array(n[mine])], schema=schema)


def _word_counts(parts: DataFrame, above: int, below: int) -> DataFrame:
    return parts.select("words", "word_counts", F.lit(above).alias("above"), F.lit(below).alias("below")).mapInArrow(_words_of, "word long, n long")


def held_out(doc_id: Column, of: int = 10) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == 0


def score_texts(docs: DataFrame, mu: tuple[float, ...] = MU, filter_bytes: int = FILTER_BYTES, frequent: int = FREQUENT, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each document, from a model of
    the documents that aren't held out."""
    spark = docs.sparkSession
    rows = id_and_bytes(docs).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part_bits = min(16, max(2, (size // part_bytes).bit_length()))
    parts = count_parts(rows.where("not held_out"), part_bits)

    many = [F.coalesce(F.sum(F.get("histogram", F.lit(k))), F.lit(0)).alias(f"h{k}") for k in range(_STEPS)]
    facts = parts.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"), F.sum(F.octet_length("bits")).alias("bytes"), *many).first()
    totals = Totals(facts.tokens or 0, facts.types or 0)
    above = next(1 << k for k in range(_STEPS) if facts[f"h{k}"] <= frequent)
    # at most `frequent` words come to the driver
    table = _word_counts(parts, above, 1 << 62).toArrow()
    order = np.argsort(words := table["word"].to_numpy().view(np.uint64))
    sent = spark.sparkContext.broadcast((words[order], np.log10(table["n"].to_numpy()[order] + ADDED)))

    if (facts.bytes or 0) <= filter_bytes:
        held = parts.select("part", "bits", "n_bits").toArrow()
        held = Filter({p: (b, n) for p, b, n in zip(*(held[c].to_pylist() for c in ("part", "bits", "n_bits")), strict=True)}, part_bits)
        scored = rows.mapInArrow(_scoring(spark.sparkContext.broadcast(held), sent, totals, mu), SCORED)
    else:
        asked = stored(rows.mapInArrow(_asking(part_bits), ASKED), "ngram-questions")
        answers = asked.where("part >= 0").select("chunk", "part", "grams").groupBy("part").cogroup(parts.select("part", "bits", "n_bits").groupBy("part")).applyInArrow(_answering(part_bits), "chunk binary, part int, grams binary, levels binary")
        scored = asked.where("part < 0").drop("part", "grams").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scoring_chunks(part_bits, sent, totals, mu), SCORED)
    scored = stored(scored, "scores")

    rare = scored.where("row is not null").select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    counted = rare.join(_word_counts(parts, 1, above), "word", "left")
    sums = counted.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ADDED)).alias("rare_base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum("times").alias("rare_tokens")
    )
    # equal rows have one key; each has its share of the sum
    share = (F.col("n_tokens") - F.col("known")) / F.col("rare_tokens")
    # rows without rare words have no key and take no part in the join
    done = scored.where("row is not null").drop("rare", "times").join(sums, "row", "left")
    base = F.col("base") + F.coalesce(F.col("rare_base") * share, F.lit(0.0))
    known = F.col("known") + F.coalesce(F.round(F.col("rare_known") * share).cast("long"), F.lit(0))
    shown = lambda rows, n_known, base: rows.select("doc_id", "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
    return shown(scored.where("row is null"), F.col("known"), F.col("base")).unionByName(shown(done, known, base))


def op12_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
