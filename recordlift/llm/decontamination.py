"""Benchmark decontamination with one Aho-Corasick automaton whose letters are words.

A window is 13 consecutive words of an item, or the whole item if it has fewer. Windows of one item share 12 of 13
words, so the automaton doesn't hold them one by one: it holds each item's words once, in blocks of 7 that begin at every
7th word, of which any window contains one. A word is one letter, a code of 7 bits. A document is normalised to words and
scanned once; where a block is found, the up to 7 windows around it are looked up by hash among the benchmark's windows
and compared with their text, so codes and hashes only narrow the search. Hit words are mapped through their positions
to the original text.

The items are sent to the tasks, so they are measured first. Beyond `max_bytes` they are dealt into parts of at most
that size (an item that alone is larger is a part). The rows are then written once with a number of their own, every
part is scanned on its own, and the parts' hits are joined by that number, so the results are the same for any number
of parts. The hits of a part are written before the next one is read: the driver holds one part at a time.

Defined results: a null or empty text has no words; null or empty items have no windows; an item with a null
item_id takes no part; repeated items count once; a document is judged by itself, so ties and repeated rows each
get their row; an empty benchmark marks nothing; further columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlift.llm.common import bytes_of, documents, folded_words, id_and_bytes, plainly_named, released, row_map, sha256_hex, sliced, stored

WINDOW = 13
#: bytes of items in one automaton; for 16 MB of random words it took 15 times as much memory, windows included
MAX_BYTES = 16 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

SCHEMA = "doc_id long, n_words long, hits binary, items array<long>, spans string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.int64())), ("spans", pa.string())])


def letters(words: list[bytes]) -> str:
    """One of 128 letters for each word. The automaton looks through a node's letters one by one, so more of them make it
    slow; the 49 bits of a block tell blocks apart well enough."""
    codes = np.fromiter(map(crc32, words), np.uint32, len(words))
    # the product's high bits differ for words that differ little, which a checksum's low bits don't
    return ((codes * np.uint32(0x9E3779B1) >> np.uint32(25)) + 0x30).astype(np.uint8).tobytes().decode("latin-1")


@dataclass(frozen=True)
class Windows:
    """The windows of a benchmark. Equal ones are a group; groups are ordered by hash."""

    width: int
    seed: int
    text: bytes  # each different item's words once, with a space on either side
    ids: list[tuple[int, ...]]  # of each different item
    blocks: dict[str, tuple[int, ...]]  # letters of a block -> lengths of the windows to look for
    hashes: np.ndarray  # of a group
    starts: np.ndarray  # where one of the group stands in the text
    first: np.ndarray  # of the group's share of `items`, and the end of the last one's
    items: np.ndarray  # the items, by their place in `ids`, that each group stands in

    @property
    def block(self) -> int:
        return (self.width + 1) // 2

    def groups(self, pieces: list[bytes]) -> list[int]:
        """The group of each piece of a text, -1 if it's no window."""
        if not pieces or not len(self.hashes):
            return [-1] * len(pieces)
        own = np.fromiter((xxhash.xxh64_intdigest(p, self.seed) for p in pieces), np.uint64, len(pieces))
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        same = self.hashes[at] == own
        return [int(g) if ok and self.text.startswith(p, self.starts[g]) else -1 for p, g, ok in zip(pieces, at, same, strict=True)]


def windows_of(items: Iterable[tuple[int, bytes]], width: int = WINDOW) -> Windows:
    lines: dict[bytes, set[int]] = {}
    for item, text in items:
        if words := folded_words(text or b""):
            lines.setdefault(b" " + b" ".join(words) + b" ", set()).add(item)
    text, ids, block = b"".join(lines), [tuple(sorted(i)) for i in lines.values()], (width + 1) // 2
    blocks: dict[str, tuple[int, ...]] = {}
    starts, ends, owners = array("q"), array("q"), array("q")
    begin = 0
    for nth, line in enumerate(lines):
        words = line.split()
        n, coded = len(words), letters(words)
        length = min(n, width)
        for i in range(0, n - block + 1, block) if n >= width else (0,):
            key = coded[i : i + min(n, block)]
            if length not in (known := blocks.get(key, ())):
                blocks[key] = (*known, length)
        spaces = begin + np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts.extend(spaces[: n - length + 1].tolist())
        ends.extend((spaces[length:] + 1).tolist())
        owners.extend([nth] * (n - length + 1))
        begin += len(line)
    starts, ends, owners = (np.frombuffer(a, np.int64) if a else np.zeros(0, np.int64) for a in (starts, ends, owners))
    for seed in count():
        hashes = np.fromiter((xxhash.xxh64_intdigest(text[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
        order = np.argsort(hashes, kind="stable")
        new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))[: len(order)]
        first = np.flatnonzero(new)
        leads = order[first][np.cumsum(new) - 1]
        repeated = np.flatnonzero(~new)
        if all(text[starts[a] : ends[a]] == text[starts[b] : ends[b]] for a, b in zip(order[repeated], leads[repeated], strict=True)):
            break  # no two different windows have the same hash
    lead = order[first]
    return Windows(width, seed, text, ids, blocks, hashes[lead], starts[lead], np.append(first, len(order)), owners[order])


class Finder:
    """A part's windows with their automaton."""

    def __init__(self, windows: Windows):
        import ahocorasick

        self.windows, self.auto = windows, None
        if windows.blocks:
            self.auto = ahocorasick.Automaton()
            for key, lengths in windows.blocks.items():
                self.auto.add_word(key, (len(key), lengths))
            self.auto.make_automaton()

    def find(self, words: list[bytes]) -> tuple[np.ndarray, list[int]] | None:
        """Which words are hit, and the items that hit them; None if nothing does."""
        if self.auto is None or not words:
            return None
        w, places = self.windows, set()
        for last, (size, lengths) in self.auto.iter(letters(words)):
            start = last - size + 1
            for n in lengths:
                low = max(0, start - w.block + 1) if n == w.width else start
                places.update((s, n) for s in range(low, min(start, len(words) - n) + 1))
        if not places:
            return None
        line = b" " + b" ".join(words) + b" "
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
        ordered, hit, owners = sorted(places), np.zeros(len(words), bool), set()
        groups = w.groups([line[spaces[s] : spaces[s + n] + 1] for s, n in ordered])
        for (s, n), g in zip(ordered, groups, strict=True):
            if g >= 0:
                hit[s : s + n] = True
                owners.add(g)
        items = {i for g in owners for k in w.items[w.first[g] : w.first[g + 1]] for i in w.ids[k]}
        return (hit, sorted(items)) if owners else None


def original_spans(text: bytes, hit: np.ndarray) -> str:
    """start:end of the runs of hit words in the original text, in code points."""
    places = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    at = lambda b: len(text[:b].decode("utf-8", "replace"))
    return ",".join(f"{at(places[a][0])}:{at(places[b - 1][1])}" for a, b in zip(edges[::2], edges[1::2], strict=True))


def scan(doc_id: int, text: bytes, finder: Finder) -> tuple:
    words = folded_words(text)
    if (found := finder.find(words)) is None:
        return doc_id, len(words), b"", [], ""
    hit, items = found
    return doc_id, len(words), np.packbits(hit).tobytes(), items, original_spans(text, hit)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def _part(parts: int):
    return F.pmod(F.xxhash64("item_id"), F.lit(parts))


def _n_parts(items: DataFrame, max_bytes: int) -> int:
    """The least of 1, 2, 4, ... parts of which none with several items is over max_bytes."""
    sizes = stored(items.groupBy("item_id").agg(F.sum(F.octet_length("text") + 8).alias("size")), "decontamination-items")
    parts = 1
    while sizes.groupBy(_part(parts)).agg(F.sum("size").alias("size"), F.count("*").alias("n")).where((F.col("size") > max_bytes) & (F.col("n") > 1)).count():
        parts *= 2
    return parts


def _windows(items: DataFrame, width: int):
    """The windows as a broadcast variable."""
    return items.sparkSession.sparkContext.broadcast(windows_of(((r.item_id, bytes(r.text)) for r in items.toLocalIterator()), width))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows as written to the shared folder, each with a number, and the name of its column."""
    name = "_number"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "decontamination-rows"), name


def part_hits(rows: DataFrame, items: DataFrame, parts: int, width: int) -> DataFrame:
    """number, n_words, n_hit, hits, items of the rows (number, text) that any part hits."""
    found = None
    for k in range(parts):
        windows = _windows(items.where(_part(parts) == k), width)
        part = stored(rows.mapInArrow(row_map(scan, _OUT, lambda windows=windows: Finder(windows.value)), SCHEMA).where("hits <> X''"), "decontamination-hits")
        found = part if found is None else found.unionByName(part)
    whole = found.groupBy("doc_id", "n_words").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))
    return whole.mapInArrow(row_map(_merge, _HITS), "number long, n_words long, n_hit long, hits binary, items array<long>")


_HITS = pa.schema([("number", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.int64()))])


def _merge(number: int, n_words: int, hits: list[bytes], items: list[list[int]]) -> tuple:
    bits = np.zeros((n_words + 7) // 8, np.uint8)
    for h in hits:
        bits |= np.frombuffer(h, np.uint8)
    return number, n_words, int(np.unpackbits(bits).sum()), bits.tobytes(), sorted({i for x in items for i in x})


def _told(doc_id: int, text: bytes, hits: bytes | None, items: list[int] | None) -> tuple:
    n_words = len(folded_words(text))
    hit = np.unpackbits(np.frombuffer(hits, np.uint8), count=n_words).astype(bool) if hits else None
    return doc_id, n_words, hits or b"", items or [], original_spans(text, hit) if hits else ""


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans: a row for each document."""
    items = _items(benchmark)
    parts = _n_parts(items, max_bytes)
    if parts == 1:
        windows = _windows(items, width)
        out = id_and_bytes(docs).mapInArrow(row_map(scan, _OUT, lambda: Finder(windows.value)), SCHEMA)
    else:
        rows, number = numbered(id_and_bytes(docs))
        hits = part_hits(rows.select(number, "text"), items, parts, width).withColumnRenamed("number", number)
        out = rows.join(hits, number, "left").select("doc_id", "text", "hits", "items").mapInArrow(row_map(_told, _OUT), SCHEMA)
    return out.mapInArrow(row_map(_digest, _FINAL), FINAL).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")


FINAL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, items array<long>, spans string"
_FINAL = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("items", pa.list_(pa.int64())), ("spans", pa.string())])


def _digest(doc_id: int, n_words: int, hits: bytes, items: list[int], spans: str) -> tuple:
    n_hit = int(np.unpackbits(np.frombuffer(hits, np.uint8)).sum()) if hits else 0
    return doc_id, n_words, n_hit, len(items), sha256_hex(",".join(sorted(map(str, items))).encode()), items, spans


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents that are not contaminated, all columns kept. Each row is judged by itself; with a benchmark too
    large for one automaton, rows are told apart by a number of their own."""
    items = _items(benchmark)
    parts = _n_parts(items, max_bytes)
    plain, text = plainly_named(docs)
    if parts > 1:
        rows, number = numbered(plain)
        texts = rows.select(number, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
        bad = part_hits(texts, items, parts, width).where("20 * n_hit >= n_words")
        return rows.join(bad.select(F.col("number").alias(number)), number, "left_anti").select(*plain.columns).toDF(*docs.columns)
    windows = _windows(items, width)

    def run(batches):
        finder = Finder(windows.value)
        for whole in batches:
            for batch in sliced(whole):
                judged = (_digest(*scan(0, t, finder)) for t in bytes_of(batch.column(text)))
                yield batch.filter(pa.array([not (n_hit > 0 and 20 * n_hit >= n_words) for _, n_words, n_hit, *_ in judged], pa.bool_()))
        released()

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP3_SQL = r"""
WITH folded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, len(w[i:i + 12]) AS n, array_to_string(w[i:i + 12], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM folded, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM folded LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
