"""Spelling variants: words of the corpus that differ by one inserted, deleted or replaced character, and the form that
each rare one is a variant of.

One edit leaves one half of a word as it is: the first at the other word's start, or the second at its end. The halves
of all words are the patterns of Aho-Corasick automata, dealt by a hash of the half into shards of bounded size. A word
is sent to the (at most four) shards that can hold a half of its start or end, for words one character shorter, equally
long or one longer; the shard's automaton scans it once, a pattern counts where it stands at its own offset and belongs
to a word of compatible length, and the rest is compared exactly. A pair that both halves find is the first half's.

Halves that more than HOT words share are no patterns, since each word that holds one would be compared with all of
them. There the rests beside the half are joined by what is left when one character is deleted: rests that differ by a
replacement share such a key with its place, others where one is the other's key. A key has at most as many words as
the alphabet (90 characters) allows at its places, however many share the half. Both ways are exact, so the result
doesn't depend on HOT.

Only counts travel: words are counted in each task before they are shuffled, and a word's near words are summed up
where they are found. Forms grow tenfold in count at each step, so the chain to a root is as short as the logarithm of
the largest count; it is followed by doubling.

All other joins are sorted ones (SORTED): Spark sizes these tables by their compressed files or as they are before an
explode, a hundredth of what they are, and would send gigabytes through the driver as long as that looks small.

Defined results: null and empty texts have no words; a null doc_id counts as empty text in the hash; rows that repeat
count as often as they stand; only doc_id and text are read, so further columns of any name do not matter; an empty
table, or one without such words, gives an empty result. Ties for the form go to the smallest word in code-point order.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlift.llm.common import documents, id_and_bytes, sliced, stored, texts_of

LEAST = 7  #: code points of a word
TIMES = 2  #: occurrences of a word
FACTOR = 10  #: a form is at least so many times as frequent
DAMAGE = 31  #: where this divides a run's hash, the run loses a character
#: words that share a half, up to which they are compared one by one; words of a shard; words that a task counts at a time
HOT, PER_SHARD, HELD = 64, 5_000, 200_000
#: bytes of hot halves that are sent to all tasks, and those that one takes there besides its text
MOST_SENT, PER_SENT = 32 << 20, 300
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEFT, RIGHT = 0, 1
SORTED = "merge"  #: hint for joins of which neither side may be broadcast

_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _counted(least: int, damage: int | None):
    """Rows of (doc_id, text) -> (word, n), summed up within the task."""

    def flush(counts: Counter) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=_COUNTS)
        counts.clear()
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
        counts: Counter = Counter()
        for whole in batches:
            for batch in sliced(whole):
                for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                    found = Counter(runs.findall(text.translate(_LOWER)))
                    if damage is None:
                        counts.update(found)
                        continue
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % damage == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < least:
                                continue
                        counts[word] += n
                if len(counts) > HELD:
                    yield flush(counts)
        if counts:
            yield flush(counts)

    return run


def word_counts(docs: DataFrame, least: int = LEAST, times: int = TIMES, damage: int | None = None) -> DataFrame:
    """word, n: runs of letters in lower case, of `least` code points and `times` occurrences or more."""
    rows = id_and_bytes(docs).mapInArrow(_counted(least, damage), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def half(word: str) -> int:
    return len(word) // 2


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells the two apart."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    k = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[k + (len(short) == len(long)) :] == long[k + 1 :]


_NEAR = pa.schema([("word", pa.string()), ("cnt", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
NEAR = "word string, cnt long, best_n long, best string"


def _scan(table: pa.Table) -> pa.Table:
    """One shard: the words whose halves it holds (rows with a side), against the words sent to it."""
    automaton, owners, words = ahocorasick.Automaton(), {}, {}
    for side, word, n in zip(*(table[c].to_pylist() for c in ("side", "word", "n")), strict=True):
        if side is None:
            words[word] = n
        else:
            segment = word[: half(word)] if side == LEFT else word[half(word) :]
            owners.setdefault(segment, ([], []))[side].append((word, n))
    for segment, held in owners.items():
        automaton.add_word(segment, (len(segment), *held))
    rows = []
    if owners:
        automaton.make_automaton()
    for v in words if owners else ():
        near = []
        for end, (size, left, right) in automaton.iter(v):
            if left and end == size - 1:
                near += [(-n, u) for u, n in left if abs(len(u) - len(v)) < 2 and one_edit(u, v)]
            if right and end == len(v) - 1:
                near += [(-n, u) for u, n in right if abs(len(u) - len(v)) < 2 and not v.startswith(u[: half(u)]) and one_edit(u, v)]
        if near:
            n, best = min(near)
            rows.append((v, len(near), -n, best))
    if not rows:
        return _NEAR.empty_table()
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NEAR, strict=True)], schema=_NEAR)


def _segment(side: int, word: Column, length: Column) -> Column:
    """The half that a word of this length would share with the given one."""
    k = F.floor(length / 2).cast("int")
    return F.substr(word, F.lit(1), k) if side == LEFT else F.substr(word, F.length(word) - (length - k) + 1, length - k)


def _halves(words: DataFrame) -> DataFrame:
    """side, segment, word, n: both halves of each word."""
    both = F.array(*(F.struct(F.lit(s).alias("side"), _segment(s, F.col("word"), F.length("word")).alias("segment")) for s in (LEFT, RIGHT)))
    return words.select(F.explode(both).alias("h"), "word", "n").select("h.side", "h.segment", "word", "n")


def _sent(words: DataFrame, least: int) -> DataFrame:
    """The same for the halves that words of compatible length would share with a word."""
    lengths = [F.length("word") + d for d in (-1, 0, 1)]
    each = F.array(*(F.when(x >= least, F.struct(F.lit(s).alias("side"), _segment(s, F.col("word"), x).alias("segment"))) for s in (LEFT, RIGHT) for x in lengths))
    return words.select(F.explode(F.array_distinct(F.array_compact(each))).alias("h"), "word", "n").select("h.side", "h.segment", "word", "n")


def _less_one(rest: Column) -> Column:
    """What is left of a text without one character, for each place."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(rest), F.lit(1))), lambda k: F.concat(F.substr(rest, F.lit(1), k - 1), F.substr(rest, k + 1)))


def _keys(rest: Column, owner: bool) -> Column:
    """Keys of a rest: with its place what remains for a replacement, and for an insertion the rest of one side beside
    what remains of the other."""
    less = _less_one(rest)
    key = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("key"))
    placed = F.transform(less, lambda x, k: F.struct(k.cast("int").alias("kind"), x.alias("key")))
    ones = F.transform(F.array_distinct(less), lambda x: key(-1 if owner else -2, x))
    return F.filter(F.concat(placed, ones, F.array(key(-2 if owner else -1, rest))), lambda x: (F.length(rest) > 0) | (x["kind"] < 0))


def _in_hot(patterns: DataFrame, sent: DataFrame) -> DataFrame:
    """NEAR for pairs that share a hot half: equal keys beside the half."""
    rest = lambda word, segment, side: F.when(side == LEFT, F.substr(word, F.length(segment) + 1)).otherwise(F.substr(word, F.lit(1), F.length(word) - F.length(segment)))

    def keyed(rows: DataFrame, owner: bool, word: str, n: str) -> DataFrame:
        named = rows.select("side", "segment", F.col("word").alias(word), F.col("n").alias(n), rest(F.col("word"), F.col("segment"), F.col("side")).alias("rest"))
        return named.select("side", "segment", word, n, F.explode(_keys(F.col("rest"), owner)).alias("k")).select("side", "segment", word, n, "k.kind", "k.key")

    pairs = keyed(sent, False, "word", "own_n").join(keyed(patterns, True, "other", "other_n").hint(SORTED), ["side", "segment", "kind", "key"])
    u, v = F.col("other"), F.col("word")
    first = F.startswith(v, F.substr(u, F.lit(1), F.floor(F.length(u) / 2).cast("int")))
    pairs = pairs.where((u != v) & ((F.col("side") == LEFT) | ~first))
    return _summed(pairs.select("word", F.lit(1).cast("long").alias("cnt"), F.col("other_n").alias("best_n"), u.alias("best")))


def _summed(near: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return near.groupBy("word").agg(F.sum("cnt").alias("cnt"), best.alias("b")).select("word", "cnt", (-F.col("b.m")).alias("best_n"), "b.best")


def near_words(words: DataFrame, least: int = LEAST, hot: int = HOT, per_shard: int = PER_SHARD) -> DataFrame:
    """word, cnt, best_n, best: how many of the words are one edit away, and the most frequent of them. The table is
    one that may be read several times."""
    shards = max(1, -(-words.count() // per_shard))
    patterns, sent = _halves(words), _sent(words, least)
    many = stored(patterns.groupBy("side", "segment").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("side", "segment"), "hot-halves")
    n_hot, sent_bytes = many.agg(F.count("*"), F.sum(F.octet_length("segment") + PER_SENT)).first()
    side = F.broadcast(many) if n_hot and sent_bytes <= MOST_SENT else many.hint(SORTED)
    usual = (lambda rows: rows.join(side, ["side", "segment"], "left_anti")) if n_hot else lambda rows: rows
    shard = F.pmod(F.xxhash64("side", "segment"), F.lit(shards)).alias("shard")
    to_scan = usual(sent).select(shard, F.lit(None).cast("int").alias("side"), "word", "n").distinct()
    rows = usual(patterns).select(shard, "side", "word", "n").unionByName(to_scan)
    near = rows.groupBy("shard").applyInArrow(_scan, NEAR)
    if n_hot:
        keep = lambda rows: rows.join(side, ["side", "segment"], "left_semi")
        near = near.unionByName(_in_hot(keep(patterns), keep(sent)))
    return _summed(near)


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """word, root for the words that have a form: chains of up to `longest` steps, followed by doubling."""
    links = stored(forms.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(links.join(ahead.hint(SORTED), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "forms")
    return links


def variants(docs: DataFrame, least: int = LEAST, times: int = TIMES, factor: int = FACTOR, damage: int | None = None, hot: int = HOT, per_shard: int = PER_SHARD) -> DataFrame:
    """word, n, n_near, form, form_n, root: a row for each word. `damage` deletes a character from runs that a hash
    chooses, so that a clean corpus has variants too."""
    words = stored(word_counts(docs, least, times, damage), "words")
    near = near_words(words, least, hot, per_shard)
    is_form = F.col("best_n") >= factor * F.col("n")
    forms = stored(
        words.join(near.hint(SORTED), "word", "left").select(
            "word", "n", F.coalesce("cnt", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
        ),
        "variants",
    )
    top = forms.agg(F.max("form_n")).first()[0] or 1
    return forms.join(roots(forms, int(math.log(top, factor)) + 1).hint(SORTED), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir), damage=DAMAGE).select("word", "form", "root", "n", "n_near", "form_n")


OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
r AS (SELECT doc_id, run, count(*) AS c, CAST(doc_id AS VARCHAR) || ':' || run AS s FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{c0}-\x{ff}]{7,}')) AS run FROM documents) GROUP BY doc_id, run),
h AS (SELECT run, c, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(strlen(s)), lambda k: CAST('0x' || substr(hex(s), 2 * k + 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) AS h FROM r, t),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, c FROM h) WHERE len(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
e AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM e a JOIN e b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT e.word, w.word, w.n FROM e JOIN w ON e.d = w.word UNION SELECT w.word, e.word, e.n FROM e JOIN w ON e.d = w.word),
b AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n, first(other ORDER BY other_n DESC, other) AS best FROM p GROUP BY word),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM w LEFT JOIN b ON w.word = b.word),
c AS (SELECT word, form AS here FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.here WHERE f.form IS NOT NULL),
z AS (SELECT c.word, c.here FROM c JOIN f ON f.word = c.here WHERE f.form IS NULL)
SELECT f.word, form, coalesce(z.here, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN z ON f.word = z.word
"""
