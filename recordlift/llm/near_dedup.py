"""Near-duplicate documents by HyperMinHash, with every link confirmed on the full shingle sets.

1. Sketch: a document's distinct 2-word shingles are hashed to 64 bits. Each of 128 registers takes the smallest hash
   of its bucket of shingles and keeps its number of leading zeros and 10 bits behind them. In sets of 1,638 shingles
   or more, the top 7 bits of a hash name its bucket. In sets of up to 2,048, most buckets of which would be empty or
   hold one common shingle, every register sees all shingles, hashed anew for each. Sets of 1,638 to 2,048 have both
   sketches: two sets that can be linked (the smaller one has 0.8 of the larger one's shingles) share a kind.
2. Documents with the same set (128-bit digest) are one node, named by a number of its own.
3. Banding: 32 bands of 4 registers of one kind, all of them filled. A link of similarity 0.8 misses all bands with
   probability 5e-8.
4. In each bucket the member that shares most buckets with others is the centre; every member is paired with it.
   Pairs are dropped where the collision-corrected estimate is 5 standard errors below the threshold, and then
   confirmed by intersecting the full sets. Linked nodes are contracted to components.
5. A bucket whose other members are all in one component is settled: what it would add is known. Of the rest, a
   small bucket gives its pairs between different components. Members of large ones go through an exact prefix
   join: shingles ordered rarest first, pairs that share one within their prefixes and pass the size and position
   bounds, between members that the centre did not link and the others. These pairs are confirmed too.
So no bucket is expanded into all its pairs, and no bucket is cut short.

Hot buckets: copies are merged before banding, counts and centres are partial aggregates, and the joins are plain
equi-joins whose large partitions adaptive execution splits. Two documents that share four registers by nature are
alike, so a common shingle makes no bucket. No link list or component comes to the driver.

Defined results: null and empty texts have no shingle and are linked with nothing, not even each other; one word is
one shingle; a null doc_id cannot name a component: such a row is linked with nothing, its component_id is null and
it is kept; rows that share a doc_id but not the text are documents of their own, and each is kept if its component is
named by that id; an empty table gives an empty result; further columns are ignored by find() and kept by dedup(), of
which one row of the id that names a component stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlift.llm.common import Table, WordHashes, documents, id_and_bytes, row_map, sliced, stored

P, MANTISSA, BANDS, ROWS = 7, 10, 32, 4
REGISTERS = 1 << P
#: shingles of a set up to which every register sees all of them
FEW = 2048
SMALL = 40
#: bits of a hash that name the bucket in which a shingle's rarity is counted
RARITY = 20
_words = WordHashes(seed=7)
_rng = np.random.Generator(np.random.PCG64(0x5EED))
# multipliers and summands of the hash functions of small sets, one for each register
_TIMES, _PLUS = _rng.integers(0, 1 << 63, (REGISTERS, 1), np.uint64) * np.uint64(2) + np.uint64(1), _rng.integers(0, 1 << 63, (REGISTERS, 1), np.uint64) * np.uint64(2)


def _tables() -> list[Table]:
    """The worker's tables; a function of the module, since functions made for a task have copies of its globals."""
    return [_words]


def shingles(text: bytes, width: int = 2) -> np.ndarray:
    """Sorted hashes of the distinct shingles of `width` words; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = _words.of(words)
    width = min(width, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, np.uint64(width), np.uint64)
        for j in range(width):
            out = (out ^ h[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return np.unique(out)


def _registers(rest: np.ndarray, bits: int) -> np.ndarray:
    """(leading zeros + 1) << 10 | mantissa of numbers of so many bits."""
    # as a float a number is 1.mantissa * 2^e
    fraction, exponent = np.frexp(np.maximum(rest, 1).astype(np.float64))
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1)
    return ((np.clip(bits - exponent, 0, 62) + 1) << MANTISSA | mantissa).astype(np.uint16)


def sketch(s: np.ndarray) -> bytes:
    """128 registers of 16 bits from sorted hashes, dealt to buckets by their top bits; 0 where no shingle fell."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(s):
        register = (s >> np.uint64(64 - P)).astype(np.int64)
        # s is sorted, so the first of each register has its smallest remainder
        at = np.flatnonzero(np.concatenate(([True], register[1:] != register[:-1])))
        out[register[at]] = _registers(s[at] & np.uint64((1 << (64 - P)) - 1), 64 - P)
    return out.tobytes()


def small_sketch(s: np.ndarray) -> bytes:
    """128 registers of 16 bits, each of all hashes in an order of its own."""
    least = np.full(REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for k in range(0, len(s), 256):
            mixed = s[None, k : k + 256] * _TIMES + _PLUS
            np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=1), out=least)
    return _registers(least, 64).tobytes()


def estimate(a: bytes, b: bytes, n: int, m: int) -> tuple[float, int]:
    """Jaccard similarity from two sketches, corrected for registers that agree by chance, and the registers used."""
    x, y = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
    used = int(((x > 0) | (y > 0)).sum())
    same = int(((x == y) & (x > 0)).sum())
    ratio = max(n, m) / max(1, min(n, m))
    chance = 0.169919487159739093975315012348 * REGISTERS / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return max(0.0, same - chance) / max(1, used), used


def _kinds(s: np.ndarray, threshold: float) -> tuple[bytes | None, bytes | None]:
    """Sketches of the set as a small and as a large one, null where it cannot be linked with a set of that kind."""
    return small_sketch(s) if 0 < len(s) <= FEW else None, sketch(s) if len(s) >= threshold * FEW else None


def _sketched(width: int, threshold: float):
    out = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("few", pa.binary()), ("many", pa.binary())])

    def each(doc_id: int, text: bytes, text_hash: int) -> tuple:
        s = shingles(text, width)
        return doc_id, text_hash, len(s), xxhash.xxh128_digest(s.tobytes()), *_kinds(s, threshold)

    return row_map(each, out, tables=_tables)


def _sets(width: int):
    out = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("set", pa.binary())])

    def each(node: int, digest: bytes, text: bytes) -> tuple | None:
        s = shingles(text, width)
        # another text of the same doc_id is another node
        return (node, len(s), s.tobytes()) if xxhash.xxh128_digest(s.tobytes()) == digest else None

    return row_map(each, out, tables=_tables)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _likely(threshold: float):
    def each(a, b, fa, fb, ma, mb, na, nb):
        if min(na, nb) < threshold * max(na, nb):
            return None
        j, used = estimate(fa, fb, na, nb) if fa and fb else estimate(ma, mb, na, nb)
        return (a, b) if j >= threshold - 5 * (threshold * (1 - threshold) / max(1, used)) ** 0.5 else None

    return row_map(each, _PAIR)


def _confirmed(percent: int):
    def each(a, b, sa, sb):
        x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return (a, b) if 100 * both >= percent * (len(x) + len(y) - both) else None

    return row_map(each, _PAIR)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> node and component, the smallest node it reaches; nodes without an edge are left out.

    In each round every node but the smallest of its neighbourhood hooks onto its smallest neighbour, chains of
    hooks are followed, and edges are redrawn between the ends; edges inside one end vanish.
    """
    live = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while not live.isEmpty():
        parent = stored(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "hooks")
        while True:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = stored(parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "hooks")
            parent = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            ends = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            labels = ends.join(parent, "node", "left").select("node", F.coalesce("up", "node").alias("component"))
        else:
            labels = labels.join(parent.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        labels = stored(labels, "labels")
        to = lambda c: parent.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))
        moved = live.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b"))
        live = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    return labels if labels is not None else live.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _bucket(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - RARITY)).astype(np.int64)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall in each bucket of hashes: partial counts of each task, summed up."""
    out = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RARITY, np.int64)
        for batch in batches:
            counts += np.bincount(_bucket(batch.column(0).flatten().to_numpy()), minlength=1 << RARITY)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], schema=out)

    found = sets.select("s").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << RARITY, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def _prefixes(frequencies: np.ndarray, threshold: float):
    """The places of a set's prefix, rarest shingles first; those of no other set are left out."""
    out = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("at", pa.int32()), ("x", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                sizes, rows = part.column("n").to_numpy(), [[], [], [], []]
                for node, n, s in zip(part.column("node").to_numpy(), sizes, part.column("s"), strict=True):
                    x = s.values.to_numpy()
                    df = frequencies[_bucket(x)]
                    order = np.lexsort((x, df))[: int(n - np.ceil(threshold * n - 1e-9) + 1)]
                    at = np.flatnonzero(df[order] > 1)
                    for column, values in zip(rows, (np.full(len(at), node), np.full(len(at), n), at.astype(np.int32), x[order[at]]), strict=True):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(rows, out, strict=True)], schema=out)

    return run


def prefix_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a of left, b of right; node, n, s: array<long>) that may reach the threshold: an exact filter.

    Rarity is that of a shingle's bucket of hashes, so that it is counted and looked up without a join; any order that
    all sets share is exact. With shingles rarest first, two sets that reach it share one within the first n - ceil(t n) + 1 of the larger
    and the first n - ceil(2 t / (1 + t) n) + 1 of the smaller; the rest behind the shared one must suffice too.
    """
    both = left.select("node", "n", "s").unionByName(right.select("node", "n", "s")).dropDuplicates(["node"])
    placed = stored(both.mapInArrow(_prefixes(_frequencies(both), threshold), "node long, n long, at int, x long"), "prefixes")
    small = F.expr(f"at <= n - ceil({2 * threshold / (1 + threshold)} * n - 1e-9)")
    t = threshold / (1 + threshold)

    def side(of: DataFrame, as_: str, keep) -> DataFrame:
        rows = placed.join(of.select("node"), "node", "left_semi")
        rows = rows.where(keep) if keep is not None else rows
        return rows.select(F.col("node").alias(as_), F.col("n").alias(f"n_{as_}"), F.col("at").alias(f"at_{as_}"), "x")

    found = []
    for a_small in (True, False):
        a, b = side(left, "a", small if a_small else None), side(right, "b", None if a_small else small)
        size = "n_a <= n_b" if a_small else "n_b < n_a"
        enough = f"least(n_a - at_a, n_b - at_b) >= {t} * (n_a + n_b) - 1e-9 and least(n_a, n_b) >= {threshold} * greatest(n_a, n_b) - 1e-9"
        found.append(a.join(b, "x").where(f"a <> b and {size} and {enough}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return found[0].union(found[1]).distinct()


def _band_keys(kind: str) -> Column:
    """A key for each band of the kind's sketch whose registers are all filled."""
    filled = " and ".join(f"substring({kind}, {2 * ROWS} * i + {2 * k + 2}, 1) <> X'00'" for k in range(ROWS))
    keys = f"transform(filter(sequence(0, {BANDS - 1}), i -> {filled}), i -> xxhash64('{kind}', i, substring({kind}, {2 * ROWS} * i + 1, {2 * ROWS})))"
    return F.expr(f"case when {kind} is null then cast(array() as array<bigint>) else {keys} end")


def find(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each document."""
    return _found(docs, width, percent).drop("hash", "component")


def _found(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of find() with the hash of their text and the number of their component, null for those without words."""
    t = percent / 100
    source = id_and_bytes(docs)
    hashed = source.select("*", F.xxhash64("text").alias("hash"))
    rows = stored(hashed.mapInArrow(_sketched(width, t), "doc_id long, hash long, n_shingles long, digest binary, few binary, many binary"), "sketches")
    known = rows.where("n_shingles > 0 and doc_id is not null")
    # the number is that of the table as written
    nodes = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("few").alias("few"), F.first("many").alias("many"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    member = nodes.select("node", F.explode(F.concat(_band_keys("few"), _band_keys("many"))).alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    member = stored(member.join(shared, "key"), "members")
    fame = member.groupBy("node").agg(F.sum("size").alias("fame"))
    centre = member.join(fame, "node").groupBy("key").agg(F.max(F.struct("fame", (-F.col("node")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("centre"))
    member = stored(member.join(centre, "key"), "centred")
    star = member.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()

    sketches = nodes.select("node", "few", "many", "n")
    of = lambda table, c, *names: table.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in names))
    compared = ("few_a", "few_b", "many_a", "many_b", "n_a", "n_b")
    likely = lambda pairs: pairs.join(of(sketches, "a", "few", "many", "n"), "a").join(of(sketches, "b", "few", "many", "n"), "b").select("a", "b", *compared).mapInArrow(_likely(t), "a long, b long")
    wanted = nodes.join(member.select("node").distinct(), "node").select(F.col("first").alias("doc_id"), "node", "digest")
    sets = source.join(wanted, "doc_id").select("node", "digest", "text").mapInArrow(_sets(width), "node long, n long, set binary")
    sets = stored(sets.dropDuplicates(["node"]), "sets")
    confirmed = lambda pairs: pairs.join(of(sets, "a", "set"), "a").join(of(sets, "b", "set"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(percent), "a long, b long")

    links = stored(confirmed(stored(likely(star), "likely")), "links")
    first = components(links)

    placed = member.where("node <> centre").join(first, "node", "left").select("key", "size", "centre", "node", F.coalesce("component", "node").alias("component"))
    placed = placed.join(first.select(F.col("node").alias("centre"), F.col("component").alias("main")), "centre", "left").withColumn("main", F.coalesce("main", "centre"))
    placed = stored(placed, "placed")
    open_ = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("key")
    left = stored(placed.join(open_, "key", "left_semi"), "open")
    small = left.where(F.col("size") <= SMALL).select("key", "node", "component")
    pairs = small.alias("l").join(small.alias("r"), "key").where("l.node < r.node and l.component <> r.component").select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()
    large = left.where(F.col("size") > SMALL)
    more = confirmed(likely(pairs))
    if not large.isEmpty():
        arrays = _unpacked(sets.join(large.select("node").distinct(), "node", "left_semi"))
        arrays = stored(arrays, "arrays")
        outside = large.where("component <> main").select("node").distinct()
        exact = prefix_pairs(arrays.join(outside, "node", "left_semi"), arrays, t)
        more = more.union(confirmed(stored(exact, "prefix-pairs")))
    more = stored(more, "more-links")
    whole = components(links.union(more)) if not more.isEmpty() else first
    linked = nodes.join(whole, "node", "left").select("digest", "first", F.coalesce("component", "node").alias("c"))
    # written, so that a large component's rows can be split in the join
    names = stored(linked.groupBy("c").agg(F.min("first").alias("component")), "names")
    named = linked.join(names, "c").select("digest", F.col("component").alias("least"), F.col("c").alias("component"))
    out = rows.join(named, "digest", "left")
    least = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    least = F.when(F.col("doc_id").isNotNull(), least)
    return out.select("doc_id", "hash", "component", "n_shingles", least.alias("component_id"), F.coalesce(F.col("doc_id") == least, F.lit(True)).alias("kept"))


def _unpacked(sets: DataFrame) -> DataFrame:
    out = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                values = [np.frombuffer(x, np.int64) for x in part.column("set").to_pylist()]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("n"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values)))], schema=out)

    return sets.mapInArrow(run, "node long, n long, s array<long>")


def dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents kept, one row of each component and one of each text without words and its id, with all columns;
    rows without a doc_id stay. Where rows of a component share its smallest id, the text of the smallest hash stays."""
    alone = F.when(F.col("component").isNull(), F.col("hash"))
    keep = _found(docs, width, percent).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("id"), "component", alone.alias("alone")).agg(F.min("hash").alias("hash"))
    # the row stands in a struct, so its columns may have any name
    row = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("hash"))
    chosen = rows.join(keep.select("id", "hash"), ["id", "hash"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("id", "hash").orderBy("hash"))).where("n = 1")
    return chosen.select("row").unionByName(rows.where("id is null").select("row")).select("row.*")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir), width=2)


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM d WHERE len(w) > 0),
e AS (SELECT doc_id, unnest(x) AS g FROM s),
n AS (SELECT doc_id, CAST(len(x) AS BIGINT) AS n FROM s),
f AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b USING (g) JOIN f USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id WHERE r.c < u.b),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM m LEFT JOIN n USING (doc_id)
"""
