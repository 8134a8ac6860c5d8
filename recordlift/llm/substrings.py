"""Substring deduplication over a log-structured fingerprint index.

A window is 13 consecutive words. Its fingerprint has 64 bits, of which a cell number (the top bits) and 48 more are
kept. The index is a list of immutable runs: for each cell the sorted fingerprints of one batch, stored as gaps, and
beside each a check.
A new batch is dealt by cell, sorted, and merge-joined with the runs of its cell: a window is a repeat if its
fingerprint is in an earlier run or belongs to a smaller doc_id of the batch. The batch's new fingerprints become
the next run; when there are more than `fanout` runs they are merged into one (compaction), and into more cells where
they have outgrown them: a cell that is split gives its fingerprints' next bit away, so nothing is read anew. A cell's
number has a leading one, so that numbers tell how many cells there were.

What travels between tasks is packed: for each chunk of a scan and each cell one row with the fingerprints in the
order of the documents, and back, for each cell and bucket of documents, one row with a bit for each window. So
neither a frequent window nor a large document makes a long list of rows. A window that stands in many documents is
reduced where it is read: of the documents of a chunk that have it, only the smallest doc_id sends it, the others are
known to repeat it. Text is dealt once, compressed, by bucket of documents, to meet the bits and drop the words.

Documents are told apart by doc_id; rows that have none, or share one, also by a hash of their text, and these take
no part in the reduction.

Every agreement of fingerprints is verified by the check: 32 bits of a second hash of the window, made from other
hashes of the words and with another step. It goes with the fingerprint of every window, through the shuffle and into
the runs, so a repeat is one only if both agree with the same smaller document or the same entry of a run. That is 87
to 96 bits; of n windows n * n / 2 ** (bits + 1) are expected to agree by chance (5e9 windows at 91 bits: 5e-9;
1e13 at 96 bits: 6e-4).

Defined results: null and empty texts have no words and lose none; a document of fewer than 13 words has no window;
a null doc_id counts as smaller than all others; rows that share a doc_id, or have none, lose no words because of each
other, and those with equal texts lose the same words; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlift.llm.common import WordHashes, documents, fresh_path, id_and_bytes, released, sliced, stored

WINDOW = 13
NO_ID = -(1 << 63)
CHUNK = 2_000_000
#: shared ids up to which they are sent to all tasks (16 bytes each)
MOST_SENT = 1_000_000
#: bytes of text for each cell and each bucket
SHARE = 16 << 20
#: bytes of a cell's history beyond which compaction splits it
MOST_CELL = 64 << 20
_PRIME, _LEHMER = 2147483647, 48271
_STEP, _CHECK_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


_hashes, _other_hashes = WordHashes(), WordHashes(1)


def window_hashes(words: np.ndarray, width: int = WINDOW, step: np.uint64 = _STEP) -> np.ndarray:
    """A 64-bit hash of each `width` consecutive words, from the words' hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(width):
            out = out * step + words[j : j + n]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return _hashes.of(words)


def release() -> None:
    """Frees the worker's tables; a function of the module, since functions made for a task have copies of its globals."""
    released(_hashes, _other_hashes)


def window_checks(words: list[bytes], width: int = WINDOW) -> np.ndarray:
    """32 bits of a hash that shares nothing with the fingerprint."""
    return (window_hashes(_other_hashes.of(words), width, _CHECK_STEP) >> np.uint64(32)).astype("<u4")


def _pack6(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack6(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _gaps(x: np.ndarray) -> bytes:
    """Sorted 48-bit numbers as 32-bit gaps; a gap too wide is told by steps of the largest gap."""
    top = np.uint64(0xFFFFFFFF)
    gaps = np.diff(x, prepend=np.uint64(0))
    steps = (gaps // top).astype(np.int64)
    if steps.any():
        out = np.full(len(x) + int(steps.sum()), top, np.uint64)
        out[np.arange(len(x)) + np.cumsum(steps)] = gaps % top
        gaps = out
    return gaps.astype("<u4").tobytes()


def _from_gaps(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, "<u4").astype(np.uint64)
    return np.cumsum(gaps)[gaps != np.uint64(0xFFFFFFFF)]


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (ids % _PRIME) * _LEHMER % _PRIME % buckets


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id (the smallest long for none), text and tag: 0, or a hash of the text for rows whose doc_id is not theirs
    alone. Their ids are counted before they are broadcast."""
    rows = id_and_bytes(docs)
    shared = stored(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "shared-ids")
    several, n = F.lit(False), shared.count()
    if n:
        shared = shared.withColumn("several", F.lit(True))
        rows = rows.join(F.broadcast(shared) if n <= MOST_SENT else shared, "doc_id", "left")
        several = F.coalesce("several", F.lit(False))
    own = F.xxhash64("text").bitwiseOR(F.lit(1))
    return rows.select("doc_id", "text", F.when(F.col("doc_id").isNull() | several, own).otherwise(0).alias("tag"))


def _packed_ids(ids: np.ndarray, tags: np.ndarray) -> bytes:
    """Ids as differences, then their tags if any differs from 0."""
    parts = [np.diff(ids, prepend=0), tags] if tags.any() else [np.diff(ids, prepend=0)]
    return zlib.compress(np.concatenate(parts).astype(np.int64).tobytes(), 1)


def _unpacked_ids(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), np.int64)
    return np.cumsum(both[:n]), both[n:] if len(both) > n else np.zeros(n, np.int64)


def _packed_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u4").tobytes(), 1)


def _unpacked_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)


def _pairs(order_first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where a new pair begins, in sorted pairs."""
    return np.concatenate(([True], (order_first[1:] != order_first[:-1]) | (second[1:] != second[:-1]))) if len(order_first) else np.zeros(0, bool)


_CELLS = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("fps", pa.binary()), ("checks", pa.binary())])
CELLS = "cell int, kind int, ids binary, counts binary, fps binary, checks binary"
_FOUND = pa.schema([("bucket", pa.int32()), ("cell", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("bits", pa.binary())])
FOUND = "bucket int, cell int, ids binary, counts binary, bits binary"


def _repeated_in(fps: np.ndarray, checks: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Windows that a smaller owner has too."""
    repeated = np.zeros(len(fps), bool)
    order = np.argsort(fps)
    same = fps[order][1:] == fps[order][:-1]
    at = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(fps) else order
    if len(at):
        at = at[np.lexsort((owner[at], checks[at], fps[at]))]
        first = _pairs(fps[at], checks[at])
        repeated[at] = owner[at] > owner[at][first][np.cumsum(first) - 1]
    return repeated


def _fingerprints(bits: int, precision: int, width: int, buckets: int):
    """Scan batches -> for each chunk and cell a row of fingerprints in the order of the documents (kind 0), and for
    each chunk and bucket a row of the repeats found already (kind 2, in a cell of its own below 0)."""

    def flush(docs: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, tags = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int64)
        fps, checks = np.concatenate([d[2] for d in docs]), np.concatenate([d[3] for d in docs])
        sizes = np.array([len(d[2]) for d in docs], np.int64)
        docs.clear()
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        known = _repeated_in(fps, checks, np.repeat(ids, sizes)) & np.repeat(tags == 0, sizes)
        rows = []
        found = np.flatnonzero(np.add.reduceat(known.astype(np.int64), begins))
        where = _bucket(ids ^ tags, buckets)[found]
        for b in np.unique(where).tolist():
            mine = found[where == b]
            marks = np.concatenate([known[begins[i] : begins[i] + sizes[i]] for i in mine])
            rows.append((-1 - b, 2, _packed_ids(ids[mine], tags[mine]), _packed_counts(sizes[mine]), np.packbits(marks).tobytes(), None))
        fps &= np.uint64(((1 << precision) - 1) << (64 - precision))
        fps, checks, owner = fps[~known], checks[~known], np.repeat(np.arange(len(ids)), sizes)[~known]
        cells = (fps >> np.uint64(64 - bits)).astype(np.int32)
        order = np.argsort(cells, kind="stable")
        owner = owner[order]
        low = _pack6((fps[order] << np.uint64(bits)) >> np.uint64(16))
        checks = checks[order].tobytes()
        edges = np.searchsorted(cells[order], np.arange((1 << bits) + 1))
        for c in np.flatnonzero(np.diff(edges)).tolist():
            a, b = int(edges[c]), int(edges[c + 1])
            own, n = np.unique(owner[a:b], return_counts=True)
            rows.append((1 << bits | c, 0, _packed_ids(ids[own], tags[own]), _packed_counts(n), low[6 * a : 6 * b], checks[4 * a : 4 * b]))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _CELLS, strict=True)], schema=_CELLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        n = 0
        try:
            for whole in batches:
                for batch in sliced(whole):
                    for doc_id, text, tag in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "tag")), strict=True):
                        words = text.split()
                        fps = window_hashes(word_hashes(words), width)
                        if len(fps):
                            docs.append((NO_ID if doc_id is None else doc_id, tag, fps, window_checks(words, width)))
                            n += len(fps)
                        if n >= CHUNK:
                            yield from flush(docs)
                            n = 0
            if n:
                yield from flush(docs)
        finally:
            release()

    return run


def _merge_join(buckets: int):
    """One cell: the batch's rows (kind 0) against the runs' (kind 1) -> repeats (kind 0 rows) and the new run."""
    out = pa.schema([("run", pa.bool_()), *_FOUND, ("checks", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        cell = table["cell"][0].as_py()
        if cell < 0:  # found in the scan already
            rows = [(False, -1 - cell, -1, ids, counts, marks, None) for ids, counts, marks in zip(*(table[c].to_pylist() for c in ("ids", "counts", "fps")), strict=True)]
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
        docs, marks, fps, checks, counts_all, past, past_checks = [], [], [], [], [], [], []
        for kind, ids, counts, data, check in zip(*(table[c].to_pylist() for c in ("kind", "ids", "counts", "fps", "checks")), strict=True):
            if kind:
                past.append(_from_gaps(zlib.decompress(data)))
                past_checks.append(np.frombuffer(check, "<u4"))
                continue
            counts_all.append(_unpacked_counts(counts))
            own_ids, own_tags = _unpacked_ids(ids, len(counts_all[-1]))
            docs.append(own_ids)
            marks.append(own_tags)
            fps.append(_unpack6(data))
            checks.append(np.frombuffer(check, "<u4"))
        if not docs:
            return out.empty_table()
        entry, tags, sizes, x, y = np.concatenate(docs), np.concatenate(marks), np.concatenate(counts_all), np.concatenate(fps), np.concatenate(checks)
        del docs, marks, fps, checks
        owner = np.repeat(entry, sizes)
        order = np.lexsort((owner, y, x))
        f, g, d = x[order], y[order], owner[order]
        first = _pairs(f, g)
        heads = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        repeat = d > d[heads][group]
        own, own_checks = f[heads], g[heads]
        if past:
            # the runs' pairs and the batch's, sorted together: a pair of both sides stands twice, the run's first
            old = np.zeros(len(own), bool)
            both, both_checks = np.concatenate([*past, own]), np.concatenate([*past_checks, own_checks])
            n_past = len(both) - len(own)
            side = np.arange(len(both)) >= n_past
            at = np.lexsort((side, both_checks, both))
            starts = _pairs(both[at], both_checks[at])
            known = ~side[at][np.flatnonzero(starts)][np.cumsum(starts) - 1]
            mine = side[at]
            old[at[mine] - n_past] = known[mine]
            repeat |= old[group]
            own, own_checks = own[~old], own_checks[~old]
        mark = np.zeros(len(x), bool)
        mark[order] = repeat
        rows = [(True, 0, cell, None, None, zlib.compress(_gaps(own), 1), own_checks.tobytes())] if len(own) else []
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        hit = np.add.reduceat(mark.astype(np.int64), begins) > 0
        if hit.any():
            where = _bucket(entry ^ tags, buckets)
            flagged = np.flatnonzero(hit)
            for b in np.unique(where[flagged]).tolist():
                mine = flagged[where[flagged] == b]
                taken = np.concatenate([mark[begins[i] : begins[i] + sizes[i]] for i in mine])
                rows.append((False, b, cell, _packed_ids(entry[mine], tags[mine]), _packed_counts(sizes[mine]), np.packbits(taken).tobytes(), None))
        if not rows:
            return out.empty_table()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return run


def _merged(table: pa.Table) -> pa.Table:
    fps = np.concatenate([_from_gaps(zlib.decompress(x)) for x in table["fps"].to_pylist()])
    checks = np.concatenate([np.frombuffer(x, "<u4") for x in table["checks"].to_pylist()])
    order = np.lexsort((checks, fps))
    fps, checks = fps[order], checks[order]
    new = _pairs(fps, checks)
    schema = pa.schema([("cell", pa.int32()), ("fps", pa.binary()), ("checks", pa.binary())])
    return pa.Table.from_arrays([pa.array([table["cell"][0].as_py()], pa.int32()), pa.array([zlib.compress(_gaps(fps[new]), 1)]), pa.array([checks[new].tobytes()])], schema=schema)


def _split(more: int):
    """Rows of a run -> the same for 2 ** more times as many cells."""
    schema = pa.schema([("cell", pa.int32()), ("fps", pa.binary()), ("checks", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, data, check in zip(*(batch.column(c).to_pylist() for c in schema.names), strict=True):
                fps, checks = _from_gaps(zlib.decompress(data)), np.frombuffer(check, "<u4")
                edges = np.searchsorted(fps, np.arange((1 << more) + 1, dtype=np.uint64) << np.uint64(48 - more))
                rows = [(cell << more | k, zlib.compress(_gaps((fps[a:b] << np.uint64(more)) & np.uint64((1 << 48) - 1)), 1), checks[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


class FingerprintIndex:
    """Runs of fingerprints and checks of what was seen, under a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str | None = None, cell_bits: int = 7, buckets: int = 128, fanout: int = 8, width: int = WINDOW):
        if not 0 < cell_bits <= 22:
            raise ValueError("cell_bits is 1 to 22")
        self.precision = min(64, cell_bits + 48)
        self.spark, self.path, self.bits, self.buckets, self.fanout, self.width = spark, path or fresh_path(spark, "fingerprints"), cell_bits, buckets, fanout, width
        self.runs: list[str] = []
        self.written = 0

    def _history(self) -> DataFrame | None:
        if not self.runs:
            return None
        runs = self.spark.read.schema("run boolean, " + FOUND + ", checks binary").parquet(*self.runs).where("run")
        return runs.select("cell", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("counts"), F.col("bits").alias("fps"), "checks")

    def add(self, docs: DataFrame) -> DataFrame:
        """Merge-joins a batch with the runs, appends its run, and returns the repeats as packed bits."""
        return self.add_tagged(tagged(docs))

    def add_tagged(self, docs: DataFrame) -> DataFrame:
        """The same for rows of tagged()."""
        rows = docs.mapInArrow(_fingerprints(self.bits, self.precision, self.width, self.buckets), CELLS)
        history = self._history()
        if history is not None:
            rows = rows.unionByName(history)
        path = f"{self.path}/run-{self.written:06d}"
        rows.groupBy("cell").applyInArrow(_merge_join(self.buckets), "run boolean, " + FOUND + ", checks binary").write.option("compression", "zstd").parquet(path)
        self.runs.append(path)
        self.written += 1
        found = self.spark.read.schema("run boolean, " + FOUND).parquet(path).where("not run").drop("run")
        if len(self.runs) > self.fanout:
            self.compact()
        return found

    def compact(self) -> None:
        """Merges all runs into one, cell by cell, with twice the cells as often as one would be larger than MOST_CELL.
        Runs that were merged are left to whoever clears the folder."""
        path = f"{self.path}/run-{self.written:06d}"
        rows = self._history().select("cell", "fps", "checks")
        size = rows.groupBy("cell").agg(F.sum(F.octet_length("fps") + F.octet_length("checks")).alias("n")).agg(F.max("n")).first()[0] or 0
        more = 0
        while size >> more > MOST_CELL and self.bits + more < 22:
            more += 1
        if more:
            rows, self.bits = rows.mapInArrow(_split(more), "cell int, fps binary, checks binary"), self.bits + more
        whole = rows.groupBy("cell").applyInArrow(_merged, "cell int, fps binary, checks binary")
        none = F.lit(None).cast("binary")
        whole.select(F.lit(True).alias("run"), F.lit(0).alias("bucket"), "cell", none.alias("ids"), none.alias("counts"), F.col("fps").alias("bits"), "checks").write.option("compression", "zstd").parquet(path)
        self.runs, self.written = [path], self.written + 1


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def covered(starts: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """Words covered by windows that start where `starts` is true."""
    edge = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


_TEXTS = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("none", pa.binary()), ("lengths", pa.binary()), ("size", pa.int64()), ("data", pa.binary())])
TEXTS = "bucket int, ids binary, none binary, lengths binary, size long, data binary"


def _dealt_texts(buckets: int):
    """Rows of tagged() -> for each chunk and bucket a row of compressed texts."""

    def flush(docs: list[tuple[int | None, bytes, int]]) -> Iterator[pa.RecordBatch]:
        ids, tags = np.array([NO_ID if d is None else d for d, _, _ in docs], np.int64), np.array([t for _, _, t in docs], np.int64)
        where = _bucket(ids ^ tags, buckets)
        rows = []
        for b in np.unique(where).tolist():
            mine = np.flatnonzero(where == b)
            texts = [docs[i][1] for i in mine]
            data = b"".join(texts)
            none = np.packbits([docs[i][0] is None for i in mine])
            rows.append((b, _packed_ids(ids[mine], tags[mine]), none.tobytes(), _packed_counts(np.array([len(t) for t in texts])), len(data), pa.compress(data, codec="zstd", asbytes=True)))
        docs.clear()
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _TEXTS, strict=True)], schema=_TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int | None, bytes, int]] = []
        size = 0
        for whole in batches:
            for batch in sliced(whole):
                docs.extend(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "tag")), strict=True))
                size += batch.nbytes
                if size >= SHARE:
                    yield from flush(docs)
                    size = 0
        if docs:
            yield from flush(docs)

    return run


def _strip(width: int, texts: bool):
    def marks(found: pa.Table) -> dict[tuple[int, int], dict[int, np.ndarray]]:
        out: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        for cell, ids, counts, data in zip(*(found[c].to_pylist() for c in ("cell", "ids", "counts", "bits")), strict=True):
            sizes = _unpacked_counts(counts)
            docs, tags = _unpacked_ids(ids, len(sizes))
            flags = np.unpackbits(np.frombuffer(data, np.uint8), count=int(sizes.sum())).astype(bool)
            for doc, tag, part in zip(docs.tolist(), tags.tolist(), np.split(flags, np.cumsum(sizes)[:-1]), strict=True):
                out.setdefault((doc, tag), {})[cell] = part
        return out

    def stripped(doc_id: int | None, text: bytes, mine: dict[int, np.ndarray] | None) -> tuple:
        words, removed = text.split(), 0
        kept = words
        if mine and len(words) >= width:
            fps = window_hashes(word_hashes(words), width)
            starts = mine.pop(-1).copy() if -1 in mine else np.zeros(len(fps), bool)
            sent = np.flatnonzero(~starts)
            bits = max(mine, default=1).bit_length() - 1  # a document's cells are those of one batch
            cells = (fps[sent] >> np.uint64(64 - bits)).astype(np.int64) | 1 << bits
            order = np.argsort(cells, kind="stable")
            for c, part in mine.items():
                a, b = np.searchsorted(cells[order], [c, c + 1])
                starts[sent[order[a:b]]] = part
            gone = covered(starts, len(words), width)
            removed = int(gone.sum())
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        joined = b" ".join(kept)
        return doc_id, len(words), removed, hashlib.sha256(joined).hexdigest(), joined if texts else None

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        repeats = marks(found)
        rows = []
        for ids, none, lengths, size, data in zip(*(docs[c].to_pylist() for c in ("ids", "none", "lengths", "size", "data")), strict=True):
            sizes = _unpacked_counts(lengths)
            keys, tags = _unpacked_ids(ids, len(sizes))
            missing = np.unpackbits(np.frombuffer(none, np.uint8), count=len(sizes)).astype(bool)
            whole = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
            at = np.concatenate(([0], np.cumsum(sizes))).tolist()
            for k, (key, tag, no_id) in enumerate(zip(keys.tolist(), tags.tolist(), missing.tolist(), strict=True)):
                own = repeats.get((key, tag))
                rows.append(stripped(None if no_id else key, whole[at[k] : at[k + 1]], dict(own) if own else None))
        release()
        if not rows:
            return _KEPT.empty_table()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _KEPT, strict=True)], schema=_KEPT)

    return run


def strip_repeats(docs: DataFrame, found: DataFrame, index: FingerprintIndex, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words: a row for each document."""
    return _stripped(tagged(docs), found, index, texts)


def _stripped(rows: DataFrame, found: DataFrame, index: FingerprintIndex, texts: bool) -> DataFrame:
    dealt = rows.mapInArrow(_dealt_texts(index.buckets), TEXTS)
    both = dealt.groupBy("bucket").cogroup(found.groupBy("bucket"))
    out = both.applyInArrow(_strip(index.width, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string")) if texts else out.drop("kept")


def dedup_substrings(docs: DataFrame, index: FingerprintIndex | None = None, batches: int = 2, texts: bool = False) -> DataFrame:
    """Takes the documents into the index in batches of ascending doc_id and strips what came before.

    Without an index given, a new one gets as many cells and buckets as keep each at about SHARE bytes of text."""
    if index is None:
        shares = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARE + 1
        index = FingerprintIndex(docs.sparkSession, cell_bits=min(22, max(7, (shares - 1).bit_length())), buckets=max(128, shares))
    rows = tagged(docs)
    cuts = docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.02) if batches > 1 else []
    found, low = None, None
    for high in [*sorted({int(c) for c in cuts}), None]:
        part = rows
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id").isNull() | (F.col("doc_id") <= high) if low is None else F.col("doc_id") <= high)
        new = index.add_tagged(part)
        found, low = new if found is None else found.unionByName(new), high
    return _stripped(rows, found, index, texts)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 12], ' ')) AS h, md5(array_to_string(w[i:i + 12], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT h, k, min(doc_id) AS first FROM x GROUP BY h, k),
r AS (SELECT doc_id, i FROM x JOIN m USING (h, k) WHERE first < doc_id),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM r) GROUP BY doc_id),
k AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN c USING (doc_id)),
p AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j))) AS i FROM k)),
s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM p GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN s USING (doc_id)
"""
