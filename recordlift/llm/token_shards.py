"""Token ids as fixed-stride binary shards in training order.

Each document is tokenised and cut into sequences of `length` tokens, the last one padded. All sequences are
numbered in the order of the scan; a keyed Feistel network over the next power of four, walked until it falls below
the number of sequences, permutes the numbers, so every sequence has a slot of its own and none is left out.
Slot s stands in shard s // per_shard at byte (s % per_shard) * stride, so a reader that stopped after slot s goes
on at s + 1 with one seek, and any range of slots is a sequential read. Shards are larger where there are more
sequences, so that there are at most 16,384 of them; a task writes a shard as it comes and holds one batch of it.

A sequence is a record of 16 + 2 * length bytes, little-endian: doc_id (8), number within the document (4), tokens
used (4), token ids (2 each; unused ones are 0).

Texts are scanned twice: first to count the sequences of each scan partition, of which only a row for each comes to
the driver, then to number and write them. Both scans must see the same rows in the same order, which stored files
do; each partition's documents and sizes are summed to a check value, and a second scan that differs is an error.
Shards are written under a temporary name and renamed, so a task that runs again leaves the same file.

Defined results: null and empty texts have no tokens and no sequence; a null doc_id is written as the smallest
long; repeated rows are sequences of their own; an empty table writes no shard; further columns are ignored.
"""

from __future__ import annotations

import array
import json
import struct
import sys
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain, groupby, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlift.llm.common import documents, fresh_path, id_and_bytes, released, sliced

LENGTH, PER_SHARD, KEY = 256, 16384, 0x5EED_0F_1D5
MOST_SHARDS = 16384
#: records read back at a time
BLOCK = 4096
NO_ID = -(1 << 63)
CHUNK = 8 << 20
#: bytes whose places to cut are found at a time
CUT = 4 << 20
#: sequences in a batch
SEQUENCES = 50_000
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) & _M
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, n: int, key: int = KEY, rounds: int = 4) -> np.ndarray:
    """Slots of the numbers: a permutation of range(n) fixed by the key."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> h, x & mask
        for r in range(rounds):
            left, right = right, left ^ (_mix(right, key + 0x9E3779B97F4A7C15 * (r + 1)) & mask)
        return (left << h) | right

    with np.errstate(over="ignore"):
        out = once(numbers.astype(np.uint64))
        while (far := out >= np.uint64(n)).any():
            out[far] = once(out[far])
    return out.astype(np.int64)


def packed(ids: list[int]) -> bytes:
    """Little-endian 16-bit ids."""
    out = array.array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Half:
    """Ids of segments, one behind another, and where each segment's begin."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.begin, self.size, self.ids = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32), np.zeros(1 << 12, np.uint16)
        self.used = 0

    def add(self, segments: list[bytes], size: np.ndarray, ids: np.ndarray) -> None:
        n, to = len(self.place), len(self.place) + len(segments)
        self.begin, self.size, self.ids = (_with_room(x, k) for x, k in ((self.begin, to), (self.size, to), (self.ids, self.used + len(ids))))
        self.place.update(zip(segments, range(n, to)))
        self.begin[n:to], self.size[n:to] = self.used + np.cumsum(size) - size, size
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def places(self, segments: list[bytes]) -> np.ndarray:
        """-1 for those that are not there."""
        return np.fromiter(map(self.place.get, segments, repeat(-1)), np.int64, len(segments))

    def ids_at(self, places: np.ndarray) -> np.ndarray:
        size = self.size[places].astype(np.int64)
        upto = np.cumsum(size)
        return self.ids[np.repeat(self.begin[places] - (upto - size), size) + np.arange(size.sum())]


def _with_room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate((x, np.zeros(max(n, len(x) + len(x) // 2) - len(x), x.dtype)))


class PieceIds:
    """Texts to uint16 ids with a public sentencepiece vocabulary.

    Where no piece has a byte behind the one in front of it, no merge goes over that place, so texts fall into segments
    there that are encoded by themselves: words, and the punctuation and line ends about them. A chunk's segments are
    made a dictionary of different ones and an index for each place, so only different ones are looked up or encoded.
    Their ids are kept in a table that the worker takes from chunk to chunk, task to task and scan to scan. It has two
    halves of bounded size: when the young half is full it becomes the old one, and segments of the old half that occur
    again go over to the young one, so frequent ones stay.

    That holds for merges without a normaliser, with a space added in front and a line end that is a piece of its own;
    with any other vocabulary the library encodes whole texts.
    """

    def __init__(self, model: str, room: int = 180 << 20):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.room, self.used = room, 0
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.sp.serialized_model_proto())
        normal, trained = spec.normalizer_spec, spec.trainer_spec
        joined = np.zeros((256, 256), bool)
        for piece in spec.pieces:
            if piece.type != piece.BYTE:
                text = np.frombuffer(piece.piece.replace("▁", " ").encode(), np.uint8)
                joined[text[:-1], text[1:]] = True
        line_end = self.sp.encode("\n")
        self.cuts = len(line_end) == 2 and not (joined[10].any() or joined[:, 10].any()) and trained.byte_fallback and trained.model_type == trained.BPE and not trained.treat_whitespace_as_suffix
        self.cuts = self.cuts and normal.add_dummy_prefix and normal.escape_whitespaces and not (normal.precompiled_charsmap or normal.remove_extra_whitespaces)
        joined[:, 0x80:0xC0] = True  # within a character
        self.cut, self.line_end = ~joined.reshape(-1), line_end[-1]
        self.young, self.old = self._half(), self._half()

    def _half(self) -> _Half:
        half = _Half()
        if self.cuts:
            half.add([b"\n"], np.array([1]), np.array([self.line_end], np.uint16))
        return half

    def _encoded(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of segments without line ends. They are encoded with one in front of each: it is joined with
        nothing, so it keeps them apart from each other and from the space that the library adds."""
        out = self.sp.encode(["\n" + b"\n".join(segments[k : k + 32]).decode() for k in range(0, len(segments), 32)], num_threads=1)
        n = np.fromiter(map(len, out), np.int64, len(out))
        ids = np.fromiter(chain.from_iterable(out), np.uint16, n.sum())
        ids = np.delete(ids, np.cumsum(n) - n)
        ends = ids == self.line_end
        size = np.diff(np.append(np.flatnonzero(ends), len(ids))) - 1
        if len(size) != len(segments):
            raise RuntimeError("segments and their ids differ in number")
        return size, ids[~ends]

    def _places(self, segments: list[bytes]) -> np.ndarray:
        """Where different segments stand in the young half."""
        if self.used > self.room // 2:
            self.old, self.young, self.used = self.young, self._half(), 0
        young, old = self.young, self.old
        at = young.places(segments)
        if len(far := np.flatnonzero(at < 0)):
            missing = [segments[k] for k in far.tolist()]
            before = old.places(missing)
            known, new = np.flatnonzero(before >= 0), np.flatnonzero(before < 0)
            for group, found in ((known, lambda _: (old.size[before[known]], old.ids_at(before[known]))), (new, self._encoded)):
                if len(group):
                    at[far[group]] = len(young.place) + np.arange(len(group))
                    taken = [missing[k] for k in group.tolist()]
                    young.add(taken, *found(taken))
            self.used += sum(map(len, missing)) * 2 + 300 * len(missing)
        return at

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each segment its place in the young half, and the number of segments up to each text's end."""
        joined = pa.array([f" {t}".replace("▁", " ") if t else t for t in texts], pa.large_string())
        upto = np.frombuffer(joined.buffers()[1], np.int64, len(texts) + 1)
        data = np.frombuffer(joined.buffers()[2] or b"", np.uint8, upto[-1])
        found = [np.zeros(1, np.int64)]
        for at in range(0, len(data) - 1, CUT):
            block = data[at : at + CUT + 1]
            pair = block[:-1].astype(np.uint16)
            pair <<= 8
            pair |= block[1:]
            cuts = self.cut[pair]
            cuts[upto[(upto > at) & (upto <= at + len(pair))] - (at + 1)] = True
            found.append(np.flatnonzero(cuts) + (at + 1))
        begin = np.concatenate((*found, [len(data)] if len(data) else []), dtype=np.int64, casting="unsafe")
        segments = pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin), joined.buffers()[2]])
        coded = segments.dictionary_encode()
        # no byte of UTF-8 is 255, so one string of them all is cut faster than each is taken by itself
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.binary())), b"\xff")[0].as_py().split(b"\xff") if len(segments) else []
        return self._places(names)[coded.indices.to_numpy()], np.searchsorted(begin, upto[1:])

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return list(map(packed, self.sp.encode(texts, num_threads=1)))
        places, ends = self._chunk(texts)
        size = self.young.size[places].astype(np.int64)
        data = self.young.ids_at(places).astype("<u2", copy=False).tobytes()
        cuts = (2 * np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], ends))]).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def sizes(self, texts: list[str]) -> list[int]:
        """Bytes that __call__ gives for each text."""
        if not self.cuts:
            return [2 * len(ids) for ids in self.sp.encode(texts, num_threads=1)]
        places, ends = self._chunk(texts)
        upto = np.concatenate(([0], np.cumsum(self.young.size[places], dtype=np.int64)))
        return (2 * np.diff(upto[ends], prepend=0)).tolist()


def piece_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


#: opens an object that gives the ids of texts when called, and their sizes by sizes()
Tokenizer = Callable[[], "PieceIds"]
_loaded: dict[str, PieceIds] = {}


def pieces(model: str | None = None) -> Tokenizer:
    """A tokenizer for materialise(): opened once in each Python worker. The path is the parameter."""

    return partial(_opened, model)


def _opened(model: str | None) -> PieceIds:
    """The worker's tokenizer; a function of the module, since functions made for a task have copies of its globals."""
    path = model or piece_model()
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = PieceIds(path)
    return _loaded[path]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """doc_ids and texts, cut where the texts reach CHUNK bytes: words that repeat within a chunk are encoded once."""
    for batch in batches:
        ids = [NO_ID if i is None else i for i in batch.column(0).to_pylist()]
        begin = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))))
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + CHUNK)))
            to = min(to, len(ids))
            yield ids[at:to], [t.decode("utf-8", "replace") for t in batch.column(1).slice(at, to - at).to_pylist()]
            at = to


def _check(value: int, ids: list[int], counts: list[int] | np.ndarray) -> int:
    return zlib.crc32(np.array(counts, "<i8").tobytes(), zlib.crc32(np.array(ids, "<i8").tobytes(), value))


def _count(tokenizer: Tokenizer, length: int):
    """Number of sequences of a scan partition and its check value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n, check = tokenizer(), 0, 0
        for ids, texts in _chunks(batches):
            counts = [-(-size // (2 * length)) for size in encode.sizes(texts)]
            n, check = n + sum(counts), _check(check, ids, counts)
        released()
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([n], pa.int64()), "sum": pa.array([check], pa.int64())})

    return run


_RECORD = pa.schema([("slot", pa.int64()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("seq_no", pa.int32()), ("ids", pa.binary())])


def _sequences(tokenizer: Tokenizer, length: int, per_shard: int, key: int, counted: dict[int, tuple[int, int]]):
    """Sequences with their slots."""
    n, before = 0, {}
    for part in sorted(counted):
        before[part] = n
        n += counted[part][0]
    width = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, check = tokenizer(), TaskContext.get().partitionId(), 0
        number = before.get(part, 0)
        for ids, texts in _chunks(batches):
            coded = encode(texts)
            size = np.fromiter(map(len, coded), np.int64, len(coded))
            counts = -(-size // width)
            check, total = _check(check, ids, counts), int(counts.sum())
            if number + total > n:
                raise RuntimeError("the second scan saw other rows than the first: write the documents to a table")
            nos = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
            begin = np.append(np.repeat(np.cumsum(size) - size, counts) + nos * width, size.sum())
            docs, data = np.repeat(np.array(ids, np.int64), counts), b"".join(coded)
            for at in range(0, total, SEQUENCES):
                to = min(at + SEQUENCES, total)
                slots, offsets = permuted(np.arange(number + at, number + to), n, key), (begin[at : to + 1] - begin[at]).astype(np.int32)
                parts = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets), pa.py_buffer(data[begin[at] : begin[to]])])
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array((slots // per_shard).astype(np.int32)), pa.array(docs[at:to]), pa.array(nos[at:to].astype(np.int32)), parts], schema=_RECORD)
            number += total
        if (number - before.get(part, 0), check) != counted.get(part, (0, 0)):
            raise RuntimeError("the second scan saw other rows than the first: write the documents to a table")
        released()

    return run


_INDEX = pa.schema([("doc_id", pa.int64()), ("seq_no", pa.int32()), ("slot", pa.int64()), ("shard", pa.int32()), ("byte_offset", pa.int64()), ("n_tokens", pa.int32()), ("ids_crc32", pa.int64())])


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def _write(folder: str, length: int, per_shard: int):
    """Sorted rows of a partition -> one file for each shard in it, read back for the index."""
    stride = 16 + 2 * length

    def record_bytes(rows: list[tuple], first: int) -> bytes:
        data = bytearray(stride * len(rows))
        for k, (slot, doc, no, ids) in enumerate(rows):
            if slot != first + k:
                raise RuntimeError(f"slot {first + k} is missing")
            struct.pack_into("<qii", data, k * stride, doc, no, len(ids) // 2)
            data[k * stride + 16 : k * stride + 16 + len(ids)] = ids
        return bytes(data)

    def read_back(store, name: str, shard: int) -> Iterator[pa.RecordBatch]:
        at = 0
        with store.open_input_file(name) as back:
            while stored := back.read(BLOCK * stride):
                got = [struct.unpack_from("<qii", stored, k) for k in range(0, len(stored), stride)]
                crcs = [zlib.crc32(stored[k * stride + 16 : k * stride + 16 + 2 * g[2]]) for k, g in enumerate(got)]
                places = range(at, at + len(got))
                columns = [[None if g[0] == NO_ID else g[0] for g in got], [g[1] for g in got], [shard * per_shard + k for k in places], [shard] * len(got), [k * stride for k in places], [g[2] for g in got], crcs]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _INDEX, strict=True)], schema=_INDEX)
                at += len(got)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        shard, n, out = None, 0, None
        name = lambda: f"{root}/shard-{shard:08d}.bin"
        temporary = lambda: f"{name()}.{TaskContext.get().taskAttemptId()}.tmp"

        def finished() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                store.move(temporary(), name())
                yield from read_back(store, name(), shard)

        for whole in batches:
            for batch in sliced(whole):
                for of, rows in groupby(zip(*(batch.column(c).to_pylist() for c in ("slot", "doc_id", "seq_no", "ids")), strict=True), lambda r: r[0] // per_shard):
                    if of != shard:
                        yield from finished()
                        shard, n = of, 0
                        out = store.open_output_stream(temporary())
                    rows = list(rows)
                    out.write(record_bytes(rows, shard * per_shard + n))
                    n += len(rows)
        yield from finished()

    return run


def shard_size(n: int) -> int:
    """Sequences in a shard where none are given: PER_SHARD, doubled until there are at most MOST_SHARDS."""
    size = PER_SHARD
    while -(-n // size) > MOST_SHARDS:
        size *= 2
    return size


def materialise(docs: DataFrame, folder: str, tokenizer: Tokenizer | None = None, length: int = LENGTH, per_shard: int | None = None, key: int = KEY) -> DataFrame:
    """Writes the shards and returns their index: doc_id, seq_no, slot, shard, byte_offset, n_tokens, ids_crc32 (as read back)."""
    tokenizer, texts = tokenizer or pieces(), id_and_bytes(docs)
    found = texts.mapInArrow(_count(tokenizer, length), "part int, n long, sum long").collect()
    counted = {r.part: (r.n, r["sum"]) for r in found}
    n = sum(r.n for r in found)
    per_shard = per_shard or shard_size(n)
    write_manifest(folder, {"sequences": n, "length": length, "per_shard": per_shard, "stride": 16 + 2 * length, "key": key})
    rows = texts.mapInArrow(_sequences(tokenizer, length, per_shard, key, counted), "slot long, shard int, doc_id long, seq_no int, ids binary")
    dealt = rows.repartitionById(max(1, -(-n // per_shard)), "shard").sortWithinPartitions("slot")
    return dealt.mapInArrow(_write(folder, length, per_shard), "doc_id long, seq_no int, slot long, shard int, byte_offset long, n_tokens int, ids_crc32 long")


def write_manifest(folder: str, facts: dict[str, int]) -> None:
    """What a reader must know of the shards, beside them."""
    store, root = _filesystem(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(facts).encode())


def read_manifest(folder: str) -> dict[str, int]:
    store, root = _filesystem(folder)
    with store.open_input_file(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def read_slots(folder: str, first: int, count: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(slot, doc_id, seq_no, ids) from slot `first` on, as many as there are up to `count`: one read for each shard
    touched. Lengths and sizes are those of the manifest."""
    facts = read_manifest(folder)
    per_shard, count = facts["per_shard"], min(count, facts["sequences"] - first)
    store, root = _filesystem(folder)
    stride, slot = facts["stride"], first
    while slot < first + count:
        shard, at = divmod(slot, per_shard)
        take = min(per_shard - at, first + count - slot)
        with store.open_input_file(shard_path(root, shard)) as f:
            f.seek(at * stride)
            data = f.read(take * stride)
        for k in range(len(data) // stride):
            doc, no, used = struct.unpack_from("<qii", data, k * stride)
            yield slot + k, doc, no, np.frombuffer(data, "<u2", used, k * stride + 16)
        slot += take


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(documents(spark, sf_dir), fresh_path(spark, "token-shards"))
