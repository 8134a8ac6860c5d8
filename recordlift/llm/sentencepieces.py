"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

Compiled once from a vocabulary file:
- the normaliser: the file's table of replacements (the longest that fits), white space collapsed or not, one space
  mark in front or not, every space to a mark, all other characters to themselves;
- the pieces: an arc for each piece from the place where it begins to the place where it ends;
- byte fallback: an arc for a character that no piece covers, which puts out its bytes' ids, or the unknown piece's
  where the vocabulary has no bytes.

Composed with an input, a state is a place in the input together with the piece that ends there; the path sought is
the shortest in the tropical semiring (weights add along a path, the least sum wins).
- In a vocabulary with a score for each piece (unigram), an arc weighs minus its piece's score, an unknown character
  10 more than the heaviest piece, and a state needs no more than its place. Sums are those of exact weights in double
  precision; the library adds in single precision, so near-ties of long texts may fall the other way.
- In a vocabulary of merges a path is the library's encoding exactly if merging the text of each two neighbouring
  pieces by itself gives those two pieces again; an arc weighs nothing if that holds for it and the piece before, and
  infinity if not. So each place has one state of finite weight at most, and the shortest path is found from left to
  right. (Weighing pieces by their scores instead would give other ids than the library does for this kind.)
No piece has a mark behind another character, so paths meet before each mark: the path of a text is that of its words,
which are kept in a table of bounded size. A unigram vocabulary with other pieces is searched over whole texts.

Defined results: null and empty texts have no ids and decode to the empty text; the mark U+2581 in a text is a
space, as in the library; repeated rows each get their row; an empty table gives an empty result; further columns
are ignored. Bytes that are no UTF-8 become U+FFFD before encoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from recordlift.llm.common import Table, documents, id_and_bytes, released, sha256_hex, sliced
from recordlift.llm.token_shards import packed, piece_model

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Normaliser:
    """A text as its vocabulary's pieces spell it, from the specification in the vocabulary file."""

    def __init__(self, spec):
        self.prefix, self.collapse, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.units, self.strings = np.zeros(0, np.uint32), b""
        if table := spec.precompiled_charsmap:
            # bytes of the trie, the trie as a double array, the replacements with a zero byte behind each
            size = int.from_bytes(table[:4], "little")
            self.units, self.strings = np.frombuffer(table, "<u4", size // 4, 4), table[4 + size :]
        self.plain = not len(self.units) and not self.collapse

    def _longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest key that stands here, and the place behind the key."""
        offset = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
        found, node = None, offset(int(self.units[0]))
        for i in range(at, len(data)):
            node ^= data[i]
            unit = int(self.units[node])
            if unit & 0x800000FF != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                begin = int(self.units[node]) & 0x7FFFFFFF
                found = self.strings[begin : self.strings.index(0, begin)], i + 1
        return found

    def _replaced(self, text: str) -> list[str]:
        if not len(self.units):
            return list(text)
        data, at, out = text.encode(), 0, []
        ends = set(np.cumsum([len(c.encode()) for c in text]).tolist())
        while at < len(data):
            if found := self._longest(data, at):
                out.append(found[0].decode("utf-8", "replace"))
                at = found[1]
            else:
                end = next(e for e in range(at + 1, at + 5) if e in ends)
                out.append(data[at:end].decode())
                at = end
        return out

    def __call__(self, text: str) -> str:
        mark = MARK if self.escape else " "
        if self.plain:
            return (mark if self.prefix else "") + text.replace(" ", mark) if text else ""
        parts = self._replaced(text)
        if not self.collapse:
            return (mark if self.prefix else "") + "".join(parts).replace(" ", mark) if text else ""
        out, space = [], True
        for part in parts:
            part = part.lstrip(" ") if space else part
            if part:
                out.append(part)
                space = part.endswith(" ")
        whole = "".join(out).rstrip(" ")
        whole = whole.replace(" ", mark)
        while whole.endswith(mark):
            whole = whole[: -len(mark)]
        return (mark if self.prefix else "") + whole if whole else ""

    def shown(self, text: str) -> str:
        """The normalised text with spaces for marks and without the one in front: what decoding should give."""
        whole = self(text).replace(MARK, " ")
        if self.collapse:
            return whole.lstrip(" ")
        return whole[1:] if self.prefix and whole[:1] == " " else whole


class Vocabulary:
    """Pieces, byte pieces and normaliser of a vocabulary file, and what its ids put out."""

    def __init__(self, sp, model):
        self.normaliser, size = Normaliser(model.normalizer_spec), sp.get_piece_size()
        self.unknown, self.kind = sp.unk_id(), "<u2" if size <= 1 << 16 else "<u4"
        self.usable = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in self.usable}
        self.byte_ids = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.in_words = not any(MARK in p.lstrip(MARK) for p in self.text.values())
        self.put_out = [sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        for b, i in self.byte_ids.items():
            self.put_out[i] = bytes([b])
        for i in range(size):
            if sp.is_control(i):
                self.put_out[i] = b""
        self.put_out[self.unknown] = model.trainer_spec.unk_surface.encode()

    def fallback(self, chars: str) -> list[int]:
        """Ids of characters that no piece covers."""
        return [self.byte_ids[b] for b in chars.encode()] if self.byte_ids else [self.unknown] * len(chars)


class UnigramTransducer(Vocabulary):
    """Pieces weighted by their scores."""

    def __init__(self, sp, model):
        super().__init__(sp, model)
        scores = {i: p.score for i, p in enumerate(model.pieces)}
        normal = [scores[i] for i in self.usable if model.pieces[i].type == 1]
        most, self.unknown_weight = max(normal, default=0.0), 10.0 - min(normal, default=0.0)
        # character -> (node it leads to, piece that ends there or -1, weight)
        self.trie: dict[str, tuple[dict, int, float]] = {}
        for i in sorted(self.usable, key=lambda i: len(self.text[i])):
            own = model.pieces[i].type == 4  # a symbol of the user's, which is always taken
            node, text = self.trie, self.text[i]
            for ch in text[:-1]:
                node = node.setdefault(ch, ({}, -1, 0.0))[0]
            node[text[-1]] = (node[text[-1]][0] if text[-1] in node else {}, i, 0.1 - len(text.encode()) * most if own else -scores[i])

    def path(self, word: str, seams: Table) -> list[int]:
        """Ids of the shortest path; of equal ones that whose last arc begins first."""
        n = len(word)
        best: list[float] = [0.0, *[float("inf")] * n]
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        for j in range(n):
            node, here, single = self.trie, best[j], False
            for i in range(j, n):
                arc = node.get(word[i])
                if arc is None:
                    break
                node, piece, weight = arc
                if piece >= 0:
                    single = single or i == j
                    if here + weight < best[i + 1]:
                        best[i + 1], came[i + 1] = here + weight, (j, piece)
            if not single and here + self.unknown_weight < best[j + 1]:
                best[j + 1], came[j + 1] = here + self.unknown_weight, (j, -1)
        out: list[list[int]] = []
        while n:
            j, piece = came[n]
            out.append([piece] if piece >= 0 else self.fallback(word[j:n]))
            n = j
        return [i for part in reversed(out) for i in part]


class PieceTransducer(Vocabulary):
    """Pieces made by merges."""

    def __init__(self, sp, model):
        super().__init__(sp, model)
        usable = self.usable
        self.ids = {p: i for i, p in self.text.items()}
        if not self.in_words:
            raise ValueError("the vocabulary has merges that span a space")
        order = sorted(usable, key=lambda i: -sp.get_score(i))
        self.rank = {i: r for r, i in enumerate(order)}
        # the last merge that makes each piece; pieces that merging never makes have no arc
        self.halves: dict[int, tuple[int, int] | None] = {}
        for i in usable:
            made = self._last_merge(self.text[i])
            if made is not False:
                self.halves[i] = made
        # character -> (node it leads to, piece that ends there or -1)
        self.trie: dict[str, tuple[dict, int]] = {}
        for i in sorted(self.halves, key=lambda i: len(self.text[i])):
            self._add_arc(i)

    def _add_arc(self, piece: int) -> None:
        node, text = self.trie, self.text[piece]
        for ch in text[:-1]:
            node = node.setdefault(ch, ({}, -1))[0]
        node[text[-1]] = (node[text[-1]][0] if text[-1] in node else {}, piece)

    def _last_merge(self, piece: str):
        parts, last = list(piece), None
        while len(parts) > 1:
            merges = [(self.rank[self.ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ids]
            if not merges:
                return False
            k = min(merges)[1]
            last = (self.ids.get(parts[k]), self.ids.get(parts[k + 1]))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return last

    def stay_apart(self, a: int, b: int) -> bool:
        """Merging the text of these two pieces gives them again: undo their merges, latest first, and see whether
        one across the seam would have come earlier."""
        limit = float("inf")
        while True:
            across = self.ids.get(self.text[a] + self.text[b])
            if across is not None and self.rank[across] < limit:
                return False
            for side in ("left", "right") if self.rank[a] > self.rank[b] else ("right", "left"):
                if side == "left" and self.halves[a]:
                    limit, a = self.rank[a], self.halves[a][1]
                    break
                if side == "right" and self.halves[b]:
                    limit, b = self.rank[b] + 1, self.halves[b][0]
                    break
            else:
                return True

    def path(self, word: str, seams: Table) -> list[int]:
        """Ids of the shortest path through one word. From each place the arcs' trie is followed as far as it goes."""
        n = len(word)
        # piece that ends at each place (-1: any may follow, -2: no path of finite weight), and where it began
        ends: list[tuple[int, int] | None] = [(-1, 0), *[None] * n]
        for j in range(n + 1):
            state = ends[j]
            if state is None:
                state = ends[j] = (-2 if word[j - 1] in self.ids else -1, j - 1)
            before, node = state[0], self.trie
            if before == -2:
                continue
            for i in range(j, n):
                arc = node.get(word[i])
                if arc is None:
                    break
                node, piece = arc
                if piece < 0 or ends[i + 1] is not None:
                    continue
                if before >= 0:
                    if (seam := seams.get((before, piece))) is None:
                        key = (before, piece)
                        if (seam := seams.recall(key, 0)) is None:
                            seam = seams.keep(key, self.stay_apart(before, piece), 0)
                    if not seam:
                        continue
                ends[i + 1] = (piece, j)
        out: list[int] = []
        while n:
            piece, j = ends[n]
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(reversed(self.fallback(word[j:n])))
            n = j
        return out[::-1]


def compiled(path: str) -> UnigramTransducer | PieceTransducer:
    """The transducer of a vocabulary file; small enough to be sent with a task (its size is that of the vocabulary)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(sp.serialized_model_proto())
    if model.trainer_spec.treat_whitespace_as_suffix or model.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and merge vocabularies with space marks in front are compiled")
    return (UnigramTransducer if model.trainer_spec.model_type == 1 else PieceTransducer)(sp, model)


class Codec:
    """Encodes and decodes in one Python worker, which keeps the tables of words and seams from task to task."""

    def __init__(self, transducer: UnigramTransducer | PieceTransducer):
        self.t, self.words, self.seams = transducer, Table(72 << 20), Table(32 << 20)

    def _word(self, word: str) -> bytes:
        if (ids := self.words.recall(word, 3 * len(word))) is not None:
            return ids
        path = self.t.path(word, self.seams)
        ids = packed(path) if self.t.kind == "<u2" else np.array(path, self.t.kind).tobytes()
        return self.words.keep(word, ids, 3 * len(word))

    def encode(self, text: str) -> np.ndarray:
        known, out = self.words, []
        whole = self.t.normaliser(text)
        for w in _WORDS.findall(whole) if self.t.in_words else [whole] if whole else []:
            ids = known.get(w)
            out.append(self._word(w) if ids is None else ids)
        made = np.frombuffer(b"".join(out), self.t.kind)
        if self.t.byte_ids:
            return made
        # unknown characters one behind another are one unknown piece
        unknown = made == self.t.unknown
        return made[~(unknown & np.concatenate(([False], unknown[:-1])))] if len(made) else made

    def decode(self, ids: np.ndarray) -> str:
        parts = list(map(self.t.put_out.__getitem__, ids.tolist()))
        if self.t.normaliser.prefix or self.t.normaliser.collapse:
            # the mark in front goes; of a vocabulary that collapses spaces, the marks of all pieces up to the first letter
            for k, part in enumerate(parts):
                if ids[k] != self.t.unknown and part[:1] == b" ":
                    parts[k] = part = part[1:]
                    if not part and self.t.normaliser.collapse:
                        continue
                break
        return b"".join(parts).decode("utf-8", "replace")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_fallback", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])
SCHEMA = "doc_id long, n_tokens long, n_fallback long, ids array<int>, decoded_sha256 string, round_trip boolean"
_here: dict[str, Codec] = {}


def codec_of(path: str, transducer: Broadcast) -> Codec:
    """The worker's codec; a function of the module, since functions made for a task have copies of its globals."""
    if path not in _here:
        _here.clear()
        _here[path] = Codec(transducer.value)
    return _here[path]


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_fallback (byte ids), ids, decoded_sha256, round_trip: a row for each document."""
    path = model or piece_model()
    transducer = docs.sparkSession.sparkContext.broadcast(compiled(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, transducer)
        low, high = min(codec.t.byte_ids.values(), default=0), max(codec.t.byte_ids.values(), default=-1)
        for whole in batches:
            for batch in sliced(whole, 2 << 20):
                ids, meta = [], []
                for raw in batch.column(1).to_pylist():
                    text = raw.decode("utf-8", "replace")
                    x = codec.encode(text)
                    back = codec.decode(x)
                    ids.append(x)
                    meta.append((len(x), int(((x >= low) & (x <= high)).sum()), sha256_hex(back.encode()), back == codec.t.normaliser.shown(text)))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                n, fell, shas, same = zip(*meta, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fell, pa.int64()), lists, pa.array(shas), pa.array(same)], schema=_OUT)
        released()

    return id_and_bytes(docs).mapInArrow(run, SCHEMA)


def op2_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir))
