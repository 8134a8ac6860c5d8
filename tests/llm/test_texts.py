"""Token shards, sentence pieces, decontamination, secrets, licenses, media: against plain versions."""

import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest

from recordlift.llm import decontamination, licenses, media, secrets, sentencepieces, token_shards
from tests.llm.corpus import EXTRA, folded, frame, rows, with_oddities


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_shards.piece_model())


# --- 1 ---


def test_permutation():
    for n in (1, 2, 3, 17, 256, 1000):
        assert sorted(token_shards.permuted(np.arange(n), n).tolist()) == list(range(n))
    assert token_shards.permuted(np.arange(1000), 1000, 1).tolist() != token_shards.permuted(np.arange(1000), 1000, 2).tolist()


def test_shards_can_be_read_in_order(spark, tmp_path, library):
    data = with_oddities(rows())
    index = token_shards.materialise(frame(spark, data), str(tmp_path), length=8, per_shard=50).collect()
    assert sorted(r.slot for r in index) == list(range(len(index)))
    assert all(r.byte_offset == r.slot % 50 * 32 and r.shard == r.slot // 50 for r in index)
    read = list(token_shards.read_slots(str(tmp_path), 0, len(index) + 9))
    assert [r[0] for r in read] == list(range(len(index)))
    got = {}
    for _, doc, no, ids in read:
        got.setdefault(doc, []).append((no, ids.tolist()))
    ids_of = lambda d: [x for _, part in sorted(got.get(d, [])) for x in part]
    for doc, text in rows()[3:]:
        assert ids_of(doc) == (library.encode(text) if text else [])
    assert len(got[0]) == 2 * math.ceil(len(library.encode(rows()[0][1])) / 8)
    assert [x[0] for x in token_shards.read_slots(str(tmp_path), 45, 20)] == list(range(45, 65))
    assert token_shards.read_manifest(str(tmp_path)) == {"sequences": len(index), "length": 8, "per_shard": 50, "stride": 32, "key": token_shards.KEY}
    whole = {d: library.encode(t or "") for d, t in rows()}
    for r in index:
        if r.doc_id is not None:
            ids = whole[r.doc_id][8 * r.seq_no : 8 * r.seq_no + 8]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u2").tobytes()))


def test_ids_from_a_small_table(library):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdeéü中😀.,\n\tАя019<s>", k=rng.randrange(1, 12))) for _ in range(3000)] + ["  ", " a", "b ", "", "c d", "c  d", "▁", "▁▁x"]
    ids = token_shards.PieceIds(token_shards.piece_model(), room=20_000)
    for k in range(0, len(words), 100):
        texts = [" ".join(words[k : k + 7]), *words[k : k + 100]]
        assert [np.frombuffer(x, "<u2").tolist() for x in ids(texts)] == [library.encode(t) if t else [] for t in texts]
        assert ids.sizes(texts) == [2 * len(library.encode(t)) if t else 0 for t in texts]


def test_segments_are_those_of_whole_texts(library):
    rng = random.Random(13)
    chars = "abcdeéü中😀.,\n\tАя019<s>▁\u3000\xa0\u200b'\"-=(){}/\\#@_:;!?\x00ﬁ\x7f" + " " * 6
    ids = token_shards.PieceIds(token_shards.piece_model(), room=20_000)
    for _ in range(60):
        texts = ["".join(rng.choices(chars, k=rng.randrange(60))) for _ in range(40)] + ["", " ", "  ", "\n", "<0x0A>", "</s>", "<unk>"]
        want = [library.encode(t) if t else [] for t in texts]
        assert [np.frombuffer(x, "<u2").tolist() for x in ids(texts)] == want
        assert ids.sizes(texts) == [2 * len(x) for x in want]
    ids.cuts = False  # as for vocabularies whose texts can't be cut
    assert [np.frombuffer(x, "<u2").tolist() for x in ids(texts)] == want
    assert ids.sizes(texts) == [2 * len(x) for x in want]


def test_a_word_is_encoded_once_whatever_stands_behind_it(library):
    class Counting:
        characters = 0

        def encode(self, texts, **more):
            self.characters += sum(map(len, texts))
            return library.encode(texts, **more)

    rng = random.Random(14)
    words = list({"".join(rng.choices("abcdefgh", k=12)) for _ in range(500)})
    ids = token_shards.PieceIds(token_shards.piece_model())
    ids.sp = Counting()
    ids.sizes([" ".join(w + end for w in words) for end in ("", ",", ".", ".\nThe", "!", ":")])
    assert ids.sp.characters < 2 * sum(map(len, words))


def test_shards_grow_with_the_input():
    assert token_shards.shard_size(0) == token_shards.shard_size(10**8) == token_shards.PER_SHARD
    assert -(-(10**12) // token_shards.shard_size(10**12)) <= token_shards.MOST_SHARDS


def test_no_shards_of_nothing(spark, tmp_path):
    assert token_shards.materialise(frame(spark, []), str(tmp_path)).count() == 0
    assert token_shards.materialise(frame(spark, [(1, None), (2, "")]), str(tmp_path)).count() == 0


# --- 2 ---


def test_pieces_are_those_of_the_library(spark, library):
    rng = random.Random(2)
    odd = ["".join(rng.choices("abcdeéü中😀 .,▁\n\tАя0123456789", k=rng.randrange(0, 60))) for _ in range(300)]
    data = with_oddities(rows()) + [(1000 + i, t) for i, t in enumerate(odd)]
    got = sentencepieces.encode_decode(frame(spark, data)).collect()
    assert len(got) == len(data)
    texts = dict(data)
    for r in got:
        if r.doc_id is not None:
            text = texts[r.doc_id] or ""
            assert list(r.ids) == (library.encode(text) if text else []), repr(text)
            assert r.round_trip and r.decoded_sha256 == sha(text.replace("▁", " ")) and r.n_tokens == len(r.ids)
    assert sentencepieces.encode_decode(frame(spark, [])).count() == 0


def vocabulary_file(path, rule, by_bytes, collapse=True, prefix=True, kind=1, seed=5):
    """A vocabulary of made-up pieces and scores, not trained on anything."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng = random.Random(seed)
    model = pb.ModelProto()
    for piece, type_ in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        model.pieces.add(piece=piece, score=0, type=type_)
    for b in range(256) if by_bytes else ():
        model.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    singles = "▁abcdeé.fi"
    made = dict.fromkeys(singles) | dict.fromkeys("".join(rng.choices("abcdeé", k=rng.randrange(2, 6))) for _ in range(150))
    made |= dict.fromkeys("▁" + "".join(rng.choices("abcde", k=rng.randrange(1, 5))) for _ in range(60))
    for piece in made:
        model.pieces.add(piece=piece, score=-rng.randrange(100, 1200) / 64, type=1)
    model.pieces.add(piece="<own>", score=0, type=4)
    model.trainer_spec.model_type = kind
    model.trainer_spec.byte_fallback = by_bytes
    model.trainer_spec.vocab_size = len(model.pieces)
    spec = pb.ModelProto()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.CopyFrom(spec.normalizer_spec)
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.escape_whitespaces = collapse, prefix, True
    path.write_bytes(model.SerializeToString())
    return str(path), sentencepiece.SentencePieceProcessor(model_file=str(path))


@pytest.mark.parametrize("rule, by_bytes, collapse, prefix", [("nmt_nfkc", True, True, True), ("nfkc_cf", False, True, True), ("identity", True, False, False), ("nmt_nfkc", False, False, True)])
def test_unigram_vocabularies(spark, tmp_path, rule, by_bytes, collapse, prefix):
    path, sp = vocabulary_file(tmp_path / "u.model", rule, by_bytes, collapse, prefix)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdeeé ABﬁ①ｶﾞ\t\u3000.x中😀", k=rng.randrange(0, 30))) for _ in range(300)] + ["", " ", "  a  b ", "<own>ab <own>", "ﬁé\u0301", "▁a▁"]
    got = {r.doc_id: r for r in sentencepieces.encode_decode(frame(spark, list(enumerate(texts))), path).collect()}
    for i, t in enumerate(texts):
        if "<own>" in t and rule != "identity":
            continue  # symbols of the user's are not normalised by the library
        assert list(got[i].ids) == sp.encode(t), (t, got[i].ids, sp.encode(t))
        assert got[i].decoded_sha256 == sha(sp.decode(list(got[i].ids))), t


# --- 3 ---


def plain_contamination(texts, items):
    windows = {}
    for item, text in items:
        w = folded(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    out = []
    for doc, text in texts:
        w, hit, found = folded(text), set(), set()
        for window, own in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("max_bytes", [64 << 20, 3000])
def test_contamination(spark, max_bytes):
    data = [x for x in rows(n=25) if len(x[1] or "") < 5000]
    items = [(1, data[0][1]), (2, " ".join(data[3][1].split()[:14]).upper()), (3, "w1 w2"), (4, ""), (5, None), (None, "w3"), (10, data[4][1]), (10, data[4][1]), (7, "word")]
    docs = frame(spark, data + [(None, "w1 w2")] + ([(0, data[0][1])] if max_bytes > 5000 else []))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs, bench, max_bytes=max_bytes)
    want = plain_contamination(data + [(None, "w1 w2")] + ([(0, data[0][1])] if max_bytes > 5000 else []), [x for x in items if x[0] is not None])
    key = lambda r: (str(r[0]), r[1:])
    assert sorted((tuple(r)[:6] for r in got.collect()), key=key) == sorted(want, key=key)
    kept = decontamination.clean(docs, bench, max_bytes=max_bytes)
    assert kept.columns == docs.columns
    bad = {r[0] for r in want if r[5]}
    assert sorted(str(r.doc_id) for r in kept.collect() if r.doc_id is not None) == sorted(str(r[0]) for r in want if r[0] not in bad and r[0] is not None)


def test_contamination_is_the_same_in_parts(spark):
    data = [x for x in rows(n=25) if len(x[1] or "") < 5000]
    items = [(i, data[i][1]) for i in range(3, 9)] + [(1, "w1 w2"), (2, "w2 w3")]
    clean = " ".join(f"u{i}" for i in range(len(folded(data[3][1]))))
    odd = [data[3], data[3], (data[3][0], clean), (None, data[4][1]), (None, "w1 w2 w3"), (None, clean), (None, None), (None, None)]
    docs, bench = frame(spark, data + odd), spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: tuple(map(str, r))
    whole, parts = ([sorted(map(tuple, f(docs, bench, max_bytes=m).collect()), key=key) for f in (decontamination.decontaminate, decontamination.clean)] for m in (64 << 20, 3000))
    assert len(whole[0]) == len(data + odd) and parts == whole
    assert [r[1] for r in whole[1]].count(clean) == 2 and data[3][1] not in [r[1] for r in whole[1]]


def brute_hits(words, items, width):
    """Hit words and items of one document, each window tried at each place."""
    hit, own = [False] * len(words), set()
    for item, text in items:
        theirs = folded(text)
        n = min(width, len(theirs))
        for window in {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if n else ():
            for s in range(len(words) - n + 1):
                if tuple(words[s : s + n]) == window:
                    hit[s : s + n] = [True] * n
                    own.add(item)
    return hit, sorted(own)


@pytest.mark.parametrize("width", [1, 2, 3, 6, 13])
def test_windows_against_brute_force(width):
    rng = random.Random(width)
    for vocabulary in (["a", "b"], [f"v{i}" for i in range(6)], ["ä", "x", "YZ", "0"]):
        for _ in range(40):
            items = [(i, ", ".join(rng.choices(vocabulary, k=rng.randrange(0, 3 * width + 3)))) for i in range(rng.randrange(0, 5))]
            finder = decontamination.Finder(decontamination.windows_of([(i, t.encode()) for i, t in items], width))
            parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 9))) for _ in range(3)] + [t for _, t in items]
            words = folded(" ".join(rng.sample(parts, len(parts))))
            found = finder.find([w.encode() for w in words])
            hit, own = brute_hits(words, items, width)
            assert (([False] * len(words), []) if found is None else (found[0].tolist(), found[1])) == (hit, own)


def test_equal_letters_are_told_apart_by_text(monkeypatch):
    monkeypatch.setattr(decontamination, "crc32", lambda word: len(word))
    finder = decontamination.Finder(decontamination.windows_of([(1, b"aa b cc d"), (2, b"x")], 3))
    assert finder.find(b"aa b cc e".split())[0].tolist() == [True, True, True, False]
    assert finder.find(b"zz y xx w".split()) is None
    assert finder.find(b"y x".split())[1] == [2]


def test_an_item_is_held_once():
    words = [f"word{i}" for i in range(7000)]
    windows = decontamination.windows_of([(1, " ".join(words).encode()), (2, " ".join(words).encode())])
    assert len(windows.blocks) == 1000 and len(windows.text) == len(" ".join(words)) + 2 and len(windows.hashes) == 7000 - 12


def test_contamination_spans_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "é W1,  w2! no")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert decontamination.decontaminate(docs, bench).first().spans == "2:9"
    assert decontamination.decontaminate(docs, bench.limit(0)).first().n_hit == 0
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0
    assert decontamination.clean(docs, bench.limit(0)).count() == 1


# --- 4 ---


def plain_spans(text):
    found = []
    for nth, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern.replace("\\x20", " "), text):
            if len(m[r.group]) >= r.least:
                found.append((m.start(), nth, r.kind, m.end()))
    return sorted(found)


def test_secrets(spark):
    rng = random.Random(4)
    parts = ["password=", "api_key: ", "Token'=\"", "😀", "AKIA" + "Z" * 16, "AKIA12", "a" * 24, "deadbeef" * 4, "é ", "abc123", "-----BEGIN RSA PRIVATE KEY-----", "eyJa.b-c.d_e", "SECRET := x", "/=+", "\n"]
    data = [(i, "".join(rng.choices(parts, k=rng.randrange(0, 20)))) for i in range(120)] + with_oddities(rows())
    docs = frame(spark, data)
    key = lambda r: tuple(map(str, r))
    want = []
    for doc, text in data:
        spans = plain_spans(text or "")
        said = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
        base = [s for s in spans if s[2] in secrets.BASE]
        want.append((doc, *(sum(s[2] == k for s in base) for k in secrets.BASE), sha(said(base)), said(spans)))
    assert sorted(map(tuple, secrets.scan_secrets(docs).collect()), key=key) == sorted(want, key=key)
    masked = secrets.redact(docs)
    assert masked.columns == docs.columns and masked.count() == len(data)
    assert not [r for r in masked.collect() if r.text and any(s[2] != "assign" for s in plain_spans(r.text))]
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    first = spark.createDataFrame([("p/1", "token=abcdef1"), ("p/2", "token=abcdef1"), ("p/3", None)], "doc_id string, text string")
    second = first.union(spark.createDataFrame([("p/4", "AKIA" + "Q" * 16), ("p/1", "clean now")], "doc_id string, text string"))
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    ledger.scan(first)
    assert ledger._all().count() == 2 * len(secrets.RULES)
    ledger.scan(second)
    assert ledger._all().count() == 4 * len(secrets.RULES)
    newer = secrets.Ledger(spark, ledger.path, (*secrets.RULES[1:], secrets.Rule("assign", 2, "abc", 0, 1, "abc")))
    newer.scan(second)
    assert newer._all().count() == 4 * len(secrets.RULES) + 4
    assert newer.table().count() == 4 * len(secrets.RULES)
    got = sorted((r.path, len(r.spans)) for r in newer.by_path(second).collect())
    assert got == [("p/1", 0), ("p/1", 1), ("p/2", 1), ("p/3", 0), ("p/4", 1)]


def test_private_keys_are_masked_whole(spark):
    head, end, body = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "\n".join(["Proc-Type: 4,ENCRYPTED", "", *["MIIE" + "aB3/" * 15] * 400])
    texts = [f"a {head}\n{body}\n{end} b", f"a {head}\n{'MIIE' * 9}\nxyz= and on", f"{head} open", f"{head}{end}{head}\nAA\n{end}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in secrets.redact(docs).orderBy("doc_id").collect()]
    assert got == ["a [SECRET] b", "a [SECRET] and on", "[SECRET] open", "[SECRET][SECRET]"]


def test_ledger_is_asked_before_texts_move(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"token=abcdef{i % 5}") for i in range(20)], "doc_id long, text string")
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    ledger.scan(docs)
    files = sorted(p.name for p in (tmp_path / "ledger").iterdir())
    ledger.scan(docs.union(docs))
    assert sorted(p.name for p in (tmp_path / "ledger").iterdir()) == files
    more = docs.union(spark.createDataFrame([(99, "token=other99")], "doc_id long, text string"))
    for most in (secrets.MOST_SENT, 0):
        ledger = secrets.Ledger(spark, str(tmp_path / f"ledger-{most}"))
        ledger.scan(docs)
        old, secrets.MOST_SENT = secrets.MOST_SENT, most
        try:
            ledger.scan(more)
        finally:
            secrets.MOST_SENT = old
        assert ledger._all().count() == 6 * len(secrets.RULES) and ledger.findings().count() == 6


# --- 6 ---


def plain_licenses(text):
    line, places, own = folded(text), [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(line) - len(p) + 1) if line[i : i + len(p)] == p]
        places += at
        own |= {label} if at else set()
    share, names = 0.0, set()
    for name, template in licenses.TEMPLATES.items():
        t, w = set(folded(template)), math.ceil(len(folded(template)) * 1.25)
        for begin in range(0, len(line), w):
            words = set(line[begin : begin + 2 * w])
            if len(t & words) >= (len(t) if len(t) < 10 else math.ceil(0.8 * len(t) - 1e-9)) and not words & set(licenses.BARRED.get(name, ())):
                names.add(name)
                share = max(share, len(t & words) / len(t))
    return len(line), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(own | names)), 1.0 if own else share


@pytest.mark.parametrize("name", ["mit-text", "bsd-3-text", "apache-2-header", "gpl-header", "bsd-notice"])
def test_wrapped_licenses_are_found(spark, name):
    words = licenses.TEMPLATES[name].split()
    wrapped = "\n".join(" * " + " ".join(words[k : k + 7]) for k in range(0, len(words), 7))
    filler = " ".join(f"q{i}" for i in range(150))
    docs = spark.createDataFrame([(1, filler + "\n" + wrapped + "\n" + filler), (2, filler), (3, " ".join(words[: len(words) // 2]))], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.find_licenses(docs).collect()}
    assert name in got[1].labels.split(",") and got[1].score == 1.0
    assert (got[2].labels, got[2].score) == ("", 0.0) and name not in got[3].labels.split(",")


def test_notices_of_other_licenses_get_no_label(spark):
    others = ["released under the BSD license", "released it to the public under a new license", "this work is licensed under the GNU Lesser General Public License version 3", "licensed under cc by 4 0 sa"]
    docs = spark.createDataFrame(list(enumerate([*others, "released under the MIT license"])), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.find_licenses(docs).collect()}
    assert [got[k] for k in range(4)] == [""] * 4 and got[4] == "mit,mit-notice"


def test_licenses(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(150):
        words = rng.choice(list(licenses.TEMPLATES.values())).split()
        rng.shuffle(words) if rng.random() < 0.3 else None
        words = [w for w in words if rng.random() > 0.12] + rng.choices(["Under", "the", "MIT", "x", "cc by nc", "apache license version 2"], k=rng.randrange(4))
        texts.append(rng.choice(["a b\n", "Yes. ", ""]) + rng.choice([" ", ", ", "\t"]).join(words) + rng.choice(["", ". The end", "\nunder THE mit License"]))
    data = [(100 + i, t) for i, t in enumerate(texts)] + with_oddities(rows())
    key = lambda r: tuple(map(str, r))
    got = sorted(map(tuple, licenses.find_licenses(frame(spark, data)).collect()), key=key)
    want = sorted(((d, *plain_licenses(t)) for d, t in data), key=key)
    assert got == want
    assert licenses.find_licenses(frame(spark, [])).count() == 0


# --- 9 ---


def test_media(spark, tmp_path):
    data = with_oddities(rows())
    docs = frame(spark, data)
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = media.op9_media(spark, str(tmp_path)).collect()
    assert len(got) == len(data)
    texts = {d: t for d, t in data if d is not None}
    for r in got:
        if r.doc_id is None:
            continue
        raw = (texts[r.doc_id] or "").encode()
        payload = media.padded(raw)
        picture = media.to_picture(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.caption) == (len(picture), hashlib.sha256(picture).hexdigest(), f"{len(raw)} bytes")


def test_interleaving(spark):
    page = '<p>One <b>two</b></p><script>x</script><figure><img src="sha256:00" alt="no"><figcaption>Said <i>so</i></figcaption></figure><img src="sha256:zz" alt="a">&amp; end<img alt="no source">'
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, html string")
    got = {r.id: [(p.position, p.kind, p.text, p.ref, p.caption) for p in r.parts] for r in media.interleave(pages).collect()}
    assert got == {1: [(0, "text", "One", None, None), (1, "text", "two", None, None), (2, "media", None, "sha256:00", "Said so"), (3, "media", None, "sha256:zz", "a"), (4, "text", "& end", None, None)], 2: [], 3: []}
    store = spark.createDataFrame([(b"\x00", 1, media.to_picture(bytes(64)))], "digest binary, n_bytes long, media binary")
    rows_ = media.resolve(media.interleave(pages), store.union(store)).collect()
    assert sorted((r.position, r.payload_bytes) for r in rows_) == [(0, None), (1, None), (2, 64), (3, None), (4, None)]


def test_no_text_of_a_page_is_lost(spark):
    pages = {
        1: "<figcaption>lost words</figcaption>",
        2: "<p>a</p><figure><figcaption>open tail",
        3: "<noscript>never closed body",
        4: '<figure><figcaption>first</figcaption><img src="x"><figure><img src="y"><figcaption>inner</figcaption></figure><img src="z" alt="no"></figure>',
        5: '<figure><figcaption>one</figcaption><p>t</p></figure>b<template>gone<template>x</template>y</template>c',
        6: "<script>if (a < b) </script>d<style>p{}</style>e",
        7: '<figure><img src="u" alt="said"></figure></figure></figcaption>f<img src="v"/>',
    }
    got = {r.id: [(p.kind[0], p.text or p.ref, p.caption) for p in r.parts] for r in media.interleave(spark.createDataFrame(list(pages.items()), "id long, html string")).collect()}
    assert got == {
        1: [("t", "lost words", None)], 2: [("t", "a", None), ("t", "open tail", None)], 3: [("t", "never closed body", None)],
        4: [("m", "x", "first"), ("m", "y", "inner"), ("m", "z", "first")], 5: [("t", "one", None), ("t", "t", None), ("t", "b", None), ("t", "c", None)],
        6: [("t", "d", None), ("t", "e", None)], 7: [("m", "u", "said"), ("t", "f", None), ("m", "v", None)],
    }


def plain_page(page):
    """Texts of a page without comments, scripts and styles, cut at its tags."""
    page = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<(script|style)>.*?</\1>", "<>", page)
    return [" ".join(html.unescape(t).split()) for t in re.split(r"<[^>]*>", page) if html.unescape(t).strip()]


def test_parts_of_whole_pages(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {}
    for r in media.interleave_pages(spark, sf).collect():
        got.setdefault(r.page_id, []).append((r.position, r.text or (r.caption, r.n_bytes, r.media_sha256)))
    assert len(got) == len(pages)
    for r in pages:
        want = []
        *bodies, tail = r.html.split("</article>")
        for body in bodies:
            want += plain_page(body)
            if (raw := docs.get(r.page_id)) is not None:
                want.append((f"Document {r.page_id}", len(raw), hashlib.sha256(media.to_picture(media.padded(raw))).hexdigest()))
        assert [x for _, x in sorted(got[r.page_id])] == want + plain_page(tail)


def test_features_of_a_picture(spark):
    payload = bytes([0, 16, 32, 255] * 32)
    store = spark.createDataFrame([(b"d", 5, media.to_picture(payload))] * 3, "digest binary, n_bytes long, media binary")
    (row,) = media.media_features(store).collect()
    grid = [list(payload[k : k + 64]) for k in (0, 64)]
    mean = sum(payload) / 128
    std = math.sqrt(sum((x - mean) ** 2 for x in payload) / 128)
    rise = sum(abs(a - b) for r in grid for a, b in zip(r, r[1:])) / 128
    hist = [sum(x >> 4 == k for x in payload) for k in range(16)]
    assert row.feature == f"mean={mean:.4f};std={std:.4f};step={rise:.4f};hist={'/'.join(map(str, hist))}" and row.n_bytes == 5


def test_extra_columns_are_there():
    assert EXTRA.count(",") > 10
