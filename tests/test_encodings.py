"""Encodings told by statistics: texts written in each and read again."""

import random

import pytest
from pyspark.sql import functions as F

from recordlift.sources.encodings import SINGLE_BYTE, encoded, guessed
from recordlift.sources.files import decode_files, read_files

RUSSIAN = "в начале года город строит новую дорогу и мост через реку жители ждут открытия Весной Москва Пётр сказал что это хорошо"
FRENCH = "la forêt était déjà très belle à cette époque où les élèves français étudiaient même le week-end über die Straße größere Bäume für später"


def texts(words, seed, n=30):
    rng = random.Random(seed)
    return [" ".join(rng.choices(words.split(), k=rng.randrange(8, 30))) + rng.choice(["", ".", ", 12 km", " (abc)"]) for _ in range(n)]


@pytest.mark.parametrize("encoding", ["cp1251", "koi8-r", "cp866", "iso8859-5", "latin-1", "utf-16-le", "utf-16-be", "utf-8"])
def test_encodings_are_told(spark, encoding):
    made = texts(FRENCH, 1) if encoding == "latin-1" else texts(RUSSIAN, 2)
    files = spark.createDataFrame([(k, t.encode(encoding)) for k, t in enumerate(made)], "doc_id long, content binary")
    got = {r.doc_id: r for r in decode_files(files, guess=True).collect()}
    wanted = "utf-8-sig" if encoding == "utf-8" else encoding
    assert [got[k].text for k in range(len(made))] == made
    assert {r.encoding for r in got.values()} == {wanted} and {r.odd_encoding for r in got.values()} == {encoding != "utf-8"}


def test_odd_contents(spark):
    made = [b"", b"\x98", b"\xff\xfea\x00", b"\xfe\xff\x00a", b"\xef\xbb\xbfabc", b"\x80", b"a\x00b\x00", b"\x00", b"\xdf\xf7 1.", None]
    files = spark.createDataFrame(list(enumerate(made)), "`a.b` long, content binary")
    got = {r[0]: (r.text, r.encoding) for r in decode_files(files, guess=True).collect()}
    assert len(got) == len(made)
    assert got[0] == ("", "utf-8-sig") and got[2] == ("a", "utf-16-le") and got[3] == ("a", "utf-16-be") and got[4] == ("abc", "utf-8-sig") and got[6] == ("ab", "utf-16-le") and got[9][0] is None
    assert got[1][1] == "latin-1"  # no confident answer: the rules decide


def test_confidence(spark):
    rows = spark.createDataFrame([("в начале было слово".encode("koi8-r"),), (b"\xb9",), (b"abc",)], "content binary").select(guessed(F.col("content")).alias("g")).collect()
    assert rows[0].g.encoding == "koi8-r" and rows[0].g.confidence > 0.99
    assert rows[1].g.confidence < 0.7 and rows[2].g.confidence == 0


def test_written_and_read(spark, tmp_path):
    for name, text, encoding in (("a.txt", RUSSIAN, "koi8-r"), ("b.txt", FRENCH, "latin-1"), ("c.txt", RUSSIAN, "utf-16")):
        (tmp_path / name).write_bytes(text.encode(encoding))
    got = {r.doc_id.rsplit("/", 1)[1]: (r.text, r.encoding) for r in read_files(spark, str(tmp_path), guess=True).collect()}
    assert got == {"a.txt": (RUSSIAN, "koi8-r"), "b.txt": (FRENCH, "latin-1"), "c.txt": (RUSSIAN, "utf-16-le")}


def test_encoding_of_columns(spark):
    row = spark.createDataFrame([(RUSSIAN,)], "t string")
    for name in (*SINGLE_BYTE, "utf-16-le", "utf-16-be"):
        if name != "latin-1":
            assert bytes(row.select(encoded(F.col("t"), name)).first()[0]) == RUSSIAN.encode(name)


def test_pairs_are_scored_as_kinds_and_letters(spark):
    """The table of pairs has the sums of the model, and the statistics stand once in the plan."""
    from pyspark.sql import functions as F

    from recordlift.sources.encodings import SINGLE_BYTE, _pair_scores, log_likelihoods, model
    from recordlift.sources.files import guessed_encoding

    content = "в начале Пётр, é и z".encode("cp1251", "ignore") + b"\x98\xe9 ab\xff"
    row = spark.createDataFrame([(content, bytearray(b"plain"))], "c binary, p binary").select(log_likelihoods(F.decode("c", "iso-8859-1")).alias("x"), log_likelihoods(F.decode("p", "iso-8859-1")).alias("none")).first()
    import re

    runs = " ".join(re.findall("[\x00-\x7f]?[\x80-\xff]+[\x00-\x7f]?", content.decode("latin-1"))).encode("latin-1")
    for got, name in zip(row.x, SINGLE_BYTE, strict=True):
        kinds, letters, steps = model(name)
        begin, scores = _pair_scores(name)
        wanted = sum(letters[x] + steps[kinds[a] * 6 + kinds[x]] for a, x in zip(b" " + runs, runs) if a > 127 or x > 127)
        assert abs(got - wanted) < 1e-9 and scores[begin[32] + 0xE9] == letters[0xE9] + steps[kinds[32] * 6 + kinds[0xE9]]
    assert row.none == [0.0] * len(SINGLE_BYTE)
    plan = spark.range(1).select(guessed_encoding(F.lit(content)).alias("e"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1
