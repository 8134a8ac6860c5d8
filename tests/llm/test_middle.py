"""Fill-in-the-middle against a plain version, with texts cut in place and with chunks dealt over tasks."""

import hashlib
import random
import re

import duckdb
import pytest

from recordlift.llm import fill_middle
from tests.llm.corpus import frame, rows, with_oddities

DATA = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_middle(doc_id, text, rate=100, spm=50, seed=7):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, sha(t), sha(t), t
    form = "spm" if h[3] % 100 < spm else "psm"
    output = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), form, len(p), len(m), sha(output), sha(t), output


def lined(seed=5):
    """Texts with many lines, empty lines, marks, characters of several bytes, and ends of lines at every kind of border."""
    rng = random.Random(seed)
    made = ["".join(rng.choices(["a", "ж", "😀", "<", "<P", "S>", "\n", "\n\n", "word ", "\r\n"], k=rng.randrange(0, 200))) for _ in range(120)]
    made += ["\n", "\n\n\n", "x", "x\n", "\nx", "a\n<P>\nb", "<M>", "<S", "a<" + "\n" * 40, "\n".join(f"line {k} é" for k in range(3000)), ("z" * 999 + "\n") * 50 + "end"]
    return list(enumerate(made + [t for _, t in rows(n=10)]))


@pytest.mark.parametrize("chunk, long", [(fill_middle.CHUNK, fill_middle.LONG), (7, 1 << 30), (7, 0), (64, 200), (1, 300)])
def test_fill_in_middle(spark, chunk, long):
    data = with_oddities(lined())
    if chunk < 10 and long < 1000:
        data = [(d, t) for d, t in data if len(t or "") < 2000]
    got = fill_middle.fill_in_middle(frame(spark, data), chunk=chunk, long=long).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted(map(tuple, got), key=key) == sorted((plain_middle(d, t) for d, t in data), key=key)


@pytest.mark.parametrize("rate, spm, long", [(60, 100, 0), (60, 100, 1 << 20), (100, 0, 50)])
def test_rates(spark, rate, spm, long):
    data = [(d, t) for d, t in lined(9) if len(t or "") < 3000]
    got = fill_middle.fill_in_middle(frame(spark, data), seed=3, rate=rate, spm=spm, chunk=32, long=long).collect()
    assert sorted(map(tuple, got)) == sorted(plain_middle(d, t, rate, spm, 3) for d, t in data)
    forms = {r.form for r in got}
    assert forms == ({"plain", "spm"} if spm == 100 else {"plain", "psm"})


def test_outputs_are_restored(spark):
    data = lined(2)
    made = fill_middle.fill_in_middle(frame(spark, data))
    got = {r.doc_id: r.t for r in made.select("doc_id", fill_middle.restored(made.output, made.form).alias("t")).collect()}
    assert got == {d: t or "" for d, t in data}


def test_nothing(spark):
    assert fill_middle.fill_in_middle(frame(spark, [])).count() == 0


def test_query_against_sql(spark):
    got = sorted(map(tuple, fill_middle.op11_fill_middle(spark, DATA).collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        assert got == sorted(db.execute(fill_middle.OP11_SQL).fetchall())
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
