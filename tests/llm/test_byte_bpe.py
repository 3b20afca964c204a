"""Byte-level BPE by tree reduction against the tiktoken library."""

import hashlib
import random

import pytest

from focusloom.llm import byte_bpe

SF = "/root/testdata/sf0.001"
#: Letters that make borders hard: words, runs without white space, contractions, wide code points.
ALPHABETS = ["ab", "abcdefgh ", "  \n\t a'", "'sredlvtm x", "aé漢字 1", "漢字仮名", "\n \r\n", "= \"/<>"]


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.coder(byte_bpe.ranks_path())


@pytest.mark.parametrize("leaf", [1, 3, 17, 64])
def test_tree_gives_the_librarys_ids(coder, monkeypatch, leaf):
    monkeypatch.setattr(byte_bpe, "LEAF", leaf)
    r = random.Random(leaf)
    for _ in range(600):
        text = "".join("".join(r.choices(r.choice(ALPHABETS), k=r.randint(0, 200))) for _ in range(2))
        assert coder.span(text).ids.tolist() == coder.library.encode_ordinary(text), text


@pytest.mark.parametrize("unit", ["a", " ", "漢", "'", "'s", "\n", " a", "="])
def test_long_runs(coder, monkeypatch, unit):
    monkeypatch.setattr(byte_bpe, "LEAF", 256)
    text = unit * 5001 + "x"
    assert coder.span(text).ids.tolist() == coder.library.encode_ordinary(text)


def test_a_window_grows_until_its_neighbours_stand(coder):
    r = random.Random(5)
    for _ in range(200):
        data = "".join(r.choices("etaoin", k=r.randint(2, 400))).encode()
        at = r.randint(1, len(data) - 1)
        assert coder.grow(coder.match(data[:at]), coder.match(data[at:])) == coder.match(data)


def expected(coder, rows):
    out = []
    for i, text in rows:
        ids = coder.library.encode_ordinary(text or "")
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows_and_spans_over_tasks(spark, coder):
    r = random.Random(9)
    long = " ".join("".join(r.choices("abcdefgh'", k=r.randint(1, 9))) for _ in range(9000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, long), (4, long), (None, "x" * 5000), (5, "two words"), (5, "two words"), (6, "漢" * 3000)]
    docs = spark.createDataFrame([(i, t, "k", 0, 0) for i, t in rows], "doc_id long, text string, key string, row long, k int")
    got = byte_bpe.encode(docs, size=100).collect()  # 500 spans and more: several levels of the tree
    assert sorted((str(g.doc_id), g.ids) for g in got) == sorted((str(i), coder.library.encode_ordinary(t or "")) for i, t in rows)
    assert sorted(map(tuple, byte_bpe.digest(docs).collect()), key=str) == expected(coder, rows)
    assert byte_bpe.digest(docs.where("false")).collect() == []
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, byte_bpe.decode(none).collect())) == [(1, None), (2, b"")]


def test_whole_documents(spark, coder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, byte_bpe.digest(docs).collect()), key=str) == expected(coder, rows)
