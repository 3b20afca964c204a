"""Spelling variants against a plain version."""

import collections
import random
import re
import zlib

import pytest

from focusloom.llm import spelling

SF = "/root/testdata/sf0.001"
ASCII = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain_words(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_near(words):
    """{word: its near words}, each pair compared that shares a first or a last letter (one edit leaves one of them)."""
    near = {w: set() for w in words}
    for end in (0, -1):
        groups = collections.defaultdict(list)
        for w in words:
            groups[w[end]].append(w)
        for group in groups.values():
            for a in group:
                near[a] |= {b for b in group if abs(len(a) - len(b)) < 2 and one_apart(a, b)}
    return near


def plain(rows):
    words = plain_words(rows)
    near = plain_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_words", [3, 40, 5000])
def test_near_words_in_any_shards(spark, shard_words):
    r = random.Random(shard_words)
    words = {"".join(r.choices("ab", k=r.randint(7, 9))) for _ in range(150)}  # dense: halves shared by many, letters in a row
    words |= {"abcdefg" + "".join(r.choices("xyzé", k=r.randint(0, 3))) for _ in range(60)} | {"überfall", "uberfall", "überfal", "aaaaaaa", "aaaaaaaa"}
    counts = {w: r.randint(2, 9) for w in words}
    got = spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), shard_words).collect()
    near = plain_near(counts)
    want = []
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-counts[o], o))
            want.append((w, len(others), counts[best], best))
    assert sorted(map(tuple, got)) == sorted(want)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Größere GRÖSSERE größere " * 40), (3, "gröbere grösere"), (None, "grössere grösser " * 3), (4, "x" * 3000 + " " + "x" * 3000), (5, "naïvely naïvely naïvly naïvly"), (5, "naïvely " * 30), (6, "123 !?\n")]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    assert sorted(map(tuple, spelling.variants(docs).collect()), key=str) == plain(rows)
    assert spelling.variants(docs.where("false")).collect() == []


def test_chains_end_at_the_last_form(spark):
    rows = [(i, " ".join(["abcdefgh"] * 3000 + ["abcdefgx"] * 250 + ["abcdefyx"] * 20 + ["abcdezyx"] * 2)) for i in (1, 2)]
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), damaged=10**9).collect()}
    assert got == {"abcdefgh": (None, "abcdefgh"), "abcdefgx": ("abcdefgh", "abcdefgh"), "abcdefyx": ("abcdefgx", "abcdefgh"), "abcdezyx": ("abcdefyx", "abcdefgh")}


def test_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, spelling.variants(docs).collect()), key=str) == plain(rows)
