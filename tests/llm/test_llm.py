"""The training-data operators against plain versions, round trips, SQL and odd inputs."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from focusloom.llm import chat, components, decontamination, gif, html_blocks, near_dedup, packing, pii, queries, substring_dedup, token_store, tokens, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, key string, pos long"
ASCII = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def odd_docs(spark):
    """Nulls, empty, blank and long texts, ties, repeated rows, clashing column names."""
    w = random.Random(3)
    words = ["".join(w.choices("abcdefgh", k=4)) for _ in range(300)]
    long = " ".join(w.choices(words, k=30_000))
    base = " ".join(w.choices(words, k=200))
    near = base.replace(words[0], "x") + " y"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, base), (6, base), (7, near), (8, "one two"), (9, "ONE Two"), (8, "one two"), (None, base), (10, base + " " + base), (11, "Mr Smith 4111 1111 1111 1111 a@b.co")]
    return spark.createDataFrame([(i, t, "en", "k", 0) for i, t in rows], DOC)


def empty(df):
    return df.where("false")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def substring_plain(rows, window):
    docs = collections.defaultdict(list)
    for i, t in rows:
        docs[i].append(SPACED.findall(t or ""))
    first = {}
    order = sorted(docs, key=lambda i: (i is not None, i))
    for i in order:
        for w in docs[i]:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                at = ((i is not None, i or 0), k)
                first[g] = min(first.get(g, at), at)
    out = []
    for i, t in rows:
        w = SPACED.findall(t or "")
        gone = [0] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != ((i is not None, i or 0), k):
                gone[k : k + window] = [1] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


SMALL_SKETCH = {"depth": 2, "cells": 16, "block": 12}


def test_substring_dedup_equals_plain(spark):
    docs = odd_docs(spark)
    got = rows_of(substring_dedup.dedup_substrings(docs, 20, **SMALL_SKETCH))
    assert sorted(map(str, got)) == sorted(map(str, substring_plain([(r[0], r[1]) for r in docs.collect()], 20)))
    assert rows_of(substring_dedup.dedup_substrings(empty(docs), 20, **SMALL_SKETCH)) == []


def near_plain(rows, threshold=85):
    sets = {}
    for i, t in rows:
        w = SPACED.findall((t or "").translate(ASCII))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    own = {i: i for i in sets}

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                own[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates_equal_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = near_plain([(r.doc_id, r.text) for r in docs.collect()])
    assert {r[0]: r[1:] for r in rows_of(near_dedup.near_duplicates(docs))} == want


def test_near_duplicates_of_odd_inputs_and_large_nodes(spark, monkeypatch):
    docs = odd_docs(spark)
    got = rows_of(near_dedup.near_duplicates(docs))
    want = near_plain([(r[0], r[1]) for r in docs.where("doc_id is not null").collect()])
    assert len(got) == docs.count() and {r[0]: r[1] for r in got if r[0] is not None} == {i: w[0] for i, w in want.items()}
    assert near_dedup.near_duplicates(empty(docs)).count() == 0
    # nodes that branch and components that are searched in blocks
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "TEXTS", 3)
    w = random.Random(5)
    base = [w.choice("abcdefghij") * 3 + str(i % 50) for i in range(300)]
    rows = [(i, " ".join(x if w.random() > 0.012 * (i % 3) else f"n{w.random()}" for x in base)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: r[1:] for r in rows_of(near_dedup.near_duplicates(df))} == near_plain(rows)


def test_components(spark):
    w = random.Random(7)
    pairs = [(w.randrange(200), w.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    own = {}

    def root(i):
        own.setdefault(i, i)
        while own[i] != i:
            i = own[i]
        return i

    for a, b in pairs:
        x, y = root(a), root(b)
        own[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in rows_of(components.components(spark.createDataFrame(pairs, "u long, v long")))}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {i: root(i) for i in linked}


def decontamination_plain(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    sizes = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    found |= x
                    hit.update(range(k, k + n))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination_equals_plain(spark):
    docs = odd_docs(spark)
    texts = [(r[0], r[1]) for r in docs.collect()]
    items = [(1, " ".join(texts[4][1].split()[20:60])), (2, "one TWO"), (3, ""), (4, None), (5, texts[4][1].split()[100]), (2, " ".join(texts[3][1].split()[5:17])), (6, "not here at all")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    assert sorted(rows_of(decontamination.digest(decontamination.contamination(docs, bench))), key=str) == decontamination_plain(texts, items)
    none = decontamination.digest(decontamination.contamination(docs, empty(bench)))
    assert sorted(rows_of(none), key=str) == decontamination_plain(texts, [])
    assert decontamination.contamination(empty(docs), bench).count() == 0


def test_decontamination_finds_items_of_every_length_inside_long_texts(spark):
    w = random.Random(11)
    word = lambda: "".join(w.choices("abcdefghijklmnop", k=6))
    items, texts = [], []
    for n in range(1, 14):
        for i in range(12):
            items.append((100 * n + i, " ".join(word() for _ in range(n))))
            texts.append((100 * n + i, " ".join([*(word() for _ in range(30)), items[-1][1], *(word() for _ in range(30))])))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontamination.digest(decontamination.contamination(docs, bench)))
    assert sorted(got, key=str) == decontamination_plain(texts, items) and all(r[2] > 0 for r in got)
    # items of one length only
    some = [i for i in items if len(i[1].split()) == 9]
    got = rows_of(decontamination.digest(decontamination.contamination(docs, bench.where("item_id between 900 and 999"))))
    assert sorted(got, key=str) == decontamination_plain(texts, some)


def library(text):
    return tokens.encoder(tokens.tokenizer_path()).full.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_table_round_trip(spark, encoding):
    docs = odd_docs(spark).where("doc_id is not null").unionByName(spark.createDataFrame([(90, "<|endoftext|>. 7 a7 it's İstanbul ΣΑΣ x café!! ÉCOLE", "x", "k", 0)], DOC))
    got = sorted(rows_of(token_store.token_digest(docs, encoding=encoding)))
    at = 0
    for (i, start, n, crc), (j, t) in zip(got, sorted((r[0], r[1]) for r in docs.where("doc_id <> 1").collect() + docs.where("doc_id = 1").selectExpr("doc_id", "'' as text").collect())):
        ids = np.array(library(t), np.uint32)
        assert (i, start, n, crc) == (j, at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    assert token_store.token_digest(empty(docs)).count() == 0


def test_packing_keeps_every_id_once(spark):
    docs = odd_docs(spark).where("doc_id is not null and doc_id <> 8").repartition(3)
    rows = rows_of(packing.pack(docs, windows=2, size=64))
    texts = {r[0]: np.array(library(r[1]), np.uint32) for r in docs.collect()}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
        by_sequence[r[5]].append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        at = 0
        for _, start, n, crc, total, _, _ in sorted(pieces, key=lambda r: r[1]):
            assert (start, total, crc) == (at, len(texts[i]), zlib.crc32(texts[i][at : at + n].tobytes()))
            at += n
        assert at == len(texts[i])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at == 64 or at & (at - 1) == 0
    assert packing.pack(empty(docs)).count() == 0


def longest_match(samples, start=8):
    """A plain LZW encoder, as other programs write GIFs."""
    clear = 1 << start
    codes, table, now, n = [clear], {}, None, clear + 2
    for c in samples:
        if now is None:
            now = c
        elif (now, c) in table:
            now = table[now, c]
        else:
            codes.append(now)
            if n < 4096:
                table[now, c] = n
                n += 1
            now = c
    codes += [now, clear + 1] if now is not None else [clear + 1]
    bits, since = "", 0
    for k, c in enumerate(codes):
        width = start + 1 if k == 0 else min(12, ((clear + 2) + max(0, since - 2)).bit_length())
        since += 1
        width = max(start + 1, min(12, (clear + 2 + max(0, k - 2)).bit_length())) if k else start + 1
        bits = format(c, f"0{width}b") + bits
    return int(bits, 2).to_bytes((len(bits) + 7) // 8, "little")


@pytest.mark.parametrize("n", [0, 1, 2, 577, 5000, 40_000])
def test_gif_codes(n):
    w = random.Random(n)
    for samples in (w.randbytes(n), b"\0" * n, bytes(w.choices(b"abcd", k=n))):
        assert gif.lzw_decode(gif.lzw_encode(samples), 8).tobytes() == samples
        if n <= 5000:
            assert gif.lzw_decode(longest_match(samples), 8).tobytes() == samples


def test_gif_frames():
    """Transparency, disposal, local palettes and interlacing."""
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])

    def frame(samples, left, top, w, h, disposal, transparent=None, flags=0):
        control = b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None)]) + b"\x05\0" + bytes([transparent or 0]) + b"\0"
        place = b"".join(v.to_bytes(2, "little") for v in (left, top, w, h))
        return control + b"\x2c" + place + bytes([flags]) + (palette[::-1] if flags & 0x80 else b"") + b"\x02" + gif._blocks(longest_match(samples, 2))

    head = b"GIF89a\x02\0\x02\0" + bytes([0x81, 0, 0]) + palette
    shown = gif.decode(head + frame([0, 1, 2, 3], 0, 0, 2, 2, 1) + frame([1, 3], 0, 0, 2, 1, 3, 3) + frame([2], 1, 1, 1, 1, 2) + frame([0, 0], 0, 0, 2, 1, 0, flags=0x81) + b"\x3b")
    assert [f.delay for f in shown] == [5, 5, 5, 5]
    assert shown[1].shown[0].tolist() == [[0, 255, 0, 255], [0, 255, 0, 255]]  # the transparent sample shows what was there
    assert shown[2].shown[0].tolist() == [[255, 0, 0, 255], [0, 255, 0, 255]]  # restored
    assert shown[3].shown[1, 1].tolist() == [0, 0, 0, 0]  # cleared
    assert shown[3].shown[0, 0].tolist() == [9, 9, 9, 255]  # its own palette
    rows = gif.decode(b"GIF87a\x01\0\x04\0" + bytes([0x81, 0, 0]) + palette + b"\x2c\0\0\0\0\x01\0\x04\0\x40\x02" + gif._blocks(longest_match([0, 1, 2, 3], 2)) + b"\x3b")
    assert rows[0].samples.ravel().tolist() == [0, 2, 1, 3]
    with pytest.raises(gif.GifError):
        gif.decode(b"GIF89a")


def test_media_columns(spark):
    df = spark.createDataFrame([(1, None), (2, b""), (3, bytes(range(256)) * 300)], "doc_id long, payload binary")
    got = {r["doc_id"]: r for r in gif.decode_media(gif.encode_media(df, "doc_id", "payload"), "doc_id", keep=("n_bytes",)).collect()}
    assert got[1]["media_bytes"] is None and got[2]["payload_bytes"] == 576 and got[3]["n_bytes"] == 76800
    payload = bytes(range(256)) * 300 + b"\xff" * (-76800 % 576)
    assert got[3]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[3]["tail_crc32"] == zlib.crc32(payload[-32:])
    assert sum(sum(f["histogram"][:4]) for f in got[3]["frames"]) == len(payload)
    bad = gif.decode_media(spark.createDataFrame([(1, b"no gif")], "doc_id long, media binary"), "doc_id").first()
    assert bad["error"] and gif.encode_media(empty(df), "doc_id", "payload").count() == 0


def test_html():
    page = "<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/>News</a></li></ul></nav><div class=ad>Buy now</div><article><h1>A &amp; B</h1><p>First   line here, with words and more words.<p>Second one of them, also long enough to be text.</article><div id=comments><p>I disagree with all of this.</p></div><footer>&copy; 2024 x</footer>"
    assert html_blocks.extract([page, None, "", "<script>x</script>"]) == ["A & B First line here, with words and more words. Second one of them, also long enough to be text.", "", "", ""]


def test_html_on_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    truth = {r.page_id: " ".join(__import__("html").unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1]).replace("<b>", "").replace("</b>", "")).split()) for r in pages.collect()}
    got = {r.page_id: r.text for r in html_blocks.main_text(pages).collect()}
    assert sum(got[i] == t for i, t in truth.items()) >= 0.97 * len(truth)
    assert html_blocks.main_text(empty(pages)).count() == 0


def test_toxicity(spark):
    p = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    labels = {r.doc_id: r.toxic for r in p("labels").collect()}
    got = [r for r in toxicity.toxicity(p("documents"), p("labels")).collect()]
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    good, bad = [s for s, y in held if not y], [s for s, y in held if y]
    assert sum(s < b for s in good for b in bad) >= 0.8 * len(good) * len(bad)
    automaton = toxicity.Model(dict(toxicity.SEED)).automaton()
    assert toxicity.evidence("you 1d10t, trаsh!", automaton)[1] == 2  # a digit and a Cyrillic letter
    assert toxicity.evidence("take out the trash can", automaton)[1] == 0
    assert toxicity.evidence(None, automaton) == (0.0, 0)
    docs = odd_docs(spark)
    assert toxicity.toxicity(docs, empty(p("labels"))).count() == docs.count()


def test_toxicity_keeps_rare_words_whatever_is_copied(spark):
    w = random.Random(17)
    text = lambda mark: " ".join([*("".join(w.choices("abcdefghijklmnop", k=5)) for _ in range(8)), mark, *("".join(w.choices("abcdefghijklmnop", k=5)) for _ in range(8))])
    rows = [(text("harmless"), 0) for _ in range(300)] + [(text("villain"), 1) for _ in range(54)] + [(text("schurke"), 1) for _ in range(6)]
    rows += [rows[300]] * 400  # copies of one toxic text
    ids = [i for i in range(2000) if not toxicity.held_out(i)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in zip(ids, rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in zip(ids, rows)], "doc_id long, toxic int")
    automaton = toxicity.fit(docs, labels).automaton()
    assert all(toxicity.evidence(f"so ein {word} da", automaton)[1] == n for word, n in (("villain", 1), ("schurke", 1), ("harmless", 0)))


def test_surrogates(spark):
    text = "Mail JO.Doe4@Mail.example.com or jo.doe4@mail.example.com, card 4111 1111 1111 1111 = 4111111111111111, Mrs Anna Weber and Mrs Anna Weber, 10.1.2.3, v2.0."
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(50, text, "en", "k", 0), (50, text, "en", "k", 0)], DOC))
    out = pii.pseudonymize(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = [r for r in out.collect() if r.doc_id == 50]
    assert got[0] == got[1]
    t = got[0].text
    for secret in ("Doe4", "doe4", "4111 1111", "Weber", "10.1.2.3"):
        assert secret not in t
    mails = re.findall(r"\S+@\S+\w", t)
    assert mails[0].lower() == mails[1].lower() and mails[0].endswith(".com")
    spaced, plain = re.search(r"card ([\d ]+) = (\d+)", t).groups()
    assert spaced.replace(" ", "") == plain and plain[0] == "4"
    digits = [int(c) for c in plain[::-1]]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert len(set(re.findall(r"Mrs (\w+ \w+)", t))) == 1 and t.endswith("v2.0.") and re.search(r", 10\.\d+\.\d+\.\d+,", t)
    assert rows_of(out.where("doc_id = 1"))[0][1] is None
    assert pii.pseudonymize(empty(docs)).count() == 0
    drawn = rows_of(pii.surrogates(spark.createDataFrame([("ipv4", f"10.0.{i // 250}.{i % 250}") for i in range(2000)], "kind string, canon string")))
    assert len({d for _, _, d in drawn}) == 2000 and not {d for _, _, d in drawn} & {c for _, c, _ in drawn}


def test_surrogates_keep_their_form_however_many_there_are(spark):
    names = ["X" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(6000)]
    got = rows_of(pii.pseudonymize(spark.createDataFrame([(i, f"Mr {n}") for i, n in enumerate(names)], "doc_id long, text string")))
    assert len({t for _, t in got}) == len(names) and all(re.fullmatch("Mr [A-Z][a-z]+", t) for _, t in got)
    # all one-letter addresses of a domain: none is left for the others
    mails = [("email", f"{a}@{b}.co") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    drawn = rows_of(pii.surrogates(spark.createDataFrame(mails, "kind string, canon string")))
    assert len({d for _, _, d in drawn} - {c for _, c, _ in drawn}) == len(mails) and all(re.fullmatch(r"[a-z0-9]+@[a-z]\.co", d) for _, _, d in drawn)


def test_surrogate_names_grow_with_their_number(spark):
    found = [("surname", "X" + "".join(chr(97 + i // 26**k % 26) for k in range(4))) for i in range(6000)] + [("first", f"{g}|X{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(300) for g in "fm"]
    drawn = rows_of(pii.surrogates(spark.createDataFrame(found, "kind string, canon string")))
    assert len(drawn) == len({r[:2] for r in drawn}) == len({(k, d) for k, _, d in drawn}) == len(found)
    assert all(re.fullmatch("[A-Z][a-z]+", d) for _, _, d in drawn)
    assert all(d.startswith(pii.NAMES[c[0], "latin"]) for k, c, d in drawn if k == "first")


def test_surrogates_of_all_forms_of_a_name_agree(spark):
    texts = [(1, "Mrs Anna Weber met Mrs Weber. Frau Anna Weber left; Anna Weber, (Weber) and Weber's Annas."), (2, "Frau Weber. Anna."), (3, "Weber and Anna, a@b.co"), (4, "Herr Karl Weber")]
    got = dict(rows_of(pii.pseudonymize(spark.createDataFrame(texts, "doc_id long, text string"))))
    first, last = re.match(r"Mrs (\w+) (\w+) ", got[1]).groups()
    assert got[1] == texts[0][1].replace("Weber", last).replace("Anna ", f"{first} ") and first.startswith(pii.NAMES["f", "latin"])
    assert got[2] == f"Frau {last}. Anna." and got[3].startswith("Weber and Anna, ")
    assert got[4].split()[0::2] == ["Herr", last] and got[4].split()[1].startswith(pii.NAMES["m", "latin"])


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "bot", "x"), (4, 0, "user", "a"), (4, 1, "bot", "b"), (4, 2, "user", "c"), (4, 2, "user", "c"), (5, 0, None, None), (None, 0, "u", "t")]
    rows += [(6, i, "user", str(i)) for i in range(700)] + [(7, i, "user", str(i)) for i in range(699)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, pos string")
    got = {r.conv_id: r for r in chat.render(df).collect()}
    assert set(got) == {2, 3, 5, 6} and got[6].n_turns == 700
    assert got[3].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nx<|im_end|>\n"
    assert chat.render(empty(df)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(queries.oracle_sql()[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == cols
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[theirs.index(c)] for c in cols]) for r in cur.fetchall())


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shape = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    near = pipeline.drop_near_duplicates(spark, docs, SF)
    assert near.columns == shape and {r.doc_id for r in near.collect()} == {i for i, v in near_plain(texts.items(), 80).items() if v[2]}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = pipeline.drop_contaminated(spark, docs, SF)
    assert clean.columns == shape and {r.doc_id for r in clean.collect()} == {r[0] for r in decontamination_plain(texts.items(), items) if not r[5]}
    packed = pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() > 0.5 * len(texts)


def test_substring_dedup_tells_rows_with_one_doc_id_apart(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    mixed = " ".join([*a.split()[:40], *b.split()[:20]])  # windows of A, at A's places, in a third row of document 2
    rows = [(1, a), (2, a), (2, b), (2, mixed), (3, mixed), (None, b), (None, a)]
    for n in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        got = rows_of(substring_dedup.dedup_substrings(docs, 20, **SMALL_SKETCH))
        assert sorted(map(str, got)) == sorted(map(str, substring_plain(rows, 20)))
    kept = {r[3]: r[2] for r in rows_of(substring_dedup.dedup_substrings(spark.createDataFrame(rows[:3], "doc_id long, text string"), 20, **SMALL_SKETCH)) if r[0] == 2}
    assert kept == {"": 60, b: 0}


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    from focusloom.llm import common

    data = np.frombuffer((" ".join("".join(random.Random(i).choices("abcd", k=i % 90 + 1)) for i in range(400))).encode(), np.uint8)
    starts, ends, _ = common.split_words(data, np.array([0, len(data)]))
    whole = common.word_hashes(data, starts, ends), common.gram_hashes(common.word_hashes(data, starts, ends), 5)
    monkeypatch.setattr(common, "CHUNK_BYTES", 64)
    monkeypatch.setattr(common, "_powers", {})
    pieces = common.word_hashes(data, starts, ends), common.gram_hashes(common.word_hashes(data, starts, ends), 5)
    assert all((a == b).all() for a, b in zip(whole, pieces)) and (common.word_hashes(data, starts, ends, 1) != whole[0]).all()


def test_word_encoder_gives_the_library_ids():
    w = random.Random(1)
    pools = ["abcdefghijkABC", "àéîößñÿÀÉÑµªº", "0123456789٣²½Ⅷ", ".,!?;:*#$%&\"'()[]{}-_/\\=+~`@^", "👍😀€→©™®¡—«»“”’", "İıſŸΣσςАБвё", "e̸ñḉ‍️­", "क़קּשׁÅﬁ", "<|>", "日本語한글ไทยعرب", "\x00\x01\x1c\x1f\x7f\x85\xa0 　", "\n\t\r\x0b\x0c "]
    texts = []
    for _ in range(100_000):
        parts = []
        for _ in range(w.randint(1, 10)):
            pool = w.choice(pools)
            parts += [*w.choices(pool, k=w.randint(1, 3)), *([" "] if w.random() < 0.25 else [])]
        texts.append("".join(parts))
    texts += ["great job 👍.", "wow 😀! ok", "price €!", "a →.", "© 2024 ©.", "see <@user>!", "x ->! y", "|#", "İ.", "a<|endoftext|>.", "it's 'll."]
    import pyarrow as pa

    e = tokens.WordEncoder(tokens.tokenizer_path(), cache_words=5000)
    for at in range(0, len(texts), 9000):
        mine = texts[at : at + 9000]
        ids, ends = e.encode(pa.array(mine))
        want = e.full.encode_batch_fast(mine, add_special_tokens=False)
        assert [ids[a : b - 1].tolist() for a, b in zip(ends, ends[1:])] == [x.ids for x in want]


def test_token_tables_are_read_in_part(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} " * (i % 7)) for i in range(500)] + [(7, "a"), (7, "b c d e")], "doc_id long, text string")
    token_store.write_token_table(docs, str(tmp_path / "t"), tokens.tokenizer_path(), row_group_bytes=1 << 12, page_bytes=1 << 10)
    some = token_store.read_tokens(spark, str(tmp_path / "t"), 100, 110)
    assert {r.doc_id: list(r.ids) for r in some.collect()} == {i: library(f"word{i} " * (i % 7)) for i in range(100, 111)}
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(doc_id,100)" in plan
    meta = token_store.read_metadata(spark, str(tmp_path / "t"))
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString().replace("ids_", "")
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in meta.collect())
    at = 0
    for start, doc, n in rows:  # starts are the places in the files, also of rows that share a doc_id
        assert start == at
        at += n
    assert [d for _, d, _ in rows] == sorted(d for _, d, _ in rows)
    digests = token_store.with_starts(token_store.read_digests(spark, str(tmp_path / "t")), meta)
    stored = [i for r in spark.read.parquet(str(tmp_path / "t")).orderBy("part", "row").collect() for i in r.ids]
    for r in digests.collect():
        assert zlib.crc32(np.array(stored[r.start : r.start + r.n_tokens], np.uint32).tobytes()) == r.ids_crc32


def test_near_duplicates_of_documents_with_several_rows(spark):
    w = random.Random(9)
    a, b, c = (" ".join("".join(w.choices("abcdef", k=5)) for _ in range(200)) for _ in range(3))
    a2, c2 = a.replace(a.split()[50], "x"), c.replace(c.split()[50], "x")
    rows = [(5, a), (5, b), (9, a), (7, c), (12, c), (12, b + " y"), (20, a2), (30, c2), (40, ""), (5, "")]
    got = {(r[0], r[1]): r[2] for r in rows_of(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert {i for (i, n), k in got.items() if n and k == 5} == {5, 7, 9, 12, 20, 30}  # 5 and 12 meet by b, 7 and 30 come with c
    assert got[40, 0] == 40


def test_near_duplicates_in_blocks_lose_no_link(spark, monkeypatch):
    """Groups that stay apart, groups that meet over one pair, in blocks of few texts."""
    monkeypatch.setattr(near_dedup, "TEXTS", 4)
    w = random.Random(13)
    base = [f"{w.choice('abcdef') * 2}{i}" for i in range(400)]
    rows = []
    for i in range(90):  # a chain: each differs from the one before by a few words more
        text = list(base)
        for k in range(i):
            text[(k * 37) % 400] = f"z{k // 3}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(x if w.random() > 0.03 else f"n{w.random()}" for x in base)) for i in range(40)]
    want = near_plain(rows)
    assert 1 < len({v[1] for v in want.values()}) < len(rows)
    assert {r[0]: r[1:] for r in rows_of(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))} == want


def test_surrogates_are_distinct_agree_and_leak_nothing(spark):
    """Texts made from templates: what stands between the entities stays, an entity has one surrogate, no two have the same."""
    w = random.Random(23)
    digits = lambda n: "".join(w.choices("0123456789", k=n))
    letters = lambda n: "".join(w.choices("abcdefghijklmnopqrstuvwxyz", k=n))

    def card():
        body = digits(15)
        odd = [int(c) for c in body[::-1]]
        return body + str(-sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(odd)) % 10)

    kinds = {
        "email": lambda: f"{letters(6)}.{letters(4)}@{letters(7)}.{w.choice(['com', 'org', 'co.uk'])}", "national_id": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", "ipv4": lambda: f"{w.choice(['10.1', '172.20', '192.168', '8.8', '81.2'])}.{w.randrange(256)}.{w.randrange(256)}",
        "ipv6": lambda: f"2001:db8:{w.randrange(16**4):x}::{w.randrange(16**4):x}", "card": card, "phone": lambda: f"+{w.randrange(1, 99)} {digits(3)} {digits(4)}-{digits(4)}", "secret": lambda: f"sk-{''.join(w.choices('abcdefghij0123456789', k=24))}", "name": lambda: f"Frau X{letters(5)}",
    }
    pool = [(k, make()) for k, make in kinds.items() for _ in range(40)]
    arabic = str.maketrans("0123456789", "\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669")
    docs = [(i, [w.choice(pool) for _ in range(w.randint(0, 6))]) for i in range(300)]
    text = lambda own: "; ".join(f"<{letters(3)}> {e}" for _, e in own) + "."
    rows = [(i, text(own)) for i, own in docs] + [(900, "id \u0661\u0662\u0663-\u0664\u0665-\u0666\u0667\u0668\u0669 and 123-45-6789"), (901, "4111 1111 1111 1112 is no card"), (902, f"\u00e9 {'4111 1111 1111 1111'.translate(arabic)}"), (903, None)]
    got = dict(rows_of(pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert len(got) == len(rows) and got[903] is None and got[901] == rows[-3][1]
    of: dict = {}
    for (i, own), (_, before) in zip(docs, rows):
        parts = re.fullmatch("".join(re.escape(x) + "(.+)" for x in re.split("|".join(re.escape(e) for _, e in own), before)[:-1]) + re.escape("."), got[i]).groups() if own else ()
        assert own or got[i] == before
        for (kind, e), new in zip(own, parts):
            assert of.setdefault((kind, e), new) == new != e and re.sub(r"\w", "x", new) == re.sub(r"\w", "x", e) or kind in ("ipv4", "ipv6", "name")
            assert kind != "ipv4" or (re.match(r"10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.", e) is None) == (re.match(r"10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.", new) is None)
    assert len(set(of.values())) == len(of) and not set(of.values()) & {e for _, e in of}
    a, b = re.fullmatch("id (.+) and (.+)", got[900]).groups()
    assert a == b.translate(arabic) and b != "123-45-6789" and set(got[902][2:]) <= set("\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669 ") and got[902] != rows[-2][1]


def test_surrogates_take_long_words_in_linear_time(spark):
    import time

    rows = [(1, "a" * 400_000), (2, "x@" + "a." * 100_000), (3, "@a" * 100_000), (4, "1" * 200_000), (5, "a" * 100_000 + " b@c.de")]
    began = time.time()
    got = dict(rows_of(pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert time.time() - began < 60 and got[1] == rows[0][1] and "b@c.de" not in got[5] and got[5].startswith("a" * 100_000 + " ")


def test_surrogates_keep_odd_columns(spark):
    df = spark.createDataFrame([(1, "a@b.co", "z", 7)], "`doc id` long, text string, `_row` string, `a.b` long")
    out = pii.pseudonymize(df)
    assert out.columns == df.columns and out.first()[0::2] == (1, "z") and out.first()[1] != "a@b.co"


def test_decontamination_of_long_and_repetitive_items(spark):
    """Items of thousands of words, words that repeat, and a bit table that lets nearly everything through."""
    w = random.Random(29)
    long = [f"w{w.randrange(4000)}" for _ in range(6000)]
    items = [(1, " ".join(long)), (2, "la " * 40), (3, " ".join(["a b c"] * 30)), (4, " ".join(f"q{i}" for i in range(3000)))]
    docs = [(1, " ".join(long[1000:1500] + ["x"] + long[10:22])), (2, "la " * 12), (3, "la " * 13), (4, " ".join(["b c a"] * 10)), (5, " ".join(f"q{i}" for i in range(2990, 3000))), (6, "nothing " * 50), (7, " ".join(f"q{i}" for i in range(3000)))]
    args = [spark.createDataFrame(x, f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id"))]
    assert sorted(rows_of(decontamination.digest(decontamination.contamination(*args))), key=str) == decontamination_plain(docs, items)
    odd = args[0].select("doc_id", "text", F.lit(1).alias("text_key"), F.lit(2).alias("n_hit"), F.lit(3).alias("a b"), F.lit(4).alias("_key"))
    kept = decontamination.clean(odd, args[1])
    assert kept.columns == odd.columns and rows_of(kept) and all(r[2:] == (1, 2, 3, 4) for r in rows_of(kept))
    assert {r[0] for r in rows_of(kept)} == {r[0] for r in decontamination_plain(docs, items) if not r[5]}


def test_html_of_malformed_pages():
    one = lambda body: html_blocks.parse(f"<html><body><article>{body}</article></body></html>")
    texts = lambda body: [b.text for b in one(body)]
    assert texts("<p title=don't>Hello there") == ["Hello there"]
    assert texts("<p title=\"a > b\" class='x>y'>Hello</p>") == ["Hello"]
    assert texts("ab<b class=" + "x" * 300_000 + ">cd</b>") == ["abcd"]
    assert texts("<a href=x\">link</a> next") == ["link next"]
    assert texts("1 < 2 and 3 > 2") == ["1 < 2 and 3 > 2"]
    assert texts("a<script src='x>y'>if (a</b) {}</script>b<style>p{}</style >c") == ["abc"]
    deep = "<ul>" + "<li><x1>" * 12 + "inner" + "<li>next</ul>after"
    assert [b.text for b in one(deep)] == ["inner", "next", "after"]
    assert len([t for t, _ in one("<dl><dt>" + "<y>" * 30 + "term<dd>meaning</dl>")[1].path]) == 5  # the term is closed however deep it is
    import time

    for piece in ("<a \"x ", "<a x=\"y ", "<!", "<p title='", "<script ", "<b>" * 3, "<div>"):
        began = time.time()
        html_blocks.extract([piece * 20_000 if piece != "<div>" else piece * 3000])
        assert time.time() - began < 5, piece


def test_pipeline_stages_take_odd_tables(spark):
    """Nulls, empty, long and repeated texts, clashing and odd columns, an empty table: every stage against what it is to do."""
    import corpus_pipeline as pipeline

    docs = odd_docs(spark).withColumn("a b", F.lit(1)).withColumn("text_key", F.lit("k")).withColumn("_row", F.lit(2)).withColumn("n_words", F.lit(3)).withColumn("score", F.lit(0.9)).withColumn("kept", F.lit(False))
    rows = {n: sorted(map(str, (r[:2] for r in rows_of(f(spark, docs, SF))))) for n, f in pipeline.STAGES[:4]}
    own = sorted(map(str, (r[:2] for r in rows_of(docs))))
    for _, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and all(r[5:] == (1, "k", 2, 3, 0.9, False) for r in rows_of(out))
        assert rows_of(stage(spark, empty(docs), SF)) == []
    assert rows["toxicity"] == rows["decontamination"] == own
    plain = near_plain([(-1 if r[0] is None else r[0], r[1]) for r in docs.collect()], 80)
    assert rows["near_dedup"] == sorted(str(r[:2]) for r in rows_of(docs) if plain[-1 if r[0] is None else r[0]][2])
    assert len(rows["pii"]) == len(own) and [x for x in own if "Smith" not in x] == [x for x in rows["pii"] if "Mr " not in x]
    packed = rows_of(pipeline.pack_sequences(spark, docs, SF))
    want = collections.Counter(r[0] for r in rows_of(docs) for _ in library(r[1]))
    got = collections.Counter()
    for r in packed:
        got[r[0]] += r[2]
    assert got == want and pipeline.pack_sequences(spark, empty(docs), SF).count() == 0


def test_toxicity_against_a_plain_matcher(spark):
    """Scores of the fitted model, worked out word by word without the automaton."""
    import math

    p = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    model = toxicity.fit(p("documents"), p("labels"))
    phrases = [x.split() for x in model.exceptions]
    got = {r.doc_id: r.score for r in toxicity.scored(p("documents"), model).collect()}
    for r in p("documents").collect():
        words, total = toxicity.fold_words(r.text), 0.0
        covered = {k for i in range(len(words)) for x in phrases if words[i : i + len(x)] == x for k in range(i, i + len(x))}
        for i, w in enumerate(words):
            own = [x for e, x in model.weights.items() if (w.startswith(e[:-1]) if e.endswith("*") else w == e)]
            total += max(own, default=0.0) if i not in covered else 0.0
        score = 1 / (1 + math.exp(-(model.slope * total / (1 + math.log1p(len(words) / toxicity.LENGTH_SCALE)) + model.bias)))
        assert abs(score - got[r.doc_id]) < 1e-9
