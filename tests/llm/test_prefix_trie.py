"""The trie of conversation prefixes against a plain one."""

import hashlib
import random
import zlib

import pytest

from focusloom.llm import prefix_trie

SF = "/root/testdata/sf0.001"


def plain(rows):
    """Nodes as prefixes of lists; subtrees by walking down."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))

    def key(t):
        return (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1].encode())}:{t[1]}:{t[2]}".encode()).digest())

    own = {c: [t[1:] for t in sorted(ts, key=key)] for c, ts in convs.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = abs(c) // 5 * 5 * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def worth(p):
        return (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0

    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        under = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in under) or 1
        saved[p] = worth(p) + sum(saved[q] for q in under)
    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if rebuilt[c] == p)))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), parent, len(cs), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, key string, base long")


def some(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if c % 5 == 0 and r.random() < 0.3:
            continue  # no base
        for t in range(r.randint(1, 12)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["hallo", "Grüße", "", None, "hallo"]) if r.random() < 0.7 else f"own {c}"))
    rows += [(3, None, "user", "first"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "assistant", "tie"), (None, 1, "user", "nobody"), (10**12 + 4, 0, "user", "hallo")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("held", [1, 7, 100_000])
def test_trie_equals_plain(spark, held):
    rows = some(held)
    assert sorted(map(tuple, prefix_trie.trie(frame(spark, rows), held).collect()), key=str) == plain(rows)


def test_copies_and_a_long_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 400) for t in range(3)] + [(403, t, "user", f"long {t}") for t in range(9000)]
    assert sorted(map(tuple, prefix_trie.trie(frame(spark, rows), 1000).collect()), key=str) == plain(rows)


def test_empty(spark):
    rows = frame(spark, [(None, 1, "user", "nobody")])
    assert prefix_trie.trie(rows).collect() == []
    assert prefix_trie.trie(rows.where("false")).collect() == []


def test_whole_conversations(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, prefix_trie.trie(table).collect()), key=str) == plain(rows)
