"""A trie of conversation prefixes, built family by family and then merged.

Conversations whose ids share a base continue its opening. The rows of a base and
of its family come together in one sorted stream; each conversation is rebuilt, and
the family's small trie is built from the rolling hashes of its turns. Only the
combined nodes of families are shuffled further, and equal ones merge. Turns are
hashed before the first shuffle, so texts never move. A task holds the base's first
turns and HELD_NODES nodes at most: of a larger family it passes on what it has, and
the rest merges like any other family's.

Figures of subtrees need no walk down the trie. A node belongs to its smallest
member, and what one conversation owns is the end of its path: so a subtree holds
all that its members own, but for what the node's owner owns above it.

Defined cases: null roles and texts are empty; a null turn comes first, turns with
one number are ordered by the hash of role and text, and all count; rows without
conv_id are left out; a negative id's base is the next multiple towards zero; other
columns are ignored; an empty table gives an empty one, without a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from focusloom.llm.common import bounded_batches, discard, lean_worker, materialize

#: Ids of one family share their multiple of FAMILY; up to HEADS - 1 turns are taken from it.
FAMILY, HEADS = 5, 9
HELD_NODES = 100_000
#: Depths that are summed up by one task.
BLOCK = 4096
ROOT = bytes(16)
_NODES = "base long, key binary, parent binary, depth long, n_bytes long, members array<long>, ends array<long>"


def _turns(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, head, turn, hash, n_bytes): turns as hashes; head: how many of the base's turns the conversation begins with."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    return rows.select(
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        "conv_id",
        (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int").alias("head"),
        "turn",
        F.unhex(F.md5(F.concat_ws(":", F.octet_length("role"), "role", "text"))).alias("hash"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )


class _Family:
    """The trie of one family's conversations, as {key: (parent, depth, bytes, members, ends)}."""

    def __init__(self, base: int):
        self.base, self.opening, self.nodes = base, [], {}
        self.conv = None

    def begin(self, conv: int, head: int) -> None:
        self.conv, self.head, self.seen, self.key, self.depth = conv, head, 0, ROOT, 0
        self.nodes.setdefault(ROOT, (None, 0, 0, [], []))[3].append(conv)
        if conv != self.base:
            for turn in self.opening[:head]:
                self.step(*turn)

    def own(self, digest: bytes, n_bytes: int) -> None:
        if self.conv == self.base and len(self.opening) < HEADS:
            self.opening.append((digest, n_bytes))
        if self.conv == self.base or self.seen >= self.head:
            self.step(digest, n_bytes)
        self.seen += 1

    def step(self, digest: bytes, n_bytes: int) -> None:
        parent, self.depth = self.key, self.depth + 1
        self.key = hashlib.blake2b(parent + digest, digest_size=16).digest()
        self.nodes.setdefault(self.key, (parent, self.depth, n_bytes, [], []))[3].append(self.conv)

    def end(self) -> None:
        if self.conv is not None:  # a node that was passed on already merges with this by its key
            self.nodes.setdefault(self.key, (None, self.depth, 0, [], []))[4].append(self.conv)

    def rows(self):
        out = [(self.base, key, *node) for key, node in self.nodes.items()]
        self.nodes = {}
        return out


def _batch(rows: list) -> pa.RecordBatch:
    fields = [("base", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n_bytes", pa.int64()), ("members", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _families(held: int):
    def build(batches):
        lean_worker()
        family, out = None, []
        for batch in batches:
            for base, conv, head, digest, n_bytes in zip(*(c.to_pylist() for c in batch.columns)):
                if family is None or family.base != base:
                    if family:
                        family.end()
                        out += family.rows()
                    family = _Family(base)
                if family.conv != conv:
                    family.end()
                    family.begin(conv, head)
                family.own(digest, n_bytes)
                if len(family.nodes) + len(out) > held:
                    out += family.rows()
                    yield _batch(out)
                    out = []
        if family:
            family.end()
            yield _batch(out + family.rows())

    return build


def _ends(batches):
    """(key, ends_sha256) of rows sorted by key and conversation: digests grow as the ids stream by."""
    lean_worker()
    key, digest = None, None
    for batch in batches:
        done = []
        for at, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if at != key:
                if digest:
                    done.append((key, digest.hexdigest()))
                key, digest = at, hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        yield _digests(done)
    if digest:
        yield _digests([(key, digest.hexdigest())])


def _digests(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())], ["key", "ends_sha256"])


def family_nodes(conversations: DataFrame, held: int = HELD_NODES) -> DataFrame:
    """The nodes of each family's trie, with the members (at most a family) that pass and end there."""
    rows = bounded_batches(_turns(conversations)).repartition("base")
    ordered = rows.sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "hash")
    return ordered.select("base", "conv_id", "head", "hash", "n_bytes").mapInArrow(_families(held), _NODES)


def _above(nodes: DataFrame) -> DataFrame:
    """(key, above): what the node's owner owns at lesser depths."""
    owned = nodes.select("key", "conv_id", "depth", "worth", F.expr(f"depth div {BLOCK}").alias("block"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = owned.groupBy("conv_id", "block").agg(F.sum("worth").alias("worth")).select("conv_id", "block", F.coalesce(F.sum("worth").over(over), F.lit(0)).alias("before"))
    here = owned.select("key", "conv_id", "block", F.coalesce(F.sum("worth").over(inside), F.lit(0)).alias("inner"))
    return here.join(blocks, ["conv_id", "block"]).select("key", (F.col("before") + F.col("inner")).alias("above"))


def trie(conversations: DataFrame, held: int = HELD_NODES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of all nodes."""
    families = materialize(family_nodes(conversations, held), "families")
    merged = families.groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.max("n_bytes").alias("n_bytes"), F.min(F.array_min("members")).alias("conv_id"), F.sum(F.size("members")).cast("long").alias("n_convs")
    )
    merged = materialize(merged, "merged")
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    worth = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("worth")
    nodes = materialize(merged.join(children, "key", "left").select("key", "parent", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), worth), "nodes")
    discard(merged)

    owned = nodes.groupBy("conv_id").agg(F.sum("worth").alias("worth"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    by_base = owned.groupBy((F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")).agg(F.collect_list(F.struct("conv_id", "worth", "leaves")).alias("owners"))
    passing = families.join(by_base, "base").select("key", F.filter("owners", lambda o: F.array_contains("members", o["conv_id"])).alias("owners"))
    total = lambda field: F.sum(F.aggregate("owners", F.lit(0).cast("long"), lambda a, o: a + o[field]))
    sums = passing.groupBy("key").agg(total("worth").alias("worth_below"), total("leaves").alias("n_leaves"))
    ends = families.select("key", F.explode("ends").alias("conv_id")).repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_ends, "key binary, ends_sha256 string")

    told = nodes.join(sums, "key").join(_above(nodes), "key").join(ends, "key", "left")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return told.join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("worth_below") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )
