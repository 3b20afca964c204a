"""Near-duplicate groups by a chosen-path set similarity join over minwise tokens.

1. Each text becomes a set of 64-bit hashes of its 5-word shingles, COORDINATES
   minwise tokens of it and a digest. Equal sets are one representative.
2. Trees: a representative goes to one root node for each tree (its minwise
   token there). Nodes of at most SMALL members are compared exhaustively by
   their tokens. Larger nodes branch: each picks BRANCHES further tokens by its
   path, and members go to the children that their values there name. Nodes
   that are still large after DEPTH levels (near copies of each other) are
   compared in blocks.
3. Comparing a node starts from its first member, takes in all whose tokens
   agree often enough, and goes on with those not yet taken in: a spanning
   forest of the node's candidate graph, not its pairs. Each tree is handed on as
   a star around its first member, so that few rounds make components of them.
4. Candidate components get their full sets back and are searched the same way,
   now with exact intersections: a set is linked if any member of the group
   reaches 100 * intersection >= 85 * union with it. Components of more than
   TEXTS sets are searched block by block, then over the blocks' groups by one
   member of each; only if several groups are left in one component are all its
   blocks compared in pairs, so that no link is lost.

Of a pair at similarity s a tree finds s at its root and, with two branches,
1 - (1 - s) ** 2 of that at each level; all TREES miss a pair at 0.85 with a
chance of some 3e-7 (at 0.8, of some 4e-7, by two trees more). The token filter,
which is 5.2 deviations below the threshold, misses some 1e-7.

Defined cases: null, empty and blank texts have empty sets, are linked with
nothing and kept; with fewer than 5 words the whole sequence is one shingle;
rows with equal doc_id are one document: it has the links of each of its rows,
and each row keeps its own n_shingles; rows without a
doc_id are together one such document; other columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from focusloom.llm.common import LOWER, bounded_batches, discard, gram_hashes, lean_worker, materialize, mix, split_words, text_chunks, word_hashes
from focusloom.llm.components import components

SHINGLE = 5
#: Links need 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
COORDINATES = 128
TREES = 9
#: Trees besides for a threshold under 85, at which each finds less.
MORE_TREES = 2
SMALL = 1024
#: Two are enough: 0.8 * 2 > 1, so a pair's paths don't die out, and members of large groups aren't carried into more nodes.
BRANCHES = 2
DEPTH = 2
BLOCK = 4096
#: Texts held by a task in the exact search (twice as many for a pair of blocks).
TEXTS = 512

_NULL_ID = -(1 << 63)
_MULTIPLIERS = np.random.default_rng(5).integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, size: int = SHINGLE):
    """For each row of a text column, in order: (row, sorted distinct shingle hashes)."""
    for a, b, data, offsets in text_chunks(column):
        data = LOWER[data]
        starts, ends, bounds = split_words(data, offsets)
        words = word_hashes(data, starts, ends)
        grams = gram_hashes(words, size)
        for i in range(b - a):
            x, y = int(bounds[i]), int(bounds[i + 1])
            if y - x >= size:
                yield a + i, np.unique(grams[x : y - size + 1])
            elif y > x:
                yield a + i, gram_hashes(words[x:y], y - x)
            else:
                yield a + i, np.zeros(0, np.uint64)


def signatures(docs: DataFrame, trees: int = TREES) -> DataFrame:
    """(doc_id, n, d1, d2, roots array<long>, tokens binary): one narrow pass over the texts."""

    def run(batches):
        lean_worker()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            held: list[np.ndarray] = []

            def flush():
                if not rows:
                    return None
                sets = np.concatenate(held)
                sizes = np.array([len(s) for s in held])
                full = np.flatnonzero(sizes)
                first = (np.cumsum(sizes) - sizes)[full]
                low = np.zeros((len(rows), COORDINATES), np.uint64)
                d1 = np.zeros(len(rows), np.uint64)
                d2 = np.zeros(len(rows), np.uint64)
                if len(full):
                    for c in range(COORDINATES):
                        x = sets * _MULTIPLIERS[c]
                        x ^= x >> np.uint64(32)
                        low[full, c] = np.minimum.reduceat(x, first)
                    d1[full] = np.add.reduceat(mix(sets + np.uint64(1)), first)
                    d2[full] = np.bitwise_xor.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
                low = mix(low)
                roots = np.ascontiguousarray(low[:, :trees]).view(np.int64)
                tokens = (low & np.uint64(255)).astype(np.uint8)
                out = pa.record_batch(
                    [
                        pa.array([ids[r] for r in rows], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(d1.view(np.int64)),
                        pa.array(d2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * trees), pa.array(np.ascontiguousarray(roots).ravel())),
                        pa.array([t.tobytes() for t in tokens], pa.binary()),
                    ],
                    names=["doc_id", "n", "d1", "d2", "roots", "tokens"],
                )
                rows.clear()
                held.clear()
                return out

            count = 0
            for row, s in shingle_sets(batch.column(1)):
                rows.append(row)
                held.append(s)
                count += len(s)
                if count >= 1 << 18:  # the sets and one product of theirs stay in the processor's cache
                    yield flush()
                    count = 0
            last = flush()
            if last is not None:
                yield last

    return bounded_batches(docs).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, roots array<long>, tokens binary")


def _blocked(df: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Adds (i, j): groups of over ``block`` rows are dealt to blocks, and each row goes to all pairs of blocks with its own."""
    sized = df.join(df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_b")), keys)
    mine = sized.withColumn("_k", F.pmod(F.xxhash64("id"), F.col("_b")).cast("int"))
    return mine.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).withColumn("i", F.least("_k", "_o")).withColumn("j", F.greatest("_k", "_o")).drop("_b", "_k", "_o")


def _runs(batches, keys: int):
    """Groups of rows with equal leading columns, from a stream sorted by them: lists of columns' values."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[a] for c in cols)
            if key != current and held:
                yield pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _forest(n: int, close) -> list[tuple[int, int]]:
    """Each member with the first of its tree, in a spanning forest; close(member, others) tells which of the others link with it."""
    edges, rest, queue, root = [], np.arange(n), [], 0
    while len(rest):
        if queue:
            at = queue.pop()
        else:
            root = at = int(rest[0])
            rest = rest[1:]
        if not len(rest):
            break
        hit = close(at, rest)
        found = rest[hit]
        if len(found):
            edges += [(root, int(x)) for x in found]
            queue += found.tolist()
            rest = rest[~hit]
    return edges


def _candidates(nodes: DataFrame, threshold: int) -> DataFrame:
    """Edges (u, v) from the first member of each tree of a node's candidate forest. nodes: key, i, j, id, n, tokens."""
    s = threshold / 100
    # agreement of 8-bit tokens: s by likeness, and by chance 1 of 256 of the rest
    p = s + (1 - s) / 256
    least = COORDINATES * p - 5.2 * (COORDINATES * p * (1 - p)) ** 0.5

    def run(batches):
        lean_worker()
        us, vs = [], []
        for t in _runs(batches, 3):
            if t.num_rows < 2:
                continue
            ids = t.column("id").to_numpy()
            n = t.column("n").to_numpy()
            tokens = np.frombuffer(b"".join(t.column("tokens").to_pylist()), np.uint8).reshape(-1, COORDINATES)

            def close(at, rest):
                fit = (100 * np.minimum(n[rest], n[at]) >= threshold * np.maximum(n[rest], n[at]))
                hit = np.zeros(len(rest), bool)
                some = np.flatnonzero(fit)
                hit[some] = (tokens[rest[some]] == tokens[at]).sum(1) >= least
                return hit

            for a, b in _forest(len(ids), close):
                us.append(ids[a])
                vs.append(ids[b])
            if len(us) > 10_000:
                yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
                us, vs = [], []
        yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    cols = nodes.select("key", "i", "j", "id", "n", "tokens")
    return cols.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id").mapInArrow(run, "u long, v long")


def _sets_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(rows, ids, sets) of a group's rows whose sets aren't empty."""
    rows, sets, at = [], [], 0
    for chunk in t.column("text").chunks:
        for row, s in shingle_sets(chunk):
            if len(s):
                rows.append(at + row)
                sets.append(s)
        at += len(chunk)
    return np.array(rows, np.int64), t.column("id").to_numpy()[rows] if rows else np.zeros(0, np.int64), sets


def _linked(sets: list[np.ndarray], threshold: int):
    """A function that tells which of some sets reach the threshold with one of them."""
    sizes = np.array([len(s) for s in sets])
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(sizes) - sizes
    mark = np.zeros(len(names), bool)

    def close(at, rest):
        fit = 100 * np.minimum(sizes[rest], sizes[at]) >= threshold * np.maximum(sizes[rest], sizes[at])
        hit = np.zeros(len(rest), bool)
        some = np.flatnonzero(fit)
        if not len(some):
            return hit
        mine = codes[first[at] : first[at] + sizes[at]]
        mark[mine] = True
        n = sizes[rest[some]]
        if len(some) * 2 > len(sets):
            common = np.add.reduceat(mark[codes], first, dtype=np.int64)[rest[some]]
        else:
            ends = np.cumsum(n)
            flat = np.repeat(first[rest[some]] - (ends - n), n) + np.arange(ends[-1])
            common = np.add.reduceat(mark[codes[flat]], ends - n, dtype=np.int64)
        mark[mine] = False
        hit[some] = 100 * common >= threshold * (n + sizes[at] - common)
        return hit

    return close


def _edges(us: list, vs: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _exact(members: DataFrame, threshold: int) -> DataFrame:
    """Edges (u, v) from the first member of each tree of a group's exact forest. members: key, i, j, id, text."""

    def run(batches):
        lean_worker()
        for t in _runs(batches, 3):
            if t.num_rows < 2:
                continue
            _, ids, sets = _sets_of(t)
            if len(sets) > 1:
                pairs = _forest(len(sets), _linked(sets, threshold))
                yield _edges([ids[a] for a, _ in pairs], [ids[b] for _, b in pairs])

    cols = members.select("key", "i", "j", "id", "text")
    return bounded_batches(cols).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id").mapInArrow(run, "u long, v long")


def _between(members: DataFrame, threshold: int) -> DataFrame:
    """Edges (u, v) between the clusters of each group: what ``mine`` has is compared with all. members: key, i, j, mine, cluster, id, text."""

    def run(batches):
        lean_worker()
        for t in _runs(batches, 3):
            rows, ids, sets = _sets_of(t)
            if len(sets) < 2:
                continue
            mine, clusters = t.column("mine").to_numpy()[rows], t.column("cluster").to_numpy()[rows]
            close, all_ = _linked(sets, threshold), np.arange(len(sets))
            us, vs = [], []
            for at in np.flatnonzero(mine).tolist():
                other = all_[(clusters != clusters[at]) & ~mine]
                found = other[close(at, other)] if len(other) else other
                _, first = np.unique(clusters[found], return_index=True)  # one edge to each cluster
                us += [ids[at]] * len(first)
                vs += ids[found[first]].tolist()
            yield _edges(us, vs)

    cols = members.select("key", "i", "j", "mine", "cluster", "id", "text")
    return bounded_batches(cols).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id").mapInArrow(run, "u long, v long")


def _stars(found: DataFrame) -> DataFrame:
    """Components as edges (u, v)."""
    return found.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))


def _links(members: DataFrame, threshold: int) -> DataFrame:
    """Edges (u, v) that join up what is linked in each group, exactly. members: key, id, text."""
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TEXTS).cast("int").alias("b"))
    block = members.join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("id"), F.col("b")).cast("int"))
    edges = materialize(_exact(block.withColumn("j", F.col("i")), threshold), "links")
    large = block.where("b > 1").select("key", "id", "text")
    if large.isEmpty():
        return edges
    # one member of each group of linked ones in a block
    found = components(edges)
    leaders = large.join(found.where("id = component").select("id"), "id")
    found = components(_stars(found).union(_exact(_blocked(leaders, ["key"], TEXTS), threshold)))
    edges = _stars(found)
    # groups that still aren't one: all but their largest cluster is compared with the whole group
    clustered = materialize(large.join(found, "id", "left").withColumn("cluster", F.coalesce("component", "id")).drop("component"), "clusters")
    counts = clustered.groupBy("key", "cluster").agg(F.countDistinct("id").alias("n"))
    largest = counts.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("all"), F.max(F.struct("n", "cluster")).alias("m")).where("c > 1")
    largest = materialize(largest.select("key", F.ceil(F.col("all") / TEXTS).cast("int").alias("b"), F.ceil((F.col("all") - F.col("m.n")) / TEXTS).cast("int").alias("q"), F.col("m.cluster").alias("top")), "largest")
    if largest.isEmpty():
        return edges
    rest = clustered.join(largest, "key")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rest.where("cluster <> top").withColumn("i", deal("q")).withColumn("j", every("b")).withColumn("mine", F.lit(True))
    right = rest.withColumn("j", deal("b")).withColumn("i", every("q")).withColumn("mine", F.lit(False))
    return edges.union(_between(left.unionByName(right), threshold))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    trees = TREES + (MORE_TREES if threshold < THRESHOLD else 0)
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(signatures(source, trees), "signatures")
    sets = signed.where("n > 0")
    classes = sets.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("id"))
    reps = materialize(sets.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "roots", "tokens")).alias("r")).select(F.col("r.doc_id").alias("id"), "n", "r.roots", "r.tokens"), "representatives")

    # the trees
    level = reps.select("id", F.posexplode("roots").alias("tree", "value")).select("id", F.xxhash64("tree", "value").alias("key"))
    small, levels = [], []
    for depth in range(DEPTH + 1):
        level = materialize(level, "nodes")
        levels.append(level)
        counts = level.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        last = depth == DEPTH
        shared = level.join(counts, "key")
        small.append(shared.select("key", "id") if last else shared.where(F.col("c") <= SMALL).select("key", "id"))
        if last or counts.where(F.col("c") > SMALL).isEmpty():
            break
        large = shared.where(F.col("c") > SMALL).select("key", "id").join(reps.select("id", "tokens"), "id")
        pick = F.explode(F.transform(F.sequence(F.lit(1), F.lit(BRANCHES)), lambda b: F.pmod(F.xxhash64("key", b), F.lit(COORDINATES)).cast("int")))
        level = large.withColumn("coordinate", pick).select("id", F.xxhash64("key", "coordinate", F.substring("tokens", F.col("coordinate") + 1, F.lit(1))).alias("key"))
    nodes = small[0]
    for s in small[1:]:
        nodes = nodes.union(s)
    nodes = _blocked(nodes, ["key"], BLOCK).join(reps.select("id", "n", "tokens"), "id")
    groups = components(_candidates(nodes, threshold))
    for table in (*levels, reps):
        discard(table)

    # the exact search
    texts = source.withColumnRenamed("doc_id", "id")
    members = materialize(groups.select("id", F.col("component").alias("key")).hint("merge").join(texts, "id"), "members")
    # a document of several rows stands for all their classes
    named = sets.join(classes, ["d1", "d2", "n"]).select("doc_id", "n", "id")
    several = named.groupBy("doc_id").agg(F.min("id").alias("v"), F.max("id").alias("w")).where("v <> w").select("doc_id")
    same = named.join(several, "doc_id").select(F.col("id").alias("u"), F.col("doc_id").alias("v"))
    linked = materialize(components(_links(members, threshold).union(same)), "components")
    discard(members)

    member = named.join(linked, "id", "left")
    out = member.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    alone = signed.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = out.union(alone)
    shown = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c)).alias(c)
    return out.select(shown("doc_id"), "n_shingles", shown("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))
