"""Groups spelling variants: words one edit apart, by an automaton over halves of words.

One edit leaves one of a word's two halves whole: the first stands at the other
word's beginning or the second at its end. Each half, with its words, lives in
one shard by its hash; a word is scanned in the shards of those beginnings and
endings of its own that can be some near word's half (at most two each), so all
words meet all halves that they can hold. A shard is an Aho-Corasick automaton
of its halves. What it finds counts if it stands at the right end and lengths
differ by one at most; then the distance is verified on the other halves: those
of all words with the half found are listed under themselves with one place left
open, so only words really one edit away are looked at, however many share the half.

A half of more words than a shard holds is parted further, by the hash of the
open-place forms, of which both words of a pair have the decisive one. Pairs are
counted where they are found and never leave a shard.

A word's form is its most frequent near word, if that is FACTOR times as frequent;
following forms multiplies frequency each time, so chains are short and end.

Defined cases: null texts have no words; a null doc_id is written as nothing before
the colon; rows that share a doc_id all count; other columns are ignored; an empty
table gives an empty one.
"""

from __future__ import annotations

import collections
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from focusloom.llm.common import bounded_batches, discard, lean_worker, materialize

#: Words are runs of these.
LETTERS = "[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
#: One in so many occurrences loses a letter (so that there are variants to find).
DAMAGED = 31
#: Words whose halves make one shard.
SHARD_WORDS = 5_000
#: Different words that a task counts before it passes them on.
HELD_WORDS = 200_000
HOLE = "\0"


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """(word, n): lower-cased words and how often they occur; one occurrence in ``damaged``, told by hash, is without one letter."""

    def counted(batches):
        lean_worker()
        long = re.compile(LETTERS + "{%d,}" % min_length)
        counts: collections.Counter = collections.Counter()
        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1)):
                before = zlib.crc32(f"{id_}:".encode())
                low = text.as_buffer().to_pybytes().lower().decode()  # of bytes, only A-Z are lower-cased
                for word, n in collections.Counter(long.findall(low)).items():
                    h = zlib.crc32(word.encode(), before)
                    if h % damaged == 0:
                        cut = h % len(word)
                        word = word[:cut] + word[cut + 1 :]
                        if len(word) < min_length:
                            continue
                    counts[word] += n
            if len(counts) > HELD_WORDS:
                yield from emitted(counts)
        yield from emitted(counts)

    def emitted(counts):
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    parts = bounded_batches(texts).mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _lengths(*sizes: str) -> Column:
    return F.array_distinct(F.array(*(F.expr(f"cast({s} as int)") for s in sizes)))


def _routes(listed: DataFrame) -> DataFrame:
    """(word, n, side, segment, rest, own): beginnings (side 0) and endings (side 1) that can be a near word's half; own: the word's own halves."""
    sized = listed.withColumn("m", F.length("word"))
    starts = F.transform(_lengths("(m - 1) div 2", "m div 2", "(m + 1) div 2"), lambda s: F.struct(F.lit(0).alias("side"), s.alias("size")))
    ends = F.transform(_lengths("m div 2", "(m + 1) div 2", "(m + 2) div 2"), lambda s: F.struct(F.lit(1).alias("side"), s.alias("size")))
    each = sized.select("word", "n", "m", F.explode(F.concat(starts, ends)).alias("r")).select("word", "n", "m", "r.side", "r.size")
    first = F.col("side") == 0
    return each.select(
        "word",
        "n",
        "side",
        F.when(first, F.expr("left(word, size)")).otherwise(F.expr("right(word, size)")).alias("segment"),
        F.when(first, F.expr("right(word, m - size)")).otherwise(F.expr("left(word, m - size)")).alias("rest"),
        (F.col("size") == F.when(first, F.expr("m div 2")).otherwise(F.expr("(m + 1) div 2"))).alias("own"),
    )


def _parts(keys: Column) -> Column:
    return F.array_distinct(F.transform(keys, lambda key: F.pmod(F.crc32(key), F.col("parts")).cast("int")))


def _shards(listed: DataFrame, shards: int, shard_words: int) -> DataFrame:
    """(shard, kind, word, n, side, part, parts): halves (kind 0) and words to scan (kind 1), each where they have to be."""
    routes = _routes(listed)
    hot = routes.where("own").groupBy("side", "segment").agg(F.ceil(F.count(F.lit(1)) / shard_words).alias("parts")).where("parts > 1")
    sized = routes.join(hot, ["side", "segment"], "left").withColumn("parts", F.coalesce(F.col("parts"), F.lit(1)).cast("int"))
    size = F.length("rest")
    opened = F.expr("transform(sequence(1, length(rest)), i -> concat(left(rest, i - 1), char(0), substring(rest, i + 1)))")
    longer = F.expr("transform(sequence(0, length(rest)), i -> concat(left(rest, i), char(0), substring(rest, i + 1)))")
    shorter = F.expr("transform(sequence(1, length(rest)), i -> concat(left(rest, i - 1), substring(rest, i + 1)))")
    one = F.array(F.lit(0))
    held = F.when(~F.col("own") | (size == 0), F.array().cast("array<int>")).when(F.col("parts") == 1, one).otherwise(_parts(F.concat(opened, F.array("rest"))))
    met = F.when(size == 0, one).when(F.col("parts") == 1, one).otherwise(_parts(F.concat(opened, longer, shorter)))
    as_kind = lambda array, kind: F.transform(array, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("part")))
    dealt = sized.select("*", F.explode(F.concat(as_kind(held, 0), as_kind(met, 1))).alias("d")).select("*", "d.kind", "d.part")
    shard = F.pmod(F.xxhash64("side", "segment", "part"), F.lit(shards)).cast("int")
    return dealt.select(shard.alias("shard"), "kind", "word", "n", "side", "part", "parts")


class _Half:
    """Words with one half: their other halves, also under themselves with one place open."""

    __slots__ = ("parts", "here", "rests", "opened")

    def __init__(self, parts: int):
        self.parts, self.here, self.rests, self.opened = parts, set(), {}, {}

    def add(self, rest: str, n: int, part: int) -> None:
        self.here.add(part)
        if rest not in self.rests:
            self.rests[rest] = n
            for i in range(len(rest)):
                self.opened.setdefault(rest[:i] + HOLE + rest[i + 1 :], []).append(rest)

    def _mine(self, key: str) -> bool:
        return self.parts == 1 or zlib.crc32(key.encode()) % self.parts in self.here

    def near(self, rest: str):
        """Other halves one edit from ``rest``, each once: of equal letters in a row the first counts as the edited one."""
        for i in range(len(rest)):
            key = rest[:i] + HOLE + rest[i + 1 :]
            found = self.opened.get(key)
            if found and self._mine(key):
                yield from (r for r in found if r != rest)
            key = rest[:i] + rest[i + 1 :]
            if key in self.rests and (not i or rest[i] != rest[i - 1]) and self._mine(key):
                yield key
        for i in range(len(rest) + 1):
            key = rest[:i] + HOLE + rest[i:]
            found = self.opened.get(key)
            if found and self._mine(key):
                yield from (r for r in found if not i or r[i] != rest[i - 1])


class Shard:
    """An automaton of halves, and the words that they belong to."""

    def __init__(self):
        self.halves: dict[tuple[int, str], _Half] = {}
        self.automaton = None

    def add(self, word: str, n: int, side: int, part: int, parts: int) -> None:
        cut = len(word) // 2
        segment, rest = (word[cut:], word[:cut]) if side else (word[:cut], word[cut:])
        self.halves.setdefault((side, segment), _Half(parts)).add(rest, n, part)

    def near(self, word: str):
        """(near word, its n), each once, of those whose half is in this shard."""
        import ahocorasick

        if not self.halves:
            return
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for _, segment in self.halves:
                self.automaton.add_word(segment, len(segment))
            self.automaton.make_automaton()
        m = len(word)
        for end, size in self.automaton.iter(word):
            if end + 1 == size and 2 * size - 1 <= m <= 2 * size + 2:  # a beginning, of words of 2 * size or one more
                half = self.halves.get((0, word[:size]))
                for rest in half.near(word[size:]) if half else ():
                    yield word[:size] + rest, half.rests[rest]
            if end + 1 == m and 2 * size - 2 <= m <= 2 * size + 1:  # an ending, of words of 2 * size or one less
                segment = word[m - size :]
                half = self.halves.get((1, segment))
                for rest in half.near(word[: m - size]) if half else ():
                    other = rest + segment
                    if not word.startswith(other[: len(other) // 2]):  # else found by its beginning
                        yield other, half.rests[rest]


def _scanned(batches):
    """Rows sorted by shard, kind and word: halves first, then the words to scan, of which only the halves are held."""
    lean_worker()
    number, shard, last = None, None, None
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for at, kind, word, n, side, part, parts in zip(*(c.to_pylist() for c in batch.columns)):
            if at != number:
                number, shard, last = at, Shard(), None
            if kind == 0:
                shard.add(word, n, side, part, parts)
            elif word != last:
                last, count, best = word, 0, (0, "")
                for other, m in shard.near(word):
                    count += 1
                    best = min(best, (-m, other))
                if count:
                    for column, value in zip(out, (word, count, -best[0], best[1])):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])


def near_words(listed: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n_near, best_n, best): how many words of (word, n) are one edit away, and the most frequent of them."""
    shards = max(1, -(-2 * listed.count() // shard_words))
    dealt = bounded_batches(_shards(listed, shards, shard_words)).repartition("shard").sortWithinPartitions("shard", "kind", "word")
    found = dealt.mapInArrow(_scanned, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): pointers doubled until none has a form of its own."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = materialize(now.join(next_, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        discard(now)
        now = after
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damaged: int = DAMAGED, factor: int = FACTOR, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words."""
    listed = materialize(words(docs, min_length, min_count, damaged), "words")
    told = listed.join(near_words(listed, shard_words), "word", "left")
    formed = F.col("best_n") >= factor * F.col("n")
    known = materialize(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    discard(listed)
    rooted = known.join(_roots(known.where("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
