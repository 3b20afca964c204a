"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Both sides keep the least k-gram hash of every sliding window of hashes, so a
shared span of WINDOW words keeps a common fingerprint. Documents' fingerprints
are joined with the benchmark's; each hit names a diagonal (document position
less item position) on which the item's words are then compared one by one, and
what lies in equal spans of WINDOW words is hit. Texts that hold none of the
benchmark's anchor words (each window's longest) are passed over before hashing:
a bit table of fixed size, whatever the benchmark's, tells which words may be
anchors. It only ever lets too many texts through, so no window is missed. Items of fewer than WINDOW
words are one window of their own length: winnowing doesn't promise to keep a
fingerprint of them, so one is joined with all hashes of the documents, made only
if there are such items; those shorter than a k-gram have hashes of their own length.

Defined cases: null and wordless texts have no words, no hits, and are clean; an
item without words has no window; repeated rows each get the same result (rows
with equal doc_id and text are searched once); a null doc_id is searched by its
text; repeated item_ids with different texts are different windows of one item;
other columns are ignored; an empty table on either side gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from focusloom.llm.common import materialize

WINDOW = 13
#: Words of a fingerprint; windows of WINDOW - GRAM + 1 hashes keep one.
GRAM = 8
#: 20 * hits >= words makes a document contaminated.
SHARE = 20
#: The anchors' bit table: 2**TABLE bits (256 KB), of which each word sets PROBES.
TABLE, PROBES = 21, 3
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def words_of(text: Column) -> Column:
    """The words of a text: split at the gaps, without the empty ends."""
    return F.filter(F.split(lowered(text), _GAP), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """How many words a text has; letters needn't be lowered for that."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("long")


def _reach(df: DataFrame, column: str, k: int, combine) -> DataFrame:
    """Replaces an array by ``combine`` over the k elements from each position on, by doubling.

    Each step is a column of its own that the next one names twice, so Spark
    works it out once; for the same reason what comes of it is exploded with
    explode_outer, for which no filter on the array is inferred and pushed down.
    The last k - 1 elements cover less than k.
    """
    have = 1
    while have < k:
        step = min(have, k - have)
        ahead = F.slice(column, F.lit(step + 1), F.greatest(F.size(column) - step, F.lit(0)))
        df = df.withColumn(column, F.zip_with(column, ahead, combine))
        have += step
    return df


def with_grams(df: DataFrame, words: str, out: str, k: int) -> DataFrame:
    """Adds the hashes of the k words from each position on; two overlapping halves name a span as well as two that adjoin."""
    df = _reach(df.withColumn(out, F.transform(words, lambda w: F.xxhash64(w))), out, k, lambda a, b: F.xxhash64(a, b))
    return df.withColumn(out, F.slice(out, F.lit(1), F.greatest(F.size(out) - (k - 1), F.lit(0)))) if k > 1 else df


def with_winnowed(df: DataFrame, hashes: str, out: str, span: int) -> DataFrame:
    """Adds the distinct least hashes of each ``span`` in a row (all that there are, if they are fewer)."""
    # least() passes over the nulls past the end
    df = _reach(df.withColumn(out, F.col(hashes)), out, span, lambda a, b: F.least(a, b))
    return df.withColumn(out, F.array_distinct(F.slice(out, F.lit(1), F.greatest(F.size(out) - (span - 1), F.lit(1)))))


def text_key(doc_id: Column, text: Column) -> Column:
    """128 bits that name a row's id and text; null for a null text."""
    return F.when(text.isNotNull(), F.concat_ws("-", F.hex(F.xxhash64(doc_id, text)), F.hex(F.xxhash64(F.lit("second"), text, doc_id))))


def _probes(h: Column) -> list[Column]:
    """The bits of the table that a word's hash names."""
    return [F.shiftrightunsigned(h, TABLE * i).bitwiseAND(F.lit((1 << TABLE) - 1).cast("long")) for i in range(PROBES)]


def _bit_table(words: DataFrame) -> DataFrame:
    """One row: the table of the words (column a) as an array of longs. Its size doesn't depend on their number."""
    bits = words.select(F.explode(F.array(*_probes(F.xxhash64("a")))).alias("p"))
    slots = bits.groupBy(F.shiftright("p", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    whole = words.sparkSession.range(1 << (TABLE - 6)).withColumnRenamed("id", "slot").join(slots, "slot", "left")
    return whole.agg(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("t")).select(F.col("t.bits").alias("bits"))


def _may_be_there(h: Column, table: Column) -> Column:
    """Is a word with this hash in the table, perhaps?"""
    out = None
    for p in _probes(h):
        one = F.call_function("shiftrightunsigned", F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63).cast("long")).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
        out = one if out is None else out & one
    return out


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, n_hit, items): of documents with hits. docs: doc_id, text; items: item_id, text."""
    item_words = items.select(F.col("item_id"), words_of(F.col("text")).alias("item_words")).where(F.size("item_words") > 0).distinct()
    item_words = materialize(item_words.withColumn("item_key", F.sha2(F.concat_ws(" ", "item_words"), 256)), "benchmark")
    sizes = {r[0] for r in item_words.select(F.least(F.size("item_words"), F.lit(window))).distinct().collect()}  # at most ``window`` rows
    lengths = sorted({min(n, gram) for n in sizes})
    # (words hashed, least and greatest size of the items, hashes of a document that keep one)
    groups = [(n, n, n, 1) for n in lengths if n < gram]
    if any(gram <= n < window for n in sizes):
        groups.append((gram, gram, window - 1, 1))
    if window in sizes or not groups:
        groups.append((gram, window, None, window - gram + 1))

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    source = source.withColumn("text_key", text_key(F.col("doc_id"), F.col("text")))
    # every window's longest word: a text with none of them holds no window
    longest = F.expr(f"transform(sequence(1, greatest(size(item_words) - {window - 1}, 1)), i -> array_max(transform(slice(item_words, i, {window}), w -> struct(length(w) as n, w as w))).w)")
    anchors = materialize(_bit_table(item_words.select(F.explode_outer(longest).alias("a")).where("a is not null").distinct()), "anchors")
    hashed = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    # Spark puts the one-row table into the filter itself
    candidates = source.select("*", anchors.scalar().alias("_table")).where(F.exists(hashed, lambda h: _may_be_there(h, F.col("_table")))).drop("_table")
    prints = candidates.select("doc_id", "text_key", words_of(F.col("text")).alias("w"))
    found = None
    for k, least, greatest, span in groups:
        of_items = item_words.where((F.size("item_words") >= least) & (F.lit(True) if greatest is None else F.size("item_words") <= greatest))
        # an item of one window keeps its least hash
        item_hashes = with_winnowed(with_grams(of_items, "item_words", "h", k), "h", "fps", window - k + 1)
        # an item's hash may stand at more than one place: all of them start diagonals
        places = item_hashes.select("item_id", "item_key", F.posexplode_outer("h").alias("item_pos", "fp"))
        kept_items = places.join(item_hashes.select("item_key", F.explode_outer("fps").alias("fp")).distinct(), ["item_key", "fp"], "left_semi")
        doc_hashes = with_grams(prints, "w", "h", k).select("doc_id", "text_key", "h")
        doc_kept = with_winnowed(doc_hashes, "h", "fps", span).select("doc_id", "text_key", F.explode_outer("fps").alias("fp"))
        mine = doc_kept.join(kept_items, "fp").select("doc_id", "text_key", "item_id", "item_key", "fp", "item_pos", F.lit(k).alias("k"))
        found = mine if found is None else found.unionByName(mine)
    found = materialize(found.distinct(), "fingerprints")

    # texts are dealt out by key at every size: what hits grows with the documents and isn't broadcast
    # extend the hits: only documents that have some come here, each row with its words and one item's
    texts = source.join(found.select("text_key").distinct().hint("merge"), "text_key", "left_semi").select("text_key", "text").distinct()
    doc_side = materialize(texts.select("text_key", words_of(F.col("text")).alias("w")), "words")
    found_at = None
    for k in lengths or [gram]:
        placed = with_grams(doc_side, "w", "h", k).select("text_key", F.posexplode_outer("h").alias("pos", "fp")).withColumn("k", F.lit(k))
        found_at = placed if found_at is None else found_at.unionByName(placed)
    seeds = found_at.join(found, ["text_key", "k", "fp"]).select("doc_id", "text_key", "item_id", "item_key", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
    lines = seeds.groupBy("doc_id", "text_key", "item_id", "item_key").agg(F.collect_set("diagonal").alias("diagonals"))
    both = lines.join(doc_side, "text_key").join(item_words.select("item_id", "item_key", "item_words"), ["item_id", "item_key"])
    need = F.least(F.size("item_words"), F.lit(window))
    # for each item position on a diagonal: do the words agree? then runs of at least ``need`` ones
    flags = "array_join(transform(item_words, (x, i) -> if(i + d >= 0 and i + d < size(w) and get(w, i + d) = x, '1', '0')), '')"
    runs = both.select("text_key", "doc_id", "item_id", need.alias("need"), F.explode_outer(F.expr(f"transform(diagonals, d -> struct(d as diagonal, {flags} as flags))")).alias("line"))
    spans = F.expr(
        "aggregate(regexp_extract_all(line.flags, '1+|0+', 0), named_struct('at', 0, 'out', cast(array() as array<struct<at:int,n:int>>)),"
        " (a, x) -> named_struct('at', a.at + length(x), 'out', if(startswith(x, '1') and length(x) >= need, concat(a.out, array(named_struct('at', a.at, 'n', length(x)))), a.out)), a -> a.out)"
    )
    runs = runs.select("text_key", "doc_id", "item_id", "line.diagonal", F.explode(spans).alias("s"))
    covered = runs.select("text_key", "doc_id", "item_id", F.explode(F.sequence(F.col("diagonal") + F.col("s.at"), F.col("diagonal") + F.col("s.at") + F.col("s.n") - 1)).alias("pos"))
    return covered.groupBy("text_key", "doc_id").agg(F.countDistinct("pos").alias("n_hit"), F.collect_set("item_id").alias("items"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated, and the columns to keep) for every row of docs."""
    found = hits(docs, items, window, gram).select("text_key", "n_hit", "items")
    n_words = n_words_of(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`") for c in keep if c not in ("doc_id", "text")))
    rows = rows.select(text_key(F.col("doc_id"), F.col("text")).alias("_key"), n_words.alias("n_words"), "doc_id", *(F.col(f"`{c}`") for c in keep if c != "doc_id"))
    out = rows.join(found.withColumnRenamed("text_key", "_key").hint("merge"), "_key", "left").drop("_key")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.col("items"), F.array().cast("array<bigint>")).alias("items"), ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"), *(F.col(f"`{c}`") for c in keep if c != "doc_id"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of docs that aren't contaminated, with their columns as they are."""
    whole = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    its = {c: F.col(f"_whole.c{i}") for i, c in enumerate(docs.columns)}
    text = its["text"].cast("string")
    rows = docs.select(whole.alias("_whole")).withColumn("_key", text_key(its["doc_id"].cast("long"), text))
    found = hits(docs, items, window, gram).select(F.col("text_key").alias("_key"), "n_hit")
    bad = rows.select("_key", n_words_of(text).alias("_n")).join(found.hint("merge"), "_key").where(SHARE * F.col("n_hit") >= F.col("_n")).select("_key").distinct()
    return rows.join(bad.hint("merge"), "_key", "left_anti").select(*(c.alias(name) for name, c in its.items()))


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of :func:`contamination`'s result."""
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return result.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), "contaminated")
