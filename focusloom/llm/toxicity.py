"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding maps look-alike letters of other scripts, accents and digit
substitutions to plain letters, so disguised words match. Weights are learnt:
words, and beginnings of words (entries that end with *, for languages that
inflect and compound), whose distinct contexts are far more often toxic. Of the
entries that match at one word the heaviest counts. A text's score comes from the weights found in it, normalised by its length, minus
what exception phrases cover, through a fitted logistic curve.

Defined cases: null and empty texts score as texts without matches; without
labelled rows of both kinds the built-in seed lexicon and curve are used; rows
with equal doc_id are scored one by one; other columns, also ones named like
ours, are ignored.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from focusloom.llm.common import bounded_batches, lean_worker

#: Labelled training rows used at most, taken by hash of doc_id (a documented bound; more change little).
TRAIN_ROWS = 8_000
#: A learnt word occurs in this many toxic contexts at least, and its counts differ from chance by
#: this log-likelihood ratio (p < 0.01), however small its language's part of the toxic texts.
LEAST_CONTEXTS, LEAST_RATIO = 3, 6.63
#: Lengths of word beginnings that may become entries.
BEGINNINGS = (4, 5, 6, 7)
#: Natural log of how much more often it must stand in toxic texts.
LEAST_WEIGHT = 2.5
#: Labels of one document in FOLDS are held out.
FOLDS = 5
#: Words in a text that count as one when weights are normalised by length.
LENGTH_SCALE = 2000.0

# Signs that stand for a letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e"}
# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l", "ℓ": "l",
}
#: Used when there is nothing to learn from.
SEED = {w: 3.0 for w in ("idiot", "moron", "scum", "stupid", "worthless", "pathetic", "disgusting", "loser", "trash", "clown")}
#: A match inside one of these phrases doesn't count.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "loser pays", "pathetic fallacy", "stupid question but", "pond scum")


def _fold_table() -> dict[int, str]:
    """Lower case, without accents, look-alikes folded; other signs than letters and digits become spaces later."""
    table: dict[int, str] = {}
    for code in range(0x80, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if base.isalpha():
            table[code] = base
    for code in range(0xFF21, 0xFF5B):
        base = unicodedata.normalize("NFKC", chr(code)).lower()
        table[code] = base
    for c, base in HOMOGLYPHS.items():
        table[ord(c)] = base
        table[ord(c.upper())] = base
    for c in "​‌‍⁠﻿­":
        table[ord(c)] = ""
    table |= {code: chr(code + 32) for code in range(65, 91)}
    return table


_FOLD = _fold_table()
_SIGNS = {ord(c): base for c, base in SUBSTITUTES.items()}
_EDGES = ".,!?;:*#$%&\"'()[]{}-_/\\=+~`@^<>|"


def fold_words(text: str | None) -> list[str]:
    """A text's folded words: signs at their edges go, those inside stand for letters where words have letters at all."""
    words = []
    for w in (text or "").translate(_FOLD).split():
        w = w.strip(_EDGES)
        if w.isalpha():
            words.append(w)
        elif any(c.isalpha() for c in w):
            words.append("".join(c for c in w.translate(_SIGNS) if c.isalnum()))
        else:
            words.append("0")
    return words


@dataclass
class Model:
    weights: dict[str, float]
    slope: float = 1.2
    bias: float = -2.0
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for w, x in self.weights.items():
            sign = f" {w[:-1]}" if w.endswith("*") else f" {w} "
            a.add_word(sign, (x, len(sign), False))
        for p in self.exceptions:
            a.add_word(f" {p} ", (0.0, len(p) + 2, True))
        a.make_automaton()
        return a


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """The begins and ends of what the spans cover together, in order."""
    begins: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def evidence(text: str | None, automaton) -> tuple[float, int]:
    """The weights found in a text, normalised by its length; the matches."""
    words = fold_words(text)
    # each word stands between two spaces of its own, so neighbours match too; phrases have one space between words
    found = list(automaton.iter(" " + " ".join(words) + " "))
    begins, ends = _merged([(end - n, end) for end, (_, n, phrase) in found if phrase])
    heaviest: dict[int, float] = {}
    for end, (weight, n, phrase) in found:
        at = end - n + 1
        k = bisect_left(begins, at)  # the spans before k begin before ``at``
        if not phrase and not (k and at <= ends[k - 1]):
            heaviest[at] = max(weight, heaviest.get(at, 0.0))
    return sum(heaviest.values()) / (1.0 + math.log1p(len(words) / LENGTH_SCALE)), len(heaviest)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0 if doc_id is not None else False


def _training(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, toxic): at most ``rows`` labelled rows that aren't held out."""
    mine = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    mine = mine.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mine = mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(mine), "doc_id")  # at most ``rows`` pairs of numbers


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Weights and curve from a bounded sample of the labelled rows.

    A word is counted by its distinct contexts (the words on both sides) and
    measured by the distinct texts of each kind, so that copies of one text count once.
    """
    train = _training(docs, labels, rows)

    def contexts(batches):
        lean_worker()
        for batch in batches:
            out: list[tuple] = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = ["", *fold_words(text), ""]
                seen = {}
                for a, w, b in zip(words, words[1:], words[2:]):
                    if 3 <= len(w) <= 24 and w not in seen:
                        seen[w] = c = zlib.crc32(f"{a} {b}".encode())
                        for n in BEGINNINGS:
                            if n < len(w):
                                seen.setdefault(f"{w[:n]}*", c)
                out += [(w, c, toxic) for w, c in seen.items()]
            out.append(("", zlib.crc32(str(len(out)).encode()), 0))
            w, c, t = zip(*out)
            yield pa.record_batch([pa.array(w), pa.array(c, pa.int64()), pa.array(t, pa.int32())], names=["word", "context", "toxic"])

    counts = bounded_batches(train).select("text", "toxic").mapInArrow(contexts, "word string, context long, toxic int").where("word <> ''")
    counts = counts.groupBy("word").agg(F.approx_count_distinct(F.when(F.col("toxic") == 1, F.col("context"))).alias("bad"), F.approx_count_distinct(F.when(F.col("toxic") == 0, F.col("context"))).alias("good"))
    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.countDistinct(F.xxhash64("text")).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model(dict(SEED))
    weight = F.log((F.col("bad") + 0.5) / (n[1] + 1)) - F.log((F.col("good") + 0.5) / (n[0] + 1))
    both = (F.col("bad") + F.col("good")) / (n[0] + n[1])
    ratio = 2 * (F.col("bad") * F.log(F.col("bad") / (both * n[1])) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (both * n[0]))).otherwise(0.0))
    best = counts.where(F.col("bad") >= LEAST_CONTEXTS).withColumn("weight", weight).withColumn("ratio", ratio).where((F.col("weight") >= LEAST_WEIGHT) & (F.col("ratio") >= LEAST_RATIO))
    rows_of = best.orderBy(F.desc("ratio"), "word").collect()  # significant words of TRAIN_ROWS texts, some hundreds
    whole = [(r["word"], r["bad"]) for r in rows_of if not r["word"].endswith("*")]
    # a beginning that one whole word accounts for says no more than the word
    lexicon = {r["word"]: float(r["weight"]) for r in rows_of if not r["word"].endswith("*") or not any(w.startswith(r["word"][:-1]) and n >= 0.8 * r["bad"] for w, n in whole)}
    if not lexicon:
        return Model(dict(SEED))
    model = Model(lexicon)
    points = scored(train.withColumnRenamed("doc_id", "_id"), model, "_id", ("toxic",)).groupBy(F.round("evidence", 1).alias("x"), "toxic").count().collect()  # at most a row for each tenth
    x, y, w = (np.array(v, float) for v in zip(*((r["x"], r["toxic"], r["count"]) for r in points)))
    slope, bias = 1.0, -2.0
    for _ in range(200):  # Newton's steps for a logistic curve with a light ridge
        p = 1 / (1 + np.exp(-(slope * x + bias)))
        g = np.array([(w * (y - p) * x).sum() - 0.05 * slope, (w * (y - p)).sum() - 0.05 * bias])
        h = w * p * (1 - p)
        m = np.array([[(h * x * x).sum() + 0.05, (h * x).sum()], [(h * x).sum(), h.sum() + 0.05]])
        step = np.clip(np.linalg.solve(m, g), -1, 1)
        slope, bias = slope + step[0], bias + step[1]
        if abs(step).max() < 1e-7:
            break
    if slope > 0:
        model.slope, model.bias = round(float(slope), 6), round(float(bias), 6)
    return model


def scored(docs: DataFrame, model: Model, key: str = "doc_id", keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """The key and kept columns with evidence, matches and score of every row: one narrow pass over whole texts.

    A string column that is both scored and kept goes to the workers once.
    """
    cols = [F.col(f"`{key}`").cast("long").alias(key), *(F.col(f"`{c}`") for c in keep)]
    kept = docs.select(*cols).schema
    schema = StructType(list(kept.fields)).add("evidence", "double").add("matches", "integer").add("score", "double")
    n = len(cols)
    once = text in keep and kept[text].dataType == StringType()
    at = 1 + keep.index(text) if once else n

    def run(batches):
        lean_worker()
        automaton = model.automaton()
        for batch in batches:
            got = [evidence(t.as_py(), automaton) for t in batch.column(at)]
            e = np.array([g[0] for g in got])
            score = 1 / (1 + np.exp(-(model.slope * e + model.bias)))
            yield pa.record_batch([*batch.columns[:n], pa.array(e), pa.array([g[1] for g in got], pa.int32()), pa.array(score)], names=[*batch.schema.names[:n], "evidence", "matches", "score"])

    more = [] if once else [F.col(f"`{text}`").cast("string").alias("_text")]
    return bounded_batches(docs).select(*cols, *more).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    out = scored(docs, fit(docs, labels, rows))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
