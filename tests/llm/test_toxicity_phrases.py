"""Matches within exception phrases: the same as by looking at each phrase, also where there are very many."""

import math
import random

from focusloom.llm import toxicity

MODEL = toxicity.Model({"trash": 2.0, "clown": 1.0, "can": 0.5, "bin*": 0.7, "los*": 1.5}, exceptions=("trash can", "can clown", "trash bin", "a trash can loser"))


def plain(text, automaton):
    words = toxicity.fold_words(text)
    found = list(automaton.iter(" " + " ".join(words) + " "))
    spans = [(end - n, end) for end, (_, n, phrase) in found if phrase]
    best = {}
    for end, (weight, n, phrase) in found:
        if not phrase and not any(a < end - n + 1 <= b for a, b in spans):
            best[end - n + 1] = max(weight, best.get(end - n + 1, 0.0))
    return sum(best.values()) / (1.0 + math.log1p(len(words) / toxicity.LENGTH_SCALE)), len(best)


def test_phrases_cover_the_same_matches():
    r, automaton = random.Random(8), MODEL.automaton()
    words = ["trash", "can", "clown", "bin", "bins", "loser", "a", "x"]
    for _ in range(3000):
        text = " ".join(r.choices(words, k=r.randrange(30)))
        assert toxicity.evidence(text, automaton) == plain(text, automaton), text


def test_very_many_phrases_end_soon():
    automaton = MODEL.automaton()
    assert toxicity.evidence("trash can " * 100_000, automaton) == (0.0, 0)
    assert toxicity.evidence("trash can " * 100_000 + "x clown", automaton)[1] == 1
    assert toxicity.evidence(None, automaton) == (0.0, 0)
