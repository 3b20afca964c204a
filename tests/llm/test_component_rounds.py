"""Components in few rounds: each costs several shuffles, which on small tables is most of a run's time."""

import numpy as np

from focusloom.llm import components, near_dedup


def tables(monkeypatch):
    made, real = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: made.append(label) or real(df, label))
    return made


def found(spark, edges):
    return {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}


def test_stars_take_no_round(spark, monkeypatch):
    made = tables(monkeypatch)
    assert found(spark, [(0, k) for k in range(1, 9)] + [(k, 10) for k in range(11, 15)]) == {k: 0 for k in range(9)} | {k: 10 for k in range(10, 15)}
    assert len(made) == 1


def test_two_depths_and_two_parents_take_one_round(spark, monkeypatch):
    made = tables(monkeypatch)
    assert found(spark, [(0, 1), (1, 2)]) == {0: 0, 1: 0, 2: 0}
    assert len(made) == 2
    assert found(spark, [(0, 2), (1, 2)]) == {0: 0, 1: 0, 2: 0}
    assert len(made) == 4


def test_no_edges(spark, monkeypatch):
    made = tables(monkeypatch)
    assert found(spark, []) == {} and found(spark, [(3, 3)]) == {}
    assert len(made) == 2


def test_trees_are_stars_around_their_first():
    chain = lambda at, rest: np.abs(rest - at) == 2
    assert sorted(near_dedup._forest(7, chain)) == [(0, 2), (0, 4), (0, 6), (1, 3), (1, 5)]
