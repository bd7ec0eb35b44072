"""Greedy choice makes objects of the items on top of the heap only."""

from docweave.operators import coverage as C
from tests.test_coverage_choice import made, tables


def test_few_items_are_opened():
    opened = []
    sets = [{(i, j): 1.0 for j in range(3)} for i in range(500)] + [{"a": 9.0, "b": 1.0}, {"a": 9.0}]

    def concepts(at):
        opened.append(at)
        return sets[at]

    found = C.choose(list(range(502)), [1] * 502, [sum(s.values()) for s in sets], concepts, 3)
    assert found == [(500, 10.0), (0, 3.0), (1, 3.0)]
    assert len(opened) <= 5


def test_bounds_that_are_too_high_change_nothing():
    sets = [{"a": 2.0}, {"b": 2.0}, {"a": 2.0, "c": 1.0}]
    assert C.choose([7, 3, 9], [1, 1, 1], [2.5, 2.1, 3.0], sets.__getitem__, 2) == [(2, 3.0), (1, 2.0)]


def test_only_choices_are_written(spark, monkeypatch):
    """All items with their concepts were written, and dealt twice, before."""
    kept, real = [], C.written
    monkeypatch.setattr(C, "written", lambda df, tag: kept.append(real(df, tag)) or kept[-1])
    sizes, covers, weights = made(99, 60)
    got = C.best_coverage(*tables(spark, sizes, covers, weights), 12, part=20).collect()
    assert got and max(t.count() for t in kept) < sum(bool(c) for c in covers.values()) * 0.8
