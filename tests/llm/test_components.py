"""Connected components: results, and how many edges are read."""

import random

import pytest

from pagewake.llm import components


def least_reachable(edges):
    label = {v: v for e in edges for v in e}
    for _ in label:
        was = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if was == label:
            return label
    return label


@pytest.mark.parametrize("edges", [
    [(random.Random(s).randrange(60), random.Random(s + 0.5).randrange(60)) for s in range(45)],
    [(i, i + 1) for i in range(0, 300)][::-1],
    [(100, i) for i in range(100)] + [(7, 7), (200, 200)],
    [],
])
def test_components_are_the_least_reachable_vertices(spark, edges):
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert dict(map(tuple, got.collect())) == least_reachable(edges) and got.count() == len({v for e in edges for v in e})


def test_a_group_of_many_edges_is_read_once(spark, monkeypatch):
    edges, left = [(i, j) for i in range(60) for j in range(i)], []

    def noted(rows, real=components.written):
        out = real(rows)
        if out.columns == ["a", "b"]:
            left.append(out.count())
        return out

    monkeypatch.setattr(components, "written", noted)
    assert {r.label for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == {0}
    assert left == [1770, 0]
