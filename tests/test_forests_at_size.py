"""Forests whose loops must not grow with the number of sessions: sizes of plans, cycles of all lengths against plain walks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestat.operators import graph


def estimate(df) -> int:
    """Bytes that the planner takes a table for."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def cuts(parents):
    """Sessions whose edge closes a cycle, by walks from the ids in order."""
    cut, seen = set(), set()
    for start in sorted(parents):
        path, here = [], start
        while here is not None and here not in path and here not in seen:
            path.append(here)
            here = parents[here]
        if here is not None and here in path:
            cut.add(path[-1])
        seen |= set(path)
    return cut


def test_forests_of_cycles_with_long_ways_into_them(spark):
    rng = random.Random(8)
    shapes = [{f"{i}": f"{rng.randrange(60)}" for i in range(60)}]
    ring = {f"r{i:02}": f"r{(i + 1) % 23:02}" for i in range(23)}
    shapes.append(ring | {f"a{i:02}": f"a{i + 1:02}" if i < 40 else "r07" for i in range(41)} | {"x": "y", "y": "x", "w": "y", "z": None, "u": "z"})
    for parents in shapes:
        parents = {x: None if p == x else p for x, p in parents.items()}
        trees = graph.forest(spark.createDataFrame(list(parents.items()), "id string, parent string"))
        want = cuts(parents)
        assert {(r.id, r.parent, r.cut) for r in trees.collect()} == {(x, None if x in want else p, x in want) for x, p in parents.items()}


def test_sizes_of_forests_are_those_of_their_rows(spark):
    # 600 sessions: a loop over all of them takes ten rounds, whose estimate has a thousand digits
    parents = [(str(k), "1" if k == 0 else "0" if k == 1 else str(k // 4)) for k in range(600)]
    trees = graph.forest(spark.createDataFrame(parents, "id string, parent string"))
    assert estimate(trees) < 10**6
    assert [r.id for r in trees.where("cut").collect()] == ["1"]


def test_sizes_of_sums_along_a_deep_chain_are_those_of_their_rows(spark):
    chain = spark.createDataFrame([(f"{i}", f"{i - 1}" if i else None) for i in range(520)], "id string, parent string")
    sums = graph.sums_along(chain, F.lit(1), F.lit(1))  # ten rounds
    assert estimate(sums) < 10**6
    assert {r.id: (r.up, r.down) for r in sums.collect()} == {f"{i}": (i + 1, 520 - i) for i in range(520)}


@pytest.fixture(scope="module")
def grown(spark):
    """Nodes, their forest and its shape: a chain of 200 under a cycle of two, read through the given operators."""
    parents = {"a": "b", "b": "a", "0": "b", "self": "self", "lost": "gone"} | {f"{i}": f"{i - 1}" for i in range(1, 200)}
    nodes = graph.normalized(spark.createDataFrame(list(parents.items()), "id string, parent_id string"))
    trees = graph.forest(nodes)
    return nodes, trees, graph.lineage(trees)


def test_summary_of_a_deep_forest_is_estimated_by_its_rows(grown):
    summary = graph.lineage_summary(*grown)
    assert estimate(summary) < 10**60
    # the walk from 0 enters at b, so that a is cut: a, b, 0 to 199
    assert summary.first().asDict() == {"sessions": 204, "self_parents": 1, "orphans": 1, "cycles_cut": 1, "roots": 3, "children": 201, "max_depth": 201}


def test_focus_on_a_deep_forest_is_estimated_by_its_rows(grown):
    near = graph.focus(grown[1], grown[2], "100")
    assert estimate(near) < 10**20
    assert {r.id for r in near.collect()} == {"a", "b"} | {f"{i}" for i in range(200)}
    assert [r.id for r in graph.focus(grown[1], grown[2], "self").collect()] == ["self"]


def test_graph_and_edges_of_a_deep_forest_are_estimated_by_their_rows(grown):
    taken = graph.lineage_graph(grown[2], 5)
    edges = graph.lineage_edges(taken)
    assert estimate(taken) < 10**30 and estimate(edges) < 10**30
    assert [r.id for r in taken.collect()] == ["a", "lost", "self", "b", "0"]
    assert [tuple(r) for r in edges.collect()] == [("a", "b"), ("b", "0")]


def test_jobs_of_the_graph_read_the_shape_once(spark, grown):
    taken = graph.lineage_graph(grown[2], 5)
    assert "sum(" not in taken._jdf.queryExecution().optimizedPlan().toString() and "Aggregate" not in taken._jdf.queryExecution().optimizedPlan().toString()
