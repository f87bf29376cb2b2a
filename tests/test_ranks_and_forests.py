"""Exact ranks and sums along forests against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

from lodestat.operators import graph, sessions
from lodestat.operators.ranks import nearest_ranks


def test_ranks_of_groups_with_ties_nulls_and_negative_values(spark):
    rng = random.Random(5)
    groups = {"a": [rng.choice([0, 1, 7]) for _ in range(50)], "b": [rng.randint(-10**12, 10**12) for _ in range(200)], None: [3], "c": [None, None], "d": [10**6 + i for i in range(100)]}
    counted = [(g, v, n) for g, values in groups.items() for v, n in Counter(values).items()]
    counts = spark.createDataFrame(counted, "g string, v long, n long")
    percents = {"p1": 1, "p50": 50, "p95": 95, "p100": 100}
    got = {r.g: r for r in nearest_ranks(counts, ["g"], "v", "n", percents).collect()}
    assert set(got) == set(groups) - {"c"}
    for g in got:
        values = sorted(groups[g])
        assert [got[g][name] for name in percents] == [values[math.ceil(p * len(values) / 100) - 1] for p in percents.values()], g


def test_ranks_without_keys_and_without_rows(spark):
    counts = spark.createDataFrame([(2.5, 3), (0.25, 1)], "v double, n long")
    assert nearest_ranks(counts, [], "v", "n", {"low": 25, "mid": 26}).collect() == [(0.25, 2.5)]
    assert nearest_ranks(counts.limit(0), [], "v", "n", {"low": 25}).collect() == [(None,)]


def test_survival_and_distribution_of_no_sessions(spark):
    none = spark.createDataFrame([], "id string, time_created long, time_updated long, tokens_input long, tokens_output long, tokens_cache_read long")
    assert sessions.session_survival(none).first().asDict() == {"total": 0, "median_seconds": 0, "short_share": 0.0}
    assert sessions.token_distribution(none).count() == 0


def test_depths_and_sizes_of_a_long_chain_and_a_random_forest(spark):
    rng = random.Random(3)
    parent = {f"c{i}": f"c{i - 1}" if i else None for i in range(70)}
    parent |= {f"r{i}": f"r{rng.randrange(i)}" if i % 9 else None for i in range(120)}
    trees = spark.createDataFrame(list(parent.items()), "id string, parent string")
    above = {x: [] for x in parent}
    for x in parent:
        at = x
        while at is not None:
            above[x].append(at)
            at = parent[at]
    size, children = Counter(a for up in above.values() for a in up), Counter(parent.values())
    shape = graph.lineage(trees)
    assert {r.id: (r.depth, r.subtree_size, r.children) for r in shape.collect()} == {x: (len(above[x]) - 1, size[x], children[x]) for x in parent}
    below = defaultdict(set)
    for x, up in above.items():
        for a in up:
            below[a].add(x)
    for x in ("c69", "c0", "r1", "r50"):
        assert {r.id for r in graph.focus(trees, shape, x).collect()} == set(above[x]) | below[x]
    assert graph.focus(trees, shape, "gone").count() == len(parent)


def test_graph_of_a_chain_and_of_wide_levels(spark):
    import random

    from lodestat.operators import graph

    def walk(parents, budget):
        """A breadth-first walk by plain loops."""
        kids, size = {}, {}
        for x, p in parents.items():
            kids.setdefault(p, []).append(x)
        for x in parents:
            while x is not None:
                size[x] = size.get(x, 0) + 1
                x = parents[x]
        taken, level = [], [None]
        while level and len(taken) < budget:
            level = [x for p in level for x in sorted(kids.get(p, []), key=lambda x: (-size[x], x))]
            taken += level
        return taken[:budget]

    rng = random.Random(6)
    chain = {f"{i:04}": f"{i - 1:04}" if i else None for i in range(300)}
    wide = {f"w{i:03}": None if i < 5 else f"w{rng.randrange(i if i < 40 else 40):03}" for i in range(400)}
    for parents, budgets in ((chain, (1, 250, 400)), (wide, (1, 3, 5, 30, 200, 400, 1000))):
        trees = spark.createDataFrame(list(parents.items()), "id string, parent string")
        shape = graph.lineage(trees).cache()
        for budget in budgets:
            began = spark.sparkContext._jsc.sc().statusTracker().getJobIdsForGroup(None)
            got = graph.lineage_graph(shape, budget)
            jobs = len(set(spark.sparkContext._jsc.sc().statusTracker().getJobIdsForGroup(None)) - set(began))
            rows = got.collect()
            assert [r.id for r in rows] == walk(parents, budget) and [r.position for r in rows] == list(range(len(rows)))
            assert rows[0].omitted == len(parents) - len(rows) and jobs <= 16
        shape.unpersist()
