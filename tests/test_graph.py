"""Distances by buckets against a queue, and what their rounds move."""

import heapq
import random

import pytest

from wayline.operators import graph


def by_queue(edges, starts, directed):
    out = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
        if not directed:
            out.setdefault(b, []).append((a, w))
    done, heap = {}, [(0.0, s) for s in starts]
    while heap:
        far, node = heapq.heappop(heap)
        if node not in done:
            done[node] = far
            for to, w in out.get(node, []):
                heapq.heappush(heap, (far + w, to))
    return done


@pytest.mark.parametrize("directed,delta,most", [(False, None, 10_000), (True, 40.0, 3), (False, 1000.0, 4)])
def test_distances_equal_a_queue(spark, monkeypatch, directed, delta, most):
    monkeypatch.setattr(graph, "SLICE", most)
    rng = random.Random(most)
    edges = [(rng.randint(0, 40), rng.randint(0, 40), float(rng.choice([0, 1, 2, 5, 30, 80]))) for _ in range(80)] + [(0, i, 9.0) for i in range(30)] + [(99, 98, 1.0)]
    starts = spark.createDataFrame([(1, 1), (2, 2), (2, 7), (2, 7), (3, 500)], "origin int, node int")
    got = {(r.origin, r.node): r.dist for r in graph.distances(spark.createDataFrame(edges, "a int, b int, w double"), starts, directed=directed, delta=delta).collect()}
    want = {(o, n): d for o, s in ((1, [1]), (2, [2, 7]), (3, [500])) for n, d in by_queue(edges, s, directed).items()}
    assert got == want


def test_within_rounds_and_negative_weights(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 9.0)], "a int, b int, w double")
    start = spark.createDataFrame([(1, 1)], "origin int, node int")
    near = {r.node: r.dist for r in graph.distances(edges, start, rounds=1).collect()}
    assert near == {1: 0, 2: 1, 3: 9}
    with pytest.raises(ValueError, match="negative"):
        graph.distances(spark.createDataFrame([(1, 2, -1.0)], "a int, b int, w double"), start)


def test_rounds_read_partitioned_edges(spark):
    """The edges lie by node and slice: extending a front exchanges the front and what it finds, not the edges."""
    step, busy = graph.adjacency(spark.createDataFrame([(i % 50, i % 7, 1.0) for i in range(400)], "a int, b int, w double"))
    front = spark.range(40).selectExpr("1 as origin", "cast(id as int) as node", "0.0D as dist", "false as heavy", "1.0D as delta")
    plan = graph._extended(front, step, busy)._jdf.queryExecution().executedPlan().toString()
    # The scan of the edges has no exchange above it before the join.
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "ExistingRDD" in line and "_w" in line)
    above = [line for line in lines[:at] if len(line) - len(line.lstrip(" :+-")) < len(lines[at]) - len(lines[at].lstrip(" :+-"))]
    join = max(i for i, line in enumerate(above) if "Join" in line)
    assert not any("Exchange" in line for line in above[join:])
