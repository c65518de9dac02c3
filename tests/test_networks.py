"""Seeds of line networks against walks over each reach, and distances along lines against Dijkstra's."""

import heapq
import math
import random

import pytest

from fluvial.operators import networks

KIND = "id long, down long, parts array<array<struct<x:double,y:double>>>"


def dijkstra(edges, sources):
    far, heap = {}, [(0.0, s) for s in sorted(sources)]
    heapq.heapify(heap)
    while heap:
        d, p = heapq.heappop(heap)
        if p in far:
            continue
        far[p] = d
        for q, w in edges.get(p, {}).items():
            if q not in far:
                heapq.heappush(heap, (d + w, q))
    return far


def seeds_of(rows, z):
    """Every reach by itself."""
    reaches = {}
    for k, down, parts in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        reaches.setdefault(k, (down, parts))
    fed = {down for down, _ in reaches.values()}
    out = set()
    for k, (down, parts) in reaches.items():
        if k in fed:
            continue
        parts = [p for p in parts if len(p) > 1]
        ends = list(dict.fromkeys(e for p in parts if p[0] != p[-1] for e in (p[0], p[-1])))
        segments = [s for p in reaches.get(down, (None, []))[1] for s in zip(p, p[1:])]

        def off(p, a, b):
            n = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
            t = max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / n)) if n else 0.0
            return math.hypot(p[0] - a[0] - t * (b[0] - a[0]), p[1] - a[1] - t * (b[1] - a[1]))

        if segments:
            v = {e: min(off(e, *s) for s in segments) for e in ends}
            slack = lambda x: max(1e-9, x * 1e-9)
        else:
            beside = {e: set() for e in ends}
            for p in parts:
                for at, following in ((p[0], p[1]),) if p[0] == p[-1] else ((p[0], p[1]), (p[-1], p[-2])):
                    if at in beside:
                        beside[at].add(following)
            ends = [e for e in ends if len(beside[e]) < 2]
            v = {e: z[k, e] for e in ends if (k, e) in z}
            slack = lambda x: max(0.01, abs(x) * 1e-9)
        least = min(v.values(), default=None)
        outlets = [e for e in ends if e in v and v[e] <= least + slack(least)]
        upper = [e for e in ends if e not in outlets]
        if ends and not upper and v:
            upper = [max(outlets, key=lambda e: v[e])]
        if len(parts) and len(upper) > 1 and outlets and len(reaches[k][1]) > 1:
            edges = {}
            for p in parts:
                if p[0] != p[-1]:
                    w = sum(math.dist(a, b) for a, b in zip(p, p[1:]))
                    edges.setdefault(p[0], {})[p[-1]] = edges.setdefault(p[-1], {})[p[0]] = w
            far = dijkstra(edges, outlets)
            down_of = {p: [q for q in edges[p] if p in far and q in far and far[p] > far[q] + max(1e-9, max(far[p], far[q]) * 1e-9)] for p in edges}
            passed = set()
            for u in upper:
                stack = list(down_of.get(u, ()))
                while stack:
                    q = stack.pop()
                    if q not in passed:
                        passed.add(q)
                        stack += down_of.get(q, ())
            upper = [u for u in upper if u not in passed]
        out |= {(k, *u) for u in upper}
    return out


def network(r, n):
    rows = []
    for k in range(n):
        y = 100.0 * k
        nodes = [(float(r.randrange(12)), y + r.randrange(12)) for _ in range(9)]
        parts = []
        for _ in range(r.choice([1, 1, 2, 4, 8])):
            parts.append([r.choice(nodes), *((r.uniform(0, 12), y + r.uniform(0, 12)) for _ in range(r.randrange(2))), r.choice(nodes)])
        rows.append((k, r.choice([None, k // 2, k // 2, 9999]), parts))
    return rows + [(None, 1, [[(0.0, 0.0), (1.0, 0.0)]]), (n, 2, []), (n + 1, 3, [[(5.0, 5.0)]]), (n + 2, n + 2, [[(0.0, 0.0), (1.0, 1.0)]]), rows[3], (5, 7, [[(-1.0, -1.0), (3.0, 3.0)]])]


@pytest.mark.parametrize("seed", [1, 2])
def test_seeds_equal_walks(spark, seed):
    r = random.Random(seed)
    rows = network(r, 150)
    z = {(k, p): r.choice([1.0, 1.005, 2.0, r.uniform(0, 9)]) for k, _, parts in rows if k is not None for part in parts for p in part if r.random() < 0.8}
    reaches = spark.createDataFrame(rows, KIND).repartition(5)
    heights = spark.createDataFrame([(k, *p, v) for (k, p), v in z.items()], "id long, x double, y double, z double")
    got = networks.headwater_seeds(reaches, heights, "id", "down").collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == seeds_of(rows, z)
    got = networks.headwater_seeds(reaches, None, "id", "down").collect()
    assert {tuple(x) for x in got} == seeds_of(rows, {})


def test_a_branch_on_the_way_is_no_seed(spark):
    y_shape = [[(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0), (2.0, 1.0)], [(1.0, 0.0), (2.0, -1.0)]]
    rows = [(1, 2, y_shape), (2, None, [[(-5.0, 0.0), (0.0, 0.0)]])]
    got = networks.headwater_seeds(spark.createDataFrame(rows, KIND), None, "id", "down").collect()
    assert {tuple(x) for x in got} == {(1, 2.0, 1.0), (1, 2.0, -1.0)}
    assert networks.headwater_seeds(spark.createDataFrame([], KIND), None, "id", "down").count() == 0


def test_distances_along_lines(spark):
    r = random.Random(9)
    pairs = {(g, *sorted(r.sample(range(60), 2))): float(r.randrange(1, 50)) for g in range(3) for _ in range(90)}
    both = [(g, p, q, w) for (g, a, b), w in pairs.items() for p, q in ((a, b), (b, a))]
    sources = [(g, r.randrange(60)) for g in range(3) for _ in range(2)]
    got = {(x.g, x.p): x.d for x in networks.spread(spark.createDataFrame(both, "g int, p int, q int, len double"), spark.createDataFrame(sources, "g int, p int"), "g").collect()}
    want = {}
    for g in range(3):
        edges = {}
        for h, p, q, w in both:
            if h == g:
                edges.setdefault(p, {})[q] = w
        want |= {(g, p): d for p, d in dijkstra(edges, {p for h, p in sources if h == g}).items()}
    assert got == want


@pytest.mark.parametrize("seed", [3, 4])
def test_reaches_in_one_task_take_no_rounds(spark, monkeypatch, seed):
    r = random.Random(seed)
    rows = network(r, 60)
    reaches = spark.createDataFrame(rows, KIND).repartition(3)
    monkeypatch.setattr(networks, "BOX", 2)
    with monkeypatch.context() as m:
        m.setattr(networks, "_rounds", lambda *_: pytest.fail("a round over all reaches"))
        short = networks.headwater_seeds(reaches, None, "id", "down").collect()
    monkeypatch.setattr(networks, "MOST", 5)  # now some are long
    assert {tuple(x) for x in short} == seeds_of(rows, {}) == {tuple(x) for x in networks.headwater_seeds(reaches, None, "id", "down").collect()}
