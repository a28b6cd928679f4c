"""Loops and components against brute force on small graphs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.operators import components
from gridloom.operators.loops import loops, numbered_loops

rng = random.Random(2)
GRAPHS = {
    "triangle": [("a", "b"), ("b", "c"), ("c", "a")],
    "tree": [("p", "q"), ("q", "s"), ("s", "s")],
    "ring": [(f"n{i}", f"n{(i + 1) % 20}") for i in range(20)] + [("n3", "x"), ("x", "y")],
    "mesh": [(f"g{i}-{j}", f"g{i}-{j + 1}") for i in range(4) for j in range(3)] + [(f"g{i}-{j}", f"g{i + 1}-{j}") for i in range(3) for j in range(4)] + [(f"t{i}", f"t{i // 2}") for i in range(1, 20)] + [("t1", "t1"), ("g0-0", "g0-1")],
    "random": [(f"r{rng.randrange(40)}", f"r{rng.randrange(40)}") for _ in range(60)],
}


def whole(pairs):
    """The smallest node of each node's component."""
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("name", GRAPHS)
def test_loops(spark, name):
    """As many simple loops as edges are left over, each along edges, each closed by an edge that no other loop has."""
    pairs = GRAPHS[name]
    component = whole(pairs)
    edge = spark.createDataFrame([(f"line:{i}", a, b, True) for i, (a, b) in enumerate(pairs)] + [("line:x", "a", "zz", False)], "key string, src string, dst string, conductive boolean")
    labels = spark.createDataFrame(list(component.items()), "bus string, component string")
    rows = loops(edge, labels)
    found = defaultdict(dict)
    for r in rows.collect():
        assert r["place"] not in found[r["loop"]] and component[r["bus"]] == r["component"]
        found[r["loop"]][r["place"]] = r["bus"]
    simple = {frozenset(p) for p in pairs if p[0] != p[1]}
    assert len(found) == len(simple) - len(component) + len(set(component.values()))
    closing = {k: frozenset(pairs[int(k.split(":")[1])]) for k in found}
    for k, places in found.items():
        buses = [places[i] for i in range(len(places))]
        around = {frozenset((buses[i - 1], buses[i])) for i in range(len(buses))}
        assert len(set(buses)) == len(buses) >= 3 and around <= simple
        assert buses[0] == min(buses) and buses[1] < buses[-1]
        assert around & set(closing.values()) == {closing[k]}
    numbers = defaultdict(list)
    for r in numbered_loops(rows).collect():
        numbers[r["component"]].append(r["number"])
        assert r["n_buses"] == len(found[r["loop"]])
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in numbers.values())


@pytest.mark.parametrize("scattered", [False, True])
def test_components_in_rounds(spark, monkeypatch, scattered):
    """Small limits, so that there are rounds and hubs."""
    for name, n in (("FINISH", 10), ("LEAST_HUB", 5), ("TASK_ROWS", 64)):
        monkeypatch.setattr(components, name, n)
    pairs = [("hub", f"m{i}") for i in range(100)] + [(f"c{i}", f"c{i + 1}") for i in range(100)] + GRAPHS["random"]
    df = spark.createDataFrame([*pairs, (None, "x"), ("alone", "alone")], "src string, dst string")
    got = components.joined(df, scattered=scattered).collect()
    want = whole(p for p in pairs if p[0] != p[1])
    assert {r["node"] for r in got} == set(want) and len(got) == len(want)
    if scattered:
        names = defaultdict(set)
        for r in got:
            names[want[r["node"]]].add(r["component"])
        assert all(len(n) == 1 for n in names.values()) and len(set().union(*names.values())) == len(names)
    else:
        assert {r["node"]: r["component"] for r in got} == want
    assert components.joined(df.limit(0), scattered=scattered).agg(F.count("*")).first()[0] == 0


def test_rounds_have_small_plans(spark, monkeypatch):
    """No job of the search has more than a few joins, whose tables the driver may broadcast, however long the ways."""
    from gridloom.operators import loops as L

    most, settle = [], L.settle
    monkeypatch.setattr(L, "settle", lambda df: most.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join")) or settle(df))
    pairs = GRAPHS["ring"]
    edge = spark.createDataFrame([(f"line:{i}", a, b, True) for i, (a, b) in enumerate(pairs)], "key string, src string, dst string, conductive boolean")
    labels = spark.createDataFrame(list(whole(pairs).items()), "bus string, component string")
    assert L.loops(edge, labels).count() == 20
    assert max(most) <= 4


@pytest.mark.parametrize("shared", [False, True])
def test_components_by_hashes(spark, monkeypatch, shared):
    """Nodes go by hashes without being joined to their edges; where hashes are shared, the result is the same."""
    for name, n in (("FINISH", 10), ("LEAST_HUB", 5), ("TASK_ROWS", 64)):
        monkeypatch.setattr(components, name, n)
    if shared:
        monkeypatch.setattr(components, "_code", lambda node: F.length(node).cast("long"))
    ordered, numbered = [], components.numbered
    monkeypatch.setattr(components, "numbered", lambda *a: ordered.append(1) or numbered(*a))
    pairs = [("hub", f"m{i}") for i in range(100)] + [(f"c{i}", f"c{i + 1}") for i in range(100)] + GRAPHS["random"]
    got = components.joined(spark.createDataFrame(pairs, "src string, dst string").repartition(4)).collect()
    want = whole(p for p in pairs if p[0] != p[1])
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert bool(ordered) == shared
