"""Loops by levels: small parts, so that ways lead through trees of several levels."""

import random
from collections import defaultdict

import pytest

from gridloom.operators import loops as L
from test_loops import GRAPHS, whole

rng = random.Random(5)
LARGE = [(f"q{i}", f"q{i + 1}") for i in range(80)] + [(f"q{rng.randrange(80)}", f"q{rng.randrange(80)}") for _ in range(40)] + [("hub", f"q{i}") for i in range(0, 80, 7)] + [(f"q{i}", f"leaf{i}") for i in range(0, 80, 5)]
LARGE += [(b, a) for a, b in LARGE[::9]]


@pytest.mark.parametrize("name", ["mesh", "large"])
def test_loops_in_levels(spark, monkeypatch, name):
    """As many loops as with one part, each along edges and closed by an edge that no other loop has; a few jobs for each level, however long the ways."""
    for limit, n in (("CHUNK_BITS", 4), ("FINISH", 10), ("ASKED", 3)):
        monkeypatch.setattr(L, limit, n)
    found, level = [], L._Level
    monkeypatch.setattr(L, "_Level", lambda edges, last: found.append(level(edges, last)) or found[-1])
    pairs = LARGE if name == "large" else GRAPHS[name]
    component = whole(pairs)
    edge = spark.createDataFrame([(f"line:{i}", a, b, True) for i, (a, b) in enumerate(pairs)], "key string, src string, dst string, conductive boolean").repartition(3)
    rows = L.loops(edge, spark.createDataFrame(list(component.items()), "bus string, component string")).collect()
    assert len(found) > 1
    simple = {frozenset(p) for p in pairs if p[0] != p[1]}
    ways = defaultdict(dict)
    for r in rows:
        assert r["place"] not in ways[r["loop"]] and r["component"] == component[r["bus"]]
        ways[r["loop"]][r["place"]] = r["bus"]
    assert len(ways) == len(simple) - len(component) + len(set(component.values()))
    closing = {k: frozenset(pairs[int(k.split(":")[1])]) for k in ways}
    for k, places in ways.items():
        buses = [places[i] for i in range(len(places))]
        around = {frozenset((buses[i - 1], buses[i])) for i in range(len(buses))}
        assert len(set(buses)) == len(buses) >= 3 and around <= simple
        assert buses[0] == min(buses) and buses[1] < buses[-1]
        assert around & set(closing.values()) == {closing[k]}
        assert k == min((f"line:{i}" for i, p in enumerate(pairs) if frozenset(p) == closing[k]))
    assert {r["loop"] for r in L.closing_edges(edge).collect()} == set(ways)


def test_jobs_do_not_grow_with_ways(spark):
    """A ring of 3000 buses takes as many jobs as one of 3."""
    def jobs(n):
        edge = spark.createDataFrame([(f"line:{i}", f"n{i}", f"n{(i + 1) % n}", True) for i in range(n)], "key string, src string, dst string, conductive boolean")
        labels = spark.createDataFrame([(f"n{i}", "n0") for i in range(n)], "bus string, component string")
        spark.sparkContext.setJobGroup(f"ring{n}", "")
        assert L.loops(edge, labels).count() == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ring{n}"))

    try:
        assert jobs(3000) <= jobs(3) < 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rules_name_loops_without_their_ways(spark, monkeypatch):
    """rule_top numbers the loops of each component from the edges that close them."""
    from gridloom.plans.rules import rule_top

    monkeypatch.setattr(L, "_ways", None)
    found = [r["object_id"] for r in rule_top(spark, "/root/testdata/sf0.001").where("code = 'TOP003'").collect()]
    assert found and len(set(found)) == len(found)
