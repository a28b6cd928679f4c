"""Queries over the topology of the grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import topology as T
from gridloom.operators.loops import loops
from gridloom.plans.testbed import Grid, with_grid


class Net:
    """What graph queries share: known edges, active sources and island labels."""

    def __init__(self, spark, sf_dir):
        g = self.grid = Grid(spark, sf_dir)
        self.bus = g.bus
        self._edge = None
        self.sources = T.active_sources(g.source, g.bus)
        self._labels = None

    @property
    def edge(self):
        if self._edge is None:  # written once: components, counts and traces all read it
            self._edge = T.store(T.known_ends(T.edges(self.grid.line, self.grid.transformer, self.grid.switch), self.bus))
        return self._edge

    @property
    def labels(self):
        if self._labels is None:
            self._labels = T.store(T.islands_of_buses(self.bus, self.edge))
        return self._labels

    def stops(self):
        return self.grid.switch.where("in_service AND NOT closed").select(F.explode(F.array("from_bus", "to_bus")).alias("bus")).unionAll(self.sources.select("bus")).distinct()


def graph_edges(spark, sf_dir):
    g = Grid(spark, sf_dir)
    return T.edges(g.line, g.transformer, g.switch)


def graph_components(spark, sf_dir):
    return Net(spark, sf_dir).labels


def graph_islands(spark, sf_dir):
    n = Net(spark, sf_dir)
    return T.island_facts(n.labels, n.edge, n.sources)


def graph_isolated(spark, sf_dir):
    n = Net(spark, sf_dir)
    return T.isolated(n.bus, n.edge)


def graph_energized(spark, sf_dir):
    n = Net(spark, sf_dir)
    return T.energized(n.labels, n.sources)


def graph_deenergized(spark, sf_dir):
    n = Net(spark, sf_dir)
    return n.labels.select("bus").join(T.energized(n.labels, n.sources), "bus", "left_anti")


def graph_source_trace_buses(spark, sf_dir):
    n = Net(spark, sf_dir)
    return T.source_totals(n.labels, n.edge, n.sources)[0]


def graph_source_trace_edges(spark, sf_dir):
    n = Net(spark, sf_dir)
    return T.source_totals(n.labels, n.edge, n.sources)[1]


def _feeders(spark, sf_dir, cross=False):
    n = Net(spark, sf_dir)
    return T.Feeders(n.bus, n.edge, n.sources, cross)


def graph_feeder_buses(spark, sf_dir):
    return _feeders(spark, sf_dir).buses()


def graph_feeder_edges(spark, sf_dir):
    return _feeders(spark, sf_dir).edges()


def graph_feeder_boundaries(spark, sf_dir):
    return _feeders(spark, sf_dir).boundaries()


def graph_feeder_overlaps(spark, sf_dir):
    return _feeders(spark, sf_dir).overlaps()


def graph_feeder_buses_crossing(spark, sf_dir):
    return _feeders(spark, sf_dir, True).buses()


def graph_open_boundaries(spark, sf_dir):
    n = Net(spark, sf_dir)
    return T.open_boundaries(n.grid.switch, T.energized(n.labels, n.sources))


def graph_parallel_groups(spark, sf_dir):
    return T.parallel_groups(Net(spark, sf_dir).edge)


def graph_degrees(spark, sf_dir):
    return T.degrees(Net(spark, sf_dir).edge)


def graph_branches(spark, sf_dir):
    n = Net(spark, sf_dir)
    stops = n.stops()
    return T.branch_facts(n.edge, T.settle(T.branches(n.edge, stops)), stops)


def graph_feeder_membership(spark, sf_dir):
    g = Grid(spark, sf_dir)
    return T.feeder_membership(g.bus, g.line, g.transformer, g.source)


def graph_label_propagation(spark, sf_dir):
    """Feeder ids carried from labelled buses over lines and transformers to the nearest buses."""
    n = Net(spark, sf_dir)
    wires = T.conductive(n.edge).where("object_type <> 'switch'")
    return T.propagate_labels(wires, n.bus.where("feeder_id IS NOT NULL").select(F.col("id").alias("bus"), F.col("feeder_id").alias("label")))


def graph_loops(spark, sf_dir):
    """The buses of each independent loop, in order."""
    n = Net(spark, sf_dir)
    return loops(n.edge, n.labels)


QUERIES = {f.__name__: f for f in (graph_loops, graph_edges, graph_components, graph_islands, graph_isolated, graph_energized, graph_deenergized, graph_source_trace_buses, graph_source_trace_edges, graph_feeder_buses, graph_feeder_edges, graph_feeder_boundaries, graph_feeder_overlaps, graph_feeder_buses_crossing, graph_open_boundaries, graph_parallel_groups, graph_degrees, graph_branches, graph_feeder_membership, graph_label_propagation)}

_E = """edge AS (
  SELECT concat('line:', id) AS key, 'line' AS object_type, id AS object_id, from_bus AS src, to_bus AS dst, TRUE AS conductive FROM line WHERE in_service
  UNION ALL SELECT concat('transformer:', id), 'transformer', id, hv_bus, lv_bus, TRUE FROM transformer WHERE in_service
  UNION ALL SELECT concat('switch:', id), 'switch', id, from_bus, to_bus, closed FROM switch WHERE in_service)"""
_W = _E + """, wire AS (SELECT * FROM edge WHERE conductive AND src IN (SELECT id FROM bus) AND dst IN (SELECT id FROM bus)),
side AS (SELECT src AS bus, dst AS other, key, object_type FROM wire UNION ALL SELECT dst, src, key, object_type FROM wire)"""
_S = ", src AS (SELECT id AS source_id, bus_id AS bus FROM source WHERE in_service AND bus_id IN (SELECT id FROM bus))"


def _reach(name: str, side: str, start: str = "SELECT id AS x, id AS y FROM bus") -> str:
    return f", {name}_r(x, y) AS ({start} UNION SELECT r.x, e.other FROM {name}_r r JOIN ({side}) e ON e.bus = r.y), {name} AS (SELECT x AS bus, min(y) AS component FROM {name}_r GROUP BY x)"


_C = _W + _reach("lab", "SELECT bus, other FROM side")
_ALL = ("bus", "line", "transformer", "switch", "source")
_g = lambda body: with_grid("+" + body, *_ALL)


def _feeder(cross: bool) -> str:
    """Feeders by plain reach: from a root through interior buses, with the ends where a trace stops."""
    allowed = "wire" if cross else "(SELECT * FROM wire WHERE object_type <> 'transformer')"
    return (
        _W + _S + f""", allowed AS (SELECT * FROM {allowed} a WHERE src <> dst), aside AS (SELECT src AS bus, dst AS other, key FROM allowed UNION ALL SELECT dst, src, key FROM allowed),
stop AS (SELECT DISTINCT bus FROM src),
root AS (SELECT concat(source_id, '|', key) AS feeder, source_id, s.bus AS source_bus, key AS root_edge, other AS root FROM src s JOIN aside a ON a.bus = s.bus),
walk(feeder, bus) AS (SELECT feeder, root FROM root UNION SELECT w.feeder, a.other FROM walk w JOIN aside a ON a.bus = w.bus JOIN root r ON r.feeder = w.feeder WHERE w.bus NOT IN (SELECT bus FROM stop) AND a.other <> r.source_bus),
fbus AS (SELECT feeder, bus FROM walk UNION SELECT feeder, source_bus FROM root),
fedge AS (SELECT feeder, root_edge AS key FROM root UNION SELECT w.feeder, a.key FROM walk w JOIN aside a ON a.bus = w.bus JOIN root r ON r.feeder = w.feeder WHERE w.bus NOT IN (SELECT bus FROM stop) AND a.other <> r.source_bus),
inner_ AS (SELECT w.feeder, w.bus, r.source_bus, r.root_edge FROM walk w JOIN root r USING (feeder) WHERE w.bus NOT IN (SELECT bus FROM stop)),
fbound AS (SELECT feeder, source_bus AS bus FROM root UNION SELECT feeder, bus FROM walk WHERE bus IN (SELECT bus FROM stop)
  UNION SELECT i.feeder, i.bus FROM inner_ i JOIN side s ON s.bus = i.bus WHERE s.bus <> s.other AND ((s.other = i.source_bus AND s.key <> i.root_edge) OR s.key NOT IN (SELECT key FROM allowed)))"""
    )


_LIVE = ", live AS (SELECT bus FROM lab WHERE component IN (SELECT component FROM lab JOIN src USING (bus)))"
SQL = {
    "graph_edges": _g(_E + " SELECT * FROM edge"),
    "graph_components": _g(_C + " SELECT bus, component FROM lab"),
    "graph_islands": _g(_C + _S + """, nb AS (SELECT component, count(*) AS bus_count FROM lab GROUP BY 1),
ne AS (SELECT component, count(*) AS edge_count, count(DISTINCT CASE WHEN src <> dst THEN least(src, dst) || '|' || greatest(src, dst) END) AS pair_count FROM wire JOIN lab ON bus = src GROUP BY 1),
ns AS (SELECT component, count(*) AS source_count, string_agg(source_id, ',' ORDER BY source_id) AS source_ids FROM src JOIN lab USING (bus) GROUP BY 1)
SELECT 'ISLAND_' || lpad(CAST(row_number() OVER (ORDER BY component) AS VARCHAR), greatest(4, length(CAST(row_number() OVER (ORDER BY component) AS VARCHAR)))::INTEGER, '0') AS island_id, component, bus_count, coalesce(edge_count, 0) AS edge_count, coalesce(source_count, 0) AS source_count, coalesce(source_ids, '') AS source_ids,
  coalesce(source_count, 0) > 0 AS energized, coalesce(edge_count, 0) = bus_count - 1 AS radial, coalesce(pair_count, 0) - bus_count + 1 AS loop_count FROM nb LEFT JOIN ne USING (component) LEFT JOIN ns USING (component)"""),
    "graph_isolated": _g(_W + " SELECT id AS bus FROM bus WHERE id NOT IN (SELECT bus FROM side)"),
    "graph_energized": _g(_C + _S + _LIVE + " SELECT bus FROM live"),
    "graph_deenergized": _g(_C + _S + _LIVE + " SELECT id AS bus FROM bus WHERE id NOT IN (SELECT bus FROM live)"),
    "graph_source_trace_buses": _g(_C + _S + " SELECT source_id, count(*) AS n_buses, min(l.bus) AS first_bus, max(l.bus) AS last_bus FROM src JOIN lab k USING (bus) JOIN lab l ON l.component = k.component GROUP BY 1"),
    "graph_source_trace_edges": _g(_C + _S + " SELECT source_id, count(*) AS n_edges, min(w.key) AS first_edge, max(w.key) AS last_edge FROM src JOIN lab k USING (bus) JOIN lab l ON l.component = k.component JOIN wire w ON w.src = l.bus GROUP BY 1"),
    "graph_feeder_buses": _g(_feeder(False) + " SELECT feeder, bus FROM fbus"),
    "graph_feeder_edges": _g(_feeder(False) + " SELECT feeder, key FROM fedge"),
    "graph_feeder_boundaries": _g(_feeder(False) + " SELECT feeder, bus FROM fbound"),
    "graph_feeder_overlaps": _g(_feeder(False) + " SELECT bus, count(*) AS n_feeders, string_agg(feeder, ',' ORDER BY feeder) AS feeders FROM fbus WHERE bus NOT IN (SELECT bus FROM stop) GROUP BY 1 HAVING count(*) > 1"),
    "graph_feeder_buses_crossing": _g(_feeder(True) + " SELECT feeder, bus FROM fbus"),
    "graph_open_boundaries": _g(_C + _S + _LIVE + " SELECT id AS switch_id, from_bus, to_bus, from_bus IN (SELECT bus FROM live) AS from_energized, to_bus IN (SELECT bus FROM live) AS to_energized FROM switch WHERE in_service AND NOT closed"),
    "graph_parallel_groups": _g(_W + " SELECT least(src, dst) AS bus_a, greatest(src, dst) AS bus_b, count(*) AS n, string_agg(key, ',' ORDER BY key) AS keys FROM wire GROUP BY 1, 2 HAVING count(*) > 1"),
    "graph_degrees": _g(_W + " SELECT bus, count(*) AS degree, count(DISTINCT other) AS neighbours FROM side GROUP BY 1"),
    "graph_branches": _g(_W + _S + """, shape AS (SELECT bus, count(*) AS d, count(DISTINCT other) AS n, max(CASE WHEN object_type <> 'line' THEN 1 ELSE 0 END) AS split FROM side WHERE bus <> other GROUP BY 1),
stops AS (SELECT from_bus AS bus FROM switch WHERE in_service AND NOT closed UNION SELECT to_bus FROM switch WHERE in_service AND NOT closed UNION SELECT bus FROM src),
inner_ AS (SELECT bus FROM shape WHERE d = 2 AND n = 2 AND split = 0 AND bus NOT IN (SELECT bus FROM stops)),
link AS (SELECT a.key AS x, b.key AS y FROM side a JOIN side b ON a.bus = b.bus AND a.key <> b.key WHERE a.bus IN (SELECT bus FROM inner_)),
br(x, y) AS (SELECT key, key FROM wire WHERE src <> dst UNION SELECT r.x, l.y FROM br r JOIN link l ON l.x = r.y), mem AS (SELECT x AS key, min(y) AS branch FROM br GROUP BY 1)
SELECT branch, count(DISTINCT key) AS edge_count, min(CASE WHEN bus NOT IN (SELECT bus FROM inner_) THEN bus END) AS start_bus, max(CASE WHEN bus NOT IN (SELECT bus FROM inner_) THEN bus END) AS end_bus,
  coalesce(min(CASE WHEN bus NOT IN (SELECT bus FROM inner_) THEN bus END) = max(CASE WHEN bus NOT IN (SELECT bus FROM inner_) THEN bus END), TRUE) AS closed FROM mem JOIN side USING (key) GROUP BY 1"""),
    "graph_feeder_membership": _g("any_ AS (SELECT from_bus AS a, to_bus AS b FROM line UNION ALL SELECT to_bus, from_bus FROM line UNION ALL SELECT hv_bus, lv_bus FROM transformer UNION ALL SELECT lv_bus, hv_bus FROM transformer)"
        + _reach("flab", "SELECT a AS bus, b AS other FROM any_") + """, head AS (SELECT component, arg_min(coalesce(feeder_id, id), id) AS feeder FROM flab JOIN bus ON id = flab.bus WHERE id IN (SELECT bus_id FROM source UNION SELECT feeder_id FROM bus WHERE feeder_id IS NOT NULL) GROUP BY 1)
SELECT f.bus, coalesce(h.feeder, feeder_id, '__ORPHAN__') AS feeder FROM flab f LEFT JOIN head h USING (component) JOIN bus b ON b.id = f.bus"""),
    "graph_label_propagation": _g(_W + """, w2 AS (SELECT bus, other FROM side WHERE object_type <> 'switch'),
near(bus, label, d) AS (SELECT id, feeder_id, 0 FROM bus WHERE feeder_id IS NOT NULL UNION SELECT w2.other, n.label, n.d + 1 FROM near n JOIN w2 ON w2.bus = n.bus WHERE n.d < 40),
best AS (SELECT bus, min(d) AS d FROM near GROUP BY 1) SELECT bus, min(label) AS label FROM near JOIN best USING (bus, d) GROUP BY 1"""),
}
