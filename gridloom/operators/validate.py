"""Validation rules: each gives rows (code, severity, category, object_type, object_id, detail); a report is their union."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import topology as T
from gridloom.operators.loops import closing_edges, numbered_names

ISSUE = ("code", "severity", "category", "object_type", "object_id", "detail")
#: Order of severities in reports.
SEVERITIES = ("ERROR", "WARNING", "INFO")


@dataclass(frozen=True)
class Profile:
    """Which rules run, and how strictly."""

    name: str
    references: bool = True
    voltages: bool = True
    library: bool = False
    topology: bool = True
    coordinates: bool = False
    zero_sequence: bool = False
    readiness: bool = False
    radial: bool = False
    voltage_tolerance_kv: float = 1e-6
    relative_tolerance: float = 1e-6


PROFILES = {
    p.name: p
    for p in (
        Profile("standard"),
        Profile("import", topology=False),
        Profile("power_flow", library=True, readiness=True),
        Profile("short_circuit", library=True, readiness=True, zero_sequence=True),
        Profile("geographic", coordinates=True),
        Profile("radial_distribution", readiness=True, radial=True),
    )
}


def issue(df: DataFrame, code: str, severity: str, category: str, kind: str | Column, ident: str | Column, detail: str | Column = "") -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), col(kind).alias("object_type"), (F.col(ident) if isinstance(ident, str) else ident).alias("object_id"), col(detail).cast("string").alias("detail"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def dangling(df: DataFrame, role: str, target: DataFrame) -> DataFrame:
    """Rows whose ``role`` names nothing in ``target`` (id)."""
    return df.where(F.col(role).isNotNull()).join(target.select(F.col("id").alias(role)), role, "left_anti")


#: Rule, element and the column that must name a bus.
BUS_ROLES = (
    ("NET001", "line", "from_bus"), ("NET001", "line", "to_bus"), ("NET002", "transformer", "hv_bus"), ("NET002", "transformer", "lv_bus"), ("NET003", "switch", "from_bus"), ("NET003", "switch", "to_bus"),
    ("NET004", "load", "bus_id"), ("NET005", "source", "bus_id"), ("NET007", "generator", "bus_id"),
)


def references(g) -> DataFrame:
    """References to buses and substations that aren't there: all roles of all elements in one anti join."""
    bus, rows = g.bus, []
    for kind in dict.fromkeys(k for _, k, _ in BUS_ROLES):
        roles = F.array(*(F.struct(F.lit(code).alias("code"), F.lit(role).alias("role"), F.col(role).alias("bus")) for code, k, role in BUS_ROLES if k == kind))
        rows.append(getattr(g, kind).select(F.lit(kind).alias("kind"), "id", F.explode(roles).alias("r")).select("kind", "id", "r.*"))
    lost = dangling(union(rows), "bus", bus)
    parts = [lost.select("code", F.lit("ERROR").alias("severity"), F.lit("reference").alias("category"), F.col("kind").alias("object_type"), F.col("id").alias("object_id"), F.col("role").alias("detail"))]
    parts.append(issue(dangling(bus, "substation_id", g.substation), "NET008", "ERROR", "reference", "bus", "id", "substation_id"))
    empty = bus.agg(F.count("*").alias("n")).where("n = 0").withColumn("id", F.lit(None).cast("string"))
    parts.append(issue(empty, "NET006", "ERROR", "reference", "network", "id"))
    return union(parts)


NUMBERS = {"bus": ("nominal_voltage_kv", "x", "y"), "line": ("length_km", "nominal_voltage_kv"), "transformer": ("hv_voltage_kv", "lv_voltage_kv", "rated_power_mva"), "load": ("active_power_mw", "reactive_power_mvar"), "generator": ("active_power_mw", "reactive_power_mvar"), "source": ("nominal_voltage_kv",)}


def data_quality(tables: dict[str, DataFrame], coordinates: bool = False) -> DataFrame:
    """Values that are no finite numbers; coordinates that are one-sided or, if asked for, absent."""
    parts = []
    for kind, fields in NUMBERS.items():
        if kind in tables:
            long = tables[kind].select("id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields))).alias("v"))
            parts.append(issue(long.where(F.isnan("v.value") | (F.abs("v.value") == float("inf"))), "DAT001", "ERROR", "data", kind, "id", F.col("v.field")))
    bus = tables["bus"]
    parts.append(issue(bus.where(F.col("x").isNull() != F.col("y").isNull()), "DAT002", "ERROR", "data", "bus", "id", F.when(F.col("x").isNull(), "x").otherwise("y")))
    if coordinates:
        parts.append(issue(bus.where("x IS NULL AND y IS NULL"), "DAT003", "ERROR", "data", "bus", "id"))
    return union(parts)


def voltages(g, tolerance: float = 1e-6) -> DataFrame:
    """Elements whose voltage isn't that of their bus; switches between voltages."""
    kv = g.bus.select(F.col("id").alias("_bus"), F.col("nominal_voltage_kv").alias("_kv"))

    def against(df: DataFrame, role: str, field: str) -> DataFrame:
        return df.join(kv, F.col(role) == F.col("_bus")).where(F.abs(F.col(field) - F.col("_kv")) > tolerance)

    other = kv.select(F.col("_bus").alias("_bus2"), F.col("_kv").alias("_kv2"))
    ends = g.switch.join(kv, F.col("from_bus") == F.col("_bus")).join(other, F.col("to_bus") == F.col("_bus2")).where(F.abs(F.col("_kv") - F.col("_kv2")) > tolerance)
    return union([
        issue(against(g.line, "from_bus", "nominal_voltage_kv"), "ELE001", "ERROR", "electrical", "line", "id", "from_bus"),
        issue(against(g.line, "to_bus", "nominal_voltage_kv"), "ELE001", "ERROR", "electrical", "line", "id", "to_bus"),
        issue(against(g.source, "bus_id", "nominal_voltage_kv"), "ELE002", "ERROR", "electrical", "source", "id", "bus_id"),
        issue(against(g.transformer, "hv_bus", "hv_voltage_kv"), "ELE003", "ERROR", "electrical", "transformer", "id", "hv_bus"),
        issue(against(g.transformer, "lv_bus", "lv_voltage_kv"), "ELE004", "ERROR", "electrical", "transformer", "id", "lv_bus"),
        issue(ends, "ELE005", "ERROR", "electrical", "switch", "id"),
    ])


def library(g, profile: Profile, unknown: str = "WARNING") -> DataFrame:
    """Instances in service against their types, which are few and broadcast by the planner where it sees fit; without a library, whether the profile wants one."""
    if g.line_type is None and g.transformer_type is None:
        wanted = g.line.sparkSession.range(1 if profile.library else 0).select(F.lit(None).cast("string").alias("id"))
        return issue(wanted, "LIB001", "ERROR", "library", "library", "id")
    lt = g.line_type.select(F.col("id").alias("type_id"), F.col("nominal_voltage_kv").alias("t_kv"), F.col("r0_ohm_per_km").alias("t_r0"), F.lit(True).alias("known"))
    line = g.line.where("in_service AND type_id <> ''").join(lt, "type_id", "left")
    tt = g.transformer_type.select(F.col("id").alias("type_id"), F.col("hv_voltage_kv").alias("t_hv"), F.col("lv_voltage_kv").alias("t_lv"), F.col("rated_power_mva").alias("t_mva"), F.col("uk0_percent").alias("t_uk0"), F.lit(True).alias("known"))
    trafo = g.transformer.where("in_service AND type_id <> ''").join(tt, "type_id", "left")
    kv, rel = profile.voltage_tolerance_kv, profile.relative_tolerance
    apart = lambda a, b, absolute, relative: F.abs(F.col(a) - F.col(b)) > F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))
    zero = F.lit(profile.zero_sequence)
    of_line = {"LIB101": F.col("known").isNull(), "LIB102": apart("nominal_voltage_kv", "t_kv", kv, 0.0), "LIB103": zero & F.col("known") & F.col("t_r0").isNull()}
    of_trafo = {"LIB201": F.col("known").isNull(), "LIB202": apart("hv_voltage_kv", "t_hv", kv, 0.0), "LIB203": apart("lv_voltage_kv", "t_lv", kv, 0.0), "LIB204": apart("rated_power_mva", "t_mva", 0.0, rel), "LIB205": zero & F.col("known") & F.col("t_uk0").isNull()}

    def broken(df: DataFrame, kind: str, rules: dict[str, Column]) -> DataFrame:
        """All rules over one join: each row gives an issue for each rule that it breaks."""
        codes = F.explode(F.filter(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules.items())), lambda x: x.isNotNull())).alias("_code")
        rows = df.select("id", "type_id", codes)
        severity = F.when(F.col("_code").isin("LIB101", "LIB201"), unknown).otherwise("ERROR")
        return rows.select(F.col("_code").alias("code"), severity.alias("severity"), F.lit("library").alias("category"), F.lit(kind).alias("object_type"), F.col("id").alias("object_id"), F.col("type_id").alias("detail"))

    return broken(line, "line", of_line).unionAll(broken(trafo, "transformer", of_trafo))


def topology(g, labels: DataFrame, edge: DataFrame, sources: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    live = T.energized(labels, sources)
    islands = T.island_sums(labels, edge, sources)
    crossing = T.open_boundaries(g.switch, live).where("from_energized <> to_energized")
    dead = labels.select("bus").join(live, "bus", "left_anti").crossJoin(F.broadcast(g.source.agg(F.count("*").alias("n")).where("n > 0")))  # one row
    closed = numbered_names(closing_edges(edge).join(labels, "bus").select("component", "loop")).withColumn("loop_id", F.concat("component", F.lit("#"), F.col("number").cast("string")))
    parts = [
        issue(T.isolated(g.bus, edge), "TOP001", "WARNING", "topology", "bus", "bus"),
        issue(dead, "TOP002", "WARNING", "topology", "bus", "bus"),
        issue(closed, "TOP003", "WARNING", "topology", "loop", "loop_id"),
        issue(T.parallel_groups(edge), "TOP004", "INFO", "topology", "bus", "bus_a", F.col("keys")),
        issue(islands.where("source_count > 1"), "TOP006", "INFO", "topology", "island", "component", F.col("source_ids")),
        issue(crossing, "TOP007", "INFO", "topology", "switch", "switch_id"),
    ]
    if overlaps is not None:
        parts.append(issue(overlaps, "TOP005", "WARNING", "topology", "bus", "bus", F.col("n_feeders")))
    return union(parts)


def readiness(g, labels: DataFrame, edge: DataFrame, sources: DataFrame, overlaps: DataFrame | None = None, radial: bool = False) -> DataFrame:
    one = lambda df, test: df.where(test).withColumn("_id", F.lit("network"))
    islands = T.island_sums(labels, edge, sources)
    facts = islands.agg(F.count(F.when(~F.col("energized"), 1)).alias("dead"), F.count(F.when(F.col("energized"), 1)).alias("live"), F.count(F.when(F.col("energized") & ~F.col("radial"), 1)).alias("meshed"))
    parts = [
        issue(one(g.source.agg(F.count(F.when(F.col("in_service"), 1)).alias("n")), "n = 0"), "RDY001", "ERROR", "readiness", "network", "_id"),
        issue(g.line.where("in_service AND type_id IS NULL"), "RDY002", "ERROR", "readiness", "line", "id"),
        issue(g.transformer.where("in_service AND type_id IS NULL"), "RDY003", "ERROR", "readiness", "transformer", "id"),
        issue(one(facts, "dead > 0"), "RDY004", "ERROR", "readiness", "network", "_id", F.col("dead")),
    ]
    if radial:
        parts.append(issue(one(facts, "meshed > 0 OR live = 0"), "RDY005", "ERROR", "readiness", "network", "_id", F.col("meshed")))
        if overlaps is not None:
            parts.append(issue(one(overlaps.agg(F.count("*").alias("n")), "n > 0"), "RDY006", "ERROR", "readiness", "network", "_id", F.col("n")))
    return union(parts)


def severity_rank() -> Column:
    rank = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        rank = F.when(F.col("severity") == s, i).otherwise(rank)
    return rank


def in_order(issues: DataFrame, most: int | None = None) -> DataFrame:
    """Issues as a report lists them; ``most``: only the first so many."""
    ordered = issues.orderBy(severity_rank(), "category", "code", "object_type", "object_id", "detail")
    return ordered if most is None else ordered.limit(most)


def counts(issues: DataFrame) -> DataFrame:
    """Numbers by severity, category and code in one pass over the issues."""
    cube = issues.groupingSets([["severity"], ["category"], ["code"]], "severity", "category", "code").agg(F.count("*").alias("n"), F.grouping("severity").alias("gs"), F.grouping("category").alias("gc"))
    return cube.select(F.when(F.col("gs") == 0, "severity").when(F.col("gc") == 0, "category").otherwise("code").alias("by"), F.coalesce("severity", "category", "code").alias("value"), "n")


def duplicate_keys(df: DataFrame, keys: list[str], code: str, kind: str) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return issue(twice, code, "ERROR", "objects", kind, F.concat_ws("/", *keys), F.col("n"))


def filled_columns(df: DataFrame, table: str) -> DataFrame:
    """(table, column, rows, non_null) of every column, from one aggregation of all rows: counts alone, which need no shuffle of values."""
    flat = df.agg(F.count("*").alias("rows"), *(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)))
    items = F.array(*(F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"n{i}").alias("non_null")) for i, c in enumerate(df.columns)))
    return flat.select(F.explode(items).alias("x")).select(F.lit(table).alias("table"), "x.*")


def profile_columns(df: DataFrame, table: str, approximate: bool = False) -> DataFrame:
    """(table, column, type, rows, non_null, distinct) of every column, from one aggregation."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    flat = df.agg(F.count("*").alias("rows"), *(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)), *(distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(df.columns)))
    items = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("rows"), F.col(f"n{i}").alias("non_null"), F.col(f"d{i}").alias("distinct")) for i, (c, t) in enumerate(df.dtypes)))
    return flat.select(F.explode(items).alias("x")).select(F.lit(table).alias("table"), "x.*", (F.col("x.non_null") < F.col("x.rows")).alias("nullable"))
