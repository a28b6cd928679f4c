"""The object model of a network as one long table, its checks, and class tables driven by a schema.

An object is a row (class, key, name, parent, source_kind, source_id, attributes, references); the last two are maps
from names to texts. Building is unions and equi-joins; nothing is looked up object by object.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.normalize import object_key, output_value, safe_name
from gridloom.operators.components import settle, store
from gridloom.operators.connect import unheld
from gridloom.operators.objects import folder_of, network_folders
from gridloom.operators.validate import issue

# Names of the classes.
CLASSES = {
    "network": "ElmNet", "substation": "ElmSubstat", "terminal": "ElmTerm", "cubicle": "StaCubic", "cubicle_switch": "StaSwitch", "line_type": "TypLne", "transformer_type": "TypTr2",
    "line": "ElmLne", "transformer": "ElmTr2", "switch": "ElmCoup", "load": "ElmLod", "generator": "ElmGenstat", "source": "ElmXnet",
}
#: Kind in keys, columns that name buses with the sides of their cubicles, and attributes, of each element.
ELEMENTS = {
    "line": ("line", (("from_bus", "1", "terminal_1_cubicle"), ("to_bus", "2", "terminal_2_cubicle")), ("length_km", "nominal_voltage_kv", "in_service")),
    "transformer": ("trafo", (("hv_bus", "hv", "hv_cubicle"), ("lv_bus", "lv", "lv_cubicle")), ("hv_voltage_kv", "lv_voltage_kv", "rated_power_mva", "in_service")),
    "switch": ("switch", (("from_bus", "1", "terminal_1_cubicle"), ("to_bus", "2", "terminal_2_cubicle")), ("closed", "in_service")),
    "load": ("load", (("bus_id", "1", "cubicle"),), ("active_power_mw", "reactive_power_mvar", "in_service")),
    "generator": ("gen", (("bus_id", "1", "cubicle"),), ("active_power_mw", "reactive_power_mvar", "in_service", "technology")),
    "source": ("source", (("bus_id", "1", "cubicle"),), ("nominal_voltage_kv", "in_service")),
}
LINE_TYPE = ("nominal_voltage_kv", "r1_ohm_per_km", "x1_ohm_per_km", "c1_nf_per_km", "rated_current_a", "r0_ohm_per_km", "x0_ohm_per_km")
TRANSFORMER_TYPE = ("rated_power_mva", "hv_voltage_kv", "lv_voltage_kv", "uk_percent", "copper_loss_kw", "uk0_percent")
#: Values of a line type made up for a voltage that the library doesn't have, and how near a type's voltage must be.
MADE_UP = {"r1_ohm_per_km": 0.40, "x1_ohm_per_km": 0.30, "rated_current_a": 250.0, "c1_nf_per_km": 10.0, "r0_ohm_per_km": 1.20, "x0_ohm_per_km": 0.90}
NEAR_KV = 0.5
COLUMNS = ("class", "key", "name", "parent", "source_kind", "source_id", "attributes", "references")


def _map(entries: Mapping[str, Column]) -> Column:
    """A map of the entries that aren't null, as texts."""
    if not entries:
        return F.expr("CAST(map() AS MAP<STRING, STRING>)")
    return F.map_filter(F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), v.cast("string")))), lambda _, v: v.isNotNull())


def _objects(df: DataFrame, kind: str, key: Column, name: Column, parent: Column | None, attributes: Mapping[str, Column], references: Mapping[str, Column], ident: Column, source_kind: str | None = None) -> DataFrame:
    above = F.lit(None).cast("string") if parent is None else parent
    return df.select(F.lit(CLASSES[kind]).alias("class"), key.alias("key"), safe_name(name).alias("name"), above.alias("parent"), F.lit(source_kind or kind).alias("source_kind"), ident.cast("string").alias("source_id"), _map(attributes).alias("attributes"), _map(references).alias("references"))


def line_types(line: DataFrame, types: DataFrame) -> DataFrame:
    """(id, type_id, made, kv): each line's own type if the library has it, else the one of the nearest voltage within NEAR_KV, else one made up for its voltage."""
    return typed_lines(line, types).select("id", "type_id", "made", F.col("nominal_voltage_kv").alias("kv"))


def typed_lines(line: DataFrame, types: DataFrame) -> DataFrame:
    """``line`` with ``made`` and the type_id that ``line_types`` tells of.

    Nearest types are found by cells of voltage, by an equi-join, for each voltage once; of the library only types that
    lines ask for are joined with them. Both are written, so that the planner knows how small they are.
    """
    cell = lambda c: F.floor(F.col(c) / NEAR_KV)
    volts = line.select(F.col("nominal_voltage_kv").alias("kv")).distinct().withColumn("cell", F.explode(F.array(*(cell("kv") + i for i in (-1, 0, 1)))))
    held = types.groupBy(F.col("nominal_voltage_kv").alias("type_kv")).agg(F.min("id").alias("near")).withColumn("cell", cell("type_kv"))
    off = F.abs(F.col("kv") - F.col("type_kv"))
    best = volts.join(held, "cell").where(off <= NEAR_KV).groupBy("kv").agg(F.min(F.struct(off.alias("off"), "near")).alias("b")).select("kv", "b.near")
    best = store(best)
    known = store(types.select(F.col("id").alias("type_id")).join(line.select("type_id").distinct(), "type_id", "left_semi").withColumn("known", F.lit(True)))
    rows = line.withColumn("kv", F.col("nominal_voltage_kv")).join(known, "type_id", "left").join(best, "kv", "left")
    text = F.regexp_replace(F.format_string("%.3f", "kv"), r"\.?0+$", "")
    made = F.concat(F.lit("FALLBACK_"), F.replace(text, F.lit("."), F.lit("p")), F.lit("kV"))
    chosen = F.when(F.col("known"), F.col("type_id")).otherwise(F.coalesce("near", made))
    return rows.select(*(chosen.alias(c) if c == "type_id" else c for c in line.columns), (F.col("known").isNull() & F.col("near").isNull()).alias("made"))


def types(lines: DataFrame, line_type: DataFrame, transformer_type: DataFrame) -> DataFrame:
    """Type objects: the library's, and those made up for lines (as ``line_types`` gives them)."""
    key = lambda kind, c: object_key(kind, F.col(c))
    made = lines.where("made").groupBy("type_id").agg(F.min("kv").alias("kv"))
    values = {"nominal_voltage_kv": F.col("kv"), **{a: F.lit(MADE_UP[a]) for a in LINE_TYPE if a in MADE_UP}}
    return (
        _objects(line_type, "line_type", key("ltype", "id"), F.col("name"), None, {a: F.col(a) for a in LINE_TYPE}, {}, F.col("id"))
        .unionAll(_objects(made, "line_type", key("ltype", "type_id"), F.concat(F.lit("Fallback "), F.regexp_replace(F.format_string("%.3f", "kv"), r"\.?0+$", ""), F.lit(" kV")), None, values, {}, F.col("type_id")))
        .unionAll(_objects(transformer_type, "transformer_type", key("ttype", "id"), F.col("name"), None, {a: F.col(a) for a in TRANSFORMER_TYPE}, {}, F.col("id")))
    )


def element(df: DataFrame, kind: str, bus: DataFrame, type_key: Column | None = None) -> DataFrame:
    """Objects of an element kind: below the network of their first bus, with references to their cubicles and, if given, their type."""
    short, sides, attributes = ELEMENTS[kind]
    key = object_key(short, F.col("id"))
    first = sides[0][0]
    of = bus.where("system_id IS NOT NULL").select(F.col("id").alias(first), F.col("system_id").alias("_system"))  # the others' folder is the same as that of no bus
    placed = df.join(of, first, "left")
    refs = {ref: object_key("cub", F.concat(key, F.lit(f":{side}"))) for _, side, ref in sides} | ({} if type_key is None else {"type": type_key})
    return _objects(placed, kind, key, F.col("name"), folder_of(F.col("_system")), {a: F.col(a) for a in attributes if a in df.columns}, refs, F.col("id"))


def cubicles(df: DataFrame, kind: str, switches: bool = False) -> DataFrame:
    """A cubicle for each end of each element, below the end's terminal, and in it, if asked for, a switch."""
    short, sides, _ = ELEMENTS[kind]
    ends = F.explode(F.array(*(F.struct(F.lit(i).alias("index"), F.lit(side).alias("side"), F.col(role).alias("bus")) for i, (role, side, _) in enumerate(sides)))).alias("e")
    rows = df.select("id", object_key(short, F.col("id")).alias("element"), ends).select("id", "element", "e.*").withColumn("key", object_key("cub", F.concat("element", F.lit(":"), "side")))
    out = _objects(rows, "cubicle", F.col("key"), F.concat(F.lit(f"{kind} "), "id", F.lit(" cubicle")), object_key("bus", F.col("bus")), {"connection_index": F.col("index")}, {"connected_element": F.col("element")}, F.col("id"), f"{kind}_cubicle")
    if switches:
        out = out.unionAll(_objects(rows, "cubicle_switch", object_key("cubsw", F.col("key")), F.concat(F.lit(f"{kind} "), "id", F.lit(" connection switch")), F.col("key"), {"closed": F.lit(True)}, {}, F.col("id"), f"{kind}_cubicle_switch"))
    return out


def build(g, switches: bool = False, out_of_service: bool = True) -> DataFrame:
    """All objects of a network. ``g`` has the tables of the inventory as attributes."""
    bus = g.bus
    keep = lambda df: df if out_of_service else df.where("in_service")
    folders = network_folders(bus)
    out = _objects(folders, "network", F.col("key"), F.col("name"), None, {}, {}, F.col("name"))
    default = folder_of(F.lit(None).cast("string"))
    out = out.unionAll(_objects(g.substation, "substation", object_key("sub", F.col("id")), F.col("name"), default, {}, {}, F.col("id")))
    known = g.substation.select(F.col("id").alias("substation_id"), F.lit(True).alias("_known"))
    parent = F.when(F.col("_known"), object_key("sub", F.col("substation_id"))).otherwise(folder_of(F.col("system_id")))
    attributes = {"nominal_voltage_kv": F.col("nominal_voltage_kv"), "x": F.col("x"), "y": F.col("y"), "feeder_id": F.col("feeder_id"), "system_id": F.col("system_id")}
    out = out.unionAll(_objects(bus.join(known, "substation_id", "left"), "terminal", object_key("bus", F.col("id")), F.col("name"), parent, attributes, {}, F.col("id")))
    line = store(keep(g.line))  # read for voltages, types, elements and cubicles
    typed = typed_lines(line, g.line_type)
    out = out.unionAll(types(typed.withColumnRenamed("nominal_voltage_kv", "kv"), g.line_type, g.transformer_type))
    trafo = keep(g.transformer).join(g.transformer_type.select(F.col("id").alias("type_id"), F.lit(True).alias("_known")), "type_id", "left")
    out = out.unionAll(element(typed, "line", bus, object_key("ltype", F.col("type_id")))).unionAll(element(trafo, "transformer", bus, F.when(F.col("_known"), object_key("ttype", F.col("type_id")))))
    for kind in ELEMENTS:
        df = line if kind == "line" else keep(getattr(g, kind))
        if kind not in ("line", "transformer"):
            out = out.unionAll(element(df, kind, bus))
        out = out.unionAll(cubicles(df, kind, switches))
    return out


def union_of(parts: list[DataFrame]) -> DataFrame:
    """Objects of all parts as one model; a key that stands twice is an error."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    twice = out.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key").limit(1).collect()
    if twice:
        raise ValueError(f"two objects have the key {twice[0][0]}")
    return out


def check(model: DataFrame) -> DataFrame:
    """PFM001: a parent that isn't there; PFM002: a reference that leads nowhere; PFM003: an object whose name another in its folder had before.

    Keys asked for and held are summed up together; names are counted by their hashes first, and only those of a hash that
    stands twice are compared.
    """
    links = model.select("key", F.explode(F.map_concat(F.map_from_arrays(F.array(F.lit("")), F.array("parent")), "references")).alias("role", "target")).where("target IS NOT NULL")
    missing = store(unheld(links.select(F.col("target").alias("id")), model.select(F.col("key").alias("id")), F.count("*")).select(F.col("id").alias("target")))
    lost = links.join(missing, "target")
    parent = F.col("role") == ""
    broken = lost.select(F.when(parent, "PFM001").otherwise("PFM002").alias("code"), F.lit("ERROR").alias("severity"), F.lit("objects").alias("category"), F.lit("object").alias("object_type"), F.col("key").alias("object_id"), F.when(parent, F.col("target")).otherwise(F.concat("role", F.lit("="), "target")).alias("detail"))
    named = model.select("class", "parent", "name", "key", F.xxhash64("class", "parent", "name").alias("_code"))
    often = store(named.groupBy("_code").agg(F.count("*").alias("_n")).where("_n > 1").select("_code"))
    alike = store(named.join(often, "_code", "left_semi").drop("_code"))
    first = alike.groupBy("class", "parent", "name").agg(F.min("key").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("class").alias("_c"), F.col("parent").alias("_p"), F.col("name").alias("_m"), "_first")
    again = alike.join(first, (F.col("class") == F.col("_c")) & F.col("parent").eqNullSafe(F.col("_p")) & (F.col("name") == F.col("_m"))).where("key <> _first")
    return broken.unionAll(issue(again, "PFM003", "ERROR", "objects", "object", "key", F.col("name")))


@dataclass(frozen=True)
class Value:
    """How an attribute is written: its column, its type, and scale, offset, texts for values or a pattern."""

    column: str
    kind: str = "string"
    scale: float = 1.0
    offset: float = 0.0
    value_map: Mapping[str, str] = field(default_factory=dict)
    pattern: str | None = None


@dataclass(frozen=True)
class ClassTable:
    """A class's table: columns of identity, attributes and references by their names in the model, fixed values, and columns that must be there."""

    cls: str
    table: str
    key: str
    name: str
    parent: str | None = None
    attributes: Mapping[str, Value] = field(default_factory=dict)
    references: Mapping[str, str] = field(default_factory=dict)
    static: Mapping[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()

    def columns(self) -> list[str]:
        """All columns in order, none twice."""
        named = [self.key, self.name, self.parent, *(v.column for v in self.attributes.values()), *self.references.values(), *self.static, *self.required]
        return list(dict.fromkeys(c for c in named if c))


def class_rows(model: DataFrame, spec: ClassTable) -> DataFrame:
    """The objects of a class as its table."""
    cells: dict[str, Column] = {c: F.lit(v) for c, v in spec.static.items()} | {spec.key: F.col("key"), spec.name: F.col("name")}
    if spec.parent:
        cells[spec.parent] = F.col("parent")
    for name, v in spec.attributes.items():
        raw = F.col("attributes")[name]
        kind = "string" if v.value_map else v.kind
        cells[v.column] = output_value(raw if kind == "string" else raw.cast(kind), kind, dict(v.value_map) or None, v.pattern, v.scale, v.offset)
    for name, column in spec.references.items():
        cells[column] = F.col("references")[name]
    return model.where(F.col("class") == spec.cls).select(*(cells.get(c, F.lit(None).cast("string")).alias(c) for c in spec.columns()))


def uses(model: DataFrame) -> DataFrame:
    """(class, kind, name, n): classes, attributes and references of the model, and of how many objects. Objects are counted by all their names at once, so that a row isn't laid out for each name."""
    names = lambda column, kind: F.transform(column, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("name")))
    alike = model.groupBy("class", F.map_keys("attributes").alias("_a"), F.map_keys("references").alias("_r")).agg(F.count("*").alias("n"))
    used = F.concat(F.array(F.struct(F.lit("class").alias("kind"), F.lit("").alias("name"))), names("_a", "attribute"), names("_r", "reference"))
    return alike.select("class", F.explode(used).alias("u"), "n").groupBy("class", "u.kind", "u.name").agg(F.sum("n").alias("n"))


def _open(used: DataFrame, specs: list[ClassTable]) -> DataFrame:
    taken = [(s.cls, kind, n) for s in specs for kind, names in (("class", [""]), ("attribute", s.attributes), ("reference", s.references)) for n in names]
    rows = used.sparkSession.createDataFrame(taken or [("", "", "")], "class string, kind string, name string")
    open_ = settle(used.join(F.broadcast(rows), ["class", "kind", "name"], "left_anti"))  # the schema is part of the program; the model is read once
    missing = open_.where("kind = 'class'").select("class")
    return open_.where("kind = 'class'").unionAll(open_.where("kind <> 'class'").join(missing, "class", "left_anti"))


def unmapped(model: DataFrame, specs: list[ClassTable]) -> DataFrame:
    """(class, kind, name, n): classes, attributes and references of the model that no table takes, and of how many objects."""
    return _open(uses(model), specs)


def _strict(open_: DataFrame) -> None:
    first = open_.orderBy("class", "kind", "name").limit(1).collect()
    if first:
        raise ValueError(f"no table takes {first[0]['kind']} {first[0]['name']} of class {first[0]['class']}".replace("  ", " "))


def sizes(model: DataFrame, specs: list[ClassTable]) -> DataFrame:
    """(table, n): the rows of all tables that ``tables`` gives in strict mode, counted in one pass over the model."""
    used = settle(uses(model))
    _strict(_open(used, specs))
    of = used.sparkSession.createDataFrame([(s.cls, s.table) for s in specs], "class string, `table` string")
    held = used.where("kind = 'class'").select("class", "n")
    return F.broadcast(of).join(held, "class", "left").groupBy("table").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


def tables(model: DataFrame, specs: list[ClassTable], strict: bool = True) -> dict[str, DataFrame]:
    """The tables of all classes; in strict mode something that no table takes is an error. Classes may share a table."""
    if strict:
        _strict(unmapped(model, specs))
    out: dict[str, DataFrame] = {}
    for s in specs:
        rows = class_rows(model, s)
        out[s.table] = out[s.table].unionByName(rows, allowMissingColumns=True) if s.table in out else rows
    return out


def check_tables(found: Mapping[str, DataFrame], specs: list[ClassTable]) -> DataFrame:
    """DGS001: a table that isn't there; DGS002: a key that stands twice in all tables; DGS003: columns that the schema doesn't know; DGS004: a reference that leads nowhere."""
    spark = next(iter(found.values())).sparkSession
    of: dict[str, list[ClassTable]] = {}
    for s in specs:
        of.setdefault(s.table, []).append(s)
    plan = [("DGS001", t, "") for t in of if t not in found]
    plan += [("DGS003", t, c) for t, df in found.items() if t in of for c in df.columns if c not in {c for s in of[t] for c in s.columns()}]
    fixed = spark.createDataFrame(plan, "code string, id string, detail string")
    out = fixed.select("code", F.lit("ERROR").alias("severity"), F.lit("objects").alias("category"), F.lit("table").alias("object_type"), F.col("id").alias("object_id"), "detail")
    held = [(t, s, found[t]) for t, ss in of.items() if t in found for s in ss[:1]]
    if not held:
        return out
    # a table is read once for its keys and what its rows ask for, and once for the rows that ask for what isn't there
    items, links = None, None
    for t, s, df in held:
        columns = list(dict.fromkeys(c for x in of[t] for c in x.references.values() if c in df.columns))
        own = F.struct(F.col(f"`{s.key}`").alias("id"), F.lit(1).alias("held"))
        part = df.select(F.explode(F.array(own, *(F.struct(F.col(f"`{c}`").alias("id"), F.lit(0).alias("held")) for c in columns))).alias("i")).select("i.*").where("held = 1 OR trim(id) <> ''")
        items = part if items is None else items.unionAll(part)
        if columns:
            part = df.select(F.lit(t).alias("table"), F.col(f"`{s.key}`").alias("id"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("key")) for c in columns))).alias("r")).select("table", "id", "r.column", "r.key").where("trim(key) <> ''")
            links = part if links is None else links.unionAll(part)
    odd = store(items.repartition("id").groupBy("id").agg(F.sum("held").alias("n")).where("n <> 1"))
    out = out.unionAll(issue(odd.where("n > 1"), "DGS002", "ERROR", "objects", "object", "id", F.col("n")))
    if links is not None:
        lost = links.join(odd.where("n = 0").select(F.col("id").alias("key")), "key")
        out = out.unionAll(issue(lost, "DGS004", "ERROR", "objects", "object", "id", F.concat("column", F.lit("="), "key")))
    return out


def general(spark, version: str) -> DataFrame:
    """The table that names the format's version."""
    return spark.range(1).select(F.lit("1").alias("FID(a:40)"), F.lit("Version").alias("Descr(a:40)"), F.lit(version).alias("Val(a:40)"))


def headers(rows: DataFrame, table: str, place: str, cells: str, among: int = 15) -> DataFrame:
    """(table, place, header): the cells of each table's header row, the first of ``among`` rows with two filled cells or more.

    ``rows``: table, place (from 1) and an array of texts.
    """
    filled = F.size(F.filter(cells, lambda c: F.trim(c) != ""))
    first = rows.where((F.col(place) <= among) & (filled >= 2)).groupBy(table).agg(F.min(F.struct(place, cells)).alias("h"))
    return first.select(table, F.col(f"h.{place}").alias("row"), F.posexplode(f"h.{cells}").alias("place", "header")).where("trim(header) <> ''")
