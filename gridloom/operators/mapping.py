"""Declarative mapping of raw layers to entities: accepted rows and rejected ones with the reason."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gridloom.functions import geometry, normalize

#: Entity: field -> (kind, required). Kinds: id, name, number, kv, length, p, q, s, closed, served.
ENTITIES: dict[str, dict[str, tuple[str, bool]]] = {
    "bus": {"id": ("id", True), "name": ("name", False), "nominal_voltage_kv": ("kv", True), "x": ("number", False), "y": ("number", False), "feeder_id": ("id", False), "substation_id": ("id", False)},
    "substation": {"id": ("id", True), "name": ("name", False), "x": ("number", False), "y": ("number", False)},
    "line": {"id": ("id", True), "name": ("name", False), "from_bus": ("id", True), "to_bus": ("id", True), "length_km": ("length", True), "nominal_voltage_kv": ("kv", True), "type_id": ("id", False), "in_service": ("served", True)},
    "transformer": {"id": ("id", True), "name": ("name", False), "hv_bus": ("id", True), "lv_bus": ("id", True), "hv_voltage_kv": ("kv", True), "lv_voltage_kv": ("kv", True), "rated_power_mva": ("s", True), "type_id": ("id", False), "in_service": ("served", True)},
    "switch": {"id": ("id", True), "name": ("name", False), "from_bus": ("id", True), "to_bus": ("id", True), "closed": ("closed", True), "in_service": ("served", True)},
    "load": {"id": ("id", True), "name": ("name", False), "bus_id": ("id", True), "active_power_mw": ("p", True), "reactive_power_mvar": ("q", True), "in_service": ("served", True)},
    "generator": {"id": ("id", True), "name": ("name", False), "bus_id": ("id", True), "active_power_mw": ("p", True), "reactive_power_mvar": ("q", True), "technology": ("name", False), "in_service": ("served", True)},
    "source": {"id": ("id", True), "name": ("name", False), "bus_id": ("id", True), "nominal_voltage_kv": ("kv", True), "in_service": ("served", True)},
}
#: Rules that every row of an entity keeps, by the reason given when it doesn't.
INVARIANTS: dict[str, dict[str, str]] = {
    "bus": {"voltage": "nominal_voltage_kv > 0"},
    "line": {"self_loop": "from_bus <> to_bus", "length": "length_km > 0", "voltage": "nominal_voltage_kv > 0"},
    "transformer": {"self_loop": "hv_bus <> lv_bus", "voltage": "hv_voltage_kv > lv_voltage_kv", "rating": "rated_power_mva > 0"},
    "switch": {"self_loop": "from_bus <> to_bus"},
    "load": {"power": "active_power_mw >= 0"},
    "generator": {"power": "active_power_mw >= 0"},
    "source": {"voltage": "nominal_voltage_kv > 0"},
}
#: Reasons for which a row is passed over as no error: it can't be connected, or a source has no name though names are given.
SKIPS: dict[str, tuple[str, ...]] = {
    "line": ("from_bus: missing or unreadable", "to_bus: missing or unreadable", "self_loop"),
    "load": ("bus_id: missing or unreadable",),
    "source": ("name: missing",),
}
#: Repaired quantities whose absence is no repair, since it means nothing.
ABSENT = ("q",)
_QUANTITY = {"length": ("length", "km"), "p": ("active_power", "MW"), "q": ("reactive_power", "Mvar"), "s": ("apparent_power", "MVA"), "kv": ("voltage", "kV")}


@dataclass(frozen=True)
class LayerMapping:
    """How a raw layer becomes an entity: columns, units and defaults by field.

    ``repair`` fields fall back to 0. ``path`` is a column with a line's WKT in metres: without a length column the
    length is that of the path.
    """

    entity: str
    fields: Mapping[str, str]
    units: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, object] = field(default_factory=dict)
    repair: tuple[str, ...] = ()
    path: str | None = None

    def __post_init__(self) -> None:
        known = ENTITIES.get(self.entity)
        if known is None:
            raise ValueError(f"unknown entity: {self.entity}")
        strange = [f for f in (*self.fields, *self.units, *self.defaults, *self.repair) if f not in known]
        if strange:
            raise ValueError(f"unknown fields of {self.entity}: {', '.join(strange)}")


def _read(kind: str, c: Column, unit: str | None, fallback: Column) -> Column:
    text = c.cast("string")
    if kind == "id":
        return normalize.identifier(text)
    if kind == "name":
        return normalize.name(text, fallback)
    if kind == "kv":
        return normalize.voltage_kv(text, unit or "kV")
    if kind == "closed":
        return normalize.switch_closed(text)
    if kind == "served":
        return normalize.in_service(text)
    return normalize.convert(text, _QUANTITY[kind][0], unit or _QUANTITY[kind][1]) if kind in _QUANTITY else normalize.number(text)


def judge_layer(df: DataFrame, mapping: LayerMapping, row: str) -> DataFrame:
    """The entity's fields of every first row of a raw id, with its outcome: accepted, skipped or rejected.

    Adds row_id, reason (why it isn't accepted), outcome and repairs, the names of the repaired fields with what was
    wrong; rows that are skipped are not repaired. ``row`` orders the raw rows: of several with the same raw id the
    first counts; rows without one are each their own, and rejected. Ids that only become equal when they are normalised
    are rejected, all but the first.
    """
    spec = ENTITIES[mapping.entity]
    missing = [c for c in (*mapping.fields.values(), *filter(None, [mapping.path])) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the layer: {', '.join(missing)}")
    raw_id = F.col(mapping.fields["id"])
    first = df.withColumn("_rank", F.row_number().over(Window.partitionBy(raw_id.cast("string"), F.when(raw_id.isNull(), F.col(row))).orderBy(row))).where("_rank = 1")
    ident = normalize.identifier(raw_id.cast("string"))
    columns, reasons, repairs = [], [], []
    for name, (kind, required) in spec.items():
        source = mapping.fields.get(name)
        raw = F.col(source) if source else F.lit(None).cast("string")
        blank = raw.isNull() | (F.trim(raw.cast("string")) == "")
        value = _read(kind, raw, mapping.units.get(name), ident)
        if kind == "length" and source is None and mapping.path:
            path = geometry.path_from_wkt(F.col(mapping.path))
            value = F.when(F.size(path) > 1, geometry.path_length(path) / 1000)
        if name in mapping.repair:
            absent = F.lit(None) if kind in ABSENT else F.when(blank, F.lit(f"{name}: missing"))
            repairs.append(F.coalesce(absent, F.when(~blank & value.isNull(), F.lit(f"{name}: unreadable"))))
        if name in mapping.defaults:
            value = F.when(blank, F.lit(mapping.defaults[name])).otherwise(value)
            if kind == "kv":  # a voltage of zero or less is as good as none
                value = F.when(value > 0, value).otherwise(F.lit(mapping.defaults[name]))
        if name in mapping.repair:
            value = F.coalesce(value, F.lit(0.0))
        columns.append(value.alias(name))
        if required:
            reasons.append(F.when(F.col(name).isNull(), F.lit(f"{name}: missing or unreadable")))
        if kind == "name" and source and "name: missing" in SKIPS.get(mapping.entity, ()):
            columns.append(blank.alias("_nameless"))
            reasons.insert(0, F.when(F.col("_nameless"), F.lit("name: missing")))
    built = first.select(F.col(row).cast("string").alias("row_id"), F.col(row).alias("_order"), F.array_compact(F.array(*repairs)).cast("array<string>").alias("_repairs"), *columns)
    for reason, rule in INVARIANTS.get(mapping.entity, {}).items():
        reasons.append(F.when(~F.coalesce(F.expr(rule), F.lit(True)), F.lit(reason)))
    same = F.row_number().over(Window.partitionBy("id", F.when(F.col("id").isNull(), F.col("_order"))).orderBy("_order"))
    judged = built.withColumn("_same", same).withColumn("reason", F.coalesce(*reasons, F.when(F.col("_same") > 1, F.lit("id: duplicate"))))
    outcome = F.when(F.col("reason").isNull(), "accepted").when(F.col("reason").isin(*SKIPS.get(mapping.entity, ())), "skipped").otherwise("rejected")
    return judged.withColumn("outcome", outcome).select(*spec, "row_id", "reason", "outcome", F.when(F.col("outcome") == "skipped", F.array().cast("array<string>")).otherwise(F.col("_repairs")).alias("repairs"))


def map_layer(df: DataFrame, mapping: LayerMapping, row: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the entity's rows, and (layer, row_id, reason) of the others (see ``judge_layer``)."""
    judged = judge_layer(df, mapping, row)
    rejected = judged.where("reason IS NOT NULL").select(F.lit(mapping.entity).alias("layer"), "row_id", "reason")
    return judged.where("reason IS NULL").select(*ENTITIES[mapping.entity]), rejected


def observed(judged: DataFrame, mapping: LayerMapping) -> tuple[DataFrame, Observation]:
    """``judged`` with counters that fill while its rows are mapped, without a pass of their own: ``Observation.get`` after the first action.

    Counted are the outcomes (``accepted``, ``skipped``, ``rejected``) and each repair by its name.
    """
    counters = [F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("accepted", "skipped", "rejected")]
    counters += [F.count(F.when(F.array_contains("repairs", f"{f}: {what}"), 1)).alias(f"{f}: {what}") for f in mapping.repair for what in ("missing", "unreadable")]
    seen = Observation(f"mapping of {mapping.entity}")
    return judged.observe(seen, *counters), seen
