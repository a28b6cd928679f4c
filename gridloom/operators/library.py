"""Type libraries: reading, checks of each type, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = ("id", "name", "nominal_voltage_kv", "r1_ohm_per_km", "x1_ohm_per_km", "rated_current_a", "c1_nf_per_km", "r0_ohm_per_km", "x0_ohm_per_km", "c0_nf_per_km", "phases")
TRANSFORMER = ("id", "name", "rated_power_mva", "hv_voltage_kv", "lv_voltage_kv", "uk_percent", "copper_loss_kw", "no_load_loss_kw", "no_load_current_percent", "vector_group", "phase_shift_deg", "uk0_percent", "ur0_percent")
_TEXT = ("id", "name", "vector_group")


def read_library(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(line types, transformer types) of a JSON file with the lists ``line_types`` and ``transformer_types``; a field that no type has is an error."""
    raw = spark.read.json(path, multiLine=True)
    out = []
    for name, fields in (("line_types", LINE), ("transformer_types", TRANSFORMER)):
        schema = ", ".join(f"{f} {'string' if f in _TEXT else 'double'}" for f in fields)
        if name not in raw.columns:
            out.append(spark.createDataFrame([], schema))
            continue
        rows = raw.select(F.explode(name).alias("t")).select("t.*")
        strange = [c for c in rows.columns if c not in fields]
        if strange:
            raise ValueError(f"unknown fields of {name}: {', '.join(strange)}")
        out.append(rows.select(*((F.col(f) if f in rows.columns else F.lit(None)).cast("string" if f in _TEXT else "double").alias(f) for f in fields)))
    return out[0], out[1]


def _rules(rules: dict[str, Column]) -> Column:
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), reason) for reason, ok in rules.items()))


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < float("inf"))


def _above(c: str) -> Column:
    return _finite(c) & (F.col(c) > 0)


def _from_zero(c: str) -> Column:
    return _finite(c) & (F.col(c) >= 0)


def bad_line_types(types: DataFrame) -> DataFrame:
    """(id, reason): the first rule that a line type breaks; sequence-zero values come all three or not at all."""
    zero = [F.col(c).isNotNull() for c in ("r0_ohm_per_km", "x0_ohm_per_km", "c0_nf_per_km")]
    whole, none = zero[0] & zero[1] & zero[2], ~zero[0] & ~zero[1] & ~zero[2]
    reason = _rules({
        "id": F.trim("id") != "", "name": F.trim("name") != "", "nominal_voltage_kv": _above("nominal_voltage_kv"), "r1_ohm_per_km": _above("r1_ohm_per_km"), "x1_ohm_per_km": _from_zero("x1_ohm_per_km"),
        "rated_current_a": _above("rated_current_a"), "c1_nf_per_km": F.col("c1_nf_per_km").isNull() | _from_zero("c1_nf_per_km"), "phases": F.coalesce("phases", F.lit(3)).isin(1, 2, 3), "zero_sequence": whole | none,
        "r0_ohm_per_km": none | _above("r0_ohm_per_km"), "x0_ohm_per_km": none | _from_zero("x0_ohm_per_km"), "c0_nf_per_km": none | _from_zero("c0_nf_per_km"),
    })
    return types.select("id", reason.alias("reason")).where("reason IS NOT NULL")


def bad_transformer_types(types: DataFrame) -> DataFrame:
    """(id, reason): the first rule that a transformer type breaks."""
    both, none = F.col("uk0_percent").isNotNull() & F.col("ur0_percent").isNotNull(), F.col("uk0_percent").isNull() & F.col("ur0_percent").isNull()
    resistive = F.col("copper_loss_kw") / (F.col("rated_power_mva") * 1000) * 100
    optional = lambda c: F.col(c).isNull() | _from_zero(c)
    reason = _rules({
        "id": F.trim("id") != "", "name": F.trim("name") != "", "vector_group": F.col("vector_group").isNull() | (F.trim("vector_group") != ""), "rated_power_mva": _above("rated_power_mva"), "hv_voltage_kv": _above("hv_voltage_kv"), "lv_voltage_kv": _above("lv_voltage_kv"),
        "voltages": F.col("hv_voltage_kv") > F.col("lv_voltage_kv"), "uk_percent": _above("uk_percent") & (F.col("uk_percent") <= 100), "copper_loss_kw": _from_zero("copper_loss_kw"), "no_load_loss_kw": optional("no_load_loss_kw"), "no_load_current_percent": optional("no_load_current_percent"),
        "zero_sequence": both | none, "uk0_percent": none | _above("uk0_percent"), "ur0_percent": none | (_from_zero("ur0_percent") & (F.col("ur0_percent") <= F.col("uk0_percent"))), "losses": resistive <= F.col("uk_percent") + 1e-12,
    })
    return types.select("id", reason.alias("reason")).where("reason IS NOT NULL")


def double_types(types: DataFrame) -> DataFrame:
    """(id, reason) of the ids that stand more than once."""
    return types.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("reason"))


def summary(line: DataFrame, transformer: DataFrame) -> DataFrame:
    """(kind, n, with_zero_sequence) of both lists."""
    one = lambda df, kind, c: df.agg(F.count("*").alias("n"), F.count(c).alias("with_zero_sequence")).select(F.lit(kind).alias("kind"), "*")
    return one(line, "line_types", "r0_ohm_per_km").unionAll(one(transformer, "transformer_types", "uk0_percent"))
