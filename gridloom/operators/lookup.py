"""Finding the table that explains codes: pairs of columns (code, value) of many tables, ranked by what their rows say."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.normalize import identifier, number

#: Relative error of the distinct counts.
ERROR = 0.02
#: Values above the first and up to the second can be voltages in kV.
VOLTAGES = (0.0, 1000.0)


def column_pairs(name: str, df: DataFrame, span: tuple[float, float] = VOLTAGES) -> DataFrame:
    """(table, code, value, numeric, single): of each two columns the share of values that can be meant, and how nearly each code has one value.

    One pass over the table with sketches of distinct counts for its columns and their pairs.
    """
    text = {c: identifier(F.col(f"`{c}`").cast("string")) for c in df.columns}
    figure = {c: number(F.col(f"`{c}`").cast("string")) for c in df.columns}
    figure = {c: F.when((x > span[0]) & (x <= span[1]), x) for c, x in figure.items()}
    pairs = [(a, b) for a in df.columns for b in df.columns if a != b]
    both = [F.when(text[a].isNotNull() & figure[b].isNotNull(), F.struct(text[a].alias("a"), figure[b].alias("b"))) for a, b in pairs]
    sums = [F.count(both[i]).alias(f"n{i}") for i in range(len(pairs))]
    sums += [F.approx_count_distinct(both[i], ERROR).alias(f"p{i}") for i in range(len(pairs))]
    sums += [F.approx_count_distinct(F.when(both[i].isNotNull(), text[a]), ERROR).alias(f"c{i}") for i, (a, _) in enumerate(pairs)]
    facts = df.agg(F.count("*").alias("rows"), *sums)
    share = lambda part, of: F.coalesce(F.least(F.lit(1.0), F.col(part) / F.nullif(F.col(of), F.lit(0))), F.lit(0.0))
    rows = F.array(*(F.struct(F.lit(a).alias("code"), F.lit(b).alias("value"), share(f"n{i}", "rows").alias("numeric"), share(f"c{i}", f"p{i}").alias("single")) for i, (a, b) in enumerate(pairs)))
    return facts.select(F.lit(name).alias("table"), F.explode(rows).alias("r")).select("table", "r.*")


def found_codes(name: str, df: DataFrame, codes: DataFrame) -> DataFrame:
    """(table, code, found): how many of the codes (code) each column holds."""
    held = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), identifier(F.col(f"`{c}`").cast("string")).alias("code")) for c in df.columns))).alias("h")).select("h.*").distinct()
    return held.join(codes, "code").groupBy("column").agg(F.count("*").alias("found")).select(F.lit(name).alias("table"), F.col("column").alias("code"), "found")


def ranked_lookups(codes: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, code, value, contained, numeric, single, score) of every pair of columns that holds some of the codes, best first.

    ``codes``: (code). Numbers explain themselves and are no codes. The score is the share of the codes that the pair
    explains, times the share of its values that can be voltages and that of codes without a second value.
    """
    asked = codes.select(identifier("code").alias("code")).where(F.col("code").isNotNull() & number(F.col("code")).isNull()).distinct()
    total = asked.agg(F.count("*").alias("total"))
    out = None
    for name, df in tables.items():
        rows = column_pairs(name, df).join(found_codes(name, df, asked), ["table", "code"])
        out = rows if out is None else out.unionAll(rows)
    ranked = out.crossJoin(total).withColumn("contained", F.col("found") / F.col("total"))  # one row
    ranked = ranked.withColumn("score", F.col("contained") * F.col("numeric") * F.col("single")).where("score > 0")
    return ranked.select("table", "code", "value", "contained", "numeric", "single", "score").orderBy(F.desc("score"), "table", "code", "value")


def looked_up(rows: DataFrame, code: str, tables: Mapping[str, DataFrame], order: str) -> DataFrame:
    """``rows`` with ``found``: the code as a number, else what the best lookup among ``tables`` gives it, of several rows the last by ``order``."""
    best = ranked_lookups(rows.select(F.col(code).alias("code")), {n: t.drop(order) for n, t in tables.items()}).first()
    own = number(F.col(code))
    if best is None:
        return rows.withColumn("found", own)
    table = tables[best["table"]]
    key, value = identifier(F.col(f"`{best['code']}`").cast("string")), number(F.col(f"`{best['value']}`").cast("string"))
    facts = table.select(key.alias("_code"), value.alias("_value"), F.col(order).alias("_order")).dropna().groupBy("_code").agg(F.max_by("_value", "_order").alias("_value"))
    return rows.join(facts, identifier(F.col(code)) == F.col("_code"), "left").withColumn("found", F.coalesce(own, "_value")).drop("_code", "_value")
