"""What columns hold: counts, ranges and sketches of distinct values from one aggregation a table, and columns held in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.normalize import number
from gridloom.operators.components import settle

#: Entries of a sketch of distinct values, as a power of two: exact up to 65 536 values, a standard error of 0.4 % beyond, 1 MB at most.
LG_ENTRIES = 16
#: A column is a key from this share of distinct values on.
KEY_SHARE = 0.99
FIGURES = r"int|float|double|decimal"
DATES = r"^(date|timestamp)"


def _text(c: str, kind: str) -> Column:
    col = F.col(f"`{c}`")
    return F.to_json(col) if kind.startswith(("map", "array", "struct")) else col.cast("string")


def _figure(c: str, kind: str) -> Column:
    if kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        return F.col(f"`{c}`").cast("double")
    return number(F.col(f"`{c}`")) if kind == "string" else F.lit(None).cast("double")


def value_key(text: Column, figure: Column) -> Column:
    """A hash under which equal values of different columns meet: figures by their number, all else by its text; null for null."""
    return F.when(figure.isNotNull(), F.xxhash64(figure + F.lit(0.0))).when(text.isNotNull(), F.xxhash64(text))


def _summed(df: DataFrame, table: str, name: str, last) -> DataFrame:
    """A row for each column from one aggregation; ``last`` gives the aggregate ``name`` from a column's name, text and figure."""
    sums = [F.count("*").alias("rows")]
    for i, (c, kind) in enumerate(df.dtypes):
        text, figure = _text(c, kind), _figure(c, kind)
        sums += [F.count(text).alias(f"n{i}"), F.count(figure).alias(f"f{i}"), F.min(figure).alias(f"a{i}"), F.max(figure).alias(f"b{i}"), last(c, kind, text, figure).alias(f"s{i}")]
    items = [
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(kind).alias("type"), F.col("rows"), F.col(f"n{i}").alias("non_null"), F.col(f"f{i}").alias("figures"), F.col(f"a{i}").alias("low"), F.col(f"b{i}").alias("high"), F.col(f"s{i}").alias(name))
        for i, (c, kind) in enumerate(df.dtypes)
    ]
    return df.agg(*sums).select(F.explode(F.array(*items)).alias("x")).select(F.lit(table).alias("table"), "x.*")


def shapes(df: DataFrame, table: str, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """(table, column, position, type, rows, non_null, figures, low, high, sketch) of every column, from one aggregation without an exchange of rows.

    ``figures``: values that are numbers, with their range; ``sketch``: a theta sketch of the distinct values. All of it
    can be merged, so that new files or days of a table need no second look at the old ones. An empty table gives
    counts of 0 and an empty sketch.
    """
    return _summed(df, table, "sketch", lambda c, kind, text, figure: F.theta_sketch_agg(value_key(text, figure), lg_entries))


def counted(df: DataFrame, table: str) -> DataFrame:
    """As ``shapes``, with the exact number of distinct values in place of the sketch: it costs an exchange of them and can't be merged."""
    whole = lambda c, kind, text: text if kind.startswith(("map", "array", "struct")) else F.col(f"`{c}`")
    return _summed(df, table, "distinct", lambda c, kind, text, figure: F.count_distinct(whole(c, kind, text)))


def merged(parts: DataFrame, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """The shapes of whole tables from those of their parts."""
    sums = [F.sum(c).alias(c) for c in ("rows", "non_null", "figures")]
    return parts.groupBy("table", "column").agg(F.min("position").alias("position"), F.first("type").alias("type"), *sums, F.min("low").alias("low"), F.max("high").alias("high"), F.theta_union_agg("sketch", lg_entries).alias("sketch"))


def facts(shape: DataFrame) -> DataFrame:
    """(table, column, position, type, rows, non_null, figures, low, high, distinct, numeric, dated): shapes without their sketches, or what ``counted`` gives.

    A column is numeric by its type, or where it is text and all that it holds are numbers.
    """
    numeric = F.col("type").rlike(FIGURES) & ~F.col("type").rlike("[<:]") | ((F.col("type") == "string") & (F.col("figures") == F.col("non_null")) & (F.col("non_null") > 0))
    distinct = F.col("distinct") if "distinct" in shape.columns else F.theta_sketch_estimate("sketch").alias("distinct")
    return shape.select("table", "column", "position", "type", "rows", "non_null", "figures", "low", "high", distinct, numeric.alias("numeric"), F.col("type").rlike(DATES).alias("dated"))


def contained(shape: DataFrame, least: float = 0.9, key_share: float = KEY_SHARE) -> DataFrame:
    """(table, column, in_table, in_column, share): columns of whose distinct values a share of ``least`` or more lies in a key column.

    Pairs of columns are compared by their sketches alone, and only where both hold numbers of ranges that overlap, or
    both hold texts. The work is that of the catalog's pairs; no table is read again.
    """
    kinds = F.filter(F.array(F.when(F.col("figures") > 0, "figure"), F.when(F.col("figures") < F.col("non_null"), "text")), lambda k: k.isNotNull())
    held = shape.where("non_null > 0").withColumn("n", F.theta_sketch_estimate("sketch")).withColumn("kind", F.explode(kinds))
    one = held.select("kind", "table", "column", "low", "high", "n", "sketch")
    key = held.where(F.col("n") >= F.col("non_null") * key_share).select("kind", F.col("table").alias("in_table"), F.col("column").alias("in_column"), F.col("low").alias("in_low"), F.col("high").alias("in_high"), F.col("sketch").alias("in_sketch"))
    reach = (F.col("kind") == "text") | ((F.col("low") <= F.col("in_high")) & (F.col("in_low") <= F.col("high")))
    pairs = one.join(key, "kind").where(reach & ((F.col("table") != F.col("in_table")) | (F.col("column") != F.col("in_column"))))
    share = F.theta_sketch_estimate(F.theta_intersection("sketch", "in_sketch")) / F.col("n")
    found = pairs.select("table", "column", "in_table", "in_column", F.least(share, F.lit(1.0)).alias("share"))
    return found.groupBy("table", "column", "in_table", "in_column").agg(F.max("share").alias("share")).where(F.col("share") >= least)


#: Columns that one mask tells of.
MASK_BITS = 62


def contained_exactly(tables: dict[str, DataFrame], least: float = 0.9, key_share: float = KEY_SHARE) -> DataFrame:
    """As ``contained``, from the values themselves, so exact for any number of them.

    Every value is brought together once with the set of columns that hold it, as bits; then values of one set are
    counted, and the sets, whose number is that of the catalog's habits, are read in pairs of columns.
    """
    columns = [(t, c, kind) for t, df in tables.items() for c, kind in df.dtypes]
    places = {(t, c): i for i, (t, c, _) in enumerate(columns)}
    masks = [f"m{k}" for k in range(len(columns) // MASK_BITS + 1)]
    rows, held = None, None
    for t, df in tables.items():
        items = [
            F.struct((_figure(c, kind) + F.lit(0.0)).alias("figure"), _text(c, kind).alias("text"), *(F.lit(1 << places[t, c] % MASK_BITS if k == places[t, c] // MASK_BITS else 0).cast("long").alias(m) for k, m in enumerate(masks)))
            for c, kind in df.dtypes
        ]
        part = df.select(F.explode(F.array(*items)).alias("v")).where("v.text IS NOT NULL").select("v.figure", F.when(F.col("v.figure").isNull(), F.col("v.text")).alias("text"), *(f"v.{m}" for m in masks))
        counts = [F.struct(F.lit(t).alias("table"), F.lit(c).alias("column"), F.lit(places[t, c]).alias("i"), F.col(f"n{places[t, c]}").alias("non_null")) for c in df.columns]
        full = df.agg(*(F.count(F.col(f"`{c}`")).alias(f"n{places[t, c]}") for c in df.columns)).select(F.explode(F.array(*counts)).alias("x")).select("x.*")
        rows, held = (part, full) if rows is None else (rows.unionAll(part), held.unionAll(full))
    sets = rows.groupBy("figure", "text").agg(*(F.bit_or(m).alias(m) for m in masks)).groupBy(*masks).agg(F.count("*").alias("n"))
    member = F.array_compact(F.array(*(F.when(F.col(masks[i // MASK_BITS]).bitwiseAND(F.lit(1 << i % MASK_BITS)) != 0, F.lit(i)) for i in range(len(columns)))))
    both = sets.select("n", member.alias("all")).select("n", "all", F.explode("all").alias("i")).select("n", "i", F.explode("all").alias("j")).groupBy("i", "j").agg(F.sum("n").alias("n"))
    both = settle(both)  # a row for each pair of columns that share a value
    one = settle(held).join(both.where("i = j").select("i", F.col("n").alias("distinct")), "i")
    key = one.where(F.col("distinct") >= F.col("non_null") * key_share).select(F.col("i").alias("j"), F.col("table").alias("in_table"), F.col("column").alias("in_column"))
    found = both.where("i <> j").join(one.select("i", "table", "column", "distinct"), "i").join(key, "j")
    return found.select("table", "column", "in_table", "in_column", (F.col("n") / F.col("distinct")).alias("share")).where(F.col("share") >= least)
