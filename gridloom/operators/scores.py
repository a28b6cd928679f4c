"""Scores of columns for fields and of tables for network objects, and the worth of whole mappings.

All work on the facts of a catalog (``shapes.facts``: a row for each column of each table), so their size is that of the
catalog; the tables were read once, for the shapes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.coordinates import column_roles
from gridloom.functions.normalize import token
from gridloom.operators import fields as V
from gridloom.operators.proposal import COMPACT, apply_strategy
from gridloom.operators.ranking import prefix_score, topsis

# Least scores of a table, a column, a column of required figures and a column of ends; how many tables an object may choose from.
TABLE_LEAST, COLUMN_LEAST, FIGURE_LEAST, END_LEAST, TABLES = 0.62, 0.34, 0.55, 0.65, 6
# From these on a name or a shape is taken at its word; the share that a shape counts for, by object.
NAMED, SHAPED = 0.55, 0.62
SHAPE_SHARE = {"buses": 0.96, "lines": 0.94}
# By object and voltage level of a table's name, factor and bonus.
LEVELS = (("lines", "bt", 1.0, 0.08), ("lines", "at", 0.92, 0.0), ("sources", "mt", 1.0, 0.06), ("sources", "at", 0.90, 0.0))
CORNERS = ("x1", "y1", "x2", "y2")


def _literal_rows(rows: list[tuple], *names: str) -> Column:
    """A row for each of the rows given, as a struct of these names."""
    text = lambda v: f"{v}D" if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else f"r'{v}'" if isinstance(v, str) else str(v)
    return F.expr("explode(array(" + ", ".join("struct(" + ", ".join(f"{text(v)} AS {n}" for v, n in zip(row, names, strict=True)) + ")" for row in rows) + "))")


def _found(c: Column, pattern: str) -> Column:
    """Whether a text holds what a column of patterns says; an empty pattern is held by all."""
    return F.rlike(c, F.col(pattern))


def _or(c: Column, other) -> Column:
    return F.coalesce(c, F.lit(other))


def lexical_scores(facts: DataFrame) -> DataFrame:
    """(table, column, entity, field, lexical): how like a column's name is to the names of a field."""
    wide = facts.select("table", "column", token(F.col("column")).alias("_c"), _literal_rows(V.alias_rows(), "entity", "field", "alias").alias("a"))
    scored = wide.select("table", "column", "a.entity", "a.field", prefix_score(F.col("_c"), token(F.col("a.alias"))).alias("lexical"))
    return scored.groupBy("table", "column", "entity", "field").agg(F.max("lexical").alias("lexical"))


def field_scores(facts: DataFrame) -> DataFrame:
    """(table, column, entity, field, required, wanted, numeric, lexical, score) of every column for every field.

    The likeness of names goes up or down with the column's type, falls for empty columns and for names that repeat,
    and is then taken through the rules of ``fields.RULES``.
    """
    known = facts.select("table", "column", "non_null", "distinct", "numeric", "dated", token(F.col("column")).alias("token"))
    flags = facts.select("table", "column", _literal_rows(V.field_rows(), "entity", "field", "required", "wanted").alias("f")).select("table", "column", "f.*")
    rows = lexical_scores(facts).join(flags, ["table", "column", "entity", "field"]).join(known, ["table", "column"])
    raw = F.col("lexical")
    typed = F.when(~F.col("wanted"), raw).when(F.col("numeric"), F.least(F.lit(1.0), raw + 0.08)).when(raw >= 0.95, raw * 0.85).otherwise(raw * 0.45)
    single = F.col("distinct") / F.nullif(F.col("non_null"), F.lit(0))
    repeats = F.when((F.col("field") == "name") & (F.col("non_null") > 1) & (single < 0.85), F.greatest(F.lit(0.05), single)).otherwise(1.0)
    base = rows.withColumn("base", typed * F.when(F.col("non_null") == 0, 0.05).otherwise(1.0) * repeats)

    tried = known.select("table", "column", "token", "dated", _literal_rows(V.rule_rows(), "field", "slot", "nr", "holds", "lacks", "on_dates", "factor", "plus").alias("r")).select("table", "column", "token", "dated", "r.*")
    fires = _found(F.col("token"), "holds") & ((F.col("lacks") == "") | ~_found(F.col("token"), "lacks")) & (~F.col("on_dates") | F.col("dated"))
    first = tried.where(fires).groupBy("table", "column", "field", "slot").agg(F.min_by(F.struct("factor", "plus"), "nr").alias("r"))
    effect = first.groupBy("table", "column", "field").agg(F.product("r.factor").alias("factor"), F.sum("r.plus").alias("plus"))
    score = F.least(F.lit(1.0), F.col("base") * _or(F.col("factor"), 1.0) + F.when(F.col("base") > 0, _or(F.col("plus"), 0.0)).otherwise(0.0))
    return base.join(effect, ["table", "column", "field"], "left").select("table", "column", "entity", "field", "required", "wanted", "numeric", "lexical", score.alias("score"))


def table_scores(facts: DataFrame, scores: DataFrame) -> DataFrame:
    """(entity, table, rows, named, shape, score, fit) of every table for every object.

    ``named``: likeness of the table's name; ``shape``: for buses that it looks like points with an id, for lines like
    spans with the corners x1 to y2; ``score``: the best of name, required columns and shape, held near the name where
    neither name nor shape speaks for it; ``fit``: whether the table may be taken for the object at all.
    """
    tables = facts.groupBy("table").agg(F.max("rows").alias("rows"), *(F.max(F.when(token(F.col("column")) == c, 1.0).when(token(F.col("column")).startswith(c), 0.92)).alias(c) for c in CORNERS)).withColumn("token", token(F.col("table")))
    names = tables.select("table", "token", _literal_rows(V.table_rows(), "entity", "alias").alias("a")).groupBy("table", "a.entity").agg(F.max(prefix_score(F.col("token"), F.col("a.alias"))).alias("named"))
    best = scores.groupBy("table", "entity", "field").agg(F.max("score").alias("score"), F.first("required").alias("required"))
    of = lambda f: F.max(F.when(F.col("field") == f, F.col("score"))).alias(f)
    held = best.groupBy("table", "entity").agg(F.avg(F.when(F.col("required"), F.col("score"))).alias("whole"), of("id"), of("x"), of("y"), of("nominal_voltage_kv"))
    roles = column_roles(facts.select("table", "column", "position")).select("table", F.col("parent").isNotNull().alias("parented"))
    rows = tables.join(names, "table").join(held, ["table", "entity"]).join(roles, "table", "left")

    named, ident, entity = F.col("named"), F.col("id"), F.col("entity")
    placed = (F.col("x") >= COLUMN_LEAST) & (F.col("y") >= COLUMN_LEAST)
    points = F.when(placed, (ident + F.col("x") + F.col("y")) / 3).otherwise(ident * 0.5) * F.when(named < NAMED, F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("rows") / 10.0))).otherwise(1.0)
    spans = F.when(F.coalesce(*(F.when(F.col(c).isNull(), True) for c in CORNERS), F.lit(False)), 0.0).otherwise((ident + sum(F.col(c) for c in CORNERS)) / 5)
    shape = F.when(ident < COLUMN_LEAST, 0.0).when(entity == "buses", points).when(entity == "lines", spans).otherwise(0.0)
    rows = rows.withColumn("shape", F.least(F.lit(1.0), shape))
    shaped = F.col("shape") >= SHAPED
    share = reduce(lambda c, s: c.when(entity == s[0], s[1]), SHAPE_SHARE.items(), F.when(F.lit(False), 0.0))
    few = F.when((entity == "buses") & (named < NAMED) & (F.col("rows") < 10), F.greatest(F.lit(0.05), F.col("rows") / 10.0)).otherwise(1.0)
    score = F.greatest(F.greatest(named, F.col("whole") * 0.92, F.when(shaped, F.col("shape") * share).otherwise(0.0)) * few, ident * 0.98)
    score = F.when((named < 0.5) & ~shaped, F.least(score, named + 0.18)).otherwise(score)
    at = lambda level: F.col("token").rlike(f"^{level}|{level}$|(tramo|salida){level}|{level}(tramo|salida)")
    level = F.when(at("bt"), "bt").when(at("mt"), "mt").when(at("at"), "at")
    change = F.when(F.lit(False), F.struct(F.lit(1.0).alias("factor"), F.lit(0.0).alias("plus")))
    for e, named_level, factor, plus in LEVELS:
        change = change.when((entity == e) & (level == named_level), F.struct(F.lit(factor).alias("factor"), F.lit(plus).alias("plus")))
    score = F.least(F.lit(1.0), score * _or(change["factor"], 1.0) + _or(change["plus"], 0.0))
    score = F.least(F.lit(1.0), score + F.when((entity == "lines") & _or(F.col("parented"), False), 0.04).otherwise(0.0))

    spoken = (named >= NAMED) | shaped
    buses = spoken & ((named >= NAMED) | (F.col("rows") >= 3) | (F.col("shape") >= 0.9)) & ~F.col("token").rlike(V.NO_BUSES) & ~((F.col("nominal_voltage_kv") >= 0.9) & (ident < 0.72))
    fit = (ident >= COLUMN_LEAST) & F.when(entity == "buses", buses).when(entity == "lines", spoken).when(entity == "substations", (named >= NAMED) & ~F.col("token").rlike(V.NO_SUBSTATIONS)).otherwise(True)
    return rows.select("entity", "table", "rows", "named", "shape", score.alias("score"), fit.alias("fit"))


def ranked_tables(scored: DataFrame) -> DataFrame:
    """(entity, table, place): the tables that each object may take, best first, TABLES at most."""
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc(F.round("score", 9)), "table"))
    return scored.where("fit").withColumn("place", place).where((F.col("place") <= TABLES) & (F.col("score") >= TABLE_LEAST)).select("entity", "table", "place")


def mappings(ranked: DataFrame, scores: DataFrame, most: int = TABLES) -> DataFrame:
    """(candidate, entity, field, table, column, required, wanted, numeric, lexical, score): mappings 1 to ``most``.

    Candidate n takes the n-th table of each object, or its last, and of that table the best column for each field, if
    its score is high enough. Columns of equal score go by their names.
    """
    counts = ranked.groupBy("entity").agg(F.max("place").alias("_last"))
    asked = counts.withColumn("candidate", F.explode(F.sequence(F.lit(1), F.lit(most)))).select("entity", "candidate", F.least("candidate", "_last").alias("place"))
    taken = asked.join(ranked, ["entity", "place"]).select("candidate", "entity", "table")
    least = F.when(F.col("field").isin(*V.ENDS.split()), END_LEAST).when(F.col("required") & F.col("wanted"), FIGURE_LEAST).otherwise(COLUMN_LEAST)
    order = Window.partitionBy("entity", "field", "table").orderBy(F.desc(F.round("score", 9)), "column")
    best = scores.where(F.col("score") >= least).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    return taken.join(best, ["entity", "table"]).select("candidate", "entity", "field", "table", "column", "required", "wanted", "numeric", "lexical", "score")


def _compactness(lines: Column, rows: Column) -> Column:
    """1 for a table of lines that is small enough, less with its size, one half without one."""
    return F.when(~lines, 0.5).when(rows <= COMPACT, 1.0).otherwise(F.greatest(F.lit(0.05), F.lit(float(COMPACT)) / rows))


def objectives(mapped: DataFrame, facts: DataFrame, ranked: DataFrame) -> DataFrame:
    """(candidate, coverage, lexical, types, uniqueness, connectivity, compactness) of mappings.

    Coverage is the share of required fields of all objects that have a table to choose; types the share of figures
    that lie in columns of figures; uniqueness that of different tables; connectivity what there is to resolve the ends
    of lines by: start or parent, end or id, feeder, buses; compactness falls with the rows of the table of lines.
    """
    fields = ranked.select("entity").distinct().withColumn("f", _literal_rows(V.field_rows(), "e", "field", "required", "wanted")).where("f.required AND f.e = entity")
    total = fields.agg(F.count("*").alias("total"))  # one row
    rows = facts.groupBy("table").agg(F.max("rows").alias("rows")).join(column_roles(facts.select("table", "column", "position")), "table", "left")
    on = lambda e, *fs: (F.col("entity") == e) & (F.col("field").isin(*fs) if fs else F.lit(True))
    marks = F.lower("column").rlike("kv|tension|voltaje|voltage")
    typed = F.col("numeric") | ((F.col("field") == "nominal_voltage_kv") & marks)
    used = mapped.groupBy("candidate", "entity").agg(F.first("table").alias("table")).groupBy("candidate").agg((F.countDistinct("table") / F.count("*")).alias("uniqueness"))
    some = lambda c: _or(F.bool_or(c), False)
    worth = mapped.join(rows, "table").groupBy("candidate").agg(
        F.count(F.when(F.col("required"), 1)).alias("hit"), F.avg("lexical").alias("lexical"), F.avg(F.when(F.col("wanted"), typed.cast("double"))).alias("types"), some(on("lines")).alias("lines"), F.max(F.when(on("lines"), F.col("rows"))).alias("rows"),
        (some(on("lines", "from_bus") | (on("lines") & F.col("parent").isNotNull())).cast("int") * 0.45 + some(on("lines", "to_bus", "id")).cast("int") * 0.25 + some(on("lines") & F.col("feeder").isNotNull()).cast("int") * 0.2 + some(on("buses", "id")).cast("int") * 0.1).alias("ends"),
    )
    out = worth.join(used, "candidate").crossJoin(F.broadcast(total))  # one row
    return out.select("candidate", (F.col("hit") / F.nullif(F.col("total"), F.lit(0))).alias("coverage"), "lexical", _or(F.col("types"), 1.0).alias("types"), "uniqueness", F.when(F.col("lines"), F.col("ends")).otherwise(0.0).alias("connectivity"), _compactness(F.col("lines"), F.col("rows")).alias("compactness"))


def strategy_scores(mapping: DataFrame, facts: DataFrame) -> DataFrame:
    """(strategy, objectives): what each strategy makes of a mapping (entity, field, table, column), measured on what it keeps."""
    rows = facts.groupBy("table").agg(F.max("rows").alias("rows"))
    kept = [apply_strategy(mapping, facts, s).withColumn("strategy", F.lit(s)) for s in ("full", "network_core", "compact_lines")]
    left = reduce(lambda a, b: a.unionByName(b), kept).join(rows, "table", "left")
    is_line = F.col("entity") == "lines"
    some = lambda c: _or(F.bool_or(c), False)
    tables = left.groupBy("strategy", "entity").agg(F.first("table").alias("table")).groupBy("strategy").agg(F.count("*").alias("n"), F.countDistinct("table").alias("tables"))
    facts_of = left.groupBy("strategy").agg(some(is_line).alias("lines"), F.max(F.when(is_line, F.col("rows"))).alias("rows"), F.countDistinct(F.when(is_line, F.col("field"))).alias("fields"), some(is_line & F.col("field").isin("from_bus", "to_bus")).alias("ends"), some(F.col("entity") == "buses").alias("buses"), some(F.col("entity") == "loads").alias("loads"))
    half = lambda c: F.when(F.col("lines") & F.col(c), 0.5).otherwise(0.0)
    compact = F.least(F.lit(1.0), _compactness(F.col("lines"), F.col("rows")) + F.when(F.col("loads"), 0.0).otherwise(0.05))
    return tables.join(facts_of, "strategy").select("strategy", (F.col("n") / len(V.FIELDS)).alias("coverage"), F.least(F.lit(1.0), F.col("fields") / 5).alias("lexical"), F.lit(1.0).alias("types"), (F.col("tables") / F.col("n")).alias("uniqueness"), (half("ends") + half("buses")).alias("connectivity"), compact.alias("compactness"))


def weighed(rows: DataFrame, key: str) -> DataFrame:
    """Rows of objectives with their closeness to the best of each."""
    return rows.join(topsis(rows, key, V.WEIGHTS), key)
