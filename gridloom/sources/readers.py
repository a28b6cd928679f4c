"""Readers of asset tables, and the catalog that holds them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geometry import path_from_wkt


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "UTF-8", limit: int | None = None) -> DataFrame:
    """All columns as text; a ``.tsv`` is split at tabs."""
    df = spark.read.csv(path, header=True, sep=delimiter or ("\t" if path.endswith(".tsv") else ","), encoding=encoding)
    return df if limit is None else df.limit(limit)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, split: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table or a query of a database; ``split`` (column, lower, upper, parts) reads it in parallel."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    reader = reader.option("dbtable", table) if table else reader.option("query", query)
    if split:
        column, lower, upper, parts = split
        reader = reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return reader.load()


def database_tables(spark: SparkSession, url: str, schema: str, **options: str) -> list[str]:
    """Names of all tables of a database's schema, sorted, as Spark's own catalog of that database lists them."""
    catalog = f"jdbc_{hashlib.sha256(repr((url, sorted(options.items()))).encode()).hexdigest()[:16]}"
    spark.conf.set(f"spark.sql.catalog.{catalog}", "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    for key, value in {"url": url, **options}.items():
        spark.conf.set(f"spark.sql.catalog.{catalog}.{key}", value)
    return sorted(r["tableName"] for r in spark.sql(f"SHOW TABLES IN {catalog}.`{schema}`").collect())


def read_database(spark: SparkSession, url: str, schema: str, tables: Iterable[str] | None = None, aliases: dict[str, str] | None = None, split: dict[str, tuple[str, int]] | None = None, **options: str) -> Catalog:
    """Tables of a database's schema as a catalog, all of them where none are asked for; an unknown one is an error.

    ``aliases``: other names by table; ``split``: by table a column of whole numbers and in how many parts to read it,
    between bounds that one query for its least and largest value gives. Rows without a value come with the first part.
    """
    there = database_tables(spark, url, schema, **options)
    asked = there if tables is None else list(tables)
    unknown = sorted((set(asked) | set(aliases or {}) | set(split or {})) - set(there))
    if unknown:
        raise ValueError(f"no table {', '.join(unknown)} in {schema}")
    out = Catalog()
    for table in asked:
        name, bounds = f'"{schema}"."{table}"', None
        if split and table in split:
            column, parts = split[table]
            low, high = read_jdbc(spark, url, query=f'SELECT MIN("{column}") AS low, MAX("{column}") AS high FROM {name}', **options).first()
            bounds = None if low is None else (f'"{column}"', int(low), int(high) + 1, parts)
        out.add((aliases or {}).get(table, table), read_jdbc(spark, url, name, split=bounds, **options))
    return out


def read_points(df: DataFrame, x: str = "x", y: str = "y") -> tuple[DataFrame, DataFrame]:
    """(points, rejected): rows with both coordinates readable, as doubles, and the others."""
    missing = [c for c in (x, y) if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    cast = df.withColumn(x, F.col(x).try_cast("double")).withColumn(y, F.col(y).try_cast("double"))
    whole = F.col(x).isNotNull() & F.col(y).isNotNull()
    return cast.where(whole), cast.where(~whole)


def read_jdbc_geometry(spark: SparkSession, url: str, query: str, geometry: str, name: str = "points", **options: str) -> DataFrame:
    """A query of a spatial database whose column ``geometry`` is text (``ST_AsText`` on the server); its path comes as ``name``."""
    return with_path(read_jdbc(spark, url, query=query, **options), geometry, name)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties, kind, parts, points) of each feature.

    ``parts`` are its points, lines or rings as arrays of (x, y), those of a multi-geometry one after another, and
    ``points`` all of them in one array; both are null without a geometry.
    """
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    feature = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    line, lines = "array<array<double>>", "array<array<array<double>>>"
    raw = (
        F.when(kind == "Point", F.array(F.array(F.from_json(text, "array<double>"))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(F.from_json(text, line)))
        .when(kind.isin("MultiLineString", "Polygon"), F.from_json(text, lines))
        .when(kind == "MultiPolygon", F.flatten(F.from_json(text, f"array<{lines}>")))
    )
    parts = F.transform(raw, lambda part: F.transform(part, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return feature.select(F.col("f.properties").alias("properties"), kind.alias("kind"), parts.alias("parts"), F.flatten(parts).alias("points"))


def _pairs(text: Column, between: str, within: str) -> Column:
    """An array of (x, y) of a text of coordinates."""
    items = F.filter(F.split(F.trim(text), between), lambda p: p != "")
    return F.transform(items, lambda p: F.struct(F.split(p, within)[0].try_cast("double").alias("x"), F.try_element_at(F.split(p, within), F.lit(2)).try_cast("double").alias("y")))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, points) of each placemark with a point or a line."""
    schema = "name string, Point struct<coordinates: string>, LineString struct<coordinates: string>"
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    text = F.coalesce("Point.coordinates", "LineString.coordinates")
    return rows.select("name", F.when(F.col("Point").isNotNull(), "Point").when(F.col("LineString").isNotNull(), "LineString").alias("kind"), _pairs(text, r"\s+", ",").alias("points"))


def read_gml(spark: SparkSession, path: str, row_tag: str, geometry: str, fields: str = "") -> DataFrame:
    """``fields`` (a schema text) and points of each element ``row_tag``, whose element ``geometry`` holds a line's or point's position list."""
    shape = "struct<LineString: struct<posList: string>, Point: struct<pos: string>>"
    rows = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(", ".join(filter(None, [fields, f"`{geometry}` {shape}"]))).load(path)
    text = F.coalesce(f"{geometry}.LineString.posList", f"{geometry}.Point.pos")
    numbers = F.filter(F.split(F.trim(text), r"\s+"), lambda n: n != "")
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / 2).cast("int") - 1), lambda i: F.struct(F.get(numbers, 2 * i).try_cast("double").alias("x"), F.get(numbers, 2 * i + 1).try_cast("double").alias("y")))
    return rows.withColumn("points", F.when(F.size(numbers) >= 2, points)).drop(geometry)


def read_layers(spark: SparkSession, paths: dict[str, str], reader=None) -> Catalog:
    """Files as a catalog, each under the name that it is given."""
    out = Catalog()
    for name, path in paths.items():
        out.add(name, (reader or read_geojson)(spark, path))
    return out


def with_path(df: DataFrame, wkt: str, name: str = "points") -> DataFrame:
    return df.withColumn(name, path_from_wkt(F.col(wkt)))


# Kinds of input by address and by suffix.
SCHEMES = ("postgresql", "postgres", "mssql", "oracle", "sqlite", "mysql", "mariadb")
SUFFIXES = {
    "csv": ("csv", "tsv"), "vector": ("shp", "gpkg", "geojson", "json", "gml", "kml"), "parquet": ("parquet", "pq"), "database": ("sqlite", "sqlite3", "db"), "spreadsheet": ("xlsx", "xlsm", "xls"), "backup": ("bak",), "script": ("sql",),
}


def input_kind(uri: Column, head: Column) -> Column:
    """The kind of an input by its address, its suffix or its first characters; ``text`` is a sectioned export, ``settings`` its configuration."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z0-9]+)(\+[A-Za-z0-9]+)?:", 1))
    suffix = F.lower(F.regexp_extract(uri, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(scheme.isin(*SCHEMES), "database")
    for kind, suffixes in SUFFIXES.items():
        out = out.when(suffix.isin(*suffixes), kind)
    out = out.when((suffix == "txt") & head.contains("[GENERAL]") & head.contains("VERSION"), "text").when((suffix == "txt") & head.contains("[IMPORT MODE]"), "settings")
    out = out.when(head.startswith("SQLite format 3"), "database").when(head.startswith("TAPE"), "backup").when(head.startswith("PAR1"), "parquet")
    return out.otherwise("unknown")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind) of all files below a folder that an engine can read or name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.decode(F.substring("content", 1, 4096), "ISO-8859-1").alias("head"))
    return files.select("path", "length", input_kind(F.col("path"), F.col("head")).alias("kind"))


def detectable(files: DataFrame) -> DataFrame:
    """The files of a manifest that hold data: those of a known kind outside output folders, in the order of their paths without case."""
    return files.where(~F.col("path").rlike("/output/") & ~F.col("kind").isin("unknown", "script")).orderBy(F.lower("path"))


@dataclass
class Catalog:
    """Logical tables by name, all lazy."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def add(self, name: str, df: DataFrame, policy: str = "error") -> None:
        """``policy`` for a name that is there already: error, overwrite or union."""
        if name in self.tables and policy == "error":
            raise ValueError(f"table {name} is there already")
        if name in self.tables and policy == "union":
            df = self.tables[name].unionByName(df, allowMissingColumns=True)
        self.tables[name] = df

    def merge(self, other: Catalog, policy: str = "error") -> Catalog:
        out = Catalog(dict(self.tables))
        for name, df in other.tables.items():
            out.add(name, df, policy)
        return out

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)


def write_issues(issues: DataFrame, folder: str, most: int = 5000) -> None:
    """All issues as Parquet, the first ``most`` of the report's order as JSON, and whether that left some out."""
    from gridloom.operators.validate import in_order

    issues.write.mode("overwrite").parquet(f"{folder}/issues")
    in_order(issues, most).write.mode("overwrite").json(f"{folder}/report")
    write_report(issues.agg(F.count("*").alias("n"), (F.count("*") > most).alias("truncated")), f"{folder}/summary")


def write_report(rows: DataFrame, folder: str) -> None:
    """A report (profile, connectivity, proposal or any other rows) as JSON, a line for each row."""
    rows.write.mode("overwrite").json(folder)
