"""Checks of the model in few passes, without columns that they don't read."""

from pyspark.sql import functions as F

from gridloom.functions.normalize import object_key
from gridloom.operators import model as M
from gridloom.plans import model as P

SF = "/root/testdata/sf0.001"


def test_sizes_read_the_model_once(spark):
    """As many rows as each table has, counted by classes and names, without laying out a row for each name; a table without objects counts none."""
    rows = spark.sql("SELECT 'A' AS class, map('x', '1', 'y', '2') AS attributes, map('r', 'k') AS references UNION ALL SELECT 'A', map('x', '1'), map() UNION ALL SELECT 'B', map(), map()")
    specs = [M.ClassTable("A", "T", "FID(a:40)", "loc_name(a:40)", None, {"x": M.Value("x(r)"), "y": M.Value("y(r)")}, {"r": "r(p)"}), M.ClassTable("B", "T", "FID(a:40)", "loc_name(a:40)"), M.ClassTable("C", "C", "FID(a:40)", "loc_name(a:40)")]
    assert {tuple(r) for r in M.sizes(rows, specs).collect()} == {("T", 3), ("C", 0)}
    assert {tuple(r) for r in M.uses(rows).where("class = 'A'").collect()} == {("A", "class", "", 2), ("A", "attribute", "x", 2), ("A", "attribute", "y", 1), ("A", "reference", "r", 1)}


def test_checks_leave_out_attributes(spark, monkeypatch):
    """What rule_model and rule_documents write of the model has no attributes."""
    class Kept(Exception):
        pass

    def store(df):
        raise Kept(df.columns)

    monkeypatch.setattr(P, "store", store)
    for query in (P.rule_model, P.rule_documents):
        try:
            query(spark, SF)
            raise AssertionError("nothing was written")
        except Kept as kept:
            assert "attributes" not in kept.args[0]


def test_keys_of_odd_ids(spark):
    """Ids that need no cleaning are told by one search, with the same keys as by cleaning."""
    ids = ["L10", " L10 ", "a_b", "_a", "a_", "a\n", "a b", "ñ", "", "_", "x" * 50, None]
    raw = F.trim("id")
    clean = F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9_.:-]+", "_"), "^_+|_+$", "")
    key = F.concat(F.lit("GRID:line:"), F.when(clean == raw, clean).otherwise(F.concat(clean, F.lit("~"), F.left(F.sha2(raw, 256), F.lit(8)))))
    long = F.when(F.length(key) <= 40, key).otherwise(F.concat(F.left(key, F.lit(31)), F.lit("~"), F.left(F.sha2(key, 256), F.lit(8))))
    df = spark.createDataFrame([(x,) for x in ids], "id string").select(object_key("line", F.col("id")).alias("got"), long.alias("want"))
    assert all(r["got"] == r["want"] for r in df.collect())
    assert "RLIKE" in df.select("got")._jdf.queryExecution().analyzed().toString()
