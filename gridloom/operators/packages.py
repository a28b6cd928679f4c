"""Files of an inventory as a table: which belong together, which copy counts, what a package is good for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _date(parts: Column, at: Column) -> Column:
    """The date that begins at a part of a name, and how many parts it takes: one of eight digits, or year, month, day or day, month, year in three.

    Only digits that may be a date are parsed: a text that is none costs an exception each.
    """
    one, three = F.get(parts, at), F.array_join(F.slice(parts, at + 1, 3), "-")
    whole = F.when(one.rlike(r"^20\d{6}$"), F.try_to_date(one, "yyyyMMdd"))
    parted = F.when(three.rlike(r"^20\d\d-\d\d-\d\d$"), F.try_to_date(three, "yyyy-MM-dd")).when(three.rlike(r"^\d\d-\d\d-20\d\d$"), F.try_to_date(three, "dd-MM-yyyy"))
    date = F.coalesce(whole, parted)
    return F.when(date.isNotNull(), F.struct(date.alias("date"), at.alias("at"), F.when(whole.isNotNull(), 1).otherwise(3).alias("parts")))


def with_tokens(files: DataFrame, name: str = "name") -> DataFrame:
    """Adds stem, the name without date and suffix, and token, its first date of this century as year, month and day, or null.

    Parts of a name stand between blanks, dots, dashes and underscores; the date goes with the separator before it.
    Both are the fields of one struct that is exploded, so that a filter on them doesn't have them worked out for each of its terms.
    """
    base = F.regexp_replace(F.lower(F.col(name)), r"\.[a-z]+[0-9]?$", "")
    rows = files.withColumn("_base", base).withColumn("_parts", F.split("_base", r"[_\s.-]"))
    dates = F.filter(F.transform(F.sequence(F.lit(0), F.size("_parts") - 1), lambda i: _date(F.col("_parts"), i)), lambda d: d.isNotNull())
    rows = rows.withColumn("_found", F.explode(F.array(F.get(dates, F.lit(0)))))
    text = lambda first, n: F.array_join(F.slice("_parts", first, n), " ")  # noqa: E731 each separator is one character
    before = F.when(F.col("_found.at") > 0, F.length(text(F.lit(1), F.col("_found.at")))).otherwise(0)
    after = F.length(text(F.lit(1), F.col("_found.at") + F.col("_found.parts"))) + 1
    stem = F.when(F.col("_found").isNull(), F.col("_base")).otherwise(F.concat(F.substring(F.col("_base"), F.lit(1), before), F.substring(F.col("_base"), after, F.length("_base"))))
    made = F.explode(F.array(F.struct(F.date_format("_found.date", "yyyyMMdd").alias("token"), stem.alias("stem")))).alias("_made")
    return rows.select(*(c for c in files.columns if c not in ("token", "stem")), made).select("*", "_made.token", "_made.stem").drop("_made")


def newest_copies(files: DataFrame, name: str = "name") -> DataFrame:
    """One file of each stem: an undated one before dated ones, of those the newest; ties by name."""
    rank = F.row_number().over(Window.partitionBy("stem").orderBy(F.col("token").isNotNull(), F.desc("token"), name))
    return files.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def relevant(files: DataFrame, include: tuple[str, ...], skip: tuple[str, ...], stem: str = "stem") -> DataFrame:
    """Files whose name holds a marker of ``include`` as a word and none of ``skip``."""
    words = F.split(F.col(stem), "[^a-z]+")
    wanted = F.exists(words, lambda w: w.isin(*include))
    return files.where(wanted & ~F.exists(words, lambda w: w.isin(*skip)))


def assess(files: DataFrame, package: str = "package") -> DataFrame:
    """Each package (package, role, token): whether its dates agree, which roles it has, and a score from 0 to 1."""
    facts = files.groupBy(package).agg(F.size(F.collect_set("token")).alias("n_dates"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count("*").alias("n_files"))
    whole = F.col("roles").contains("network")
    score = F.when(whole, 0.6).otherwise(0.0) + F.when(F.col("roles").contains("loads"), 0.2).otherwise(0.0) + F.when(F.col("n_dates") <= 1, 0.2).otherwise(0.0)
    return facts.select(package, "n_files", (F.col("n_dates") <= 1).alias("dates_agree"), "roles", F.round(score, 3).alias("score"))
