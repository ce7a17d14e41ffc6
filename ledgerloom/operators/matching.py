"""Matching a text to one of many records by a ladder of rungs: exact key, key of its title, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import catalog_key, title_line


def trigrams(text):
    """Every run of three characters: two strings of which one holds the other share those of the shorter."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))


def catalog_ladder(lines: DataFrame, catalog: DataFrame, shortest: int = 6) -> DataFrame:
    """line_id, id, rung for lines(line_id, description) and catalog(id, description): the first rung that has a match.

    Rung 3 takes the longest catalogue key of at least `shortest` characters that holds the line's key or is held by it;
    ties go to the lower id. It is no product of the tables: a key that holds another holds its first characters, so the
    rarest run of three characters of the shorter key is an equality join, which contains() then verifies."""
    keys = catalog.select("id", catalog_key(F.col("description")).alias("key")).filter("key <> ''").groupBy("key").agg(F.min("id").alias("id"))
    asked = lines.select("line_id", catalog_key(F.col("description")).alias("whole"), catalog_key(title_line(F.col("description"))).alias("title"))
    one = asked.join(keys, asked["whole"] == keys["key"]).select("line_id", "id", F.lit(1).alias("rung"), F.lit(0).alias("len"))
    two = asked.join(keys, asked["title"] == keys["key"]).select("line_id", "id", F.lit(2).alias("rung"), F.lit(0).alias("len"))
    left = asked.select("line_id", "title").filter(F.length("title") >= shortest).join(one.union(two), "line_id", "left_anti")
    long = keys.filter(F.length("key") >= shortest)
    distinct = left.select("title").distinct()
    grams = long.select(F.explode(trigrams(F.col("key"))).alias("g")).unionByName(distinct.select(F.explode(trigrams(F.col("title"))).alias("g"))).groupBy("g").agg(F.count("*").alias("n"))

    def rarest(df: DataFrame, column: str) -> DataFrame:
        each = df.select(column, F.explode(trigrams(F.col(column))).alias("g")).join(grams, "g")
        return each.groupBy(column).agg(F.min_by("g", F.struct("n", "g")).alias("g"))

    short_key = rarest(long, "key").join(distinct.select("title", F.explode(trigrams(F.col("title"))).alias("g")), "g").filter(F.col("title").contains(F.col("key"))).select("title", "key")
    short_title = rarest(distinct, "title").join(long.select("key", F.explode(trigrams(F.col("key"))).alias("g")), "g").filter(F.col("key").contains(F.col("title"))).select("title", "key")
    held = short_key.union(short_title).distinct().join(long, "key").groupBy("title").agg(F.min_by("id", F.struct(-F.length("key"), "id")).alias("id"))
    three = left.join(held, "title").select("line_id", "id", F.lit(3).alias("rung"), F.lit(0).alias("len"))
    return one.union(two).union(three).groupBy("line_id").agg(F.min(F.struct("rung", "id")).alias("m")).select("line_id", "m.id", "m.rung")


def best_by_words(roles: DataFrame, cards: DataFrame) -> DataFrame:
    """role, code: per role(role, category, unit, prefer, avoid) the card(code, category, unit, cost, text) with the most
    preferred words, then the lowest cost, then the code; category and unit filter, an avoided word excludes."""
    fit = roles.join(cards.select(F.col("category").alias("c_category"), F.col("unit").alias("c_unit"), "code", "cost", F.lower("text").alias("text")), F.expr("(category is null or contains(lower(c_category), lower(category))) and (unit is null or c_unit = unit)"))
    fit = fit.filter(~F.exists(F.coalesce("avoid", F.array().cast("array<string>")), lambda w: F.col("text").contains(F.lower(w))))
    score = F.size(F.filter(F.coalesce("prefer", F.array().cast("array<string>")), lambda w: F.col("text").contains(F.lower(w))))
    return fit.withColumn("score", score).filter("score > 0 or size(coalesce(prefer, array())) = 0").groupBy("role").agg(F.min_by("code", F.struct(-F.col("score"), "cost", "code")).alias("code"), F.max("score").alias("score"))


def duplicate_groups(df: DataFrame, key, columns: list[str]) -> DataFrame:
    """key, n and the members of every key that stands on more than one row; keys are counted before members are gathered."""
    keyed = df.withColumn("key", key).filter("key <> ''")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return keyed.join(counts, "key").select("key", "n", *columns)
