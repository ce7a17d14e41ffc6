"""Queries of problem 2: spellings of one client's or supplier's name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.names import link
from ledgerloom.runtime import table


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = table(spark, sf_dir, "quotations").select("client_name").union(table(spark, sf_dir, "invoices").select("client_name"))
    return clients.select(F.lit("client").alias("kind"), F.col("client_name").alias("name")).union(table(spark, sf_dir, "suppliers").select(F.lit("supplier"), "name")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = link(_names(spark, sf_dir))
    return groups.alias("a").join(groups.alias("b"), F.expr("a.kind = b.kind and a.group = b.group and a.name < b.name")).select("a.kind", F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct name with the first name of its group."""
    groups = link(_names(spark, sf_dir))
    first = groups.groupBy("group").agg(F.min("name").alias("group_name"), F.count("*").alias("n_names"))
    return groups.join(first, "group").select("kind", "name", "group_name", "n_names")


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
SQL: dict[str, str] = {}
