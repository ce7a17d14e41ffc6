"""Operators that keep one row of many, number rows, merge tables and guard writes. All are joins and windows.

Where a window partition could hold a large share of all rows, an aggregate is used instead: max_by and min_by combine
before the shuffle, row_number doesn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.runtime import materialize, release


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order; combines before the shuffle, so a hot key is no hot task."""
    kept = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in kept)).select(df.columns)


def keep_latest(df: DataFrame, keys: list[str], order: list[Column], inherit: list[str] = []) -> DataFrame:
    """The last row of each key; a null in an inherited column is filled from the latest row that has a value."""
    kept = [c for c in df.columns if c not in keys]
    by = F.struct(*order)
    filled = [F.max_by(c, F.when(F.col(c).isNotNull(), by)).alias(f"_{c}") for c in inherit]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*kept), by).alias("r"), *filled)
    return best.select(*keys, *((F.col(f"_{c}") if c in inherit else F.col(f"r.{c}")).alias(c) for c in kept)).select(df.columns)


def keep_newest_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n newest rows of each key. The rank limit is pushed below the shuffle by the optimizer."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def number_rows(df: DataFrame, order: list[str], start: Column | int = 0, name: str = "number", partitions: int | None = None) -> DataFrame:
    """Consecutive numbers in a total order, without gathering the rows in one task.

    Rows are range-partitioned by the order and written once with the number of their range; ranges, their sizes and the
    rows' places in them all come from what was written, so they agree whatever the plan samples or coalesces. A range's
    rows are numbered on their own and shifted by the sizes of the ranges before it, of which there are few."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    shift = F.lit(start) if isinstance(start, int) else start
    return ranged.withColumn("_row", inside).join(F.broadcast(before), "_part", "left").withColumn(name, F.col("_before") + F.col("_row") + shift).drop("_part", "_row", "_before")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], unions: list[str] = []) -> DataFrame:
    """old with the rows of new merged in: new values win where they are not null, array columns in unions are united."""
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *(F.col(c).alias(f"o_{c}") for c in values))
    n = new.select(*keys, *(F.col(c).alias(f"n_{c}") for c in values))

    def merged(c: str) -> Column:
        if c in unions:
            return F.array_sort(F.array_union(F.coalesce(f"o_{c}", F.array()), F.coalesce(f"n_{c}", F.array())))
        return F.coalesce(f"n_{c}", f"o_{c}")

    return o.join(n, keys, "full").select(*keys, *(merged(c).alias(c) for c in values)).select(old.columns)


def update(df: DataFrame, changes: DataFrame, key: str, allowed: dict[str, tuple | None]) -> tuple[DataFrame, DataFrame]:
    """(updated, refused): whitelisted columns of df set from changes(key, field, value); refused holds the changes to
    unknown fields, to values outside an enumeration, or of unknown rows."""
    known = F.lit(False)
    for field, values in allowed.items():
        known = known | ((F.col("field") == field) & (F.col("value").isin(*values) if values else F.lit(True)))
    fit = changes.withColumn("_ok", F.coalesce(known, F.lit(False)))
    good = fit.filter("_ok").drop("_ok")
    present = good.join(df.select(key), key, "left_semi")
    refused = fit.filter("not _ok").drop("_ok").unionByName(good.join(df.select(key), key, "left_anti"))
    wide = present.groupBy(key).agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}") for f in allowed))
    types = dict(df.dtypes)
    joined = df.join(wide, key, "left")
    return joined.select(*((F.coalesce(F.col(f"_{c}").try_cast(types[c]), F.col(c)).alias(c) if c in allowed else F.col(c)) for c in df.columns)), refused


def cascade_delete(parent: DataFrame, child: DataFrame, gone: DataFrame, key: str, foreign: str, how: str = "cascade") -> tuple[DataFrame, DataFrame]:
    """(parent, child) without the keys in gone; children are removed too, or keep a null reference (how='null')."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    left = parent.join(ids, parent[key] == ids["_gone"], "left_anti")
    if how == "cascade":
        return left, child.join(ids, child[foreign] == ids["_gone"], "left_anti")
    marked = child.join(ids, child[foreign] == ids["_gone"], "left")
    return left, marked.select(*((F.when(F.col("_gone").isNull(), child[foreign]).alias(c) if c == foreign else child[c]) for c in child.columns))


def guarded_insert(existing: DataFrame, new: DataFrame, unique: list[str], parent: DataFrame | None = None, parent_key: str | None = None, foreign: str | None = None) -> DataFrame:
    """The rows of new whose unique columns are not taken, by a row of existing or an earlier one of new, and whose parent exists."""
    out = keep_first(new, unique, [F.col(c) for c in new.columns]).join(existing, unique, "left_anti")
    return out.join(parent.select(F.col(parent_key).alias(foreign)).distinct(), foreign, "left_semi").select(new.columns) if parent is not None else out


def resolve_chain(df: DataFrame, key: str = "id", to: str = "merged_into") -> DataFrame:
    """key, root: the end of each row's chain of references, by pointer doubling.

    A reference to an unknown row ends the chain. A cycle has no end: it, and what leads into it, resolves to its least
    key. Every round doubles the length followed; it ends when all chains have, or when that length exceeds the rows,
    which only cycles outlast."""
    ids = df.select(F.col(key).alias("known"))
    links = df.select(F.col(key).alias("node"), F.col(to).alias("next"))
    links = links.join(ids, links["next"] == ids["known"], "left").select("node", F.coalesce("known", "node").alias("next"))
    links = materialize(links.withColumn("low", F.least("node", "next")), "chain")
    ends = links.filter("node = next").select(F.col("node").alias("next"), F.lit(True).alias("end"))
    ends = materialize(ends, "chain-ends")
    for _ in range(max(1, df.count().bit_length())):
        step = links.select(F.col("node").alias("next"), F.col("next").alias("after"), F.col("low").alias("low2"))
        new = materialize(links.join(step, "next").select("node", "next", "after", F.least("low", "low2").alias("low")), "chain")
        moved = new.filter("after <> next").limit(1).count()
        release(links)
        links = new.select("node", F.col("after").alias("next"), "low")
        if not moved:
            break
    cycle = links.select(F.col("node").alias("next"), F.col("low").alias("least"))
    return links.select("node", "next").join(ends, "next", "left").join(cycle, "next").select(F.col("node").alias(key), F.when(F.col("end"), F.col("next")).otherwise(F.col("least")).alias("root"))


def proportional(df: DataFrame, group: list[str], share: str, total: str, order: list[Column], scale: int = 0) -> DataFrame:
    """df with 'allotted': total split in proportion to share, rounded; the largest share takes what rounding leaves."""
    w = Window.partitionBy(*group)
    part = F.round(F.col(total) * F.col(share) / F.sum(share).over(w), scale)
    out = df.withColumn("allotted", part).withColumn("_first", F.row_number().over(w.orderBy(F.desc(share), *order)))
    drift = F.max(total).over(w) - F.sum("allotted").over(w)
    return out.withColumn("_drift", drift).withColumn("allotted", F.when(F.col("_first") == 1, F.col("allotted") + F.col("_drift")).otherwise(F.col("allotted"))).drop("_first", "_drift")
