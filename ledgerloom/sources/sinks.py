"""Sinks: staged tables with a checked swap, content-addressed blobs, render-ready rows."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.runtime import delete
from ledgerloom.sources.buckets import point, pointed


def publish(df: DataFrame, root: str, expected: int | None = None) -> str:
    """Write df as a new version under root and point root's readers at it, if its rows are as many as expected.

    A pointer is a small file renamed to a name of its own, and the highest name is the live one: readers see the old
    version or the new one, never a part and never none."""
    spark = df.sparkSession
    version = f"v{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{root}/{version}")
    n = spark.read.parquet(f"{root}/{version}").count()
    if expected is not None and n != expected:
        delete(spark, f"{root}/{version}")
        raise ValueError(f"{n} rows were written, {expected} expected; the live version stays")
    point(spark, root, {"version": version, "rows": n})
    return version


def published(spark: SparkSession, root: str) -> DataFrame:
    live = pointed(spark, root)
    if live is None:
        raise FileNotFoundError(f"nothing was ever published at {root}")
    return spark.read.parquet(f"{root}/{live['version']}")


def blobs(df: DataFrame, column: str = "bytes") -> DataFrame:
    """ref, path, bytes: one row per content, addressed by its digest and sharded by its first two digits."""
    ref = F.sha2(F.col(column), 256)
    return df.filter(F.col(column).isNotNull()).groupBy(ref.alias("ref")).agg(F.first(column).alias("bytes")).select("ref", F.concat(F.left("ref", F.lit(2)), F.lit("/"), "ref").alias("path"), "bytes")


def orphan_blobs(stored: DataFrame, live: list[DataFrame]) -> DataFrame:
    """Stored refs that no live table names; refused where the live tables name none at all."""
    refs = live[0].select("ref")
    for more in live[1:]:
        refs = refs.union(more.select("ref"))
    refs = refs.filter("ref is not null").distinct()
    if not refs.limit(1).count():
        raise ValueError("no live reference at all: refusing to call every blob an orphan")
    return stored.join(refs, "ref", "left_anti")


def document_rows(lines: DataFrame, vat_rate: str = "0.05") -> DataFrame:
    """Render-ready lines of documents(doc_id, line_no, description, unit, qty, rate): name, specification, and amounts."""
    from ledgerloom.functions.text import spec_lines, title_line

    net = (F.col("qty").cast("decimal(18,4)") * F.col("rate").cast("decimal(18,4)")).cast("decimal(28,6)")
    vat = F.lit(vat_rate).cast("decimal(5,4)")
    return lines.select("doc_id", "line_no", title_line(F.col("description")).alias("name"), spec_lines(F.col("description")).alias("specs"), "unit", "qty", "rate", F.round(net * vat, 2).alias("vat"), F.round(net * (1 + vat), 2).alias("line_total"))


def document_summary(rows: DataFrame, discounts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_lines, subtotal, discount, vat, grand_total of document_rows: the block under the lines.

    discounts(doc_id, discount_type, discount_value) takes a 'percent' of the net or an amount off, never more than the net;
    vat falls by the same share."""
    net = F.sum(F.col("line_total") - F.col("vat"))
    one = rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), net.alias("subtotal"), F.sum("vat").alias("_vat"))
    one = one.join(discounts.select("doc_id", "discount_type", "discount_value"), "doc_id", "left") if discounts is not None else one.withColumns({"discount_type": F.lit(None).cast("string"), "discount_value": F.lit(None).cast("decimal(18,4)")})
    value = F.greatest(F.coalesce("discount_value", F.lit(0)), F.lit(0))
    off = F.when(F.lower("discount_type").startswith("percent"), F.col("subtotal") * value / 100).otherwise(F.when(F.col("discount_type").isNotNull(), value).otherwise(0))
    one = one.withColumn("discount", F.round(F.least(off, F.col("subtotal")), 2))
    vat = F.round(F.when(F.col("subtotal") > 0, F.col("_vat") * (1 - F.col("discount") / F.col("subtotal"))).otherwise(0), 2)
    return one.withColumn("vat", vat).select("doc_id", "n_lines", "subtotal", "discount", "vat", (F.col("subtotal") - F.col("discount") + F.col("vat")).alias("grand_total"))


def data_uri_bytes(uri: Column) -> Column:
    """The bytes of a base64 data URI; null for any other text."""
    return F.when(uri.rlike(r"^data:[^,]*;base64,"), F.try_to_binary(F.regexp_extract(uri, r"^data:[^,]*;base64,(.*)$", 1), F.lit("base64")))


def refs_for_images(items: Column, field: str = "image") -> Column:
    """JSON items with every data URI in a field replaced by the digest of its bytes; other items and fields stay as they are."""
    from ledgerloom.functions.items import elements

    image = lambda x: F.get_json_object(x, f"$.{field}")
    swapped = lambda x: F.when(data_uri_bytes(image(x)).isNotNull(), F.replace(x, image(x), F.sha2(data_uri_bytes(image(x)), 256))).otherwise(x)
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(elements(items), lambda x: swapped(F.coalesce(x, F.lit("null")))), ","), F.lit("]")), items)


def appended_cards(card: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(card with the fit rows of new, refused rows with their reason): a code is needed and must be new, a cost positive."""
    from ledgerloom.operators.records import keep_first

    coded = new.withColumn("code", F.upper(F.trim(F.coalesce("code", F.lit("")))))
    reason = F.when(F.col("code") == "", "no code").when(~F.coalesce(F.col("avg_cost") > 0, F.lit(False)), "no cost")
    judged = coded.withColumn("reason", reason)
    fit = judged.filter("reason is null").drop("reason")
    fresh = keep_first(fit, ["code"], [F.col(c) for c in fit.columns]).join(card.select(F.upper(F.trim("code")).alias("code")), "code", "left_anti").select(card.columns)
    taken = fit.join(fresh.select("code"), "code", "left_anti").withColumn("reason", F.lit("code exists"))
    return card.unionByName(fresh), judged.filter("reason is not null").unionByName(taken)


def backfilled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns derived where they are missing or null: what a change of schema does to older rows."""
    return df.withColumns({n: F.coalesce(F.col(n), c) if n in df.columns else c for n, c in columns.items()})
