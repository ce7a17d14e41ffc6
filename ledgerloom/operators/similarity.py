"""Nearest neighbours over stored vectors, exact and distributed.

The query side and the corpus side are each cut into blocks of about BLOCK_ROWS rows, so their numbers grow with the
data; a pair of blocks is one task, which multiplies two matrices and keeps the k best per query, and the k best of all
blocks are merged by an aggregate. Nothing is broadcast and a task holds two blocks, whatever the two sides' sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 8192  # queries multiplied at once
BLOCK_ROWS = 50_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity_percent(squared_distance: Column) -> Column:
    """Cosine of unit vectors, from their squared distance, as a percentage with one decimal; 0 for null."""
    cos = F.lit(1.0) - squared_distance.cast("double") / 2
    return F.when(squared_distance.isNull(), 0.0).otherwise(F.round((F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos)) * 100).cast("decimal(18,6)"), 1).cast("double"))


def _blocks(df: DataFrame, id_col: str, vector: str, n: int, name: str) -> DataFrame:
    return df.filter(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias(name), F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, id, score (cosine), rank: the k most similar corpus rows of every query, itself excluded; ties go to the lower id."""
    nq, nc = (max(least, -(-df.count() // block_rows)) for df, least in ((queries, 4), (corpus, 8)))
    q = _blocks(queries, id_col, vector, nq, "q").select("*", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("c")).select("q", "c", "id", "v")
    c = _blocks(corpus, id_col, vector, nc, "c").select("*", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q")).select("q", "c", "id", "v")

    def unit(rows: pd.DataFrame) -> np.ndarray:
        m = np.array(rows["v"].tolist(), dtype=np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm > 0, norm, 1)

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        right = right.sort_values("id")
        ids, matrix, out = right["id"].to_numpy(), unit(right), []
        for start in range(0, len(left), BLOCK):
            part = left.iloc[start : start + BLOCK]
            scores = np.round(unit(part) @ matrix.T, 9)
            own = part["id"].to_numpy()[:, None] == ids[None, :]
            scores[own] = -np.inf
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(part["id"].to_numpy(), top.shape[1]), "id": ids[top].ravel(), "score": np.take_along_axis(scores, top, 1).ravel()}))
        found = pd.concat(out)
        return found[np.isfinite(found["score"])]

    best = q.groupBy("q", "c").cogroup(c.groupBy("q", "c")).applyInPandas(match, "query_id bigint, id bigint, score double")
    ranked = best.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("top"))
    return ranked.select("query_id", F.posexplode("top").alias("at", "t")).select("query_id", "t.id", (-F.col("t.s")).alias("score"), (F.col("at") + 1).alias("rank"))


def crossfill(items: DataFrame, lowest: float = 0.70, firm: float = 0.82) -> DataFrame:
    """id, donor, score, label for items (id, image_ref, embedding, service): the most similar item with an image, for every
    one without that isn't a service; 'matched' from firm on, 'suggested' from lowest on."""
    have = items.filter("coalesce(image_ref, '') <> ''").withColumnRenamed("id", "vec_id")
    need = items.filter("coalesce(image_ref, '') = '' and not service").withColumnRenamed("id", "vec_id")
    best = nearest(need, have, 1).filter(F.col("score") >= lowest)
    return best.select(F.col("query_id").alias("id"), F.col("id").alias("donor"), "score", F.when(F.col("score") >= firm, "matched").otherwise("suggested").alias("label"))


def mean_pool(rows: DataFrame, keys: list[str], vector: str, mask: str | None = None) -> DataFrame:
    """keys, pooled: the mean of each key's unmasked vectors, brought to length 1; a mean of zeros stays as it is.

    Sums are taken per dimension and combine before the shuffle. Null vectors and rows masked out (0, false or null) are
    left out; a key without any other has no row."""
    kept = rows.filter(F.col(vector).isNotNull())
    kept = kept.filter(F.coalesce(F.col(mask).cast("int"), F.lit(0)) > 0) if mask else kept
    each = kept.select(*keys, F.posexplode(vector).alias("_at", "_x")).groupBy(*keys, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    mean = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_m"))), lambda s: s["_m"]).alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    return mean.withColumn("_n", norm).select(*keys, F.transform("_v", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(x)).alias("pooled"))


def stale_vectors(items: DataFrame, stored: DataFrame, key: str = "id", version: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """(kept, stale): stored vectors whose item is as it was when they were made, and items that need theirs made anew."""
    same = (items[key] == stored[key]) & items[version].eqNullSafe(stored[version])
    return stored.join(items, same, "left_semi"), items.join(stored, same, "left_anti")


def search(queries: DataFrame, library: DataFrame, as_of: Column, markup: float = 0.04, k: int = 5) -> DataFrame:
    """query_id, rank, id, similarity (percent), rate, adjusted_rate, years: the k nearest of library(vec_id, embedding,
    rate, quote_date), their rates carried forward to as_of."""
    from ledgerloom.functions.dates import elapsed_years
    from ledgerloom.operators.ledgers import uplifted

    best = nearest(queries, library, k).withColumnRenamed("id", "vec_id")
    told = best.join(library.drop("embedding"), "vec_id").withColumn("years", elapsed_years(F.col("quote_date"), as_of))
    percent = similarity_percent(2 - 2 * F.col("score"))
    return told.select("query_id", "rank", F.col("vec_id").alias("id"), percent.alias("similarity"), "rate", F.round(uplifted(F.col("rate"), F.col("years"), markup), 2).alias("adjusted_rate"), "years")


def semantic_rung(lines: DataFrame, catalog: DataFrame, matched: DataFrame, lowest: float = 0.72) -> DataFrame:
    """line_id, id, rung 4 for the lines that no earlier rung matched: the nearest catalogue vector, if near enough."""
    open_ = lines.join(matched.select("line_id"), "line_id", "left_anti").withColumnRenamed("line_id", "vec_id")
    best = nearest(open_, catalog, 1).filter(F.col("score") >= lowest)
    return best.select(F.col("query_id").alias("line_id"), "id", F.lit(4).alias("rung"))
