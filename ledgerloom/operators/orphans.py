"""References to records that do not exist, kept as incremental keyed state.

The state is two tables that only ever merge by minimum and maximum, so the result does not depend on how the
history is cut into batches, on the order in which a batch's rows come, or on how often a batch is fed:

* ``index``: one row per parent key with its first and last load and its last removal;
* ``refs``: one row per reference with its own first load and its status.

Both are kept in buckets of neighbouring parent ids (sources/buckets.py). ``advance`` finds the buckets that a batch
touches, by its references or by its loads and removals of parents, and reads, judges and writes those and no others: new
references probe the index, an arriving parent resolves waiting orphans, a removal reopens settled references. One
pointer commits both tables, so a batch that dies leaves the state as it was, and may be fed again.

Both tables hold one row per key, so a hot parent is hot only on the probing side of a join whose other side is
unique per key; adaptive execution splits such a partition without changing the result, and a bucket is written by as
many tasks as it needs. ``span``, the ids of a bucket, must leave thousands of buckets at most; the driver lists them.

Edge cases: a reference that is null or 0 is no reference; a row without id, or without load time, tells nothing and
is left out; repeated rows and repeated removals merge; a row delivered with two different parents is two references;
removals of records never seen make an index row that is never loaded; empty batches leave the state as it was;
further columns of the input are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.runtime import materialize, outside, scratch, shared_dir
from ledgerloom.sources.buckets import BucketStore


@dataclass(frozen=True)
class Reference:
    table: str
    field: str
    parent: str


#: Every reference the store declares.
REFERENCES = (
    Reference("invoices", "quotation_id", "quotations"),
    Reference("invoices", "job_id", "jobs"),
    Reference("jobs", "quotation_id", "quotations"),
)

RESOLVED, MISSING, REMOVED, LATE = "resolved", "missing", "removed", "late"
INDEX = "parent string, parent_id bigint, first_loaded timestamp_ntz, last_loaded timestamp_ntz, last_removed timestamp_ntz"
REFS = "table_name string, row_id bigint, field_name string, parent string, parent_id bigint, ref_loaded timestamp_ntz, created_at timestamp_ntz, status string"
KEY, ROW = ["parent", "parent_id"], ["table_name", "row_id", "field_name"]
SPAN = 1 << 14


@dataclass(frozen=True)
class OrphanState:
    """The state at a folder; another process finds it there again."""

    store: BucketStore
    span: int

    @property
    def index(self) -> DataFrame:
        return self.store.read("index")

    @property
    def refs(self) -> DataFrame:
        return self.store.read("refs")


def state_at(spark: SparkSession, root: str, span: int = SPAN) -> OrphanState:
    return OrphanState(BucketStore(spark, root, {"index": INDEX, "refs": REFS}), span)


def empty_state(spark: SparkSession, span: int = SPAN) -> OrphanState:
    return state_at(spark, f"{shared_dir(spark)}/ledgerloom/orphans-{uuid.uuid4().hex}", span)


def _ntz(name: str) -> Column:
    return F.col(name).cast("timestamp_ntz")


def parent_changes(records: dict[str, DataFrame], removals: DataFrame) -> DataFrame:
    """Loads and removals of a batch as index rows, one per key."""
    removed = removals.select(F.col("table_name").alias("parent"), F.col("record_id").alias("parent_id"), *(F.lit(None).cast("timestamp_ntz").alias(c) for c in ("first_loaded", "last_loaded")), _ntz("removed_at").alias("last_removed"))
    rows = removed.filter("parent_id is not null and parent is not null and last_removed is not null")
    for name, df in sorted(records.items()):
        loads = df.filter("id is not null and loaded_at is not null").select(F.lit(name).alias("parent"), F.col("id").alias("parent_id"), _ntz("loaded_at").alias("first_loaded"), _ntz("loaded_at").alias("last_loaded"), F.lit(None).cast("timestamp_ntz").alias("last_removed"))
        rows = rows.unionByName(loads)
    return merge_index(rows)


def merge_index(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy(*KEY, *more).agg(F.min("first_loaded").alias("first_loaded"), F.max("last_loaded").alias("last_loaded"), F.max("last_removed").alias("last_removed"))


def merge_refs(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy(*ROW, *KEY, *more).agg(F.min("ref_loaded").alias("ref_loaded"), F.min("created_at").alias("created_at"), F.max("status").alias("status"))


def batch_references(records: dict[str, DataFrame], references: tuple[Reference, ...] = REFERENCES) -> DataFrame | None:
    """The references of a batch; all references of a table come from one scan of it."""
    out = None
    for name in sorted({r.table for r in references} & set(records)):
        own = [r for r in references if r.table == name]
        made = F.array(*(F.struct(F.lit(r.field).alias("field_name"), F.lit(r.parent).alias("parent"), F.col(r.field).cast("bigint").alias("parent_id")) for r in own))
        rows = records[name].filter("id is not null and loaded_at is not null").select(
            F.lit(name).alias("table_name"), F.col("id").alias("row_id"), _ntz("loaded_at").alias("ref_loaded"), _ntz("created_at").alias("created_at"), F.explode(made).alias("r")
        )
        rows = rows.select("table_name", "row_id", "r.*", "ref_loaded", "created_at").filter("parent_id is not null and parent_id <> 0")
        out = rows if out is None else out.unionByName(rows)
    return out


def judge() -> Column:
    """Status of a reference from its own first load and its parent's index row (null columns where there is none)."""
    return (
        F.when(F.col("first_loaded").isNull(), MISSING)
        .when(F.col("last_removed").isNotNull() & (F.col("last_loaded") <= F.col("last_removed")), REMOVED)
        .when(F.col("first_loaded") > F.col("ref_loaded"), LATE)
        .otherwise(RESOLVED)
    )


def advance(state: OrphanState, records: dict[str, DataFrame], removals: DataFrame, references: tuple[Reference, ...] = REFERENCES) -> OrphanState:
    """Merge a batch of loaded records and logged removals into the state; only the buckets it touches are read and written."""
    bucket = F.concat_ws("-", "parent", F.floor(F.col("parent_id") / state.span).cast("string")).alias("bucket")
    spark = removals.sparkSession
    with scratch(spark):
        delta = materialize(parent_changes(records, removals).select("*", bucket), "orphan-delta")
        fresh = batch_references(records, references)
        fresh = spark.createDataFrame([], REFS + ", bucket string") if fresh is None else fresh.withColumn("status", F.lit(None).cast("string")).select("*", bucket)
        fresh = materialize(merge_refs(fresh, "bucket"), "orphan-fresh")
        touched = sorted(r["bucket"] for r in delta.select("bucket").union(fresh.select("bucket")).distinct().collect())
        if touched:
            index = merge_index(state.store.read("index", touched).select("*", bucket).unionByName(delta), "bucket")
            refs = merge_refs(state.store.read("refs", touched).select("*", bucket).unionByName(fresh), "bucket")
            index = materialize(index, "orphan-index")
            judged = refs.join(index.drop("bucket"), KEY, "left").withColumn("status", judge()).select(*refs.columns)
            state.store.commit({"index": index, "refs": judged}, touched)
    return state


def replay(spark: SparkSession, records: dict[str, DataFrame], removals: DataFrame, cuts: list[str], references: tuple[Reference, ...] = REFERENCES, each=None) -> OrphanState:
    """Run the whole history through advance(), cut by load and removal time at the given instants.

    The inputs are routed to their batches once. each(cut, state) is called after every batch, which is where periodic
    snapshots are taken."""
    state, edges = empty_state(spark), [*cuts, None]

    def routed(df: DataFrame, at: str, label: str) -> DataFrame:
        late = reduce(lambda n, cut: n + F.when(F.col(at) >= F.lit(cut).cast("timestamp_ntz"), 1).otherwise(0), cuts, F.lit(0))
        return materialize(df.filter(F.col(at).isNotNull()).withColumn("batch", late), label, ["batch"])

    with scratch(spark):
        loads = {k: routed(v, "loaded_at", f"orphan-{k}") for k, v in records.items()}
        gone = routed(removals, "removed_at", "orphan-removals")
        for i, cut in enumerate(edges):
            state = advance(state, {k: v.filter(F.col("batch") == i).drop("batch") for k, v in loads.items()}, gone.filter(F.col("batch") == i).drop("batch"), references)
            state.store.prune(1)
            if each is not None:
                with outside():
                    each(cut, state)
    return state


def orphans(state: OrphanState) -> DataFrame:
    return state.refs.filter(F.col("status") != RESOLVED)


def snapshot_counts(state: OrphanState) -> DataFrame:
    """Orphans per table, field, status and month of the referring record's created_at."""
    month = F.date_format(F.col("created_at"), "yyyy-MM").alias("month")
    return orphans(state).groupBy("table_name", "field_name", "status", month).agg(F.count("*").alias("n"))
