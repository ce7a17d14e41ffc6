"""Structured Streaming over files: event-time windows, sessions, upserts by identity and orphan tracking.

Each function runs what is there (availableNow) and returns the sink as a table, so the same code serves a scheduled
batch and, with another trigger, a continuous run. State and offsets live in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.orphans import OrphanState, advance, state_at
from ledgerloom.operators.records import keep_latest
from ledgerloom.runtime import materialize, scratch, shared_dir
from ledgerloom.sources.buckets import BucketStore, pointed


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the parquet files at path (a folder, or one file)."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input into files, and read them."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/ledgerloom/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def window_counts(events: DataFrame, length: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """start, event_type, n, total per window; windows the watermark has passed, and so complete."""
    w = F.window("ts", length)
    return _drain(events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "0 seconds") -> DataFrame:
    """user_id, start, end, n per session of events with no pause as long as the gap."""
    w = F.session_window("ts", gap)
    return _drain(events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))


def upsert_stream(stream: DataFrame, target: str, keys: list[str], order: list[str], buckets: int = 64) -> DataFrame:
    """Keep at target the latest row per key of all micro-batches; re-running over the same input changes nothing.

    The target is kept in buckets of the keys' hash (their number is fixed by the first run), and a batch reads and writes
    those it touches. Offsets lie beside it, and the pointer that makes a batch live is the last thing it writes: a batch
    that dies leaves no trace and is run again."""
    spark = stream.sparkSession
    store = BucketStore(spark, target, {"rows": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)})
    n = (pointed(spark, target) or {}).get("buckets", buckets)

    def merge(batch: DataFrame, number: int) -> None:
        if number > 0 and pointed(spark, target) is None:
            raise FileNotFoundError(f"offsets say that batches were merged into {target}, but nothing was ever committed there")
        bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("string").alias("bucket")
        with scratch(spark):
            new = materialize(keep_latest(batch, keys, [F.col(c) for c in order]).select("*", bucket), "upsert-batch")
            touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
            merged = keep_latest(store.read("rows", touched).select("*", bucket).unionByName(new), [*keys, "bucket"], [F.col(c) for c in order])
            store.commit({"rows": merged}, touched, buckets=n)
        store.prune()

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{target}/_state").trigger(availableNow=True).start().awaitTermination()
    return store.read("rows")


def track_orphans(records: dict[str, DataFrame], removals: DataFrame, root: str | None = None) -> OrphanState:
    """Feed streams of records and removals to the orphan state at root, a micro-batch at a time.

    State and offsets both lie at root, so a run that dies is taken up where it was; batches merge by minimum and maximum,
    so one that was committed and is fed again changes nothing."""
    spark = removals.sparkSession
    root = root or f"{shared_dir(spark)}/ledgerloom/orphans-{uuid.uuid4().hex}"
    state = state_at(spark, root)
    none = {name: spark.createDataFrame([], s.schema) for name, s in records.items()}
    no_removals = spark.createDataFrame([], removals.schema)

    def feed(name: str | None):
        def step(batch: DataFrame, _: int) -> None:
            advance(state, none if name is None else none | {name: batch}, batch if name is None else no_removals)
            state.store.prune()

        return step

    for name, stream in [*records.items(), (None, removals)]:
        stream.writeStream.foreachBatch(feed(name)).option("checkpointLocation", f"{root}/_offsets/{name or 'removals'}").trigger(availableNow=True).start().awaitTermination()
    return state


def import_pages(pages: DataFrame, root: str) -> BucketStore:
    """Keep the elements read from drawing pages, as they arrive, in a store at root by file; a page that comes again
    replaces itself, and a run that dies is taken up where it was. finish_import reconciles the complete set."""
    spark = pages.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    store = BucketStore(spark, root, {"elements": schema})

    def merge(batch: DataFrame, _: int) -> None:
        bucket = F.pmod(F.xxhash64("file"), F.lit(64)).cast("string").alias("bucket")
        with scratch(spark):
            new = materialize(batch.select("*", bucket), "import-pages")
            touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
            old = store.read("elements", touched).select("*", bucket).join(new.select("file", "page").distinct(), ["file", "page"], "left_anti").select(*new.columns)
            store.commit({"elements": old.unionByName(new)}, touched)
        store.prune()

    pages.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/_offsets").trigger(availableNow=True).start().awaitTermination()
    return store


def finish_import(store: BucketStore) -> DataFrame:
    from ledgerloom.operators.drawings import reconcile

    return reconcile(store.read("elements"))


def corrected_stream(items: DataFrame, corrections: DataFrame) -> DataFrame:
    """A stream of re-read items with the corrections made to earlier readings of them replayed, run to its end."""
    from ledgerloom.operators.corrections import apply_corrections

    return _drain(apply_corrections(items, corrections))
