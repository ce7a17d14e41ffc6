"""Tables kept in buckets, of which a change rewrites only those it touches.

A store is a folder. A commit writes the touched buckets of its tables to a new folder and then renames one small pointer
file into place, under a name no other commit has; the pointer with the highest name is the live one. Readers see the
state before a commit or after it, never a part and never none; a commit that dies leaves files that no pointer names.

The pointer lists a folder per bucket, and the driver the buckets of a batch: choose a bucket's width so that there are
thousands of them at most, however many rows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fs_path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def point(spark: SparkSession, root: str, content: dict) -> int:
    """Make content the live pointer under root; its number."""
    number = max((n for n, _ in pointers(spark, root)), default=0) + 1
    tmp, fs = fs_path(spark, f"{root}/_pointers/_tmp-{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    final, _ = fs_path(spark, f"{root}/_pointers/p{number:012d}.json")
    if fs.exists(final) or not fs.rename(tmp, final):
        fs.delete(tmp, False)
        raise RuntimeError(f"another writer has committed to {root}")
    return number


def pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, path) of the pointers under root, the live one last."""
    folder, fs = fs_path(spark, f"{root}/_pointers")
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder)]
    return sorted((int(p.getName()[1:13]), p.toString()) for p in found if p.getName().startswith("p"))


def pointed(spark: SparkSession, root: str) -> dict | None:
    """What the live pointer says; None where nothing was ever committed."""
    found = pointers(spark, root)
    if not found:
        return None
    path, fs = fs_path(spark, found[-1][1])
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


class BucketStore:
    """Tables of given schemas, each without its column bucket, under one pointer."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas

    def state(self) -> dict[str, dict[str, str]]:
        return (pointed(self.spark, self.root) or {}).get("tables", {})

    def read(self, table: str, buckets: list[str] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets."""
        parts = self.state().get(table, {})
        folders = sorted({f for b, f in parts.items() if buckets is None or b in set(buckets)})
        if not folders:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*folders)

    def commit(self, changes: dict[str, DataFrame], touched: list[str], **said) -> int:
        """Replace the touched buckets of each table by the rows of its DataFrame, which has a column bucket."""
        tables = {t: dict(p) for t, p in self.state().items()}
        for table, rows in changes.items():
            at = f"{self.root}/{table}-{uuid.uuid4().hex}"
            rows.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(at)
            folder, fs = fs_path(self.spark, at)
            made = {s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(folder) if s.isDirectory()}
            live = tables.setdefault(table, {})
            for b in touched:
                if b in made:
                    live[b] = f"{at}/bucket={b}"
                else:
                    live.pop(b, None)
        return point(self.spark, self.root, {"tables": tables, **said})

    def prune(self, keep: int = 2) -> None:
        """Delete older pointers than the last `keep`, and folders that none of those names."""
        found = pointers(self.spark, self.root)
        if not found:
            return
        kept = set()
        for _, path in found[-keep:]:
            at, fs = fs_path(self.spark, path)
            stream = fs.open(at)
            parts = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["tables"]
            stream.close()
            kept |= {f.rsplit("/", 2)[1] for p in parts.values() for f in p.values()}
        for _, path in found[:-keep]:
            at, fs = fs_path(self.spark, path)
            fs.delete(at, False)
        folder, fs = fs_path(self.spark, self.root)
        for s in fs.listStatus(folder):
            name = s.getPath().getName()
            if name.split("-")[0] in self.schemas and name not in kept:
                fs.delete(s.getPath(), True)
