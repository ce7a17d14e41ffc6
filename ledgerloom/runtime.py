"""Session, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "ledgerloom", memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a single JVM may go without: it gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, at.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Folders written inside the scratch scopes that are open, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def materialize(df: DataFrame, label: str, by: list[str] = []) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there, so a lost executor costs nothing."""
    at = f"{shared_dir(df.sparkSession)}/ledgerloom/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(at)
    if _scopes.get():
        _scopes.get()[-1].append(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Delete what materialize() wrote for df, once nothing reads it any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/ledgerloom/" in folder:
            head, tail = folder.split("/ledgerloom/", 1)
            delete(df.sparkSession, f"{head}/ledgerloom/{tail.split('/')[0]}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A scope at whose end all that materialize() wrote inside is deleted; what the yielded function writes stays.

    An operator wraps its rounds in it and returns keep(result, label), so only its result takes room afterwards."""
    mine: list[str] = []
    token = _scopes.set((*_scopes.get(), mine))

    def keep(df: DataFrame, label: str) -> DataFrame:
        kept = materialize(df, label)
        at = mine.pop()
        if len(_scopes.get()) > 1:
            _scopes.get()[-2].append(at)
        return kept

    try:
        yield keep
    finally:
        _scopes.reset(token)
        for at in mine:
            delete(spark, at)


@contextmanager
def outside() -> Iterator[None]:
    """What materialize() writes inside belongs to no open scope: for callbacks of an operator's caller."""
    token = _scopes.set(())
    try:
        yield
    finally:
        _scopes.reset(token)
