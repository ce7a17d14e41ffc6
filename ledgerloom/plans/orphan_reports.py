"""Queries of problem 1: references to records that are missing, removed or late."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.orphans import OrphanState, orphans, replay, snapshot_counts
from ledgerloom.runtime import materialize, table

#: Where the history is cut into batches; any cuts give the same final state.
CUTS = ["2023-01-01", "2024-01-01", "2025-01-01", "2026-01-01"]
COLUMNS = {
    "quotations": ["id", "created_at", "loaded_at"],
    "jobs": ["id", "quotation_id", "created_at", "loaded_at"],
    "invoices": ["id", "quotation_id", "job_id", "created_at", "loaded_at"],
}


def _replay(spark: SparkSession, sf_dir: str, each=None) -> OrphanState:
    records = {name: table(spark, sf_dir, name).select(*columns) for name, columns in COLUMNS.items()}
    removals = table(spark, sf_dir, "removed_records").filter(F.col("table_name").isin(*COLUMNS))
    return replay(spark, records, removals, CUTS, each=each)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(_replay(spark, sf_dir)).select("table_name", "row_id", "field_name")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_counts(_replay(spark, sf_dir))


def p1_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts as they stood at each cut and at the end."""
    taken: list[DataFrame] = []

    def take(cut: str | None, state: OrphanState) -> None:
        taken.append(materialize(snapshot_counts(state).withColumn("as_of", F.lit(cut or "end")), "orphan-snapshot"))

    _replay(spark, sf_dir, take)
    return reduce(DataFrame.unionByName, taken)


def _sql(until: str | None) -> str:
    """Every orphan with its status, from all rows loaded and removals logged before the given instant."""
    cut = f"< TIMESTAMP '{until}'" if until else "IS NOT NULL"
    refs = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, id AS row_id, '{f}' AS field_name, '{p}' AS parent, max({f}) AS parent_id, min(loaded_at) AS ref_loaded, min(created_at) AS created_at FROM {t} WHERE loaded_at {cut} AND id IS NOT NULL AND {f} IS NOT NULL AND {f} <> 0 GROUP BY id"
        for t, f, p in (("invoices", "quotation_id", "quotations"), ("invoices", "job_id", "jobs"), ("jobs", "quotation_id", "quotations"))
    )
    loads = " UNION ALL ".join(f"SELECT '{t}' AS parent, id AS parent_id, min(loaded_at) AS first_loaded, max(loaded_at) AS last_loaded FROM {t} WHERE loaded_at {cut} GROUP BY id" for t in ("quotations", "jobs"))
    return f"""
    SELECT r.table_name, r.row_id, r.field_name, r.created_at,
           CASE WHEN l.first_loaded IS NULL THEN 'missing' WHEN d.last_removed IS NOT NULL AND l.last_loaded <= d.last_removed THEN 'removed'
                WHEN l.first_loaded > r.ref_loaded THEN 'late' END AS status
    FROM ({refs}) r LEFT JOIN ({loads}) l ON r.parent = l.parent AND r.parent_id = l.parent_id
    LEFT JOIN (SELECT table_name, record_id, max(removed_at) AS last_removed FROM removed_records WHERE removed_at {cut} GROUP BY 1, 2) d
      ON r.parent = d.table_name AND r.parent_id = d.record_id"""


def _counts_sql(until: str | None, extra: str = "") -> str:
    return f"SELECT table_name, field_name, status, strftime(created_at, '%Y-%m') AS month, count(*) AS n{extra} FROM ({_sql(until)}) WHERE status IS NOT NULL GROUP BY 1, 2, 3, 4"


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p1_snapshots": p1_snapshots}
SQL = {
    "p1_found": f"SELECT table_name, row_id, field_name FROM ({_sql(None)}) WHERE status IS NOT NULL",
    "p1_counts": _counts_sql(None),
    "p1_snapshots": " UNION ALL ".join(_counts_sql(c, f", '{c or 'end'}' AS as_of") for c in [*CUTS, None]),
}
