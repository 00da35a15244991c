"""Publishing: snapshot diff, change application, reconciliation, key checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreledger.operators.joins import attach_all


def snapshot_diff(old: DataFrame, new: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Classify every key: insert, update, delete or unchanged.

    Values of the new snapshot are carried along (NULL for deletes).  Columns
    are compared null-safely one by one, so no hash collision can hide a change.
    """
    values = [c for c in new.columns if c not in pk]
    o = old.select(*[F.col(c).alias(f"__o_{c}") for c in [*pk, *values]]).withColumn("__old", F.lit(True))
    n = new.withColumn("__new", F.lit(True))
    cond = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__o_{c}") for c in pk])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in values], F.lit(True))
    change = (
        F.when(F.col("__old").isNull(), "insert")
        .when(F.col("__new").isNull(), "delete")
        .when(same, "unchanged")
        .otherwise("update")
    )
    keys = [F.coalesce(F.col(c), F.col(f"__o_{c}")).alias(c) for c in pk]
    return n.join(o, cond, "full_outer").select(*keys, *values, change.alias("change_type"))


def apply_changes(old: DataFrame, changes: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Old snapshot with inserts, updates and deletes applied on the key."""
    touched = changes.where(F.col("change_type") != "unchanged")
    kept = old.join(touched.select(*pk), list(pk), "left_anti")
    fresh = touched.where(F.col("change_type") != "delete").select(*old.columns)
    return kept.unionByName(fresh)


def reconcile(source: dict[str, DataFrame], target: dict[str, DataFrame | None]) -> DataFrame:
    """(table_name, source_rows, target_rows, status) for every source table.

    A target that is absent is 'skipped'; unequal counts are 'mismatch'.
    """
    out = []
    for name, df in source.items():
        one = df.agg(F.count(F.lit(1)).alias("source_rows"))
        tgt = target.get(name)
        if tgt is None:
            row = one.withColumn("target_rows", F.lit(None).cast("long"))
        else:
            row = attach_all(one, tgt.agg(F.count(F.lit(1)).alias("target_rows")))
        status = (
            F.when(F.col("target_rows").isNull(), "skipped")
            .when(F.col("source_rows") == F.col("target_rows"), "ok")
            .otherwise("mismatch")
        )
        out.append(row.select(F.lit(name).alias("table_name"), "source_rows", "target_rows", status.alias("status")))
    return reduce(DataFrame.unionByName, out)


def require_reconciled(report: DataFrame) -> DataFrame:
    """Pass the report through; a mismatch fails the job that reads it."""
    message = F.concat(F.lit("row counts differ for "), F.col("table_name"))
    return report.withColumn(
        "status", F.when(F.col("status") == "mismatch", F.raise_error(message)).otherwise(F.col("status")))


def pk_violations(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*pk).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def key_report(df: DataFrame, name: str, pk: Sequence[str]) -> DataFrame:
    """One row: the table's name, its distinct keys, its rows and how many keys have several rows."""
    counted = df.groupBy(*pk).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count_if(F.col("n") > 1).alias("duplicate_keys")).select(
        F.lit(name).alias("table_name"), "keys", "row_count", "duplicate_keys")
