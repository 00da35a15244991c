"""Row counts and broken references of a set of tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, keys: list[str], parent: DataFrame) -> DataFrame:
    """One row: how many child rows name a parent that isn't there. Keys are counted first, so a hot key meets the parent as one row."""
    named = child.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return named.join(parent.select(*keys).distinct(), keys, "left_anti").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("value"))


def integrity_report(tables: dict[str, DataFrame], links: Iterable[tuple[str, list[str], str]]) -> DataFrame:
    """(check_name, value): rows of each table, and orphans of each link (child, keys, parent). A NULL key is an orphan."""
    checks = {f"rows_{name}": df.agg(F.count(F.lit(1)).alias("value")) for name, df in tables.items()}
    checks |= {f"orphans_{child}_{'_'.join(keys)}": orphans(tables[child], keys, tables[parent]) for child, keys, parent in links}
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("check_name"), "value") for name, df in checks.items()])
