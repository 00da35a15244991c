"""Registration of queries together with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from acreledger.plans.lakehouse import Lakehouse
from acreledger.session import input_listing
from acreledger.testbed.binding import BINDINGS, with_ctes
from acreledger.testbed.tables import Tables

AS_OF = "2001-11-01"          # end of the ledger
STAR_AS_OF = "2000-12-31"     # reporting date of the fund report
LO, HI = "1998-01-01", "1998-03-31"  # statement quarter
TENANT = "ARN-00009"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# oracle-side definitions beyond the shared bindings
DEFS: dict[str, str] = {}


class Context:
    """What a registered query may read: bound tables and the built lakehouse."""

    _tables: dict[tuple, Tables] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        # changed input files make new tables
        listing = input_listing(spark, sf_dir)[1]
        key = (id(spark), spark.sparkContext.applicationId, sf_dir, listing)
        if key not in self._tables:
            self._tables[key] = Tables(spark, sf_dir)
        self.t = self._tables[key]
        self.lake = Lakehouse(spark, self.t, f"{self.t.sf_dir}|{listing}", AS_OF, STAR_AS_OF)

    def gold(self, name: str) -> DataFrame:
        return self.lake.table(f"gold_{name}")

    def silver(self, name: str) -> DataFrame:
        return self.lake.table(f"silver_{name}")


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Context], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Context(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql.strip(), {**BINDINGS, **DEFS})
        return fn

    return register


def define(name: str, sql: str) -> None:
    DEFS[name] = sql.strip()


# ---- oracle-side snippets
def c(x: str, scale: str = "100e0") -> str:
    return f"CAST(floor(({x}) * {scale} + 5e-1) AS BIGINT)"


def msum(x: str) -> str:
    return f"CAST(SUM({c(x)}) AS DOUBLE) / 100e0"


def mwhere(x: str, cond: str) -> str:
    return msum(f"CASE WHEN {cond} THEN {x} ELSE 0e0 END")


def mavg(x: str, scale: str = "100e0") -> str:
    return f"CAST(SUM({c(x, scale)}) AS DOUBLE) / CAST(COUNT({x}) AS DOUBLE) / {scale}"


def rnd(x: str, digits: int) -> str:
    return f"floor(({x}) * {10**digits}e0 + 5e-1) / {10**digits}e0"
