"""The medallion update: raw entities -> silver -> gold, as written tables.

Readers of gold (workload, dashboards, lookups) then scan small clustered
Parquet tables with pushed-down tenant and month filters.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from acreledger.plans import fund_metrics, gold, latency, pcap, silver
from acreledger.session import RELEASE, settings
from acreledger.sources.storage import shared_dir
from acreledger.sources.writers import write_clustered, write_parquet, write_sorted

# Layout columns of the large tables.  Tenant and date prune; the
# last column lets the range partitioner split a tenant that holds most rows.
CLUSTERING = {
    "silver_gl_transactions": ["arena_id", "transaction_date", "transaction_id"],
    "gold_property_financials": ["arena_id", "month", "property_id"],
    "gold_gl_monthly_summary": ["arena_id", "month", "fund_id"],
    "gold_fund_attribution_period": ["fund_id", "period_id", "property_id"],
    "gold_investor_pcap": ["investor_id", "fund_id", "period_id"],
}
# Fixed value: of these, tables that come out of a dedupe spread by their key; sorted files do, another shuffle of all rows is spared.
SPREAD = {"silver_gl_transactions"}
# Fixed value: the same for tables that come out of joins on their leading columns; sorted row groups still prune.
GROUPED = {"gold_investor_pcap", "gold_fund_attribution_period"}


class Lakehouse:
    """Tables written once per session and input, then read back.

    A lost executor costs nothing but re-reading files.
    """

    _built: dict[str, dict[str, StructType]] = {}
    _lock = threading.RLock()

    def __init__(self, spark: SparkSession, raw: Mapping[str, DataFrame], input_id: str, as_of: str, report_as_of: str | None = None):
        self.spark, self.raw, self.as_of, self.report_as_of = spark, raw, as_of, report_as_of or as_of
        tag = hashlib.md5(f"{input_id}|{as_of}|{self.report_as_of}".encode()).hexdigest()[:12]
        self.root = f"{shared_dir(spark)}/acreledger/{spark.sparkContext.applicationId}/{tag}"

    def recipes(self) -> Mapping[str, Callable[[], DataFrame]]:
        t = self.table
        return {
            "silver_arenas": lambda: silver.arenas(self.raw["arenas"]),
            "silver_funds": lambda: silver.funds(self.raw["funds"]),
            "silver_investors": lambda: silver.investors(self.raw["investors"]),
            "silver_properties": lambda: silver.properties(self.raw["properties"]),
            "silver_gl_transactions": lambda: silver.gl_transactions(self.raw["gl_raw"]),
            "gold_fund_performance": lambda: gold.fund_performance(
                t("silver_funds"), t("silver_properties"), t("silver_investors")),
            "silver_gl_monthly": lambda: gold.ledger_base(t("silver_gl_transactions"), self.as_of),
            "gold_property_financials": lambda: gold.property_financials(
                t("silver_properties"), t("silver_funds"), self.ledger()),
            "gold_investor_portfolio": lambda: gold.investor_portfolio(t("silver_investors"), t("silver_funds")),
            "gold_gl_monthly_summary": lambda: gold.gl_monthly_summary(self.ledger(), t("silver_funds")),
            "gold_arena_overview": lambda: gold.arena_overview(
                t("silver_arenas"), t("silver_funds"), t("silver_properties"), t("silver_investors"),
                self.ledger(), self.as_of),
            "gold_fund_attribution_period": lambda: fund_metrics.attribution_period(self.raw, self.report_as_of),
            "gold_investor_pcap": lambda: pcap.investor_pcap(self.raw),
            "benchmark_summary": lambda: latency.summary_lockstep(self.raw["benchmark_raw"]),
        }

    def ledger(self) -> DataFrame:
        """What ledger rollups read: the monthly base where it is written, else the ledger, which folds to their grain before it moves."""
        base = "silver_gl_monthly"
        return self.table(base if base in self._built.get(self.root, {}) else "silver_gl_transactions")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        with self._lock:
            built = self._built.setdefault(self.root, {})
            if name not in built:
                df = self.recipes()[name]()
                keys = CLUSTERING.get(name)
                with settings(self.spark, RELEASE):
                    if name in SPREAD | GROUPED:
                        write_sorted(df, self.path(name), keys)
                    elif keys:
                        write_clustered(df, self.path(name), keys)
                    else:
                        write_parquet(df, self.path(name))
                built[name] = df.schema
        return self.spark.read.schema(built[name]).parquet(self.path(name))

    def update(self) -> dict[str, str]:
        """Build every table once; returns name -> path."""
        for name in self.recipes():
            self.table(name)
        return {name: self.path(name) for name in self.recipes()}
