"""Dashboard datasets, parameterised lookups and the portfolio questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreledger.functions.money import cents, money_avg, money_sum, money_total, round_half_up, safe_ratio
from acreledger.functions.scalars import EXPENSE_CATEGORIES, month_date
from acreledger.operators.joins import attach_all


def _by_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", month_date(F.col("month")))


# ------------------------------------------------------------ datasets
def fund_summary(gold_fund: DataFrame) -> DataFrame:
    return gold_fund.orderBy(F.desc("total_aum")).select(
        "fund_name", "strategy", "total_aum", "property_count", "total_invested", "current_portfolio_value",
        "unrealized_gain_loss", "investor_count", "total_commitments")


def fund_kpis(gold_fund: DataFrame) -> DataFrame:
    return gold_fund.agg(
        F.count(F.lit(1)).alias("fund_count"),
        money_total("total_aum").alias("total_aum"),
        money_total("total_invested").alias("total_invested"),
        money_total("current_portfolio_value").alias("total_portfolio_value"),
        money_total("unrealized_gain_loss").alias("total_gain_loss"),
        F.sum("investor_count").alias("total_investors"),
    )


def aum_by_strategy(gold_fund: DataFrame) -> DataFrame:
    return gold_fund.groupBy("strategy").agg(
        money_total("total_aum").alias("total_aum"), F.count(F.lit(1)).alias("fund_count")
    ).orderBy(F.desc("total_aum"))


def property_rows(gold_property: DataFrame) -> DataFrame:
    return _by_month(gold_property).orderBy("month").select(
        "property_name", "property_type", "fund_name", "month", "revenue", "expenses", "noi", "occupancy_rate")


def noi_trend(gold_property: DataFrame) -> DataFrame:
    return _by_month(gold_property).groupBy("month").agg(
        money_total("revenue").alias("total_revenue"),
        money_total("expenses").alias("total_expenses"),
        money_total("noi").alias("total_noi"),
    ).orderBy("month")


def gl_monthly(gold_gl: DataFrame) -> DataFrame:
    return _by_month(gold_gl).orderBy("month").select("fund_name", "category", "month", "total_amount", "transaction_count")


def gl_by_category(gold_gl: DataFrame) -> DataFrame:
    return gold_gl.groupBy("category").agg(
        money_total("total_amount").alias("total_amount"), F.sum("transaction_count").alias("total_transactions")
    ).orderBy(F.desc("total_amount"))


def top_properties(gold_property: DataFrame, k: int = 15) -> DataFrame:
    keys = ["property_name", "property_type", "fund_name"]
    return gold_property.groupBy(*keys).agg(
        money_sum("revenue").alias("total_revenue"),
        money_sum("noi").alias("total_noi"),
        money_avg("occupancy_rate").alias("avg_occupancy"),
    ).orderBy(F.desc("total_revenue"), *keys).limit(k)


def spend_trend(gold_gl: DataFrame) -> DataFrame:
    return _by_month(gold_gl).groupBy("month", "category").agg(money_total("total_amount").alias("total_amount"))


def volume_trend(gold_gl: DataFrame) -> DataFrame:
    return _by_month(gold_gl).groupBy("month").agg(F.sum("transaction_count").alias("transaction_count"))


# ------------------------------------------------------------ lookups with optional parameters
@dataclass(frozen=True)
class Lookup:
    """A parameterised read of a gold table: what it returns and which optional bounds it takes.

    ``bounds``: parameter -> (column, comparison, SQL type of the parameter). The
    DataFrame lookup and the SQL table function are both made from it.
    """

    name: str
    columns: tuple[str, ...]
    bounds: dict[str, tuple[str, str, str]]

    def read(self, gold: DataFrame, **given) -> DataFrame:
        rows = _by_month(gold) if "month" in self.columns else gold
        for parameter, value in given.items():
            column, comparison, kind = self.bounds[parameter]
            if value is not None:
                bound = F.lit(value).cast(kind)
                rows = rows.where(F.col(column) == bound if comparison == "=" else F.col(column) >= bound)
        return rows.select(*self.columns)

    def create(self, gold: DataFrame, view: str) -> None:
        """Register the table function over a view of the gold table; parameters have a p_ prefix, so that no column shadows them."""
        spark, types = gold.sparkSession, {f.name: f.dataType.simpleString() for f in gold.schema} | {"month": "date"}
        takes = ", ".join(f"p_{p} {kind} DEFAULT NULL" for p, (_, _, kind) in self.bounds.items())
        gives = ", ".join(f"{c} {types[c]}" for c in self.columns)
        reads = ", ".join(f"CAST({c} AS {types[c]}) AS {c}" for c in self.columns)
        holds = " AND ".join(f"coalesce({column} {comparison} p_{p}, p_{p} IS NULL)" for p, (column, comparison, _) in self.bounds.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({takes}) RETURNS TABLE({gives}) RETURN SELECT {reads} FROM {view} WHERE {holds}")


FUND_LOOKUP = Lookup("acre_fund_lookup", ("fund_name", "strategy", "total_aum", "property_count", "total_invested", "current_portfolio_value", "unrealized_gain_loss", "investor_count"),
                     {"strategy": ("strategy", "=", "STRING"), "min_aum": ("total_aum", ">=", "DOUBLE")})
PROPERTY_LOOKUP = Lookup("acre_property_lookup", ("property_name", "property_type", "fund_name", "month", "revenue", "expenses", "noi", "occupancy_rate"),
                         {"fund": ("fund_name", "=", "STRING"), "type": ("property_type", "=", "STRING"), "start": ("month", ">=", "DATE")})
LEDGER_LOOKUP = Lookup("acre_ledger_lookup", ("fund_name", "category", "month", "total_amount", "transaction_count", "avg_transaction_amount"),
                       {"fund": ("fund_name", "=", "STRING"), "category": ("category", "=", "STRING"), "start": ("month", ">=", "DATE")})


# ------------------------------------------------------------ the ten portfolio questions
def total_aum(gold_fund: DataFrame) -> DataFrame:
    return gold_fund.agg(money_total("total_aum").alias("total_aum"))


def fund_count(gold_fund: DataFrame, strategy: str) -> DataFrame:
    return gold_fund.where(F.col("strategy") == strategy).agg(F.count(F.lit(1)).alias("fund_count"))


def top_revenue(gold_property: DataFrame, k: int = 3) -> DataFrame:
    return gold_property.groupBy("property_id", "property_name").agg(
        money_sum("revenue").alias("total_revenue")).orderBy(F.desc("total_revenue"), "property_id").limit(k)


def category_spend(gold_gl: DataFrame, categories: list[str], year: int) -> DataFrame:
    return gold_gl.where(F.col("category").isin(categories) & (F.year("month") == year)).groupBy("category").agg(
        money_total("total_amount").alias("total_amount"))


def strategy_most_investors(gold_fund: DataFrame) -> DataFrame:
    return gold_fund.groupBy("strategy").agg(F.sum("investor_count").alias("investors")).orderBy(
        F.desc("investors"), "strategy").limit(1)


def avg_occupancy(properties: DataFrame) -> DataFrame:
    return properties.groupBy("property_type").agg(
        round_half_up(money_avg("occupancy_rate"), 6).alias("avg_occupancy"), F.count(F.lit(1)).alias("property_count"))


def monthly_revenue(gold_gl: DataFrame, year: int) -> DataFrame:
    return _by_month(gold_gl).where((F.year("month") == year) & (F.col("category") == "revenue")).groupBy("month").agg(
        money_total("total_amount").alias("revenue")).orderBy("month")


def negative_noi(gold_property: DataFrame, funds: DataFrame, strategy: str, expense_sign: int = -1) -> DataFrame:
    """Properties of one strategy whose revenue does not cover costs.

    Expense amounts are stored negative, so the answer needs revenue + expenses.
    """
    in_strategy = funds.where(F.col("strategy") == strategy).select("fund_id")
    noi = (cents("revenue") - F.lit(expense_sign) * cents("expenses"))
    return (
        gold_property.join(in_strategy, "fund_id", "left_semi")
        .groupBy("property_id", "property_name")
        .agg((F.sum(noi).cast("double") / F.lit(100.0)).alias("noi"))
        .where("noi < 0")
    )


def debt_service_share(gold_gl: DataFrame) -> DataFrame:
    spend = gold_gl.where(F.col("category").isin(EXPENSE_CATEGORIES)).agg(
        money_total(F.when(F.col("category") == "debt_service", F.col("total_amount")).otherwise(F.lit(0.0))).alias("debt_service"),
        money_total("total_amount").alias("total_spend"),
    )
    return spend.withColumn("share_pct", round_half_up(safe_ratio(F.col("debt_service"), F.col("total_spend")) * 100, 4))


def portfolio_summary(gold_fund: DataFrame, gold_property: DataFrame) -> DataFrame:
    """One-row overview of the whole portfolio (two one-row aggregates side by side)."""
    funds = gold_fund.agg(
        money_total("total_aum").alias("total_aum"), F.count(F.lit(1)).alias("fund_count"),
        F.sum("property_count").alias("property_count"), money_total("total_commitments").alias("total_commitments"),
    )
    pnl = gold_property.agg(money_total("revenue").alias("total_revenue"), money_total("noi").alias("total_noi"))
    return attach_all(funds, pnl)
