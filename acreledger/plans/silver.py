"""Typed, validated entities from raw rows.  Each function maps DataFrame to
DataFrame and works on batch and streaming input alike (the ledger is batch:
its dedupe needs the full set). ``seen`` names the metrics under which a stream
reports how many rows broke each rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreledger.functions.scalars import cast_or_null, is_expense
from acreledger.operators.aggregates import dedupe
from acreledger.operators.predicates import expect_or_drop

# Row rules per entity (rows that break one are dropped).
RULES = {
    "arenas": {"valid_arena_id": "arena_id IS NOT NULL"},
    "funds": {"valid_fund_id": "fund_id IS NOT NULL", "valid_arena_id": "arena_id IS NOT NULL"},
    "investors": {"valid_investor_id": "investor_id IS NOT NULL", "valid_arena_id": "arena_id IS NOT NULL"},
    "properties": {"valid_property_id": "property_id IS NOT NULL", "valid_arena_id": "arena_id IS NOT NULL"},
    "gl_transactions": {
        "valid_transaction_id": "transaction_id IS NOT NULL",
        "valid_amount": "amount IS NOT NULL",
        "valid_arena_id": "arena_id IS NOT NULL",
    },
}


def arenas(raw: DataFrame, seen: str | None = None) -> DataFrame:
    typed = raw.withColumns({"arena_id": F.col("arena_id").cast("string"), "arena_name": F.col("arena_name").cast("string")})
    return expect_or_drop(typed, RULES["arenas"], seen)


def funds(raw: DataFrame, seen: str | None = None) -> DataFrame:
    typed = raw.withColumns({
        "arena_id": F.col("arena_id").cast("string"),
        "aum": cast_or_null(F.col("aum"), "double"),
        "strategy": F.lower("strategy"),
    })
    return expect_or_drop(typed, RULES["funds"], seen)


def investors(raw: DataFrame, seen: str | None = None) -> DataFrame:
    typed = raw.withColumns({
        "arena_id": F.col("arena_id").cast("string"),
        "commitment_amount": cast_or_null(F.col("commitment_amount"), "double"),
        "type": F.lower("type"),
    })
    return expect_or_drop(typed, RULES["investors"], seen)


def properties(raw: DataFrame, seen: str | None = None) -> DataFrame:
    price = cast_or_null(F.col("acquisition_price"), "double")
    value = cast_or_null(F.col("current_valuation"), "double")
    typed = raw.withColumns({
        "arena_id": F.col("arena_id").cast("string"),
        "acquisition_price": price,
        "current_valuation": value,
        "square_footage": cast_or_null(F.col("square_footage"), "int"),
        "occupancy_rate": cast_or_null(F.col("occupancy_rate"), "double"),
        "unrealized_gain": value - price,
    })
    return expect_or_drop(typed, RULES["properties"], seen)


def gl_conform(raw: DataFrame) -> DataFrame:
    """Types, fiscal parts and expense flag (of rows with a category), without the dedupe.

    Landing partition columns (`year`, `month`) are dropped: `month` means the
    month start from gold on.
    """
    day = F.to_date("transaction_date")
    typed = raw.drop("year", "month").withColumns({
        "arena_id": F.col("arena_id").cast("string"),
        "amount": cast_or_null(F.col("amount"), "double"),
        "transaction_date": day,
        "fiscal_year": F.year(day),
        "fiscal_quarter": F.quarter(day),
        **({"is_expense": is_expense(F.col("category"))} if "category" in raw.columns else {}),
    })
    return expect_or_drop(typed, RULES["gl_transactions"])


# Fixed value: what the monthly rollups read of the ledger.
MEASURED = ["transaction_id", "arena_id", "property_id", "fund_id", "amount", "transaction_date", "category"]

# Fixed value: what a count of the kept rows reads of it, the columns of the rules and the dedupe's order.
COUNTED = ["transaction_id", "arena_id", "amount", "transaction_date"]


def gl_transactions(raw: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rules first (less to shuffle), then one row per transaction_id.

    ``columns``: raw columns that are wanted, those that rules and typing read among
    them; all if none are named. The raw ledger is read once, it may be a join.
    """
    bad = RULES["gl_transactions"]
    return gl_conform(dedupe(expect_or_drop(raw, bad), "transaction_id", ["transaction_date", "amount"], columns, counted=False))
