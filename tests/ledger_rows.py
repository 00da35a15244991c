"""Small landing tables for tests: five funds and ten properties in each tenant."""


def arenas(spark, n):
    return spark.range(n).selectExpr("concat('A', id) AS arena_id", "concat('Tenant ', id) AS arena_name", "'gold' AS tier", "TIMESTAMP '2020-01-01 00:00:00' AS created_at")


def funds(spark, start, end):
    return spark.range(start, end).selectExpr(
        "concat('F', id) AS fund_id", "concat('A', id DIV 5) AS arena_id", "concat('Fund ', id) AS fund_name", "CAST(2015 + id % 11 AS INT) AS vintage_year",
        "'Core' AS strategy", "8.0D AS target_return_pct", "CAST(1000000 + id AS DOUBLE) AS aum", "'active' AS status")


def investors(spark, n):
    return spark.range(n).selectExpr(
        "concat('I', id) AS investor_id", "concat('A', id % 4) AS arena_id", "concat('Investor ', id) AS investor_name", "'PENSION' AS type",
        "CAST(5000 + id AS DOUBLE) AS commitment_amount", "concat('F', (id % 4) * 5 + id % 5) AS fund_id", "'City' AS city", "'ST' AS state")


def properties(spark, n):
    return spark.range(n).selectExpr(
        "concat('P', id) AS property_id", "concat('A', id DIV 10) AS arena_id", "concat('F', (id DIV 10) * 5 + id % 5) AS fund_id", "concat('House ', id) AS property_name",
        "'1 Main St' AS address", "'City' AS city", "'ST' AS state", "'Office' AS property_type", "DATE '2020-01-01' AS acquisition_date",
        "CAST(1000000 AS DOUBLE) AS acquisition_price", "CAST(1100000 AS DOUBLE) AS current_valuation", "1000 AS square_footage", "0.9D AS occupancy_rate")


def ledger(spark, start, end):
    return spark.range(start, end).selectExpr(
        "concat('T', id) AS transaction_id", "concat('A', id % 4) AS arena_id", "concat('P', (id % 4) * 10 + id % 10) AS property_id",
        "concat('F', (id % 4) * 5 + id % 5) AS fund_id", "'4100' AS account_code", "'Rent' AS account_name", "'entry' AS description",
        "CAST(100 + id % 7 AS DOUBLE) AS amount", "date_add(DATE '2025-01-01', CAST(id % 300 AS INT)) AS transaction_date",
        "CASE id % 2 WHEN 0 THEN 'revenue' ELSE 'opex' END AS category", "true AS posted", "CAST(2025 AS INT) AS year",
        "month(date_add(DATE '2025-01-01', CAST(id % 300 AS INT))) AS month", "'memo' AS memo_text", "'R' AS reference_id", "CAST(NULL AS STRING) AS external_ref_id",
        "'USD' AS currency", "1.0D AS fx_rate_to_usd", "'approved' AS approval_status", "'U' AS approver_id", "DATE '2025-06-01' AS approval_date",
        "'CC-001' AS cost_center", "'D1' AS department_code", "'Party' AS counterparty_name", "'CP-1' AS counterparty_id")
