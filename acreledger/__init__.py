"""Multi-tenant fund-accounting analytics on Spark."""
