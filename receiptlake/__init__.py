"""Quality control of nested cash-register receipts on Spark."""
