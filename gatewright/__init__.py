"""gatewright: quality rules, findings and gates as Spark DataFrame queries."""
