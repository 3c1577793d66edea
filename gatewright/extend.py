"""Rules brought by a user."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.reporting.findings import union_findings
from gatewright.schema import as_findings, seq_of


class Rules:
    """Rules by id: a function from a facts table to findings, or a text detector."""

    def __init__(self) -> None:
        self._rules: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, rule_id: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        """`fn` works on whole tables, so Spark plans it like a built-in rule."""
        if rule_id in self._rules:
            raise ValueError(f"rule {rule_id} is registered already")
        self._rules[rule_id] = fn

    def register_udtf(self, rule_id: str, detector, id_col: str = "doc_id", text_col: str = "text",
                      severity: str = "Warning") -> None:
        """`detector` is a Python UDTF: one text in, rows (line_no, member) out."""

        def run(df: DataFrame) -> DataFrame:
            hits = df.select(id_col, F.col(text_col).alias("__text")).lateralJoin(
                detector(F.col("__text").outer())
            )
            return as_findings(
                hits, rule_id=rule_id, target=F.col(id_col).cast("string"), severity=severity,
                seq=seq_of(F.col(id_col), F.col("line_no"), 1_000_000),
            )

        self.register(rule_id, run)

    def run(self, facts: DataFrame) -> DataFrame:
        """All registered rules over one facts table, as one findings table."""
        return union_findings([
            as_findings(fn(facts), rule_id=rule_id) for rule_id, fn in self._rules.items()
        ])
