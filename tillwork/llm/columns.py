"""Columns of the user under names that no helper column can clash with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Aside:
    """The rows of ``docs`` with their columns renamed by position (``rows``), and the way back."""

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.rows = docs.toDF(*[f"_c{i}" for i in range(len(self.columns))])

    def name(self, column: str) -> str:
        """Where a column of ``docs`` is found in ``rows``; names are compared as Spark does."""
        return f"_c{[c.lower() for c in self.columns].index(column.lower())}"

    def back(self, *but: str) -> list:
        """The columns under their own names, without those that have a name in ``but``."""
        return [F.col(f"_c{i}").alias(c) for i, c in enumerate(self.columns) if c.lower() not in but]
