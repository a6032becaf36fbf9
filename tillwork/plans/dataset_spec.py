"""A dataset as configuration that becomes one lazy DataFrame."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.functions.casts import exported
from tillwork.operators import filters


@dataclass(frozen=True)
class JoinSpec:
    """One secondary table on one equi-key."""

    table: str
    primary_key: str = "id"
    secondary_key: str | None = None
    how: str = "left"


@dataclass(frozen=True)
class DatasetSpec:
    """Primary table, joins, columns, roles, and filters.

    Tables are joined first, so that filters may name columns of any of them (``table.column``; a plain name is
    one of the primary table). Filters are applied in a fixed order: date, category and numeric filters first;
    entity filters (top revenue, counts, sums) see that filtered base when a date filter is set, else the whole
    primary table.
    """

    primary: str
    joins: Sequence[JoinSpec] = ()
    columns: Mapping[str, Sequence[str]] = field(default_factory=dict)
    aliases: Mapping[str, str] = field(default_factory=dict)
    roles: Mapping[str, str] = field(default_factory=dict)
    timestamp: str | None = None
    rolling_days: int | None = None
    start_date: str | None = None
    categories: Sequence[Mapping] = ()
    numerics: Sequence[Mapping] = ()
    dates: Sequence[Mapping] = ()
    top_revenue: Sequence[Mapping] = ()
    entity_metrics: Sequence[Mapping] = ()

    def to_json(self) -> str:
        """Snapshot to keep beside the output table."""
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> DatasetSpec:
        raw = json.loads(text)
        raw["joins"] = tuple(JoinSpec(**j) for j in raw["joins"])
        return DatasetSpec(**raw)

    # -- filters ------------------------------------------------------------------------------------------

    def _at(self, ref: str) -> str:
        """Working name of ``column`` (of the primary table) or ``table.column``."""
        table, _, column = ref.rpartition(".")
        return f"{table or self.primary}__{column}"

    @staticmethod
    def _named(table: str, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{table}__{c}") for c in df.columns])

    def _joined(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """All tables side by side; columns that nothing asks for are pruned by the optimizer."""
        main = self._named(self.primary, tables[self.primary])
        for j in self.joins:
            side = self._named(j.table, tables[j.table])
            match = F.col(self._at(j.primary_key)) == F.col(f"{j.table}__{j.secondary_key or j.primary_key}")
            main = main.join(side, match, j.how)
        return main

    def _row_filtered(self, df: DataFrame, primary: DataFrame) -> DataFrame:
        ts = self._at(self.timestamp) if self.timestamp else None
        if self.rolling_days is not None:
            df = filters.rolling_days(df, ts, self.rolling_days, anchor=primary)
        if self.start_date is not None:
            df = filters.start_date(df, ts, self.start_date)
        for f in self.categories:
            df = filters.category(df, self._at(f["column"]), f["values"], f.get("exclude", False))
        for f in self.numerics:
            df = filters.numeric(df, **{**f, "column": self._at(f["column"])})
        whole = df
        for f in self.dates:
            column = self._at(f["column"])
            if "days" in f:
                source = primary if column in primary.columns else whole
                latest_of = source.select(F.max(column)).scalar()
                cond = F.col(column) >= latest_of - F.expr(f"INTERVAL {int(f['days'])} DAYS")
                df = df.where(F.col(column).isNull() | cond if f.get("include_nulls") else cond)
            else:
                df = filters.date_fixed(df, **{**f, "column": column})
        return df

    def _filtered(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """Joined and filtered rows under their working names.

        With a date filter, revenue and counts of entities are taken from the joined rows that the row filters
        leave; without one, from the whole primary table (from all joined rows, if they need a joined column).
        """
        primary = self._named(self.primary, tables[self.primary])
        joined = self._joined(tables)
        out = self._row_filtered(joined, primary)
        dated = self.rolling_days is not None or self.start_date is not None
        rows = out

        def base(*columns: str) -> DataFrame:
            return rows if dated else primary if set(columns) <= set(primary.columns) else joined

        for f in self.top_revenue:
            entity, amount = self._at(f["entity"]), self._at(f["amount"])
            out = filters.top_revenue(out, entity, amount, f["percent"], base=base(entity, amount))
        for f in self.entity_metrics:
            named = {**f, **{k: self._at(f[k]) for k in ("entity", "amount") if f.get(k)}}
            out = filters.entity_metric(out, base=base(*[named[k] for k in ("entity", "amount") if named.get(k)]), **named)
        return out

    def filtered(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """The primary table's columns of the rows that all filters leave."""
        return self._filtered(tables).select(*[F.col(self._at(c)).alias(c) for c in tables[self.primary].columns])

    # -- columns ------------------------------------------------------------------------------------------

    def _names(self) -> list[tuple[str, str, str]]:
        """(table, column, output name); a repeated name gets its table in front, an alias wins."""
        seen: set[str] = set()
        out = []
        for table, cols in self.columns.items():
            for c in cols:
                name = c if c not in seen else f"{table}_{c}"
                seen.add(c)
                name = self.aliases.get(f"{table}_{c}", self.aliases.get(f"{table}.{c}", name))
                out.append((table, c, name))
        return out

    def to_df(self, tables: Mapping[str, DataFrame], for_analysis: bool = False, for_export: bool = False,
              nullable: Sequence[str] = ()) -> DataFrame:
        """The dataset. ``for_export``: times become epoch seconds, and columns that a left join or the source
        (``nullable``, as table.column) may leave empty get their type's default; arrays stay as they are."""
        if not self.columns:
            return self.filtered(tables)
        main = self._filtered(tables)
        role_of = {column: role for role, column in self.roles.items()} if for_analysis else {}
        left = {j.table for j in self.joins if "left" in j.how}
        cols = []
        for table, c, name in self._names():
            if for_analysis and table == self.primary and c in role_of:
                name = role_of[c]
            value = F.col(f"{table}__{c}")
            if for_export:
                value = exported(value, tables[table].schema[c].dataType, table in left or f"{table}.{c}" in nullable)
            cols.append(value.alias(name))
        return main.select(*cols)
