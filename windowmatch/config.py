"""Names of the columns and tables a search works on."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class SearchColumns:
    """Column names, passed to every operator; nothing below hard-codes them."""

    sid: str = "sid"
    time: str = "datetime"
    exchange: str = "exchangeCD"
    match: tuple[str, ...] = ("open", "high", "low", "close")
    begin: str = "begintime"
    end: str = "endtime"
    period: str = "period"
    namespace: str | None = None
    table: str | None = None

    def with_match(self, *columns: str) -> SearchColumns:
        if not columns:
            raise ValueError("at least one match column is needed")
        return replace(self, match=tuple(columns))

    def with_table(self, table: str, namespace: str | None = None) -> SearchColumns:
        return replace(self, table=table, namespace=namespace)

    @property
    def window_key(self) -> tuple[str, str, str]:
        """Primary key of a windows table."""
        return (self.sid, self.begin, self.end)

    @property
    def qualified_table(self) -> str:
        if self.table is None:
            raise ValueError("no table configured")
        return f"{self.namespace}.{self.table}" if self.namespace else self.table

    def time_order(self, bars: DataFrame) -> list[str]:
        """Order of the bars inside one security: time, then exchange if there is one."""
        return [self.time] + [c for c in (self.exchange,) if c in bars.columns]

    def bar_key(self, bars: DataFrame) -> list[str]:
        """Primary key of a bars table."""
        return [self.sid, *self.time_order(bars)]

    def describe(self) -> str:
        """The settings in one line."""
        place = self.qualified_table if self.table else "no table"
        return f"{place}: windows of {', '.join(self.match)} by {self.sid} over {self.time}"
