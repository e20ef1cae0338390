"""The model of a stream: rows with an explicit order, keys and arrival times."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.plans.prefix import scan


@dataclass(frozen=True)
class Stream:
    """Rows in the order of a unique key, each of ``by`` a stream of its own.

    arrival names a column of whole microseconds since the stream's start. All operators assume a sink
    that is always ready. Without ``by`` the whole table is one sequence in a numeric order. Folds, runs, samples, delays,
    pulses, intervals and index merges then take a two-pass prefix scan (``plans.prefix``); time windows, throttles,
    valves and the operators that call a Python function for each row in turn hold the sequence in one task.
    """

    df: DataFrame
    order_by: str
    by: Sequence[str] = field(default_factory=tuple)
    arrival: str | None = None

    def scan(self, **columns: tuple[str, Column]) -> Stream:
        """With running columns (how, value) in the stream's order; see ``plans.prefix.scan``."""
        return self.having(scan(self.df, self.order_by, columns, self.by))

    def apply(self, operator: Callable[..., Any], *args: Any, **options: Any) -> Any:
        """operator(self, ...): operators in the order in which they are applied."""
        return operator(self, *args, **options)

    def window(self, *more: Column | str) -> WindowSpec:
        """Rows of a key in order."""
        return Window.partitionBy(*self.by, *more).orderBy(self.order_by)

    def running(self, *more: Column | str) -> WindowSpec:
        """The same, from the first row to the current one."""
        return self.window(*more).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def having(self, df: DataFrame) -> Stream:
        return replace(self, df=df)

    def position(self, name: str = "rn") -> Stream:
        """With the position of each row, from 1."""
        return self.scan(**{name: ("count", F.lit(1))})


def over(operator: Callable[..., DataFrame], *args: Any, order_by: str, by: Sequence[str] = (), arrival: str | None = None, **options: Any) -> Callable[[DataFrame], DataFrame]:
    """An operator as a function of a table, for ``df.transform(over(timing.pulse, 20_000, order_by="seq", arrival="a"))``."""
    return lambda df: operator(Stream(df, order_by, tuple(by), arrival), *args, **options)


def micros(ts: Column | str, start_us: int = 0) -> Column:
    """Microseconds of a timestamp (without zone: as UTC in a UTC session) since ``start_us``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp")) - F.lit(start_us)


def cell(arrival: str, interval_us: int) -> Column:
    """Index of the interval of the grid that starts at 0; whole numbers throughout."""
    return F.expr(f"`{arrival}` div {int(interval_us)}L")
