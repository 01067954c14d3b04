"""Clauses (any, one, or) and the filters of each family, as Column predicates that reach the scan."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryTooBroad

MAX_OR_TERMS = 128


@dataclass(frozen=True)
class Clause:
    """``values`` None: any value, absent ones too.  Else the column is present and one of ``values``; none match ()."""

    values: tuple | None = None

    @staticmethod
    def any() -> Clause:
        return Clause()

    @staticmethod
    def one(value) -> Clause:
        return Clause((value,))

    @staticmethod
    def any_of(values) -> Clause:
        return Clause(tuple(values))

    @property
    def indexed(self) -> bool:
        return self.values is not None

    def predicate(self, column: Column) -> Column | None:
        if self.values is None:
            return None
        if not self.values:
            return F.lit(False)
        return column == self.values[0] if len(self.values) == 1 else column.isin(list(self.values))


ANY = Clause()


class _Filter:
    flags: tuple[str, ...] = ()

    def _clauses(self) -> dict[str, Clause]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in self.flags}

    def indexed(self) -> bool:
        return any(c.indexed for c in self._clauses().values())

    def widest(self) -> int:
        return max((len(c.values) for c in self._clauses().values() if c.indexed), default=0)

    def check_width(self, maximum: int = MAX_OR_TERMS) -> None:
        if self.indexed() and self.widest() > maximum:
            raise QueryTooBroad(self.widest(), maximum)

    def predicate(self) -> Column:
        parts = [p for name, c in self._clauses().items() if (p := c.predicate(F.col(name))) is not None]
        parts += [F.col(name) == F.lit(getattr(self, name)) for name in self.flags if getattr(self, name) is not None]
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.where(self.predicate())


@dataclass(frozen=True)
class LogFilter(_Filter):
    address: Clause = ANY
    topic0: Clause = ANY
    topic1: Clause = ANY
    topic2: Clause = ANY
    topic3: Clause = ANY


@dataclass(frozen=True)
class TxFilter(_Filter):
    from_addr: Clause = ANY
    to_addr: Clause = ANY
    selector: Clause = ANY


@dataclass(frozen=True)
class TraceFilter(_Filter):
    from_addr: Clause = ANY
    to_addr: Clause = ANY
    selector: Clause = ANY
    is_top_level: bool | None = None
    has_value: bool | None = None
    flags: tuple[str, ...] = field(default=("is_top_level", "has_value", "flags"), init=False, repr=False)

    def indexed(self) -> bool:
        """A wanted value has an index of its own; top level, or no value, has none."""
        return super().indexed() or self.has_value is True

    def predicate(self) -> Column:
        parts = [p for name, c in self._clauses().items() if (p := c.predicate(F.col(name))) is not None]
        parts += [F.col(n) == F.lit(v) for n, v in (("is_top_level", self.is_top_level), ("has_value", self.has_value)) if v is not None]
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def page(rows: DataFrame, where: _Filter, id_col: str, limit: int, from_block: int | None = None, to_block: int | None = None, after: int | None = None, descending: bool = False) -> DataFrame:
    """At most ``limit`` matching rows in id order behind ``after``: keyset paging, planned as a distributed top-n."""
    if from_block is not None:
        rows = rows.where(F.col("block_num") >= from_block)
    if to_block is not None:
        rows = rows.where(F.col("block_num") <= to_block)
    if after is not None:
        rows = rows.where(F.col(id_col) < after if descending else F.col(id_col) > after)
    return where.apply(rows).orderBy(F.desc(id_col) if descending else F.asc(id_col)).limit(limit)


def prefix_page(rows: DataFrame, column: str, prefix: str, after: str | None, limit: int) -> DataFrame:
    """(key): at most ``limit`` distinct values with a prefix, in order, beyond ``after``; the bounds reach the scan."""
    key = F.col(column)
    wanted = key.startswith(prefix) if after is None else key.startswith(prefix) & (key > after)
    return rows.where(wanted).select(key.alias("key")).distinct().orderBy("key").limit(limit)
