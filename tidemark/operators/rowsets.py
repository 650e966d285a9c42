"""Relational operations over tables of five-state values.

A rowset is a DataFrame, the values of its fields and the column that tells its rows apart. Scalars of one rowset are
added in one projection and aggregates of one group in one aggregation; windows over the same partition and order share
one specification, so Catalyst plans one exchange and sort for them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.errors import CalculationError, fail_where
from tidemark.functions import exact
from tidemark.functions.values import MISSING, NULL, NUMERIC, PRESENT, STALE, UNAVAILABLE, Value, _quantised, field

EXTREMES = (*NUMERIC, "date", "timestamp", "duration")


@dataclass(frozen=True)
class Key:
    """A sort key: field, direction and the place of absent values."""

    name: str
    descending: bool = False
    absent_first: bool = False


@dataclass(frozen=True)
class Rowset:
    df: DataFrame
    fields: dict[str, Value]
    row_id: str
    total_order: tuple | None = None

    def __getitem__(self, name: str) -> Value:
        if name not in self.fields:
            raise CalculationError("missing_field", name)
        return self.fields[name]

    def order(self, keys: list[Key]) -> list[Column]:
        """Absent values together (unavailable, missing, null), then present before stale, then by value, then by row."""
        found = []
        for key in keys:
            value = self[key.name]
            if value.state is None:
                c = value.payload
                found.append((c.desc_nulls_first() if key.absent_first else c.desc_nulls_last()) if key.descending else (c.asc_nulls_first() if key.absent_first else c.asc_nulls_last()))
                continue
            absent = value.payload.isNull()
            found.append(absent.desc() if key.absent_first else absent.asc())
            found.append(F.when(value.states == UNAVAILABLE, 0).when(value.states == MISSING, 1).when(value.states == NULL, 2).otherwise(0).asc())
            found.append((value.states == STALE).asc())
            found.append(value.payload.desc() if key.descending else value.payload.asc())
        return [*found, F.col(self.row_id).asc()]

    def select(self, **projections: Value) -> Rowset:
        """Named values over the same rows; the order certificate goes."""
        columns, fields = [F.col(self.row_id)], {}
        for name, value in projections.items():
            columns.append(value.payload.cast(value.kind).alias(name))
            if value.state is not None:
                columns.append(value.states.cast("int").alias(f"{name}__st"))
            fields[name] = replace(field(name, value.scalar, value.scale, value.state is not None), unit=value.unit, currency=value.currency, grain=value.grain)
        return Rowset(self.df.select(*columns), fields, self.row_id)

    def filter(self, predicate: Value) -> Rowset:
        if predicate.scalar != "boolean":
            raise CalculationError("type_mismatch")
        return replace(self, df=self.df.where(predicate.payload))

    def sort(self, *keys: Key) -> Rowset:
        order = self.order(list(keys))
        return replace(self, df=self.df.orderBy(*order), total_order=tuple(keys))

    def top_k(self, k: int) -> Rowset:
        if self.total_order is None:
            raise CalculationError("type_mismatch", "top_k needs sorted rows")
        return replace(self, df=self.df.limit(k))

    def group(self, *names: str) -> Group:
        return Group(self, names)

    # --- windows -----------------------------------------------------------------------------------------------

    def over(self, partition: list[str], keys: list[Key]) -> WindowSpec:
        by = [c for n in partition for c in ([self[n].payload] if self[n].state is None else [self[n].payload, self[n].states])]
        return Window.partitionBy(*by).orderBy(*self.order(keys))

    def rank(self, partition: list[str], keys: list[Key]) -> Value:
        return Value(F.row_number().over(self.over(partition, keys)).cast("bigint"), "integer")

    def lag(self, name: str, partition: list[str], keys: list[Key], offset: int = 1) -> Value:
        """Before a partition's start there is nothing: missing, not null."""
        value, w = self[name], self.over(partition, keys)
        return replace(value, payload=F.lag(value.payload, offset).over(w), state=F.lag(value.states.cast("int"), offset, MISSING).over(w))

    def delta(self, name: str, partition: list[str], keys: list[Key], offset: int = 1, scale: int = 2, rounding: str = "half_even") -> Value:
        from tidemark.functions.values import subtract

        return subtract(self[name], self.lag(name, partition, keys, offset), scale, rounding)

    def percentage_change(self, name: str, partition: list[str], keys: list[Key], offset: int = 1, scale: int = 2, rounding: str = "half_even") -> Value:
        from tidemark.functions.values import _merged

        value, before = self[name], self.lag(name, partition, keys, offset)
        if value.scalar not in NUMERIC:
            raise CalculationError("type_mismatch")
        n = ((value.coefficient() - before.coefficient()) * 100).cast(exact.WHOLE)
        d = fail_where(value.computable & before.computable & (before.payload == 0), "divide_by_zero", before.coefficient(), exact.WHOLE)
        return Value(exact.ratio(n, d, scale, rounding), "decimal", _merged([value, before]), scale, "%", None, value.grain)

    def _framed(self, name: str, partition: list[str], keys: list[Key], preceding: int, following: int) -> tuple[Column, Column, Column | None]:
        value, w = self[name], self.over(partition, keys).rowsBetween(-preceding, following)
        if value.scalar not in NUMERIC:
            raise CalculationError("type_mismatch")
        total = F.coalesce(F.sum(value.coefficient()).over(w), exact.whole(0)).cast(exact.WHOLE)
        state = None if value.state is None else F.when(F.max((value.states == UNAVAILABLE).cast("int")).over(w) == 1, UNAVAILABLE).when(F.max((value.states == STALE).cast("int")).over(w) == 1, STALE).otherwise(PRESENT)
        return total, F.count(value.payload).over(w), state

    def window_sum(self, name: str, partition: list[str], keys: list[Key], preceding: int, following: int = 0) -> Value:
        total, _, state = self._framed(name, partition, keys, preceding, following)
        sound = total if state is None else F.when(state != UNAVAILABLE, total)
        return replace(self[name], payload=exact.from_coefficient(sound, self[name].scale), scalar="decimal", state=state)

    def window_mean(self, name: str, partition: list[str], keys: list[Key], preceding: int, following: int = 0, scale: int = 2, rounding: str = "half_even") -> Value:
        total, n, state = self._framed(name, partition, keys, preceding, following)
        blocked = F.lit(False) if state is None else state == UNAVAILABLE
        d = fail_where(~blocked & (n == 0), "empty_input", (F.greatest(n, F.lit(1)).cast(exact.WHOLE) * exact.power(self[name].scale)).cast(exact.WHOLE), exact.WHOLE)
        return replace(self[name], payload=F.when(~blocked, exact.ratio(total, d, scale, rounding)), scalar="decimal", scale=scale, state=state)


@dataclass(frozen=True)
class Group:
    """Groups by zero or more fields. An absent key fails the job; stale and present keys are different keys."""

    rows: Rowset
    names: tuple[str, ...]

    def _state(self, value: Value) -> Column | None:
        if value.state is None:
            return None
        return F.when(F.max((value.states == UNAVAILABLE).cast("int")) == 1, UNAVAILABLE).when(F.max((value.states == STALE).cast("int")) == 1, STALE).otherwise(PRESENT)

    def _sound(self, value: Value, payload: Column) -> Column:
        return payload if value.state is None else F.when(F.max((value.states == UNAVAILABLE).cast("int")) == 1, F.lit(None)).otherwise(payload)

    def count_rows(self) -> Value:
        return Value(F.count(F.lit(1)), "integer")

    def count_present(self, name: str) -> Value:
        value = self.rows[name]
        return Value(self._sound(value, F.count(value.payload)), "integer", self._state(value))

    def sum(self, name: str) -> Value:
        value = self.rows[name]
        if value.scalar not in NUMERIC:
            raise CalculationError("type_mismatch")
        total = F.coalesce(F.sum(value.coefficient()), exact.whole(0)).cast(exact.WHOLE)
        return replace(value, payload=self._sound(value, exact.from_coefficient(total, value.scale)), scalar="decimal", state=self._state(value))

    def _extreme(self, name: str, how) -> Value:
        value = self.rows[name]
        if value.scalar not in EXTREMES:
            raise CalculationError("type_mismatch")
        empty = F.count(value.payload) == 0
        if value.state is not None:
            empty = empty & (F.max((value.states == UNAVAILABLE).cast("int")) == 0)
        return replace(value, payload=self._sound(value, fail_where(empty, "empty_input", how(value.payload), value.kind)), state=self._state(value))

    def min(self, name: str) -> Value:
        return self._extreme(name, F.min)

    def max(self, name: str) -> Value:
        return self._extreme(name, F.max)

    def mean(self, name: str, scale: int, rounding: str = "half_even") -> Value:
        """Exact sum by count of the computable values, rounded once."""
        value = self.rows[name]
        if value.scalar not in NUMERIC:
            raise CalculationError("type_mismatch")
        n = F.count(value.payload)
        empty = n == 0 if value.state is None else (n == 0) & (F.max((value.states == UNAVAILABLE).cast("int")) == 0)
        d = fail_where(empty, "empty_input", (F.greatest(n, F.lit(1)).cast(exact.WHOLE) * exact.power(value.scale)).cast(exact.WHOLE), exact.WHOLE)
        mean = exact.ratio(F.sum(value.coefficient()).cast(exact.WHOLE), d, scale, rounding)
        return replace(value, payload=self._sound(value, mean), scalar="decimal", scale=scale, state=self._state(value))

    def aggregate(self, **aggregates: Value) -> Rowset:
        by, fields = [], {}
        for name in self.names:
            value = self.rows[name]
            by.append(fail_where(value.payload.isNull(), "invalid_group_key", value.payload, value.kind).alias(name))
            if value.state is not None:
                by.append(value.states.alias(f"{name}__st"))
            fields[name] = replace(field(name, value.scalar, value.scale, value.state is not None), unit=value.unit, currency=value.currency)
        columns = []
        for name, value in aggregates.items():
            columns.append(value.payload.cast(value.kind).alias(name))
            if value.state is not None:
                columns.append(value.state.cast("int").alias(f"{name}__st"))
            fields[name] = replace(field(name, value.scalar, value.scale, value.state is not None), unit=value.unit, currency=value.currency)
        df = self.rows.df.groupBy(*by).agg(*columns)
        return Rowset(df, fields, self.names[0] if self.names else next(iter(aggregates)))


def source(df: DataFrame, row_id: str, **fields: Value) -> Rowset:
    """Scan only the listed fields of a table."""
    held = {name: value for name, value in fields.items()}
    rows = Rowset(df, held, row_id)
    return rows.select(**held)


def quantised(value: Value, scale: int, rounding: str = "half_even") -> Value:
    return replace(value, payload=_quantised(value.coefficient(), value.scale, scale, rounding), scalar="decimal", scale=scale)
