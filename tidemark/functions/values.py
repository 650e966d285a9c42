"""Five-state values as columns, and the scalar operations over them.

A value is a payload column, NULL unless there is something to compute with, and a state column. Where every value is
present or null, as in plain tables, the state column is left out and the payload says all, so plans over ordinary data
carry no state logic. Types, units, currencies and grains are checked when an expression is built.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import CalculationError, fail_where
from tidemark.functions import exact
from tidemark.functions.units import CURRENCIES, RATE_MAX_AGE_MILLIS, is_affine, linear_map

PRESENT, NULL, MISSING, UNAVAILABLE, STALE = range(5)
NUMERIC = ("integer", "decimal")
ORDERED = (*NUMERIC, "text", "date", "timestamp", "duration")
SPARK_TYPES = {"boolean": "boolean", "integer": "bigint", "text": "string", "date": "date", "timestamp": "timestamp", "duration": "bigint"}


@dataclass(frozen=True)
class Value:
    payload: Column
    scalar: str
    state: Column | None = None
    scale: int = 0
    unit: str | None = None
    currency: str | None = None
    grain: str | None = None

    @property
    def states(self) -> Column:
        return F.when(self.payload.isNull(), F.lit(NULL)).otherwise(F.lit(PRESENT)) if self.state is None else self.state

    @property
    def kind(self) -> str:
        return f"decimal(38,{self.scale})" if self.scalar == "decimal" else SPARK_TYPES[self.scalar]

    @property
    def computable(self) -> Column:
        return self.payload.isNotNull()

    def coefficient(self) -> Column:
        return exact.coefficient(self.payload, self.scale)


def field(name: str, scalar: str, scale: int = 0, states: bool = False, **tags) -> Value:
    """A column of a table; with ``states``, beside a column name__st of state codes."""
    value = Value(F.col(name), scalar, scale=scale, **tags)
    payload = F.col(name).cast(value.kind)
    if not states:
        return replace(value, payload=payload)
    state = F.col(f"{name}__st").cast("int")
    return replace(value, payload=F.when(state.isin(PRESENT, STALE), payload), state=state)


def literal(content, scalar: str, state: int = PRESENT, **tags) -> Value:
    """A constant; absent ones have a state and no content."""
    if (content is None) != (state != PRESENT):
        raise CalculationError("invalid_graph", "a literal is present with content, or absent without")
    scale = max(0, -Decimal(str(content)).as_tuple().exponent) if scalar == "decimal" and content is not None else 0
    value = Value(F.lit(None), scalar, scale=scale, **tags)
    given = F.lit(str(content)) if scalar == "decimal" and content is not None else F.lit(content)
    return replace(value, payload=given.cast(value.kind), state=None if state in (PRESENT, NULL) else F.lit(state))


def _merged(values: list[Value]) -> Column | None:
    """The state of a result that needs all its operands."""
    if all(v.state is None for v in values):
        return None
    some = lambda code: reduce(lambda a, b: a | b, [v.states == code for v in values])
    return F.when(some(UNAVAILABLE), UNAVAILABLE).when(some(MISSING), MISSING).when(some(NULL), NULL).when(some(STALE), STALE).otherwise(PRESENT)


def _same(left: Value, right: Value) -> None:
    if left.grain != right.grain:
        raise CalculationError("grain_mismatch")
    if left.currency != right.currency:
        raise CalculationError("currency_mismatch")
    if left.unit != right.unit:
        raise CalculationError("unit_mismatch")


def _numeric(*values: Value) -> None:
    if any(v.scalar not in NUMERIC for v in values):
        raise CalculationError("type_mismatch")


def _quantised(numerator: Column, numerator_scale: int, scale: int, rounding: str) -> Column:
    """A coefficient at one scale, as a decimal of another."""
    if scale >= numerator_scale:
        return exact.from_coefficient((numerator * exact.power(scale - numerator_scale)).cast(exact.WHOLE), scale)
    return exact.ratio(numerator, exact.power(numerator_scale), scale, rounding)


def _added(left: Value, right: Value, sign: int, scale: int, rounding: str) -> Value:
    _numeric(left, right)
    _same(left, right)
    if is_affine(left.unit):
        raise CalculationError("unit_mismatch", "affine units don't add")
    k = max(left.scale, right.scale)
    total = exact.coefficient(left.payload, k) + exact.coefficient(right.payload, k) * sign
    return Value(_quantised(total.cast(exact.WHOLE), k, scale, rounding), "decimal", _merged([left, right]), scale, left.unit, left.currency, left.grain)


def add(left: Value, right: Value, scale: int, rounding: str = "half_even") -> Value:
    return _added(left, right, 1, scale, rounding)


def subtract(left: Value, right: Value, scale: int, rounding: str = "half_even") -> Value:
    return _added(left, right, -1, scale, rounding)


def multiply(left: Value, right: Value, scale: int, rounding: str = "half_even") -> Value:
    """Bare numbers only: there is no algebra of units."""
    _numeric(left, right)
    if left.grain != right.grain:
        raise CalculationError("grain_mismatch")
    if left.currency or right.currency:
        raise CalculationError("currency_mismatch")
    if left.unit or right.unit:
        raise CalculationError("unit_mismatch")
    product = (left.coefficient() * right.coefficient()).cast(exact.WHOLE)
    return Value(_quantised(product, left.scale + right.scale, scale, rounding), "decimal", _merged([left, right]), scale, grain=left.grain)


def divide(left: Value, right: Value, scale: int, rounding: str = "half_even") -> Value:
    """Like by like, giving unit 1; a zero divisor fails the job."""
    _numeric(left, right)
    _same(left, right)
    shift = right.scale - left.scale
    n = (left.coefficient() * exact.power(max(0, shift))).cast(exact.WHOLE)
    d = (right.coefficient() * exact.power(max(0, -shift))).cast(exact.WHOLE)
    both = left.computable & right.computable
    d = fail_where(both & (d == 0), "divide_by_zero", d, exact.WHOLE)
    return Value(exact.ratio(n, d, scale, rounding), "decimal", _merged([left, right]), scale, "1", None, left.grain)


def absolute(value: Value) -> Value:
    _numeric(value)
    return replace(value, payload=exact.magnitude(value.payload, value.scale), scalar="decimal")


def clamp(value: Value, low: Decimal | int, high: Decimal | int) -> Value:
    _numeric(value)
    if low > high:
        raise CalculationError("invalid_graph", "the lower bound is above the upper")
    scale = max(value.scale, *[max(0, -Decimal(x).as_tuple().exponent) for x in (low, high)])
    kind = f"decimal(38,{scale})"
    held = F.least(F.greatest(value.payload.cast(kind), F.lit(str(low)).cast(kind)), F.lit(str(high)).cast(kind))
    return replace(value, payload=F.when(value.computable, held), scalar="decimal", scale=scale)


def round_to(value: Value, scale: int, rounding: str = "half_even") -> Value:
    _numeric(value)
    return replace(value, payload=_quantised(value.coefficient(), value.scale, scale, rounding), scalar="decimal", scale=scale)


def _compared(left: Value, right: Value, how: Callable[[Column, Column], Column], ordered: bool) -> Value:
    if left.scalar != right.scalar or ordered and left.scalar not in ORDERED:
        raise CalculationError("type_mismatch")
    _same(left, right)
    a, b = left.payload, right.payload
    if left.scalar == "decimal":  # Spark's common type of two wide decimals would drop decimals
        kind = f"decimal(38,{max(left.scale, right.scale)})"
        a, b = a.cast(kind), b.cast(kind)
    return Value(how(a, b), "boolean", _merged([left, right]), grain=left.grain)


def equal(left: Value, right: Value) -> Value:
    return _compared(left, right, lambda a, b: a == b, False)


def not_equal(left: Value, right: Value) -> Value:
    return _compared(left, right, lambda a, b: a != b, False)


def less(left: Value, right: Value) -> Value:
    return _compared(left, right, lambda a, b: a < b, True)


def less_equal(left: Value, right: Value) -> Value:
    return _compared(left, right, lambda a, b: a <= b, True)


def greater(left: Value, right: Value) -> Value:
    return _compared(left, right, lambda a, b: a > b, True)


def greater_equal(left: Value, right: Value) -> Value:
    return _compared(left, right, lambda a, b: a >= b, True)


def _decided(left: Value, right: Value, decisive: bool, payload: Column) -> Value:
    """A decisive operand settles the result over any absence; it is present if a present one settles it."""
    if left.scalar != "boolean" or right.scalar != "boolean":
        raise CalculationError("type_mismatch")
    if left.state is None and right.state is None:
        return Value(payload, "boolean", grain=left.grain)
    settles = [F.coalesce(v.payload == F.lit(decisive), F.lit(False)) for v in (left, right)]
    fresh = [s & (v.states == PRESENT) for s, v in zip(settles, (left, right))]
    state = F.when(fresh[0] | fresh[1], PRESENT).when(settles[0] | settles[1], STALE).otherwise(_merged([left, right]))
    return Value(payload, "boolean", state, grain=left.grain)


def and_(left: Value, right: Value) -> Value:
    return _decided(left, right, False, left.payload & right.payload)


def or_(left: Value, right: Value) -> Value:
    return _decided(left, right, True, left.payload | right.payload)


def not_(value: Value) -> Value:
    if value.scalar != "boolean":
        raise CalculationError("type_mismatch")
    return replace(value, payload=~value.payload)


def if_then_else(condition: Value, yes: Value, no: Value) -> Value:
    """An absent condition gives its own state; a stale one makes a present branch stale."""
    if condition.scalar != "boolean" or yes.scalar != no.scalar:
        raise CalculationError("type_mismatch")
    _same(yes, no)
    scale = max(yes.scale, no.scale)
    kind = replace(yes, scale=scale).kind
    payload = F.when(condition.payload, yes.payload.cast(kind)).when(~condition.payload, no.payload.cast(kind))
    state = None
    if any(v.state is not None for v in (condition, yes, no)):
        branch = F.when(condition.payload, yes.states).otherwise(no.states)
        aged = F.when((condition.states == STALE) & (branch == PRESENT), STALE).otherwise(branch)
        state = F.when(condition.payload.isNull(), condition.states).otherwise(aged)
    return replace(yes, payload=payload, state=state, scale=scale)


def coalesce(*values: Value) -> Value:
    """The first computable value; an unavailable one met before it stops the search."""
    first = values[0]
    for other in values[1:]:
        if other.scalar != first.scalar:
            raise CalculationError("type_mismatch")
        _same(first, other)
    scale = max(v.scale for v in values)
    kind = replace(first, scale=scale).kind
    if all(v.state is None for v in values):
        return replace(first, payload=F.coalesce(*[v.payload.cast(kind) for v in values]), scale=scale)
    payload, state = F.lit(None).cast(kind), F.when(reduce(lambda a, b: a | b, [v.states == NULL for v in values]), NULL).otherwise(MISSING)
    for v in reversed(values):
        payload = F.when(v.computable, v.payload.cast(kind)).when(v.states == UNAVAILABLE, F.lit(None)).otherwise(payload)
        state = F.when(v.computable, v.states).when(v.states == UNAVAILABLE, UNAVAILABLE).otherwise(state)
    return replace(first, payload=payload, state=state, scale=scale)


def unit_convert(value: Value, source: str, target: str, scale: int, rounding: str = "half_even") -> Value:
    _numeric(value)
    if value.currency:
        raise CalculationError("currency_mismatch")
    a, b = linear_map(source, target)
    if value.unit != source:
        raise CalculationError("unit_mismatch")
    d = a.denominator * b.denominator * 10**value.scale
    n = value.coefficient() * exact.whole(a.numerator * b.denominator) + exact.whole(b.numerator * a.denominator * 10**value.scale)
    try:
        payload = exact.ratio(n.cast(exact.WHOLE), exact.whole(d), scale, rounding)
    except CalculationError as failure:
        raise CalculationError("invalid_unit_conversion") from failure
    return replace(value, payload=payload, scalar="decimal", scale=scale, unit=target)


def check_rate(evidence: dict | None, source: str, target: str, evaluated_millis: int) -> Decimal:
    """The rate of a rate document for just this direction, not from the future and at most a day old."""
    if evidence is None or (evidence["from"], evidence["to"]) != (source, target):
        raise CalculationError("missing_fx_evidence", f"{source} to {target}")
    if not 0 <= evaluated_millis - evidence["observed_millis"] <= RATE_MAX_AGE_MILLIS:
        raise CalculationError("stale_fx")
    return Decimal(evidence["rate"])


def currency_convert(value: Value, source: str, target: str, rate: Decimal) -> Value:
    _numeric(value)
    if value.unit or value.currency != source or source not in CURRENCIES or target not in CURRENCIES:
        raise CalculationError("currency_mismatch")
    digits = max(0, -rate.as_tuple().exponent)
    product = (value.coefficient() * exact.whole(int(rate.scaleb(digits)))).cast(exact.WHOLE)
    scale = CURRENCIES[target]
    return replace(value, payload=_quantised(product, value.scale + digits, scale, "half_even"), scalar="decimal", scale=scale, currency=target)


def classify_state(value: Value, stale_after_millis: int, evaluated_micros: int) -> Value:
    """Text ``current`` or ``stale`` by age at a pinned time; just the limit is current."""
    if value.scalar != "timestamp":
        raise CalculationError("type_mismatch")
    age = F.lit(evaluated_micros) - F.unix_micros(value.payload)
    told = F.when(value.computable, F.when(age > stale_after_millis * 1000, "stale").otherwise("current"))
    return Value(told, "text", value.state, grain=value.grain)
