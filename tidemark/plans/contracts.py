"""Metric contracts: reviewed definitions of metrics, checked when they are made and measured as one aggregation."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.errors import CalculationError, fail_where
from tidemark.functions import exact
from tidemark.functions import values as v
from tidemark.functions.units import UNITS
from tidemark.functions.values import NUMERIC, Value
from tidemark.operators.rowsets import Group, Rowset

# What may be declared, and what can be computed.
AGGREGATIONS = ("count", "count_distinct", "sum", "min", "max", "mean", "median", "ratio")
COMPUTABLE = ("count", "sum", "min", "max", "mean", "ratio")
VALUE_TYPES = ("integer", "decimal", "currency", "percentage", "duration")
# How threshold and target are compared, by direction.
COMPARISONS = {"higher_is_better": (v.greater_equal, v.greater_equal), "lower_is_better": (v.less_equal, v.less_equal), "target_band": (v.greater_equal, v.less_equal)}
_DECIMAL = re.compile(r"(?!-0)-?(?:0|[1-9][0-9]*)(?:\.[0-9]{0,17}[1-9])?")


def contract_number(text: str) -> Decimal:
    """A bound as contracts write it: no leading or trailing zeros, no negative zero, 18 decimals and 38 digits at most."""
    if not _DECIMAL.fullmatch(text) or len(re.sub(r"\D", "", text)) > 38:
        raise CalculationError("invalid_graph", f"not a canonical decimal: {text}")
    return Decimal(text)


@dataclass(frozen=True)
class MetricContract:
    name: str
    measure: str
    aggregation: str
    value_type: str
    direction: str = "neutral"
    threshold: str | None = None
    target: str | None = None
    unit: str | None = None
    currency: str | None = None
    denominator: str | None = None
    scale: int = 18
    business_owner: str = "business"
    data_owner: str = "data"
    freshness_millis: int = 0

    def __post_init__(self):
        if self.aggregation not in AGGREGATIONS or self.value_type not in VALUE_TYPES:
            raise CalculationError("invalid_graph", self.name)
        if self.business_owner == self.data_owner:
            raise CalculationError("invalid_graph", "the two owners are one")
        if (self.aggregation == "ratio") != (self.denominator is not None):
            raise CalculationError("invalid_graph", "a ratio, and only a ratio, has a denominator")
        if self.aggregation not in COMPUTABLE:
            raise CalculationError("type_mismatch", f"{self.aggregation} is declared only")
        self._check_value_type()
        self._check_direction()

    def _check_value_type(self) -> None:
        plain, wanted = self.unit is None and self.currency is None, (self.value_type, self.unit)
        if self.aggregation == "count":
            if self.value_type != "integer" or not plain:
                raise CalculationError("type_mismatch", "a count is a plain integer")
        elif self.aggregation == "ratio":
            if wanted not in (("decimal", "1"), ("percentage", "%")) or self.currency:
                raise CalculationError("type_mismatch", "a ratio is a decimal of unit 1 or a percentage")
        elif self.value_type == "currency":
            if self.currency is None or self.unit is not None:
                raise CalculationError("currency_mismatch", "one currency and no unit")
        elif self.value_type == "integer":
            raise CalculationError("type_mismatch", "only counts are integers")
        elif self.currency is not None:
            raise CalculationError("currency_mismatch" if self.value_type == "decimal" else "unit_mismatch", "no currency")
        elif self.value_type == "percentage" and self.unit != "%" or self.value_type == "decimal" and self.unit == "%":
            raise CalculationError("unit_mismatch", "percentages, and only they, have unit %")
        elif self.value_type == "duration" and (self.unit not in UNITS or UNITS[self.unit][0] != "duration"):
            raise CalculationError("unit_mismatch", "a unit of duration")

    def _check_direction(self) -> None:
        bounds = (self.threshold, self.target)
        if self.direction == "neutral":
            if bounds != (None, None):
                raise CalculationError("invalid_graph", "neutral metrics have no bounds")
            return
        if self.direction not in COMPARISONS or None in bounds:
            raise CalculationError("invalid_graph", "a direction needs threshold and target")
        threshold, target = map(contract_number, bounds)
        if (threshold < target if self.direction == "lower_is_better" else threshold > target):
            raise CalculationError("invalid_graph", "threshold and target are on the wrong sides")


@dataclass(frozen=True)
class ContractSet:
    """Reviewed versions of contracts, over one snapshot of the field catalog."""

    set_id: str
    catalog_snapshot_id: str
    versions: Mapping[tuple[str, int], MetricContract]

    def resolve(self, contract_id: str, version: int, set_id: str, catalog_snapshot_id: str) -> MetricContract:
        """The contract that a calculation is bound to; it must name this set and its snapshot."""
        if (set_id, catalog_snapshot_id) != (self.set_id, self.catalog_snapshot_id):
            raise CalculationError("invalid_graph", "another contract set or catalog snapshot")
        if (contract_id, version) not in self.versions:
            raise CalculationError("missing_field", f"no version {version} of {contract_id}")
        return self.versions[contract_id, version]


def _measured(contract: MetricContract, group: Group) -> Value:
    measure = group.rows[contract.measure]
    if contract.aggregation == "count":
        return group.count_present(contract.measure)
    if contract.aggregation in ("min", "max"):
        if measure.scalar != "decimal":
            raise CalculationError("type_mismatch", "minima and maxima are of decimals")
        return getattr(group, contract.aggregation)(contract.measure)
    if measure.scalar not in NUMERIC:
        raise CalculationError("type_mismatch")
    if contract.aggregation == "sum":
        return group.sum(contract.measure)
    if contract.aggregation == "mean":
        return group.mean(contract.measure, contract.scale)
    n, d = group.sum(contract.measure), group.sum(contract.denominator)
    if (n.unit, n.currency) != (d.unit, d.currency):
        raise CalculationError("currency_mismatch" if n.currency != d.currency else "unit_mismatch")
    k = max(n.scale, d.scale)
    below = exact.coefficient(d.payload, k)
    times = 100 if contract.value_type == "percentage" else 1
    above = (exact.coefficient(n.payload, k) * times).cast(exact.WHOLE)
    below = fail_where(n.computable & (below == 0), "divide_by_zero", below, exact.WHOLE)
    return Value(exact.ratio(above, below, contract.scale), "decimal", v._merged([n, d]), contract.scale, contract.unit)


def _converted(value: Value, contract: MetricContract, conversion: Decimal | str) -> Value:
    """The one conversion that may follow an aggregation: to the contract's unit, or by a rate to its currency."""
    if contract.aggregation in ("count", "ratio"):
        raise CalculationError("invalid_graph", f"a {contract.aggregation} has nothing to convert")
    if conversion == "unit":
        return v.unit_convert(value, value.unit, contract.unit, exact.MAX_SCALE)
    return v.currency_convert(value, value.currency, contract.currency, conversion)


def measure(rows: Rowset, contract: MetricContract, *by: str, conversion: Decimal | str | None = None) -> Rowset:
    """The metric by zero or more dimensions: value, and meets_threshold and meets_target where there is a direction.

    One aggregation; the comparisons are columns on its result. ``conversion`` is "unit" or a rate, where the measure's unit or
    currency isn't the contract's: the aggregate is converted, not each row, and rounded once more.
    """
    group = rows.group(*by)
    value = _measured(contract, group)
    if conversion is not None:
        value = _converted(value, contract, conversion)
    if value.currency != contract.currency:
        raise CalculationError("currency_mismatch", contract.name)
    if contract.aggregation != "ratio" and value.unit != contract.unit:
        raise CalculationError("unit_mismatch", contract.name)
    found = group.aggregate(value=value)
    if contract.direction == "neutral":
        return found
    told, columns = found["value"], {}
    for name, compare, text in zip(("meets_threshold", "meets_target"), COMPARISONS[contract.direction], (contract.threshold, contract.target)):
        bound = replace(v.literal(text, "decimal" if told.scalar == "decimal" else "integer"), unit=told.unit, currency=told.currency)
        columns[name] = compare(told, bound)
    keys = {name: found[name] for name in by}
    df = found.df.select("*", *[c.payload.alias(n) for n, c in columns.items()])
    return Rowset(df, {**keys, "value": told, **{n: v.field(n, "boolean") for n in columns}}, found.row_id)


def is_current(latest_age_millis, contract: MetricContract, lag_millis: int = 0):
    """Whether the evidence behind a metric is within its lag plus freshness objective (column of milliseconds)."""
    return F.coalesce((latest_age_millis >= 0) & (latest_age_millis <= lag_millis + contract.freshness_millis), F.lit(False))
