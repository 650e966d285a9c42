"""Typed failures. Static ones are raised while a plan is built; data-dependent ones by the job that meets them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed set of failure codes.
CODES = (
    "invalid_graph", "type_mismatch", "unit_mismatch", "currency_mismatch", "grain_mismatch", "missing_field", "cycle", "limit_exceeded", "overflow", "divide_by_zero",
    "empty_input", "invalid_timezone", "invalid_unit_conversion", "inexact_arithmetic", "missing_fx_evidence", "stale_fx", "invalid_group_key",
)
_MARK = re.compile("calculation failed: (" + "|".join(CODES) + ")")


class CalculationError(ValueError):
    """A failure with one of CODES."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def fail_where(condition: Column, code: str, value: Column, kind: str) -> Column:
    """``value``, but the job fails with ``code`` on a row that meets ``condition``."""
    return F.when(condition, F.raise_error(F.lit(f"calculation failed: {code}")).cast(kind)).otherwise(value)


def code_of(failure: Exception) -> str | None:
    """The code of a failed job: as raised by fail_where, or Spark's own arithmetic overflow."""
    found = _MARK.search(str(failure))
    if found:
        return found[1]
    return "overflow" if "NUMERIC_VALUE_OUT_OF_RANGE" in str(failure) or "ARITHMETIC_OVERFLOW" in str(failure) else None
