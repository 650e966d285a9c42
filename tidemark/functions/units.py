"""Units and currencies with exact factors."""

from __future__ import annotations

from fractions import Fraction

from tidemark.errors import CalculationError

# Unit, dimension, multiplier and offset to the dimension's base unit.
UNITS = {
    "1": ("dimensionless", "1", "0"),
    "%": ("dimensionless", "1/100", "0"),
    "m": ("length", "1", "0"),
    "cm": ("length", "1/100", "0"),
    "mm": ("length", "1/1000", "0"),
    "km": ("length", "1000", "0"),
    "[in_i]": ("length", "127/5000", "0"),
    "[ft_i]": ("length", "381/1250", "0"),
    "s": ("duration", "1", "0"),
    "min": ("duration", "60", "0"),
    "h": ("duration", "3600", "0"),
    "d": ("duration", "86400", "0"),
    "m3": ("volume", "1", "0"),
    "L": ("volume", "1/1000", "0"),
    "[ft_i]3": ("volume", "55306341/1953125000", "0"),
    "[gal_us]": ("volume", "473176473/125000000000", "0"),
    "m3/s": ("volumetric_flow", "1", "0"),
    "m3/h": ("volumetric_flow", "1/3600", "0"),
    "L/s": ("volumetric_flow", "1/1000", "0"),
    "L/min": ("volumetric_flow", "1/60000", "0"),
    "[ft_i]3/s": ("volumetric_flow", "55306341/1953125000", "0"),
    "[gal_us]/min": ("volumetric_flow", "157725491/2500000000000", "0"),
    "K": ("temperature", "1", "0"),
    "Cel": ("temperature", "1", "5463/20"),
    "[degF]": ("temperature", "5/9", "45967/180"),
    "[degR]": ("temperature", "5/9", "0"),
}
# Decimals of each currency, and the age in milliseconds beyond which a rate is stale.
CURRENCIES = {"USD": 2, "EUR": 2, "GBP": 2, "JPY": 0}
RATE_MAX_AGE_MILLIS = 86_400_000


def is_affine(unit: str | None) -> bool:
    return unit is not None and UNITS[unit][2] != "0"


def linear_map(source: str, target: str) -> tuple[Fraction, Fraction]:
    """(a, b) such that a * x + b converts x exactly."""
    if source not in UNITS or target not in UNITS:
        raise CalculationError("invalid_unit_conversion", f"{source} to {target}")
    (dimension, m, o), (other, n, p) = UNITS[source], UNITS[target]
    if dimension != other:
        raise CalculationError("unit_mismatch", f"{source} to {target}")
    return Fraction(m) / Fraction(n), (Fraction(o) - Fraction(p)) / Fraction(n)
