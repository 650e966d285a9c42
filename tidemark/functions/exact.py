"""Exact decimal arithmetic in Catalyst expressions: whole coefficients, one rounding at the end.

A number is held as decimal(38, scale). Arithmetic is done on its coefficient (the number times 10**scale) as
decimal(38, 0), where sums, products and remainders are exact, and rounded once to the wanted scale, half to even.
Quotients are taken in 64 bits where a row's numbers allow it, and else by a fold over the wanted decimals, so numbers of
38 digits are divided at any scale; a result of more than 38 digits fails the job in Spark's ANSI mode (overflow), it never
loses digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import CalculationError, fail_where

MAX_SCALE = 18
WHOLE = "decimal(38,0)"


def power(n: int) -> Column:
    return F.lit(str(10**n)).cast(WHOLE)


def whole(number: int) -> Column:
    return F.lit(str(number)).cast(WHOLE)


def coefficient(value: Column, scale: int) -> Column:
    """value * 10**scale, for a value that has at most ``scale`` decimals."""
    return (value.cast(f"decimal(38,{scale})") * F.lit(str(10**scale)).cast(f"decimal({scale + 1},0)")).cast(WHOLE)


def from_coefficient(coef: Column, scale: int) -> Column:
    return F.concat(coef.cast("string"), F.lit(f"E-{scale}")).cast(f"decimal(38,{scale})")


def magnitude(number: Column, scale: int = 0) -> Column:
    """The absolute value as decimal(38, scale). Spark's own abs and minus keep 34 digits of a negative decimal, subtraction all."""
    kind = f"decimal(38,{scale})"
    return F.when(number < 0, (F.lit(0).cast(kind) - number).cast(kind)).otherwise(number.cast(kind))


def _divided(n: Column, d: Column) -> Column:
    """struct(down, rest): whole quotient and remainder of numbers that aren't negative.

    Spark's quotient of two wide decimals keeps 32 digits before the point, so numerators over small divisors are divided in
    two halves.
    """
    half = whole(10**19)
    plain = lambda x: F.struct(((x["n"] - x["n"] % x["d"]) / x["d"]).cast(WHOLE).alias("down"), (x["n"] % x["d"]).cast(WHOLE).alias("rest"))
    pair = lambda n, d: F.struct(n.cast(WHOLE).alias("n"), d.alias("d"))

    def halves(x: Column) -> Column:
        low = (x["n"] % half).cast(WHOLE)
        above = bound(pair((x["n"] - low) / half, x["d"]), plain)
        both = lambda up: bound(bound(pair(up["rest"] * half + low, x["d"]), plain), lambda lower: F.struct((up["down"] * half + lower["down"]).cast(WHOLE).alias("down"), lower["rest"].alias("rest")))
        return bound(above, both)

    return bound(pair(n, d), lambda x: F.when(x["d"] < half, halves(x)).otherwise(plain(x)))


def _digit(so_far: Column, d: Column) -> Column:
    """One more decimal of a quotient: struct(down, rest) after it. For divisors of 38 digits ten times the rest isn't formed."""
    tenth = ((d - d % 10).cast(WHOLE) * F.lit("0.1").cast("decimal(2,1)")).cast(WHOLE)  # 37 digits: more than a quotient holds
    rest, last = so_far["rest"], (d % 10).cast("int")
    fits = lambda q: rest >= (tenth * q + F.ceil(last * q / 10)).cast(WHOLE)  # noqa: E731  that is, 10 * rest >= q * d
    digit = F.size(F.filter(F.sequence(F.lit(1), F.lit(9)), fits))
    after = lambda q: ((rest - tenth * q).cast(WHOLE) * 10 - last * q).cast(WHOLE)
    return bound(digit, lambda q: F.struct((so_far["down"] * 10 + q).cast(WHOLE).alias("down"), after(q).alias("rest")))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def _long(numerator: Column, denominator: Column, scale: int, rounding: str) -> Column:
    """The coefficient by long division, digit by digit; its size grows with neither the digits nor the operands."""

    def rounded(x: Column, d: Column) -> Column:
        other = (d - x["rest"]).cast(WHOLE)
        if rounding == "none":
            return fail_where(x["rest"] != 0, "inexact_arithmetic", x["down"], WHOLE)
        away = (x["rest"] > other) | ((x["rest"] == other) & (x["down"] % 2 != 0))
        return F.when(away, (x["down"] + 1).cast(WHOLE)).otherwise(x["down"])

    def positive(x: Column) -> Column:
        start = _divided(x["n"], x["d"])
        steps = F.array(*[F.lit(i) for i in range(scale)]).cast("array<int>")
        return F.aggregate(steps, start, lambda so_far, _: _digit(so_far, x["d"]), lambda done: rounded(done, x["d"]))

    sizes = lambda p: F.struct(magnitude(p["n"]).alias("n"), magnitude(p["d"]).alias("d"))
    given = F.struct(numerator.cast(WHOLE).alias("n"), denominator.cast(WHOLE).alias("d"))
    signed = lambda p: bound(bound(sizes(p), positive), lambda q: F.when((p["n"] < 0) != (p["d"] < 0), (whole(0) - q).cast(WHOLE)).otherwise(q))
    return bound(given, signed)


def _short(numerator: Column, denominator: Column, scale: int, rounding: str) -> Column:
    """The coefficient as a bigint, for numbers that 64 bits hold after scaling."""
    n, d = numerator.cast("bigint") * F.lit(10**scale), denominator.cast("bigint")
    down, rest = F.call_function("div", n, d), n % d
    if rounding == "none":
        return fail_where(rest != 0, "inexact_arithmetic", down, "bigint")
    twice = F.abs(rest) * 2
    away = (twice > F.abs(d)) | ((twice == F.abs(d)) & (down % 2 != 0))
    return F.when(away, down + F.when((n < 0) == (d < 0), 1).otherwise(-1)).otherwise(down)


def _ways(numerator: Column, denominator: Column, scale: int, rounding: str) -> tuple[Column, Column, Column]:
    """Whether 64 bits do, the coefficient if so, and the coefficient if not. A row takes one way only."""
    if not 0 <= scale <= MAX_SCALE:
        raise CalculationError("limit_exceeded", f"scale {scale}")
    if rounding not in ("half_even", "none"):
        raise CalculationError("invalid_graph", f"rounding {rounding}")
    most, largest = whole(10 ** (18 - scale)), whole(10**18)
    small = numerator.between(-most, most) & denominator.between(-largest, largest)
    both = numerator.isNotNull() & denominator.isNotNull()
    return small, _short(numerator, denominator, scale, rounding), F.when(both, _long(numerator, denominator, scale, rounding))


def quotient(numerator: Column, denominator: Column, scale: int, rounding: str = "half_even") -> Column:
    """The coefficient at ``scale`` of numerator / denominator (whole numbers, denominator not 0), rounded once."""
    small, short, long = _ways(numerator, denominator, scale, rounding)
    return F.when(small, short.cast(WHOLE)).otherwise(long)


def ratio(numerator: Column, denominator: Column, scale: int, rounding: str = "half_even") -> Column:
    """numerator / denominator (whole numbers) as decimal(38, scale)."""
    small, short, long = _ways(numerator, denominator, scale, rounding)
    if scale > 17:  # a product of 64 bits and 10**-18 has too many digits
        return from_coefficient(F.when(small, short.cast(WHOLE)).otherwise(long), scale)
    unit = F.lit(f"1E-{scale}").cast(f"decimal({scale + 1},{scale})")
    return F.when(small, (short.cast("decimal(19,0)") * unit).cast(f"decimal(38,{scale})")).otherwise(from_coefficient(long, scale))
