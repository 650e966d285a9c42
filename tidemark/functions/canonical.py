"""Canonical forms at the edges of the library: decimals, strict dates and timestamps, and typed values as bytes.

Everything is a Catalyst expression. Texts that are not in the one accepted spelling give NULL, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import CalculationError
from tidemark.functions import exact
from tidemark.functions.values import Value

# The byte of each type (states are their codes, 0 to 4), and the tag of 64-bit numbers in text.
TYPE_BYTES = {"boolean": 0, "integer": 1, "decimal": 2, "text": 3, "date": 4, "timestamp": 5, "duration": 6}
I64_TAG = "i64:"
_DAY = 86_400_000_000
_LIMB = 1 << 32


# --- decimals ----------------------------------------------------------------------------------------------------


def reduced(value: Column, scale: int) -> tuple[Column, Column]:
    """Coefficient (as text) and scale of a decimal with ``scale`` decimals, without trailing zeros behind the point."""
    plain = value.cast(f"decimal(38,{scale})").cast("string")  # in ANSI mode with all its decimals; a product could overflow
    digits = F.replace(plain, F.lit("."), F.lit("")).cast(exact.WHOLE).cast("string")
    zeros = F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))
    cut = F.when(digits == "0", F.lit(scale)).otherwise(F.least(zeros, F.lit(scale)))
    return F.when(digits == "0", digits).otherwise(F.left(digits, F.length(digits) - cut)), F.lit(scale) - cut


def canonical_decimal(value: Column, scale: int) -> Column:
    """struct(coefficient string, scale string): equal numbers have equal structs, whatever scale their columns have."""
    digits, left = reduced(value, scale)
    return F.when(value.isNotNull(), F.struct(digits.alias("coefficient"), F.concat(F.lit(I64_TAG), left.cast("string")).alias("scale")))


def parse_decimal(coefficient: Column, scale: Column) -> Column:
    """decimal(38, 18) of a canonical coefficient and tagged scale; NULL for any other spelling.

    Numbers with more than 20 digits before the point are valid, but too wide for the result: they overflow.
    """
    places = F.regexp_extract(scale, rf"\A{I64_TAG}(0|[1-9][0-9]?)\z", 1).try_cast("int")
    sound = coefficient.rlike(r"\A(0|-?[1-9][0-9]{0,37})\z") & (places <= exact.MAX_SCALE) & ((places == 0) | ~coefficient.endswith("0"))
    return F.when(sound, F.concat(coefficient, F.lit("E-"), places.cast("string")).cast("decimal(38,18)"))


# --- dates and timestamps ----------------------------------------------------------------------------------------


def parse_date(text: Column) -> Column:
    """The date of exactly YYYY-MM-DD; NULL for other spellings and for days that don't exist."""
    return F.when(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), text.try_cast("date"))


def parse_timestamp(text: Column) -> Column:
    """The instant of exactly YYYY-MM-DDThh:mm:ss.ffffffZ; NULL for offsets, shorter fractions and leap seconds."""
    return F.when(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z\z"), text.try_cast("timestamp"))


def format_date(day: Column) -> Column:
    return day.cast("string")


def format_timestamp(at: Column) -> Column:
    """The spelling that parse_timestamp reads, in any session time zone."""
    micros = F.unix_micros(at)
    rest = F.pmod(micros, F.lit(_DAY))
    day = F.date_from_unix_date(((micros - rest) / _DAY).cast("int"))
    part = lambda unit, of, width: F.lpad((F.floor(rest / unit) % of).cast("string"), width, "0")
    return F.concat(day.cast("string"), F.lit("T"), part(3_600_000_000, 24, 2), F.lit(":"), part(60_000_000, 60, 2), F.lit(":"), part(1_000_000, 60, 2), F.lit("."), part(1, 1_000_000, 6), F.lit("Z"))


# --- typed values as bytes ---------------------------------------------------------------------------------------


def _big_endian(number: Column, n_bytes: int) -> Column:
    """The lowest bytes of a bigint, in two's complement."""
    return F.unhex(F.right(F.lpad(F.hex(number.cast("bigint")), 16, "0"), F.lit(2 * n_bytes)))


def _halves(high: Column, low: Column) -> Column:
    return F.concat(_big_endian(high, 8), _big_endian(low, 8))


def _wide(digits: Column) -> Column:
    """A decimal(38, 0) in 16 bytes, two's complement: two halves of 64 bits, of -1 - x where x is negative."""
    half = exact.whole(1 << 64)

    def split(x: Column) -> Column:
        rest = F.when(x < 0, (exact.whole(-1) - x).cast(exact.WHOLE)).otherwise(x)
        return exact.bound(F.struct((x < 0).alias("negative"), rest.alias("rest"), (rest % half).cast(exact.WHOLE).alias("low")), joined)

    def joined(x: Column) -> Column:
        high = ((x["rest"] - x["low"]) / half).cast("bigint")
        low = F.when(x["low"] >= exact.whole(1 << 63), x["low"] - half).otherwise(x["low"]).cast("bigint")
        return F.when(x["negative"], _halves(F.bitwise_not(high), F.bitwise_not(low))).otherwise(_halves(high, low))

    return exact.bound(digits, split)


def _decimal_bytes(value: Column, scale: int) -> Column:
    """Coefficient in 16 bytes and scale in one. Numbers whose coefficient has 18 digits at most, nearly all, stay in 64 bits."""

    def short(number: Column) -> Column:
        # A zero has no digit that counts, so it loses its whole scale.
        cut = F.when(number == 0, scale).otherwise(F.least(F.length(number.cast("string")) - F.length(F.rtrim(number.cast("string"), F.lit("0"))), F.lit(scale)))
        plain = F.call_function("div", number, F.element_at(F.array(*[F.lit(10**i) for i in range(19)]), F.least(cut, F.lit(18)) + 1))
        return F.concat(F.unhex(F.when(plain < 0, "F" * 16).otherwise("0" * 16)), _big_endian(plain, 8), _big_endian(F.lit(scale) - cut, 1))

    def long(x: Column) -> Column:
        digits, left = reduced(x, scale)
        return exact.bound(F.struct(digits.cast(exact.WHOLE).alias("digits"), left.alias("left")), lambda d: F.concat(_wide(d["digits"]), _big_endian(d["left"], 1)))

    most = F.lit("9" * 18 + f"E-{scale}").cast(f"decimal(38,{scale})")
    small = (value >= -most) & (value <= most)
    return F.when(small, exact.bound(exact.coefficient(value, scale).cast("bigint"), short)).otherwise(exact.bound(value, long))


def _payload(value: Value) -> Column:
    p = value.payload
    if value.scalar == "boolean":
        return _big_endian(p.cast("bigint"), 1)
    if value.scalar in ("integer", "duration"):
        return _big_endian(p, 8)
    if value.scalar == "timestamp":
        return _big_endian(F.unix_micros(p), 8)
    if value.scalar == "date":
        return _big_endian(F.unix_date(p), 4)
    if value.scalar == "text":
        content = F.encode(p, "UTF-8")
        return F.concat(_big_endian(F.octet_length(content), 4), content)
    if value.scalar == "decimal":
        return _decimal_bytes(p, value.scale)
    raise CalculationError("type_mismatch", value.scalar)


def typed_bytes(value: Value) -> Column:
    """Type byte, state byte and payload (none where there is nothing to compute with); texts are encoded as they stand.

    Equal values, and only they, have equal bytes, so bytes serve for identities and as an order that all runs share.
    """
    header = F.concat(_big_endian(F.lit(TYPE_BYTES[value.scalar]), 1), _big_endian(value.states, 1))
    return F.when(value.computable, F.concat(header, _payload(value))).otherwise(header)
