"""Canonical decimals, dates, timestamps and bytes; contract versions; reports; payload limits."""

import json
from decimal import Context, Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.errors import CalculationError
from tidemark.functions import canonical
from tidemark.functions.values import field
from tidemark.operators import verification
from tidemark.plans.contracts import ContractSet, MetricContract


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_decimals_lose_only_zeros_behind_the_point(spark):
    numbers = ["0.000", "-0.500", "1200.000", "-12.345", "12345678901234567890123456789012345.000", None]
    rows = [(Decimal(x) if x else None,) for x in numbers]
    found = one(spark, rows, "d decimal(38,3)", canonical.canonical_decimal(F.col("d"), 3).alias("c"))
    assert [tuple(c) if c else None for (c,) in found] == [("0", "i64:0"), ("-5", "i64:1"), ("1200", "i64:0"), ("-12345", "i64:3"), ("12345678901234567890123456789012345", "i64:0"), None]
    texts = [("5", "i64:1"), ("50", "i64:1"), ("-0", "i64:0"), ("0", "i64:1"), ("05", "i64:0"), ("50", "i64:0"), ("1", "i64:19"), ("1", "1"), ("1", "i64:01"), ("1\n", "i64:0"), (None, "i64:0")]
    found = one(spark, texts, "c string, s string", canonical.parse_decimal(F.col("c"), F.col("s")).alias("d"))
    assert [d for (d,) in found] == [Decimal("0.5"), None, None, None, None, Decimal(50), None, None, None, None, None]


def test_dates_and_timestamps_have_one_spelling(spark):
    days = ["2024-02-29", "2023-02-29", "1900-02-29", "0000-02-29", "9999-12-31", "2024-2-29", "2024-02-29 ", "2024-13-01", "2024-00-10", "２０24-01-01", "2024-01-01\n", None]
    found = one(spark, [(d,) for d in days], "t string", canonical.format_date(canonical.parse_date(F.col("t"))).alias("d"))
    assert [d for (d,) in found] == ["2024-02-29", None, None, "0000-02-29", "9999-12-31", *[None] * 7]
    stamps = ["1969-12-31T23:59:59.999999Z", "2024-02-29T00:00:00.000000Z", "2024-02-29T24:00:00.000000Z", "2024-02-29T23:59:60.000000Z", "2024-02-29T00:00:00Z", "2024-02-29T00:00:00.000000+00:00", "2024-02-29t00:00:00.000000Z", None]
    at = canonical.parse_timestamp(F.col("t"))
    found = one(spark, [(d,) for d in stamps], "t string", F.unix_micros(at).alias("m"), canonical.format_timestamp(at).alias("d"))
    assert found[:2] == [(-1, stamps[0]), (1709164800000000, stamps[1])] and set(found[2:]) == {(None, None)}


def test_bytes_of_typed_values_equal_a_plain_model(spark):
    numbers = [0, 1, -1, 10**35 - 1, -(10**35) + 1, 2**64, -(2**64), 2**32 - 1, -(2**32), None]
    rows = [(None if n is None else Decimal(n).scaleb(-3, Context(prec=50)), None if n is None else n % 1000 - 500) for n in numbers]
    shown = canonical.typed_bytes(field("d", "decimal", 3)), canonical.typed_bytes(field("w", "integer"))
    for n, (wide, whole) in zip(numbers, one(spark, rows, "d decimal(38,3), w bigint", *[x.alias(k) for k, x in zip("ab", shown)])):
        if n is None:
            assert (bytes(wide), bytes(whole)) == (b"\x02\x01", b"\x01\x01")
            continue
        digits, scale = n, 3
        while scale and digits % 10 == 0:
            digits, scale = digits // 10, scale - 1
        assert bytes(wide) == b"\x02\x00" + digits.to_bytes(16, "big", signed=True) + bytes([scale])
        assert bytes(whole) == b"\x01\x00" + (n % 1000 - 500).to_bytes(8, "big", signed=True)
    others = {"b": field("b", "boolean"), "t": field("t", "text"), "day": field("day", "date")}
    row = spark.sql("SELECT true AS b, 'é' AS t, DATE'1969-12-31' AS day").select(*[canonical.typed_bytes(x).alias(n) for n, x in others.items()]).first()
    assert [bytes(x) for x in row] == [b"\x00\x00\x01", b"\x03\x00\x00\x00\x00\x02\xc3\xa9", b"\x04\x00\xff\xff\xff\xff"]


def test_contracts_are_found_by_version(spark):
    one_way = MetricContract("m", "x", "max", "decimal")
    reviewed = ContractSet("s", "c", {("m", 1): one_way})
    assert reviewed.resolve("m", 1, "s", "c") is one_way
    for asked, code in ((("m", 2, "s", "c"), "missing_field"), (("m", 1, "other", "c"), "invalid_graph"), (("m", 1, "s", "older"), "invalid_graph")):
        with pytest.raises(CalculationError) as failure:
            reviewed.resolve(*asked)
        assert failure.value.code == code


def test_reports_of_no_and_of_few_cases(spark):
    schema = "intent string, wrongness string, correct boolean, refusal string"
    none = spark.createDataFrame([], schema)
    assert tuple(verification.probe_report(none).first()) == (0, 0, 0, 0, 0.0) and verification.strictness_cost(none).count() == 0
    probe = verification.PROBE
    rows = spark.createDataFrame([(probe, "a", False, "hash-mismatch"), (probe, "a", False, None), (probe, None, False, None), ("control", "b", True, "malformed-candidate"), ("control", None, True, None)], schema)
    assert tuple(verification.probe_report(rows).first()) == (3, 2, 2, 1, 2 / 3)
    assert [tuple(r) for r in verification.strictness_cost(rows).collect()] == [("contract", 1)]


def test_payloads_beyond_their_limits_are_refused(spark, tmp_path, monkeypatch):
    from tidemark.sources import air, river

    monkeypatch.setattr(river, "MAX_OBSERVATIONS", 4)
    monkeypatch.setattr(air, "MAX_MEASUREMENTS", 2)

    def gauge(n):
        value = [{"value": "1.0", "dateTime": f"2026-07-28T0{i}:00:00.000Z"} for i in range(n)]
        place = {"siteName": "X", "siteCode": [{"value": "1"}], "geoLocation": {"geogLocation": {"latitude": 1.0, "longitude": 2.0}}}
        unit = {"variableCode": [{"value": "00065"}], "variableDescription": "d", "unit": {"unitCode": "ft"}, "noDataValue": -9.0}
        return {"sourceInfo": place, "variable": unit, "values": [{"value": value}]}

    def monitor(n):
        hours = [{"value": 1.0, "period": {"datetimeTo": {"utc": f"2026-08-18T0{i}:00:00Z"}}} for i in range(n)]
        place = {"id": 1, "name": "X", "isMonitor": True, "coordinates": {"latitude": 1.0, "longitude": 2.0}, "sensors": [{"id": 5, "parameter": {"name": "pm25", "units": "µg/m³"}}]}
        return {"retrievedAt": "2026-08-18T12:00:00Z", "locations": {"results": [place]}, "hours": {"5": {"results": hours}}}

    documents = {
        "river": (river.read_river, lambda n: {"value": {"queryInfo": {"creationTime": "2026-07-30T00:00:00Z"}, "timeSeries": [gauge(2), gauge(n - 2)]}}, 4),
        "air": (air.read_air, monitor, 2),
    }
    for name, (read, make, limit) in documents.items():
        for n in (limit, limit + 1):
            path = tmp_path / f"{name}-{n}.json"
            path.write_text(json.dumps(make(n)))
            places, seen = read(spark, str(path))
            if n == limit:
                assert seen.count() > 0 and places.count() == 1
            else:
                with pytest.raises(Exception, match=f"{name} payload: too many"):
                    places.collect()
                with pytest.raises(Exception, match=f"{name} payload: too many"):
                    seen.collect()


def test_wide_negative_numbers_keep_all_digits(spark):
    """Spark's own abs and minus round a negative decimal to 34 digits."""
    from tidemark.functions import exact, values

    rows = [(Decimal("-" + "9" * 35), Decimal(1)), (Decimal("-" + "1234567890" * 3 + "12345678"), Decimal(1)), (Decimal("9" * 36), Decimal(-3))]
    n, d = F.col("n"), F.col("d")
    found = one(spark, rows, "n decimal(38,0), d decimal(38,0)", values.absolute(field("n", "decimal")).payload.alias("a"), exact.magnitude(d).alias("m"))
    assert found == [(abs_of(n), abs_of(d)) for n, d in rows]
    quotients = one(spark, [(Decimal("-" + "7" * 31), Decimal(1)), (Decimal("-" + "7" * 35), Decimal(7 * 10**6)), (Decimal("7" * 35), Decimal(-7 * 10**6))], "n decimal(38,0), d decimal(38,0)", exact.quotient(n, d, 6).alias("q"))
    assert [int(q) for (q,) in quotients] == [-int("7" * 31 + "000000"), -int("1" * 35), -int("1" * 35)]


def abs_of(number):
    return number.copy_abs()


def test_bytes_of_decimals_of_any_width_by_a_small_expression(spark):
    from decimal import Decimal

    from pyspark.sql import functions as F

    from tidemark.functions import canonical
    from tidemark.functions.values import field

    edges = {s * (b + d) for b in (0, 10**17, 10**18, 1 << 31, 1 << 32, 1 << 63, 1 << 64, 1 << 96, 10**37, 10**38 - 1) for d in (-1, 0, 1) for s in (1, -1)} | {700, -1230, 10**20, -(10**36)}
    edges = sorted(x for x in edges if abs(x) < 10**38)
    for scale in (0, 2, 18):
        column = canonical.typed_bytes(field("x", "decimal", scale))
        assert len(column._jc.toString()) < 30_000
        rows = spark.createDataFrame([(str(x),) for x in edges], "said string").withColumn("x", F.concat("said", F.lit(f"E-{scale}")).cast(f"decimal(38,{scale})"))
        for r in rows.select("said", F.hex(column).alias("h")).collect():
            coefficient, left = int(r.said), scale
            while left and coefficient % 10 == 0:
                coefficient, left = coefficient // 10, left - 1
            assert r.h == "0200" + (coefficient.to_bytes(16, "big", signed=True) + bytes([left])).hex().upper(), (r.said, scale)
    assert Decimal(edges[-1]) == 10**38 - 1
