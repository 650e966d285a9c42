"""Exact arithmetic, five-state logic and units against models in plain Python."""

from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.errors import CalculationError, code_of
from tidemark.functions import values as v
from tidemark.functions.units import linear_map
from tidemark.functions.values import MISSING, NULL, PRESENT, STALE, UNAVAILABLE, Value
from tidemark.operators.rowsets import Key, Rowset


def half_even(x: Fraction, scale: int) -> Decimal:
    n = x * 10**scale
    down = n.numerator // n.denominator
    rest = n - down
    if rest > Fraction(1, 2) or rest == Fraction(1, 2) and down % 2:
        down += 1
    return Decimal(f"{down}E-{scale}")  # exact: arithmetic would keep 28 digits


def evaluate(spark, value: Value):
    return spark.range(1).select(value.payload.alias("p"), value.states.alias("s")).first()


def number(text: str, **tags) -> Value:
    return v.literal(text, "decimal", **tags)


@pytest.mark.parametrize(("x", "expected"), [("0.5", 0), ("1.5", 2), ("-1.5", -2), ("2.5", 2), ("-2.5", -2), ("3.5", 4)])
def test_rounding_is_half_even(spark, x, expected):
    assert evaluate(spark, v.round_to(number(x), 0)).p == expected


def test_division_matches_fractions(spark):
    import random

    random.seed(5)
    rows = [(Decimal(random.randint(-(10**10), 10**10)).scaleb(-2), Decimal(random.randint(1, 10**8) * random.choice([-1, 1])).scaleb(-2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "a decimal(12,2), b decimal(12,2)")
    a, b = v.field("a", "decimal", 2), v.field("b", "decimal", 2)
    for scale in (0, 2, 6, 12):
        found = df.select("a", "b", v.divide(a, b, scale).payload.alias("q")).collect()
        assert all(r.q == half_even(Fraction(r.a) / Fraction(r.b), scale) for r in found)


# Conversion vectors: value, from, to, scale, rounding, expected result or code.
VECTORS = [
    ("1", "m", "cm", 0, "none", "100"), ("1", "%", "1", 18, "none", "0.01"), ("1", "[ft_i]3/s", "m3/s", 12, "none", "0.028316846592"), ("1", "[gal_us]/min", "L/s", 10, "none", "0.0630901964"),
    ("0", "Cel", "K", 2, "none", "273.15"), ("32", "[degF]", "Cel", 0, "none", "0"), ("212", "[degF]", "Cel", 0, "none", "100"), ("-40", "[degF]", "Cel", 0, "none", "-40"), ("491.67", "[degR]", "K", 2, "none", "273.15"),
    ("5", "cm", "m", 1, "half_even", "0"), ("15", "cm", "m", 1, "half_even", "0.2"), ("-15", "cm", "m", 1, "half_even", "-0.2"),
]


@pytest.mark.parametrize(("x", "source", "target", "scale", "rounding", "expected"), VECTORS)
def test_unit_conversion(spark, x, source, target, scale, rounding, expected):
    assert evaluate(spark, v.unit_convert(number(x, unit=source), source, target, scale, rounding)).p == Decimal(expected)


def test_unit_failures(spark):
    with pytest.raises(CalculationError, match="unit_mismatch"):
        linear_map("m", "s")
    with pytest.raises(CalculationError, match="invalid_unit_conversion"):
        linear_map("cfs", "m3/s")
    with pytest.raises(Exception) as failure:
        evaluate(spark, v.unit_convert(number("1", unit="m"), "m", "[ft_i]", 18, "none"))
    assert code_of(failure.value) == "inexact_arithmetic"


def test_currency(spark):
    document = {"from": "USD", "to": "EUR", "rate": "0.925", "observed_millis": 0}
    rate = v.check_rate(document, "USD", "EUR", 86_400_000)
    assert evaluate(spark, v.currency_convert(number("100", currency="USD"), "USD", "EUR", rate)).p == Decimal("92.5")
    for wrong, code in ((("USD", "EUR", 86_400_001), "stale_fx"), (("USD", "EUR", -1), "stale_fx"), (("EUR", "USD", 0), "missing_fx_evidence")):
        with pytest.raises(CalculationError, match=code):
            v.check_rate(document, *wrong)
    for x, expected in (("1", 2), ("-1", -2)):  # 1.5 and -1.5 yen
        assert evaluate(spark, v.currency_convert(number(x, currency="USD"), "USD", "JPY", Decimal("1.5"))).p == expected


def test_failures_have_codes(spark):
    for build, code in ((lambda: v.divide(number("1"), number("0"), 2), "divide_by_zero"), (lambda: v.round_to(number("1.5"), 0, "none"), "inexact_arithmetic")):
        with pytest.raises(Exception) as failure:
            evaluate(spark, build())
        assert code_of(failure.value) == code
    with pytest.raises(CalculationError, match="unit_mismatch"):
        v.multiply(number("1", unit="m"), number("1"), 0)
    with pytest.raises(CalculationError, match="currency_mismatch"):
        v.add(number("1", currency="USD"), number("1", currency="EUR"), 0)


def stated(state: int, payload, scalar: str = "boolean") -> Value:
    content = F.lit(payload if state in (PRESENT, STALE) else None)
    value = Value(content, scalar, F.lit(state), scale=2 if scalar == "decimal" else 0)
    return Value(content.cast(value.kind), scalar, F.lit(state), scale=value.scale)


def propagated(*states):
    for code in (UNAVAILABLE, MISSING, NULL):
        if code in states:
            return code
    return STALE if STALE in states else PRESENT


def test_state_pairs(spark):
    """All pairs of states and truths through and, or, add, equal, coalesce and if_then_else."""
    cases, expected = [], []
    for s in range(5):
        for t in range(5):
            for a in (True, False):
                for b in (True, False):
                    one, two = stated(s, a), stated(t, b)
                    has = {"a": s in (PRESENT, STALE), "b": t in (PRESENT, STALE)}
                    for how, decisive in ((v.and_, False), (v.or_, True)):
                        cases.append(how(one, two))
                        settled = [x for x, ok, st_ in ((a, has["a"], s), (b, has["b"], t)) if ok and x is decisive]
                        if settled:
                            fresh = (has["a"] and a is decisive and s == PRESENT) or (has["b"] and b is decisive and t == PRESENT)
                            expected.append((decisive, PRESENT if fresh else STALE))
                        elif has["a"] and has["b"]:
                            expected.append((not decisive, propagated(s, t)))
                        else:
                            expected.append((None, propagated(s, t)))
            x, y = stated(s, "1.25", "decimal"), stated(t, "2.50", "decimal")
            both = s in (PRESENT, STALE) and t in (PRESENT, STALE)
            cases.append(v.add(x, y, 2))
            expected.append((Decimal("3.75") if both else None, propagated(s, t)))
            cases.append(v.equal(x, y))
            expected.append((False if both else None, propagated(s, t)))
            cases.append(v.coalesce(x, y))
            if s in (PRESENT, STALE):
                expected.append((Decimal("1.25"), s))
            elif s == UNAVAILABLE or t == UNAVAILABLE:
                expected.append((None, UNAVAILABLE))
            elif t in (PRESENT, STALE):
                expected.append((Decimal("2.50"), t))
            else:
                expected.append((None, NULL if NULL in (s, t) else MISSING))
            cases.append(v.if_then_else(stated(s, True), y, stated(PRESENT, "9", "decimal")))
            if s not in (PRESENT, STALE):
                expected.append((None, s))
            else:
                expected.append((Decimal("2.50") if t in (PRESENT, STALE) else None, STALE if s == STALE and t == PRESENT else t))
    step = 40
    for at in range(0, len(cases), step):
        part = cases[at : at + step]
        row = spark.range(1).select(*[c for i, x in enumerate(part) for c in (x.payload.alias(f"p{i}"), x.states.alias(f"s{i}"))]).first()
        assert [(row[f"p{i}"], row[f"s{i}"]) for i in range(len(part))] == expected[at : at + step]


def test_sort_order_of_states(spark):
    df = spark.createDataFrame([("u", 0, 3), ("m", 0, 2), ("n", 0, 1), ("p2", 2, 0), ("s1", 1, 4), ("p1", 1, 0)], "id string, x bigint, x__st int")
    rows = Rowset(df, {"x": v.field("x", "integer", states=True)}, "id")
    order = lambda **how: [r.id for r in rows.sort(Key("x", **how)).df.collect()]
    assert order() == ["p1", "p2", "s1", "u", "m", "n"]
    assert order(descending=True) == ["p2", "p1", "s1", "u", "m", "n"]
    assert order(absent_first=True) == ["u", "m", "n", "p1", "p2", "s1"]
    with pytest.raises(CalculationError, match="type_mismatch"):
        rows.top_k(1)


def test_group_failures(spark):
    df = spark.createDataFrame([(1, None, None)], "id bigint, k string, x bigint")
    rows = Rowset(df, {"k": v.field("k", "text"), "x": v.field("x", "integer")}, "id")
    by_key, everything = rows.group("k"), rows.group()
    for job, code in ((lambda: by_key.aggregate(n=by_key.count_rows()), "invalid_group_key"), (lambda: everything.aggregate(m=everything.min("x")), "empty_input"), (lambda: everything.aggregate(m=everything.mean("x", 2)), "empty_input")):
        with pytest.raises(Exception) as failure:
            job().df.collect()
        assert code_of(failure.value) == code
    assert everything.aggregate(t=everything.sum("x"), n=everything.count_present("x")).df.first().asDict() == {"t": 0, "n": 0}


def test_lag_starts_missing_and_zero_base_fails(spark):
    df = spark.createDataFrame([(1, 0), (2, 5)], "id bigint, x bigint")
    rows = Rowset(df, {"x": v.field("x", "integer"), "id": v.field("id", "integer")}, "id")
    found = rows.select(b=rows.lag("x", [], [Key("id")])).df.orderBy("id").collect()
    assert [(r.b, r.b__st) for r in found] == [(None, MISSING), (0, PRESENT)]
    with pytest.raises(Exception) as failure:
        rows.select(p=rows.percentage_change("x", [], [Key("id")])).df.collect()
    assert code_of(failure.value) == "divide_by_zero"


def test_freshness_boundary(spark):
    at = v.literal("2024-01-01 00:00:00", "timestamp")
    start = 1_704_067_200_000_000
    assert evaluate(spark, v.classify_state(at, 1000, start + 1_000_000)).p == "current"
    assert evaluate(spark, v.classify_state(at, 1000, start + 1_000_001)).p == "stale"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.decimals(min_value=-(10**9), max_value=10**9, places=2), min_size=1, max_size=30), st.integers(0, 12))
def test_mean_is_rounded_once(spark, numbers, scale):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "id bigint, x decimal(12,2)")
    rows = Rowset(df, {"x": v.field("x", "decimal", 2)}, "id")
    g = rows.group()
    assert g.aggregate(m=g.mean("x", scale)).df.first().m == half_even(Fraction(sum(Fraction(x) for x in numbers), len(numbers)), scale)


def test_contracts_are_checked():
    from tidemark.plans.contracts import MetricContract, contract_number

    base = dict(name="m", measure="x", aggregation="sum", value_type="decimal")
    MetricContract(**base)
    wrong = [
        (dict(aggregation="median"), "type_mismatch"), (dict(aggregation="ratio"), "invalid_graph"), (dict(denominator="y"), "invalid_graph"), (dict(value_type="currency"), "currency_mismatch"), (dict(value_type="percentage"), "unit_mismatch"),
        (dict(unit="%"), "unit_mismatch"), (dict(value_type="duration", unit="m"), "unit_mismatch"), (dict(value_type="integer"), "type_mismatch"), (dict(aggregation="count"), "type_mismatch"), (dict(data_owner="business"), "invalid_graph"),
        (dict(threshold="1"), "invalid_graph"), (dict(direction="higher_is_better", threshold="2", target="1"), "invalid_graph"), (dict(direction="lower_is_better", threshold="1", target="2"), "invalid_graph"), (dict(direction="target_band", threshold="2", target="1"), "invalid_graph"),
    ]
    for change, code in wrong:
        with pytest.raises(CalculationError, match=code):
            MetricContract(**{**base, **change})
    assert contract_number("0.5") == Decimal("0.5") and contract_number("-12") == -12
    for text in ("-0", "01", "1.50", "1.", "", "1e3", "+1"):
        with pytest.raises(CalculationError):
            contract_number(text)


def test_wide_quotients(spark):
    """Quotients of up to 38 digits, either sign, ties included."""
    import random

    from tidemark.functions.exact import quotient

    rng = random.Random(2)
    cases = [(rng.choice((-1, 1)) * rng.randrange(10 ** rng.randint(1, 24)), rng.choice((-1, 1)) * rng.randrange(1, 10 ** rng.randint(1, 18))) for _ in range(300)]
    cases += [(5 * 10**19 + 1, 2 * 10**14), (-(5 * 10**19 + 1), 2 * 10**14), (12345678901234567894500, 100), (0, 7), (1, 3), (10**31, 1)]
    rows = spark.createDataFrame([(i, str(n), str(d)) for i, (n, d) in enumerate(cases)], "i int, n string, d string")
    n, d = F.col("n").cast("decimal(38,0)"), F.col("d").cast("decimal(38,0)")
    for scale in (0, 5, 6, 13):
        fits = [i for i, (a, b) in enumerate(cases) if abs(a) * 10**scale // abs(b) < 10**37]
        found = {r.i: int(r.q) for r in rows.where(F.col("i").isin(fits)).select("i", quotient(n, d, scale).alias("q")).collect()}
        for i in fits:
            a, b = abs(cases[i][0]) * 10**scale, abs(cases[i][1])
            down, rest = divmod(a, b)
            down += 2 * rest > b or 2 * rest == b and down % 2
            assert found[i] == (down if (cases[i][0] < 0) == (cases[i][1] < 0) else -down), (cases[i], scale)


def test_quotients_of_all_widths(spark):
    """Numbers of 1 to 38 digits at every scale, against fractions: all that fit in 38 digits are right."""
    import random

    from tidemark.functions.exact import quotient, ratio

    rng = random.Random(11)
    width = lambda: rng.choice([1, 2, 9, 17, 18, 19, 20, 31, 32, 33, 37, 38])
    for scale in (0, 1, 6, 17, 18):
        pairs = [(rng.choice([-1, 1]) * rng.randrange(10 ** width()), rng.choice([-1, 1]) * (1 + rng.randrange(10 ** width() - 1))) for _ in range(400)]
        pairs += [(10**38 - 1, 1), (10**38 - 1, 10**38 - 101), (1 - 10**38, 2), (5, 10), (15, 10), (-25, 10), (0, 7), (10**18, 10**18), (10**18 + 1, 3), (-(10**18), 1)]
        pairs = [(n, d) for n, d in pairs if abs(n) * 10**scale // abs(d) < 10**38 - 1]
        df = spark.createDataFrame([(Decimal(n), Decimal(d)) for n, d in pairs], "n decimal(38,0), d decimal(38,0)")
        rows = df.select("n", "d", quotient(F.col("n"), F.col("d"), scale).alias("q")).collect()
        assert len(rows) == len(pairs) and all(Decimal(f"{r.q}E-{scale}") == half_even(Fraction(int(r.n), int(r.d)), scale) for r in rows)
        narrow = [(n, d) for n, d in pairs if abs(n) // abs(d) < 10 ** (37 - scale)]
        rows = spark.createDataFrame([(Decimal(n), Decimal(d)) for n, d in narrow], "n decimal(38,0), d decimal(38,0)").select("n", "d", ratio(F.col("n"), F.col("d"), scale).alias("q")).collect()
        assert all(r.q == half_even(Fraction(int(r.n), int(r.d)), scale) for r in rows)
    nulls = spark.createDataFrame([(None, Decimal(1)), (Decimal(1), None)], "n decimal(38,0), d decimal(38,0)").select(quotient(F.col("n"), F.col("d"), 6).alias("q")).collect()
    assert [r.q for r in nulls] == [None, None]


def test_division_stays_small(spark):
    """The expression grows with neither the scale nor the operands' own size by more than a few copies."""
    from tidemark.functions.exact import ratio

    size = lambda scale: len(ratio(F.col("n") + F.col("m"), F.col("d"), scale)._jc.toString())
    assert size(17) < 2 * size(1) < 20_000


def test_evidence_rows_shrink_on_their_way(spark):
    """Digests that were compared are not shuffled again, and travel as bytes, equal only where their texts are."""
    import hashlib

    from tidemark import calculation_queries
    from tidemark.operators import rates

    texts = [hashlib.sha256(b"a").hexdigest(), hashlib.sha256(b"a").hexdigest().upper(), hashlib.sha256(b"a").hexdigest() + "\n", "", "zz", None]
    packed = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(rates._packed(F.col("t")).alias("p")).collect()]
    assert len({None if p is None else bytes(p) for p in packed}) == len(texts) and packed[-1] is None and len(packed[0]) == 32
    plan = calculation_queries.fx_evidence_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    while "Join" not in plan.nodeName():
        plan = plan.children().head()
    carried = plan.children().head().output()
    assert not [carried.apply(i).name() for i in range(carried.size()) if "sha256" in carried.apply(i).name()]
