"""Hand-computed values of the scalar library."""

import math

import pytest
from pyspark.sql import functions as F

from tickloom.functions import costs as co
from tickloom.functions import scalar as sc
from tickloom.functions.distributions import t_two_sided_p
from tickloom.operators.savings import xirr


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_cost_components(spark):
    e = one(spark, co.entry_cost(100.0, 10.0))
    assert e["brokerage"] == pytest.approx(0.3) and e["stt"] == 0.0 and e["stamp_duty"] == pytest.approx(0.15)
    assert e["gst"] == pytest.approx(0.18 * (0.3 + 0.0345))
    x = one(spark, co.exit_cost(100.0, 10.0, delivery=True))
    assert x["stt"] == pytest.approx(1.0) and x["stamp_duty"] == 0.0
    assert one(spark, co.entry_cost(1e6, 10.0))["brokerage"] == 20.0
    short = one(spark, co.entry_cost(100.0, 10.0, "SELL"))
    assert short["stt"] == pytest.approx(1.0) and short["stamp_duty"] == 0.0
    trip = one(spark, co.round_trip_cost(1000.0, 1000.0, 5.0, delivery=True))
    assert trip / 5000 == pytest.approx(co.round_trip_cost_pct())
    assert one(spark, co.net_pnl(100.0, 110.0, 10.0)) < 100.0
    assert one(spark, co.net_pnl(110.0, 100.0, 10.0, "SELL")) == pytest.approx(100 - one(spark, co.round_trip_cost(110.0, 100.0, 10.0, "SELL")))


@pytest.mark.parametrize(
    "text, want",
    [
        ("Bonus 1:1", 0.5),
        ("BONUS issue 3:1", None),
        ("bonus 2 : 3", 0.4),
        ("Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 2/- Per Share", 0.2),
        ("Face value split from Rs.5 to Re 1", None),
        ("Dividend Rs 5", None),
        (None, None),
    ],
)
def test_adjustment_factor(spark, text, want):
    got = one(spark, sc.adjustment_factor(F.lit(text).cast("string")))
    assert got == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("price, want", [(100.03, 100.05), (100.02, 100.0), (0.024, 0.0), (7.0, 7.0)])
def test_tick(spark, price, want):
    assert one(spark, sc.round_to_tick(F.lit(price))) == want


def test_circuit_and_session(spark):
    assert one(spark, sc.is_frozen(F.lit(100.0), F.lit(121.0))) and not one(spark, sc.is_frozen(F.lit(0.0), F.lit(121.0)))
    assert not one(spark, sc.would_fill(F.lit(100.0), F.lit(130.0), F.lit(121.0)))
    assert one(spark, sc.would_fill(F.lit(100.0), F.lit(130.0), F.lit(119.0)))
    ts = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, sc.in_session(ts("2024-01-01 09:15:00"))) and not one(spark, sc.in_session(ts("2024-01-06 10:00:00")))
    assert not one(spark, sc.in_session(ts("2024-01-01 15:30:01")))


def test_numbers_kelly_and_confidence(spark):
    assert one(spark, sc.to_number(F.lit(" 1,23,456.5 "))) == 123456.5
    assert one(spark, sc.to_number(F.lit("n/a"))) is None
    assert one(spark, sc.kelly_fraction(F.lit(0.6), F.lit(0.02), F.lit(0.01))) == pytest.approx(0.25 * (0.6 * 2 - 0.4) / 2)
    assert one(spark, sc.kelly_fraction(F.lit(0.6), F.lit(0.02), F.lit(0.0))) == 0.0
    assert one(spark, sc.composite_confidence(*[F.lit(1.0)] * 5)) == pytest.approx(1.0)


@pytest.mark.parametrize("t, df, p", [(2.228139, 10, 0.05), (12.706205, 1, 0.05), (1.959964, 2_000_000, 0.05), (0.0, 7, 1.0), (-2.063899, 24, 0.05)])
def test_student_p(spark, t, df, p):
    assert one(spark, t_two_sided_p(F.lit(t), F.lit(df))) == pytest.approx(p, abs=2e-6)


def test_xirr(spark):
    flows = lambda xs: F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(a)).alias("amount")) for t, a in xs])
    assert one(spark, xirr(flows([(0, -100), (1, 110)]))) == pytest.approx(0.10, abs=1e-9)
    assert one(spark, xirr(flows([(0, -100), (2, 121)]))) == pytest.approx(0.10, abs=1e-9)
    assert one(spark, xirr(flows([(0, 100), (1, 110)]))) is None
    assert math.isclose(one(spark, xirr(flows([(0, -100), (1, 50)]))), -0.5, abs_tol=1e-9)


def test_t_probability_for_any_degrees_of_freedom(spark):
    import math

    from tickloom.functions.distributions import t_two_sided_p

    known = [(1.0, 1, 0.5), (12.706204736432095, 1, 0.05), (2.2281388519649385, 10, 0.05), (0.0, 7, 1.0)]
    known += [(t, 10**k, math.erfc(t / math.sqrt(2))) for t in (0.5, 2.0, 4.0) for k in (7, 10)]
    df = spark.createDataFrame([(t, v, p) for t, v, p in known], "t double, v long, want double")
    for r in df.withColumn("p", t_two_sided_p("t", "v")).collect():
        assert abs(r["p"] - r["want"]) < (1e-7 if r["v"] > 1000 else 1e-11)
