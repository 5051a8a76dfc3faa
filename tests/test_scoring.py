"""Scores, gates, sizing and text rules at their thresholds."""

import pytest
from pyspark.sql import functions as F

from tickloom.functions.columns import fixed, ratio, rounded, two_decimals
from tickloom.functions import scoring as S
from tickloom.plans import sqlparts


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("x")).first().x


@pytest.mark.parametrize("prob, price, bankroll, exposure, usd, reason", [
    (0.70, 0.50, 1000.0, 0.0, 100.0, None),
    (0.57, 0.50, 1000.0, 0.0, 0.0, "edge below minimum"),
    (0.30, 0.50, 1000.0, 0.0, 0.0, "negative Kelly"),
    (0.90, 0.995, 1000.0, 0.0, 0.0, "market price too extreme"),
    (0.95, 0.50, 100_000.0, 0.0, 500.0, None),
    (0.95, 0.50, 100_000.0, 4900.0, 100.0, None),
    (0.70, 0.50, 5.0, 0.0, 0.5, "below $1 after caps"),
])
def test_kelly_size(one, prob, price, bankroll, exposure, usd, reason):
    k = value(one, S.kelly_size(*[F.lit(x) for x in (prob, price, bankroll, exposure)]))
    if reason == "market price too extreme":
        assert k.skip_reason == reason or abs(prob - price) < 0.08
    else:
        assert (k.recommended_usd, k.skip_reason) == (usd, reason)


def test_arb_and_atr_size(one):
    a = value(one, S.arb_size(F.lit(0.4), F.lit(0.5), F.lit(5000.0), F.lit(0.0)))
    assert (a.recommended_usd, a.yes_leg, a.no_leg, a.roi_pct, a.locked_profit) == (500.0, 222.22, 277.78, 11.11, 50.0)
    assert value(one, S.atr_size(F.lit(1000.0), F.lit(2.5))) == 2.0
    assert value(one, S.atr_size(F.lit(1000.0), F.lit(2.5), F.lit(30.0), units="quote")) == 60.0
    assert value(one, S.atr_size(F.lit(1000.0), F.lit(0.0))) == 500.0


MACRO = "funding_rate double, ls_ratio double, premium double, oi_trend double, fetch_ok boolean"


@pytest.mark.parametrize("row, buy, sell, label", [
    ((0.0001, 1.0, 0.0, 0.0, True), 1.0, 1.0, "NEUTRAL (funding=+0.010% L/S=1.00)"),
    ((0.0016, 2.5, 0.0, 0.0, True), 0.45 * 0.55, 1.15, "OVERHEATED LONGS (funding=+0.160% L/S=2.50)"),
    ((-0.0012, 0.65, 0.0, 0.0, True), 1.2 * 1.10, 0.9, "SHORT SQUEEZE SETUP (funding=-0.120% L/S=0.65)"),
    ((-0.002, 0.5, 0.0, 0.0, True), 1.5, 0.75, "SHORT SQUEEZE SETUP (funding=-0.200% L/S=0.50)"),
    ((0.0005, 1.0, -0.003, 0.2, True), 0.85 * 0.9, 1.0, "NEUTRAL (funding=+0.050% L/S=1.00)"),
    ((0.0016, 2.5, 0.0, 0.0, False), 1.0, 1.0, "UNKNOWN (fetch failed)"),
])
def test_macro_rules(spark, row, buy, sell, label):
    r = spark.createDataFrame([row], MACRO).select(S.buy_multiplier().alias("b"), S.sell_multiplier().alias("s"), S.macro_label().alias("l")).first()
    assert (r.b, r.s, r.l) == (pytest.approx(buy), pytest.approx(sell), label)


@pytest.mark.parametrize("prob, side, strength", [(0.60, "HOLD", 0.0), (0.6001, "BUY", 0.2), (0.40, "HOLD", 0.0), (0.39, "SELL", 0.22)])
def test_side_thresholds_are_strict(one, prob, side, strength):
    s, k = S.side_and_strength(F.lit(prob))
    assert (value(one, s), value(one, k)) == (side, pytest.approx(strength, abs=1e-3))


def test_regime_weights(one):
    own, other = S.regime_weights(F.lit("CHAOTIC"), F.lit(0.5))
    assert (value(one, own), value(one, other)) == (0.45, 0.55)
    own, _ = S.regime_weights(F.lit("NO SUCH"), F.lit(1.0))
    assert value(one, own) == 0.6
    assert value(one, S.blended_probability(F.lit(0.999), F.lit(None).cast("double"), F.lit(0.5), F.lit(0.5))) == 0.99


@pytest.mark.parametrize("text, expected", [
    ('{"probability": 0.73}', 0.73), ('{"probability": 1.5}', None), ('{"other": 1}', None), ("maybe 0.62 or 0.7", 0.62), ("0.5", None), ("none", None), (None, None),
])
def test_probability_in_text(one, text, expected):
    assert value(one, S.extract_probability(F.lit(text).cast("string"))) == expected


def test_gates(one):
    def reason(h, regime, p, **kw):
        return value(one, S.entry_block_reason(F.lit(h), F.lit(regime), F.lit(p), **kw))

    assert reason(0.44, "CHAOTIC", 0.9) == "hurst"
    assert reason(0.45, "RANGING", 0.9) == "regime"
    assert reason(0.45, "RANGING", 0.9, regime_gate=False) is None
    assert reason(0.5, "CHAOTIC", 0.51) == "entry_filter"
    assert reason(0.5, "CHAOTIC", 0.52) is None
    assert value(one, S.fear_greed_allows(F.lit("BUY"), F.lit(19))) is False
    assert value(one, S.fear_greed_allows(F.lit("BUY"), F.lit(20))) is True
    assert value(one, S.fear_greed_allows(F.lit("SELL"), F.lit(1))) is True
    assert value(one, S.kelly_fraction(F.lit(0.55))) == pytest.approx(0.1)
    assert value(one, S.smooth_labels(F.lit(1.0))) == pytest.approx(0.95)


TECH = "close double, idx long, rsi double, bb_upper double, bb_lower double, macd_hist double, macd_hist_prev double, stoch_k double, stoch_k_prev double, vol_spike boolean, obv_rising boolean, price_rising boolean, volume double, vol_sma double"


@pytest.mark.parametrize("row, buy, sell, why", [
    ((100.0, 50, 25.0, 110.0, 101.0, 0.1, -0.1, 10.0, 5.0, True, True, True, 3.0, 2.0), 1.25, 0.0, "MACD bull cross"),
    ((100.0, 50, 50.0, 110.0, 90.0, 0.1, 0.1, 50.0, 50.0, True, True, False, 3.0, 2.0), 0.28, 0.0, "OBV divergence: accumulation"),
    ((100.0, 50, 75.0, 99.0, 90.0, -0.1, 0.1, 90.0, 95.0, True, False, True, 3.0, 2.0), 0.1, 1.27, "Vol spike 1.5×"),
    ((100.0, 50, 50.0, 110.0, 90.0, 0.1, 0.1, 50.0, 50.0, True, False, False, 3.0, 2.0), 0.2, 0.08, "MACD positive"),
])
def test_scan_scores(spark, row, buy, sell, why):
    b, s = S.tech_scores()
    reasons, _ = S.tech_reasons()
    r = spark.createDataFrame([row], TECH).select(b.alias("b"), s.alias("s"), reasons.alias("w")).first()
    assert (r.b, r.s) == (pytest.approx(buy), pytest.approx(sell))
    assert why in r.w


def test_two_decimals_round_by_the_exact_binary_value(spark):
    values = [i / 1000 for i in range(0, 1001)] + [0.125, 0.375, 0.625, 0.875, 1.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", two_decimals(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == [f"{r.x:.2f}" for r in got]


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_fixed_text_rounds_by_the_exact_binary_value(spark, digits):
    """0.25 is +0.2, 0.15 is +0.1 and 50.5 is 50, in moves, RSI and bands alike."""
    values = [s * i / 40 for i in range(401) for s in (1, -1)] + [50.5, 29.5, 0.15, -0.04, 4.9999e13, 1e5 + 0.05]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", fixed(F.col("x"), digits, "+").alias("t")).collect()
    assert [r.t for r in got] == [f"{r.x:+.{digits}f}" for r in got]


def test_lesson_numbers_round_by_the_exact_binary_value(spark):
    df = spark.createDataFrame([({"rsi": "50.5", "bb_pos": "0.125"},)], "indicators map<string,string>")
    assert df.select(S.indicator_summary(F.lit("TECH")).alias("x")).first().x == "RSI=50 BB=0.12"


def test_premium_over_a_price_of_zero_is_infinite(spark):
    got = spark.createDataFrame([(2.0, 0.0), (-2.0, 0.0), (0.0, 0.0), (3.0, 2.0), (3.0, None)], "a double, b double").select(S.premium(F.col("a"), F.col("b")).alias("x"))
    assert [repr(r.x) for r in got.collect()] == ["inf", "-inf", "nan", "0.5", "None"]


def test_report_rounding_is_that_of_sql(spark):
    """Also where a double has no room for the decimals: 2.11 over 1e-9, the move of a signal entered at a price of zero."""
    import duckdb

    values = [2.11 / 1e-9, 67.31 / 1e-9, -2.11 / 1e-9, float("inf"), float("nan"), 1e300] + [i / 1e7 for i in range(-400, 400)] + [1.0000005, -2.5e-7, 1234.5678915, 0.1 + 0.2]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", rounded(F.col("x")).alias("r")).collect()
    sql = duckdb.connect()
    want = [sql.execute(f"SELECT {sqlparts.r('x')} FROM (SELECT ?::DOUBLE AS x)", [r.x]).fetchone()[0] for r in got]
    assert [repr(r.r) for r in got] == [repr(w) for w in want]
