"""Gate, sizing, dataset bookkeeping and model queries."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import scoring as S
from tickloom.functions.columns import rounded
from tickloom.operators import features, labels, models, regimes, reports
from tickloom.operators.alignment import asof_scan, band_join
from tickloom.plans import domain, sqlparts as q
from tickloom.plans.dataset_plans import LABELS, dataset, sample_rows
from tickloom.plans.indicator_plans import values_cte
from tickloom.plans.registry import query
from tickloom.operators.signals import ta_indicators
from tickloom.session import materialize, shared_dir, stored

C = F.col
T, B = q.ticks(), q.bars()

# Gate inputs as columns of the tick table.
_GATE = (
    f"{T}, gt AS (SELECT seq, product_id, price, volume, volume / 100 AS p, CASE WHEN seq % 4 = 0 THEN (price % 10) / 10 END AS p2, (price % 1) AS hurst, volume / 10 AS di, (volume % 10) / 10 AS entropy, "
    "CASE product_id WHEN 'click' THEN 'TRENDING' WHEN 'view' THEN 'RANGING' WHEN 'purchase' THEN 'CHAOTIC' WHEN 'error' THEN 'OTHER' ELSE 'UNKNOWN' END AS regime, (seq % 11) / 10.0::DOUBLE AS conf FROM ticks)"
)


def gate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain.ticks(spark, sf_dir)
    regime = F.when(C("product_id") == "click", "TRENDING").when(C("product_id") == "view", "RANGING").when(
        C("product_id") == "purchase", "CHAOTIC").when(C("product_id") == "error", "OTHER").otherwise("UNKNOWN")
    return t.select(
        "seq", "product_id", "price", "volume", (C("volume") / 100).alias("p"), F.when(C("seq") % 4 == 0, C("price") % 10 / 10).alias("p2"),
        (C("price") % 1).alias("hurst"), (C("volume") / 10).alias("di"), (C("volume") % 10 / 10).alias("entropy"), regime.alias("regime"),
        (C("seq") % 11 / F.lit(10.0)).alias("conf"))


@query("sig9_linear_probability", values_cte(["bb_pos", "rsi", "macd_hist", "mfi", "obv_slope", "adx"]) + f" SELECT product_id, start, {q.r('least(0.99, greatest(0.01, 0.5 + 0.20 * (bb_pos - 0.5) + 0.15 * (0.5 - rsi / 100) + 0.10 * macd_hist / 100 + 0.10 * (0.5 - mfi / 100) + 0.08 * obv_slope + 0.07 * (1 - adx / 100)))')} AS prob FROM v")
def linear_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ta_indicators(domain.bars(spark, sf_dir))
    p = S.linear_probability(C("bb_pos"), C("rsi") / 100, C("macd_hist") / 100, C("mfi") / 100, C("obv_slope"), C("adx") / 100)
    return df.select("product_id", F.unix_seconds("start").alias("start"), rounded(p).alias("prob"))


_W = "round(CASE regime WHEN 'TRENDING' THEN 0.75 WHEN 'RANGING' THEN 0.55 WHEN 'CHAOTIC' THEN 0.40 ELSE 0.60 END * conf + 0.5 * (1 - conf), 3)"
_BLEND = f"{_GATE}, wg AS (SELECT *, {_W}::DOUBLE AS w1, round(1 - (CASE regime WHEN 'TRENDING' THEN 0.75 WHEN 'RANGING' THEN 0.55 WHEN 'CHAOTIC' THEN 0.40 ELSE 0.60 END * conf + 0.5 * (1 - conf)), 3)::DOUBLE AS w2 FROM gt), bp AS (SELECT *, least(0.99, greatest(0.01, CASE WHEN p2 IS NULL THEN p ELSE w1 * p + w2 * p2 END)) AS mp FROM wg)"


def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = gate_inputs(spark, sf_dir)
    own, other = S.regime_weights(C("regime"), C("conf"))
    df = df.withColumns({"w1": own, "w2": other})
    return df.withColumn("mp", S.blended_probability(C("p"), C("p2"), C("w1"), C("w2")))


@query("sig10_regime_weights", f"WITH {_GATE} SELECT DISTINCT regime, seq % 11 AS c, CASE regime WHEN 'TRENDING' THEN round(0.5 + 0.025 * (seq % 11), 4) WHEN 'RANGING' THEN round(0.5 + 0.005 * (seq % 11), 4) WHEN 'CHAOTIC' THEN round(0.5 - 0.01 * (seq % 11), 4) ELSE round(0.5 + 0.01 * (seq % 11), 4) END::DOUBLE AS w FROM gt")
def regime_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, _ = S.regime_weights(C("regime"), C("conf"))
    return gate_inputs(spark, sf_dir).select("regime", (C("seq") % 11).alias("c"), own.alias("w")).distinct()


@query("sig11_blend_and_side", f"WITH {_BLEND} SELECT seq, {q.r('mp')} AS model_prob, CASE WHEN mp > 0.60 THEN 'BUY' WHEN mp < 0.40 THEN 'SELL' ELSE 'HOLD' END AS side FROM bp")
def blend_and_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = blended(spark, sf_dir)
    side, _ = S.side_and_strength(C("mp"))
    return df.select("seq", rounded(C("mp")).alias("model_prob"), side.alias("side"))


@query("sig12_skip_second_opinion", f"WITH {_GATE} SELECT seq, abs(p - 0.5) >= 0.25 OR (hurst > 0.45 AND hurst < 0.55 AND di > 5) OR entropy > 0.85 AS skip FROM gt")
def skip_second_opinion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_inputs(spark, sf_dir).select("seq", S.skip_second_opinion(C("p"), C("hurst"), C("di"), C("entropy")).alias("skip"))


@query("sig13_entry_gates", f"WITH {_GATE} SELECT seq, CASE WHEN hurst < 0.45 THEN 'hurst' WHEN regime <> 'CHAOTIC' THEN 'regime' WHEN p < 0.52 THEN 'entry_filter' END AS blocked_by FROM gt")
def entry_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_inputs(spark, sf_dir).select("seq", S.entry_block_reason(C("hurst"), C("regime"), C("p")).alias("blocked_by"))


@query("ml6_adx_regime", values_cte(["adx"]) + " SELECT product_id, start, CASE WHEN product_id IN ('click', 'view') THEN 'CHAOTIC' WHEN adx >= 25 THEN 'TRENDING' ELSE 'RANGING' END AS regime, CASE WHEN product_id IN ('click', 'view') THEN 0.7 ELSE 1.0 END::DOUBLE AS confidence FROM v")
def adx_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = C("product_id").isin("click", "view")
    regime, conf = S.adx_regime(F.when(known, "CHAOTIC").otherwise("UNKNOWN"), F.lit(0.7), C("adx"))
    return ta_indicators(domain.bars(spark, sf_dir)).select("product_id", F.unix_seconds("start").alias("start"), regime.alias("regime"), conf.alias("confidence"))


@query("sig14_kelly_fraction", f"WITH {_GATE} SELECT seq, {q.r('greatest(0, least(2 * p - 1, 0.25))')} AS kelly FROM gt")
def kelly_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_inputs(spark, sf_dir).select("seq", rounded(S.kelly_fraction(C("p"))).alias("kelly"))


_KS = f"{_GATE}, ks AS (SELECT seq, p, (price % 100) / 100.0 AS mp, 1000 + volume * 10 AS bank, volume * 51 AS ex FROM gt), kz AS (SELECT *, p - mp AS edge, (p - mp) / nullif(1 - mp, 0) AS fk, greatest(0, 5000 - ex) AS room FROM ks)"


@query("sig15_kelly_size", f"WITH {_KS} SELECT seq, {q.cols(usd='CASE WHEN abs(edge) < 0.08 OR mp <= 0.01 OR mp >= 0.99 OR fk <= 0 THEN 0.0 ELSE greatest(0, least(fk * 0.25 * bank, 500, room)) END', edge='edge')}, "
       "CASE WHEN abs(edge) < 0.08 THEN 'edge below minimum' WHEN mp <= 0.01 OR mp >= 0.99 THEN 'market price too extreme' WHEN fk <= 0 THEN 'negative Kelly' WHEN least(fk * 0.25 * bank, 500, room) < 1 THEN 'below $1 after caps' END AS skip_reason FROM kz")
def kelly_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes at full precision."""
    df = gate_inputs(spark, sf_dir).withColumns({"mp": C("price") % 100 / 100, "bank": 1000 + C("volume") * 10, "ex": C("volume") * 51})
    sized = df.withColumn("k", S.kelly_size(C("p"), C("mp"), C("bank"), C("ex"), digits=12))
    return sized.select("seq", rounded(C("k.recommended_usd")).alias("usd"), rounded(C("k.edge")).alias("edge"), C("k.skip_reason").alias("skip_reason"))


@query("sig16_arb_size", f"WITH {_GATE}, a AS (SELECT seq, p * 0.5 + 0.01 AS yes, (price % 40) / 100.0 + 0.01 AS no, price * 100 AS bank, volume * 60 AS ex FROM gt), z AS (SELECT *, least(1000, bank * 0.10, greatest(0, 5000 - ex)) AS size FROM a) "
       f"SELECT seq, {q.cols(usd='size', yes_leg='size * yes / (yes + no)', roi_pct='(1 - yes - no) / (yes + no) * 100', locked='(1 - yes - no) * size')} FROM z")
def arb_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = gate_inputs(spark, sf_dir).select(
        "seq", S.arb_size(C("p") * 0.5 + 0.01, C("price") % 40 / 100 + 0.01, C("price") * 100, C("volume") * 60, digits=12).alias("a"))
    return df.select("seq", rounded(C("a.recommended_usd")).alias("usd"), rounded(C("a.yes_leg")).alias("yes_leg"), rounded(C("a.roi_pct")).alias("roi_pct"), rounded(C("a.locked_profit")).alias("locked"))


@query("sig17_atr_size", f"WITH {_GATE} SELECT seq, {q.cols(base='CASE WHEN volume / 10 <= 0 THEN 500.0 ELSE least(500, 1000 * 0.01 / (volume / 10 * 2)) END', quote='CASE WHEN volume / 10 <= 0 THEN 500.0 ELSE least(500, 1000 * 0.01 / (volume / 10 * 2) * price) END')} FROM gt")
def atr_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance, atr = F.lit(1000.0), C("volume") / 10
    return gate_inputs(spark, sf_dir).select(
        "seq", rounded(S.atr_size(balance, atr)).alias("base"), rounded(S.atr_size(balance, atr, C("price"), units="quote")).alias("quote"))


@query("sig18_fear_greed", f"WITH {_GATE}, fg AS (SELECT ts AS ft, volume::INT AS score FROM ticks WHERE product_id = 'error'), s AS (SELECT seq, ts, CASE WHEN price >= 50 THEN 'BUY' ELSE 'SELL' END AS side FROM ticks WHERE product_id <> 'error'), "
       "j AS (SELECT s.*, score FROM s ASOF LEFT JOIN fg ON s.ts >= fg.ft) SELECT seq, side <> 'BUY' OR score IS NULL OR score >= 20 AS allowed, CASE WHEN score < 25 THEN 'Extreme Fear' WHEN score < 50 THEN 'Fear' WHEN score < 75 THEN 'Greed' WHEN score IS NOT NULL THEN 'Extreme Greed' END AS label FROM j")
def fear_greed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain.ticks(spark, sf_dir)
    index = t.where(C("product_id") == "error").select(C("ts").alias("ft"), C("volume").cast("int").alias("score"))
    s = t.where(C("product_id") != "error").withColumn("side", F.when(C("price") >= 50, "BUY").otherwise("SELL"))
    df = asof_scan(s, index, [], "ts", "ft", ["score"])
    return df.select("seq", S.fear_greed_allows(C("side"), C("score")).alias("allowed"), F.when(C("score").isNotNull(), S.fear_greed_label(C("score"))).alias("label"))


@query("sig19_long_short_sentiment", f"WITH {_GATE} SELECT seq, {q.r('least(1, greatest(-1, price / 50 - (1 - p)))')} AS sentiment FROM gt")
def long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_inputs(spark, sf_dir).select("seq", rounded(S.long_short_sentiment(C("price") / 50, 1 - C("p"))).alias("sentiment"))


@query("ind27_iv_rv_spread", values_cte(["realized_vol", "realized_vol_60"]) + f" SELECT product_id, start, {q.r('round(least(1, greatest(-1, volume / 1000 - realized_vol)), 4)')} AS spread20, {q.r('round(least(1, greatest(-1, volume / 1000 - realized_vol_60)), 4)')} AS spread60 FROM v")
def iv_rv_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.operators import indicators as ind
    from tickloom.operators.blocks import blocked, core_rows

    df = core_rows(ind.with_indicators(blocked(domain.bars(spark, sf_dir), 60), [ind.realized_vol(), ind.realized_vol(60, name="realized_vol_60")]))
    iv = C("volume") / 1000
    return df.select("product_id", F.unix_seconds("start").alias("start"), S.iv_rv_spread(iv, C("realized_vol")).alias("spread20"), S.iv_rv_spread(iv, C("realized_vol_60")).alias("spread60"))


@query("sig20_indicator_summary", f"WITH {T} SELECT seq, CASE seq % 4 WHEN 0 THEN 'RSI=' || volume::INT || ' MACD=' || CASE WHEN price > 50 THEN 'bull' ELSE 'bear' END WHEN 1 THEN 'mom5d=+' || volume::INT || '.0%' WHEN 2 THEN 'ADX=' || volume::INT || ' regime=' || product_id ELSE '' END AS summary FROM ticks")
def indicator_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain.ticks(spark, sf_dir)
    source = F.element_at(F.array(*[F.lit(x) for x in ("TECH", "MOMENTUM", "CNN", "NONE")]), (C("seq") % 4 + 1).cast("int"))
    values = (
        F.when(C("seq") % 4 == 0, F.create_map(F.lit("rsi"), C("volume").cast("string"), F.lit("macd_h"), (C("price") - 50).cast("string")))
        .when(C("seq") % 4 == 1, F.create_map(F.lit("mom_s"), (C("volume") / 100).cast("string")))
        .otherwise(F.create_map(F.lit("adx"), C("volume").cast("string"), F.lit("regime"), C("product_id"))))
    return t.withColumns({"source": source, "indicators": values}).select("seq", S.indicator_summary(C("source")).alias("summary"))


@query("sig22_extract_probability", f"WITH {T} SELECT seq, CASE seq % 4 WHEN 0 THEN CASE WHEN price / 100 <= 1 THEN round(price / 100, 6) END WHEN 1 THEN volume / 100 WHEN 2 THEN NULL ELSE NULL END::DOUBLE AS prob FROM ticks")
def extract_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain.ticks(spark, sf_dir)
    text = (
        F.when(C("seq") % 4 == 0, F.to_json(F.struct(F.round(C("price") / 100, 6).alias("probability"))))
        .when(C("seq") % 4 == 1, F.concat(F.lit("I would say 0."), F.lpad(C("volume").cast("int").cast("string"), 2, "0"), F.lit(" or so")))
        .when(C("seq") % 4 == 2, F.lit('{"other": 1}')).otherwise("no idea, 7 out of 10"))
    return t.select("seq", S.extract_probability(text).alias("prob"))


# -- dataset bookkeeping -------------------------------------------------------------------

# Stored high-water marks: what the dataset looked like at earlier times, one product each.
_MARKS = f"{T}, {B}, nw AS (SELECT product_id, count(*) AS n, min(start) AS f FROM bars GROUP BY 1), mk AS (SELECT product_id, f + CASE WHEN product_id = 'error' THEN 3600 ELSE 0 END AS first_start, CASE product_id WHEN 'click' THEN n WHEN 'view' THEN n - 30 WHEN 'signup' THEN n + 5 ELSE n - 1 END AS last_n FROM nw WHERE product_id <> 'purchase')"


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = domain.bars(spark, sf_dir).groupBy("product_id").agg(F.count("*").alias("n"), F.min("start").alias("f")).where(C("product_id") != "purchase")
    last = F.when(C("product_id") == "click", C("n")).when(C("product_id") == "view", C("n") - 30).when(C("product_id") == "signup", C("n") + 5).otherwise(C("n") - 1)
    first = F.when(C("product_id") == "error", C("f") + F.expr("interval 1 hour")).otherwise(C("f"))
    return now.select("product_id", first.alias("first_start"), last.alias("last_n"))


_STATUS = _MARKS + ", st AS (SELECT nw.product_id, n, CASE WHEN n < 65 THEN 'skip' WHEN last_n IS NULL OR first_start <> f OR last_n > n THEN 'rebuild' WHEN last_n = n THEN 'hit' ELSE 'append' END AS status, last_n FROM nw LEFT JOIN mk ON nw.product_id = mk.product_id)"


@query("ds8_dataset_status", f"WITH {_STATUS} SELECT product_id, n, status, CASE status WHEN 'append' THEN greatest(59, last_n - 4) WHEN 'rebuild' THEN 59 END AS from_idx FROM st")
def dataset_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.dataset_status(domain.bars(spark, sf_dir), marks(spark, sf_dir)).select("product_id", "n", "status", "from_idx")


@query("ds8_incremental_samples", f"{LABELS}, {_STATUS.split(', ', 1)[1].split(B + ', ')[1]} SELECT sm.product_id, idx, label FROM sm JOIN st ON sm.product_id = st.product_id WHERE is_sample AND idx >= CASE status WHEN 'append' THEN greatest(59, last_n - 4) WHEN 'rebuild' THEN 59 ELSE 999999999 END")
def incremental_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = domain.bars(spark, sf_dir)
    df = features.incremental_samples(labels.labelled(b), features.dataset_status(b, marks(spark, sf_dir)))
    return df.select("product_id", "idx", "label")


@query("agg21_status_summary", f"WITH {_STATUS} SELECT status, count(*) AS n FROM st GROUP BY 1")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(features.dataset_status(domain.bars(spark, sf_dir), marks(spark, sf_dir)), "status")


@query("agg21_label_summary", f"{LABELS} SELECT count(*) AS samples, {q.r('avg(label) * 100')} AS positive_pct FROM sm WHERE is_sample")
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports.label_summary(sample_rows(spark, sf_dir))
    return df.select("samples", rounded(C("positive_pct")).alias("positive_pct"))


@query("agg15_class_balance", f"{LABELS}, cb AS (SELECT sum((label >= 0.5)::INT)::BIGINT AS n_pos, sum((label < 0.5)::INT)::BIGINT AS n_neg FROM sm WHERE is_sample) SELECT n_pos, n_neg, {q.r('CASE WHEN n_pos > 0 AND n_neg > 0 THEN n_neg / n_pos ELSE 1.0 END')} AS pos_weight FROM cb")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.class_balance(sample_rows(spark, sf_dir)).select("n_pos", "n_neg", rounded(C("pos_weight")).alias("pos_weight"))


@query("ds9_fingerprint", f"WITH {T}, {B}, k AS (SELECT product_id, count(*) AS n, min(start) AS a, max(start) AS b, arg_max(close, start) AS c FROM bars GROUP BY 1), "
       "d AS (SELECT sha256(product_id || '|' || n || '|' || a || '|' || b || '|' || printf('%.6f', c)) AS d FROM k), "
       "d1 AS (SELECT left(d, 5) AS p, sha256(string_agg(d, ',' ORDER BY d)) AS d FROM d GROUP BY 1), d2 AS (SELECT left(p, 3) AS p, sha256(string_agg(d, ',' ORDER BY d)) AS d FROM d1 GROUP BY 1) "
       "SELECT sha256('horizon=4;seq_len=60;version=7' || '#' || string_agg(d, ',' ORDER BY d)) AS fingerprint FROM d2")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.fingerprint(domain.bars(spark, sf_dir), seq_len=60, horizon=4, version=7)


@query("ds10_time_split", f"{LABELS}, cu AS (SELECT quantile_disc(start, 0.8) AS cut FROM sm WHERE is_sample) SELECT product_id, idx, CASE WHEN start <= cut THEN 'train' ELSE 'val' END AS split FROM sm, cu WHERE is_sample")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.time_split(sample_rows(spark, sf_dir), "start").select("product_id", "idx", "split")


_ENTRY = f"{T}, en AS (SELECT seq, volume / 100 AS cnn_prob, CASE WHEN seq % 5 <> 0 THEN price END AS rsi, price - 50 AS pnl, hour(ts) AS hour_of_day, dayofweek(ts) AS day_of_week FROM ticks)"


def entry_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades with entry features, derived from ticks; every fifth lacks a feature."""
    t = domain.ticks(spark, sf_dir)
    return models.entry_rows(t.select(
        "seq", "ts", (C("volume") / 100).alias("cnn_prob"), F.when(C("seq") % 5 != 0, C("price")).alias("rsi"), (C("price") - 50).alias("pnl"),
        (C("volume") % 30).alias("adx"), F.lit(float("nan")).alias("strength"), (C("price") % 7).alias("macd"), C("volume").alias("mfi"),
        (C("price") % 100).alias("stoch_k"), F.hour("ts").alias("hour_of_day"), (F.dayofweek("ts") - 1).alias("day_of_week"), F.lit(100.0).alias("usd_open")))


@query("ds11_entry_rows", f"WITH {_ENTRY} SELECT seq, {q.cols(cnn_prob='cnn_prob', rsi='coalesce(rsi, 0)', strength='0.0', hour_of_day='hour_of_day', day_of_week='day_of_week', weight='greatest(abs(pnl), 1e-3)')}, CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM en")
def entry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("cnn_prob", "rsi", "strength", "hour_of_day", "day_of_week", "weight")
    return entry_inputs(spark, sf_dir).select("seq", *[rounded(C(c)).alias(c) for c in names], "label")


_OBS = f"WITH {T}, {B}, r AS (SELECT product_id, start, row_number() OVER v - 1 AS idx, ln(close / lag(close) OVER v) AS lr FROM bars WINDOW v AS (PARTITION BY product_id ORDER BY start)), ob AS (SELECT product_id, start, idx, lr, stddev_pop(lr) OVER (PARTITION BY product_id ORDER BY start ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS vol FROM r)"


@query("ds12_regime_observations", f"{_OBS} SELECT product_id, start, {q.cols(log_ret='lr', vol='vol')} FROM ob WHERE idx >= 11")
def regime_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labels.regime_observations(domain.bars(spark, sf_dir))
    return df.select("product_id", F.unix_seconds("start").alias("start"), rounded(C("log_ret")).alias("log_ret"), rounded(C("vol")).alias("vol"))


@query("ds14_enough_history", f"WITH {q.ticks('user_id')}, {B}, n AS (SELECT product_id, count(*) AS n FROM bars GROUP BY 1) SELECT bars.product_id, start FROM bars JOIN n ON bars.product_id = n.product_id WHERE n >= 65")
def enough_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = domain.bars(spark, sf_dir, key="user_id")
    return labels.enough_history(b, b, 65).select("product_id", F.unix_seconds("start").alias("start"))


# -- models --------------------------------------------------------------------------------

# Trades met by the scans around them; P&L is null, zero, a gain or a loss, and features have gaps.
_JOINED = f"""WITH {q.SCANS}, tr AS (SELECT product_id, ts AS opened_at, s AS os, seq AS trade, volume, CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 13 = 0 THEN 0.0 ELSE price - 50 END AS pnl, price AS paid FROM ticks WHERE volume >= 50),
 jn AS (SELECT t.*, b.seq AS scan, b.model_prob, b.price AS seen FROM tr t JOIN scans b ON t.product_id = b.product_id AND abs(t.os - b.s) < 120 WHERE b.model_prob < 0.5)"""


def joined_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Trades and scans with what each of them says alone, computed before the join makes pairs of them."""
    t = domain.ticks(spark, sf_dir).where(C("volume") >= 50)
    pnl = F.when(C("seq") % 11 == 0, F.lit(None)).when(C("seq") % 13 == 0, 0.0).otherwise(C("price") - 50)
    trades = t.select(
        "product_id", C("ts").alias("opened_at"), C("seq").alias("trade"), C("volume").alias("mfi"), pnl.alias("pnl"), C("price").alias("usd_open"),
        F.hour("ts").alias("hour_of_day"), (F.dayofweek("ts") - 1).alias("day_of_week"))
    scans = domain.scans(spark, sf_dir).where(C("model_prob") < 0.5).select(
        "product_id", "scanned_at", C("seq").alias("scan"), C("model_prob").alias("cnn_prob"), C("price").alias("seen"),
        F.when(C("seq") % 5 != 0, C("price")).alias("rsi"), F.when(C("seq") % 7 == 0, F.lit(float("nan"))).otherwise(C("price") % 30).alias("adx"),
        (C("price") % 100).alias("stoch_k"))
    return trades, scans


def paired(trades: DataFrame, scans: DataFrame) -> DataFrame:
    pairs = band_join(trades, scans, ["product_id"], "opened_at", "scanned_at", 120)
    return pairs.withColumn("macd", C("usd_open") - C("seen")).drop("product_id", "scanned_at", "seen")


@query("ds11_joined_entry_rows", f"{_JOINED} SELECT trade, scan, {q.cols(cnn_prob='model_prob', rsi='CASE WHEN scan % 5 <> 0 THEN seen ELSE 0 END', adx='CASE WHEN scan % 7 = 0 THEN 0 ELSE seen % 30 END', macd='paid - seen', strength='0.0', hour_of_day='hour(opened_at)', day_of_week='dayofweek(opened_at)', weight='greatest(abs(coalesce(pnl, 0)), 1e-3)')}, CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM jn")
def joined_entry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry rows of trades joined with the scans around them; each side is cleaned and rounded before it meets the other."""
    trades, scans = joined_sides(spark, sf_dir)
    own = [rounded(C(c)).alias(c) for c in ("strength", "hour_of_day", "day_of_week", "weight")]
    trades = models.EntryRows().transform(trades.withColumn("paid", C("usd_open"))).select("product_id", "opened_at", "trade", "paid", *own, "label")
    scans = models.EntryRows().transform(scans).select("product_id", "scanned_at", "scan", "seen", *[rounded(C(c)).alias(c) for c in ("cnn_prob", "rsi", "adx")])
    pairs = band_join(trades, scans, ["product_id"], "opened_at", "scanned_at", 120)
    macd = models.gap_filled(C("paid") - C("seen"))
    return pairs.select(
        "trade", "scan", "cnn_prob", "rsi", "adx", rounded(macd).alias("macd"), "strength", "hour_of_day", "day_of_week", "weight", "label")


def alike_pairs(trades: DataFrame, scans: DataFrame) -> DataFrame:
    """The pairs of ``paired`` with one row for equal ones and their number ``copies``, but for the ids; ``macd`` is left to be taken from ``usd_open`` and ``seen``.

    Times count in whole seconds, as in the join. Equal trades and equal scans are one row before they meet, so no pair is moved to be counted.
    """
    def alike(df: DataFrame, ts: str, key: str, number: str) -> DataFrame:
        df = df.drop(key).withColumn(ts, F.date_trunc("second", ts))
        return df.groupBy(*df.columns).agg(F.count("*").alias(number))

    pairs = band_join(alike(trades, "opened_at", "trade", "__trades"), alike(scans, "scanned_at", "scan", "__scans"), ["product_id"], "opened_at", "scanned_at", 120)
    return pairs.withColumn("copies", C("__trades") * C("__scans")).drop("product_id", "scanned_at", "__trades", "__scans")


@query("ml1_ml2_entry_filter")
def entry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the older trades, store the model, and let the one read back gate the newer trades.

    The pairs to learn from are written once, by columns, and read from there.
    """
    trades, scans = joined_sides(spark, sf_dir)
    alike = stored(alike_pairs(trades, scans))
    train = labels.time_split(alike, "opened_at", rows=C("copies")).where(C("split") == "train").withColumn("macd", C("usd_open") - C("seen"))
    model = models.train_entry_filter(train, copies=C("copies"))
    if model is not None:
        path = f"{shared_dir(spark)}/entry-filter-{uuid.uuid4().hex}"
        models.save_entry_filter(model, path)
        model = models.load_entry_filter(path)
    last = train.agg(F.max(F.unix_seconds("opened_at"))).first()[0]
    newer = trades if last is None else trades.where(F.unix_seconds("opened_at") > last)
    return models.gate_entries(model, paired(newer, scans)).select("trade", "scan", "entry_prob", "allow")


@query("ml2_entry_gate", f"WITH {T} SELECT seq, volume >= 52 AND seq % 9 > 0 AND seq % 10 > 0 AS allow FROM ticks")
def entry_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate on given probabilities; null and NaN do not pass."""
    prob = F.when(C("seq") % 9 == 0, F.lit(None)).when(C("seq") % 10 == 0, F.lit(float("nan"))).otherwise(C("volume") / 100)
    return models.gate(domain.ticks(spark, sf_dir).withColumn("entry_prob", prob)).select("seq", "allow")


@query("ml1_readiness", f"WITH {T} SELECT count(*) AS n, sum((price > 50)::INT)::BIGINT AS wins, count(*) >= 50 AND sum((price > 50)::INT) >= 20 AND sum((price > 50)::INT) < count(*) AS ready FROM ticks")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.readiness(entry_inputs(spark, sf_dir))


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.regime_observations(domain.bars(spark, sf_dir)).select("product_id", "start", "idx", "log_ret", "vol")


@query("ml3_ml4_ml5_regimes")
def fitted_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit jointly on every product's series, decode every product."""
    obs = materialize(_observed(spark, sf_dir))
    model = regimes.fit_regimes(obs)
    return regimes.decode_regimes(model, obs).select("product_id", F.unix_seconds("start").alias("start"), "regime", rounded(C("confidence")).alias("confidence"))


# A fixed model, so that SQL can follow it: (mean and variance of return, of volatility), start and moves.
_FIXED = regimes.RegimeModel(
    np.array([[0.0, 1.0], [0.1, 1.4], [-0.1, 1.9]]), np.array([[0.8, 0.06], [1.6, 0.09], [3.0, 0.2]]),
    np.array([0.5, 0.3, 0.2]), np.array([[0.9, 0.07, 0.03], [0.1, 0.8, 0.1], [0.05, 0.15, 0.8]]))


def _density(i: int) -> str:
    (m, v), (a, b) = _FIXED.means[i], _FIXED.variances[i]
    return f"-0.5 * (pow(lr - {float(m)!r}, 2) / {float(a)!r} + pow(vol - {float(v)!r}, 2) / {float(b)!r} + {float(np.log(2 * np.pi * a) + np.log(2 * np.pi * b))!r})"


def _walks() -> str:
    """One step after the other through every series: best path scores, forward and backward probabilities."""
    three = range(3)
    start, move = _FIXED.start.tolist(), _FIXED.transition.tolist()
    best = ", ".join(f"greatest({', '.join(f'w.s{i} + {float(np.log(move[i][j]))!r}::DOUBLE' for i in three)}) + d.d{j} AS s{j}" for j in three)
    ahead = ", ".join(f"({' + '.join(f'w.a{i} * {move[i][j]!r}::DOUBLE' for i in three)}) / (w.a0 + w.a1 + w.a2) * exp(d.d{j} - d.top) AS a{j}" for j in three)
    back = ", ".join(f"({' + '.join(f'{move[i][j]!r}::DOUBLE * exp(d.d{j} - d.top) * w.b{j}' for j in three)}) / (w.b0 + w.b1 + w.b2) AS b{i}" for i in three)
    return (
        f"{_OBS.replace('WITH ', 'WITH RECURSIVE ', 1)}, dd AS (SELECT product_id, start, idx, lr, vol, {', '.join(f'{_density(i)} AS d{i}' for i in three)} FROM ob WHERE idx >= 11), "
        "d AS MATERIALIZED (SELECT *, greatest(d0, d1, d2) AS top, min(idx) OVER (PARTITION BY product_id) AS lo, max(idx) OVER (PARTITION BY product_id) AS hi FROM dd), "
        f"f AS (SELECT product_id, idx, {', '.join(f'{float(np.log(start[j]))!r}::DOUBLE + d{j} AS s{j}' for j in three)}, {', '.join(f'{start[j]!r}::DOUBLE * exp(d{j} - top) AS a{j}' for j in three)} FROM d WHERE idx = lo "
        f"UNION ALL SELECT d.product_id, d.idx, {best}, {ahead} FROM f w JOIN d ON d.product_id = w.product_id AND d.idx = w.idx + 1), "
        "g AS (SELECT product_id, idx, 1.0::DOUBLE AS b0, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2 FROM d WHERE idx = hi "
        f"UNION ALL SELECT d.product_id, d.idx - 1, {back} FROM g w JOIN d ON d.product_id = w.product_id AND d.idx = w.idx WHERE d.idx > d.lo)"
    )


@query("ml4_ml5_regime_decode", f"{_walks()}, st AS (SELECT f.*, d.start, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS k FROM f JOIN d USING (product_id, idx)) "
       f"SELECT product_id, start, ['RANGING', 'TRENDING', 'CHAOTIC'][k + 1] AS regime, {q.cols(confidence='[a0, a1, a2][k + 1] / (a0 + a1 + a2)')} FROM st")
def regime_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regime and confidence at every bar under a fixed model."""
    df = regimes.decode_regimes(_FIXED, _observed(spark, sf_dir))
    return df.select("product_id", F.unix_seconds("start").alias("start"), "regime", rounded(C("confidence")).alias("confidence"))


_GAMMA = ", ".join(f"a{i} * b{i} / (a0 * b0 + a1 * b1 + a2 * b2) AS g{i}" for i in range(3))
_MOVES = ", ".join(f"fa{i} * {float(_FIXED.transition[i, j])!r}::DOUBLE * e{j} * b{j} AS x{i}{j}" for i in range(3) for j in range(3))
_EVERY = " + ".join(f"x{i}{j}" for i in range(3) for j in range(3))


@query("ml3_expected_counts", f"{_walks()}, h AS (SELECT f.*, b0, b1, b2, lr, vol, top, lo, {_GAMMA} FROM f JOIN g USING (product_id, idx) JOIN d USING (product_id, idx)), "
       f"p AS (SELECT {_MOVES} FROM (SELECT f.a0 AS fa0, f.a1 AS fa1, f.a2 AS fa2, b0, b1, b2, exp(d0 - top) AS e0, exp(d1 - top) AS e1, exp(d2 - top) AS e2 FROM f JOIN d ON d.product_id = f.product_id AND d.idx = f.idx + 1 JOIN g ON g.product_id = d.product_id AND g.idx = d.idx)), "
       f"m AS (SELECT {', '.join(f'sum(x{i}{j} / ({_EVERY})) AS move{i}{j}' for i in range(3) for j in range(3))} FROM p), "
       f"k AS (SELECT sum(ln(a0 + a1 + a2) + top) AS loglik, {', '.join(f'sum(g{i}) FILTER (WHERE idx = lo) AS start{i}, sum(g{i}) AS weight{i}, sum(g{i} * lr) AS ret{i}, sum(g{i} * vol) AS vol{i}, sum(g{i} * lr * lr) AS ret2_{i}, sum(g{i} * vol * vol) AS vol2_{i}' for i in range(3))} FROM h) "
       f"SELECT name, {q.r('value', 4)} AS value FROM (UNPIVOT (SELECT * FROM k, m) ON COLUMNS(*) INTO NAME name VALUE value)")
def regime_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One expectation step of the fit under a fixed model: log-likelihood and expected counts, one row each."""
    counts = regimes.expected_counts(_FIXED, materialize(regimes.prepared(_observed(spark, sf_dir))))
    return spark.createDataFrame(sorted(counts.items()), "name string, value double").select("name", rounded(C("value"), 4).alias("value"))


def _trained(spark: SparkSession, sf_dir: str) -> tuple[object, DataFrame]:
    data = materialize(labels.time_split(features.masked(dataset(spark, sf_dir)), "start"))
    return models.train_window_classifier(data.where(C("split") == "train")), data.where(C("split") == "val")


def stored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier training sessions: one an order, its loss read off the order's total."""
    o = domain.table(spark, sf_dir, "orders")
    return o.select(C("o_orderkey").alias("session_id"), C("o_orderdate").alias("started_at"), (C("o_totalprice") / 400_000).alias("val_loss"))


@query("ml7_ml8_window_classifier")
def window_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation report of the window classifier, saved if better than the stored sessions."""
    model, val = _trained(spark, sf_dir)
    report = models.validation_report(models.score_windows(model, val))
    return models.keep_if_better(report, stored_sessions(spark, sf_dir))


@query("ds6_ml8_fold_report")
def fold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window classifier under purged walk-forward validation, a row a fold."""
    data = materialize(features.masked(dataset(spark, sf_dir)))
    roles = labels.walk_forward(labels.sample_positions(data.select("product_id", "idx")))
    return models.fold_report(data, roles, models.train_window_classifier, models.score_windows)


@query("ml8_keep_if_better", "WITH ss AS (SELECT o_orderkey AS id, o_totalprice / 400000 AS loss FROM orders) SELECT id AS session_id, loss < (SELECT min(loss) FROM ss WHERE loss >= 0.1) AS saved FROM ss")
def keep_if_better(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the sessions would have been saved over the plausible losses of all of them."""
    sessions = stored_sessions(spark, sf_dir)
    return models.keep_if_better(sessions, sessions).select("session_id", "saved")


@query("ml9_channel_importance")
def channel_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _trained(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(models.channel_importance(model))), "channel int, importance double")


@query("fil19_training_sessions", "SELECT o_orderkey AS session_id, o_totalprice AS val_loss FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def training_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = domain.table(spark, sf_dir, "orders").select(C("o_orderkey").alias("session_id"), C("o_orderdate").alias("started_at"), C("o_totalprice").alias("val_loss"))
    return models.latest_session(s).select("session_id", "val_loss")
