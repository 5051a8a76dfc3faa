"""Label, dataset and alignment queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import scoring as S
from tickloom.functions.columns import rounded, single
from tickloom.operators import alignment, features, labels
from tickloom.plans import domain, sqlparts as q
from tickloom.plans.indicator_plans import VALUE, base, slope_sql
from tickloom.plans.registry import query
from tickloom.session import materialize, shared_dir
from tickloom.sources.bars import read_bars, write_bars
from tickloom.sources.window_store import read_windows, top_up_windows

C = F.col
REFERENCE = "click"


def _start() -> Column:
    return F.unix_seconds("start").alias("start")


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.bars(spark, sf_dir).where(C("product_id") == REFERENCE)


# -- alignment -----------------------------------------------------------------------------

# Every third reference bar is dropped so that the fill has gaps to bridge.
_REF_SQL = f"refb AS (SELECT start AS rs, close AS ref_close FROM bars WHERE product_id = '{REFERENCE}' AND start // 3600 % 3 <> 0)"
_ALIGN = f"WITH {q.ticks()}, {q.bars()}, {_REF_SQL}, al AS (SELECT b.*, coalesce(r.ref_close, (SELECT arg_min(ref_close, rs) FROM refb)) AS ref_close FROM bars b ASOF LEFT JOIN refb r ON b.start >= r.rs)"


@query("join2_asof_closes", f"{_ALIGN} SELECT product_id, start, {q.cols(ref_close='ref_close')} FROM al")
def asof_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = reference(spark, sf_dir).where(F.unix_seconds("start") / 3600 % 3 != 0)
    df = features.aligned_closes(domain.bars(spark, sf_dir), ref)
    return df.select("product_id", _start(), rounded(C("ref_close")).alias("ref_close"))


FUNDING_SQL = (
    q.bars(28800, "bars8") + ", fund AS (SELECT product_id, start AS ft, (close - pc) / pc / 100 AS rate FROM "
    "(SELECT *, lag(close) OVER (PARTITION BY product_id ORDER BY start) AS pc FROM bars8) WHERE pc IS NOT NULL), "
    "ff AS (SELECT product_id, arg_min(rate, ft) AS r0 FROM fund GROUP BY 1)"
)


@query("join3_asof_funding", f"WITH {q.ticks()}, {q.bars()}, {FUNDING_SQL} SELECT b.product_id, b.start, {q.r('coalesce(f.rate, ff.r0)', 9)} AS funding_rate "
       "FROM bars b ASOF LEFT JOIN fund f ON b.product_id = f.product_id AND b.start >= f.ft LEFT JOIN ff ON b.product_id = ff.product_id")
def asof_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.aligned_funding(domain.bars(spark, sf_dir), domain.funding(spark, sf_dir))
    return df.select("product_id", _start(), rounded(C("funding_rate"), 9).alias("funding_rate"))


FAST_SQL = (
    q.bars(300, "bars5") + ", a5 AS (SELECT *, row_number() OVER v - 1 AS idx, close - lag(close) OVER v AS diff, lag(close, 12) OVER v AS c12 "
    "FROM bars5 WINDOW v AS (PARTITION BY product_id ORDER BY start)), "
    "b5 AS (SELECT *, list(diff) FILTER (WHERE diff IS NOT NULL) OVER (v ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS d5, "
    "avg(volume) OVER (v ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m60, stddev_pop(volume) OVER (v ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS s60 "
    "FROM a5 WINDOW v AS (PARTITION BY product_id ORDER BY start)), "
    f"f5 AS (SELECT product_id, start AS fs, CASE WHEN idx < 13 THEN 0.5 ELSE ({q.rsi(12, 'd5')}) / 100 END AS fast_rsi, "
    "CASE WHEN idx < 13 THEN 0.0 ELSE least(1, greatest(-1, (close - c12) / greatest(c12, 1e-9) / 12 / 0.005)) END AS velocity, "
    "CASE WHEN idx < 13 THEN 0.0 ELSE least(1, greatest(-1, (volume - m60) / greatest(s60, 1e-9) / 3)) END AS volume_z FROM b5)"
)
_FAST_COLS = ("fast_rsi", "velocity", "volume_z")


@query("ind21_22_23_fast_features", f"WITH {q.ticks()}, {FAST_SQL} SELECT product_id, fs AS start, {q.cols(**{c: c for c in _FAST_COLS})} FROM f5")
def fast_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.fast_features(domain.bars(spark, sf_dir, "FIVE_MINUTE"))
    return df.select("product_id", F.unix_seconds("fast_start").alias("start"), *[rounded(C(c)).alias(c) for c in _FAST_COLS])


@query("join4_asof_fast_slice", f"WITH {q.ticks()}, {q.bars()}, {FAST_SQL} SELECT b.product_id, b.start, "
       + q.cols(fast_rsi="coalesce(f.fast_rsi, 0.5)", velocity="coalesce(f.velocity, 0.0)", volume_z="coalesce(f.volume_z, 0.0)")
       + " FROM bars b ASOF LEFT JOIN f5 f ON b.product_id = f.product_id AND b.start + 3600 > f.fs")
def asof_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.with_fast_features(domain.bars(spark, sf_dir), features.fast_features(domain.bars(spark, sf_dir, "FIVE_MINUTE")))
    return df.select("product_id", _start(), *[rounded(C(c)).alias(c) for c in _FAST_COLS])


_CORR = (
    ", cr AS (SELECT *, row_number() OVER v - 1 AS idx, (close - lag(close) OVER v) / greatest(lag(close) OVER v, 1e-9) AS ra, "
    "(ref_close - lag(ref_close) OVER v) / greatest(lag(ref_close) OVER v, 1e-9) AS rb FROM al WINDOW v AS (PARTITION BY product_id ORDER BY start)), "
    "cc AS (SELECT product_id, start, corr(ra, rb) OVER w AS c, count(ra) OVER w AS n, stddev_pop(ra) OVER w AS sa, stddev_pop(rb) OVER w AS sb "
    "FROM cr WINDOW w AS (PARTITION BY product_id ORDER BY start ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"
)


@query("ind20_return_correlation", _ALIGN + _CORR + f" SELECT product_id, start, {q.r('CASE WHEN n >= 5 AND sa > 0 AND sb > 0 AND NOT isnan(c) THEN least(1, greatest(-1, c)) ELSE 0.0 END')} AS ref_corr FROM cc")
def return_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.operators import indicators as ind
    from tickloom.operators.blocks import core_rows, halo, index_bars

    ref = reference(spark, sf_dir).where(F.unix_seconds("start") / 3600 % 3 != 0)
    df = halo(features.aligned_closes(index_bars(domain.bars(spark, sf_dir)), ref), 20)
    df = core_rows(ind.with_indicators(df, [ind.return_correlation("ref_close")]))
    return df.select("product_id", _start(), rounded(C("ref_corr")).alias("ref_corr"))


# -- labels --------------------------------------------------------------------------------

def _label_sql(h: int = 4) -> str:
    leads = ", ".join(f"lead({c}, {k}) OVER v AS {a}{k}" for k in range(1, h + 1) for a, c in (("h", "high"), ("l", "low"), ("c", "close")))
    whens = " ".join(
        f"WHEN h{k} >= close * (1 + 0.01::DOUBLE) AND l{k} <= close * (1 - 0.01::DOUBLE) THEN CASE WHEN c{k} > close THEN 1.0 WHEN c{k} < close THEN 0.0 END "
        f"WHEN h{k} >= close * (1 + 0.01::DOUBLE) THEN 1.0 WHEN l{k} <= close * (1 - 0.01::DOUBLE) THEN 0.0" for k in range(1, h + 1))
    final = "coalesce(" + ", ".join(f"c{k}" for k in range(h, 0, -1)) + ", close)"
    move = f"(({final} - close) / close)"
    return (
        f"ld AS (SELECT *, row_number() OVER v - 1 AS idx, {leads} FROM bars WINDOW v AS (PARTITION BY product_id ORDER BY start)), "
        f"lb AS (SELECT *, (CASE WHEN close <= 0 THEN NULL {whens} ELSE CASE WHEN abs({move}) < 0.003 THEN NULL WHEN {move} > 0 THEN 1.0 ELSE 0.0 END END)::DOUBLE AS label FROM ld), "
        f"sm AS (SELECT *, idx >= 59 AND c{h} IS NOT NULL AND label IS NOT NULL AS is_sample FROM lb)"
    )


def _weight_sql(first: int, h: int = 4) -> str:
    lo = "CURRENT ROW" if first == 0 else f"{first} PRECEDING"
    fo = "CURRENT ROW" if first == 0 else f"{first} FOLLOWING"
    return (
        f"nt AS (SELECT *, sum(CASE WHEN is_sample THEN 1 ELSE 0 END) OVER (PARTITION BY product_id ORDER BY start ROWS BETWEEN {h} PRECEDING AND {lo}) AS n_t FROM sm), "
        f"wt AS (SELECT *, avg(CASE WHEN n_t > 0 THEN 1.0::DOUBLE / n_t END) OVER (PARTITION BY product_id ORDER BY start ROWS BETWEEN {fo} AND {h} FOLLOWING) AS w FROM nt)"
    )


LABELS = f"WITH {q.ticks()}, {q.bars()}, {_label_sql()}"


@query("ds3_triple_barrier", f"{LABELS} SELECT product_id, start, label FROM sm")
def triple_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.labelled(domain.bars(spark, sf_dir)).select("product_id", _start(), "label")


@query("ds2_samples", f"{LABELS} SELECT product_id, start, idx, label FROM sm WHERE is_sample")
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(spark, sf_dir).select("product_id", _start(), "idx", "label")


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.labelled(domain.bars(spark, sf_dir)).where("is_sample")


@query("ds4_uniqueness", f"{LABELS}, {_weight_sql(1)} SELECT product_id, start, {q.cols(weight='coalesce(w, 0)')} FROM wt WHERE is_sample")
def uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(spark, sf_dir).select("product_id", _start(), rounded(C("weight")).alias("weight"))


@query("ds13_uniqueness_with_entry", f"{LABELS}, {_weight_sql(0)} SELECT product_id, start, {q.cols(weight='coalesce(w, 0)')} FROM wt WHERE is_sample")
def uniqueness_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labels.labelled(domain.bars(spark, sf_dir), include_entry=True).where("is_sample")
    return df.select("product_id", _start(), rounded(C("weight")).alias("weight"))


@query("ds5_smooth_labels", f"{LABELS} SELECT product_id, start, {q.cols(smooth='label * (1 - 2 * 0.05) + 0.05')} FROM sm WHERE is_sample")
def smooth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(spark, sf_dir).select("product_id", _start(), rounded(S.smooth_labels(C("label"))).alias("smooth"))


_FOLDS = LABELS + """, ps AS (SELECT product_id, idx, row_number() OVER (PARTITION BY product_id ORDER BY idx) - 1 AS position FROM sm WHERE is_sample),
 nn AS (SELECT product_id, count(*) AS n, count(*) // 2 AS half, greatest(1, (count(*) - count(*) // 2) // 3) AS size FROM ps GROUP BY 1),
 bd AS (SELECT *, half + fold * size AS lo, CASE WHEN fold = 2 THEN n ELSE half + fold * size + size END AS hi FROM nn, (SELECT unnest([0, 1, 2]) AS fold)),
 eg AS (SELECT b.product_id, b.fold, b.lo, b.hi, max(CASE WHEN position = lo THEN idx END) AS fv, max(CASE WHEN position = hi - 1 THEN idx END) AS lv FROM bd b JOIN ps USING (product_id) GROUP BY ALL)
 SELECT p.product_id, p.idx, p.position, e.fold::INT AS fold, CASE WHEN position >= lo AND position < hi THEN 'val' ELSE 'train' END AS role
 FROM ps p JOIN eg e ON p.product_id = e.product_id
 WHERE (position >= lo AND position < hi) OR (position < lo AND idx + 4 < fv AND NOT EXISTS (
   SELECT 1 FROM eg o WHERE o.product_id = p.product_id AND o.fold < e.fold AND p.idx > o.lv AND p.idx <= o.lv + 4))"""


@query("ds6_walk_forward", _FOLDS)
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = labels.sample_positions(sample_rows(spark, sf_dir).select("product_id", "idx"))
    return labels.walk_forward(placed).select("product_id", "idx", "position", "fold", "role")


# -- windows -------------------------------------------------------------------------------

def dataset(spark: SparkSession, sf_dir: str, precision: str = "float") -> DataFrame:
    """The full training set: 27 x 60 windows, labels and weights of every sample."""
    return features.dataset(
        domain.bars(spark, sf_dir), reference(spark, sf_dir), domain.funding(spark, sf_dir), domain.bars(spark, sf_dir, "FIVE_MINUTE"),
        precision=precision)


_PI = "2 * pi() / 24"
_LAST = {
    0: "CASE WHEN list_max(c) > list_min(c) THEN (close - list_min(c)) / (list_max(c) - list_min(c)) ELSE close - list_min(c) END",
    1: "log10(greatest(volume, 1)) / 10", 2: "(high - low) / greatest(close, 1e-9)",
    3: "least(1, greatest(-1, (close - open) / greatest(abs(open), 1e-9)))",
    4: f"({q.rsi(14, 'd[-20:]')}) / 100",
    5: f"least(1, greatest(-1, ({VALUE['macd_hist']}) / greatest(abs(close), 1) * 1000))",
    6: f"least(0.1, greatest(-0.1, (({VALUE['ema9']}) - close) / greatest(close, 1e-9))) / 0.1",
    7: f"least(0.1, greatest(-0.1, (({VALUE['ema21']}) - close) / greatest(close, 1e-9))) / 0.1",
    8: VALUE["bb_pos"], 9: "least(0.1, greatest(-0.1, (close - pc) / greatest(pc, 1e-9))) / 0.1",
    10: "0.0", 11: "0.0", 12: f"({VALUE['mfi']}) / 100",
    13: f"least(1, greatest(-1, {slope_sql('obv[-11:]', 11)} * 10 / greatest(abs(list_avg(obv[-11:])), 1)))",
    14: f"({VALUE['stoch_rsi_k']}) / 100", 15: f"({VALUE['adx']}) / 100", 16: VALUE["vwap_dist"],
    17: "coalesce(fast_rsi, 0.5)", 18: "coalesce(velocity, 0.0)", 19: "coalesce(volume_z, 0.0)",
    20: "least(1, greatest(-1, funding / 0.01))", 21: "coalesce(CASE WHEN n >= 5 AND sa > 0 AND sb > 0 AND NOT isnan(cor) THEN least(1, greatest(-1, cor)) END, 0.0)",
    22: f"sin((start // 3600 % 24) * {_PI})", 23: f"cos((start // 3600 % 24) * {_PI})", 24: "0.0", 25: "0.0", 26: "0.0",
}
_WINDOW_SQL = (
    f"{base(60)}, {FUNDING_SQL}, {FAST_SQL}, refb AS (SELECT start AS rs, close AS ref_close FROM bars WHERE product_id = '{REFERENCE}'), "
    "al AS (SELECT b.product_id, b.start, b.close, coalesce(r.ref_close, (SELECT arg_min(ref_close, rs) FROM refb)) AS ref_close FROM bars b ASOF LEFT JOIN refb r ON b.start >= r.rs)"
    + _CORR + f", {_label_sql()}, {_weight_sql(1)}, "
    "x AS (SELECT k.*, cc.c AS cor, cc.n, cc.sa, cc.sb, wt.label, coalesce(wt.w, 0) AS weight FROM k JOIN cc USING (product_id, start) JOIN wt USING (product_id, start) WHERE wt.is_sample), "
    "x1 AS (SELECT x.*, f.rate AS fr FROM x ASOF LEFT JOIN fund f ON x.product_id = f.product_id AND x.start >= f.ft), "
    "x2 AS (SELECT x1.*, f.fast_rsi, f.velocity, f.volume_z FROM x1 ASOF LEFT JOIN f5 f ON x1.product_id = f.product_id AND x1.start + 3600 > f.fs), "
    "x3 AS (SELECT x2.*, coalesce(x2.fr, ff.r0) AS funding FROM x2 LEFT JOIN ff ON x2.product_id = ff.product_id)"
)


_LAST_SQL = ", ".join(f"{q.single(f'({e})')} AS ch{i}" for i, e in _LAST.items())


@query("ds1_window_last", f"{_WINDOW_SQL} SELECT product_id, start, label, {q.cols(weight='weight')}, {_LAST_SQL} FROM x3")
def window_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last position of each of the 27 channels of every training window."""
    df = dataset(spark, sf_dir, "double")
    return df.select(
        "product_id", _start(), "label", rounded(C("weight")).alias("weight"),
        *[single(F.element_at(C("channels")[i], -1)).alias(f"ch{i}") for i in range(features.CHANNELS)],
    )


@query("ds1_feature_windows")
def feature_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset(spark, sf_dir).select("product_id", _start(), "label", "weight", "channels")


# Channels whose every position SQL can give: their sums over a window, the masked ones among them.
_PER_BAR = {i: _LAST[i] for i in (1, 2, 3, 22, 23)} | {9: _LAST[9]}
_SUMS = {
    0: "CASE WHEN hi > lo THEN (s0 - 60 * lo) / (hi - lo) ELSE s0 - 60 * lo END", **{i: f"s{i}" for i in _PER_BAR},
    17: "60 * coalesce(fast_rsi, 0.5)", 18: "60 * coalesce(velocity, 0.0)", 19: "60 * coalesce(volume_z, 0.0)", **{i: "0.0" for i in features.MASKED},
}
_MASKED_SQL = (
    f"{_WINDOW_SQL}, pb AS (SELECT product_id, start, close, {', '.join(f'{e} AS c{i}' for i, e in _PER_BAR.items())} FROM k), "
    f"ws AS (SELECT product_id, start, sum(close) OVER w AS s0, min(close) OVER w AS lo, max(close) OVER w AS hi, {', '.join(f'sum(c{i}) OVER {chr(118) if i == 9 else chr(119)} AS s{i}' for i in _PER_BAR)} FROM pb "
    "WINDOW w AS (PARTITION BY product_id ORDER BY start ROWS 59 PRECEDING), v AS (PARTITION BY product_id ORDER BY start ROWS 58 PRECEDING))"
)


@query("ds7_masked_windows", f"{_MASKED_SQL} SELECT x3.product_id, x3.start, 27 AS n_channels, 60 AS n_bars, {', '.join(f'{q.r(e, 5)} AS sum{i}' for i, e in _SUMS.items())} FROM x3 JOIN ws ON ws.product_id = x3.product_id AND ws.start = x3.start")
def masked_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked training windows: their shape, and the sum over all positions of every channel that SQL can follow."""
    df = features.masked(dataset(spark, sf_dir, "double"))
    total = lambda i: F.aggregate(C("channels")[i], F.lit(0.0), lambda a, x: a + x)
    bars = F.array_min(F.transform("channels", lambda c: F.size(c)))
    return df.select("product_id", _start(), F.size("channels").alias("n_channels"), bars.alias("n_bars"), *[rounded(total(i), 5).alias(f"sum{i}") for i in _SUMS])


@query("ds8_window_store", f"{_WINDOW_SQL} SELECT product_id, start, idx::BIGINT AS idx, label, {q.cols(weight='weight')}, {_LAST_SQL} FROM x3")
def window_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the older bars stored, topped up twice from the bar store and read back: the same as one full build."""
    folder = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    hourly, fives = (materialize(domain.bars(spark, sf_dir, g)) for g in ("ONE_HOUR", "FIVE_MINUTE"))
    funding = materialize(domain.funding(spark, sf_dir))
    cuts = hourly.select(F.percentile(F.unix_seconds("start"), F.array(F.lit(0.7), F.lit(0.9)))).first()[0]
    steps = [None, *[F.timestamp_seconds(F.floor(F.lit(c) / 86_400) * 86_400 + 36_000) for c in cuts], None]
    for low, high in zip(steps, steps[1:]):
        for bars, granularity in ((hourly, "ONE_HOUR"), (fives, "FIVE_MINUTE")):
            part = bars if low is None else bars.where(C("start") >= low)
            write_bars(part if high is None else part.where(C("start") < high), f"{folder}/bars", granularity)
        stored, stored_5m = (read_bars(spark, f"{folder}/bars", g, with_day=True) for g in ("ONE_HOUR", "FIVE_MINUTE"))
        paid = funding if high is None else funding.where(F.timestamp_millis("funding_time_ms") < high)
        top_up_windows(spark, f"{folder}/windows", stored, stored.where(C("product_id") == REFERENCE), paid, stored_5m, precision="double")
    df = read_windows(spark, f"{folder}/windows")
    return df.select(
        "product_id", _start(), "idx", "label", rounded(C("weight")).alias("weight"),
        *[single(F.element_at(C("channels")[i], -1)).alias(f"ch{i}") for i in range(features.CHANNELS)],
    )
