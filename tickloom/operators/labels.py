"""Labels, sample weights, folds and splits for supervised datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.alignment import with_scalar
from tickloom.operators.blocks import blocked, core_rows
from tickloom.operators.layers import Indicator, d, with_indicators
from tickloom.session import materialize

C = F.col
KEYS = ("product_id",)


def _lead(expr: str, n: int, keys: Sequence[str]) -> str:
    return f"lead({expr}, {n}) OVER (PARTITION BY {', '.join(keys)}, block ORDER BY idx)"


def triple_barrier(max_bars: int = 4, up: float = 0.01, down: float = 0.01, dead_zone: float = 0.003, keys: Sequence[str] = KEYS) -> Indicator:
    """1 or 0 by the first barrier touched in the next ``max_bars`` bars, else by the final move.

    Both barriers in one bar: the close decides, null on a tie. A final move inside the dead
    zone is null. Needs ``max_bars`` halo rows after the block.
    """
    ahead = {f"__{c}{k}": _lead(column, k, keys) for k in range(1, max_bars + 1) for c, column in (("h", "high"), ("l", "low"), ("c", "close"))}
    upper, lower = f"close * (1 + {d(up)})", f"close * (1 - {d(down)})"
    cases = []
    for k in range(1, max_bars + 1):
        hit_up, hit_down = f"__h{k} >= {upper}", f"__l{k} <= {lower}"
        cases += [
            f"WHEN {hit_up} AND {hit_down} THEN CASE WHEN __c{k} > close THEN 1D WHEN __c{k} < close THEN 0D END",
            f"WHEN {hit_up} THEN 1D",
            f"WHEN {hit_down} THEN 0D",
        ]
    final = "coalesce(" + ", ".join(f"__c{k}" for k in range(max_bars, 0, -1)) + ", close)"
    move = f"(({final} - close) / close)"
    timed = f"CASE WHEN abs({move}) < {d(dead_zone)} THEN NULL WHEN {move} > 0 THEN 1D ELSE 0D END"
    label = f"CASE WHEN close <= 0 THEN NULL {' '.join(cases)} ELSE {timed} END"
    return Indicator({"label": label, "has_horizon": f"__c{max_bars} IS NOT NULL"}, [ahead])


def uniqueness(horizon: int = 4, include_entry: bool = False, sample: str = "is_sample", keys: Sequence[str] = KEYS) -> Indicator:
    """Mean of 1/N over the forward window, N counting the samples whose window covers a bar.

    ``include_entry`` lets the window start at the sample's own bar. Bars past the end of the
    series do not count. Needs ``horizon`` halo rows on both sides with known sample flags.
    """
    spec = f"PARTITION BY {', '.join(keys)}, block ORDER BY idx"
    first = 0 if include_entry else 1

    def bound(n: int) -> str:
        return "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"

    covering = f"sum(CASE WHEN {sample} THEN 1 ELSE 0 END) OVER ({spec} ROWS BETWEEN {bound(-horizon)} AND {bound(-first)})"
    weight = f"avg(CASE WHEN __nt > 0 THEN 1D / __nt END) OVER ({spec} ROWS BETWEEN {bound(first)} AND {bound(horizon)})"
    return Indicator({"weight": "CASE WHEN " + sample + " THEN coalesce(__wt, 0D) END"}, [{"__nt": covering}, {"__wt": weight}])


def labelled(bars: DataFrame, seq_len: int = 60, horizon: int = 4, include_entry: bool = False, dead_zone: float = 0.003) -> DataFrame:
    """Every bar with its label, sample flag and uniqueness weight (one exchange)."""
    df = blocked(bars, max(horizon, 1), 2 * horizon)
    return core_rows(label_blocks(df, seq_len, horizon, include_entry, dead_zone))


def label_blocks(df: DataFrame, seq_len: int = 60, horizon: int = 4, include_entry: bool = False, dead_zone: float = 0.003) -> DataFrame:
    """Label columns on a blocked frame with ``horizon`` rows before and twice that after."""
    df = with_indicators(df, [triple_barrier(horizon, dead_zone=dead_zone)])
    df = df.withColumn("is_sample", F.expr(f"idx >= {seq_len - 1} AND has_horizon AND label IS NOT NULL"))
    return with_indicators(df, [uniqueness(horizon, include_entry)])


def enough_history(samples: DataFrame, bars: DataFrame, minimum: int) -> DataFrame:
    """Samples of products that own at least ``minimum`` bars."""
    enough = bars.groupBy("product_id").agg(F.count("*").alias("n")).where(C("n") >= minimum).select("product_id")
    return samples.join(enough, "product_id", "left_semi")


def walk_forward(samples: DataFrame, folds: int = 3, horizon: int = 4, embargo: int = 4, key: str = "product_id", index: str = "idx") -> DataFrame:
    """Purged walk-forward folds: one row per (sample, fold) with its role.

    ``samples`` carries ``key``, ``index`` and ``position`` (0-based rank of the sample in its
    key). The first half only trains; the rest is cut into ``folds`` validation blocks. A
    training sample is purged when its label window reaches the block and left out when it lies
    within ``embargo`` bars after an earlier block. Fold bounds are a few rows per key, found by
    one aggregation and joined back; no series is sorted. The samples are computed once.
    """
    samples = materialize(samples)
    sized = samples.groupBy(key).agg(F.count("*").alias("n"))
    bounds = (
        sized.withColumn("half", F.floor(C("n") * 0.5))
        .withColumn("size", F.greatest(F.lit(1), F.floor((C("n") - C("half")) / folds)))
        .withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(folds)])))
        .withColumn("lo", C("half") + C("fold") * C("size"))
        .withColumn("hi", F.when(C("fold") == folds - 1, C("n")).otherwise(C("lo") + C("size")))
        .where((C("lo") < C("hi")) & (C("lo") < C("n")))
        .select(key, "fold", "lo", "hi")
    )
    edge = samples.join(bounds, key).groupBy(key, "fold", "lo", "hi").agg(
        F.max(F.when(C("position") == C("lo"), C(index))).alias("first_val"),
        F.max(F.when(C("position") == C("hi") - 1, C(index))).alias("last_val"),
    )
    ends = edge.groupBy(key).agg(F.collect_list(F.struct("fold", "last_val")).alias("ends"))
    plan = edge.join(ends, key)
    member = samples.join(plan, key)
    barred = F.exists("ends", lambda e: (e["fold"] < C("fold")) & (C(index) > e["last_val"]) & (C(index) <= e["last_val"] + embargo))
    role = F.when((C("position") >= C("lo")) & (C("position") < C("hi")), "val").when(
        (C("position") < C("lo")) & (C(index) + horizon < C("first_val")) & ~barred, "train")
    return member.withColumn("role", role).where(C("role").isNotNull()).drop("lo", "hi", "first_val", "last_val", "ends")


def time_split(df: DataFrame, ts: str, share: float = 0.8, rows: Column | None = None) -> DataFrame:
    """Train/validation by time over all products: the newest rows validate.

    The cut is the second that holds the row at ``share`` of all, exactly: counts a day find its day, counts a second
    of that day find the second. Days and the seconds of a day are few, so no row is sorted. A row may stand for several ``rows``.
    """
    seconds = F.unix_seconds(C(ts))
    day = F.floor(seconds / 86_400)
    rows = F.lit(1) if rows is None else rows

    def at_share(counts: DataFrame, key: str, wanted: Column) -> DataFrame:
        running = counts.withColumn("__run", F.sum("__n").over(Window.orderBy(key)))
        return running.where(C("__run") >= wanted).agg(F.min(F.struct(key, (C("__run") - C("__n")).alias("__before"))).alias("__at"))

    days = df.groupBy(day.alias("__day")).agg(F.sum(rows).alias("__n"))
    days = days.withColumn("__wanted", F.ceil(F.sum("__n").over(Window.partitionBy()) * share))
    cut_day = at_share(days, "__day", C("__wanted")).select("__at.*")
    total = df.agg(F.ceil(F.sum(rows) * share).alias("__wanted"))
    inner = with_scalar(with_scalar(df.select(seconds.alias("__second"), day.alias("__of"), rows.alias("__rows")), cut_day), total).where(C("__of") == C("__day"))
    inner = inner.groupBy("__second").agg(F.sum("__rows").alias("__n"), F.first("__before").alias("__start"), F.first("__wanted").alias("__wanted"))
    cut = at_share(inner, "__second", C("__wanted") - C("__start")).select(C("__at.__second").alias("__cut"))
    return with_scalar(df, cut).withColumn("split", F.when(seconds <= C("__cut"), "train").otherwise("val")).drop("__cut")


def class_balance(samples: DataFrame, label: str = "label") -> DataFrame:
    """Class counts and the positive weight ``n_neg / n_pos`` (1 for a single class)."""
    pos, neg = F.sum(F.when(C(label) >= 0.5, 1).otherwise(0)), F.sum(F.when(C(label) < 0.5, 1).otherwise(0))
    return samples.agg(pos.alias("n_pos"), neg.alias("n_neg")).withColumn(
        "pos_weight", F.when((C("n_pos") > 0) & (C("n_neg") > 0), C("n_neg") / C("n_pos")).otherwise(1.0))


def regime_observations(bars: DataFrame, window: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Log return of each bar and the deviation of the ``window`` returns before it."""
    spec = f"PARTITION BY {', '.join(keys)}, block ORDER BY idx"
    ret = f"CASE WHEN lag(close) OVER ({spec}) > 0 AND close > 0 THEN ln(close / lag(close) OVER ({spec})) END"
    before = f"stddev_pop(__r) OVER ({spec} ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    df = with_indicators(blocked(bars, window + 1), [Indicator({"log_ret": "__r", "vol": "__v"}, [{"__r": ret}, {"__v": before}])])
    return core_rows(df).where((C("idx") >= window + 1) & C("log_ret").isNotNull())


def fingerprint(bars: DataFrame, **parameters: object) -> DataFrame:
    """SHA-256 over the parameters and each product's count, first, last start and last close."""
    per_key = bars.groupBy("product_id").agg(
        F.count("*").alias("n"), F.min("start").alias("a"), F.max("start").alias("b"), F.max_by("close", "start").alias("c"))
    line = F.concat_ws("|", "product_id", C("n").cast("string"), F.unix_seconds("a").cast("string"),
                       F.unix_seconds("b").cast("string"), F.format_string("%.6f", "c"))
    head = ";".join(f"{k}={v}" for k, v in sorted(parameters.items()))
    # Digests of products are folded by their first five characters, then by three, so the last row holds at most 4096 of them.
    digests = per_key.select(F.sha2(line, 256).alias("d"), F.sha2(line, 256).substr(1, 5).alias("p"))

    def folded(d: DataFrame, prefix: int) -> DataFrame:
        joined = F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256)
        return d.groupBy("p").agg(joined.alias("d")).select("d", C("p").substr(1, prefix).alias("p"))

    top = folded(folded(digests, 3), 0)
    return top.agg(F.sha2(F.concat_ws("#", F.lit(head), F.array_join(F.array_sort(F.collect_list("d")), ",")), 256).alias("fingerprint"))


def sample_positions(samples: DataFrame, key: str = "product_id", index: str = "idx", width: int = 4096) -> DataFrame:
    """Rank of every sample inside its key (counts per index range, then ranks inside the range)."""
    from tickloom.operators.blocks import row_index

    cut = samples.withColumn("__b", F.floor(C(index) / width))
    return row_index(cut, [key], ["__b"], [index], "position").drop("__b")


