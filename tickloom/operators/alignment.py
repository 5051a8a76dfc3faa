"""Joins along time: as-of, interval (band) and live-price enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.blocks import TICK_BUCKET, running
from tickloom.session import materialize

C = F.col
#: Into how many tasks the left rows of one time bucket are spread when the join has no other key.
SPREAD = 32
#: How many rows of some 40 bytes are sent to every task.
FEW = 250_000


def asof_join(
    left: DataFrame, ref: DataFrame, on: Sequence[str], left_ts: str, ref_ts: str, values: Sequence[str],
    bucket_seconds: int, seed_first: bool = False, max_age_seconds: int | None = None, strict: bool = False,
) -> DataFrame:
    """Latest reference row at or before each left row (before it, with ``strict``).

    The reference is folded to one row per key and time bucket: its rows of that bucket plus the
    last row before it. Left rows then need a plain equi-join on ``(on, bucket)`` and pick from
    that short array, so the large side is neither sorted nor unioned, a hot key is split
    by adaptive skew handling, and a small reference is broadcast on its measured size.
    Meant for references of a fixed cadence (bars, funding events, macro rows), where
    ``bucket_seconds`` bounds the array; ``asof_scan`` takes references of any density.

    Without keys all left rows of a bucket would meet in one task: they are spread over ``SPREAD`` copies of the folded reference.

    ``seed_first`` gives rows before the first reference row that first row's values;
    ``max_age_seconds`` turns older matches into null.
    """
    on, values = list(on), list(values)
    width = F.lit(bucket_seconds)

    def bucket(ts: str) -> Column:
        return F.floor(F.unix_seconds(C(ts)) / width)

    pick = F.struct(C(ref_ts).alias("t"), *[C(v) for v in values])
    if on:
        folded_in, constant = ref, []
    else:
        folded_in, constant = ref.withColumn("__one", F.lit(1)), ["__one"]
        plain = [f.name for f in left.schema if not isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType))]
        left = left.withColumn("__one", F.pmod(F.xxhash64(*plain), F.lit(SPREAD)).cast("int"))
    keys = on + constant
    folded = folded_in.groupBy(*keys, bucket(ref_ts).alias("__b")).agg(
        F.array_sort(F.collect_list(pick)).alias("__rows"))
    # One compact row per bucket; read three times below, so computed once.
    folded = materialize(folded)
    by_bucket = Window.partitionBy(*keys).orderBy("__b")
    last = F.element_at("__rows", -1)
    chained = folded.select(
        *keys, "__b", "__rows", F.lag(last).over(by_bucket).alias("__carry"), F.lead("__b").over(by_bucket).alias("__next"))
    own = F.when(C("__carry").isNotNull(), F.concat(F.array("__carry"), C("__rows"))).otherwise(C("__rows"))
    # Buckets up to the next one with reference rows just hold the last row of this one.
    until = F.coalesce(C("__next") - 1, C("__b"))
    table = chained.select(*keys, "__b", own.alias("__own"), F.array(last).alias("__idle"), F.explode(F.sequence("__b", until)).alias("__at")).select(
        *keys, C("__at").alias("__b"), F.when(C("__at") == C("__b"), C("__own")).otherwise(C("__idle")).alias("__rows"))
    ends = folded.groupBy(*keys).agg(
        F.max_by(last, C("__b")).alias("__last"),
        F.max("__b").alias("__last_b"),
        F.min_by(F.element_at("__rows", 1), C("__b")).alias("__first"),
    )
    if constant:
        copies = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
        table = table.withColumn("__one", copies)
        ends = F.broadcast(ends.withColumn("__one", copies))  # SPREAD rows
    joined = (
        left.withColumn("__b", bucket(left_ts))
        .join(table, [*keys, "__b"], "left")
        .join(ends, keys, "left")
    )
    at = C(left_ts)
    earlier = F.filter("__rows", lambda x: (x["t"] < at) if strict else (x["t"] <= at))
    match = F.when(C("__b") > C("__last_b"), C("__last")).otherwise(F.try_element_at(earlier, F.lit(-1)))
    if seed_first:
        match = F.coalesce(match, C("__first"))
    joined = joined.withColumn("__m", match)
    if max_age_seconds is not None:
        fresh = F.unix_micros(at) - F.unix_micros(C("__m.t")) <= max_age_seconds * 1_000_000
        joined = joined.withColumn("__m", F.when(fresh, C("__m")))
    return joined.select(
        *[c for c in left.columns if c != "__one"],
        *[C(f"__m.{v}").alias(v) for v in values],
        C("__m.t").alias(f"{ref_ts}_matched"),
    )


def asof_scan(
    left: DataFrame, ref: DataFrame, on: Sequence[str], left_ts: str, ref_ts: str, values: Sequence[str],
    bucket_seconds: int = TICK_BUCKET, max_age_seconds: int | None = None, strict: bool = False,
) -> DataFrame:
    """``asof_join`` for references as dense as the left side (ticks against ticks).

    Both sides are merged into one ordered series and the last reference value is scanned over
    short time buckets, so no bucket is ever held as an array.
    """
    on = list(on)
    keys = on or ["__one"]
    if not on:
        left, ref = left.withColumn("__one", F.lit(1)), ref.withColumn("__one", F.lit(1))
    payload = F.struct(C(ref_ts).alias("t"), *[C(v) for v in values])
    a = left.select(*keys, C(left_ts).alias("__t"), F.lit(1).alias("__side"), F.struct(*[c for c in left.columns if c != "__one"]).alias("__row"))
    b = ref.select(*keys, C(ref_ts).alias("__t"), F.lit(2 if strict else 0).alias("__side"), payload.alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__b", F.floor(F.unix_seconds("__t") / bucket_seconds))
    scanned = running(both, keys, ["__b"], ["__t", "__side"], {"__m": ("last", C("__v"))}).where(C("__side") == 1)
    match = C("__m")
    if max_age_seconds is not None:
        match = F.when(F.unix_micros("__t") - F.unix_micros("__m.t") <= max_age_seconds * 1_000_000, match)
    scanned = scanned.withColumn("__m", match)
    return scanned.select("__row.*", *[C(f"__m.{v}").alias(v) for v in values], C("__m.t").alias(f"{ref_ts}_matched"))


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row."""
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(one_row.withColumn("__one", F.lit(1))), "__one").drop("__one")


def with_known(df: DataFrame, ref: DataFrame, key: str, ref_key: str) -> DataFrame:
    """The rows of ``df`` that meet a row of ``ref`` on an integer key, once per row met; no column of ``ref`` is added.

    64 neighbouring keys of ``ref`` are one row with a mask, and keys that repeat are listed beside it. Such rows are sent to every task while
    they are few, so that ``df`` stays where it is; otherwise both sides are dealt by them.
    """
    counts = ref.where(C(ref_key).isNotNull()).groupBy(C(ref_key).cast("long").alias("__key")).agg(F.count("*").alias("__n"))
    slots = materialize(counts.groupBy(F.shiftright("__key", 6).alias("__slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(__key & 63 AS int))")).alias("__mask"),
        F.collect_list(F.when(C("__n") > 1, F.struct("__key", "__n"))).alias("__repeated")))
    rows, repeated = slots.agg(F.count("*"), F.max(F.size("__repeated"))).first()
    if rows <= FEW:
        slots = F.broadcast(slots)
    joined = df.withColumn("__key", C(key).cast("long")).withColumn("__slot", F.shiftright("__key", 6)).join(slots, "__slot")
    met = joined.where(F.expr("__mask & shiftleft(1L, cast(__key & 63 AS int)) <> 0"))
    if not repeated:
        return met.select(*df.columns)
    times = F.expr("coalesce(get(filter(__repeated, x -> x.__key = __key), 0).__n, 1L)")
    return met.select(*df.columns, F.explode(F.array_repeat(F.lit(True), times.cast("int"))).alias("__met")).drop("__met")


def band_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, seconds: int,
) -> DataFrame:
    """Pairs with equal keys and ``abs(left_ts - right_ts) < seconds`` in whole seconds.

    The left rows are copied to the three buckets their partners can be in; the equi-join on
    ``(on, bucket)`` meets each pair once because the right side sits in one bucket only.
    """
    width = F.lit(seconds)
    lb = F.floor(F.unix_seconds(C(left_ts)) / width)
    left = left.withColumn("__b", F.explode(F.array(lb - 1, lb, lb + 1)))
    right = right.withColumn("__b", F.floor(F.unix_seconds(C(right_ts)) / width))
    gap = F.abs(F.unix_seconds(C(left_ts)) - F.unix_seconds(C(right_ts)))
    return left.join(right, [*on, "__b"]).where(gap < seconds).drop("__b")


def nearest(pairs: DataFrame, left_key: Sequence[str], left_ts: str, right_ts: str, tie: str) -> DataFrame:
    """Of the pairs of ``band_join``, the closest right row per left row (ties by ``tie``)."""
    gap = F.abs(F.unix_micros(C(left_ts)) - F.unix_micros(C(right_ts)))
    payload = F.struct(*[c for c in pairs.columns if c not in left_key])
    return pairs.groupBy(*left_key).agg(F.min_by(payload, F.struct(gap, C(tie))).alias("__p")).select(*left_key, "__p.*")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key; one partial aggregate per partition, no sort."""
    keys = list(keys)
    payload = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(payload, F.struct(*order)).alias("__p")).select(*keys, "__p.*")


def latest_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Newest ``n`` rows per key; the rank filter is applied before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("rank", rank).where(C("rank") <= n)


def with_live_price(products: DataFrame, latest_ticks: DataFrame) -> DataFrame:
    """Live price where one is known and positive, else the stored price."""
    live = latest_ticks.select("product_id", C("price").alias("live_price"))
    return products.join(live, "product_id", "left").withColumn(
        "price", F.coalesce(F.when(C("live_price") > 0, C("live_price")), C("price")))


def marked_to_market(positions: DataFrame, latest_ticks: DataFrame) -> DataFrame:
    """Unrealised P&L of open positions at the live price; zero entry prices are flagged."""
    live = latest_ticks.select("product_id", C("price").alias("live_price"))
    known = (C("live_price") > 0) & (C("avg_price") > 0)
    return positions.join(live, "product_id", "left").withColumns({
        "unrealized_pnl": F.when(known, (C("live_price") - C("avg_price")) * C("size")),
        "unrealized_pct": F.when(known, F.try_divide(C("live_price") - C("avg_price"), C("avg_price")) * 100),
        "entry_corrupt": F.coalesce(C("avg_price") <= 0, F.lit(True)),
    })
