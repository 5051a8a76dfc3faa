"""Suppression by scanned jump maps against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import signals


@pytest.mark.parametrize("spread,sides,block,fan", [(40, "BBBS", None, 512), (400, "BS", None, 2), (9, "B", 300, 3), (3, "BBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBS", 77, 2), (700, "BBS", 50, 2)])
def test_suppression_matches_a_loop(spark, spread, sides, block, fan):
    rng, t, rows = random.Random(spread), -5000, []
    for i in range(900):
        t += rng.randint(0, spread)
        rows.append((rng.choice("ppq"), t, i, rng.choice(sides)))
    df = spark.createDataFrame(rows, "product_id string, s long, seq long, side string").withColumn("ts", F.timestamp_seconds("s")).repartition(6)
    got = signals.suppress_repeats(df, "ts", "seq", 300, block_seconds=block, fan=fan)
    assert got.columns == df.columns
    last, want = {}, []
    for product, s, seq, side in rows:
        at, before = last.get(product, (-10 ** 9, None))
        if side != before or s - at >= 300:
            last[product] = (s, side)
            want.append(seq)
    assert sorted(r.seq for r in got.collect()) == want


def test_an_unbroken_run_spreads_over_blocks(spark):
    """A million seconds of one side are a few hundred bounded blocks, not one run."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("p").alias("product_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"), F.lit("BUY").alias("side"))
    out = signals.suppress_repeats(df, "ts", "seq")
    assert [r.seq for r in out.orderBy("seq").select("seq").collect()] == list(range(0, n, 300))
