"""Books, pairing, exits and outcomes against small sequential programs."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import ledger, outcomes, signals


def with_ts(df):
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def book_loop(rows, opening=1000.0):
    """Position, profit, balance and realised profit after every fill that changes something."""
    cash, won, held, out = {}, {}, {}, {}
    for agent, _, seq, product, side, price, usd in rows:
        cash.setdefault(agent, opening)
        won.setdefault(agent, 0.0)
        size, cost = held.get((agent, product), (0.0, 0.0))
        if side == "BUY" and usd and price > 0:
            held[agent, product] = size, cost = size + usd / price, cost + usd
            cash[agent] -= usd
            out[seq] = ("BUY", size, cost / size, None, cash[agent], won[agent])
        elif side == "SELL" and size:
            held.pop((agent, product))
            cash[agent] += size * price
            won[agent] += size * price - cost
            out[seq] = ("SELL", size, cost / size, size * price - cost, cash[agent], won[agent])
    return out


def fill_rows(n=400):
    rng = random.Random(11)
    return [(rng.choice("xy"), 37 * i, i, rng.choice("pqr"), rng.choice(["BUY", "BUY", "SELL"]), rng.choice([rng.uniform(1, 50), 0.0]), rng.choice([None, 0.0, 5.0, 120.0])) for i in range(n)]


FILLS = "agent string, s long, seq long, product_id string, side string, price double, usd double"


def test_average_cost_book_matches_a_loop(spark):
    rows = fill_rows()
    got = {r.seq: r for r in ledger.average_cost_book(with_ts(spark.createDataFrame(rows, FILLS))).collect()}
    want = book_loop(rows)
    assert got.keys() == want.keys() and len(want) > 100
    for seq, (action, size, avg, pnl, balance, realized) in want.items():
        r = got[seq]
        assert r.action == action and (r.pnl is None) == (pnl is None)
        assert (r.size, r.avg_price, r.balance, r.realized_pnl or 0.0) == pytest.approx((size, avg, balance, realized))
        assert pnl is None or r.pnl == pytest.approx(pnl)


def test_pairing_takes_the_newest_free_open(spark):
    kinds = "OOCCCOCOOOCOCC"
    rows = [("a", "p", 100 * i, i, "OPEN" if k == "O" else "CLOSE", float(i), 1.0, 10.0 + i, 1.0, f"t{i}", 5.0) for i, k in enumerate(kinds)]
    events = with_ts(spark.createDataFrame(rows, "agent string, product_id string, s long, seq long, kind string, price double, size double, usd double, pnl double, trigger string, balance double"))
    got = {(r.open_seq, r.close_seq) for r in ledger.pair_trades(events).collect()}
    stack, want = [], set()
    for i, k in enumerate(kinds):
        if k == "O":
            stack.append(i)
        else:
            want.add((stack.pop() if stack else None, i))
    assert got == want | {(i, None) for i in stack}
    row = ledger.pair_trades(events).where("close_seq = 2").first()
    assert (row.hold_secs, row.trigger_open, row.trigger_close) == (100, "t1", "t2")
    assert row.pct_pnl == pytest.approx(1.0 / 11.0 * 100)
    orphan = ledger.pair_trades(events).where("close_seq = 4").first()
    assert orphan.trigger_open == "UNKNOWN" and orphan.opened_at == orphan.closed_at and orphan.hold_secs is None
    assert (orphan.entry_price, orphan.usd_open) == (orphan.exit_price, orphan.usd_close)


def test_ghost_trades(spark):
    rows = [(1, "a", "p"), (2, "a", "p"), (3, "a", "q"), (4, "b", "p")]
    open_ = spark.createDataFrame(rows, "trade_id long, agent string, product_id string")
    held = spark.createDataFrame([("p",)], "product_id string")
    assert sorted(r.trade_id for r in ledger.ghost_trades(open_, held).collect()) == [1, 3]


TICKS = "episode string, s long, seq long, price double, avg_price double, size double, sell_score double"


@pytest.mark.parametrize("prices, score, expected", [
    ([100.5, 98.4], None, (1, "TICK_STOP")),
    ([100.5, 98.5], None, None),                         # exactly the stop does not fire
    ([101.0, 102.0, 101.7], None, (2, "TICK_TRAIL")),    # peak $2, gave back $0.30
    ([100.9, 100.5], None, None),                        # never armed
    ([106.1], None, (0, "TICK_PROFIT")),
    ([100.2], 0.55, (0, "TICK_SIGNAL")),
    ([97.0], 0.9, (0, "TICK_SIGNAL")),                   # the score comes first
])
def test_tick_exit_rules(spark, prices, score, expected):
    rows = [("e", 60 * i, i, p, 100.0, 1.0, score) for i, p in enumerate(prices)]
    out = ledger.tick_exits(with_ts(spark.createDataFrame(rows, TICKS))).collect()
    assert [(r.seq, r.trigger) for r in out] == ([expected] if expected else [])


@pytest.mark.parametrize("prices, entry, step, expected", [
    ([98.0, 92.0], 0, 60, (1, "STOP_LOSS")),
    ([110.0, 106.6], 0, 60, (1, "TRAIL_STOP")),
    ([100.0, 101.0, 101.0], 0, 86_400 * 4, (2, "MAX_HOLD")),
    ([101.0], None, 60, (0, "LEGACY_EXIT")),
    ([0.0, 101.0], 0, 60, None),
])
def test_scan_exit_rules(spark, prices, entry, step, expected):
    rows = [("e", step * i, i, p, 100.0) for i, p in enumerate(prices)]
    df = with_ts(spark.createDataFrame(rows, "episode string, s long, seq long, price double, avg_price double"))
    df = df.withColumn("entry_time", F.timestamp_seconds(F.lit(entry).cast("long")))
    out = ledger.scan_exits(df).collect()
    assert [(r.seq, r.trigger) for r in out] == ([expected] if expected else [])


def test_drawdown_halts_until_the_window_ends(spark):
    day = 86_400
    rows = [("a", 7 * day * 100 + s, i, b) for i, (s, b) in enumerate([(0, 1000.0), (100, 960.0), (200, 949.0), (300, 990.0), (day, 990.0), (day + 5, 980.0), (2 * day, 899.0), (3 * day, 950.0), (7 * day, 940.0)])]
    df = with_ts(spark.createDataFrame(rows, "agent string, s long, seq long, balance double"))
    got = [r.halted for r in ledger.drawdown(df).orderBy("seq").collect()]
    assert got == [False, False, True, True, False, False, True, True, False]


def test_decisions_follow_the_position(spark):
    rng = random.Random(2)
    rows = [(rng.choice("pq"), 1000 * i, i, rng.random(), rng.random()) for i in range(300)]
    df = with_ts(spark.createDataFrame(rows, "product_id string, s long, seq long, adj_buy double, adj_sell double")).withColumn("b", F.floor(F.unix_seconds("ts") / 20_000))
    got = {r.seq: r for r in signals.decide(df, ["ts", "seq"], ["b"]).collect()}
    held = {"p": False, "q": False}
    for product, _, seq, buy, sell in rows:
        side = "BUY" if buy >= 0.55 and not held[product] else "SELL" if sell >= 0.55 and held[product] else "HOLD"
        assert (got[seq].holding, got[seq].side) == (held[product], side)
        held[product] = side == "BUY" or (held[product] and side != "SELL")


@pytest.mark.parametrize("spread", [40, 400])
def test_repeats_are_suppressed_from_the_last_emitted(spark, spread):
    rng = random.Random(spread)
    t, rows = 0, []
    for i in range(500):
        t += rng.randint(0, spread)
        rows.append((rng.choice("pq"), t, i, rng.choice(["BUY", "BUY", "BUY", "SELL"])))
    df = with_ts(spark.createDataFrame(rows, "product_id string, s long, seq long, side string"))
    got = sorted(r.seq for r in signals.suppress_repeats(df, "ts", "seq").collect())
    last, want = {}, []
    for product, s, seq, side in rows:
        at, before = last.get(product, (-10 ** 9, None))
        if not (side == before and s - at < 300):
            last[product] = (s, side)
            want.append(seq)
    assert got == want


@pytest.mark.parametrize("side, exit_, expected", [
    ("BUY", 100.6, "WIN"), ("BUY", 99.4, "LOSS"), ("BUY", 100.4, "NEUTRAL"), ("SELL", 99.4, "WIN"), ("SELL", 100.6, "LOSS"),
])
def test_outcomes_resolve_at_the_horizon(spark, side, exit_, expected):
    sig = spark.createDataFrame([("TECH", "p", side, 0.61234, 100.0, 0, 1, {"rsi": "28.6", "macd_h": "0.2"})], "source string, product_id string, side string, confidence double, price double, s long, seq long, indicators map<string,string>")
    sig = sig.withColumn("created_at", F.timestamp_seconds("s")).drop("s")
    # The bar that has ended at the horizon counts, not the one that opens there.
    bars = spark.createDataFrame([("p", 10_800, exit_), ("p", 14_400, 500.0), ("p", 3600, 77.0)], "product_id string, s long, close double").withColumn("start", F.timestamp_seconds("s"))
    r = outcomes.resolve(outcomes.record(sig), bars).first()
    assert (r.outcome, r.exit_price) == (expected, exit_)
    assert r.lesson.startswith(f"TECH {side} conf=0.61 RSI=29 MACD=bull → ") and r.lesson.endswith(f"after 4h [{expected}]")
    assert outcomes.resolve(outcomes.record(sig), bars, F.timestamp_seconds(F.lit(14_399))).count() == 0


def test_order_at_a_price_of_zero_has_no_finite_size(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 3.0), (3, None)], "signal_id long, price double")
    got = {r.signal_id: r.base_size for r in ledger.orders_for_signals(df, F.lit(100.0)).collect()}
    assert got == {1: float("inf"), 2: 33.33333333, 3: None}


def test_order_sizes_are_rounded_once(spark):
    """Rounded first in decimal form and then by scaling, these sizes move to a neighbour; a negative zero gives the other infinity."""
    prices = {0.0020702759162386924: 48302.74033313, 0.0002243873270581003: 445657.96701214, 7.496949817305769e-05: 1333875.80865437, 2.6757784405145424e-06: 37372302.01345459}
    df = spark.createDataFrame([(i, p) for i, p in enumerate([*prices, -0.0])], "signal_id long, price double")
    got = [r.base_size for r in ledger.orders_for_signals(df, F.lit(100.0)).orderBy("signal_id").collect()]
    assert got == [*prices.values(), float("-inf")]


def test_balance_parts_deal_the_trades_once(spark):
    """Reports from bucket rows equal those from every trade's balance, and the trades are computed once."""
    from tickloom.operators import reports
    from tickloom.plans import domain

    rng = random.Random(8)
    rows = [(rng.choice("AN"), 86_400 * rng.randint(0, 70), i, 1, 1, 1, float(rng.randint(-9, 9)), 1.0) for i in range(400)]
    seen = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(rows, "agent string, s long, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, pnl double, pct_pnl double")
    df = df.withColumn("closed_at", F.timestamp_seconds("s")).drop("s")

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    cut = df.mapInArrow(count, df.schema).withColumn("__range", F.shiftright("l_orderkey", 6))
    parts = reports.balance_parts(cut, domain.TRADE_ORDER, ["closed_at", "__range"])
    got = sorted(map(tuple, reports.monthly_of_parts(parts, by_agent=True).collect()))
    assert seen.value == len(rows)
    assert got == sorted(map(tuple, reports.monthly_performance(domain.with_balance(df), domain.TRADE_ORDER, by_agent=True).collect()))


def test_rows_that_meet_a_key_once_per_row_met(spark):
    """Keys that repeat, are null, negative or missing give the rows of a plain join, also when the masks are not sent to every task."""
    from tickloom.operators import alignment

    rng = random.Random(3)
    ref = spark.createDataFrame([(rng.choice([None, *range(-130, 200)]),) for _ in range(300)], "r long")
    df = spark.createDataFrame([(i, rng.choice([None, *range(-140, 210)])) for i in range(900)], "i long, k long")
    want = sorted(map(tuple, df.join(ref, F.col("k") == F.col("r")).select("i", "k").collect()))
    assert len(want) > len(set(want)) > 300
    assert sorted(map(tuple, alignment.with_known(df, ref, "k", "r").collect())) == want
    few, alignment.FEW = alignment.FEW, 0
    try:
        assert sorted(map(tuple, alignment.with_known(df, ref, "k", "r").collect())) == want
    finally:
        alignment.FEW = few


def test_reports_deal_their_lines_once(spark, tmp_path, monkeypatch):
    """Lines of an order and bucket stay where the ranges of order keys put them: one exchange of lines and one of orders."""
    from tickloom.plans import domain
    from tickloom.session import joins_as_dealt

    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    seen = []
    monkeypatch.setattr("tickloom.operators.blocks.materialize", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    domain.ledger_parts(spark, "/root/testdata/sf0.001")
    exchanges = [line for line in seen[0].splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and all("shiftright" in line for line in exchanges), seen[0]
    with pytest.raises(ZeroDivisionError), joins_as_dealt(spark):
        assert spark.conf.get(key) == "false" and 1 / 0
    assert spark.conf.get(key) == before
