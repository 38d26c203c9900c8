"""Lot matching against a sequential one-by-one matcher, with hot groups cut into small blocks."""

import random
from fractions import Fraction

import pytest

from ledgerloom.operators import fifo, groups, quality


def sequential(rows, fee_in_lot=True):
    """(sell index, buy index) -> (quantity at the sale, cost, proceeds), and the open lots' cost; in exact fractions."""
    exact = lambda x: Fraction(str(x))
    lots, out = [], {}
    for i, (_, _, action, q, *rest) in enumerate(rows, 1):
        q = exact(q)
        price = exact(rest[0]) if rest else None
        fee = exact(rest[1]) if len(rest) > 1 and rest[1] else 0
        if action == "BUY":
            lots.append([i, q, (q * price + fee) / q])
        elif action == "SPLIT" and q > 0:
            for lot in lots:
                lot[1], lot[2] = lot[1] * q, lot[2] / q
        elif action == "SELL":
            left, proceeds = q, q * price - fee
            for lot in lots:
                take = min(lot[1], left)
                if take > 0:
                    out[(i, lot[0])] = tuple(map(float, (take, take * lot[2], proceeds * take / q)))
                    lot[1] -= take
                    left -= take
    return out, float(sum(q * c for _, q, c in lots))


def random_rows(seed, n, days=12):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        day = f"2024-01-{rng.randint(1, days):02d}"
        roll = rng.random()
        if roll < 0.08:
            rows.append((day, "AAA", "SPLIT", rng.choice([2.0, 0.5, 3.0])))
        elif roll < 0.55:
            rows.append((day, "AAA", "BUY", float(rng.randint(1, 20)), float(rng.randint(50, 150)), float(rng.randint(0, 5))))
        else:
            rows.append((day, "AAA", "SELL", float(rng.randint(1, 25)), float(rng.randint(50, 150)), float(rng.randint(0, 5))))
    return sorted(rows, key=lambda r: r[0])


@pytest.mark.parametrize("hot_rows", [2, 7, 1 << 20])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_the_sequential_matcher(make_ledger, make_prices, seed, hot_rows):
    rows = random_rows(seed, 70)
    want, open_cost = sequential(rows)
    ledger, prices = make_ledger(rows), make_prices([("AAA", "2024-01-01", 100.0)])
    got = {
        (r.sell_id, r.matched_buy_id): (r.sell_quantity, r.cost_basis_usd, r.proceeds_usd)
        for r in fifo.realized_gains(ledger, prices, "2024-02-01", hot_rows=hot_rows).collect()
    }
    assert set(got) == set(want)
    for key, figures in want.items():
        assert got[key] == pytest.approx(figures, rel=1e-9), key
    metrics = fifo.fifo_metrics(ledger, prices, "2024-02-01", hot_rows=hot_rows).first()
    assert metrics.cost_basis == pytest.approx(open_cost, abs=0.01)
    assert metrics.realized_gain == pytest.approx(sum(p - c for _, c, p in want.values()), abs=0.01)


def decimal_rows(seed, n=60):
    """Decimal quantities of very different size after a large turnover, with splits by 3 and 1.5 and a broken one."""
    rng = random.Random(seed)
    rows = [("2024-01-01", "AAA", "BUY", 1e9, 1.0), ("2024-01-02", "AAA", "SELL", 1e9, 1.0)]
    rows += [("2024-01-03", "AAA", "BUY", 5e-10, 7.0), ("2024-01-03", "AAA", "SELL", 5e-10, 8.0), ("2024-01-03", "AAA", "SPLIT", 0.0)]
    for day in range(4, 4 + n):
        when = f"2024-{1 + day // 28:02d}-{1 + day % 28:02d}"
        rows.append((when, "AAA", rng.choice(["BUY", "BUY", "SELL"]), rng.choice([0.1, 0.2, 0.3, 0.7, 1.1, 5e-10]), float(rng.randint(5, 9))))
        if day % 20 == 0:
            rows.append((when, "AAA", "SPLIT", rng.choice([3.0, 1.5])))
    return rows


@pytest.mark.parametrize("hot_rows", [2, 7, 1 << 20])
@pytest.mark.parametrize("rows", [decimal_rows(1, 30), [
    ("2024-01-01", "AAA", "BUY", 1e9, 1.0), ("2024-01-01", "AAA", "SELL", 1e9, 1.0),
    *[("2024-01-02", "AAA", action, 0.1, 2.0) for action in ("BUY", "SELL") for _ in range(15)]], [
    ("2024-01-01", "AAA", "BUY", 9.0, 1.0), ("2024-01-02", "AAA", "SPLIT", 1 / 3), ("2024-01-03", "AAA", "SELL", 3.0, 4.0),
    ("2024-01-04", "AAA", "BUY", 2.0, 1.0), ("2024-01-05", "AAA", "SELL", 2.0, 1.0)]])
def test_decimal_quantities_match_exactly(make_ledger, make_prices, rows, hot_rows):
    thirds = [(*r[:3], Fraction(1, 3), *r[4:]) if r[3] == 1 / 3 else r for r in rows]
    want, open_cost = sequential(thirds)
    ledger, prices = make_ledger(rows), make_prices([("AAA", "2024-01-01", 100.0)])
    got = {
        (r.sell_id, r.matched_buy_id): (r.sell_quantity, r.cost_basis_usd, r.proceeds_usd)
        for r in fifo.realized_gains(ledger, prices, "2024-12-01", hot_rows=hot_rows).collect()
    }
    assert set(got) == set(want)
    for key, figures in want.items():
        assert got[key] == pytest.approx(figures, rel=1e-9), key
    assert fifo.fifo_metrics(ledger, prices, "2024-12-01", hot_rows=hot_rows).first().cost_basis == pytest.approx(open_cost, abs=0.01)


def unround_rows(ratio, splits, size, seed, sales):
    """Trades around many splits of one unround ratio; ``sales`` are parts of what is held, or None for all of it."""
    rng, rows, held = random.Random(seed), [], Fraction(0)
    for k in range(splits + 1):
        for n, part in enumerate(sales):
            when = f"2024-{1 + k:02d}-{1 + 2 * n:02d}"
            bought = Fraction(str(round(rng.uniform(0.5, 2.0), 2))) * size
            rows.append((when, "AAA", "BUY", float(bought), 2.0))
            held += Fraction(str(float(bought)))
            if part is not None:
                sold = float(f"{float(held * Fraction(str(part))):.6g}")
                rows.append((when, "AAA", "SELL", sold, 3.0))
                held -= Fraction(str(sold))
        if k < splits:
            rows.append((f"2024-{1 + k:02d}-27", "AAA", "SPLIT", ratio))
            held *= Fraction(str(ratio))
    return rows


TOKENS = [("2024-01-01", "AAA", "BUY", 1e-18, 5.0), ("2024-01-01", "AAA", "BUY", 3e-18, 5.0), ("2024-01-02", "AAA", "SELL", 2e-18, 6.0),
          ("2024-01-03", "AAA", "BUY", 12345.678901234567, 1.0), ("2024-01-04", "AAA", "SELL", 2e-18, 6.0), ("2024-01-05", "AAA", "SELL", 12345.678901234567, 1.0)]


HISTORIES = [
    unround_rows(1.281, 5, 1, 1, (None, 0.3, 0.5)), unround_rows(1.0123456, 9, 10, 2, (0.25, None, 0.6)),
    unround_rows(0.98765432101, 11, 1000, 3, (0.5, 0.1)), unround_rows(1.281, 4, 10**13, 4, (0.3, 0.2)),
    [("2024-01-01", "AAA", "BUY", 2e12, 1.0), ("2024-01-02", "AAA", "SELL", 5e11, 1.0), ("2024-01-03", "AAA", "SELL", 1.5e12, 1.0)],
    [("2024-01-01", "AAA", "BUY", 1e-13, 1.0), ("2024-01-02", "AAA", "SELL", 1e-13, 2.0)], TOKENS,
    [("2024-01-01", "AAA", "BUY", 10.0, 1.0), *[(f"2024-01-{2 + k:02d}", "AAA", "SPLIT", 1.281) for k in range(5)], ("2024-01-20", "AAA", "SELL", float(Fraction("1.281") ** 5 * 10), 2.0)],
    [("2024-01-01", "AAA", "BUY", 2.0, 1.0), ("2024-01-02", "AAA", "SELL", 1.0, 1.0)],
]


@pytest.mark.parametrize("hot_rows", [2, 7, 1 << 20])
def test_nothing_is_too_large_small_or_unround(make_ledger, make_prices, hot_rows):
    """One asset for each history; ids count through all of them."""
    rows, want, open_cost = [], {}, 0.0
    for k, history in enumerate(HISTORIES):
        found, cost = sequential(history)
        want |= {(a + len(rows), b + len(rows)): figures for (a, b), figures in found.items()}
        open_cost += cost
        rows += [(day, f"A{k}", *rest) for day, _, *rest in history]
    ledger, prices = make_ledger(rows), make_prices([(f"A{k}", "2024-01-01", 1.0) for k in range(len(HISTORIES))])
    got = {
        (r.sell_id, r.matched_buy_id): (r.sell_quantity, r.cost_basis_usd, r.proceeds_usd)
        for r in fifo.realized_gains(ledger, prices, "2025-12-01", hot_rows=hot_rows).collect()
    }
    assert set(got) == set(want)
    for key, figures in want.items():
        assert got[key] == pytest.approx(figures, rel=1e-9, abs=1e-25), key
    assert fifo.fifo_metrics(ledger, prices, "2025-12-01", hot_rows=hot_rows).first().cost_basis == pytest.approx(open_cost, rel=1e-9)


def test_a_single_hot_day_is_cut_by_id(make_ledger, make_prices):
    rows = [("2024-01-05", "AAA", "BUY" if i % 3 else "SELL", float(1 + i % 4), 10.0) for i in range(60)]
    want, _ = sequential(rows)
    got = fifo.realized_gains(make_ledger(rows), make_prices([("AAA", "2024-01-01", 1.0)]), "2024-02-01", hot_rows=4)
    assert {(r.sell_id, r.matched_buy_id): r.sell_quantity for r in got.collect()} == {k: v[0] for k, v in want.items()}


def test_blocks_stay_small_and_ordered(make_ledger):
    rows = [(f"2024-01-{1 + i // 10:02d}", "AAA", "BUY", 1.0, 1.0) for i in range(100)]
    blocked = groups.split_hot_groups(make_ledger(rows), ["account", "asset"], 8).collect()
    sizes = {}
    for r in blocked:
        sizes[(r.blk, r.sub)] = sizes.get((r.blk, r.sub), 0) + 1
    assert len(blocked) == 100 and max(sizes.values()) <= 16 and len(sizes) > 6
    order = [(r.blk, r.sub) for r in sorted(blocked, key=lambda r: (r.date, r.id))]
    assert order == sorted(order)


@pytest.mark.parametrize("hot_rows", [3, 1 << 20])
def test_running_total_and_oversell(make_ledger, hot_rows):
    rows = [r for r in random_rows(5, 60) if r[2] != "SPLIT"]
    held, want = 0.0, {}
    for i, (_, _, action, q, *_rest) in enumerate(rows, 1):
        if action == "SELL" and q > held:
            want[i] = held
        held += q if action == "BUY" else -q
    got = quality.oversold(make_ledger(rows), hot_rows)
    assert {r.id: r.held for r in got.collect()} == want


def test_split_then_sale(make_ledger, make_prices):
    ledger = make_ledger(
        [
            ("2024-01-02", "USD", "DEPOSIT", 15000),
            ("2024-01-02", "AAA", "BUY", 100, 150),
            ("2024-01-03", "AAA", "SPLIT", 4),
            ("2024-01-04", "AAA", "SELL", 100, 50),
        ]
    )
    (row,) = fifo.realized_gains(ledger, make_prices([("AAA", "2024-01-02", 150)]), "2024-02-01").collect()
    assert (row.cost_basis_usd, row.realized_gain, row.holding_days, row.sell_quantity) == (3750.0, 1250.0, 2, 100.0)


def test_from_date_filters_output_only(make_ledger, make_prices):
    ledger = make_ledger(
        [("2024-01-02", "AAA", "BUY", 10, 10), ("2024-01-03", "AAA", "SELL", 4, 11), ("2024-03-01", "AAA", "SELL", 4, 12)]
    )
    prices = make_prices([("AAA", "2024-01-02", 10)])
    (row,) = fifo.realized_gains(ledger, prices, "2024-12-31", from_date="2024-02-01", asset="aaa").collect()
    assert row.sell_quantity == 4.0 and row.cost_basis_usd == 40.0
    (year,) = fifo.realized_gains_by_year(fifo.realized_gains(ledger, prices, "2024-12-31")).collect()
    assert (year.total_realized_gain, year.short_term_gain, year.transaction_count) == (12.0, 12.0, 2)


def test_trades_stay_where_they_are_where_splits_are_few(spark, make_ledger):
    from ledgerloom.functions import classify as C
    from ledgerloom.operators import splits

    ledger = C.classified(make_ledger([
        ("2024-01-01", "AAPL", "BUY", 10, 1), ("2024-01-05", "AAPL", "SPLIT", 4), ("2024-01-06", "AAPL", "BUY", 1, 1), ("2024-01-06", "SPY", "BUY", 2, 1),
    ]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = splits.with_split_factor(ledger, splits.split_steps(ledger))
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = {(r.asset, r.id): (r.factor, r.end_factor) for r in found.collect()}
        most, splits.FEW_SPLITS = splits.FEW_SPLITS, 0
        try:
            many = splits.with_split_factor(ledger, splits.split_steps(ledger))
            assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
            assert {(r.asset, r.id): (r.factor, r.end_factor) for r in many.collect()} == rows
        finally:
            splits.FEW_SPLITS = most
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert rows == {("AAPL", 1): (1.0, 4.0), ("AAPL", 2): (1.0, 1.0), ("AAPL", 3): (4.0, 4.0), ("SPY", 4): (1.0, 1.0)}
