"""The same queries as SQL text, to be run by another engine on the raw tables.

Only the ledger views are shared with the Spark side.  Reports are worked out in other ways here: as-of joins
instead of calendars, correlated products for splits, a recursion over events for lots, recursion or list folds for smoothed
averages.
"""

from __future__ import annotations

from ledgerloom import vocab
from ledgerloom.plans.registry import AS_OF, BENCHMARK, EARLY, EARLY_TICKS, SAVING, SPENDING, TARGETS, TODAY, TRACKED
from ledgerloom.sources.ledger_views import VIEWS

D = f"DATE '{AS_OF}'"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


STABLE, FIAT = _in(vocab.STABLECOINS), _in(vocab.BARE_FIAT)
FOREIGN = _in(f"stock_{c.lower()}" for c in vocab.LISTING_CURRENCY.values())


def stable(a: str) -> str:
    return f"upper({a}) IN {STABLE}"


def bucket(a: str) -> str:
    arms = " ".join(
        f"WHEN {a} LIKE '%{sfx}' THEN 'stock_{ccy.lower()}'" for sfx, ccy in vocab.LISTING_CURRENCY.items()
    )
    return (
        f"(CASE WHEN {a} = 'USD' THEN 'cash_base' WHEN {a} IN {FIAT} THEN 'cash_fx' WHEN {stable(a)} THEN 'cash_stable' "
        f"WHEN {a} LIKE '%USD=X' THEN 'cash_fx' WHEN {a} LIKE '%-USD' THEN 'crypto' {arms} ELSE 'stock_usd' END)"
    )


def cash_like(a: str, t: str) -> str:
    return f"(coalesce({t} LIKE 'cash_%', FALSE) OR coalesce({a} LIKE 'CASH %', FALSE))"


def pair_of(t: str) -> str:
    return f"(CASE WHEN {t} IN {FOREIGN} THEN upper(right({t}, 3)) || 'USD=X' ELSE 'USD' END)"


def _stable_bucket(a: str) -> str:
    return f"({a} LIKE 'CASH %' AND {stable(f'trim(substr({a}, 6))')})"


def key_of(a: str, t: str) -> str:
    return (
        f"(CASE WHEN {t} = 'cash_stable' THEN upper({a}) WHEN {_stable_bucket(a)} THEN upper(trim(substr({a}, 6))) "
        f"WHEN {a} IN {FIAT} THEN {a} || 'USD=X' WHEN {t} = 'cash_fx' THEN {a} WHEN {t} IN {FOREIGN} THEN {pair_of(t)} "
        f"WHEN {a} IN ('CASH EUR', 'CASH GBP', 'CASH UAH') THEN right({a}, 3) || 'USD=X' ELSE 'USD' END)"
    )


def norm_of(a: str, t: str) -> str:
    return (
        f"(CASE WHEN {t} = 'cash_stable' THEN upper({a}) WHEN {_stable_bucket(a)} THEN upper(trim(substr({a}, 6))) "
        f"WHEN {a} IN ('USD', 'CASH USD') THEN 'USD' WHEN {a} IN {FIAT} THEN {a} || 'USD=X' WHEN {t} = 'cash_fx' THEN {a} "
        f"WHEN {a} IN ('CASH EUR', 'CASH GBP', 'CASH UAH') THEN right({a}, 3) || 'USD=X' "
        f"WHEN {a} LIKE '%-USD' THEN {a} ELSE {a} || '-USD' END)"
    )


def shown(k: str) -> str:
    pairs = _in(f"{c}USD=X" for c in vocab.CURRENCIES if c != "USD")
    return f"(CASE WHEN {k} IN {pairs} THEN left({k}, 3) ELSE {k} END)"


def fee_key(c: str) -> str:
    t = bucket(c)
    return (
        f"(CASE WHEN coalesce({c}, '') IN ('', 'USD') THEN 'USD' WHEN {t} = 'cash_stable' THEN upper({c}) "
        f"WHEN {t} = 'cash_fx' THEN {key_of(c, t)} ELSE {c} || '-USD' END)"
    )


def kind_of(a: str, q: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.QUOTE_KIND.items())
    return (
        f"(CASE WHEN {q} IS NOT NULL THEN coalesce(CASE {q} {arms} END, 'unknown') WHEN {a} = 'USD' THEN 'cash' "
        f"WHEN {a} IN {FIAT} OR {a} LIKE '%USD=X' THEN 'fx' WHEN {a} LIKE '%-USD' THEN 'crypto' "
        f"WHEN {bucket(a)} IN {FOREIGN} THEN 'stock' WHEN {a} LIKE 'CASH %' OR {stable(a)} THEN 'cash' ELSE 'stock' END)"
    )


def one(k: str) -> str:
    return f"({k} = 'USD' OR {stable(k)})"


SIGNED = (
    "CASE WHEN action IN ('BUY', 'DEPOSIT', 'DIVIDEND', 'INTEREST', 'TRANSFER', 'EXCHANGE_TO') THEN quantity "
    "WHEN action IN ('SELL', 'WITHDRAW', 'FEE', 'TAX') THEN -quantity WHEN action = 'EXCHANGE_FROM' THEN {x} quantity "
    "ELSE 0 END"
)
ADDED, SUBTRACTED = SIGNED.format(x="+"), SIGNED.format(x="-")
DELTA = "CASE WHEN action IN ('BUY', 'EXCHANGE_TO') THEN quantity WHEN action IN ('SELL', 'EXCHANGE_FROM') THEN -quantity ELSE 0 END"

# Name -> (text, names it reads).
LIB: dict[str, tuple[str, tuple[str, ...]]] = {n: (text, needs) for n, (text, needs) in VIEWS.items()}


def lib(name: str, text: str, *needs: str) -> None:
    LIB[name] = (text, needs)


def build(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for need in LIB[name][1]:
            visit(need)
        if name not in order:
            order.append(name)

    for need in needs:
        visit(need)
    heads = [f"{n.replace('()', '')} AS ({LIB[n][0]})" for n in order]
    return (f"WITH RECURSIVE {', '.join(heads)} " if heads else "") + final


SQL: dict[str, str] = {}


def q(name: str, final: str, *needs: str) -> None:
    SQL[name] = build(final, *needs)


# --- shared parts ----------------------------------------------------------------------------------------------

lib(
    "led",
    f"""SELECT *, {norm_of('asset', 'asset_type')} AS norm_key, {key_of('asset', 'asset_type')} AS own_key,
    {fee_key("coalesce(nullif(fee_currency, ''), nullif(currency, ''), 'USD')")} AS paid_fee_key
    FROM (SELECT *, {cash_like('asset', 'asset_type')} AS is_cash FROM
      (SELECT *, {bucket('asset')} AS asset_type, {bucket('fee_currency')} AS fee_type FROM txn))""",
    "txn",
)
lib("latest", f"SELECT ticker, arg_max(price, date) AS price FROM prices WHERE date <= {D} GROUP BY ticker", "prices")
lib(
    "units",
    f"""SELECT l.ticker, l.price, CASE WHEN {pair_of(bucket('l.ticker'))} = 'USD' THEN 1.0 ELSE f.price END AS fx,
    CASE WHEN {pair_of(bucket('l.ticker'))} = 'USD' THEN l.price ELSE l.price * f.price END AS unit
    FROM latest l LEFT JOIN latest f ON f.ticker = {pair_of(bucket('l.ticker'))}""",
    "latest",
)
lib(
    "pos",
    f"""SELECT account, asset, asset_type, sum(delta * coalesce(f, 1)) AS net_quantity FROM (
      SELECT t.account, t.asset, t.asset_type, {DELTA.replace('action', 't.action').replace('quantity', 't.quantity')} AS delta,
        (SELECT product(s.quantity) FROM led s WHERE s.action = 'SPLIT' AND s.account = t.account AND s.asset = t.asset
          AND s.date <= {D} AND (s.date > t.date OR (s.date = t.date AND s.id > t.id))) AS f
      FROM led t WHERE NOT t.is_cash AND t.action <> 'SPLIT' AND t.date <= {D})
    GROUP BY account, asset, asset_type HAVING sum(delta * coalesce(f, 1)) <> 0""",
    "led",
)
lib(
    "marked",
    """SELECT *, coalesce(fees, 0) AS fee, trade AND coalesce(fee_currency, '') <> ''
      AND fee_currency <> coalesce(currency, 'USD') AND coalesce(fees, 0) > 0 AS apart
    FROM (SELECT *, action IN ('BUY', 'SELL') AND NOT is_cash AND price IS NOT NULL AS trade FROM led)""",
    "led",
)
lib(
    "legs",
    f"""SELECT account, date, own_key AS cash_key, {shown('own_key')} AS currency,
      CASE WHEN asset LIKE 'CASH %' THEN asset WHEN asset_type = 'cash_base' THEN 'CASH USD'
        WHEN asset_type = 'cash_stable' THEN 'CASH ' || upper(asset)
        WHEN asset_type = 'cash_fx' THEN 'CASH ' || {shown('own_key')} END AS label,
      CASE WHEN trade AND action = 'BUY' THEN -(quantity * price + CASE WHEN apart THEN 0 ELSE fee END)
        WHEN trade THEN quantity * price - CASE WHEN apart THEN 0 ELSE fee END
        WHEN action = 'SPLIT' THEN 0 WHEN action IN ('SELL', 'WITHDRAW', 'FEE', 'TAX') THEN -quantity ELSE quantity END AS delta
    FROM marked
    UNION ALL
    SELECT account, date, {fee_key('fee_currency')}, CASE WHEN fee_type = 'cash_base' THEN 'USD' ELSE fee_currency END,
      'CASH ' || CASE WHEN fee_type = 'cash_base' THEN 'USD' WHEN fee_type = 'cash_fx'
        THEN {shown(key_of('fee_currency', 'fee_type'))} ELSE fee_currency END, -fee
    FROM marked WHERE apart""",
    "marked",
)
lib(
    "cash_now",
    f"""SELECT c.account, c.cash_key, c.currency, coalesce(c.label, 'CASH ' || c.currency) AS display_bucket, c.balance,
      CASE WHEN {one('c.cash_key')} THEN c.balance ELSE c.balance * coalesce(l.price, 0) END AS usd_value
    FROM (SELECT account, cash_key, max(currency) AS currency, max(label) AS label, sum(delta) AS balance
      FROM legs WHERE date <= {D} GROUP BY account, cash_key HAVING sum(delta) <> 0) c
    LEFT JOIN latest l ON l.ticker = c.cash_key""",
    "legs",
    "latest",
)
lib(
    "valued",
    f"""SELECT p.account, p.asset, p.asset_type, p.net_quantity, p.net_quantity * coalesce(u.unit, 0) AS value_usd
    FROM pos p LEFT JOIN units u ON u.ticker = p.asset
    UNION ALL
    SELECT account, cash_key, CASE WHEN cash_key = 'USD' THEN 'cash_base' WHEN {stable('cash_key')} THEN 'cash_stable'
      ELSE 'cash_fx' END, balance, usd_value FROM cash_now""",
    "pos",
    "units",
    "cash_now",
)
lib("worth", "SELECT account, sum(value_usd) AS portfolio_value FROM valued GROUP BY account", "valued")
lib(
    "alloc",
    f"""SELECT v.account, v.asset, v.asset_type, {kind_of('v.asset', 'm.quote_type')} AS asset_kind, v.net_quantity,
      v.value_usd, CASE WHEN w.portfolio_value > 0 THEN v.value_usd / w.portfolio_value * 100 ELSE 0 END AS allocation_pct
    FROM valued v JOIN worth w USING (account) LEFT JOIN metadata_flat m ON m.ticker = v.asset WHERE v.value_usd <> 0""",
    "valued",
    "worth",
    "metadata_flat",
)
lib(
    "weights",
    "SELECT ticker, sector, parts / sum(parts) OVER (PARTITION BY ticker) AS weight FROM sector_parts",
    "sector_parts",
)
lib(
    "meta",
    """SELECT ticker, quote_type, CASE WHEN asset_no IN (1, 6, 8) THEN 'Technology' WHEN asset_no = 12 THEN 'Energy' END
      AS sector, DATE '2001-06-30' - CAST(asset_no AS INTEGER) AS fetched FROM metadata_flat""",
    "metadata_flat",
)

# Lots: intervals on the axis of pre-split units, matched by overlap.
lib(
    "trades",
    f"""SELECT t.*, coalesce((SELECT product(s.quantity) FROM led s WHERE s.action = 'SPLIT' AND s.account = t.account
        AND s.asset = t.asset AND s.date <= {D} AND (s.date < t.date OR (s.date = t.date AND s.id < t.id))), 1) AS factor
    FROM led t WHERE t.action IN ('BUY', 'SELL') AND NOT t.is_cash AND t.quantity > 0 AND t.date <= {D}""",
    "led",
)
_CCY = "coalesce(nullif(currency, ''), 'USD')"
lib(
    "costed",
    f"""SELECT account, asset, asset_type, date, id, action, factor, quantity / factor AS units,
      CASE WHEN action = 'BUY' THEN paid + fee_usd ELSE paid - fee_usd END AS usd
    FROM (SELECT a.*, quantity * coalesce(a.price, 0) * CASE WHEN {one('pay_key')} THEN 1 ELSE p.price END AS paid,
        coalesce(fees, 0) * CASE WHEN {one('paid_fee_key')} THEN 1 ELSE f.price END AS fee_usd
      FROM (SELECT *, {norm_of(_CCY, bucket(_CCY))} AS pay_key FROM trades) a
      ASOF LEFT JOIN prices p ON p.ticker = a.pay_key AND p.date <= a.date
      ASOF LEFT JOIN prices f ON f.ticker = a.paid_fee_key AND f.date <= a.date)""",
    "trades",
    "prices",
)
lib(
    "running",
    """SELECT *, sum(CASE WHEN action = 'BUY' THEN units ELSE -units END) OVER w AS s,
      sum(CASE WHEN action = 'BUY' THEN units ELSE 0 END) OVER w AS b
    FROM costed WINDOW w AS (PARTITION BY account, asset ORDER BY date, id)""",
    "costed",
)
lib(
    "held",
    """SELECT *, b - held AS used, coalesce(lag(b - held) OVER (PARTITION BY account, asset ORDER BY date, id), 0) AS used_before
    FROM (SELECT *, s - least(0, min(s) OVER (PARTITION BY account, asset ORDER BY date, id)) AS held FROM running)""",
    "running",
)
# Lots one event after the other: each step of the recursion takes the next event of every (account, asset) and keeps the
# open lots as a list.  Quantities here are binary fractions, so plain numbers are exact.
lib(
    "events",
    f"""SELECT *, row_number() OVER (PARTITION BY account, asset ORDER BY date, id) AS n FROM (
      SELECT account, asset, date, id, action, units * factor AS quantity, usd FROM costed
      UNION ALL SELECT account, asset, date, id, action, quantity, 0 FROM led WHERE action = 'SPLIT' AND NOT is_cash AND quantity > 0 AND date <= {D}
        AND (account, asset) IN (SELECT (account, asset) FROM costed))""",
    "costed",
    "led",
)
lib(
    "walk",
    """SELECT DISTINCT account, asset, 0::BIGINT AS n, []::STRUCT(id BIGINT, date DATE, size DOUBLE, rest DOUBLE, usd DOUBLE)[] AS lots,
        []::STRUCT(sell_date DATE, sell_id BIGINT, sell_quantity DOUBLE, proceeds_usd DOUBLE, cost_basis_usd DOUBLE, buy_id BIGINT, buy_date DATE)[] AS matches
      FROM events
    UNION ALL
    SELECT account, asset, n, CASE action
        WHEN 'BUY' THEN list_append(lots, {'id': id, 'date': date, 'size': quantity, 'rest': quantity, 'usd': usd})
        WHEN 'SPLIT' THEN list_transform(lots, lambda l: {'id': l.id, 'date': l.date, 'size': l.size * quantity, 'rest': l.rest * quantity, 'usd': l.usd})
        ELSE list_filter(list_transform(lots, lambda l, k: {'id': l.id, 'date': l.date, 'size': l.size, 'rest': l.rest - taken[k], 'usd': l.usd}), lambda l: l.rest > 0) END,
      CASE WHEN action = 'SELL' THEN list_filter(list_transform(lots, lambda l, k: {'sell_date': date, 'sell_id': id, 'sell_quantity': taken[k],
        'proceeds_usd': usd * taken[k] / quantity, 'cost_basis_usd': l.usd * taken[k] / l.size, 'buy_id': l.id, 'buy_date': l.date}), lambda m: m.sell_quantity > 0)
        ELSE [] END
    FROM (SELECT w.account, w.asset, w.lots, e.n, e.date, e.id, e.action, e.quantity, e.usd, CASE WHEN e.action = 'SELL' THEN list_transform(w.lots, lambda l, k:
        greatest(0, least(l.rest, e.quantity - coalesce(list_sum(list_transform(w.lots[:k - 1], lambda x: x.rest)), 0)))) END AS taken
      FROM walk w JOIN events e ON w.account = e.account AND w.asset = e.asset AND e.n = w.n + 1)""",
    "events",
)
lib(
    "gains",
    """SELECT account, m.sell_date, m.sell_id, asset, m.sell_quantity, m.proceeds_usd, m.cost_basis_usd,
      m.proceeds_usd - m.cost_basis_usd AS realized_gain, m.sell_date - m.buy_date AS holding_days, m.buy_id AS matched_buy_id,
      m.buy_date AS matched_buy_date FROM (SELECT account, asset, unnest(matches) AS m FROM walk)""",
    "walk",
)
lib(
    "open_lots",
    """SELECT account, asset, sum(l.usd * l.rest / l.size) AS cost, sum(l.rest) AS quantity
    FROM (SELECT account, asset, unnest(arg_max(lots, n)) AS l FROM walk GROUP BY account, asset) GROUP BY account, asset""",
    "walk",
)
lib(
    "fifo",
    """SELECT account, cost_basis, realized_gain, market - cost_basis AS unrealized_gain,
      realized_gain + (market - cost_basis) AS total_profit
    FROM (SELECT a.account, round(coalesce(c.cost, 0), 2) AS cost_basis, round(coalesce(g.gain, 0), 2) AS realized_gain,
        round(coalesce(c.market, 0), 2) AS market
      FROM (SELECT DISTINCT account FROM held) a
      LEFT JOIN (SELECT account, sum(o.cost) AS cost, sum(CASE WHEN quantity > 0 THEN quantity * u.unit END) AS market
        FROM open_lots o LEFT JOIN units u ON u.ticker = o.asset GROUP BY account) c USING (account)
      LEFT JOIN (SELECT account, sum(realized_gain) AS gain FROM gains GROUP BY account) g USING (account))""",
    "held",
    "open_lots",
    "gains",
    "units",
)
lib(
    "rated",
    f"""SELECT r.*, r.quantity * CASE WHEN {one('r.norm_key')} THEN 1 ELSE p.price END AS usd,
      r.fees * CASE WHEN {one('r.paid_fee_key')} THEN 1 ELSE f.price END AS fee_usd
    FROM led r ASOF LEFT JOIN prices p ON p.ticker = r.norm_key AND p.date <= r.date
    ASOF LEFT JOIN prices f ON f.ticker = r.paid_fee_key AND f.date <= r.date""",
    "led",
    "prices",
)
lib(
    "flows",
    f"""SELECT account, count(*) AS transactions_count, min(date) AS start_date, max(date) AS end_date,
      coalesce(sum(usd) FILTER (action = 'DEPOSIT'), 0) AS deposits,
      coalesce(sum(usd) FILTER (action = 'WITHDRAW'), 0) AS withdrawals,
      coalesce(sum(usd) FILTER (action IN ('DIVIDEND', 'INTEREST')), 0) AS income,
      coalesce(sum(usd) FILTER (action = 'FEE'), 0) + coalesce(sum(fee_usd) FILTER (fees > 0), 0) AS fees,
      coalesce(sum(usd) FILTER (action = 'TAX'), 0) AS taxes
    FROM rated WHERE date <= {D} GROUP BY account""",
    "rated",
)
lib(
    "stat",
    """SELECT account, transactions_count, start_date, end_date, coalesce(portfolio_value, 0) AS portfolio_value,
      deposits - withdrawals AS total_invested, deposits, withdrawals, income, fees, taxes,
      CASE WHEN deposits > withdrawals THEN coalesce(portfolio_value, 0) - (deposits - withdrawals) END AS total_gain,
      CASE WHEN deposits > withdrawals THEN (coalesce(portfolio_value, 0) - (deposits - withdrawals))
        / (deposits - withdrawals) * 100 END AS total_gain_pct,
      coalesce(cost_basis, 0) AS cost_basis, coalesce(realized_gain, 0) AS realized_gain,
      coalesce(unrealized_gain, 0) AS unrealized_gain, coalesce(total_profit, 0) AS total_profit
    FROM flows LEFT JOIN worth USING (account) LEFT JOIN fifo USING (account)""",
    "flows",
    "worth",
    "fifo",
)

# Daily values: every account-day meets the last position of each instrument and the last quote by as-of joins.
lib(
    "moves",
    f"""SELECT account, kind, instrument, date, sum(move) AS move, product(split) AS split FROM (
      SELECT account, 'asset' AS kind, asset AS instrument, date,
        {DELTA.replace('action', 't.action').replace('quantity', 't.quantity')}
          / coalesce((SELECT product(s.quantity) FROM led s WHERE s.action = 'SPLIT' AND s.account = t.account
            AND s.asset = t.asset AND (s.date < t.date OR (s.date = t.date AND s.id < t.id))), 1) AS move, 1.0 AS split
      FROM led t WHERE NOT is_cash AND action <> 'SPLIT'
      UNION ALL SELECT account, 'asset', asset, date, 0, quantity FROM led WHERE action = 'SPLIT'
      UNION ALL SELECT account, 'cash', cash_key, date, delta, 1.0 FROM legs)
    WHERE date <= {D} GROUP BY ALL""",
    "led",
    "legs",
)
lib(
    "levels",
    """SELECT account, kind, instrument, date, sum(move) OVER w * product(split) OVER w AS quantity FROM moves
    WINDOW w AS (PARTITION BY account, kind, instrument ORDER BY date)""",
    "moves",
)
lib(
    "spine",
    f"""SELECT account, CAST(unnest(generate_series(first_day, {D}, INTERVAL 1 DAY)) AS DATE) AS date
    FROM (SELECT account, min(date) AS first_day FROM led WHERE date <= {D} GROUP BY account)""",
    "led",
)
lib(
    "quotes",
    f"""SELECT g.ticker, g.date, p.price FROM (SELECT i.ticker, d.date FROM (SELECT DISTINCT ticker FROM prices) i,
      (SELECT DISTINCT date FROM spine) d) g ASOF JOIN prices p ON p.ticker = g.ticker AND p.date <= g.date""",
    "spine",
    "prices",
)
lib(
    "inst_days",
    f"""SELECT s.account, i.kind, i.instrument, s.date, l.quantity,
      l.quantity * CASE WHEN i.kind = 'cash' AND {one('i.instrument')} THEN 1
        WHEN {pair_of(bucket('i.instrument'))} = 'USD' THEN coalesce(u.price, 0)
        ELSE coalesce(u.price * f.price, 0) END AS value_usd,
      NOT (i.kind = 'cash' AND {one('i.instrument')}) AND (u.price IS NULL OR
        {pair_of(bucket('i.instrument'))} <> 'USD' AND f.price IS NULL) AS missing
    FROM spine s JOIN (SELECT DISTINCT account, kind, instrument FROM moves) i USING (account)
    ASOF JOIN levels l ON l.account = s.account AND l.kind = i.kind AND l.instrument = i.instrument AND l.date <= s.date
    LEFT JOIN quotes u ON u.ticker = i.instrument AND u.date = s.date
    LEFT JOIN quotes f ON f.ticker = {pair_of(bucket('i.instrument'))} AND f.date = s.date
    WHERE abs(l.quantity) > 1e-9""",
    "spine",
    "moves",
    "levels",
    "quotes",
)
lib(
    "base_days",
    """SELECT s.account, s.date, coalesce(v.value, 0) AS value, coalesce(x.flow, 0) AS flow,
      lag(coalesce(v.value, 0)) OVER (PARTITION BY s.account ORDER BY s.date) AS before
    FROM spine s
    LEFT JOIN (SELECT account, date, sum(value_usd) AS value FROM inst_days GROUP BY ALL) v USING (account, date)
    LEFT JOIN (SELECT account, date, sum(CASE action WHEN 'DEPOSIT' THEN usd ELSE -usd END) AS flow FROM rated
      WHERE is_cash AND action IN ('DEPOSIT', 'WITHDRAW') GROUP BY ALL) x USING (account, date)""",
    "spine",
    "inst_days",
    "rated",
)
lib(
    "daily",
    """SELECT account, date, value AS portfolio_value,
      CASE WHEN before > 0 THEN (value - before) / before * 100 ELSE 0 END AS portfolio_daily_return,
      CASE WHEN before > 0 THEN (value - before - flow) / before * 100 ELSE 0 END AS investment_return,
      CASE WHEN before IS NULL THEN 0 ELSE flow END AS cash_flow_impact,
      first(value) OVER w + sum(CASE WHEN before IS NULL THEN 0 ELSE flow END) OVER w AS adjusted_base
    FROM base_days WINDOW w AS (PARTITION BY account ORDER BY date)""",
    "base_days",
)


def _performance(name: str, since: str | None) -> None:
    floor = f" AND date >= DATE '{since}'" if since else ""
    lib(
        f"dr_{name}",
        f"""SELECT *, ln(greatest(1 + investment_return / 100, 1e-12)) AS lg,
          max(portfolio_value) OVER (PARTITION BY account ORDER BY date) AS peak
        FROM daily WHERE portfolio_value > 0{floor}""",
        "daily",
    )
    lib(
        f"dd_{name}",
        f"SELECT account, date, (peak - portfolio_value) / peak * 100 AS dd, "
        f"count(*) FILTER (peak = portfolio_value) OVER (PARTITION BY account ORDER BY date) AS island FROM dr_{name}",
        f"dr_{name}",
    )
    lib(
        f"bench_{name}",
        f"""SELECT date, price, (price - before) / before * 100 AS ret FROM (SELECT date, price,
          lag(price) OVER (ORDER BY date) AS before FROM prices WHERE ticker = '{BENCHMARK}' AND date <= {D}{floor})
        WHERE before > 0""",
        "prices",
    )
    lib(
        f"perf_{name}",
        f"""SELECT m.*, cv.*, dd.*, mm.*, al.*, bb.*, date_diff('day', start_date, end_date) AS days,
          CASE WHEN days > 0 THEN pow(1 + twr, 1 / (days / 365.25)) - 1 ELSE 0 END AS growth,
          pow(1 + twr, 1 / greatest(days / 365.25, 1 / 365.25)) - 1 AS growth_floored,
          CASE WHEN days > 0 AND btwr > -1 AND bs > 0 AND be > 0 THEN pow(1 + btwr, 1 / (days / 365.25)) - 1 ELSE 0 END AS bgrowth,
          CASE WHEN var > 0 THEN cov / var ELSE 0 END AS bt
        FROM (SELECT account, count(*) AS total_days, min(date) AS start_date, max(date) AS end_date,
            arg_min(portfolio_value, date) AS start_value, arg_max(portfolio_value, date) AS end_value,
            avg(portfolio_daily_return) AS adr, avg(investment_return) AS air, stddev_pop(investment_return) AS sd,
            quantile_cont(investment_return, 0.05) AS v95, quantile_cont(investment_return, 0.01) AS v99,
            exp(sum(lg)) - 1 AS twr,
            coalesce(sqrt(avg(pow(investment_return - 0.02 / 252 * 100, 2)) FILTER (investment_return < 0.02 / 252 * 100)), 0) AS down
          FROM dr_{name} GROUP BY account) m
        JOIN (SELECT d.account, avg(investment_return) FILTER (investment_return <= q95) AS c95,
            avg(investment_return) FILTER (investment_return <= q99) AS c99
          FROM dr_{name} d JOIN (SELECT account, quantile_cont(investment_return, 0.05) AS q95,
            quantile_cont(investment_return, 0.01) AS q99 FROM dr_{name} GROUP BY account) USING (account) GROUP BY d.account) cv USING (account)
        JOIN (SELECT account, max(dd) AS mdd, coalesce(avg(dd) FILTER (dd > 0), 0) AS add_, coalesce(count(*) FILTER (dd > 0)
            / nullif(count(DISTINCT island) FILTER (dd > 0), 0), 0) AS dur FROM dd_{name} GROUP BY account) dd USING (account)
        JOIN (SELECT account, median(r) * 100 AS med FROM (SELECT account, date_trunc('month', date) AS mo, exp(sum(lg)) - 1 AS r
            FROM dr_{name} GROUP BY ALL) GROUP BY account) mm USING (account)
        LEFT JOIN (SELECT account, covar_pop(investment_return, ret) AS cov, var_pop(ret) AS var,
            avg(investment_return - ret) AS exc, sqrt(avg(pow(investment_return - ret, 2))) AS te,
            sum(investment_return) FILTER (ret > 0) AS upp, sum(ret) FILTER (ret > 0) AS upb,
            sum(investment_return) FILTER (ret < 0) AS dnp, sum(ret) FILTER (ret < 0) AS dnb
          FROM dr_{name} JOIN bench_{name} USING (date) GROUP BY account) al USING (account)
        CROSS JOIN (SELECT arg_min(price, date) AS bs, arg_max(price, date) AS be,
            exp(sum(ln(greatest(1 + ret / 100, 1e-12)))) - 1 AS btwr FROM bench_{name}) bb""",
        f"dr_{name}",
        f"dd_{name}",
        f"bench_{name}",
    )
    lib(
        f"report_{name}",
        f"""SELECT account, total_days, start_date, end_date, start_value, end_value, start_value * twr AS total_gain,
          adr AS avg_daily_return, air AS avg_investment_return, sd AS std_dev, sd * sqrt(252) AS hist_volatility,
          v95 AS var_95, v99 AS var_99, coalesce(c95, 0) AS cvar_95, coalesce(c99, 0) AS cvar_99, mdd AS max_drawdown,
          add_ AS avg_drawdown, dur AS avg_drawdown_duration, twr * 100 AS time_weighted_return_pct,
          (end_value - start_value) / start_value * 100 AS total_return_pct, med AS median_monthly_return,
          growth * 100 AS cagr, bt AS beta,
          CASE WHEN sd > 0 THEN (growth_floored - 0.02) / (sd * sqrt(252) / 100) ELSE 0 END AS sharpe_ratio,
          CASE WHEN down > 0 THEN (air - 0.02 / 252 * 100) / down * sqrt(252) ELSE 0 END AS sortino_ratio,
          CASE WHEN bt <> 0 THEN (growth_floored - 0.02) / bt ELSE 0 END AS treynor_ratio,
          CASE WHEN te > 0 THEN exc * 252 / (te * sqrt(252)) ELSE 0 END AS information_ratio,
          CASE WHEN days > 0 THEN (growth - (0.02 + bt * (bgrowth - 0.02))) * 100 ELSE 0 END AS jensens_alpha,
          CASE WHEN days > 0 THEN (growth - bgrowth) * 100 ELSE 0 END AS relative_return,
          coalesce(te * sqrt(252), 0) AS tracking_error, CASE WHEN btwr > -1 THEN btwr * 100 ELSE 0 END AS spy_twr_pct,
          bgrowth * 100 AS spy_cagr_pct, CASE WHEN upb <> 0 THEN upp / upb ELSE 0 END AS up_capture_ratio,
          CASE WHEN dnb <> 0 THEN dnp / dnb ELSE 0 END AS down_capture_ratio,
          CASE WHEN mdd <> 0 THEN growth * 100 / mdd ELSE 0 END AS calmar_ratio,
          ((1 + growth) / 1.025 - 1) * 100 AS real_cagr,
          (end_value / start_value / pow(1.025, days / 365.25) - 1) * 100 AS real_total_return_pct
        FROM perf_{name}""",
        f"perf_{name}",
    )


_performance("all", None)
_performance("since", "1999-01-01")

PERF_COLUMNS = (
    "start_value end_value total_gain avg_daily_return avg_investment_return std_dev hist_volatility var_95 var_99 "
    "cvar_95 cvar_99 max_drawdown avg_drawdown avg_drawdown_duration time_weighted_return_pct total_return_pct "
    "median_monthly_return cagr beta sharpe_ratio sortino_ratio treynor_ratio information_ratio jensens_alpha "
    "relative_return tracking_error spy_twr_pct spy_cagr_pct up_capture_ratio down_capture_ratio calmar_ratio real_cagr "
    "real_total_return_pct"
).split()


def rnd(digits: int, *names: str) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def swap(digits: int, *names: str) -> str:
    """SELECT list that replaces columns by their rounded values."""
    return "* REPLACE (" + rnd(digits, *names) + ")"


# --- scans, sources, sinks -------------------------------------------------------------------------------------

q("ledger_page", """SELECT account, id, date, asset, action, quantity, price, currency, fees FROM txn
  WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' ORDER BY date, id LIMIT 50 OFFSET 100""", "txn")
q("ledger_page_total", "SELECT count(*) AS total FROM txn WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'", "txn")
q("report_page", "SELECT * FROM daily WHERE date >= DATE '1998-01-01' ORDER BY date, account LIMIT 30 OFFSET 60", "daily")
q("price_upsert", """SELECT ticker, date, coalesce(n.price, p.price) AS price FROM prices p FULL JOIN
  (SELECT asset AS ticker, date, arg_max(price, id) AS price FROM trade_lines GROUP BY ALL) n USING (ticker, date)""",
  "prices", "trade_lines")
q("metadata_upsert", """SELECT ticker, quote_type, CASE WHEN n.sector IS NOT NULL THEN n.sector ELSE m.sector END AS sector,
  CASE WHEN n.sector IS NOT NULL THEN 'Global' END AS region, CASE WHEN n.sector IS NOT NULL THEN 'scan' ELSE 'parts' END AS source
  FROM meta m FULL JOIN (SELECT ticker, arg_max(sector, (parts, sector)) AS sector FROM sector_parts GROUP BY ticker) n USING (ticker)""",
  "meta", "sector_parts")
q("chart_bars", f"""SELECT ticker, date, CASE WHEN volume % 3 = 0 THEN close ELSE open END AS open,
  CASE WHEN volume % 3 = 0 THEN close ELSE high END AS high, low, close, volume FROM bars WHERE date <= {D} AND volume % 7 <> 0""", "bars")
q("price_rows", f"""SELECT ticker, date, CASE WHEN ticker IN {_in(vocab.REVERSE_QUOTED)} THEN 1 / price ELSE price END AS price
  FROM prices WHERE date BETWEEN DATE '1996-01-01' AND {D}""", "prices")
q("cash_prices", f"""SELECT DISTINCT asset AS ticker, CAST(d AS DATE) AS date, 1.0::DOUBLE AS price
  FROM txn, generate_series(DATE '2001-01-01', {D}, INTERVAL 1 DAY) g(d) WHERE asset LIKE 'CASH%'""", "txn")
q("latest_indicator", "SELECT arg_max(unrate, date) AS value, max(date) AS date FROM macro WHERE unrate IS NOT NULL", "macro")
q("purged_prices", """SELECT ticker, count(*) AS rows, sum(price) AS price_sum FROM (SELECT * FROM prices UNION ALL
  SELECT 'USD', date, price FROM prices WHERE ticker = 'EURUSD=X' AND price = 1) GROUP BY ticker""", "prices")

# --- classification --------------------------------------------------------------------------------------------

lib("names", """SELECT DISTINCT a AS asset FROM (SELECT asset AS a FROM txn UNION ALL SELECT currency FROM txn
  UNION ALL SELECT fee_currency FROM txn) WHERE a <> ''""", "txn")
q("asset_classes", f"""SELECT asset, t AS asset_type, {stable('asset')} AS stablecoin, {cash_like('asset', 't')} AS cash_like,
  {norm_of('asset', 't')} AS normalized, {key_of('asset', 't')} AS cash_key, {shown(key_of('asset', 't'))} AS display_currency,
  {pair_of('t')} AS quote_pair, {fee_key('asset')} AS fee_ticker,
  NOT (asset = 'USD' OR {stable('asset')} OR upper(asset) IN {_in(vocab.CURRENCIES)} OR regexp_full_match(asset, '[A-Z]{{3}}USD=X')
    OR asset LIKE 'CASH %') AS fetchable
  FROM (SELECT asset, {bucket('asset')} AS t FROM names)""", "names")
_AN = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.QUOTE_ANALYSIS_TYPE.items())
_KD = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.QUOTE_KIND.items())
_TI = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.TRACKING_INDEX.items())
ANALYSIS = f"coalesce(CASE quote_type {_AN} END, 'UNKNOWN')"
q("asset_kinds", f"""SELECT ticker, {kind_of('ticker', 'quote_type')} AS asset_kind, coalesce(CASE quote_type {_KD} END, 'unknown') AS quote_kind,
  {ANALYSIS} AS analysis_type, CASE {ANALYSIS} WHEN 'CRYPTO' THEN 365.0 ELSE 252.0 END::DOUBLE AS periods,
  coalesce(CASE ticker {_TI} END, '{vocab.DEFAULT_INDEX}') AS tracking_index FROM meta""", "meta")
_FI = _in(c for c in vocab.CURRENCIES if c != "USD")
_PA = _in(f"{c}USD=X" for c in vocab.CURRENCIES)
_FS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.FUND_SECTOR.items())
FALLBACK = (
    f"CASE WHEN upper(asset) IN {_in(vocab.FUND_SECTOR_WEIGHTS)} THEN NULL WHEN upper(asset) IN {_in(vocab.FUND_SECTOR)} THEN CASE upper(asset) {_FS} END "
    f"WHEN asset = 'USD' OR asset LIKE 'CASH %' THEN 'Cash' WHEN {stable('asset')} OR asset LIKE '%-USD' THEN 'Crypto' "
    f"WHEN asset IN {_FI} OR asset IN {_PA} THEN 'FX' END"
)
_FW = " ".join(f"WHEN '{k}' THEN {len(v)}" for k, v in vocab.FUND_SECTOR_WEIGHTS.items())
q("static_profiles", f"""SELECT asset,
  CASE WHEN asset = 'USD' THEN 'Cash' WHEN {stable('asset')} THEN 'Crypto' WHEN asset IN {_FI} OR asset IN {_PA} THEN 'FX'
    WHEN asset LIKE 'CASH %' THEN 'Cash' WHEN asset LIKE '%-USD' THEN 'Crypto' END AS sector,
  CASE WHEN asset = 'USD' THEN 'US' WHEN {stable('asset')} THEN 'Global' WHEN asset IN {_FI} OR asset IN {_PA} THEN left(asset, 3)
    WHEN asset LIKE 'CASH %' THEN 'US' WHEN asset LIKE '%-USD' THEN 'Global' END AS region,
  {FALLBACK} AS fallback_sector, coalesce(CASE asset {_FW} END, 0)::INTEGER AS fallback_weights FROM names""", "names")
q("trading_days", """SELECT DISTINCT date, CASE dayofweek(date) WHEN 0 THEN date - 2 WHEN 6 THEN date - 1 ELSE date END AS trading_day,
  date AS from_iso, date AS from_old, CAST(NULL AS DATE) AS from_bad FROM txn""", "txn")
q("signed_quantities", f"""SELECT account, action, CAST(sum({ADDED}) AS DOUBLE) AS exchange_added,
  CAST(sum({SUBTRACTED}) AS DOUBLE) AS exchange_subtracted, CAST(sum({DELTA}) AS DOUBLE) AS position FROM txn GROUP BY ALL""", "txn")
q("quote_spreads", "SELECT ticker, date, high - low AS spread, round((high - low) / low * 100, 8) AS spread_pct FROM bars", "bars")

# --- validation ------------------------------------------------------------------------------------------------

lib("checked", f"""SELECT action, list_filter([
  CASE WHEN action NOT IN {_in(vocab.USER_ACTIONS)} THEN 'UNKNOWN_ACTION' END,
  CASE WHEN action IN ('BUY', 'SELL') AND asset IN {_in(vocab.CURRENCIES)} THEN 'BARE_CURRENCY_TRADE' END,
  CASE WHEN currency NOT IN {_in(vocab.CURRENCIES)} THEN 'UNKNOWN_CURRENCY' END,
  CASE WHEN trim(exchange) = '' THEN 'EXCHANGE_REQUIRED' END,
  CASE WHEN NOT quantity > 0 THEN 'QUANTITY_NOT_POSITIVE' END,
  CASE WHEN price <= 0 THEN 'PRICE_NOT_POSITIVE' END, CASE WHEN fees < 0 THEN 'FEES_NEGATIVE' END,
  CASE WHEN action IN ('BUY', 'SELL') AND price IS NULL THEN 'PRICE_REQUIRED' END,
  CASE WHEN action IN {_in(vocab.CASH_ONLY_ACTIONS)} AND price IS NOT NULL THEN 'PRICE_NOT_ALLOWED' END,
  CASE WHEN action IN {_in(vocab.CASH_ONLY_ACTIONS)} AND NOT is_cash THEN 'CASH_ASSET_REQUIRED' END,
  CASE WHEN action = 'SPLIT' AND is_cash THEN 'SPLIT_NEEDS_NON_CASH' END], lambda e: e IS NOT NULL) AS errors FROM led""", "led")
q("row_validation", "SELECT action, error, count(*) AS rows FROM (SELECT action, unnest(errors) AS error FROM checked) GROUP BY ALL", "checked")
q("accepted_rows", "SELECT action, count(*) AS rows FROM checked WHERE len(errors) = 0 GROUP BY ALL", "checked")
q("oversold_sales", """SELECT account, asset, date, id, quantity, held FROM (SELECT *, coalesce(sum(CASE action WHEN 'BUY' THEN quantity
  ELSE -quantity END) OVER (PARTITION BY account, asset ORDER BY date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held
  FROM txn WHERE action IN ('BUY', 'SELL')) WHERE action = 'SELL' AND quantity > held""", "txn")
q("unpriced_holdings", f"""SELECT h.account, h.asset, CASE WHEN p.price IS NULL THEN h.asset ELSE {pair_of('h.asset_type')} END AS missing,
  CASE WHEN p.price IS NULL THEN 'PRICE_UNAVAILABLE' ELSE 'FX_PRICE_UNAVAILABLE' END AS problem, DATE '{EARLY}' AS as_of_date
  FROM (SELECT account, asset, asset_type, DATE '{EARLY}' AS d, sum({DELTA}) AS net FROM led WHERE NOT is_cash AND date <= DATE '{EARLY}'
    GROUP BY ALL HAVING net <> 0) h
  ASOF LEFT JOIN prices p ON p.ticker = h.asset AND p.date <= h.d
  ASOF LEFT JOIN prices f ON f.ticker = {pair_of('h.asset_type')} AND f.date <= h.d
  WHERE p.price IS NULL OR (f.price IS NULL AND {pair_of('h.asset_type')} <> 'USD')""", "led", "prices")

# --- as-of look-ups --------------------------------------------------------------------------------------------

q("prices_asof", """SELECT x.ticker, x.date, CASE WHEN p.date >= x.date - 1 THEN p.price END AS recent_price, p.price
  FROM (SELECT DISTINCT CASE coalesce(nullif(currency, ''), 'USD') WHEN 'USD' THEN asset ELSE currency || 'USD=X' END AS ticker, date FROM txn) x
  ASOF LEFT JOIN prices p ON p.ticker = x.ticker AND p.date <= x.date""", "txn", "prices")
q("market_values", f"""SELECT t.account, t.id, t.asset, t.quantity * p.price * CASE WHEN {pair_of('t.asset_type')} = 'USD' THEN 1 ELSE f.price END AS value_usd
  FROM (SELECT * FROM led WHERE action IN ('BUY', 'SELL')) t ASOF LEFT JOIN prices p ON p.ticker = t.asset AND p.date <= t.date
  ASOF LEFT JOIN prices f ON f.ticker = {pair_of('t.asset_type')} AND f.date <= t.date""", "led", "prices")
q("cash_values", "SELECT account, id, asset, usd AS usd_value FROM rated WHERE price IS NULL AND action <> 'SPLIT'", "rated")

# --- holdings --------------------------------------------------------------------------------------------------

lib("all_held", f"SELECT account, asset, CAST(sum({ADDED}) AS DOUBLE) AS net_quantity FROM txn GROUP BY ALL HAVING sum({SUBTRACTED}) <> 0", "txn")
lib("all_cash", f"""SELECT account, own_key AS cash_key, {shown('own_key')} AS currency, CASE WHEN asset LIKE 'CASH %' THEN asset
  WHEN asset_type = 'cash_base' THEN 'CASH USD' WHEN asset_type = 'cash_fx' THEN 'CASH ' || {shown('own_key')} END AS label,
  CAST(sum({ADDED}) AS DOUBLE) AS balance FROM led GROUP BY ALL HAVING sum({ADDED}) <> 0""", "led")
lib("all_valued", f"""SELECT h.*, CASE WHEN {bucket('h.asset')} IN ('cash_base', 'cash_stable') THEN net_quantity
  ELSE net_quantity * u.unit END AS value_usd FROM all_held h LEFT JOIN units u ON u.ticker = h.asset""", "all_held", "units")
q("current_holdings", "SELECT * FROM all_held", "all_held")
q("cash_balances", "SELECT account, cash_key, currency, coalesce(label, 'CASH ' || currency) AS display_bucket, balance FROM all_cash", "all_cash")
q("holdings_with_value", f"""SELECT account, asset, net_quantity, coalesce(net_quantity * l.price, net_quantity) AS market_value_usd,
  {kind_of('asset', 'm.quote_type')} AS asset_kind FROM all_held h LEFT JOIN latest l ON l.ticker = h.asset
  LEFT JOIN metadata_flat m ON m.ticker = h.asset""", "all_held", "latest", "metadata_flat")
q("holdings_allocation", """SELECT account, asset, net_quantity, value_usd, round(CASE WHEN total > 0 THEN value_usd / total * 100 ELSE 0 END, 8)
  AS allocation_pct FROM (SELECT *, sum(value_usd) OVER (PARTITION BY account) AS total FROM all_valued) WHERE value_usd <> 0""", "all_valued")
q("holdings_summary", """SELECT account, coalesce((SELECT count(*) FROM all_held h WHERE h.account = t.account), 0) AS holding_count,
  (SELECT sum(balance) FROM all_cash c WHERE c.account = t.account) AS total_cash_usd,
  (SELECT sum(value_usd) FROM all_valued v WHERE v.account = t.account) AS portfolio_value_usd,
  max(date) AS last_transaction_date, count(*) AS transaction_count FROM txn t GROUP BY account""", "all_held", "all_cash", "all_valued")
q("cash_report", "SELECT * FROM cash_now", "cash_now")
q("split_positions", "SELECT * FROM pos", "pos")
q("allocation", f"SELECT {swap(8, 'allocation_pct')} FROM alloc", "alloc")
q("portfolio_value", "SELECT * FROM worth", "worth")
lib("summ", f"""SELECT account, (SELECT count(*) FROM (SELECT asset FROM txn x WHERE x.account = t.account AND x.date <= {D} GROUP BY asset
    HAVING sum({SUBTRACTED.replace('action', 'x.action').replace('quantity', 'x.quantity')}) <> 0)) AS holding_count,
  coalesce((SELECT sum(usd_value) FROM cash_now c WHERE c.account = t.account), 0) AS total_cash_usd,
  coalesce((SELECT portfolio_value FROM worth w WHERE w.account = t.account), 0) AS portfolio_value_usd,
  max(date) AS last_transaction_date, count(*) AS transaction_count, {D} AS as_of_date
  FROM txn t WHERE date <= {D} GROUP BY account""", "txn", "cash_now", "worth")
q("summary", "SELECT * FROM summ", "summ")

# --- lots, status, income --------------------------------------------------------------------------------------

GAIN_ROWS = "SELECT * FROM gains"
q("realized_gains", GAIN_ROWS, "gains")
q("realized_gains_asset", GAIN_ROWS + " WHERE asset = 'AAPL' AND sell_date >= DATE '1999-01-01'", "gains")
q("realized_gains_by_year", """SELECT account, CAST(year(sell_date) AS INTEGER) AS tax_year, round(coalesce(sum(realized_gain), 0), 4) AS total_realized_gain,
  round(coalesce(sum(realized_gain) FILTER (holding_days <= 365), 0), 4) AS short_term_gain,
  round(coalesce(sum(realized_gain) FILTER (holding_days > 365), 0), 4) AS long_term_gain,
  count(DISTINCT sell_id) AS transaction_count FROM gains GROUP BY ALL""", "gains")
q("fifo_metrics", f"SELECT {swap(2, 'unrealized_gain', 'total_profit')} FROM fifo", "fifo")
q("account_status", f"""SELECT * REPLACE (round(unrealized_gain, 2) AS unrealized_gain, round(total_profit, 2) AS total_profit,
  round(total_gain_pct, 8) AS total_gain_pct), {D} AS as_of_date FROM stat""", "stat")
lib("earned", f"""SELECT account, asset, action, coalesce(currency, 'USD') AS currency, sum(quantity) AS total_quantity, sum(usd) AS usd_value,
  count(*) AS transaction_count, min(date) AS first_date, max(date) AS last_date
  FROM rated WHERE action IN ('DIVIDEND', 'INTEREST') AND date <= {D} GROUP BY account, asset, action, rated.currency""", "rated")
q("income", "SELECT * FROM earned", "earned")
q("income_since", f"""SELECT account, asset, action, coalesce(currency, 'USD') AS currency, sum(quantity) AS total_quantity, sum(usd) AS usd_value,
  count(*) AS transaction_count, min(date) AS first_date, max(date) AS last_date
  FROM rated WHERE action IN ('DIVIDEND', 'INTEREST') AND date BETWEEN DATE '1998-01-01' AND {D} AND asset = 'USD'
  GROUP BY account, asset, action, rated.currency""", "rated")
q("income_totals", """SELECT account, sum(usd_value) AS total_income_usd, coalesce(sum(usd_value) FILTER (action = 'DIVIDEND'), 0) AS total_dividends_usd,
  coalesce(sum(usd_value) FILTER (action = 'INTEREST'), 0) AS total_interest_usd FROM earned GROUP BY account""", "earned")

# --- returns ---------------------------------------------------------------------------------------------------

q("unpriced_days", "SELECT account, date, count(*) AS unpriced FROM inst_days WHERE missing GROUP BY ALL", "inst_days")
q("guarded_returns", f"""SELECT {swap(8, 'portfolio_daily_return', 'investment_return')} FROM daily WHERE NOT EXISTS
  (FROM inst_days i WHERE missing AND i.account = daily.account AND i.date <= daily.date)""", "daily", "inst_days")
q("daily_returns", f"SELECT {swap(8, 'portfolio_daily_return', 'investment_return')} FROM daily", "daily")
q("performance_report", f"SELECT {swap(6, *PERF_COLUMNS)} FROM report_all", "report_all")
q("performance_since", f"SELECT {swap(6, *PERF_COLUMNS)} FROM report_since", "report_since")
lib("periods", f"""SELECT account, unnest([
  {{'p': '1M', 'f': CAST({D} - INTERVAL 1 MONTH AS DATE)}}, {{'p': '3M', 'f': CAST({D} - INTERVAL 3 MONTH AS DATE)}},
  {{'p': '6M', 'f': CAST({D} - INTERVAL 6 MONTH AS DATE)}}, {{'p': 'YTD', 'f': CAST(date_trunc('year', {D}) AS DATE)}},
  {{'p': '1Y', 'f': CAST({D} - INTERVAL 1 YEAR AS DATE)}}, {{'p': 'SII', 'f': min(date) FILTER (portfolio_value > 0)}}]) AS w
  FROM daily GROUP BY account""", "daily")
q("period_returns", """SELECT account, w.p AS period, coalesce(w.f, max(date)) AS from_date,
  round(coalesce((exp(sum(ln(greatest(1 + investment_return / 100, 1e-12)))) - 1) * 100, 0), 6) AS return_pct
  FROM periods LEFT JOIN daily USING (account) WHERE date >= w.f AND portfolio_value > 0 GROUP BY account, w""", "periods", "daily")


def _rolling(months: int) -> str:
    return f"""SELECT e.account, e.me AS date, {months} AS window_months, coalesce((exp(sum(ln(greatest(1 + investment_return / 100, 1e-12)))
        FILTER (portfolio_value > 0)) - 1) * 100, 0) AS return_pct
      FROM (SELECT account, max(date) AS me FROM daily GROUP BY account, date_trunc('month', date)) e
      JOIN daily r ON r.account = e.account AND r.date > e.me - INTERVAL {months} MONTH AND r.date <= e.me
      JOIN (SELECT account, min(date) AS first_day FROM daily WHERE portfolio_value > 0 GROUP BY account) f
        ON f.account = e.account AND f.first_day <= e.me - INTERVAL {months} MONTH
      GROUP BY e.account, e.me"""


lib("roll12", _rolling(12), "daily")
lib("roll24", _rolling(24), "daily")
q("rolling_returns", "SELECT account, date, round(return_pct, 6) AS return_pct FROM roll12", "roll12")
q("monthly_performance", """SELECT account, date AS month_end, CAST(CAST(twr * 100 AS FLOAT) AS DOUBLE) AS time_weighted_return_pct,
  CAST(CAST(CASE WHEN days > 0 THEN (pow(1 + twr, 365.25 / days) - 1) * 100 ELSE 0 END AS FLOAT) AS DOUBLE) AS cagr,
  CAST(CAST(CASE WHEN sd > 0 THEN (pow(1 + twr, 365.25 / greatest(days, 1)) - 1 - 0.02) / (sd * sqrt(252) / 100) ELSE 0 END AS FLOAT) AS DOUBLE) AS sharpe_ratio,
  round(mdd, 6) AS max_drawdown
  FROM (SELECT d.account, d.date, exp(sum(lg) OVER w) - 1 AS twr, date_diff('day', min(d.date) OVER w, d.date) AS days,
      stddev_pop(investment_return) OVER w AS sd, max(dd) OVER w AS mdd,
      d.date = max(d.date) OVER (PARTITION BY d.account, date_trunc('month', d.date)) AS is_end
    FROM dr_all d JOIN dd_all x ON x.account = d.account AND x.date = d.date WINDOW w AS (PARTITION BY d.account ORDER BY d.date))
  WHERE is_end""", "dr_all", "dd_all")
q("cash_drag", f"""SELECT account, portfolio_value_usd AS total_portfolio_value, total_cash_usd,
  round(CASE WHEN portfolio_value_usd > 0 THEN total_cash_usd / portfolio_value_usd * 100 ELSE 0 END, 4) AS cash_pct,
  round(coalesce(cagr, 0), 4) AS portfolio_cagr, round(coalesce(spy_cagr_pct, 0), 4) AS benchmark_cagr, 0.0::DOUBLE AS assumed_cash_return_rate,
  round(total_cash_usd * coalesce(cagr, 0) / 100, 4) AS drag_vs_portfolio_cagr, round(total_cash_usd * coalesce(spy_cagr_pct, 0) / 100, 4) AS drag_vs_benchmark,
  round(CASE WHEN portfolio_value_usd > 0 THEN total_cash_usd * coalesce(cagr, 0) / portfolio_value_usd ELSE 0 END, 4) AS drag_vs_portfolio_pct,
  round(CASE WHEN portfolio_value_usd > 0 THEN total_cash_usd * coalesce(spy_cagr_pct, 0) / portfolio_value_usd ELSE 0 END, 4) AS drag_vs_benchmark_pct,
  coalesce(start_date, {D}) AS period_start_date, coalesce(end_date, {D}) AS period_end_date
  FROM summ LEFT JOIN report_all USING (account)""", "summ", "report_all")
# On an account's first day no lot is a day old; its flows, value and gains are those of that day's rows alone.
lib("first_days", "SELECT account, min(date) AS d0, arg_min(portfolio_value, date) AS initial_value FROM daily GROUP BY account", "daily")
lib("first_fifo", f"""SELECT account, sum(gain) AS realized, sum(market) - sum(cost) AS unrealized, round(sum(market), 2) - round(sum(cost), 2) AS unreal2,
    round(sum(gain), 2) AS real2 FROM (
  SELECT h.account, 0 AS gain, usd / units * (b - greatest(b - units, tu)) AS cost,
    (b - greatest(b - units, tu)) * p.price * CASE WHEN {pair_of('h.asset_type')} = 'USD' THEN 1 ELSE f.price END AS market
  FROM (SELECT h.*, d0, max(used) OVER (PARTITION BY h.account, h.asset) AS tu FROM held h JOIN first_days USING (account) WHERE date = d0) h
  ASOF LEFT JOIN prices p ON p.ticker = h.asset AND p.date <= h.date
  ASOF LEFT JOIN prices f ON f.ticker = {pair_of('h.asset_type')} AND f.date <= h.date
  WHERE action = 'BUY' AND b > tu
  UNION ALL SELECT account, realized_gain, 0, 0 FROM gains JOIN first_days USING (account) WHERE sell_date = d0) GROUP BY account""",
  "held", "first_days", "prices", "gains")
lib("first_flows", """SELECT account, coalesce(sum(usd) FILTER (action = 'DEPOSIT'), 0) AS deposits0, coalesce(sum(usd) FILTER (action = 'WITHDRAW'), 0) AS withdrawals0,
  coalesce(sum(usd) FILTER (action IN ('DIVIDEND', 'INTEREST')), 0) AS income0,
  coalesce(sum(usd) FILTER (action = 'FEE'), 0) + coalesce(sum(fee_usd) FILTER (fees > 0), 0) AS fees0,
  coalesce(sum(usd) FILTER (action = 'TAX'), 0) AS taxes0 FROM rated JOIN first_days USING (account) WHERE date = d0 GROUP BY account""", "rated", "first_days")
q("decomposition", f"""SELECT account, {D} AS as_of_date, g AS total_growth_usd,
  round(CASE WHEN initial_value > 0 THEN g / initial_value * 100 ELSE 0 END, 2) AS total_growth_pct, nd AS from_contributions_usd,
  round(nd / nullif(g, 0) * 100, 2) AS from_contributions_pct, round(tg, 2) AS from_returns_usd, round(tg / nullif(g, 0) * 100, 2) AS from_returns_pct,
  initial_value, portfolio_value AS current_value, nd AS net_deposits, round(tg, 2) AS total_gain, income - income0 AS total_income,
  fees - fees0 + (taxes - taxes0) AS total_fees_and_taxes
  FROM (SELECT *, portfolio_value - initial_value AS g, deposits - deposits0 - (withdrawals - withdrawals0) AS nd,
      realized_gain - coalesce(real2, 0) + (unrealized_gain - coalesce(unreal2, 0)) AS tg
    FROM stat JOIN first_days USING (account) JOIN first_flows USING (account) LEFT JOIN first_fifo USING (account))""",
  "stat", "first_days", "first_flows", "first_fifo")
lib("irr_flows", f"""SELECT account AS k, date, CASE action WHEN 'DEPOSIT' THEN -usd ELSE usd END AS amount FROM rated
  WHERE action IN ('DEPOSIT', 'WITHDRAW') AND date <= {D} AND usd IS NOT NULL
  UNION ALL SELECT account, {D}, portfolio_value FROM worth WHERE portfolio_value > 0""", "rated", "worth")
lib("asset_flows", f"""SELECT asset AS k, date, CASE action WHEN 'BUY' THEN -quantity ELSE quantity END * price AS amount FROM led
  WHERE action IN ('BUY', 'SELL') AND date <= {D}
  UNION ALL SELECT asset, {D}, sum(net_quantity) * any_value(l.price) FROM pos JOIN latest l ON l.ticker = asset GROUP BY asset""", "led", "pos", "latest")


def _irr(flows: str, name: str) -> None:
    lib(f"{name}_t", f"SELECT k, (date - min(date) OVER (PARTITION BY k)) / 365.0 AS t, amount FROM {flows}", flows)
    # Plain bisection over a wide bracket; any method finds the same root.
    lib(f"{name}_b", f"""SELECT k, -0.99::DOUBLE AS lo, 10.0::DOUBLE AS hi, 0 AS i FROM (SELECT DISTINCT k FROM {name}_t)
      UNION ALL SELECT s.k, CASE WHEN s.f > 0 THEN s.mid ELSE s.lo END, CASE WHEN s.f > 0 THEN s.hi ELSE s.mid END, s.i + 1 FROM (
        SELECT b.k, any_value(lo) AS lo, any_value(hi) AS hi, any_value(i) AS i, any_value((lo + hi) / 2) AS mid,
          sum(amount / pow(1 + (lo + hi) / 2, t)) AS f FROM {name}_b b JOIN {name}_t USING (k) WHERE i < 60 GROUP BY b.k) s""", f"{name}_t")


_irr("irr_flows", "mwr")
_irr("asset_flows", "airr")
q("money_weighted_return", "SELECT k AS account, round((lo + hi) / 2, 6) AS mwr FROM mwr_b WHERE i = 60", "mwr_b")
q("asset_irr", "SELECT k AS asset, round((lo + hi) / 2, 6) AS irr FROM airr_b WHERE i = 60", "airr_b")
q("widget", f"""SELECT account, {D} AS as_of_date, {D} AS last_refresh, portfolio_value AS value, today_amount, today_pct,
  total_gain AS total_amount, round(total_gain_pct, 8) AS total_pct, points, series_sum, series_from
  FROM stat JOIN (SELECT account, coalesce(max(portfolio_value) FILTER (date = {D}) - max(portfolio_value) FILTER (date = {D} - 1), 0) AS today_amount,
    round(max(investment_return) FILTER (date = {D}), 8) AS today_pct, CAST(count(*) FILTER (date > {D} - 30) AS INTEGER) AS points,
    sum(portfolio_value) FILTER (date > {D} - 30) AS series_sum, min(date) FILTER (date > {D} - 30) AS series_from
    FROM daily GROUP BY account) USING (account)""", "stat", "daily")

# --- exposure --------------------------------------------------------------------------------------------------

q("currency_exposure", f"""SELECT account, {D} AS as_of_date, portfolio_value, currency, usd_value,
  round(CASE WHEN portfolio_value > 0 THEN usd_value / portfolio_value * 100 ELSE 0 END, 8) AS pct, holdings_usd, cash_usd
  FROM (SELECT *, sum(usd_value) OVER (PARTITION BY account) AS portfolio_value FROM (
    SELECT account, currency, coalesce(h, 0) AS holdings_usd, coalesce(c, 0) AS cash_usd, coalesce(h, 0) + coalesce(c, 0) AS usd_value
    FROM (SELECT account, {shown(pair_of('asset_type'))} AS currency, sum(value_usd) AS h FROM alloc WHERE asset_type NOT LIKE 'cash%' GROUP BY ALL)
    FULL JOIN (SELECT account, currency, sum(usd_value) AS c FROM cash_now WHERE usd_value <> 0 GROUP BY ALL) USING (account, currency)))
  WHERE usd_value <> 0""", "alloc", "cash_now")
q("concentration", "SELECT account, round(sum(pow(allocation_pct / 100, 2)) * 10000, 6) AS hhi, count(*) AS total_holdings FROM alloc GROUP BY account", "alloc")
q("top_holdings", """SELECT account, CAST(rank AS INTEGER) AS rank, asset, asset_type, round(allocation_pct, 8) AS allocation_pct FROM (SELECT *,
  row_number() OVER (PARTITION BY account ORDER BY allocation_pct DESC, asset, asset_type) AS rank FROM alloc) WHERE rank <= 5""", "alloc")
q("largest_holdings", """SELECT account, asset, value_usd, round(allocation_pct, 8) AS allocation_pct FROM alloc
  ORDER BY value_usd DESC, account, asset, asset_type LIMIT 20""", "alloc")
q("kind_exposure", "SELECT account, asset_kind, round(sum(allocation_pct), 6) AS allocation_pct FROM alloc WHERE allocation_pct > 0 GROUP BY ALL", "alloc")
q("holdings_table", """SELECT account, asset, asset_kind, net_quantity, value_usd, round(allocation_pct, 8) AS allocation_pct,
  CAST(row_number() OVER (PARTITION BY account ORDER BY value_usd DESC, asset) AS INTEGER) AS position
  FROM alloc WHERE abs(allocation_pct) >= 0.05 AND asset_kind NOT IN ('cash', 'fx')""", "alloc")
_FWROWS = ", ".join(f"('{t}', '{s}', {w}::DOUBLE)" for t, ws in vocab.FUND_SECTOR_WEIGHTS.items() for s, w in ws.items())
lib("all_weights", f"""SELECT ticker, sector, weight FROM weights UNION ALL
  SELECT * FROM (VALUES {_FWROWS}) v(ticker, sector, weight) WHERE ticker NOT IN (SELECT ticker FROM weights)
    AND ticker NOT IN (SELECT ticker FROM meta WHERE sector IS NOT NULL)""", "weights", "meta")
lib("scaled", "SELECT ticker, sector, weight / CASE WHEN max(weight) OVER (PARTITION BY ticker) > 1 THEN 100 ELSE 1 END AS share FROM all_weights", "all_weights")
lib("eq", f"SELECT * FROM alloc WHERE asset_kind NOT IN {_in(vocab.NON_EQUITY_KINDS)} AND value_usd > 0", "alloc")
lib("slices", f"""SELECT account, sector, sum(v) AS v FROM (
    SELECT a.account, s.sector, a.value_usd * s.share AS v FROM eq a JOIN scaled s ON s.ticker = a.asset
    UNION ALL SELECT a.account, 'Other', a.value_usd * (1 - t.total) FROM eq a JOIN (SELECT ticker, sum(share) AS total FROM scaled GROUP BY ticker) t
      ON t.ticker = a.asset WHERE a.value_usd * (1 - t.total) > 0.005
    UNION ALL SELECT a.account, coalesce(m.sector, {FALLBACK}, 'Other'), a.value_usd FROM eq a LEFT JOIN meta m ON m.ticker = a.asset
      WHERE a.asset NOT IN (SELECT ticker FROM scaled))
  WHERE sector NOT IN {_in(vocab.NON_EQUITY_SECTORS)} AND v > 0 GROUP BY account, sector""", "eq", "scaled", "meta")
q("sector_exposure", """SELECT account, CASE WHEN small OR rk > 8 THEN 'Other' ELSE sector END AS sector, round(sum(v), 2) AS value_usd,
  round(sum(v) / any_value(total) * 100, 4) AS pct
  FROM (SELECT *, row_number() OVER (PARTITION BY account, small ORDER BY v DESC, sector) AS rk FROM (
    SELECT *, sector = 'Other' OR v / total * 100 < 3 AS small FROM (SELECT *, sum(v) OVER (PARTITION BY account) AS total FROM slices)))
  GROUP BY account, CASE WHEN small OR rk > 8 THEN 'Other' ELSE sector END""", "slices")
_TG = ", ".join(f"('{a}', {p}::DOUBLE)" for a, p in TARGETS.items())
q("rebalance", f"""SELECT *, CAST(row_number() OVER (PARTITION BY account ORDER BY abs(drift_pct) DESC, asset) AS INTEGER) AS drift_rank FROM (SELECT account, asset, round(cp, 2) AS current_pct, tp AS target_pct, round(cp - tp, 2) AS drift_pct, round(cv, 2) AS current_value_usd,
  round(tp / 100 * total, 2) AS target_value_usd, round(tp / 100 * total - cv, 2) AS suggested_delta_usd,
  CASE WHEN abs(cp - tp) < 0.01 THEN 'HOLD' WHEN tp / 100 * total - cv > 0 THEN 'BUY' ELSE 'SELL' END AS action
  FROM (SELECT account, asset, coalesce(t.pct, 0) AS tp, coalesce(c.pct, 0) AS cp, coalesce(c.val, 0) AS cv
    FROM (SELECT w.account, v.asset, v.pct FROM worth w, (VALUES {_TG}) v(asset, pct)) t
    FULL JOIN (SELECT account, asset, sum(allocation_pct) AS pct, sum(value_usd) AS val FROM alloc GROUP BY ALL) c USING (account, asset))
  JOIN (SELECT account, sum(value_usd) AS total FROM alloc GROUP BY account) USING (account))""", "alloc", "worth")
q("day_change", f"""SELECT a.account, a.asset, a.asset_type, a.value_usd, p.last AS last_price,
  round(CASE WHEN p.prev > 0 THEN a.value_usd - a.value_usd / (p.last / p.prev) END, 6) AS day_gain_usd
  FROM alloc a LEFT JOIN (SELECT ticker, arg_max(price, date) AS last, list(price ORDER BY date DESC)[2] AS prev FROM prices WHERE date <= {D} GROUP BY ticker) p
  ON p.ticker = a.asset WHERE a.net_quantity > 0""", "alloc", "prices")
lib("held_long", f"""SELECT account, asset FROM led WHERE NOT is_cash AND date <= {D} GROUP BY ALL HAVING sum({SUBTRACTED}) > 0""", "led")
lib("ret12", f"""SELECT ticker, date, (price - before) / before AS ret FROM (SELECT *, lag(price) OVER (PARTITION BY ticker ORDER BY date) AS before
  FROM prices WHERE date > {D} - INTERVAL 12 MONTH AND date <= {D} AND price > 0) WHERE before > 0""", "prices")
lib("corr12", """SELECT a.ticker AS x, b.ticker AS y, CASE WHEN count(*) >= 5 THEN corr(a.ret, b.ret) END AS r
  FROM ret12 a JOIN ret12 b USING (date) GROUP BY ALL""", "ret12")
q("correlation_matrix", """SELECT a.account, a.asset AS asset_a, b.asset AS asset_b, round(CASE WHEN isnan(r) THEN NULL ELSE r END, 6) AS correlation
  FROM held_long a JOIN held_long b USING (account) JOIN corr12 ON x = a.asset AND y = b.asset""", "held_long", "corr12")
lib("ret252", f"""SELECT ticker, date, price / before - 1 AS ret FROM (SELECT *, lag(price) OVER (PARTITION BY ticker ORDER BY date) AS before
  FROM prices WHERE date BETWEEN {D} - 252 AND {D}) WHERE before <> 0""", "prices")
lib("corr252", """SELECT a.ticker AS x, b.ticker AS y, corr(a.ret, b.ret) AS r FROM ret252 a JOIN ret252 b USING (date) WHERE a.ticker < b.ticker
  GROUP BY ALL HAVING count(*) >= 2 AND NOT isnan(corr(a.ret, b.ret))""", "ret252")
lib("wgt", "SELECT account, asset, allocation_pct / 100 AS w FROM alloc WHERE allocation_pct > 0", "alloc")
q("diversification", f"""SELECT account, {D} AS as_of_date, round(h * 10000, 6) AS hhi, n AS total_holdings, round(1 / h, 6) AS effective_holdings,
  round(a, 6) AS avg_pairwise_correlation, round(mx, 6) AS max_pairwise_correlation, round(mn, 6) AS min_pairwise_correlation,
  round((h + 2 * coalesce(adj, 0)) * 10000, 6) AS correlation_weighted_hhi
  FROM (SELECT account, sum(w * w) AS h, count(*) AS n FROM wgt GROUP BY account) LEFT JOIN (
    SELECT p.account, avg(r) FILTER (abs(r) >= 0.05) AS a, max(r) FILTER (abs(r) >= 0.05) AS mx, min(r) FILTER (abs(r) >= 0.05) AS mn, sum(p.w * o.w * r) AS adj
    FROM wgt p JOIN wgt o USING (account) JOIN corr252 ON x = p.asset AND y = o.asset
    WHERE NOT {cash_like('p.asset', bucket('p.asset'))} AND NOT {cash_like('o.asset', bucket('o.asset'))} GROUP BY p.account) USING (account)""", "wgt", "corr252")

# --- scenarios -------------------------------------------------------------------------------------------------


def _rows(scenarios: list[dict], fields: dict[str, tuple[str, str]]) -> str:
    def lit(v, kind):
        return f"CAST({'NULL' if v is None else repr(v)} AS {kind})"

    rows = ", ".join("(" + ", ".join(lit(s.get(key), kind) for key, kind in fields.values()) + ")" for s in scenarios)
    return f"(VALUES {rows}) s({', '.join(fields)})"


_NAME, _INFL = ("scenario", "VARCHAR"), ("inflation_rate", "DOUBLE")
_SAVE = _rows(
    SAVING,
    {"scenario": _NAME, "c": ("monthly_contribution", "DOUBLE"), "rr": ("annual_return_rate", "DOUBLE"),
     "target": ("target_value", "DOUBLE"), "yrs": ("projection_years", "INTEGER"), "infl": _INFL},
)
_SPEND = _rows(
    SPENDING,
    {"scenario": _NAME, "aw": ("annual_withdrawal", "DOUBLE"), "wr": ("withdrawal_rate", "DOUBLE"),
     "yrs": ("time_horizon_years", "INTEGER"), "er": ("expected_return", "DOUBLE"), "infl": _INFL},
)
lib("vals", f"""SELECT d.account, d.portfolio_value AS v, r.cagr FROM daily d LEFT JOIN report_all r USING (account) WHERE d.date = {D}""", "daily", "report_all")


def _fv(v: str, m: str, c: str, n: str) -> str:
    return f"(CASE WHEN abs({m}) <= 1e-14 THEN {v} + {c} * {n} ELSE {v} * pow(1 + {m}, {n}) + {c} * (pow(1 + {m}, {n}) - 1) / {m} END)"


_M = "(pow(1 + rate, 1 / 12.0) - 1)"
lib("plans", f"""SELECT *, {_M} AS m FROM (SELECT account, v, s.*, coalesce(rr, cagr / 100, 0) AS rate FROM vals, {_SAVE} WHERE v > 0)""", "vals")
lib("reach", f"""SELECT account, scenario, min(i) AS months FROM plans, range(1, 1201) g(i)
  WHERE target > v AND {_fv('v', 'm', 'c', 'i')} >= target * pow(1 + infl, i / 12.0) GROUP BY ALL""", "plans")
lib("need", f"""SELECT account, scenario, -0.2::DOUBLE AS lo, 2.0::DOUBLE AS hi, 0 AS i FROM plans
  UNION ALL SELECT account, scenario, CASE WHEN f < goal THEN mid ELSE lo END, CASE WHEN f < goal THEN hi ELSE mid END, i + 1 FROM (
    SELECT p.account, p.scenario, lo, hi, i, (lo + hi) / 2 AS mid, target * pow(1 + infl, yrs) AS goal,
      {_fv('v', '(pow(1 + (lo + hi) / 2, 1 / 12.0) - 1)', 'c', '(yrs * 12)')} AS f
    FROM need n JOIN plans p ON p.account = n.account AND p.scenario = n.scenario WHERE i < 45)""", "plans")
q("projection", f"""SELECT account, scenario, v AS current_value, round(rate, 4) AS annual_return_rate, c AS monthly_contribution, infl AS inflation_rate,
  target AS target_value, round(CASE WHEN v >= target THEN 0 ELSE months / 12.0 END, 4) AS years_to_goal,
  CAST(CAST(CASE WHEN v >= target THEN v ELSE {_fv('v', 'm', 'c', 'months')} END AS FLOAT) AS DOUBLE) AS projected_goal_value,
  CASE WHEN target IS NULL THEN yrs END AS projection_years,
  CAST(CAST(CASE WHEN target IS NULL THEN {_fv('v', 'm', 'c', '(yrs * 12)')} END AS FLOAT) AS DOUBLE) AS projected_value_nominal,
  CAST(CAST(CASE WHEN target IS NULL THEN {_fv('v', 'm', 'c', '(yrs * 12)')} / pow(1 + infl, yrs) END AS FLOAT) AS DOUBLE) AS projected_value_real,
  CASE WHEN target IS NULL THEN c * yrs * 12 END AS total_contributions,
  CAST(CAST(CASE WHEN target IS NULL THEN {_fv('v', 'm', 'c', '(yrs * 12)')} - v - c * yrs * 12 END AS FLOAT) AS DOUBLE) AS return_portion,
  round(CASE WHEN months IS NOT NULL AND {_fv('v', '(pow(3.0, 1 / 12.0) - 1)', 'c', '(yrs * 12)')} >= target * pow(1 + infl, yrs) THEN (lo + hi) / 2 END, 4) AS required_return_rate
  FROM plans LEFT JOIN reach USING (account, scenario) LEFT JOIN (SELECT * FROM need WHERE i = 45) USING (account, scenario)""", "plans", "reach", "need")
_M7 = "(pow(1.07, 1 / 12.0) - 1)"
q("projection_path", f"""SELECT account, CAST(i AS INTEGER) AS month, round({_fv('v', _M7, '750.0', 'i')}, 2) AS value, round(750.0 * i, 2) AS contribution_sum,
  round({_fv('v', _M7, '750.0', 'i')} - v - 750.0 * i, 2) AS gain FROM vals, range(0, 25) g(i)""", "vals")
_M2 = "(pow(0.98, 1 / 12.0) - 1)"
q("accumulation", f"""SELECT account, 37 AS points, round(sum(round({_fv('v', _M2, '100.0', 'i')}, 2)), 2) AS values_sum, round(any_value({_fv('v', _M2, '100.0', '36')}), 2) AS projected_value,
  3600.0::DOUBLE AS total_contributions, round(any_value({_fv('v', _M2, '100.0', '36')} - v - 3600), 2) AS gain_from_returns FROM vals, range(0, 37) g(i) GROUP BY account""", "vals")
_M6, _MN3 = "(pow(1.06, 1 / 12.0) - 1)", "(pow(0.97, 1 / 12.0) - 1)"


def _goal(m: str, c: str, mult: str, cap: int, infl: str, bound: str) -> str:
    fv = _fv("v", m, c, "i")
    return f"""SELECT account, round(v * {mult}, 2) AS target, months IS NOT NULL AS feasible, CAST(months AS INTEGER) AS months_needed,
      round({_fv('v', m, c, f'coalesce(months, {cap})')}, 2) AS projected_value, {bound} AS max_achievable
    FROM (SELECT account, v, CASE WHEN v * {mult} <= v THEN 0 ELSE (SELECT min(i) FROM range(1, {cap + 1}) g(i) WHERE {fv} >= v * {mult} * pow(1 + {infl}, i / 12.0)) END AS months FROM vals)"""


q("goal_months", _goal(_M6, "2000.0", "1.5", 600, "0.01", "CAST(NULL AS DOUBLE)"), "vals")
q("goal_bound", _goal(_MN3, "30000.0", "1.25", 240, "0", f"round(greatest(v, 30000.0 / abs({_MN3})), 2)"), "vals")
lib("spend", f"""SELECT *, row_number() OVER () AS rid FROM (SELECT account, v, s.*, coalesce(er, cagr / 100, 0) AS rate, infl / 100 AS i2,
  coalesce(aw, v * wr / 100, v * 0.04) AS w0 FROM vals, {_SPEND} WHERE v > 0)""", "vals")
lib("years", """SELECT account, scenario, 0 AS t, v, v AS prev, CAST(NULL AS DOUBLE) AS dep, 0.0::DOUBLE AS drawn FROM spend
  UNION ALL SELECT account, scenario, t + 1, nv, v, CASE WHEN dep IS NULL AND nv <= 0 THEN t + part ELSE dep END,
    drawn + CASE WHEN dep IS NOT NULL THEN 0 WHEN nv <= 0 THEN take * part ELSE take END
  FROM (SELECT *, CASE WHEN nv = 0 OR v <= 0 THEN 1 ELSE least(1, v / (v - nv)) END AS part FROM (
    SELECT y.account, y.scenario, t, y.v, dep, drawn, w0 * pow(1 + i2, t) AS take, y.v * (1 + rate) - w0 * pow(1 + i2, t) AS nv
    FROM years y JOIN spend s ON s.account = y.account AND s.scenario = y.scenario WHERE t < yrs))""", "spend")
q("withdrawal", f"""SELECT account, scenario, CAST(CAST(s.v AS FLOAT) AS DOUBLE) AS portfolio_value, CAST(CAST(w0 AS FLOAT) AS DOUBLE) AS annual_withdrawal, CAST(CAST(w0 / s.v * 100 AS FLOAT) AS DOUBLE) AS withdrawal_rate_pct,
  yrs AS time_horizon_years, CAST(CAST(rate AS FLOAT) AS DOUBLE) AS expected_return, CAST(CAST(infl AS FLOAT) AS DOUBLE) AS inflation_rate, CAST(CAST(dep AS FLOAT) AS DOUBLE) AS years_until_depletion, CAST(CAST(y.v AS FLOAT) AS DOUBLE) AS terminal_value,
  CAST(CAST(ok AS FLOAT) AS DOUBLE) AS success_likelihood, CAST(CAST(safe AS FLOAT) AS DOUBLE) AS max_safe_withdrawal, CAST(CAST(safe / s.v * 100 AS FLOAT) AS DOUBLE) AS max_safe_withdrawal_rate, CAST(CAST(drawn AS FLOAT) AS DOUBLE) AS total_withdrawn,
  CAST(CAST(CASE WHEN dep < yrs THEN 0 ELSE y.v END - s.v + drawn AS FLOAT) AS DOUBLE) AS return_generated, CAST(CAST(100 - ok AS FLOAT) AS DOUBLE) AS shortfall_risk
  FROM spend s JOIN (SELECT *, CASE WHEN y.v >= 0 THEN 100 WHEN dep > 0 THEN greatest(0, least(100, 100 * dep / t)) ELSE 0 END AS ok FROM years y) y
    USING (account, scenario)
  JOIN (SELECT account, scenario, any_value(v * pow(1 + rate, yrs)) / sum(pow(1 + i2, i - 1) * pow(1 + rate, yrs - i)) AS safe
    FROM spend, range(1, 101) g(i) WHERE i <= yrs GROUP BY ALL) USING (account, scenario) WHERE y.t = yrs""", "spend", "years")

# --- ledger changes --------------------------------------------------------------------------------------------

lib("wanted", f"SELECT * FROM (SELECT *, {bucket('asset')} AS t FROM cash_orders) WHERE action = 'WITHDRAW' AND {norm_of('asset', 't')} <> 'EURUSD=X'", "cash_orders")
q("exchange_legs", """SELECT account, id + o AS id, date, CASE o WHEN 0 THEN asset ELSE 'EUR' END AS asset, CASE o WHEN 0 THEN 'EXCHANGE_FROM' ELSE 'EXCHANGE_TO' END AS action,
  CASE o WHEN 0 THEN -(total / 8.0) ELSE total / 8.0 * 0.5 END::DOUBLE AS quantity, CAST(NULL AS DOUBLE) AS price, '' AS currency, CAST(NULL AS DOUBLE) AS fees,
  CAST(NULL AS VARCHAR) AS fee_currency, '' AS exchange, account || '-' || CAST(id AS VARCHAR) AS exchange_group_id FROM wanted, range(0, 2) g(o)""", "wanted")
lib("gone", "SELECT account, exchange_group_id AS grp FROM txn WHERE action = 'EXCHANGE_FROM' AND year(date) = 2000", "txn")
q("changed_ledger", """SELECT account, action, count(*) AS rows, sum(quantity) AS quantity, max(date) AS last_date FROM (
  SELECT account, action, CASE WHEN action = 'DIVIDEND' AND year(date) = 1999 THEN quantity * 2 ELSE quantity END AS quantity,
    CASE WHEN action = 'DIVIDEND' AND year(date) = 1999 THEN date - 3 ELSE date END AS date
  FROM txn t WHERE exchange_group_id IS NULL OR NOT EXISTS (SELECT 1 FROM gone g WHERE g.account = t.account AND g.grp = t.exchange_group_id)
  UNION ALL SELECT account, 'SPLIT', 3.0, max(date) FROM txn GROUP BY account) GROUP BY account, action""", "txn", "gone")
q("recalc_from", """SELECT account, min(d) AS recalc_from FROM (SELECT account, date - 3 AS d FROM txn WHERE action = 'DIVIDEND' AND year(date) = 1999
  UNION ALL SELECT account, date FROM txn WHERE action = 'EXCHANGE_FROM' AND year(date) = 2000 UNION ALL SELECT account, max(date) FROM txn GROUP BY account) GROUP BY account""", "txn")

# --- bars ------------------------------------------------------------------------------------------------------

lib("nb", f"""SELECT *, row_number() OVER w AS n, lag(close) OVER w AS before, count(*) OVER (PARTITION BY ticker) AS total FROM bars WHERE date <= {D}
  WINDOW w AS (PARTITION BY ticker ORDER BY date)""", "bars")
lib("rets", "SELECT ticker, date, close / before - 1 AS ret FROM nb WHERE before > 0", "nb")
q("ticker_returns", "SELECT ticker, date, round(ret, 10) AS ret FROM rets", "rets")
lib("chg", "SELECT ticker, date, n - 1 AS k, total - 1 AS last_k, greatest(close - before, 0) AS g, greatest(before - close, 0) AS l FROM nb WHERE before IS NOT NULL", "nb")
lib("wilder", """SELECT ticker, 14 AS k, avg(g) AS g, avg(l) AS l FROM chg WHERE k <= 14 GROUP BY ticker HAVING count(*) = 14
  UNION ALL SELECT c.ticker, c.k, w.g + (c.g - w.g) / 14, w.l + (c.l - w.l) / 14 FROM wilder w JOIN chg c ON c.ticker = w.ticker AND c.k = w.k + 1""", "chg")
lib("rsi_all", "SELECT w.ticker, c.date, c.k = c.last_k AS is_last, CASE WHEN abs(w.l) < 1e-10 THEN 100 ELSE 100 - 100 / (1 + w.g / w.l) END AS rsi FROM wilder w JOIN chg c USING (ticker, k)",
    "wilder", "chg")
q("rsi", """SELECT ticker, round(rsi, 8) AS rsi, CASE WHEN rsi >= 70 THEN 'Overbought' WHEN rsi <= 30 THEN 'Oversold' WHEN rsi >= 55 THEN 'Bullish'
  WHEN rsi <= 45 THEN 'Bearish' WHEN rsi IS NOT NULL THEN 'Neutral' END AS rsi_signal FROM (SELECT DISTINCT ticker FROM nb) LEFT JOIN
  (SELECT ticker, rsi FROM rsi_all WHERE is_last) USING (ticker)""", "nb", "rsi_all")
q("rsi_series", "SELECT ticker, date, round(rsi, 6) AS rsi FROM rsi_all", "rsi_all")
lib("mas", """SELECT ticker, arg_max(close, n) AS c, max(total) AS total, avg(close) FILTER (n > total - 50) AS a50, avg(close) FILTER (n > total - 200) AS a200
  FROM nb GROUP BY ticker""", "nb")
lib("ma", """SELECT ticker, c, CASE WHEN total >= 50 THEN a50 END AS ma50, CASE WHEN total >= 200 THEN a200 END AS ma200 FROM mas""", "mas")
q("moving_averages", """SELECT ticker, ma50, ma200, round((c - ma50) / ma50 * 100, 8) AS price_vs_ma50,
  round((c - ma200) / ma200 * 100, 8) AS price_vs_ma200, round((ma50 - ma200) / ma200 * 100, 8) AS ma50_vs_ma200,
  CASE WHEN ma200 IS NULL THEN 'Insufficient data' WHEN ma50 > ma200 THEN 'Golden Cross (Bullish)' ELSE 'Death Cross (Bearish)' END AS ma_trend FROM ma""", "ma")
lib("emas", """SELECT ticker, n, total, close AS f, close AS s, 0.0::DOUBLE AS sig FROM nb WHERE n = 1
  UNION ALL SELECT ticker, n, total, f, s, sig + 0.2 * (f - s - sig) FROM (SELECT b.ticker, b.n, b.total, e.f + 2 / 13.0::DOUBLE * (b.close - e.f) AS f,
    e.s + 2 / 27.0::DOUBLE * (b.close - e.s) AS s, e.sig FROM emas e JOIN nb b ON b.ticker = e.ticker AND b.n = e.n + 1)""", "nb")
q("macd", """SELECT ticker, round(m, 8) AS macd, round(sig, 8) AS macd_signal, round(m - sig, 8) AS macd_histogram, CASE WHEN m IS NULL THEN 'Insufficient data'
  WHEN m > sig AND m > 0 THEN 'Strong Bullish' WHEN m > sig AND m < 0 THEN 'Bullish Reversal' WHEN m < sig AND m > 0 THEN 'Bearish Reversal' ELSE 'Strong Bearish' END AS macd_trend
  FROM (SELECT ticker, CASE WHEN total >= 35 THEN f - s END AS m, CASE WHEN total >= 35 THEN sig END AS sig FROM emas WHERE n = total)""", "emas")


def _wr(p: int) -> str:
    return f"""CASE WHEN total >= {p} AND max(high) FILTER (n > total - {p}) - min(low) FILTER (n > total - {p}) >= 1e-10 THEN
      (max(high) FILTER (n > total - {p}) - arg_max(close, n)) / (max(high) FILTER (n > total - {p}) - min(low) FILTER (n > total - {p})) * -100 END"""


def _wl(p: int) -> str:
    return f"""CASE WHEN total < {p} THEN 'Insufficient data' WHEN w{p} IS NULL THEN 'N/A' WHEN w{p} >= -20 THEN 'Overbought' WHEN w{p} <= -80 THEN 'Oversold' ELSE 'Neutral' END"""


q("williams_r", f"""SELECT ticker, round(w14, 8) AS williams_r_14, {_wl(14)} AS williams_r_14_signal, round(w2, 8) AS williams_r_2, {_wl(2)} AS williams_r_2_signal
  FROM (SELECT ticker, total, {_wr(14)} AS w14, {_wr(2)} AS w2 FROM nb GROUP BY ticker, total)""", "nb")
CROSS = """CASE WHEN k IS NULL THEN 'Insufficient data' WHEN k >= 80 THEN 'Overbought' WHEN k <= 20 THEN 'Oversold' WHEN k > d THEN 'Bullish crossover'
  WHEN k < d THEN 'Bearish crossover' ELSE 'Neutral' END"""
lib("st0", """SELECT ticker, n, total, CASE WHEN n >= 14 THEN CASE WHEN hi - lo < 1e-10 THEN 50 ELSE 100 * (close - lo) / (hi - lo) END END AS raw FROM (SELECT *,
  max(high) OVER w AS hi, min(low) OVER w AS lo FROM nb WINDOW w AS (PARTITION BY ticker ORDER BY n ROWS 13 PRECEDING))""", "nb")


def _two(src: str, first: int) -> str:
    return f"""SELECT ticker, n, total, k, CASE WHEN n >= {first + 2} THEN avg(filled) OVER (PARTITION BY ticker ORDER BY n ROWS 2 PRECEDING) END AS d FROM (
      SELECT *, CASE WHEN n >= {first} THEN coalesce(k, 50) END AS filled FROM (SELECT *, CASE WHEN n >= {first + 2} THEN
        avg(raw) OVER (PARTITION BY ticker ORDER BY n ROWS 2 PRECEDING) END AS k FROM {src}))"""


lib("st", _two("st0", 14), "st0")
q("stochastic", f"SELECT ticker, round(k, 8) AS stoch_k, round(d, 8) AS stoch_d, {CROSS} AS stoch_signal FROM st WHERE n = total", "st")
lib("sr0", """SELECT ticker, n, total, CASE WHEN n >= 15 THEN CASE WHEN al < 1e-10 THEN 100 ELSE 100 - 100 / (1 + ag / al) END END AS ix FROM (
  SELECT ticker, n, total, avg(greatest(close - before, 0)) OVER w AS ag, avg(greatest(before - close, 0)) OVER w AS al FROM nb WINDOW w AS (PARTITION BY ticker ORDER BY n ROWS 13 PRECEDING))""", "nb")
lib("sr1", """SELECT ticker, n, total, CASE WHEN n >= 28 THEN CASE WHEN hi - lo < 1e-10 THEN 50 ELSE (ix - lo) / (hi - lo) * 100 END END AS raw FROM (SELECT *,
  max(ix) OVER w AS hi, min(ix) OVER w AS lo FROM sr0 WINDOW w AS (PARTITION BY ticker ORDER BY n ROWS 13 PRECEDING))""", "sr0")
lib("sr", _two("sr1", 28), "sr1")
q("stochastic_rsi", f"SELECT ticker, round(k, 8) AS stochrsi_k, round(d, 8) AS stochrsi_d, {CROSS} AS stochrsi_signal FROM sr WHERE n = total", "sr")
lib("win", f"SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS before FROM bars WHERE date BETWEEN {D} - 366 AND {D}", "bars")
lib("wret", "SELECT ticker, date, close / before - 1 AS ret FROM win WHERE before > 0", "win")
lib("ptypes", f"SELECT ticker, {ANALYSIS} AS type, CASE {ANALYSIS} WHEN 'CRYPTO' THEN 365.0 ELSE 252.0 END AS p FROM meta", "meta")
lib("rr", """SELECT ticker, any_value(p) AS p, count(*) AS n, stddev_samp(ret) AS sd, stddev_pop(ret) AS sp, product(1 + ret) - 1 AS tot,
  sum(pow(least(ret - (pow(1.0425, 1 / p) - 1), 0), 2)) AS bsq, sum(pow(ret - mu, 3)) AS m3, sum(pow(ret - mu, 4)) AS m4
  FROM (SELECT *, avg(ret) OVER (PARTITION BY ticker) AS mu FROM wret) JOIN ptypes USING (ticker) GROUP BY ticker""", "wret", "ptypes")
lib("rrisk", """SELECT ticker, sd * sqrt(p) AS annual_volatility, (pow(1 + tot, p / n) - 1 - 0.0425) / (sd * sqrt(p)) AS sharpe_ratio,
  CASE WHEN bsq > 0 THEN (pow(1 + tot, p / n) - 1 - 0.0425) / (sqrt(bsq / n) * sqrt(p)) END AS sortino_ratio, sqrt(bsq / n) * sqrt(p) AS downside_deviation,
  n / ((n - 1) * (n - 2)) * m3 / pow(sp, 3) AS skewness,
  n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * m4 / pow(sp, 4) - 3 * pow(n - 1, 2) / ((n - 2) * (n - 3)) AS kurtosis FROM rr""", "rr")
RR = ("annual_volatility", "sharpe_ratio", "sortino_ratio", "downside_deviation", "skewness", "kurtosis")
q("return_risk", f"SELECT {swap(6, *RR)} FROM rrisk", "rrisk")


def _dd(src: str) -> str:
    return f"""SELECT ticker, min(dd) AS max_drawdown, CASE WHEN min(dd) < 0 THEN arg_min(date, (dd, date)) END AS max_drawdown_date,
      sqrt(avg(pow(dd * 100, 2))) AS ulcer_index FROM (SELECT ticker, date, (close - pk) / pk AS dd FROM (SELECT *,
      max(close) OVER (PARTITION BY ticker ORDER BY date) AS pk FROM {src})) GROUP BY ticker"""


lib("dds", _dd("nb"), "nb")
q("drawdowns", f"SELECT {swap(8, 'max_drawdown', 'ulcer_index')} FROM dds", "dds")


def _cagr(years: int, src: str, name: str) -> None:
    lib(f"{name}w", f"""SELECT b.* FROM {src} b JOIN (SELECT x.ticker, max(x.date) AS s FROM {src} x JOIN (SELECT ticker, max(date) AS e FROM {src} GROUP BY ticker) y
      ON y.ticker = x.ticker AND x.date <= y.e - INTERVAL {years} YEAR GROUP BY x.ticker) st ON st.ticker = b.ticker AND b.date >= st.s""", src)
    lib(name, f"""SELECT ticker, pow(lastc / firstc, 1 / (k + date_diff('day', s + to_years(k), e) / date_diff('day', s + to_years(k), s + to_years(k) + INTERVAL 1 YEAR))) - 1 AS g{years}
      FROM (SELECT ticker, min(date) AS s, max(date) AS e, arg_min(close, date) AS firstc, arg_max(close, date) AS lastc,
        CAST(year(max(date)) - year(min(date)) - CASE WHEN min(date) + to_years(CAST(year(max(date)) - year(min(date)) AS INTEGER)) > max(date) THEN 1 ELSE 0 END AS INTEGER) AS k
        FROM {name}w GROUP BY ticker)""", f"{name}w")


for _y in (1, 3, 5):
    _cagr(_y, "nb", f"c{_y}")
lib("c3d", _dd("c3w"), "c3w")
q("trailing_cagr", """SELECT ticker, round(g1, 8) AS cagr_1y, round(g3, 8) AS cagr_3y, round(g5, 8) AS cagr_5y, round(g3 / abs(nullif(max_drawdown, 0)), 8) AS calmar_ratio
  FROM (SELECT DISTINCT ticker FROM bars) LEFT JOIN c1 USING (ticker) LEFT JOIN c3 USING (ticker) LEFT JOIN c5 USING (ticker) LEFT JOIN c3d USING (ticker)""",
  "bars", "c1", "c3", "c5", "c3d")
q("bar_count_cagr", """SELECT ticker, round(pow(arg_max(close, n) / max(close) FILTER (n = total - least(504, total - 1)), 1 / (least(504, any_value(total) - 1) / 252.0)) - 1, 8) AS cagr
  FROM nb GROUP BY ticker""", "nb")


def _bench(rets: str) -> str:
    return f"""SELECT ticker, n AS aligned, beta, up_capture, down_capture,
      CASE WHEN up_capture >= 100 THEN 'Outperforms' WHEN up_capture >= 80 THEN 'Good' WHEN up_capture >= 50 THEN 'Weak' WHEN up_capture IS NOT NULL THEN 'Poor' END AS up_capture_ratio,
      CASE WHEN down_capture <= 80 THEN 'Protects' WHEN down_capture <= 100 THEN 'Average' WHEN down_capture <= 120 THEN 'Weak' WHEN down_capture IS NOT NULL THEN 'Poor' END AS down_capture_ratio
    FROM (SELECT a.ticker, count(*) AS n, CASE WHEN count(*) >= 10 THEN covar_samp(a.ret, b.ret) / nullif(var_samp(b.ret), 0) END AS beta,
      CASE WHEN count(*) >= 10 THEN (product(1 + a.ret) FILTER (b.ret > 0) - 1) / nullif(product(1 + b.ret) FILTER (b.ret > 0) - 1, 0) * 100 END AS up_capture,
      CASE WHEN count(*) >= 10 THEN (product(1 + a.ret) FILTER (b.ret < 0) - 1) / nullif(product(1 + b.ret) FILTER (b.ret < 0) - 1, 0) * 100 END AS down_capture
    FROM {rets} a JOIN {rets} b ON a.date = b.date AND b.ticker = '{BENCHMARK}' GROUP BY a.ticker)"""


lib("brisk", _bench("rets"), "rets")
q("benchmark_risk", f"SELECT {swap(6, 'beta', 'up_capture', 'down_capture')} FROM brisk", "brisk")
q("tracking_error", f"""SELECT a.ticker, count(*) AS tracked, round(CASE WHEN count(*) >= 10 THEN stddev_samp(a.ret - b.ret) * sqrt(any_value(p)) END, 8) AS tracking_error
  FROM rets a JOIN rets b ON a.date = b.date AND b.ticker = '{TRACKED}' JOIN ptypes t ON t.ticker = a.ticker GROUP BY a.ticker""", "rets", "ptypes")
lib("year_place", f"""SELECT ticker, (c - l.price) / l.price * 100 AS premium_discount, (c - lo) / nullif(hi - lo, 0) * 100 AS fifty_two_week_range_percent,
  CASE WHEN hi > lo THEN (hi - c) / hi * 100 END AS fifty_two_week_percent_from_high
  FROM (SELECT ticker, arg_max(close, date) AS c, max(high) AS hi, min(low) AS lo FROM bars WHERE date BETWEEN {D} - 364 AND {D} GROUP BY ticker) LEFT JOIN latest l USING (ticker)""", "bars", "latest")
q("year_range", f"SELECT ticker, {rnd(8, 'premium_discount', 'fifty_two_week_range_percent', 'fifty_two_week_percent_from_high')} FROM year_place", "year_place")
lib("hist", f"SELECT * FROM bars WHERE date BETWEEN {D} - 1839 AND {D}", "bars")
for _y in (1, 3, 5):
    _cagr(_y, "hist", f"h{_y}")
lib("h3d", _dd("h3w"), "h3w")
lib("wdd", _dd("win"), "win")
lib("wbench", _bench("wret"), "wret")
lib("wtracked", f"""SELECT ticker, CASE WHEN quote_type = 'ETF' OR ticker IN {_in(vocab.TRACKING_INDEX)} AND coalesce(CASE ticker {_TI} END, '') <> '{vocab.DEFAULT_INDEX}' THEN '{BENCHMARK}' ELSE '{TRACKED}' END AS idx FROM meta""", "meta")
lib("wtrack", f"""SELECT a.ticker, count(*) AS tracked, CASE WHEN count(*) >= 10 THEN stddev_samp(a.ret - b.ret) * sqrt(any_value(p)) END AS tracking_error
  FROM wret a JOIN wtracked x ON x.ticker = a.ticker JOIN wret b ON a.date = b.date AND b.ticker = x.idx JOIN ptypes t ON t.ticker = a.ticker GROUP BY a.ticker""", "wret", "ptypes", "wtracked")
q("asset_metrics", f"""SELECT ticker, type, bars, {rnd(6, 'beta', 'annual_volatility', 'sharpe_ratio', 'sortino_ratio', 'downside_deviation')}, {rnd(6, 'max_drawdown')}, max_drawdown_date,
  round(g1, 6) AS cagr_1y, round(g3, 6) AS cagr_3y, round(g5, 6) AS cagr_5y, round(g3 / abs(nullif(deep, 0)), 6) AS calmar_ratio, {rnd(6, 'ulcer_index', 'skewness', 'kurtosis', 'up_capture', 'down_capture')},
  up_capture_ratio, down_capture_ratio, {rnd(6, 'tracking_error')}, idx AS tracking_error_benchmark, {rnd(6, 'premium_discount', 'fifty_two_week_range_percent', 'fifty_two_week_percent_from_high')},
  concat_ws(',', CASE WHEN bars < 50 THEN 'INSUFFICIENT_LOOKBACK_HISTORY' END, CASE WHEN coalesce(hy, 0) < 1 THEN 'INSUFFICIENT_LONG_HISTORY' END,
    CASE WHEN aligned IS NULL THEN 'BENCHMARK_METRICS_UNAVAILABLE' WHEN aligned / (bars - 1) < 0.6 THEN 'BENCHMARK_ALIGNMENT_REDUCED' END,
    CASE WHEN tracked IS NULL THEN 'TRACKING_ERROR_UNAVAILABLE' WHEN tracked / (bars - 1) < 0.6 THEN 'TRACKING_ALIGNMENT_REDUCED' END) AS warnings
  FROM (SELECT ticker, count(*) AS bars FROM win GROUP BY ticker) JOIN ptypes USING (ticker)
  LEFT JOIN wbench USING (ticker) LEFT JOIN rrisk USING (ticker) LEFT JOIN wdd USING (ticker) LEFT JOIN wtrack USING (ticker)
  LEFT JOIN h1 USING (ticker) LEFT JOIN h3 USING (ticker) LEFT JOIN h5 USING (ticker) LEFT JOIN (SELECT ticker, max_drawdown AS deep FROM h3d) USING (ticker)
  LEFT JOIN (SELECT ticker, date_diff('day', min(date), max(date)) / 365.2425 AS hy FROM hist GROUP BY ticker) USING (ticker) LEFT JOIN wtracked USING (ticker) LEFT JOIN year_place USING (ticker) WHERE bars >= 2""",
  "win", "ptypes", "wtracked", "year_place", "wbench", "rrisk", "wdd", "wtrack", "h1", "h3", "h5", "h3d", "hist")
for _n in ("rsi", "moving_averages", "macd", "williams_r", "stochastic", "stochastic_rsi"):
    lib(f"t_{_n}", SQL[_n])
q("technicals", "SELECT * FROM t_rsi LEFT JOIN t_moving_averages USING (ticker) LEFT JOIN t_macd USING (ticker) LEFT JOIN t_williams_r USING (ticker) "
  "LEFT JOIN t_stochastic USING (ticker) LEFT JOIN t_stochastic_rsi USING (ticker)", "t_rsi", "t_moving_averages", "t_macd", "t_williams_r", "t_stochastic", "t_stochastic_rsi")

# --- price coverage --------------------------------------------------------------------------------------------

lib("req", f"""SELECT DISTINCT ticker, ticker_category FROM (
  SELECT asset AS ticker, 'asset' AS ticker_category FROM led WHERE NOT {stable('asset')} AND NOT {_stable_bucket('asset')}
  UNION ALL SELECT currency || 'USD=X', 'fx' FROM led WHERE currency IN {_FI}
  UNION ALL SELECT {pair_of('asset_type')}, 'fx' FROM led WHERE asset_type IN {FOREIGN}
  UNION ALL SELECT asset, 'fx' FROM led WHERE asset_type = 'cash_fx'
  UNION ALL SELECT right(asset, 3) || 'USD=X', 'fx' FROM led WHERE asset IN ('CASH EUR', 'CASH GBP', 'CASH UAH')
  UNION ALL SELECT fee_currency || 'USD=X', 'fx' FROM led WHERE fee_currency IN {FIAT}
  UNION ALL SELECT {fee_key('fee_currency')}, 'asset' FROM led WHERE fee_currency <> '' AND fee_type NOT LIKE 'cash%')""", "led")
q("required_tickers", "SELECT * FROM req", "req")
lib("active", f"SELECT DISTINCT {bucket('ticker')} AS bucket, date FROM prices", "prices")
q("last_bucket_dates", f"SELECT bucket, max(date) AS last_date FROM active WHERE date <= {D} GROUP BY bucket", "active")


def _points(name: str, end: str) -> None:
    lib(f"pts_{name}", f"""SELECT DISTINCT ticker, {bucket('ticker')} AS b, date FROM (
      SELECT asset AS ticker, date FROM led WHERE action IN ('BUY', 'SELL') AND NOT is_cash
      UNION ALL SELECT {pair_of('asset_type')}, date FROM led WHERE action IN ('BUY', 'SELL') AND asset_type IN {FOREIGN}
      UNION ALL SELECT norm_key, date FROM led WHERE (asset_type = 'cash_fx' OR (asset LIKE 'CASH %' AND asset <> 'CASH USD')) AND norm_key <> 'USD' AND NOT {stable('norm_key')})""", "led")
    lib(f"chk_{name}", f"""SELECT DISTINCT ticker, c.date AS checkpoint_date FROM (SELECT * FROM pts_{name} UNION SELECT ticker, b, CASE b WHEN 'crypto' THEN {end}
        ELSE (SELECT max(date) FROM active a WHERE a.bucket = b AND a.date <= {end}) END FROM pts_{name}) c JOIN active x ON x.bucket = c.b AND x.date = c.date""", f"pts_{name}", "active")
    lib(f"gap_{name}", f"SELECT k.* FROM chk_{name} k WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.ticker = k.ticker AND p.date = k.checkpoint_date)", f"chk_{name}", "prices")


_points("d", D)
_points("t", f"DATE '{TODAY}'")
q("required_checkpoints", "SELECT * FROM chk_d", "chk_d")
q("missing_checkpoints", "SELECT * FROM gap_d", "gap_d")
q("coverage_issues", """SELECT ticker, count(*) AS missing_count, 'missing_dates: ' || string_agg(CAST(checkpoint_date AS VARCHAR), ', ' ORDER BY checkpoint_date) AS issues
  FROM gap_d GROUP BY ticker""", "gap_d")


def _stale(today: str, age: int) -> str:
    return f"""SELECT ticker, l AS last_price_date, CAST({today} - l AS INTEGER) AS age_days FROM req JOIN (SELECT ticker, max(date) AS l FROM prices GROUP BY ticker) USING (ticker)
      WHERE l < {today} - {age}"""


T = f"DATE '{TODAY}'"
q("stale_tickers", _stale("DATE '2001-11-20'", 17), "req", "prices")
q("missing_or_stale", f"""SELECT DISTINCT ticker FROM req r WHERE NOT {cash_like('ticker', bucket('ticker'))} AND NOT EXISTS (SELECT 1 FROM prices p
  WHERE p.ticker = r.ticker AND p.date BETWEEN DATE '2001-12-05' - 1 AND DATE '2001-12-05')""", "req", "prices")
lib("stale2", _stale(T, 2), "req", "prices")
lib("stale3", _stale(T, 3), "req", "prices")
lib("stale5", _stale(T, 5), "req", "prices")
q("verify_prices", """SELECT count(*) AS total_rows, count(DISTINCT ticker) AS unique_tickers, min(date) AS start_date, max(date) AS end_date,
  (SELECT count(DISTINCT ticker) FROM req) AS required_tickers, (SELECT count(DISTINCT ticker) FROM gap_t) AS coverage_issues,
  (SELECT count(*) FROM stale5) AS stale_tickers FROM prices""", "prices", "req", "gap_t", "stale5")
q("freshness", f"""SELECT max(date) AS prices_as_of, CAST({T} - max(date) AS INTEGER) AS price_age_days, EXISTS (SELECT 1 FROM gap_t) OR EXISTS (SELECT 1 FROM stale2) AS stale
  FROM prices WHERE date <= {T}""", "prices", "gap_t", "stale2")
q("unhealthy_tickers", """SELECT ticker, bool_or(g) AS coverage_gap, bool_or(NOT g) AS stale_price FROM (SELECT ticker, TRUE AS g FROM gap_t UNION ALL SELECT ticker, FALSE FROM stale3) GROUP BY ticker""", "gap_t", "stale3")
q("data_quality_summary", """SELECT (SELECT count(*) FROM stale3) AS stale_count, (SELECT coalesce(string_agg(ticker, ',' ORDER BY ticker), '') FROM stale3) AS stale_list,
  (SELECT count(DISTINCT ticker) FROM gap_t) AS coverage_count, (SELECT coalesce(string_agg(ticker, ',' ORDER BY ticker), '') FROM (SELECT DISTINCT ticker FROM gap_t)) AS coverage_list""", "stale3", "gap_t")
q("price_report", f"""SELECT ticker, ticker IN (SELECT ticker FROM req) AS required, (SELECT count(*) FROM gap_t g WHERE g.ticker = t.ticker) AS missing_count,
  (SELECT string_agg(CAST(checkpoint_date AS VARCHAR), ',' ORDER BY checkpoint_date) FROM gap_t g WHERE g.ticker = t.ticker) AS missing_dates, l AS last_price_date,
  CAST({T} - l AS INTEGER) AS age_days, ticker IN (SELECT ticker FROM stale3) AS stale
  FROM (SELECT ticker FROM req UNION SELECT ticker FROM gap_t) t LEFT JOIN (SELECT ticker, max(date) AS l FROM prices GROUP BY ticker) USING (ticker)""", "req", "gap_t", "stale3", "prices")
q("repair_summary", f"""SELECT (SELECT min(date) FROM txn) AS range_start, {T} AS range_end, count(*) - count(*) FILTER (fresh) AS would_repair, count(*) FILTER (fresh) AS would_skip_fresh,
  (SELECT count(DISTINCT ticker) FROM gap_t) AS unresolved_missing, (SELECT count(DISTINCT ticker) FROM stale3) AS unresolved_stale,
  CASE WHEN EXISTS (SELECT 1 FROM gap_t) OR EXISTS (SELECT 1 FROM stale3) THEN 'degraded' ELSE 'ok' END AS status
  FROM (SELECT DISTINCT ticker, ticker IN (SELECT ticker FROM prices WHERE date >= {T} - 3) AS fresh FROM req)""", "txn", "req", "prices", "gap_t", "stale3")
q("repair_plan", f"""SELECT DISTINCT ticker, CASE WHEN EXISTS (SELECT 1 FROM prices p WHERE p.ticker = r.ticker AND p.date >= {T} - 3) THEN 'skip_fresh' ELSE 'repair' END AS plan,
  CASE WHEN ticker IN (SELECT ticker FROM gap_t) OR ticker IN (SELECT ticker FROM stale3) THEN 'degraded' ELSE 'ok' END AS status FROM req r""", "req", "prices", "gap_t", "stale3")
q("metadata_cache", f"""SELECT ticker AS asset, CAST(NULL AS VARCHAR) AS asset_kind, sector, CAST(NULL AS VARCHAR) AS industry, CAST(NULL AS VARCHAR) AS region,
  CAST((SELECT count(*) FROM sector_parts s WHERE s.ticker = m.ticker) AS INTEGER) AS sector_weights, 'parts' AS source, strftime(fetched, '%Y-%m-%dT00:00:00Z') AS fetched_at,
  fetched < {D} - 5 AS is_stale FROM meta m""", "meta", "sector_parts")

# --- rules -----------------------------------------------------------------------------------------------------

lib("index200", f"""SELECT last_day(date) AS date, arg_max(close, date) AS spx_price, arg_max(sma, date) AS sma200 FROM (SELECT date, close,
  CASE WHEN row_number() OVER (ORDER BY date) >= 200 THEN avg(close) OVER (ORDER BY date ROWS 199 PRECEDING) END AS sma FROM bars WHERE ticker = '{BENCHMARK}')
  GROUP BY last_day(date) HAVING arg_max(CASE WHEN sma IS NULL THEN 0 ELSE 1 END, date) = 1""", "bars")
lib("regime", """SELECT *, CASE WHEN missing_count > 1 THEN 'CAUTION' WHEN peak_count <= 1 THEN 'AGGRESSIVE' WHEN peak_count = 2 THEN 'CAUTION' ELSE 'PROTECTION' END AS regime FROM (
  SELECT m.*, spx_price, sma200, (cape > 30)::INT + coalesce(fear_greed > 75, FALSE)::INT + coalesce(unrate <= 3.8, FALSE)::INT + coalesce(spx_price <= sma200, FALSE)::INT AS peak_count,
    (fear_greed IS NULL)::INT + (unrate IS NULL)::INT + (spx_price IS NULL)::INT AS missing_count
  FROM (SELECT a.date, a.cape, a.fear_greed, u.unrate FROM macro a ASOF LEFT JOIN (SELECT date, unrate FROM macro WHERE unrate IS NOT NULL) u ON a.date >= u.date) m
  ASOF LEFT JOIN index200 x ON m.date >= x.date)""", "macro", "index200")
q("macro_regime", """SELECT date, cape, fear_greed, unrate, spx_price, sma200, unrate BETWEEN 3.8 AND 4.8 AS unrate_ok_band, unrate > 4.8 AS labor_warning,
  peak_count, missing_count, regime, CASE WHEN missing_count > 1 THEN missing_count || ' indicators missing' ELSE peak_count || ' PEAK' END AS regime_reason FROM regime""", "regime")
lib("shares", """SELECT account, date AS month, sum(value_usd) AS portfolio_value, coalesce(sum(value_usd) FILTER ((kind = 'cash' AND instrument IN ('USD', 'USDT', 'USDC', 'GBPUSD=X', 'EURUSD=X'))
  OR (kind = 'asset' AND instrument = 'SGOV')), 0) AS idle_usd FROM inst_days WHERE date = last_day(date) GROUP BY ALL""", "inst_days")
lib("idle", "SELECT *, CASE WHEN portfolio_value > 0 THEN idle_usd / portfolio_value END AS idle_share FROM shares", "shares")
q("month_shares", f"SELECT {swap(8, 'idle_share')} FROM idle", "idle")
lib("filt", """SELECT ticker, last_day(date) AS month, arg_max(close, date) AS close, arg_max_null(sma, date) AS sma, arg_max_null(rsi, date) AS rsi FROM (
  SELECT b.ticker, b.date, b.close, CASE WHEN n >= 90 THEN avg(close) OVER (PARTITION BY b.ticker ORDER BY b.date ROWS 89 PRECEDING) END AS sma, r.rsi
  FROM nb b LEFT JOIN rsi_all r USING (ticker, date) WHERE b.ticker IN ('SPYM', 'SCHD', 'XLU')) GROUP BY ALL""", "nb", "rsi_all")
lib("passed", "SELECT *, coalesce(rsi < CASE ticker WHEN 'SPYM' THEN 70 ELSE 65 END, FALSE) OR coalesce(close < sma, FALSE) AS passes FROM filt", "filt")
q("buy_filters", "SELECT ticker, month, close, sma, round(rsi, 6) AS rsi, passes FROM passed", "passed")
lib("rolls", "SELECT * FROM roll12 UNION ALL SELECT * FROM roll24", "roll12", "roll24")
q("underperformance", f"""SELECT account, date, window_months, round(return_pct, 6) AS return_pct, round(bp, 6) AS benchmark_pct, round(bp - return_pct, 6) AS shortfall_pct,
  bp - return_pct > CASE window_months WHEN 12 THEN 10 ELSE 20 END AS alert FROM (SELECT r.account, r.date, r.window_months, r.return_pct, (e.price / b.price - 1) * 100 AS bp
  FROM (SELECT *, '{BENCHMARK}' AS t, CAST(date - to_months(window_months) AS DATE) AS s FROM rolls) r ASOF JOIN prices e ON e.ticker = r.t AND e.date <= r.date
  ASOF JOIN prices b ON b.ticker = r.t AND b.date <= r.s)""", "rolls", "prices")

lib("under", SQL["underperformance"])
# One row per month; then per month and fund; what a month leaves; the months since the last round of the core fund.
lib("bm_month", """SELECT i.account, i.month, coalesce(g.regime, 'CAUTION') AS regime, coalesce(g.fear_greed < 20, FALSE) AS fear, idle_share, coalesce(idle_share, 0) AS sh,
    coalesce(lag(idle_share) OVER w > 0.45 AND lag(idle_share, 2) OVER w > 0.45, FALSE) AS step,
    count(*) FILTER (idle_share > 0.45) OVER (PARTITION BY account ORDER BY month ROWS 5 PRECEDING) = 6
      AND EXISTS (SELECT 1 FROM under u WHERE u.account = i.account AND u.date = i.month AND u.window_months = 24 AND u.alert) AS kill
  FROM idle i LEFT JOIN regime g ON g.date = i.month WINDOW w AS (PARTITION BY account ORDER BY month)""", "idle", "regime", "under")
lib("bm_fund", """SELECT m.*, v.t, p.rsi, p.passes, v.w IS NULL OR coalesce(p.passes, FALSE) AS ok,
    CASE WHEN v.t = 'BTC-USD' THEN 100 WHEN v.t = 'SGOV' THEN CASE WHEN sh < 0.25 THEN 50 ELSE 0 END WHEN sh >= 0.45 THEN CASE v.t WHEN 'SPYM' THEN 1000 ELSE 0 END ELSE 1000 * v.w END::DOUBLE AS base,
    CASE WHEN v.t = 'BTC-USD' THEN 0 WHEN v.t = 'SGOV' THEN CASE WHEN fear THEN -60 ELSE 0 END
      ELSE CASE WHEN fear THEN 60 * v.w / 0.95 ELSE 0 END + CASE WHEN NOT step THEN 0 WHEN sh < 0.45 THEN 100 * v.w / 0.95 WHEN v.t = 'SPYM' THEN 100 ELSE 0 END END::DOUBLE AS bonus,
    CASE WHEN v.t = 'SPYM' AND sh > 0.30 THEN 1000 ELSE 0 END::DOUBLE AS more
  FROM bm_month m CROSS JOIN (VALUES ('SPYM', 0.8::DOUBLE), ('SCHD', 0.1), ('XLU', 0.05), ('SGOV', NULL), ('BTC-USD', NULL)) v(t, w)
  LEFT JOIN passed p ON p.month = m.month AND p.ticker = v.t""", "bm_month", "passed")
lib("bm_left", """SELECT *, max(month) FILTER (core) OVER (PARTITION BY account ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM (
  SELECT account, month, bool_or(ok) FILTER (t = 'SPYM') AS core, coalesce(sum(base + bonus + more) FILTER (NOT ok), 0) + CASE WHEN any_value(sh) >= 0.25 AND any_value(sh) < 0.45 THEN 50 ELSE 0 END AS held,
    any_value(regime) = 'AGGRESSIVE' AND NOT any_value(kill) AND count(passes) FILTER (t IN ('SPYM', 'SCHD', 'XLU')) = 3
      AND coalesce(sum(base + bonus) FILTER (ok AND t IN ('SPYM', 'SCHD', 'XLU')), 0) < 800 AS under_floor
  FROM bm_fund GROUP BY account, month)""", "bm_fund")
lib("bm_pool", """SELECT a.account, a.month, any_value(a.under_floor) AS under_floor, coalesce(sum(b.held), 0) AS pool FROM bm_left a
  LEFT JOIN bm_left b ON b.account = a.account AND b.month < a.month AND (a.since IS NULL OR b.month >= a.since) GROUP BY a.account, a.month""", "bm_left")
q("buy_map", """SELECT account, month, t AS ticker, regime, kill AS kill_switch, under_floor AS below_risk_floor, round(idle_share, 6) AS idle_share, round(rsi, 6) AS rsi,
  round(base, 4) AS base_usd, round(bonus, 4) AS bonus_usd, more AS surcharge_usd, round(carried, 4) AS carried_usd,
  round(CASE WHEN ok THEN base + bonus + more + carried ELSE 0 END, 4) AS buy_usd, round(CASE WHEN ok THEN 0 ELSE base + bonus + more END, 4) AS deferred_usd
  FROM (SELECT f.*, under_floor, CASE WHEN t = 'SPYM' THEN pool ELSE 0 END::DOUBLE AS carried FROM bm_fund f JOIN bm_pool USING (account, month))""", "bm_fund", "bm_pool")

# --- documents, streams ----------------------------------------------------------------------------------------

q("publish_snapshot", f"""SELECT account, portfolio_value_usd, today_abs, coalesce(total_gain, 0) AS total_abs, points AS history_points,
  (SELECT max(date) FROM prices WHERE date <= {D}) AS prices_as_of, {D} AS as_of_date FROM summ JOIN stat USING (account) JOIN (SELECT account,
    coalesce(max(portfolio_value) FILTER (date = {D}) - max(portfolio_value) FILTER (date = {D} - 1), 0) AS today_abs, CAST(count(*) FILTER (date > {D} - 180) AS INTEGER) AS points
    FROM daily GROUP BY account) USING (account)""", "summ", "stat", "daily", "prices")
q("dashboard_snapshot", f"""SELECT account, holding_count, allocation_usd, allocation_rows, cash_rows, CAST(total_days AS INTEGER) AS total_days, history_points FROM summ
  JOIN (SELECT account, sum(value_usd) AS allocation_usd, CAST(count(*) AS INTEGER) AS allocation_rows FROM alloc GROUP BY account) USING (account)
  JOIN (SELECT account, CAST(count(*) AS INTEGER) AS cash_rows FROM cash_now GROUP BY account) USING (account) LEFT JOIN report_all USING (account)
  JOIN (SELECT account, CAST(count(*) FILTER (date > {D} - 365) AS INTEGER) AS history_points FROM daily GROUP BY account) USING (account)""", "summ", "alloc", "cash_now", "report_all", "daily")
q("tick_closes", "SELECT event_type AS ticker, CAST(ts AS DATE) AS day, arg_max(value, (ts, event_id)) AS price FROM events GROUP BY event_type, CAST(ts AS DATE)")
q("sector_weight_items", "SELECT ticker, sector, weight FROM weights", "weights")
q("hourly_closes", "SELECT event_type AS ticker, strftime(ts, '%Y-%m-%d %H') AS hour, arg_max(value, (ts, event_id)) AS price, count(*) AS ticks FROM events GROUP BY event_type, strftime(ts, '%Y-%m-%d %H')")
q("streamed_hours", f"""WITH tagged AS (SELECT event_type AS ticker, ts, value, event_id, strftime(ts, '%Y-%m-%d %H') AS hour, NOT ({EARLY_TICKS}) AND
    date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events WHERE {EARLY_TICKS}) AS late FROM events)
  SELECT ticker, hour, arg_max(value, (ts, event_id)) AS price, count(*) AS ticks, late FROM tagged GROUP BY ticker, hour, late""")
q("resumed_returns", f"SELECT {swap(8, 'portfolio_daily_return', 'investment_return')} FROM daily", "daily")
q("dated_copies", """SELECT * FROM (SELECT unnest([{'stamp': '20010630', 'run': 1}, {'stamp': '20010630', 'run': 2}, {'stamp': '20010805', 'run': 3}], recursive := true)) JOIN
  (SELECT name, run, if(run = 2, 0, n) AS rows_copied, n AS rows_there FROM (SELECT name, unnest([1, 2]) AS run, n FROM (
     SELECT 'prices' AS name, count(*) AS n FROM prices UNION ALL SELECT 'metadata', count(*) FROM meta UNION ALL SELECT 'bars', count(*) FROM bars)
   UNION ALL SELECT 'prices', 3, count(*) FROM prices WHERE ticker = 'SPY' UNION ALL SELECT unnest(['metadata', 'bars']), 3, 0)) USING (run)""", "prices", "meta", "bars")
q("stored_documents", f"""SELECT account, CASE WHEN NOT ends_with(account, '1') THEN portfolio_value_usd END AS portfolio_value_usd,
  CASE WHEN NOT ends_with(account, '1') THEN {D} END AS as_of_date FROM summ""", "summ")
q("recalculated_returns", """SELECT * EXCLUDE (f) REPLACE (round(portfolio_daily_return, 8) AS portfolio_daily_return, round(investment_return, 8) AS investment_return) FROM daily d
  JOIN (SELECT account, min(date) AS f FROM txn WHERE action = 'TAX' AND date >= DATE '2001-03-01' GROUP BY account) USING (account) WHERE d.date >= f""", "daily", "txn")
