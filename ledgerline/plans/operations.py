"""Trading, operations, treasury, planning, data and commercial (B11 to B18) as statements: name -> (columns, text)."""

STATEMENTS: dict[str, tuple[str, str]] = {
    "b11_01_block_split": ("instrument_id l, trade_date t, child l, qty l", """
        with b as (select instrument_id, trade_date, sum(qty) as q from txn where side = 1 group by 1, 2), s as (select instrument_id, trade_date, q, RANGE(1, IDIV(q + 29, 30)) as child from b)
        select instrument_id, trade_date, child, least(30, q - 30 * (child - 1)) as qty from s"""),
    "b11_03_vwap": ("instrument_id l, m l, vwap d, slippage d", "select instrument_id, m, vwap, max_u - vwap as slippage from (select instrument_id, year(trade_date) * 12 + month(trade_date) as m, sum(amount) * 1.0 / sum(qty) as vwap, max(amount * 1.0 / qty) as max_u from txn group by 1, 2) as x"),
    "b11_04_shortfall": ("order_id l, execution l, opportunity l", "select order_id, sum(amount - qty * price) as execution, sum(case when line_status = 'O' then qty * IDIV(price, 100) else 0 end) as opportunity from txn join instrument on txn.instrument_id = instrument.instrument_id group by 1"),
    "b11_06_fill_rate": ("order_id l, ordered l, filled l, state s", "select order_id, sum(qty) as ordered, sum(case when line_status = 'F' then qty else 0 end) as filled, case when sum(case when line_status = 'F' then qty else 0 end) = 0 then 'new' when sum(case when line_status = 'F' then qty else 0 end) = sum(qty) then 'filled' else 'partial' end as state from txn group by 1"),
    "b11_07_settlement_chain": ("segment s, class s, region_name s, amount l, n l", "select c_mktsegment as segment, class, region_name, sum(amount) as amount, count(*) as n from txn join instrument on txn.instrument_id = instrument.instrument_id join party on broker_id = party_id and kind = 'S' join place on party.nation = place.nation join ord on txn.order_id = ord.order_id join customer on ord.portfolio_id = c_custkey group by 1, 2, 3"),
    "b12_02_matching": ("instrument_id l, matched l", """
        with b as (select instrument_id, trade_date, qty, row_number() over (partition by instrument_id, qty order by trade_date, order_id, line, amount, broker_id) as k from txn where side = 1), s as (select instrument_id, trade_date, qty, row_number() over (partition by instrument_id, qty order by trade_date, order_id, line, amount, broker_id) as k from txn where side = -1)
        select b.instrument_id, count(*) as matched from b join s on b.instrument_id = s.instrument_id and b.qty = s.qty and b.k = s.k group by 1"""),
    "b12_03_ibor_abor": ("instrument_id l, ibor l, abor l, difference l", "select instrument_id, sum(case when flag = 'N' then qty else 0 end) as ibor, sum(case when flag = 'A' then qty else 0 end) as abor, sum(case when flag = 'N' then qty when flag = 'A' then -qty else 0 end) as difference from txn group by 1"),
    "b12_04_break_recurrence": ("portfolio_id l, breaks l, repeats l, longest_gap l", "select portfolio_id, count(*) as breaks, sum(case when gap < 60 then 1 else 0 end) as repeats, max(gap) as longest_gap from (select portfolio_id, DAYS(order_date, lag(order_date) over (partition by portfolio_id order by order_date, order_id)) as gap from ord where status = 'P') as x group by 1"),
    "b12_05_shadow_nav": ("m l, own l, administrator l, within b", "select m, sum(gross) as own, sum(IDIV(gross * (990 + portfolio_id % 21), 1000)) as administrator, abs(sum(gross) - sum(IDIV(gross * (990 + portfolio_id % 21), 1000))) * 1000 <= sum(gross) as within from monthly group by m"),
    "b12_06_settlement_fails": ("broker_id l, late l, penalty l", "select broker_id, sum(case when DAYS(trade_date, order_date) > 30 then 1 else 0 end) as late, sum(IDIV(greatest(0, DAYS(trade_date, order_date) - 30) * amount, 100000)) as penalty from txn group by 1"),
    "b12_08_income": ("instrument_id l, expected l, received l, shortfall l", "select instrument_id, sum(amount * 5) as expected, sum(amount * tax) as received, sum(amount * 5) - sum(amount * tax) as shortfall from txn group by 1"),
    "b12_09_fee_accrual": ("portfolio_id l, gross_fee l, waiver l, net_fee l", "select portfolio_id, sum(amount * tax) as gross_fee, sum(case when disc >= 8 then amount else 0 end) as waiver, sum(amount * tax) - sum(case when disc >= 8 then amount else 0 end) as net_fee from txn group by 1"),
    "b12_10_ocf": ("segment s, ocf d", "select segment, sum(charge) / 10000.0 / avg(nav) as ocf from (select segment, m, sum(gross) as nav, sum(gross) * 12 as charge from monthly join portfolio on monthly.portfolio_id = portfolio.portfolio_id group by 1, 2) as x group by 1"),
    "b12_16_harvest": ("portfolio_id l, instrument_id l, loss l", "select portfolio_id, valued.instrument_id, cost - mv as loss from valued where cost > mv and qty > 0 and not exists (select 1 from txn where txn.portfolio_id = valued.portfolio_id and txn.instrument_id = valued.instrument_id and trade_date > date '2001-07-01')"),
    "b12_19_register": ("segment s, holder l, units l, payment l", "select segment, ord.portfolio_id as holder, sum(IDIV(total, 10000)) as units, sum(IDIV(total, 10000)) * 3 as payment from ord join portfolio on ord.portfolio_id = portfolio.portfolio_id group by 1, 2"),
    "b12_20_lending": ("instrument_id l, lendable l, lent l, utilisation d, revenue l", "select instrument_id, sum(qty) as lendable, sum(case when line_status = 'O' then qty else 0 end) as lent, sum(case when line_status = 'O' then qty else 0 end) * 1.0 / sum(qty) as utilisation, sum(case when line_status = 'O' then amount * disc else 0 end) as revenue from txn group by 1"),
    "b12_21_etf_basket": ("class s, basket l, cash_residual l", "select class, sum(price * 3) as basket, 100000000 - sum(price * 3) as cash_residual from instrument group by class"),
    "b12_22_leases": ("segment s, walt d, noi l", "select segment, sum(total * DAYS(PLUS_DAYS(order_date, 1500), date '1998-01-01') / 365.0) / sum(total) as walt, sum(total) - sum(IDIV(total * 35, 100)) as noi from ord join portfolio on ord.portfolio_id = portfolio.portfolio_id where PLUS_DAYS(order_date, 1500) > date '1998-01-01' group by 1"),
    "b13_01_margin_call": ("broker_id l, exposure l, held l, call_amount l", "select broker_id, exposure, held, case when greatest(exposure - 1000000, 0) - held >= 500000 then greatest(exposure - 1000000, 0) - held else 0 end as call_amount from (select broker_id, sum(side * amount) as exposure, max(balance) * 2 as held from txn join party on broker_id = party_id and kind = 'S' group by 1) as x"),
    "b13_02_haircut": ("class s, value l, eligible l", "with h as (select 'ECONOMY' as c, 5 as pct union all select 'STANDARD', 10 union all select 'PROMO', 25) select class, sum(price) as value, sum(IDIV(price * (100 - coalesce(pct, 100)), 100)) as eligible from instrument left join h on class = c group by class"),
    "b13_04_inventory": ("instrument_id l, posted l, received l, available l", "select instrument_id, sum(case when flag = 'A' then qty else 0 end) as posted, sum(case when flag = 'N' then qty else 0 end) as received, sum(case when flag = 'R' then qty else 0 end) as available from txn group by 1"),
    "b13_05_borrowing_base": ("segment s, base_amount l, drawn l, covenant_ok b", "select segment, IDIV(sum(greatest(cash, 0)) * 80, 100) as base_amount, sum(greatest(-cash, 0)) as drawn, sum(greatest(-cash, 0)) <= IDIV(sum(greatest(cash, 0)) * 80, 100) as covenant_ok from portfolio group by 1"),
    "b14_01_drift": ("portfolio_id l, class s, weight d, drift d", "with w as (select portfolio_id, class, sum(mv) * 1.0 / sum(sum(mv)) over (partition by portfolio_id) as weight from valued where mv > 0 group by 1, 2) select portfolio_id, class, weight, weight - 1.0 / 6 as drift from w where abs(weight - 1.0 / 6) > 0.1"),
    "b14_02_rebalance": ("portfolio_id l, class s, trade l", "select portfolio_id, class, IDIV(IDIV(total, 6) - mv, 10000) * 10000 as trade from (select portfolio_id, class, sum(mv) as mv, sum(sum(mv)) over (partition by portfolio_id) as total from valued where mv > 0 group by 1, 2) as x"),
    "b14_03_model_replication": ("portfolio_id l, class s, target l", "with m as (select class, count(*) as w, sum(count(*)) over () as t from instrument group by class) select portfolio_id, class, IDIV(greatest(cash, 0) * case when class = 'PROMO' and portfolio_id % 10 = 0 then 0 else w end, t) as target from portfolio cross join m"),
    "b14_04_tilt": ("segment s, tilted d", "select segment, least(0.3, greatest(0.1, 0.2 + (avg(cash) - 450000) / 1000000.0)) as tilted from portfolio group by 1"),
    "b14_05_cash_drag": ("segment s, drag d", "select segment, sum(greatest(cash, 0)) * 1.0 / (sum(greatest(cash, 0)) + sum(coalesce(mv, 0))) * 0.04 as drag from portfolio left join (select portfolio_id, sum(mv) as mv from valued group by 1) as v on portfolio.portfolio_id = v.portfolio_id group by 1"),
    "b14_06_maturity": ("class s, wam d", "select class, sum(amount * DAYS(trade_date, date '1995-01-01')) * 1.0 / sum(amount) as wam from txn join instrument on txn.instrument_id = instrument.instrument_id group by 1"),
    "b14_07_risk_budget": ("user_id l, budget l, cut b", "select user_id, sum(v) as budget, min(RATIO(v * 1.0, hwm)) < 0.2 as cut from (select user_id, d, v, max(v) over (partition by user_id order by d) as hwm from daily) as x group by 1"),
    "b14_08_funded_ratio": ("segment s, assets l, liabilities d, ratio d", "with a as (select segment, sum(cash) as assets from portfolio group by 1), b as (select segment, sum(total / power(1.03, year(order_date) - 1994)) / 100 as pv from ord join portfolio on ord.portfolio_id = portfolio.portfolio_id where status = 'O' group by 1) select a.segment, assets, pv as liabilities, assets / pv / 100 as ratio from a join b on a.segment = b.segment"),
    "b14_09_adequacy": ("portfolio_id l, required l, funded d, adequate b", "select portfolio.portfolio_id, IDIV(sum(total), 100) as required, max(cash) * 100.0 / sum(total) as funded, max(cash) * 100 >= sum(total) as adequate from portfolio join ord on portfolio.portfolio_id = ord.portfolio_id group by 1"),
    "b15_01_divergence": ("user_id l, providers l, spread l", "select user_id, count(*) as providers, max(a) - min(a) as spread from (select user_id, provider, WHOLE(avg(v)) as a from obs group by 1, 2) as x group by 1"),
    "b15_02_waci": ("portfolio_id l, waci d", "select portfolio_id, sum(mv * size) * 1.0 / sum(mv) as waci from valued join (select instrument_id, size from instrument) as i on valued.instrument_id = i.instrument_id where mv > 0 group by 1"),
    "b15_03_coverage": ("source s, docs l, covered l, share d", "select source, count(*) as docs, count(labels.doc_id) as covered, count(labels.doc_id) * 1.0 / count(*) as share from documents left join labels on documents.doc_id = labels.doc_id group by source"),
    "b15_04_data_quality": ("rule s, failed l", "select 'order_line_unique' as rule, count(*) as failed from (select order_id, line from txn group by 1, 2 having count(*) > 1) as x union all select 'amount_positive', count(*) from txn where amount <= 0 union all select 'ship_after_order', count(*) from txn where trade_date < order_date union all select 'name_present', count(*) from party where name is null or name = ''"),
    "b15_05_lineage": ("metric s, dependent s, depth i", """
        with recursive dep as (select 'price' as a, 'mv' as b union all select 'qty', 'mv' union all select 'mv', 'nav' union all select 'nav', 'twr' union all select 'nav', 'fee' union all select 'fee', 'net' union all select 'twr', 'net'),
        walk as (select a as metric, b as top, 1 as depth from dep union all select walk.metric, dep.b, walk.depth + 1 from walk join dep on walk.top = dep.a)
        select metric, top as dependent, max(depth) as depth from walk group by 1, 2"""),
    "b15_10_case_ageing": ("conv_id l, turns l, user_turns l, late b", "select conv_id, count(*) as turns, sum(case when role = 'user' then 1 else 0 end) as user_turns, max(turn) >= 4 as late from conversations group by 1"),
    "b16_01_overlay": ("nation l, exposure l, contracts l", "select nation, sum(balance) as exposure, IDIV(IDIV(sum(balance), 2), 100000) as contracts from party group by 1"),
    "b16_02_equitisation": ("segment s, idle l, contracts l", "select segment, sum(greatest(cash - 100000, 0)) as idle, IDIV(sum(greatest(cash - 100000, 0)), 250000) as contracts from portfolio group by 1"),
    "b16_03_sleeve": ("order_date t, due l, horizon l", "select order_date, due, sum(due) over (order by order_date rows between 29 preceding and current row) as horizon from (select order_date, sum(total) as due from ord group by 1) as x"),
    "b16_04_long_short": ("portfolio_id l, long_mv l, short_mv l, net l, gross l, leverage d", "select portfolio_id, sum(greatest(mv, 0)) as long_mv, sum(least(mv, 0)) as short_mv, sum(mv) as net, sum(abs(mv)) as gross, sum(abs(mv)) * 1.0 / nullif(abs(sum(mv)), 0) as leverage from valued group by 1"),
    "b16_05_completion": ("class s, target d, actual d, gap d", "with a as (select class, sum(mv) * 1.0 / sum(sum(mv)) over () as actual from valued group by 1), t as (select class, count(*) * 1.0 / sum(count(*)) over () as target from instrument group by 1) select coalesce(a.class, t.class) as class, coalesce(target, 0) as target, coalesce(actual, 0) as actual, coalesce(target, 0) - coalesce(actual, 0) as gap from a full outer join t on a.class = t.class"),
    "b16_06_futures_roll": ("size i, next_size i, roll d", "select size, next_size, next_price * 1.0 / price - 1 as roll from (select size, price, lead(size) over (order by size) as next_size, lead(price) over (order by size) as next_price from (select size, WHOLE(avg(price)) as price from instrument group by 1) as x) as y where next_size is not null"),
    "b16_07_funding": ("nation_name s, need l, balance l, short l", "select nation_name, need, balance, greatest(0, need - balance) as short from (select nation_name, sum(case when status = 'P' and order_date >= date '2001-07-01' then total else 0 end) as need, max(cash) as balance from ord join portfolio on ord.portfolio_id = portfolio.portfolio_id group by 1) as x"),
    "b16_09_sources_uses": ("instrument_id l, supply l, demand l, reused l", "with a as (select instrument_id, sum(qty) as supply from txn where flag = 'N' group by 1), b as (select instrument_id, sum(qty) as demand from txn where flag = 'R' group by 1) select coalesce(a.instrument_id, b.instrument_id) as instrument_id, coalesce(supply, 0) as supply, coalesce(demand, 0) as demand, least(coalesce(supply, 0), coalesce(demand, 0)) as reused from a full outer join b on a.instrument_id = b.instrument_id"),
    "b16_10_liquidity_stress": ("scenario s, segment s, coverage d", "with s as (select 'mild' as scenario, 10 as redeem, 95 as keep union all select 'severe', 30, 70) select scenario, segment, sum(cash * keep) * 1.0 / sum(total_due * redeem) as coverage from portfolio join (select portfolio_id, sum(total) as total_due from ord group by 1) as o on portfolio.portfolio_id = o.portfolio_id cross join s group by 1, 2"),
    "b16_11_hedged_class": ("segment s, base_pnl l, hedge_pnl l, class_pnl l", "select segment, sum(flow) as base_pnl, case when segment = 'HOUSEHOLD' then IDIV(sum(gross), 50) else 0 end as hedge_pnl, sum(flow) + case when segment = 'HOUSEHOLD' then IDIV(sum(gross), 50) else 0 end as class_pnl from monthly join portfolio on monthly.portfolio_id = portfolio.portfolio_id group by 1"),
    "b17_03_mark_challenge": ("portfolio_id l, m l, rolled l, challenged b", "select portfolio_id, m, p + flow as rolled, abs(gross - (p + flow)) * 100 > 50 * gross as challenged from (select *, lag(gross) over (partition by portfolio_id order by m) as p from monthly) as x where p is not null"),
    "b17_04_reserves": ("instrument_id l, reserve l", "select instrument_id, case when sum(qty) > 1000 then IDIV(sum(amount) * 3, 100) when sum(qty) > 700 then IDIV(sum(amount) * 2, 100) else IDIV(sum(amount), 100) end as reserve from txn group by 1"),
    "b17_05_mark_verification": ("user_id l, a l, b l, exception b", "select user_id, a, b, abs(a - b) * 100 > 20 * a as exception from (select user_id, WHOLE(avg(case when provider = 'click' then v end)) as a, WHOLE(avg(case when provider = 'view' then v end)) as b from obs group by 1) as x where a is not null and b is not null"),
    "b17_06_what_if": ("class s, before_qty l, after_qty l", "with h as (select instrument_id, side * qty as q, 0 as extra from txn union all select instrument_id, 100, 1 from instrument where class = 'PROMO') select class, sum(case when extra = 0 then q else 0 end) as before_qty, sum(q) as after_qty from h join instrument on h.instrument_id = instrument.instrument_id group by 1"),
    "b17_10_grains": ("portfolio_id l, order_id l, multiple d", "select portfolio_id, order_id, sum(case when side = -1 then amount else 0 end) * 1.0 / sum(amount) as multiple from txn group by grouping sets ((portfolio_id), (portfolio_id, order_id))"),
    "b17_14_top_factor": ("segment s, top_issuer s, share d", "select segment, issuer as top_issuer, share from (select segment, issuer, mv * 1.0 / sum(mv) over (partition by segment) as share, row_number() over (partition by segment order by mv desc, issuer) as k from (select segment, issuer, sum(greatest(mv, 0)) as mv from valued join portfolio on valued.portfolio_id = portfolio.portfolio_id group by 1, 2) as x) as y where k = 1"),
    "b18_01_correcting_entries": ("order_id l, line l, posted l, reversed l, net l", "select order_id, line, sum(amount) as posted, sum(amount) - max(amount) as reversed, max(amount) as net from txn group by 1, 2 having count(*) > 1"),
    "b18_02_affirmation": ("field s, mismatches l", "with x as (select total, order_id from ord), l as (select order_id, sum(amount) as s, min(trade_date) as a, count(*) as n from txn group by 1) select 'amount' as field, sum(case when total <> s then 1 else 0 end) as mismatches from x join l on x.order_id = l.order_id union all select 'lines', sum(case when n > 7 then 1 else 0 end) from l"),
    "b18_04_income_type": ("kind s, n l, amount l", "select case when tax = 0 then 'exempt' when tax < 5 then 'reduced' else 'full' end as kind, count(*) as n, sum(amount) as amount from txn group by 1"),
    "b18_05_notice_checks": ("portfolio_id l, notices l, over_undrawn l", "select portfolio_id, count(*) as notices, sum(case when cum > 300000000 then 1 else 0 end) as over_undrawn from (select portfolio_id, sum(total) over (partition by portfolio_id order by order_date, order_id) as cum from ord) as x group by 1"),
    "b18_07_fee_offset": ("broker_id l, computed l, charged l, ok b", "select broker_id, sum(amount * tax) as computed, sum(amount * disc) as charged, abs(sum(amount * tax) - sum(amount * disc)) * 10 <= sum(amount * disc) as ok from txn group by 1"),
    "b18_08_compression": ("broker_id l, instrument_id l, gross l, net l", "select broker_id, instrument_id, sum(qty) as gross, sum(side * qty) as net from txn group by 1, 2 having count(*) > 1"),
    "b18_09_loan_book": ("broker_id l, open_loans l, recall l", "select broker_id, sum(case when line_status = 'O' then amount else 0 end) as open_loans, sum(case when line_status = 'O' and DAYS(date '2001-12-31', trade_date) > 365 then amount else 0 end) as recall from txn group by 1"),
    "b18_10_class_action": ("portfolio_id l, eligible l", "select portfolio_id, sum(qty) as eligible from txn where side = 1 and instrument_id % 10 = 3 and trade_date between date '1998-01-01' and date '1998-12-31' group by 1"),
    "b18_11_gate": ("m l, redemptions l, paid l, gated b", "select m, r as redemptions, case when r * 10 > g * 3 then IDIV(g * 3, 10) else r end as paid, r * 10 > g * 3 as gated from (select m, sum(case when flow < 0 then -flow else 0 end) as r, sum(gross) as g from monthly group by m) as x"),
    "b18_14_insider_window": ("instrument_id l, n l", "with w as (select 3 as k, date '1997-01-01' as a, date '1997-06-30' as z union all select 7, date '1999-01-01', date '1999-12-31') select instrument_id, count(*) as n from txn join w on instrument_id % 50 = k and trade_date between a and z group by 1"),
    "b18_15_velocity": ("user_id l, d t, n l, flagged b", "select user_id, d, n, n > 4 * av as flagged from (select user_id, d, n, avg(n) over (partition by user_id) as av from (select user_id, d, count(*) as n from obs group by 1, 2) as x) as y"),
    "b18_16_control_sample": ("y i, sampled l, failed l, rate d", "select year(order_date) as y, count(*) as sampled, sum(case when status = 'P' then 1 else 0 end) as failed, sum(case when status = 'P' then 1 else 0 end) * 1.0 / count(*) as rate from ord where (order_id * 7919) % 97 < 20 group by 1"),
    "b18_17_pipeline_sla": ("provider s, days_seen l, days_missed l, worst_hour i", "select provider, count(distinct d) as days_seen, 30 - count(distinct d) as days_missed, max(hour(ts)) as worst_hour from obs group by 1"),
    "b18_18_index_series": ("m l, lvl d", "select m, 100 * exp(sum(ln(p * 1.0 / q)) over (order by m)) as lvl from (select m, p, coalesce(lag(p) over (order by m), p) as q from (select m, sum(gross) as p from monthly group by m) as x) as y"),
    "b18_19_report": ("segment s, priority s, n l, total l", "select segment, priority, count(*) as n, sum(total) as total from ord join portfolio on ord.portfolio_id = portfolio.portfolio_id group by grouping sets ((segment), (priority), ())"),
    "b18_21_complaints": ("role s, turn l, n l", "select role, turn, count(*) as n from conversations group by rollup(role, turn)"),
    "b18_22_budget_variance": ("y i, plan l, actual l, variance l", "select y, plan, actual, actual - plan as variance from (select y, IDIV(sum(total) over (), 7) as plan, total as actual from (select year(order_date) as y, sum(total) as total from ord group by 1) as x) as z"),
    "b18_23_substantiation": ("order_id l, ledger l, subledger l, ok b", "with s as (select order_id, sum(amount) as s from txn group by 1) select coalesce(ord.order_id, s.order_id) as order_id, coalesce(total, 0) as ledger, coalesce(s, 0) as subledger, abs(coalesce(total, 0) - coalesce(s, 0)) <= 100 as ok from ord full outer join s on ord.order_id = s.order_id"),
}
