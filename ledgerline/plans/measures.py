"""Performance, appraisal, private markets, exposure and risk (B5 to B10) as statements: name -> (columns, text)."""

MOMENTS = "select user_id, count(*) as n, avg(r) as mean, stddev_samp(r) as sd, avg(m) as mm, covar_samp(r, m) as cv, var_samp(m) as vm, corr(r, m) as rho from paired group by user_id having count(*) > 5"

STATEMENTS: dict[str, tuple[str, str]] = {
    "b05_01_twr": ("user_id l, n l, twr d", "select user_id, count(*) as n, LINK(1 + r) - 1 as twr from rets group by user_id"),
    "b05_04_period_returns": ("user_id l, wk i, week_return d, to_date d", """
        with w as (select user_id, cast(IDIV(DAYS(d, date '2024-01-01'), 7) as int) as wk, sum(ln(1 + r)) as lr from rets group by 1, 2)
        select user_id, wk, exp(lr) - 1 as week_return, exp(sum(lr) over (partition by user_id order by wk)) - 1 as to_date from w"""),
    "b05_05_gross_net": ("instrument_id l, gross d, net d, drag d", "select txn.instrument_id, sum(amount) * 1.0 / sum(qty * price) - 1 as gross, sum(amount * (100 - disc)) / 100.0 / sum(qty * price) - 1 as net, sum(amount * disc) / 100.0 / sum(qty * price) as drag from txn join instrument on txn.instrument_id = instrument.instrument_id group by 1"),
    "b05_06_composite": ("grp l, d t, composite d, members l", "with x as (select rets.user_id, rets.d, r, w - v as base from rets join wealth on rets.user_id = wealth.user_id and rets.d = wealth.d) select user_id % 5 as grp, d, RATIO(sum(base * r), sum(base)) as composite, count(*) as members from x group by 1, 2"),
    "b05_07_currency_decomposition": ("nation l, local_r d, fx_r d, cross_r d, total_r d", "select nation, l as local_r, f as fx_r, l * f as cross_r, (1 + l) * (1 + f) - 1 as total_r from (select nation, avg(balance) / 10000000.0 as l, (nation % 7 - 3) / 100.0 as f from party group by nation) as x"),
    "b05_08_return_to_book": ("user_id l, breaks l, worst d", "select x.user_id, count(*) as breaks, max(abs(r * (w - v) - v)) as worst from rets as x join wealth on x.user_id = wealth.user_id and x.d = wealth.d group by 1"),
    "b05_09_blended_benchmark": ("d t, blended d", "select d, 0.6 * max(case when k = 0 then r end) + 0.4 * max(case when k = 1 then r end) as blended from (select d, user_id % 2 as k, avg(r) as r from rets group by 1, 2) as x group by d"),
    "b05_10_index_weights": ("class s, members l, total d, ok b", "select class, count(*) as members, sum(w) as total, abs(sum(w) - 1) < 0.000001 as ok from (select class, price * 1.0 / sum(price) over (partition by class) as w from instrument) as x group by class"),
    "b05_11_brinson": ("segment s, allocation d, selection d, interaction d", """
        with x as (select segment, class, sum(mv) as mv, sum(cost) as cost from valued join portfolio on valued.portfolio_id = portfolio.portfolio_id group by 1, 2),
        p as (select segment, class, mv * 1.0 / sum(mv) over (partition by segment) as wp, mv * 1.0 / cost - 1 as rp from x where cost > 0), b as (select class, sum(mv) * 1.0 / sum(sum(mv)) over () as wb, sum(mv) * 1.0 / sum(cost) - 1 as rb from x where cost > 0 group by class),
        t as (select sum(wb * rb) as rt from b)
        select segment, sum((wp - wb) * (rb - rt)) as allocation, sum(wb * (rp - rb)) as selection, sum((wp - wb) * (rp - rb)) as interaction from p join b on p.class = b.class cross join t group by segment"""),
    "b05_12_factor_regression": ("user_id l, beta d, alpha d, r2 d", "select user_id, SLOPE(r, m) as beta, INTERCEPT(r, m) as alpha, regr_r2(r, m) as r2 from paired group by user_id having count(*) > 5"),
    "b05_14_multi_level": ("region_name s, nation_name s, flow l, gross l", "select region_name, nation_name, sum(flow) as flow, sum(gross) as gross from monthly join portfolio on monthly.portfolio_id = portfolio.portfolio_id group by rollup(region_name, nation_name)"),
    "b06_01_tracking_error": ("user_id l, te d, ir d", "select user_id, stddev_samp(r - m) as te, RATIO(avg(r - m), stddev_samp(r - m)) as ir from paired group by user_id having count(*) > 5"),
    "b06_02_alpha_beta": ("user_id l, beta d, alpha d, treynor d", f"select user_id, RATIO(cv, vm) as beta, mean - RATIO(cv, vm) * mm as alpha, RATIO(mean, (RATIO(cv, vm))) as treynor from ({MOMENTS}) as x where abs(cv) > 0.000001"),
    "b06_03_sharpe": ("user_id l, sharpe d, m2 d", f"select user_id, RATIO((mean - 0.0001), sd) as sharpe, 0.0001 + RATIO((mean - 0.0001), sd) * sqrt(vm) as m2 from ({MOMENTS}) as x"),
    "b06_04_sortino": ("user_id l, sortino d", "select user_id, RATIO((avg(r) - 0.05), sqrt(avg(power(least(r - 0.05, 0), 2)))) as sortino from rets group by user_id having min(r) < 0.04"),
    "b06_05_drawdown": ("user_id l, max_drawdown d, peak l, under l", """
        with x as (select user_id, d, v, max(v) over (partition by user_id order by d) as hwm from daily) select user_id, min(RATIO(v * 1.0, hwm) - 1) as max_drawdown, max(hwm) as peak, sum(case when v < hwm then 1 else 0 end) as under from x group by user_id"""),
    "b06_06_capture": ("user_id l, up d, down d", "select user_id, RATIO(avg(case when m > a then r end), avg(case when m > a then m end)) as up, RATIO(avg(case when m <= a then r end), avg(case when m <= a then m end)) as down from paired cross join (select avg(m) as a from market) as x group by user_id having count(*) > 5"),
    "b06_07_skill": ("user_id l, t_stat d, adequate b", "select user_id, RATIO(avg(r - m), (stddev_samp(r - m) / sqrt(count(*)))) as t_stat, count(*) >= 20 as adequate from paired group by user_id having count(*) > 5"),
    "b06_09_high_water_mark": ("user_id l, d t, hwm l, excess l", "select user_id, d, hwm, greatest(0, v - coalesce(lag(hwm) over (partition by user_id order by d), 0)) as excess from (select user_id, d, v, max(v) over (partition by user_id order by d) as hwm from daily) as x"),
    "b07_01_paid_in": ("portfolio_id l, committed l, paid_in l, recallable l, unfunded l", "select portfolio_id, sum(amount) * 2 as committed, sum(case when side = 1 then amount else 0 end) as paid_in, sum(case when side = -1 and line_status = 'O' then amount else 0 end) as recallable, sum(amount) * 2 - sum(case when side = 1 then amount else 0 end) + sum(case when side = -1 and line_status = 'O' then amount else 0 end) as unfunded from txn group by 1"),
    "b07_02_multiples": ("portfolio_id l, dpi d, rvpi d, tvpi d", """
        with f as (select portfolio_id, sum(case when side = 1 then amount else 0 end) as paid, sum(case when side = -1 then amount else 0 end) as dist from txn group by 1), n as (select portfolio_id, sum(mv) as nav from valued group by 1)
        select f.portfolio_id, dist * 1.0 / paid as dpi, coalesce(nav, 0) * 1.0 / paid as rvpi, (dist + coalesce(nav, 0)) * 1.0 / paid as tvpi from f left join n on f.portfolio_id = n.portfolio_id where paid > 0"""),
    "b07_06_j_curve": ("portfolio_id l, trough l, trough_m l, final l", """
        with c as (select portfolio_id, m, -sum(flow) over (partition by portfolio_id order by m) as cum from monthly)
        select portfolio_id, max(case when k = 1 then cum end) as trough, max(case when k = 1 then m end) as trough_m, max(case when z = 1 then cum end) as final from (select *, row_number() over (partition by portfolio_id order by cum, m) as k, row_number() over (partition by portfolio_id order by m desc) as z from c) as x group by 1"""),
    "b07_08_overcommitment": ("scenario s, m l, net l", "with s as (select 'base' as scenario, 100 as up, 100 as down union all select 'late', 60, 100 union all select 'crisis', 40, 130) select scenario, m, sum(case when flow < 0 then IDIV(-flow * up, 100) else -IDIV(flow * down, 100) end) as net from monthly cross join s group by 1, 2"),
    "b07_09_vintage": ("y i, committed l, share d, in_plan b", "select y, committed, committed * 1.0 / sum(committed) over () as share, committed * 100 between 10 * sum(committed) over () and 20 * sum(committed) over () as in_plan from (select year(order_date) as y, sum(total) as committed from ord group by 1) as x"),
    "b07_10_waterfall": ("portfolio_id l, capital l, preferred l, catch_up l, lp_split l, gp_split l", """
        with f as (select portfolio_id, sum(case when side = 1 then amount else 0 end) as paid, sum(case when side = -1 then amount else 0 end) * 2 as dist from txn group by 1),
        a as (select *, least(dist, paid) as capital from f), b as (select *, least(dist - capital, IDIV(paid * 8, 100)) as preferred from a), c as (select *, least(dist - capital - preferred, IDIV(preferred, 4)) as catch_up from b), e as (select *, dist - capital - preferred - catch_up as rest from c)
        select portfolio_id, capital, preferred, catch_up, rest - IDIV(rest * 20, 100) as lp_split, IDIV(rest * 20, 100) as gp_split from e"""),
    "b07_11_clawback": ("portfolio_id l, taken l, entitled l, clawback l", "select portfolio_id, taken, entitled, greatest(0, taken - entitled) as clawback from (select portfolio_id, sum(case when side = -1 then IDIV(amount * 20, 100) else 0 end) as taken, greatest(0, IDIV(sum(-side * amount) * 20, 100)) as entitled from txn group by 1) as x"),
    "b08_01_exposure_cube": ("class s, segment s, region_name s, mv l", "select class, segment, region_name, sum(mv) as mv from valued join portfolio on valued.portfolio_id = portfolio.portfolio_id group by cube(class, segment, region_name)"),
    "b08_02_concentration": ("portfolio_id l, hhi d, top3 d, effective d", """
        with w as (select portfolio_id, instrument_id, mv * 1.0 / sum(mv) over (partition by portfolio_id) as w, row_number() over (partition by portfolio_id order by mv desc, instrument_id) as k from valued where mv > 0)
        select portfolio_id, sum(w * w) as hhi, sum(case when k <= 3 then w else 0 end) as top3, 1 / sum(w * w) as effective from w group by 1"""),
    "b08_05_overlap": ("instrument_id l, vehicles l", "select instrument_id, count(distinct portfolio_id) as vehicles from valued group by 1 having count(distinct portfolio_id) > 1"),
    "b08_06_threshold": ("issuer s, mv l, share d", "select issuer, mv, mv * 1.0 / total as share from (select issuer, sum(mv) as mv, sum(sum(mv)) over () as total from valued group by issuer) as x where mv * 100 > 4 * total"),
    "b08_07_group_issuer": ("class s, issuer s, mv l, group_mv l", "select class, issuer, mv, sum(mv) over (partition by class) as group_mv from (select class, issuer, sum(mv) as mv from valued group by 1, 2) as x"),
    "b08_08_counterparty": ("broker_id l, netted b, exposure l", "select broker_id, broker_id % 4 <> 0 as netted, case when broker_id % 4 <> 0 then greatest(sum(side * amount), 0) else sum(greatest(side * amount, 0)) end - max(IDIV(balance, 10)) as exposure from txn join party on broker_id = party_id and kind = 'S' group by 1, 2"),
    "b09_01_var_es": ("user_id l, var d, es d", "with q as (select user_id, QUANTILE(r, 0.05) as var from rets group by 1) select rets.user_id, var, avg(case when r <= var then r end) as es from rets join q on rets.user_id = q.user_id group by 1, 2"),
    "b09_02_parametric_var": ("user_id l, var d", "select user_id, avg(r) - 1.645 * stddev_samp(r) as var from rets group by 1 having count(*) > 5"),
    "b09_04_var_backtest": ("user_id l, exceptions l, expected d", "with q as (select user_id, QUANTILE(r, 0.1) as var from rets where d < date '2024-01-16' group by 1) select rets.user_id, sum(case when r < var then 1 else 0 end) as exceptions, count(*) * 0.1 as expected from rets join q on rets.user_id = q.user_id where d >= date '2024-01-16' group by 1"),
    "b09_06_desmoothing": ("user_id l, d t, unsmoothed d", """
        with x as (select user_id, d, r, lag(r) over (partition by user_id order by d) as p from rets), c as (select user_id, CORR(r, p) as rho from x group by 1 having count(p) > 4)
        select x.user_id, d, (r - rho * p) / (1 - rho) as unsmoothed from x join c on x.user_id = c.user_id where p is not null and abs(rho) < 0.9"""),
    "b09_07_risk_contribution": ("a l, contribution d", """
        with x as (select d, user_id % 4 as a, avg(r) as r from rets group by 1, 2), c as (select x.a as a, y.a as b, covar_samp(x.r, y.r) as cv from x join x as y on x.d = y.d group by 1, 2)
        select a, RATIO(sum(cv), (select sum(cv) from c)) as contribution from c group by a"""),
    "b09_09_migration": ("was s, now s, n l", "select was, now, count(*) as n from (select lag(priority) over (partition by portfolio_id order by order_date, order_id) as was, priority as now from ord) as x where was is not null group by 1, 2"),
    "b09_10_liquidity_tier": ("tier i, positions l, mv l", "with v as (select instrument_id, sum(qty) * 1.0 / count(distinct trade_date) as adv from txn group by 1) select case when abs(qty) <= adv then 1 when abs(qty) <= 3 * adv then 2 when abs(qty) <= 10 * adv then 3 else 4 end as tier, count(*) as positions, sum(mv) as mv from valued join v on valued.instrument_id = v.instrument_id group by 1"),
    "b09_11_stress": ("scenario s, segment s, loss l", "with s as (select 'rates' as scenario, 'ECONOMY' as hit, 12 as pct union all select 'credit', 'PROMO', 25 union all select 'all', null, 7) select scenario, segment, sum(IDIV(greatest(mv, 0) * pct, 100)) as loss from valued join portfolio on valued.portfolio_id = portfolio.portfolio_id join s on hit is null or hit = class group by 1, 2"),
    "b09_14_escalation": ("priority s, open_items l, over_year l", "select priority, sum(case when status = 'O' then 1 else 0 end) as open_items, sum(case when status = 'O' and DAYS(date '2001-12-31', order_date) > 365 then 1 else 0 end) as over_year from ord group by 1"),
    "b10_01_pre_trade": ("order_id l, rules_failed l, verdict s", """
        with r as (select 'size' as rule_id, 40000000 as cap union all select 'cash', 30000000), j as (select order_id, rule_id, case when rule_id = 'size' then total > cap else total - cash > cap end as failed from ord join portfolio on ord.portfolio_id = portfolio.portfolio_id cross join r)
        select order_id, sum(case when failed then 1 else 0 end) as rules_failed, case when max(case when failed then 1 else 0 end) = 1 then 'fail' else 'pass' end as verdict from j group by 1"""),
    "b10_02_sweep": ("portfolio_id l, rule_id s, ok b", "with r as (select 'long_only' as rule_id union all select 'top_issuer'), p as (select portfolio_id, min(mv) as low, max(mv) as high, sum(abs(mv)) as gross from valued group by 1) select portfolio_id, rule_id, case when rule_id = 'long_only' then low >= 0 else high * 100 <= 40 * gross end as ok from p cross join r"),
    "b10_05_esg_screen": ("lang s, docs l, flagged l, share d", "select lang, count(*) as docs, sum(toxic) as flagged, sum(toxic) * 1.0 / count(*) as share from documents join labels on documents.doc_id = labels.doc_id group by lang"),
    "b10_06_mfn": ("instrument_id l, best i, below_best l", "select instrument_id, best, sum(case when disc < best then 1 else 0 end) as below_best from (select instrument_id, disc, max(disc) over (partition by instrument_id) as best from txn) as x group by 1, 2"),
}
