"""Identity, time, books and valuation (B1 to B4) as statements: name -> (columns, text)."""

STATEMENTS: dict[str, tuple[str, str]] = {
    "aum_by_region_and_class": ("region_name s, class s, level i, mv l, holdings l", """
        select region_name, class, cast(grouping(region_name) * 2 + grouping(class) as int) as level, sum(mv) as mv, count(*) as holdings
        from valued join portfolio on valued.portfolio_id = portfolio.portfolio_id group by rollup(region_name, class)"""),
    "b01_01_entity_resolution": ("party_id l, kind s, tier s, golden l", """
        with feed as (select party_id, kind, name, case when party_id % 3 = 0 then party_id end as ext, case when party_id % 3 = 1 then upper(name) when party_id % 3 = 2 then concat(name, '?') else name end as seen from party),
        gold as (select party_id as gold_id, kind as gold_kind, lower(RX(name, '[^A-Za-z0-9]', '')) as norm from party)
        select f.party_id, f.kind, case when e.gold_id is not null then 'external' when a.gold_id is not null then 'alias' else 'queue' end as tier, coalesce(e.gold_id, a.gold_id) as golden
        from feed f left join gold e on f.ext = e.gold_id and f.kind = e.gold_kind left join gold a on f.ext is null and f.party_id % 3 = 1 and lower(RX(f.seen, '[^A-Za-z0-9]', '')) = a.norm and f.kind = a.gold_kind"""),
    "b01_02_alias_accumulation": ("party_id l, alias s, first_seen i", """
        select party_id, alias, min(seen) as first_seen from (select party_id, name as alias, 1 as seen from party where kind = 'C' union all select party_id, lower(name), 2 from party where kind = 'C' union all select party_id, name, 3 from party where kind = 'C') as x group by party_id, alias"""),
    "b01_03_read_cache": ("broker_id l, issuers s, classes l", "select broker_id, CAT(issuer) as issuers, count(distinct class) as classes from txn join instrument on txn.instrument_id = instrument.instrument_id group by broker_id"),
    "b01_04_identifier_xref": ("nation l, by_name s, by_region s, by_number s", """
        select nation, max(case when scheme = 'name' then ident end) as by_name, max(case when scheme = 'region' then ident end) as by_region, max(case when scheme = 'number' then ident end) as by_number
        from (select nation, 'name' as scheme, nation_name as ident from place union all select nation, 'region', region_name from place union all select nation, 'number', cast(nation as varchar(20)) from place) as x group by nation"""),
    "b01_05_ultimate_parent": ("node s, root s, depth i", """
        with recursive edge as (select concat('S', cast(party_id as varchar(20))) as child, concat('N', cast(nation as varchar(20))) as parent from party where kind = 'S' union all select concat('N', cast(nation as varchar(20))), concat('R', cast(region as varchar(20))) from place),
        walk as (select child as node, parent as top, 1 as depth from edge union all select walk.node, edge.parent, walk.depth + 1 from walk join edge on walk.top = edge.child)
        select node, top as root, depth from walk where not exists (select 1 from edge where edge.child = walk.top)"""),
    "b01_06_hierarchy_rollup": ("ancestor s, total l, orders l", """
        with closure as (select portfolio_id, concat('N', cast(nation as varchar(20))) as ancestor from portfolio union all select portfolio_id, concat('R', cast(region as varchar(20))) from portfolio union all select portfolio_id, 'ALL' from portfolio)
        select ancestor, sum(total) as total, count(*) as orders from ord join closure on ord.portfolio_id = closure.portfolio_id group by ancestor"""),
    "b01_07_succession": ("portfolio_id l, live_order l, chain l", """
        select portfolio_id, max(case when nxt is null then order_id end) as live_order, count(*) as chain from (select portfolio_id, order_id, lead(order_id) over (partition by portfolio_id order by order_date, order_id) as nxt from ord) as x group by portfolio_id"""),
    "b01_08_correction_chain": ("order_id l, line l, statements l, amount l", """
        select order_id, line, n as statements, amount from (select order_id, line, amount, count(*) over (partition by order_id, line) as n, row_number() over (partition by order_id, line order by trade_date desc, instrument_id desc, broker_id desc, qty desc, amount desc) as k from txn) as x where k = 1"""),
    "b01_09_golden_source": ("user_id l, provider s, v l", """
        select user_id, provider, v from (select user_id, provider, v, row_number() over (partition by user_id order by case provider when 'purchase' then 1 when 'view' then 2 when 'click' then 3 else 4 end, ts desc, event_id desc) as k from obs) as x where k = 1"""),
    "b01_10_vendor_normalisation": ("code s, unit s, n l, units l", """
        with map as (select 'click' as provider, 'CLK' as code, 100 as factor union all select 'view', 'VEW', 1 union all select 'purchase', 'PUR', 10)
        select coalesce(code, 'UNK') as code, case when factor is null then 'raw' else 'scaled' end as unit, count(*) as n, sum(JSON_INT(props, k) * coalesce(factor, 1)) as units from obs left join map on obs.provider = map.provider group by 1, 2"""),
    "b01_11_faceted_owner": ("provider s, owner s, n l", """
        with owner_of as (select 'click' as facet, 'desk-1' as owner union all select 'view', 'desk-2' union all select 'purchase', 'desk-3')
        select provider, coalesce(owner, 'steward') as owner, count(*) as n from obs left join owner_of on provider = facet group by 1, 2"""),
    "b02_04_latest_view": ("user_id l, event_id l, v l", "select user_id, event_id, v from (select user_id, event_id, v, row_number() over (partition by user_id order by ts desc, event_id desc) as k from obs) as x where k = 1"),
    "b02_02_bitemporal": ("subject l, d t, event_id l, v l", """
        with s as (select event_id, user_id % 20 as subject, PLUS_DAYS(d, -(event_id % 3)) as eff, d as loaded, ts, v from obs)
        select subject, eff as d, event_id, v from (select *, row_number() over (partition by subject, eff order by loaded desc, ts desc, event_id desc) as k from s where loaded <= date '2024-01-20' and eff <= date '2024-01-15') as x where k = 1"""),
    "b02_07_confidence_tier": ("tier i, docs l", "select quality as tier, count(*) as docs from labels where quality in (1, 2) group by quality"),
    "b02_10_two_book": ("portfolio_id l, instrument_id l, ibor l, abor l, rows_ l", "select portfolio_id, instrument_id, sum(case when flag = 'N' then qty else 0 end) as ibor, sum(case when flag = 'A' then qty else 0 end) as abor, count(*) as rows_ from txn where flag <> 'R' group by 1, 2"),
    "b02_11_three_grain": ("grain s, n l, v l", """
        with x as (select v, case when event_id % 3 = 0 then user_id end as fund, case when event_id % 3 = 1 then user_id end as asset, case when event_id % 3 = 2 then user_id end as position from obs)
        select 'fund' as grain, count(*) as n, sum(v) as v from x where fund is not null and asset is null and position is null union all select 'asset', count(*), sum(v) from x where asset is not null and fund is null union all select 'position', count(*), sum(v) from x where position is not null and asset is null"""),
    "b02_12_ageing": ("bucket s, status s, n l, total l", """
        select case when a < 180 then 'fresh' when a < 720 then 'watch' when a < 1440 then 'stale' else 'escalate' end as bucket, status, count(*) as n, sum(total) as total from (select DAYS(date '2001-12-31', order_date) as a, status, total from ord where status = 'O') as x group by 1, 2"""),
    "b03_01_position_keeping": ("portfolio_id l, instrument_id l, trade_date t, position l, cost l", """
        select portfolio_id, instrument_id, trade_date, sum(q) over w as position, sum(c) over w as cost from (select portfolio_id, instrument_id, trade_date, sum(side * qty) as q, sum(side * amount) as c from txn group by 1, 2, 3) as x window w as (partition by portfolio_id, instrument_id order by trade_date rows between unbounded preceding and current row)"""),
    "b03_02_start_of_day": ("instrument_id l, trade_date t, opening l", """
        select instrument_id, trade_date, coalesce(sum(q) over (partition by instrument_id order by trade_date rows between unbounded preceding and 1 preceding), 0) as opening from (select instrument_id, trade_date, sum(side * qty) as q from txn group by 1, 2) as x"""),
    "b03_03_intraday_update": ("user_id l, d t, n l, total l", "select user_id, d, count(*) as n, sum(v) as total from obs group by user_id, d"),
    "b03_04_projected_cash": ("portfolio_id l, settle_date t, projected l", """
        select portfolio_id, settle_date, cash - sum(due) over (partition by portfolio_id order by settle_date) as projected from (select portfolio.portfolio_id, cash, PLUS_DAYS(order_date, 2) as settle_date, sum(total) as due from ord join portfolio on ord.portfolio_id = portfolio.portfolio_id where status in ('O', 'P') group by 1, 2, 3) as x"""),
    "b03_05_trade_vs_settle": ("m l, by_order l, by_ship l, gap l", """
        with a as (select year(order_date) * 12 + month(order_date) as m, sum(amount) as x from txn group by 1), b as (select year(trade_date) * 12 + month(trade_date) as m, sum(amount) as y from txn group by 1)
        select coalesce(a.m, b.m) as m, coalesce(x, 0) as by_order, coalesce(y, 0) as by_ship, coalesce(x, 0) - coalesce(y, 0) as gap from a full outer join b on a.m = b.m"""),
    "b03_06_gl_posting": ("order_id l, debits l, credits l, balanced b", """
        with legs as (select order_id, amount * 10000 as dr, 0 as cr from txn union all select order_id, 0, amount * disc * 100 from txn union all select order_id, 0, amount * (10000 - disc * 100) from txn)
        select order_id, sum(dr) as debits, sum(cr) as credits, sum(dr) = sum(cr) as balanced from legs group by order_id"""),
    "b03_07_book_close": ("instrument_id l, m l, closing l", "select instrument_id, m, sum(q) over (partition by instrument_id order by m) as closing from (select instrument_id, year(trade_date) * 12 + month(trade_date) as m, sum(side * qty) as q from txn group by 1, 2) as x"),
    "b03_09_cash_positioning": ("region_name s, nation_name s, cash l, accounts l", "select region_name, nation_name, sum(cash) as cash, count(*) as accounts from portfolio group by rollup(region_name, nation_name)"),
    "b03_10_liquidity_forecast": ("m l, net l, cumulative l, low l", """
        with f as (select year(trade_date) * 12 + month(trade_date) as m, sum(-side * amount) as net from txn group by 1), c as (select min(m) as a, max(m) as z from f), cal as (select RANGE(a, z) as m from c)
        select m, net, cumulative, min(cumulative) over (order by m) as low from (select cal.m, coalesce(net, 0) as net, sum(coalesce(net, 0)) over (order by cal.m) as cumulative from cal left join f on cal.m = f.m) as x"""),
    "b04_01_price_movement": ("user_id l, d t, move d, flag b", "select user_id, d, v * 1.0 / p - 1 as move, abs(v * 1.0 / p - 1) > 0.5 as flag from (select user_id, d, v, lag(v) over (partition by user_id order by d) as p from daily) as x where p > 0"),
    "b04_02_missing_price": ("user_id l, d t", """
        with c as (select DATE_RANGE(date '2024-01-01', date '2024-01-30') as d), u as (select distinct user_id from obs), g as (select user_id, d from u cross join c)
        select g.user_id, g.d from g left join daily on g.user_id = daily.user_id and g.d = daily.d where daily.v is null"""),
    "b04_02_stale_price": ("user_id l, d t, run l", """
        with x as (select user_id, d, case when IDIV(v, 1000) = lag(IDIV(v, 1000)) over (partition by user_id order by d) then 0 else 1 end as moved from daily),
        y as (select user_id, d, sum(moved) over (partition by user_id order by d) as island from x)
        select user_id, d, count(*) over (partition by user_id, island order by d) as run from y"""),
    "b04_03_matrix_pricing": ("size i, known l, interpolated d", """
        with k as (select size, case when size % 7 = 0 then null else WHOLE(avg(price)) end as p from instrument group by size),
        n as (select size, p, max(case when p is not null then size end) over (order by size rows between unbounded preceding and current row) as lo, min(case when p is not null then size end) over (order by size rows between current row and unbounded following) as hi from k)
        select n.size, n.p as known, coalesce(n.p * 1.0, a.p + (b.p - a.p) * (n.size - lo) * 1.0 / (hi - lo)) as interpolated from n left join k as a on n.lo = a.size left join k as b on n.hi = b.size"""),
    "b04_05_valuation": ("portfolio_id l, positions l, mv l, cost l, unrealised l", "select portfolio_id, count(*) as positions, sum(mv) as mv, sum(cost) as cost, sum(mv) - sum(cost) as unrealised from valued group by portfolio_id"),
    "b04_06_nav_strike": ("segment s, nav l, units l, per_unit d", """
        with a as (select portfolio_id, sum(mv) as mv from valued group by portfolio_id), f as (select portfolio_id, sum(IDIV(amount * disc, 10000)) as fee, sum(IDIV(amount * tax, 10000)) as accrued from txn group by portfolio_id)
        select segment, sum(coalesce(mv, 0) + cash + coalesce(accrued, 0) - coalesce(fee, 0)) as nav, count(*) * 1000 as units, sum(coalesce(mv, 0) + cash + coalesce(accrued, 0) - coalesce(fee, 0)) * 1.0 / (count(*) * 1000) as per_unit from portfolio left join a on portfolio.portfolio_id = a.portfolio_id left join f on portfolio.portfolio_id = f.portfolio_id group by segment"""),
    "b04_07_nav_tolerance": ("segment s, m l, nav l, verdict s", """
        with x as (select segment, m, sum(gross) as nav from monthly join portfolio on monthly.portfolio_id = portfolio.portfolio_id group by 1, 2)
        select segment, m, nav, case when p is null then 'first' when abs(nav - p) * 100 > 25 * p then 'hold' else 'approved' end as verdict from (select *, lag(nav) over (partition by segment order by m) as p from x) as y"""),
    "b04_08_swing": ("m l, flow l, gross l, factor d", "select m, flow, gross, case when abs(flow) * 100 > 40 * gross then 1.0 + case when flow > 0 then 0.002 else -0.002 end else 1.0 end as factor from (select m, sum(flow) as flow, sum(gross) as gross from monthly group by m) as x"),
    "b04_09_multi_lens": ("user_id l, d t, clicks l, views l, purchases l, spread l", """
        select user_id, d, clicks, views, purchases, greatest(clicks, views, purchases) - least(clicks, views, purchases) as spread from (select user_id, d, sum(case when provider = 'click' then v else 0 end) as clicks, sum(case when provider = 'view' then v else 0 end) as views, sum(case when provider = 'purchase' then v else 0 end) as purchases from obs group by 1, 2) as x"""),
    "b04_10_fair_value_levels": ("class s, fv_level i, n l, share d", """
        select class, fv_level, n, price * 1.0 / sum(price) over (partition by class) as share from (select class, case when size <= 15 then 1 when size <= 35 then 2 else 3 end as fv_level, count(*) as n, sum(price) as price from instrument group by 1, 2) as x"""),
    "b04_11_mark_backtest": ("instrument_id l, exits l, median_ratio d", "select txn.instrument_id, count(*) as exits, QUANTILE(amount * 1.0 / (qty * price), 0.5) as median_ratio from txn join instrument on txn.instrument_id = instrument.instrument_id where side = -1 group by 1"),
    "b04_12_price_verification": ("instrument_id l, n l, median_price d, worst d", """
        with p as (select instrument_id, amount * 1.0 / qty as u from txn), m as (select instrument_id, QUANTILE(u, 0.5) as med, count(*) as n from p group by 1)
        select p.instrument_id, n, med as median_price, max(abs(u - med) / med) as worst from p join m on p.instrument_id = m.instrument_id group by 1, 2, 3"""),
    "b04_13_capital_roll_forward": ("portfolio_id l, y i, opening l, called l, returned l, closing l", """
        with x as (select portfolio_id, year(trade_date) as y, sum(case when side = 1 then amount else 0 end) as called, sum(case when side = -1 then amount else 0 end) as returned from txn group by 1, 2)
        select portfolio_id, y, sum(called - returned) over (partition by portfolio_id order by y) - called + returned as opening, called, returned, sum(called - returned) over (partition by portfolio_id order by y) as closing from x"""),
    "b04_14_equalisation": ("portfolio_id l, units l, income l, equalised l", "select portfolio_id, sum(qty) as units, sum(IDIV(amount * tax, 100)) as income, sum(qty * (DAYS(date '2002-01-01', trade_date))) as equalised from txn where side = 1 group by 1"),
    "b02_03_version_closing": ("portfolio_id l, order_id l, effective_from t, effective_to t, priority s", "select portfolio_id, order_id, order_date as effective_from, lead(order_date) over (partition by portfolio_id order by order_date, order_id) as effective_to, priority from ord"),
}
