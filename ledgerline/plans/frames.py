"""Queries built with DataFrame operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.hierarchy import look_through
from ..operators.lots import relieve
from ..operators.reconcile import allocate, reconcile
from ..operators.returns import compile_metric
from ..operators.temporal import as_of_join, close_versions, effective_at, episodes, latest, restatements, with_unknown
from ..streaming import replay
from .dialect import Query, expand, frame

VERSIONS = "select portfolio_id, priority, order_date as effective_from, lead(order_date) over (partition by portfolio_id order by order_date, order_id) as effective_to from ord"
LOTS = """
with b as (select instrument_id, order_id, trade_date, amount, qty, sum(qty) over (partition by instrument_id order by KEYS trade_date, order_id, line, broker_id, amount, qty rows between unbounded preceding and current row) as z from txn where side = 1),
s as (select instrument_id, trade_date, amount, qty, sum(qty) over (partition by instrument_id order by trade_date, order_id, line, broker_id, amount, qty rows between unbounded preceding and current row) as z from txn where side = -1),
m as (select b.instrument_id, least(b.z, s.z) - greatest(b.z - b.qty, s.z - s.qty) as q, b.amount as ba, b.qty as bq, s.amount as sa, s.qty as sq from b join s on b.instrument_id = s.instrument_id and b.z - b.qty < s.z and s.z - s.qty < b.z)
select instrument_id, count(*) as pieces, sum(q) as matched, sum(IDIV(sa * q, sq) - IDIV(ba * q, bq)) as gain from m group by instrument_id"""


def _lots(view, order):
    txn = view("txn")
    tie = ["trade_date", "order_id", "line", "broker_id", "amount", "qty"]
    met = relieve(txn.filter("side = 1"), txn.filter("side = -1"), ["instrument_id"], "qty", [*order, *tie], tie)
    gain = F.expr("(sale_amount * matched) div sale_qty - (lot_amount * matched) div lot_qty")
    return met.groupBy("instrument_id").agg(F.count("*").alias("pieces"), F.sum("matched").alias("matched"), F.sum(gain).alias("gain"))


LOT_COLUMNS = "instrument_id l, pieces l, matched l, gain l"


def _lot_query(order, keys: str) -> Query:
    return frame(LOT_COLUMNS, lambda spark, view: _lots(view, order()), LOTS.replace("KEYS", keys))


def _prices(view):
    return view("txn").groupBy("instrument_id", "trade_date").agg(F.max("amount").alias("price_amount"))


def _effective(spark, view):
    v = close_versions(view("ord").withColumnRenamed("order_date", "effective_from"), ["portfolio_id"], "effective_from", ["order_id"]).select("portfolio_id", "priority", "effective_from", "effective_to")
    facts = view("txn").select("portfolio_id", "order_id", "line", "trade_date", "instrument_id", "broker_id", "qty", "amount")
    return effective_at(facts, v, ["portfolio_id"], "trade_date").groupBy("priority").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def _look(spark, view):
    ownership = view("txn").filter("side = 1").groupBy("portfolio_id", "order_id", "instrument_id").agg(F.sum("qty").alias("q"))
    first = ownership.groupBy("portfolio_id", "order_id").agg(F.sum("q").alias("q"))
    total = first.groupBy("portfolio_id").agg(F.sum("q").alias("t"))
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    a = first.join(total, "portfolio_id").select(name("P", "portfolio_id").alias("owner"), name("O", "order_id").alias("owned"), (F.col("q") / F.col("t")).alias("weight"))
    b = ownership.join(first.select("order_id", F.col("q").alias("t")), "order_id").select(name("O", "order_id").alias("owner"), name("I", "instrument_id").alias("owned"), (F.col("q") / F.col("t")).alias("weight"))
    return look_through(a.unionByName(b), a.select(F.col("owner").alias("root")).distinct())


def _stream(build, mode="complete"):
    return lambda spark, sf_dir: replay.finished(build(replay.events(spark, f"{sf_dir}/events.parquet")), mode)


def _raw(build, columns: str, oracle: str) -> Query:
    own = dict(c.split() for c in columns.split(","))
    kinds = {"l": "bigint", "s": "string", "i": "int"}
    return Query(lambda spark, sf_dir: build(spark, sf_dir).selectExpr(*[f"cast({n} as {kinds[k]}) as {n}" for n, k in own.items()]), expand(oracle, columns, 1))


QUERIES: dict[str, Query] = {
    "b02_01_effective_dated": frame("priority s, n l, amount l", _effective, f"with v as ({VERSIONS}) select priority, count(*) as n, sum(amount) as amount from txn left join v on txn.portfolio_id = v.portfolio_id and effective_from <= trade_date and (effective_to is null or trade_date < effective_to) group by priority"),
    "b02_05_restatement": frame("order_id l, line l, trade_date t, previous l, amount l", lambda spark, view: restatements(view("txn").groupBy("order_id", "line", "trade_date").agg(F.max("amount").alias("amount")), ["order_id", "line"], ["trade_date"], "amount"), "select order_id, line, trade_date, previous, amount from (select order_id, line, trade_date, a as amount, lag(a) over (partition by order_id, line order by trade_date) as previous from (select order_id, line, trade_date, max(amount) as a from txn group by 1, 2, 3) as x) as y where previous <> amount"),
    "b02_06_unknown_member": frame("member l, docs l, chars l", lambda spark, view: with_unknown(view("documents"), view("labels"), "doc_id").groupBy((F.when(F.col("member") < 0, -1).otherwise(F.col("member") % 10)).alias("member")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars")), "with l as (select distinct doc_id as k from labels) select case when k is null then -1 else k % 10 end as member, count(*) as docs, sum(n_chars) as chars from documents left join l on doc_id = k group by 1"),
    "b02_08_threshold_at_date": frame("user_id l, event_id l, v l, threshold l", lambda spark, view: as_of_join(view("obs").filter("provider = 'purchase'").select("user_id", "event_id", "ts", "v"), view("obs").filter("provider = 'view'").groupBy("user_id", "ts").agg(F.max("v").alias("threshold")), ["user_id"], "ts", "ts", ["threshold"]), "select user_id, event_id, v, (select max(b.v) from obs as b where b.user_id = a.user_id and b.provider = 'view' and b.ts = (select max(c.ts) from obs as c where c.user_id = a.user_id and c.provider = 'view' and c.ts <= a.ts)) as threshold from obs as a where provider = 'purchase'"),
    "b02_09_record_date": frame("instrument_id l, record_date t, entitled l", lambda spark, view: as_of_join(view("instrument").select("instrument_id", F.expr("date '1999-12-31'").alias("record_date")), view("txn").groupBy("instrument_id", "trade_date").agg(F.sum(F.expr("side * qty")).alias("q")).selectExpr("instrument_id", "trade_date", "sum(q) over (partition by instrument_id order by trade_date) as entitled"), ["instrument_id"], "record_date", "trade_date", ["entitled"]), "select instrument_id, date '1999-12-31' as record_date, (select sum(side * qty) from txn where txn.instrument_id = instrument.instrument_id and trade_date <= date '1999-12-31') as entitled from instrument"),
    "b08_04_look_through": frame("root s, leaf s, weight d", _look, "with o as (select portfolio_id, order_id, instrument_id, sum(qty) as q from txn where side = 1 group by 1, 2, 3), f as (select portfolio_id, order_id, sum(q) as q from o group by 1, 2), t as (select portfolio_id, sum(q) as t from f group by 1) select concat('P', cast(o.portfolio_id as varchar(20))) as root, concat('I', cast(instrument_id as varchar(20))) as leaf, sum(f.q * 1.0 / t.t * (o.q * 1.0 / f.q)) as weight from o join f on o.order_id = f.order_id join t on o.portfolio_id = t.portfolio_id group by 1, 2"),
    "b09_13_breach_episodes": frame("user_id l, episode l, first_day t, last_day t, days l", lambda spark, view: episodes(view("daily"), ["user_id"], ["d"], F.col("v") > 12000).groupBy("user_id", "episode").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("days")), "with x as (select user_id, d, v > 12000 as f, coalesce(lag(v > 12000) over (partition by user_id order by d), false) as p from daily), y as (select *, sum(case when f and not p then 1 else 0 end) over (partition by user_id order by d) as episode from x) select user_id, episode, min(d) as first_day, max(d) as last_day, count(*) as days from y where f group by 1, 2"),
    "b11_02_pro_rata": frame("order_id l, share l, lines l", lambda spark, view: allocate(view("txn").withColumn("pot", F.lit(100001)), ["order_id"], "qty", "pot", ["line", "instrument_id", "broker_id", "trade_date", "amount"]).groupBy("order_id").agg(F.max("share").alias("share"), F.count("*").alias("lines")), "with x as (select order_id, qty, IDIV(100001 * qty, sum(qty) over (partition by order_id)) as s, row_number() over (partition by order_id order by qty desc, line, instrument_id, broker_id, trade_date, amount) as k from txn), y as (select order_id, s + case when k = 1 then 100001 - sum(s) over (partition by order_id) else 0 end as s from x) select order_id, max(s) as share, count(*) as lines from y group by 1"),
    "b12_01_reconciliation": frame("instrument_id l, left_value l, right_value l, difference l, cause s", lambda spark, view: reconcile(view("txn").filter("flag = 'A'").groupBy("instrument_id").agg(F.sum("qty").alias("q")), view("txn").filter("flag = 'N'").groupBy("instrument_id").agg(F.sum("qty").alias("q")), ["instrument_id"], "q", 25), "with a as (select instrument_id, sum(qty) as x from txn where flag = 'A' group by 1), b as (select instrument_id, sum(qty) as y from txn where flag = 'N' group by 1) select coalesce(a.instrument_id, b.instrument_id) as instrument_id, x as left_value, y as right_value, coalesce(x, 0) - coalesce(y, 0) as difference, case when x is null then 'missing_left' when y is null then 'missing_right' when abs(x - y) > 25 then 'break' when x <> y then 'within_tolerance' else 'match' end as cause from a full outer join b on a.instrument_id = b.instrument_id"),
    "b12_12_expense_allocation": frame("y i, portfolio_id l, share l", lambda spark, view: allocate(view("ord").groupBy(F.year("order_date").alias("y"), "portfolio_id").agg(F.sum("total").alias("w")).withColumn("pot", F.lit(1000003)), ["y"], "w", "pot", ["portfolio_id"]), "with x as (select year(order_date) as y, portfolio_id, sum(total) as w from ord group by 1, 2), s as (select y, portfolio_id, IDIV(1000003 * w, sum(w) over (partition by y)) as s, row_number() over (partition by y order by w desc, portfolio_id) as k from x) select y, portfolio_id, s + case when k = 1 then 1000003 - sum(s) over (partition by y) else 0 end as share from s"),
    "b12_13_lots_fifo": _lot_query(lambda: [], ""),
    "b12_13_lots_lifo": _lot_query(lambda: [F.desc("trade_date")], "trade_date desc,"),
    "b12_13_lots_hifo": _lot_query(lambda: [F.expr("amount div qty").desc()], "IDIV(amount, qty) desc,"),
    "b12_17_lots_to_holding": frame("instrument_id l, bought l, relieved l, open_qty l", lambda spark, view: view("txn").filter("side = 1").groupBy("instrument_id").agg(F.sum("qty").alias("bought")).join(_lots(view, []).select("instrument_id", F.col("matched").alias("relieved")), "instrument_id", "left").withColumn("relieved", F.coalesce("relieved", F.lit(0))).withColumn("open_qty", F.col("bought") - F.col("relieved")), "with b as (select instrument_id, sum(case when side = 1 then qty else 0 end) as bought, sum(case when side = -1 then qty else 0 end) as sold from txn group by 1) select instrument_id, bought, least(bought, sold) as relieved, bought - least(bought, sold) as open_qty from b where bought > 0"),
    "b15_06_metric_formula": frame("segment s, value d", lambda spark, view: view("ord").join(view("portfolio"), "portfolio_id").groupBy("segment").agg(compile_metric('{"op": "div", "args": [{"op": "sum", "args": [{"op": "mul", "args": [{"col": "total"}, {"value": 3}]}]}, {"op": "count", "args": [{"col": "order_id"}]}]}').alias("value")), "select segment, sum(total * 3) * 1.0 / count(ord.order_id) as value from ord join portfolio on ord.portfolio_id = portfolio.portfolio_id group by segment"),
    "b18_03_custody": frame("broker_id l, left_value l, right_value l, difference l, cause s", lambda spark, view: reconcile(view("txn").groupBy("broker_id").agg(F.sum("qty").alias("q")), view("txn").filter("line_status = 'F'").groupBy("broker_id").agg((F.sum("qty") * 2).alias("q")), ["broker_id"], "q", 300), "with a as (select broker_id, sum(qty) as x from txn group by 1), b as (select broker_id, sum(qty) * 2 as y from txn where line_status = 'F' group by 1) select coalesce(a.broker_id, b.broker_id) as broker_id, x as left_value, y as right_value, coalesce(x, 0) - coalesce(y, 0) as difference, case when x is null then 'missing_left' when y is null then 'missing_right' when abs(x - y) > 300 then 'break' when x <> y then 'within_tolerance' else 'match' end as cause from a full outer join b on a.broker_id = b.broker_id"),
    "b18_12_tax_records": frame("instrument_id l, left_value l, right_value l, difference l, cause s", lambda spark, view: reconcile(_lots(view, []), view("txn").filter("side = -1").groupBy("instrument_id").agg(F.sum("qty").alias("matched")), ["instrument_id"], "matched", 0), "with t as (select instrument_id, sum(case when side = 1 then qty else 0 end) as b, sum(case when side = -1 then qty else 0 end) as s from txn group by 1) select instrument_id, case when least(b, s) > 0 then least(b, s) end as left_value, case when s > 0 then s end as right_value, least(b, s) - s as difference, case when s = 0 then 'x' when least(b, s) = 0 then 'missing_left' when least(b, s) <> s then 'break' else 'match' end as cause from t where s > 0"),
    "stream_tumbling": _raw(_stream(replay.tumbling), "event_type s, n l, v l", "select provider as event_type, count(*) as n, sum(v) as v from obs group by date_trunc('hour', ts), provider"),
    "stream_sessions": _raw(_stream(replay.sessions), "user_id l, n l", "with x as (select user_id, ts, event_id, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 2 hours then 1 else 0 end as fresh from obs), y as (select user_id, sum(fresh) over (partition by user_id order by ts, event_id) as k from x) select user_id, count(*) as n from y group by user_id, k"),
    "stream_positions": _raw(_stream(replay.positions), "user_id l, n l, v l", "select user_id, count(*) as n, sum(v) as v from obs group by user_id"),
}
