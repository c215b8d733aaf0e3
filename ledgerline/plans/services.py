"""Searching, matching, screening, linking and monitoring: services built with operators over the canonical views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import derivatives as V
from ..operators import documents as D
from ..operators import performance as perf
from ..operators import returns as P
from ..operators import risk, similar
from ..operators.catalog import Catalog
from ..operators.funds import waterfall
from ..operators.graph import layers
from ..operators.linkage import link_blocks
from ..operators.matching import match
from ..operators.ranking import in_groups, ntile
from ..operators.rules import gaps
from ..operators.screening import screen_names
from ..shared import scratch
from ..sources import model as M
from ..streaming import monitor, replay
from .dialect import Query, frame
from .model import ents


def _searched(spark: SparkSession, view) -> DataFrame:
    index = D.build(view("documents"), scratch(spark, "index"), folders=8)
    return D.search(spark, index, view("benchmark"), 5, "item_id").withColumnRenamed("doc", "doc_id")


TERMS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SEARCHED = f"""
with dw as (select doc_id, {TERMS} as w from documents where doc_id is not null), dn as (select count(*) filter (where len(w) > 0) as n, sum(len(w))::bigint as l from dw),
dt as (select doc_id, len, term, count(*) as tf from (select doc_id, len(w) as len, unnest(w) as term from dw) as x group by all), df as (select term, count(*) as df from dt group by 1),
dq as (select item_id, term, count(*) as times from (select item_id, unnest({TERMS}) as term from benchmark) as x group by 1, 2),
ds as (select item_id, doc_id, sum(times * cast(floor(1000 * ln((2.0 * n + 2) / (2.0 * df + 1))) as bigint) * ((1000000 * tf) // (tf * 1000 + 8 * (25 + (75 * len * n) // l)))) as score from dq join df using (term) join dt using (term), dn group by 1, 2),
dr as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from ds where score > 0)
select item_id, rank, doc_id, score from dr where rank <= 5"""

#: Documents of a transaction point to a party, an instrument or an order, as its flag says; some to nothing that is there.
LINKED = "order_id, line, broker_id, instrument_id, trade_date, amount, case when line % 6 = 5 then 'contract' when flag = 'R' then 'party' when flag = 'A' then 'instrument' else 'order' end as target_type, case when qty = 13 then null when qty = 17 then 1000000000 else 0 end + case when flag = 'R' then broker_id when flag = 'A' then instrument_id else order_id end as target_id"


def _links(spark: SparkSession, view) -> DataFrame:
    parties = view("party").filter("kind = 'S'").select(F.col("party_id").alias("target_id"), F.col("name").alias("label"))
    instruments = view("instrument").select(F.col("instrument_id").alias("target_id"), F.col("name").alias("label"))
    orders = view("ord").select(F.col("order_id").alias("target_id"), F.col("priority").alias("label"))
    links = view("txn").selectExpr(*_columns(LINKED))
    return D.resolve(links, {"party": parties, "instrument": instruments, "order": orders})


def _columns(text: str) -> list[str]:
    """The expressions of a select list whose commas outside brackets part them."""
    return [c.strip() for c in text.split(", ")]


def _matched(spark: SparkSession, view) -> DataFrame:
    """Own trades against those that brokers confirm, by instrument, within 2,500.00 and a day."""
    txn = view("txn").withColumn("id", F.expr("order_id * 10 + line"))
    return match(txn.filter("flag = 'A'"), txn.filter("flag = 'N' or flag = 'R'"), ["instrument_id"], "amount", "trade_date", "id", 250_000, 1)


def _near_names(spark: SparkSession, view) -> DataFrame:
    names = view("party").filter("kind = 'S'").select("party_id", "name")
    digits = F.substring("name", 10, 20)
    alias = F.when(F.col("party_id") % 100 == 0, F.col("name")).when(F.col("party_id") % 100 == 25, F.concat(digits, F.lit(", SUPPLIER"))).when(F.col("party_id") % 100 == 50, F.concat(F.lit("Spüplier "), digits)).otherwise(F.concat(F.lit("Супплиер "), digits))
    return screen_names(names, names.filter("party_id % 25 = 0").select(F.col("party_id").alias("listed"), alias.alias("alias")))


NEAR = """
with l as (select party_id as listed, case when party_id % 100 = 25 then concat(substring(name, 10), ' supplier') when party_id % 100 = 50 then concat('spuplier ', substring(name, 10)) else concat('supplier ', substring(name, 10)) end as t from party where kind = 'S' and party_id % 25 = 0),
n as (select party_id, concat('supplier ', substring(name, 10)) as s, concat(substring(name, 10), ' supplier') as w from party where kind = 'S'),
b as (select party_id, listed, damerau_levenshtein(s, t) as a, damerau_levenshtein(w, case when t like '%supplier' then t else concat(substring(t, 10), ' ', substring(t, 1, 8)) end) as z, length(s) as n, length(t) as m from n join l on true)
select party_id, listed, case when a <= z then 'written' else 'words' end as form, least(a, z) as distance, 1 - least(a, z) * 1.0 / greatest(n, m) as score from b where least(a, z) <= 2"""


def _linked(spark: SparkSession, view) -> DataFrame:
    """Customers against a feed of two in three of them, with misspelt names, wrong nations and balances a cent off."""
    own = view("party").filter("kind = 'C'").select("party_id", "name", "nation", "segment", "balance")
    spoilt = F.when(F.col("party_id") % 5 == 0, F.regexp_replace("name", "Customer", "Custmer")).otherwise(F.col("name"))
    nation = F.when(F.col("party_id") % 7 == 0, (F.col("nation") + 1) % 25).otherwise(F.col("nation"))
    feed = own.filter("party_id % 3 <> 2").select((F.col("party_id") + 1_000_000_000).alias("feed_id"), spoilt.alias("name2"), nation.alias("nation2"), F.when(F.col("party_id") % 11 != 0, F.col("segment")).alias("segment2"), (F.col("balance") + F.when(F.col("party_id") % 4 == 0, 1).otherwise(0)).alias("balance2"))
    blocks = lambda n: [[F.col(f"name{n}")], [F.col(f"nation{n}"), F.col(f"segment{n}"), F.expr(f"balance{n} div 10000")], [F.expr(f"balance{n} div 1000"), F.col(f"segment{n}")]]
    fields = {"name": F.col("name") == F.col("name2"), "nation": F.col("nation") == F.col("nation2"), "segment": F.col("segment") == F.col("segment2"), "balance": F.abs(F.col("balance") - F.col("balance2")) <= 100}
    scored, _ = link_blocks(own, feed, fields, list(zip(blocks(""), blocks("2"), strict=True)), "party_id", "feed_id", 0.0, 6.0, most=200)
    return scored.filter("state <> 'other'")


RULES = [monitor.Range("high", -(10**15), 20_000), monitor.Range("low", -20_000, 10**15)]
SIGNED = "case when event_type in ('view', 'purchase') then 1 when event_type in ('click', 'error') then -1 else 0 end * cast(round(value * 100) as bigint)"


def _monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure of each user, held between two limits; a user without an event for 36 hours is stale."""
    for k, v in monitor.STORE.items():
        spark.conf.set(k, v)
    events = replay.events(spark, f"{sf_dir}/events.parquet").withColumn("value", F.expr(SIGNED))
    alerts = replay.finished(monitor.watch(events, RULES, "36 hours"), "append")
    return alerts.select(F.col("key").alias("user_id"), "rule", "action", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "cause")


MONITORED = f"""
with e as (select distinct user_id, event_id, ts, {SIGNED} as v from events), z as (select date_trunc('millisecond', max(ts)) - interval 1 day as until from e),
f as (select e.*, until, sum(v) over w as total, lead(ts) over w as next, lead(event_id) over w as next_id from e, z where ts <= until window w as (partition by user_id order by ts, event_id)),
s as (select *, 'high' as rule, total > 20000 as broken from f union all select *, 'low', total < -20000 from f),
t as (select *, coalesce(lag(broken) over (partition by user_id, rule order by ts, event_id), false) as before from s)
select cast(user_id as bigint) as user_id, rule, case when broken then 'raised' else 'cleared' end as action, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as at, 'update ' || event_id || ': ' || cast(total as bigint) as cause from t where broken <> before
union all select cast(user_id as bigint), 'stale', 'raised', strftime(ts + interval 36 hours, '%Y-%m-%d %H:%M:%S.%f'), 'none since ' || event_id from f where coalesce(next > ts + interval 36 hours, ts + interval 36 hours <= until)
union all select cast(user_id as bigint), 'stale', 'cleared', strftime(next, '%Y-%m-%d %H:%M:%S.%f'), 'update ' || next_id from f where next > ts + interval 36 hours"""

#: Orders of a portfolio as deals in the order of their dates: odd lines are what was paid in, even lines what came back.
DEALS = "select portfolio_id, order_id, order_date, sum(case when line % 2 = 1 then amount else 0 end) as cost, sum(case when line % 2 = 0 then amount else 0 end) as proceeds, max(DAYS(trade_date, order_date)) as days from txn group by 1, 2, 3"


def _american(spark: SparkSession, view) -> DataFrame:
    odd = F.col("line") % 2 == 1
    deals = view("txn").groupBy("portfolio_id", "order_id", "order_date").agg(F.sum(F.when(odd, F.col("amount")).otherwise(0)).alias("cost"), F.sum(F.when(~odd, F.col("amount")).otherwise(0)).alias("proceeds"), F.max(F.datediff("trade_date", "order_date")).alias("days"))
    return waterfall(deals.withColumn("preferred", F.expr("(cost * 8 * days) div 36500")), ["portfolio_id"], ["order_date", "order_id"], "cost", "preferred", "proceeds")


#: The same by a fold over a portfolio's deals, one at a time.
FOLD = f"""
with recursive dd as ({DEALS}), dl as (select *, IDIV(cost * 8 * days, 36500) as preferred, row_number() over (partition by portfolio_id order by order_date, order_id) as k from dd),
f as (select portfolio_id, k, order_id, cost, proceeds, least(cost, proceeds) as returned, cost - least(cost, proceeds) as open_c, least(preferred, proceeds - least(cost, proceeds)) as paid, preferred - least(preferred, proceeds - least(cost, proceeds)) as open_p,
      least(IDIV(least(preferred, proceeds - least(cost, proceeds)), 4), proceeds - least(cost, proceeds) - least(preferred, proceeds - least(cost, proceeds))) as caught,
      IDIV(least(preferred, proceeds - least(cost, proceeds)), 4) - least(IDIV(least(preferred, proceeds - least(cost, proceeds)), 4), proceeds - least(cost, proceeds) - least(preferred, proceeds - least(cost, proceeds))) as open_g from dl where k = 1
      union all
      select portfolio_id, k, order_id, cost, proceeds, returned, open_c, paid, open_p, least(open_g + IDIV(paid, 4), proceeds - returned - paid), open_g + IDIV(paid, 4) - least(open_g + IDIV(paid, 4), proceeds - returned - paid) from (
      select portfolio_id, k, order_id, cost, proceeds, returned, open_c, least(open_p + preferred, proceeds - returned) as paid, open_p + preferred - least(open_p + preferred, proceeds - returned) as open_p, open_g from (
      select dl.portfolio_id, dl.k, dl.order_id, dl.cost, dl.proceeds, dl.preferred, least(f.open_c + dl.cost, dl.proceeds) as returned, f.open_c + dl.cost - least(f.open_c + dl.cost, dl.proceeds) as open_c, f.open_p, f.open_g
      from f join dl on dl.portfolio_id = f.portfolio_id and dl.k = f.k + 1) as a) as b)
select portfolio_id, order_id, cost, proceeds, returned, paid as preferred_paid, caught as catch_up, caught + IDIV((proceeds - returned - paid - caught) * 20, 100) as carried, proceeds - caught - IDIV((proceeds - returned - paid - caught) * 20, 100) as to_investors from f"""

FACTORS = "fv as (select provider, d, sum(v) as v from obs group by 1, 2), fr as (select provider, d, v * 1.0 / lag(v) over (partition by provider order by d) - 1 as r from fv)"


def _factors(view) -> DataFrame:
    daily = view("obs").groupBy("provider", "d").agg(F.sum("v").alias("v"))
    return daily.withColumn("r", F.col("v") / F.lag("v").over(Window.partitionBy("provider").orderBy("d")) - 1).filter("r is not null")


def _exposed(view) -> DataFrame:
    return view("obs").groupBy("user_id", "provider").agg((F.sum("v") / 100).alias("w"))


def _exposure(view) -> DataFrame:
    """Loss expected of each broker: default in a year, on what a simulated net of its trades is worth by then."""
    yearly = view("txn").groupBy("broker_id", F.expr("year(trade_date) - 1994").alias("k")).agg((F.sum(F.expr("side * amount")) / 100).alias("m"), (F.sum("amount") / 2000).alias("s"))
    held = risk.expected_exposure(yearly, "broker_id", "k", "m", "s")
    hazard = F.expr("(broker_id % 5 + 1) / 100D")
    default = F.exp(-hazard * (F.col("k") - 1)) - F.exp(-hazard * F.col("k"))
    return held.groupBy("broker_id").agg(F.sum(default * 0.6 * F.col("exposure") * F.pow(F.lit(1.03), -F.col("k"))).alias("cva"), F.max("peak").alias("peak"))


def _near_vectors(spark: SparkSession, view) -> DataFrame:
    """Pairs of like vectors, and copies as pairs with their first one, which are of cosine 1."""
    pairs, members = similar.similar(view("embeddings"), 0.9)
    return pairs.unionByName(members.select("a", F.col("member").alias("b"), F.lit(1.0).alias("cosine")))


def _quotes(view) -> DataFrame:
    """A call on each instrument at a price of the closed form, and the volatility that the price implies."""
    own = view("instrument").withColumns({"f": F.col("price") / 100, "strike": F.expr("price / 100D * (0.9 + size / 250D)"), "t": F.expr("(1 + size % 4) / 2D")})
    own = own.withColumn("given", F.expr("0.2 + 0.1 * abs(ln(strike / f)) + 0.02 * sqrt(t)"))
    own = own.withColumn("value", P.black(F.col("f"), F.col("strike"), F.col("given"), F.col("t"), F.exp(-0.03 * F.col("t"))))
    implied = V.implied_vol(F.col("value"), F.col("f"), F.col("strike"), F.col("t"), F.exp(-0.03 * F.col("t")))
    return own.select("instrument_id", "class", "t", F.log(F.col("strike") / F.col("f")).alias("k"), implied.alias("vol"))


GIVEN = "qv as (select instrument_id, class, t, k, 0.2 + 0.1 * abs(k) + 0.02 * sqrt(t) as vol from (select instrument_id, class, (1 + size % 4) / 2.0 as t, ln(0.9 + size / 250.0) as k from instrument) as x)"
GRID = [-0.1, -0.05, 0.0, 0.05, 0.1]
#: Least squares with centred powers, another way to the same fit.
FITTED = f"""{GIVEN}, qc as (select *, k - avg(k) over p as x, vol * vol * t as w, avg(k) over p as k0, k * k - avg(k * k) over p - (k - avg(k) over p) * regr_slope(k * k, k) over p as y from qv window p as (partition by class, t)),
qs as (select class, t, max(k0) as k0, count(*) as n, count(distinct k) as strikes, avg(w) as w0, regr_slope(k * k, k) as m, avg(k * k) as q0, sum(x * w) / sum(x * x) as l1, sum(y * w) / sum(y * y) as c from qc group by 1, 2),
qf as (select class, t, n, c, l1 - c * m as b, w0 - l1 * k0 + c * (m * k0 - q0) as a from qs where strikes >= 3)"""


def _compressed(view) -> DataFrame:
    """Notionals between nations by class and year, compressed."""
    owner = view("portfolio").select("portfolio_id", F.col("nation").alias("payer"))
    dealer = view("party").filter("kind = 'S'").select(F.col("party_id").alias("broker_id"), F.col("nation").alias("receiver"))
    trades = view("txn").join(owner, "portfolio_id").join(dealer, "broker_id").join(view("instrument").select("instrument_id", "class"), "instrument_id").withColumn("y", F.year("trade_date"))
    return V.compress(trades, ["class", "y"], "payer", "receiver", "amount")


COMPRESSED = """
with x as (select class, year(trade_date) as y, portfolio.nation as payer, party.nation as receiver, amount from txn join portfolio on portfolio.portfolio_id = txn.portfolio_id join party on party_id = broker_id and party.kind = 'S' join instrument on instrument.instrument_id = txn.instrument_id),
n as (select class, y, party, sum(q) as q from (select class, y, payer as party, -amount as q from x union all select class, y, receiver, amount from x) as l group by 1, 2, 3),
a as (select class, y, party, -q as q, sum(-q) over (partition by class, y order by party) as z from n where q < 0), b as (select class, y, party, q, sum(q) over (partition by class, y order by party) as z from n where q > 0)
select a.class, a.y, a.party as payer, b.party as receiver, least(a.z, b.z) - greatest(a.z - a.q, b.z - b.q) as notional from a join b on a.class = b.class and a.y = b.y and a.z - a.q < b.z and b.z - b.q < a.z"""


def _leg_cash(view) -> DataFrame:
    """Each order as a floating leg of ninety days over the rate that its priority's orders fixed last."""
    fixings = view("ord").groupBy("priority", F.col("order_date").alias("fixed_on")).agg(F.expr("(sum(total) div count(*)) % 500").alias("rate"))
    periods = view("ord").selectExpr("order_id", "priority", "total", "order_date as starts", "date_add(order_date, 90) as ends", "portfolio_id % 50 as spread")
    return V.leg_cash(periods, fixings, ["priority"], "starts", "ends", "total", "spread", "fixed_on", "rate")


def _struck(view) -> DataFrame:
    """Orders at the first strike within a hundred days, of the month starts that can be one."""
    strikes = view("txn").groupBy(F.date_trunc("month", "trade_date").cast("date").alias("strike")).agg((F.sum("amount") / F.sum("qty")).alias("per_unit"))
    months = F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.add_months(F.trunc("order_date", "month"), k))).alias("strike")
    met = view("ord").select("order_id", "total", "order_date", months).filter("strike >= order_date and datediff(strike, order_date) < 100").join(strikes, "strike")
    first = met.groupBy("order_id").agg(F.min(F.struct("strike", "total", "per_unit")).alias("m"))
    return first.select("order_id", "m.strike", (F.col("m.total") / F.col("m.per_unit")).alias("units"))


def _share(rank: str = "rank", rows: str = "rows"):
    return F.when(F.col(rows) > 1, (F.col(rank) - 1) / (F.col(rows) - 1)).otherwise(F.lit(0.0))


def _screened(view) -> DataFrame:
    placed = in_groups(view("instrument").select("instrument_id", "size", "class", "price"), ["class"], [F.col("price")])
    return placed.withColumn("pct", _share()).filter("size between 10 and 30 and pct < 0.2").select("instrument_id", "pct")


def _rank_ic(view) -> DataFrame:
    own = view("wealth").select("d", "w", F.lead("v").over(Window.partitionBy("user_id").orderBy("d")).alias("nxt")).filter("nxt is not null")
    first = in_groups(own, ["d"], [F.col("w")]).withColumnRenamed("rank", "a").drop("row", "rows")
    both = in_groups(first, ["d"], [F.col("nxt")]).withColumnRenamed("rank", "b")
    return both.groupBy("d").agg(F.count("*").alias("n"), perf.correlation(F.col("a"), F.col("b")).alias("ic")).filter("n > 5")


def _funnel(view) -> DataFrame:
    """A user is at a stage whose last event is after the first of the stage before."""
    at = lambda f, p: f(F.when(F.col("provider") == p, F.col("ts")))
    users = view("obs").groupBy("user_id").agg(at(F.min, "view").alias("v"), at(F.min, "click").alias("c"), at(F.max, "click").alias("c2"), at(F.max, "purchase").alias("p2"))
    n = lambda when: F.count(F.when(F.expr(when), 1))
    row = users.agg(n("v is not null").alias("view"), n("c2 > v").alias("click"), n("p2 > c").alias("purchase"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), F.lit(p).alias("provider"), F.col(p).alias("users")) for k, p in enumerate(("view", "click", "purchase"), 1)])).alias("s")).select("s.*")


def _quartiles(view) -> DataFrame:
    own = view("ord").join(view("portfolio").select("portfolio_id", "segment"), "portfolio_id").groupBy("portfolio_id", "segment", F.year("order_date").alias("y")).agg(F.sum("total").alias("total"))
    placed = in_groups(own, ["segment", "y"], [-F.col("total"), F.col("portfolio_id")]).withColumn("quartile", ntile(F.col("row"), F.col("rows"), 4)).drop("row", "rank", "rows")
    return in_groups(placed, ["segment", "y"], [F.col("total")]).withColumn("pct", _share())


def _pack_entities(view) -> DataFrame:
    """Entities of each tree by the registry's packs, none counted as none."""
    found = ents(view).select("root", F.col("pack").alias("slug"))
    packs = M.packs(view.spark).select("prefix", "slug")
    every = found.select("root").distinct().crossJoin(F.broadcast(packs))  # a row a pack of the registry
    return every.join(found.groupBy("root", "slug").agg(F.count("*").alias("n")), ["root", "slug"], "left").select("root", "prefix", F.coalesce("n", F.lit(0)).alias("n"))


def _inputs(view) -> DataFrame:
    """Inputs of documents that each tool takes and refuses."""
    tools = F.explode(F.array(*map(F.lit, sorted(Catalog.LEAST)))).alias("tool")
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("given")) for c in ("lang", "source", "text")])).alias("f")
    given = view("documents").select("lang", "source", "text", tools).select("tool", fields)
    return given.select("tool", "f.field", Catalog.accepts(F.col("tool"), F.col("f.given")).alias("valid")).groupBy("tool", "field", "valid").agg(F.count("*").alias("n"))


def _impact(view) -> DataFrame:
    """What a broker's data feeds: orders, their portfolios, nations and regions, each counted once however it is reached."""
    edges = lambda name, src, dst: view(name).select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
    hops = [edges("txn", "broker_id", "order_id"), edges("ord", "order_id", "portfolio_id").distinct(), edges("portfolio", "portfolio_id", "nation").distinct(), edges("place", "nation", "region").distinct()]
    kind = F.element_at(F.array(*[F.lit(k) for k in "OPNR"]), F.col("depth"))
    return layers(hops).groupBy(F.col("start").alias("broker_id"), kind.alias("kind")).agg(F.count("*").alias("n"))


def _effects(view) -> DataFrame:
    """Segments below regions: cost shares and gains of what is held against all portfolios' by class."""
    own = view("valued").join(view("portfolio").select("portfolio_id", "region_name", "segment"), "portfolio_id").filter("cost > 0")
    part = own.groupBy("region_name", "segment").agg(F.sum("cost").alias("c"), F.sum("mv").alias("m"), F.sum("qty").alias("q"), F.count("*").alias("k"))
    all_of = part.agg(F.sum("c").alias("tc"), F.sum("m").alias("tm"), F.sum("k").alias("tk"))  # one row
    leaves = part.crossJoin(F.broadcast(all_of)).select("region_name", "segment", (F.col("c") / F.col("tc")).alias("w"), (F.col("m") / F.col("c") - 1).alias("r"), (F.col("k") / F.col("tk")).alias("b"), ((F.col("m") / F.col("q")) / 100_000 - 1).alias("s"))
    return perf.attribution_tree(leaves, ["region_name", "segment"], "w", "r", "b", "s")


EFFECTS = """
with h as (select region_name, segment, valued.* from valued join portfolio on portfolio.portfolio_id = valued.portfolio_id where cost > 0),
l as (select region_name, segment, sum(cost) * 1.0 / sum(sum(cost)) over () as w, sum(mv) * 1.0 / sum(cost) - 1 as r, count(*) * 1.0 / sum(count(*)) over () as b, sum(mv) * 1.0 / sum(qty) / 100000 - 1 as s from h group by 1, 2),
g as (select region_name, sum(w) as w, sum(b) as b, sum(b * s) / sum(b) as rate from l group by 1), t as (select sum(b * s) / sum(b) as rate from l)
select 1 as depth, region_name, cast(null as varchar) as segment, (w - b) * (g.rate - t.rate) as allocation, 0.0 as selection from g, t
union all select 2, l.region_name, segment, (l.w - g.w * l.b / g.b) * (s - g.rate), l.w * (r - s) from l join g on g.region_name = l.region_name"""
SPANS = """
with x as (select user_id, d, v, max(v) over (partition by user_id order by d) as peak from daily), y as (select *, (select max(d) from x as z where z.user_id = x.user_id and z.d <= x.d and z.v = z.peak) as start from x where v < peak),
g as (select user_id, start, min(v) as low, max(peak) as peak, count(*) as days from y group by 1, 2)
select g.user_id, g.start, (select min(d) from y where y.user_id = g.user_id and y.start = g.start and y.v = g.low) as trough, (select min(d) from x where x.user_id = g.user_id and x.d > g.start and x.v >= g.peak) as recovery, low * 1.0 / peak - 1 as depth, days from g"""

QUERIES: dict[str, Query] = {
    "a01_24_pack_entities": frame("root s, prefix s, n l", lambda spark, view: _pack_entities(view), """
        with p as (select * from (values ('E', 'core'), ('PB', 'public-markets'), ('FO', 'fund-operations'), ('PM', 'private-markets'), ('DR', 'derivatives'), ('RA', 'real-assets')) as t(prefix, pack)), r as (select distinct root from m_ent)
        select concat('r', cast(r.root as varchar)) as root, p.prefix, count(m_ent.suppkey) as n from r cross join p left join m_ent on m_ent.root = r.root and m_ent.pack = p.pack group by 1, 2"""),
    "a04_07_valid_inputs": frame("tool s, field s, valid b, n l", lambda spark, view: _inputs(view), """
        with x as (select 'lang' as field, lang as given from documents union all select 'source', source from documents union all select 'text', text from documents), t as (select * from (values ('get', 2), ('map_requirement', 5), ('search', 2)) as v(tool, least))
        select tool, field, coalesce(length(given) >= least, false) as valid, count(*) as n from x cross join t group by 1, 2, 3"""),
    "a06_07_gaps": frame("doc_id l", lambda spark, view: gaps("labels", "doc_id")({"labels": view("labels")}).select(F.col("subject").alias("doc_id")), "with s as (select RANGE((select min(doc_id) from labels), (select max(doc_id) from labels)) as doc_id) select s.doc_id from s where not exists (select 1 from labels where labels.doc_id = s.doc_id)"),
    "b01_01_linkage": frame("left_id l, right_id l, weight d, state s", _linked, None),
    "b05_14_effects": frame("depth l, region_name s, segment s, allocation d, selection d", lambda spark, view: _effects(view), EFFECTS),
    "b06_03_appraisal": frame("user_id l, n l, appraisal d", lambda spark, view: perf.regression(view("paired"), ["user_id"], "r", "m"), "select user_id, n, (my - s * mx) / sqrt((vy - s * s * vx) * n / (n - 2)) as appraisal from (select user_id, count(*) as n, avg(m) as mx, avg(r) as my, var_pop(m) as vx, var_pop(r) as vy, regr_slope(r, m) as s from paired group by 1) as x where n > 2"),
    "b06_04_calmar": frame("user_id l, yearly d, worst d, calmar d", lambda spark, view: perf.calmar(view("daily"), ["user_id"], "d", "v", 30.0), """
        with x as (select user_id, d, v * 1.0 / max(v) over (partition by user_id order by d) - 1 as f from daily), w as (select user_id, min(f) as worst from x group by 1), e as (select user_id, min_by(v, d) as a, max_by(v, d) as z, DAYS(max(d), min(d)) as n from daily group by 1)
        select e.user_id, power(z * 1.0 / a, 30.0 / n) - 1 as yearly, case when worst < 0 then worst end as worst, case when worst < 0 then (power(z * 1.0 / a, 30.0 / n) - 1) / -worst end as calmar from e join w on w.user_id = e.user_id where a > 0 and n > 0"""),
    "b06_05_spans": frame("user_id l, start t, trough t, recovery t, depth d, days l", lambda spark, view: perf.drawdown_spans(view("daily"), ["user_id"], "d", "v"), SPANS),
    "b06_06_linked_capture": frame("user_id l, up d, down d", lambda spark, view: perf.capture(view("paired").filter("r < 5").crossJoin(F.broadcast(view("market").agg(F.avg("m").alias("a")))), ["user_id"], "r", "m", F.col("m") > F.col("a")), """
        with c as (select avg(m) as a from market), p as (select user_id, m > a as up, power(product(1 + r), 1.0 / count(*)) - 1 as r, power(product(1 + m), 1.0 / count(*)) - 1 as m from paired, c where r < 5 group by 1, 2)
        select user_id, max(case when up then r / m end) as up, max(case when not up then r / m end) as down from p group by 1"""),
    "b06_07_alpha_t": frame("user_id l, alpha d, alpha_t d", lambda spark, view: perf.regression(view("paired"), ["user_id"], "r", "m").withColumns({c: F.when(~F.isnan("alpha"), F.col(c)) for c in ("alpha_t", "alpha")}), """
        with x as (select user_id, count(*) as n, avg(m) as mx, regr_slope(r, m) as s, regr_intercept(r, m) as i, regr_sxx(r, m) as sxx from paired group by 1), e as (select paired.user_id, sum(power(r - i - s * m, 2)) as rss from paired join x on x.user_id = paired.user_id group by 1)
        select x.user_id, i as alpha, i / sqrt(rss / (n - 2) * (1.0 / n + mx * mx / sxx)) as alpha_t from x join e on e.user_id = x.user_id where n > 2"""),
    "b07_10_american_waterfall": frame("portfolio_id l, order_id l, cost l, proceeds l, returned l, preferred_paid l, catch_up l, carried l, to_investors l", _american, FOLD),
    "b09_02_portfolio_sigma": frame("user_id l, sigma d, var99 d", lambda spark, view: risk.sigma(_exposed(view), risk.covariance(_factors(view), "provider", "d", "r"), "user_id", "provider", "w").withColumn("var99", F.col("sigma") * 2.326348), f"""
        with {FACTORS}, c as (select x.provider as i, y.provider as j, covar_samp(x.r, y.r) as c from fr as x join fr as y on x.d = y.d where x.r is not null and y.r is not null group by 1, 2),
        e as (select user_id, provider, sum(v) / 100.0 as w from obs group by 1, 2) select a.user_id, sqrt(sum(a.w * b.w * c)) as sigma, sqrt(sum(a.w * b.w * c)) * 2.326348 as var99 from e as a join e as b on a.user_id = b.user_id join c on i = a.provider and j = b.provider group by 1"""),
    "b09_03_correlated_var": frame("user_id l, var z, es z", lambda spark, view: risk.simulate(_exposed(view), risk.covariance(_factors(view), "provider", "d", "r"), "user_id", "provider", "w"), None),
    "b09_04_kupiec": frame("user_id l, n l, breaches l, statistic d, rejected b", lambda spark, view: perf.kupiec(view("rets").join(view("rets").groupBy("user_id").agg((F.avg("r") - F.stddev_samp("r")).alias("line")), "user_id"), ["user_id"], F.col("r") < F.col("line"), 0.05), """
        with l as (select user_id, avg(r) - stddev_samp(r) as line from rets group by 1), c as (select rets.user_id, count(*) as n, count(*) filter (where r < line) as x from rets join l on l.user_id = rets.user_id group by 1)
        select user_id, n, x as breaches, s as statistic, s > 3.841459 as rejected from (select *, 2 * (case when x > 0 then x * ln(x * 1.0 / n / 0.05) else 0 end + case when x < n then (n - x) * ln((1 - x * 1.0 / n) / 0.95) else 0 end) as s from c) as y"""),
    "b09_08_expected_exposure": frame("broker_id l, cva z, peak z", lambda spark, view: _exposure(view), None),
    "b10_03_near_names": frame("party_id l, listed l, form s, distance l, score d", _near_names, NEAR),
    "b12_02_tolerance_match": frame("left_id l, right_id l, stage s, days l, gap l", _matched, None),
    "b06_08_peer_quartile": frame("portfolio_id l, segment s, y i, quartile i, pct d", lambda spark, view: _quartiles(view), "select portfolio_id, segment, y, ntile(4) over (partition by segment, y order by total desc, portfolio_id) as quartile, percent_rank() over (partition by segment, y order by total) as pct from (select ord.portfolio_id, segment, year(order_date) as y, sum(total) as total from ord join portfolio on ord.portfolio_id = portfolio.portfolio_id group by 1, 2, 3) as x"),
    "b12_18_deals_at_strike": frame("order_id l, strike t, units d", lambda spark, view: _struck(view), "with s as (select MONTH_START(trade_date) as strike, sum(amount) * 1.0 / sum(qty) as per_unit from txn group by 1) select order_id, strike, total / per_unit as units from (select order_id, total, strike, per_unit, row_number() over (partition by order_id order by strike) as k from ord join s on strike >= order_date and DAYS(strike, order_date) < 100) as x where k = 1"),
    "b17_16_rank_ic": frame("d t, n l, ic d", lambda spark, view: _rank_ic(view), "select d, count(*) as n, corr(a, b) as ic from (select d, rank() over (partition by d order by w) as a, rank() over (partition by d order by nxt) as b from (select user_id, d, w, lead(v) over (partition by user_id order by d) as nxt from wealth) as x where nxt is not null) as y group by d having count(*) > 5"),
    "b17_17_screen": frame("instrument_id l, pct d", lambda spark, view: _screened(view), "select instrument_id, pct from (select instrument_id, size, percent_rank() over (partition by class order by price) as pct from instrument) as x where size between 10 and 30 and pct < 0.2"),
    "b18_20_funnel": frame("stage i, provider s, users l", lambda spark, view: _funnel(view), "select 1 as stage, 'view' as provider, count(distinct user_id) as users from obs where provider = 'view' union all select 2, 'click', count(distinct a.user_id) from obs as a where a.provider = 'click' and exists (select 1 from obs as b where b.user_id = a.user_id and b.provider = 'view' and b.ts < a.ts) union all select 3, 'purchase', count(distinct a.user_id) from obs as a where a.provider = 'purchase' and exists (select 1 from obs as b where b.user_id = a.user_id and b.provider = 'click' and b.ts < a.ts)"),
    "b15_05_impact": frame("broker_id l, kind s, n l", lambda spark, view: _impact(view), """
        with x as (select broker_id, txn.order_id, txn.portfolio_id, nation, region from txn join portfolio on portfolio.portfolio_id = txn.portfolio_id)
        select broker_id, 'O' as kind, count(distinct order_id) as n from x group by 1 union all select broker_id, 'P', count(distinct portfolio_id) from x group by 1
        union all select broker_id, 'N', count(distinct nation) from x group by 1 union all select broker_id, 'R', count(distinct region) from x group by 1"""),
    "b15_08_index_search": frame("item_id l, rank l, doc_id l, score l", _searched, SEARCHED),
    "b15_08_links": frame("order_id l, line l, broker_id l, instrument_id l, trade_date t, amount l, target_type s, target_id s, label s, state s", _links, f"""
        with k as (select {LINKED} from txn), n as (select 'party' as target_type, party_id as target_id, name as label from party where kind = 'S' union all select 'instrument', instrument_id, name from instrument union all select 'order', order_id, priority from ord)
        select k.*, label, case when k.target_type = 'contract' then 'unknown_type' when k.target_id is null then 'empty' when label is null then 'dangling' else 'resolved' end as state from k left join n on n.target_type = k.target_type and n.target_id = k.target_id"""),
    "b15_09_near_vectors": frame("a l, b l, cosine d", _near_vectors, "with u as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where vec_id is not null and embedding is not null) select x.vec_id as a, y.vec_id as b, list_cosine_similarity(x.e, y.e) as cosine from u as x join u as y on x.vec_id < y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.9"),
    "b17_02_implied_vol": frame("instrument_id l, vol d", lambda spark, view: _quotes(view), f"with {GIVEN} select instrument_id, vol from qv"),
    "b17_02_surface": frame("class s, t d, a d, b d, c d, n l", lambda spark, view: V.surface(_quotes(view), "class", "t", "k", "vol"), f"with {FITTED} select class, t, a, b, c, n from qf"),
    "b17_02_arbitrage": frame("class s, t d, k d, kind s", lambda spark, view: V.arbitrage(V.surface(_quotes(view), "class", "t", "k", "vol"), "class", "t", GRID), f"""
        with {FITTED}, p as (select class, t, a + b * k + c * k * k as w, b + 2 * c * k as d, c, k from qf cross join (select unnest({GRID}) as k) as g), o as (select *, lag(w) over (partition by class, k order by t) as before from p)
        select class, t, k, 'calendar' as kind from o where w < before union all select class, t, k, 'butterfly' from o where w <= 0 or power(1 - k * d / (2 * w), 2) - d * d / 4 * (1 / w + 0.25) + c < 0"""),
    "b18_08_multilateral": frame("class s, y i, payer i, receiver i, notional l", lambda spark, view: _compressed(view), COMPRESSED),
    "b18_08_leg_cash": frame("order_id l, rate l, cash l", lambda spark, view: _leg_cash(view), """
        with f as (select priority, order_date as fixed_on, IDIV(sum(total), count(*)) % 500 as rate from ord group by 1, 2), p as (select order_id, priority, total, order_date, portfolio_id % 50 as spread from ord)
        select order_id, rate, IDIV(total * (rate + spread) * 90, 3600000) as cash from p asof left join f on p.priority = f.priority and p.order_date > f.fixed_on"""),
    "b18_13_monitor": Query(_monitored, MONITORED),
}
