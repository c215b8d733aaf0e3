"""One statement for two dialects.

Query text is ANSI SQL with a few macros for what Spark and the checking engine spell differently. ``expand`` writes it
for one of them, puts the canonical views that it names before it, and casts its columns to declared types.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Macro by name: how it is written for Spark and for the checking engine; {0}, {1} ... are its arguments.
MACROS: dict[str, tuple[str, str]] = {
    "DAYS": ("datediff({0}, {1})", "date_diff('day', {1}, {0})"),
    "PLUS_DAYS": ("date_add({0}, cast({1} as int))", "({0} + cast({1} as integer))"),
    "MONTH_START": ("cast(date_trunc('month', {0}) as date)", "cast(date_trunc('month', {0}) as date)"),
    "IDIV": ("(({0}) div ({1}))", "(({0}) // ({1}))"),
    "QUANTILE": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "WHOLE": ("cast(floor({0}) as bigint)", "cast(floor({0}) as bigint)"),
    "JSON_INT": ("cast(get_json_object({0}, '$.{1}') as bigint)", "cast(json_extract_string({0}, '$.{1}') as bigint)"),
    "SPLIT": ("split({0}, '{1}')", "string_split({0}, '{1}')"),
    "RANGE": ("explode(sequence({0}, {1}))", "unnest(generate_series(cast({0} as bigint), cast({1} as bigint)))"),
    "DATE_RANGE": ("explode(sequence({0}, {1}, interval 1 day))", "cast(unnest(generate_series({0}, {1}, interval 1 day)) as date)"),
    "EDIT": ("levenshtein({0}, {1})", "levenshtein({0}, {1})"),
    "RX": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "CAT": ("array_join(array_sort(collect_set({0})), ',')", "array_to_string(list_sort(list_distinct(list({0}))), ',')"),
    "LINK": ("exp(sum(ln({0})))", "exp(sum(ln({0})))"),
    # by zero, as doubles are divided: infinite with the sign of what is divided, or not a number
    "RATIO": ("(case when {1} = 0 then {0} * double('infinity') else {0} / {1} end)", "{0} / {1}"),
    # not a number where either side, or what the slope is on, stands still
    "CORR": ("(case when regr_sxx({0}, {1}) = 0 or regr_syy({0}, {1}) = 0 then double('nan') else regr_sxy({0}, {1}) / sqrt(regr_sxx({0}, {1})) / sqrt(regr_syy({0}, {1})) end)", "corr({0}, {1})"),
    "SLOPE": ("(case when regr_sxx({0}, {1}) = 0 then double('nan') else regr_slope({0}, {1}) end)", "regr_slope({0}, {1})"),
    # null where the slope is not a number
    "INTERCEPT": ("(case when not isnan(regr_slope({0}, {1})) then regr_intercept({0}, {1}) end)", "regr_intercept({0}, {1})"),
}
TYPES = {"l": "bigint", "i": "int", "s": "string", "b": "boolean", "t": "date", "d": "double", "z": "double"}

#: Canonical views over the tables, by name, in the order of their needs. Money is whole cents.
VIEWS: dict[str, str] = {
    "party": "select c_custkey as party_id, 'C' as kind, c_name as name, c_nationkey as nation, cast(round(c_acctbal * 100) as bigint) as balance, c_mktsegment as segment from customer union all select s_suppkey, 'S', s_name, s_nationkey, cast(round(s_acctbal * 100) as bigint), 'BROKER' from supplier",
    "place": "select n_nationkey as nation, n_name as nation_name, r_regionkey as region, r_name as region_name from nation join region on n_regionkey = r_regionkey",
    "portfolio": "select c_custkey as portfolio_id, c_mktsegment as segment, nation, nation_name, region, region_name, cast(round(c_acctbal * 100) as bigint) as cash from customer join place on c_nationkey = nation",
    "instrument": "select p_partkey as instrument_id, p_name as name, p_brand as issuer, p_type as class, p_size as size, cast(round(p_retailprice * 100) as bigint) as price from part",
    "ord": "select o_orderkey as order_id, o_custkey as portfolio_id, o_orderstatus as status, cast(round(o_totalprice * 100) as bigint) as total, cast(o_orderdate as date) as order_date, o_orderpriority as priority from orders",
    "txn": "select l_orderkey as order_id, l_linenumber as line, portfolio_id, l_partkey as instrument_id, l_suppkey as broker_id, order_date, cast(l_shipdate as date) as trade_date, case when l_returnflag = 'R' then -1 else 1 end as side, cast(l_quantity as bigint) as qty, cast(round(l_extendedprice * 100) as bigint) as amount, cast(round(l_discount * 100) as bigint) as disc, cast(round(l_tax * 100) as bigint) as tax, l_returnflag as flag, l_linestatus as line_status from lineitem join ord on l_orderkey = order_id",
    "obs": "select event_id, user_id, event_type as provider, cast(ts as date) as d, ts, cast(round(value * 100) as bigint) as v, props from events",
    "daily": "select user_id, d, sum(v) as v from obs group by user_id, d",
    "wealth": "select user_id, d, v, sum(v) over (partition by user_id order by d) as w from daily",
    "rets": "select user_id, d, r from (select user_id, d, RATIO(v, lag(w) over (partition by user_id order by d)) as r from wealth) as x where r is not null",
    "market": "select d, sum(r * 1) / count(*) as m from rets group by d",
    "paired": "select user_id, rets.d, r, m from rets join market on rets.d = market.d",
    "monthly": "select portfolio_id, year(trade_date) * 12 + month(trade_date) as m, sum(side * amount) as flow, sum(amount) as gross, count(*) as n from txn group by 1, 2",
    "holding": "select portfolio_id, instrument_id, sum(side * qty) as qty, sum(side * amount) as cost from txn group by 1, 2",
    "valued": "select portfolio_id, holding.instrument_id, issuer, class, qty, cost, qty * price as mv from holding join instrument on holding.instrument_id = instrument.instrument_id where qty <> 0",
    # what the generated model trees say (modelfiles.py writes it as files): a tree for each hundred suppliers
    "m_root": "select distinct IDIV(s_suppkey, 100) as root from supplier",
    "m_bd": "select root, r_regionkey + 1 as bd, concat('BD-0', cast(r_regionkey + 1 as varchar(9))) as bd_id, r_name as name, case r_regionkey when 0 then 'Front' when 1 then 'Middle office' when 2 then 'back' when 3 then 'Crossing' else 'Commercial' end as office from region cross join m_root",
    "m_place": "select n_nationkey as nk, cast(n_nationkey % 5 + 1 as bigint) as bd, cast(IDIV(n_nationkey, 5) + 1 as bigint) as sd, concat('SD-0', cast(n_nationkey % 5 + 1 as varchar(9)), '.', cast(cast(IDIV(n_nationkey, 5) + 1 as bigint) as varchar(9))) as sd_id, concat('BD-0', cast(n_nationkey % 5 + 1 as varchar(9))) as bd_id, concat('Asset Books of ', n_name) as name, case n_nationkey % 3 when 0 then 'PUB' when 1 then 'PRIV' else 'BOTH' end as applies from nation",
    "m_sd": "select root, nk, bd, sd, sd_id, bd_id, name, applies from m_place cross join m_root",
    "m_ent": "select root, suppkey, num, nk, name, prefix, pack, no, concat(prefix, '-', lpad(cast(no as varchar(9)), 2, '0')) as entity_id, case when prefix = 'E' then null when num % 13 = 0 then 'E-99' else concat('E-', lpad(cast(no as varchar(9)), 2, '0')) end as parent from (select IDIV(s_suppkey, 100) as root, s_suppkey as suppkey, s_suppkey % 100 as num, s_nationkey as nk, s_name as name, case IDIV(s_suppkey % 100, 17) when 0 then 'E' when 1 then 'PB' when 2 then 'FO' when 3 then 'PM' when 4 then 'DR' else 'RA' end as prefix, case IDIV(s_suppkey % 100, 17) when 0 then 'core' when 1 then 'public-markets' when 2 then 'fund-operations' when 3 then 'private-markets' when 4 then 'derivatives' else 'real-assets' end as pack, cast(s_suppkey % 100 % 17 + 1 as bigint) as no from supplier) as x",
    "m_key": "select root, suppkey, entity_id, 'owner_id' as col, concat('E-', lpad(cast(num % 15 + 1 as varchar(9)), 2, '0')) as target from m_ent union all select root, suppkey, entity_id, 'other_id', 'E-03' from m_ent where num % 5 = 0 union all select root, suppkey, entity_id, 'other_id', 'PB-04' from m_ent where num % 5 = 0 union all select root, suppkey, entity_id, 'parent_id', entity_id from m_ent where num % 7 = 0 union all select root, suppkey, entity_id, 'lost_id', 'E-98' from m_ent where num % 11 = 3",
    "m_fk": "select distinct root, entity_id, target, entity_id = target as is_self from m_key",
    "m_link": "select root, entity_id, sd_id, 'owned_by' as kind from m_ent join m_place on m_place.nk = m_ent.nk union all select root, entity_id, sd_id, 'owned_by' from m_ent join m_place on m_place.nk = (m_ent.nk + 1) % 25 where num % 4 = 0 union all select root, entity_id, sd_id, 'consumed_by' from m_ent join m_place on m_place.nk = (m_ent.nk + 2) % 25 union all select root, entity_id, 'SD-77.1', 'consumed_by' from m_ent where num % 10 = 9",
    "m_says": "select root, a.nk, a.sd_id, a.bd_id, b.sd_id as ref, 'consumes-sd' as kind from m_sd as a join m_place as b on b.nk = (a.nk + 1) % 25 where a.nk % 2 = 0 union all select root, nk, sd_id, bd_id, 'SD-99.1', 'produces-sd' from m_sd where nk % 8 = 5 union all select root, a.nk, a.sd_id, a.bd_id, b.sd_id, 'produces-sd' from m_sd as a join m_place as b on b.nk = (a.nk + 3) % 25 where a.nk % 3 = 0 union all select root, a.nk, a.sd_id, a.bd_id, b.sd_id, 'input' from m_sd as a join m_place as b on b.nk = (a.nk + 5) % 25 where a.nk % 4 = 1 union all select root, nk, sd_id, bd_id, concat('BD-0', cast(bd % 5 + 1 as varchar(9))), 'input' from m_sd where nk % 5 = 0 union all select root, nk, sd_id, bd_id, bd_id, 'input' from m_sd where nk % 6 = 0 union all select root, a.nk, a.sd_id, a.bd_id, b.sd_id, 'output' from m_sd as a join m_place as b on b.nk = (a.nk + 7) % 25 where a.nk % 5 = 2 union all select root, nk, sd_id, bd_id, 'BD-09', 'output' from m_sd where nk % 11 = 3",
    "m_uses": "select root, sd_id, 'E-04' as ref, 'consumes-entity' as kind, nk from m_sd where nk % 3 <> 1 union all select root, sd_id, 'E-07', 'consumes-entity', nk from m_sd where nk % 3 <> 2 union all select distinct m_link.root, m_link.sd_id, m_link.entity_id, 'owns-entity', nk from m_link join m_sd on m_sd.root = m_link.root and m_sd.sd_id = m_link.sd_id where kind = 'owned_by' and nk % 6 <> 4 and m_link.entity_id not like '%-13'",
    "m_ref": "select distinct root, sd_id, bd_id, ref, case kind when 'input' then 'upstream' when 'output' then 'downstream' else kind end as kind from m_says union select root, sd_id, bd_id, ref, case kind when 'consumes-sd' then 'upstream' else 'downstream' end from m_says where kind in ('consumes-sd', 'produces-sd') union select u.root, u.sd_id, s.bd_id, u.ref, u.kind from m_uses as u join m_sd as s on s.root = u.root and s.sd_id = u.sd_id",
    "m_edge": "select distinct root, case when kind in ('consumes-sd', 'upstream') then ref else sd_id end as src, case when kind in ('consumes-sd', 'upstream') then sd_id else ref end as dst, case when kind = 'upstream' and ref like 'SD-%' then 'narrative-input' when kind = 'upstream' then 'narrative-bd-input' when kind = 'downstream' and ref like 'SD-%' then 'narrative-output' when kind = 'downstream' then 'narrative-bd-output' else kind end as kind from m_ref where kind in ('consumes-sd', 'produces-sd', 'upstream', 'downstream') and ref not in ('SD-99.1', 'BD-09') and ref <> bd_id",
    "m_verb": "select p.verb, p.label, p.inverse, p.meaning, p.k from (select distinct upper(replace(o_orderpriority, '-', '_')) as verb, o_orderpriority as label, case when o_orderpriority < '3' then 'EARLY_OF' when o_orderpriority like '4%' then '' when o_orderpriority like '5%' then '3_MEDIUM' else concat(upper(replace(o_orderpriority, '-', '_')), '_OF') end as inverse, concat('From ', o_orderpriority, ' on.') as meaning, cast(substring(o_orderpriority, 1, 1) as bigint) as k from orders) as p",
    "m_term": "select distinct term, concat('What a ', term, ' is.') as definition from (select p_type as term from part union all select p_brand from part) as x",
    "m_bind": "select root, verb, entity_id, col from m_key join m_verb on k = cast(substring(entity_id, length(entity_id), 1) as bigint) % 4 + 1 where col = 'owner_id' and suppkey % 6 <> 5 union all select root, verb, entity_id, col from m_key join m_verb on k <= 2 where col = 'parent_id' union all select root, verb, entity_id, cast(null as varchar(20)) from m_ent join m_verb on k = 3 where parent is not null and num % 3 <> 0",
    "m_map": "select root, entity_id, sd_id, 1 as nth from m_link where kind = 'owned_by' and entity_id not like '%-16' union all select root, entity_id, 'SD-01.1', 2 from m_ent where no = 17",
    "m_count": "select root, bd, bd_id, count(*) as n from m_sd group by 1, 2, 3",
}
ORDER = list(VIEWS)
#: Views as Spark reads them: rows of large tables are dealt by key before they are sorted and counted, so that a task has no more of them.
DEALT: dict[str, str] = {
    "txn": VIEWS["txn"].replace("from lineitem join ord on", "from (select /*+ repartition(:parts, l_orderkey) */ * from lineitem) as l join (select /*+ repartition(:parts, order_id) */ * from ord) as o on"),
    "holding": VIEWS["holding"].replace("from txn group by", "from (select /*+ repartition(:parts, portfolio_id, instrument_id) */ portfolio_id, instrument_id, side, qty, amount from txn) as t group by"),
}
#: Lines of a part; up to ``FEW`` parts, adaptive execution decides alone.
LINES, FEW = 500_000, 8
_LINES: dict[str, int] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _macros(sql: str, which: int) -> str:
    name = "|".join(sorted(MACROS, key=len, reverse=True))
    while m := re.search(rf"\b({name})\(", sql):
        depth, at, args, start = 1, m.end(), [], m.end()
        quoted = False
        while depth:
            c = sql[at]
            quoted ^= c == "'"
            if not quoted:
                depth += (c in "([") - (c in ")]")
                if c == "," and depth == 1:
                    args.append(sql[start:at].strip())
                    start = at + 1
            at += 1
        args.append(sql[start : at - 1].strip())
        sql = sql[: m.start()] + MACROS[m[1]][which].format(*args) + sql[at:]
    return sql


def _views(sql: str) -> list[str]:
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for v in ORDER:
            if v not in needed and re.search(rf"\b{v}\b", text):
                needed.add(v)
                todo.append(VIEWS[v])
    return [v for v in ORDER if v in needed]


def _view(name: str, which: int) -> str:
    return VIEWS[name] if which else DEALT.get(name, VIEWS[name])


def parts(spark: SparkSession, sf_dir: str, lines: int | None = None) -> int:
    """In how many parts the lines are dealt; 0 where they are few. Lines are counted from the file's footers, once a path."""
    if sf_dir not in _LINES:
        _LINES[sf_dir] = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    n = math.ceil(_LINES[sf_dir] / (lines or LINES))
    return n if n > FEW else 0


def _sized(spark: SparkSession, sf_dir: str, text: str) -> str:
    """The statement with the number of parts in its hints, or without the hints."""
    if ":parts" not in text:
        return text
    n = parts(spark, sf_dir)
    return text.replace(":parts", str(n)) if n else re.sub(r"/\*\+ repartition\(:parts[^*]*\*/ ", "", text)


def expand(sql: str, columns: str, which: int) -> str:
    """The statement for Spark (0) or for the checking engine (1). ``columns`` is 'name type, ...': l long, i int, s string, b boolean, t date, d a double to 6 places, z one to 2."""
    own = dict(c.split() for c in columns.split(","))
    types = TYPES if not which else TYPES | {"s": "varchar"}
    cast = {n: f"cast({n} as {types[k]})" for n, k in own.items()}
    cast |= {n: f"round({cast[n]}, {6 if k == 'd' else 2}) + 0.0" for n, k in own.items() if k in "dz"}
    body = sql.strip()
    recursive = bool(re.match(r"with recursive\b", body, re.I))
    inner = re.sub(r"^with( recursive)?\s+", "", body, flags=re.I) if re.match("with ", body, re.I) else None
    parts = [f"{v} as ({_view(v, which)})" for v in _views(body)]
    if inner is None:
        parts.append(f"result_ as ({body})")
    else:  # the statement's own views come after, and its last select becomes one more
        cut = _last_select(inner)
        parts += [inner[:cut].rstrip().rstrip(","), f"result_ as ({inner[cut:]})"]
    text = f"with {'recursive ' if recursive else ''}" + ", ".join(parts) + " select " + ", ".join(f"{cast[n]} as {n}" for n in own) + " from result_"
    # literals with a point are doubles in both dialects, not decimals of few places
    return _macros(re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", text), which)


def _last_select(sql: str) -> int:
    """Where the statement that follows the common table expressions begins."""
    depth, at = 0, 0
    for m in re.finditer(r"[()]|\bselect\b|'[^']*'", sql, re.I):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth -= 1
        elif m[0].lower() == "select" and not depth:
            at = m.start()
            break
    return at


@dataclass(frozen=True)
class Query:
    """A registered query: how Spark runs it, and the SQL that gives the same rows (None where SQL has none)."""

    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


def tables(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def statement(columns: str, sql: str) -> Query:
    """A query from one text."""
    text = expand(sql, columns, 0)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables(spark, sf_dir, used)
        return spark.sql(_sized(spark, sf_dir, text))

    return Query(run, expand(sql, columns, 1))


def frame(columns: str, build: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame], oracle: str | None) -> Query:
    """A query built with DataFrame operators; ``build`` gets the session and a function from view or table name to frame."""
    own = dict(c.split() for c in columns.split(","))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def view(name: str) -> DataFrame:
            body = f"select * from {name}"
            text = ("with " + ", ".join(f"{v} as ({_view(v, 0)})" for v in _views(body)) + " " if _views(body) else "") + body
            tables(spark, sf_dir, [t for t in TABLES if re.search(rf"\b{t}\b", text)])
            return spark.sql(_sized(spark, sf_dir, _macros(text, 0)))

        view.spark, view.sf_dir, view.parts = spark, sf_dir, lambda lines=None: parts(spark, sf_dir, lines)
        out = build(spark, view)
        return out.selectExpr(*[(f"round(cast({n} as double), {6 if k == 'd' else 2}) + 0.0 as {n}" if k in "dz" else f"cast({n} as {TYPES[k]}) as {n}") for n, k in own.items()])

    return Query(run, expand(oracle, columns, 1) if oracle else None)
