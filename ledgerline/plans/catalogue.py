"""Catalogue, graph and rule queries over the document tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph
from ..operators.catalog import Catalog
from ..operators.rules import Rule, gaps, not_unique, report, unresolved, violates
from .dialect import Query, frame

#: What the checking engine folds with: its own removal of accents, over the letters of the tables the same.
FOLD = "lower(strip_accents({0}))"
#: Its slug: accents end a run of letters.
SLUG = "trim(regexp_replace(strip_accents(regexp_replace(lower({0}), '([à-öø-ÿ])', '\\1-', 'g')), '[^a-z0-9]+', '-', 'g'), '-')"


def items(view) -> DataFrame:
    """Documents as catalogue items: id, type, title (the first line), description and content."""
    d = view("documents")
    line = F.split("text", "\n")[0]
    return d.select(F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("type"), F.substring(line, 1, 40).alias("title"), line.alias("description"), F.col("text").alias("content"))


ITEMS = "it as (select concat('D-', cast(doc_id as varchar)) as id, lang as type, substring(string_split(text, chr(10))[1], 1, 40) as title, string_split(text, chr(10))[1] as description, text as content from documents)"


def _score(query: str, columns: tuple[str, ...] = ("id", "title", "description", "content")) -> str:
    parts = [FOLD.format(c) for c in columns]
    own = [f"case when {parts[0]} = '{query}' then 100 else 0 end", f"case when {parts[1]} = '{query}' then 80 else 0 end"]
    own += [f"case when contains({p}, '{query}') then {n} else 0 end" for p, n in zip(parts[1:], (35, 18, 8), strict=True)]
    words = [w for w in dict.fromkeys(re.findall(r"[a-z0-9]+(?:\.[0-9]+)?", query)) if len(w) > 1]
    own += [f"case when contains({p}, '{w}') then {n} else 0 end" for w in words for p, n in zip(parts, (14, 10, 5, 1), strict=True)]
    return " + ".join(own)


def _search(query: str, k: int, types: list[str] | None = None) -> Query:
    where = f"where type in ({', '.join(repr(t) for t in types)})" if types else ""
    return frame("id s, type s, title s, score i", lambda spark, view: Catalog(items(view)).search(query, k, types), f"with {ITEMS}, sc as (select id, type, title, {_score(query)} as score from it {where}) select id, type, title, score from sc where score > 0 order by score desc, id limit {k}")


def _edges(view) -> DataFrame:
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    t = view("txn")
    return graph.union_edges(
        t.select(name("P", "portfolio_id").alias("src"), name("B", "broker_id").alias("dst"), F.lit("trades_with").alias("verb")),
        t.select(name("B", "broker_id").alias("src"), name("I", "instrument_id").alias("dst"), F.lit("makes").alias("verb")),
        view("portfolio").select(name("P", "portfolio_id").alias("src"), name("N", "nation").alias("dst"), F.lit("domiciled").alias("verb")),
        parts=view.parts(250_000),  # two edges a line
    )


EDGES = "ed as (select distinct concat('P', cast(portfolio_id as varchar)) as src, concat('B', cast(broker_id as varchar)) as dst, 'trades_with' as verb from txn union select concat('B', cast(broker_id as varchar)), concat('I', cast(instrument_id as varchar)), 'makes' from txn union select concat('P', cast(portfolio_id as varchar)), concat('N', cast(nation as varchar)), 'domiciled' from portfolio)"

def cited(names: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id and whether the document of that id has a prefix of two words or more of the name in its text, in any case.

    A text that has a longer prefix has the first two words, so these decide.
    """
    words = F.regexp_extract_all("name", F.lit(r"(?U)(\S+)"), F.lit(1))
    first = F.lower(F.array_join(F.slice(words, 1, 2), " "))
    own = names.select("item_id", F.col("text").alias("name"))
    has = (F.size(words) >= 2) & F.contains(F.lower("content"), first)
    met = own.join(docs.select(F.col("doc_id").alias("item_id"), F.col("text").alias("content")), "item_id").filter(has).select("item_id", "name").distinct()
    return own.join(met.withColumn("cited", F.lit(True)), ["item_id", "name"], "left").select("item_id", F.coalesce("cited", F.lit(False)).alias("cited"))


RULES = [
    Rule("order_has_customer", "error", unresolved("orders", "o_custkey", "customer", "c_custkey")),
    Rule("line_has_part", "error", unresolved("lineitem", "l_partkey", "part", "p_partkey")),
    Rule("line_key", "warning", not_unique("lineitem", ["l_orderkey", "l_linenumber"])),
    Rule("balance", "warning", violates("customer", "c_custkey", "c_acctbal < 0", "balance is negative")),
    Rule("label_numbers", "warning", gaps("labels", "doc_id")),
]
RULE_TABLES = ["orders", "customer", "lineitem", "part", "labels"]

QUERIES: dict[str, Query] = {
    "a03_02_tokens": frame("doc_id l, n l", lambda spark, view: view("documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n")), f"select doc_id, len(list_filter(list_distinct(regexp_extract_all({FOLD.format('text')}, '([a-z0-9]+(?:\\.[0-9]+)?)', 1)), lambda t: length(t) > 1)) as n from documents"),
    "a03_08_slug": frame("item_id l, slug s", lambda spark, view: view("benchmark").select("item_id", X.slug(F.col("text")).alias("slug")), f"select item_id, {SLUG.format('text')} as slug from benchmark"),
    "a05_12_cited_text": frame("item_id l, cited b", lambda spark, view: cited(view("benchmark"), view("documents")), None),
    "a03_18_html_links": frame("page_id l, links l, items l", lambda spark, view: view("pages").select("page_id", F.size(X.anchors(F.col("html"))).alias("links"), F.size(X.list_items(F.col("html"))).alias("items")), "select page_id, len(regexp_extract_all(html, '(?is)<a\\s[^>]*href=[\"'']([^\"'']*)[\"'']', 1)) as links, len(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1)) as items from pages"),
    "a03_20_line_number": frame("doc_id l, line i", lambda spark, view: view("documents").select("doc_id", X.line_number(F.col("text"), F.lit("stupid")).alias("line")), "select doc_id, case when instr(text, 'stupid') > 0 then len(string_split(substring(text, 1, instr(text, 'stupid') - 1), chr(10))) end as line from documents"),
    "a06_01_count_by_type": frame("type s, count l", lambda spark, view: Catalog(items(view)).counts(), "select lang as type, count(*) as count from documents group by lang"),
    "a07_02_search": _search("stupid thing", 10),
    "a09_01_search_types": _search("the tion", 20, ["en", "fr"]),
    "a09_02_get": frame("id s, type s, title s", lambda spark, view: Catalog(items(view)).get("d-17"), f"with {ITEMS} select id, type, title from it where lower(id) = 'd-17'"),
    "a05_01_one_hop": frame("src s, dst s, src_label s, dst_label s", lambda spark, view: graph.match(_edges(view), view("portfolio").select(F.concat(F.lit("P"), F.col("portfolio_id").cast("string")).alias("id"), F.col("segment").alias("label")).unionByName(view("place").select(F.concat(F.lit("N"), F.col("nation").cast("string")).alias("id"), F.col("nation_name").alias("label"))), "domiciled"), "select concat('P', cast(portfolio_id as varchar)) as src, concat('N', cast(nation as varchar)) as dst, segment as src_label, nation_name as dst_label from portfolio"),
    "a05_02_never_source": frame("id s", lambda spark, view: graph.without(_edges(view), view("party").filter("kind = 'C'").select(F.concat(F.lit("P"), F.col("party_id").cast("string")).alias("id")), "trades_with"), "select concat('P', cast(party_id as varchar)) as id from party where kind = 'C' and not exists (select 1 from txn where portfolio_id = party_id)"),
    "a05_10_two_sided": frame("portfolio_id l, broker_id l, defect s, severity s", lambda spark, view: graph.one_sided(view("txn").filter("side = 1"), view("txn").filter("side = -1"), ["portfolio_id", "broker_id"], view("txn").filter("broker_id % 10 = 0")), "with a as (select distinct portfolio_id as p, broker_id as b from txn where side = 1), c as (select distinct portfolio_id as p, broker_id as b from txn where side = -1) select coalesce(a.p, c.p) as portfolio_id, coalesce(a.b, c.b) as broker_id, case when a.p is null then 'missing_left' else 'missing_right' end as defect, case when coalesce(a.b, c.b) % 10 = 0 then 'warning' else 'error' end as severity from a full outer join c on a.p = c.p and a.b = c.b where a.p is null or c.p is null"),
    "a08_01_edge_kinds": frame("verb s, n l", lambda spark, view: _edges(view).groupBy("verb").agg(F.count("*").alias("n")), f"with {EDGES} select verb, count(*) as n from ed group by verb"),
    "a08_06_inverse": frame("verb s, n l", lambda spark, view: graph.inverse(_edges(view), spark.createDataFrame([("makes", "made_by"), ("domiciled", "home_of")], "verb string, inverse string")).groupBy("verb").agg(F.count("*").alias("n")), f"with {EDGES}, i as (select 'makes' as v, 'made_by' as inv union all select 'domiciled', 'home_of') select verb, count(*) as n from (select verb from ed union all select inv from ed join i on verb = v) as x group by verb"),
    "a10_20_rule_report": frame("rule s, severity s, subject s, message s", lambda spark, view: report(RULES, {t: view(t) for t in RULE_TABLES}), """
        select 'order_has_customer' as rule, 'error' as severity, cast(o_custkey as varchar) as subject, 'orders.o_custkey has no customer' as message from orders where o_custkey is not null and not exists (select 1 from customer where c_custkey = o_custkey)
        union all select 'line_has_part', 'error', cast(l_partkey as varchar), 'lineitem.l_partkey has no part' from lineitem where not exists (select 1 from part where p_partkey = l_partkey)
        union all select 'line_key', 'warning', concat(cast(l_orderkey as varchar), '/', cast(l_linenumber as varchar)), 'lineitem repeats l_orderkey/l_linenumber' from (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1) as x
        union all select 'balance', 'warning', cast(c_custkey as varchar), 'balance is negative' from customer where c_acctbal < 0
        union all select 'label_numbers', 'warning', cast(k as varchar), 'labels.doc_id is missing' from (select unnest(generate_series((select min(doc_id) from labels), (select max(doc_id) from labels))) as k) as g where not exists (select 1 from labels where doc_id = k)"""),
}
