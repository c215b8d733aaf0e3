"""Reference checks, counts, numbering and set operations of the catalogue (A4 to A8) as statements: name -> (columns, text)."""

STATEMENTS: dict[str, tuple[str, str]] = {
    "a04_01_type_filter": ("lang s, n l", "select lang, count(*) as n from documents where lang in ('en', 'de') group by lang"),
    "a04_03_projection": ("doc_id l, lang s, source s", "select doc_id, lang, source from documents where n_chars > 2000"),
    "a04_06_cross_domain": ("was l, now l, n l", "select p.region as was, q.region as now, count(*) as n from txn join portfolio as p on txn.portfolio_id = p.portfolio_id join party on broker_id = party_id and kind = 'S' join place as q on party.nation = q.nation where p.region <> q.region group by 1, 2"),
    "a05_04_resolving_refs": ("portfolio_id l, ref l", "select distinct portfolio_id, broker_id as ref from txn where broker_id <> portfolio_id and exists (select 1 from party where kind = 'S' and party_id = broker_id)"),
    "a05_08_link_check": ("id l, defect s", "with a as (select distinct doc_id as l from documents), b as (select distinct doc_id as r from labels) select coalesce(l, r) as id, case when l is null then 'dead_link' else 'unlinked' end as defect from a full outer join b on l = r where l is null or r is null"),
    "a05_14_relation_coverage": ("portfolio_id l, verbs l", "select portfolio.portfolio_id, count(distinct ord.priority) as verbs from portfolio left join ord on portfolio.portfolio_id = ord.portfolio_id group by 1 having count(distinct ord.priority) <> 5"),
    "a05_15_all_edges": ("src_kind s, dst_kind s, n l", "select 'order' as src_kind, 'portfolio' as dst_kind, count(*) as n from ord union all select 'txn', 'order', count(*) from txn union all select 'txn', 'instrument', count(*) from txn union all select 'portfolio', 'nation', count(*) from portfolio"),
    "a05_18_polymorphic_key": ("kind s, resolved l", "with x as (select event_id, case when event_id % 2 = 0 then 'C' else 'S' end as discriminator, user_id as ref from obs) select discriminator as kind, count(party_id) as resolved from x left join party on discriminator = kind and ref = party_id group by 1"),
    "a06_02_duplicates": ("order_id l, line l, n l", "select order_id, line, count(*) as n from txn group by 1, 2 having count(*) > 1"),
    "a06_03_contiguity": ("order_id l, contiguous b", "select order_id, min(line) = 1 and max(line) = count(*) and count(distinct line) = count(*) as contiguous from txn group by 1"),
    "a06_05_pack_counts": ("lang s, source s, n l", "select lang, source, count(*) as n from documents group by rollup(lang, source)"),
    "a06_06_subtotals": ("region_name s, declared l, actual l, ok b", "with a as (select region_name, count(*) as actual from portfolio group by 1), d as (select r_name as region_name, (select count(*) from customer where c_nationkey = r_regionkey) * 5 as declared from region) select coalesce(a.region_name, d.region_name) as region_name, coalesce(declared, 0) as declared, coalesce(actual, 0) as actual, coalesce(declared, 0) = coalesce(actual, 0) as ok from a full outer join d on a.region_name = d.region_name"),
    "a06_08_bijective": ("inverse s, n l", "with v as (select distinct priority as verb, case when priority < '3' then 'early' else lower(priority) end as inverse from ord) select inverse, count(*) as n from v group by 1 having count(*) > 1"),
    "a06_09_edge_kinds": ("portfolio_id l, broker_id l, kinds s", "select portfolio_id, broker_id, CAT(flag) as kinds from txn group by 1, 2 having count(distinct flag) > 1"),
    "a06_11_distinct_pairs": ("nation l, broker_nation l", "select distinct portfolio.nation, party.nation as broker_nation from txn join portfolio on txn.portfolio_id = portfolio.portfolio_id join party on broker_id = party_id and kind = 'S'"),
    "a07_01_numbering": ("conv_id l, turn l, ordinal i", "select conv_id, turn, row_number() over (partition by conv_id order by turn, role, text) as ordinal from conversations"),
    "a07_06_set_difference": ("instrument_id l", "select instrument_id from instrument except select instrument_id from txn where side = -1 and trade_date >= date '2001-01-01'"),
    "a10_15_deferral_language": ("doc_id l, hits l", "select doc_id, (case when lower(text) like '%later%' then 1 else 0 end) + (case when lower(text) like '%to be%' then 1 else 0 end) + (case when lower(text) like '%stupid%' then 1 else 0 end) as hits from documents where lower(text) like '%later%' or lower(text) like '%to be%' or lower(text) like '%stupid%'"),
    "a10_21_shape_constraints": ("constraint_id s, failed l", "select 'c_name:minCount' as constraint_id, sum(case when c_name is null then 1 else 0 end) as failed from customer union all select 'c_custkey:maxCount', count(*) - count(distinct c_custkey) from customer union all select 'o_custkey:class', sum(case when c_custkey is null then 1 else 0 end) from orders left join customer on o_custkey = c_custkey union all select 'p_size:datatype', sum(case when p_size < 0 then 1 else 0 end) from part"),
}
