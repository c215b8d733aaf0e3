"""Queries over model trees, second part: text functions, graphs, catalogue tools and validator rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import integrity as I
from ..sources import model as M
from . import modelfiles as W
from .catalogue import FOLD, ITEMS, _score
from .catalogue import items as document_items
from .dialect import Query, frame
from .model import BOUND, FOLDER, ITEM_COUNTS, PLAIN, SD_PATH, SDB, SITE, TREE, R, _bound, _chain, _edges, _validation, bds, catalog, counts, ents, items, numbers, one, pages, sds

#: Text of a reference list in a file: joined in order.
LISTED = "array_to_string(list_sort(list_distinct(list({0}))), ', ')"
#: Scores of a query over the catalogue's rows (id, title, description, content), each folded.
CATALOG = f"""
bo as (select root, sd_id, name, {PLAIN.format('name')} as plain, bd_name, applies, nk from {SDB} as x),
it as (select concat('r', cast(root as varchar), '/', sd_id) as id, 'service-domain' as type, plain as title, concat(plain, ' serves clients of ', bd_name, '. Second line.') as description from bo
       union all select concat('r', cast(root as varchar), '/', sd_id, ':op-1'), 'service-operation', concat('Book ', plain), 'books it' from bo
       union all select concat('r', cast(root as varchar), '/', entity_id), 'entity', {PLAIN.format('name')}, concat('Row of ', {PLAIN.format('name')}, ' and its keys.') from m_ent)"""


def _no_content(view):
    """The catalogue without contents, domains, operations and entities only: what CATALOG says."""
    own = items(view).filter("type in ('service-domain', 'service-operation', 'entity')").drop("root").withColumn("content", F.lit(""))
    from ..operators.catalog import Catalog

    return Catalog(own, "1", {"name": "Model", **SITE})


def _points(query: str) -> str:
    return _score(query, ("id", "title", "description", "''"))


def _prose(view) -> DataFrame:
    return one(view, "prose")


def _rendered(view) -> DataFrame:
    return I.page_coverage(pages(view), sds(view), ents(view))


def _declared(view) -> DataFrame:
    return reduce(DataFrame.unionByName, [I.ids(bds(view), "bd_id"), I.ids(sds(view), "sd_id"), I.ids(ents(view), "entity_id")])


def _exported(view, ids: DataFrame, text: str, lost: str) -> DataFrame:
    """An export's text a tree: an element for each id, but for those that end in ``lost``."""
    return ids.filter(~F.col("id").endswith(lost)).groupBy("root").agg(F.array_join(F.array_sort(F.collect_list(F.format_string(text, "id"))), "\n").alias("value"))


IDS = "(select root, bd_id as id from m_bd union all select root, sd_id from m_sd union all select root, entity_id from m_ent)"
TEXTS: dict[str, Query] = {
    "a03_01_fold": frame("doc_id l, folded s", lambda spark, view: view("documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded")), f"select doc_id, md5({FOLD.format('text')}) as folded from documents"),
    "a03_03_score": frame("id s, score i", lambda spark, view: document_items(view).select("id", F.explode(X.relevance(" The ation 2.5 ", F.col("id"), F.col("title"), F.col("description"), F.col("content"))).alias("score")), f"with {ITEMS} select id, score from (select id, {_score('the ation 2.5')} as score from it) as x where score > 0"),
    "a03_04_clean_inline": frame("doc_id l, clean s", lambda spark, view: view("documents").select("doc_id", F.md5(X.clean_inline(F.col("text"))).alias("clean")), r"select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[`*_>#]', '', 'g'), '[ \t\n\f\r\x0B]+', ' ', 'g'))) as clean from documents"),
    "a03_05_first_paragraph": frame("root s, first s", lambda spark, view: M.below(W.entities(view), "model/").select("root", X.first_paragraph(F.regexp_replace("value", r"^# .+\r?\n", "")).alias("first")), f"select {R}, concat('Row of ', {PLAIN.format('name')}, ' and its keys.') as first from m_ent"),
    "a03_06_section": frame("root s, sd_id s, purpose s", lambda spark, view: sds(view).select("root", "sd_id", X.section(F.col("value"), "Purpose").alias("purpose")), f"select {R}, sd_id, concat(name, ' serves *clients* of [', bd_name, '](x.md).', chr(10), 'Second line.', chr(10), chr(10), 'More prose.') as purpose from {SDB} as x"),
    "a03_07_heading": frame("id s, title s", lambda spark, view: W.service_domains(view).unionByName(one(view, "index")).select(X.heading(F.col("value")).alias("h")).select("h.*"), f"select sd_id as id, {PLAIN.format('name')} as title from m_sd union all select '', 'Index' from m_root"),
    "a03_09_urls": frame("source_url s, official_url s", lambda spark, view: M.below(W.service_domains(view), "model/").select(X.source_url(F.col("source_path"), SITE).alias("source_url"), X.official_url(F.col("source_path"), "service-domain", SITE).alias("official_url")), f"""
        select concat('https://code.example/model/blob/v1/', {SD_PATH}) as source_url, concat('https://model.example/model/', lower({FOLDER}), '/', lower(sd_id), '-', lower(replace(replace(name, ' ', '-'), '_', '-')), '/') as official_url from {SDB} as x"""),
    "a03_10_references": frame("root s, sd_id s, ref s, kind s", lambda spark, view: M.sd_references(sds(view)), f"select {R}, sd_id, ref, kind from m_ref"),
    "a03_11_bold_block": frame("root s, sd_id s, owns s, consumes s", lambda spark, view: sds(view).select("root", "sd_id", "owns", "consumes"), f"""
        select {R}, s.sd_id, coalesce((select {LISTED.format('ref')} from m_uses as u where u.root = s.root and u.sd_id = s.sd_id and u.kind = 'owns-entity'), 'none') as owns,
               concat_ws('; ', case when nk % 3 <> 1 then case when nk % 2 = 0 then 'E-04 any `book`' else 'E-04 positions' end end, case when nk % 3 <> 2 then 'E-07 any `method`' end,
                         (select {LISTED.format('ref')} from m_says as u where u.root = s.root and u.sd_id = s.sd_id and u.kind = 'consumes-sd')) as consumes from m_sd as s"""),
    "a03_12_operation_names": frame("root s, sd_id s, name s", lambda spark, view: M.operations(sds(view)).select("root", "sd_id", "name"), f"select {R}, sd_id, concat(verb, ' ', name) as name from m_sd cross join (select unnest(['Book', 'Check', 'Close']) as verb) as v"),
    "a03_13_entity_ids": frame("root s, entity_id s, target s, is_self b", lambda spark, view: M.foreign_keys(ents(view)), f"select {R}, entity_id, target, is_self from m_fk"),
    "a03_14_parent_domain": frame("root s, ref s, parent s", lambda spark, view: M.sd_references(sds(view)).select("root", "ref", X.domain_of(F.col("ref")).alias("parent")).distinct(), f"select distinct {R}, ref, case when ref like 'SD-%' then concat('BD-', substring(ref, 4, 2)) when ref like 'BD-%' then ref end as parent from m_ref"),
    "a03_15_operation_ids": frame("so_id s, name s", lambda spark, view: M.operations(sds(view)).select("so_id", "name"), "select concat('so-', substring(sd_id, 4), '-0', cast(k as varchar)) as so_id, concat(verb, ' ', name) as name from m_sd cross join (values (1, 'Book'), (2, 'Check'), (3, 'Close')) as v(k, verb)"),
    "a03_16_offices": frame("root s, bd_id s, bucket s", lambda spark, view: bds(view).select("root", "bd_id", X.office(F.col("office")).alias("bucket")), f"select {R}, bd_id, case bd when 1 then 'Front' when 2 then 'Middle' when 3 then 'Back' when 4 then 'Cross-cutting' else 'Commercial' end as bucket from m_bd"),
    "a03_17_curie_tokens": frame("sd_id s, prefix s, name s", lambda spark, view: sds(view).select("sd_id", F.explode(F.concat(X.curies(F.col("value"), X.CURIE_CLASS), X.curies(F.col("value"), X.CURIE_PROPERTY))).alias("t")).select("sd_id", "t.*"), """
        select sd_id, 'fibo-be-le' as prefix, 'LegalEntity' as name from m_sd union all select sd_id, 'fibo-be-le', 'Bogus' from m_sd where nk % 9 = 4 union all select sd_id, 'cmns-zz', 'Thing' from m_sd where nk % 10 = 6
        union all select sd_id, 'fibo-be-le', 'owns' from m_sd where nk % 4 = 0 union all select sd_id, 'cmns-id', 'names' from m_sd where nk % 7 = 5"""),
    "a03_19_match_predicates": frame("root s, page s, carries b, leads b", lambda spark, view: pages(view).select("root", "page", X.carries_name(X.list_items(F.col("value")), F.lit("SD-01.1")).alias("carries"), X.resolves_to(X.anchors(F.col("value")), F.lit("sd-01.1.html")).alias("leads")), f"""
        with l as (select root, bd_id as id, sd_id as x from m_sd union select root, sd_id, ref from m_ref where kind in ('upstream', 'downstream') union select root, entity_id, sd_id from m_link),
        ids as (select root, bd_id as id from m_bd union all select root, sd_id from m_sd where sd_id not like '%03.4' union all select root, entity_id from m_ent),
        p as (select root, id, exists (select 1 from l where l.root = ids.root and l.id = ids.id and x like 'SD-01_1') as y from ids
              union all select root, 'index', true from m_root union all select root, 'landscape', false from m_root union all select root, 'erd', false from m_root)
        select {R}, case when id like 'SD-%' then concat('sd-', substring(id, 4), '.html') when id like 'BD-%' then concat('bd-', substring(id, 4), '.html') when id like '%-%' then concat('entity-', id, '.html') else concat(id, '.html') end as page, y as carries, y as leads from p"""),
    "a04_02_positive_score": frame("type s, n l", lambda spark, view: document_items(view).withColumn("score", F.explode(X.relevance("the zzz", F.col("id"), F.col("title"), F.col("description"), F.col("content")))).groupBy("type").agg(F.count("*").alias("n")), f"with {ITEMS} select type, count(*) as n from (select type, {_score('the zzz')} as score from it) as x where score > 0 group by 1"),
    "a04_04_point_lookup": frame("id s, title s, model_version s", lambda spark, view: catalog(view).get("R0/Sd-01.2").select("id", "title", "model_version"), f"select concat('r0/', sd_id) as id, {PLAIN.format('name')} as title, '1' as model_version from m_sd where root = 0 and nk = 5"),
    "a04_05_edges_within": frame("root s, src s, dst s, kind s", lambda spark, view: G.within(_edges(view), 3), f"select {R}, src, dst, kind from m_edge where src like 'SD-03.%' and dst like 'SD-03.%'"),
    "a04_07_validation": frame("tool s, given s, valid b", _validation, "select * from (values ('search', 'a', false), ('search', 'ab', true), ('search', '', false), ('get', 'E', false), ('get', 'E-01', true), ('map_requirement', 'risk', false), ('map_requirement', 'risks', true), ('map_requirement', 'a big need', true)) as t(tool, given, valid)"),
}

CHECKS: dict[str, Query] = {
    "a05_03_recursive_walk": frame("start l, node l, depth i", lambda spark, view: G.walk(_chain(spark, view), "part_of"), f"with recursive {TREE} select start, node, min(depth) as depth from tr group by 1, 2"),
    "a05_05_domain_references": frame("root s, sd_id s, ref s, kind s", lambda spark, view: I.domain_references(sds(view), bds(view)), f"select {R}, sd_id, ref, kind from m_ref where kind in ('consumes-sd', 'produces-sd', 'upstream', 'downstream') and ref not in (select sd_id from m_sd union all select bd_id from m_bd)"),
    "a05_06_entity_references": frame("root s, entity_id s, ref s, kind s", lambda spark, view: I.entity_references(ents(view)), f"select {R}, entity_id, ref, kind from (select root, entity_id, target as ref, 'fk' as kind from m_fk where not is_self union all select root, entity_id, parent, 'specialises' from m_ent where parent is not null) as x where not exists (select 1 from m_ent as e where e.root = x.root and e.entity_id = ref)"),
    "a05_07_entity_domains": frame("root s, entity_id s, ref s, kind s", lambda spark, view: I.entity_domains(ents(view), sds(view)), f"select distinct {R}, entity_id, sd_id as ref, kind from m_link where sd_id not in (select sd_id from m_sd)"),
    "a05_09_owner_side": frame("root s, entity_id s, sd_id s, defect s", lambda spark, view: I.owner_side(M.ownership(one(view, "ownership")), sds(view)), f"""
        select concat('r', cast(m.root as varchar)) as root, m.entity_id, m.sd_id, case when h.k is null then 'says_none' else 'not_named' end as defect from m_map as m
        left join (select distinct root as hr, sd_id as hs, 1 as k from m_uses where kind = 'owns-entity') as h on hr = m.root and hs = m.sd_id
        where not exists (select 1 from m_uses as u where u.root = m.root and u.sd_id = m.sd_id and u.ref = m.entity_id and u.kind = 'owns-entity')"""),
    "a05_11_declaration_window": frame("root s, source_path s, entity_id s", lambda spark, view: I.partitions(W.service_domains(view)), f"select {R}, {SD_PATH} as source_path, 'E-04' as entity_id from {SDB} as x where nk % 3 <> 1 and nk % 2 = 1"),
    "a05_12_cited_name": frame("root s, source_path s, sd_id s, cited s, defect s", lambda spark, view: I.cited_names(W.service_domains(view), sds(view)), f"""
        select {R}, {SD_PATH} as source_path, n as sd_id, 'Asset Ledger' as cited, 'other_name' as defect from {SDB} as x join (select (nk + 24) % 25 as k, sd_id as n from m_place) as p on p.k = x.nk where nk % 7 = 3
        union all select {R}, {SD_PATH}, concat('SD-', '99.', '1'), 'Lost Domain', 'no_domain' from {SDB} as x where nk % 12 = 5"""),
    "a05_13_curies": frame("root s, source_path s, prefix s, name s, defect s", lambda spark, view: I.curie_tokens(W.service_domains(view), M.curies(one(view, "curies"))), f"select {R}, {SD_PATH} as source_path, 'fibo-be-le' as prefix, 'Bogus' as name, 'unknown_name' as defect from {SDB} as x where nk % 9 = 4 union all select {R}, {SD_PATH}, 'cmns-zz', 'Thing', 'unknown_prefix' from {SDB} as x where nk % 10 = 6"),
    "a05_16_page_join": frame("root s, entity_id s, owners s, users s, targets s", lambda spark, view: reduce(lambda a, b: a.join(b, ["root", "entity_id"], "left"), [
        ents(view).select("root", "entity_id"), *[M.links(ents(view)).filter(F.col("kind") == kind).groupBy("root", "entity_id").agg(F.array_join(F.array_sort(F.collect_set("sd_id")), ", ").alias(name)) for kind, name in (("owned_by", "owners"), ("consumed_by", "users"))],
        M.foreign_keys(ents(view)).filter("not is_self").groupBy("root", "entity_id").agg(F.array_join(F.array_sort(F.collect_set("target")), ", ").alias("targets"))]), f"""
        select {R}, entity_id, (select {LISTED.format('sd_id')} from m_link as l where l.root = e.root and l.entity_id = e.entity_id and kind = 'owned_by') as owners, (select {LISTED.format('sd_id')} from m_link as l where l.root = e.root and l.entity_id = e.entity_id and kind = 'consumed_by') as users,
               nullif((select {LISTED.format('target')} from m_fk as f where f.root = e.root and f.entity_id = e.entity_id and not is_self), '') as targets from m_ent as e"""),
    "a05_17_page_coverage": frame("root s, page s, defect s, subject s", lambda spark, view: _rendered(view), f"""
        select {R}, 'sd-03.4.html' as page, 'missing_page' as defect, cast(null as varchar) as subject from m_root
        union all select {R}, concat('sd-', substring(sd_id, 4), '.html'), 'missing_operation', concat('Check ', name) from m_sd where bd = 2
        union all select {R}, 'entity-E-02.html', 'missing_key', concat('entity-', target, '.html') from m_fk where entity_id = 'E-02' and not is_self"""),
    "a06_04_layer_counts": frame("root s, core l, specialised l", lambda spark, view: ents(view).groupBy("root").agg(F.count_if(F.col("pack") == "core").alias("core"), F.count_if(F.col("pack") != "core").alias("specialised")), f"select {R}, c as core, s as specialised from (select root, count(*) filter (where prefix = 'E') as c, count(*) filter (where prefix <> 'E') as s from m_ent group by 1) as x"),
    "a06_10_groups": frame("root s, kind s, bucket s, members s", lambda spark, view: ents(view).groupBy("root", F.lit("pack").alias("kind"), F.col("pack").alias("bucket")).agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("members")).unionByName(bds(view).groupBy("root", F.lit("office").alias("kind"), X.office(F.col("office")).alias("bucket")).agg(F.array_join(F.array_sort(F.collect_list("bd_id")), ",").alias("members"))), f"""
        select {R}, 'pack' as kind, pack as bucket, string_agg(entity_id, ',' order by entity_id) as members from m_ent group by root, pack
        union all select {R}, 'office', case bd when 1 then 'Front' when 2 then 'Middle' when 3 then 'Back' when 4 then 'Cross-cutting' else 'Commercial' end, bd_id from m_bd"""),
    "a07_03_global_sort": frame("nth l, id s", lambda spark, view: items(view).filter("type = 'entity'").selectExpr("id", "row_number() over (partition by substring_index(id, '/', 1) order by id) as nth"), "select row_number() over (partition by root order by entity_id) as nth, concat('r', cast(root as varchar), '/', entity_id) as id from m_ent"),
    "a07_04_numeric_sort": frame("root s, nth l, bd_id s, sd_id s", lambda spark, view: sds(view).selectExpr("root", "bd_id", "sd_id", "row_number() over (partition by root order by bd, sd) as nth"), f"select {R}, row_number() over (partition by root order by bd, sd) as nth, bd_id, sd_id from m_sd"),
    "a07_05_union_dedup": frame("src l, dst l, kind s", lambda spark, view: reduce(DataFrame.unionByName, [view("txn").filter(f"side = {s}").select(F.col("portfolio_id").alias("src"), F.col("instrument_id").alias("dst"), F.lit(k).alias("kind")) for s, k in ((1, "buy"), (-1, "sell"))]).dropDuplicates(["src", "dst", "kind"]), "select portfolio_id as src, instrument_id as dst, 'buy' as kind from txn where side = 1 union select portfolio_id, instrument_id, 'sell' from txn where side = -1"),
    "a07_07_distinct_references": frame("root s, entity_id s, refs s", lambda spark, view: ents(view).select("root", "entity_id", F.array_join(F.array_sort(F.array_distinct("owned_by")), ",").alias("refs")), f"select {R}, entity_id, string_agg(distinct sd_id, ',' order by sd_id) as refs from m_link where kind = 'owned_by' group by root, entity_id"),
    "a07_08_union_in_recursion": frame("depth i, n l", lambda spark, view: G.walk(_chain(spark, view)).groupBy("depth").agg(F.count("*").alias("n")), f"with recursive {TREE} select depth, count(*) as n from (select start, node, min(depth) as depth from tr group by 1, 2) as x group by 1"),
    "a08_01_capability_graph": frame("root s, src s, dst s, kind s", lambda spark, view: _edges(view), f"select {R}, src, dst, kind from m_edge"),
    "a08_02_entity_graph": frame("root s, src s, dst s, kind s", lambda spark, view: G.entity_edges(ents(view)), f"select {R}, entity_id as src, target as dst, 'fk' as kind from m_fk where not is_self union all select {R}, entity_id, parent, 'specialises' from m_ent where parent is not null"),
    "a08_03_property_graph": frame("src s, dst s, verb s, src_label s, dst_label s", lambda spark, view: G.match(_bound(view).withColumns({"src": F.concat_ws("/", "root", "src"), "dst": F.concat_ws("/", "root", "dst")}).select("src", "dst", "verb"), ents(view).select(F.concat_ws("/", "root", "entity_id").alias("id"), F.col("pack").alias("label")), "1_URGENT"), f"""
        select concat('r', cast(x.root as varchar), '/', src) as src, concat('r', cast(x.root as varchar), '/', dst) as dst, verb, a.pack as src_label, b.pack as dst_label from {BOUND} as x
        join m_ent as a on a.root = x.root and a.entity_id = src join m_ent as b on b.root = x.root and b.entity_id = dst where verb = '1_URGENT'"""),
    "a08_04_typed_schema": frame("src s, dst s, verb s", lambda spark, view: G.ill_typed(_bound(view).select(F.concat_ws("/", "root", "src").alias("src"), F.concat_ws("/", "root", "dst").alias("dst"), "verb"), ents(view).select(F.concat_ws("/", "root", "entity_id").alias("id"), F.col("pack").alias("label")), spark.createDataFrame([(v, p, "core") for v in ("1_URGENT", "2_HIGH", "3_MEDIUM") for p in ("core", "derivatives")], "verb string, src_label string, dst_label string")), f"""
        select concat('r', cast(x.root as varchar), '/', src) as src, concat('r', cast(x.root as varchar), '/', dst) as dst, verb from {BOUND} as x left join m_ent as a on a.root = x.root and a.entity_id = src left join m_ent as b on b.root = x.root and b.entity_id = dst where not (verb in ('1_URGENT', '2_HIGH', '3_MEDIUM') and coalesce(a.pack, '') in ('core', 'derivatives') and coalesce(b.pack, '') = 'core')"""),
    "a08_05_graph_statements": frame("root s, line s", lambda spark, view: G.cypher(ents(view).select("root", F.col("entity_id").alias("id"), "name", "pack"), _bound(view)).select("root", "line"), f"""
        select {R}, concat('CREATE (:Entity {{id: ''', entity_id, ''', name: ''', name, ''', pack: ''', pack, '''}});') as line from m_ent
        union all select {R}, concat('MATCH (a:Entity {{id: ''', src, '''}}), (b:Entity {{id: ''', dst, '''}}) CREATE (a)-[:`', verb, '` {{kind: ''association'', inverse: ''', inverse, ''', cardinality: ''n-1'', column: ''owner_id''}}]->(b);') from {BOUND} as x"""),
    "a08_07_hierarchy": frame("start l, last l, depth i", lambda spark, view: G.chain_ends(_chain(spark, view).filter("dst > 0")), "with recursive tr as (select 1 as depth, instrument_id as start, IDIV(instrument_id, 2) as node from instrument where instrument_id > 1 union all select depth + 1, start, IDIV(node, 2) from tr where node > 1) select start, max_by(node, depth) as last, max(depth) as depth from tr group by 1"),
    "a09_03_map_requirement": frame("id s, type s, title s, description s, score i, model_version s", lambda spark, view: _no_content(view).map_requirement("book asset nation 12", 15), f"with {CATALOG} select id, type, title, description, {_points('book asset nation 12')} as score, '1' as model_version from it where score > 0 order by score desc, id limit 15"),
    "a09_04_list_exports": frame("id s, title s, description s, source_path s, source_url s, official_url s", lambda spark, view: catalog(view).list_exports(), """
        select concat('r', cast(root as varchar), '/export:', f) as id, f as title, concat('Released ', upper(x), ' model artefact.') as description, concat('exports/', f) as source_path, concat('https://code.example/model/raw/v1/exports/', f) as source_url, concat('https://model.example/exports/', f) as official_url
        from (select root, x, concat(lower(replace(name, ' ', '-')), '.', x) as f from m_sd cross join (select unnest(['csv', 'TTL', 'json']) as x) as k) as y"""),
    "a09_05_identity": frame("model_version s, official_source s, type s, n l", lambda spark, view: catalog(view).get_identity().select("model_version", "official_source", F.explode("counts").alias("type", "n")), f"select '1' as model_version, 'https://model.example/' as official_source, type, n from ({ITEM_COUNTS}) as x"),
    "a09_06_resources": frame("uri s, name s, entities l", lambda spark, view: catalog(view).resources().select("uri", F.get_json_object("text", "$.name").alias("name"), F.get_json_object("text", "$.counts.entity").cast("long").alias("entities")), "select 'catalog://identity' as uri, 'Model' as name, cast(null as bigint) as entities union all select 'catalog://summary', null, count(*) from m_ent"),
    "a09_07_suggestions": frame("id s, title s, found b", lambda spark, view: _no_content(view).get_or_suggest("Nation 7").select("id", "title", "found"), f"with {CATALOG} select id, title, false as found from (select id, title, {_points('nation 7')} as score from it) as x where score > 0 order by score desc, id limit 5"),
}

VALIDATOR: dict[str, Query] = {
    "a10_01_file_shape": frame("root s, sd_id s, severity s, missing s", lambda spark, view: I.file_shape(W.service_domains(view)), f"select {R}, sd_id, 'warning' as severity, '## Open extensions' as missing from m_sd where nk % 4 = 2"),
    "a10_02_index_agreement": frame("root s, bd i, declared l, actual l, defect s", lambda spark, view: I.declared_counts(M.index_summary(one(view, "index"))[1], counts(view)), f"select {R}, bd, n + 1 as declared, n as actual, 'other_count' as defect from m_count where bd = 3 union all select {R}, bd, null, n, 'no_row' from m_count where bd = 5 union all select {R}, 9, 2, null, 'no_domain' from m_root"),
    "a10_03_readme_counts": frame("root s, label s, stated_bd l, stated_sd l", lambda spark, view: I.stated_pairs(_prose(view), numbers(view), {"readme": I.README_PAIR}, "README"), f"select {R}, 'readme' as label, b as stated_bd, n - 1 as stated_sd from (select root, count(*) as b, sum(n) as n from m_count group by 1) as x"),
    "a10_04_paired_phrases": frame("root s, label s, stated_bd l, stated_sd l", lambda spark, view: I.stated_pairs(_prose(view), numbers(view), I.PAIRS, "README"), f"select {R}, 'model total' as label, b as stated_bd, n - 1 as stated_sd from (select root, count(*) as b, sum(n) as n from m_count group by 1) as x"),
    "a10_05_prose_counts": frame("root s, label s, stated l, actual l", lambda spark, view: I.stated_numbers(_prose(view), numbers(view), I.PROSE, "README"), f"""
        with x as (select m_count.root, count(*) as b, sum(n) as s, max(t) as t from m_count join (select root as r2, count(*) as t from m_ent group by 1) as e on r2 = m_count.root group by 1)
        select {R}, 'all business domains' as label, b + 1 as stated, b as actual from x union all select {R}, 'model total', b, s from x union all select {R}, 'with the core', t - 1, t from x"""),
    "a10_06_index_prose": frame("root s, label s, stated_bd l, stated_sd l", lambda spark, view: I.stated_pairs(_prose(view).withColumn("value", F.concat("value", F.lit("| current 1 BD / 2 SD |\n"))), numbers(view), I.PAIRS, "README", skip_tables=True), f"select {R}, 'model total' as label, b as stated_bd, n - 1 as stated_sd from (select root, count(*) as b, sum(n) as n from m_count group by 1) as x"),
    "a10_07_annotations": frame("root s, bd i, stated l, actual l", lambda spark, view: I.annotations(_prose(view), counts(view), "README"), f"select {R}, bd, 4 as stated, n as actual from m_count where bd = 2 union all select {R}, 8, 1, null from m_root"),
    "a10_08_row_tables": frame("root s, bd i, defect s", lambda spark, view: I.declared_counts(M.domain_rows(M.below(one(view, "index").unionByName(_prose(view)), r"\.md$")), counts(view)), f"select {R}, 3 as bd, 'other_count' as defect from m_root union all select {R}, 5, 'no_row' from m_root union all select {R}, 9, 'no_domain' from m_root"),
    "a10_09_map_subtotals": frame("root s, rule s, subject s, stated l, actual l", lambda spark, view: I.office_subtotals(M.offices(one(view, "map")), counts(view)), f"""
        select {R}, 'subtotal' as rule, 'OFFICE2' as subject, n as stated, n - 1 as actual from m_count where bd = 2 union all select {R}, 'subtotal', 'OFFICE4', n + 1, n from m_count where bd = 4
        union all select {R}, 'cell', 'BD-02', n - 1, n from m_count where bd = 2 union all select {R}, 'absent', 'BD-05', null, n from m_count where bd = 5
        union all select {R}, 'total', 'all', a, b from (select root, sum(case bd when 4 then n + 1 when 5 then 0 else n end) as a, sum(n) as b from m_count group by 1) as x"""),
    "a10_10_maturity": frame("root s, bd_id s, stated l, actual l", lambda spark, view: I.maturity_counts(bds(view), counts(view)), f"select {R}, bd_id, n + 1 as stated, n as actual from m_count where bd = 4"),
    "a10_11_curie_sweep": frame("root s, prefix s, name s, defect s, n l", lambda spark, view: I.curie_sweep(W.service_domains(view).unionByName(W.business_domains(view).withColumn("path", F.concat(F.lit("x"), "path"))), one(view, "curies")).groupBy("root", "prefix", "name", "defect").agg(F.count("*").alias("n")), f"""
        select {R}, 'fibo-be-le' as prefix, 'Bogus' as name, 'unknown_name' as defect, count(*) as n from m_sd where nk % 9 = 4 group by root union all select {R}, 'cmns-zz', 'Thing', 'unknown_prefix', count(*) from m_sd where nk % 10 = 6 group by root
        union all select {R}, 'cmns-id', 'names', 'unknown_prefix', count(*) from m_sd where nk % 7 = 5 group by root union all select concat('xr', cast(root as varchar)), null, null, 'no_reference', 1 from m_root"""),
    "a10_12_owner_line": frame("root s, n l", lambda spark, view: I.without_owner(W.entities(view).withColumn("value", F.when(F.col("path").contains("/PB-"), F.replace("value", F.lit("**Owned by:**"), F.lit("Owner:"))).otherwise(F.col("value")))).groupBy("root").agg(F.count("*").alias("n")), f"select {R}, count(*) as n from m_ent where prefix = 'PB' group by root"),
    "a10_14_count_surfaces": frame("root s, label s, stated s, actual s", lambda spark, view: I.stated_numbers(_prose(view), numbers(view), I.ENTITY_COUNTS, "README").select("root", "label", F.col("stated").cast("string"), F.col("actual").cast("string")).unionByName(I.pack_counts(_prose(view), numbers(view), "README").select("root", "label", "stated", "actual")), f"""
        with x as (select root, count(*) as t, count(*) filter (where prefix = 'E') as c, count(*) filter (where prefix = 'PB') as pb, count(*) filter (where prefix = 'FO') as fo, count(*) filter (where prefix = 'PM') as pm, count(*) filter (where prefix = 'DR') as dr, count(*) filter (where prefix = 'RA') as ra from m_ent group by 1)
        select {R}, 'total: with the core' as label, cast(t - 1 as varchar) as stated, cast(t as varchar) as actual from x union all select {R}, 'core: generalised', cast(c + 1 as varchar), cast(c as varchar) from x union all select {R}, 'fund-operations', cast(fo + 2 as varchar), cast(fo as varchar) from x
        union all select {R}, 'all', concat_ws(' + ', pb, fo, pm, dr, ra + 1), concat_ws(' + ', pb, fo, pm, dr, ra) from x"""),
    "a10_16_render_coverage": frame("root s, defect s, n l", lambda spark, view: I.page_coverage(pages(view), sds(view).unionByName(sds(view).withColumn("root", F.lit("bare"))), ents(view)).groupBy("root", "defect").agg(F.count("*").alias("n")), f"""
        select {R}, 'missing_page' as defect, 1 as n from m_root union all select {R}, 'missing_operation', count(*) from m_sd where bd = 2 group by root
        union all select {R}, 'missing_key', count(*) from m_fk where entity_id = 'E-02' and not is_self group by root union all select 'bare', 'not_rendered', 1"""),
    "a10_17_element_coverage": frame("root s, id s, severity s", lambda spark, view: I.export_coverage(_declared(view), _exported(view, _declared(view), "<element><name>%s thing</name></element>", "5"), rf"<name>\s*((?:BD-\d{{2}})|(?:SD-\d{{2}}\.\d+)|(?:(?:{M.PREFIX})-\d{{2}}))\b[^<]*</name>"), f"select {R}, id, 'error' as severity from {IDS} as x where id like '%5'"),
    "a10_18_schema_coverage": frame("root s, id s, severity s", lambda spark, view: I.export_coverage(I.ids(ents(view), "entity_id").unionByName(ents(view).select(F.lit("bare").alias("root"), F.col("entity_id").alias("id"))), _exported(view, I.ids(ents(view), "entity_id"), '"%s": {', "-07"), rf'"((?:{M.PREFIX})-\d{{2}})"\s*:\s*\{{'), f"select {R}, entity_id as id, 'error' as severity from m_ent where entity_id like '%-07' union all select 'bare', null, 'warning'"),
    "a10_19_relation_gate": frame("root s, subject s, defect s", lambda spark, view: I.relation_gate(one(view, "relations"), ents(view), M.relations(one(view, "relations"))), f"""
        with k as (select distinct root, entity_id, col from m_key)
        select {R}, concat(entity_id, '.', col) as subject, 'unbound_key' as defect from k where not exists (select 1 from m_bind as b where b.root = k.root and b.entity_id = k.entity_id and b.col = k.col)
        union all select {R}, concat(entity_id, '.', col), 'several_verbs' from (select root, entity_id, col from m_bind where col is not null group by 1, 2, 3 having count(distinct verb) > 1) as x
        union all select {R}, entity_id, 'unbound_parent' from m_ent as e where parent is not null and not exists (select 1 from m_bind as b where b.root = e.root and b.entity_id = e.entity_id and b.col is null)
        union all select {R}, verb, 'orphan_verb' from m_verb cross join m_root where not exists (select 1 from m_bind as b where b.root = m_root.root and b.verb = m_verb.verb)
        union all select {R}, verb, 'no_inverse' from m_verb cross join m_root where k = 4 union all select {R}, verb, 'shared_inverse' from m_verb cross join m_root where k = 2 union all select {R}, verb, 'inverse_is_a_verb' from m_verb cross join m_root where k = 5"""),
    "a10_22_package_integrity": frame("path s, digest s, forbidden b", lambda spark, view: W.business_domains(view).select("path", F.sha2("value", 256).alias("digest"), F.col("value").rlike(r"(?i)middle office").alias("forbidden")), """
        select concat('r', cast(m_bd.root as varchar), '/model/service-domains/', m_bd.bd_id, '-', lower(replace(name, ' ', '-')), '/README.md') as path,
               sha256(concat('# ', m_bd.bd_id, ' — ', name, chr(10), chr(10), '**Office:** ', office, '.', chr(10), chr(10), '**Maturity:** drafted, ', cast(case when m_bd.bd = 4 then n + 1 else n end as varchar), ' Service Domains.', chr(10), chr(10), name, ' at work.', chr(10))) as digest, m_bd.bd = 2 as forbidden
        from m_bd join m_count on m_count.root = m_bd.root and m_count.bd = m_bd.bd"""),
}
