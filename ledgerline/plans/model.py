"""Queries over model trees: sources, integrity, graphs, sinks, catalogue tools and validator rules.

Each parses files that modelfiles.py writes from the tables; its SQL reads what was written (views m_...), not the files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import integrity as I
from ..operators.catalog import Catalog
from ..shared import scratch, write_files
from ..sources import files as S
from ..sources import model as M
from . import modelfiles as W
from .dialect import Query, frame

SITE = {"repository": "https://code.example/model", "tag": "v1", "official": "https://model.example/"}
IDENTITY = {"name": "Model", "version": "1", **SITE}
R = "concat('r', cast(root as varchar(9))) as root"
#: A name as it is after the removal of markup.
PLAIN = "replace(replace({0}, '_', ''), '#', '')"
FOLDER = "concat(bd_id, '-', lower(replace(bd_name, ' ', '-')))"
SDB = "(select m_sd.*, m_bd.name as bd_name from m_sd join m_bd on m_bd.root = m_sd.root and m_bd.bd = m_sd.bd)"


def sds(view) -> DataFrame:
    return M.service_domains(W.service_domains(view))


def bds(view) -> DataFrame:
    return M.business_domains(W.business_domains(view))


def ents(view) -> DataFrame:
    return M.entities(W.entities(view))


def one(view, name: str) -> DataFrame:
    return W.files(view, name)


def counts(view) -> DataFrame:
    return I.domain_counts(sds(view))


def numbers(view) -> DataFrame:
    return I.totals(counts(view), ents(view))


def items(view) -> DataFrame:
    """The catalogue of all trees; ids carry the tree."""
    own = M.catalogue_items(W.tree(view), SITE)
    return own.withColumn("id", F.concat_ws("/", "root", "id")).withColumn("parent_id", F.when(F.col("parent_id").isNotNull(), F.concat_ws("/", "root", "parent_id")))


def catalog(view) -> Catalog:
    return Catalog(items(view).drop("root"), "1", IDENTITY)


def pages(view) -> DataFrame:
    """The site of all trees with known faults: no pages of SD-03.4, no checks on pages of BD-02, no link from E-02 to E-16."""
    own = G.site(bds(view), sds(view), ents(view)).filter("page <> 'sd-03.4.html'")
    value = F.when(F.col("page").startswith("sd-02."), F.regexp_replace("value", r"<li>Check[^<]*</li>\n?", "")).when(F.col("page") == "entity-E-02.html", F.regexp_replace("value", r'href="entity-', 'href="entities-')).otherwise(F.col("value"))
    return own.withColumn("value", value)


def _document(spark, view) -> DataFrame:
    """Writes a catalogue document and reads it again."""
    path = scratch(spark, "catalogue")
    S.write_catalogue(items(view), path, "1", IDENTITY)
    return S.read_document(spark, path)


def _csv(spark, rows: DataFrame, schema: str) -> DataFrame:
    path = scratch(spark, "graph")
    S.write_csv(rows, path)
    return S.graph_csv(spark, path, schema)


def _validation(spark, view) -> DataFrame:
    """Which arguments the tools take."""
    own, rows = Catalog(view("m_place").selectExpr("sd_id as id", "'x' as type", "name as title", "name as description", "name as content")), []
    for tool, call, values in (("search", own.search, ("a", "ab", "")), ("get", own.get, ("E", "E-01")), ("map_requirement", own.map_requirement, ("risk", "risks", "a big need"))):
        for v in values:
            try:
                call(v)
                rows.append((tool, v, True))
            except ValueError:
                rows.append((tool, v, False))
    return spark.createDataFrame(rows, "tool string, given string, valid boolean")


ITEM_COUNTS = """
select 'business-domain' as type, count(*) as n from m_bd union all select 'service-domain', count(*) from m_sd union all select 'service-operation', count(*) from m_sd
union all select 'entity', count(*) from m_ent union all select 'glossary-term', count(*) from m_term cross join m_root union all select 'relationship', count(*) from m_verb cross join m_root
union all select 'export', 3 * count(*) from m_sd"""
SD_PATH = f"concat('model/service-domains/', {FOLDER}, '/', sd_id, '-', lower(replace(replace(name, ' ', '-'), '_', '-')), '.md')"
ENTITY_PATH = "concat('model/entities/', case when pack = 'core' then 'core' else concat('specialisations/', pack) end, '/', entity_id, '-', lower(replace(replace(name, ' ', '-'), '#', '-')), '.md')"
TREE = f"""
tr as (select 1 as depth, start, node from (select instrument_id as start, IDIV(instrument_id, 2) as node from instrument where instrument_id > 0) as a
       union all select depth + 1, start, IDIV(node, 2) from tr where node > 0)"""
CHAIN = "select concat('I', cast(instrument_id as string)) as src, concat('I', cast(instrument_id div 2 as string)) as dst, 'part_of' as verb from instrument where instrument_id > 0"


def _chain(spark, view) -> DataFrame:
    return view("instrument").filter("instrument_id > 0").selectExpr("instrument_id as src", "instrument_id div 2 as dst", "'part_of' as verb")


def _edges(view) -> DataFrame:
    return G.capability_edges(sds(view), bds(view))


def _bound(view) -> DataFrame:
    """Graph edges of the vocabulary: an entity's keys by the verbs that bind their column."""
    verbs = M.relations(one(view, "relations"))
    keys = M.foreign_keys(ents(view)).filter("not is_self")
    bound = M.bindings(verbs).filter("column = 'owner_id'").join(verbs.select("root", "verb", "inverse", "cardinality"), ["root", "verb"])
    return keys.join(bound, ["root", "entity_id"]).select("root", F.col("entity_id").alias("src"), F.col("target").alias("dst"), "verb", F.lit("association").alias("kind"), "inverse", "cardinality", "column")


BOUND = "(select f.root, f.entity_id as src, f.target as dst, b.verb, v.inverse from m_fk as f join m_bind as b on b.root = f.root and b.entity_id = f.entity_id and b.col = 'owner_id' join m_verb as v on v.verb = b.verb where not f.is_self)"

SOURCES: dict[str, Query] = {
    "a01_02_file_scan": Query(lambda spark, sf_dir: M.listing(spark, sf_dir).filter(F.col("path").rlike(r"/(?:nation|region|part)\.parquet(?:/|$)")).select(F.regexp_extract("path", r"/(\w+)\.parquet", 1).alias("name")).distinct(), "select unnest(['nation', 'region', 'part']) as name"),
    "a01_01_catalogue_json": frame("type s, n l", lambda spark, view: _document(spark, view).groupBy("type").agg(F.count("*").alias("n")), ITEM_COUNTS),
    "a01_03_markdown_items": frame(
        "root s, id s, type s, title s, description s",
        lambda spark, view: items(view).filter("type in ('business-domain', 'service-domain', 'entity')").select("root", F.regexp_replace("id", "^[^/]*/", "").alias("id"), "type", "title", "description"),
        f"""select {R}, bd_id as id, 'business-domain' as type, name as title, concat('Office: ', office, '.') as description from m_bd
        union all select {R}, sd_id, 'service-domain', {PLAIN.format('name')}, concat({PLAIN.format('name')}, ' serves clients of ', bd_name, '. Second line.') from {SDB} as x
        union all select {R}, entity_id, 'entity', {PLAIN.format('name')}, concat('Row of ', {PLAIN.format('name')}, ' and its keys.') from m_ent""",
    ),
    "a01_04_business_scan": frame("root s, source_path s", lambda spark, view: M.below(W.tree(view), r"/README\.md$").filter("source_path like 'model/service-domains/%'").select("root", "source_path"), f"select {R}, concat('model/service-domains/', bd_id, '-', lower(replace(name, ' ', '-')), '/README.md') as source_path from m_bd"),
    "a01_05_service_scan": frame("root s, source_path s", lambda spark, view: M.below(W.tree(view), r"/SD-\d+\.\d+-.+\.md$").select("root", "source_path"), f"select {R}, {SD_PATH} as source_path from {SDB} as x"),
    "a01_06_entity_scan": frame("root s, prefix s, n l", lambda spark, view: M.below(W.tree(view), rf"/(?:{M.PREFIX})-\d+-.+\.md$").groupBy("root", F.regexp_extract("path", r"/([A-Z]+)-\d+-[^/]*$", 1).alias("prefix")).agg(F.count("*").alias("n")), f"select {R}, prefix, n from (select root, prefix, count(*) as n from m_ent group by 1, 2) as x"),
    "a01_07_glossary": frame("root s, term s, slug s, definition s", lambda spark, view: M.glossary(one(view, "glossary")).select("root", "term", "slug", "definition"), f"select {R}, replace(term, '#', '') as term, lower(replace(term, '#', '')) as slug, replace(definition, '#', '') as definition from m_term cross join m_root"),
    "a01_08_relations": frame("root s, verb s, label s, inverse s, cardinality s, meaning s", lambda spark, view: M.relations(one(view, "relations")).select("root", "verb", "label", "inverse", "cardinality", "meaning"), f"select {R}, verb, label, inverse, 'n-1' as cardinality, meaning from m_verb cross join m_root"),
    "a01_09_exports": frame("root s, rel s, format s", lambda spark, view: M.exports(W.exports(view)).select("root", "rel", "format"), f"select {R}, concat(lower(replace(name, ' ', '-')), '.', x) as rel, upper(x) as format from m_sd cross join (select unnest(['csv', 'TTL', 'json']) as x) as f"),
    "a01_10_business_domains": frame("root s, bd_id s, bd i, slug s, name s, office s, error s", lambda spark, view: bds(view), f"select {R}, bd_id, bd, lower(replace(name, ' ', '-')) as slug, name, office, cast(null as varchar) as error from m_bd"),
    "a01_11_service_domains": frame(
        "root s, sd_id s, bd i, sd i, name s, applies s, purpose s, error s",
        lambda spark, view: sds(view),
        f"select {R}, sd_id, bd, sd, name, applies, concat(name, ' serves *clients* of [', bd_name, '](x.md).', chr(10), 'Second line.') as purpose, case when nk = 24 then 'unknown heading Extra' end as error from {SDB} as x",
    ),
    "a01_12_domain_tree": frame(
        "root s, bd_id s, office s, sd_id s, nth i",
        lambda spark, view: bds(view).join(sds(view).select("root", "bd", "sd", "sd_id"), ["root", "bd"]).selectExpr("root", "bd_id", "office", "sd_id", "row_number() over (partition by root, bd order by sd) as nth"),
        f"select {R}, m_bd.bd_id, office, sd_id, sd as nth from m_bd join (select root as r2, bd as b2, sd, sd_id from m_sd) as s on r2 = root and b2 = bd",
    ),
    "a01_13_entities": frame(
        "root s, entity_id s, pack s, name s, summary s, parent s, keys l, owners l, consumers l, error s",
        lambda spark, view: ents(view).withColumns({"keys": F.size("members"), "owners": F.size("owned_by"), "consumers": F.size("consumed_by")}),
        f"""select {R}, e.entity_id, pack, name, concat('Row of ', name, ' and its *keys*.') as summary, parent, k as keys, o as owners, u as consumers, cast(null as varchar) as error from m_ent as e
        join (select root as r1, entity_id as e1, count(*) as k from m_key group by 1, 2) as a on r1 = root and e1 = e.entity_id
        join (select root as r2, entity_id as e2, count(distinct sd_id) filter (where kind = 'owned_by') as o, count(distinct sd_id) filter (where kind = 'consumed_by') as u from m_link group by 1, 2) as b on r2 = root and e2 = e.entity_id""",
    ),
    "a01_14_entity_tree": frame(
        "root s, pack s, display s, n l, error s",
        lambda spark, view: M.entities(W.entities(view).unionByName(W.entities(view).filter(F.col("path").rlike("/PB-0[12]-")).withColumn("path", F.replace("path", F.lit("public-markets"), F.lit("arts"))))).join(M.packs(spark).withColumnRenamed("slug", "pack"), "pack", "left").groupBy("root", "pack", "display", "error").agg(F.count("*").alias("n")),
        f"""select {R}, pack, case pack when 'core' then 'Core' when 'public-markets' then 'Public-markets' when 'fund-operations' then 'Fund-Operations' when 'private-markets' then 'Private-markets' when 'derivatives' then 'Derivatives' else 'Real-assets' end as display, n, cast(null as varchar) as error
        from (select root, pack, count(*) as n from m_ent group by 1, 2) as x
        union all select {R}, 'arts', null, n, 'the pack is unknown' from (select root, count(*) as n from m_ent where entity_id in ('PB-01', 'PB-02') group by 1) as y""",
    ),
    "a01_15_ownership": frame(
        "root s, entity_id s, owners l, pattern s, error s",
        lambda spark, view: M.ownership(one(view, "ownership")).withColumn("owners", F.size("owners")),
        f"""select {R}, entity_id, n as owners, 'Single owner' as pattern, case when nth = 2 then 'the entity has a row already' when n = 0 then 'the row names no domain' end as error
        from (select root, entity_id, nth, count(distinct sd_id) as n from m_map group by 1, 2, 3 union all select root, entity_id, 1, 0 from m_ent where no = 16) as x""",
    ),
    "a01_16_ownership_lenient": frame("root s, entity_id s, owners l, last_owner s", lambda spark, view: M.ownership_lenient(one(view, "ownership")).select("root", "entity_id", F.size("owners").alias("owners"), F.element_at("owners", -1)["sd_id"].alias("last_owner")), f"select {R}, entity_id, count(*) as owners, max_by(sd_id, concat(cast(nth as varchar), sd_id)) as last_owner from m_map group by root, entity_id"),
    "a01_17_index_summary": frame(
        "root s, bd i, declared l",
        lambda spark, view: (lambda t, rows: t.select("root", F.lit(0).alias("bd"), F.col("declared_sd").alias("declared")).unionByName(rows.select("root", "bd", "declared")))(*M.index_summary(one(view, "index"))),
        f"select {R}, 0 as bd, n + 1 as declared from (select root, sum(n) as n from m_count group by 1) as x union all select {R}, bd, case when bd = 3 then n + 1 else n end from m_count where bd <> 5 union all select {R}, 9, 2 from m_root",
    ),
    "a01_18_offices": frame("root s, office s, subtotal l, bd i, cell l", lambda spark, view: M.offices(one(view, "map")).select("root", "office", "subtotal", F.explode("cells").alias("bd", "cell")), f"select {R}, concat('OFFICE', cast(bd as varchar)) as office, case when bd = 4 then n + 1 else n end as subtotal, bd, case when bd = 2 then n - 1 else n end as cell from m_count where bd <> 5"),
    "a01_19_curie_classes": frame("root s, prefix s, name s", lambda spark, view: M.curies(one(view, "curies")), f"select {R}, prefix, name from m_root cross join (select 'fibo-be-le' as prefix, 'LegalEntity' as name union all select 'cmns-id', 'Identifier') as x"),
    "a01_20_curie_properties": frame("root s, prefix s, name s", lambda spark, view: M.curies(one(view, "curies"), "object_properties"), f"select {R}, prefix, name from m_root cross join (select 'fibo-be-le' as prefix, 'owns' as name union all select 'cmns-id', null) as x"),
    "a01_21_baseline": frame("root s, entity_id s, sd_id s", lambda spark, view: M.baseline(one(view, "baseline")), f"select distinct {R}, entity_id, sd_id from m_link where kind = 'consumed_by' and entity_id like '%1'"),
    "a01_22_node_csv": frame(
        "root s, id s, name s, parent s",
        lambda spark, view: _csv(spark, ents(view).select("root", F.col("entity_id").alias("id"), "name", F.coalesce("parent", F.lit("")).alias("parent")), "root string, id string, name string, parent string"),
        f"select {R}, entity_id as id, name, coalesce(parent, '') as parent from m_ent",
    ),
    "a01_23_edge_csv": frame("root s, src s, dst s, verb s", lambda spark, view: _csv(spark, _bound(view).select("root", "src", "dst", "verb"), "root string, src string, dst string, verb string"), f"select {R}, src, dst, verb from {BOUND} as x"),
    "a01_24_packs": frame("ordinal i, prefix s, slug s, is_core b", lambda spark, view: M.packs(spark), "select * from (values (1, 'E', 'core', true), (2, 'PB', 'public-markets', false), (3, 'FO', 'fund-operations', false), (4, 'PM', 'private-markets', false), (5, 'DR', 'derivatives', false), (6, 'RA', 'real-assets', false)) as t(ordinal, prefix, slug, is_core)"),
}

SINKS: dict[str, Query] = {
    "a02_01_catalogue_writer": frame("id s, type s, title s, parent_id s, official_url s", lambda spark, view: _document(spark, view).filter("type in ('service-operation', 'entity')"), f"""
        select concat('r', cast(root as varchar), '/', sd_id, ':op-1') as id, 'service-operation' as type, concat('Book ', {PLAIN.format('name')}) as title, concat('r', cast(root as varchar), '/', sd_id) as parent_id,
               concat('https://model.example/model/', lower({FOLDER}), '/', lower(sd_id), '-', lower(replace(replace(name, ' ', '-'), '_', '-')), '/#', 'book-', lower(replace(replace(name, ' ', '-'), '_', '-'))) as official_url from {SDB} as x
        union all select concat('r', cast(root as varchar), '/', entity_id), 'entity', {PLAIN.format('name')}, null, concat('https://model.example/model/entities/', lower(entity_id), '-', lower(replace(replace(name, ' ', '-'), '#', '-')), '/') from m_ent"""),
    "a02_02_site": frame("root s, page s, items l, links l", lambda spark, view: G.site(bds(view), sds(view), ents(view)).select("root", "page", F.size(X.list_items(F.col("value"))).alias("items"), F.size(X.anchors(F.col("value"))).alias("links")), f"""
        with l as (select root, sd_id as id, concat('op', cast(k as varchar)) as x, 0 as a from m_sd cross join (select unnest([1, 2, 3]) as k) as o
            union select root, sd_id, ref, 1 from m_ref where kind in ('consumes-entity', 'owns-entity', 'upstream', 'downstream') union select root, bd_id, sd_id, 1 from m_sd
            union select root, entity_id, sd_id, 1 from m_link union select root, entity_id, target, 1 from m_fk where not is_self),
        ids as (select root, bd_id as id from m_bd union all select root, sd_id from m_sd union all select root, entity_id from m_ent)
        select concat('r', cast(ids.root as varchar)) as root, case when ids.id like 'SD-%' then concat('sd-', substring(ids.id, 4), '.html') when ids.id like 'BD-%' then concat('bd-', substring(ids.id, 4), '.html') else concat('entity-', ids.id, '.html') end as page, count(x) as items, coalesce(sum(a), 0) as links
        from ids left join l on l.root = ids.root and l.id = ids.id group by ids.root, ids.id
        union all select {R}, concat(k, '.html'), n, n from (select root, 'index' as k, count(*) as n from ids group by 1 union all select root, 'landscape', count(*) from m_bd group by 1 union all select root, 'erd', count(*) from m_ent group by 1) as z"""),
    "a02_03_landscape": frame("root s, line s", lambda spark, view: G.landscape(bds(view), sds(view), _edges(view)).filter("part = '2 arrows'"), f"""
        with p as (select root, case when src like 'SD-%' then concat('BD-', substring(src, 4, 2)) else src end as a, case when dst like 'SD-%' then concat('BD-', substring(dst, 4, 2)) else dst end as b, kind from m_edge)
        select {R}, concat('bd_', substring(a, 4), ' -> bd_', substring(b, 4), case when bool_and(kind like 'narrative-bd-%') then ' [style="dashed"];' else ';' end) as line from p where a <> b group by root, a, b"""),
    "a02_04_domain_detail": frame("root s, line s", lambda spark, view: G.detail_lines(_edges(view), 2), f"""
        with p as (select root, src, dst, case when src like 'SD-%' then concat('BD-', substring(src, 4, 2)) else src end as a, case when dst like 'SD-%' then concat('BD-', substring(dst, 4, 2)) else dst end as b from m_edge),
        q as (select distinct root, case when a = 'BD-02' then src else a end as s, case when b = 'BD-02' then dst else b end as d from p where a = 'BD-02' or b = 'BD-02')
        select {R}, concat(case when s like 'SD-%' then concat('sd_', replace(substring(s, 4), '.', '_')) else concat('bd_', substring(s, 4)) end, ' -> ', case when d like 'SD-%' then concat('sd_', replace(substring(d, 4), '.', '_')) else concat('bd_', substring(d, 4)) end, ';') as line from q"""),
    "a02_05_entity_diagram": frame("root s, n l, dashed l", lambda spark, view: G.document(G.erd(ents(view)), "erd").select(F.regexp_extract("path", "^[^/]*", 0).alias("root"), F.size(F.regexp_extract_all("value", F.lit("->"), F.lit(0))).alias("n"), F.size(F.regexp_extract_all("value", F.lit("dashed"), F.lit(0))).alias("dashed")), f"""
        select {R}, n, dashed from (select root, count(*) as n, count(*) filter (where k = 's') as dashed from (select root, 'f' as k from m_fk where not is_self union all select root, 's' from m_ent where parent is not null) as x group by 1) as y"""),
    "a02_07_drift": frame("path s, state s", lambda spark, view: S.drift(one(view, "glossary").unionByName(W.business_domains(view)), W.business_domains(view).withColumn("value", F.when(F.col("path").contains("BD-02"), F.concat("value", F.lit(" "))).otherwise(F.col("value"))).filter("path not like '%BD-03%'").unionByName(one(view, "curies"))), """
        select concat('r', cast(root as varchar), '/model/service-domains/', bd_id, '-', lower(replace(name, ' ', '-')), '/README.md') as path, case when bd = 2 then 'changed' else 'missing' end as state from m_bd where bd in (2, 3)
        union all select concat('r', cast(root as varchar), '/model/glossary.md'), 'missing' from m_root union all select concat('r', cast(root as varchar), '/model/curies.json'), 'unexpected' from m_root"""),
    "a02_08_manifest": frame("name s, version s, items l", lambda spark, view: catalog(view).get_identity().select(F.get_json_object("identity", "$.name").alias("name"), F.get_json_object("identity", "$.version").alias("version"), F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("items")), f"select 'Model' as name, '1' as version, sum(n) as items from ({ITEM_COUNTS}) as x"),
    "a02_09_graph_texts": frame("path s, bytes l", lambda spark, view: write_files(reduce(DataFrame.unionByName, [lines.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "\n").alias("value")).select(F.concat("root", F.lit(f"/{name}")).alias("path"), "value") for name, lines in (("nodes.cypher", G.cypher(ents(view).select("root", F.col("entity_id").alias("id"), "name", "pack"), _bound(view)).filter("part = 1")), ("type.gql", G.graph_type(M.relations(one(view, "relations")))), ("shapes.ttl", G.shapes(M.key_columns(ents(view)))))]), scratch(spark, "exports")), """
        select concat('r', cast(root as varchar), '/nodes.cypher') as path, sum(octet_length(encode(concat('CREATE (:Entity {id: ''', entity_id, ''', name: ''', name, ''', pack: ''', pack, '''});'))) + 1) - 1 as bytes from m_ent group by root
        union all select concat('r', cast(root as varchar), '/type.gql'), sum(octet_length(encode(concat('(:Entity)-[`', verb, '` :`', verb, '`]->(:Entity)'))) + 1) + octet_length(encode('(Entity :Entity {id STRING NOT NULL, name STRING, pack STRING})')) from m_verb cross join m_root group by root
        union all select concat('r', cast(root as varchar), '/shapes.ttl'), sum(octet_length(encode(concat('<', entity_id, '#', col, '> a sh:PropertyShape ; sh:maxCount 1 .'))) + 1) - 1 from (select distinct root, entity_id, col from m_key) as x group by root"""),
}
