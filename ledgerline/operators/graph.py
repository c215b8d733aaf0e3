"""Property graphs as node and edge frames: building, matching, walking, and their texts for other engines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..shared import scratch, written
from ..sources import model as M

#: Fill and stroke of the five offices in the landscape, in its order.
OFFICES = {"Front": ("#dfe8f7", "#5b7aa6"), "Middle": ("#e5efe1", "#5b8a48"), "Back": ("#fef3e2", "#b07d2a"), "Cross-cutting": ("#e9e2f0", "#7a5b9b"), "Commercial": ("#f7dfe0", "#a65b5b")}


def match(edges: DataFrame, nodes: DataFrame, verb: str) -> DataFrame:
    """One hop over a verb with the labels of both ends."""
    n = nodes.select("id", "label")
    e = edges.filter(F.col("verb") == verb)
    return e.join(n.toDF("src", "src_label"), "src").join(n.toDF("dst", "dst_label"), "dst")


def without(edges: DataFrame, nodes: DataFrame, verb: str) -> DataFrame:
    """Nodes that are never the source of a verb."""
    return nodes.join(edges.filter(F.col("verb") == verb).select(F.col("src").alias("id")), "id", "left_anti")


def inverse(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges and, for each verb with an inverse name, the edges that go back; names are a row a verb, so no verb's edges are one task's."""
    back = edges.join(F.broadcast(names.select("verb", "inverse")), "verb").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("inverse").alias("verb"))
    return edges.select("src", "dst", "verb").unionByName(back)


def union_edges(*kinds: DataFrame, parts: int = 0) -> DataFrame:
    """Edges of several kinds without repeats and without loops, dealt in ``parts``, if given, before they are told apart."""
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    out = out.filter("src <> dst")
    return (out.repartition(parts, "src", "dst", "verb") if parts else out).dropDuplicates(["src", "dst", "verb"])


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that end in no node."""
    return edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti")


def one_sided(left: DataFrame, right: DataFrame, key: list[str], baseline: DataFrame) -> DataFrame:
    """Pairs that only one side states; pairs of the baseline are warnings, others defects."""
    both = left.select(*key).distinct().withColumn("l", F.lit(1)).join(right.select(*key).distinct().withColumn("r", F.lit(1)), key, "full_outer").filter("l is null or r is null")
    known = baseline.select(*key).distinct().withColumn("known", F.lit(1))
    return both.join(known, key, "left").select(*key, F.when(F.col("l").isNull(), "missing_left").otherwise("missing_right").alias("defect"), F.when(F.col("known") == 1, "warning").otherwise("error").alias("severity"))


def walk(edges: DataFrame, verb: str | None = None) -> DataFrame:
    """start, node, depth: every node that a start reaches over a verb, at its least depth, to the fixed point."""
    return reach(edges if verb is None else edges.filter(F.col("verb") == verb))


def reach(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """start, node, depth: what the given starts (all sources, if none are given) reach, at its least depth.

    A round is one join; what was reached before is dropped, so cycles end. Rounds are written into one folder, a part a
    depth, so what was reached is one table and plans don't grow. Where no source has two edges and all are starts, rounds
    double the depth, so what was reached is read as many times as the longest way has bits.
    """
    spark = edges.sparkSession
    own = written(edges.select("src", "dst").distinct(), "edges")
    kind = own.schema["src"].dataType.simpleString()
    if starts is None and own.groupBy("src").count().filter("count > 1").isEmpty():
        return _doubled(own, kind)
    folder, depth = scratch(spark, "walk"), 1
    first = own.select(F.col("src").alias("start"), F.col("dst").alias("node"))
    (first if starts is None else first.join(starts.select("start").distinct(), "start")).write.parquet(f"{folder}/depth=1")
    reached = lambda path: spark.read.schema(f"start {kind}, node {kind}").option("basePath", path).parquet(path)
    while not (front := reached(f"{folder}/depth={depth}")).isEmpty():
        step = front.join(own, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        depth += 1
        step.join(reached(folder), ["start", "node"], "left_anti").write.parquet(f"{folder}/depth={depth}")
    return spark.read.schema(f"start {kind}, node {kind}, depth int").option("basePath", folder).parquet(folder)


def _doubled(own: DataFrame, kind: str) -> DataFrame:
    """What all sources reach, each by its one edge: a round joins the nodes at the greatest depth so far with all that these reach."""
    spark, folder, depth = own.sparkSession, scratch(own.sparkSession, "walk"), 1
    own.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("depth")).write.parquet(f"{folder}/round=1")
    reached = lambda: spark.read.schema(f"start {kind}, node {kind}, depth int").parquet(folder)
    while not (front := reached().filter(F.col("depth") == depth)).isEmpty():
        onward = reached().select(F.col("start").alias("via"), F.col("node").alias("next"), F.col("depth").alias("more"))
        step = front.join(onward, F.col("node") == F.col("via")).select("start", F.col("next").alias("node"), (F.col("depth") + F.col("more")).alias("depth"))
        depth *= 2
        step.join(reached().select("start", "node"), ["start", "node"], "left_anti").write.parquet(f"{folder}/round={depth}")
    return reached().select("start", "node", "depth")


def layers(hops: list[DataFrame]) -> DataFrame:
    """start, node, depth: what the sources of the first hop's edges reach through one hop after another, each node once.

    The nodes of each hop are a layer of their own, so what one hop reaches no other does: nothing is read again to drop it.
    """
    spark, folder, depth = hops[0].sparkSession, scratch(hops[0].sparkSession, "layers"), 1
    step = hops[0].select(F.col("src").alias("start"), F.col("dst").alias("node")).distinct()
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in step.schema)
    step.write.parquet(f"{folder}/depth=1")
    for hop in hops[1:]:
        front = spark.read.schema(fields).parquet(f"{folder}/depth={depth}")
        step = front.join(hop.select("src", "dst"), F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        depth += 1
        step.write.parquet(f"{folder}/depth={depth}")
    return spark.read.schema(f"{fields}, depth int").option("basePath", folder).parquet(folder)


def chain_ends(edges: DataFrame) -> DataFrame:
    """start, last, depth: the end of the chain that begins at each node with an edge, where no node has two.

    Pointers are doubled: a round joins each pointer with that of the node it points to, so a chain of n nodes takes as
    many rounds as n has bits, and nothing but a pointer a node is held. A node whose chain has no end, as it runs into a
    cycle, has no row.
    """
    pointers = written(edges.select(F.col("src").alias("start"), F.col("dst").alias("last"), F.lit(1).cast("long").alias("depth")), "pointers")
    nodes, reach = pointers.count(), 1
    while True:
        onward = pointers.select(F.col("start").alias("last"), F.col("last").alias("next"), F.col("depth").alias("more"))
        met = pointers.join(onward, "last", "left")
        # beyond as many steps as there are nodes, what goes on is in a cycle
        if reach > nodes or met.filter("next is not null").isEmpty():
            return met.filter("next is null").select("start", "last", F.col("depth").cast("int").alias("depth"))
        pointers = written(met.select("start", F.coalesce("next", "last").alias("last"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "pointers", instead=pointers)
        reach *= 2


def ends(walked: DataFrame) -> DataFrame:
    """start and last: the node that a start reaches last, by depth; ties go to the least node."""
    return walked.groupBy("start").agg(F.max(F.struct("depth", F.col("node").alias("n"))).alias("m")).select("start", F.col("m.n").alias("last"), F.col("m.depth").alias("depth"))


def capability_edges(domains: DataFrame, business: DataFrame) -> DataFrame:
    """root, src, dst, kind of six kinds, each once: structured and narrative references between domains that resolve.

    A reference to a whole business domain stays one edge; one to the own domain, or the own business domain, is none.
    """
    known = domains.select("root", F.col("sd_id").alias("ref")).unionByName(business.select("root", F.col("bd_id").alias("ref")))
    refs = M.sd_references(domains).join(known.distinct(), ["root", "ref"], "left_semi").filter("ref <> sd_id and ref <> bd_id")
    narrow = F.when(F.col("ref").startswith("SD-"), F.lit("narrative-")).otherwise(F.lit("narrative-bd-"))
    kind = F.when(F.col("kind") == "upstream", F.concat(narrow, F.lit("input"))).when(F.col("kind") == "downstream", F.concat(narrow, F.lit("output"))).otherwise(F.col("kind"))
    into = F.col("kind").isin("consumes-sd", "upstream")
    own = refs.filter(F.col("kind").isin("consumes-sd", "produces-sd", "upstream", "downstream"))
    return own.select("root", F.when(into, F.col("ref")).otherwise(F.col("sd_id")).alias("src"), F.when(into, F.col("sd_id")).otherwise(F.col("ref")).alias("dst"), kind.alias("kind")).distinct()


def entity_edges(entities: DataFrame) -> DataFrame:
    """root, src, dst, kind: keys to other entities, and specialisations."""
    keys = M.foreign_keys(entities).filter("not is_self").select("root", F.col("entity_id").alias("src"), F.col("target").alias("dst"), F.lit("fk").alias("kind"))
    return keys.unionByName(entities.filter("parent is not null").select("root", F.col("entity_id").alias("src"), F.col("parent").alias("dst"), F.lit("specialises").alias("kind")))


def within(edges: DataFrame, bd: int) -> DataFrame:
    """Edges between service domains of one business domain."""
    prefix = f"SD-{bd:02d}."
    return edges.filter(F.col("src").startswith(prefix) & F.col("dst").startswith(prefix))


def between(edges: DataFrame) -> DataFrame:
    """root, src_bd, dst_bd and the sorted kinds of edges between business domains."""
    own = edges.withColumns({"src_bd": X.domain_of(F.col("src")), "dst_bd": X.domain_of(F.col("dst"))}).filter("src_bd <> dst_bd")
    return own.groupBy("root", "src_bd", "dst_bd").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def ill_typed(edges: DataFrame, nodes: DataFrame, types: DataFrame) -> DataFrame:
    """Edges (src, dst, verb) that the typed schema (verb, src_label, dst_label) does not allow."""
    n = nodes.select("id", "label")
    labelled = edges.join(n.toDF("src", "src_label"), "src", "left").join(n.toDF("dst", "dst_label"), "dst", "left")
    return labelled.join(types.select("verb", "src_label", "dst_label").distinct(), ["verb", "src_label", "dst_label"], "left_anti")


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """root, part, line: statements that create nodes (id, name, pack) and edges (src, dst, verb, kind, inverse, cardinality, column)."""
    made = nodes.select("root", F.lit(1).alias("part"), F.concat(F.lit("CREATE (:Entity {id: "), quoted(F.col("id")), F.lit(", name: "), quoted(F.col("name")), F.lit(", pack: "), quoted(F.col("pack")), F.lit("});")).alias("line"))
    props = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), quoted(F.col(c))) for c in ("kind", "inverse", "cardinality", "column") if c in edges.columns])
    joined = edges.select("root", F.lit(2).alias("part"), F.concat(F.lit("MATCH (a:Entity {id: "), quoted(F.col("src")), F.lit("}), (b:Entity {id: "), quoted(F.col("dst")), F.lit("}) CREATE (a)-[:`"), F.col("verb"), F.lit("` {"), props, F.lit("}]->(b);")).alias("line"))
    return made.unionByName(joined)


def graph_type(verbs: DataFrame) -> DataFrame:
    """root, part, line: a typed graph schema with one edge type a verb."""
    head = verbs.select("root").distinct().select("root", F.lit(1).alias("part"), F.lit("(Entity :Entity {id STRING NOT NULL, name STRING, pack STRING})").alias("line"))
    kinds = verbs.select("root", F.lit(2).alias("part"), F.concat(F.lit("(:Entity)-[`"), F.col("verb"), F.lit("` :`"), F.col("verb"), F.lit("`]->(:Entity)")).alias("line"))
    return head.unionByName(kinds)


def shapes(columns: DataFrame) -> DataFrame:
    """root, part, line: a property shape for each column (entity_id, column) of an entity."""
    path = F.concat(F.lit("<"), F.col("entity_id"), F.lit("#"), F.col("column"), F.lit("> a sh:PropertyShape ; sh:maxCount 1 ."))
    return columns.select("root", F.lit(1).alias("part"), path.alias("line"))


def label(text: Column) -> Column:
    """A text within a quoted label."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def bd_node(bd_id: Column) -> Column:
    return F.concat(F.lit("bd_"), F.substring(bd_id, 4, 1 << 30))


def sd_node(sd_id: Column) -> Column:
    return F.concat(F.lit("sd_"), F.replace(F.substring(sd_id, 4, 1 << 30), F.lit("."), F.lit("_")))


def landscape(business: DataFrame, domains: DataFrame, edges: DataFrame) -> DataFrame:
    """root, part, line of the landscape: business domains in clusters by office, one arrow a pair.

    A pair that only narrative references to whole domains join is dashed; any other edge makes it solid.
    """
    count = domains.groupBy("root", "bd_id").agg(F.count("*").alias("n"))
    office = X.office(F.col("office"))
    fill = F.create_map(*[F.lit(x) for k, (f, _) in OFFICES.items() for x in (k, f)])
    nodes = business.join(count, ["root", "bd_id"], "left").withColumn("o", office)
    text = F.concat(bd_node(F.col("bd_id")), F.lit(' [label="'), label(F.concat_ws("\\n", "bd_id", "name", F.concat(F.lit("("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" SDs)")))), F.lit('", fillcolor="'), F.element_at(fill, F.col("o")), F.lit('"];'))
    boxes = nodes.select("root", F.concat(F.lit("1 "), F.col("o")).alias("part"), text.alias("line"))
    known = business.select("root", "bd_id")
    pairs = between(edges).join(known.withColumnRenamed("bd_id", "src_bd"), ["root", "src_bd"], "left_semi").join(known.withColumnRenamed("bd_id", "dst_bd"), ["root", "dst_bd"], "left_semi")
    whole = F.size(F.array_except("kinds", F.array(F.lit("narrative-bd-input"), F.lit("narrative-bd-output")))) == 0
    arrow = F.concat(bd_node(F.col("src_bd")), F.lit(" -> "), bd_node(F.col("dst_bd")), F.when(whole, ' [style="dashed"];').otherwise(";"))
    return boxes.unionByName(pairs.select("root", F.lit("2 arrows").alias("part"), arrow.alias("line")))


def detail(edges: DataFrame, bd: int) -> DataFrame:
    """root, src, dst of one business domain's view: its service domains, all other domains as one node each."""
    own = f"BD-{bd:02d}"
    touched = edges.withColumns({"s": X.domain_of(F.col("src")), "d": X.domain_of(F.col("dst"))}).filter((F.col("s") == own) | (F.col("d") == own))
    inside = lambda c, of: F.when(F.col(of) == own, F.col(c)).otherwise(F.col(of))
    return touched.select("root", inside("src", "s").alias("src"), inside("dst", "d").alias("dst")).distinct()


def detail_lines(edges: DataFrame, bd: int) -> DataFrame:
    node = lambda c: F.when(F.col(c).startswith("SD-"), sd_node(F.col(c))).otherwise(bd_node(F.col(c)))
    return detail(edges, bd).select("root", F.lit("arrows").alias("part"), F.concat(node("src"), F.lit(" -> "), node("dst"), F.lit(";")).alias("line"))


def erd(entities: DataFrame) -> DataFrame:
    """root, part, line of the entity diagram: entities in clusters by pack, keys solid and specialisations dashed."""
    fill = F.create_map(*[F.lit(x) for _, slug, _, f, *_ in M.PACKS for x in (slug, f)])
    node = lambda c: F.replace(F.lower(c), F.lit("-"), F.lit("_"))
    boxes = entities.select("root", F.concat(F.lit("1 "), "pack").alias("part"), F.concat(node(F.col("entity_id")), F.lit(' [label="'), label(F.concat_ws(" ", "entity_id", "name")), F.lit('", fillcolor="'), F.element_at(fill, F.col("pack")), F.lit('"];')).alias("line"))
    arrows = entity_edges(entities).select("root", F.lit("2 arrows").alias("part"), F.concat(node(F.col("src")), F.lit(" -> "), node(F.col("dst")), F.when(F.col("kind") == "fk", ";").otherwise(' [style="dashed"];')).alias("line"))
    return boxes.unionByName(arrows)


def document(lines: DataFrame, name: str) -> DataFrame:
    """path and value: a graph text a root, its lines in the order of part and line, to be written with ``write_files``."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: F.concat(F.lit("  "), x["line"])), "\n")
    return lines.groupBy("root").agg(body.alias("b")).select(F.concat("root", F.lit(f"/{name}.dot")).alias("path"), F.concat(F.lit(f"digraph {name} {{\n"), "b", F.lit("\n}\n")).alias("value"))


def escaped(text: Column) -> Column:
    return reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), text)


def site(business: DataFrame, domains: DataFrame, entities: DataFrame) -> DataFrame:
    """root, page, value: a page for each domain and entity, and three that lead to them.

    A page is a title, list items and links; rows meet it by the id that it is about.
    """
    bare = lambda c: F.substring(c, 4, 1 << 30)
    page = lambda c: F.when(F.col(c).startswith("SD-"), F.concat(F.lit("sd-"), bare(F.col(c)), F.lit(".html"))).when(F.col(c).startswith("BD-"), F.concat(F.lit("bd-"), bare(F.col(c)), F.lit(".html"))).otherwise(F.concat(F.lit("entity-"), F.col(c), F.lit(".html")))
    row = lambda frame, about, to: frame.select("root", F.col(about).alias("id"), F.concat(F.lit('<li><a href="'), page(to), F.lit('">'), F.col(to), F.lit("</a></li>")).alias("li"))
    links = M.links(entities)
    refs = M.sd_references(domains)
    items = [
        M.operations(domains).select("root", F.col("sd_id").alias("id"), F.concat(F.lit("<li>"), escaped(F.col("name")), F.lit("</li>")).alias("li")),
        row(refs.filter(F.col("kind").isin("consumes-entity", "owns-entity")), "sd_id", "ref"), row(refs.filter(F.col("kind").isin("upstream", "downstream")), "sd_id", "ref"),
        row(domains, "bd_id", "sd_id"), row(links, "entity_id", "sd_id"), row(M.foreign_keys(entities).filter("not is_self"), "entity_id", "target"),
    ]
    lists = reduce(DataFrame.unionByName, items).distinct().groupBy("root", "id").agg(F.array_join(F.array_sort(F.collect_list("li")), "\n").alias("lis"))
    titles = reduce(DataFrame.unionByName, [business.select("root", F.col("bd_id").alias("id"), "name"), domains.select("root", F.col("sd_id").alias("id"), "name"), entities.select("root", F.col("entity_id").alias("id"), "name")])
    html = F.concat(F.lit("<h1>"), "id", F.lit(" "), escaped(F.col("name")), F.lit("</h1>\n<ul>\n"), F.coalesce("lis", F.lit("")), F.lit("\n</ul>\n"))
    own = titles.join(lists, ["root", "id"], "left").select("root", page("id").alias("page"), html.alias("value"))
    leads = {"index": titles, "landscape": titles.filter("id like 'BD-%'"), "erd": titles.filter("not (id like 'BD-%' or id like 'SD-%')")}
    for name, rows in leads.items():
        anchors = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<li><a href="'), page("id"), F.lit('">'), "id", F.lit("</a></li>")))), "\n")
        own = own.unionByName(rows.groupBy("root").agg(anchors.alias("a")).select("root", F.lit(f"{name}.html").alias("page"), F.concat(F.lit("<ul>\n"), "a", F.lit("\n</ul>\n")).alias("value")))
    return own
