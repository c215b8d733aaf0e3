"""Parsers of model trees: Markdown files of domains, entities, ownership, glossary and relations as frames.

Every function takes ``files`` (path, value), a whole file a row, as ``tree`` reads it or any query makes it. A tree is told
by what stands before ``model/`` or ``exports/`` in the path (``root``), so any number of trees is parsed at once; all joins
are within a tree. What breaks a file's grammar is a text in its ``error`` column, not an exception: the first of its
defects, null if it has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: The packs in reader-facing order: prefix, slug, name, fill, stroke, whether it is the core.
PACKS = [
    ("E", "core", "Core", "#dfe8f7", "#5b7aa6", True),
    ("PB", "public-markets", "Public-markets", "#e5efe1", "#5b8a48", False),
    ("FO", "fund-operations", "Fund-Operations", "#fef3e2", "#b07d2a", False),
    ("PM", "private-markets", "Private-markets", "#e9e2f0", "#7a5b9b", False),
    ("DR", "derivatives", "Derivatives", "#fbf0d8", "#a07b2c", False),
    ("RA", "real-assets", "Real-assets", "#f7dfe0", "#a65b5b", False),
]
PREFIX = "|".join(p[0] for p in PACKS)
#: The second-level headings that a service-domain file may have.
SD_HEADINGS = ["Purpose", "Service Operations", "Inputs and outputs", "Entities", "Standards", "Open extensions", "Design notes"]
#: Extensions of export artefacts.
EXPORTS = ["archimate", "bpmn", "csv", "cypher", "gql", "json", "md", "rdf", "sql", "svg", "ttl"]

SD_REF, BD_REF, ENTITY_REF = r"\bSD-\d{2}\.\d+\b", r"\bBD-\d{2}\b", rf"\b(?:{PREFIX})-\d{{2}}\b"
FK = rf"(?i)FK\s*[\->→]+\s*(\{{[^}}]*\}}|self\b|(?:{PREFIX})[_-]?\d{{2,3}})"
FK_MEMBER = rf"(?i)^(?:{PREFIX})[_-]?\d{{2,3}}$"


def tree(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """path and value of all files below a path whose names match."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path and length of all files below a path; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def packs(spark: SparkSession) -> DataFrame:
    """The pack registry, in its order."""
    return spark.createDataFrame([(k, *p) for k, p in enumerate(PACKS, 1)], "ordinal int, prefix string, slug string, display string, fill string, stroke string, is_core boolean")


def below(files: DataFrame, pattern: str) -> DataFrame:
    """The files whose path has the pattern, with the tree's root and the path below it."""
    own = files.filter(F.col("path").rlike(pattern))
    return own.withColumn("root", root()).withColumn("source_path", source_path())


def root(path: str = "path") -> Column:
    return F.regexp_extract(path, r"^(.*?)/?(?:model|exports)/", 1)


def source_path(path: str = "path") -> Column:
    """The path below the root, with forward slashes."""
    return F.regexp_extract(F.translate(F.col(path), "\\", "/"), r"(?:^|/)((?:model|exports)/.*)$", 1)


def name_of(path: str = "path") -> Column:
    return F.substring_index(path, "/", -1)


def first_error(*conditions: tuple[Column, Column | str]) -> Column:
    """The message of the first condition that holds."""
    return F.coalesce(*[F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in conditions])


def line(n: int = 0) -> Column:
    return F.coalesce(F.get(F.split("value", "\r?\n"), F.lit(n)), F.lit(""))


def business_domains(files: DataFrame) -> DataFrame:
    """A row for each README of a business domain: number, id, slug, name, office, error."""
    own = below(files, r"model/service-domains/BD-\d{2}-[^/]+/README\.md$")
    title = r"^#\s+BD-(\d{2})\s+[—-]\s+(.+?)\s*$"
    folder = F.regexp_extract("path", r"BD-(\d{2})-([^/]+)/README\.md$", 1)
    office = F.regexp_extract("value", r"(?m)\*\*Office:\*\*\s*([^\n]+?)\.?\s*$", 1)
    parsed = own.select(
        "root", "source_path", F.regexp_extract(line(), title, 1).alias("number"), F.regexp_extract(line(), title, 2).alias("name"), office.alias("office"),
        F.regexp_extract("path", r"BD-\d{2}-([^/]+)/README\.md$", 1).alias("slug"), folder.alias("folder"), "value",
    )
    error = first_error((F.col("number") == "", "the first line is not '# BD-NN — Title'"), (F.col("office") == "", "there is no office line"), (F.col("number") != F.col("folder"), "title and folder have different numbers"))
    return parsed.select("root", "source_path", F.concat(F.lit("BD-"), "number").alias("bd_id"), F.expr("try_cast(number as int)").alias("bd"), "slug", "name", "office", error.alias("error"), "value")


def service_domains(files: DataFrame) -> DataFrame:
    """A row for each service-domain file with its lists of references, in the order of mention."""
    own = below(files, r"model/service-domains/BD-\d{2}-[^/]+/SD-[^/]*\.md$")
    title = r"^#\s+SD-(\d{2})\.(\d+)\s+[—-]\s+(.+?)\s*$"
    folder, file = F.regexp_extract("path", r"BD-(\d{2})-[^/]+/SD-[^/]*$", 1), r"SD-(\d{2})\.(\d+)-.+\.md$"
    parts = own.select(
        "root", "source_path", "value", folder.alias("folder"), F.regexp_extract("path", file, 1).alias("file_bd"), F.regexp_extract("path", file, 2).alias("file_sd"),
        F.regexp_extract(line(), title, 1).alias("title_bd"), F.regexp_extract(line(), title, 2).alias("title_sd"), F.regexp_extract(line(), title, 3).alias("name"),
        F.regexp_extract("value", r"\*\*Applies:\*\*\s*([A-Z]+)", 1).alias("applies"),
        X.part(F.col("value"), "Purpose").alias("purpose_body"), X.part(F.col("value"), "Service Operations").alias("operations_body"),
        X.part(F.col("value"), "Inputs and outputs").alias("io_body"), X.part(F.col("value"), "Entities").alias("entities_body"),
        F.regexp_extract_all("value", F.lit(r"(?m)^##\s+(.+?)\s*$"), F.lit(1)).alias("headings"),
    )
    blocks = parts.select(
        "*", F.concat(F.lit("SD-"), "title_bd", F.lit("."), "title_sd").alias("sd_id"), F.concat(F.lit("BD-"), "title_bd").alias("bd_id"),
        X.bold_block(F.col("io_body"), "Inputs").alias("inputs"), X.bold_block(F.col("io_body"), "Outputs").alias("outputs"),
        X.bold_block(F.col("entities_body"), "Consumes").alias("consumes"), X.bold_block(F.col("entities_body"), "Owns").alias("owns"), X.bold_block(F.col("entities_body"), "Produces").alias("produces"),
    )
    others = lambda c: F.array_remove(X.references(F.col(c), SD_REF), F.col("sd_id"))
    owned = F.ltrim(F.regexp_replace(F.lower("owns"), r"^:", ""))
    refs = blocks.select(
        "*", X.references(F.col("consumes"), ENTITY_REF).alias("consumes_entities"),
        F.when(owned.startswith("none") | owned.startswith("no entities"), F.array().cast("array<string>")).otherwise(X.references(F.col("owns"), ENTITY_REF)).alias("owns_entities"),
        others("consumes").alias("consumes_sds"), others("produces").alias("produces_sds"),
        F.array_union(F.array_union(others("inputs"), X.references(F.col("inputs"), BD_REF)), others("consumes")).alias("upstream"),
        F.array_union(F.array_union(others("outputs"), X.references(F.col("outputs"), BD_REF)), others("produces")).alias("downstream"),
        F.array_except("headings", F.array(*map(F.lit, SD_HEADINGS))).alias("unknown_headings"),
    )
    has = lambda h: F.array_contains("headings", h)
    error = first_error(
        (F.col("value") == "", "the file is empty"), (F.col("file_bd") == "", "the name is not SD-NN.M-slug.md"), (F.col("file_bd") != F.col("folder"), "name and folder have different numbers"),
        (F.col("title_bd") == "", "the first line is not '# SD-NN.M — Title'"), (F.expr("title_bd <> file_bd or title_sd <> file_sd"), "title and name have different numbers"),
        (F.col("applies") == "", "there is no Applies tag"), (~F.col("applies").isin("PUB", "PRIV", "BOTH"), "Applies is not PUB, PRIV or BOTH"),
        (~has("Service Operations"), "there is no section Service Operations"), (~has("Entities"), "there is no section Entities"),
        (F.size("unknown_headings") > 0, F.concat(F.lit("unknown heading "), F.get("unknown_headings", F.lit(0)))),
    )
    return refs.select(
        "root", "source_path", "sd_id", "bd_id", F.expr("try_cast(title_bd as int)").alias("bd"), F.expr("try_cast(title_sd as int)").alias("sd"), "name", "applies",
        F.trim(F.split("purpose_body", "\n\n", 2)[0]).alias("purpose"), "operations_body", "consumes", "owns", "consumes_entities", "owns_entities", "consumes_sds", "produces_sds", "upstream", "downstream", "headings", error.alias("error"), "value",
    )


def operations(domains: DataFrame) -> DataFrame:
    """root, sd_id, ordinal, so_id and name of each bullet of Service Operations, numbered from 1 in each domain."""
    lines = domains.select("root", "sd_id", F.posexplode(F.split("operations_body", "\n")).alias("at", "raw")).withColumn("raw", F.trim("raw")).filter(F.col("raw").startswith("- "))
    w = Window.partitionBy("root", "sd_id").orderBy("at")
    numbered = lines.select("root", "sd_id", X.operation_name(F.trim(F.substring("raw", 3, 1 << 30))).alias("name"), F.row_number().over(w).alias("ordinal"))
    return numbered.withColumn("so_id", X.operation_id(F.col("sd_id"), F.col("ordinal")))


def entities(files: DataFrame) -> DataFrame:
    """A row for each entity file: id, pack, name, summary, parent, raw keys, owners and consumers, error."""
    own = below(files, r"model/entities/(?:core|specialisations/[^/]+)/(?!README)[^/]+\.md$")
    title, file = rf"^#\s+({PREFIX})-(\d{{2}})\s+[—-]\s+(.+?)\s*$", rf"/(?:core|specialisations/([^/]+))/({PREFIX})-(\d{{2}})-[^/]+\.md$"
    slugs = {slug: prefix for prefix, slug, *_ in PACKS}
    parts = own.select(
        "root", "source_path", "value", F.regexp_extract("path", r"/(core|specialisations/[^/]+)/[^/]+$", 1).alias("folder"),
        F.regexp_extract("path", file, 2).alias("file_prefix"), F.regexp_extract("path", file, 3).alias("file_number"),
        F.regexp_extract(line(), title, 1).alias("prefix"), F.regexp_extract(line(), title, 2).alias("number"), F.regexp_extract(line(), title, 3).alias("name"),
        F.regexp_extract("value", rf"\*\*Specialises:\*\*\s*((?:{PREFIX})-\d{{2}})", 1).alias("parent"),
        F.regexp_extract_all("value", F.lit(FK), F.lit(1)).alias("keys"), X.part(F.col("value"), "Owned and consumed by").alias("owned_body"),
    )
    blocks = parts.select("*", F.regexp_replace("folder", "^specialisations/", "").alias("slug"), X.bold_block(F.col("owned_body"), "Owned by").alias("owned"), X.bold_block(F.col("owned_body"), "Consumed by").alias("consumed"))
    # the list of consumers ends where a sentence follows the last bracket
    listed = F.regexp_replace("consumed", r"(?s)(\)\.)\s+[A-Z\n].*$", "$1")
    expected = F.coalesce(*[F.when(F.col("slug") == s, p) for s, p in slugs.items()])
    lists = blocks.select("*", F.concat("prefix", F.lit("-"), "number").alias("entity_id"), X.references(F.col("owned"), SD_REF).alias("owned_by"), X.references(listed, SD_REF).alias("consumed_by"), expected.alias("pack_prefix"))
    members = F.flatten(F.transform("keys", lambda k: F.when(k.startswith("{"), F.transform(F.split(F.substring_index(F.substring(k, 2, 1 << 30), "}", 1), ","), lambda m: F.trim(m))).otherwise(F.array(k))))
    bad = F.exists("members", lambda m: ~m.rlike(FK_MEMBER) & (F.lower(m) != "self"))
    error = first_error(
        (F.col("value") == "", "the file is empty"), (F.col("pack_prefix").isNull(), "the pack is unknown"), (F.col("file_prefix") == "", "the name is not X-NN-slug.md"), (F.col("file_prefix") != F.col("pack_prefix"), "the prefix is not that of the pack"),
        (F.col("prefix") == "", "the first line is not '# X-NN — Title'"), (F.expr("prefix <> file_prefix or number <> file_number"), "title and name have different numbers"), (bad, "malformed set of keys"),
        (F.coalesce("owned", F.lit("")) == "", "there is no Owned by line"), (F.coalesce("consumed", F.lit("")) == "", "there is no Consumed by line"), (F.size("owned_by") == 0, "the Owned by line names no domain"),
    )
    return lists.withColumn("members", members).select(
        "root", "source_path", "entity_id", "prefix", F.expr("try_cast(number as int)").alias("number"), F.col("slug").alias("pack"), "name", X.summary(F.col("value")).alias("summary"),
        F.nullif("parent", F.lit("")).alias("parent"), "members", "owned_by", "consumed_by", error.alias("error"), "value",
    )


def foreign_keys(entities: DataFrame) -> DataFrame:
    """root, entity_id, target, is_self of each distinct key of an entity file; sets count by member, ids in one spelling."""
    own = entities.select("root", "entity_id", F.explode("members").alias("raw"))
    target = F.when(F.lower("raw") == "self", F.col("entity_id")).otherwise(X.entity_id(F.col("raw")))
    return own.select("root", "entity_id", target.alias("target")).distinct().withColumn("is_self", F.col("entity_id") == F.col("target"))


def key_columns(entities: DataFrame) -> DataFrame:
    """root, entity_id, column of each attribute row that holds a key of any notation."""
    rows = entities.select("root", "entity_id", F.explode(F.split("value", "\n")).alias("row")).filter(F.col("row").rlike(r"^\|\s*`?\w+`?\s*\|") & F.col("row").rlike(FK))
    return rows.select("root", "entity_id", F.regexp_extract("row", r"^\|\s*`?(\w+)`?\s*\|", 1).alias("column")).distinct()


def links(entities: DataFrame) -> DataFrame:
    """root, entity_id, sd_id, kind (owned_by, consumed_by)."""
    one = lambda c: entities.select("root", "entity_id", F.explode(c).alias("sd_id"), F.lit(c).alias("kind"))
    return one("owned_by").unionByName(one("consumed_by"))


def sd_references(domains: DataFrame) -> DataFrame:
    """root, sd_id, ref, kind: consumes-sd, produces-sd, upstream, downstream, consumes-entity, owns-entity."""
    kinds = {"consumes_sds": "consumes-sd", "produces_sds": "produces-sd", "upstream": "upstream", "downstream": "downstream", "consumes_entities": "consumes-entity", "owns_entities": "owns-entity"}
    tagged = lambda c, kind: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda r: F.struct(r.alias("ref"), F.lit(kind).alias("kind")))
    pairs = F.flatten(F.array(*[tagged(c, kind) for c, kind in kinds.items()]))
    return domains.select("root", "sd_id", "bd_id", F.explode(pairs).alias("r")).select("root", "sd_id", "bd_id", "r.ref", "r.kind")


def ownership(files: DataFrame) -> DataFrame:
    """A row for each entity row of the ownership map: owners, pattern, owner cell, line, error (repeated, or without owner)."""
    rows = below(files, r"model/ownership-map\.md$").select("root", F.posexplode(F.split("value", "\n")).alias("at", "row"))
    cells = rf"^\|\s*\**((?:{PREFIX})-\d{{2}})[^|]*\|([^|]+)\|([^|]+)\|"
    own = rows.filter(F.col("row").rlike(cells)).select("root", (F.col("at") + 1).alias("line"), F.regexp_extract("row", cells, 1).alias("entity_id"), F.trim(F.regexp_extract("row", cells, 2)).alias("cell"), F.trim(F.regexp_replace(F.regexp_extract("row", cells, 3), r"\*+", "")).alias("pattern"))
    own = own.withColumn("owners", X.references(F.col("cell"), SD_REF)).withColumn("nth", F.row_number().over(Window.partitionBy("root", "entity_id").orderBy("line")))
    return own.withColumn("error", first_error((F.col("nth") > 1, "the entity has a row already"), (F.size("owners") == 0, "the row names no domain"))).drop("nth")


def ownership_lenient(files: DataFrame) -> DataFrame:
    """root, entity_id and the (sd_id, annotation) pairs of all its rows, in the order of lines."""
    own = ownership(files).filter(F.size("owners") > 0)
    pairs = F.transform(F.regexp_extract_all("cell", F.lit(r"(SD-\d{2}\.\d+)"), F.lit(1)), lambda s: F.struct(s.alias("sd_id"), F.col("cell").alias("annotation")))
    return own.groupBy("root", "entity_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", pairs.alias("p")))), lambda x: x["p"])).alias("owners"))


def index_summary(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The totals that an index declares (null if it does not), and its per-domain rows."""
    own = below(files, r"model/service-domains/INDEX\.md$")
    total = r"\*\*(\d+) Business Domains, (\d+) Service Domains\.\*\*"
    number = lambda k: F.nullif(F.regexp_extract("value", total, k), F.lit("")).cast("int")
    return own.select("root", number(1).alias("declared_bd"), number(2).alias("declared_sd")), domain_rows(own)


def domain_rows(files: DataFrame) -> DataFrame:
    """root, source_path, bd and declared count of each row | BD-nn | name | office | n |."""
    pattern = r"^\|\s*BD-(\d+)\s*\|[^|]+\|[^|]+\|\s*(\d+)\s*\|"
    rows = files.select("root", "source_path", F.explode(F.split("value", "\n")).alias("row")).filter(F.col("row").rlike(pattern))
    return rows.select("root", "source_path", F.regexp_extract("row", pattern, 1).cast("int").alias("bd"), F.regexp_extract("row", pattern, 2).cast("int").alias("declared"))


def offices(files: DataFrame) -> DataFrame:
    """root, office, subtotal and cells (bd -> count) of each subgraph of the domain map."""
    own = below(files, r"model/diagrams/[^/]*business-domain-map\.md$")
    block = r'subgraph\s+(\w+)\["[^"]*?—\s*(\d+)\s+SDs?"\]\s*\n(?s:(.*?))\n\s*end\b'
    whole = own.select("root", F.explode(F.regexp_extract_all("value", F.lit(block), F.lit(0))).alias("b"))
    cell = r'BD(\d+)\["[^"]*?<br\s*/?>\s*(\d+)\s+SDs?"\]'
    cells = F.map_from_arrays(F.transform(F.regexp_extract_all("b", F.lit(cell), F.lit(1)), lambda x: x.cast("int")), F.transform(F.regexp_extract_all("b", F.lit(cell), F.lit(2)), lambda x: x.cast("int")))
    return whole.select("root", F.regexp_extract("b", block, 1).alias("office"), F.regexp_extract("b", block, 2).cast("int").alias("subtotal"), cells.alias("cells"))


def curies(files: DataFrame, part: str = "classes") -> DataFrame:
    """root, prefix, name of a curie reference, a JSON document of prefixes; ``part`` is classes or object_properties.

    A prefix without names is a row with a null name, so that a known prefix can be told from an unknown one.
    """
    own = files.withColumn("root", root()).withColumn("p", F.from_json("value", f"prefixes map<string, struct<{part}: array<string>>>")["prefixes"])
    return own.select("root", F.explode("p").alias("prefix", "s")).select("root", "prefix", F.explode_outer(F.col("s")[part]).alias("name"))


def baseline(files: DataFrame) -> DataFrame:
    """root, entity_id, sd_id of the pairs that a baseline document lists."""
    own = files.withColumn("root", root())
    return own.select("root", F.explode(F.from_json("value", "pairs array<array<string>>")["pairs"]).alias("p")).select("root", F.col("p")[0].alias("entity_id"), F.col("p")[1].alias("sd_id")).distinct()


def glossary(files: DataFrame) -> DataFrame:
    """root, term, slug and definition of each line **term** — definition."""
    pattern = r"^\*\*([^*]+)\*\*\s+[—-]\s+(.+)$"
    rows = below(files, r"model/glossary\.md$").select("root", "source_path", F.explode(F.split("value", "\r?\n")).alias("row")).filter(F.col("row").rlike(pattern))
    own = rows.select("root", "source_path", X.clean_inline(F.regexp_extract("row", pattern, 1)).alias("term"), X.clean_inline(F.regexp_extract("row", pattern, 2)).alias("definition"))
    return own.withColumn("slug", X.slug(F.col("term")))


def relations(files: DataFrame) -> DataFrame:
    """root, verb, label, inverse, meaning and text of each block under a heading of the fourth level."""
    own = below(files, r"model/relations\.md$")
    block = r"(?m)^####\s+`([^`]+)`\s+[—-]\s+`([^`]+)`\s*$(?s:.*?)(?=^#### |^### |\z)"
    blocks = own.select("root", "source_path", F.explode(F.regexp_extract_all("value", F.lit(block), F.lit(0))).alias("b"))
    bullet = lambda name: F.trim(F.regexp_extract("b", rf"(?m)^-\s+\*\*{name}:\*\*\s+(.+)$", 1))
    verb, label = F.regexp_extract("b", block.replace(r"(?=^#### |^### |\z)", ""), 1), F.regexp_extract("b", block.replace(r"(?=^#### |^### |\z)", ""), 2)
    return blocks.select("root", "source_path", verb.alias("verb"), label.alias("label"), F.regexp_replace(bullet("Inverse"), "`", "").alias("inverse"), bullet("Cardinality").alias("cardinality"), bullet("Meaning").alias("meaning"), bullet("Binds").alias("binds"), F.col("b").alias("text"))


def bindings(relations: DataFrame) -> DataFrame:
    """root, verb, entity_id, column (null for a specialisation) of each binding a verb lists: `E-01.column` or `PB-01 specialises`."""
    pattern = rf"((?:{PREFIX})-\d{{2}})(?:\.(\w+)| (specialises))"
    own = relations.select("root", "verb", F.explode(F.regexp_extract_all("binds", F.lit(pattern), F.lit(0))).alias("b"))
    return own.select("root", "verb", F.regexp_extract("b", pattern, 1).alias("entity_id"), F.nullif(F.regexp_extract("b", pattern, 2), F.lit("")).alias("column"))


def exports(files: DataFrame) -> DataFrame:
    """root, path below exports/ and format of each artefact of a known extension."""
    own = files.select("path").filter(F.col("path").rlike(rf"(?i)(?:^|/)exports/.*\.(?:{'|'.join(EXPORTS)})$"))
    rel = F.regexp_extract("path", r"(?:^|/)exports/(.*)$", 1)
    return own.select(root().alias("root"), rel.alias("rel"), F.upper(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("format"))


ITEM = ["root", "id", "type", "title", "description", "content", "parent_id", "source_path", "source_url", "official_url"]


def _markdown_items(files: DataFrame, pattern: str, kind: str, site: dict) -> DataFrame:
    own = below(files, pattern)
    purpose = X.section(F.col("value"), "Purpose")
    body = F.when(purpose != "", purpose).otherwise(F.regexp_replace("value", r"^# .+\r?\n", ""))
    rows = own.select("root", F.lit(kind).alias("type"), X.heading(F.col("value")).alias("h"), X.first_paragraph(body).alias("description"), X.clean_inline(F.col("value")).alias("content"), F.lit(None).cast("string").alias("parent_id"), "source_path", "value")
    return rows.select("root", F.col("h.id").alias("id"), "type", F.col("h.title").alias("title"), "description", "content", "parent_id", "source_path", X.source_url(F.col("source_path"), site).alias("source_url"), X.official_url(F.col("source_path"), kind, site).alias("official_url"), "value")


def catalogue_items(files: DataFrame, site: dict) -> DataFrame:
    """All items of a catalogue: domains, operations, entities, glossary terms, relations and exports.

    ``site`` has repository, tag and official (URLs and a release tag).
    """
    business = _markdown_items(files, r"model/service-domains/.*/README\.md$", "business-domain", site)
    service = _markdown_items(files, r"model/service-domains/.*/SD-\d+\.\d+-[^/]+\.md$", "service-domain", site)
    entity = _markdown_items(files, rf"model/entities/.*/(?:{PREFIX})-\d+-[^/]+\.md$", "entity", site)
    bullet = r"(?m)^-\s+\*\*([^*]+)\*\*\s+[—-]\s+(.+)$"
    ops = service.select("root", "id", "title", "source_path", "source_url", "official_url", F.posexplode(F.regexp_extract_all(X.section(F.col("value"), "Service Operations"), F.lit(bullet), F.lit(0))).alias("at", "b"))
    name, told = F.regexp_extract("b", bullet, 1), X.clean_inline(F.regexp_extract("b", bullet, 2))
    operation = ops.select(
        "root", F.concat("id", F.lit(":op-"), (F.col("at") + 1).cast("string")).alias("id"), F.lit("service-operation").alias("type"), X.clean_inline(name).alias("title"), told.alias("description"), F.concat_ws(" ", X.clean_inline(name), told, "title").alias("content"),
        F.col("id").alias("parent_id"), "source_path", F.concat("source_url", F.lit("#service-operations")).alias("source_url"), F.concat("official_url", F.lit("#"), X.slug(name)).alias("official_url"),
    )
    none = F.lit(None).cast("string").alias("parent_id")
    at = lambda anchor: F.concat(X.source_url(F.col("source_path"), site), F.lit("#"), F.col(anchor))
    terms = glossary(files).select("root", F.concat(F.lit("glossary:"), "slug").alias("id"), F.lit("glossary-term").alias("type"), F.col("term").alias("title"), F.col("definition").alias("description"), F.concat_ws(" ", "term", "definition").alias("content"), none, "source_path", at("slug").alias("source_url"), at("slug").alias("official_url"))
    meaning = F.when(F.col("meaning") != "", F.col("meaning")).otherwise(F.concat("verb", F.lit(" ("), "label", F.lit(")")))
    verbs = relations(files).select("root", F.concat(F.lit("relation:"), "verb").alias("id"), F.lit("relationship").alias("type"), F.col("verb").alias("title"), X.clean_inline(meaning).alias("description"), X.clean_inline(F.col("text")).alias("content"), none, "source_path", at("label").alias("source_url"), at("label").alias("official_url"))
    released = exports(files).select(
        "root", F.concat(F.lit("export:"), "rel").alias("id"), F.lit("export").alias("type"), F.col("rel").alias("title"), F.concat(F.lit("Released "), "format", F.lit(" model artefact.")).alias("description"), F.col("rel").alias("content"), none,
        F.concat(F.lit("exports/"), "rel").alias("source_path"), F.concat(F.lit(f"{site['repository']}/raw/{site['tag']}/exports/"), "rel").alias("source_url"), F.concat(F.lit(f"{site['official']}exports/"), "rel").alias("official_url"),
    )
    out = business.select(ITEM)
    for other in (service, operation, entity, terms, verbs, released):
        out = out.unionByName(other.select(ITEM))
    return out
