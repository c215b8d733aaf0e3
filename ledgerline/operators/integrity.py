"""Integrity rules over the frames of a model tree: each gives rows of what breaks it, (root, subject, message) and more.

Rules are joins and aggregations within a tree (``root``); a tree without defects gives no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import model as M

#: Entities whose rows are partitioned among owners, and the words by which a consumer tells the partition.
PARTITIONED = {
    "E-04": ["book", "ibor", "abor"],
    "E-07": ["method", "observable_price", "mark_to_model", "manager_mark", "appraisal", "amortised_cost"],
    "E-13": ["partition", "instrument-side", "entity-side", "fund-side"],
    "E-14": ["partition", "instrument-side", "entity-side", "fund-side"],
    "E-19": ["risk_type"],
    "E-25": ["account_type", "safekeeping", "cash", "register"],
    "E-29": ["plan_type", "strategic", "reference_portfolio", "commitment_pacing"],
}
#: Phrases that state both numbers of domains, and phrases that state one of the model's numbers.
PAIRS = {
    "model total": r"model total[^\d]{0,30}?(\d+)\s+Business\s+Domains?,?\s+(\d+)\s+Service\s+Domains?",
    "current": r"(?:current(?:\s+state)?[:\s]+|the current\s+|[Ff]inal model[:\s]+\**)(\d+)\s+BD\s*/\s*(\d+)\s+SD",
    "decomposition": r"(\d+)\s+Business\s+Domains?\s*/\s*(\d+)\s+Service\s+Domains?\s+decomposition",
    "and": r"(\d+)\s+Business\s+Domains?\s+and\s+(\d+)\s+Service\s+Domains?",
}
#: The phrase of the README, phrases that state entity counts by what they count, and the sum in brackets.
README_PAIR = r"(\d+) Business Domains?(?:\s+and|,)\s+(\d+) Service Domains?"
PROSE = [("all business domains", r"all (\d+) Business Domains", "bds"), ("all service domains", r"all (\d+) Service Domains", "sds"), ("model total", r"model total\D{0,30}?(\d+)", "sds"), ("specialisations", r"(\d+) specialisation entit", "spec"), ("with the core", r"(\d+) with the core", "total"), ("entity model", r"entity model is \*\*(\d+) entities", "total")]
ENTITY_COUNTS = [
    ("total: bold", r"\*\*(\d+)\s+entities\*\*\s*[:(—]", "total"), ("total: with the core", r"\b(\d+)\s+with\s+the\s+core\b", "total"), ("total: has", r"\bhas\s+(\d+)\s+entities\b", "total"), ("total: label", r"(?<!\()\b(\d+)\s+entities\s+[—(]", "total"), ("total: model", r"entity model is \*\*(\d+)\s+entities", "total"),
    ("core: generalised", r"\bgeneralised core of (\d+)\b", "core"), ("core: of", r"\bcore of (\d+)\s+entit", "core"), ("core: entities", r"\b(\d+)\s+core\s+entities\b", "core"), ("core: layers", r"\b(\d+)\s+core\s*\+\s*\d+\s+specialisation", "core"),
    ("specialisations: bold", r"\*\*(\d+)\s+specialisation\s+entit", "spec"), ("specialisations", r"\b(\d+)\s+specialisation\s+entities\b", "spec"),
]
GLOSS = r"\((\d+)\s*\+\s*(\d+)\s*\+\s*(\d+)\s*\+\s*(\d+)\s*\+\s*(\d+)\)"
#: Sections that a service-domain file must have, and those whose absence is a warning.
REQUIRED, EXPECTED = ["## Purpose", "## Service Operations", "## Entities", "## Standards"], ["## Inputs and outputs", "## Open extensions"]


def unresolved(references: DataFrame, known: DataFrame, key: str = "ref") -> DataFrame:
    """References (root, ..., ref) that name nothing that is known (root, id)."""
    return references.join(known.select("root", F.col("id").alias(key)).distinct(), ["root", key], "left_anti")


def ids(frame: DataFrame, column: str) -> DataFrame:
    return frame.select("root", F.col(column).alias("id"))


def domain_references(domains: DataFrame, business: DataFrame) -> DataFrame:
    """References between domains, structured or narrative, that resolve to none."""
    refs = M.sd_references(domains).filter(F.col("kind").isin("consumes-sd", "produces-sd", "upstream", "downstream"))
    return unresolved(refs, ids(domains, "sd_id").unionByName(ids(business, "bd_id"))).select("root", "sd_id", "ref", "kind")


def entity_references(entities: DataFrame) -> DataFrame:
    """Keys and parents of entities that name no entity."""
    refs = M.foreign_keys(entities).filter("not is_self").select("root", "entity_id", F.col("target").alias("ref"), F.lit("fk").alias("kind"))
    parents = entities.filter("parent is not null").select("root", "entity_id", F.col("parent").alias("ref"), F.lit("specialises").alias("kind"))
    return unresolved(refs.unionByName(parents), ids(entities, "entity_id")).select("root", "entity_id", "ref", "kind")


def entity_domains(entities: DataFrame, domains: DataFrame) -> DataFrame:
    """Owners and consumers of entities that are no service domain."""
    refs = M.links(entities).select("root", "entity_id", F.col("sd_id").alias("ref"), "kind")
    return unresolved(refs, ids(domains, "sd_id")).select("root", "entity_id", "ref", "kind")


def owner_side(ownership: DataFrame, domains: DataFrame) -> DataFrame:
    """Owners of the map that do not say so: there is no such domain, no Owns line, it starts with none, or lacks the entity."""
    pairs = ownership.select("root", "entity_id", F.explode("owners").alias("sd_id"))
    own = pairs.join(domains.select("root", "sd_id", "owns", F.lit(True).alias("there")), ["root", "sd_id"], "left")
    first = F.lower(F.trim(F.substring_index("owns", "\n", 1)))
    state = F.when(F.col("there").isNull(), "no_domain").when(F.coalesce("owns", F.lit("")) == "", "no_line").when(first.startswith("none"), "says_none").when(~F.col("owns").contains(F.col("entity_id")), "not_named")
    return own.withColumn("defect", state).filter("defect is not null").select("root", "entity_id", "sd_id", "defect")


def partitions(files: DataFrame) -> DataFrame:
    """Mentions of a partitioned entity in a Consumes block that do not tell the partition.

    The window is the 240 characters after the mention, cut at the next entity; one of the entity's words must be in it.
    """
    own = M.below(files, r"model/service-domains/BD-[^/]+/(?:README|SD-[^/]*)\.md$")
    blocks = own.filter(F.contains("value", F.lit("**Consumes"))).select("root", "source_path", F.explode(X.labelled_blocks(F.col("value"), "Consumes", bullet=False)).alias("b"))
    mention = rf"\b({'|'.join(PARTITIONED)})\b(?=((?s:.{{0,240}})))"
    found = blocks.select("root", "source_path", F.explode(F.arrays_zip(F.regexp_extract_all("b", F.lit(mention), F.lit(1)).alias("entity_id"), F.regexp_extract_all("b", F.lit(mention), F.lit(2)).alias("w"))).alias("m"))
    window = F.regexp_replace("m.w", rf"(?s)\b(?:{M.PREFIX})-\d+\b.*$", "")
    words = F.create_map(*[x for e, own_words in PARTITIONED.items() for x in (F.lit(e), F.array(*map(F.lit, own_words)))])
    silent = found.select("root", "source_path", "m.entity_id", window.alias("w")).filter(~F.exists(F.element_at(words, F.col("entity_id")), lambda k: F.contains(F.col("w"), k)))
    return silent.select("root", "source_path", "entity_id")


#: Small words that stand inside names.
SMALL = ["&", "of", "the", "and", "for", "in", "on", "to", "at"]


def cited_names(files: DataFrame, domains: DataFrame) -> DataFrame:
    """Citations of a service domain by a name that is not its own: no prefix of two words or more is part of its title.

    The files of service domains and entities are read; what is navigation, such as a README, is not. A longer prefix that
    is part of the title holds the first two words, so these decide. The text is cut before each id; what
    follows an id is told by a letter a word (C: a word of capital initial, E: the same at a stop, s: a small word inside
    names), and the name is the run of such words.
    """
    own = M.below(files, rf"model/(?:service-domains/BD-[^/]+/SD-[^/]*|entities/core/E-\d+-[^/]*|entities/specialisations/[^/]+/(?:{M.PREFIX})-\d+-[^/]*)\.md$")
    prose = F.regexp_replace("value", r"(?s)```.*?```", "")
    cut = own.select("root", "source_path", F.posexplode(F.split(prose, "(?=SD-)")).alias("k", "piece"), F.split(prose, "(?=SD-)").alias("pieces"))
    before = F.when(F.col("k") > 0, F.get("pieces", F.col("k") - 1)).otherwise("")
    words = F.split("piece", r"\s+")
    initial = lambda w: F.regexp_extract(w, "^[A-Z][A-Za-z0-9']*", 0)
    letter = lambda w: F.when(w.isin(*SMALL), "s").when(initial(w) == "", "x").when(initial(w) == w, "C").otherwise("E")
    pieces = cut.filter(~before.rlike(r"(?:\w|/ ?)$")).select("root", "source_path", words.alias("w")).filter(F.col("w")[0].rlike(r"^SD-\d{2}\.\d+$"))
    told = pieces.select("root", "source_path", F.col("w")[0].alias("sd_id"), "w", F.array_join(F.transform(F.slice("w", F.lit(2), F.size("w")), letter), "").alias("letters"))
    run = F.length(F.regexp_extract("letters", "^C(?:s?C)*(?:s?E)?", 0))
    named = told.withColumn("n", run).filter("n >= 2")
    found = named.select("root", "source_path", F.struct("sd_id", F.array_join(F.concat(F.slice("w", F.lit(2), F.col("n") - 1), F.array(initial(F.element_at("w", F.col("n") + 1)))), " ").alias("cited")).alias("c"))
    met = found.select("root", "source_path", "c.sd_id", "c.cited").join(domains.select("root", "sd_id", F.col("name").alias("title")), ["root", "sd_id"], "left")
    two = F.lower(F.array_join(F.slice(F.split("cited", r"\s+"), 1, 2), " "))
    state = F.when(F.col("title").isNull(), "no_domain").when(~F.contains(F.lower("title"), two), "other_name")
    return met.withColumn("defect", state).filter("defect is not null").select("root", "source_path", "sd_id", "cited", "defect")


def curie_tokens(files: DataFrame, reference: DataFrame, pattern: str = X.CURIE_CLASS) -> DataFrame:
    """Curies of the files that do not resolve: the prefix is unknown, or has no such name."""
    own = M.below(files, r"model/.*\.md$").select("root", "source_path", F.explode(X.curies(F.col("value"), pattern)).alias("t")).select("root", "source_path", F.col("t.prefix").alias("prefix"), F.col("t.name").alias("name"))
    named = reference.filter("name is not null").select("root", "prefix", "name")
    # a prefix that has classes only has no verified property, so its properties are of an unknown prefix
    known = (reference if pattern == X.CURIE_CLASS else named).select("root", "prefix").distinct().withColumn("known", F.lit(True))
    bad = own.join(named.distinct(), ["root", "prefix", "name"], "left_anti").join(known, ["root", "prefix"], "left")
    return bad.select("root", "source_path", "prefix", "name", F.when(F.col("known"), "unknown_name").otherwise("unknown_prefix").alias("defect"))


def curie_sweep(files: DataFrame, document: DataFrame) -> DataFrame:
    """Class and property curies of all trees; a tree without a reference is a defect of its own."""
    classes, properties = M.curies(document), M.curies(document, "object_properties")
    missing = M.below(files, r"model/").select("root").distinct().join(classes.select("root").distinct(), "root", "left_anti")
    none = missing.select("root", *[F.lit(None).cast("string").alias(c) for c in ("source_path", "prefix", "name")], F.lit("no_reference").alias("defect"))
    have = files.join(missing.withColumn("_m", F.lit(True)).select(F.col("root").alias("_root")), F.expr("regexp_extract(path, '^(.*?)/?(?:model|exports)/', 1) = _root"), "left_anti")
    return curie_tokens(have, classes).unionByName(curie_tokens(have, properties, X.CURIE_PROPERTY)).unionByName(none)


def domain_counts(domains: DataFrame) -> DataFrame:
    """root, bd and its number of service domains, by their files."""
    return domains.groupBy("root", "bd").agg(F.count("*").alias("actual"))


def totals(counts: DataFrame, entities: DataFrame) -> DataFrame:
    """The numbers of a tree: bds, sds, core, spec, total, and one for each pack."""
    own = counts.groupBy("root").agg(F.count("*").alias("bds"), F.sum("actual").alias("sds"))
    packs = [F.count_if(F.col("pack") == slug).alias(prefix) for prefix, slug, *_ in M.PACKS]
    by = entities.groupBy("root").agg(*packs, F.count("*").alias("total"))
    return own.join(by.withColumns({"core": F.col("E"), "spec": F.col("total") - F.col("E")}), "root")


def file_shape(files: DataFrame) -> DataFrame:
    """Sections and lines that a service-domain file lacks, with severity."""
    own = M.below(files, r"model/service-domains/BD-\d{2}-[^/]+/SD-\d{2}\.\d+-[^/]*\.md$").withColumn("sd_id", F.regexp_extract("path", r"(SD-\d{2}\.\d+)-[^/]*$", 1))
    lacks = lambda text: ~F.col("value").contains(text)
    checks = [(~F.col("value").startswith(F.concat(F.lit("# "), "sd_id", F.lit(" "))), "error", "title")]
    checks += [(lacks(s), "error", s) for s in REQUIRED] + [(lacks(s), "warning", s) for s in EXPECTED] + [(lacks("**Applies:**"), "error", "**Applies:**")]
    rows = F.filter(F.array(*[F.when(c, F.struct(F.lit(sev).alias("severity"), F.lit(what).alias("missing"))) for c, sev, what in checks]), lambda x: x.isNotNull())
    return own.select("root", "sd_id", F.explode(rows).alias("d")).select("root", "sd_id", "d.*")


def declared_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (root, source_path, bd, declared) of tables against the domains: other count, no such domain, or no row for one."""
    tables = rows.select("root", "source_path").distinct()
    actual = counts.join(tables, "root").select("root", "source_path", "bd", "actual")
    both = rows.select("root", "source_path", "bd", "declared").join(actual, ["root", "source_path", "bd"], "full_outer")
    state = F.when(F.col("actual").isNull(), "no_domain").when(F.col("declared").isNull(), "no_row").when(F.col("declared") != F.col("actual"), "other_count")
    return both.withColumn("defect", state).filter("defect is not null")


def index_totals(declared: DataFrame, numbers: DataFrame) -> DataFrame:
    """The totals that an index states wrongly, or not at all."""
    both = declared.join(numbers.select("root", "bds", "sds"), "root")
    one = lambda c, d, what: F.when(F.coalesce(F.col(c) != F.col(d), F.lit(True)), F.struct(F.lit(what).alias("what"), F.col(c).cast("long").alias("declared"), F.col(d).cast("long").alias("actual")))
    return both.select("root", F.explode(F.filter(F.array(one("declared_bd", "bds", "bd"), one("declared_sd", "sds", "sd")), lambda x: x.isNotNull())).alias("d")).select("root", "d.*")


def _matches(text: Column, pattern: str, groups: int, label: str) -> Column:
    """An array of (label, g1 ... gn) for each match."""
    parts = F.arrays_zip(*[F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), lambda x: x.cast("long")).alias(f"g{g}") for g in range(1, groups + 1)])
    return F.transform(parts, lambda p: F.struct(F.lit(label).alias("label"), *[p[f"g{g}"].alias(f"g{g}") for g in range(1, groups + 1)]))


def stated_pairs(files: DataFrame, numbers: DataFrame, patterns: dict[str, str], path: str, skip_tables: bool = False) -> DataFrame:
    """Phrases that state numbers of both kinds of domains other than the model's; rows of tables can be left out."""
    text = F.regexp_replace("value", r"(?m)^\s*\|.*$", "") if skip_tables else F.col("value")
    own = M.below(files, path).select("root", "source_path", text.alias("t"))
    found = own.select("root", "source_path", F.explode(F.concat(*[_matches(F.col("t"), p, 2, n) for n, p in patterns.items()])).alias("m"))
    met = found.select("root", "source_path", "m.label", F.col("m.g1").alias("stated_bd"), F.col("m.g2").alias("stated_sd")).join(numbers.select("root", "bds", "sds"), "root")
    return met.filter("stated_bd <> bds or stated_sd <> sds").select("root", "source_path", "label", "stated_bd", "stated_sd")


def stated_numbers(files: DataFrame, numbers: DataFrame, patterns: list[tuple[str, str, str]], path: str) -> DataFrame:
    """Phrases that state a number other than the model's; line breaks of diagrams count as spaces."""
    plain = F.regexp_replace(F.regexp_replace("value", r"\\n", " "), r"(?i)<br\s*/?>", " ")
    own = M.below(files, path).select("root", "source_path", plain.alias("t")).join(numbers, "root")
    found = lambda n, p, c: F.transform(F.regexp_extract_all("t", F.lit(f"(?i){p}"), F.lit(1)), lambda x: F.struct(F.lit(n).alias("label"), x.cast("long").alias("stated"), F.col(c).cast("long").alias("actual")))
    rows = [found(*p) for p in patterns]
    return own.select("root", "source_path", F.explode(F.concat(*rows)).alias("m")).select("root", "source_path", "m.*").filter("stated <> actual")


def pack_counts(files: DataFrame, numbers: DataFrame, path: str) -> DataFrame:
    """Sizes of packs that prose or a table row states wrongly, and glosses (a + b + c + d + e) of all sizes in their order."""
    own = M.below(files, path).select("root", "source_path", F.col("value").alias("t")).join(numbers, "root")
    found = lambda n, p, c: F.transform(F.regexp_extract_all("t", F.lit(p), F.lit(1)), lambda x: F.struct(F.lit(n).alias("label"), x.alias("stated"), F.col(c).cast("string").alias("actual")))
    rows = []
    for prefix, slug, *_, core in M.PACKS:
        if not core:
            rows.append(found(slug, rf"(?i)\b{slug}\s+(\d+)(?=[,.\s]|$)", prefix))
            rows.append(found(f"{slug} row", rf"(?im)^\|\s*\*?\*?\[?{slug}[^|]*\|\s*(\d+)\s*\|", prefix))
    sizes = F.concat_ws(" + ", *[F.col(p[0]).cast("string") for p in M.PACKS if not p[5]])
    gloss = F.transform(F.regexp_extract_all("t", F.lit(GLOSS), F.lit(0)), lambda x: F.struct(F.lit("all").alias("label"), F.regexp_replace(F.regexp_replace(x, r"[()]", ""), r"\s*\+\s*", " + ").alias("stated"), sizes.alias("actual")))
    return own.select("root", "source_path", F.explode(F.concat(*rows, gloss)).alias("m")).select("root", "source_path", "m.*").filter("stated <> actual")


def annotations(files: DataFrame, counts: DataFrame, path: str) -> DataFrame:
    """Annotations 'BD-nn ... (n SDs)' with another count than the domain's, or of no domain."""
    own = M.below(files, path).select("root", "source_path", F.explode(_matches(F.col("value"), r"BD-(\d+)[^()\n]{1,200}?\((\d+)\s+SDs?\b", 2, "annotation")).alias("m"))
    met = own.select("root", "source_path", F.col("m.g1").alias("bd"), F.col("m.g2").alias("stated")).join(counts, ["root", "bd"], "left")
    return met.filter("actual is null or actual <> stated").select("root", "source_path", "bd", "stated", "actual")


def office_subtotals(offices: DataFrame, counts: DataFrame) -> DataFrame:
    """Four rules of the domain map: cells sum to the subtotal, cells are the domains' counts, subtotals sum to the total, every domain has a cell."""
    summed = F.aggregate(F.map_values("cells"), F.lit(0).cast("long"), lambda a, x: a + x)
    row = lambda rule, subject, stated, actual: [F.lit(rule).alias("rule"), subject.alias("subject"), stated.cast("long").alias("stated"), actual.cast("long").alias("actual")]
    first = offices.withColumn("s", summed).filter("s <> subtotal").select("root", *row("subtotal", F.col("office"), F.col("subtotal"), F.col("s")))
    cells = offices.select("root", F.explode("cells").alias("bd", "stated"))
    name = F.concat(F.lit("BD-"), F.lpad(F.col("bd").cast("string"), 2, "0"))
    met = cells.join(counts, ["root", "bd"], "full_outer")
    second = met.filter("stated is not null and (actual is null or actual <> stated)").select("root", *row("cell", name, F.col("stated"), F.col("actual")))
    grand = offices.groupBy("root").agg(F.sum("subtotal").alias("stated")).join(counts.groupBy("root").agg(F.sum("actual").alias("actual")), "root")
    third = grand.filter("stated <> actual").select("root", *row("total", F.lit("all"), F.col("stated"), F.col("actual")))
    fourth = met.filter("stated is null").select("root", *row("absent", name, F.col("stated"), F.col("actual")))
    return reduce(DataFrame.unionByName, [first, second, third, fourth])


def maturity_counts(business: DataFrame, counts: DataFrame) -> DataFrame:
    """READMEs whose maturity line states no count of service domains, or another than there are."""
    stated = F.nullif(F.regexp_extract("value", r"\*\*Maturity:\*\*[^\n]*?(\d+)\s+Service\s+Domains?\b", 1), F.lit("")).cast("long")
    met = business.select("root", "bd_id", "bd", stated.alias("stated")).join(counts, ["root", "bd"], "left")
    return met.filter("stated is null or stated <> actual").select("root", "bd_id", "stated", "actual")


def without_owner(files: DataFrame) -> DataFrame:
    """Entity files that have no Owned by line."""
    return M.below(files, rf"model/entities/.*/(?:{M.PREFIX})-\d+-[^/]+\.md$").filter(~F.col("value").contains("**Owned by:**")).select("root", "source_path")


def relation_coverage(entities: DataFrame, verbs: DataFrame) -> DataFrame:
    """Key columns without a verb or with several, specialisations without one, and verbs that bind nothing."""
    bound = M.bindings(verbs)
    keys = M.key_columns(entities)
    by = bound.filter("column is not null").groupBy("root", "entity_id", "column").agg(F.count_distinct("verb").alias("n"))
    subject = F.concat_ws(".", "entity_id", "column")
    unbound = keys.join(by, ["root", "entity_id", "column"], "left_anti").select("root", subject.alias("subject"), F.lit("unbound_key").alias("defect"))
    several = by.filter("n > 1").select("root", subject.alias("subject"), F.lit("several_verbs").alias("defect"))
    parents = entities.filter("parent is not null").select("root", "entity_id").join(bound.filter("column is null").select("root", "entity_id").distinct(), ["root", "entity_id"], "left_anti")
    orphans = verbs.select("root", "verb").join(bound.select("root", "verb").distinct(), ["root", "verb"], "left_anti")
    return reduce(DataFrame.unionByName, [unbound, several, parents.select("root", F.col("entity_id").alias("subject"), F.lit("unbound_parent").alias("defect")), orphans.select("root", F.col("verb").alias("subject"), F.lit("orphan_verb").alias("defect"))])


def bijectivity(verbs: DataFrame) -> DataFrame:
    """Verbs without an inverse, that share one, or whose inverse is a verb."""
    own = verbs.select("root", "verb", "inverse")
    none = own.filter("inverse = ''").select("root", "verb", F.lit("no_inverse").alias("defect"))
    shared = own.filter("inverse <> ''").groupBy("root", "inverse").agg(F.min("verb").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = own.join(shared, ["root", "inverse"]).filter("verb <> first").select("root", "verb", F.lit("shared_inverse").alias("defect"))
    forward = own.join(verbs.select("root", F.col("verb").alias("inverse")), ["root", "inverse"], "left_semi").select("root", "verb", F.lit("inverse_is_a_verb").alias("defect"))
    return reduce(DataFrame.unionByName, [none, later, forward])


def relation_gate(files: DataFrame, entities: DataFrame, verbs: DataFrame) -> DataFrame:
    """Coverage and bijectivity; a tree that has entities and no vocabulary is a defect of its own."""
    lost = entities.select("root").distinct().join(M.below(files, r"model/relations\.md$").select("root"), "root", "left_anti")
    have = entities.join(lost, "root", "left_anti")
    return relation_coverage(have, verbs).unionByName(bijectivity(verbs).withColumnRenamed("verb", "subject")).unionByName(lost.select("root", F.lit("relations.md").alias("subject"), F.lit("no_vocabulary").alias("defect")))


def export_coverage(declared: DataFrame, exported: DataFrame, pattern: str) -> DataFrame:
    """Declared ids that an export (root, value) does not hold; ``pattern`` finds the ids in its text. Without an export: a warning."""
    present = exported.select("root", F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1))).alias("id")).distinct()
    absent = declared.select("root").distinct().join(exported.select("root").distinct(), "root", "left_anti").select("root", F.lit(None).cast("string").alias("id"), F.lit("warning").alias("severity"))
    missing = declared.join(exported.select("root").distinct(), "root", "left_semi").join(present, ["root", "id"], "left_anti").select("root", "id", F.lit("error").alias("severity"))
    return missing.unionByName(absent)


def page_coverage(pages: DataFrame, domains: DataFrame, entities: DataFrame) -> DataFrame:
    """Rendered pages (root, page, value) against the model: pages that are missing, operations, keys and members a page lacks.

    A tree without pages is one warning.
    """
    bare = lambda c: F.substring(F.col(c), 4, 1 << 30)
    sd_page, entity_page = F.concat(F.lit("sd-"), bare("sd_id"), F.lit(".html")), F.concat(F.lit("entity-"), F.col("entity_id"), F.lit(".html"))
    bd_page = F.concat(F.lit("bd-"), bare("bd_id"), F.lit(".html"))
    fixed = domains.select("root").distinct().select("root", F.explode(F.array(*[F.lit(f"{p}.html") for p in ("index", "landscape", "erd")])).alias("page"))
    wanted = reduce(DataFrame.unionByName, [fixed, domains.select("root", bd_page.alias("page")).distinct(), domains.select("root", sd_page.alias("page")), entities.select("root", entity_page.alias("page"))])
    there = pages.select("root").distinct()
    row = lambda frame, kind, what: frame.select("root", "page", F.lit(kind).alias("defect"), what.alias("subject"))
    none = F.lit(None).cast("string")
    warned = row(domains.select("root").distinct().join(there, "root", "left_anti").withColumn("page", none), "not_rendered", none)
    missing = row(wanted.join(there, "root", "left_semi").join(pages.select("root", "page"), ["root", "page"], "left_anti"), "missing_page", none)
    parsed = pages.select("root", "page", X.list_items(F.col("value")).alias("items"), X.anchors(F.col("value")).alias("hrefs"))
    ops = M.operations(domains).select("root", sd_page.alias("page"), "name").join(parsed, ["root", "page"]).filter(~X.carries_name(F.col("items"), F.col("name")))
    target = lambda c: F.concat(F.lit("entity-"), F.col(c), F.lit(".html"))
    keys = M.foreign_keys(entities).filter("not is_self").select("root", entity_page.alias("page"), target("target").alias("to")).join(parsed, ["root", "page"]).filter(~X.resolves_to(F.col("hrefs"), F.col("to")))
    members = domains.select("root", bd_page.alias("page"), sd_page.alias("to")).join(parsed, ["root", "page"]).filter(~X.resolves_to(F.col("hrefs"), F.col("to")))
    return reduce(DataFrame.unionByName, [warned, missing, row(ops, "missing_operation", F.col("name")), row(keys, "missing_key", F.col("to")), row(members, "missing_member", F.col("to"))])
