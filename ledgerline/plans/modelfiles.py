"""Model trees as files, written from the tables: what the views m_... say, in the Markdown that the parsers read.

The queries of model.py parse these files; their SQL reads the views, so a parser is held against what was written and not
against another parser. Known defects are written in: dangling references, keys in several spellings, rows without owner,
stale counts, missing and surplus rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import scratch

View = Callable[[str], DataFrame]


def cat(*parts: Column | str) -> Column:
    """A text of columns (given as columns) and literals (given as strings)."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def c(name: str) -> Column:
    return F.col(name)


def joined(frame: DataFrame, key: list[str], text: Column, name: str, sep: str, order: list[str] | None = None) -> DataFrame:
    """key and the texts of its rows as one."""
    entry = F.struct(*[F.col(o) for o in order or []], text.alias("t"))
    return frame.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), sep).alias(name))


def when(condition: str, text: Column | str, other: Column | str = "") -> Column:
    return F.when(F.expr(condition), cat(text)).otherwise(cat(other))


def _service_domains(view: View) -> DataFrame:
    sd = view("m_sd").join(view("m_bd").select("root", "bd", c("name").alias("bd_name")), ["root", "bd"])
    says, uses = view("m_says"), view("m_uses")
    lists = {"inputs": says.filter("kind = 'input'"), "outputs": says.filter("kind = 'output'"), "produces": says.filter("kind = 'produces-sd'"), "consumes": says.filter("kind = 'consumes-sd'"), "owns": uses.filter("kind = 'owns-entity'")}
    for name, rows in lists.items():
        sd = sd.join(joined(rows.distinct(), ["root", "sd_id"], c("ref"), name, ", "), ["root", "sd_id"], "left").withColumn(name, F.coalesce(c(name), F.lit("")))
    following = view("m_place").select(((c("nk") + 24) % 25).alias("nk"), c("sd_id").alias("next_id"), c("name").alias("next_name"))
    sd = sd.join(following, "nk")
    eaten = F.concat_ws("; ", F.when(F.expr("nk % 3 <> 1"), when("nk % 2 = 0", "E-04 any `book`", "E-04 positions")), F.when(F.expr("nk % 3 <> 2"), F.lit("E-07 any `method`")), F.when(c("consumes") != "", c("consumes")))
    value = cat(
        "# ", c("sd_id"), " — ", c("name"), "\n\n**Applies:** ", c("applies"), "\n\n## Purpose\n\n", c("name"), " serves *clients* of [", c("bd_name"), "](x.md).\nSecond line.\n\nMore prose.\n\n",
        "## Service Operations\n\nProse first.\n\n- **Book ", c("name"), "** — books it\n- Check ", c("name"), " — checks it\n- Close ", c("name"), ": at night\n\n",
        "## Inputs and outputs\n\n- **Inputs:** from ", c("inputs"), "\n- **Outputs:** to ", c("outputs"), "\n\n",
        "## Entities\n\n- **Consumes:** ", eaten, "\n- **Owns:** ", F.when(c("owns") == "", "none").otherwise(c("owns")), "\n- **Produces:** ", c("produces"), "\n\n",
        "## Standards\n\nAligned to fibo-be-le:LegalEntity", when("nk % 9 = 4", " and fibo-be-le:Bogus"), when("nk % 10 = 6", " and cmns-zz:Thing"), when("nk % 4 = 0", " via fibo-be-le:owns"), when("nk % 7 = 5", " via cmns-id:names"), ".\n",
        when("nk % 2 = 1", cat("\nCompare ", c("next_id"), " ", c("next_name"), ".\n")), when("nk % 7 = 3", cat("\nCompare ", c("next_id"), " Asset Ledger here.\n")), when("nk % 12 = 5", "\nCompare SD-99.1 Lost Domain.\n"),
        when("nk % 4 <> 2", "\n## Open extensions\n\nNone; a later addition may come.\n"), when("nk = 24", "\n## Extra\n\nNot known.\n"),
    )
    return sd.select(cat("r", c("root"), "/model/service-domains/", c("bd_id"), "-", F.lower(F.translate("bd_name", " ", "-")), "/", c("sd_id"), "-", F.lower(F.translate("name", " _", "--")), ".md").alias("path"), value.alias("value"))


def _business_domains(view: View) -> DataFrame:
    bd = view("m_bd").join(view("m_count").select("root", "bd", "n"), ["root", "bd"])
    value = cat("# ", c("bd_id"), " — ", c("name"), "\n\n**Office:** ", c("office"), ".\n\n**Maturity:** drafted, ", when("bd = 4", c("n") + 1, c("n")), " Service Domains.\n\n", c("name"), " at work.\n")
    return bd.select(cat("r", c("root"), "/model/service-domains/", c("bd_id"), "-", F.lower(F.translate("name", " ", "-")), "/README.md").alias("path"), value.alias("value"))


def _entities(view: View) -> DataFrame:
    spelled = F.when(F.expr("suppkey % 3 = 0"), F.translate("target", "-", "_")).when(F.expr("suppkey % 3 = 1"), F.translate("target", "-", "")).otherwise(c("target"))
    written = F.when(c("col") == "parent_id", F.lit("self")).otherwise(spelled)
    keys = view("m_key").withColumn("written", written).groupBy("root", "entity_id", "col").agg(F.array_sort(F.collect_list("written")).alias("t"))
    one = F.when(F.size("t") > 1, cat("{", F.array_join("t", ", "), "}")).otherwise(F.get("t", F.lit(0)))
    rows = joined(keys, ["root", "entity_id"], cat("| ", c("col"), " | varchar | FK ", F.when(c("col") == "parent_id", "→").otherwise("->"), " ", one, " |\n"), "rows", "")
    link = view("m_link")
    owners = joined(link.filter("kind = 'owned_by'").distinct(), ["root", "entity_id"], cat(c("sd_id"), " (keeps)"), "owners", "; ")
    users = joined(link.filter("kind = 'consumed_by'").distinct(), ["root", "entity_id"], cat(c("sd_id"), " (reads)"), "users", "; ")
    e = view("m_ent").join(rows, ["root", "entity_id"]).join(owners, ["root", "entity_id"]).join(users, ["root", "entity_id"])
    value = cat(
        "# ", c("entity_id"), " — ", c("name"), "\n\nRow of ", c("name"), "\nand its *keys*.\n\n", F.when(c("parent").isNull(), "").otherwise(cat("**Specialises:** ", c("parent"), "\n\n")),
        "| Attribute | Type | Definition |\n|---|---|---|\n", c("rows"), "| note | text | free |\n\n## Owned and consumed by\n\n- **Owned by:** ", c("owners"), ".\n- **Consumed by:** ", c("users"), ". The rest is mastered by SD-66.6 elsewhere.\n",
    )
    folder = F.when(c("pack") == "core", "core").otherwise(cat("specialisations/", c("pack")))
    return e.select(cat("r", c("root"), "/model/entities/", folder, "/", c("entity_id"), "-", F.lower(F.translate("name", " #", "--")), ".md").alias("path"), value.alias("value"))


def _singles(view: View) -> dict[str, DataFrame]:
    """The files of which a tree has one, by name."""
    root = view("m_root")
    row = lambda *parts: cat("| ", *[x for p in parts for x in (p, " | ")][:-1], " |\n")
    owned = view("m_map").groupBy("root", "entity_id", "nth").agg(F.array_join(F.array_sort(F.collect_list("sd_id")), " (`book`) + ").alias("sds"))
    lost = view("m_ent").filter("no = 16").select("root", "entity_id", F.lit(1).alias("nth"), F.lit("to be decided").alias("sds"))
    table = joined(owned.select("root", "entity_id", "nth", "sds").unionByName(lost), ["root"], row(cat("**", c("entity_id"), "** thing"), c("sds"), "**Single owner**"), "t", "", ["nth", "entity_id"])
    ownership = table.select("root", F.lit("model/ownership-map.md").alias("file"), cat("# Ownership\n\n| Entity | Owner | Pattern |\n|---|---|---|\n", c("t")).alias("value"))
    terms = view("m_term").agg(F.array_join(F.array_sort(F.collect_list(cat("**", c("term"), "** — ", c("definition"), "\n\n"))), "").alias("t"))
    glossary = root.crossJoin(F.broadcast(terms)).select("root", F.lit("model/glossary.md").alias("file"), cat("# Glossary\n\n", c("t")).alias("value"))
    bound = joined(view("m_bind").distinct(), ["root", "verb"], F.when(c("col").isNull(), cat("`", c("entity_id"), " specialises`")).otherwise(cat("`", c("entity_id"), ".", c("col"), "`")), "binds", ", ")
    verbs = root.crossJoin(F.broadcast(view("m_verb"))).join(bound, ["root", "verb"], "left")
    block = cat("#### `", c("verb"), "` — `", c("label"), "`\n\n- **Inverse:** `", c("inverse"), "`\n- **Cardinality:** n-1\n- **Meaning:** ", c("meaning"), "\n- **Binds:** ", F.coalesce("binds", F.lit("none")), "\n\n")
    relations = joined(verbs, ["root"], block, "t", "", ["k"]).select("root", F.lit("model/relations.md").alias("file"), cat("# Relations\n\n### Verbs\n\n", c("t")).alias("value"))
    count = view("m_count").join(view("m_bd").select("root", "bd", "name", "office"), ["root", "bd"])
    said = F.when(c("bd") == 3, c("n") + 1).otherwise(c("n"))
    totals = count.groupBy("root").agg(F.count("*").alias("bds"), F.sum("n").alias("sds"))
    lines = joined(count.filter("bd <> 5"), ["root"], row(cat("BD-0", c("bd")), c("name"), c("office"), said), "t", "", ["bd"])
    index = totals.join(lines, "root").select("root", F.lit("model/service-domains/INDEX.md").alias("file"), cat("# Index\n\n**", c("bds"), " Business Domains, ", c("sds") + 1, " Service Domains.**\n\n| BD | Name | Office | SDs |\n|---|---|---|---|\n", c("t"), "| BD-09 | Lost | Front | 2 |\n").alias("value"))
    cell = cat("  subgraph OFFICE", c("bd"), '["', c("office"), " office — ", when("bd = 4", c("n") + 1, c("n")), ' SDs"]\n    BD', c("bd"), '["BD-0', c("bd"), "<br/>", when("bd = 2", c("n") - 1, c("n")), ' SDs"]\n  end\n')
    maps = joined(count.filter("bd <> 5"), ["root"], cell, "t", "", ["bd"]).select("root", F.lit("model/diagrams/02-business-domain-map.md").alias("file"), cat("```mermaid\nflowchart LR\n", c("t"), "```\n").alias("value"))
    ents = view("m_ent").groupBy("root").agg(F.count("*").alias("n"), F.count_if(c("pack") == "core").alias("core"), *[F.count_if(c("prefix") == p).alias(p) for p in ("PB", "FO", "PM", "DR", "RA")])
    prose = totals.join(ents, "root").select(
        "root", F.lit("model/README.md").alias("file"),
        cat(
            "# Model\n\nThere are ", c("bds"), " Business Domains and ", c("sds"), " Service Domains.\nThe model total: ", c("bds"), " Business Domains, ", c("sds") - 1, " Service Domains.\nWe keep current ", c("bds"), " BD / ", c("sds"), " SD.\n",
            "BD-02 covers much (4 SDs). BD-01 is small (5 SDs). BD-08 is lost (1 SD).\nIt holds all ", c("bds") + 1, " Business Domains.\n",
            "The model has ", c("n"), " entities in a generalised core of ", c("core") + 1, " with ", c("n") - c("core"), " specialisation entities, ", c("n") - 1, " with the core.\n",
            "Packs: public-markets ", c("PB"), ", fund-operations ", c("FO") + 2, ", (", c("PB"), " + ", c("FO"), " + ", c("PM"), " + ", c("DR"), " + ", c("RA") + 1, ").\n",
        ).alias("value"),
    )
    curies = root.select("root", F.lit("model/curies.json").alias("file"), F.lit('{"prefixes": {"fibo-be-le": {"classes": ["LegalEntity"], "object_properties": ["owns"]}, "cmns-id": {"classes": ["Identifier"]}}}').alias("value"))
    pairs = view("m_link").filter("kind = 'consumed_by'").select("root", "entity_id", "sd_id").filter(F.col("entity_id").endswith("1")).distinct()
    grandfathered = joined(pairs, ["root"], cat('["', c("entity_id"), '", "', c("sd_id"), '"]'), "t", ", ").select("root", F.lit("model/baseline.json").alias("file"), cat('{"pairs": [', c("t"), "]}").alias("value"))
    files = {"ownership": ownership, "glossary": glossary, "relations": relations, "index": index, "map": maps, "prose": prose, "curies": curies, "baseline": grandfathered}
    return {name: f.select(cat("r", c("root"), "/", c("file")).alias("path"), "value") for name, f in files.items()}


def _exports(view: View) -> DataFrame:
    """Artefacts by path, with no content: one of each of three formats for a nation, and others of an unknown one."""
    names = view("m_place").select(F.explode(F.array(*[F.concat(F.lit("exports/"), F.lower("name"), F.lit(f".{x}")) for x in ("csv", "TTL", "json", "exe")])).alias("file"))
    return view("m_root").crossJoin(F.broadcast(names)).select(cat("r", c("root"), "/", F.translate("file", " ", "-")).alias("path"), F.lit("").alias("value"))


#: Trees that were written, by application and folder of the tables.
_WRITTEN: dict[tuple[str, str], str] = {}


def files(view: View, kind: str | None = None) -> DataFrame:
    """path and value of all files, or those of a kind; the trees are written once an application and then read."""
    key = (view.spark.sparkContext.applicationId, view.sf_dir)
    if key not in _WRITTEN:
        parts = {"service": _service_domains(view), "business": _business_domains(view), "entity": _entities(view), "export": _exports(view), **_singles(view)}
        folder = scratch(view.spark, "trees")
        for name, part in parts.items():
            part.write.parquet(f"{folder}/kind={name}")
        _WRITTEN[key] = folder
    if kind is not None:
        return view.spark.read.schema("path string, value string").parquet(f"{_WRITTEN[key]}/kind={kind}")
    return view.spark.read.schema("path string, value string, kind string").parquet(_WRITTEN[key]).select("path", "value")


def service_domains(view: View) -> DataFrame:
    return files(view, "service")


def business_domains(view: View) -> DataFrame:
    return files(view, "business")


def entities(view: View) -> DataFrame:
    return files(view, "entity")


def exports(view: View) -> DataFrame:
    return files(view, "export")


def tree(view: View) -> DataFrame:
    return files(view)
