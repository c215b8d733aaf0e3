"""Parsers, rules and graphs on hand-made files with what a grammar does not allow, and text functions against plain Python."""

import os
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import graph as G
from ledgerline.operators import integrity as I
from ledgerline.operators.catalog import Catalog
from ledgerline.shared import scratch, write_files
from ledgerline.sources import files as S
from ledgerline.sources import model as M

SITE = {"repository": "https://c", "tag": "v1", "official": "https://o/"}
DOMAIN = """# SD-01.1 — Making & Keeping

**Applies:** PUB

## Purpose

It [keeps](x.md) things.

## Service Operations

- **Book it** — now
- Check – then - go
- Close: late
- Stop.
not a bullet

## Inputs and outputs

- **Inputs:** from SD-01.2, SD-01.1 and
  BD-02 too
- **Outputs:** none

## Entities

- **Consumes:** E-04 and E-07 any `method`, SD-02.1
- **Owns:** none, but E-05 is near
- **Produces:** SD-01.2

## Standards
"""
ENTITY = """# PB-03 — Bond

A row of
a bond.

**Specialises:** E-02

| Attribute | Type | Definition |
|---|---|---|
| a_id | varchar | FK -> E_9 no, FK -> E_09 |
| b_id | varchar | FK → {PB-03, PM04} |
| c_id | varchar | FK -> self |

## Owned and consumed by

- **Owned by:** SD-01.1 A; SD-01.1 A again
- **Consumed by:** SD-01.2 B (x); SD-02.1 C (y). Those of SD-09.9 are others.
"""


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, value string")


def test_service_domain(spark):
    d = M.service_domains(frame(spark, [("t/model/service-domains/BD-01-a/SD-01.1-making.md", DOMAIN)])).first()
    assert (d.root, d.sd_id, d.name, d.applies, d.purpose, d.error) == ("t", "SD-01.1", "Making & Keeping", "PUB", "It [keeps](x.md) things.", None)
    assert (d.consumes_entities, d.owns_entities, d.consumes_sds, d.produces_sds) == (["E-04", "E-07"], [], ["SD-02.1"], ["SD-01.2"])
    assert (sorted(d.upstream), sorted(d.downstream)) == (["BD-02", "SD-01.2", "SD-02.1"], ["SD-01.2"])


def test_operations(spark):
    files = frame(spark, [("model/service-domains/BD-01-a/SD-01.1-making.md", DOMAIN)])
    rows = M.operations(M.service_domains(files)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.so_id, r.name) for r in rows] == [(1, "so-01.1-01", "Book it"), (2, "so-01.1-02", "Check"), (3, "so-01.1-03", "Close"), (4, "so-01.1-04", "Stop")]


@pytest.mark.parametrize(
    ("path", "change", "error"),
    [
        ("BD-01-a/SD-01.1-x.md", lambda t: "", "the file is empty"),
        ("BD-01-a/SD-1.1-x.md", lambda t: t, "the name is not SD-NN.M-slug.md"),
        ("BD-02-a/SD-01.1-x.md", lambda t: t, "name and folder have different numbers"),
        ("BD-01-a/SD-01.1-x.md", lambda t: t.replace("# SD", "SD", 1), "the first line is not '# SD-NN.M — Title'"),
        ("BD-01-a/SD-01.2-x.md", lambda t: t, "title and name have different numbers"),
        ("BD-01-a/SD-01.1-x.md", lambda t: t.replace("**Applies:** PUB", ""), "there is no Applies tag"),
        ("BD-01-a/SD-01.1-x.md", lambda t: t.replace("PUB", "ALL"), "Applies is not PUB, PRIV or BOTH"),
        ("BD-01-a/SD-01.1-x.md", lambda t: t.replace("## Service Operations", "Operations"), "there is no section Service Operations"),
        ("BD-01-a/SD-01.1-x.md", lambda t: t + "\n## More\n", "unknown heading More"),
    ],
)
def test_service_domain_errors(spark, path, change, error):
    assert [r.error for r in M.service_domains(frame(spark, [(f"model/service-domains/{path}", change(DOMAIN))])).collect()] == [error]


def test_entity(spark):
    files = frame(spark, [("model/entities/specialisations/public-markets/PB-03-bond.md", ENTITY)])
    e = M.entities(files)
    r = e.first()
    assert (r.entity_id, r.pack, r.name, r.summary, r.parent, r.owned_by, r.consumed_by, r.error) == ("PB-03", "public-markets", "Bond", "A row of a bond.", "E-02", ["SD-01.1"], ["SD-01.2", "SD-02.1"], None)
    assert {(x.target, x.is_self) for x in M.foreign_keys(e).collect()} == {("E-09", False), ("PM-04", False), ("PB-03", True)}
    assert {x.column for x in M.key_columns(e).collect()} == {"a_id", "b_id", "c_id"}


@pytest.mark.parametrize(
    ("path", "change", "error"),
    [
        ("specialisations/arts/PB-03-b.md", lambda t: t, "the pack is unknown"),
        ("core/PB-03-b.md", lambda t: t, "the prefix is not that of the pack"),
        ("specialisations/public-markets/Bond.md", lambda t: t, "the name is not X-NN-slug.md"),
        ("specialisations/public-markets/PB-04-b.md", lambda t: t, "title and name have different numbers"),
        ("specialisations/public-markets/PB-03-b.md", lambda t: t.replace("PM04", ""), "malformed set of keys"),
        ("specialisations/public-markets/PB-03-b.md", lambda t: t.replace("PM04", "XX-04"), "malformed set of keys"),
        ("specialisations/public-markets/PB-03-b.md", lambda t: t.replace("Owned by:", "Owner:"), "there is no Owned by line"),
        ("specialisations/public-markets/PB-03-b.md", lambda t: t.replace("SD-01.1 A", "nobody"), "the Owned by line names no domain"),
    ],
)
def test_entity_errors(spark, path, change, error):
    assert [r.error for r in M.entities(frame(spark, [(f"model/entities/{path}", change(ENTITY))])).collect()] == [error]


def test_partition_window_ends_at_the_next_entity(spark):
    block = lambda t: frame(spark, [("model/service-domains/BD-01-a/SD-01.1-x.md", f"- **Consumes:** {t}\n\nbook")])
    said = lambda t: [r.entity_id for r in I.partitions(block(t)).collect()]
    assert said("E-04 any book") == [] and said("E-04 rows, E-07 by method and book") == ["E-04"] and said("E-04 " + "x" * 240 + " book") == ["E-04"]
    assert said("E-01 and E-19 of risk_type market; E-29") == ["E-29"]


def test_cited_names(spark):
    domains = M.service_domains(frame(spark, [("model/service-domains/BD-01-a/SD-01.1-x.md", DOMAIN)]))
    text = "SD-01.1 Making & Keeping feeds SD-01.1 Making Up Things, SD-09.9 Lost Domain; SD-01.1 IPV policy. ```SD-01.1 Not Seen Here``` a / SD-01.1 Whole List"
    found = I.cited_names(frame(spark, [("model/service-domains/BD-01-a/SD-01.2-y.md", text), ("model/service-domains/BD-01-a/README.md", text), ("model/notes.md", text)]), domains).collect()
    assert sorted((r.sd_id, r.cited, r.defect) for r in found) == [("SD-01.1", "Making Up Things", "other_name"), ("SD-09.9", "Lost Domain", "no_domain")]


def test_subtotals(spark):
    text = 'subgraph FRONT["Front — 20 SDs"]\n  BD1["BD-01<br/>12 SDs"]\n  BD2["BD-02<br>8 SDs"]\nend\nsubgraph BACK["Back — 15 SDs"]\n  BD3["x<br/>14 SDs"]\nend\n'
    offices = M.offices(frame(spark, [("model/diagrams/02-business-domain-map.md", text)]))
    counts = spark.createDataFrame([("", 1, 12), ("", 2, 9), ("", 3, 14), ("", 4, 5)], "root string, bd int, actual long")
    found = {(r.rule, r.subject, r.stated, r.actual) for r in I.office_subtotals(offices, counts).collect()}
    assert found == {("subtotal", "BACK", 15, 14), ("cell", "BD-02", 8, 9), ("total", "all", 35, 40), ("absent", "BD-04", None, 5)}


def test_fold_and_slug_of_every_code_point(spark):
    points = [c for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4]
    rows = [f"a{chr(c)}B{chr(c)}" for c in points]
    found = spark.createDataFrame([(r,) for r in rows], "t string").select("t", X.fold(F.col("t")).alias("f"), X.slug(F.col("t")).alias("s")).collect()
    plain = lambda t: re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", unicodedata.normalize("NFKD", t.lower())))
    # letters whose lower case only one of the two Unicode versions knows differ; they have no decomposition
    wrong = [r.t for r in found if r.f != X.fold_plain(r.t)]
    assert len(wrong) < 60 and all(unicodedata.normalize("NFKD", t) == t for t in wrong)
    assert [r.t for r in found if r.s != plain(r.t)] == []


def test_search_trims_and_folds(spark):
    items = spark.createDataFrame([("E-01", "entity", "Čas ﬁx", "old", "x"), ("E-02", "export", "other", "cas fix", "y"), ("G-1", "glossary-term", "cas fix", "", "")], "id string, type string, title string, description string, content string")
    catalog = Catalog(items, "1")
    assert [(r.id, r.score, r.model_version) for r in catalog.search("  ČAS FIX ").collect()] == [("E-01", 80 + 35 + 20, "1"), ("G-1", 80 + 35 + 20, "1"), ("E-02", 18 + 10, "1")]
    assert [r.id for r in catalog.map_requirement("cas fix").collect()] == ["E-01"] and [r.id for r in catalog.list_exports("cas").collect()] == ["E-02"]
    assert catalog.search("..").count() == 0 and "content" not in catalog.get("e-01").drop("content").columns
    assert [(r.id, r.found) for r in catalog.get_or_suggest("e-01").collect()] == [("E-01", True)]
    assert [(r.id, r.found) for r in catalog.get_or_suggest("cas").orderBy("id").collect()] == [("E-01", False), ("E-02", False), ("G-1", False)]


def test_files_and_catalogue_document(spark, tmp_path):
    written = frame(spark, [("a/model/service-domains/BD-01-x/SD-01.1-making.md", DOMAIN), ("a/model/glossary.md", "**Ärm** — a thing\n"), ("a/exports/x.csv", "1")])
    assert sorted((r.path.split("/")[-1], r.bytes) for r in write_files(written, f"file://{tmp_path}").collect()) == sorted((p, len(v.encode())) for p, v in [("SD-01.1-making.md", DOMAIN), ("glossary.md", "**Ärm** — a thing\n"), ("x.csv", "1")])
    read = M.tree(spark, str(tmp_path))
    assert {r.value for r in read.collect()} == {DOMAIN, "**Ärm** — a thing\n"} and M.listing(spark, str(tmp_path)).count() == 3
    items = M.catalogue_items(read.unionByName(M.listing(spark, str(tmp_path)).select("path", F.lit("").alias("value"))), SITE).drop("root")
    path = scratch(spark, "doc")
    S.write_catalogue(items.withColumn("root", F.lit("r")).select(M.ITEM), path, "1", SITE)
    assert S.read_document(spark, path).count() == items.count()
    import json

    parts = sorted((tmp_path.__class__(path.removeprefix("file://"))).glob("part-*"))
    whole = json.loads("".join(p.read_text() for p in parts))
    assert whole["modelVersion"] == "1" and [i["id"] for i in whole["items"]] == sorted(i["id"] for i in whole["items"]) and "glossary:a-rm" in {i["id"] for i in whole["items"]}


def test_walk_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "v"), ("b", "c", "v"), ("c", "a", "v"), ("c", "d", "w")], "src string, dst string, verb string")
    assert sorted(tuple(r) for r in G.walk(edges, "v").collect()) == sorted([("a", "b", 1), ("a", "c", 2), ("a", "a", 3), ("b", "c", 1), ("b", "a", 2), ("b", "b", 3), ("c", "a", 1), ("c", "b", 2), ("c", "c", 3)])


def test_labels_are_escaped(spark):
    business = spark.createDataFrame([("r", "BD-01", 'A "b" \\c', "front")], "root string, bd_id string, name string, office string")
    domains = spark.createDataFrame([], "root string, bd_id string")
    edges = spark.createDataFrame([], "root string, src string, dst string, kind string")
    line = G.landscape(business, domains, edges).first().line
    assert 'label="BD-01\\\\nA \\"b\\" \\\\c' in line.replace("\\\\\\\\", "\\\\") and G.quoted(F.lit("x")) is not None


@pytest.mark.skipif("MODEL_TREE" not in os.environ, reason="the folder of a released model tree")
def test_a_released_tree_has_no_defects(spark):
    """The parsers and the rules on a tree of the released layout, with the released numbers of files."""
    files = M.tree(spark, os.environ["MODEL_TREE"])
    bds, sds, ents = M.business_domains(files), M.service_domains(files), M.entities(files)
    assert (bds.count(), sds.count(), ents.count()) == (17, 171, 86)
    for found in (bds.filter("error is not null") if "error" in bds.columns else bds.filter("false"), sds.filter("error is not null"), ents.filter("error is not null"), I.domain_references(sds, bds), I.entity_references(ents), I.entity_domains(ents, sds), I.partitions(files), I.cited_names(files, sds)):
        assert found.collect() == []
