"""A searchable catalogue over any frame of id, type, title, description and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


class Catalog:
    """Search, point lookup and counts. One plan a call: filter by type, score once a row, top k.

    ``items`` may have more columns (parent, source path, URLs); all but the content are given back. ``version`` is added
    to each result if it is given; ``identity`` describes the release.
    """

    LIMIT = 20
    #: Characters that an input of each tool has at least.
    LEAST = {"search": 2, "get": 2, "map_requirement": 5}
    #: The types that a requirement is mapped to, and the type of exports.
    MODEL_TYPES, EXPORT = ["business-domain", "service-domain", "service-operation", "entity", "relationship"], "export"

    def __init__(self, items: DataFrame, version: str | None = None, identity: dict | None = None) -> None:
        self.items, self.version, self.identity = items, version, identity or {}

    @classmethod
    def accepts(cls, tool: Column, given: Column) -> Column:
        """Whether a tool takes an input: the same rule for a column of inputs; unknown tools take none."""
        least = F.coalesce(*[F.when(tool == name, n) for name, n in cls.LEAST.items()])
        return F.coalesce(F.length(given) >= least, F.lit(False))

    def _versioned(self, found: DataFrame) -> DataFrame:
        return found if self.version is None else found.withColumn("model_version", F.lit(self.version))

    def search(self, query: str, k: int = 10, types: list[str] | None = None) -> DataFrame:
        """The k best items without their content: score descending, id ascending; k is held within 1 ... 20."""
        if len(query) < self.LEAST["search"]:
            raise ValueError("a query has two characters at least")
        return self._search(query, k, types)

    def _search(self, query: str, k: int, types: list[str] | None) -> DataFrame:
        found = self.items.filter(F.col("type").isin(types)) if types else self.items
        score = X.relevance(query, F.col("id"), F.col("title"), F.col("description"), F.col("content"))
        scored = found.withColumn("score", F.explode(score))
        return self._versioned(scored.drop("content").orderBy(F.desc("score"), "id").limit(max(1, min(self.LIMIT, k))))

    def get(self, ident: str) -> DataFrame:
        """The item whose folded id is the given one, or no row."""
        if len(ident) < self.LEAST["get"]:
            raise ValueError("an identifier has two characters at least")
        return self._versioned(self.items.filter(X.fold(F.col("id")) == X.fold_plain(ident)).orderBy("id").limit(1))

    def get_or_suggest(self, ident: str) -> DataFrame:
        """The item (found is true), or the five best matches for its identifier where there is none (found is false)."""
        item = self.get(ident).drop("content")
        others = self._search(ident, 5, None).join(F.broadcast(item.select(F.lit(1).alias("_one"))), F.lit(True), "left_anti")
        return item.withColumns({"score": F.lit(None).cast("int"), "found": F.lit(True)}).unionByName(others.withColumn("found", F.lit(False)))

    def map_requirement(self, requirement: str, k: int = 10, types: list[str] | None = None) -> DataFrame:
        """The k best model items for a requirement; terms of the glossary and exports are left out."""
        if len(requirement) < self.LEAST["map_requirement"]:
            raise ValueError("a requirement has five characters at least")
        return self._search(requirement, k, types or self.MODEL_TYPES)

    def list_exports(self, query: str | None = None) -> DataFrame:
        """All exports without their content, or the best of them for a query."""
        if query:
            return self._search(query, self.LIMIT, [self.EXPORT])
        return self._versioned(self.items.filter(F.col("type") == self.EXPORT).drop("content"))

    def get_identity(self) -> DataFrame:
        """One row: version, official source, the identity as JSON, and the items of each type as a map."""
        counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "count"))))
        own = self.items.groupBy("type").count().agg(counts.alias("counts"))
        described = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in self.identity.items()])) if self.identity else F.lit("{}")
        return own.select(F.lit(self.version).alias("model_version"), F.lit(self.identity.get("official")).alias("official_source"), described.alias("identity"), "counts")

    def resources(self) -> DataFrame:
        """uri and text of the two read-only resources: the identity, and version with counts."""
        own = self.get_identity()
        summary = F.to_json(F.struct("model_version", "counts", "official_source"))
        return own.select(F.explode(F.array(F.struct(F.lit("catalog://identity").alias("uri"), F.col("identity").alias("text")), F.struct(F.lit("catalog://summary").alias("uri"), summary.alias("text")))).alias("r")).select("r.*")

    def counts(self) -> DataFrame:
        return self.items.groupBy("type").count().orderBy("type")

    def duplicates(self) -> DataFrame:
        return self.items.groupBy("id").count().filter("count > 1")
