"""Matching of names against lists, by edit distance, without comparing all with all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold
from ..shared import written

#: Latin spellings of Cyrillic and Greek letters (in lower case and without marks), one letter each, and several.
ONE = dict(zip("абвгдезийклмнопрстуфхыэієґαβγδεζηικλμνξοπρσςτυφωø", "abvgdeziiklmnoprstufhyeiegavgdeziiklmnxoprsstyfoo", strict=True))
SEVERAL = {"ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ъ": "", "ь": "", "θ": "th", "χ": "ch", "ψ": "ps", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "đ": "d", "ł": "l", "ı": "i"}


def deletions(text: Column) -> Column:
    """The text and each text that lacks one of its characters."""
    return F.array_distinct(F.concat(F.array(text), F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda k: F.concat(F.substring(text, F.lit(1), k - 1), F.substring(text, k + 1, F.length(text))))))


def screen(names: DataFrame, listed: DataFrame, name: str = "name", alias: str = "alias") -> DataFrame:
    """Names and list entries at an edit distance of one at most, with the distance.

    Two such texts have a deletion in common (or one is a deletion of the other), so an equi-join on deletions misses
    none; what it finds is checked. Rows grow with the length of a name, not with the list.
    """
    a = names.withColumn("_d", F.explode(deletions(F.col(name))))
    b = listed.withColumn("_d", F.explode(deletions(F.col(alias))))
    met = a.join(b, "_d").drop("_d").distinct().withColumn("distance", F.levenshtein(name, alias))
    return met.filter("distance <= 1")


def spelling(name: Column) -> Column:
    """A name as it is compared: folded, in Latin letters, with one space for all that is neither letter nor digit."""
    out = F.translate(fold(name), "".join(ONE), "".join(ONE.values()))
    for letter, several in SEVERAL.items():
        out = F.replace(out, F.lit(letter), F.lit(several))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def near_keys(text: Column) -> Column:
    """Hashes of the text and of all that is left of it without one or two of its characters."""
    twice = F.flatten(F.transform(deletions(text), deletions))
    return F.array_distinct(F.transform(twice, lambda t: F.xxhash64(t)))


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and exchanges of neighbours that make one text the other (unrestricted)."""
    far = len(a) + len(b)
    last: dict[str, int] = {}
    d = {(-1, -1): far} | {(i, -1): far for i in range(len(a) + 1)} | {(-1, j): far for j in range(len(b) + 1)}
    d |= {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            swapped = d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1) if k and m else far
            d[i, j] = min(d[i - 1, j - 1] + (x != y), d[i, j - 1] + 1, d[i - 1, j] + 1, swapped)
            if x == y:
                match = j
        last[x] = i
    return d[len(a), len(b)]


def edits_of_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """``edits`` of each pair, all pairs at once for each pair of places."""
    n, m = max(map(len, a)), max(map(len, b))
    size = [np.fromiter(map(len, side), np.int64, len(side)) for side in (a, b)]
    # letters as numbers of this call; places past a text's end are letters that nothing has
    texts = [np.frombuffer("".join(x.ljust(k, end) for x in side).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(side), k) if k else np.empty((len(side), 0), "<u4") for side, k, end in ((a, n, "\ufffe"), (b, m, "\uffff"))]
    letters, codes = np.unique(np.concatenate([t.ravel() for t in texts]), return_inverse=True)
    x, y = codes[: texts[0].size].reshape(texts[0].shape), codes[texts[0].size :].reshape(texts[1].shape)
    pair, far = np.arange(len(a)), n + m
    last = np.zeros((len(a), len(letters)), np.int16)
    d = np.full((n + 2, m + 2, len(a)), far, np.int16)  # a place further than the texts', as an exchange looks two back
    d[1:, 1] = np.arange(n + 1)[:, None]
    d[1, 1:] = np.arange(m + 1)[:, None]
    for i in range(1, n + 1):
        match = np.zeros(len(a), np.int16)
        for j in range(1, m + 1):
            k, same = last[pair, y[:, j - 1]], x[:, i - 1] == y[:, j - 1]
            least = np.minimum(np.minimum(d[i, j + 1], d[i + 1, j]) + 1, d[i, j] + ~same)
            met = np.flatnonzero((k > 0) & (match > 0))
            least[met] = np.minimum(least[met], d[k[met], match[met], met] + (i - k[met] - 1) + 1 + (j - match[met] - 1))
            d[i + 1, j + 1] = least
            match[same] = j
        last[pair, x[:, i - 1]] = i
    return d[size[0] + 1, size[1] + 1, pair].astype(np.int32)


#: Spellings, and pairs of them, of a task.
NAMES, MET = 2000, 100_000
#: Pairs whose edits are counted at once, and places of their texts against each other.
PAIRS, PLACES = 4096, 1 << 22


@F.pandas_udf(T.IntegerType())
def _edits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        n = max(1, min(PAIRS, PLACES // ((a.str.len().max() + 2) * (b.str.len().max() + 2)))) if len(a) else 1
        a, b = a.tolist(), b.tolist()
        yield pd.Series(np.concatenate([edits_of_pairs(a[k : k + n], b[k : k + n]) for k in range(0, len(a), n)] or [np.empty(0, np.int32)]))


def screen_names(names: DataFrame, listed: DataFrame, key: str = "party_id", name: str = "name", entry: str = "listed", alias: str = "alias", most: int = 2) -> DataFrame:
    """Names and list entries that are at most ``most`` (two at most) edits apart, as written or with their words in order.

    key, entry, form (``written``, or ``words`` where only the words in alphabetical order are near), distance and score
    (one less the distance's part of the longer spelling), by the form with the least distance.

    Spellings are compared once each, however many rows have them. Texts two edits apart, exchanges of neighbours
    included, have a text in common that lacks at most two characters of each, so an equi-join on hashes of such texts
    misses none, for lists of any size; edits are counted of what it finds. A spelling of n characters has n * n / 2 such
    texts: names, not documents. Names without a letter or digit match nothing.
    """

    def forms(frame: DataFrame, text: str) -> DataFrame:
        spelt = frame.select(spelling(F.col(text)).alias("s")).filter("s <> ''").distinct()
        words = F.array_join(F.array_sort(F.split("s", " ")), " ")
        return spelt.select("s", F.explode(F.array(F.struct(F.lit("written").alias("form"), F.col("s").alias("t")), F.struct(F.lit("words").alias("form"), words.alias("t")))).alias("f")).select("s", "f.*")

    a, b = written(forms(names, name), "forms"), written(forms(listed, alias), "forms")
    # rows are short and what is made of them is long or slow, so tasks are told by rows, not by bytes
    dealt = lambda frame, rows: frame.repartition(max(1, -(-frame.count() // rows)))
    keys = lambda frame, t: dealt(frame.select("form", F.col("t").alias(t)).distinct(), NAMES).withColumn("_k", F.explode(near_keys(F.col(t))))
    met = keys(a, "t").join(keys(b, "u"), ["form", "_k"]).filter(F.abs(F.length("t") - F.length("u")) <= most).select("form", "t", "u").distinct()
    near = dealt(written(met, "met"), MET).withColumn("distance", _edits("t", "u")).filter(F.col("distance") <= most)
    pairs = a.join(near, ["form", "t"]).join(b.select(F.col("s").alias("s2"), "form", F.col("t").alias("u")), ["form", "u"])
    longer = F.greatest(F.length("t"), F.length("u"))
    best = pairs.groupBy("s", "s2").agg(F.min(F.struct("distance", F.when(F.col("form") == "written", 0).otherwise(1).alias("o"), "form", (1 - F.col("distance") / longer).alias("score"))).alias("m"))
    whom = names.select(key, spelling(F.col(name)).alias("s")).join(best, "s").join(listed.select(entry, spelling(F.col(alias)).alias("s2")), "s2")
    return whom.select(key, entry, F.col("m.form").alias("form"), F.col("m.distance").alias("distance"), F.col("m.score").alias("score"))
