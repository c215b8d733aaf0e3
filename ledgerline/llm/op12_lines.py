"""Lines that stand in many documents, dropped from all of them, in DataFrame functions only.

A line's key is the line without white space at both ends and with A to Z in lower case. Lines are exploded with their
positions and hashed (two 64-bit hashes with different seeds); the distinct documents of each hash are counted; the
occurrences of hashes at the threshold or over it give each document the positions that go; and a text is put together
again from the slices of its lines between those positions.

A text moves once, by its id and its hash; of lines only hashes, ids and positions move. Documents of a hash are told
apart before they are counted, so a line of a third of all documents is one row a task there. The occurrences of lines that
hold a ``HOT``-th of all that go, which are ``HOT`` lines at most, meet their hash over ``SALTS`` tasks.

Results: a null or empty text is one empty line; keys of fewer than ``chars`` code points always stay; lines that occur
twice in a document count once; rows that share a doc_id are one document where lines are counted, as are rows without an
id and with the same text, and each row loses its own lines; a text all of whose lines go is empty; a very long text is an
array of its lines, and a text without line ends one line; columns of the result replace columns of the same name, others
are kept by ``deduplicate``; no rows give none.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, owning, quoted, table, written

#: Documents in which a key must be found to be dropped, and code points that it must have.
LEAST, CHARS = 10, 1
#: Lines are hot if they are at least this part of all that go: so many at most, by which what is broadcast is bounded.
HOT = 4096
SPACE = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    """Only A to Z change; where a line is all ASCII, which is the common case, that is what ``lower`` does."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _occurrences(docs: DataFrame, chars: int) -> DataFrame:
    """_id, _text (hash), _at, _a, _b (hashes of the key): a row for each line that counts."""
    each = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(F.col("text")).alias("_text"), F.posexplode(lines(F.col("text"))).alias("_at", "_line"))
    keyed = each.select("_id", "_text", "_at", key(F.col("_line")).alias("_key")).filter(F.length("_key") >= chars)
    return keyed.select("_id", "_text", "_at", F.xxhash64("_key").alias("_a"), F.xxhash64(F.lit(1), "_key").alias("_b"))


def frequent(docs: DataFrame, least: int = LEAST, chars: int = CHARS) -> DataFrame:
    """_a, _b, n_docs: the hashes of keys that stand in so many documents."""
    document = F.struct("_id", F.when(F.col("_id").isNull(), F.col("_text")))
    return _occurrences(docs, chars).groupBy("_a", "_b").agg(F.count_distinct(document).alias("n_docs")).filter(F.col("n_docs") >= least)


def deduplicate(docs: DataFrame, least: int = LEAST, chars: int = CHARS) -> DataFrame:
    """The columns of docs with the text that is left, and n_lines (before) and n_dropped."""
    going = written(frequent(docs, least, chars), "frequent")
    total = going.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    going = owning(going.select("_a", "_b", (F.col("n_docs") * HOT >= total).alias("_hot")), going)
    salts = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt")
    marked = _occurrences(docs, chars).join(F.broadcast(going.filter("_hot")), ["_a", "_b"], "left")
    salted = marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_id", "_text"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    gone = salted.join(going.select("_a", "_b", salts).hint("shuffle_hash"), ["_a", "_b", "_salt"])
    gone = gone.groupBy("_id", "_text").agg(F.array_sort(F.collect_set("_at")).alias("_gone"))
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    own = docs.select(F.struct(*map(quoted, kept)).alias("_row"), F.col("doc_id").alias("_own_id"), F.xxhash64(F.col("text")).alias("_own_text"))
    # ids are hashed, so that texts are not sorted
    both = own.join(gone.hint("shuffle_hash"), F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_text") == F.col("_text")), "left")
    split = both.select("_row", lines(F.col("_row.text")).alias("_lines"), F.coalesce("_gone", F.array().cast("array<int>")).alias("_gone"))
    bounds = split.withColumn("_bounds", F.concat(F.array(F.lit(-1)), "_gone", F.array(F.size("_lines"))))
    left = F.expr("array_join(flatten(transform(sequence(0, size(_gone)), k -> slice(_lines, _bounds[k] + 2, _bounds[k + 1] - _bounds[k] - 1))), '\\n')")
    result = bounds.select("_row", F.when(F.size("_gone") == 0, F.col("_row.text")).otherwise(left).alias("_left"), F.size("_lines").cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_dropped"))
    return owning(result.select(*[F.col("_left").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in kept], "n_lines", "n_dropped"), going)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
e as (select r, doc_id, case when doc_id is null then t end as own, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as pos from t),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as k from e),
f as (select k from k where length(k) >= {CHARS} group by k having count(distinct row(doc_id, own)) >= {LEAST}),
m as (select k.*, f.k is not null as gone from k left join f on k.k = f.k)
select any_value(doc_id) as doc_id, count(*) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by r
"""
