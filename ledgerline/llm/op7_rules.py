"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once and stores, per document, the measurements and one bit for each rule that fails.
``apply`` judges a ledger by a versioned policy, which is a mask of bits. ``ablation`` tells for each rule of a policy
how many documents fail it, how many fail nothing else, and how many would be rejected without it, by bitwise
aggregation over the ledger alone.

A row is measured by itself: no shuffle, and an array of a text's words is the most that is held. Results: a null text
has no words and fails ``few_words``; a text without white space is one word; a very long text is one array of its words
and one of 64-bit hashes of its windows, by which windows are compared (two of a text of a million words collide with a
chance of about 3e-8); repeated rows and ties are judged each; columns that the ledger makes replace columns of the same
name, others are kept by ``ledger(..., keep=[...])``; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Rules by bit: name and the condition under which a document fails, over the measurements below.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "20 * n_symbols > word_chars"),
    ("upper_case", "10 * n_upper > 3 * word_chars"),
    ("few_distinct_words", "n_words >= 50 and 100 * n_distinct_words < 15 * n_words"),
    ("duplicate_lines", "n_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "n_words >= 10 and word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
]
#: Policies by version: the rules that reject. Version 0 is the base.
POLICIES: dict[int, list[str]] = {0: ["few_words", "repeated_windows"], 1: [name for name, _ in RULES]}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_distinct_words", "n_lines"]


def mask(policy: int) -> int:
    return sum(1 << k for k, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def _repeat_words(sorted_windows: str, starts: str) -> Column:
    return F.expr(f"aggregate({starts}, named_struct('last', -5, 'n', 0), (a, x) -> named_struct('last', x, 'n', a.n + least(5, x - a.last)), a -> cast(a.n as bigint))")


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The measurements of each text. Steps are separate projections, as lambdas would evaluate shared arrays again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    taken = {*MEASURES, "fail_bits"}
    d = docs.select(*[c for c in keep if c not in taken], text.alias("_t"))
    d = d.withColumn("_w", F.array_remove(F.split("_t", SPACE + "+"), "")).withColumn("_l", F.expr("filter(split(_t, '\\n'), x -> trim(BOTH ' \\t\\n\\u000b\\f\\r' FROM x) <> '')"))
    d = d.withColumn("_h", F.expr("if(size(_w) < 5, cast(array() as array<bigint>), transform(sequence(0, size(_w) - 5), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2], _w[i + 3], _w[i + 4])))"))
    # texts in which no window repeats, which are most, stop here
    d = d.withColumn("_s", F.expr("if(size(array_distinct(_h)) = size(_h), null, array_sort(arrays_zip(_h, sequence(0, size(_h) - 1))))"))
    d = d.withColumn("_p", F.expr("array_sort(transform(filter(_s, (x, i) -> x._h = get(_s, i - 1)._h or x._h = get(_s, i + 1)._h), x -> x['1']))"))
    count = lambda of: F.length("_t") - F.length(F.regexp_replace("_t", of, ""))
    return d.select(
        *[c for c in keep if c not in taken],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_repeat_words("_s", "_p"), F.lit(0)).cast("long").alias("n_repeat_words"),
        count("[A-Z]").cast("long").alias("n_upper"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )


def ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Measurements and ``fail_bits`` of each document."""
    d = measured(docs, ["doc_id"] if keep is None else keep)
    bits = " + ".join(f"if({fails}, {1 << k}L, 0L)" for k, (_, fails) in enumerate(RULES))
    # an expression that is not deterministic keeps filters above this projection: below it they would evaluate all again
    return d.withColumn("fail_bits", F.expr(bits) + F.monotonically_increasing_id().bitwiseAND(F.lit(0)))


def apply(ledger: DataFrame, policy: int = 1) -> DataFrame:
    """Adds base_failed, kept and the policy's version."""
    bits = F.col("fail_bits")
    return ledger.withColumns({"base_failed": bits.bitwiseAND(F.lit(mask(0))) != 0, "kept": bits.bitwiseAND(F.lit(mask(0) | mask(policy))) == 0, "policy": F.lit(policy)})


def ablation(ledger: DataFrame, policy: int = 1) -> DataFrame:
    """rule, failed, failed_alone, rejected, rejected_without: a row for each rule of the policy."""
    m = mask(policy)
    by_bits = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("b")).agg(F.count("*").alias("n"))  # at most one row a pattern
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (name, _) in enumerate(RULES) if m >> k & 1])).alias("r")
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    b, bit = F.col("b"), F.col("r.bit")
    return by_bits.select("b", "n", rules).groupBy("r.rule").agg(n(b.bitwiseAND(bit) != 0).alias("failed"), n(b == bit).alias("failed_alone"), n(b != 0).alias("rejected"), n((b != 0) & (b != bit)).alias("rejected_without"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(ledger(table(spark, sf_dir, "documents"))).drop("policy")


SQL = rf"""
with t as (select doc_id, coalesce(text, '') as t, row_number() over () as row_no from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
g as (select row_no, i, count(*) over (partition by row_no, g) > 1 as twice from
      (select row_no, unnest(range(1, len(w) - 3)) as i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) as g from w where len(w) >= 5)),
r as (select row_no, sum(least(5, i - last)) as n from (select row_no, i, coalesce(lag(i) over (partition by row_no order by i), -5) as last from g where twice) group by row_no),
m as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
             cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words,
             cast(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as bigint) as n_upper,
             cast(len(list_distinct(w)) as bigint) as n_distinct_words, cast(len(l) as bigint) as n_lines
      from w left join r using (row_no)),
f as (select *, cast({" + ".join(f"case when {fails} then {1 << k} else 0 end" for k, (_, fails) in enumerate(RULES))} as bigint) as fail_bits from m)
select *, (fail_bits & {mask(0)}) <> 0 as base_failed, (fail_bits & {mask(0) | mask(1)}) = 0 as kept from f
"""
