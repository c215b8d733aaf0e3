"""Language identification by interpolated Kneser-Ney character models.

Training counts the ``ORDER``-grams of characters of all padded words of all training documents, for each language: a
task sums the words of its batches before it expands them, and rows of (language, gram, count) are summed again before
the shuffle. Continuation counts of the lower orders, contexts' sums and discounts are aggregations of those counts.

The model keeps every gram that was counted. Probabilities are joins of the counts, order by order. Grams are kept as
64-bit hashes in shards of the hash space, files of about ``SHARD`` bytes in the shared folder: a sorted array, with a row
of log probabilities, one for each language, found by binary search. Tasks get the names of the shards, look grams up in
one shard after the other and hold ``HELD`` of them. A document's score for a language is its log probability by
character; the language with the least cross-entropy is chosen.

A temperature turns cross-entropies into the score, and a rejection threshold for each language says whether the choice
is accepted; both are calibrated on about ``SAMPLE`` training documents, a tenth of all at most, which ``split`` keeps out
of the counts.

Results: a null text or one without letters (Unicode's category L) is ``und`` with score 0 and not accepted; a very long
text is looked up by its distinct words; ties go to the first language in order; rows that repeat are learned as often;
documents without lang or id are not learned from; without any training document every text is ``und``, and without one
for calibration the temperature is 1 and all is accepted; other columns are left out; no rows give none.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, put, scratch, store, table, written

#: Characters of the longest gram; documents kept for calibration, about, and the largest share of all that they may be.
ORDER, SAMPLE, SHARE = 4, 4000, 0.1
#: Bytes of a shard of the model, and shards that a process holds at once.
SHARD, HELD = 1 << 20, 128
PAD = " "


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Bounds of each text's words, their numbers, and the distinct words: runs of letters in lower case."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    bounds = split.offsets.to_numpy().astype(np.int64)
    chunks = split.values.dictionary_encode()
    codes = chunks.indices.to_numpy(zero_copy_only=False)
    lower = pc.utf8_lower(chunks.dictionary)
    plain = pc.utf8_is_alpha(lower)
    distinct, number, of = [], {}, []
    for word, alpha in zip(lower.to_pylist(), plain.to_pylist(), strict=True):
        own = (word,) if alpha else tuple(LETTERS.findall(word))
        of.append([number.setdefault(w, len(number)) for w in own])
    distinct = list(number)
    sizes = np.array([len(x) for x in of], np.int64)
    flat = np.array([n for x in of for n in x], np.int64)
    starts = np.cumsum(sizes) - sizes
    own = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(own)])
    numbers = flat[np.arange(int(ends[-1])) + np.repeat(starts[codes] - ends[:-1], own)]
    return ends[bounds - bounds[0]], numbers, distinct


LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def _grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``order`` code points, one for each character of the padded words and its history, and the word of each."""
    joined = np.frombuffer("".join([PAD * (order - 1) + w + PAD for w in words]).encode("utf-32-le"), "<u4")
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    ends = np.cumsum(sizes + order - 1)
    at = np.arange(int(sizes.sum())) + np.repeat(ends - sizes - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return np.stack([joined[at - order + 1 + k] for k in range(order)], axis=1), np.repeat(np.arange(len(words)), sizes)


def _hash(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of code points."""
    h = np.full(len(codes), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(codes.shape[1]):
        h = (h ^ codes[:, k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _hash_texts(grams: list[str], order: int) -> np.ndarray:
    return _hash(np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").reshape(-1, order)) if grams else np.empty(0, np.uint64)


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram and n over all rows that have both text and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[str, int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, grams in total.items():
                yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])
            total.clear()

        for b in bounded(batches):
            bounds, numbers, distinct = _words(b.column("text"))
            if not distinct:
                continue
            langs = b.column("lang").dictionary_encode()
            of = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(bounds))
            rows, word = _grams(distinct, order)
            hashes, first, inverse = np.unique(_hash(rows), return_index=True, return_inverse=True)
            texts = [t.tobytes().decode("utf-32-le") for t in np.ascontiguousarray(rows[first]).astype("<u4")]
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                by_word = np.bincount(numbers[of == k], minlength=len(distinct))
                by_gram = np.bincount(inverse, by_word[word].astype(np.float64), len(hashes)).astype(np.int64)
                own = total.setdefault(lang, {})
                for j in np.flatnonzero(by_gram).tolist():
                    own[texts[j]] = own.get(texts[j], 0) + int(by_gram[j])
            if sum(map(len, total.values())) > 500_000:
                yield from out()
        yield from out()

    return docs.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Shards of sorted hashes: log probabilities by gram and language, and by history the log weight that the lower order gets after it."""

    def __init__(self, langs: list[str], order: int) -> None:
        self.langs, self.order = langs, order
        self.shards: dict[tuple[str, int], tuple[int, dict[int, str]]] = {}  # by kind and order: bits of a hash that number its shard, and the files
        self.temperature, self.accept = 1.0, np.full(len(langs), np.inf)

    def _look_up(self, kind: str, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and the rows of those."""
        bits, files = self.shards.get((kind, n), (0, {}))
        shard = _shard_of(keys, bits)
        by = np.argsort(shard, kind="stable")
        found, rows = np.zeros(len(keys), bool), np.zeros((len(keys), len(self.langs)))
        for part in np.split(by, np.flatnonzero(np.diff(shard[by])) + 1):
            if len(part) and (file := files.get(int(shard[part[0]]))):
                hashes, logs = _held(file)
                known, at = _find(hashes, keys[part])
                found[part] = known
                rows[part[known]] = logs[at[known]]
        return found, rows[found]

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Natural logs, by row of code points and language."""
        out, weight, left = np.zeros((len(rows), len(self.langs))), np.zeros((len(rows), len(self.langs))), np.arange(len(rows))
        for n in range(self.order, 0, -1):
            found, logs = self._look_up("gram", n, _hash(rows[left, self.order - n :]))
            hit = left[found]
            out[hit] = weight[hit] + logs
            left = left[~found]
            if not len(left):
                return out
            if n > 1:
                known, logs = self._look_up("context", n, _hash(rows[left, self.order - n : -1]))
                weight[left[known]] += logs
        out[left] = weight[left] + np.log(1 / 2048)  # a character seen nowhere
        return out

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy by text and language, and the characters that count of each text."""
        bounds, numbers, distinct = _words(texts)
        n = len(bounds) - 1
        if not distinct or not self.langs:
            return np.zeros((n, len(self.langs))), np.zeros(n, np.int64)
        by_word, sizes = np.zeros((len(distinct), len(self.langs))), np.array([len(w) + 1 for w in distinct], np.int64)
        for k in range(0, len(distinct), 50_000):
            rows, word = _grams(distinct[k : k + 50_000], self.order)
            logs = self.log_probabilities(rows)
            by_word[k : k + 50_000] = np.add.reduceat(logs, np.flatnonzero(np.diff(word, prepend=-1)), axis=0)
        full = np.flatnonzero(np.diff(bounds))
        total, chars = np.zeros((n, len(self.langs))), np.zeros(n, np.int64)
        if len(full):
            for j in range(len(self.langs)):
                total[full, j] = np.add.reduceat(by_word[numbers, j], bounds[full])
            chars[full] = np.add.reduceat(sizes[numbers], bounds[full])
        return -total / np.maximum(chars, 1)[:, None], chars


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def _shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


@functools.lru_cache(maxsize=HELD)
def _held(file: str) -> tuple[np.ndarray, np.ndarray]:
    files, path = store(file)
    with files.open_input_stream(path) as f, np.load(io.BytesIO(f.read())) as own:
        return own["hashes"], own["logs"]


def _sharded(frame: DataFrame, size: int, width: int, base: str) -> tuple[int, dict[int, str]]:
    """Writes rows of key, a text of ``size`` characters, and values; gives the bits of the shards' numbers and the files."""
    bits = max(0, (frame.count() * 8 * (width + 1) - 1) // SHARD).bit_length()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _hash_texts(b.column("key").to_pylist(), size)
            yield pa.record_batch([pa.array(_shard_of(keys, bits)), pa.array(keys.view(np.int64)), b.column("values")], ["shard", "hash", "values"])

    def put_one(t: pa.Table) -> pa.Table:
        hashes = t.column("hash").to_numpy().view(np.uint64)
        logs = np.log(np.maximum(t.column("values").combine_chunks().flatten().to_numpy(), 1e-12)).reshape(-1, width)
        by, shard, out = np.argsort(hashes), t.column("shard")[0].as_py(), io.BytesIO()
        np.savez(out, hashes=hashes[by], logs=logs[by])
        put(f"{base}-{shard}.npz", out.getvalue())
        return pa.table({"shard": [shard]})

    done = frame.select("key", "values").mapInArrow(hashed, "shard long, hash long, values array<double>").groupBy("shard").applyInArrow(put_one, "shard long")
    return bits, {r.shard: f"{base}-{r.shard}.npz" for r in done.collect()}


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """A model of the rows of doc_id, text and lang."""
    top = written(counts(docs, order), "grams")
    by_order = {order: top}
    for n in range(order - 1, 0, -1):  # a lower order counts the distinct characters before a gram
        by_order[n] = by_order[n + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
    langs = sorted(r.lang for r in top.select("lang").distinct().collect())
    model = Model(langs, order)
    if not langs:
        return model
    base = scratch(docs.sparkSession, "language")
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int")

    def by_language(rows: DataFrame, key: list[str], value: F.Column, name: str, default: float) -> DataFrame:
        """One row of each key with an array of values by language."""
        own = rows.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(number, value.alias("x")))).alias("own"))
        return own.select(*key, F.transform(F.sequence(F.lit(1), F.lit(len(langs))), lambda k: F.coalesce(F.try_element_at("own", k), F.lit(default))).alias(name))

    below = None
    for n in range(1, order + 1):
        c = by_order[n].withColumn("context", F.expr(f"substring(gram, 1, {n - 1})"))
        ones = {(r.lang): (r.one, r.two) for r in c.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect()}
        discount = {lang: min(0.95, max(0.1, a / (a + 2 * b))) if a + b else 0.75 for lang, (a, b) in ones.items()}
        d = F.element_at(F.array(*[F.lit(discount[x]) for x in langs]), number)
        sums = c.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        # the weight of the lower order after a context; 1 where the context was never seen
        weights = written(by_language(sums, ["context"], d * F.col("types") / F.col("total"), "values", 1.0), "weights")
        own = by_language(c.join(sums, ["lang", "context"]), ["gram", "context"], F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total"), "own", 0.0)
        own = own.join(weights.withColumnRenamed("values", "weight"), "context")
        if below is None:
            own = own.withColumn("below", F.array_repeat(F.lit(1 / 2048), len(langs)))
        else:  # what was counted in an order was counted in the one below
            own = own.join(below.select(F.col("gram").alias("rest"), F.col("values").alias("below")), F.expr("substring(gram, 2)") == F.col("rest"))
        both = F.zip_with("weight", "below", lambda w, p: w * p)
        below = written(own.select("gram", F.zip_with("own", both, lambda p, q: p + q).alias("values")), "probabilities")
        model.shards["gram", n] = _sharded(below.withColumnRenamed("gram", "key"), n, len(langs), f"{base}/gram-{n}")
        if n > 1:
            model.shards["context", n] = _sharded(weights.withColumnRenamed("context", "key"), n - 1, len(langs), f"{base}/context-{n}")
    return model


def split(docs: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """The rows to count and those to calibrate with, by a hash of id and text: about ``sample`` rows, a tenth at most."""
    part = min(SHARE, sample / max(1, docs.count()))
    own = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(1_000_000 * part)
    rows = docs.select("doc_id", "text", "lang")
    return rows.filter(~own), rows.filter(own)


def calibrate(model: Model, docs: DataFrame) -> Model:
    """Sets the temperature under which the right languages of the rows, a bounded sample, are likeliest, and the thresholds."""
    part = docs.filter("text is not null and lang is not null").filter(F.col("lang").isin(model.langs)).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            h, chars = model.entropies(b.column("text"))
            yield pa.record_batch([b.column("lang").cast(pa.string()), pa.array(chars), pa.array(h.tolist(), pa.list_(pa.float64()))], ["lang", "chars", "h"])

    rows = [r for r in part.mapInArrow(run, "lang string, chars long, h array<double>").collect() if r.chars > 0]
    if not rows:
        return model
    h = np.array([r.h for r in rows])
    right = np.array([model.langs.index(r.lang) for r in rows])
    logp = lambda t: np.mean((-(h - h.min(axis=1, keepdims=True)) * t)[np.arange(len(h)), right] - np.log(np.exp(-(h - h.min(axis=1, keepdims=True)) * t).sum(axis=1)))
    model.temperature = max((1.0, 2.0, 4.0, 8.0, 16.0, 32.0), key=logp)
    for k in range(len(model.langs)):
        own = h[right == k, k]
        if len(own):
            model.accept[k] = own.mean() + 6 * max(own.std(), 0.05)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy and accepted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names of shards
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in bounded(batches):
            h, chars = m.entropies(b.column("text"))
            best = h.argmin(axis=1) if m.langs else np.zeros(len(h), np.int64)
            known = chars > 0
            least = np.where(known, h.min(axis=1) if m.langs else 0.0, 0.0)
            score = np.where(known, 1 / np.exp(-(h - least[:, None]) * m.temperature).sum(axis=1), 0.0) if m.langs else np.zeros(len(h))
            pred = [m.langs[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
            accepted = known & (least <= (m.accept[best] if m.langs else 0))
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(pred), pa.array(score), pa.array(least), pa.array(accepted)], ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, cross_entropy double, accepted boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = docs.filter(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    fit, tune = split(own)
    return predict(docs, calibrate(train(fit), tune))
