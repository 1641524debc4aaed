"""Phrase collocation mining (operator 11): Toivonen's method over contiguous phrases of 1 to 4 words.

An eighth of the documents, drawn by hash, proposes: phrases seen LEAST_IN_SAMPLE times there enter a filter. The full pass
counts a phrase if both phrases one word shorter inside it are in the filter (single words always): those are the
proposed phrases and their negative border. Counted phrases that are frequent but not in the filter are border failures.
They trigger an expansion pass, which counts every uncounted phrase whose parts are, as far as they have been counted,
frequent; a part that hasn't been counted is judged by its own parts. That closes the search: all parts of a frequent
phrase are frequent, so it is counted in the first pass or in this one.

These passes count by 64-bit hash of language and phrase, so a count is exact or, where hashes collide, too high: no
frequent phrase is missed. A last pass counts the phrases of frequent hashes by their text, which makes counts exact. All
filters have a fixed size (FILTER_BITS). They only ever add phrases to be counted, so neither their size (once they fill
up, less is pruned) nor the sample changes the result.

Scores, containment and ranks are joins and aggregates over the frequent phrases.

Cases: null and empty texts have no words; a null lang is `und`, as one language with a lang of that name; texts of any
length are taken whole; repeated rows count repeatedly; a score's cut with the lowest value counts, ties to the fewest first
words; an empty table gives no rows; columns other than id, text and lang are not read (ids only draw the sample).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.llm.catalog import query
from runloom.llm.common import _powers, flat, mix, read, settle, steps, word_spans, written

LEAST, LONGEST, TOP, COVERED = 30, 4, 2_000, 80
SAMPLED, LEAST_IN_SAMPLE = 8, 2
FILTER_BITS = 1 << 27
UNKNOWN = "und"

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 10
_BYTES[[32, 9]] = 32


class Phrases:
    """The phrases of a batch: bytes of its words joined by single spaces, and for n = 1 to 4 the places of the n-word
    phrases (by first word) with their hashes."""

    def __init__(self, batch: pa.RecordBatch):
        raw, offsets = flat(batch.column("text"))
        raw = _BYTES[raw]
        starts, ends, rows = word_spans(raw, offsets)
        breaks = np.cumsum(raw == 10, dtype=np.int32)
        linked = (rows[1:] == rows[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1] - 1])
        inside = (raw != 32) & (raw != 10)
        inside[ends[ends < len(raw)]] = True  # one separator after each word
        place = np.cumsum(inside, dtype=np.int64) - inside
        self.raw = np.where((raw == 10) | (raw == 32), np.uint8(32), raw)[inside]
        self.starts, self.ends = place[starts] if len(starts) else starts, place[ends - 1] + 1 if len(ends) else ends
        langs = batch.column("lang").dictionary_encode()
        self.langs = [UNKNOWN if v is None else v for v in langs.dictionary.to_pylist()] + [UNKNOWN]
        codes = langs.indices.fill_null(len(self.langs) - 1).to_numpy()
        self.lang = codes[rows] if len(rows) else np.zeros(0, np.int64)
        salt = np.array([int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big") for v in self.langs], np.uint64)
        up, down = _powers(len(self.raw) + 1)
        total = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * up[:len(self.raw)], dtype=np.uint64, out=total[1:])
        self.at, self.hashes = [], []
        at = np.arange(len(self.starts))
        for n in range(1, LONGEST + 1):
            if n > 1:
                at = at[:np.searchsorted(at, len(self.starts) - n + 1)]
                at = at[linked[at + n - 2]]
            a, b = self.starts[at], self.ends[at + n - 1]
            self.at.append(at)
            self.hashes.append(mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) ^ salt[self.lang[at]]))

    def both(self, n: int, flags: np.ndarray) -> np.ndarray:
        """Of the n-word phrases those whose two phrases of n - 1 words have their flag."""
        all_ = np.zeros(len(self.starts) + 1, bool)
        all_[self.at[n - 2]] = flags
        return all_[self.at[n - 1]] & all_[self.at[n - 1] + 1]

    def proposed(self, held: np.ndarray) -> list[np.ndarray]:
        """For every number of words: the phrases that the full pass counts under the filter."""
        return [np.ones(len(self.at[0]), bool), *(self.both(n, in_filter(self.hashes[n - 2], held)) for n in range(2, LONGEST + 1))]

    def expanded(self, held: np.ndarray, frequent: np.ndarray) -> list[np.ndarray]:
        """The phrases that the expansion pass counts, given the filters of the full pass and of its frequent phrases."""
        counted, out, fine = self.proposed(held), [], np.ones(0, bool)
        for n in range(1, LONGEST + 1):
            parts = self.both(n, fine) if n > 1 else np.ones(len(self.at[0]), bool)
            out.append(parts & ~counted[n - 1])
            fine = np.where(counted[n - 1], in_filter(self.hashes[n - 1], frequent), parts)
        return out

    def texts(self, n: int, at: np.ndarray) -> pa.Array:
        a, b = self.starts[at], self.ends[at + n - 1]
        offsets = np.concatenate([[0], np.cumsum(b - a)])
        take = np.repeat(a - offsets[:-1], b - a) + np.arange(offsets[-1])
        data = pa.py_buffer(self.raw[take].tobytes())
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64).tobytes()), data).cast(pa.string())


def _bits(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)


def in_filter(hashes: np.ndarray, held: np.ndarray) -> np.ndarray:
    """held: a Bloom filter of two probes in bytes, its length a power of two."""
    hit = np.ones(len(hashes), bool)
    for place in _bits(hashes, len(held) * 8):
        hit &= (held[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit


def _filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The filter of the hashes `h`. At most bits / 64 rows, whatever the number of hashes, come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            if len(h):
                places = np.unique(np.concatenate(_bits(h, bits)))
                at, first = np.unique(places >> np.uint64(6), return_index=True)
                held = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(held.view(np.int64))], ["word", "bits"])
    got = hashes.select("h").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return words.view(np.uint8)


def _hashed(chosen):
    """Counts by hash of the phrases that chosen(phrases) flags."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            phrases = Phrases(batch)
            h, n = np.unique(np.concatenate([h[f] for h, f in zip(phrases.hashes, chosen(phrases), strict=False)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])
        settle()
    return run


def _texts(frequent):
    """Counts by language and text of the phrases in the filter, and all words of each language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            phrases = Phrases(batch)
            langs = pa.array(phrases.langs, pa.string())
            n = np.bincount(phrases.lang, minlength=len(langs))
            yield _rows(langs, 0, pa.array([""] * len(langs), pa.string()), n)
            for size, (at, h) in enumerate(zip(phrases.at, phrases.hashes, strict=True), 1):
                known = in_filter(h, frequent.value)
                at = at[known]
                _, first, n = np.unique(h[known], return_index=True, return_counts=True)
                yield _rows(langs.take(pa.array(phrases.lang[at[first]])), size, phrases.texts(size, at[first]), n)
        settle()
    return run


def _rows(langs: pa.Array, size: int, texts: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(texts), size, np.int32)), texts, pa.array(n.astype(np.int64))], ["lang", "size", "phrase", "f"])


def frequent_phrases(docs: DataFrame, least: int = LEAST, sampled: int = SAMPLED, least_in_sample: int = LEAST_IN_SAMPLE, bits: int = FILTER_BITS,
                     id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, text, lang) -> lang, size, phrase, f of all phrases of 1 to 4 words with f >= least, and a row of size 0 for each
    language with all its words counted."""
    ship = docs.sparkSession.sparkContext.broadcast
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"))
    drawn = texts.where(F.pmod(F.xxhash64("id"), F.lit(sampled)) == 0).select("text", "lang")
    texts = texts.select("text", "lang")

    def counted(rows: DataFrame, chosen, least: int) -> DataFrame:
        return rows.mapInArrow(_hashed(chosen), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")

    every = counted(drawn, lambda p: [np.ones(len(h), bool) for h in p.hashes[:-1]], least_in_sample)
    held = ship(_filter(every, bits))
    known = written(counted(texts, lambda p: p.proposed(held.value), least), "phrase-hashes")
    frequent = _filter(known, bits)
    if not known.mapInArrow(_missing(held), "h long").isEmpty():
        first = ship(frequent)
        frequent = frequent | _filter(counted(texts, lambda p: p.expanded(held.value, first.value), least), bits)
    rows = texts.mapInArrow(_texts(ship(frequent)), "lang string, size int, phrase string, f long").groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return written(rows.where((F.col("f") >= least) | ((F.col("size") == 0) & (F.col("f") > 0))), "phrases")


def _missing(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~in_filter(batch.column("h").to_numpy().view(np.uint64), held.value)))
    return run


def collocations(frequent: DataFrame, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """Frequent phrases -> the first `top` of each language: lang, rank, phrase, a, l, r, n, score."""
    frequent = frequent.select("lang", "size", "phrase", "f")
    total = frequent.where("size = 0").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ")
    longer = frequent.where("size > 2").withColumn("w", words)
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: F.array_join(F.slice("w", at, n), " "))))
    around = longer.select("lang", F.explode(parts).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = frequent.where("size > 1").join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.lit(100) * F.col("around").cast("decimal(20,0)") < F.lit(covered) * F.col("f").cast("decimal(20,0)")))
    cut = kept.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).withColumn("w", words)
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size")), " ").alias("rest"))
    known = frequent.where("size between 1 and 3")
    cut = cut.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(2000000BD * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    ranked = scored.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn(
        "rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, m AS size, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 30),
around AS (
  SELECT lang, phrase, max(f) AS around FROM (
    SELECT lang, f, unnest(list_transform(range(1, size - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM f, (SELECT unnest([2, 3]) AS m) WHERE size > m) GROUP BY lang, phrase),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
  FROM f LEFT JOIN around USING (lang, phrase), (SELECT unnest([1, 2, 3]) AS k) WHERE k < size AND (around IS NULL OR 100 * around < 80 * f)),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, ((2000000 * c.a::HUGEINT) // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON c.lang = x.lang AND c.first = x.phrase JOIN f y ON c.lang = y.lang AND c.rest = y.phrase
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (2000000 * c.a::HUGEINT) // (x.f + y.f), c.k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored JOIN total USING (lang) QUALIFY rank <= 2000
"""


@query("op11_collocations", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(frequent_phrases(read(spark, sf_dir, "documents")))
