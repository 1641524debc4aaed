"""URL filters (operator 13): Bloom filter cascades over the corpus's whole universe of keys.

A rule is a host with a path; its key is both joined. A url's keys are its host's suffixes and its path's prefixes of the
shapes (labels, path length) that rules have, so a rule fits a url exactly if its key is one of the url's keys. For
each list (block, allow) level 0 of a cascade encodes the listed keys, level 1 the unlisted keys of the corpus that
pass level 0, level 2 the listed keys that pass level 1, and so on until none passes. Every key of the corpus then has
its exact answer from the levels alone: urls are judged without a join. Building reads all urls once; what level 0
lets through (about as many keys as are listed) is the only part that is shuffled.

A cascade is shipped to the workers. Level 0 lets about one unlisted key through for each listed one, so its size is
bounded by MOST_KEYS listed keys (about 40 MB); a longer list is cut by hash into parts of that size, which are
applied one after the other, the longest rule found so far being kept.

Cases: a null url, and one without "://", has empty host and path and no rule; longest means host plus path, then host;
a key listed in both lists blocks; rules without a host, and with a path that doesn't start with "/", fit nothing; a null
path of a rule is empty; without a rule the verdict is that of a key that isn't listed (`allow`); repeated rows
repeat; an empty table gives no rows; columns other than the id and the url are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.catalog import query
from runloom.llm.common import mix, read, written

#: Listed keys of one cascade.
MOST_KEYS = 4_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Host, path and verdict of the rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

Level = tuple[int, int, np.ndarray]  # bits, probes, the bits in words of 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_keys(shapes: list[tuple[int, int]]) -> Column:
    """Keys of (host, path), the longest first: structs (order: size, then that of the host; key, h1, h2)."""
    def key(labels: int, size: int) -> Column:
        suffix = F.substring_index("host", ".", -labels)
        text = F.concat(suffix, F.substring("path", 1, size))
        made = F.struct(((F.length(suffix) + size) * F.lit(1 << 32) + F.length(suffix)).alias("order"), text.alias("key"), *_hashes(text))
        return F.when((F.col("host") != "") & (F.length("path") >= size), made)
    return F.sort_array(F.array_compact(F.array(*(key(*s) for s in shapes))), False)


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, probes: int) -> Iterator[np.ndarray]:
    a, b = mix(h1.view(np.uint64) + np.uint64(level)), mix(h2.view(np.uint64) + np.uint64(level)) | np.uint64(1)
    for i in range(probes):
        yield (a + np.uint64(i) * b) % np.uint64(bits)


def _passes(h1: np.ndarray, h2: np.ndarray, number: int, level: Level) -> np.ndarray:
    bits, probes, held = level
    hit = np.ones(len(h1), bool)
    for place in _places(h1, h2, number, bits, probes):
        hit &= (held[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return hit


def listed(h1: np.ndarray, h2: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Whether the keys are listed: the first level that a key doesn't pass decides (even ones hold listed keys)."""
    answer, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
    for number, level in enumerate(levels):
        passed = _passes(h1[open_], h2[open_], number, level)
        answer[open_[~passed]] = number % 2 == 1
        open_ = open_[passed]
    answer[open_] = len(levels) % 2 == 1
    return answer


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _level(keys: DataFrame, n: int, number: int, share: float) -> Level:
    """A Bloom filter of n keys (h1, h2) that lets about `share` of all other keys through."""
    probes = min(60, max(1, math.ceil(-math.log2(share))))
    bits = 64 * max(16, math.ceil(n * probes / math.log(2) / 64))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                places = np.unique(np.concatenate(list(_places(_column(batch, "h1"), _column(batch, "h2"), number, bits, probes))))
                at, first = np.unique(places >> np.uint64(6), return_index=True)
                held = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(held.view(np.int64))], ["word", "bits"])

    rows = keys.select("h1", "h2").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    held, got = np.zeros(bits // 64, np.uint64), rows.toArrow()  # at most bits / 64 rows
    held[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return bits, probes, held


def _passing(keys: DataFrame, number: int, level: Level) -> DataFrame:
    held = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_passes(_column(batch, "h1"), _column(batch, "h2"), number, held.value)))
    return keys.mapInArrow(run, keys.schema)


def cascade(universe: DataFrame, size: int, keys: DataFrame, share: float | None = None) -> list[Level]:
    """Levels of the listed `keys` (key, h1, h2) over the universe (key, h1, h2; at most `size` keys, repeats allowed).
    `share` is what level 0 lets through of the rest; by default about as many keys as are listed."""
    n = keys.count()
    if not n:
        return []
    levels = [_level(keys, n, 0, share or min(0.5, n / max(size, 1)))]
    passed = _passing(universe.select("key", "h1", "h2"), 0, levels[0]).distinct()
    sides = [keys, written(passed.join(keys.select("key"), "key", "left_anti"), "url-passed")]  # listed, unlisted
    while n := (turn := sides[len(levels) % 2]).count():
        number = len(levels)
        levels.append(_level(turn, n, number, 0.5))
        sides[1 - number % 2] = written(_passing(sides[1 - number % 2], number, levels[number]), "url-passed")
    return levels


def verdicts(pages: DataFrame, rules: DataFrame, share: float | None = None, most_keys: int = MOST_KEYS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url), (host, path, verdict) -> page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    path = F.coalesce("path", F.lit(""))
    fine = (F.col("host") != "") & ((path == "") | path.startswith("/")) & F.col("verdict").isin("block", "allow")
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("host"), path.alias("path"), "verdict").where(fine)
    listing = clean.select(F.concat("host", "path").alias("key"), "verdict", (F.size(F.split("host", r"\.")).alias("labels")), F.length("path").alias("size")).distinct()
    listing = written(listing.select("*", *_hashes(F.col("key"))), "url-rules")
    shapes = [(r.labels, r.size) for r in listing.select("labels", "size").distinct().collect()]  # bounded by labels of a host, lengths of a path
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not shapes:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    size = pages.count() * len(shapes)
    parts = -(-listing.count() // most_keys)
    out = urls.select("*", F.lit(-1).cast("long").alias("order"), F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    for part in range(parts):
        mine = listing.where(F.pmod("h2", F.lit(parts)) == part)
        universe = urls.select(F.explode(url_keys(shapes)).alias("k")).select("k.*")
        held = spark.sparkContext.broadcast([(v, cascade(universe, size, mine.where(F.col("verdict") == v), share)) for v in ("block", "allow")])
        out = out.withColumn("keys", url_keys(shapes)).mapInArrow(_judge(held), out.schema)
        if part < parts - 1:
            out = written(out, "url-part")
    return out.drop("order")


def _judge(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("keys")
            rows, keys = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
            h1, h2, order = (keys.field(f).to_numpy(zero_copy_only=False) for f in ("h1", "h2", "order"))
            best, rule, verdict = _column(batch, "order").copy(), batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()
            for name, levels in held.value:
                hits = np.flatnonzero(listed(h1, h2, levels))
                hits = hits[np.unique(rows[hits], return_index=True)[1]]  # a row's first key is its longest
                hits = hits[order[hits] > best[rows[hits]]]
                for i, text in zip(rows[hits].tolist(), keys.field("key").take(pa.array(hits)).to_pylist(), strict=True):
                    rule[i], verdict[i] = text, name
                best[rows[hits]] = order[hits]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(best), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             ["page_id", "host", "path", "order", "rule", "verdict"])
    return run


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_LONGEST = sorted(RULES, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), reverse=True)
SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in _LONGEST)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _LONGEST)} ELSE 'allow' END AS verdict
FROM parts
"""


@query("op13_url_filters", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))
