"""Byte-level BPE on Spark.

- Pretokenisation (T1) is a native ``regexp_extract_all`` with the split pattern; ``(?U)`` makes
  Java's ``\\s`` and friends Unicode-aware like the Rust regex engine.
- Training (T2) is a driver loop of small Spark jobs over the table of *distinct* pretokens with
  their counts: the adjacent pairs (A10) are counted once, then each job returns what the next merges
  change in them. Tie-break: highest count, then the smallest (left, right) ids.
- Encoding (T5) pretokenises natively and maps each document's words to ids with an Arrow-batched
  helper that caches encoded words per worker (the merges table is at most the vocabulary size);
  a narrow plan without any shuffle.
- Decoding (T8) joins ids to the broadcast vocabulary and concatenates bytes in position order.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from runloom.schemas import SPECIAL_TOKENS, SPLIT_PATTERN, VOCAB_SCHEMA, VOCAB_SIZE

INT_ARRAY = ArrayType(IntegerType())


# ---- T1 / A9 ------------------------------------------------------------------------------------
def pretokenize(docs: DataFrame, text_col: str = "text", pattern: str = SPLIT_PATTERN,
                keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per pretoken: (keep..., pos, word). Native regex, no Python."""
    pieces = F.regexp_extract_all(F.col(text_col), F.lit("(?U)" + pattern), F.lit(0))
    return docs.select(*keep, F.posexplode(pieces).alias("pos", "word"))


def word_counts(docs: DataFrame, text_col: str = "text", pattern: str = SPLIT_PATTERN) -> DataFrame:
    """Pretoken frequencies (partial aggregation before the shuffle)."""
    return pretokenize(docs, text_col, pattern, keep=()).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def utf8_bytes(word: Column) -> Column:
    """The UTF-8 bytes of a string as an array of ints 0..255. The hex text is split once and the
    lambda only sees its own element (an input expression referenced inside a lambda would be
    re-evaluated for every element)."""
    pairs = F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def adjacent_pairs(syms: Column) -> Column:
    """Adjacent (a, b) pairs as two shifted slices zipped together (no per-element lookups)."""
    n = F.greatest(F.size(syms) - 1, F.lit(0))
    return F.arrays_zip(F.slice(syms, 1, n).alias("a"), F.slice(syms, 2, n).alias("b"))


def pair_counts(words: DataFrame, syms: str = "syms", weight: str = "cnt") -> DataFrame:
    """A10: adjacent symbol pairs weighted by word count. No filter on the symbols here: Catalyst
    would push it below the word-count aggregate and evaluate the byte arrays per occurrence."""
    w = words
    return (w.select(F.explode(adjacent_pairs(F.col(syms))).alias("p"), F.col(weight))
            .groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum(weight).alias("n")))


# ---- T2 / T3 -------------------------------------------------------------------------------------
#: Merges guessed ahead in one job, and accepted merges after which the word table is rewritten. Neither changes a result.
AHEAD, REWRITE_EVERY = 32, 64
#: Most frequent words that the driver holds to guess merges by; what is accepted rests on exact counts over all words.
GUESS_WORDS = 20_000
_DELTAS = "step INT, pair LONG, n LONG"


def _tally(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of ``n`` per pair, in ascending order of the pairs; zero sums go."""
    if not len(pairs):
        return pairs, n
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    pairs, n = pairs[first], np.add.reduceat(n, first)
    return pairs[n != 0], n[n != 0]


def _add(counts, pairs, n):
    return _tally(np.concatenate([counts[0], pairs]), np.concatenate([counts[1], n]))


def _joined(syms: pa.Array, cnt: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of a batch as one array of symbols, a -1 after each word, and the word's count at every place."""
    sizes = np.diff(syms.offsets.to_numpy())
    ends = np.cumsum(sizes + 1) - 1
    flat = np.full(int(sizes.sum()) + len(sizes), -1, dtype=np.int64)
    inside = np.ones(len(flat), dtype=bool)
    inside[ends] = False
    flat[inside] = syms.flatten().to_numpy()
    return flat, np.repeat(cnt.to_numpy().astype(np.int64), sizes + 1)


def _pairs_at(flat, weight, places, sign):
    places = np.unique(places)
    places = places[(places >= 0) & (places < len(flat) - 1)]
    l, r = flat[places], flat[places + 1]
    both = (l >= 0) & (r >= 0)
    return (l[both] << 32) | r[both], sign * weight[places[both]]


def _merge(flat, weight, left: int, right: int, new: int):
    """Replace (left, right) by ``new``, left to right without overlap: the arrays after it, and what it changed in
    the pair counts. Only pairs that touch a replaced symbol are looked at."""
    at = np.flatnonzero((flat[:-1] == left) & (flat[1:] == right))
    if left == right and len(at):  # of a run of matches, every second one from its start
        place = np.arange(len(at))
        start = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], place, 0))
        at = at[(place - start) % 2 == 0]
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return flat, weight, none, none
    lost = _pairs_at(flat, weight, np.concatenate([at - 1, at, at + 1]), -1)
    flat = flat.copy()
    flat[at] = new
    flat, weight = np.delete(flat, at + 1), np.delete(weight, at + 1)
    now = at - np.arange(len(at))
    won = _pairs_at(flat, weight, np.concatenate([now - 1, now]), 1)
    return flat, weight, *_tally(np.concatenate([lost[0], won[0]]), np.concatenate([lost[1], won[1]]))


def _change_job(words: DataFrame, done: list, ahead: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """What each merge of ``ahead`` changes in the pair counts of all words, after ``done`` and those before it. Comes
    to the driver summed: a merge changes at most four times the vocabulary size of pairs."""
    def changes(batches):
        for batch in batches:
            flat, weight = _joined(batch.column("syms"), batch.column("cnt"))
            for a, b, new in done:
                flat, weight, _, _ = _merge(flat, weight, a, b, new)
            for i, (a, b, new) in enumerate(ahead):
                flat, weight, pairs, n = _merge(flat, weight, a, b, new)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), i, dtype=np.int32)), pa.array(pairs), pa.array(n)],
                                                     names=["step", "pair", "n"])

    got = words.mapInArrow(changes, _DELTAS).groupBy("step", "pair").agg(F.sum("n").alias("n")).toArrow()
    step, pair, n = (got.column(c).to_numpy() for c in ("step", "pair", "n"))
    return [(pair[step == i], n[step == i]) for i in range(len(ahead))]


def _rewritten(words: DataFrame, done: list) -> DataFrame:
    """The word table with the merges of ``done`` in it; words of a single symbol go."""
    def rewrite(batches):
        for batch in batches:
            flat, weight = _joined(batch.column("syms"), batch.column("cnt"))
            for a, b, new in done:
                flat, weight, _, _ = _merge(flat, weight, a, b, new)
            ends = np.flatnonzero(flat < 0)
            offsets = np.r_[0, ends - np.arange(len(ends))]
            syms = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat[flat >= 0].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([syms, pa.array(weight[ends])], names=["syms", "cnt"])

    return words.mapInArrow(rewrite, "syms ARRAY<INT>, cnt LONG").where(F.size("syms") >= 2).checkpoint(eager=True)


def _best(counts) -> tuple[int, int, int] | None:
    """The pair with the highest count; on ties the smallest (left, right), as the pairs ascend."""
    if not len(counts[0]):
        return None
    i = int(np.argmax(counts[1]))
    pair = int(counts[0][i])
    return pair >> 32, pair & 0xFFFFFFFF, int(counts[1][i])


def _guess(counts, sample, first: int, n: int) -> list[tuple[int, int, int]]:
    """The next ``n`` merges as the sample's words would have them, the first of them exact. Each guessed merge changes
    the counts as it does in the sample, scaled to the pair's count."""
    flat, weight = sample
    out = []
    for new in range(first, first + n):
        top = _best(counts)
        if top is None or top[2] <= 0:
            break
        a, b, count = top
        out.append((a, b, new))
        flat, weight, pairs, change = _merge(flat, weight, a, b, new)
        pair = (a << 32) | b
        seen = -int(change[pairs == pair].sum())
        scaled = np.round(change * (count / seen)).astype(np.int64) if seen > 0 else change
        counts = _add(counts, np.r_[pairs, pair], np.r_[scaled, -count + (count if seen > 0 else 0)])
        counts = tuple(c[counts[0] != pair] for c in counts)
    return out


def train_merges(texts: DataFrame, n_merges: int, text_col: str = "text", pattern: str = SPLIT_PATTERN,
                 log=None) -> list[tuple[int, int, int, int]]:
    """Returns [(token_id, left, right, count)] for up to ``n_merges`` merges over all words of ``texts``.

    The pair counts are taken once and then only changed: a job over the word table returns what the next merges change
    (a few rows a merge), and the driver holds at most vocabulary size squared pairs. One job tries several merges ahead,
    guessed from the most frequent words; a guess counts only if the exact counts make it the best pair, so the result
    is that of one merge at a time. The word table is rewritten and checkpointed every REWRITE_EVERY merges."""
    # octet_length(word) >= 2 is the cheap form of "at least two symbols"
    words = (word_counts(texts, text_col, pattern).where(F.octet_length("word") >= 2)
             .select(utf8_bytes(F.col("word")).alias("syms"), "cnt"))
    # the distinct-word table is small, so AQE would coalesce it into very few partitions; every
    # job scans it, so spread it once over the cluster's task slots
    words = words.repartition(max(1, texts.sparkSession.sparkContext.defaultParallelism)).checkpoint(eager=True)
    start = pair_counts(words).select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "n").toArrow()
    counts = _tally(start.column("pair").to_numpy(), start.column("n").to_numpy())
    top = words.orderBy(F.desc("cnt"), "syms").limit(GUESS_WORDS).toArrow().combine_chunks()
    sample = (np.zeros(0, dtype=np.int64),) * 2
    if top.num_rows:
        sample = _joined(*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in top.columns))
    merges: list[tuple[int, int, int, int]] = []
    done: list[tuple[int, int, int]] = []
    while len(merges) < n_merges and _best(counts) is not None:
        ahead = _guess(counts, sample, 256 + len(merges), min(AHEAD, n_merges - len(merges)))
        for (a, b, new), change in zip(ahead, _change_job(words, done, ahead)):
            best = _best(counts)
            if best is None or best[:2] != (a, b):
                break
            merges.append((new, *best))
            done.append((a, b, new))
            counts = _add(counts, *change)
            sample = _merge(*sample, a, b, new)[:2]
            if log:
                log(f"merge {len(merges) - 1}: ({a}, {b}) -> {new} x{best[2]}")
        if len(done) >= REWRITE_EVERY and len(merges) < n_merges:
            words, done = _rewritten(words, done), []
    return merges


def vocab_rows(merges: list[tuple[int, int, int, int]], specials: tuple[str, ...] = SPECIAL_TOKENS) -> list[tuple]:
    """The vocabulary rows: 256 bytes, merges in rank order, then the special tokens."""
    table: dict[int, bytes] = {i: bytes([i]) for i in range(256)}
    rows = [(i, table[i], None, None, False) for i in range(256)]
    for tid, a, b, _ in merges:
        table[tid] = table[a] + table[b]
        rows.append((tid, table[tid], a, b, False))
    base = 256 + len(merges)
    for i, s in enumerate(specials):
        rows.append((base + i, s.encode("utf-8"), None, None, True))
    return rows


def build_vocab(spark: SparkSession, merges: list[tuple[int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame(vocab_rows(merges), VOCAB_SCHEMA)


def merges_for_vocab(vocab_size: int = VOCAB_SIZE, n_specials: int = len(SPECIAL_TOKENS)) -> int:
    return vocab_size - n_specials - 256


def token_bytes(vocab: DataFrame, mode: str = "reference") -> DataFrame:
    """T4 + U1: bytes per token. ``reference``: UTF-8 length of the *decoded* token (a lone invalid
    byte becomes U+FFFD and counts 3); ``raw``: the token's own byte length. Specials count 0."""
    if mode == "reference":
        n = F.octet_length(F.make_valid_utf8(F.col("bytes").cast("string")))
    elif mode == "raw":
        n = F.octet_length("bytes")
    else:
        raise ValueError(mode)
    return vocab.select("token_id", F.when(F.col("is_special"), F.lit(0)).otherwise(n).cast("int").alias("n_bytes"))


# ---- T5 / T7 -------------------------------------------------------------------------------------
def _ranks(rows: list[tuple]) -> dict[bytes, int]:
    ranks: dict[bytes, int] = {}
    for tid, bts, _, _, special in rows:
        if not special and bts not in ranks:
            ranks[bts] = tid
    return ranks


def encode_word(word: str, ranks: dict[bytes, int]) -> list[int]:
    """Encode one pretoken: merge the adjacent pair whose concatenation has the lowest rank (the leftmost on ties) until
    none is in the vocabulary. A heap holds the pairs as (rank, start, middle, end) byte places; an entry whose pieces
    have grown since is passed over, so a word of n bytes takes n log n steps."""
    data = word.encode("utf-8")
    size = len(data)
    end, before = list(range(1, size + 1)), list(range(-1, size - 1))  # by the start of a piece; end 0: merged away
    heap: list[tuple[int, int, int, int]] = []

    def offer(start: int) -> None:
        mid = end[start]
        if mid < size:
            rank = ranks.get(data[start:end[mid]])
            if rank is not None:
                heapq.heappush(heap, (rank, start, mid, end[mid]))

    for i in range(size - 1):
        offer(i)
    while heap:
        _, start, mid, stop = heapq.heappop(heap)
        if end[start] != mid or end[mid] != stop:
            continue
        end[start], end[mid] = stop, 0
        if stop < size:
            before[stop] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    return [ranks[data[i:e]] for i, e in enumerate(end) if e]


_WORKER_CACHE: dict[str, dict[str, bytes]] = {}
#: Words that a worker remembers; a full memory starts anew. Changes no result.
_CACHE_LIMIT = 1 << 18
#: Elements (bytes of text, words, tokens) that one step of a Python worker takes from an Arrow batch.
STEP_ITEMS = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_ITEMS) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose strings or lists in ``column`` hold about ``most`` bytes or elements, at least one row each:
    what a worker makes of a step is bounded by it (or one long row), whatever the batch holds."""
    for batch in batches:
        sizes = batch.column(column)
        sizes = pc.binary_length(sizes) if pa.types.is_string(sizes.type) or pa.types.is_large_string(sizes.type) else pc.list_value_length(sizes)
        ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def is_byte_level(rows: list[tuple]) -> bool:
    """No merges: every token is one byte, so the ids of a text are its UTF-8 bytes."""
    return all(l is None for _, _, l, _, s in rows if not s)


def _byte_ids(texts: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t, dtype=np.uint8) for t in pc.fill_null(texts, "").cast(pa.binary()).to_pylist()]


def _word_ids(rows: list[tuple]):
    """array<word> -> ids for a fixed vocabulary. The ranks (at most vocabulary-size entries) travel with the function; every
    Python worker remembers words it has already encoded, so frequent words are encoded once per worker, not per use."""
    ranks = _ranks(rows)
    key = vocab_key(*sorted(ranks.items()))

    def ids(docs: pa.Array) -> list[np.ndarray]:
        cache = _WORKER_CACHE.setdefault(key, {})
        out = []
        for words in docs.to_pylist():
            parts = []
            for w in words or ():
                t = cache.get(w)
                if t is None:
                    t = np.asarray(encode_word(w, ranks), dtype=np.int32).tobytes()
                    if len(cache) >= _CACHE_LIMIT:
                        cache.clear()
                    cache[w] = t
                parts.append(t)
            out.append(np.frombuffer(b"".join(parts), dtype=np.int32))
        return out
    return ids


def _encoded(ids, bos_id: int | None, columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The ids of each text, BOS first when given, in steps; rows without text have null."""
    first = np.array([] if bos_id is None else [bos_id], dtype=np.int32)
    for batch in slices((pa.RecordBatch.from_arrays([c], names=["docs"]) for c in columns), "docs"):
        docs = batch.column("docs")
        found = ids(docs)
        offsets = np.zeros(len(found) + 1, dtype=np.int32)
        np.cumsum([len(t) + len(first) for t in found], out=offsets[1:])
        flat = np.concatenate([part for t in found for part in (first, t)]).astype(np.int32, copy=False)
        yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=docs.is_null() if docs.null_count else None)


def encode_docs(docs: DataFrame, rows: list[tuple], bos_id: int | None, text_col: str = "text",
                pattern: str = SPLIT_PATTERN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """T5 + T7: (keep..., tokens) with the BOS id prepended when given. Pretokenisation is the native
    regex; the words of each document are mapped to ids by an Arrow-batched helper with a per-worker
    word cache. A byte-level vocabulary needs no pretokens under the standard pattern, which covers every
    character: ids are the UTF-8 bytes. A narrow
    plan: no shuffle, every document encoded where it was read, a bounded step of a batch at a time."""
    if is_byte_level(rows) and pattern == SPLIT_PATTERN:
        given, ids = F.col(text_col), _byte_ids
    else:
        given, ids = F.regexp_extract_all(F.col(text_col), F.lit("(?U)" + pattern), F.lit(0)), _word_ids(rows)

    def enc(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _encoded(ids, bos_id, columns)
    # marked non-deterministic only so that Catalyst never duplicates the call (an inferred
    # `size(tokens) > 0` filter of a later explode would otherwise evaluate it twice)
    return docs.select(*keep, arrow_udf(enc, INT_ARRAY).asNondeterministic()(given).alias("tokens"))


# ---- T8 / T9 -------------------------------------------------------------------------------------
def vocab_hex_array(rows: list[tuple]) -> Column:
    """The vocabulary as an array literal of hex strings indexed by token id (ids are dense and the
    array has at most vocabulary-size entries)."""
    by_id = {t: b.hex().upper() for t, b, *_ in rows}
    return F.array(*[F.lit(by_id.get(i, "")) for i in range(max(by_id) + 1)])


def decode_tokens(tokens: Column, rows: list[tuple]) -> Column:
    """T8 as a native expression: ids -> bytes (array lookup) concatenated in order, invalid UTF-8
    replaced (decoding never throws on a cut character)."""
    table = vocab_hex_array(rows)
    hx = F.array_join(F.transform(tokens, lambda t: F.element_at(table, t + 1)), "")
    return F.make_valid_utf8(F.unhex(hx).cast("string"))


def decode_docs(encoded: DataFrame, rows: list[tuple], keep: tuple[str, ...] = ("doc_id",),
                tokens_col: str = "tokens") -> DataFrame:
    """T8 over a table of token arrays; a narrow projection."""
    return encoded.select(*keep, decode_tokens(F.col(tokens_col), rows).alias("decoded"))


def roundtrip(docs: DataFrame, rows: list[tuple], text_col: str = "text", pattern: str = SPLIT_PATTERN) -> DataFrame:
    """Encode without BOS, decode, compare with the text. Ids are decoded in steps of Arrow batches: bytes concatenated in
    order, invalid UTF-8 replaced."""
    enc = encode_docs(docs.select("doc_id", F.col(text_col).alias("_text"), F.col(text_col)), rows, None,
                      text_col, pattern, keep=("doc_id", "_text"))
    by_id = {t: b for t, b, *_ in rows}
    table = np.array([by_id.get(i, b"") for i in range(max(by_id) + 1)], dtype=object)

    def compared(batches):
        for batch in slices(batches, "tokens"):
            tokens = batch.column("tokens")
            flat, sizes = table[tokens.flatten().to_numpy(zero_copy_only=False)], pc.fill_null(pc.list_value_length(tokens), 0).to_pylist()
            same, at = [], 0
            for n, text in zip(sizes, batch.column("_text").to_pylist(), strict=True):
                same.append(None if text is None else b"".join(flat[at:at + n]).decode("utf-8", "replace") == text)
                at += n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(same, pa.bool_())], names=["doc_id", "roundtrip_ok"])

    return enc.mapInArrow(compared, StructType([enc.schema["doc_id"], StructField("roundtrip_ok", BooleanType())]))


def vocab_key(*parts) -> str:
    return hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:16]
