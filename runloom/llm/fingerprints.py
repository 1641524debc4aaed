"""Document fingerprints (operator 10): digests of statistically improbable features.

Every window of WINDOW bytes has an entropy (of order 2, -log2 of the sum of squared byte frequencies); entropies that
are rare over all windows of the corpus are improbable.
In every run of RUN neighbouring windows the leftmost of the rarest wins; windows that win at least VOTES times are the
text's features. Features are hashed and inserted, in order, into a chain of Bloom filters of FILTER_BITS bits that
take FILTER_FEATURES features each. Two digests are compared filter by filter: the overlap of set bits, normalised so
that the overlap expected by chance is 0 and the largest possible is 1; each filter of the shorter chain counts with
its best partner, weighted by its features.

The entropy table is one corpus-wide count in ENTROPY_BINS bins (a bounded array), so equal texts have equal
fingerprints within a run.

Cases: null text is the empty text, whose fingerprint is the empty string; two empty fingerprints are alike (1), an
empty and another are not (0). A text shorter than a window is one feature. If no window wins VOTES times, all
winners are features. Repeated rows repeat. The next document is by (doc_id, text), null ids first. An empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from runloom.llm.catalog import query
from runloom.llm.common import flat, mix, read, steps

WINDOW = 16
RUN = 16
VOTES = 5
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
#: Equal pairs of bytes in a window: 0 to WINDOW * (WINDOW - 1) / 2. The entropy of order 2 is a falling function of them.
ENTROPY_BINS = WINDOW * (WINDOW - 1) // 2 + 1


def entropies(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy bins of the windows of all rows, and the position of each window in raw."""
    n = len(raw)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = n - WINDOW + 1
    # equal pairs in a window = sum over its bytes i of the equal bytes among the i before
    before, pairs = np.zeros(n, np.uint8), np.zeros(m, np.uint8)
    for i in range(1, WINDOW):
        before[i:] += raw[i:] == raw[:n - i]
        pairs += before[i:i + m]
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(np.arange(m) + WINDOW <= ends[:m])
    return pairs[at].astype(np.int64), at


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(ENTROPY_BINS, np.int64)
    for batch in steps(batches, "text"):
        counts += np.bincount(entropies(*flat(batch.column("text")))[0], minlength=ENTROPY_BINS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENTROPY_BINS)), pa.array(counts)], ["bin", "n"])


def rarity(docs: DataFrame) -> list[int]:
    """Rank of each entropy bin over all windows of the corpus, rarest first; bins that never occur come first."""
    counts = docs.select("text").mapInArrow(_tally, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    n = {r.bin: r.n for r in counts.collect()}
    ranks = [0] * ENTROPY_BINS
    for place, b in enumerate(sorted(range(ENTROPY_BINS), key=lambda b: (n.get(b, 0), b))):
        ranks[b] = place
    return ranks


def features(raw: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every feature, in order of row and position."""
    bins, at = entropies(raw, offsets)
    row = np.searchsorted(offsets, at, "right") - 1
    sizes = np.diff(offsets)
    per_row = np.bincount(row, minlength=len(sizes)) if len(row) else np.zeros(len(sizes), np.int64)
    picked, rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(at):
        key = (ranks[bins] << np.int64(40)) + np.arange(len(at))
        low, width = key, 1
        while width < RUN:  # least key of the RUN windows from each on
            low = np.minimum(low[:len(low) - width], low[width:]) if len(low) > width else low[:0]
            width *= 2
        win = np.zeros(0, np.int64)
        if len(low):
            whole = row[:len(low)] == row[RUN - 1:]
            win = low[whole] & np.int64((1 << 40) - 1)
        few = np.flatnonzero((per_row > 0) & (per_row < RUN))  # rows of fewer windows than a run: one run
        first = np.cumsum(per_row) - per_row
        if len(few):
            win = np.concatenate([win, np.repeat([int(key[first[r]:first[r] + per_row[r]].min()) & ((1 << 40) - 1) for r in few.tolist()], VOTES)])
        votes = np.bincount(win, minlength=len(at))
        enough = np.zeros(len(sizes), bool)
        enough[row[votes >= VOTES]] = True
        chosen = (votes >= VOTES) | ((votes > 0) & ~enough[row])
        picked, rows = at[chosen], row[chosen]
    hashes = np.zeros(len(picked), np.uint64)
    for i in range(0, WINDOW, 8):
        part = np.zeros(len(picked), np.uint64)
        for j in range(8):
            part |= raw[picked + i + j].astype(np.uint64) << np.uint64(8 * j)
        hashes = mix(hashes ^ part)
    tiny = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    if len(tiny):
        own = [int.from_bytes(hashlib.sha256(raw[offsets[r]:offsets[r + 1]].tobytes()).digest()[:8], "little") for r in tiny.tolist()]
        rows, hashes = np.concatenate([rows, tiny]), np.concatenate([hashes, np.array(own, np.uint64)])
        by = np.argsort(rows, kind="stable")
        rows, hashes = rows[by], hashes[by]
    return rows, hashes


def digests(raw: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> list[bytes]:
    """Of every row the chain of filters: for each 2 bytes of feature count and FILTER_BITS / 8 bytes."""
    rows, hashes = features(raw, offsets, ranks)
    n = len(offsets) - 1
    per_row = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    chain = -(-per_row // FILTER_FEATURES)
    first = np.cumsum(chain) - chain
    which = first[rows] + place // FILTER_FEATURES
    total = int(chain.sum())
    filters = np.zeros((total, FILTER_BITS // 8), np.uint8)
    for k in range(HASHES):
        bit = ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
        np.bitwise_or.at(filters, (which, bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    counts = np.bincount(which, minlength=total) if len(which) else np.zeros(total, np.int64)
    whole = np.concatenate([counts.astype("<u2").view(np.uint8).reshape(total, 2), filters], axis=1)
    return [whole[a:a + c].tobytes() for a, c in zip(first.tolist(), chain.tolist(), strict=True)]


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: normalised bit overlap of two digests; symmetric."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(d, np.uint8).reshape(-1, 2 + FILTER_BITS // 8) for d in (a, b))
    if (len(x), a) > (len(y), b):
        x, y = y, x
    bx, by = np.unpackbits(x[:, 2:], axis=1).astype(np.float32), np.unpackbits(y[:, 2:], axis=1).astype(np.float32)
    nx, ny = bx.sum(1)[:, None], by.sum(1)[None, :]
    chance, most = nx * ny / FILTER_BITS, np.minimum(nx, ny)
    score = np.clip((bx @ by.T - chance) / np.maximum(most - chance, 1e-9), 0.0, 1.0).max(axis=1)
    weight = x[:, :2].copy().view("<u2")[:, 0].astype(np.float64)
    return float(np.dot(score, weight) / weight.sum())


def edited(text: str, following: str) -> str:
    """The text with its last quarter (rounded down) replaced by the head of the following text."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q] if q else text


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ranks: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, doc_id, text); a row without `own` only follows the row before it."""
    table = np.array(ranks, np.int64)
    held: tuple | None = None  # last row: bucket, id, text, digest
    for batch in steps(batches, "text"):
        cols = [batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "own")]
        texts = [t or "" for t in cols[2]]
        own = digests(*flat(pa.array(texts, pa.string())), table)
        rows = [*([held] if held else []), *zip(cols[0], cols[1], texts, own, cols[3], strict=True)]
        pairs = [(r, s) for r, s in zip(rows, rows[1:], strict=False) if r[0] == s[0] and r[4]]
        held = rows[-1]
        if pairs:
            yield _result(pairs, table)


def _result(pairs: list[tuple], table: np.ndarray) -> pa.RecordBatch:
    new = [edited(r[2], s[2]) for r, s in pairs]
    marks = digests(*flat(pa.array(new, pa.string())), table)
    return pa.RecordBatch.from_arrays([
        pa.array([r[1] for r, _ in pairs], pa.int64()), pa.array([len(r[2]) for r, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]), pa.array([r[3].hex() for r, _ in pairs]), pa.array([m.hex() for m in marks]),
        pa.array([likeness(r[3], m) for (r, _), m in zip(pairs, marks, strict=True)], pa.float64()),
        pa.array([likeness(r[3], s[3]) for r, s in pairs], pa.float64())],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """documents -> SCHEMA, see the module. Documents are dealt into ranges of ids, a few for each shuffle partition; the
    first row of each range also ends the range before it (that of the first ends the last), so a range is compared in
    one pass over its sorted rows with one batch in memory. The result does not depend on the ranges."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranks = rarity(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / (4 * parts) for i in range(1, 4 * parts)]
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, F.lit(40 * parts))).first()[0] or []))
    after = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    dealt = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(after).cast("int"))
    heads = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("head"))  # one row a range
    order = W.orderBy("bucket")
    following = F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    tails = heads.select("bucket", following.alias("h")).select("bucket", "h.doc_id", "h.text", F.lit(False).alias("own"))
    rows = dealt.withColumn("own", F.lit(True)).unionByName(tails)
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", F.desc("own"), F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return rows.select("bucket", "doc_id", "text", "own").mapInArrow(lambda it: _compare(ranks, it), SCHEMA)


@query("op10_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
