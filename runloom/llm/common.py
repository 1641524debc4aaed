"""Helpers shared by the operators of this package: written intermediates, text batches, connected components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.session import discard, setting, shuffles_dropped, work_dir

#: A word: a run of bytes other than space and the controls 9 to 13 (pattern of every word count here).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step works on; a longer text makes a step of its own.
STEP_BYTES = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage, survives lost executors."""
    path = work_dir(df.sparkSession, f"llm-{name}")
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` returned, after the last job that reads them."""
    for t in tables:
        discard(t.sparkSession, t.written_to)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; 0 is the held-out fold (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


#: A Bloom filter's bits for each key, the bits of a block, and the blocks that it has at most (8 MB).
KEY_BITS, BLOCK_BITS, MOST_BLOCKS = 12, 4096, 16_384


def may_match(rows: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows whose key may be one of `keys` (same column): all that are, and few others (2 %; more beyond 5.6 million
    keys, when the filter grows no further). For rows that are wide beside their keys, before a join shuffles them. A
    Bloom filter in blocks: a key's bits are all in one, so blocks are joined by number. how: left_anti for the other rows."""
    keys = keys.select(F.col(key).cast(rows.schema[key].dataType).alias(key)).where(F.col(key).isNotNull())
    blocks = min(MOST_BLOCKS, max(1, -(-keys.count() * KEY_BITS // BLOCK_BITS)))
    places = [f"cast(shiftrightunsigned(xxhash64('place', `{key}`), {at}) & {BLOCK_BITS - 1} as int)" for at in (0, 32)]
    block = f"cast(pmod(xxhash64(`{key}`), {blocks}) as int)"
    set_bits = keys.select(F.expr(block).alias("block"), F.explode(F.array(*map(F.expr, places))).alias("place"))
    words = set_bits.groupBy("block", F.expr("place div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, place % 64)")).alias("held"))
    held = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "held"))).alias("held"))
    filled = held.select(F.col("block").alias("_block"), F.expr(f"transform(sequence(0L, {BLOCK_BITS // 64 - 1}L), i -> coalesce(held[i], 0L))").alias("_bits"))
    passes = " and ".join(f"(shiftrightunsigned(_bits[{p} div 64], {p} % 64) & 1L) = 1L" for p in places)
    return rows.join(F.broadcast(filled), F.expr(f"{block} = _block and {passes}"), how)


def steps(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches that hold about `most` bytes of text, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)),
                         dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows (null: empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset:]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def small_batches(spark: SparkSession, rows: int = 1_000) -> contextlib.AbstractContextManager[None]:
    """Arrow batches of at most `rows` rows for the jobs that run inside; the session's own setting afterwards."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def settle() -> None:
    """Give memory that a finished task no longer uses back to the system: workers live on through later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each; grown when needed."""
    if len(_POWERS["up"]) < n:
        size = max(n, STEP_BYTES + 1)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of raw, from one prefix sum of a polynomial hash."""
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of every row; a word never crosses rows."""
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys of a partition that is sorted by them. Holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n indices over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        live = low != high
        if not live.any():
            break
        a, b = a[live], b[live]
        np.minimum.at(label, high[live], low[live])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the graph of `edges`: one row (node, component) for every node with a link to another
    node; component is the smallest node reachable. Null ends are no links; no edges give no rows.

    Each round every root takes its smallest neighbouring root as parent, chains of parents are halved until they
    are flat, and edges are carried over to the roots; the number of roots with edges at least halves. All tables are
    keyed by node, so a hub with very many links is pre-aggregated by min() before its shuffle.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    live = written(both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    label: DataFrame | None = None
    while not live.isEmpty():
        near = live.select(F.col("v").alias("node"), F.col("u").alias("up")).unionByName(
            live.select(F.col("u").alias("node"), F.col("v").alias("up")))
        parent = written(near.groupBy("node").agg(F.min("up").alias("up")).select("node", F.least("node", "up").alias("up")), "parent")
        while True:
            nxt = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jump = written(parent.join(nxt, "up", "left").select("node", F.coalesce("top", "up").alias("up"),
                                                                  (F.col("top") < F.col("up")).alias("moved")), "jump")
            moved = not jump.where("moved").isEmpty()
            parent = jump.select("node", "up")
            if not moved:
                break
        to = parent.withColumnsRenamed({"node": "u", "up": "ru"})
        tv = parent.withColumnsRenamed({"node": "v", "up": "rv"})
        live = written(live.join(to, "u").join(tv, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        if label is None:
            label = parent
        else:
            root = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            label = label.join(root, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    if label is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return label.select("node", F.col("up").alias("component"))
