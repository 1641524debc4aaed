"""Best-fit packing of token sequences into rows of T+1 tokens.

Packing is sequential by nature. :func:`pack_ranges` cuts the stream of documents into long ranges of positions (many
times the buffer), each streamed in order through one Python function whose memory is bounded by the buffer (1,000
documents) plus one row. A range doesn't drain its buffer: what is left in it when its input ends goes, in order of
arrival, to the next level, where `fan` neighbouring ranges make one stream, and so on until one stream is left; that
one drains. So every placement but the last thousand or so is made with a full buffer, no document is lost between
ranges, and one unfinished row, the tail, is all that the whole table leaves. A stream that fits one range is packed
exactly as by a single loader. (:func:`pack` makes independent streams, each with a tail of its own.)

Rules of a stream (same as the single-stream loader): documents enter a buffer in batches of 128
(per epoch, in order) whenever the buffer holds fewer than 1,000 documents, before every placement.
A row is filled by repeatedly taking the longest buffered document that fits the remaining space
(the earliest buffered on ties); if none fits, the shortest document (earliest on ties) is cropped
to the remaining space and the rest of it is dropped. Every row starts with BOS because every
document does. A row's epoch is that of the latest batch taken when it is full.
"""

from __future__ import annotations

import bisect
import itertools
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from runloom.schemas import DOC_BATCH, PACK_BUFFER, PACKED_SCHEMA
from runloom.session import saved

#: Documents of a range, and ranges whose left documents make one stream of the next level.
PACK_RANGE, PACK_FAN = 32_768, 32


class _Buffer:
    """Documents (arrival, epoch, tokens) keyed by length: per-length FIFO queues plus the sorted list of lengths present."""

    def __init__(self) -> None:
        self.by_len: dict[int, deque] = {}
        self.lengths: list[int] = []
        self.size = 0
        self.arrived = 0

    def add(self, epoch: int, toks: np.ndarray) -> None:
        n = len(toks)
        q = self.by_len.get(n)
        if q is None:
            q = self.by_len[n] = deque()
            bisect.insort(self.lengths, n)
        q.append((self.arrived, epoch, toks))
        self.arrived += 1
        self.size += 1

    def _take(self, n: int) -> tuple[int, int, np.ndarray]:
        q = self.by_len[n]
        t = q.popleft()
        if not q:
            del self.by_len[n]
            self.lengths.pop(bisect.bisect_left(self.lengths, n))
        self.size -= 1
        return t

    def take_best_fit(self, room: int) -> tuple[int, int, np.ndarray] | None:
        i = bisect.bisect_right(self.lengths, room)
        return self._take(self.lengths[i - 1]) if i > 0 else None

    def take_shortest(self) -> tuple[int, int, np.ndarray]:
        return self._take(self.lengths[0])

    def waiting(self) -> list[tuple[int, int, np.ndarray]]:
        return [t for q in self.by_len.values() for t in q]


def pack_stream(docs: Iterator[tuple[int, np.ndarray]], row_len: int, buffer_size: int = PACK_BUFFER,
                batch: int = DOC_BATCH, counts: list[int] | None = None,
                left: list[tuple[int, np.ndarray]] | None = None) -> Iterator[tuple[int, np.ndarray, int, bool]]:
    """Pack one ordered stream of (epoch, tokens). Yields (epoch, row, cropped_tokens, complete).
    ``counts`` (a two-item list), when given, accumulates documents placed in rows and their tokens, cropped ones whole.
    ``left``, when given, takes the documents that wait when the input ends, by arrival; else they are packed too."""
    buf = _Buffer()
    it = iter(docs)
    exhausted = False
    epoch = 1
    pending: tuple[int, np.ndarray] | None = None
    counts = counts if counts is not None else [0, 0]

    def refill() -> None:
        nonlocal exhausted, epoch, pending
        # one batch: up to `batch` documents of one epoch
        got = 0
        while got < batch:
            if pending is None:
                try:
                    pending = next(it)
                except StopIteration:
                    exhausted = True
                    return
            e, toks = pending
            if got and e != epoch:
                return  # an epoch boundary ends the batch
            epoch = e
            buf.add(e, toks)
            pending = None
            got += 1

    while True:
        placed: list[tuple[int, int, np.ndarray]] = []
        row: list[np.ndarray] = []
        pos = 0
        cropped = 0
        while pos < row_len:
            while buf.size < buffer_size and not exhausted:
                refill()
            if left is not None and exhausted and buf.size < buffer_size:
                left += [(e, t) for _, e, t in sorted(placed + buf.waiting(), key=lambda d: d[0])]
                return
            if buf.size == 0:
                break
            room = row_len - pos
            doc = buf.take_best_fit(room) or buf.take_shortest()
            placed.append(doc)
            row.append(doc[2][:room])
            cropped += max(0, len(doc[2]) - room)
            pos += len(row[-1])
        if not pos:
            return
        counts[0] += len(placed)
        counts[1] += sum(len(t) for _, _, t in placed)
        yield epoch, np.concatenate(row), cropped, pos == row_len


_PACKED = T.StructType([*PACKED_SCHEMA.fields, T.StructField("left", T.IntegerType())])
#: Packed rows, or documents that are left, of one Arrow batch that a worker gives back.
PACK_STEP = 256


def _pack_partitions(row_len: int, buffer_size: int, batch: int, drain: bool = True, max_rows: int | None = None):
    """Packed rows of each shard of a sorted partition, with ``left`` null; without ``drain``, behind them the documents that
    are left (one a row, ``left`` counting from 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows arrive sorted by (shard, epoch, order): each shard is one contiguous run, streamed
        def rows():
            for b in batches:
                tokens = b.column("tokens")
                for i, (s, e) in enumerate(zip(b.column("shard").to_pylist(), b.column("epoch").to_pylist(), strict=True)):
                    t = tokens[i].values  # None: no tokens
                    # a copy of its own: what waits in the buffer must not hold its whole batch
                    yield s, e, np.zeros(0, np.int32) if t is None else t.to_numpy(zero_copy_only=False).astype(np.int32)

        def records():
            for shard, grp in itertools.groupby(rows(), key=lambda x: x[0]):
                docs = ((e, t) for _, e, t in grp)
                counts, left = [0, 0], None if drain else []
                stream = pack_stream(docs, row_len, buffer_size, batch, counts, left)
                for n, (e, r, c, ok) in enumerate(itertools.islice(stream, max_rows)):
                    yield shard, n, e, r, c, ok, counts[0], counts[1], None
                    counts[0] = counts[1] = 0
                for i, (e, t) in enumerate(left or ()):
                    yield shard, 0, e, t, 0, False, 0, 0, i

        found = records()
        while out := list(itertools.islice(found, PACK_STEP)):
            columns = dict(zip(_PACKED.names, zip(*out, strict=True), strict=True))
            offsets = np.cumsum([0, *map(len, columns["tokens"])]).astype(np.int32)
            columns["tokens"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(columns["tokens"])))
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
    schema = to_arrow_schema(_PACKED)
    return run


def pack_ranges(encoded: DataFrame, seq_len: int, order_col: str = "pos", epoch_col: str | None = None, range_docs: int = PACK_RANGE,
                fan: int = PACK_FAN, buffer_size: int = PACK_BUFFER, batch: int = DOC_BATCH, max_rows: int | None = None) -> DataFrame:
    """K1-K5 over one stream: ``encoded`` has (order_col, tokens[, epoch]), order_col counting documents from 0 over all epochs.
    Returns level, shard, row_no, epoch, tokens, cropped, complete, docs_in, tokens_in; one row at most isn't complete.
    ``max_rows`` stops early: the first rows of the whole in order of (level, shard, row_no)."""
    e = F.col(epoch_col) if epoch_col else F.lit(1)
    top = encoded.agg(F.max(order_col)).first()[0]
    shards = 1 if top is None else top // range_docs + 1
    d = encoded.select(F.floor(F.col(order_col) / range_docs).cast("int").alias("shard"), e.cast("int").alias("epoch"), F.col(order_col).alias("_o"), "tokens")
    done: DataFrame | None = None
    level = 0
    while True:
        packed = (d.repartition("shard").sortWithinPartitions("shard", "epoch", "_o").drop("_o")
                  .mapInArrow(_pack_partitions(seq_len + 1, buffer_size, batch, shards == 1, max_rows), _PACKED))
        packed = packed.select(F.lit(level).alias("level"), "*")
        if shards > 1:
            packed = saved(packed, "packed")
        rows = packed.where("left is null").drop("left")
        done = rows if done is None else done.unionByName(rows)
        if shards == 1:
            return done if max_rows is None else done.orderBy("level", "shard", "row_no").limit(max_rows)
        left = packed.where("left is not null")
        d = left.select(F.floor(F.col("shard") / fan).cast("int").alias("shard"), "epoch", (F.col("shard") * F.lit(1 << 32) + F.col("left")).alias("_o"), "tokens")
        shards, level = -(-shards // fan), level + 1


def epochs_for(encoded: DataFrame, seq_len: int, max_rows: int) -> int:
    """Epochs whose tokens surely fill ``max_rows`` rows: every row takes T+1 tokens and crops fewer than the longest document."""
    r = encoded.agg(F.sum(F.size("tokens")).alias("n"), F.max(F.size("tokens")).alias("longest")).first()
    if not r.n:
        raise ValueError("no tokens to pack")
    return -(-max_rows * (seq_len + 1 + r.longest) // r.n) + 1


def pack_epochs(encoded: DataFrame, seq_len: int, n_docs: int, epochs: int, order_col: str = "pos", **options) -> DataFrame:
    """K3 over the endless stream's first epochs (U2): a batch ends with its epoch, the buffer runs on across the border."""
    every = encoded.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    every = every.withColumn("_stream_pos", (F.col("epoch") - 1) * F.lit(n_docs) + F.col(order_col))
    return pack_ranges(every, seq_len, "_stream_pos", "epoch", **options)


def pack(encoded: DataFrame, seq_len: int, shards: int | None = None, order_col: str = "pos", epoch_col: str | None = None,
         buffer_size: int = PACK_BUFFER, batch: int = DOC_BATCH, key_col: str = "doc_id",
         shard_docs: int | None = None) -> DataFrame:
    """K1-K5: ``encoded`` has (key_col, order_col, tokens[, epoch]); tokens already start with BOS.
    Returns (shard, row_no, epoch, tokens, cropped, complete); ``complete = false`` is the tail.

    A shard is one sequential stream. ``shard_docs`` makes shards of that many neighbouring positions, so the result
    depends on the data and this number alone; ``shards`` deals documents out by a hash instead (1: one stream)."""
    e = F.col(epoch_col) if epoch_col else F.lit(1)
    if (shards is None) == (shard_docs is None):
        raise ValueError("give either shards or shard_docs")
    shard = F.floor(F.col(order_col) / shard_docs) if shard_docs else F.pmod(F.xxhash64(F.col(key_col)), F.lit(shards))
    d = encoded.select(shard.cast("int").alias("shard"),
                       e.cast("int").alias("epoch"), F.col(order_col).alias("_o"), "tokens")
    d = (d.repartition(shards, "shard") if shards else d.repartition("shard")).sortWithinPartitions("shard", "epoch", "_o").drop("_o")
    return d.mapInArrow(_pack_partitions(seq_len + 1, buffer_size, batch), _PACKED).drop("left")


def packing_report(packed: DataFrame, seq_len: int, bos_id: int) -> DataFrame:
    """K2 + K4 in one aggregate over the packed rows: input documents and tokens (as counted by the
    packer), every complete row has T+1 tokens and starts with BOS, and tokens in = packed + cropped
    + tail."""
    c = F.col("complete")
    n = F.size("tokens").cast("long")
    out = packed.agg(
        F.coalesce(F.sum("docs_in"), F.lit(0)).cast("long").alias("docs_in"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).cast("long").alias("tokens_in"),
        F.count_if(c).alias("rows"),
        F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long").alias("packed_tokens"),
        F.coalesce(F.sum("cropped"), F.lit(0)).cast("long").alias("cropped_tokens"),
        F.coalesce(F.sum(F.when(~c, n)), F.lit(0)).cast("long").alias("tail_tokens"),
        F.count_if(~c).alias("tails"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"),
        F.count_if(c & (n != seq_len + 1)).alias("bad_length_rows"),
        F.count_if(F.element_at("tokens", 1) != F.lit(bos_id)).alias("bad_bos_rows"))
    return out.withColumn("balance_gap", F.col("tokens_in") - F.col("packed_tokens") - F.col("cropped_tokens")
                          - F.col("tail_tokens"))


def next_token_pairs(packed: DataFrame, seq_len: int) -> DataFrame:
    """inputs = row[:-1], targets = row[1:]."""
    c = packed.where("complete")
    place = [n for n in ("level", "shard", "row_no") if n in packed.columns]
    return c.select(*place, "epoch", F.slice("tokens", 1, seq_len).alias("inputs"),
                    F.slice("tokens", 2, seq_len).alias("targets"))


def batches(packed: DataFrame, batch_rows: int) -> DataFrame:
    """K5: rows grouped in batches of B per shard."""
    return packed.where("complete").withColumn("batch_no", F.floor(F.col("row_no") / batch_rows).cast("long"))


def eval_steps(eval_tokens: int, batch_rows: int, seq_len: int) -> int:
    """Steps of batch_rows rows of seq_len tokens that the evaluation budget pays for, one at least."""
    return max(1, eval_tokens // (batch_rows * seq_len))


def eval_rows(packed: DataFrame, steps: int, batch_rows: int) -> DataFrame:
    """K6: the first steps * B complete rows of the one stream that levels and shards make in their order (a top-k)."""
    place = [n for n in ("level", "shard", "row_no") if n in packed.columns]
    return packed.where("complete").orderBy(*place).limit(steps * batch_rows)
