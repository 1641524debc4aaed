import random

import numpy as np
from pyspark.sql import functions as F

from runloom.operators import packing as pk


def docs_of(lengths, bos=99):
    return [(1, np.array([bos] + list(range(1, n)), dtype=np.int32)) for n in lengths]


def test_hand_case_best_fit():
    rows = list(pk.pack_stream(iter(docs_of([4, 2, 6, 3])), 6, buffer_size=100))
    assert [len(r[1]) for r in rows] == [6, 6, 3]
    assert [r[3] for r in rows] == [True, True, False]      # the last row is the unfinished tail
    assert sum(r[2] for r in rows) == 0


def test_hand_case_crop_shortest():
    rows = list(pk.pack_stream(iter(docs_of([9, 8])), 6, buffer_size=100))
    assert [len(r[1]) for r in rows] == [6, 6]
    assert [r[2] for r in rows] == [2, 3]                   # 8 cropped to 6, then 9 cropped to 6


def pieces_of(row):
    starts = [k for k, t in enumerate(row) if t == 99]
    return [b - a for a, b in zip(starts, [*starts[1:], len(row)], strict=True)]


def test_each_piece_is_the_longest_that_fits():
    """With the whole input in the buffer: a piece that was not cropped is the longest waiting one that fits, and a document
    is cropped only when none fits, and then the shortest one."""
    rng = random.Random(7)
    for _ in range(30):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 300))]
        row_len = rng.randint(5, 50)
        waiting = sorted(lengths)
        for _, row, cropped, whole in pk.pack_stream(iter(docs_of(lengths)), row_len, buffer_size=1000):
            room, lost = row_len, 0
            for n in pieces_of(row):
                fitting = [x for x in waiting if x <= room]
                if fitting:
                    assert n == fitting[-1]
                    waiting.remove(n)
                else:
                    assert n == room
                    lost += waiting.pop(0) - n
                room -= n
            assert lost == cropped and whole == (room == 0)
        assert not waiting


def test_spark_packing_invariants(spark):
    rng = random.Random(3)
    rows = [(i, i, [99] + [rng.randint(0, 50) for _ in range(rng.randint(0, 30))]) for i in range(500)]
    enc = spark.createDataFrame(rows, "doc_id LONG, pos LONG, tokens ARRAY<INT>")
    for shards in (1, 4):
        packed = pk.pack(enc, 15, shards, buffer_size=50, batch=8)
        rep = pk.packing_report(packed, 15, 99).first()
        assert rep.bad_length_rows == 0 and rep.bad_bos_rows == 0 and rep.balance_gap == 0
        assert rep.docs_in == 500 and rep.tokens_in == sum(len(t) for _, _, t in rows)
    one = pk.pack(enc, 15, 1, buffer_size=50, batch=8).where("complete").orderBy("row_no")
    assert 0 < one.count() <= sum(len(t) for _, _, t in rows) // 16
    pairs = pk.next_token_pairs(one, 15).first()
    assert len(pairs.inputs) == 15 and list(pairs.inputs[1:]) == list(pairs.targets[:-1])


def test_shards_come_from_positions_not_from_the_cluster(spark):
    rows = [(i, i, [99] + [1] * (i % 23)) for i in range(400)]
    enc = spark.createDataFrame(rows, "doc_id LONG, pos LONG, tokens ARRAY<INT>")
    results = []
    for parts in (1, 3, 7):
        packed = pk.pack(enc.repartition(parts), 15, shard_docs=64)
        results.append(sorted((r.shard, r.row_no, tuple(r.tokens)) for r in packed.collect()))
    assert results[0] == results[1] == results[2] and {r[0] for r in results[0]} == set(range(7))
    first = [(r.shard, r.row_no) for r in pk.eval_rows(pk.pack(enc, 15, shard_docs=64), 4, 2).collect()]
    assert first == [x[:2] for x in results[0]][:8]


def scan(lengths, epochs, row_len, buffer_size, batch):
    """One loader over the documents (epoch, number of tokens), by a plain scan of a list; its last row may be short."""
    stream = [(e, i, n) for e in range(1, epochs + 1) for i, n in enumerate(lengths)]
    fed = [stream[a + k:a + k + batch] for a in range(0, len(stream), len(lengths) or 1) for k in range(0, len(lengths), batch)]
    fed = [[d for d in f if d[0] == f[0][0]] for f in fed]
    buffer, rows, epoch = [], [], 1
    while True:
        row, room = [], row_len
        while room:
            while len(buffer) < buffer_size and fed:
                epoch = fed[0][0][0]
                buffer += fed.pop(0)
            if not buffer:
                break
            fitting = [d for d in buffer if d[2] <= room]
            doc = max(fitting, key=lambda d: d[2]) if fitting else min(buffer, key=lambda d: d[2])
            buffer.remove(doc)
            row.append((*doc[:2], min(doc[2], room)))
            room -= min(doc[2], room)
        if row:
            rows.append((epoch, row))
        if room:
            return rows


def numbered(lengths):
    return [(i, [99_999] + [i] * (n - 1)) for i, n in enumerate(lengths)]


def test_one_stream_is_the_linear_scan(spark):
    rng = random.Random(11)
    lengths = [rng.choice([2, 3, 9, 20, 33, 60]) for _ in range(700)]
    enc = spark.createDataFrame(numbered(lengths), "pos long, tokens array<int>")
    for epochs, buffer_size, batch in ((1, 100, 16), (3, 50, 128), (2, 2_000, 7)):
        packed = pk.pack_epochs(enc, 40, len(lengths), epochs, buffer_size=buffer_size, batch=batch)
        got = [(r.epoch, list(r.tokens)) for r in sorted(packed.collect(), key=lambda r: r.row_no)]
        want = [(e, [t for _, i, n in row for t in [99_999] + [i] * (n - 1)]) for e, row in scan(lengths, epochs, 41, buffer_size, batch)]
        assert got == want


def test_ranges_lose_nothing_and_leave_one_tail(spark):
    rng = random.Random(12)
    lengths = [rng.randint(2, 60) for _ in range(3_000)]
    enc = spark.createDataFrame(numbered(lengths), "pos long, tokens array<int>")
    whole = pk.pack_ranges(enc, 40, buffer_size=60, batch=16)
    cropped = pk.packing_report(whole, 40, 99_999).first().cropped_tokens
    results = []
    for parts in (1, 5):
        packed = pk.pack_ranges(enc.repartition(parts), 40, range_docs=256, fan=3, buffer_size=60, batch=16)
        rows = sorted(map(tuple, packed.collect()))
        results.append(rows)
        r = pk.packing_report(packed, 40, 99_999).first()
        assert (r.docs_in, r.tokens_in, r.balance_gap, r.bad_length_rows, r.bad_bos_rows) == (3_000, sum(lengths), 0, 0, 0)
        assert r.tails <= 1 and r.cropped_tokens <= 1.2 * cropped
        assert {x[0] for x in rows} == {0, 1, 2, 3}
    assert results[0] == results[1]
    starts = sorted(t for row in results[0] for a, t in zip(row[4], row[4][1:], strict=False) if a == 99_999)
    assert len(set(starts)) == len(starts) and sum(row[4].count(99_999) for row in results[0]) == 3_000
    first = pk.pack_ranges(enc, 40, range_docs=256, fan=3, buffer_size=60, batch=16, max_rows=30).collect()
    assert sorted(map(tuple, first)) == [r for r in results[0]][:30]
    assert pk.pack_ranges(enc.where("false"), 40).count() == 0
