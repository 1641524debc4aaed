"""SentencePiece encoding and decoding (operator 1): suffix-array matching of pieces.

A task joins the new distinct units of its batch (a unit is a run of word marks and the characters up to the next
run; no piece reaches across) to one text, builds its suffix array by prefix doubling, finds the occurrence range of
every piece by binary search, and sorts the occurrences by position: these are the edges over the text. Relaxing takes,
in every unit at once, the best edge that joins two neighbouring symbols, the leftmost of equal ones, until none is
left. For a BPE model this is the library's result; the model's type is checked.

Units once encoded are remembered within a task, up to a bound. Characters without a piece become the pieces of
their bytes. Decoding joins the bytes of the pieces, turns word marks to spaces and drops the one that encoding adds.

Cases: null or empty text has no ids and decodes to the empty text; texts of any length are taken whole; repeated
rows repeat; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.catalog import query
from runloom.llm.common import read, settle, steps

MODEL = "piece_bpe_32k.model"
MARK = "▁"
REMEMBERED = 300_000
#: Characters of a unit beyond which merges are taken from a heap instead of in rounds; the ids are the same.
LONG = 48
STEP = 2_000_000


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        names = [sp.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.byte_ids = np.zeros(256, np.int64)
        for i in ids:
            if sp.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
        if not any(map(sp.is_byte, ids)) or any(re.search(f"[^{MARK}]{MARK}", names[i]) for i in plain):
            raise ValueError("a BPE model with byte pieces and without pieces across word marks is expected")
        self.names = [names[i] for i in plain]
        self.ids = np.array(plain)
        self.cost = np.full(len(names), np.inf)
        self.cost[plain] = [-sp.get_score(i) for i in plain]
        self.sizes = np.array([len(n) for n in self.names])
        joined = {c for n in self.names if len(n) > 1 for c in n}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        self.units = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else ""))
        spelled = [bytes([int(n[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else n.encode() for i, n in enumerate(names)]
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.array([len(x) for x in spelled])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.counts, self.first, self.flat = (np.zeros(0, np.int64) for _ in range(3))

    def split(self, text: str) -> list[str]:
        return self.units.findall((MARK + text).replace(" ", MARK)) if text else []

    def look_up(self, units: list[str]) -> np.ndarray:
        if len(self.index) > REMEMBERED:
            self.forget()
        at = np.fromiter(map(self.index.get, units, repeat(-1)), np.int64, len(units))
        lost = np.flatnonzero(at < 0).tolist()
        if lost:
            new = list(dict.fromkeys(units[i] for i in lost))
            counts, ids = self.encode_units(new)
            base = len(self.counts)
            self.index.update(zip(new, range(base, base + len(new)), strict=True))
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.flat = np.concatenate([self.flat, ids])
            at[lost] = [self.index[units[i]] for i in lost]
        return at

    def suffix_array(self, text: np.ndarray, depth: int) -> np.ndarray:
        """Positions of text (small codes, 0 between units) in the order of their next `depth` characters or more."""
        bits = int(text.max(initial=0)).bit_length() or 1
        width = max(1, min(62 // bits, depth, len(text)))
        rank = np.zeros(len(text), np.int64)
        for k in range(width):  # as many characters as fit make the first rank
            rank <<= bits
            rank[:len(text) - k] |= text[k:]
        while True:
            order = np.argsort(rank)
            if width >= depth or width >= len(rank):
                return order
            ordered = rank[order]
            rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
            after = np.zeros_like(rank)
            after[:-width] = rank[width:]
            rank = rank * (len(rank) + 2) + after
            width *= 2

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """text: code points, 0 between units -> keys (position * 64 + length, sorted) and ids of all occurrences."""
        alphabet, codes = np.unique(text, return_inverse=True)
        codes = np.append(codes, 0)
        order = self.suffix_array(codes[:-1], int(self.sizes.max()))
        points = [np.fromiter(map(ord, n), np.int64, len(n)) for n in self.names] if not hasattr(self, "points") else self.points
        self.points = points
        which = np.arange(len(points))
        low, high = np.zeros(len(points), np.int64), np.full(len(points), len(order), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not hasattr(self, "matrix"):
            self.matrix = np.zeros((len(points), int(self.sizes.max())), np.int64)
            for i, p in enumerate(points):
                self.matrix[i, :len(p)] = p
        for depth in range(self.matrix.shape[1]):
            want = self.matrix[which, depth]
            code = np.searchsorted(alphabet, want)
            known = (code < len(alphabet)) & (alphabet[np.minimum(code, len(alphabet) - 1)] == want)
            which, low, high, code = which[known], low[known], high[known], code[known]
            ends = []
            for target in (code, code + 1):
                a, b = low.copy(), high.copy()
                while (a < b).any():
                    mid = (a + b) >> 1
                    less = codes[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, len(codes) - 1)] < target
                    go = a < b
                    a, b = np.where(go & less, mid + 1, a), np.where(go & ~less, mid, b)
                ends.append(a)
            low, high = ends
            there = low < high
            which, low, high = which[there], low[there], high[there]
            done = self.sizes[which] == depth + 1
            found.append((which[done], low[done], high[done]))
            which, low, high = which[~done], low[~done], high[~done]
            if not len(which):
                break
        piece, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        n = high - low
        at = order[np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        piece = np.repeat(piece, n)
        key = at * 64 + self.sizes[piece]
        by = np.argsort(key)
        return key[by], self.ids[piece][by]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and all ids of the units."""
        text = np.frombuffer(("\0" + "\0".join(u.replace("\0", "￿") for u in units) + "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
        nul = [i for i, u in enumerate(units) if "\0" in u or "￿" in u]
        key, ids = self.edges(text)
        sizes = np.array([len(u) for u in units])
        start = np.flatnonzero(text)
        unit = np.repeat(np.arange(len(units)), sizes)
        stop = start + 1

        def cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            if not len(a):
                return np.zeros(0)
            span = b - a
            want = a * 64 + np.minimum(span, 63)
            at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            return np.where((key[at] == want) & (span < 63), self.cost[ids[at]], np.inf) if len(key) else np.full(len(a), np.inf)

        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for u in np.flatnonzero(sizes > LONG).tolist():
            mine = np.flatnonzero(unit == u) if len(units) < 50 else np.arange(np.searchsorted(unit, u), np.searchsorted(unit, u, "right"))
            out.append((np.full(0, u), *self._heap(start[mine], key, ids)))
            out[-1] = (np.full(len(out[-1][1]), u), out[-1][1], out[-1][2])
        short = sizes[unit] <= LONG
        start, stop, unit = start[short], stop[short], unit[short]
        pair = np.full(len(start), np.inf)
        if len(start) > 1:
            pair[:-1] = np.where(unit[1:] == unit[:-1], cost(start[:-1], stop[1:]), np.inf)
        while len(start):
            heads = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            best = np.repeat(np.minimum.reduceat(pair, heads), np.diff(np.append(heads, len(unit))))
            over = np.isinf(best)
            if over.any():
                out.append((unit[over], start[over], stop[over]))
                start, stop, unit, pair, best = (x[~over] for x in (start, stop, unit, pair, best))
                if not len(start):
                    break
            hit = np.flatnonzero(pair == best)
            hit = hit[np.concatenate([[True], unit[hit[1:]] != unit[hit[:-1]]])]
            stop[hit] = stop[hit + 1]
            keep = np.ones(len(start), bool)
            keep[hit + 1] = False
            now = hit - np.arange(len(hit))
            start, stop, unit, pair = start[keep], stop[keep], unit[keep], pair[keep]
            for left in (now, now - 1):
                left = left[(left >= 0) & (left + 1 < len(start))]
                pair[left] = np.where(unit[left] == unit[left + 1], cost(start[left], stop[left + 1]), np.inf)
            tail = now[now + 1 >= len(start)]
            pair[tail] = np.inf
        unit, start, stop = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        by = np.argsort(start)
        unit, start, stop = unit[by], start[by], stop[by]
        want = start * 64 + stop - start
        at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
        known = key[at] == want if len(key) else np.zeros(len(want), bool)
        for u in nul:  # a NUL character takes part as U+FFFF, which is no piece either; its own bytes are set here
            known &= ~((unit == u) & (text[start] == 0xFFFF))
        n = np.ones(len(start), np.int64)
        first = np.where(known, ids[at], -1) if len(key) else np.full(len(start), -1)
        odd = np.flatnonzero(~known)
        spelled: dict[int, np.ndarray] = {}
        base = np.cumsum(sizes + 1) - sizes
        for i in odd.tolist():
            spelled[i] = self.byte_ids[np.frombuffer(units[unit[i]][start[i] - base[unit[i]]].encode("utf-8", "replace"), np.uint8)]
            n[i] = len(spelled[i])
        flat_ids = np.repeat(first, n)
        place = np.cumsum(n) - n
        for i, v in spelled.items():
            flat_ids[place[i]:place[i] + len(v)] = v
        return np.bincount(unit, weights=n, minlength=len(units)).astype(np.int64), flat_ids

    def _heap(self, start: np.ndarray, key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same merges for one long unit: the best pair from a heap over a linked list of symbols."""
        a = np.searchsorted(key, start[0] * 64)
        b = np.searchsorted(key, (start[-1] + 1) * 64)
        cost = dict(zip(key[a:b].tolist(), self.cost[ids[a:b]].tolist(), strict=True))
        begin = start.tolist()
        end = [x + 1 for x in begin]
        after = [*range(1, len(begin)), -1]
        before = [-1, *range(len(begin) - 1)]
        heap: list[tuple[float, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and end[j] - begin[i] < 63 and (c := cost.get(begin[i] * 64 + end[j] - begin[i])) is not None:
                heapq.heappush(heap, (c, i, end[j]))
        for i in range(len(begin) - 1):
            push(i)
        live = [True] * len(begin)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j < 0 or end[j] != to:
                continue
            end[i], after[i], live[j] = end[j], after[j], False
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        kept = [i for i in range(len(begin)) if live[i]]
        return np.array([begin[i] for i in kept]), np.array([end[i] for i in kept])

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of the pieces of each row, word marks as they are; row i has the ids up to ends[i]."""
        n = self.lengths[ids]
        at = np.cumsum(n)
        text = self.blob[np.repeat(self.offsets[ids] - at + n, n) + np.arange(int(n.sum()))].tobytes()
        cuts = np.concatenate([[0], at])[np.concatenate([[0], ends])].tolist()
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        return plain(self.spell(np.array(ids, np.int64), np.array([len(ids)]))[0])


def plain(spelled: bytes) -> str:
    """Word marks to spaces; without the mark that encoding adds."""
    text = spelled.decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


_MODELS: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    return _MODELS.get(path) or _MODELS.setdefault(path, Pieces(path))


def _encode(path: str, id_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = model(path)
    for batch in steps(batches, "text", STEP):
        units = [own.split(t or "") for t in batch.column("text").to_pylist()]
        at = own.look_up([u for row in units for u in row])
        counts = own.counts[at]
        within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        values = own.flat[np.repeat(own.first[at], counts) + within]
        row = np.repeat(np.arange(len(units)), [len(u) for u in units])
        per_row = np.bincount(row, weights=counts, minlength=len(units)).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()), pa.array(values, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(id_col), lists], [id_col, "ids"])


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text) -> id, ids: the pieces of every whole text, as the library's encode() gives them."""
    path = path or public_tokenizers.path(MODEL)
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(id_col, "text").mapInArrow(lambda it: _encode(path, id_col, it), schema)


def _decode(path: str, id_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = model(path)
    for batch in batches:
        lists = pc.fill_null(batch.column("ids"), []).cast(pa.list_(pa.int64()))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        texts = [plain(x) for x in own.spell(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes))]
        yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])


def decode(coded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) -> id, text."""
    path = path or public_tokenizers.path(MODEL)
    schema = T.StructType([coded.schema[id_col], T.StructField("text", T.StringType())])
    return coded.select(id_col, "ids").mapInArrow(lambda it: _decode(path, id_col, it), schema)


def _round(path: str, id_cols: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoding and decoding in one pass over the texts."""
    own = model(path)
    for batch in steps(batches, "text", STEP):
        coded = next(_encode(path, id_cols[0], iter([batch])))
        lists, mark = coded.column("ids"), MARK.encode()
        spelled = own.spell(lists.values.to_numpy(), lists.offsets.to_numpy()[1:])
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        same = [x == (mark + t.replace(b" ", mark) if t else b"") for x, t in zip(spelled, texts, strict=True)]
        yield pa.RecordBatch.from_arrays([*map(batch.column, id_cols), lists, pa.array(same, pa.bool_())], [*id_cols, "ids", "round_trip"])
        del coded, lists, spelled, texts, same
    own.forget()
    settle()


def encode_checked(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, ...) -> id, the columns of `keep`, ids, round_trip: whether the ids decode to the text (a word mark in
    it: to a space)."""
    path = path or public_tokenizers.path(MODEL)
    id_cols = [id_col, *keep]
    schema = T.StructType([*(docs.schema[c] for c in id_cols), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    return docs.select(*id_cols, "text").mapInArrow(lambda it: _round(path, id_cols, it), schema)


@query("op1_piece_codes")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_checked(read(spark, sf_dir, "documents")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
