"""Token counts (operator 3): prefix dynamic programming over whole texts.

For every text the operator stores the exact token count of each of its prefixes, a prefix being its first n code points:
`change_at` holds the prefix lengths at which the count changes, `change_to` the count from there on. Counts don't only
grow (a longer piece of a word may be one token where a shorter one is two), hence both arrays. Truncation and budget
questions are answered from them without encoding again.

The table is built as count(prefix) = count(text before its last word) + count(piece of that word): the tokenizer never
joins words, so each distinct word of a task is worked out once. Inside a word, the tokenizer's own normaliser and
pre-tokenizer give the units, and a unit's prefixes are counted by dynamic programming over its bytes. A token sequence is
the encoding exactly if each pair of neighbours encodes to itself, so the last token before byte i is the one whose
predecessor, the last token before its start, it may follow: exactly one does; count[i] = count[start] + 1. The vocabulary marks the last byte
of a unit; so each cut takes its last token from the marked ones, and the table of the unmarked ones is carried on.

Words end at the ASCII white space that the tokenizer drops anyway. A special string is one token once it is complete, and
ordinary text before. Where composing marks (NFC) make a cut word differ from the word's own begin, that cut is encoded by
the library itself.

Cases: null or empty text has no changes, 0 bytes and 0 code points; texts of any length are taken whole; a budget below 0
counts as 0; repeated rows repeat; an empty table gives no rows; only the id and text columns are read, so other columns
cannot clash.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
from collections.abc import Iterator
from itertools import accumulate, chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.catalog import query
from runloom.llm.common import flat, read, settle, steps, word_spans

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Distinct words, units and pairs of tokens that a worker remembers, and entries of its tables; beyond, the memory starts anew.
REMEMBERED, ENTRIES = 500_000, 6_000_000
INNER, FINAL = 1, 2
Node = tuple[dict, str | None, str | None]
#: What stands for the merge of a token that is one symbol.
SINGLE = (-1, "", "")
#: Letters of ASCII and Latin-1, then ASCII marks other than the apostrophe.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class Units:
    """Token counts of the prefixes of a unit: a string of byte symbols that the vocabulary codes by itself."""

    def __init__(self, model: dict):
        self.mark = model["end_of_word_suffix"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        made = {a + b for a, b in self.rank}
        #: Of each token the rank of its merge and the pair it joins.
        self.parts: dict[str, tuple[int, str, str]] = {}
        #: Of each begin of a token whether it is one itself (INNER, FINAL: a marked one).
        self.begins: dict[str, int] = {}
        #: Of each begin its node in a tree of symbols: the next nodes, the token that ends there as it stands plain, and marked.
        self.nodes: dict[str, Node] = {"": ({}, None, None)}
        for token in model["vocab"]:
            marked = token.endswith(self.mark) and len(token) > len(self.mark)
            plain = token[:-len(self.mark)] if marked else token
            if len(plain) > 1:
                own, pair = self.merged(plain, marked) if token in made else ([], None)
                if own != [token]:
                    continue  # no text has it
                self.parts[token] = (self.rank[pair], *pair)
            self.begins[plain] = self.begins.get(plain, 0) | (FINAL if marked else INNER)
            for i in range(1, len(plain)):
                self.begins.setdefault(plain[:i], 0)
        for plain, kind in sorted(self.begins.items()):
            node = ({}, plain if kind & INNER else None, plain + self.mark if kind & FINAL else None)
            self.nodes[plain] = self.nodes[plain[:-1]][0][plain[-1]] = node
        self.forget()

    def forget(self) -> None:
        #: Of a token (before) the tokens that are known to follow it or not to.
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.units: dict[str, list[int]] = {}
        self.recent: tuple[str, list[int], list[int], list[str]] = ("", [0], [0], [""])

    def merged(self, symbols: str, marked: bool) -> tuple[list[str], tuple[str, str] | None]:
        """The tokens of a short string, by its merges in order of rank, the leftmost first; and the last merge."""
        own, last = [*symbols], None
        if marked:
            own[-1] += self.mark
        while len(own) > 1:
            rank, at = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(own, own[1:], strict=False)))
            if rank == len(self.rank):
                break
            last = (own[at], own[at + 1])
            own[at:at + 2] = [own[at] + own[at + 1]]
        return own, last

    def follows(self, before: str, token: str) -> bool:
        """Whether the token may stand after the other one: undoing both, the latest merge first, never shows two
        neighbours across the border that would have merged before they went into their tokens. Any token may begin a unit."""
        rank, parts = self.rank, self.parts
        x, y, x_goes, y_goes = before, token, len(rank), len(rank)
        while before:
            meets = rank.get((x, y))
            if meets is not None and meets < x_goes and meets <= y_goes:
                return False
            x_made, y_made = parts.get(x, SINGLE), parts.get(y, SINGLE)
            if x_made is SINGLE and y_made is SINGLE:
                break
            if x_made[0] > y_made[0]:
                x_goes, _, x = x_made
            else:
                y_goes, y, _ = y_made
        return True

    def counts(self, unit: str) -> list[int]:
        """Tokens of the first 0, 1, ... len(unit) symbols, each prefix a unit of its own. Units that come in order
        share the table of their common begin."""
        known = self.units.get(unit)
        if known is not None:
            return known
        size, (recent, out, inside, last) = len(unit), self.recent
        same = 0
        for a, b in zip(recent, unit, strict=False):
            if a != b:
                break
            same += 1
        out, inside, last = ([*x[:same + 1], *[empty] * (size - same)] for x, empty in ((out, 0), (inside, 0), (last, "")))
        nodes, follows, pairs, judged = self.nodes, self.follows, self.pairs, 0
        for begin in range(size):
            first = begin if begin > same else same
            node = nodes.get(unit[begin:first])
            if node is None:
                continue
            before, count = last[begin], inside[begin] + 1
            known = pairs.get(before)
            if known is None:
                known = pairs[before] = {}
            for end, symbol in enumerate(unit[first:], first + 1):
                node = node[0].get(symbol)
                if node is None:
                    break
                _, plain, marked = node
                if plain is not None and not inside[end]:
                    stays = known.get(plain)
                    if stays is None:
                        stays = known[plain] = follows(before, plain)
                        judged += 1
                    if stays:
                        last[end], inside[end] = plain, count
                if marked is not None and not out[end]:
                    stays = known.get(marked)
                    if stays is None:
                        stays = known[marked] = follows(before, marked)
                        judged += 1
                    if stays:
                        out[end] = count
        self.n_pairs += judged
        if not all(out[1:]):
            raise ValueError(f"the vocabulary has no tokens for {unit!r}")
        if len(self.units) > REMEMBERED or self.n_pairs > REMEMBERED:
            self.forget()
        if size <= 64:
            self.units[unit] = out
            self.recent = (unit, out, inside, last)
        return out


class Words:
    """Token counts of all prefixes of words, each worked out once while it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.units = Units(model["model"])
        special = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        units = lambda text: [u for u, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        latin = "".join(c for c in map(chr, range(0xC0, 0x100)) if c.isalpha())
        letters, marks = string.ascii_letters + latin, string.punctuation.replace("'", "")
        #: The two byte symbols of each Latin-1 letter.
        self.symbols = {ord(c): "".join(units(c)) for c in latin.lower()}
        #: Whether letters are lower-cased and stay together, and so do marks, so that such words are units as they are.
        self.simple = units(self.tokenizer.normalizer.normalize_str(letters + marks)) == [letters.lower().translate(self.symbols), marks]
        self.simple &= {len(x) for x in self.symbols.values()} == {2}
        self.shapes: dict[str, str] = {}
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.chars, self.first, self.table = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def normal(self, text: str) -> list[int]:
        """Token counts of the prefixes of a normalised text, from 0 code points on."""
        out = [0] * (len(text) + 1)
        before, done, units = 0, 0, self.units.counts
        for unit, (start, stop) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            out[done + 1:start + 1] = [before] * (start - done)
            own = units(unit)
            if len(unit) == stop - start:
                out[start + 1:stop + 1] = [before + c for c in own[1:]]
            else:
                out[start + 1:stop + 1] = [before + own[b] for b in accumulate(len(c.encode()) for c in text[start:stop])]
            if text[start] == "'" and stop - start > 1:  # a shortened word that is cut falls into other units
                out[start + 1:stop] = [before + self.library(text[start:i]) for i in range(start + 1, stop)]
            before, done = before + own[-1], stop
        out[done + 1:] = [before] * (len(text) - done)
        return out

    def plain(self, text: str) -> list[int]:
        """Token counts of the prefixes of a text without special strings."""
        normalize = self.tokenizer.normalizer.normalize_str
        whole = normalize(text)
        own = self.normal(whole)
        if text.isascii() and len(whole) == len(text):
            return own
        if unicodedata.is_normalized("NFC", text):
            shapes = [self.shapes.get(c) or self.shapes.setdefault(c, normalize(c)) for c in text]
            sizes = [0 if s == " " and i and shapes[i - 1] == " " else len(s) for i, s in enumerate(shapes)]
            if sum(sizes) == len(whole):
                return [own[b] for b in accumulate(sizes, initial=0)]
        out, base, begin = [0], 0, 0
        for i in range(1, len(text) + 1):
            if text[i - 1].isascii():  # nothing before is changed by what follows
                base += len(normalize(text[begin:i - 1]))
                begin = i - 1
            tail = normalize(text[begin:i])
            out.append(own[base + len(tail)] if whole.startswith(tail, base) else self.library(text[:i]))
        return out

    def counts(self, word: str) -> list[int]:
        """Token counts of the prefixes of a word, from 0 code points on."""
        if self.simple and (parts := SIMPLE.fullmatch(word)):
            if word.isascii():
                out = self.units.counts(parts[1].lower())
            else:
                own = self.units.counts(parts[1].lower().translate(self.symbols))
                out = [own[b] for b in accumulate((1 if c < "\x80" else 2 for c in parts[1]), initial=0)]
            return [*out, *(out[-1] + c for c in self.units.counts(parts[2])[1:])] if parts[2] else out
        out, base, begin = [0], 0, 0
        for hit in self.special.finditer(word):
            own = self.plain(word[begin:hit.end()])
            out += [base + c for c in own[1:-1]]
            base += own[hit.start() - begin] + 1
            out.append(base)
            begin = hit.end()
        return out + [base + c for c in self.plain(word[begin:])[1:]]

    def look_up(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > REMEMBERED or len(self.table) > ENTRIES:
            self.forget()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        lost = np.flatnonzero(at < 0)
        if len(lost):
            new = sorted({words[i] for i in lost.tolist()}, key=bytes.lower)  # units of a common begin come together
            tables = [self.counts(w.decode()) for w in new]  # from 0 code points on: first is the entry of 1
            sizes = np.array([len(t) for t in tables], np.int64) - 1
            fresh = np.fromiter(chain.from_iterable(tables), np.int32, int(sizes.sum()) + len(new))
            self.index.update(zip(new, range(len(self.chars), len(self.chars) + len(new)), strict=True))
            self.first = np.concatenate([self.first, len(self.table) + np.cumsum(sizes + 1) - sizes])
            self.chars = np.concatenate([self.chars, sizes])
            self.table = np.concatenate([self.table, fresh])
            at[lost] = [self.index[words[i]] for i in lost.tolist()]
        return at


_WORDS: dict[str, Words] = {}


def _changes(path: str, id_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = _WORDS.get(path) or _WORDS.setdefault(path, Words(path))
    for batch in steps(batches, "text"):
        raw, offsets = flat(batch.column("text"))
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
        starts, _, rows = word_spans(raw, offsets)
        at = own.look_up([w for t in batch.column("text").cast(pa.binary()).to_pylist() if t for w in t.split()])
        sizes = own.chars[at]
        total = int(sizes.sum())
        within = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        counts = own.table[own.first[at] + sizes - 1]
        upto = np.cumsum(counts)
        per_row = np.bincount(rows, weights=counts, minlength=batch.num_rows).astype(np.int64)
        before = upto - counts - (np.cumsum(per_row) - per_row)[rows]
        value = own.table[np.repeat(own.first[at], sizes) + within] + np.repeat(before, sizes)
        place = np.repeat(points[starts] - points[offsets[rows]], sizes) + within + 1
        row = np.repeat(rows, sizes)
        new = np.ones(total, bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        new &= (value != 0) | ~np.concatenate([[True], row[1:] != row[:-1]])[:total]
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=batch.num_rows))]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[new], pa.int32())) for x in (place, value)]
        yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(np.diff(offsets), pa.int64()), pa.array(np.diff(points[offsets]), pa.int64()), *lists],
                                         [id_col, "n_bytes", "n_chars", "change_at", "change_to"])
    settle()


def prefix_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text) -> id, n_bytes, n_chars, change_at, change_to: the exact token count of every prefix of every whole text."""
    path = path or public_tokenizers.path(VOCABULARY)
    fields = T.StructType.fromDDL("n_bytes long, n_chars long, change_at array<int>, change_to array<int>").fields
    return docs.select(id_col, "text").mapInArrow(lambda it: _changes(path, id_col, it), T.StructType([docs.schema[id_col], *fields]))


def token_count() -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.get("change_to", F.size("change_to") - 1), F.lit(0)).cast("long")


def count_at(n_chars: Column | int) -> Column:
    """Tokens of the first n_chars code points, encoded by themselves."""
    return F.coalesce(F.get("change_to", F.size(F.filter("change_at", lambda at: at <= n_chars)) - 1), F.lit(0)).cast("long")


def truncate_at(budget: int) -> Column:
    """Code points of the longest prefix that encodes to at most `budget` tokens."""
    size = F.size("change_to")
    back = F.array_position(F.reverse(F.transform("change_to", lambda n: n <= max(budget, 0))), F.lit(True))
    after = F.when(back == 0, 0).otherwise(size - back + 1).cast("int")
    return F.when(after >= size, F.col("n_chars")).otherwise(F.get("change_at", after) - 1).cast("long")


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts(read(spark, sf_dir, "documents")).withColumn("n_tokens", token_count())
    over = F.col("n_tokens") > LIMIT
    return counted.select("doc_id", "n_bytes", "n_tokens", over.alias("over_limit"), F.when(over, truncate_at(LIMIT)).otherwise(F.col("n_chars")).alias("chars_within_limit"))
