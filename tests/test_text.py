import collections
import random
import time

import duckdb
import pandas as pd
import regex
import tiktoken
from pyspark.sql import functions as F

from shared_values import SF_SMALL
from runloom.operators import bpe
from runloom.operators.corpus import smoke_stories
from runloom.plans.q_tokens import WORD_COUNTS_SQL
from runloom.schemas import SIMPLE_SPLIT_PATTERN, SPLIT_PATTERN


def test_pretokens_match_python_regex(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60)
    ours = {r.doc_id: r.words for r in docs.select(
        "doc_id", F.regexp_extract_all("text", F.lit("(?U)" + SPLIT_PATTERN), F.lit(0)).alias("words")).collect()}
    pat = regex.compile(SPLIT_PATTERN)
    for r in docs.collect():
        expected = pat.findall(r.text)
        assert ours[r.doc_id] == expected
        assert "".join(expected) == r.text


def _smoke(spark, n=200):
    pos = spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").alias("pos_in_split"), F.lit(0).alias("seed"))
    return smoke_stories(pos)


def test_bpe_encoding_matches_tiktoken_with_our_merges(spark):
    stories = _smoke(spark)
    merges = bpe.train_merges(stories, 40)
    assert len(merges) == 40
    rows = bpe.vocab_rows(merges)
    ranks = {b: t for t, b, _, _, s in rows if not s}
    enc = tiktoken.Encoding(name="ours", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r.text for r in stories.limit(20).collect()] + ["Hello world! Numbers: 123.", "naïve café 12345 — ok?\n\n  x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id LONG, text STRING")
    got = {r.doc_id: list(r.tokens) for r in bpe.encode_docs(df, rows, None).collect()}
    for i, t in enumerate(texts):
        assert got[i] == enc.encode_ordinary(t), t
    rt = {r.doc_id: r.roundtrip_ok for r in bpe.roundtrip(df, rows).collect()}
    assert all(rt.values())


def test_merge_tie_break_and_counts(spark):
    df = spark.createDataFrame([(0, "ab ab ab cd cd cd")], "doc_id LONG, text STRING")
    merges = bpe.train_merges(df, 2)
    # words: 'ab' x1, ' ab' x2, ' cd' x3 -> pairs (a,b)=3, (' ',c)=3, (c,d)=3, (' ',a)=2:
    # the count ties at 3 and the smallest (left, right) ids win
    assert merges[0] == (256, 32, 99, 3)
    assert merges[1] == (257, 97, 98, 3)


def one_merge_at_a_time(counts: dict[str, int], n: int) -> list[tuple]:
    """Training by recounting all pairs for every merge."""
    words = {w: list(w.encode("utf-8")) for w in counts}
    merges = []
    while len(merges) < n:
        pairs = collections.Counter()
        for w, syms in words.items():
            for pair in zip(syms, syms[1:]):
                pairs[pair] += counts[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        new = 256 + len(merges)
        merges.append((new, *best, pairs[best]))
        for w, syms in words.items():
            out = []
            for x in syms:
                if out and (out[-1], x) == best:
                    out[-1] = new
                else:
                    out.append(x)
            words[w] = out
    return merges


def test_training_equals_one_merge_at_a_time(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").limit(40)
    pat = regex.compile(SPLIT_PATTERN)
    counts = collections.Counter(w for r in docs.collect() for w in pat.findall(r.text))
    expected = one_merge_at_a_time(counts, 150)
    assert bpe.train_merges(docs, 150) == expected
    # a poor sample and frequent rewriting change the number of jobs, not the merges
    monkeypatch.setattr(bpe, "GUESS_WORDS", 3)
    monkeypatch.setattr(bpe, "REWRITE_EVERY", 1)
    assert bpe.train_merges(docs, 40) == expected[:40]


def test_training_on_runs_of_one_letter_and_on_nothing(spark):
    df = spark.createDataFrame([(0, "aaaaa aaaa aaa aaaaaaaaaaaaaaa"), (1, ""), (2, None)], "doc_id LONG, text STRING")
    counts = collections.Counter(["aaaaa", " aaaa", " aaa", " aaaaaaaaaaaaaaa"])
    assert bpe.train_merges(df, 30) == one_merge_at_a_time(counts, 30)
    assert bpe.train_merges(df.where("doc_id > 0"), 30) == []


def test_long_words_encode_in_good_time():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257, b"ba": 258, b"aba": 259}
    enc = tiktoken.Encoding(name="few", pat_str=r"\p{L}+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for n in (1, 2, 7, 50, 50_000):
        word = "".join(rng.choice("aab") for _ in range(n))
        began = time.perf_counter()
        got = bpe.encode_word(word, ranks)
        assert time.perf_counter() - began < 2
        assert got == enc.encode_ordinary(word)


def test_pieces_outside_the_pattern_go_with_and_without_merges(spark):
    df = spark.createDataFrame([(0, "a b")], "doc_id LONG, text STRING")
    for merges in ([], [(256, 97, 97, 1)]):
        assert list(bpe.encode_docs(df, bpe.vocab_rows(merges), None, pattern=SIMPLE_SPLIT_PATTERN).first().tokens) == [97, 98]


def test_bos_and_specials(spark):
    rows = bpe.vocab_rows([])
    df = spark.createDataFrame([(0, "hi")], "doc_id LONG, text STRING")
    toks = bpe.encode_docs(df, rows, 256).first().tokens
    assert list(toks) == [256, 104, 105]
    vocab = spark.createDataFrame(rows, bpe.VOCAB_SCHEMA)
    tb = {r.token_id: r.n_bytes for r in bpe.token_bytes(vocab).collect()}
    assert tb[ord("a")] == 1
    assert tb[0xE9] == 3            # a lone invalid byte decodes to U+FFFD: 3 bytes
    assert tb[256] == 0 and tb[259] == 0
    raw = {r.token_id: r.n_bytes for r in bpe.token_bytes(vocab, "raw").collect()}
    assert raw[0xE9] == 1


def test_decode_never_throws_on_cut_characters(spark):
    rows = bpe.vocab_rows([])
    df = spark.createDataFrame([(0, [0xC3])], "doc_id LONG, tokens ARRAY<INT>")
    assert bpe.decode_docs(df, rows).first().decoded == "�"


def test_word_counts_sql_is_the_split_pattern(spark):
    """Spark, the two-step SQL and the pattern itself agree on texts full of white space, marks and short forms."""
    draw = random.Random(3)
    letters = "abÀ1 23  \n\n\r\t 　\x0b\x85.!'’sLlvVeé٣ "
    rows = [(i, "".join(draw.choices(letters, k=draw.randint(0, 14)))) for i in range(4000)] + [(-1, None), (-2, "")]
    want = collections.Counter(w for _, t in rows if t for w in regex.findall(SPLIT_PATTERN, t))
    assert {tuple(r) for r in bpe.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == set(want.items())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert set(con.execute(WORD_COUNTS_SQL).fetchall()) == set(want.items())
