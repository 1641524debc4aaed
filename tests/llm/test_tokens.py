import random

import public_tokenizers
import pytest

from runloom.llm import pieces, token_counts


@pytest.fixture(scope="module")
def words():
    return token_counts.Words(public_tokenizers.path(token_counts.VOCABULARY))


def library_counts(words, text):
    """Tokens of the first 0, 1, ... code points, each prefix encoded by the library."""
    return [len(c.ids) for c in words.tokenizer.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]


ODD_WORDS = ["it's", "they're", "!!'re", "a'll'd", "''s", "x<|endoftext|>y", "<|endoftext|><|startoftext|>'s", "!<|endoftex", "café", "cafe\u0301s", "e\u0301e\u0302x\u0323\u0307",
             "\u0130stanbul", "a\u3000\u3000b\u00a0", "ΑΣ", "日本語テキスト", "한국어", "\u1112\u1161\u11ab\u1100", "\U0001d4b3\U0001f600\U0001f600a1b22", "don't!!!...", "\0\x1c\x1fz",
             "\ufb01x", "é" * 20, "\u0915\u093cx", "\u0301a", "x" * 300, "ab" * 100, "supercalifragilisticexpialidocious", "http://www.example.com/a?b=1&c=2", "AbCÉ" * 30]


@pytest.mark.parametrize("word", ODD_WORDS)
def test_every_prefix_of_a_word_counts_as_the_library_says(words, word):
    assert words.counts(word) == library_counts(words, word)


def test_every_prefix_of_many_words(words):
    rng = random.Random(4)
    made = ["".join(rng.choice("aeinrst" if rng.random() < 0.7 else "abcdefghijklmnopqrstuvwxyz'!é12E\u0301") for _ in range(rng.randint(1, 24))) for _ in range(1500)]
    for word in made:
        assert words.counts(word) == library_counts(words, word), word


def test_neighbours_are_those_of_the_merges(words):
    rng, units = random.Random(5), words.units
    inner = sorted(t for t, kind in units.begins.items() if kind & token_counts.INNER)
    final = sorted(t for t, kind in units.begins.items() if kind & token_counts.FINAL)
    for _ in range(4000):
        a, b = rng.choice(inner), rng.choice(inner)
        assert units.follows(a, b) == (units.merged(a + b, False)[0] == [a, b])
        b = rng.choice(final)
        assert units.follows(a, b + units.mark) == (units.merged(a + b, True)[0] == [a, b + units.mark])


def test_memory_that_starts_anew_changes_no_count(words, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    few = [w.encode() for w in ODD_WORDS]
    for part in (few[:9], few[5:], few):
        at = words.look_up(part)
        assert [words.table[words.first[k]:words.first[k] + words.chars[k]].tolist() for k in at] == [library_counts(words, w.decode())[1:] for w in part]


def test_counts_and_cuts_of_texts_are_the_librarys(spark, words, odd_docs, no_docs):
    from pyspark.sql import functions as F
    got = token_counts.prefix_counts(odd_docs).withColumn("n_tokens", token_counts.token_count()).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(got) == 11
    for r in got:
        text = texts[r.doc_id]
        assert (r.n_tokens, r.n_bytes, r.n_chars) == (words.library(text), len(text.encode()), len(text))
    rows = list(enumerate([" \t", "", " ".join(ODD_WORDS[:20]), "  it's FOO<|endoftext|>bar \n café Été 12345 \u3000 x ", "a" * 50 + "\u3000"]))
    docs = token_counts.prefix_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    cuts = (-1, 0, 1, 2, 5, 9, 20, 1000)
    at = {n: token_counts.count_at(n).alias(f"c{n}") for n in range(max(len(t) for _, t in rows) + 2)}
    for r in docs.select("doc_id", *at.values(), *(token_counts.truncate_at(k).alias(f"t{k}") for k in cuts)).collect():
        want = library_counts(words, rows[r.doc_id][1])
        assert [r[f"c{n}"] for n in range(len(want))] == want
        assert [r[f"t{k}"] for k in cuts] == [max(i for i, n in enumerate(want) if n <= max(k, 0)) for k in cuts]
    assert docs.where(F.size("change_at") != F.size("change_to")).count() == 0
    assert token_counts.prefix_counts(no_docs).count() == 0


def test_pieces_are_the_librarys_and_decode(spark, odd_docs, no_docs):
    from sentencepiece import SentencePieceProcessor
    lib = SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    coded = pieces.encode_checked(odd_docs).collect()
    assert len(coded) == 11 and all(r.round_trip for r in coded)
    assert all(list(r.ids) == lib.encode(texts[r.doc_id]) for r in coded)
    back = pieces.decode(pieces.encode(odd_docs)).collect()
    assert all(r.text == texts[r.doc_id] for r in back)
    assert pieces.encode(no_docs).count() == 0


@pytest.mark.parametrize("text", ["  two  spaces ", "▁mark▁▁", "a\nb\tc\r", "日本語" * 60, "ab" * 200, "<s> <0x41> </s>", "!!!???...", "\0￿\0"])
def test_pieces_of_hard_texts(text):
    from sentencepiece import SentencePieceProcessor
    path = public_tokenizers.path(pieces.MODEL)
    own, lib = pieces.model(path), SentencePieceProcessor(model_file=path)
    at = own.look_up(own.split(text))
    ids = [int(i) for k in at for i in own.flat[own.first[k]:own.first[k] + own.counts[k]]]
    assert ids == lib.encode(text) and own.decode(ids) == lib.decode(ids)
