"""Registered queries: pretokens, byte pairs, BPE vocabulary, encode / decode, packing and
bits per byte over the ``documents`` table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from runloom.operators import bpb as bpbm
from runloom.operators import bpe
from runloom.operators import packing as pk
from runloom.plans import standins as st
from runloom.plans.catalog import query, r6
from runloom.plans.q_corpus import SPLIT_SQL, split_docs, train_docs
from runloom.schemas import EVAL_TOKENS, SPECIAL_TOKENS, SPLIT_PATTERN
from runloom.session import checkpoint_base

N_MERGES = bpe.merges_for_vocab()  # merges of the full vocabulary
PACK_SEQ = 1024        # packing queries use T = 1,024 (SURVEY §7.5)

PACK_STOP_ROWS = 500   # rows of the early-stop query
EVAL_BATCH = 4
BYTE_BOS = 256         # BOS id of the byte-level vocabulary (no merges)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _state(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table: changed data gets a vocabulary of its own."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return "|".join(sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in files))


def trained_vocab(spark: SparkSession, d: str, n_merges: int = N_MERGES, rebuild: bool = False):
    """S14 + S15: train once per (corpus, merges, pattern) and reuse the saved table; ``rebuild`` trains anew."""
    path = _vocab_path(spark, d, n_merges)
    if rebuild or not _exists(spark, f"{path}/token_bytes/_SUCCESS"):
        # all words of the train split are counted: the character budget (W2) is the feature of its own query
        merges = bpe.train_merges(train_docs(spark, d).select("text"), n_merges)
        v = bpe.build_vocab(spark, merges)
        v.write.mode("overwrite").parquet(f"{path}/vocab")                          # S14
        bpe.token_bytes(v).write.mode("overwrite").parquet(f"{path}/token_bytes")  # S13
    vocab = spark.read.parquet(f"{path}/vocab")
    rows = [tuple(r) for r in vocab.orderBy("token_id").collect()]  # at most the vocabulary size
    rows = [(t, bytes(b), l, r, s) for t, b, l, r, s in rows]
    return vocab, rows


# T1 in SQL: an engine without look-ahead takes the pattern in two steps. White space is the Unicode property, as (?U) has it. A
# mark goes before the last blank of a run that a word follows (the look-ahead gives that blank back); no piece spans a mark.
# The possessive parts need no step: what they could give back never lets a later part match.
_BLANK = r"\t\x{0B}\f \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACE, _MARK = rf"\r\n{_BLANK}", r"\x{E000}"
_MARKED_SQL = rf"regexp_replace(text, '([{_SPACE}])([{_BLANK}][^{_SPACE}])', '\1' || chr(57344) || '\2', 'g')"
_PIECES_SQL = "|".join([r"\x27(?i:[sdmt]|ll|ve|re)", rf"[^\r\n\p{{L}}\p{{N}}{_MARK}]?\p{{L}}+", r"\p{N}{1,2}",
                        rf" ?[^{_SPACE}\p{{L}}\p{{N}}{_MARK}]+[\r\n]*", rf"[{_SPACE}]*[\r\n]", rf"[{_SPACE}]+"])
WORD_COUNTS_SQL = f"""SELECT word, count(*) AS cnt FROM (
  SELECT unnest(regexp_extract_all({_MARKED_SQL}, '{_PIECES_SQL}')) AS word FROM documents) w GROUP BY word"""


@query("pretoken_counts", "T1 A9", WORD_COUNTS_SQL)
def pretoken_counts(spark, d):
    return bpe.word_counts(st.stories(spark, d))


@query("byte_pair_counts", "A10", f"""
WITH w AS ({WORD_COUNTS_SQL}),
h AS (SELECT hex(encode(word)) AS h, cnt FROM w),
p AS (SELECT substr(h, 2 * i + 1, 2) AS left_hex, substr(h, 2 * i + 3, 2) AS right_hex, cnt
      FROM (SELECT h, cnt, unnest(range(0, length(h) // 2 - 1)) AS i FROM h WHERE length(h) >= 4) y)
SELECT left_hex, right_hex, CAST(sum(cnt) AS BIGINT) AS pair_count FROM p GROUP BY left_hex, right_hex""")
def byte_pair_counts(spark, d):
    w = bpe.word_counts(st.stories(spark, d)).select(
        bpe.utf8_bytes(F.col("word")).alias("syms"), "cnt")
    pc = bpe.pair_counts(w)
    hx = lambda c: F.lpad(F.hex(c), 2, "0")
    return pc.select(hx(F.col("a")).alias("left_hex"), hx(F.col("b")).alias("right_hex"), F.col("n").alias("pair_count"))


@query("bpe_vocab", "T2 T3 T10 S14 S15")
def bpe_vocab(spark, d):
    vocab, _ = trained_vocab(spark, d)
    return vocab.select("token_id", F.hex("bytes").alias("bytes_hex"), "left", "right", "is_special")


def _vocab_path(spark, d, n_merges=N_MERGES):
    return f"{checkpoint_base(spark)}/runloom/vocab-{bpe.vocab_key(_state(spark, f'{d}/documents.parquet'), n_merges, SPLIT_PATTERN)}"


@query("token_bytes", "T4 U1 S13")
def token_bytes(spark, d):
    trained_vocab(spark, d)
    return spark.read.parquet(f"{_vocab_path(spark, d)}/token_bytes")


@query("vocab_summary", "T10 T3", f"""
SELECT CAST({256 + N_MERGES + len(SPECIAL_TOKENS)} AS BIGINT) AS vocab_size, {256 + N_MERGES} AS bos_id,
  CAST({len(SPECIAL_TOKENS)} AS BIGINT) AS n_special, CAST({N_MERGES} AS BIGINT) AS n_merges""")
def vocab_summary(spark, d):
    """Vocabulary size and BOS id (the first special token) from the saved table."""
    vocab, _ = trained_vocab(spark, d)
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"),
                     F.min(F.when(F.col("is_special"), F.col("token_id"))).alias("bos_id"),
                     F.count_if("is_special").alias("n_special"),
                     F.count_if(F.col("left").isNotNull()).alias("n_merges"))


def _encoded_trained(spark, d):
    vocab, rows = trained_vocab(spark, d)
    bos = next(t for t, _, _, _, s in rows if s)  # T3: BOS is the first special token
    return bpe.encode_docs(st.stories(spark, d), rows, bos), vocab, rows


@query("encode_corpus", "T5 T7 T11")
def encode_corpus(spark, d):
    enc, _, _ = _encoded_trained(spark, d)
    return enc.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.element_at("tokens", 1).alias("first_token"),
                      "tokens")


@query("decode_roundtrip", "T8 T9", "SELECT doc_id, true AS roundtrip_ok FROM documents")
def decode_roundtrip(spark, d):
    _, rows = trained_vocab(spark, d)
    return bpe.roundtrip(st.stories(spark, d), rows)


BYTE_ROWS = bpe.vocab_rows([])


def byte_encoded(spark, d, keep=("doc_id", "lang", "source")):
    return bpe.encode_docs(st.stories(spark, d), BYTE_ROWS, BYTE_BOS, keep=keep)


@query("doc_token_stats", "F21 T7 T11", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes,
  CAST(octet_length(encode(text)) + 1 AS BIGINT) AS n_tokens, 256 AS first_token,
  round(octet_length(encode(text)) / (octet_length(encode(text)) + 1.0), 6) AS bytes_per_token
FROM documents""")
def doc_token_stats(spark, d):
    docs = st.stories(spark, d).select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.octet_length("text").cast("long").alias("n_bytes"))
    enc = bpe.encode_docs(docs, BYTE_ROWS, BYTE_BOS, keep=("doc_id", "n_chars", "n_bytes"))
    n = F.size("tokens").cast("long")
    return enc.select("doc_id", "n_chars", "n_bytes", n.alias("n_tokens"), F.element_at("tokens", 1).alias("first_token"),
                      r6(F.col("n_bytes") / n).alias("bytes_per_token"))


def _encoded_split(spark, d, split):
    s = split_docs(spark, d).where(F.col("split") == split).select("doc_id", "pos_in_split", "text")
    return bpe.encode_docs(s, BYTE_ROWS, BYTE_BOS, keep=("doc_id", "pos_in_split"))


def _packed(spark, d, seq=PACK_SEQ, split="train"):
    return pk.pack_ranges(_encoded_split(spark, d, split), seq, order_col="pos_in_split")


@query("packed_rows", "K1 K2 K3 K5")
def packed_rows(spark, d):
    return pk.batches(_packed(spark, d), EVAL_BATCH).select("level", "shard", "row_no", "batch_no", "epoch", "tokens")


SPLIT_TRAIN_SQL = """
WITH n AS (SELECT count(*) AS n FROM documents),
p AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT p.* FROM p WHERE pos >= (SELECT least(n // 5, n) FROM n)"""


_INPUT_SQL = """CAST({e} * count(*) AS BIGINT) AS docs_in, CAST({e} * sum(octet_length(encode(text)) + 1) AS BIGINT) AS tokens_in,
  CAST(0 AS BIGINT) AS bad_length_rows, CAST(0 AS BIGINT) AS bad_bos_rows, CAST(0 AS BIGINT) AS balance_gap, true AS one_tail_at_most"""


@query("packing_report", "K2 K4", f"SELECT {_INPUT_SQL.format(e=1)} FROM ({SPLIT_TRAIN_SQL}) t")
def packing_report(spark, d):
    r = pk.packing_report(_packed(spark, d), PACK_SEQ, BYTE_BOS)
    return r.select("docs_in", "tokens_in", "bad_length_rows", "bad_bos_rows", "balance_gap", (F.col("tails") <= 1).alias("one_tail_at_most"))


@query("packing_totals", "K2 K4 (counts)")
def packing_totals(spark, d):
    return pk.packing_report(_packed(spark, d), PACK_SEQ, BYTE_BOS)


@query("packing_epochs", "K3 U2", f"{SPLIT_SQL} SELECT {_INPUT_SQL.format(e=2)}, 2 AS last_epoch FROM s WHERE split = 'val'")
def packing_epochs(spark, d):
    """Two epochs of the val split as one stream: the buffer runs across the border."""
    enc = _encoded_split(spark, d, "val")
    p = pk.pack_epochs(enc, PACK_SEQ, enc.count(), 2, order_col="pos_in_split")
    return pk.packing_report(p, PACK_SEQ, BYTE_BOS).select(
        "docs_in", "tokens_in", "bad_length_rows", "bad_bos_rows", "balance_gap", (F.col("tails") <= 1).alias("one_tail_at_most"), "last_epoch")


@query("packing_early_stop", "K3 U2 K5", f"""
SELECT CAST({PACK_STOP_ROWS} AS BIGINT) AS rows, CAST({PACK_STOP_ROWS * (PACK_SEQ + 1)} AS BIGINT) AS packed_tokens,
  CAST(0 AS BIGINT) AS bad_length_rows, CAST(0 AS BIGINT) AS bad_bos_rows, CAST(0 AS BIGINT) AS tails""")
def packing_early_stop(spark, d):
    """The endless stream over the val split, stopped after a number of rows, however many epochs they take."""
    enc = _encoded_split(spark, d, "val")
    p = pk.pack_epochs(enc, PACK_SEQ, enc.count(), pk.epochs_for(enc, PACK_SEQ, PACK_STOP_ROWS), order_col="pos_in_split", max_rows=PACK_STOP_ROWS)
    return pk.packing_report(p, PACK_SEQ, BYTE_BOS).select("rows", "packed_tokens", "bad_length_rows", "bad_bos_rows", "tails")


@query("next_token_pairs", "W5")
def next_token_pairs(spark, d):
    return pk.next_token_pairs(_packed(spark, d), PACK_SEQ)


@query("eval_rows", "K6")
def eval_rows(spark, d):
    rows = pk.eval_rows(_packed(spark, d, split="val"), pk.eval_steps(EVAL_TOKENS, EVAL_BATCH, PACK_SEQ), EVAL_BATCH)
    return rows.select("level", "shard", "row_no", "epoch", "tokens")


BPB_SQL = """
WITH t AS (
  SELECT doc_id, lang, source, substr(h, 2 * i + 1, 2) AS tok
  FROM (SELECT doc_id, lang, source, h, unnest(range(0, length(h) // 2)) AS i
        FROM (SELECT doc_id, lang, source, hex(encode(text)) AS h FROM documents) a) b
  UNION ALL SELECT doc_id, lang, source, 'BOS' FROM documents),
c AS (SELECT tok, count(*) AS c FROM t GROUP BY tok),
n AS (SELECT sum(c) AS n FROM c),
l AS (SELECT t.*, -ln(c.c / (SELECT n FROM n)) AS nats,
        CASE WHEN t.tok = 'BOS' THEN 0 WHEN substr(t.tok, 1, 1) IN ('8', '9', 'A', 'B', 'C', 'D', 'E', 'F') THEN 3 ELSE 1 END AS nb
      FROM t JOIN c ON c.tok = t.tok)
"""


def _bpb(spark, d, group=()):
    return _bpb_of(byte_encoded(spark, d), spark.createDataFrame(BYTE_ROWS, bpe.VOCAB_SCHEMA), group)


def _bpb_of(enc, vocab, group):
    losses = bpbm.unigram_losses(enc, group)
    out = bpbm.bits_per_byte(losses, bpe.token_bytes(vocab), group, weight="n")
    # total_nats is a sum of millions of doubles: its 6th decimal depends on summation order, so
    # only the ratio and the integer byte total are compared
    return out.select(*group, "total_bytes", r6("bpb").alias("bpb"))


def _bpb_sql(group: str) -> str:
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return BPB_SQL + (f"SELECT {g}CAST(sum(nb) AS BIGINT) AS total_bytes, round(sum(CASE WHEN nb > 0 THEN nats ELSE 0 END) / (ln(2) * sum(nb)), 6) AS bpb FROM l{gb}")


@query("bpb_overall", "J7 A7", _bpb_sql(""))
def bpb_overall(spark, d):
    return _bpb(spark, d)


@query("bpb_by_lang", "J7 A7", _bpb_sql("lang"))
def bpb_by_lang(spark, d):
    return _bpb(spark, d, ("lang",))


@query("bpb_by_source", "J7 A7", _bpb_sql("source"))
def bpb_by_source(spark, d):
    return _bpb(spark, d, ("source",))


@query("bpb_trained_by_lang", "T2 T5 J7 A7")
def bpb_trained_by_lang(spark, d):
    """The whole chain: trained vocabulary, encoding, token losses, bits per byte by language."""
    vocab, rows = trained_vocab(spark, d)
    bos = next(t for t, _, _, _, s in rows if s)
    return _bpb_of(bpe.encode_docs(st.stories(spark, d), rows, bos, keep=("lang",)), vocab, ("lang",))
