"""Language ID (operator 9): rank-order profiles of character n-grams compared by out-of-place distance.

A profile is the list of the most frequent n-grams (1 to 3 letters of case-folded words, word edges marked), most
frequent first. A document's distance to a language is the sum, over its own profile, of how far each n-gram is out of
place in the language's profile; an n-gram that the language lacks costs the profile length. The nearest language
wins, ties go to the smaller name. The score is 1 - distance / largest possible distance.

Profiles and limits are learned from all learning rows; learning and prediction read whole texts. Nothing but text and
the language of learning rows is used.

What scores below the limit of its nearest language is far from every learned language. The limit is MARGIN of the score
that all but LOW of that language's learning rows reach, learned like the profiles. A text of fewer than SHORT distinct
n-grams shows less: its limit is less in that proportion.

Cases: null text or a text without letters is `und` with score 0; rows without a language teach nothing; without any
learning row all documents are `und`; repeated rows repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from runloom.llm.catalog import query
from runloom.llm.common import fold, read, steps

PROFILE = 300
UNDETERMINED = "und"
#: The limit of a language: a quantile of its learning rows' scores, the part of it that must be reached, n-grams from which on all of it.
LOW, MARGIN, SHORT = 0.01, 0.75, 60

#: Case-folded code point of each code point where it is a letter, 0 elsewhere; filled when first needed.
_FOLD = np.zeros(0, np.uint32)


def _fold_table() -> np.ndarray:
    global _FOLD
    if not len(_FOLD):
        _FOLD = np.array([0 if not (c := chr(i)).isalpha() else ord(low) if len(low := c.lower()) == 1 else i for i in range(0x110000)], np.uint32)
    return _FOLD


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of the text, ascending, and their counts. 21 bits a character, 0 is a word edge."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.zeros(len(points) + 2, np.uint64)
    x[1:-1] = _fold_table()[points]
    x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]  # one edge between words
    if len(x) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    two = (x[:-1] << np.uint64(21)) | x[1:]
    three = ((two[:-1] << np.uint64(21)) | x[2:])[x[1:-1] != 0]
    return np.unique(np.concatenate([x[x != 0], two | np.uint64(1 << 63), three]), return_counts=True)


def profile(text: str, size: int = PROFILE) -> np.ndarray:
    codes, counts = grams(text)
    return codes[np.argsort(-counts, kind="stable")[:size]]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        langs = np.array(batch.column("lang").to_pylist())
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs.tolist())):
            parts = [grams(texts[i]) for i in np.flatnonzero(langs == lang).tolist()]
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], ["lang", "code", "n"])


def _learning(labelled: DataFrame) -> DataFrame:
    """(text, lang) of the rows that teach: those with a text and a language."""
    return labelled.where("lang is not null and text is not null").select("text", "lang")


def learn(labelled: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """(text, lang) -> profile of each language; its size is bounded by languages times profile length."""
    counts = _learning(labelled).mapInArrow(_tally, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))
    kept = counts.withColumn("place", best).where(F.col("place") <= size)
    out: dict[str, list[int]] = {}
    for r in sorted(kept.collect(), key=lambda r: (r.lang, r.place)):
        out.setdefault(r.lang, []).append(r.code)
    return out


def limits(labelled: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> dict[str, float]:
    """Least score of each language, from the learning rows that are nearest to it and labelled so. The quantile counts distinct
    scores: whole distances over a profile's length, whose number the profile size bounds, not the rows."""
    scores = predict(_learning(labelled), profiles, size, "lang").where("lang = lang_pred and score > 0")
    rows = scores.groupBy("lang").agg(F.percentile("score", F.lit(LOW)).alias("low")).collect()  # one row a language
    return {r.lang: MARGIN * r.low for r in rows}


def _judge(profiles: dict[str, list[int]], size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], list[float], list[int]]]:
    """Batches with nearest language, score and number of distinct n-grams (of the profile) of their texts."""
    names = sorted(profiles)
    codes = np.unique(np.concatenate([np.array(profiles[n], np.int64) for n in names]).view(np.uint64)) if names else np.zeros(0, np.uint64)
    place = np.full((len(names), len(codes) + 1), -1, np.int64)
    for i, name in enumerate(names):
        place[i, np.searchsorted(codes, np.array(profiles[name], np.int64).view(np.uint64))] = np.arange(len(profiles[name]))
    for batch in steps(batches, "text"):
        langs, scores, lengths = [], [], []
        for text in batch.column("text").to_pylist():
            own = profile(text or "", size)
            lengths.append(len(own))
            if not len(own) or not names:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            at = np.searchsorted(codes, own)
            at[(at == len(codes)) | (codes[np.minimum(at, len(codes) - 1)] != own)] = len(codes)
            there = place[:, at]
            far = np.where(there >= 0, np.abs(there - np.arange(len(own))), size).sum(axis=1)
            best = int(far.argmin())
            langs.append(names[best])
            scores.append(max(0.0, 1.0 - float(far[best]) / (size * len(own))))
        yield batch, langs, scores, lengths


def _predict(profiles: dict[str, list[int]], size: int, id_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, langs, scores, _ in _judge(profiles, size, batches):
        yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])


def _keep(profiles: dict[str, list[int]], least: dict[str, float], size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, langs, scores, lengths in _judge(profiles, size, batches):
        yield batch.filter(pa.array([name != UNDETERMINED and s >= least.get(name, 0.0) * min(1.0, n / SHORT)
                                     for name, s, n in zip(langs, scores, lengths, strict=True)], pa.bool_()))


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, id_col: str = "doc_id") -> DataFrame:
    """(id, text) -> id, lang_pred, score."""
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(id_col, "text").mapInArrow(lambda it: _predict(profiles, size, id_col, it), schema)


def keep(docs: DataFrame, profiles: dict[str, list[int]], least: dict[str, float] | None = None, size: int = PROFILE) -> DataFrame:
    """The rows of docs, all columns, whose text is in a learned language with at least the limit's score, if one is given."""
    return docs.mapInArrow(lambda it: _keep(profiles, least or {}, size, it), docs.schema)


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = learn(docs.where(fold("doc_id") != 0))
    return predict(docs, profiles).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score")
