"""License scans (operator 6): sparse TF-IDF cosine to templates, then nearest-ancestor inheritance by path joins.

A header is a sentence or line of a text that speaks of licensing (a word of KEY begins one of its words). Headers, and
whole texts that may be licence files, become sparse TF-IDF vectors over words; document frequencies of the template
words are counted over all headers of the corpus, words outside the templates weigh as unseen ones. The template of the largest
cosine at LEAST or more is the licence; ties go to the smaller name. A file's own licence is that of its best header.

A licence file (its base name is one of FILES, or its text is nothing but a licence by the same cosine) speaks for its
directory. Directories inherit from the nearest ancestor that has one: each distinct directory is joined with its
ancestors' licences (a row for each level, not for each file), then files with their directories. A file's licence is its
own, else its directory's. Several licence files of one directory: the best score, then the smaller path.

Cases: null or empty text has no licence of its own; a null path is a file of the root directory with an empty name;
texts are taken whole; repeated rows repeat; without licences all results are null; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.catalog import query
from runloom.llm.common import read, steps, written

LEAST = 0.6
FILES = ("license", "licence", "copying", "notice", "unlicense")

#: Statements of public licences as they are usually written in headers and files.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. Do not copy or distribute."),
}
KEY = re.compile(r"\b(?:licen[cs]|copyright|permi(?:ssion|tted)|redistribut|rights reserved|spdx)", re.I)
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
SENTENCE = re.compile(r"\n+|(?<=[.!?;])\s+(?=\S)")


def headers(text: str) -> list[str]:
    """Sentences and lines that speak of licensing."""
    out, done = [], 0
    for m in KEY.finditer(text):
        if m.start() < done:
            continue
        begin = max((e.end() for e in SENTENCE.finditer(text, max(done, m.start() - 400), m.start())), default=max(done, m.start() - 400))
        stop = SENTENCE.search(text, m.end())
        done = stop.start() if stop else len(text)
        out.append(text[begin:done])
    return out


def terms(text: str) -> Counter[str]:
    return Counter(w.lower() for w in WORD.findall(text))


VOCABULARY = frozenset(w for texts in TEMPLATES.values() for t in texts for w in terms(t))


class Matcher:
    """Cosines of sparse vectors to the templates. df: headers with a term, of n headers."""

    def __init__(self, df: dict[str, int], n: int):
        self.idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in VOCABULARY}
        self.unseen = math.log(n + 1) + 1
        self.vectors = []
        for name in sorted(TEMPLATES):
            for t in TEMPLATES[name]:
                v = {w: c * self.idf[w] for w, c in terms(t).items()}
                self.vectors.append((name, v, math.sqrt(sum(x * x for x in v.values()))))

    def best(self, text: str) -> tuple[str | None, float]:
        own = {w: c * self.idf.get(w, self.unseen) for w, c in terms(text).items()}
        length = math.sqrt(sum(x * x for x in own.values()))
        name, top = None, 0.0
        for label, v, norm in self.vectors:
            cosine = sum(x * own[w] for w, x in v.items() if w in own) / (norm * length) if length else 0.0
            if cosine >= LEAST and cosine > top + 1e-12:
                name, top = label, cosine
        return name, min(1.0, top)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        df: Counter[str] = Counter()
        for t in batch.column("text").to_pylist():
            for h in headers(t or ""):
                df.update({w for w in terms(h) if w in VOCABULARY} | {""})
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], ["word", "n"])


def matcher(files: DataFrame) -> Matcher:
    """Header frequencies over the whole corpus; what is collected is bounded by the template words."""
    counts = files.select("text").mapInArrow(_frequencies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r.word: r.n for r in counts}
    return Matcher(df, df.get("", 0))


def _own(own: Matcher, id_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        names, scores, whole = [], [], []
        for t in batch.column("text").to_pylist():
            found = [own.best(h) for h in headers(t or "")]
            name, score = min((f for f in found if f[0]), key=lambda f: (-f[1], f[0]), default=(None, 0.0))
            names.append(name)
            scores.append(score)
            whole.append(bool(name) and own.best(t)[0] is not None)
        yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("path"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(whole, pa.bool_())],
                                         [id_col, "path", "own_license", "own_score", "whole"])


def scan(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, path, text) -> id, path, own_license, own_score, inherited_license, inherited_from, license."""
    files = files.select(id_col, F.coalesce("path", F.lit("")).alias("path"), "text")
    own = matcher(files)
    schema = T.StructType([files.schema[id_col], *T.StructType.fromDDL("path string, own_license string, own_score double, whole boolean").fields])
    found = written(files.mapInArrow(lambda it: _own(own, id_col, it), schema)
                    .withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")), "license-own")
    base = F.lower(F.regexp_extract("path", r"([^/.]*)[^/]*$", 1))
    spoken = found.where(F.col("own_license").isNotNull() & (base.isin(*FILES) | F.col("whole")))
    best = spoken.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("b"))
    speaking = best.select(F.col("dir").alias("above"), F.col("b.own_license").alias("inherited_license"))
    dirs = found.select("dir").distinct()
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    above = dirs.withColumn("k", F.explode(F.sequence(F.lit(0), depth))).withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("k")), "/"))
    nearest = above.join(speaking, "above").groupBy("dir").agg(F.max(F.struct("k", "above", "inherited_license")).alias("n"))
    per_dir = nearest.select("dir", F.col("n.inherited_license").alias("inherited_license"), F.col("n.above").alias("inherited_from"))
    out = found.join(per_dir, "dir", "left")
    return out.select(id_col, "path", "own_license", "own_score", "inherited_license", "inherited_from",
                      F.coalesce("own_license", "inherited_license").alias("license"))


def stand_in_path() -> str:
    """The given table has no paths: source / thousands of ids / hundreds of ids / id, as a tree of four levels."""
    return "concat_ws('/', coalesce(source, 'none'), cast(doc_id div 1000 as string), cast(doc_id div 100 as string), coalesce(cast(doc_id as string), ''))"


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").withColumn("path", F.expr(stand_in_path())))
