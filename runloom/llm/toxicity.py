"""Toxicity (operator 8): a weighted finite-state pattern grammar over clauses.

Words are read as symbols of small classes: insult, threat, target, negation, reporting verb, quotation mark. A clause
(up to a sentence mark or line end) with an insult or threat is run through weighted finite-state transducers:
  ahead     reads from the clause's end: an insult or threat at most NEAR words before a target becomes an aimed one,
  target    the same for a target before it,
  insult    writes a mark for each insult, plain or aimed,
  threat    writes a mark for each threat, plain or aimed,
  negation  a negation at most NEAR words before turns the mark into a negated one,
  report    a reporting verb or an open quotation before turns it into a reported one, and weighs what is left.
The last five are composed into one machine, whose states are theirs in combination; ahead stands apart since it reads the other
way. An arc's weight is a vector with a place for each kind of mark; weights along a path and over the clauses of a text add
up. The score is a logistic function of log2(1 + sum) of each kind. Isolated words get no score of their own: only the
weights of the arcs that a clause takes count.

Word classes start from short fixed lists. The insult class is extended by words that the learning rows show far more
often in toxic than in other texts: at LEAST_RATIO times the rate, and more often than chance allows. The test asks how
likely so many of a word's texts are toxic if the word says nothing; it needs no share of all toxic texts, so that the
words of a rare language count by their own texts. The weights of the marks are fitted on the learning rows by maximum a
posteriori with the prior weights below (an aimed insult weighs more, a negated or reported one less). All labelled learning rows are learned from. Learning and
scoring read whole texts.

Cases: null or empty text has no marks and gets the score of a text without marks; labels that are null or neither 0
nor 1, and labels without a document, teach nothing; several labels of one document: 1 wins; without learning rows the
prior weights are used; repeated rows repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.catalog import query
from runloom.llm.common import fold, may_match, read, settle, steps, written

NEAR = 4
#: Learned insults: at LEAST_RATIO times the rate of other texts, and at most this share of them expected to be there by chance.
LEAST_RATIO, FALSE_SHARE = 15.0, 0.05

#: Fixed word classes.
INSULTS = ("idiot idiots moron morons scum trash worthless pathetic stupid loser losers clown clowns disgusting imbecile dumb "
           "fool bastard vermin filth idiota imbécil estúpido basura escoria asqueroso idioten dummkopf abschaum widerlich "
           "wertlos erbärmlich crétin débile ordure minable salaud").split()
THREATS = ("kill destroy hurt beat crush murder strangle töten umbringen vernichten tuer détruire frapper écraser matar "
           "destruir golpear aplastar").split()
TARGETS = ("you your yours yourself he she they them him her his their those these people we u ihr du dich euch sie er "
           "tu te vous ils elles toi él ella ellos ustedes vosotros").split()
NEGATIONS = "not no never nobody don't isn't aren't won't nicht kein keine nie niemals ne pas jamais nunca ningún".split()
REPORTS = ("said says say called calls wrote told claimed claims quoted according sagte sagt nannte schrieb dit disait appelé "
           "écrit dijo dice llamó escribió").split()

KINDS = ("insult", "aimed_insult", "threat_plain", "aimed_threat", "negated", "reported")
#: Classes of words, the aimed ones (i, k), and marks. The weight of an arc that weighs nothing.
SYMBOLS = (*".IKTNRQik", *KINDS)
NOTHING = (0,) * len(KINDS)
PRIOR = np.array([-3.0, 2.5, 3.5, 0.2, 3.0, 0.3, 0.3])  # of a text without marks, then of log2(1 + count) of each kind
PRIOR_STRENGTH = 0.5

LETTERS = re.compile(r"[^\W\d_]+")
WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n\"“”«»]")
ENDS = frozenset(".!?;\n")
QUOTES = frozenset("\"“”«»")


def grammar(insults: list[str]) -> dict[str, str]:
    """Symbol class of each word; the first class that lists a word has it."""
    out: dict[str, str] = {}
    for words, kind in ((insults, "I"), (INSULTS, "I"), (THREATS, "K"), (TARGETS, "T"), (NEGATIONS, "N"), (REPORTS, "R")):
        for w in words:
            out.setdefault(w, kind)
    return out


class Transducer(NamedTuple):
    """A deterministic weighted transducer: arcs of each state by the symbol read, as (next state, symbol written, weight)."""
    start: Hashable
    arcs: dict[Hashable, dict[str, tuple[Hashable, str, tuple[int, ...]]]]

    def run(self, symbols: Iterable[str]) -> tuple[list[str], list[int]]:
        """What is written, and the sum of the weights on the way."""
        state, out, total = self.start, [], [0] * len(KINDS)
        for symbol in symbols:
            state, written_symbol, weight = self.arcs[state][symbol]
            out.append(written_symbol)
            if weight is not NOTHING:
                total = [a + b for a, b in zip(total, weight, strict=True)]
        return out, total


def reached(start: Hashable, arcs_of: Callable) -> Transducer:
    """The transducer of all states that can be reached from the start."""
    arcs, ahead = {}, [start]
    while ahead:
        state = ahead.pop()
        if state not in arcs:
            arcs[state] = arcs_of(state)
            ahead += [to for to, _, _ in arcs[state].values()]
    return Transducer(start, arcs)


def rewriter(start: Hashable, step: Callable, weight: dict[str, tuple[int, ...]] | None = None) -> Transducer:
    """A transducer from a rule (state, symbol) -> (state, symbol written); weights by the symbol written."""
    def arcs_of(state: Hashable) -> dict:
        moves = {x: step(state, x) for x in SYMBOLS}
        return {x: (to, y, (weight or {}).get(y, NOTHING)) for x, (to, y) in moves.items()}
    return reached(start, arcs_of)


def compose(first: Transducer, then: Transducer) -> Transducer:
    """The transducer that writes what `then` writes for what `first` writes; weights add up."""
    def arcs_of(state: tuple) -> dict:
        out = {}
        for x, (to, y, weight) in first.arcs[state[0]].items():
            to_then, z, more = then.arcs[state[1]][y]
            both = weight if more is NOTHING else more if weight is NOTHING else tuple(a + b for a, b in zip(weight, more, strict=True))
            out[x] = ((to, to_then), z, both)
        return out
    return reached((first.start, then.start), arcs_of)


def numbered(machine: Transducer) -> Transducer:
    """The same with numbers for states."""
    number = {state: i for i, state in enumerate(machine.arcs)}
    return Transducer(number[machine.start], {number[s]: {x: (number[to], y, w) for x, (to, y, w) in arcs.items()} for s, arcs in machine.arcs.items()})


def near(symbol: str, change: dict[str, str]) -> Transducer:
    """Changes what stands at most NEAR symbols after the symbol. State: symbols read since then, NEAR for more or none."""
    def step(since: int, x: str) -> tuple[int, str]:
        return 0 if x == symbol else min(since + 1, NEAR), change.get(x, x) if since < NEAR else x
    return rewriter(NEAR, step)


def parts() -> list[Transducer]:
    """ahead, target, insult, threat, negation, report."""
    aim = {"I": "i", "K": "k"}

    def report(state: tuple[bool, bool], x: str) -> tuple[tuple[bool, bool], str]:
        told, quoted = state
        return (told or x == "R", quoted != (x == "Q")), "reported" if x in KINDS and (told or quoted) else x

    def write(marks: dict[str, str]) -> Transducer:
        return rewriter(0, lambda state, x: (state, marks.get(x, x)))

    one = {kind: tuple(int(k == kind) for k in KINDS) for kind in KINDS}
    return [near("T", aim), near("T", aim), write({"I": "insult", "i": "aimed_insult"}), write({"K": "threat_plain", "k": "aimed_threat"}),
            near("N", dict.fromkeys(KINDS, "negated")), rewriter((False, False), report, one)]


#: The machine that reads a clause from its end, and the composed one that reads what it wrote from the begin.
AHEAD, GRAMMAR = parts()[0], numbered(reduce(compose, parts()[1:]))


def clause_marks(symbols: list[str]) -> list[str]:
    """The marks that the grammar writes for a clause."""
    return [x for x in GRAMMAR.run(AHEAD.run(reversed(symbols))[0][::-1])[0] if x in KINDS]


def clause_weight(symbols: list[str]) -> list[int]:
    """Weight of a clause ('.' is any other word): how many marks of each kind the grammar finds in it."""
    return GRAMMAR.run(AHEAD.run(reversed(symbols))[0][::-1])[1]


class Scanner:
    """Sums of the clauses' weights of whole texts. Only clauses with an insult or threat word are read word by word."""

    def __init__(self, insults: list[str]):
        self.kind = grammar(insults)
        self.hot = {w for w, k in self.kind.items() if k in "IK"}

    def counts(self, text: str) -> tuple[int, ...]:
        text = text.lower()
        if self.hot.isdisjoint(LETTERS.findall(text)):
            return NOTHING
        total, done = NOTHING, 0
        for hit in LETTERS.finditer(text):
            if hit.start() < done or hit.group() not in self.hot:
                continue
            begin = max(text.rfind(c, done, hit.start()) for c in ENDS) + 1 or done
            end = min((e for c in ENDS if (e := text.find(c, hit.end())) >= 0), default=len(text))
            symbols = ["Q" if w in QUOTES else self.kind.get(w, ".") for w in WORDS.findall(text[begin:end])]
            total = tuple(a + b for a, b in zip(total, clause_weight(symbols), strict=True))
            done = end
        return total


def _learning(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the learning rows. Texts without a label are left out before the join, which shuffles the others at
    any size: the labels grow with the documents."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(fold("doc_id") != 0)
    y = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", "text").where("text is not null").where(fold("doc_id") != 0)
    return may_match(texts, known, "doc_id").join(y.hint("merge"), "doc_id").select("text", "toxic")


def _word_tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        seen: Counter[tuple[str, int]] = Counter()
        n: Counter[int] = Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            n[y] += 1
            seen.update((w, y) for w in {*re.findall(r"[^\W\d_]{3,}", text.lower())})
        rows = [*((w, y, c) for (w, y), c in seen.items()), *(("", y, c) for y, c in n.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["word", "toxic", "n"])


def _marks(insults: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = Scanner(insults)
    for batch in steps(batches, "text"):
        seen = Counter((*scan.counts(t), y) for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], ["marks", "n"])


def least_surprise(found: list[tuple[float, int]], tested: int) -> float:
    """The surprise (-log of a chance) from which words are taken, so that FALSE_SHARE of them at most is expected to be
    chance (Benjamini-Hochberg). found: surprise, words that have it; tested: words in all."""
    least, n = math.inf, 0
    for surprise, words in sorted(found, reverse=True):
        n += words
        if surprise >= math.log(tested / (FALSE_SHARE * n)):
            least = surprise
    return least


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[float]]:
    """(insults, weights). What reaches the driver: the learned words, the distinct pairs of text counts of words above
    the ratio, at most those words, and the sums of each step of the fit."""
    rows = written(_learning(docs, labels), "toxic-learning")
    words = written(rows.mapInArrow(_word_tally, "word string, toxic int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")), "toxic-words")
    total = words.where("word = ''").first()
    if total is None:
        return [], PRIOR.tolist()
    rate = ((F.col("a") + 0.5) / (total.a + 1.0)) / ((F.col("b") + 0.5) / (total.b + 1.0))
    share, texts = (total.a + 1.0) / (total.a + total.b + 2.0), F.col("a") + F.col("b")
    tested = words.where("word <> '' and a + b > 1")
    # Chernoff's bound of the binomial tail, exact for words in toxic texts only.
    surprise = F.col("a") * F.log(F.col("a") / (texts * share)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (texts * (1 - share)))).otherwise(0.0)
    found = tested.where((rate >= LEAST_RATIO) & (F.col("a") > texts * share)).withColumn("surprise", surprise)
    least = least_surprise([(r.surprise, r.n) for r in found.groupBy("a", "b").agg(F.first("surprise").alias("surprise"), F.count("*").alias("n")).collect()], tested.count())
    picked = found.where(F.col("surprise") >= least - 1e-9)
    insults = sorted(r.word for r in picked.select("word").collect())
    kinds = rows.mapInArrow(lambda it: _marks(insults, it), "marks array<int>, n long").groupBy("marks").agg(F.sum("n").alias("n"))
    return insults, fit(written(kinds, "toxic-marks"))


def _sums(w: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gradient and curvature of the likelihood at w, summed over a partition's distinct marks: one row."""
    k = len(w)
    total = np.zeros(k + k * k)
    for batch in batches:
        if batch.num_rows:
            marks = np.array(batch.column("marks").to_pylist(), float)
            x, y, c = np.column_stack([np.ones(len(marks)), np.log2(1 + marks[:, :-1])]), marks[:, -1], batch.column("n").to_numpy().astype(float)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            total += np.concatenate([x.T @ (c * (y - p)), ((x * (c * p * (1 - p))[:, None]).T @ x).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])


def fit(kinds: DataFrame) -> list[float]:
    """Weights by Newton steps on the log posterior of a logistic model with Gaussian prior around PRIOR. kinds: the marks of a
    text and behind them its label, n texts that have them."""
    w, k = PRIOR.copy(), len(PRIOR)
    for _ in range(50):
        at = w.copy()
        total = np.sum([r.sums for r in kinds.mapInArrow(lambda it: _sums(at, it), "sums array<double>").collect()], axis=0)  # noqa: B023
        curve = total[k:].reshape(k, k) + PRIOR_STRENGTH * np.eye(k)
        step = np.linalg.solve(curve, total[:k] - PRIOR_STRENGTH * (w - PRIOR))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def _judge(insults: list[str], weights: list[float], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    scan, w = Scanner(insults), np.array(weights)
    for batch in steps(batches, "text"):
        marks = np.log2(1 + np.array([scan.counts(t or "") for t in batch.column("text").to_pylist()], float))
        yield batch, 1 / (1 + np.exp(-np.clip(w[0] + marks @ w[1:], -30, 30)))
    settle()


def _keep(insults: list[str], weights: list[float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, scores in _judge(insults, weights, batches):
        yield batch.filter(pa.array(scores < 0.5))


def _score(insults: list[str], weights: list[float], id_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, scores in _judge(insults, weights, batches):
        yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])


def score(docs: DataFrame, insults: list[str], weights: list[float], id_col: str = "doc_id") -> DataFrame:
    """(id, text) -> id, score, predicted."""
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(id_col, "text").mapInArrow(lambda it: _score(insults, weights, id_col, it), schema)


def keep(docs: DataFrame, insults: list[str], weights: list[float]) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic."""
    return docs.mapInArrow(lambda it: _keep(insults, weights, it), docs.schema)


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, read(spark, sf_dir, "labels"))
    return score(docs, *model).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")
