"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult (with a weight), threat, target, negation, reported speech, other. Small transducers
read a clause's symbols side by side, some from its start and some from its end: whether a negation is in scope, whether
someone's words are reported, whether a target stands near, whether a threat has met its target, whether a word has another
beside it that it can be said of. What they tell of a position, put together, is the pattern that matches there: an insult at
a target, an insult said of something, a threat at a target; each plain, negated, reported or both. A clause's weight is that of
its matches together, each word once, and it counts under the pattern of the heaviest; a document's features are the weights of its
matched clauses. One word is no clause: it is read with what follows. A lexicon word alone matches nothing, nor does a threat without a target.
The lexicon of insults (whole words and stems) and the weights of the patterns are learnt from labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows to learn from, at most: those with the least hashes of their ids.
SAMPLE = 20_000
#: Lengths of stems.
STEMS = (4, 5, 6, 7)
#: A pattern needs a log-odds this many standard errors over 0 and this high; seeds need less.
SURE, SEED_SURE, LEAST = 3.2, 1.5, 2.0

SEEDS = frozenset("idiot moron stupid loser scum trash worthless pathetic disgusting clown fool dumb ugly hate idiota estúpido imbécil basura tonto crétin débile ordure dummkopf trottel abschaum arschloch".split())
THREATS = frozenset("kill murder destroy strangle töten umbringen vernichten matar destruir tuer détruire écraser".split())
TARGETS = frozenset("you your yours yourself he she him her they them these those people du dich dir ihr euch tú usted ustedes ellos vosotros tu toi vous eux".split())
NEGATIONS = frozenset("not no never neither nor isn aren don doesn didn nicht kein keine niemals nie nunca jamás tampoco ne pas jamais aucun".split())
REPORTS = frozenset("said says wrote writes claimed claims reported called quoted allegedly sagte schrieb behauptete nannte dijo escribió afirmó llamó dit écrivit affirma appela".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
_BREAKS = ".!?;\n"


class Transducer:
    """A deterministic automaton over word symbols. Its output for a symbol says whether the symbol stands in its context.

    ``opens`` are the symbols that open a scope of ``scope`` symbols; the first ``skip`` of them are not in it yet. Where ``at``
    is given, only that symbol meets the context, and closes it.
    """

    def __init__(self, opens: set[int], scope: int, skip: int = 0, at: int | None = None):
        self.opens, self.scope, self.skip, self.at = opens, scope, skip, at

    def step(self, state: int, symbol: int) -> tuple[int, bool]:
        """``state`` is how many symbols the scope still has."""
        met = 0 < state <= self.scope - self.skip and (self.at is None or symbol == self.at)
        after = self.scope if symbol in self.opens else 0 if met and self.at is not None else max(0, state - 1)
        return after, met


class Composed:
    """Transducers run together; product states are made when first met. The output has a bit per transducer."""

    def __init__(self, *parts: Transducer):
        self.parts = parts
        self.moves: dict[tuple, tuple[tuple, int]] = {}

    def read(self, symbols: Iterable[int]) -> list[int]:
        state, out = (0,) * len(self.parts), []
        for symbol in symbols:
            key = (state, symbol)
            if key not in self.moves:
                steps = [p.step(s, symbol) for p, s in zip(self.parts, state)]
                self.moves[key] = tuple(s for s, _ in steps), sum(1 << i for i, (_, met) in enumerate(steps) if met)
            state, context = self.moves[key]
            out.append(context)
        return out


#: Any other word of the clause can be what an insult is said of.
_HEADS = {OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT}
#: From a clause's start: negated, reported, after a target, after a word, a threat that meets its target. From its end: reported by what follows
#: ("..., he said"), before a target, before a word.
FORWARD = (Transducer({NEGATION}, 3), Transducer({REPORT}, 1000), Transducer({TARGET}, 6), Transducer(_HEADS, 1), Transducer({THREAT}, 4, at=TARGET))
BACKWARD = (Transducer({REPORT}, 3, skip=1), Transducer({TARGET}, 3), Transducer(_HEADS, 1))
AIMED, SAID_OF, THREATENED = range(3)
FEATURES = 3 * 4 + 3


class Grammar:
    """The transducers of both directions, and the pattern that their outputs make of a position."""

    def __init__(self):
        self.forward, self.backward = Composed(*FORWARD), Composed(*BACKWARD)

    def matches(self, clause: list[tuple[int, float, str]]) -> Iterator[tuple[int, int, float, str]]:
        """(pattern, context, weight, word) of each match in a clause of (symbol, weight, word); context: 1 negated, 2 reported."""
        symbols = [k for k, _, _ in clause]
        after = self.forward.read(symbols)
        before = self.backward.read(symbols[::-1])[::-1]
        for (symbol, weight, word), f, b in zip(clause, after, before):
            context = (f & 1) + 2 * (f >> 1 & 1 | b & 1)
            if symbol == INSULT:
                if f & 4 or b & 2:
                    yield AIMED, context, weight, word
                elif f & 8 or b & 4:
                    yield SAID_OF, context, weight, word
            elif f & 16:
                yield THREATENED, context, 1.0, word


@dataclass
class Model:
    """What was learnt. ``words`` and ``stems`` give weights; a word takes that of its most specific pattern."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = -4.0

    def insult(self, word: str) -> float:
        w = self.words.get(word)
        if w is not None:
            return w
        for n in reversed(STEMS):
            if len(word) > n and (w := self.stems.get(word[:n])) is not None:
                return w
        return 0.0


class Scorer:
    """A model with a memo of words' symbols."""

    MEMO = 300_000

    def __init__(self, model: Model):
        self.model, self.grammar = model, Grammar()
        self.seen: set[str] = set()
        self.hot: dict[str, tuple[int, float, str]] = {}

    def symbol(self, word: str) -> tuple[int, float, str]:
        w = self.model.insult(word)
        kind = INSULT if w > 0 else THREAT if word in THREATS else TARGET if word in TARGETS else NEGATION if word in NEGATIONS else REPORT if word in REPORTS else OTHER
        return kind, w or 1.0, word

    def features(self, text: str) -> np.ndarray:
        """Weights of matched clauses: by pattern and context, in the best clause, their number, and their share."""
        x = np.zeros(FEATURES)
        lowered = text.lower()
        words = set(_WORD.findall(lowered))
        new = words - self.seen
        if new:
            if len(self.seen) >= self.MEMO:
                self.seen.clear()
                self.hot.clear()
                new = words
            self.seen |= new
            self.hot |= {w: found for w in new if (found := self.symbol(w))[0] != OTHER}
        here = {w: self.hot[w] for w in words & self.hot.keys()}
        if not any(kind in (INSULT, THREAT) for kind, _, _ in here.values()):
            return x
        other = (OTHER, 1.0, "")
        clauses, clause = [], []
        for token in _TOKEN.findall(lowered):
            if token in _BREAKS:
                if len(clause) > 1:  # one word is read with what follows
                    clauses.append(clause)
                    clause = []
            else:
                clause.append(here.get(token, other))
        if len(clause) == 1 and clauses:
            clauses[-1] += clause
        elif clause:
            clauses.append(clause)
        matched, best = 0, 0.0
        for c in clauses:
            if not any(kind in (INSULT, THREAT) for kind, _, _ in c):
                continue
            found = sorted(self.grammar.matches(c), key=lambda m: (-m[2], m[1], m[0]))
            if found:
                weight = sum({word: w for _, _, w, word in found}.values())
                pattern, context = found[0][:2]
                x[pattern * 4 + context] += weight
                matched += 1
                best = max(best, weight)
        x[:-3] = np.log1p(x[:-3])
        x[-3:] = math.log1p(best), math.log1p(matched), matched / len(clauses)
        return x

    def score(self, text: str | None) -> float:
        z = float(self.features(text or "") @ self.model.weights) + self.model.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def patterns(text: str) -> set[str]:
    """A text's words (marked with a final $) and stems."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.add(w + "$")
        out.update(w[:n] for n in STEMS if len(w) > n)
    return out


def _odds(p: float, n: float, np_: float, nn: float) -> tuple[float, float]:
    """Smoothed log-odds of a pattern in toxic against other rows, and its standard errors over 0."""
    w = math.log((p + 0.5) / (np_ + 1)) - math.log((n + 0.5) / (nn + 1))
    return w, w / math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))


def _good(pattern: str, p: int, n: int, np_: int, nn: int) -> float:
    """The pattern's weight, or 0 if the evidence is too thin."""
    w, z = _odds(p, n, np_, nn)
    return w if w >= LEAST and z >= (SEED_SURE if pattern[:-1] in SEEDS else SURE) else 0.0


def held_out(key: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text divisible by 5 (a null id is as an empty one)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _counts(df: DataFrame, column: str, only: set[str] | None) -> DataFrame:
    """(pattern, n): rows that hold each pattern, combined per batch."""
    ddl = "pattern string, n long"
    schema = common.arrow_type(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                c = Counter()
                for t in b.column(0).slice(lo, 500).to_pylist():
                    found = patterns(t)
                    c.update(found & only if only is not None else found)
                yield common.to_batch({"pattern": list(c), "n": list(c.values())}, schema)

    return df.select(column).mapInArrow(common.lean(run), ddl).groupBy("pattern").agg(F.sum("n").alias("n"))


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method, with a penalty on the weights."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    ridge = np.append(np.full(x.shape[1], penalty), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from up to ``sample`` labelled rows outside the held-out fifth.

    Of rows that share an id the one whose text has the least hash teaches, so no more than ``sample`` rows are read. Only
    the sample's counts reach the driver: patterns that toxic rows hold often enough to be trusted, their counts, and per row the
    few words that match a pattern. Without labels of both kinds the model has no pattern and scores every text low.
    """
    spark = docs.sparkSession
    common.ship(spark)
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    first = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text")))
    rows = common.materialize(rows.groupBy("doc_id").agg(first.alias("text"), F.max(F.col("toxic") > 0).alias("toxic")).select("text", "toxic"), "labelled")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    np_, nn = sizes.get(True, 0), sizes.get(False, 0)
    if not np_ or not nn:
        return Model()
    enough = [next((n for n in range(2, np_ + 1) if _good(p, n, 0, np_, nn)), np_ + 1) for p in (next(iter(SEEDS)) + "$", "")]
    seed = F.expr("left(pattern, length(pattern) - 1)").isin(list(SEEDS))
    tried = _counts(rows.where("toxic"), "text", None).where(F.col("n") >= F.when(seed, enough[0]).otherwise(enough[1]))
    positive = {r.pattern: r.n for r in tried.collect()}
    hopeful = set(positive)
    negative = {r.pattern: r.n for r in _counts(rows.where("not toxic"), "text", hopeful).collect()}
    good = {p for p in hopeful if _good(p, positive[p], negative.get(p, 0), np_, nn)}
    model = _lexicon(_matches(rows, good), good, np_, nn)
    scorer_model = Model(model.words, model.stems)
    ddl = "toxic boolean, x array<double>"
    schema = common.arrow_type(ddl)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(scorer_model)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                yield common.to_batch({"toxic": part.column(1).to_pylist(), "x": [scorer.features(t).tolist() for t in part.column(0).to_pylist()]}, schema)

    seen = rows.mapInArrow(common.lean(features), ddl).collect()
    x, y = np.array([r.x for r in seen]), np.array([float(r.toxic) for r in seen])
    order = np.lexsort((*x.T, y))  # the sum's rounding doesn't hang on the order of tasks
    model.weights, model.bias = _fit(x[order], y[order])
    return model


def _matches(rows: DataFrame, good: set[str]) -> list[tuple[bool, list[str]]]:
    """(toxic, words that match a good pattern) of each row."""
    ddl = "toxic boolean, words array<string>"
    schema = common.arrow_type(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                found = [sorted(w for w in set(_WORD.findall(t.lower())) if w + "$" in good or any(w[:n] in good for n in STEMS if len(w) > n)) for t in part.column(0).to_pylist()]
                yield common.to_batch({"toxic": part.column(1).to_pylist(), "words": found}, schema)

    return [(r.toxic, r.words) for r in rows.mapInArrow(common.lean(run), ddl).where("size(words) > 0").collect()]


def _lexicon(matches: list[tuple[bool, list[str]]], good: set[str], np_: int, nn: int) -> Model:
    """Accepts patterns from the most specific on; words that an accepted one explains don't count for a shorter stem."""
    model = Model()
    open_ = [(t, set(w)) for t, w in matches]
    for n in (None, *reversed(STEMS)):
        of = (lambda w: w + "$") if n is None else (lambda w: w[:n] if len(w) > n else "")  # noqa: B023
        p, q = Counter(), Counter()
        for toxic, words in open_:
            (p if toxic else q).update({of(w) for w in words} & good)
        found = {x: w for x in p if (w := _good(x, p[x], q[x], np_, nn))}
        for x, w in found.items():
            if n is None:
                model.words[x[:-1]] = w
            else:
                model.stems[x] = w
        open_ = [(t, {w for w in words if of(w) not in found}) for t, words in open_]
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name``: a score (0 to 1) for each whole text; a null text is empty, and rows that repeat score alike.

    Other columns are never read. If one of them has the name already, underscores are put behind the new one's. An empty table
    stays empty.
    """
    name = common.free_name(name, docs.columns)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double"
    schema, at = common.arrow_type(kind), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                score = pa.array([scorer.score(t) for t in part.column(at).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, score], schema=schema)

    common.ship(docs.sparkSession)
    return docs.mapInArrow(common.lean(run), kind)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; the model learns from those of them that have labels."""
    name = common.free_name("toxicity", docs.columns)
    return scored(docs, train(docs, labels), name=name).where(F.col(name) < threshold).drop(name)


def op5_toxicity_grammar(spark, sf_dir: str) -> DataFrame:
    """All documents with their scores."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
