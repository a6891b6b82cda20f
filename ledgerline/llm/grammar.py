"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer turns words into symbols (insult, threat, target, negation, report) with weights; it matches words by
prefixes, so that inflected forms are found.  It is composed with a clause transducer, itself the product of three
small machines: the scope of a negation, reported speech, and an address to somebody.  Reading a clause yields the
weights of its insults and threats by how they stand there (negated, reported, aimed at a target), sixteen kinds in all;
a document's score is a logistic function of these sums, not of isolated words.

Insults come from labelled rows (prefixes that toxic documents have and others lack); the words of the other classes are
fixed below.  How much each kind of clause counts is fitted on the same rows, of which there are at most LABELLED.
Null and empty texts have no clause and get the score of the bias alone.  Without toxic labels the prior weights hold.
Columns of the caller pass, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import append_columns, cut, pack, quoted
from ledgerline.llm.dsir import bounded_labels

LABELLED = 12_000
#: Tasks that the labelled rows are dealt to; a bounded number of rows needs no more.
TASKS = 24
#: A prefix needs this share of the toxic rows, this many of them, and this log ratio of rates.
LEAST_SHARE, LEAST_ROWS, LEAST_RATIO = 0.02, 4, 3.0
PREFIXES = range(3, 9)
SCOPE = 3
#: A lone match counts in full in a short text, and less the longer the text is.
LENGTH = 60
REMEMBERED = 400_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Fixed words of the classes that are not learned.
WORDS = {
    THREAT: "kill murder hurt destroy beat attack burn shoot stab töten umbringen schlagen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours yourself u du dich dir dein ihr euch tu te toi ton vous votre usted ustedes tú ti tus",
    NEGATION: "not no never n't cannot isn't aren't don't nicht kein keine nie pas jamais aucun nunca jamás ningún",
    REPORT: "said says quoted quote called reported wrote claims sagte sagt schrieb dit disait écrit dijo dice escribió",
}
KINDS = 16
#: Prior weights by kind (threat, negated, reported, aimed): what counts without labels.
PRIOR = np.array([1.0 * (0.4 if neg else 1) * (0.5 if rep else 1) * (1.3 if aim else 1) for _, neg, rep, aim in product((0, 1), repeat=4)])
PRIOR_BIAS = -4.0

_ENDS = b".!?;\n"
BYTES = bytes(
    10 if b in _ENDS else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 or b == 39 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def clauses(text: str | None) -> list[list[bytes]]:
    """The words of each clause, in lower case."""
    return [c.split() for c in (text or "").lower().encode().translate(BYTES).split(b"\n")]


@dataclass
class Lexicon:
    """Symbol and weight by word or by prefix; the heaviest matching prefix decides."""

    prefixes: dict[bytes, float]
    words: dict[bytes, int] = field(default_factory=lambda: {w.encode(): s for s, line in WORDS.items() for w in line.split()})
    known: dict[bytes, tuple[int, float]] = field(default_factory=dict)

    def __call__(self, word: bytes) -> tuple[int, float]:
        found = self.known.get(word)
        if found is None:
            weight = max((self.prefixes[p] for p in prefixes_of(word) if p in self.prefixes), default=0.0)
            found = (INSULT, weight) if weight else (self.words.get(word, OTHER), 1.0)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found


def prefixes_of(word: bytes) -> list[bytes]:
    """Prefixes of whole characters, and the word itself with a mark of its end."""
    if word.isascii():
        cut_ = [word[:k] for k in PREFIXES if k <= len(word)]
    else:
        text = word.decode(errors="replace")
        cut_ = [text[:k].encode() for k in PREFIXES if k <= len(text)]
    return [*cut_, word + b"$"]


def compose() -> dict[tuple[int, int], tuple[int, int | None]]:
    """The clause transducer: (state, symbol) -> (next state, kind without the target bit, or None).

    A state is (words left under a negation, reported or not, aimed or not), the product of three machines.
    """
    code = lambda neg, rep, aim: (neg * 2 + rep) * 2 + aim
    arcs = {}
    for neg, rep, aim, symbol in product(range(SCOPE + 1), (0, 1), (0, 1), range(6)):
        nxt = (SCOPE if symbol == NEGATION else max(0, neg - 1), int(rep or symbol == REPORT), int(aim or symbol == TARGET))
        out = ((int(symbol == THREAT) * 2 + int(neg > 0)) * 2 + rep) * 2 if symbol in (INSULT, THREAT) else None
        arcs[code(neg, rep, aim), symbol] = code(*nxt), out
    return arcs


class Grammar:
    def __init__(self, prefixes: dict[bytes, float]):
        self.lexicon, self.arcs = Lexicon(prefixes), compose()

    def sums(self, text: str | None) -> np.ndarray:
        """Weights by kind of clause, summed over the text's clauses, for each LENGTH words (and LENGTH more)."""
        out, lexicon, arcs, n = np.zeros(KINDS), self.lexicon, self.arcs, LENGTH
        for clause in clauses(text):
            n += len(clause)
            read = [lexicon(w) for w in clause]
            if not any(s == INSULT or s == THREAT for s, _ in read):
                continue
            state, found = 0, []
            for symbol, weight in read:
                state, kind = arcs[state, symbol]
                if kind is not None:
                    found.append((kind, weight))
            for kind, weight in found:
                # A threat without anybody it is aimed at is no threat.
                if kind < 8 or state & 1:
                    out[kind + (state & 1)] += weight
        return out * (LENGTH / n)


def learn_lexicon(rows: DataFrame, text: str = "text", label: str = "toxic") -> dict[bytes, float]:
    """Prefixes with their log ratio of rates in toxic and other rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = Counter(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = {w for c in clauses(t) for w in c}
                    (toxic if y else other).update({p for w in words for p in prefixes_of(w)})
        keys = list(toxic | other)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), pa.array([toxic[k] for k in part], pa.int64()), pa.array([other[k] for k in part], pa.int64())],
                names=["prefix", "a", "b"],
            )

    n_toxic, n = rows.agg(F.coalesce(F.sum(label), F.lit(0)), F.count("*")).first()
    if not n_toxic or n_toxic == n:
        return {}
    counted = rows.select(text, label).mapInArrow(count, "prefix binary, a long, b long").groupBy("prefix").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ratio = F.log((F.col("a") + 0.5) / (n_toxic + 1)) - F.log((F.col("b") + 0.5) / (n - n_toxic + 1))
    least = max(LEAST_ROWS, LEAST_SHARE * n_toxic) if n_toxic >= 2 * LEAST_ROWS else 2
    found = counted.where(F.col("a") >= least).select("prefix", "a", "b", ratio.alias("ratio")).where(F.col("ratio") >= LEAST_RATIO)
    # Each has LEAST_SHARE of the toxic rows: at most 1 / LEAST_SHARE times as many as an average row has prefixes.
    best = found.collect()
    rows_of = {bytes(r["prefix"]): (r["a"], r["b"]) for r in best}
    # A longer prefix with nearly the same toxic rows and fewer others takes the place of a shorter one.
    vague = set()
    for q, (a, b) in rows_of.items():
        vague.update(p for k in range(2, len(q)) if (p := q[:k]) in rows_of and a >= 0.8 * rows_of[p][0] and b <= 0.5 * rows_of[p][1] - 1)
    return {bytes(r["prefix"]): float(r["ratio"]) for r in best if bytes(r["prefix"]) not in vague}


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 400, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression pulled towards the prior weights; classes count alike."""
    w, b = PRIOR.copy(), PRIOR_BIAS
    if not y.any() or y.all():
        return w, b
    scale = np.maximum(np.sqrt((x**2).mean(axis=0)), 1.0)
    z, v = x / scale, w * scale
    prior, c = v.copy(), np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    c = 0.5 * c + 0.5  # between balanced and as they come
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ v + b, -30, 30)))
        g = c * (p - y)
        v -= (z.T @ g / len(y) + ridge * (v - prior))
        b -= g.mean()
        v = np.maximum(v, 0.0)
    return v / scale, float(b)


@dataclass
class Model:
    prefixes: dict[bytes, float]
    weights: np.ndarray
    bias: float


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", most: int = LABELLED) -> Model:
    """Learns from at most `most` labelled ids and all their rows, none of them held out."""
    known = bounded_labels(labels.select(key, "toxic"), "toxic", key, most).select(F.col(key).alias("_k"), F.col("toxic").cast("long").alias("_toxic"))
    rows = docs.select(quoted(key).alias("_id"), quoted(text).alias("_text")).join(F.broadcast(known), F.col("_id") == F.col("_k"))
    rows = cut(rows.select("_k", "_text", "_toxic").repartition(TASKS), "toxic-rows")
    prefixes = learn_lexicon(rows, "_text", "_toxic")
    # An id in many rows counts once, by its means (decimal, so that the order of rows doesn't matter).
    means = F.array(*(F.avg(F.col("_kinds")[i].cast("decimal(28,12)")).cast("double") for i in range(KINDS)))
    seen = sums(rows, prefixes, "_text").groupBy("_k", "_toxic").agg(means.alias("_kinds")).orderBy("_k").collect()  # at most `most` rows
    x = np.array([r["_kinds"] for r in seen]) if seen else np.zeros((0, KINDS))
    return Model(prefixes, *(fit(x, np.array([r["_toxic"] for r in seen], float)) if seen else (PRIOR, PRIOR_BIAS)))


def sums(rows: DataFrame, prefixes: dict[bytes, float], text: str) -> DataFrame:
    """rows with `_kinds` in place of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(prefixes)

    def make(values) -> Iterator[list[tuple]]:
        grammar = Grammar(shared.value)
        for batch in values:
            yield [(grammar.sums(t),) for t in batch]

    return append_columns(rows, F.col(text), T.StructType([T.StructField("_kinds", T.ArrayType(T.DoubleType()))]), make, gone=[text])


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`doc` (the columns `carry` of docs, all by default) with score (0 to 1) and predicted (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(values) -> Iterator[list[tuple]]:
        own = shared.value
        grammar = Grammar(own.prefixes)
        for batch in values:
            z = np.clip(np.array([grammar.sums(t) for t in batch]) @ own.weights + own.bias, -30, 30)
            yield [(float(p), int(p >= 0.5)) for p in 1 / (1 + np.exp(-z))]

    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return append_columns(pack(docs, carry, own_text=text), F.col("own_text"), added, make, gone=["own_text"])
