"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words become symbols (insult, threat, target, negation, speech, other). Four small weighted transducers rewrite the
symbols of a clause: the lexical one weighs insults and threats, negation and reported speech mark those in their reach and take
weight off, target marks those that have somebody to aim at and adds weight. They are composed into one
deterministic table once, whose arcs' weights are the sums of the parts' weights; a clause is one walk through it, and its weight the sum of
its arcs. Fitting on a bounded, documented sample of labelled rows replaces the composed arcs' weights, pulled towards
those of the parts; a document's score is the logistic function of its clauses' patterns under these weights. Beginnings of words
that tell toxic training rows which the grammar's own words miss from others extend the lexicon.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.langid import held_out

#: The grammar's own words, by symbol.
WORDS = {
    "INSULT": (
        "idiot idiots moron morons imbecile stupid dumb fool clown clowns loser losers scum trash garbage worthless pathetic "
        "disgusting filthy vermin bastard bitch asshole dumbass shithead cretin freak pig pigs coward scumbag "
        "idiota estúpido imbécil basura asqueroso idiote stupide imbécile ordure minable dégoûtant "
        "idiotisch dumm trottel abschaum widerlich wertlos erbärmlich"
    ).split(),
    "THREAT": "kill murder hurt destroy strangle stab shoot matar morir tuer mourir töten sterben umbringen".split(),
    "TARGET": (
        "you your you're u he she they them him her his their we us people everyone this that these those "
        "tú usted ustedes ellos ella él vosotros tu vous ils elle il eux du ihr sie er euch dich"
    ).split(),
    "NEGATION": "not no never isn't aren't wasn't don't doesn't didn't nobody none without nunca jamás pas jamais non nicht nie kein keine".split(),
    "SPEECH": "said says say told tells called calls wrote writes claims claimed quote quoted according dijo dice dit disait sagte sagt".split(),
}
SYMBOLS = ("OTHER", "INSULT", "THREAT", "TARGET", "NEGATION", "SPEECH", "END")
#: Words that a negation reaches ahead.
REACH = 3
#: Labelled rows that the fit takes, in expectation, chosen by the hash of their id. A bound of the fit, not of scoring.
TRAIN_ROWS = 20_000
#: Word beginnings learned from toxic rows that the grammar's own words miss: their lengths, the rows each must be in, its least log odds, and
#: the rows that one must explain beyond those learned before it: learning stops at the first that doesn't.
STEM, LEAST_ROWS, LEAST_ODDS, LEAST_GAIN = (3, 4, 5, 6, 7), 3, 3.0, 2
#: Weights of the parts' arcs before any label is seen: a bare or aimed insult or threat suffices, a negated or reported one hardly does.
INSULTS, THREATS, NEGATED, REPORTED, AIMED, AIMED_BACK = 4.0, 3.0, -2.0, -1.5, 1.0, 0.5

CLAUSE = regex.compile(r"[.!?;:\n]+")
WORD = regex.compile(r"\p{L}[\p{L}'’]*")


@dataclass
class Transducer:
    """A deterministic weighted transducer: (state, symbol) -> (state, symbol out, weight). State 0 starts; a missing arc copies the symbol and
    stays, with no weight."""

    states: int
    arcs: dict[tuple[int, str], tuple[int, str, float]] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def compose(self, other: Transducer, symbols: list[str]) -> Transducer:
        """First self, then other on what self gives out; weights add up."""
        out = Transducer(self.states * other.states)
        for (p, q), s in product(product(range(self.states), range(other.states)), symbols):
            p2, mid, one = self.step(p, s)
            q2, last, two = other.step(q, mid)
            out.arcs[p * other.states + q, s] = (p2 * other.states + q2, last, one + two)
        return out

    def alphabet(self, symbols: list[str]) -> list[str]:
        return list(dict.fromkeys([*symbols, *(out for _, out, _ in self.arcs.values())]))


def marks(symbol: str) -> bool:
    """Whether the symbol is an insult or threat, however marked so far."""
    return symbol.startswith(("INSULT", "THREAT"))


def lexical(symbols: list[str]) -> Transducer:
    return Transducer(1, {(0, "INSULT"): (0, "INSULT", INSULTS), (0, "THREAT"): (0, "THREAT", THREATS)})


def negation(symbols: list[str]) -> Transducer:
    """After a negation the next REACH words are in its scope; state k: k words of scope left."""
    t = Transducer(REACH + 1)
    for k in range(REACH + 1):
        for s in symbols:
            hit = k > 0 and marks(s)
            t.arcs[k, s] = (REACH if s == "NEGATION" else 0 if s == "END" else max(0, k - 1), f"{s}-negated" if hit else s, NEGATED * hit)
    return t


def speech(symbols: list[str]) -> Transducer:
    """After a verb of speech the rest of the clause is reported."""
    t = Transducer(2)
    for s in symbols:
        t.arcs[0, s] = (int(s == "SPEECH"), s, 0.0)
        t.arcs[1, s] = (int(s != "END"), f"{s}-reported" if marks(s) else s, REPORTED * marks(s))
    return t


def target(symbols: list[str]) -> Transducer:
    """An insult or threat behind a target in its clause is aimed; state 2: one came first, so a target behind it aims it."""
    t = Transducer(3)
    for s in symbols:
        for state in range(3):
            after = 0 if s == "END" else 1 if s == "TARGET" or state == 1 else 2 if marks(s) or state == 2 else 0
            aimed, back = marks(s) and state == 1, s == "TARGET" and state == 2
            t.arcs[state, s] = (after, f"{s}-aimed" if aimed else "AIMED-BACK" if back else s, AIMED * aimed + AIMED_BACK * back)
    return t


class Grammar:
    """The composed table: next state, pattern and weight for each state and symbol; patterns are numbered from 0, -1 is none."""

    def __init__(self, weights: np.ndarray | None = None):
        """weights: fitted ones, by pattern, that the arcs emitting the pattern have instead of the parts' sums."""
        symbols = list(SYMBOLS)
        machine = lexical(symbols)
        for make in (negation, speech, target):
            machine = machine.compose(make(machine.alphabet(symbols)), symbols)
        outs = sorted({out for _, out, _ in machine.arcs.values() if marks(out) or out == "AIMED-BACK"})
        self.patterns = outs
        self.index = {s: i for i, s in enumerate(symbols)}
        self.next = np.zeros((machine.states, len(symbols)), dtype=int).tolist()
        self.emit = np.full((machine.states, len(symbols)), -1).tolist()
        self.weight = np.zeros((machine.states, len(symbols))).tolist()
        for (state, s), (to, out, weight) in machine.arcs.items():
            k = self.index[s]
            self.next[state][k] = to
            self.weight[state][k] = weight
            if out in outs:
                self.emit[state][k] = outs.index(out)
                if weights is not None:
                    self.weight[state][k] = float(weights[outs.index(out)])

    def clause(self, words: list[str], lexicon: dict[str, int]) -> tuple[Counter, float]:
        """Patterns of one clause, with their counts, and the weight of its path."""
        state, found, total = 0, Counter(), 0.0
        for w in words:
            s = lexicon.get(w) or next((lexicon[w[:n] + "*"] for n in STEM if w[:n] + "*" in lexicon), 0)
            if (p := self.emit[state][s]) >= 0:
                found[p] += 1
            total += self.weight[state][s]
            state = self.next[state][s]
        return found, total

    def pattern_weights(self) -> list[float]:
        """The weight of the arcs that emit each pattern; all that emit one have the same, as its marks name the parts' weights."""
        of = {p: self.weight[state][s] for state, row in enumerate(self.emit) for s, p in enumerate(row) if p >= 0}
        return [of[p] for p in range(len(self.patterns))]


@dataclass
class ToxicityModel:
    lexicon: dict[str, int]  # word -> symbol number
    triggers: list[str]  # words without which no pattern can match
    weights: np.ndarray  # of features()

    def clauses(self, text: str, grammar: Grammar) -> list[tuple[str, Counter, float]]:
        """The clauses that match a pattern, and their weights. A text without a trigger is read once and no further."""
        low = text.lower()
        present = [w for w in self.triggers if w in low]
        out = []
        if present:
            for part in CLAUSE.split(low):
                if any(w in part for w in present):
                    found, weight = grammar.clause(WORD.findall(part), self.lexicon)
                    if found:
                        out.append((part.strip(), found, weight))
        return out

    def features(self, text: str, grammar: Grammar) -> tuple[np.ndarray, list[tuple[str, float]]]:
        """Per pattern: whether a clause matches it, and log of how many do; then a constant and log of matching clauses."""
        matched = self.clauses(text, grammar)
        n = len(grammar.patterns)
        counts = np.zeros(n)
        for _, found, _ in matched:
            for p, k in found.items():
                counts[p] += k
        return np.concatenate([counts > 0, np.log1p(counts), [1.0, math.log1p(len(matched))]]), [(c, w) for c, _, w in matched]


def prior(grammar: Grammar) -> np.ndarray:
    """Weights of features() before any label is seen: the parts' weights, composed."""
    first = grammar.pattern_weights()
    return np.array([*first, *[0.5] * len(first), -3.0, 0.5])


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Newton steps for logistic regression, pulled towards start."""
    w = start.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + pull * (w - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), gradient)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _lexicon(extra: list[str], grammar: Grammar) -> tuple[dict[str, int], list[str]]:
    lexicon = {w: grammar.index[s] for s, words in WORDS.items() for w in words}
    lexicon |= {f"{w}*": grammar.index["INSULT"] for w in extra}
    triggers = [w.rstrip("*") for w, s in lexicon.items() if s in (grammar.index["INSULT"], grammar.index["THREAT"])]
    return lexicon, [w for w in triggers if not any(v != w and v in w for v in triggers)]


def stems_of(text: str) -> set[str]:
    """The beginnings of a text's words, as candidates for the lexicon."""
    return {w[:n] for w in set(WORD.findall(text.lower())) for n in STEM if len(w) >= n}


def _stems(sample: DataFrame, base: ToxicityModel) -> list[str]:
    """Word beginnings that tell toxic rows which the base lexicon misses from rows that aren't toxic.

    They are taken greedily, the one that explains most of the rows left, while it explains LEAST_GAIN. All that is gathered is
    bounded by the sample.
    """

    def count(rows: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, c = Grammar(), Counter()
            for batch in batches:
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if rows == "missed" and toxic == 1 and not base.clauses(text or "", g):
                        c.update(stems_of(text or ""))
                    elif rows == "clean" and toxic != 1:
                        c.update(stems_of(text or "") & wanted.value)
                        c[""] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["stem", "n"])

        return sample.select("text", "toxic").mapInArrow(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))

    missed = {r["stem"]: r["n"] for r in count("missed").filter(F.col("n") >= LEAST_ROWS).collect()}
    if not missed:
        return []
    wanted = sample.sparkSession.sparkContext.broadcast(set(missed))
    clean = {r["stem"]: r["n"] for r in count("clean").collect()}
    rows = max(1, clean.get("", 0))
    total = max(missed.values())
    odds = {w: math.log((n + 0.5) / (total + 1)) - math.log((clean.get(w, 0) + 0.5) / (rows + 1)) for w, n in missed.items()}
    chosen = sample.sparkSession.sparkContext.broadcast({w for w, x in odds.items() if x >= LEAST_ODDS})

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar()
        for batch in batches:
            out = [
                sorted(stems_of(t or "") & chosen.value)
                for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if toxic == 1 and not base.clauses(t or "", g)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], names=["stems"])

    left = [set(r["stems"]) for r in sample.select("text", "toxic").mapInArrow(held, "stems array<string>").collect()]
    out: list[str] = []
    while left:
        gain = Counter(w for s in left for w in s)
        if not gain:
            break
        best = max(gain, key=lambda w: (gain[w], odds[w], -len(w), w))
        if gain[best] < LEAST_GAIN:
            break
        out.append(best)
        left = [s for s in left if best not in s]
    return out


def bounded(labels: DataFrame, most: int) -> DataFrame:
    """All rows if there are at most `most`, else so many in expectation, by the hash of doc_id."""
    million = 1 << 20
    share = min(million, million * most // max(1, labels.count()) + 1)
    return labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(million)) < int(share))


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on labelled(doc_id, text, toxic), null labels left out. Without rows, or with one label only, the prior stays."""
    grammar = Grammar()
    base = ToxicityModel(*_lexicon([], grammar), prior(grammar))
    sample = bounded(labelled.filter("toxic is not null").select("doc_id", "text", "toxic"), train_rows)

    model = ToxicityModel(*_lexicon(_stems(sample, base), grammar), prior(grammar))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct feature vectors with their labels and counts: few, as most texts match nothing."""
        g, c = Grammar(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c[model.features(text or "", g)[0].tobytes(), int(toxic)] += 1
        keys = list(c)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array([c[k] for k in keys], pa.int64())], names=["x", "y", "n"])

    got = sample.select("text", "toxic").mapInArrow(featurize, "x binary, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).collect()
    if len({r["y"] for r in got}) > 1:
        x = np.repeat(np.array([np.frombuffer(r["x"]) for r in got]), [r["n"] for r in got], axis=0)
        y = np.repeat(np.array([float(r["y"] == 1) for r in got]), [r["n"] for r in got])
        model.weights = logistic(x, y, model.weights)
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, clauses) for each row of docs(doc_id, text): the probability of the toxic label, and the clauses that matched, with
    their weights.

    Null and empty texts match nothing and get the score of such texts; texts of any length are read whole, one at a time. Repeated
    rows, ids that repeat with other texts and null ids pass through, each scored by its own text; equal texts have equal scores. Other
    columns are ignored, an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, g = sent.value, Grammar(sent.value.weights)
        for batch in batches:
            scores, clauses = [], []
            for text in batch.column(1).to_pylist():
                x, found = m.features(text or "", g)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ m.weights))))))
                clauses.append([{"clause": c, "weight": w} for c, w in found])
            kind = pa.list_(pa.struct([("clause", pa.string()), ("weight", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(clauses, kind)], names=["doc_id", "score", "clauses"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, clauses array<struct<clause: string, weight: double>>")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on labelled documents outside the held-out fold (crc32 mod 5 = 0), score all: doc_id, held_out, score, predicted."""
    sample = bounded(labels.filter("toxic is not null").filter(~held_out(0, 5)).select("doc_id", "toxic"), TRAIN_ROWS)
    # a bounded number of (doc_id, toxic): the texts stay where they are read
    model = train(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    out = score(docs, model).withColumn("held_out", held_out(0, 5))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
