"""Operator 6: toxicity by a weighted finite-state pattern grammar.

Words are read by a lexical transducer into six symbols: insult, threat, target,
negation, report and other. Clauses (cut at . ! ? ; and line feeds) of symbols are
read by transducers given as tables, states x symbols. A symbol carries marks, and
each transducer passes symbols on, adding its mark to insults and threats:

* *target* (run in both directions): "aimed", a target stands within reach;
* *negation*: "negated", a negation stands shortly before;
* *report*: "reported", a verb of saying stands before it in the clause;
* *insult* and *threat*: "again", the clause had one before.

The transducers that read forwards are composed into one table, as products of
their states. The composed automaton is weighted: an arc that reads an insult or
threat has the weight of what it puts out, the symbol with its marks, learned
from the labels. A document's score is the logistic of the weights of its matches
(each kind counted with log(1 + n)).

Insult words are entries fixed below and stems learned from labels: a stem is
the longest start shared by words that stand in toxic training documents and
hardly in others. Weights are learned from the same rows, with ridge pull
towards starting weights. At most ``labelled.PER_CLASS`` rows of each class are
used to fit; their words are counted and their clauses read on executors, so the
driver gets frequent starts of words and a row of counts for each document, however
long texts are. Scoring reads every clause of every text.

Cases. Null and empty texts match nothing and get the score of no match. With
labels of one class or none the starting weights are used. Repeated rows get equal
scores. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled, tokens

THRESHOLD = 0.5
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP = range(7)
# Word lists of the grammar.
WORDS = {
    INSULT: "idiot moron stupid scum trash loser worthless pathetic disgusting clown imbecile dumbass",
    THREAT: "kill hurt destroy beat punch shoot stab töten schlagen vernichten tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours yourself u they them those he she du dich dir dein ihr euch tu te toi ton vous votre tú ti tus usted ustedes vosotros",
    NEGATION: "not no never nobody isn't aren't don't doesn't won't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún tampoco",
    REPORT: "said says say told tells called wrote claimed reported quoted sagt sagte sagten schrieb behauptete dit disait écrit affirme dijo dice dijeron escribió afirmó",
}
#: Marks, and the starting weights of what is put out: of marks that meet, the first in this list decides.
MARKS = ("reported", "negated", "aimed", "again")
START = {"insult": 2.0, "insult aimed": 2.5, "insult negated": 0.5, "insult reported": 0.8, "threat": 0.3, "threat aimed": 1.5, "threat negated": 0.0, "threat reported": 0.2}
BIAS = -2.5
REACH, SCOPE = 4, 3
#: Stems have this many characters, and this share and number of toxic documents among those that hold them.
STEM, PURE, SEEN = (4, 10), 0.97, 5


class Lexicon:
    """The lexical transducer: whole words and stems to symbols."""

    def __init__(self, stems: list[str]) -> None:
        self.stems = stems
        pairs = sorted((int(h), s) for s, words in WORDS.items() for h in _hash(words.split()))
        self.keys, self.symbols = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int8)
        self.by_length: dict[int, np.ndarray] = {}
        for s in stems:
            self.by_length.setdefault(len(s.encode()), []).append(s)
        self.by_length = {n: np.sort(_hash(x)) for n, x in self.by_length.items()}

    def __call__(self, t: tokens.Texts, w: tokens.Words, prefix: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.keys, w.hash), len(self.keys) - 1)
        out = np.where(self.keys[k] == w.hash, self.symbols[k], OTHER).astype(np.int8)
        for n, known in self.by_length.items():
            at = np.flatnonzero(w.end - w.start >= n)
            h = tokens.span_hash(prefix, w.start[at], w.start[at] + n)
            j = np.minimum(np.searchsorted(known, h), len(known) - 1)
            out[at[known[j] == h]] = INSULT
        return out


def _hash(words: list[str]) -> np.ndarray:
    column = pa.array(words, pa.string())
    t = next(tokens.chunks(column))
    return tokens.span_hash(tokens.prefix_hash(tokens.LOWER[t.data]), t.offsets[:-1], t.offsets[1:])


APOSTROPHE = tokens.NON_LETTER.copy()
APOSTROPHE[ord("'")] = False
CLAUSE_END = np.zeros(256, bool)
CLAUSE_END[list(b".!?;\n")] = True


@dataclass(frozen=True)
class Transducer:
    """``step[state, symbol]``: the next state; ``out[state, symbol]``: the symbol put out. A symbol is a number: kind times 16, and a bit for each mark. State 0 is the first."""

    step: np.ndarray
    out: np.ndarray

    def __call__(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for x in symbols:
            out.append(int(self.out[state, x]))
            state = int(self.step[state, x])
        return out

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one puts out. States are pairs."""
        n = len(other.step)
        pair = np.arange(len(self.step) * n)
        between = self.out[pair // n]
        return Transducer(self.step[pair // n] * n + other.step[(pair % n)[:, None], between], other.out[(pair % n)[:, None], between])


SYMBOLS = STOP << len(MARKS)


def transducer(states: int, step: Callable[[int, int], int], mark: str, active: Callable[[int], bool], on: tuple[int, ...] = (INSULT, THREAT)) -> Transducer:
    """The table of a transducer that marks ``on`` in its active states. ``step``: state and kind of symbol to the next state."""
    kind = np.arange(SYMBOLS) >> len(MARKS)
    table = np.array([[step(q, k) for k in range(STOP)] for q in range(states)])[:, kind]
    marked = np.array([active(q) for q in range(states)])[:, None] & np.isin(kind, on)[None, :]
    return Transducer(table, np.where(marked, np.arange(SYMBOLS) | 1 << MARKS.index(mark), np.arange(SYMBOLS)))


#: States count the symbols since the last target; the first state is "none within reach".
TARGETS = transducer(REACH + 1, lambda q, k: 1 if k == TARGET else (q + 1) % (REACH + 1) if q else 0, "aimed", lambda q: q > 0)
#: States count what is left of a negation's scope.
NEGATIONS = transducer(SCOPE + 1, lambda q, k: SCOPE if k == NEGATION else max(0, q - 1), "negated", lambda q: q > 0)
REPORTS = transducer(2, lambda q, k: int(q or k == REPORT), "reported", bool)
INSULTS = transducer(2, lambda q, k: int(q or k == INSULT), "again", bool, (INSULT,))
THREATS = transducer(2, lambda q, k: int(q or k == THREAT), "again", bool, (THREAT,))
#: The grammar: targets that follow are marked by the run backwards, the rest in one run of the composition.
GRAMMAR = TARGETS.then(NEGATIONS).then(REPORTS).then(INSULTS).then(THREATS)


def _name(symbol: int) -> str:
    marks = [m for b, m in enumerate(MARKS) if symbol >> b & 1]
    return " ".join(["insult" if symbol >> len(MARKS) == INSULT else "threat", *marks])


#: What the grammar can put out for an insult or a threat.
KINDS = [_name(k << len(MARKS) | m) for k in (INSULT, THREAT) for m in range(1 << len(MARKS))]
_PLACE = {k << len(MARKS) | m: i * (1 << len(MARKS)) + m for i, k in enumerate((INSULT, THREAT)) for m in range(1 << len(MARKS))}


def starting_weights() -> np.ndarray:
    """Of what a match carries the first mark of MARKS that START knows decides."""
    out = []
    for name in KINDS:
        word, *marks = name.split()
        out.append(next((START[f"{word} {m}"] for m in MARKS if m in marks and f"{word} {m}" in START), START[word]))
    return np.array(out)


def read(clause: list[int]) -> list[int]:
    """The clause's symbols with their marks."""
    symbols = [k << len(MARKS) for k in clause]
    return GRAMMAR(TARGETS(symbols[::-1])[::-1])


def matches(clause: list[int]) -> list[str]:
    """What the grammar finds in the symbols of one clause."""
    return [KINDS[_PLACE[x]] for x in read(clause) if x in _PLACE]


def counts(t: tokens.Texts, lexicon: Lexicon) -> np.ndarray:
    """Texts x kinds of match. Clauses without an insult or threat have no match and are passed over."""
    w = tokens.words(t, APOSTROPHE)
    symbol = lexicon(t, w, tokens.prefix_hash(tokens.LOWER[t.data]))
    ends = np.concatenate([[0], np.cumsum(CLAUSE_END[t.data])])
    clause = ends[w.start]
    out = np.zeros((len(t), len(KINDS)))
    hot = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    seen: dict[bytes, list[int]] = {}
    done = (-1, -1)
    for k in hot.tolist():
        d = int(w.doc[k])
        if done == (d, clause[k]):
            continue
        done = (d, clause[k])
        lo, hi = int(w.first[d]), int(w.first[d + 1])
        lo, hi = lo + np.searchsorted(clause[lo:hi], clause[k]), lo + np.searchsorted(clause[lo:hi], clause[k], side="right")
        key = symbol[lo:hi].tobytes()
        if key not in seen:
            seen[key] = [_PLACE[x] for x in read(symbol[lo:hi].tolist()) if x in _PLACE]
        np.add.at(out[d], seen[key], 1)
    return out


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(start, y, n): in how many texts of the batch a word begins so, for starts of STEM characters; start '' counts texts."""
    common.trim()
    for b in batches:
        found = [Counter(), Counter()]
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
            words = set(_words(text or ""))
            found[y].update({w[:n] for w in words for n in range(STEM[0], min(STEM[1], len(w)) + 1)} | {""})
        rows = [(k, y, n) for y in (0, 1) for k, n in found[y].items()]
        yield pa.RecordBatch.from_pydict({"start": pa.array([r[0] for r in rows], pa.string()), "y": pa.array([r[1] for r in rows], pa.int32()), "n": pa.array([r[2] for r in rows], pa.int64())})


def learn_stems(rows: DataFrame) -> list[str]:
    """Stems that stand in toxic texts of ``rows`` (text, y) and hardly in others.

    Starts are counted on executors. Only starts come back that are pure and
    frequent enough for chance not to find one among all of their length that stand in ``SEEN`` toxic texts; of those
    that begin alike the shortest counts, grown as long as (nearly) all go on alike.
    """
    n = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("all")
    starts = common.stash(rows.mapInArrow(_starts, "start string, y int, n long").groupBy("start").agg(*n), "op6_starts")
    total = starts.where("start = ''").first()
    if not total or not total["bad"]:
        return []
    share = min(max(total["bad"] / total["all"], 0.01), 0.9)
    sizes = starts.where((F.col("start") != "") & (F.col("bad") >= SEEN)).groupBy(F.char_length("start").alias("length")).agg(F.count("*").alias("kinds"))
    enough = F.greatest(F.lit(SEEN), F.ceil(F.log(100.0 * F.col("kinds")) / -math.log(share)))
    # A start in the SEEN-th part of a bounded sample's toxic texts at least: their number is bounded as the sample is, by its distinct words.
    pure = starts.withColumn("length", F.char_length("start")).join(F.broadcast(sizes), "length").where((F.col("bad") >= enough) & (F.col("bad") >= PURE * F.col("all"))).select("start", "bad")
    known = {r["start"]: r["bad"] for r in pure.collect()}
    common.drop(starts)
    return sorted({_grown(s, known) for s in known if s[:-1] not in known})


def _grown(stem: str, known: dict[str, int]) -> str:
    """The stem as long as (nearly) all texts that have it have one longer start."""
    most = known[stem]
    children: dict[str, list[str]] = {}
    for s in known:
        if s.startswith(stem) and len(s) > len(stem):
            children.setdefault(s[:-1], []).append(s)
    while stem in children:
        best = max(children[stem], key=lambda s: (known[s], s))
        if known[best] < 0.95 * most:
            break
        stem = best
    return stem


def _words(text: str) -> list[str]:
    raw = np.frombuffer(text.encode(), np.uint8)
    t = tokens.Texts(raw, np.array([0, len(raw)]), 0)
    w = tokens.words(t, APOSTROPHE)
    low = tokens.LOWER[raw].tobytes()
    return [low[a:b].decode("utf-8", "ignore") for a, b in zip(w.start.tolist(), w.end.tolist())]


def _features(stems: list[str]):
    """Matches of each text by kind, and its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        lexicon = Lexicon(stems)
        for b in batches:
            y = b.column("y")
            for t in tokens.chunks(b.column("text")):
                yield pa.RecordBatch.from_pydict({"x": pa.array([r.tobytes() for r in counts(t, lexicon).astype("<f4")], pa.binary()), "y": y.slice(t.row, len(t))})

    return run


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, per_class: int = labelled.PER_CLASS) -> dict:
    rows, sizes = labelled.sample(docs, labels, "toxic", folds, per_class)
    weights, bias = starting_weights(), BIAS
    if len(sizes) < 2:
        return {"stems": [], "weights": weights, "bias": bias}
    rows = common.stash(rows.where("text is not null").distinct(), "op6_rows")
    stems = learn_stems(rows)
    got = rows.mapInArrow(_features(stems), "x binary, y int").groupBy("x", "y").agg(F.count("*").alias("n")).orderBy("x", "y").toArrow()
    common.drop(rows)
    x = np.log1p(np.array([np.frombuffer(r, "<f4") for r in got["x"].to_pylist()], np.float64).reshape(-1, len(KINDS)))
    y, many = got["y"].to_numpy().astype(float), got["n"].to_numpy().astype(float)
    n = np.array([max(1, many[y == 0].sum()), max(1, many[y == 1].sum())])
    share = np.array([sizes[0], sizes[1]]) / (sizes[0] + sizes[1])
    c = (share / n)[y.astype(int)] * many  # the classes' true shares
    start = weights.copy()
    for _ in range(3000):
        d = (1 / (1 + np.exp(-(x @ weights + bias))) - y) * c
        weights = weights - 0.5 * (x.T @ d + 1e-3 * (weights - start))
        bias -= 0.5 * d.sum()
    return {"stems": stems, "weights": weights, "bias": float(bias)}


def scorer(model: dict):
    held: list[Lexicon] = []

    def score(text: pa.Array) -> pa.Array:
        common.trim()
        if not held:
            held.append(Lexicon(model["stems"]))
        out = [np.zeros(0)]
        for t in tokens.chunks(text):
            out.append(1 / (1 + np.exp(-(np.log1p(counts(t, held[0])) @ model["weights"] + model["bias"]))))
        return pa.array(np.concatenate(out), pa.float64())

    score.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    model = fit(docs, labels, folds)
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"), (common.fold("doc_id", folds) == 0).alias("held_out"))
    out = base.select("doc_id", "held_out", scorer(model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
