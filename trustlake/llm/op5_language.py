"""Operator 5: language identification by segmentation-marginalised unigrams.

Each language has a distribution over the pieces of a fixed public vocabulary.
A text's likelihood in a language is the sum over *all* segmentations of its
words (runs of letters) into pieces (forward algorithm). Distributions are learned by
expectation maximisation from unit counts: the expected number of times a piece
is used, over all segmentations of all training units, again and again until the
likelihood of the training words settles (``SETTLED``, ``ROUNDS`` at most).

Cases. Null text or text without a letter: language ``und``, score 0. Rows with
a null ``lang`` teach nothing. With no training rows at all every text is
``und``. Ties go to the alphabetically first language. Repeated rows get the
same answer; other columns are not read, whatever their names. A run of more
than 95 letters is read in units of 95.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens
from .lattice import MAX_UNIT, SPACE, Vocabulary, backward, forward, utf8

#: Multiplied into an edge for each character it spells, so sums stay near 1.
SCALE = 300.0
SMOOTH = 0.1
#: EM ends when a round gains less than this share of the log likelihood, or after so many rounds.
SETTLED, ROUNDS = 0.01, 6
_VOCAB: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCAB:
        _VOCAB[path] = Vocabulary(path)
    return _VOCAB[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def scaled_weights(v: Vocabulary, e, table: np.ndarray) -> np.ndarray:
    return v.weights(e.piece, table) * SCALE ** (e.end - e.start)[:, None]


def cut(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Lattice units of words, and the word each belongs to: words over MAX_UNIT - 1 letters are read in parts."""
    most = MAX_UNIT - 1
    if max(map(len, words), default=0) <= most:
        return [SPACE + w for w in words], np.arange(len(words))
    units, of = [], []
    for k, w in enumerate(words):
        for i in range(0, len(w), most):
            units.append(SPACE + w[i : i + most])
            of.append(k)
    return units, np.array(of)


def loglik(v: Vocabulary, words: list[str], table: np.ndarray) -> np.ndarray:
    """log of the sum over segmentations, words x languages."""
    out = np.zeros((len(words), table.shape[1]))
    for lo in range(0, len(words), 3000):
        units, of = cut(words[lo : lo + 3000])
        e = v.edges(units)
        z = forward(e, scaled_weights(v, e, table))[e.last]
        n = np.fromiter(map(len, units), np.float64, len(units))
        np.add.at(out, lo + of, np.log(np.maximum(z, 1e-300)) - n[:, None] * np.log(SCALE))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word) counts of a task; handed on whenever a million have gathered, so memory is bounded."""
    common.trim()
    parts: dict[str, list] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang in list(parts):
            _, n, word = tokens.merged(parts.pop(lang))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(n), pa.string()), "word": word, "n": pa.array(n)})

    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), object)
        for t in tokens.chunks(b.column("text")):
            w = tokens.words(t, tokens.NON_LETTER)
            own = langs[t.row : t.row + len(t)]
            for lang in set(own.tolist()):
                got = tokens.counted(t, w, pa.string(), pick=np.flatnonzero((own == lang)[w.doc]))
                parts.setdefault(lang, []).append(got)
                held += len(got[0])
        if held > 1_000_000:
            yield from out()
            held = 0
    yield from out()


def _expect(path: str, langs: list[str], table: np.ndarray):
    """E step over (lang, word, n) rows: expected uses of each (language, piece), summed within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        v, index = vocabulary(path), {x: i for i, x in enumerate(langs)}
        total = np.zeros((len(langs), len(v.pieces)))
        log = 0.0
        for b in common.arrow_rows(batches, 3000):
            units, of = cut(b.column("word").to_pylist())
            lang = np.array([index[x] for x in b.column("lang").to_pylist()])[of]
            n = b.column("n").to_numpy().astype(np.float64)[of]
            e = v.edges(units)
            unit = np.searchsorted(e.first, e.start, side="right") - 1
            w = np.take_along_axis(scaled_weights(v, e, table), lang[unit][:, None], axis=1)
            a, z = forward(e, w), backward(e, w)
            sums = np.maximum(a[e.last][:, 0], 1e-300)
            log += float((n * (np.log(sums) - np.fromiter(map(len, units), np.float64, len(units)) * np.log(SCALE))).sum())
            use = (a[e.start] * w * z[e.end])[:, 0] / sums[unit] * n[unit]
            whole = e.piece >= 0
            total += np.bincount(lang[unit][whole] * np.int64(total.shape[1]) + e.piece[whole], use[whole], total.size).reshape(total.shape)
            lone = np.flatnonzero(~whole)
            if len(lone):
                byte, there = utf8(-1 - e.piece[lone])
                k, place = np.nonzero(there)
                np.add.at(total, (lang[unit[lone]][k], v.byte_ids[byte[k, place]]), use[lone][k])
        li, pi = np.nonzero(total)
        # The log likelihood travels as piece -1.
        yield pa.RecordBatch.from_pydict({"l": pa.array(np.append(li, 0), pa.int32()), "p": pa.array(np.append(pi, -1), pa.int32()), "x": pa.array(np.append(total[li, pi], log), pa.float64())})

    return run


def fit(docs: DataFrame, vocab_path: str, iterations: int = ROUNDS) -> dict:
    """Learn the distributions from (lang, text) rows, in at most so many rounds.

    What reaches the driver is bounded by languages x vocabulary (32,000).
    """
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    counts = rows.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = common.stash(counts, "op5_words")
    tokens = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(tokens)
    v = vocabulary(vocab_path)
    table = np.full((len(v.pieces), len(langs)), 1.0 / len(v.pieces))
    before = -np.inf
    for _ in range(iterations if langs else 0):
        got = counts.mapInArrow(_expect(vocab_path, langs, table), "l int, p int, x double").groupBy("l", "p").agg(F.sum("x").alias("x")).toArrow()
        piece, lang, x = (got[c].to_numpy() for c in ("p", "l", "x"))
        use = np.full(table.shape, SMOOTH)
        use[piece[piece >= 0], lang[piece >= 0]] += x[piece >= 0]
        table = use / use.sum(axis=0)
        now = float(x[piece < 0].sum())
        if now - before < SETTLED * abs(now):
            break
        before = now
    common.drop(counts)
    total = sum(tokens.values()) or 1
    return {"langs": langs, "table": table, "prior": np.log(np.array([max(tokens[x], 1) / total for x in langs])) if langs else np.zeros(0), "path": vocab_path}


class Scorer:
    """Scores texts with a fitted model; one per Python worker, with a bounded cache of word scores."""

    #: Scores held, 8 bytes each.
    MOST = 2_400_000

    def __init__(self, model: dict) -> None:
        self.m, self.v = model, vocabulary(model["path"])
        self.known = np.zeros(0, np.uint64)
        self.scores = np.zeros((0, len(model["langs"])))

    def __call__(self, t: tokens.Texts) -> tuple[list[str], np.ndarray]:
        m, w = self.m, tokens.words(t, tokens.NON_LETTER)
        if not m["langs"]:
            return ["und"] * len(t), np.zeros(len(t))
        u, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        if (len(self.known) + len(u)) * len(m["langs"]) > self.MOST:
            self.known, self.scores = self.known[:0], self.scores[:0]
        fresh = np.flatnonzero(~np.isin(u, self.known, assume_unique=True))
        if len(fresh):
            words = tokens.strings(tokens.LOWER[t.data], w.start[at[fresh]], w.end[at[fresh]], pa.string()).to_pylist()
            known = np.concatenate([self.known, u[fresh]])
            order = np.argsort(known)
            self.known, self.scores = known[order], np.concatenate([self.scores, loglik(self.v, words, m["table"])])[order]
        x = tokens.sums(self.scores[np.searchsorted(self.known, u)][back], w.first) + m["prior"]
        best = x.argmax(axis=1)
        score = 1.0 / np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1)
        none = np.diff(w.first) == 0
        ascii_letters = tokens.sums(~tokens.NON_LETTER[t.data] & (t.data < 128), t.offsets)
        for i in np.flatnonzero(~none & (ascii_letters == 0)):
            none[i] = not any(map(str.isalpha, t.data[t.offsets[i] : t.offsets[i + 1]].tobytes().decode("utf-8", "replace")))
        return [("und" if e else m["langs"][k]) for k, e in zip(best.tolist(), none.tolist())], np.where(none, 0.0, score)


def predictor(model: dict):
    """An Arrow UDF text -> struct(lang_pred, score)."""
    held: list[Scorer] = []

    def predict(text: pa.Array) -> pa.Array:
        common.trim()
        if not held:
            held.append(Scorer(model))
        out: list[pa.Array] = []
        for t in tokens.chunks(text):
            lang, score = held[0](t)
            out.append(pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))

    predict.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(predict, "struct<lang_pred:string,score:double>")


def identify(docs: DataFrame, vocab_path: str | None = None, folds: int = 5, iterations: int = ROUNDS) -> DataFrame:
    """Predict every row's language, learning only from rows outside fold 0."""
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang", (common.fold("doc_id", folds) == 0).alias("held_out"))
    model = fit(base.where(~F.col("held_out")), vocab_path or default_path(), iterations)
    out = base.select("doc_id", "held_out", predictor(model)("text").alias("r"))
    return out.select("doc_id", "held_out", "r.lang_pred", "r.score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))
