"""The operators against brute force, on small tables with the cases that tables hold."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trustlake.llm import lattice, op1_quality, op2_packing, op3_language_model, op4_jaccard, op5_language, op6_toxicity, op7_suffix, op8_sampling, op9_fingerprint, op10_topk, registry, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus():
    """Documents with null and empty texts, copies, near copies, shared passages, long words, odd characters."""
    rng = random.Random(5)
    en = ["the", "of", "and", "river", "stone", "walking", "Lantern.", "quiet,", "under", "bridge"] + [f"{a}{b}ing" for a in "bcdfgh" for b in ("al", "or", "un")]
    de = ["der", "und", "nicht", "Straße", "für", "schön,", "über"] + [f"ge{a}{b}ung" for a in "bcdfgh" for b in ("el", "or", "un")]
    passage = sentence(rng, 30, en)
    out = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        text = sentence(rng, rng.randint(1, 120), de if lang == "de" else en)
        if i % 7 == 0:
            text += "\n" + passage + " tail" + str(i)
        out.append((i, text, lang, f"s{i % 4}"))
    base = out[10][1]
    for k in range(6):  # near copies and copies
        words = base.split(" ")
        if k % 2:
            words[k * 3 % len(words)] = f"edit{k}"
        out.append((100 + k, " ".join(words), "en", "copy"))
    out += [(200, None, "en", "x"), (201, "", "en", "x"), (202, " \n\t ", None, "x"), (203, "12 34 !!", "en", None), (204, "a", "en", "x"), (205, "A b  C d", "en", "x"), (206, "a b c d", "en", "x"), (207, "x" * 300 + " <|endoftext|> ▁▁ éé 你好 😀  end ", "en", "x"), (208, "A B\x1cc\x85d", None, "x"), (10, "the repeated id with other words here", "en", "x"), (11, out[11][1], "en", "s3")]
    return [(*r, len(r[1] or "")) for r in out]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs")) + "/t"
    # Extra columns whose names clash with those that the operators use inside.
    extra = {c: F.lit("x") for c in ("score", "row", "block", "order", "kept", "n", "word", "node", "part", "h")}
    spark.createDataFrame(ROWS, SCHEMA).withColumns(extra).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(r[0], int(len(r[1] or "") > 60), int("river" in (r[1] or ""))) for r in ROWS] + [(3, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none")) + "/t"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def fold(i, k):
    return zlib.crc32(str(i).encode()) % k


def test_words_are_exact():
    texts = [r[1] for r in ROWS]
    for t in tokens.chunks(pa.array(texts, pa.string()), 500):
        w = tokens.words(t)
        low = tokens.LOWER[t.data].tobytes()
        for i in range(len(t)):
            got = [low[a:b] for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])]
            assert got == (texts[t.row + i] or "").encode().lower().split()


def test_hashes_tell_words_apart():
    words = sorted({w for r in ROWS for w in (r[1] or "").encode().lower().split()} | {a.encode() for a in ("ab", "ba", "abc", "acb", "aa", "aaa")})
    t = next(tokens.chunks(pa.array(words, pa.binary()), 1 << 30))
    assert len(set(tokens.span_hash(tokens.prefix_hash(t.data), t.offsets[:-1], t.offsets[1:]).tolist())) == len(words)


# -- 1, 6
@pytest.mark.parametrize("op, cut", [(op1_quality, 0.3), (op6_toxicity, 0.5)])
def test_classifiers(docs, labels, empty, op, cut):
    rows = op.classify(docs, labels).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) and r["held_out"] == (fold(r["doc_id"], 5) == 0)
    assert op.classify(empty, labels).count() == 0
    assert op.classify(docs, labels.where("false")).count() == len(ROWS)


def test_quality_gradient():
    rng = np.random.default_rng(0)
    m = op1_quality.Model(np.zeros(op1_quality.WIDTH), np.ones(op1_quality.WIDTH))
    m.p["o"], m.p["a"] = rng.normal(size=op1_quality.HIDDEN), rng.normal(size=op1_quality.ATTENTION)
    x, bag, y = rng.normal(size=(7, op1_quality.WIDTH)), np.array([0, 0, 0, 1, 1, 2, 2]), np.array([1.0, 0, 1])
    loss = lambda: float(np.mean([np.log1p(np.exp(-z if t else z)) for z, t in zip(m.forward(x, bag, 3)[-1], y)]))
    g = m.gradient(x, bag, y, np.ones(3))
    for k in ("W", "V", "U", "a", "o", "b"):
        i = tuple(0 for _ in m.p[k].shape)
        decay = 1e-4 * m.p[k][i] if k in ("W", "o") else 0
        m.p[k][i] += 1e-5
        up = loss()
        m.p[k][i] -= 2e-5
        down = loss()
        m.p[k][i] += 1e-5
        assert math.isclose((up - down) / 2e-5 + decay, g[k][i], rel_tol=1e-3, abs_tol=1e-7)


def test_quality_learns(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(("!!" if i % 2 else "") + rng.choice(["ab", "cd", "efg", "hij"]) for _ in range(200))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    got = op1_quality.classify(docs, labels).where("held_out").collect()
    assert got and all((r["score"] > 0.5) == (r["doc_id"] % 2 == 0) for r in got)


def _plain_marks(clause):
    """What the grammar should find, word by word."""
    g, out = op6_toxicity, []
    for i, k in enumerate(clause):
        if k in (g.INSULT, g.THREAT):
            marks = [
                ("reported", g.REPORT in clause[:i]), ("negated", g.NEGATION in clause[max(0, i - g.SCOPE) : i]),
                ("aimed", g.TARGET in clause[max(0, i - g.REACH) : i] or g.TARGET in clause[i + 1 : i + 1 + g.REACH]), ("again", k in clause[:i]),
            ]
            out.append(" ".join(["insult" if k == g.INSULT else "threat", *[m for m, on in marks if on]]))
    return out


def test_quality_scores_follow_from_the_model(spark, monkeypatch):
    """The query's scores, recomputed passage by passage from the fitted weights; the fit stays within its bound of passages."""
    rng = random.Random(4)
    rows = [(i, " ".join(("!!" if i % 2 else "") + rng.choice(["ab", "cd", "Efg", "h1", "é#"]) for _ in range(rng.choice([3, 64, 65, 300])))) for i in range(90)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(90)], "doc_id long, quality int")
    m = op1_quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in op1_quality.classify(docs, labels).collect()}
    for i, text in rows:
        words = (text or "").encode().split()
        parts = [words[k : k + op1_quality.PASSAGE] for k in range(0, len(words), op1_quality.PASSAGE)] or [[]]
        x = []
        for part in parts:
            t = tokens.Texts(np.frombuffer(b" ".join(part), np.uint8), np.array([0, len(b" ".join(part))]), 0)
            x.append(op1_quality.encode(t)[0][0])
        h = [np.tanh((v - m.mean) * m.scale @ m.p["W"] + m.p["b"]) for v in x]
        a = np.array([(np.tanh(v @ m.p["V"]) / (1 + np.exp(-(v @ m.p["U"])))) @ m.p["a"] for v in h])
        a = np.exp(a - a.max()) / np.exp(a - a.max()).sum()
        z = sum(w * v for w, v in zip(a, h)) @ m.p["o"] + m.p["c"][0] + m.shift
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), abs_tol=1e-5)
    monkeypatch.setattr(op1_quality, "PASSAGES", 10)
    few = op1_quality.fit(docs, labels)
    assert few is not None and not np.allclose(few.mean, m.mean)


def test_grammar():
    g = op6_toxicity
    rng = random.Random(5)
    for _ in range(2000):
        clause = [rng.choice([g.OTHER, g.OTHER, g.INSULT, g.THREAT, g.TARGET, g.NEGATION, g.REPORT]) for _ in range(rng.randrange(12))]
        assert g.matches(clause) == _plain_marks(clause)
        symbols = [k << len(g.MARKS) for k in clause]
        one_by_one = symbols
        for transducer in (g.TARGETS, g.NEGATIONS, g.REPORTS, g.INSULTS, g.THREATS):
            one_by_one = transducer(one_by_one)
        assert g.GRAMMAR(symbols) == one_by_one
    assert len(g.GRAMMAR.step) == (g.REACH + 1) * (g.SCOPE + 1) * 8
    lexicon = g.Lexicon(["vequ"])
    (t,) = tokens.chunks(pa.array(["You are an idiot. Vequmo! he said you idiot", "fine", None], pa.string()))
    got = g.counts(t, lexicon)
    assert {k: n for k, n in zip(g.KINDS, got[0].tolist()) if n} == {"insult aimed": 1, "insult": 1, "insult reported aimed": 1}
    assert not got[1:].any()


def test_toxicity_scores_follow_from_matches(spark):
    """The query's scores, recomputed plainly: words by a regular expression, marks word by word, the fitted weights."""
    import re

    g, rng = op6_toxicity, random.Random(6)
    filler = ["river", "stone", "Maybe", "idiots", "été", "und", "you", "not", "said", "kill", "moron"]
    rows = []
    for i in range(300):
        words = [rng.choice(filler[:6] if i % 3 else filler) for _ in range(rng.randrange(40))] + (["you", f"blarg{rng.choice('abcd')}"] if i % 3 == 0 else [])
        rows.append((i, "".join(w + rng.choice([" ", " ", ", ", ". ", "! ", "\n"]) for w in words)))
    rows += [(400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    m = g.fit(docs, labels)
    assert "blarg" in m["stems"] and set(g.START) <= set(g.KINDS)
    known = {w: k for k, words in g.WORDS.items() for w in words.split()}
    got = {r["doc_id"]: r["score"] for r in g.classify(docs, labels).collect()}
    for i, text in rows:
        n = collections.Counter()
        for clause in re.split(r"[.!?;\n]", text or ""):
            words = [w.lower() for w in re.findall(r"[A-Za-z'\u0080-\U0010ffff]+", clause)]
            n.update(_plain_marks([g.INSULT if any(w.startswith(s) for s in m["stems"]) else known.get(w, g.OTHER) for w in words]))
        z = m["bias"] + sum(math.log1p(k) * m["weights"][g.KINDS.index(name)] for name, k in n.items())
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), abs_tol=1e-6)
    held = [i for i in range(300) if fold(i, 5) == 0]
    assert sum((got[i] >= 0.5) == (i % 3 == 0) for i in held) >= 0.9 * len(held)


def test_stems_are_learned(spark):
    rng = random.Random(1)
    rows = [(" ".join([rng.choice(["ab", "cd", "velo", "vero"]) for _ in range(9)] + ([f"zork{rng.choice('abcdef')}{rng.choice('ghij')}"] if i % 2 else [])), i % 2) for i in range(200)]
    assert op6_toxicity.learn_stems(spark.createDataFrame(rows, "text string, y int")) == ["zork"]


# -- 2
def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op2_packing.default_path())
    rows = op2_packing.pack(docs, size=64, open_windows=3, merge=2).collect()
    want = [tok.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in ROWS]
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], ids.tolist()))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    total = collections.Counter((r[0], tuple(w)) for r, w in zip(ROWS, want))
    got = collections.Counter()
    for (doc, n), parts in pieces.items():
        copies = sum(len(p) for _, p in parts) // n
        ids = [x for _, p in sorted(parts, key=lambda p: p[0]) for x in p]
        assert len(ids) == copies * n
        got[doc] += copies
        if copies == 1:
            assert total[doc, tuple(ids)] == 1
    assert got == collections.Counter(r[0] for r in ROWS)
    padding = sum(64 - n for parts in sequences.values() if (n := sum(x for _, x in parts)) & (n - 1))
    assert padding <= 0.1 * sum(map(len, want))
    assert op2_packing.pack(empty).count() == 0


def test_best_fit():
    w = op2_packing.Windows(10, 2, 1, 0)
    out = [p for n in (6, 7, 3, 4, 5) for p in w.place(n, n)]
    assert all(sum(x[1] for x in p) == 10 for p in out) and [[x[4] for x in p] for p in out] == [[7, 3], [6, 4]]
    assert list(w.place("long", 25)) != [] and len(w.free) <= 2


# -- 3
def test_base_score(docs, empty):
    c, ends = collections.Counter(), 0
    for i, text, *_ in ROWS:
        if fold(i, 7) != 2:
            c.update((text or "").encode().lower().split())
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    want = collections.Counter()
    for i, text, *_ in ROWS:
        w = (text or "").encode().lower().split()
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        want[i, fold(i, 7) == 2, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 6)] += 1
    rows = op3_language_model.score(docs).collect()
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 60]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert op3_language_model.score(empty).count() == 0


# -- 4
def test_jaccard(docs, empty):
    sets = []
    for i, text, *_ in ROWS:
        w = (text or "").encode().lower().split()
        sets.append((i, set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = collections.defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least[find(k)], i)
    want = collections.Counter((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))
    assert collections.Counter(map(tuple, op4_jaccard.join(docs).collect())) == want
    assert any(n > 1 for n in collections.Counter(w[2] for w in want).values())
    assert op4_jaccard.join(empty).count() == 0


# -- 5
def test_forward_sums_all_segmentations():
    v = op5_language.vocabulary(op5_language.default_path())
    table = np.random.default_rng(0).random((len(v.pieces), 2))

    def brute(unit):
        if not unit:
            return np.ones(2)
        total = sum(table[v.ids[unit[:k]]] * brute(unit[k:]) for k in range(1, len(unit) + 1) if unit[:k] in v.ids)
        if unit[0] not in v.ids:
            total = total + table[v.byte_ids[list(unit[0].encode())]].prod(axis=0) * brute(unit[1:])
        return total

    units = ["▁the", "▁walking", "▁straße", "▁q你😀", "▁"]
    e = v.edges(units)
    w = v.weights(e.piece, table)
    got, back = lattice.forward(e, w)[e.last], lattice.backward(e, w)[e.first]
    assert np.allclose(got, [brute(u) for u in units]) and np.allclose(got, back)


def test_language(docs, empty):
    rows = op5_language.identify(docs).collect()
    truth = {r[0]: r[2] for r in ROWS}
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS)
    for i in (200, 201, 202, 203):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 60]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in rows)
    assert op5_language.identify(empty).count() == 0
    assert {r["lang_pred"] for r in op5_language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_em_raises_the_likelihood_until_it_settles(spark, monkeypatch):
    """Rounds of EM against a plain one over all segmentations; each raises the likelihood of the training words."""
    v = op5_language.vocabulary(op5_language.default_path())
    words = ["river", "rivers", "stone", "ölö", "\U0001f600x"]
    units = ["▁" + w for w in words]
    n = [5, 3, 4, 2, 1]
    docs = spark.createDataFrame([(" ".join(w for w, k in zip(words[:4], n) for _ in range(k)), "en")], "text string, lang string")

    def ways(unit):
        if not unit:
            yield ()
        for k in range(1, len(unit) + 1):
            ids = [v.ids[unit[:k]]] if unit[:k] in v.ids else [int(x) for x in v.byte_ids[list(unit[0].encode())]] if k == 1 else None
            if ids:
                for rest in ways(unit[k:]):
                    yield (*ids, *rest)

    p, logs = np.full(len(v.pieces), 1 / len(v.pieces)), []
    for _ in range(4):
        use, log = np.full(len(v.pieces), op5_language.SMOOTH), 0.0
        for unit, k in zip(units[:4], n):
            found = list(ways(unit))
            w = np.array([np.prod(p[list(x)]) for x in found])
            log += k * math.log(w.sum())
            for x, share in zip(found, w / w.sum()):
                np.add.at(use, list(x), k * share)
        p = use / use.sum()
        logs.append(log)
    assert logs == sorted(logs)
    settled = op5_language.fit(docs, op5_language.default_path())["table"][:, 0]
    assert np.abs(settled - p).max() < 0.01
    monkeypatch.setattr(op5_language, "SETTLED", 0.0)
    assert np.allclose(op5_language.fit(docs, op5_language.default_path(), 4)["table"][:, 0], p, rtol=1e-6, atol=1e-12)
    byte, there = lattice.utf8(np.array([0x41, 0xE9, 0x20AC, 0x1F600, 0xD800]))
    assert [bytes(b[t].tolist()) for b, t in zip(byte.astype(int), there)] == [chr(c).encode("utf-8", "surrogatepass") for c in (0x41, 0xE9, 0x20AC, 0x1F600, 0xD800)]


# -- 7
def test_repeats(docs, empty):
    smallest = {}
    for i, text, *_ in sorted(ROWS, key=lambda r: r[0]):
        b = (text or "").encode()
        for s in range(len(b) - 49):
            smallest.setdefault(b[s : s + 50], i)
    want = collections.Counter()
    for i, text, *_ in ROWS:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if smallest[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        want[i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    got = op7_suffix.dedup(docs).collect()
    have = collections.Counter((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got)
    assert have == want and sum(w[2] for w in want) > 500
    assert op7_suffix.dedup(empty).count() == 0
    shuffled = op7_suffix.dedup(docs.repartition(5, "source"), ("doc_id", "lang"), scanned=False).collect()
    assert collections.Counter((r["doc_id"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in shuffled) == collections.Counter((w[0], w[4]) for w in want.elements())


def test_every_string_holds_an_anchor():
    rng = random.Random(8)
    text = bytes(rng.choice(b"ab \n") for _ in range(4000)) + b"z" * 300
    a = op7_suffix.Anchors(tokens.Texts(np.frombuffer(text, np.uint8), np.array([0, 900, 940, 4300]), 0))
    at = set(a.at.tolist())
    for lo, hi in ((0, 900), (940, 4300)):
        for s in range(lo, hi - 49):
            assert any(k in at for k in range(s, s + op7_suffix.SPAN))
    assert not [k for k in at if 900 <= k < 940]


# -- 8
def test_sampling_round_trip(docs, empty, spark):
    rows = op8_sampling.sample(docs)
    got = rows.collect()
    assert all(r["lossless"] for r in got) and len(got) == len(ROWS)
    back = op8_sampling.decode(rows).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in back) == collections.Counter((r[0], r[1] or "") for r in ROWS)
    again = op8_sampling.sample(docs.repartition(7)).collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in again) == collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got)
    assert [tuple(r["ids"]) for r in op8_sampling.sample(docs, seed=8).orderBy("doc_id").collect()] != [tuple(r["ids"]) for r in rows.orderBy("doc_id").collect()]
    assert op8_sampling.sample(empty).count() == 0


def test_sampling_follows_the_forward_sums():
    s = op8_sampling.Sampler(op5_language.default_path())
    n = 20_000
    column = pa.array([" walk"] * n)
    (t,) = tokens.chunks(column, 1 << 30)
    ids, begin = s(t, np.arange(n).astype(np.uint64))
    seen = collections.Counter(tuple(ids[begin[i] : begin[i + 1]].tolist()) for i in range(n))

    def all_ways(u):
        if not u:
            yield ()
        for k in range(1, len(u) + 1):
            if u[:k] in s.v.ids:
                yield from ((s.v.ids[u[:k]], *rest) for rest in all_ways(u[k:]))

    p = {w: float(np.prod(s.w[list(w), 0])) for w in all_ways("▁walk")}
    total = sum(p.values())
    assert set(seen) <= set(p)
    for w, x in p.items():
        x /= total
        assert abs(seen[w] / n - x) < 5 * math.sqrt(x / n) + 1e-4


# -- 9
def test_fingerprints(docs, empty, spark):
    got = op9_fingerprint.fingerprint(docs).collect()
    order = sorted(ROWS, key=lambda r: (-r[0], r[1] or ""))
    want = collections.Counter()
    for k, r in enumerate(order):
        a, b = r[1] or "", order[(k + 1) % len(order)][1] or ""
        m = len(a) // 3
        want[r[0], len(a), hashlib.sha256((a[: len(a) - m] + b[:m]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by = collections.defaultdict(set)
    texts = {r[0]: r[1] for r in ROWS}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] not in (10, 11):
            by[texts[r["doc_id"]] or ""].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by.values()) and by[""] == {""}
    assert op9_fingerprint.fingerprint(empty).count() == 0
    assert op9_fingerprint.fingerprint(docs.limit(1)).first()["near_next"] == 1.0


def test_fingerprint_likeness(spark):
    rng, rows, want = random.Random(6), [], []
    for n in (8, 40, 150, 600, 2000):
        for share in (0.1, 0.4, 0.9):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            cut = int(n * share)
            other = words[:cut] + [f"x{rng.randrange(10**6)}" for _ in range(n - cut)]
            x, y = ({tuple(w[i : i + 5]) for i in range(n - 4)} for w in (words, other))
            rows.append((" ".join(words), " ".join(other)))
            want.append(len(x & y) / len(x | y))
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    df = op9_fingerprint.with_fingerprint(op9_fingerprint.with_fingerprint(df, "a", "fa"), "b", "fb")
    got = [r[0] for r in df.select(op9_fingerprint.likeness(F.col("fa"), F.col("fb"))).collect()]
    assert max(abs(g - w) for g, w in zip(got, want)) < 0.2 and np.mean(np.abs(np.array(got) - want)) < 0.05


# -- 10
def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(9)] + [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 12), (2150, [float("inf")] * 12), (2200, [0.0] * 12), (2250, [0.5, -0.25]), (None, rows[0][1]), (2300, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("norm2", F.lit("x"))
    ok = [(i, [math.floor(256 * float(x)) for x in e] + [0] * (12 - len(e))) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q, e in ok:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(e, f)), i) for i, f in ok if i != q)[:5]
            want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    for part, block, seed in ((20_000, 2048, 2048), (50, 4, 8)):
        monkeypatch.setattr(op10_topk, "PART", part)
        monkeypatch.setattr(op10_topk, "QUERY_BLOCK", block)
        monkeypatch.setattr(op10_topk, "SEED", seed)
        assert sorted(map(tuple, op10_topk.top_k(v).collect())) == sorted(want)
    assert op10_topk.top_k(v.where("false")).count() == 0
    assert op10_topk.top_k(v.where("vec_id = 50")).count() == 0


def test_top_k_however_rows_are_dealt(spark, monkeypatch):
    """Equal lengths, one vec_id on a third of the rows, many more partitions than parts: no candidate is lost."""
    monkeypatch.setattr(op10_topk, "PART", 40)
    monkeypatch.setattr(op10_topk, "SEED", 8)
    rng = np.random.default_rng(5)
    e = rng.normal(size=(600, 8))
    e = (e / np.linalg.norm(e, axis=1, keepdims=True)).astype(np.float32)
    ids = [77 if i % 3 == 0 else i for i in range(600)]
    v = spark.createDataFrame(list(zip(ids, e.tolist())), "vec_id long, embedding array<float>").repartition(40)
    whole = np.floor(256 * e.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(600):
        if ids[q] % 50 == 0:
            s = sorted((-int(whole[q] @ whole[i]), ids[i]) for i in range(600) if ids[i] != ids[q])[:5]
            want += [(ids[q], k + 1, i, -x) for k, (x, i) in enumerate(s)]
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert sorted(map(tuple, op10_topk.top_k(v).collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_top_k_refuses_scores_beyond_a_long(spark):
    v = spark.createDataFrame([(50, [3e30, 1.0]), (51, [1.0, 1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(OverflowError):
        op10_topk.top_k(v)
    big = spark.createDataFrame([(50, [2.0**22, 1.0]), (51, [2.0**22, -1.0])], "vec_id long, embedding array<double>")
    assert op10_topk.top_k(big).collect() == [(50, 1, 51, 2**60 - 2**16)]


def test_registry():
    assert sorted(int(n.split("_")[0][2:]) for n in registry.queries()) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())
