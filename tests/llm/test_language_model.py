"""The language model: seatings against exact distributions, scores against a plain recomputation."""

import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trustlake.llm import op3_language_model as lm
from trustlake.llm import pitman_yor, tokens


def numbers(d, most):
    """Generalised Stirling numbers, plainly."""
    s = np.zeros((most + 1, most + 1))
    s[0, 0] = 1
    for n in range(most):
        for t in range(n + 1):
            s[n + 1, t] += (n - d * t) * s[n, t]
            if t < most:
                s[n + 1, t + 1] += s[n, t]
    return s


def test_small_cells_are_drawn_from_their_conditional():
    c, d, new, more = 8, 0.5, 0.3, 0.05
    s = numbers(d, c)
    w = np.array([s[c, t] * math.prod(new + more * i for i in range(1, t)) for t in range(1, c + 1)])
    one = np.ones(40_000)
    got = pitman_yor.draw(np.full(40_000, c), new * one, more * one, d, np.random.default_rng(2))
    assert np.abs(np.bincount(got, minlength=c + 1)[1:] / 40_000 - w / w.sum()).max() < 0.01


def test_large_cells_follow_the_process():
    """Tables of c customers without data: E[T] of a Pitman-Yor restaurant."""
    c, d, theta, one = 200, 0.5, 2.0, np.ones(4000)
    got = pitman_yor.draw(np.full(4000, c), theta * one, d * one, d, np.random.default_rng(1))
    want = theta / d * (np.prod([(theta + d + i) / (theta + i) for i in range(c)]) - 1)
    assert abs(got.mean() - want) < 0.05 * want


def rising(theta, d, t):
    return math.prod(theta + d * i for i in range(1, t))


def test_the_posterior_of_a_tiny_corpus_is_exact(monkeypatch):
    """Two contexts, one parent: all table counts of all cells are enumerated, and the mean prediction is compared."""
    d, theta, dishes = 0.5, 1.0, 3
    cells = {(0, 0): 3, (0, 1): 1, (1, 0): 2, (1, 2): 2}
    s = numbers(d, 8)
    total, mean = 0.0, np.zeros((2, dishes))
    for ts in itertools.product(*[range(1, n + 1) for n in cells.values()]):
        below = np.zeros(dishes, int)
        for (_, w), t in zip(cells, ts):
            below[w] += t
        for us in itertools.product(*[range(1, c + 1) if c else [0] for c in below]):
            p = math.prod((1 / dishes) ** u for u in us) * rising(theta, d, sum(us)) / math.prod(theta + i for i in range(1, below.sum()))
            p *= math.prod(s[c, u] for c, u in zip(below, us))
            for x in (0, 1):
                t = [k for (c, _), k in zip(cells, ts) if c == x]
                p *= rising(theta, d, sum(t))
            p *= math.prod(s[n, t] for n, t in zip(cells.values(), ts))
            g = [(below[w] - d * us[w] + (theta + d * sum(us)) / dishes) / (theta + below.sum()) for w in range(dishes)]
            for x in (0, 1):
                n, t = sum(v for (c, _), v in cells.items() if c == x), sum(k for (c, _), k in zip(cells, ts) if c == x)
                for w in range(dishes):
                    own = cells.get((x, w), 0) - d * dict(zip(cells, ts)).get((x, w), 0)
                    mean[x, w] += p * (own + (theta + d * t) * g[w]) / (theta + n)
            total += p
    monkeypatch.setattr(pitman_yor, "resample", lambda *a: a[3:5])
    context, dish = np.array(list(cells)).T
    h = pitman_yor.Hierarchy(context, dish, np.array(list(cells.values())), [np.zeros(2, int)], dishes)
    got = h.averaged(50, 6000)
    assert np.allclose(got.sum(axis=1), 1, atol=1e-5)
    assert np.abs(got - mean / total).max() < 0.01


def test_tables_are_customers_of_the_parent():
    rng = np.random.default_rng(4)
    context, dish = np.divmod(np.arange(60), 10)
    h = pitman_yor.Hierarchy(context, dish, rng.integers(0, 200, 60), [np.array([0, 0, 1, 1, 1, 0]), np.array([0, 0])], 12)
    for _ in range(3):
        h.sweep()
        for level in h.levels:
            assert (level.t <= level.count).all() and (level.t[level.count > 0] >= 1).all()
        for a, b in zip(h.levels, h.levels[1:]):
            assert a.t.sum() == b.count.sum()
    assert np.allclose(h.averaged(1, 2).sum(axis=1), 1, atol=1e-5)


def test_parameters_are_found_again():
    """Discount and strength of restaurants that were filled by the process itself."""
    rng, d, theta = np.random.default_rng(3), 0.6, 10.0
    customers, tables, cells = [], [], np.zeros((65, 65), int)
    for _ in range(300):
        sizes = []
        for n in range(64):
            u = rng.random() * (n + theta)
            if u < theta + d * len(sizes):
                sizes.append(1)
            else:
                w = np.array(sizes) - d
                sizes[rng.choice(len(sizes), p=w / w.sum())] += 1
        customers.append(64)
        tables.append(len(sizes))
        for n in sizes:  # each table a dish of its own
            if n <= 64:
                cells[n, 1] += 1
    got = (0.3, 1.0)
    for _ in range(20):
        got = pitman_yor.resample(np.array(customers), np.array(tables), cells, *got, rng)
    assert abs(got[0] - d) <= 0.11 and got[1] in (3, 10, 30)


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choice(words) if rng.random() < 0.9 else f"rare{rng.randrange(10**6)}" for _ in range(rng.randrange(60)))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, "W1 w2\tw3"), (202, "other text w1 w1 w1"), (None, "w5 w6 w7")]


def test_tokens_arrive_as_they_are():
    """Numbers that travel give back every token with its context and text, and every word's spelling."""
    t = next(tokens.chunks(pa.array([text for _, text in corpus()]), 1 << 30))
    w = tokens.words(t)
    u, n = np.unique(w.hash, return_counts=True)
    often = u[np.argsort(-n)][:12]
    plain = type("Plain", (), {"end": 0.0, "__call__": lambda self, d, a, z: (z - a).astype(float)})()
    length = dict(zip(w.hash.tolist(), (w.end - w.start).tolist()))
    g = lm.Gathered(lm.Known(often, 4, np.array([0, *[length[h] for h in often.tolist()]], float)), plain, 9, True)
    g.add(t, np.arange(len(t)) + 5)
    spell = {0: 0} | {int(g.known.numbers(np.array([h], np.uint64))[0]): k for h, k in length.items()}
    got = {}
    for r in g.out().to_pylist():
        v = lm.opened(r, g.known.spells)
        assert r["base"] == 5 and [spell[x] for x in v["words"].tolist()] == v["spells"].tolist()
        for x, c, i, times in zip(np.repeat(v["words"], v["sizes"]).tolist(), v["contexts"].tolist(), v["texts"].tolist(), v["times"].tolist()):
            got[x, c, i] = got.get((x, c, i), 0) + times
    want = {}
    for key in zip(*(x.tolist() for x in lm.stream(t, g.known))):
        want[key] = want.get(key, 0) + 1
    assert got == want


@pytest.mark.parametrize("small", [False, True])
def test_scores_follow_from_cells_and_samples(spark, tmp_path, monkeypatch, small):
    """``small``: few known contexts, few heavy words, many buckets: every way a token can go."""
    if small:
        for name, value in {"KNOWN": 12, "HEAVY": 4, "SPLIT": 3, "BUCKET": 900}.items():
            monkeypatch.setattr(lm, name, value)
    spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    m = lm.fit(base.where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2).select("row", "text"))
    assert len(m.samples) == lm.SAMPLES and (m.buckets > 3) == small
    cells, words = {}, {}
    for r in m.cells.collect():
        c = {k: lm.unpack(r[k], kind) for k, kind in lm.CELL_KINDS.items()}
        own, at = c["p"].reshape(lm.SAMPLES, -1), 0
        for i, (w, n) in enumerate(zip(c["words"].tolist(), c["sizes"].tolist())):
            words[w] = own[:, i], float(c["spells"][i])
            for k in range(at, at + n):
                assert (w, int(c["contexts"][k])) not in cells
                cells[w, int(c["contexts"][k])] = int(c["n"][k]), int(c["sum_t"][k]) / lm.SAMPLES, int(c["t"][k])
            at += n
    last = m.samples[-1]
    for x in range(len(last.n)):
        mine = [v for (_, c), v in cells.items() if c == x]
        assert last.n[x] == sum(v[0] for v in mine) and last.t[x] == sum(v[2] for v in mine)
    far_n, far_t = {}, {}
    for (_, c), (n, t, _) in cells.items():
        if c >= int(lm.FAR):
            far_n[c], far_t[c] = far_n.get(c, 0) + n, far_t.get(c, 0) + t
    heavy = range(m.known.heavy + 1)
    want = []
    for i, text in corpus():
        t = next(tokens.chunks(pa.array([text or ""]), 1 << 30))
        word, context, _ = lm.stream(t, m.known)
        w = tokens.words(t)
        spell = np.append(m.spelling(tokens.LOWER[t.data], w.start, w.end), m.spelling.end)
        total = 0.0
        for x, c, sp in zip(word.tolist(), context.tolist(), spell.tolist()):
            n, tables, _ = cells.get((x, c), (0, 0.0, 0))
            ps = []
            for k, s in enumerate(m.samples):
                new = (s.theta0 + s.d0 * s.tables) * math.exp(np.float32(sp)) / (s.theta0 + s.customers)
                ps.append(s.heavy_p[x] if x in heavy else words[x][0][k] if x in words else new)
            if c < int(lm.FAR):
                total += math.log10(np.mean([(n - s.d * tables + (s.theta + s.d * s.t[c]) * q) / (s.theta + s.n[c]) for s, q in zip(m.samples, ps)]))
            else:
                d, theta = (np.mean([getattr(s, a) for s in m.samples]) for a in ("d", "theta"))
                total += math.log10((n - d * tables + (theta + d * far_t.get(c, 0)) * np.mean(ps)) / (theta + far_n.get(c, 0)))
        want.append((str(i), len(word), round(total, 4)))
    got = [(str(r["doc_id"]), r["n_tokens"], round(r["score"], 4)) for r in lm.score(docs).collect()]
    for g, w in zip(sorted(got), sorted(want)):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 2e-3
    assert len(got) == len(want)


def test_contexts_are_words_however_rare(spark):
    """What follows x depends on the word before it, though all are rare."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    ids = [i for i in range(1000) if fold(i) != 2]
    held = [i for i in range(1000) if fold(i) == 2][:2]
    rng = random.Random(9)
    fill = [f"zz{i:04d}" for i in range(1200)]
    texts = [" ".join(rng.sample(fill, 1200)) for _ in range(12)] + ["aaqq aaone", "aarr aatwo"] * 6
    rows = list(zip(ids, texts)) + [(held[0], "aaqq aaone"), (held[1], "aaqq aatwo")]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got[held[0]] > got[held[1]] + 0.5


def rare_contexts(spark):
    """Contexts with many words after each, some of them often, beside a few frequent words."""
    rng = random.Random(6)
    rows = [" ".join(x for _ in range(40) for x in (f"often{rng.randrange(4)}", f"c{rng.randrange(40)}", f"w{min(rng.randrange(60), rng.randrange(60))}")) for _ in range(150)]
    return spark.createDataFrame(list(enumerate(rows)), "row long, text string").repartition(3)


def cells_of(m):
    return {r["bucket"]: {k: lm.unpack(r[k], kind) for k, kind in lm.CELL_KINDS.items()} for r in m.cells.collect()}


def test_cells_of_rare_contexts_meet_their_whole_restaurant(spark, monkeypatch):
    """What a sweep is told of contexts that are not known to all, against the cells of all buckets."""
    for name, value in {"KNOWN": 6, "HEAVY": 2, "SPLIT": 3, "BUCKET": 9000, "PART": 3}.items():
        monkeypatch.setattr(lm, name, value)
    m = lm.fit(rare_contexts(spark))
    assert m.buckets > 5 and m.parts > 1
    cells, tables, customers = cells_of(m), {}, {}
    for c in cells.values():
        for x, n, t in zip(c["contexts"].tolist(), c["n"].tolist(), c["t"].tolist()):
            tables[x], customers[x] = tables.get(x, 0) + t, customers.get(x, 0) + n
    said, seen = lm._exchange(m, False), 0
    for bucket, c in cells.items():
        got = lm._heard(c, [r.asDict() for r in said.where(f"what = 0 AND bucket = {bucket}").collect()], m.parts)
        at = np.flatnonzero((c["contexts"] >= lm.FAR) & (c["n"] > 1))
        assert got.tolist() == [tables[x] - t for x, t in zip(c["contexts"][at].tolist(), c["t"][at].tolist())]
        seen += len(got)
    assert seen > 500
    for counted, sizes in ((m.far_n, customers), (m.far_t, tables)):
        u, n = np.unique([v for x, v in sizes.items() if x >= int(lm.FAR)], return_counts=True)
        assert dict(zip(*(x.tolist() for x in lm.tally(*counted)))) == dict(zip(u.tolist(), n.tolist()))


def test_tables_do_not_depend_on_which_contexts_are_known(spark, monkeypatch):
    """Cells of rare contexts get as many tables as when every context is known to all."""
    docs, got = rare_contexts(spark), []
    for known in (1 << 18, 6):
        monkeypatch.setattr(lm, "KNOWN", known)
        m = lm.fit(docs, 4, 6)
        got.append((sum(float(c["sum_t"][c["n"] > 1].sum()) for c in cells_of(m).values()) / 6, np.mean([s.d for s in m.samples])))
    assert abs(got[0][0] - got[1][0]) < 0.05 * got[0][0] and abs(got[0][1] - got[1][1]) < 0.11
