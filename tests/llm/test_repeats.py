"""Removal of repeated strings: hot passages, blocks of one long text, segments, and shuffled texts, against brute force."""

import random

import numpy as np
import pytest

from trustlake.llm import op7_suffix, tokens


def brute(rows):
    smallest = {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (text or "").encode()
        for s in range(len(b) - 49):
            smallest.setdefault(b[s : s + 50], i)
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            least = smallest[b[s : s + 50]]
            if least is not None and (i is None or least < i):
                gone[s : s + 50] = True
        out.append((i, len(b), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


def table(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def removed(docs, **how):
    return sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in op7_suffix.dedup(docs, **how).collect()), key=repr)


def texts(rng, n):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    line = lambda k: " ".join(word() for _ in range(k))
    hot, other = line(40), line(25)
    return [(i, line(rng.randrange(30)) + hot + (line(9) + other if i % 3 == 0 else "") + line(rng.randrange(20))) for i in range(n)] + [(None, line(5) + hot), (n, None), (3, hot), (n + 1, other)]


@pytest.mark.parametrize("hot", [0, 1, 3, 64])
def test_a_passage_in_every_document(spark, tmp_path, monkeypatch, hot):
    """With ``hot`` 0 every shared anchor's strings go one by one, with 64 none's."""
    monkeypatch.setattr(op7_suffix, "BLOCK", 4)
    rows = texts(random.Random(hot), 60)
    want = brute(rows)
    assert sum(n for _, n, _ in want) > sum(len(k) for *_, k in want) + 5000
    assert removed(table(spark, str(tmp_path / "t"), rows), hot=hot) == want


def test_long_texts_and_shuffled_texts(spark, tmp_path, monkeypatch):
    """Texts over LONG are blocks of their own; without a broadcast the copies' texts are shuffled."""
    monkeypatch.setattr(op7_suffix, "LONG", 300)
    monkeypatch.setattr(op7_suffix, "BROADCAST_ROWS", -1)
    rows = texts(random.Random(7), 40) + [(100, "x" * 400), (101, "x" * 400), (102, "x" * 90)]
    assert removed(table(spark, str(tmp_path / "t"), rows), hot=2) == brute(rows)


def test_no_character_is_cut_in_two(spark, tmp_path):
    """Removal is by bytes; the text that is left drops characters that lost one."""
    shared = "é" * 40  # 80 bytes
    rows = [(1, "a" + shared + "ê"), (2, "ab" + shared + "ë"), (3, "x" + "\u00e9" * 24 + "è")]
    docs = table(spark, str(tmp_path / "t"), rows)
    plain = {r["doc_id"]: bytes(r["kept"]).decode("utf-8", "ignore") for r in op7_suffix.dedup(docs).collect()}
    whole = {r["doc_id"]: r["kept"] for r in op7_suffix.dedup(docs, characters=True).collect()}
    assert whole[1] == rows[0][1] and all(set(whole[i]) <= set(rows[i - 1][1]) for i in whole)
    assert whole == plain | {i: whole[i] for i in whole if "\u00c3" in plain[i]}


def test_anchors_do_not_depend_on_segments(monkeypatch):
    rng = random.Random(1)
    text = bytes(rng.choice(b"abc \n") for _ in range(5000)) + b"q" * 200
    t = tokens.Texts(np.frombuffer(text, np.uint8), np.array([0, 0, 700, 740, 740, 3000, 5200]), 0)
    whole = op7_suffix.Anchors(t)
    for size in (60, 333, 1000):
        monkeypatch.setattr(op7_suffix, "SEGMENT", size)
        cut = op7_suffix.Anchors(t)
        for name in ("at", "rank", "doc", "full", "lo", "hi"):
            assert (getattr(cut, name) == getattr(whole, name)).all()


def test_a_text_of_20_mb(spark, tmp_path):
    rng = np.random.default_rng(2)
    long = rng.integers(97, 123, 20_000_000, dtype=np.uint8).tobytes().decode()
    rows = [(1, long[5_000_000:5_000_080]), (2, long), (3, long[-200:] + "!")]
    got = {i: (n, len(k)) for i, n, k in removed(table(spark, str(tmp_path / "t"), rows))}
    assert got == {1: (80, 80), 2: (20_000_000, 20_000_000 - 80), 3: (201, 1)}
