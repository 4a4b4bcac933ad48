"""Periodic runs against a comparison of every word with every other."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from hitledger.llm import periodic
from hitledger.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(w):
    """All maximal stretches of every period, smaller periods of the same stretch ruled out by trying them."""
    found = set()
    for q in range(1, len(w) // 3 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            stretch = w[i - q : j]
            if len(stretch) >= max(24, 3 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                found.add((i - q, len(stretch), q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def dropped(runs, n):
    return {i for s, length, q in runs for i in range(s + q, min(n, s + length))}


def texts(seed, count):
    """Texts of few and many words with runs of many periods, nested and side by side."""
    r = random.Random(seed)
    for _ in range(count):
        out = []
        for _ in range(r.randint(1, 5)):
            alphabet = "abcdefghijklmnopqrstuvwxyz"[: r.choice([1, 2, 2, 3, 26])]
            piece = [r.choice(alphabet) for _ in range(r.choice([1, 2, 3, 5, 8, 9, 16, 17, 33, 40]))]
            piece *= r.choice([1, 2, 3, 4, 9])
            out += piece[: r.randint(1, len(piece))] if r.random() < 0.3 else piece
        yield out * r.choice([1, 1, 1, 3])


def test_runs_of_many_texts():
    for words in texts(5, 600):
        want = brute(words)
        got = periodic.scan(" ".join(words).encode(), None)
        assert [(x["start"], x["length"], x["period"]) for x in got["runs"]] == want, words
        gone = dropped(want, len(words))
        assert got["collapsed"].decode() == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_work_is_bounded_on_frequent_words():
    """One word 200,000 times, and a long text in which one word is every other: one occurrence a window, not all pairs."""
    n = 200_000
    assert periodic.scan(b"a " * n, None)["runs"] == [{"start": 0, "length": n, "period": 1}]
    r = random.Random(2)
    mixed = [w for k in range(n // 2) for w in ("the", f"w{r.randint(0, 10**9)}")]
    ids = {w: k for k, w in enumerate(dict.fromkeys(mixed))}
    import numpy as np

    assert len(periodic.occurrences(np.array([ids[w] for w in mixed]))) == 0


def by_contract(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = dropped(runs, n)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def test_query_against_brute_force(spark):
    """Every short text of the table by the contract's own words; long ones cost the brute force too much."""
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(got) == sorted(r[0] for r in docs)
    short = [r for r in docs if len(WORD.findall(r[1] or "")) <= 1000]
    assert len(short) > 150 and sum(got[r[0]][1] > 0 for r in short) > 20
    for r in short:
        assert got[r[0]] == by_contract(*r)


def test_odd_rows(spark):
    rows = [(None, None, 1, "x"), (1, None, 1, "x"), (2, "", 1, "x"), (3, " \t\n", 1, "x"), (4, "ä " * 30, 1, "x"), (4, "ä " * 30, 1, "x"), (5, "a b c", 1, "x"), (6, "word " * 50_000, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, `a.b` string")
    got = periodic.find_runs(docs)
    assert got.columns == ["doc_id", "text", "a.b", "n_words", "runs", "longest", "collapsed"]
    out = sorted([(r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()])
    assert out == [(0, 0, [], ""), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 30, [(0, 30, 1)], "ä"), (4, 30, [(0, 30, 1)], "ä"), (5, 1, [], "a b c"), (6, 50_000, [(0, 50_000, 1)], "word")]
    assert periodic.find_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("h", [0, 10, 1230, 77770])
def test_planted(h):
    words = [str(i).encode() for i in range(200)]
    assert len(periodic.planted(words, h)) == 200 and periodic.planted(words, h + 1) == words and periodic.planted([], h) == []
