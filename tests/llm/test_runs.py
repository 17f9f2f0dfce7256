"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orgloom.llm import periodic_runs as R
from orgloom.llm.queries import QUERIES
from tests.conftest import SMALL


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        x = q
        while x < n:
            if w[x] != w[x - q]:
                x += 1
                continue
            begin = x
            while x < n and w[x] == w[x - q]:
                x += 1
            start, length = begin - q, x - begin + q
            if length >= max(6, 4 * q) and not any(w[start:start + length - r] == w[start + r:start + length] for r in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            digest("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark):
    rows = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = QUERIES["op13_periodic_runs"](spark, SMALL).collect()
    small = {r.doc_id: r.text for r in rows if len((r.text or "").split()) < 1500}
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    assert {tuple(r) for r in got if r.doc_id in small} == {brute_row(i, t) for i, t in small.items()}
    assert sum(r.n_runs > 0 for r in got) > 5


PERIODS = [1, 2, 3, 5, 8, 9, 10, 15, 16, 17, 20, 31, 32, 33, 40, 63, 64, 65, 70, 129]


def patched(rnd):
    out = []
    for _ in range(rnd.randrange(0, 6)):
        q, letters = rnd.choice(PERIODS), rnd.choice([1, 2, 3, 50, 1000])
        unit = [rnd.randrange(letters) for _ in range(q)]
        out += [unit[i % q] for i in range(int(q * rnd.choice([1, 2, 3.9, 4, 4.1, 5, 7.3])))]
        out += [rnd.randrange(letters) for _ in range(rnd.randrange(0, 8))]
        if rnd.random() < 0.2 and out:
            out[rnd.randrange(len(out))] = 99
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(8):
        texts = [patched(rnd) if rnd.random() < 0.7 else [rnd.randrange(2) for _ in range(rnd.randrange(0, 90))] * rnd.choice([1, 4]) for _ in range(rnd.randrange(1, 12))]
        first = np.cumsum([0, *map(len, texts)])
        assert R.find_runs(np.array([x for t in texts for x in t], np.uint64), first) == [brute_runs(t) for t in texts]


@pytest.mark.parametrize("q", PERIODS)
def test_shortest_and_longest_runs_of_each_period(q):
    for n in (max(6, 4 * q) - 1, max(6, 4 * q), 4 * q + 3, 50 * q):
        for before in (0, 1, q):
            w = [10**6 + i for i in range(before)] + [i % q for i in range(n)] + [10**7, 10**7 + 1]
            want = [(before, n, q)] if n >= max(6, 4 * q) else []
            assert R.find_runs(np.array(w, np.uint64), np.array([0, len(w)])) == [want]


def test_one_period_of_thousands_of_words():
    unit = np.random.default_rng(1).integers(0, 1 << 60, 40_000).astype(np.uint64)
    w = np.concatenate([unit[:7], np.tile(unit, 5), unit[:9]])
    assert R.find_runs(w, np.array([0, len(w)])) == [[(7, 5 * 40_000 + 9, 40_000)]]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(R.W, "word_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    texts = ["a b c " * 9, "a b " * 9 + "c", "a " * 9, "a b c d e f"]
    raw, at = R.W.raw_column(pa.array(texts))
    out = R.judged([1, 2, 3, 4], raw, at, 6, 4, None)
    assert [[(r["start"], r["length"], r["period"]) for r in row["runs"]] for row in out] == [brute_runs(t.split()) for t in texts]


def test_odd_rows(spark):
    rows = [(1, "a b a b a b a b"), (1, "a b a b a b a b"), (None, "x " * 7), (2, None), (3, ""), (4, " \t\n"), (5, "one"), (6, "same " * 30000), (7, "p q r s t u " * 4000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "runs", "start", "length", "period", "n_words", "collapsed"):
        docs = docs.withColumn(c, F.lit("x"))
    got = R.periodic_runs(docs).collect()
    told = sorted(((r.doc_id, r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.collapsed) for r in got), key=str)
    assert told == sorted([
        (1, 8, 1, 0, 8, 2, 4000, "a b"), (1, 8, 1, 0, 8, 2, 4000, "a b"), (None, 7, 1, 0, 7, 1, 7000, "x"), (2, 0, 0, None, None, None, None, None), (3, 0, 0, None, None, None, None, None),
        (4, 0, 0, None, None, None, None, None), (5, 1, 0, None, None, None, None, None), (6, 30000, 1, 0, 30000, 1, 30000000, "same"),
        (7, 24001, 1, 0, 24000, 6, 4000000, "p q r s t u end")], key=str)
    assert R.periodic_runs(docs.limit(0)).collect() == []
    assert R.periodic_runs(docs, rewrite=lambda i, n: (0, 1)).filter("doc_id IS NULL").first().n_words == 7
