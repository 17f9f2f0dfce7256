"""Similarity join, repeated passages and components against brute force."""

import hashlib
import random
import re

import pytest

from orgloom.llm import ngram_join as J
from orgloom.llm.components import components
from orgloom.llm.substring_dedup import substring_dedup


def near_copies(seed, groups=6, size=30):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for g in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.choice((20, 60, 120)))]
        for _ in range(size):
            text = list(base)
            for _ in range(rnd.choice((0, 0, 1, 1, 2, 3, 5))):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            out.append(" ".join(text))
    out += [" ".join(rnd.choice(words[:12]) for _ in range(rnd.randrange(0, 14))) for _ in range(60)]
    rnd.shuffle(out)
    return list(enumerate(out))


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids, links = list(sets), dict.fromkeys(sets, 0)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
                links[a] += 1
                links[b] += 1
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


@pytest.mark.parametrize("k,percent,paired,block", [(3, 90, 64, 256), (3, 90, 4, 8), (5, 80, 8, 16)])
def test_join_equals_brute_force(spark, monkeypatch, k, percent, paired, block):
    monkeypatch.setattr(J, "PAIRED", paired)
    monkeypatch.setattr(J, "BLOCK", block)
    rows = near_copies(k + percent + paired)
    got = J.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k=k, percent=percent, count_links=True).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == brute_components(rows, k, percent)


def kept_tables(monkeypatch):
    """Rows of the tables that the join writes, by name (of the first of a name)."""
    written, rows = J.written, {}

    def count(df, name):
        out = written(df, name)
        rows.setdefault(name, out.count())
        return out

    monkeypatch.setattr(J, "written", count)
    return rows


def test_join_of_more_shingles_than_counters(spark, monkeypatch):
    """Common words meet in any order by chance; a sketch full of other shingles must not make such shingles the rare ones."""
    monkeypatch.setattr(J, "SKETCH_BITS", 8)
    rnd = random.Random(5)
    common, rows = [f"c{i}" for i in range(12)], []
    for i in range(400):
        rows.append((i, " ".join(f"r{rnd.randrange(10**9)}" if rnd.random() < 0.15 else rnd.choice(common) for _ in range(80))))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(20)]
    kept = kept_tables(monkeypatch)
    got = J.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), count_links=True).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == brute_components(rows, 3, 90)
    assert kept["postings"] < 20 * 2 * 15 + 100 and kept["groups"] == 40


def test_shared_passage_makes_no_group(spark, monkeypatch):
    """Texts that share a passage with the next one are no candidates, so they don't chain into one group."""
    rnd = random.Random(6)
    passages = [[f"p{g}x{i}" for i in range(14)] for g in range(61)]
    rows = [(i, " ".join(passages[i] + [f"w{rnd.randrange(10**9)}" for _ in range(200)] + passages[i + 1])) for i in range(60)]
    rows += [(100 + i, t.rsplit(" ", 2)[0]) for i, t in rows[:5]]
    kept = kept_tables(monkeypatch)
    got = J.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=5, percent=80, count_links=True).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == brute_components(rows, 5, 80)
    assert kept["groups"] == 10


def test_similar_sets_share_enough(spark):
    """``enough`` is a lower bound, met by some pairs, for all sizes and prefixes."""
    rnd, pairs = random.Random(7), []
    for _ in range(3000):
        percent, n = rnd.choice((80, 90)), rnd.randrange(1, 60)
        x = set(rnd.sample(range(10**6), n))
        y = set(rnd.sample(sorted(x), n - rnd.randrange(0, n // 5 + 1))) | {rnd.randrange(10**6) for _ in range(rnd.randrange(0, n // 5 + 1))}
        if 100 * len(x & y) < percent * len(x | y):
            continue
        ends = [rnd.randrange(1, min(4, -(-percent * len(s) // 100)) + 1) for s in (x, y)]
        a, b = (set(sorted(s)[:len(s) - -(-percent * len(s) // 100) + l]) for s, l in zip((x, y), ends))
        pairs.append((percent, len(x), len(y), *ends, len(a & b)))
    df = spark.createDataFrame(pairs, "percent int, n long, n2 long, need int, need2 int, shared int")
    for percent in (80, 90):
        spare = [r.spare for r in df.filter(df.percent == percent).select((df.shared - J.enough(percent)).alias("spare")).collect()]
        assert min(spare) == 0 and len(spare) > 300


def test_poisson_tail():
    import numpy as np

    rate = np.array([1e-9, 1e-4, 0.01, 0.5, 3.0])
    assert np.allclose(J._at_least(rate, 1), 1 - np.exp(-rate), rtol=1e-3)
    assert np.allclose(J._at_least(rate, 2)[2:], (1 - np.exp(-rate) * (1 + rate))[2:], rtol=1e-3)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (100, 50), (7, 7), (None, 3), (200, 201), (200, 202), (203, 202)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50, **{i: 200 for i in range(200, 204)}}


def brute_removed(rows, window):
    first, words = {}, {i: re.findall(r"[^ \t-\r]+", t) for i, t in rows}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s:s + window]), (i, s))
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] != (i, s):
                gone |= set(range(s, s + window))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for n, x in enumerate(w) if n not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window,block", [(20, 10), (7, 4)])
def test_substring_dedup_equals_brute_force(spark, window, block):
    rnd = random.Random(window)
    shared = [[rnd.choice("abcdefgh") + str(rnd.randrange(40)) for _ in range(rnd.randrange(5, 60))] for _ in range(8)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rnd.randrange(1, 6)):
            if rnd.random() < 0.4:
                part = rnd.choice(shared)
                at = rnd.randrange(0, len(part))
                text += part[at:at + rnd.randrange(1, 50)]
            elif rnd.random() < 0.1:
                text += ["x"] * rnd.randrange(1, 60)
            else:
                text += [str(rnd.randrange(10**6)) for _ in range(rnd.randrange(0, 30))]
        rows.append((i * 3 - 50, rnd.choice([" ", "\n", " \t "]).join(text)))
    rnd.shuffle(rows)
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), window=window, block=block).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_removed(rows, window)
    assert all(r.n_removed == sum(s["end"] - s["start"] for s in r.removed) for r in got)
    with pytest.raises(ValueError):
        substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=8, block=5)


def test_exact_dedup_splits_a_hot_group(spark):
    from pyspark.sql import functions as F

    from orgloom.llm.exact_dedup import exact_dedup

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot " * 20).otherwise(F.concat(F.lit("t"), (F.col("id") % 500).cast("string"))).alias("text"))
    for keep, fn in (("smallest", min), ("largest", max)):
        want = {}
        for r in docs.collect():
            want.setdefault(r.text, []).append(r.doc_id)
        got = exact_dedup(docs, keep=keep).collect()
        text = {i: t for t, ids in want.items() for i in ids}
        assert len(got) == 3000
        for r in got:
            ids = want[text[r.doc_id]]
            assert (r.keep_id, r.group_size, r.kept) == (fn(ids), len(ids), r.doc_id == fn(ids))


def alike_under_powers():
    """Two words that every polynomial with an odd base modulo 2**64 gives one value."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    return a, b


def test_long_words_keep_apart(spark):
    a, b = alike_under_powers()
    same = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{same} {a}"), (2, f"{same} {b}"), (3, a), (4, b)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.component_id for r in J.ngram_join(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_word_hashes_differ():
    import numpy as np
    import pyarrow as pa

    from orgloom.llm import words as W

    texts = ["a" * n for n in range(1, 200)] + ["a" * n + "b" for n in range(200)] + ["\0" * n for n in range(1, 100)] + list(alike_under_powers())
    raw, at = W.raw_column(pa.array(texts))
    words = W.words_of(raw, at, b" ", False)
    assert len(np.unique(words.hash)) == len(texts) == len(words.hash)
