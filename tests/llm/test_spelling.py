"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orgloom.llm import spelling as S
from orgloom.llm.queries import QUERIES
from tests.conftest import SMALL


def brute_counts(rows, damage, least_chars=6):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{word}".encode())
            if damage and i is not None and h % damage == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= least_chars:
                counts[word] += 1
    return counts


def brute_groups(rows, damage=None, least_chars=6, least_count=5, factor=5):
    n = {w: k for w, k in brute_counts(rows, damage, least_chars).items() if k >= least_count}
    near = {w: set() for w in n}
    holes = {}
    for w in n:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1:]), set()).add(w)
            if (shorter := w[:k] + w[k + 1:]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    df = QUERIES["op11_spelling_groups"](spark, SMALL)
    assert dict(df.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert got(df) == brute_groups(rows, S.DAMAGE)


def crowded(seed):
    """Few letters and short words, so that nearly all words have neighbours, ties and chains of forms."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abéÿZ") for _ in range(rnd.randrange(2, 7))) for _ in range(150)] + ["aaaaaa", "aaaaaaa", "aaaaaab", "abcdef" * 30, "abcdef" * 30 + "g"]
    return [(rnd.choice((1, 2, 3, None)), rnd.choice(" ,1\n中Ā").join(rnd.choice(words[:rnd.choice((5, 30, len(words)))]) for _ in range(40))) for _ in range(150)]


@pytest.mark.parametrize("filter_bytes", [24, 200, S.FILTER_BYTES])
def test_crowded_vocabulary(spark, filter_bytes):
    rows = crowded(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = S.spelling_groups(docs, least_chars=2, least_count=2, factor=2, damage=7, filter_bytes=filter_bytes)
    want = brute_groups(rows, 7, 2, 2, 2)
    assert got(found) == want
    assert any(form and form != root for _, form, root, *_ in want)


def test_passes_hold_every_length_within_the_bound():
    sizes = {6: 10, 7: 1000, 8: 3, 40: 1}
    for limit in (8, 100, 1 << 20):
        passes = S._passes(sizes, limit)
        for length in sizes:
            parts = [s for p in passes for s in p if s.length == length]
            assert sorted(s.part for s in parts) == list(range(parts[0].parts))
        assert all(8 * sum(s.cells for s in p) <= max(limit, 8) for p in passes)


def test_pairs_are_given_once(spark):
    words = ["aabb", "abb", "aab", "aabbb", "abab", "àabb", "xyz"]
    table = spark.createDataFrame([(w, n) for n, w in enumerate(words)], "word string, n long")
    pairs = [(r.word, r.other) for r in S.near_words(table).collect()]
    edit = lambda a, b: (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) or (
        abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:k] + max(a, b, key=len)[k + 1:] == min(a, b, key=len) for k in range(max(len(a), len(b)))))
    assert sorted(pairs) == sorted((a, b) for a in words for b in words if a != b and edit(a, b))
    assert all(r.n == words.index(r.word) and r.other_n == words.index(r.other) for r in S.near_words(table).collect())


def test_word_counts(spark):
    rows = [(1, "CaféSS ÉCOLES ×÷×÷×÷ naïveté́"), (1, None), (2, ""), (3, "abcdef" * 12000 + " abcdeF-abcdefœabcdef"), (None, "abcdef" * 12000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("id", F.lit(0))
    for damage in (None, 1, 3):
        assert {r.word: r.n for r in S.word_counts(docs, damage=damage).collect()} == brute_counts(rows, damage)
    assert S.spelling_groups(docs.limit(0)).count() == 0
