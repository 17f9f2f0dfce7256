"""Similar records against brute force: recall of the bands, exact verdicts, copies, hot keys, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from orgloom.operators import similarity as S


def brute(texts, threshold):
    """{(class a, class b): similarity} and {id: (class, links)} by comparing all."""
    sets = {i: frozenset((t or "").lower().split()) for i, t in texts}
    classes = {}
    for i in sorted(sets):
        classes.setdefault(sets[i], i)
    jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    pairs = {}
    kept = sorted((i, s) for s, i in classes.items() if s)
    for n, (i, x) in enumerate(kept):
        for j, y in kept[n + 1:]:
            if jaccard(x, y) >= threshold:
                pairs[i, j] = jaccard(x, y)
    rows = {i: (classes[s] if s else i, sum(j != i and jaccard(s, z) >= threshold for j, z in sets.items())) for i, s in sets.items()}
    return pairs, rows


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    out, base = [], rng.sample(words, 30)
    for i in range(300):
        if i % 3 == 0:  # a third of all records are near copies of one, some of them equal
            t = base[:]
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(30)] = rng.choice(words)
        else:
            t = rng.sample(words, rng.randint(1, 40))
        rng.shuffle(t)
        out.append((i, " ".join(t).upper() if i % 2 else "\u00a0".join(t) + "\n"))
    return out + [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE  one"), (905, " ".join(f"long{n % 5000}" for n in range(50_000)))]


@pytest.mark.parametrize("threshold, bands, rows, recall", [(0.8, 20, 3, 1.0), (0.5, 20, 3, 0.9), (0.5, 60, 2, 1.0)])
def test_like_brute_force(spark, texts, threshold, bands, rows, recall, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 7)
    df = spark.createDataFrame(texts, "id long, text string").withColumn("class_id", F.lit("clash")).repartition(5)
    want, links = brute(texts, threshold)
    got = {(r.a, r.b): r.similarity for r in S.similar_pairs(df, threshold, bands=bands, rows=rows).collect()}
    assert len(want) > 100 and set(got) <= set(want) and len(got) >= recall * len(want)
    assert all(abs(want[p] - s) < 1e-12 for p, s in got.items())
    if threshold == 0.8:
        out = S.similar_records(df, threshold)
        assert {r.id: (r.class_id, r.n_links) for r in out.collect()} == links and out.columns == ["id", "class_id", "n_links"]


def test_a_pair_comes_once_and_copies_cost_nothing(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, "a b c d e f g h i j").otherwise("a b c d e f g h i k").alias("text"))
    assert [tuple(r) for r in S.similar_pairs(rows).collect()] == [(0, 1, 9 / 11, 1000, 1000)]
    assert S.similar_records(rows).groupBy("class_id", "n_links").count().orderBy("class_id").collect() == [(0, 1999, 1000), (1, 1999, 1000)]


def test_empty_table_null_ids_and_wrong_threshold(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert S.similar_pairs(none).count() == 0 and S.similar_records(none).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b")], "id long, text string")
    assert sorted(map(tuple, S.similar_records(odd).collect()), key=str) == [(1, 1, 0), (None, None, 0), (None, None, 0)]
    with pytest.raises(ValueError):
        S.similar_pairs(none, 0)


def test_sketches_keep_every_similar_pair_and_spare_the_words_of_others(spark, monkeypatch, tmp_path):
    # records of four families share one word in two with each other and all but one with their own
    rng = random.Random(5)
    common = [f"c{i}" for i in range(40)]
    families = [common + [f"f{k}x{i}" for i in range(40)] for k in range(4)]
    texts = [(i, " ".join([*families[i % 4], f"own{i}"])) for i in range(200)] + [(1000 + i, " ".join(rng.sample(common, 30) + [f"{i}y{n}" for n in range(60)])) for i in range(200)]
    df = spark.createDataFrame(texts, "id long, text string")
    written = {}
    keep = S.stored
    monkeypatch.setattr(S, "stored", lambda frame, name: written.setdefault(name, keep(frame, name)))
    assert {r.id: (r.class_id, r.n_links) for r in S.similar_records(df).collect()} == brute(texts, 0.8)[1]
    assert "hashes" not in written["signatures"].columns and "words" not in written["signatures"].columns
    # no record outside the families brings its words, and no list of pairs is written
    assert written["likely"].filter("class_id >= 1000").isEmpty() and "similar" not in written
