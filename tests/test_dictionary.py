"""Dictionary words in texts: the same rows as chains of contains, whatever the size of the dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from orgloom.functions import fixed_values as V
from orgloom.functions import scoring as S
from orgloom.operators import dictionary as D

WORDS = "word string, label string, place long"


def expected(text, entries):
    """(first label, best label, number of words by label, places) by plain search."""
    hits = {}
    for word, label, place in entries:
        if word and label is not None and text and word in text:
            key = (word, label)
            hits[key] = min(place, hits.get(key, place))
    by_label = {}
    for (_, label), place in hits.items():
        by_label.setdefault(label, []).append(place)
    if not hits:
        return None, None, 0, []
    first = min((min(p), label) for label, p in by_label.items())[1]
    best = min((-len(p), min(p), label) for label, p in by_label.items())[2]
    return first, best, len(hits), sorted(hits.values())


@pytest.mark.parametrize("characters", [D.PART_CHARACTERS, 60])
def test_like_plain_search(spark, characters):
    rng = random.Random(5)
    letters = "ab가é😀"
    entries = [("".join(rng.choices(letters, k=rng.randint(1, 4))), rng.choice("xyz"), rng.randint(0, 40)) for _ in range(80)]
    entries += [("", "x", 1), (None, "x", 2), ("b", None, 0), ("ab", "x", 3), ("ab", "y", 3)]
    texts = ["".join(rng.choices(letters + " ", k=rng.randint(0, 30))) for _ in range(200)] + [None, "", "q" * 100_000 + "ab", "ab", "ab"]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id long, text string, label string")
    out = D.with_dictionary(docs, "text", spark.createDataFrame(entries, WORDS), "d_", characters)
    got = {r.id: (r.d_first_label, r.d_best_label, r.d_n_words, r.d_places) for r in out.collect()}
    assert got == {i: expected(t, entries) for i, t in enumerate(texts)}
    assert out.columns == ["id", "text", "label", "d_first_label", "d_best_label", "d_n_words", "d_places"]


def test_like_the_chains(spark):
    words = [w for _, ws in V.ORG_TYPE_WORDS + V.TEXT_CATEGORY_WORDS for w in ws]
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, "".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(300)], "id long, text string")
    out = D.with_dictionary(docs, "text", D.dictionary_of(spark, V.TEXT_CATEGORY_WORDS), "c_")
    out = D.with_dictionary(out, "text", D.dictionary_of(spark, V.ORG_TYPE_WORDS), "t_")
    wrong = out.filter((F.coalesce("c_first_label", F.lit(V.OTHER)) != S.text_category(F.col("text"))) | (F.coalesce("t_best_label", F.lit(V.OTHER)) != S.org_type(F.col("text"))))
    assert wrong.count() == 0


def test_hundred_thousand_words_in_one_pass(spark):
    words = spark.range(100_000).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(";")).alias("word"), (F.col("id") % 7).cast("string").alias("label"), F.col("id").alias("place"))
    docs = spark.range(200).select("id", F.concat(F.lit("w"), (F.col("id") * 499).cast("string"), F.lit("; and w"), (F.col("id") + 99_990).cast("string"), F.lit(";")).alias("text"))
    out = D.with_dictionary(docs, "text", words)
    assert "ArrowEvalPython" in out._jdf.queryExecution().toString() and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        places = sorted({p for p in (r.id * 499, r.id + 99_990) if p < 100_000})
        assert (r.places, r.first_label) == (places, str(places[0] % 7))


def test_empty_dictionary_empty_table_and_clashes(spark):
    none = spark.createDataFrame([], WORDS)
    docs = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    assert [tuple(r)[2:] for r in D.with_dictionary(docs, "text", none).orderBy("id").collect()] == [(None, None, 0, [])] * 2
    one = spark.createDataFrame([("a", "x", 0)], WORDS)
    assert D.with_dictionary(docs.limit(0), "text", one).count() == 0
    with pytest.raises(ValueError):
        D.with_dictionary(docs.withColumn("Places", F.lit(1)), "text", one)
