"""The pipeline against a brute-force version, stage by stage on what the stage before kept."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from orgloom.llm.packing import pack
from orgloom.llm.queries import vocabulary
from orgloom.llm.storage import keep_rows
from tests.conftest import SMALL
from tests.llm.test_pairs import brute_components

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def windows(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(10, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def holds(text, item):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return any(tuple(w[i:i + len(g)]) in item for g in {min(item, key=len)} for i in range(len(w) - len(g) + 1)) if item else False


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = P.keep_good(spark, docs, SMALL)
    assert good.columns == docs.columns
    rows = {r.doc_id: r.text for r in good.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert sum(labels[i] == 1 for i in rows if i in labels) >= 0.97 * sum(q == 1 for q in labels.values())

    last = {}
    for i, t in rows.items():
        last[t or ""] = max(i, last.get(t or "", i))
    kept = {i: rows[i] for i in last.values()}
    once = P.drop_copies(spark, good, SMALL)
    assert once.columns == docs.columns and {r.doc_id for r in once.collect()} == set(kept)

    roots = brute_components(list(kept.items()), 5, 80)
    kept = {i: t for i, t in kept.items() if roots[i][1] == i}
    apart = P.drop_near_copies(spark, once, SMALL)
    assert apart.columns == docs.columns and {r.doc_id for r in apart.collect()} == set(kept)

    items = [windows(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(holds(t, item) for item in items)}
    clean = P.drop_contaminated(spark, apart, SMALL)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(kept)

    places = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    whole = P.run(spark, SMALL)
    assert places(whole) == places(pack(docs.filter(F.col("doc_id").isin(list(kept))), vocabulary()))


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_keep_rows(spark, bits):
    docs = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, None, 4), (None, "c", 5), (None, "c", 6), (3, "d", 7)], "doc_id long, text string, key int")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    verdicts = docs.select("doc_id", key.alias("text_key"), F.col("key").isin(2, 3, 7).alias("kept"))
    got = keep_rows(docs, verdicts, bits=bits)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a"), (1, "b"), (3, "d")]
    assert keep_rows(docs.limit(0), verdicts).count() == 0 and keep_rows(docs, verdicts.limit(0)).count() == 7
