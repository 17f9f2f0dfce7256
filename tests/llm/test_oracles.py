"""The training-data queries against their check SQL, and their shape on empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from orgloom.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect
from tests.conftest import SMALL

TABLES = ("documents", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SMALL, name, QUERIES[name], ORACLES[name]) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def emptied(spark, tmp_path_factory):
    """The tables without rows."""
    top = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{top}/{t}.parquet")
    return str(top)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, emptied, name):
    rows = QUERIES[name](spark, emptied).collect()
    assert [r.conv_id for r in rows] == [-7] if name.startswith("op10") else rows == []


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls, blanks, repeated rows, ties and columns named like those used inside."""
    top = tmp_path_factory.mktemp("odd")
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (5, " \n\t "), (None, text), (None, None), (6, "a"), (7, "a b"), (8, "A  b"),
            (9, "x" * 70000), (10, " ".join(["same"] * 3000)), (11, "été\u00a0naïve 漢字 \U0001f600")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(None).cast("long").alias("n_chars"),
        *(F.lit(7).alias(c) for c in ("id", "key", "part", "hash", "n", "node", "row", "rank", "score", "held_out", "length", "turn", "kept", "word")))
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, "five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (2, "a b"), (2, "a b"), (3, None), (None, "...")],
                          "item_id long, text string").withColumn("window", F.lit(1)).write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 1, 1), (6, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int").withColumn(
        "label", F.lit("x")).write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (None, 2, "assistant", "<|im_end|>"), (1, None, "assistant", "x\\")],
                          "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(0)).write.parquet(f"{top}/conversations.parquet")
    return str(top)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    df = QUERIES[name](spark, odd)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"))
    assert not (name.startswith(("op6", "op10")) and ("Arrow" in plan or "Pandas" in plan))
    got = df.collect()
    if name.startswith("op10"):
        by = {r.conv_id: r for r in got}
        assert by.keys() == {-7, 1, None} and by[1].n_turns == 4 and by[1].loss_chars == 2 and by[None].loss_chars == len("<|im_end|>")
        return
    if name.startswith("op11"):
        assert got == []  # no word of six letters occurs five times
        return
    if name.startswith("op4"):
        assert len(got) == 14 + sum(r.piece > 0 for r in got)
    else:
        assert sorted(str(r.doc_id) for r in got) == sorted(map(str, [1, 1, 2, 3, 4, 5, None, None, 6, 7, 8, 9, 10, 11]))
    one = {r.doc_id: r for r in got if r.doc_id is not None}
    if name.startswith("op1_"):
        assert [one[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8, 10)] == [1, 1, 3, 4, 5, 6, 7, 7, 10]
        assert [one[i].n_shingles for i in (1, 3, 5, 6, 7, 10)] == [19, 0, 0, 1, 1, 1]
        assert {r.component_id for r in got if r.doc_id is None} == {1, None}
    if name.startswith("op3"):
        assert (one[1].n_hit, one[1].n_items, one[7].n_hit, one[8].n_hit, one[6].n_hit, one[3].n_words) == (11, 1, 2, 2, 0, 0)
    if name.startswith("op6"):
        assert sorted((r.kept, r.group_size, r.keep_id) for r in got if r.doc_id == 1) == [(False, 4, 2), (False, 4, 2)] and one[2].kept
        assert (one[4].keep_id, one[3].group_size, one[4].kept) == (4, 3, True)
    if name.startswith("op8"):
        assert (one[1].n_removed, one[2].n_removed, one[10].n_removed, one[9].n_words) == (0, 21, 2999, 1)
        assert [r.n_removed for r in got if r.doc_id is None and r.n_words] == [21]
    if name.startswith(("op2", "op5")):
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
