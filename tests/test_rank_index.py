"""Any page of a rank index equals the page of the sorted table, from a few files."""

import pytest
from pyspark.sql import functions as F

from orgloom.operators import ranking as R
from orgloom.operators import rank_index as X

ORDER = [("updated_at", True), ("id", False)]


@pytest.fixture(scope="module")
def rows(spark):
    # a third of the rows share one time, others have none
    return spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(500)).when(F.col("id") % 7 != 1, (F.col("id") * 37) % 1000).cast("int").alias("updated_at"),
                                    F.concat(F.lit("n"), "id").alias("name"))


@pytest.mark.parametrize("per_range", [100, 333, 10_000])
def test_pages_equal_the_sorted_table(spark, rows, tmp_path, per_range):
    folder = str(tmp_path / "r")
    X.create_rank_index(rows, folder, ORDER, per_range)
    whole = [tuple(r) for r in rows.orderBy(F.desc_nulls_first("updated_at"), F.asc("id")).collect()]
    assert X.ranked_total(spark, folder) == 3000
    for number, size in ((1, 20), (2, 20), (75, 40), (76, 40), (9, 333), (1, 5000), (150, 20), (151, 20)):
        page = X.ranked_page(spark, folder, number, size)
        assert [tuple(r) for r in page.collect()] == whole[(number - 1) * size:number * size]
    assert X.ranked_page(spark, folder, 3, 50).columns == rows.columns
    if per_range == 100:
        # deep pages read as few files as the first one
        reads = [len(X.ranked_page(spark, folder, n, 20).inputFiles()) for n in (1, 20, 75, 140)]
        assert max(reads) <= 2 and spark.read.parquet(f"{folder}/ranges").count() > 20
        assert spark.read.parquet(f"{folder}/ranges").agg(F.max("n")).first()[0] < 400  # equal times are split too


def test_page_like_the_operator(spark, rows, tmp_path):
    folder = str(tmp_path / "r")
    X.create_rank_index(rows, folder, ORDER, 500)
    got = X.ranked_page(spark, folder, 12, 25).collect()
    assert got == R.page(rows, [F.desc_nulls_first("updated_at"), F.asc("id")], 12, 25).collect()


def test_empty_and_wrong_pages(spark, rows, tmp_path):
    X.create_rank_index(rows.limit(0), str(tmp_path / "e"), ORDER)
    assert X.ranked_page(spark, str(tmp_path / "e"), 1, 10).count() == 0 and X.ranked_total(spark, str(tmp_path / "e")) == 0
    for number, size in ((0, 10), (1, 0)):
        with pytest.raises(ValueError):
            X.ranked_page(spark, str(tmp_path / "e"), number, size)
