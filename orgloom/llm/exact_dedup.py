"""Exact deduplication by content sort (DataFrame functions only).

Rows are range-partitioned by content (the text's head and hash) and id with splitters
that Spark samples, each range is sorted externally by content, whole text and id, and every row is compared in full with its
neighbours. A splitter may fall inside a group of copies, so a hot group is dealt
over as many ranges as its share of the data; a step over one row per range
joins the pieces of such a group again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgloom.llm.storage import written

SPLITTER_CHARS = 48


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest",
) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256, text_key.

    Two rows are equal when their normalised texts are identical byte by byte;
    ``normalise`` maps the text column (None: no change). Of a group the row with
    the ``keep`` ("smallest" or "largest") identifier stays.

    * A null text counts as the empty text; all empty texts form one group.
    * A null identifier is kept only in a group that has no other.
    * Repeated rows with the same identifier count one by one; exactly one row of a
      group has ``kept`` true.
    * An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    # the row that stays is the last of its group in this order
    order = F.desc_nulls_first("id") if keep == "smallest" else F.asc_nulls_first("id")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a splitter holds the text's head and hash, so the sampled keys stay small; texts differ in full only within both
    content = (F.asc("head"), F.asc("hash"))
    dealt = (
        docs.select(F.col(id_col).alias("id"), text.alias("text"))
        .withColumns({"head": F.substring("text", 1, SPLITTER_CHARS), "hash": F.xxhash64("text")})
        .repartitionByRange(ranges, *content, order)
        .withColumn("part", F.spark_partition_id())
    )
    rows = Window.partitionBy("part").orderBy(*content, F.asc("text"), order)
    before, after = F.lag("text").over(rows), F.lead("text").over(rows)
    marked = dealt.select(
        "id", "part", "hash", F.sha2("text", 256).alias("sha"),
        F.when(before.isNull() | after.isNull(), F.col("text")).alias("edge"),
        before.isNull().alias("first"), after.isNull().alias("last"),
        F.coalesce(before != F.col("text"), F.lit(True)).alias("opens"),
        F.coalesce(after != F.col("text"), F.lit(True)).alias("closes"),
        F.row_number().over(rows).alias("n"),
    )
    upto = Window.partitionBy("part").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("run", F.sum(F.col("opens").cast("long")).over(upto))
    whole = Window.partitionBy("part", "run")
    local = written(
        marked.select(
            "id", "part", "hash", "sha", "edge", "first", "last", "closes", "run",
            F.max(F.when(F.col("closes"), F.struct(F.col("id").alias("id")))).over(whole)["id"].alias("keep"),
            F.count(F.lit(1)).over(whole).alias("size"),
        ),
        "dedup",
    )

    # one row per range: its first and last run, and whether the first run goes on from the range before
    ends = local.filter("first OR last").groupBy("part").agg(
        F.max(F.when(F.col("first"), F.col("edge"))).alias("first_text"),
        F.max(F.when(F.col("last"), F.col("edge"))).alias("last_text"),
        F.max(F.when(F.col("last"), F.col("run"))).alias("last_run"),
        F.max(F.when(F.col("first"), F.col("size"))).alias("first_size"),
        F.max(F.when(F.col("first"), F.struct("keep"))).alias("first_keep"),
        F.max(F.when(F.col("last"), F.col("size"))).alias("last_size"),
        F.max(F.when(F.col("last"), F.struct("keep"))).alias("last_keep"),
    )
    ranks = ends.select("part", F.row_number().over(Window.orderBy("part")).alias("rank"))
    ends = ends.join(ranks, "part")
    prior = ends.select((F.col("rank") + 1).alias("rank"), F.col("last_text").alias("prior_text"))
    line = ends.join(prior, "rank", "left").select(
        "part", "rank", "last_run", "first_size", "first_keep", "last_size", "last_keep",
        F.coalesce(F.col("first_text") == F.col("prior_text"), F.lit(False)).alias("goes_on"),
    )
    by_rank = Window.orderBy("rank")
    head = F.when(~(F.col("goes_on") & (F.col("last_run") == 1)), F.col("rank"))
    line = line.withColumn("last_chain", F.max(head).over(by_rank))
    line = line.withColumn(
        "first_chain",
        F.when(F.col("goes_on"), F.lag("last_chain").over(by_rank)).when(F.col("last_run") == 1, F.col("last_chain")),
    ).withColumn("followed", F.coalesce(F.lead("goes_on").over(by_rank), F.lit(False)))
    pieces = line.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("part"), F.lit(1).cast("long").alias("run"), F.col("first_chain").alias("chain"), F.col("rank"),
                    F.col("first_size").alias("size"), F.col("first_keep")["keep"].alias("keep"),
                    ((F.col("last_run") == 1) & F.col("followed")).alias("followed"),
                ),
                F.struct(
                    F.col("part"), F.col("last_run").alias("run"), F.when(F.col("last_run") > 1, F.col("last_chain")).alias("chain"),
                    F.col("rank"), F.col("last_size").alias("size"), F.col("last_keep")["keep"].alias("keep"), F.col("followed"),
                ),
            )
        ).alias("p")
    ).select("p.*").filter("chain IS NOT NULL")
    chains = pieces.groupBy("chain").agg(F.sum("size").alias("chain_size"), F.max_by(F.struct("keep"), "rank").alias("chain_keep"))
    joined = pieces.join(chains, "chain").select("part", "run", "followed", "chain_size", "chain_keep")
    return local.join(joined, ["part", "run"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("chain_keep", F.struct("keep"))["keep"].alias("keep_id"),
        F.coalesce("chain_size", "size").alias("group_size"),
        (F.col("closes") & ~F.coalesce("followed", F.lit(False))).alias("kept"),
        F.col("sha").alias("text_sha256"), F.col("hash").alias("text_key"),
    )
