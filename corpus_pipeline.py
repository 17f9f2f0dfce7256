"""The corpus pipeline: from raw documents to packed training sequences.

Each stage gets what its predecessor kept, as Parquet, and returns the columns of documents; the
last returns the packed pieces. Rows are followed by identifier and text, so repeated
identifiers do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgloom.llm.decontamination import decontaminate
from orgloom.llm.exact_dedup import exact_dedup
from orgloom.llm.ngram_join import ngram_join
from orgloom.llm.packing import pack
from orgloom.llm.quality import quality_scores
from orgloom.llm.queries import table, vocabulary
from orgloom.llm.storage import keep_rows, written

NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    scored = quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return keep_rows(docs, exact_dedup(docs, keep="largest"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest identifier, of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    found = ngram_join(docs, k=NEAR_WORDS, percent=NEAR_PERCENT)
    return keep_rows(docs, found.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id"))))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words, or whole shorter item, with the benchmark."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return keep_rows(docs, found.withColumn("kept", F.col("n_hit") == 0))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised pieces of all documents, packed into sequences of 4096 tokens."""
    return pack(docs, vocabulary())


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier decides in the first stage, which SQL can't express; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
