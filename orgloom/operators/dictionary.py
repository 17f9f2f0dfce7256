"""Words of a dictionary table found in texts, all of them in one pass over each text.

A dictionary has word, label and place (a number; smaller counts first). A chain of ``contains`` reads a text once per word; the automaton of
all words reads it once. Tasks build the automaton from a broadcast list of words and read whole texts batch by batch.
Words go out in parts of a bounded number of characters; a larger dictionary takes one pass per part, each written
before the next begins, so that memory does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.functions import arrow_udf

from orgloom.session import stored

PART_CHARACTERS = 8 << 20  # of words in one broadcast; an automaton takes about 50 bytes for each
FOUND = "struct<places:array<bigint>,firsts:array<bigint>,labels:array<string>,counts:array<bigint>>"


def distinct_words(words: DataFrame) -> DataFrame:
    """(word, label, place): empty and null words go; a label keeps each word once, at its first place."""
    return words.filter("word <> '' AND label IS NOT NULL AND place IS NOT NULL").groupBy("word", "label").agg(F.min(F.col("place").cast("long")).alias("place"))


def _parts(words: DataFrame, characters: int) -> DataFrame:
    """The words with the number of their part; the running sum goes over ranges of the word's hash, not over the words."""
    cells = words.withColumn("cell", F.pmod(F.xxhash64("word"), F.lit(4096)).cast("int"))
    sums = cells.groupBy("cell").agg(F.sum(F.length("word")).alias("size"))
    before = F.sum("size").over(Window.orderBy("cell")) - F.col("size")  # at most 4096 rows
    return cells.join(sums.select("cell", F.floor(before / characters).cast("int").alias("part")), "cell").drop("cell")


class _Finder:
    """Finds the distinct words of one part in texts; built once per Python task."""

    def __init__(self, entries: list[tuple[str, list[tuple[str, int]]]]):
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.entries = [labels for _, labels in entries]
        for n, (word, _) in enumerate(entries):
            self.machine.add_word(word, n)
        self.machine.make_automaton()

    def found(self, text: str | None) -> dict:
        labels: dict[str, list[int]] = {}
        if text:
            for n in {n for _, n in self.machine.iter(text)}:
                for label, place in self.entries[n]:
                    labels.setdefault(label, []).append(place)
        ranked = sorted((min(p), label, len(p)) for label, p in labels.items())
        return {"places": sorted(x for p in labels.values() for x in p), "firsts": [r[0] for r in ranked], "labels": [r[1] for r in ranked], "counts": [r[2] for r in ranked]}


def _finder_udf(entries):
    schema = pa.struct([("places", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    @arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = _Finder(entries.value)
        for texts in batches:
            yield pa.array([finder.found(t) for t in texts.to_pylist()], schema)

    return find


def with_dictionary(df: DataFrame, text_col: str, words: DataFrame, prefix: str = "", characters: int = PART_CHARACTERS) -> DataFrame:
    """``df`` with ``prefix``first_label, best_label, n_words and places.

    A word counts for a text that contains it, however often, code point by code point; fold case on both sides where it must not matter.
    first_label is the label of the word with the smallest place (what a chain of ``contains`` gives), best_label the label with most
    words, of equal ones that with the smallest place; n_words counts words by label and places lists theirs, sorted. A word may have
    several labels. Equal places of different labels go by the label's order. Texts without a word, null texts and an empty
    dictionary give nulls, 0 and an empty list. Rows are kept as they are, repeated ones too.
    """
    spark = df.sparkSession
    parted = stored(_parts(distinct_words(words), characters), "dictionary")
    numbers = sorted(r.part for r in parted.select("part").distinct().collect())
    names = {n: f"{prefix}{n}" for n in ("first_label", "best_label", "n_words", "places")}
    taken = {x.lower() for x in df.columns} & {x.lower() for x in [*names.values(), "__found"]}
    if taken:
        raise ValueError(f"columns exist: {sorted(taken)}")
    out = df.withColumn("__found", F.lit(None).cast(FOUND))
    for i, number in enumerate(numbers):
        rows: list[Row] = parted.filter(F.col("part") == number).groupBy("word").agg(F.collect_list(F.struct("label", "place")).alias("labels")).collect()
        entries = spark.sparkContext.broadcast([(r.word, [(x.label, x.place) for x in r.labels]) for r in rows])
        new = _finder_udf(entries)(F.col(text_col))
        if i == 0:
            out = out.withColumn("__found", new)
        else:
            out = _united(stored(out, "found").withColumn("__new", new))
    found = F.col("__found")
    ranked = F.arrays_zip(found["counts"], found["firsts"], found["labels"])
    best = F.array_max(F.transform(ranked, lambda r: F.struct(r["counts"].alias("n"), (-r["firsts"]).alias("place"))))
    last = F.filter(ranked, lambda r: (r["counts"] == best["n"]) & (r["firsts"] == -best["place"]))
    return out.withColumns({
        names["first_label"]: F.get(found["labels"], 0), names["best_label"]: F.get(last, 0)["labels"],
        names["n_words"]: F.coalesce(F.size(found["places"]), F.lit(0)).cast("long") if numbers else F.lit(0).cast("long"),
        names["places"]: F.coalesce(found["places"], F.array().cast("array<bigint>"))}).drop("__found")


def _united(df: DataFrame) -> DataFrame:
    """__found and __new (of other words) as one __found."""
    def rows(x):
        return F.arrays_zip(x["firsts"], x["labels"], x["counts"])

    both = F.concat(rows(F.col("__found")), rows(F.col("__new")))
    names = F.array_distinct(F.transform(both, lambda r: r["labels"]))

    def one(name):
        mine = F.filter(both, lambda r: r["labels"] == name)
        return F.struct(F.array_min(F.transform(mine, lambda r: r["firsts"])).alias("firsts"), name.alias("labels"),
                        F.aggregate(mine, F.lit(0).cast("long"), lambda s, r: s + r["counts"]).alias("counts"))

    ranked = F.array_sort(F.transform(names, one))
    places = F.array_sort(F.concat(F.col("__found")["places"], F.col("__new")["places"]))
    return df.withColumn("__found", F.struct(
        places.alias("places"), F.transform(ranked, lambda r: r["firsts"]).alias("firsts"), F.transform(ranked, lambda r: r["labels"]).alias("labels"),
        F.transform(ranked, lambda r: r["counts"]).alias("counts"))).drop("__new")


def dictionary_of(spark, groups) -> DataFrame:
    """The dictionary of (label, words) pairs, in their order."""
    rows = [(w, label) for label, ws in groups for w in ws]
    return spark.createDataFrame([(w, label, i) for i, (w, label) in enumerate(rows)], "word string, label string, place long")
