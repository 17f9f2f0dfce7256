"""Readers for organization files: JSON layouts, CSV in several encodings, sheets."""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orgloom.sources.blocks import csv_records, documents_without, json_records

ORG_STRUCT = "struct<name:string,homepage:string,phone:string,fax:string,email:string,mobile:string,postal_code:string,address:string,category:string>"
ENCODINGS = ("utf-8", "cp949", "euc-kr", "latin1")
# --- fixed values: Java names of the encodings ------------------------------
_JAVA = {"utf-8": "utf-8", "cp949": "MS949", "euc-kr": "EUC-KR", "latin1": "iso-8859-1"}


def java_charset(spark: SparkSession, encoding: str) -> str:
    """Java name of an encoding; Korean ones need the session to admit JVM charsets."""
    if encoding in ("cp949", "euc-kr"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return _JAVA[encoding]


@contextmanager
def jvm_charsets(spark: SparkSession) -> Iterator[None]:
    """Lets the session write Korean charsets; its setting is as before afterwards."""
    name = "spark.sql.legacy.javaCharsets"
    held = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if held is None else spark.conf.set(name, held)


def _documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """One JSON document per file, or per line where files hold many (splittable)."""
    return spark.read.text(path, wholetext=not lines)


def _objects(items: Column, struct: str) -> Column:
    """Parsed objects of an array of JSON texts; what is no object is dropped."""
    return F.transform(F.filter(items, lambda x: F.ltrim(x).startswith("{")), lambda x: F.from_json(x, struct))


def _categories(value: Column, strict: bool) -> Column:
    """array<struct<key, value>> of a document's top level, values as JSON text; a bare list has the key NULL."""
    listed = F.array(F.struct(F.lit(None).cast("string").alias("key"), value.alias("value")))
    groups = F.when(value.startswith("["), listed).otherwise(F.map_entries(F.from_json(value, "map<string,string>")))
    wrong = F.try_parse_json(value).isNull() & (F.length(value) > 0)
    return F.when(wrong, F.raise_error(F.concat(F.lit("no JSON document: "), F.substring(value, 1, 200)))).otherwise(groups) if strict else groups


def read_json_by_category(spark: SparkSession, path: str, struct: str = ORG_STRUCT, lines: bool = False, strict: bool = False) -> DataFrame:
    """{category: [organizations]} flattened, the key as ``category``; a bare list as it is.

    Values that are no lists (metadata, counts) and items that are no objects are passed over. A document
    that is no JSON gives no rows, or an error where ``strict``. Without ``lines`` a file is one document; it is read
    by as many tasks as it has byte ranges (:mod:`orgloom.sources.blocks`).
    """
    if not lines:
        parsed = json_records(spark, path, strict).select("key", F.from_json("text", struct).alias("o"))
        flat = parsed.select(F.col("key").alias("__key"), "o.*")
        return flat.withColumn("category", F.coalesce("__key", "category")).drop("__key")
    doc = _documents(spark, path, lines)
    rows = doc.select(F.explode(_categories(F.trim("value"), strict)).alias("g")).filter(F.ltrim("g.value").startswith("["))
    rows = rows.select(F.col("g.key").alias("__key"), F.explode(_objects(F.from_json("g.value", "array<string>"), struct)).alias("o"))
    flat = rows.select("__key", "o.*")
    return flat.withColumn("category", F.coalesce("__key", "category")).drop("__key")


def count_json_categories(spark: SparkSession, path: str, lines: bool = False, strict: bool = False) -> DataFrame:
    """Items per top-level key over all documents: a list counts its items, anything else one, a bare list counts under 'total'."""
    groups = _documents(spark, path, lines).select(F.explode(_categories(F.trim("value"), strict)).alias("g"))
    items = F.when(F.ltrim("g.value").startswith("["), F.size(F.from_json("g.value", "array<string>"))).otherwise(1)
    return groups.groupBy(F.coalesce("g.key", F.lit("total")).alias("category")).agg(F.sum(items).alias("n"))


def read_json_wrapped(spark: SparkSession, path: str, key: str = "churches", struct: str = ORG_STRUCT, lines: bool = False) -> DataFrame:
    """{key: [...]}, a list, or a single object. Without ``lines`` a file is one document, read by as many tasks as it has byte ranges;
    only files that hold a single object are read whole."""
    if not lines:
        found = json_records(spark, path)
        listed = found.filter((F.col("top") == "[") | (F.col("key") == key)).select(F.from_json("text", struct).alias("o")).select("o.*")
        single = documents_without(spark, found, path, key)
        return listed.unionByName(_wrapped(spark.read.text([unquote(f) for f in single], wholetext=True), key, struct)) if single else listed
    return _wrapped(_documents(spark, path, lines), key, struct)


def _wrapped(documents: DataFrame, key: str, struct: str) -> DataFrame:
    value = F.trim("value")
    wrapped = F.get_json_object(value, f"$.{key}")
    items = (F.when(value.startswith("["), F.from_json(value, "array<string>"))
             .when(wrapped.isNotNull(), F.from_json(wrapped, "array<string>")).otherwise(F.array(value)))
    return documents.select(F.explode(_objects(items, struct)).alias("o")).select("o.*")


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines of text files; the text source keeps raw bytes, so other charsets use the CSV decoder."""
    if encoding == "utf-8":
        return spark.read.text(path)
    return spark.read.csv(path, schema="value string", sep="\u0001", quote="", encoding=java_charset(spark, encoding))


def encodings_by_file(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> dict[str, str]:
    """For each file the first encoding under which all its lines decode (the last one is not tried).

    One pass over the raw lines; one row per file and task is shuffled, one per file returned.
    """
    tried = list(encodings[:-1])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad: dict[str, list[bool]] = {}
        for batch in batches:
            for file, raw in zip(batch["file"].to_pylist(), batch["raw"].to_pylist()):
                flags = bad.setdefault(file, [False] * len(tried))
                if raw is not None and not raw.isascii():
                    for i, enc in enumerate(tried):
                        if not flags[i]:
                            try:
                                raw.decode(enc)
                            except UnicodeDecodeError:
                                flags[i] = True
        yield pa.RecordBatch.from_pydict({"file": pa.array(list(bad), pa.string()), "bad": pa.array(list(bad.values()), pa.list_(pa.bool_()))})

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("raw"))
    found = lines.mapInArrow(judge, "file string, bad array<boolean>")
    rows = found.groupBy("file").agg(*(F.max(F.col("bad")[i]).alias(f"bad{i}") for i in range(len(tried)))).collect()
    return {r.file: next((e for i, e in enumerate(tried) if not r[f"bad{i}"]), encodings[-1]) for r in rows}


def pick_encoding(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> str:
    """The encoding under which every line of all files decodes."""
    found = set(encodings_by_file(spark, path, encodings).values())
    return next((e for e in reversed(encodings) if e in found), encodings[0])


def read_csv_encodings(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS, multi_line: bool = False) -> DataFrame:
    """Header CSV files, each in whichever of the encodings fits it; a byte-order mark is dropped, columns are matched by name.

    With ``multi_line`` quoted cells may hold line breaks, and files are still read by byte ranges. Korean encodings are decoded
    in the tasks, so no session setting is needed or changed.
    """
    by_file = encodings_by_file(spark, path, encodings)
    if multi_line:
        return _by_header(csv_records(spark, path, by_file))
    files: dict[str, list[str]] = defaultdict(list)
    for file, enc in sorted(by_file.items()):
        files[enc].append(unquote(file))
    korean = [f for enc in ("cp949", "euc-kr") for f in files.pop(enc, [])]
    parts = [_by_header(csv_records(spark, korean, by_file))] if korean else []
    for enc, names in files.items() or ([] if korean else [(encodings[0], [path])]):
        df = spark.read.csv(path if len(files) == 1 and not korean else names, header=True, encoding=java_charset(spark, enc), multiLine=multi_line, quote='"', escape='"', emptyValue="",
                            enforceSchema=False)
        parts.append(df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns]))
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def _by_header(records: DataFrame) -> DataFrame:
    """Records as columns named by the first record of their file; files with one header are read together."""
    heads = records.filter("first").select("file", F.col("cells").alias("head"))
    layouts = [r.head for r in heads.select("head").distinct().collect()]  # one row per layout
    rows = records.filter("NOT first").join(F.broadcast(heads), "file")  # one row per file
    out = None
    for head in layouts:
        names = [c.lstrip("\ufeff").strip() for c in head]
        part = rows.filter(F.col("head") == F.array(*map(F.lit, head))).select(
            *[F.nullif(F.try_element_at("cells", F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(names)])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else records.select()


def _without_first(n: int, width: int):
    """Drop the first n records of each file: those of its first split, which is read in order."""
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = defaultdict(int)
        for batch in batches:
            keep = []
            for file, start in zip(batch["__file"].to_pylist(), batch["__start"].to_pylist()):
                seen[file] += start == 0
                keep.append(start > 0 or seen[file] > n)
            yield batch.select(list(range(width))).filter(pa.array(keep, pa.bool_()))

    return drop


def read_sheet(spark: SparkSession, path: str, header_row: int = 0, encoding: str = "utf-8", multi_line: bool = False) -> DataFrame:
    """Exported sheet whose header stands below ``header_row`` title lines, in every file of ``path``.

    The first ``header_row`` + 1 records of each file are no data, wherever else they
    may occur again; rows without any value are dropped. ``multi_line`` admits line breaks
    inside quoted cells; a file is then one split. Only title and header lines visit the driver.
    """
    head = [r.value for r in _lines(spark, path, encoding).limit(header_row + 1).collect()]
    names = [c.lstrip("\ufeff").strip() or f"column{i}" for i, c in enumerate(next(csv.reader([head[header_row]])))]
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    rows = spark.read.csv(path, schema=schema, encoding=java_charset(spark, encoding), multiLine=multi_line, quote='"', escape='"', enforceSchema=True)
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"))
    return rows.mapInArrow(_without_first(header_row + 1, len(names)), schema).toDF(*names).dropna(how="all")


POSITIONS = ("name", "phone", "fax", "email", "homepage")


def read_sheet_positional(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Columns by position; rows without a name are skipped, numbers formatted when valid."""
    return positional(spark.read.csv(path, header=header, quote='"', escape='"', enforceSchema=False))


def positional(df: DataFrame) -> DataFrame:
    """The first columns of a sheet as name, phone, fax, email and homepage; rows without a name are skipped, numbers formatted when valid."""
    from orgloom.functions import phone as P
    from orgloom.functions.blank import is_filled

    named = df.select(*[F.coalesce(F.col(df.columns[i]), F.lit("")).alias(n) for i, n in enumerate(POSITIONS) if i < len(df.columns)])
    tidy = lambda c: F.when(P.valid_strict(c), P.format_phone(c)).otherwise(F.col(c)).alias(c)
    return named.filter(is_filled("name")).select("name", tidy("phone"), tidy("fax"), "email", "homepage")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A database table in parallel slices of a numeric key; filters and columns are pushed down."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options)
