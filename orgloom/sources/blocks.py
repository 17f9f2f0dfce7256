"""Large documents that hold many records, read block by block.

One JSON document, or a CSV file with line breaks inside quoted cells, can't be cut at any line: whether a place lies inside a
string, and how deep, depends on all that stands before. Here Spark deals the file out by byte ranges (the
text source, with a closing brace or a line end as separator), and

1. every block tells its effect for each state it may be entered in: outside or inside a string, and how
   much deeper it ends than it begins;
2. the effects of a file's blocks, one small row each, are composed in order, which gives each block the state it is entered in;
3. every block is cut into records, side by side. A record that crosses blocks leaves pieces that are joined by a shuffle of those pieces alone.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgloom.session import stored

_QUOTE, _BACKSLASH = 0x22, 0x5C
_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_STRUCTURE = _STEP != 0
_STRUCTURE[ord(",")] = True


def _segments(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """(file, start, size, value): what stands between separators, in order within each byte range of a file."""
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Rows of one block each, in order."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        start = batch["start"].to_numpy()
        turn = start[1:] != start[:-1]
        if n > 1:
            turn |= np.asarray(pc.not_equal(batch["file"].slice(1), batch["file"].slice(0, n - 1)))
        cuts = [0, *(np.flatnonzero(turn) + 1).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield (batch["file"][a].as_py(), int(start[a])), batch.slice(a, b - a)


def _bytes(rows: pa.RecordBatch, separator: bytes) -> bytes:
    values = rows["value"].to_pylist()
    return separator.join(values) + separator


# --- JSON ----------------------------------------------------------------------

def structure(raw: bytes, inside: bool) -> tuple[np.ndarray, bool]:
    """(places of braces, brackets and commas outside strings, whether the bytes end inside a string). ``raw`` begins behind a closing brace or a file's start."""
    data = np.frombuffer(raw, np.uint8)
    quotes = np.flatnonzero(data == _QUOTE)
    slash = data == _BACKSLASH
    if slash.any() and len(quotes):
        last_other = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
        before = np.where(quotes > 0, quotes - 1 - last_other[quotes - 1], 0)
        quotes = quotes[before % 2 == 0]
    marks = np.flatnonzero(_STRUCTURE[data])
    outside = (np.searchsorted(quotes, marks) + inside) % 2 == 0
    return marks[outside], bool((len(quotes) + inside) % 2)


def _json_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: for being entered outside and inside a string whether it ends inside one, and by how much deeper; its first byte that is no space, bytes."""
    blocks: dict[tuple[str, int], dict] = {}
    for key, rows in _stretches(batches):
        own = blocks.setdefault(key, {"file": key[0], "start": key[1], "size": rows["size"][0].as_py(), "ends": [False, True], "deeper": [0, 0], "top": None, "bytes": 0})
        raw = _bytes(rows, b"}")
        data = np.frombuffer(raw, np.uint8)
        for state in (0, 1):
            marks, own["ends"][state] = structure(raw, own["ends"][state])
            own["deeper"][state] += int(_STEP[data[marks]].sum())
        own["bytes"] += len(raw)
        if own["top"] is None:
            own["top"] = raw.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("latin-1") or None
    yield pa.RecordBatch.from_pylist(list(blocks.values()), pa.schema([
        ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("ends", pa.list_(pa.bool_())), ("deeper", pa.list_(pa.int64())),
        ("top", pa.string()), ("bytes", pa.int64())]))


def _entered(key: tuple, table: pa.Table) -> pa.Table:
    """The state each block of a file is entered in, and whether the file ends outside strings at depth 0."""
    blocks = sorted(table.to_pylist(), key=lambda b: b["start"])
    inside, depth, top, out = False, 0, None, []
    for b in blocks:
        top = top or b["top"]
        out.append({"file": b["file"], "start": b["start"], "inside": inside, "depth": depth, "top": top})
        depth += b["deeper"][inside]
        inside = b["ends"][inside]
    # the separator that was added to the last piece is part of the file, or not (a byte-order mark of three bytes isn't counted)
    added = (sum(b["bytes"] for b in blocks) - blocks[0]["size"]) in (1, -2)
    for row in out:
        row["whole"] = not inside and depth + added == 0
    return pa.Table.from_pylist(out, pa.schema([("file", pa.string()), ("start", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64()), ("top", pa.string()), ("whole", pa.bool_())]))


_PIECES = "file string, start bigint, what string, top string, key string, kind string, pending int, text string"
_PIECES_ARROW = pa.schema([(n, pa.int64() if n == "start" else pa.int32() if n == "pending" else pa.string())
                           for n in ("file", "start", "what", "top", "key", "kind", "pending", "text")])


def _key(text: bytes) -> str | None:
    """The last string before a colon."""
    at = text.rfind(b":")
    text = text[:at].strip() if at >= 0 else b""
    try:
        return json.loads(text[text.index(b'"'):].decode("utf-8", "replace")) if b'"' in text else None
    except json.JSONDecodeError:
        return None


class _Cutter:
    """Cuts a block of a JSON document into records: objects in the top list, or in lists that are values of the top object.

    The list a record belongs to is (key, kind of bracket, pending): pending 0 is known, 1 was opened before the block, 2 is
    opened first in the block, but its key may begin before it.
    """

    def __init__(self, name: tuple[str, int], inside: bool, depth: int, top: str):
        self.name, self.inside, self.depth, self.top = name, inside, depth, top
        self.level = 1 if top == "[" else 2
        self.group: tuple[str | None, str | None, int] = (None, None, 1)
        self.gap: bytes | None = b"" if depth == 1 else None  # text of the top object since its last comma, outside its values
        self.known = False  # whether the gap begins in this block
        self.head: bytes | None = None
        self.opened = False
        self.open: list[bytes] | None = [] if depth > self.level else None
        self.carried, self.closed = depth > self.level, False
        self.owner = self.group
        self.rows: list[tuple] = []

    def _row(self, what: str, group: tuple, text: bytes) -> None:
        self.rows.append((*self.name, what, self.top, *group, text.decode("utf-8", "replace")))

    def feed(self, raw: bytes) -> list[tuple]:
        data = np.frombuffer(raw, np.uint8)
        marks, self.inside = structure(raw, self.inside)
        code = data[marks]
        step = _STEP[code]
        after = self.depth + np.cumsum(step)
        before = after - step
        places, groups = self._groups(raw, marks, code, step, before, after) if self.top == "{" else ([], [self.group])
        opens = marks[(code == ord("{")) & (before == self.level)]
        closes = marks[(code == ord("}")) & (after == self.level) & (step < 0)]
        ends = closes.tolist()
        if self.open is not None:
            back = np.flatnonzero((after == self.level) & (step < 0))
            if not len(back):
                self.open.append(raw)
            else:
                if code[back[0]] == ord("}"):  # else the block began inside a nested list
                    text = b"".join([*self.open, raw[:ends.pop(0) + 1]])
                    self._row("piece" if self.carried else "record", self.owner, text)
                    self.closed |= self.carried
                self.open, self.carried = None, False
        owners = np.searchsorted(np.array(places, np.int64), opens)
        for k, begin in enumerate(opens.tolist()):
            group = groups[owners[k]]
            if k < len(ends):
                self._row("record", group, raw[begin:ends[k] + 1])
            else:
                self.open, self.owner, self.carried = [raw[begin:]], group, False
        if len(after):
            self.depth = int(after[-1])
        out, self.rows = self.rows, []
        return out

    def _groups(self, raw, marks, code, step, before, after) -> tuple[list[int], list[tuple]]:
        """Places where values of the top object open, and the list that records belong to before, between and behind them."""
        places, groups, begin = [], [self.group], 0
        turns = np.flatnonzero(((step > 0) & (before <= 1)) | ((step < 0) & (after <= 1)) | ((step == 0) & (before == 1)))
        for t in turns.tolist():
            at = int(marks[t])
            if step[t] > 0 and before[t] == 1:
                text = (self.gap or b"") + raw[begin:at]
                if self.known:
                    self.group = (_key(text), chr(code[t]), 0)
                else:
                    self.head, self.group = text, (None, chr(code[t]), 2)
                self.opened, self.gap, self.known = True, None, True
                places.append(at)
                groups.append(self.group)
            elif after[t] <= 1:
                self.gap, begin = b"", at + 1
                self.known = True
        if self.gap is not None:
            self.gap += raw[begin:]
        return places, groups

    def finish(self) -> list[tuple]:
        if self.open is not None:
            self._row("piece" if self.carried else "begin", self.owner, b"".join(self.open))
        text = lambda b: None if b is None else b.decode("utf-8", "replace")
        told = {"head": text(self.head), "opened": self.opened, "gap": text(self.gap), "known": self.known, "begins": self.open is not None and not self.carried,
                "closed": self.closed}
        self._row("block", self.group, json.dumps(told).encode())
        return self.rows


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter: _Cutter | None = None
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES_ARROW)], schema=_PIECES_ARROW)
    for name, rows in _stretches(batches):
        if rows["depth"][0].as_py() is None:
            raise ValueError(f"the byte ranges of {name[0]} changed between two passes; run the job again")
        if cutter is None or cutter.name != name:
            if cutter is not None:
                yield batch_of(cutter.finish())
            cutter = _Cutter(name, rows["inside"][0].as_py(), rows["depth"][0].as_py(), rows["top"][0].as_py())
        out = cutter.feed(_bytes(rows, b"}"))
        if out:
            yield batch_of(out)
    if cutter is not None:
        yield batch_of(cutter.finish())


def _resolved(key: tuple, table: pa.Table) -> pa.Table:
    """What the blocks of a file could not know: the list open at their beginning, the key of their first list, and the block where the record they begin in was opened."""
    key1 = kind1 = owner = None
    gap, out = "", []
    for b in sorted(table.to_pylist(), key=lambda b: b["start"]):
        told = json.loads(b["text"])
        key2 = _key((gap + told["head"]).encode()) if told["head"] is not None else None
        out.append({"file": b["file"], "start": b["start"], "key1": key1, "kind1": kind1, "key2": key2, "owner": owner})
        if told["opened"]:
            key1, kind1 = (b["key"] if b["pending"] == 0 else key2), b["kind"]
        owner = b["start"] if told["begins"] else None if told["closed"] else owner
        gap = "" if told["gap"] is None else told["gap"] if told["known"] else gap + told["gap"]
    return pa.Table.from_pylist(out, pa.schema([("file", pa.string()), ("start", pa.int64()), ("key1", pa.string()), ("kind1", pa.string()), ("key2", pa.string()), ("owner", pa.int64())]))


def json_records(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(file, top, key, text): the objects in the lists of JSON documents, one document per file, each read by as many tasks as it has byte ranges.

    A list may be the document itself (``top`` '[', no key) or a value of its object (``top`` '{', its key). Other values are passed over. A file
    that ends inside a string or a bracket gives no rows, or an error where ``strict``. Of each block one row (its state) is broadcast:
    at the default range of 128 MB less than a millionth of the data.
    """
    segments = _segments(spark, path, "}")
    effects = segments.mapInArrow(_json_effects, "file string, start bigint, size bigint, ends array<boolean>, deeper array<bigint>, top string, bytes bigint")
    states = stored(effects.groupBy("file").applyInArrow(_entered, "file string, start bigint, inside boolean, depth bigint, top string, whole boolean"), "json-blocks")
    if strict:
        broken = F.raise_error(F.concat(F.lit("no JSON document: "), F.col("file"))).cast("boolean")
        states = states.withColumn("whole", F.when(F.col("whole") & F.col("top").isin("[", "{"), True).otherwise(broken))
    # blocks of other files go unread; a block without a state must not
    joined = segments.join(F.broadcast(states), ["file", "start"], "left")
    used = joined.filter(F.col("depth").isNull() | (F.col("whole") & F.col("top").isin("[", "{")))
    pieces = stored(used.select("file", "start", "value", "inside", "depth", "top").mapInArrow(_cut, _PIECES), "json-pieces")
    told = pieces.filter("what = 'block'").groupBy("file").applyInArrow(_resolved, "file string, start bigint, key1 string, kind1 string, key2 string, owner bigint")
    rest = pieces.filter("what = 'piece' OR what = 'begin' OR (what = 'record' AND pending > 0 AND top = '{')").join(told, ["file", "start"])
    key = F.when(F.col("pending") == 0, F.col("key")).when(F.col("pending") == 1, F.col("key1")).otherwise(F.col("key2"))
    kind = F.when(F.col("pending") == 1, F.col("kind1")).otherwise(F.col("kind"))
    placed = rest.select("file", "top", "start", "what", key.alias("key"), kind.alias("kind"), "text", F.when(F.col("what") == "begin", F.col("start")).otherwise(F.col("owner")).alias("owner"))
    is_begin = F.col("what") == "begin"
    joint = placed.filter("what <> 'record' AND owner IS NOT NULL").groupBy("file", "top", "owner").agg(
        F.max(F.when(is_begin, F.col("key"))).alias("key"), F.max(F.when(is_begin, F.col("kind"))).alias("kind"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda s: s["text"]), "").alias("text"))
    columns = ["file", "top", "key", "kind", "text"]
    known = pieces.filter("what = 'record' AND (pending = 0 OR top = '[')")
    every = known.select(*columns).unionByName(placed.filter("what = 'record'").select(*columns)).unionByName(joint.select(*columns))
    return every.filter("top = '[' OR kind = '['").select("file", "top", "key", "text")


def documents_without(spark: SparkSession, records: DataFrame, path: str, key: str) -> list[str]:
    """Files whose document is an object without a list named ``key``."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    with_list = records.filter((F.col("top") == "[") | (F.col("key") == key)).select("file").distinct()
    return [r.file for r in files.join(with_list, "file", "left_anti").collect()]


# --- CSV -----------------------------------------------------------------------

def csv_records(spark: SparkSession, path: str | list[str], encodings: dict[str, str] | str = "utf-8") -> DataFrame:
    """(file, first, cells): the records of CSV files, whose quoted cells may hold line breaks; ``first`` marks each file's first record.

    Quotes are doubled inside quoted cells. ``encodings``: of all files, or by file. A file is read by as many tasks as it has byte ranges; its
    blocks are entered inside a quoted cell where an odd number of quotes stands before.
    """
    lines = _segments(spark, path, "\n")
    quotes = F.length("value") - F.length(F.regexp_replace(F.decode("value", "iso-8859-1"), '"', ""))
    per_block = lines.groupBy("file", "start").agg(F.sum(quotes.cast("long")).alias("n"))

    def entered(key: tuple, table: pa.Table) -> pa.Table:
        out, inside = [], False
        for b in sorted(table.to_pylist(), key=lambda b: b["start"]):
            out.append({"file": b["file"], "start": b["start"], "inside": inside})
            inside ^= bool(b["n"] % 2)
        return pa.Table.from_pylist(out, pa.schema([("file", pa.string()), ("start", pa.int64()), ("inside", pa.bool_())]))

    states = per_block.groupBy("file").applyInArrow(entered, "file string, start bigint, inside boolean")
    charset: Callable[[str], str] = (lambda file: encodings) if isinstance(encodings, str) else encodings.__getitem__
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("what", pa.string()), ("first", pa.bool_()), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, inside, held, carried, out = None, False, [], False, []

        def put(what: str, raw: bytes, first: bool) -> None:
            out.append({"file": name[0], "start": name[1], "what": what, "first": first, "text": raw.decode(charset(name[0]), "replace")})

        def close() -> None:
            if name is not None and held:
                put("piece" if carried else "begin", b"\n".join(held), False)

        for key, rows in _stretches(batches):
            if rows["inside"][0].as_py() is None:
                raise ValueError(f"the byte ranges of {key[0]} changed between two passes; run the job again")
            if key != name:
                close()
                name, inside, held = key, rows["inside"][0].as_py(), []
                carried, fresh = inside, key[1] == 0
            for raw in rows["value"].to_pylist():
                held.append(raw)
                inside ^= raw.count(b'"') % 2 == 1
                if inside:
                    continue
                text = b"\n".join(held)
                if carried:
                    put("piece", text + b"\n", False)
                else:
                    text = text.removesuffix(b"\r")
                    if text:
                        put("record", text, fresh)
                        fresh = False
                held, carried = [], False
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    pieces = stored(lines.join(F.broadcast(states), ["file", "start"], "left").select("file", "start", "value", "inside").mapInArrow(
        cut, "file string, start bigint, what string, first boolean, text string"), "csv-pieces")

    def owners(key: tuple, table: pa.Table) -> pa.Table:
        """The block where each piece's record begins."""
        out, owner = [], None
        for b in sorted(table.to_pylist(), key=lambda b: (b["start"], b["what"] == "begin")):
            owner = b["start"] if b["what"] == "begin" else owner
            out.append({**b, "owner": owner})
        return pa.Table.from_pylist(out, pa.schema([("file", pa.string()), ("start", pa.int64()), ("what", pa.string()), ("owner", pa.int64())]))

    crossing = pieces.filter("what <> 'record'")
    owned = crossing.select("file", "start", "what").groupBy("file").applyInArrow(owners, "file string, start bigint, what string, owner bigint")
    order = F.array_sort(F.collect_list(F.struct("start", "text")))
    joint = crossing.join(owned, ["file", "start", "what"]).groupBy("file", "owner").agg(F.array_join(F.transform(order, lambda s: s["text"]), "\n").alias("text"))
    texts = pieces.filter("what = 'record'").select("file", "first", "text").unionByName(
        joint.select("file", F.lit(False).alias("first"), F.regexp_replace("text", r"\r?\n?$", "").alias("text")))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [next(csv.reader([t.removeprefix("﻿")], strict=False)) if "\n" not in t and "\r" not in t else next(csv.reader(t.splitlines(keepends=True)))
                     for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["file"], batch["first"], pa.array(cells, pa.list_(pa.string()))], ["file", "first", "cells"])

    return texts.mapInArrow(parse, "file string, first boolean, cells array<string>")
