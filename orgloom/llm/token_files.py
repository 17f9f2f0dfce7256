"""Token ids as binary files, coded with shared static frequencies, and their parallel reader.

Format of a file (numbers are little-endian)::

    magic "LOOMANS1", version, bits, ids per block, lanes (4 x 4 bytes), digest of the frequency table (32 bytes)
    block payloads
    checkpoints: per block its place (8), bytes (4), ids (4), CRC-32 of the payload (4), CRC-32 of the ids as 32-bit numbers (4)
    documents: identifiers (8 each), whether they are set (1 each), numbers of ids (8 each)
    footer: places of checkpoints and documents, numbers of blocks, documents and ids (5 x 8), CRC-32 of header, checkpoints and documents (4), magic

The frequencies, one table for all files, are in ``frequencies.bin`` beside them. Files hold consecutive ranges of
documents by identifier. A writing task names its file by a random number and reports it; only reported files
belong to the output, so a task that ran twice, or in part, changes nothing.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgloom.llm.ans import Coder, quantised, scale_bits
from orgloom.llm.storage import tidy, written
from orgloom.llm.tokens import text_ids
from orgloom.session import checkpoint_root

MAGIC, VERSION = b"LOOMANS1", 1
BLOCK = 1 << 15  # ids of a block
GROUP = 64  # blocks coded side by side
HEADER, FOOTER = struct.Struct("<8sIIII32s"), struct.Struct("<QQQQQI8s")
POINT = np.dtype([("place", "<u8"), ("bytes", "<u4"), ("ids", "<u4"), ("payload_crc", "<u4"), ("ids_crc", "<u4")])
FILES = "part int, file string, n_ids bigint, n_docs bigint, n_blocks bigint, bytes bigint"


def _open_root(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a folder's address, and its path there."""
    if "://" not in folder and not folder.startswith("file:"):
        return arrow_fs.LocalFileSystem(), folder
    return arrow_fs.FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, serial, n, ids, counts): every document's ids with ``end_id`` behind them, and one row per task that counts all its ids."""
    from tokenizers import Tokenizer

    symbols = max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1)
    kind = "<u2" if symbols <= 1 << 16 else "<u4"
    names = ["id", "hash", "n", "ids", "counts"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = text_ids(vocabulary, spaced=True)
        counts = np.zeros(symbols, np.int64)
        for batch in batches:
            for i, j, at, ids in reader.batches(batch["text"]):
                at = at + np.arange(j - i + 1)
                raw = np.full(int(at[-1]), end_id, kind)
                inner = np.ones(len(raw), bool)
                inner[at[1:] - 1] = False
                raw[inner] = ids
                counts += np.bincount(raw, minlength=symbols)
                view, size = memoryview(raw).cast("B"), raw.itemsize
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(i, j - i), batch["hash"].slice(i, j - i), pa.array(np.diff(at)),
                     pa.array([view[size * a:size * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()), pa.nulls(j - i, pa.binary())], names)
        if counts.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.array([0]), pa.array([0]), pa.nulls(1, pa.binary()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    return rows.mapInArrow(tidy(encode), "id bigint, hash bigint, n bigint, ids binary, counts binary").withColumn("serial", F.monotonically_increasing_id())


def frequencies(tokens: DataFrame, symbols: int) -> np.ndarray:
    """How often each id occurs: one number per entry of the vocabulary reaches the driver."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["counts"].to_pylist():
                counts = np.frombuffer(zlib.decompress(raw), np.int64)
                seen = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["symbol", "n"])

    rows = tokens.filter("counts IS NOT NULL").select("counts").mapInArrow(unpack, "symbol bigint, n bigint")
    found = rows.groupBy("symbol").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(symbols, np.int64)
    out[found["symbol"].to_numpy()] = found["n"].to_numpy()
    return out


class _Writer:
    """One file: blocks are coded as soon as a group of them is full."""

    def __init__(self, folder: str, part: int, coder: Coder):
        store, path = _open_root(folder)
        self.name, self.coder = f"part-{part:06d}-{uuid.uuid4().hex}.ans", coder
        self.out = store.open_output_stream(f"{path}/{self.name}")
        self.header = HEADER.pack(MAGIC, VERSION, coder.bits, BLOCK, coder.lanes, coder.digest)
        self.out.write(self.header)
        self.place, self.waiting, self.held, self.points = len(self.header), [], 0, []

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= GROUP * BLOCK:
            self._code(self.held // BLOCK * BLOCK)

    def _code(self, n: int) -> None:
        every = np.concatenate(self.waiting)
        self.waiting, self.held = [every[n:]], len(every) - n
        whole = n // BLOCK * BLOCK
        shapes = [every[i:min(i + GROUP * BLOCK, whole)].reshape(-1, BLOCK) for i in range(0, whole, GROUP * BLOCK)]
        if whole < n:
            shapes.append(every[whole:n].reshape(1, -1))
        for ids in shapes:
            for row, payload in zip(ids, self.coder.encode(ids)):
                self.out.write(payload)
                self.points.append((self.place, len(payload), len(row), zlib.crc32(payload), zlib.crc32(row.astype("<u4"))))
                self.place += len(payload)

    def close(self, ids: list[pa.Array], sizes: list[np.ndarray]) -> tuple:
        if self.held:
            self._code(self.held)
        points = np.array(self.points, POINT)
        names = pa.concat_arrays(ids)
        size = np.concatenate(sizes).astype("<i8")
        index = points.tobytes() + names.fill_null(0).to_numpy().astype("<i8").tobytes() + np.asarray(names.is_valid()).astype(np.uint8).tobytes() + size.tobytes()
        self.out.write(index)
        documents = self.place + points.nbytes
        self.out.write(FOOTER.pack(self.place, documents, len(points), len(size), int(size.sum()), zlib.crc32(self.header + index), MAGIC))
        self.out.close()
        return self.name, int(size.sum()), len(size), len(points), documents + 17 * len(size) + FOOTER.size


def write_token_files(
    docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids_per_file: int = 1 << 23,
) -> tuple[str, DataFrame]:
    """Write the ids of all documents in ascending order of identifier; (folder, files: part, file, n_ids, n_docs, n_blocks, bytes).

    ``vocabulary`` is a byte-level tokenizers file; every document's ids end with ``end_id``. The folder (by default a new one below
    ``spark.checkpoint.dir``) must be on a store that pyarrow can open: local or mounted, HDFS, S3 or GCS.

    Null texts are empty and have ``end_id`` alone. Null identifiers come first. Rows that share an identifier follow each other by
    a hash of their text. An empty table gives no files; other columns are ignored.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    folder = folder or f"{checkpoint_root(spark)}/llm-token-files-{uuid.uuid4().hex}"
    symbols = max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1)
    kind = "<u2" if symbols <= 1 << 16 else "<u4"
    tokens = written(tokenised(docs, vocabulary, end_id, id_col, text_col), "tokens", compression="zstd")
    bits = scale_bits(symbols)
    coder = Coder(quantised(frequencies(tokens, symbols), bits), bits)
    store, path = _open_root(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/frequencies.bin") as out:
        out.write(coder.to_bytes())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        writer, ids, sizes = None, [], []
        for batch in batches:
            if not len(batch):
                continue
            writer = writer or _Writer(folder, part, coder)
            raw, _ = _flat(batch["ids"])
            writer.add(raw.view(kind))
            ids.append(batch["id"])
            sizes.append(batch["n"].to_numpy())
        if writer:
            name, n_ids, n_docs, n_blocks, size = writer.close(ids, sizes)
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "file": name, "n_ids": n_ids, "n_docs": n_docs, "n_blocks": n_blocks, "bytes": size}],
                pa.schema([("part", pa.int32()), ("file", pa.string()), *((n, pa.int64()) for n in ("n_ids", "n_docs", "n_blocks", "bytes"))]))

    rows = tokens.filter("counts IS NULL")
    total = rows.agg(F.sum("n")).first()[0] or 0
    order = ["id", "hash", "serial"]
    dealt = rows.select(*order, "n", "ids").repartitionByRange(max(1, -(-total // ids_per_file)), *order).sortWithinPartitions(*order)
    return folder, written(dealt.select("id", "n", "ids").mapInArrow(tidy(write), FILES), "token-manifest")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].copy(), at - at[0]


def _decoded(handle, coder: Coder, points: np.ndarray, first: int) -> Iterator[np.ndarray]:
    """The ids of the blocks from ``first`` on, a group at a time, each block checked."""
    while first < len(points):
        size = points["ids"][first]
        end = first + 1
        while end < min(len(points), first + GROUP + 8) and points["ids"][end] == size:
            end += 1
        some = points[first:end]
        handle.seek(int(some["place"][0]))
        raw = handle.read(int(some["bytes"].astype(np.int64).sum()))
        cut = np.cumsum([0, *some["bytes"].tolist()]).tolist()
        payloads = [raw[a:b] for a, b in zip(cut[:-1], cut[1:])]
        if any(zlib.crc32(p) != c for p, c in zip(payloads, some["payload_crc"].tolist())):
            raise ValueError("block damaged")
        ids = coder.decode(payloads, int(size))
        if any(zlib.crc32(row.astype("<u4")) != c for row, c in zip(ids, some["ids_crc"].tolist())):
            raise ValueError("block damaged")
        yield ids.reshape(-1)
        first = end


def read_token_files(folder: str, files: DataFrame, keep_ids: bool = False, blocks: int = GROUP) -> DataFrame:
    """(id, start, n_tokens, ids_crc32): one row per document, decoded from its file (with ``keep_ids`` also ids, as little-endian 32-bit numbers).

    Files are read by stretches of ``blocks`` blocks, each by the checkpoints of its file. A stretch gives the documents that begin in
    it and reads on to the end of its last one. A wrong checksum ends the job.
    """
    group = (F.col("part") / 1024).cast("int")
    sums = files.groupBy(group.alias("grp")).agg(F.sum("n_ids").alias("n"))
    ahead = sums.select("grp", (F.sum("n").over(Window.orderBy("grp")) - F.col("n")).alias("ahead"))  # one row per 1024 files
    own = F.sum("n_ids").over(Window.partitionBy("grp").orderBy("part")) - F.col("n_ids")
    placed = files.withColumn("grp", group).withColumn("own", own).join(ahead, "grp").withColumn("base", F.col("ahead") + F.col("own"))
    stretches = placed.select("file", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1, F.lit(blocks).cast("long"))).alias("first"))
    spread = stretches.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open_root(folder)
        coder = None
        for batch in batches:
            for row in batch.to_pylist():
                if coder is None:
                    with store.open_input_stream(f"{path}/frequencies.bin") as table:
                        coder = Coder.from_bytes(table.read())
                with store.open_input_file(f"{path}/{row['file']}") as handle:
                    yield from _stretch(handle, coder, row["base"], row["first"], blocks, keep_ids)

    schema = "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if keep_ids else "")
    return spread.mapInArrow(tidy(read), schema)


def _stretch(handle, coder: Coder, base: int, first: int, blocks: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    header = handle.read(HEADER.size)
    handle.seek(handle.size() - FOOTER.size)
    points_at, docs_at, n_blocks, n_docs, n_ids, crc, magic = FOOTER.unpack(handle.read(FOOTER.size))
    handle.seek(points_at)
    index = handle.read(docs_at - points_at + 17 * n_docs)
    kind, version, bits, block, lanes, digest = HEADER.unpack(header)
    if kind != MAGIC or magic != MAGIC or version != VERSION or zlib.crc32(header + index) != crc:
        raise ValueError("token file damaged")
    if (bits, lanes, digest) != (coder.bits, coder.lanes, coder.digest):
        raise ValueError("token file of another frequency table")
    points = np.frombuffer(index, POINT, n_blocks)
    at = docs_at - points_at
    names, valid = np.frombuffer(index, "<i8", n_docs, at), np.frombuffer(index, np.uint8, n_docs, at + 8 * n_docs)
    size = np.frombuffer(index, "<i8", n_docs, at + 9 * n_docs)
    start = np.cumsum(size) - size
    lo, hi = np.searchsorted(start, [first * block, (first + blocks) * block])
    if lo == hi:
        return
    ends = (start + size)[lo:hi].tolist()
    begins = start[lo:hi].tolist()
    crcs, parts = [0] * (hi - lo), [[] for _ in range(hi - lo)]
    doc, place = 0, first * block
    points = points[:-(-ends[-1] // block)]
    for ids in _decoded(handle, coder, points, first):
        view = memoryview(ids.astype("<u4")).cast("B")
        until = place + len(ids)
        while doc < len(ends):
            piece = view[4 * max(0, begins[doc] - place):4 * (min(ends[doc], until) - place)]
            crcs[doc] = zlib.crc32(piece, crcs[doc])
            if keep_ids:
                parts[doc].append(bytes(piece))
            if ends[doc] > until:
                break
            doc += 1
        place = until
        if doc == len(ends):
            break
    if doc < len(ends):
        raise ValueError("token file damaged")
    columns = [pa.array(names[lo:hi], mask=valid[lo:hi] == 0), pa.array(base + start[lo:hi]), pa.array(size[lo:hi]), pa.array(crcs, pa.int64())]
    columns += [pa.array([b"".join(p) for p in parts], pa.binary())] if keep_ids else []
    yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])
