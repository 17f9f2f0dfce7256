"""Token files: the coder, the format and damaged files, and the query against the plain tokenizer."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orgloom.llm import token_files as T
from orgloom.llm.ans import Coder, quantised, scale_bits
from orgloom.llm.queries import QUERIES, vocabulary
from tests.conftest import SMALL

PATH = vocabulary("byte_bpe_50k.json")


def plain(rows):
    """(id, start, n_tokens, crc) by the plain tokenizer; rows in order."""
    tokenizer, out, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_equals_plain_tokenizer(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = QUERIES["op12_token_files"](spark, SMALL)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


@pytest.mark.parametrize("symbols,bits", [(1, 20), (3, 20), (50257, 22), (200_000, 24)])
def test_coder_gives_back_every_id(symbols, bits):
    rnd = np.random.default_rng(symbols)
    ids = np.minimum(rnd.zipf(1.2, (5, 3000)) - 1, symbols - 1).astype(np.uint32)
    counts = np.bincount(ids.ravel(), minlength=symbols)
    table = quantised(counts, bits)
    assert table.sum() == 1 << bits and ((table > 0) == (counts > 0)).all()
    coder = Coder.from_bytes(Coder(table, bits).to_bytes())
    for n in (1, 31, 32, 33, 64, 3000):
        assert (coder.decode(coder.encode(ids[:, :n]), n) == ids[:, :n]).all()
    share = counts[counts > 0] / counts.sum()
    size = 8 * sum(len(p) - 8 * coder.lanes for p in coder.encode(ids))
    assert size <= 1.02 * ids.size * -(share * np.log2(share)).sum() + 5 * 64 * coder.lanes


def test_frequencies_of_many_rare_symbols():
    counts = np.ones(300_000, np.int64)
    counts[7] = 10**13
    table = quantised(counts, scale_bits(300_000))
    assert table.sum() == 1 << scale_bits(300_000) and table.min() == 1 and table.argmax() == 7
    assert quantised(np.zeros(5, np.int64), 20).sum() == 0


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(5, "five six"), (5, "five six"), (5, "other"), (-3, "é à la"), (None, "nobody"), (None, None), (7, None), (8, ""), (9, "long text, " * 30000),
            (10, "<|endoftext|>  x"), (11, "z" * 50000), (2**40, "far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "hash", "serial", "n", "ids", "counts", "part"):
        docs = docs.withColumn(c, F.lit("x"))
    return rows, docs


@pytest.mark.parametrize("per_file,block,group", [(1 << 23, 1 << 15, 64), (20000, 64, 3), (1000, 1000, 1)])
def test_files_and_stretches(spark, monkeypatch, odd, per_file, block, group):
    rows, docs = odd
    monkeypatch.setattr(T, "BLOCK", block)
    monkeypatch.setattr(T, "GROUP", group)
    folder, files = T.write_token_files(docs, PATH, ids_per_file=per_file)
    listed = files.orderBy("part").collect()
    got = T.read_token_files(folder, files, keep_ids=True, blocks=group).collect()
    assert len(got) == len(rows) and sum(r.n_ids for r in listed) == sum(r.n_tokens for r in got) and sum(r.n_docs for r in listed) == len(rows)
    got.sort(key=lambda r: r.start)
    assert [r.id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    end = 0
    for r in got:
        assert r.start == end and len(r.ids) == 4 * r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32
        end += r.n_tokens
    assert sorted((str(i), n, c) for i, _, n, c in plain(rows)) == sorted((str(r.id), r.n_tokens, r.ids_crc32) for r in got)


def test_unreported_files_change_nothing_and_damage_is_seen(spark, odd):
    rows, docs = odd
    folder, files = T.write_token_files(docs, PATH, ids_per_file=30000)
    _, path = T._open_root(folder)
    name = files.orderBy("part").first().file
    whole = open(f"{path}/{name}", "rb").read()
    with open(f"{path}/part-000000-left-by-a-lost-task.ans", "wb") as out:
        out.write(whole[:1000])
    assert T.read_token_files(folder, files).count() == len(rows)
    for at in (5, 60, T.HEADER.size + 300, len(whole) - 40, len(whole) - 300):
        with open(f"{path}/{name}", "wb") as out:
            out.write(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1:])
        with pytest.raises(Exception, match="damaged|another frequency table"):
            T.read_token_files(folder, files).collect()


def test_empty_table(spark, odd):
    folder, files = T.write_token_files(odd[1].limit(0), PATH)
    assert files.count() == 0 and T.read_token_files(folder, files).count() == 0
