"""Documents cut by byte ranges against parsing them whole."""

import csv
import io
import json
import random

import pytest

from orgloom.sources import blocks as B
from orgloom.sources import files


@pytest.fixture
def narrow(spark):
    """Ranges of a few hundred bytes."""
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}

    def set_to(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield set_to
    for k, v in held.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


ODD = ['a}b', 'x{"y":[', '\\', 'q"q', '\\"}', "중} é", "line\nend", "}}}", "", '[{"a": "b"}]', "\\\\\\"]


def record(rnd, i):
    out = {"name": f"n{i} {rnd.choice(ODD)}", "phone": rnd.choice([None, "02-1", *ODD]), "extra": {"a": [{"b": rnd.choice(ODD)}] * rnd.randrange(3), "c": {}}}
    if rnd.random() < 0.05:
        out["address"] = "}long{" * rnd.randrange(400)
    return out


def document(seed, kind):
    rnd = random.Random(seed)
    items = lambda: [rnd.choice([record(rnd, i)] * 9 + [i, "no object }", None, [record(rnd, -1)]]) for i in range(rnd.randrange(0, 60))]
    if kind == "list":
        return items()
    out = {}
    for i in range(rnd.randrange(1, 8)):
        key = f"k{i} {rnd.choice(ODD)}" + ("}" * rnd.randrange(300) if rnd.random() < 0.2 else "")
        out[key] = rnd.choice([items(), items(), items(), {"meta": record(rnd, 0), "l": [record(rnd, 0)]}, 5, "text } here", None, []])
    return out


def wanted(docs):
    out = []
    for name, doc in docs.items():
        groups = {None: doc} if isinstance(doc, list) else doc
        for key, items in groups.items():
            if isinstance(items, list):
                out += [(name, key, json.dumps(x, sort_keys=True)) for x in items if isinstance(x, dict)]
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [300, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_by_ranges_equals_whole_parse(spark, tmp_path, narrow, width, indent):
    docs = {f"d{s}.json": document(s + width, "list" if s % 3 == 0 else "object") for s in range(4)}
    for i, (name, doc) in enumerate(docs.items()):
        text = json.dumps(doc, ensure_ascii=i % 2 == 0, indent=indent) + ("\n" if i % 2 else "")
        (tmp_path / name).write_bytes((b"\xef\xbb\xbf" if i == 3 else b"") + text.encode())
    narrow(width)
    if width < 1000 and indent:
        assert B._segments(spark, str(tmp_path), "}").rdd.getNumPartitions() > 10
    got = [(r.file.rsplit("/", 1)[1], r.key, json.dumps(json.loads(r.text), sort_keys=True)) for r in B.json_records(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == wanted(docs)


@pytest.mark.parametrize("broken", ['{"a": [{"name": "x"}, {"name": "y"}', '{"a": [{"name": "x"}', '[{"name": "x}]', '[{"name": "x"}\n', '[{"name": "x"}]]', "5", "", "  \n"])
def test_broken_documents_give_nothing(spark, tmp_path, broken):
    (tmp_path / "a.json").write_text(broken)
    (tmp_path / "b.json").write_text('[{"name": "fine"}]')
    assert [r.text for r in B.json_records(spark, str(tmp_path)).collect()] == ['{"name": "fine"}']
    if broken.strip():
        with pytest.raises(Exception, match="no JSON document"):
            B.json_records(spark, str(tmp_path), strict=True).collect()


def test_readers_by_ranges(spark, tmp_path, narrow):
    doc = {"churches": [{"name": f"c{i}", "phone": "}" * (i % 5), "category": "own"} for i in range(80)], "n": 3, "centers": [{"name": "z", "homepage": ""}] * 40}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text(json.dumps([{"name": "lone", "category": "x"}]))
    narrow(300)
    got = files.read_json_by_category(spark, str(tmp_path))
    assert sorted((r.name, r.category) for r in got.collect()) == sorted([*((f"c{i}", "churches") for i in range(80)), *[("z", "centers")] * 40, ("lone", "x")])
    (tmp_path / "c.json").write_text(json.dumps({"name": "single", "phone": "1"}))
    wrapped = files.read_json_wrapped(spark, str(tmp_path))
    assert sorted(r.name for r in wrapped.collect()) == sorted([*(f"c{i}" for i in range(80)), "lone", "single"])


CELLS = ["", "plain", 'say ""no""'.replace('""', '"'), "two\nlines", "a,b", "\n\n", "중\n기관", '"', "end\r\nof line", " lead"]


@pytest.mark.parametrize("width", [150, 1 << 20])
@pytest.mark.parametrize("encoding", ["utf-8", "cp949"])
def test_csv_by_ranges_equals_whole_parse(spark, tmp_path, narrow, width, encoding):
    rnd, want = random.Random(width), {}
    for name in ("a.csv", "b.csv", "c.csv"):
        rows = [["기관명", "전화", name]] + [[rnd.choice(CELLS) for _ in range(2)] + [rnd.choice(CELLS) * rnd.choice([1, 1, 30])] for _ in range(60 if name != "c.csv" else 0)]
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator="\r\n" if name == "b.csv" else "\n").writerows(rows)
        (tmp_path / name).write_bytes(out.getvalue().encode(encoding))
        want[name] = [r for r in rows if r != [""]]
    narrow(width)
    got = B.csv_records(spark, str(tmp_path), encoding).collect()
    by_file = {n: sorted(list(r.cells) for r in got if r.file.endswith(n)) for n in want}
    assert by_file == {n: sorted(rows) for n, rows in want.items()}
    assert sorted((r.file.rsplit("/", 1)[1], r.cells[0]) for r in got if r.first) == [(n, "기관명") for n in sorted(want)]


def test_multi_line_csv_reader(spark, tmp_path, narrow):
    for name, enc in (("a.csv", "utf-8-sig"), ("b.csv", "cp949")):
        (tmp_path / name).write_bytes(('기관명,메모\n' + "".join(f'"{name}{i}","첫 줄\n""둘째"" 줄"\n' for i in range(30))).encode(enc))
    narrow(200)
    df = files.read_csv_encodings(spark, str(tmp_path), multi_line=True)
    assert df.columns == ["기관명", "메모"]
    assert sorted(map(tuple, df.collect())) == sorted((f"{n}{i}", '첫 줄\n"둘째" 줄') for n in ("a.csv", "b.csv") for i in range(30))
