"""Huge documents by many tasks: equal to the multi-line readers, whatever the byte ranges."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from transectra.sources.documents import csv_records, json_objects, read_csv_split
from transectra.sources.tables import read_json_objects, read_metadata_csv, read_provenance, read_xmp_json


@pytest.fixture(params=["300b", "128m"])
def ranges(spark, request):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


CELLS = ["plain", "", "two\nlines", 'quote "" in', "a,b", "\n\n", "é漢🎉", " spaced ", "x" * 150, '""', "\n\"\"\n,"]


def csv_text(rows, rng):
    out = ["id,text,\"odd \"\"name\"\"\nof two lines\""]
    for i in range(rows):
        cells = [rng.choice(CELLS) for _ in range(2)]
        out.append(f"{i}," + ",".join(f'"{c}"' if any(x in c for x in '",\n') or rng.random() < 0.3 else c for c in cells))
    return "\n".join(out) + "\n"


def test_csv_equals_the_multi_line_reader(spark, tmp_path, ranges):
    rng = random.Random(1)
    for k, n in enumerate((30, 1)):
        (tmp_path / f"f{k}.csv").write_bytes(csv_text(n, rng).encode())
    path = str(tmp_path / "*.csv")
    options = dict(header=True, quote='"', escape='"', nullValue="\u0000", emptyValue="", multiLine=True)
    want = spark.read.csv(path, **options)
    got = read_csv_split(spark, path)
    assert got.columns == [*want.columns, "_pos"]
    assert sorted(map(tuple, got.drop("_pos").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    order = [r.id for r in got.filter("endswith(_pos.file, 'f0.csv')").orderBy("_pos").collect()]
    assert order == [str(i) for i in range(30)]
    if ranges == "300b":
        assert csv_records(spark, path).rdd.getNumPartitions() > 1
        assert spark.read.option("lineSep", "\n").text(path).select("_metadata.file_block_start").distinct().count() > 4


def test_csv_of_odd_endings(spark, tmp_path):
    cases = {
        "cr": b"a,b\r\n1,\"x\r\ny\"\r\n2,z\r\n", "none": b"", "head": b"a,b", "blank": b"a,b\n\n1,2\n \n\n", "open": b"a,b\n1,2\n3,\"never\nclosed",
        "short": b"a,b\n1\n1,2,3\n",
    }
    got = {}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
        got[name] = [tuple(r)[:-1] for r in read_csv_split(spark, str(tmp_path / name)).collect()]
    assert sorted(got["cr"]) == [("1", "x\r\ny"), ("2", "z")] and got["none"] == [] and got["head"] == []
    assert got["blank"] == [("1", "2")] and len(got["open"]) == 2
    assert sorted(got["short"], key=repr) == sorted([("1", None), ("1", "2")], key=repr)


TEXTS = ["", "a } b { c", "] [ \" \\", "{\"x\": 1}", "line\nbreak\t", "\\\\}", "é漢🎉}", "y" * 120, "\\\"}{"]


def objects(n, rng):
    deep = lambda d: {rng.choice("kq}{"): rng.choice([deep(d - 1), [deep(d - 1)], rng.choice(TEXTS)]) if d else rng.choice(TEXTS)}
    return [{"i": i, "SourceFile": f"d/{i}.tif", "t": rng.choice(TEXTS), "n": deep(i % 4), "list": [{}, [], "}", {"a": "{"}]} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_equals_plain_parsing(spark, tmp_path, ranges, indent):
    rng = random.Random(2)
    items = objects(40, rng)
    head = ["a{b", 3, None, "}", [[]]] if indent else []
    (tmp_path / "a.json").write_text(json.dumps(head + items, indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(x) for x in items[:7]) + "\n")
    (tmp_path / "c.json").write_text(json.dumps(items[3], indent=1))
    (tmp_path / "d.json").write_text("[]\n")
    got = {}
    for r in json_objects(spark, str(tmp_path / "*.json")).collect():
        got.setdefault(r.file[-6:], []).append((r.record, json.loads(r.text)))
    ordered = {f: [x for _, x in sorted(v, key=lambda p: p[0])] for f, v in got.items()}
    assert ordered == {"a.json": items, "b.json": items[:7], "c.json": [items[3]]}


def test_lists_inside_an_envelope(spark, tmp_path, ranges):
    rng = random.Random(3)
    files = [{"name": f"n{i} }}", "sha256": f"{i:064x}", "notes": rng.choice(TEXTS), "more": {"deep": [{}, "}"]}} for i in range(30)]
    envelope = {"schema": "s {", "note": "a } b { \" c", "files": files, "total": 3}
    for k, indent in enumerate((None, 1)):
        (tmp_path / f"e{k}.json").write_text(json.dumps(envelope, indent=indent))
        got = read_provenance(spark, str(tmp_path / f"e{k}.json"), multi_line=True).collect()
        assert sorted((r.name, r.sha256) for r in got) == sorted((f["name"], f["sha256"]) for f in files)
    inner = json_objects(spark, str(tmp_path / "e0.json"), depth=2).collect()
    assert len(inner) == 30 and all(json.loads(r.text)["deep"] == [{}, "}"] for r in inner)


def test_records_equal_the_multi_line_json_reader(spark, tmp_path):
    items = objects(60, random.Random(4))
    (tmp_path / "x.json").write_text(json.dumps(items))
    schema = "i int, SourceFile string, t string"
    want = spark.read.schema(schema).json(str(tmp_path / "x.json"), multiLine=True)
    assert sorted(map(tuple, read_json_objects(spark, str(tmp_path / "x.json"), schema).collect())) == sorted(map(tuple, want.collect()))


def test_readers_keep_the_last_row(spark, tmp_path, ranges):
    tags = [{"SourceFile": f"d/{i % 5}.tif", "Credit": f"c{i} }}"} for i in range(40)]
    (tmp_path / "t.json").write_text(json.dumps(tags))
    assert {r.name: r.iptc_credit for r in read_xmp_json(spark, str(tmp_path / "t.json")).collect()} == {f"{i}.tif": f"c{35 + i} }}" for i in range(5)}
    head = "image_id,uuid,preservedfilename,cammake,cammodel,artist,copyright,dtoriginal,lat,lng\n"
    (tmp_path / "m.csv").write_text(head + "".join(f'{i},u,n{i % 3}.tif,"make\n{i}",m,a,c,d,1,2\n' for i in range(30)))
    got = {r.key: r.csv_cammake for r in read_metadata_csv(spark, str(tmp_path / "m.csv"), multi_line=True).collect()}
    assert got == {f"n{i}.tif": f"make\n{27 + i}" for i in range(3)}


def test_many_tasks_read_one_document(spark, tmp_path):
    """Byte ranges of one line: several blocks have chunks of their own."""
    (tmp_path / "one.json").write_text(json.dumps(objects(400, random.Random(5))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        raw = spark.read.option("lineSep", "}").text(str(tmp_path / "one.json"))
        assert raw.groupBy(F.spark_partition_id()).count().count() > 5
        assert json_objects(spark, str(tmp_path / "one.json")).count() == 400
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
