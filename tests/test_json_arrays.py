"""JSON arrays read in slices, against the json module."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import types as T

from shelfmargin.sources.files import read_documents, write_table
from shelfmargin.sources.json_arrays import read_json_array

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("inner", T.StructType([T.StructField("list", T.ArrayType(T.StringType()))])),
    ]
)


def records(n, seed=1):
    """Objects whose strings hold quotes, braces, brackets, backslashes and letters of several bytes."""
    rng = random.Random(seed)
    pieces = ['"', "{", "}", "[", "]", "\\", '\\"', "},{", "é", "語", "a", "\n", ", ", '"]}']

    def text():
        return "".join(rng.choices(pieces, k=rng.randrange(12)))

    return [{"id": k, "text": text(), "inner": {"list": [text() for _ in range(rng.randrange(3))]}} for k in range(n)]


def ids_and_texts(df):
    return sorted((r.id, r.text, tuple(r.inner.list) if r.inner else None) for r in df.collect())


def expected(rows):
    return sorted((r["id"], r["text"], tuple(r["inner"]["list"])) for r in rows)


@pytest.mark.parametrize("style", ["indent", "compact", "unescaped", "lines", "joined", "marked"])
@pytest.mark.parametrize("size", [17, 1000, 1 << 20])
def test_every_record_once_at_every_cut(spark, tmp_path, style, size):
    rows = records(6 if size < 64 else 60, seed=size)
    path = tmp_path / "export.json"
    if style == "lines":
        text = "\n".join(json.dumps(r) for r in rows) + "\n"
    elif style == "joined":
        text = "".join(json.dumps(r) for r in rows)
    else:
        text = json.dumps(rows, indent=2 if style == "indent" else None, ensure_ascii=style not in ("unescaped", "marked"))
    path.write_bytes((b"\xef\xbb\xbf \n" if style == "marked" else b"") + text.encode())
    assert ids_and_texts(read_json_array(spark, str(path), SCHEMA, slice_bytes=size)) == expected(rows)


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "export.json"
    path.write_text(json.dumps(records(400), indent=2))
    got = read_json_array(spark, f"file:{path}", SCHEMA, slice_bytes=2048)
    assert got.rdd.getNumPartitions() == -(-path.stat().st_size // 2048) > 10
    assert len([n for n in got.rdd.glom().map(len).collect() if n]) > 10


def test_long_runs_of_backslashes_and_long_records(spark, tmp_path):
    rows = [{"id": k, "text": "\\" * (9000 + k) + '"}', "inner": {"list": []}} for k in range(5)]
    path = tmp_path / "export.json"
    path.write_text(json.dumps(rows))
    assert ids_and_texts(read_json_array(spark, str(path), SCHEMA, slice_bytes=1001)) == expected(rows)


@pytest.mark.parametrize("text", ["", " \n", "[]", "[\n]", " [ ] "])
def test_nothing_in_it(spark, tmp_path, text):
    path = tmp_path / "export.json"
    path.write_text(text)
    assert read_json_array(spark, str(path), SCHEMA, slice_bytes=2).collect() == []


@pytest.mark.parametrize(
    "text", ['[{"id": 1}, 2]', '[[{"id": 1}]]', '[{"id": 1}', '[{"id": 1}, {"id": ', '{"id": 1', '[{"id": 1}, "x"]', "[null]"]
)
@pytest.mark.parametrize("size", [3, 100])
def test_what_is_no_list_of_objects_stops_the_job(spark, tmp_path, text, size):
    path = tmp_path / "export.json"
    path.write_text(text)
    with pytest.raises(Exception, match="an element is no object|text outside|ends inside"):
        read_json_array(spark, str(path), SCHEMA, slice_bytes=size).collect()


def test_missing_and_compressed_paths(spark, tmp_path):
    with pytest.raises(ValueError, match="no such path"):
        read_json_array(spark, str(tmp_path / "none.json"), SCHEMA)
    (tmp_path / "a.json.gz").write_bytes(b"x")
    with pytest.raises(ValueError, match="compressed"):
        read_json_array(spark, str(tmp_path), SCHEMA)


def test_arrays_are_written_and_read_again(spark, tmp_path):
    rows = records(50) + [{"id": None, "text": None, "inner": None}]
    table = spark.createDataFrame([(r["id"], r["text"], (r["inner"]["list"],) if r["inner"] else None) for r in rows], SCHEMA)
    out = str(tmp_path / "out")
    write_table(table.repartition(3), out, "json_array")
    parts = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part-*")]
    assert sum(map(len, parts)) == 51 and all(set(r) == {"id", "text", "inner"} for p in parts for r in p)
    got = read_documents(spark, out, SCHEMA, fmt="json_array")
    assert sorted(map(str, got.collect())) == sorted(map(str, table.collect()))
