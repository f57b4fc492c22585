"""Line numbers of strict readers, ASCII in JSON lines, files of summaries."""

import json
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.sources import files


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.fixture
def folder(spark, tmp_path):
    rows = ["" if k % 7 == 3 else json.dumps({"k": k, "t": "é日" * (k % 5)}, ensure_ascii=False) for k in range(400)]
    (tmp_path / "a.jsonl").write_text("\n".join(rows) + "\n", encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("\n\n" + rows[5], encoding="utf-8")
    (tmp_path / "c.jsonl").write_text("", encoding="utf-8")
    return tmp_path


def test_lines_are_numbered_over_splits(spark, small_splits, folder):
    got = files.read_lines(spark, str(folder))
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 10
    by_file = {}
    for r in got.collect():
        by_file.setdefault(Path(r.file).name, []).append((r.line, r.value))
    for name in ("a.jsonl", "b.jsonl"):
        want = (folder / name).read_text(encoding="utf-8").split("\n")
        assert sorted(by_file[name]) == [(n, x) for n, x in enumerate(want, 1) if n < len(want) or x]
    assert "c.jsonl" not in by_file


def test_strict_reader_names_file_and_line(spark, small_splits, folder):
    rows = files.read_jsonl_strict(spark, str(folder), "k bigint, t string")
    assert sorted(r.k for r in rows.collect()) == sorted([k for k in range(400) if k % 7 != 3] + [5])
    good = (folder / "a.jsonl").read_text(encoding="utf-8").split("\n")
    for broken in ("[1]", "{1", '{"k": }', '{"k": "word"}', "7"):
        (folder / "a.jsonl").write_text("\n".join([*good[:250], broken, *good[250:]]), encoding="utf-8")
        with pytest.raises(PySparkException, match=r"line 251 is not a JSON object of the schema: .*a\.jsonl"):
            files.read_jsonl_strict(spark, str(folder), "k bigint, t string").collect()
    assert files.read_jsonl_strict(spark, str(folder / "c.jsonl"), "k bigint").count() == 0


def test_json_lines_are_ascii(spark, tmp_path):
    rows = [(1, "plain"), (2, "é日\U0001f600 \\u \"q\"\n"), (3, None), (4, "")]
    files.write_jsonl(spark.createDataFrame(rows, "`a.b` int, t string"), str(tmp_path / "out"))
    lines = sorted(x for p in (tmp_path / "out").glob("part-*") for x in p.read_bytes().decode("ascii").split("\n") if x)
    assert [json.loads(x) for x in lines] == [{"a.b": k, "t": t} for k, t in rows]
    assert lines[1] == json.dumps({"a.b": 2, "t": rows[1][1]}, separators=(",", ":"))


def test_summaries_of_many_rows_are_several_files(spark, tmp_path, monkeypatch):
    rows = spark.range(50).repartition(4)
    files.write_csv(rows, str(tmp_path / "one"))
    monkeypatch.setattr(files, "SUMMARY_ROWS", 10)
    files.write_csv(rows, str(tmp_path / "more"))
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1 < len(list((tmp_path / "more").glob("*.csv")))
    for name in ("one", "more"):
        assert spark.read.csv(str(tmp_path / name), header=True, schema="id bigint").agg(F.sum("id")).first()[0] == 1225
