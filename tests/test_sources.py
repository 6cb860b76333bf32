"""Files written by hand, read back and written again."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fathom import schema
from fathom.sources import files
from fathom.sources.json_dump import objects
from fathom.sources.text_files import FilesWriter

HEADER = "Published Date: 2019-11-05 07:03:21 CET\nSubject: Fever - Land\nArchive Number: 20191105.77\n"


def test_alerts(spark, tmp_path):
    body = "T\n-----\nx\n y\n--"
    for name, subject in (("a", "Old"), ("b", "Fever - Land")):
        alerts = [{"header": [HEADER.replace("Fever - Land", subject)], "body": [body]}, {"header": ["Subject: none\n"], "body": ["x"]}, {"header": [], "body": []}]
        (tmp_path / f"{name}.json").write_text(json.dumps(alerts))
    found = files.alerts(files.raw_alerts(spark, str(tmp_path / "*.json")))
    rows = sorted(found.collect(), key=lambda r: r.file)
    assert [r.subject for r in rows] == ["Old", "Fever - Land"] and str(rows[0].date) == "2019-11-05 07:03:21"
    assert [tuple(x) for x in rows[1].sections] == [("T", "x y")] and rows[1].text == "Fever - Land\n\nT\n\nx y\n\n"
    files.write_alerts(found, str(tmp_path / "out"))
    assert [r.subject for r in spark.read.json(str(tmp_path / "out")).collect()] == ["Fever - Land"]


def test_contexts(spark, tmp_path):
    sentence = {"@type": "s", "timexes": [{"text": "May", "intervals": [{"@id": "1", "start": "2016"}]}], "geolocs": [{"text": "Land"}]}
    (tmp_path / "12.txt.jsonld").write_text(json.dumps({"documents": [{"sentences": [sentence]}]}))
    row = files.contexts(spark, str(tmp_path)).first()
    assert row.id == "12" and row.sentences[0].timexes[0].intervals[0]["start"] == "2016" and row.sentences[0].geolocs[0].geoID is None


def test_tables(spark, tmp_path):
    (tmp_path / "edges.tsv").write_bytes(b':START_ID\tyears_data:string\t:TYPE\t:END_ID\r\na\t"{""2000"": 1.5}"\tisa\tb\r\n')
    row = files.tsv(spark, str(tmp_path / "edges.tsv"), "src string, years string, type string, dst string").first()
    assert tuple(row) == ("a", '{"2000": 1.5}', "isa", "b")
    (tmp_path / "o.csv").write_text('ID,outbreakName,archiveNumber,datePublished\n1,"""Flu""",20191105.10,2019-11-05\n')
    assert tuple(files.csv(spark, str(tmp_path / "o.csv"), schema.OUTBREAKS).first()) == ("1", "Flu", "20191105.10", "2019-11-05")
    rows = spark.createDataFrame([("b", "x\ty"), ("a", 'q"'), ("a", 'q"')], "k string, v string")
    files.write_tsv(rows, str(tmp_path / "out"))
    assert [tuple(r) for r in files.tsv(spark, str(tmp_path / "out"), "k string, v string").orderBy("k").collect()] == [("a", 'q"'), ("b", "x\ty")]


def test_objects_of_a_dump_are_found_from_any_byte_range(spark, tmp_path):
    rng = random.Random(3)
    words = ["a", "}", "{", '"', "\\", '\\"', "}{", "\n", "\u00e9", ",", "[", "]", '"}', ""]
    text = lambda: "".join(rng.choice(words) for _ in range(rng.randrange(9)))
    some = lambda: {"header": [text() for _ in range(rng.randrange(3))], "more": {text(): {"deep": [{}, text()]}}, "body": [text()]}
    wanted = {}
    for name, indent in (("flat", None), ("tall", 1), ("wide", None)):
        wanted[name] = [some() for _ in range(15)]
        (tmp_path / f"{name}.json").write_text(json.dumps(wanted[name], indent=indent, ensure_ascii=name == "wide"))
    for name, whole in (("none", "[]"), ("empty", ""), ("cut", '[{"a": 1}, {"b": {"c": 2}, ')):
        (tmp_path / f"{name}.json").write_text(whole)
    wanted["one"] = [some()]
    (tmp_path / "one.json").write_text(json.dumps(wanted["one"][0]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("97", "1000", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = objects(spark, str(tmp_path / "*.json"))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        rows = sorted(found.collect(), key=lambda r: (r.file, r.place))
        for name, those in wanted.items():
            assert [json.loads(r.json) for r in rows if r.file.endswith(f"/{name}.json")] == those
        assert [r.json for r in rows if r.file.endswith("/cut.json")] == ['{"a": 1}'] and not [r for r in rows if "/none." in r.file or "/empty." in r.file]


def test_files_by_name(spark, tmp_path):
    path = tmp_path / "out"
    rows = spark.createDataFrame([(f"2019.{i}", f"text {i}\n", "f") for i in range(50)] + [("2019.1", "later", "g"), ("2019.2", None, "g")], "archive_number string, text string, file string")
    files.write_texts(rows, str(path))
    assert sorted(p.name for p in path.iterdir()) == sorted(["_SUCCESS"] + [f"2019.{i}.txt" for i in range(50)])
    assert (path / "2019.1.txt").read_text() == "later" and (path / "2019.2.txt").read_text() == "" and (path / "2019.3.txt").read_text() == "text 3\n"
    files.write_alert_files(rows.where("archive_number = '2019.7'"), f"file://{path}")
    assert [p.name for p in sorted(path.iterdir())] == ["2019.7.json", "_SUCCESS"]
    assert json.loads((path / "2019.7.json").read_text()) == {"archive_number": "2019.7", "text": "text 7\n", "file": "f"}
    with pytest.raises(Exception, match="can't be a file's name"):
        files.write_texts(rows.withColumn("archive_number", F.concat(F.lit("../"), "archive_number")), str(path))


def test_many_small_files_are_read_by_a_fixed_number_of_tasks(spark, tmp_path):
    """The driver holds neither their list nor a task for every few of them."""
    for i in range(450):
        (tmp_path / f"{i}.txt").write_bytes(b"" if i == 7 else f"text {i}\n\u00e9".encode() * (1 + i % 3))
    (tmp_path / "bare").write_bytes(b"\xff")
    for hidden in ("_SUCCESS", ".bare.crc"):
        (tmp_path / hidden).write_text("x")
    (tmp_path / "deeper").mkdir()
    found = files.named_texts(spark, f"file://{tmp_path}")
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and not found.inputFiles()
    wanted = {str(i): "" if i == 7 else f"text {i}\n\u00e9" * (1 + i % 3) for i in range(450)}
    rows = found.where("name <> 'bare'").collect()
    assert len(rows) == 450 and {r.name: r.text for r in rows} == wanted
    assert found.where("name = 'bare'").select(F.hex("text")).first()[0] == "FF"


def test_a_repeated_task_leaves_one_file(tmp_path):
    writer = FilesWriter(str(tmp_path), True)
    done = [writer.write(iter([("a", "x"), ("b", "y")])) for _ in range(2)]
    (tmp_path / "_pending" / "lost").write_text("half")
    writer.commit(done)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["_SUCCESS", "a", "b"] and (tmp_path / "b").read_text() == "y"
