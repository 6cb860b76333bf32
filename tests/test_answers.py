"""Answers, assemblers and sinks on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from fathom import schema
from fathom.functions import text as T
from fathom.operators import answers, assemble, literature, services
from fathom.operators.graph import Graph, complete
from fathom.sources import files


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [("MESH:1", "Flu", ["disease", "entity"], None), ("MESH:2", "Fever", ["disease", "entity"], None), ("MESH:3", "Northland", ["geoloc", "entity"], None), ("place:4", "Old Town", ["geoloc"], None), ("al:1", "1", ["alert"], "2020-01-01"), ("al:2", "2", ["alert"], None)]
    edges = [("MESH:1", "isa", "MESH:2", None), ("place:4", "isa", "MESH:3", None), ("al:1", "mentions", "MESH:1", None), ("al:1", "mentions", "MESH:3", None), ("al:2", "mentions", "place:4", None)]
    return Graph(spark.createDataFrame(nodes, schema.NODES), spark.createDataFrame(edges, schema.EDGES))


def test_text_to_answer(spark, graph):
    dictionary = answers.grounding_dictionary(graph.nodes.where(F.size("labels") > 1))
    types = spark.createDataFrame([("MESH:1", "disease"), ("MESH:2", "disease")], "curie string, type string")
    scores = spark.createDataFrame([("1", "3", -1.0), ("1", "2", -8.0)], "a string, b string, score double")
    found = answers.answer(graph, "FLU and fever in Northland; flu.", dictionary, types, scores, ["MESH"], "MESH:")
    assert sorted((r.start, r.text, r.curie, r.type) for r in found.annotations.collect()) == [(1, "flu", "MESH:1", "disease"), (3, "fever", "MESH:2", "disease"), (5, "northland", "MESH:3", "other"), (6, "flu", "MESH:1", "disease")]
    assert [tuple(r) for r in found.direct.collect()] == [("MESH:1", "isa", "MESH:2")]
    assert [tuple(r) for r in found.alerts.collect()] == [("al:1", "MESH:1,MESH:3", 2)]
    # Term 3 has no type, so that its pairs don't count.
    assert [tuple(r) for r in found.scores.collect()] == [("1", "2", -8.0)]
    assert found.score.first()["classification"] == "low"
    nothing = answers.answer(graph, "", dictionary, types, scores, ["MESH"], "MESH:")
    assert nothing.annotations.count() == 0 and nothing.score.first()["score_sum"] == float("-inf")


def test_alerts_by_name(spark, graph):
    dictionary = answers.grounding_dictionary(graph.nodes)
    search = lambda **k: sorted(r.alert for r in answers.alerts_by_name(graph, dictionary, ["MESH"], **k).collect())
    assert search(geolocation="northland") == ["al:1", "al:2"] and search(geolocation="place:4") == ["al:2"]
    assert search(geolocation="Old Town") == search(geolocation="nowhere") == [] and search(geolocation="", timestamp="") == ["al:1", "al:2"]
    assert answers.health(graph) == "OK"
    assert [tuple(r) for r in complete(graph, "alert geolocations", "N").collect()] == [("northland", "Northland", "MESH:3", "")]


def test_normalised_names(spark):
    rows = spark.createDataFrame([("Type-II β",), ("IV",), ("Foo–bar  XX",), (None,)], "x string")
    assert [r[0] for r in rows.select(T.normalised(F.col("x"))).collect()] == ["type 2 beta", "iv", "foo bar 20", None]


def test_names_of_any_length_and_spelling(spark, monkeypatch):
    names = ["Severe acute respiratory syndrome coronavirus 2", "Respiratory syndrome", "Interferon-β", "Hepatitis II", "IV fluids", "a b c d e f g h i j k l", "Sigma factor"]
    dictionary = answers.grounding_dictionary(spark.createDataFrame([(f"M:{i}", n) for i, n in enumerate(names)], "curie string, name string"))
    texts = ["SARS is severe acute respiratory syndrome coronavirus II", "interferon beta, Interferon-Β; hepatitis 2 and HEPATITIS ii by iv fluids", "a b c d e f g h i j k l", "IV", "", None, "ς factor " + "x " * 3000 + "hepatitis ii"]
    monkeypatch.setattr(T, "CHUNK_WORDS", 16)
    found = answers.annotate(spark.createDataFrame(list(enumerate(texts)), "doc int, text string"), dictionary, spark.createDataFrame([], "curie string, type string"), ["M"]).collect()
    assert sorted((r.doc, r.start, r.curie) for r in found) == [(0, 3, "M:0"), (1, 1, "M:2"), (1, 3, "M:2"), (1, 5, "M:3"), (1, 8, "M:3"), (1, 11, "M:4"), (2, 1, "M:5"), (6, 1, "M:6"), (6, 3003, "M:3")]
    assert answers.annotate(spark.createDataFrame([(1, "x")], "doc int, text string"), dictionary.limit(0), spark.createDataFrame([], "curie string, type string"), ["M"]).count() == 0


def test_long_sections_stay_linear(spark):
    body = "T\n---\n" + "x\n" * 20_000 + "--\n--"
    row = spark.createDataFrame([(body,)], "b string").select(T.sections(F.col("b")).alias("s")).first()
    assert [(s.title, len(s.content)) for s in row.s] == [("T", 39_999)] * 2


def test_assemblers(spark):
    mentions = spark.createDataFrame([("1", "MESH", "D1", "Flu"), ("1", "MESH", "D1", "Disease"), ("2", "geonames", "D1", "Flu"), ("3", "MESH", "D9", "x")], "alert string, db string, id string, name string")
    dates = spark.createDataFrame([("1", "2020-01-02", 2), ("1", "2020-01-01", 1)], "archiveNumber string, datePublished string, row int")
    flags = spark.createDataFrame([("MESH:D1", True, False, False), ("MESH:D9", False, False, False)], "curie string, is_disease boolean, is_pathogen boolean, is_geoloc boolean")
    nodes, edges = assemble.alert_relations(mentions, dates, flags, "row")
    assert {(r.name, r.timestamp) for r in nodes.collect()} == {("1", "2020-01-01"), ("2", None), ("3", None)}
    assert [tuple(r) for r in edges.collect()] == [("alert:1", "mentions", "MESH:D1")]
    a, b = (spark.createDataFrame([("n1", x), ("n2", x)], "curie string, name string") for x in ("first", "second"))
    links = spark.createDataFrame([("n1", "isa", "n2"), ("n1", "isa", "n9")], "src string, type string, dst string")
    kept, good = assemble.load_files([a, b], [links, links])
    assert {r.name for r in kept.collect()} == {"first"} and good.count() == 2


def test_sinks_and_matrix(spark, tmp_path):
    (tmp_path / "dt.csv").write_text("mesh_id,major,pmid\nD1,1,7\nD2,0,7\nD1,0,8\n")
    doc_term = files.doc_terms(spark, str(tmp_path / "dt.csv"))
    files.write_matrix(doc_term, spark.createDataFrame([("D1", "disease"), ("D2", "other")], "term string, type string"), str(tmp_path / "m"))
    matrix, types = files.matrix(spark, str(tmp_path / "m"))
    assert {tuple(r) for r in matrix.collect()} == {(7, "D1", 2), (7, "D2", 1), (8, "D1", 1)} and types.count() == 2
    assert tuple(literature.totals(matrix).first()) == (2, 2)
    kinds = F.when(F.col("term") == "D1", "disease").otherwise("other")
    rows = {r.doc: r.overlap_counts for r in literature.find_literature(matrix, "MESH:D1, MESH:D2", kinds, "MESH:").collect()}
    assert rows[7] == {"disease": 1, "other": 1}
    with pytest.raises(KeyError):
        literature.find_literature(matrix, "D1,D5", kinds)
    mentions = spark.createDataFrame([("1", "flu", 1, "M", "1", "Flu"), ("2", "flu", 1, "M", "1", "Flu"), ("2", "cold", 2, "M", "2", "Cold")], schema.MENTIONS)
    files.write_annotations(mentions, str(tmp_path / "a"))
    back = files.annotations(spark, str(tmp_path / "a"))
    files.write_stats(services.mention_stats(back), str(tmp_path / "s"))
    written = next((tmp_path / "s").glob("part-*")).read_text().splitlines()
    assert written == ["text\tterm_db\tterm_id\tterm_name\tcount", "flu\tM\t1\tFlu\t2", "cold\tM\t2\tCold\t1"]
    files.write_terms(services.terms_by_alert(back), str(tmp_path / "t"))
    assert {r.doc: [t.id for t in r.terms] for r in files.terms(spark, str(tmp_path / "t")).collect()} == {"1": ["1"], "2": ["1", "2"]}
    alerts = spark.createDataFrame([("1.1", "old", "x/f1"), ("1.1", "new\ntext", "x/f2")], "archive_number string, text string, file string")
    files.write_texts(alerts, str(tmp_path / "x"))
    assert (tmp_path / "x" / "1.1.txt").read_text() == "new\ntext"
    assert [tuple(r) for r in files.file_index(alerts).collect()] == [("1.1", ["f1", "f2"])]
