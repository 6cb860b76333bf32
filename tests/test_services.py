"""Indicators, single alerts, synonym keys and mention statistics on hand-made rows."""

import pytest

from fathom import schema
from fathom.operators import services
from fathom.operators.graph import Graph


def test_indicators_of_places_under_and_above(spark):
    nodes = [(x, x, ["geoloc"], None) for x in ("city", "land", "world")] + [("wdi:x", "rain x", ["indicator"], None)]
    edges = [("city", "isa", "land", None), ("land", "isa", "world", None), ("land", "has_indicator", "wdi:x", {"2000": 1.0}), ("city", "has_indicator", "wdi:x", {"2000": 3.0})]
    graph = Graph(spark.createDataFrame(nodes, schema.NODES), spark.createDataFrame(edges, schema.EDGES))
    found = lambda *a: sorted((r.place.curie, r.path, r.relation.years_data[0].value) for r in services.find_indicators(graph, *a).collect())
    assert found("land", "rain") == [("city", ["land"], 3.0), ("land", [], 1.0)]
    assert found("city", "rain") == [("city", [], 3.0), ("land", ["city"], 1.0)]
    assert found(None, "rain") == found("land", None) == found("land", "snow") == []


def test_alert_of_the_last_file(spark):
    rows = spark.createDataFrame([("1.1", "old", "f1"), ("1.1", "new", "f2"), ("2.2", "x", "f1")], "archive_number string, text string, file string")
    assert services.alert_text(rows, "1.1") == "new" and services.last_alerts(rows).count() == 2
    with pytest.raises(LookupError):
        services.alert_text(rows, "3.3")


def test_names_and_synonyms(spark):
    rows = spark.createDataFrame([("Flu", "Influenza", "b"), ("flu", "Fluke", "a"), ("FLU", "x", "c"), ("Cold", "y", "d")], "match string, name string, curie string")
    assert {(r.key, r.curie) for r in services.synonym_keys(rows).collect()} == {("flu", "a"), ("flu_1", "b"), ("flu_2", "c"), ("cold", "d")}
    assert [r.name for r in services.names_from(rows, "Flu").collect()] == ["Fluke"]


def test_terms_and_stats(spark):
    rows = spark.createDataFrame([(1, "flu", "M", "1", "Flu"), (1, "flu", "M", "1", "Flu"), (1, "cold", "M", "2", "Cold"), (2, "flu", "M", "1", "Flu")], "doc int, surface string, db string, id string, name string")
    assert {r.doc: [x.id for x in r.terms] for r in services.terms_by_alert(rows).collect()} == {1: ["1", "2"], 2: ["1"]}
    assert [tuple(r) for r in services.mention_stats(rows).collect()] == [("flu", "M", "1", "Flu", 3), ("cold", "M", "2", "Cold", 1)]
