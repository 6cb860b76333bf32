"""What the graph's services answer beside alert search and text relations: indicators, single alerts, names by prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.tables import materialised
from fathom.operators.answers import curie_of
from fathom.operators.graph import Graph
from fathom.operators.traverse import paths


def find_indicators(graph: Graph, geolocation: str | None, part: str | None) -> DataFrame:
    """indicator, relation, place, path of places under or above a geolocation (a curie) whose indicator's name contains part; a null finds nothing.

    A place that reaches the geolocation by several paths has a row for each;
    path has the curies from the place's parent, or child, to the geolocation.
    Only paths to places with such an indicator are followed.
    """
    isa, has = graph.typed("isa"), graph.typed("has_indicator")
    target = graph.labelled("geoloc").where(F.col("curie") == F.lit(geolocation)).select("curie")
    indicators = graph.labelled("indicator").where(F.col("name").contains(F.lit(part)))
    places = materialised(has.join(indicators.select(F.col("curie").alias("dst")), "dst", "left_semi").select(F.col("src").alias("curie")).distinct())
    ways = []
    for backwards in (True, False):
        walked = paths(isa, target, None, backwards=backwards, ends=places)
        # From the geolocation outwards; turned round, the place comes first and is left out.
        whole = F.reverse(F.concat(F.array("start"), F.col("path")))
        ways.append(walked.select(F.col("node").alias("place_curie"), F.slice(whole, F.lit(2), F.size(whole) - 1).alias("path")))
    reached = ways[0].unionByName(ways[1]).distinct()
    whole_node = lambda rows, key, name: rows.select(F.col("curie").alias(key), F.struct("curie", "name", "labels", "timestamp").alias(name))
    edges = has.select(F.col("src").alias("place_curie"), F.col("dst").alias("indicator_curie"), F.struct("type", F.array_sort(F.map_entries("years_data")).alias("years_data")).alias("relation"))
    rows = reached.join(edges, "place_curie").join(whole_node(indicators, "indicator_curie", "indicator"), "indicator_curie").join(whole_node(graph.labelled("geoloc"), "place_curie", "place"), "place_curie")
    return rows.select("indicator", "relation", "place", "path").distinct()


def indicators_by_name(graph: Graph, dictionary: DataFrame, namespaces: list[str], geolocation: str | None, part: str | None) -> DataFrame:
    """find_indicators() of a place's name or curie; a name that can't be grounded finds nothing."""
    return find_indicators(graph, curie_of(geolocation, dictionary, namespaces) if geolocation else None, part)


def last_alerts(alerts: DataFrame) -> DataFrame:
    """One row per archive number: of several the one from the last file, then with the greatest text."""
    order = Window.partitionBy("archive_number").orderBy(F.desc("file"), F.desc("text"))
    return alerts.withColumn("_last", F.row_number().over(order)).where("_last = 1").drop("_last")


def alert_text(alerts: DataFrame, archive_number: str) -> str:
    """An alert's text; an unknown number raises LookupError."""
    row = last_alerts(alerts.where(F.col("archive_number") == archive_number)).select("text").first()
    if row is None:
        raise LookupError(archive_number)
    return row["text"]


def synonym_keys(synonyms: DataFrame) -> DataFrame:
    """key, match, name, curie of synonyms (match, name, curie): lower-case matches; the second one of a key, in the order of curie and match, gets `_1`, the next `_2`."""
    keyed = synonyms.withColumn("key", F.lower("match"))
    n = F.row_number().over(Window.partitionBy("key").orderBy("curie", "match", "name")) - 1
    return keyed.withColumn("_n", n).select(F.when(F.col("_n") == 0, F.col("key")).otherwise(F.concat_ws("_", "key", "_n")).alias("key"), "match", "name", "curie")


def names_from(nodes: DataFrame, prefix: str, top_n: int = 100) -> DataFrame:
    """name: the first different names that begin with a prefix in this very case, 100 at most."""
    return nodes.where(F.col("name").startswith(prefix)).select("name").distinct().orderBy("name").limit(min(top_n, 100))


def terms_by_alert(mentions: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """doc, terms: the different (db, id, name) of each document's mentions, sorted; with alerts (doc), also those without a mention, whose list is empty."""
    rows = mentions.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("db", "id", "name"))).alias("terms"))
    if alerts is None:
        return rows
    none = F.array().cast(rows.schema["terms"].dataType)
    return alerts.select("doc").distinct().join(rows, "doc", "full").select("doc", F.coalesce("terms", none).alias("terms"))


def mention_stats(mentions: DataFrame) -> DataFrame:
    """text, term_db, term_id, term_name, count: how often each surface stands for each term, the most frequent first."""
    counts = mentions.groupBy(F.col("surface").alias("text"), F.col("db").alias("term_db"), F.col("id").alias("term_id"), F.col("name").alias("term_name")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "text", "term_db", "term_id", "term_name")
