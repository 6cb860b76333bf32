"""From a text or a name to an answer: annotations, relations, alerts and scores."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.functions.fixed_values import GENERAL_TERMS
from fathom.operators import assemble
from fathom.operators.graph import FILTERS, Graph, find_alerts, ground_scored, text_relations


def grounding_dictionary(*vocabularies: DataFrame) -> DataFrame:
    """entry, db, id, name, curie of vocabularies (curie, name): entries are normalised names, db and id the curie's two parts."""
    rows = reduce(DataFrame.unionByName, [v.select("curie", "name") for v in vocabularies])
    return rows.select(T.normalised(F.col("name")).alias("entry"), F.split_part("curie", F.lit(":"), F.lit(1)).alias("db"), F.split_part("curie", F.lit(":"), F.lit(2)).alias("id"), "name", "curie").where("entry <> ''")


def annotate(documents: DataFrame, dictionary: DataFrame, types: DataFrame, namespaces: list[str]) -> DataFrame:
    """doc, start, text, name, curie, type of the mentions in documents (doc, text).

    Names of any length are found, with Greek letters and Roman numbers spelled
    either way. Of a place's entries the one of the first namespace counts,
    then the smallest id. types has curie and type; what has none is `other`.
    """
    entries = dictionary.where(F.col("db").isin(namespaces)).select("entry", "db", "id", "name")
    order = F.array_position(F.array(*map(F.lit, namespaces)), F.col("db"))
    best = entries.groupBy("entry").agg(F.min(F.struct(order.alias("o"), "db", "id", "name")).alias("best"))
    rows = T.first_mentions(documents, best).select("doc", "start", F.col("surface").alias("text"), "best.name", F.concat_ws(":", "best.db", "best.id").alias("curie"))
    return rows.join(types.select("curie", "type"), "curie", "left").select("doc", "start", "text", "name", "curie", F.coalesce("type", F.lit("other")).alias("type"))


def top_terms(documents: DataFrame, dictionary: DataFrame, namespaces: list[str], order: list[str]) -> DataFrame:
    """doc, start, text, db, id, name: the term that stands for each mention of documents (doc, text) with an entry of one of the namespaces.

    That is the mention's first term by the order of all databases, then the
    smallest id, of whatever namespace: an entry of the namespaces only lets
    the mention count.
    """
    known = dictionary.where(F.col("db").isin(order)).select("entry", "db", "id", "name")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("db"))
    best = known.groupBy("entry").agg(F.min(F.struct(place.alias("o"), "db", "id", "name")).alias("top"), F.bool_or(F.col("db").isin(namespaces)).alias("counts"))
    # All entries take part, so that one of another namespace still covers what stands inside it.
    return T.first_mentions(documents, best).where("counts").select("doc", "start", F.col("surface").alias("text"), "top.db", "top.id", "top.name")


def curies_of(annotations: DataFrame) -> DataFrame:
    """doc, curies: each document's different curies, sorted."""
    return annotations.groupBy("doc").agg(F.array_sort(F.collect_set("curie")).alias("curies"))


def pair_scores(scores: DataFrame, terms: list[str], typed: DataFrame, general: tuple[str, ...] = GENERAL_TERMS) -> DataFrame:
    """a, b, score of all pairs (a < b) of a query's terms, minus infinity for those that no document has; terms on the stop list or without a type (typed.term) take no part."""
    usable = sorted(set(terms) - set(general))
    spark = scores.sparkSession
    rows = spark.createDataFrame([(t,) for t in usable], "term string").join(typed.select("term").distinct(), "term", "left_semi")
    pairs = rows.select(F.col("term").alias("a")).join(rows.select(F.col("term").alias("b")), F.col("a") < F.col("b"))  # terms of one text
    found = scores.where(F.col("a").isin(usable) & F.col("b").isin(usable)).select("a", "b", "score")
    return pairs.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("score", F.lit(float("-inf"))).alias("score"))


def summed_score(pairs: DataFrame) -> DataFrame:
    """score_sum, classification of pair scores: the log of their sum; minus infinity without a pair."""
    total = F.sum(F.exp("score"))
    score = F.when(total > 0, F.ln(total)).otherwise(F.lit(float("-inf")))
    return pairs.agg(score.alias("score_sum")).select("score_sum", assemble.score_class(F.col("score_sum")).alias("classification"))


@dataclass(frozen=True)
class Answer:
    """What a text is about: mentions, edges between their entities, alerts that mention several, scores of pairs and of all."""

    annotations: DataFrame
    direct: DataFrame
    pairs: DataFrame
    alerts: DataFrame
    scores: DataFrame
    score: DataFrame


def answer(graph: Graph, text: str, dictionary: DataFrame, types: DataFrame, scores: DataFrame, namespaces: list[str], term_prefix: str) -> Answer:
    """The answer to one text.

    scores has a, b, score of terms, which are curies without term_prefix;
    terms are those of curies with it. A text is a driver's string, and so are
    the curies found in it; the graph is only joined with them.
    """
    spark = graph.nodes.sparkSession
    annotations = annotate(spark.createDataFrame([(0, text)], "doc int, text string"), dictionary, types, namespaces)
    curies = [r[0] for r in annotations.select("curie").distinct().orderBy("curie").collect()]
    direct, pairs, alerts = text_relations(graph, curies)
    terms = [c.removeprefix(term_prefix) for c in curies if c.startswith(term_prefix)]
    typed = types.where(F.col("curie").startswith(term_prefix)).select(F.substring("curie", len(term_prefix) + 1, 2**31 - 1).alias("term"))
    each = pair_scores(scores, terms, typed)
    return Answer(annotations.drop("doc"), direct, pairs, alerts, each, summed_score(each))


def score_text(text: str, dictionary: DataFrame, types: DataFrame, scores: DataFrame, namespace: str) -> DataFrame:
    """score_sum, classification of the terms of one namespace in a text."""
    spark = dictionary.sparkSession
    found = annotate(spark.createDataFrame([(0, text)], "doc int, text string"), dictionary, types, [namespace])
    terms = [r[0] for r in found.select(F.split_part("curie", F.lit(":"), F.lit(2))).distinct().collect()]
    typed = types.where(F.col("curie").startswith(f"{namespace}:")).select(F.split_part("curie", F.lit(":"), F.lit(2)).alias("term"))
    return summed_score(pair_scores(scores, terms, typed))


def curie_of(name: str, dictionary: DataFrame, namespaces: list[str]) -> str | None:
    """The curie of the entry that fits a name best, None if it is unknown; a name with a colon is a curie already."""
    if ":" in name:
        return name
    names = dictionary.sparkSession.createDataFrame([(name,)], "name string")
    return ground_scored(names, dictionary, namespaces).first()["curie"]


def alerts_by_name(graph: Graph, dictionary: DataFrame, namespaces: list[str], *, disease: str | None = None, geolocation: str | None = None, pathogen: str | None = None, symptom: str | None = None, timestamp: str | None = None, limit: int | None = None) -> DataFrame:
    """find_alerts() by names or curies; a name that can't be grounded gives no rows. An empty string is no filter."""
    named = dict(zip([f[0] for f in FILTERS], (disease, geolocation, pathogen, symptom), strict=True))
    found = {k: curie_of(v, dictionary, namespaces) for k, v in named.items() if v}
    if None in found.values():
        columns = ", ".join(f"{k} string, {k}_isa string" for k in found)
        return graph.nodes.sparkSession.createDataFrame([], f"alert string, timestamp string{', ' + columns if columns else ''}")
    return find_alerts(graph, disease=found.get("disease"), geolocation=found.get("geoloc"), pathogen=found.get("pathogen"), symptom=found.get("symptom"), timestamp=timestamp or None, limit=limit)


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text, for services; maps and arrays of structs nest, nulls are left out."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias(name))


def years_as_text(years: Column) -> Column:
    """A map of yearly values as JSON text, as edge files hold it."""
    return F.to_json(years)


def years_from_text(text: Column) -> Column:
    return F.from_json(text, "map<string,double>")


def health(graph: Graph) -> str:
    """`OK` if the graph's tables can be read."""
    graph.nodes.limit(1).count()
    graph.edges.limit(1).count()
    return "OK"
