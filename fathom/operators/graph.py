"""A property graph as two tables, and a pattern builder over it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.tables import materialised, sent
from fathom.functions.text import normalised
from fathom.operators.traverse import closure


@dataclass(frozen=True)
class Graph:
    """Nodes and edges; ancestors may have, for types of edges in alphabetical order, the stored table of what reaches what over them."""

    nodes: DataFrame
    edges: DataFrame
    ancestors: dict[tuple[str, ...], DataFrame] = field(default_factory=dict)

    def labelled(self, label: str) -> DataFrame:
        return self.nodes.where(F.array_contains("labels", label))

    def typed(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))

    def under(self, curies: list[str], *types: str) -> DataFrame:
        """curie, root: the nodes that reach each of some nodes over edges of the types, itself included; a range of a stored table if there is one, else a walk level by level."""
        known = self.nodes.where(F.col("curie").isin(curies)).select("curie")
        if (stored := self.ancestors.get(tuple(sorted(types)))) is None:
            return closure(self.typed(*types), known)
        # A node without such edges isn't in the table.
        return stored.where(F.col("root").isin(curies)).select("curie", "root").unionByName(known.select("curie", F.col("curie").alias("root"))).distinct()

    def reach(self, curie: str, *types: str, label: str | None = None) -> DataFrame:
        """curie of the nodes that reach a node with the given curie, and label if one is asked for, over edges of the types."""
        found = self.under([curie], *types)
        if label:
            found = found.join(self.labelled(label).where(F.col("curie") == curie).select(F.col("curie").alias("root")), "root", "left_semi")
        return found.select("curie").distinct()


class Match:
    """Conjunctive patterns, one column per variable.

    Match(graph).node("a", "alert").edge("a", "mentions", "b").reaches("b",
    "isa", "REGION:2").rows. Patterns that share a variable join on it.
    """

    def __init__(self, graph: Graph, rows: DataFrame | None = None):
        self.graph, self.rows = graph, rows

    def _joined(self, found: DataFrame) -> Match:
        if self.rows is None:
            return Match(self.graph, found)
        shared = [c for c in found.columns if c in self.rows.columns]
        if not shared:
            raise ValueError("patterns without a common variable")
        return Match(self.graph, self.rows.join(found, shared))

    def node(self, name: str, label: str | None = None, where: Column | None = None) -> Match:
        """Nodes with a label and a condition on curie, name, labels and timestamp."""
        nodes = self.graph.labelled(label) if label else self.graph.nodes
        return self._joined((nodes if where is None else nodes.where(where)).select(F.col("curie").alias(name)))

    def edge(self, a: str, types: str, b: str) -> Match:
        """(a)-[:types]->(b); types alternate with `|`."""
        return self._joined(self.graph.typed(*types.split("|")).select(F.col("src").alias(a), F.col("dst").alias(b)))

    def reaches(self, name: str, types: str, curie: str, label: str | None = None) -> Match:
        """(name)-[:types*0..]->(curie)"""
        return self._joined(self.graph.reach(curie, *types.split("|"), label=label).select(F.col("curie").alias(name)))

    def different(self, a: str, b: str) -> Match:
        return Match(self.graph, self.rows.where(F.col(a) != F.col(b)))

    def returns(self, *names: str, distinct: bool = False, limit: int | None = None) -> DataFrame:
        """The variables; a limit takes the first rows in their order."""
        rows = self.rows.select(*names)
        rows = rows.distinct() if distinct else rows
        if limit is None:
            return rows
        if not isinstance(limit, int) or limit < 0:
            raise ValueError("limit must be a number of rows")
        return rows.orderBy(*names).limit(limit)


def _counted(rows: DataFrame) -> tuple[int, DataFrame]:
    """Different rows, stored, and how many they are."""
    rows = materialised(rows.distinct())
    return rows.count(), rows


#: Filters of find_alerts: column, label of both ends, types of edges between them.
FILTERS = (("disease", "disease", ("isa",)), ("geoloc", "geoloc", ("isa",)), ("pathogen", "pathogen", ("isa",)), ("symptom", "disease", ("has_phenotype", "isa")))


def find_alerts(graph: Graph, disease: str | None = None, geolocation: str | None = None, pathogen: str | None = None, symptom: str | None = None, timestamp: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct alerts with a mention, and for each filter (a curie; empty means none) the mentioned node and what it is found under.

    Filters over the same types of edges share one closure. The filter with
    the fewest nodes comes first; the next ones read only mentions by alerts
    that are left. Mentions are cut down where they are read, before they are
    made distinct.
    """
    alerts = graph.labelled("alert")
    if timestamp:
        alerts = alerts.where(F.col("timestamp") == timestamp)
    rows = alerts.select(F.col("curie").alias("alert"), "timestamp")
    mentions = graph.typed("mentions").select(F.col("src").alias("alert"), F.col("dst").alias("node"))
    wanted = [(*f, curie) for f, curie in zip(FILTERS, (disease, geolocation, pathogen, symptom), strict=True) if curie]
    if not wanted:
        rows = rows.join(mentions, "alert", "left_semi")
    else:
        found = []
        for types in sorted({types for _, _, types, _ in wanted}):
            own = [(name, label, curie) for name, label, t, curie in wanted if t == types]
            reached = graph.under(sorted({curie for _, _, curie in own}), *types)
            for name, label, curie in own:
                # Of a label's many nodes Spark's estimate knows little more than the columns' widths, and would send them all.
                under = reached.where(F.col("root") == curie).join(graph.labelled(label).select("curie").hint("merge"), "curie", "left_semi")
                # The target itself may lack the label although another filter's target is the same node.
                under = under.join(graph.labelled(label).where(F.col("curie") == curie).select(F.col("curie").alias("root")), "root", "left_semi")
                found.append(under.select(F.col("curie").alias("node"), F.lit(name).alias("filter")))
        nodes = materialised(reduce(DataFrame.unionByName, found))
        sizes = {name: size for name, size in nodes.groupBy("filter").count().collect()}
        left, hits = _counted(rows.select("alert")) if timestamp else None, {}
        for name in sorted((name for name, *_ in wanted), key=lambda n: sizes.get(n, 0)):
            cuts = [(sizes.get(name, 0), nodes.where(F.col("filter") == name).select("node"))] + ([left] if left else [])
            own = mentions
            for size, few in sorted(cuts, key=lambda c: c[0]):
                own = own.join(sent(few, size), few.columns, "left_semi")
            hits[name] = materialised(own)
            if timestamp or len(wanted) > 1:
                left = _counted(hits[name].select("alert"))
        if left:
            rows = rows.join(sent(left[1], left[0]), "alert", "left_semi")
        for name, _, _, curie in wanted:
            rows = rows.join(hits[name].withColumnRenamed("node", name), "alert").withColumn(f"{name}_isa", F.lit(curie))
    rows = rows.distinct()
    return rows if limit is None else rows.orderBy(*rows.columns).limit(limit)


def text_relations(graph: Graph, curies: list[str], most: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For entities found in a text: edges between them, pairs of them that an alert mentions, and the alerts that mention most of them."""
    entities = graph.labelled("entity").where(F.col("curie").isin(curies)).select("curie")
    # The curies are on the driver, so edges are filtered where they are read and the joins get few.
    inside = graph.edges.where(F.col("src").isin(curies) & F.col("dst").isin(curies))
    direct = inside.join(entities.withColumnRenamed("curie", "src"), "src", "left_semi").join(entities.withColumnRenamed("curie", "dst"), "dst", "left_semi").select("src", "type", "dst")
    mentions = graph.typed("mentions").where(F.col("dst").isin(curies)).join(entities.withColumnRenamed("curie", "dst"), "dst", "left_semi").select(F.col("src").alias("alert"), F.col("dst").alias("entity"))
    pairs = mentions.withColumnRenamed("entity", "a").join(mentions.withColumnRenamed("entity", "b"), "alert").where("a <> b").select("alert", "a", "b")
    ranked = pairs.groupBy("alert").agg(F.array_join(F.array_sort(F.collect_set("a")), ",").alias("entities"), F.countDistinct("a").alias("n_entities"))
    return direct, pairs, ranked.orderBy(F.desc("n_entities"), "alert").limit(most)


def completions(nodes: DataFrame) -> DataFrame:
    """key, name, curie: lower-case names, of nodes with one key the one with the greatest curie."""
    one = nodes.groupBy(F.lower("name").alias("key")).agg(F.max(F.struct("curie", "name")).alias("top"))
    return one.select("key", F.col("top.name").alias("name"), F.col("top.curie").alias("curie"))


def after_prefix(prefix: str) -> str | None:
    """The least string behind all that begin with prefix, in the order of code points; None if there is none."""
    for i in range(len(prefix), 0, -1):
        if (code := ord(prefix[i - 1])) < 0x10FFFF:
            return prefix[: i - 1] + chr(0xE000 if code + 1 == 0xD800 else code + 1)
    return None


def first_completions(keyed: DataFrame, prefix: str, top_n: int = 100) -> DataFrame:
    """The first rows of completions() with a prefix, 100 at most; a prefix with a colon finds nothing.

    The prefix is a range of keys, which readers of a table in their order,
    see write_completions(), take to skip all files and row groups but a few.
    """
    low = prefix.lower()
    rows = keyed.where(F.col("key") >= low) if ":" not in prefix else keyed.limit(0)
    if (end := after_prefix(low)) is not None:
        rows = rows.where(F.col("key") < end)
    return rows.orderBy("key").limit(min(top_n, 100))


def write_completions(nodes: DataFrame, path: str) -> None:
    """completions() as a table in the order of keys, dealt by their ranges."""
    completions(nodes).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def stored_completions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, name string, curie string").parquet(path)


def autocomplete(nodes: DataFrame, prefix: str, top_n: int = 100) -> DataFrame:
    """first_completions() of nodes without a stored table."""
    return first_completions(completions(nodes.where(F.lower("name").startswith(prefix.lower()))), prefix, top_n)


#: What each kind of autocompletion offers: a label, and whether only nodes of the ontology.
COMPLETIONS = {"alert geolocations": ("geoloc", True), "indicator geolocations": ("geoloc", False), "diseases": ("disease", False), "pathogens": ("pathogen", False), "symptoms": ("disease", False), "indicators": ("indicator", False), "alerts": ("alert", False)}


def complete(graph: Graph, kind: str, prefix: str, top_n: int = 100, ontology: str = "MESH", definitions: DataFrame | None = None) -> DataFrame:
    """match, name, curie, definition of the first names of a kind (COMPLETIONS) with a prefix, in the order of their keys; definitions has curie and definition, else it is empty."""
    label, own = COMPLETIONS[kind]
    nodes = graph.labelled(label)
    if own:
        nodes = nodes.where(F.col("curie").startswith(ontology))
    rows = autocomplete(nodes, prefix, top_n)
    if definitions is None:
        rows = rows.withColumn("definition", F.lit(""))
    else:
        rows = rows.join(definitions.select("curie", "definition"), "curie", "left").withColumn("definition", F.coalesce("definition", F.lit(""))).orderBy("key")
    return rows.select(F.col("key").alias("match"), "name", "curie", "definition")


def ground(names: DataFrame, dictionary: DataFrame, namespaces: list[str]) -> DataFrame:
    """names.name with the curie of the best entry: the namespace first in the list, then the smallest curie. A name with a colon is a curie already; unknown ones get null."""
    order = F.array_position(F.array(*map(F.lit, namespaces)), F.col("db"))
    best = dictionary.where(F.col("db").isin(namespaces)).groupBy("entry").agg(F.min(F.struct(order.alias("o"), "curie")).alias("best"))
    found = names.join(best, F.lower("name") == F.col("entry"), "left")
    return found.select("name", F.when(F.col("name").contains(":"), F.col("name")).otherwise(F.col("best.curie")).alias("curie"))


def match_score(name: Column, entry: Column) -> Column:
    """How well a name fits a dictionary's name with the same normalised form: 1 if they are alike, 0.75 but for case, 0.5 but for dashes and other marks too, 0.25 if Greek letters or Roman numbers are spelled otherwise."""
    marks = lambda x: F.array_join(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+", -1), lambda w: w != ""), " ")
    return F.when(name == entry, 1.0).when(F.lower(name) == F.lower(entry), 0.75).when(marks(name) == marks(entry), 0.5).otherwise(0.25)


def ground_scored(names: DataFrame, dictionary: DataFrame, namespaces: list[str]) -> DataFrame:
    """name, curie, score of each different name: of the entries (entry, db, name, curie) with its normalised form the one that fits best, then of the namespace first in the list, then with the smallest curie.

    A name with a colon is a curie already, with score 1; unknown ones get nulls.
    """
    order = F.array_position(F.array(*map(F.lit, namespaces)), F.col("db"))
    asked = names.select("name").distinct().withColumn("entry", F.when(~F.col("name").contains(":"), normalised(F.col("name"))))
    entries = dictionary.where(F.col("db").isin(namespaces)).select("entry", F.col("name").alias("known"), order.alias("place"), "curie")
    each = asked.join(entries, "entry", "left")
    fit = F.when(F.col("curie").isNotNull(), F.struct((-match_score(F.col("name"), F.col("known"))).alias("worse"), "place", "curie"))
    best = each.groupBy("name").agg(F.min(fit).alias("best"))
    own = F.col("name").contains(":")
    return best.select("name", F.when(own, F.col("name")).otherwise(F.col("best.curie")).alias("curie"), F.when(own, 1.0).otherwise(-F.col("best.worse")).alias("score"))
