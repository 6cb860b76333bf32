"""Assembly of node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.functions.fixed_values import GENERAL_NAMES, PLACE_ALIASES
from fathom.operators.graph import ground
from fathom.operators.traverse import closure


def first_per(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_first = 1").drop("_first")


def load(nodes: DataFrame, edges: DataFrame, *order: Column | str) -> tuple[DataFrame, DataFrame]:
    """Nodes without later rows of the same curie, and edges whose ends both exist; edges aren't deduplicated."""
    kept = first_per(nodes, "curie", *order)
    known = kept.select("curie")
    good = edges.join(known.withColumnRenamed("curie", "src"), "src", "left_semi").join(known.withColumnRenamed("curie", "dst"), "dst", "left_semi")
    return kept, good.select(*edges.columns)


def consistent(edges: DataFrame, flags: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Edges whose parent has every flag of the child; flags has curie and a boolean for each of names."""
    child = flags.select(F.col("curie").alias("src"), *(F.col(n).alias(f"c_{n}") for n in names))
    parent = flags.select(F.col("curie").alias("dst"), *(F.col(n).alias(f"p_{n}") for n in names))
    rows = edges.join(child, "src").join(parent, "dst")
    for n in names:
        rows = rows.where(~F.col(f"c_{n}") | F.col(f"p_{n}"))
    return rows.select(*edges.columns)


def type_by_hierarchy(disease: Column, pathogen: Column, geoloc: Column) -> Column:
    return F.when(disease, "disease").when(pathogen, "pathogen").when(geoloc, "geoloc")


def type_by_helper(disease: Column, pathogen: Column, geoloc: Column) -> Column:
    return F.when(disease, "disease").when(geoloc, "geoloc").when(pathogen, "pathogen").otherwise("other")


def type_by_cooccurrence(disease: Column, pathogen: Column, geoloc: Column) -> Column:
    return F.when(pathogen, "pathogen").when(geoloc, "geoloc").when(disease, "disease")


def cross_referenced(pairs: DataFrame, xref: DataFrame) -> DataFrame:
    """src, dst of pairs (a, b) in the target namespace; pairs with an unmapped side go."""
    one = lambda side, out: xref.select(F.col("id").alias(side), F.col("target").alias(out))
    return pairs.join(one("a", "src"), "a").join(one("b", "dst"), "b").select("src", "dst").distinct()


def year_values(wide: DataFrame, keys: list[str]) -> DataFrame:
    """keys, years_data: columns named by years as a map of rounded values; cells that aren't numbers are left out."""
    years = [c for c in wide.columns if c[:4].isdigit() and len(c) >= 4]
    long = wide.unpivot(keys, years, "year", "value")
    number = F.when(F.col("value").rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"), F.col("value").try_cast("double"))
    rows = long.withColumn("number", F.round(number, 3)).where("number IS NOT NULL")
    return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.substring("year", 1, 4).alias("year"), "number")))).alias("years_data"))


#: Rows of a document that meet in one group at most, about: twice as many from two blocks of a wider one.
BLOCK_ROWS = 1000


def in_blocks(rows: DataFrame, *key: str, width: int = BLOCK_ROWS) -> DataFrame:
    """rows with _i, _j and _own: a document's rows in blocks by the hash of their key, once for each pair of blocks that their own is in.

    Pairs of rows of one document meet in the group (doc, _i, _j) of their
    blocks, so that a document of many rows is spread over as many groups as
    it has pairs of blocks. pair_counts() tells where a pair counts. A
    document of one block has one group and no copies.
    """
    blocks = F.ceil(F.count("*").over(Window.partitionBy("doc")) / width).cast("int")
    dealt = rows.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64(*key), F.col("_blocks")).cast("int"))
    each = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return each.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_blocks", "_other")


def pair_counts(i: Column, j: Column, own: Column, other: Column) -> Column:
    """Whether a pair counts in a group: rows of one block meet in several groups, but only that of the block with itself is theirs."""
    return (i == j) | (own != other)


def cooccurrence(terms: DataFrame, width: int = BLOCK_ROWS) -> DataFrame:
    """a, b, count, score for term pairs (a < b) of (doc, term): ln(documents with both) - ln(documents)."""
    distinct = terms.select("doc", "term").distinct()
    total = distinct.agg(F.countDistinct("doc").alias("total"))
    dealt = in_blocks(distinct, "term", width=width)
    side = lambda name: dealt.select("doc", "_i", "_j", F.col("_own").alias(f"_{name}"), F.col("term").alias(name))
    met = side("a").join(side("b"), ["doc", "_i", "_j"]).where((F.col("a") < F.col("b")) & pair_counts(F.col("_i"), F.col("_j"), F.col("_a"), F.col("_b")))
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("count"))
    return pairs.join(F.broadcast(total)).select("a", "b", "count", (F.ln("count") - F.ln("total")).alias("score"))


def plausibility(scores: DataFrame, terms: list[str]) -> DataFrame:
    """score, class of a set of terms: log of the sum of its pairs' shares; minus infinity without a pair."""
    chosen = scores.where(F.col("a").isin(terms) & F.col("b").isin(terms)).agg(F.sum(F.exp("score")).alias("total"))
    score = F.when(F.coalesce("total", F.lit(0.0)) > 0, F.ln("total")).otherwise(F.lit(float("-inf")))
    return chosen.select(score.alias("score")).withColumn("class", score_class(F.col("score")))


def score_class(score: Column) -> Column:
    """The class of a log score; null counts as low."""
    return F.when(score > -4.5, "high").when(score > -7, "medium").otherwise("low")


# -- types


def type_flags(isa: DataFrame, roots: dict[str, list[str]]) -> DataFrame:
    """curie and is_<kind> for each kind of roots: whether the node is one of the kind's roots or under it; one row for each end of isa (src, dst)."""
    spark = isa.sparkSession
    named = spark.createDataFrame([(kind, root) for kind, own in roots.items() for root in own], "kind string, root string")
    under = closure(isa, named.select(F.col("root").alias("curie"))).join(F.broadcast(named), "root")
    flags = under.groupBy("curie").agg(*(F.bool_or(F.col("kind") == k).alias(f"is_{k}") for k in roots))
    ends = isa.select(F.explode(F.array("src", "dst")).alias("curie")).distinct()
    return ends.join(flags, "curie", "left").select("curie", *(F.coalesce(f"is_{k}", F.lit(False)).alias(f"is_{k}") for k in roots))


#: Kinds of pairs that count, in either orientation.
PAIR_KINDS = (("geoloc", "pathogen"), ("disease", "pathogen"), ("geoloc", "disease"))


def pair_orientations(a: Column | dict[str, Column], b: Column | dict[str, Column]) -> Column:
    """In how many orientations a pair is one of PAIR_KINDS; each side is a type or a flag for each kind."""
    has = lambda side, kind: side[kind] if isinstance(side, dict) else side == kind
    fits = lambda x, y: sum(((has(x, p) & has(y, q)).cast("long") for p, q in PAIR_KINDS), F.lit(0).cast("long"))
    return fits(a, b) + fits(b, a)


def typed_pairs(mentions: DataFrame, flags: DataFrame, width: int = BLOCK_ROWS) -> DataFrame:
    """a, b, name_a, name_b, count: how many documents mention two typed entities of PAIR_KINDS.

    mentions has doc, curie, name; names on the stop list take no part. Pairs
    are in the order of their names, then curies, and count once for a document.
    """
    kinds = ("disease", "geoloc", "pathogen")
    typed = mentions.where(~F.col("name").isin(*GENERAL_NAMES)).select("doc", "curie", "name").distinct().join(flags, "curie")
    dealt = in_blocks(typed, "name", "curie", width=width)
    side = lambda tag: dealt.select("doc", "_i", "_j", F.col("_own").alias(f"_{tag}"), F.struct("name", "curie").alias(tag), *(F.col(f"is_{k}").alias(f"{tag}_{k}") for k in kinds))
    pairs = side("x").join(side("y"), ["doc", "_i", "_j"]).where((F.col("x") < F.col("y")) & pair_counts(F.col("_i"), F.col("_j"), F.col("_x"), F.col("_y")))
    of = lambda tag: {k: F.col(f"{tag}_{k}") for k in kinds}
    good = pairs.where(pair_orientations(of("x"), of("y")) > 0)
    return good.groupBy("x", "y").agg(F.count("*").alias("count")).select(F.col("x.curie").alias("a"), F.col("y.curie").alias("b"), F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b"), "count")


# -- assemblers: nodes and edges of the graph from their sources


def hierarchy(terms: DataFrame, isa: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed terms (curie, name) as nodes with labels, and the edges between them whose parent has every type of the child."""
    kind = type_by_hierarchy(F.col("is_disease"), F.col("is_pathogen"), F.col("is_geoloc"))
    typed = terms.join(flags, "curie").withColumn("kind", kind).where("kind IS NOT NULL")
    nodes = typed.select("curie", "name", F.array("kind", F.lit("entity")).alias("labels")).distinct()
    edges = consistent(isa.select("src", "dst"), flags, ("is_disease", "is_pathogen", "is_geoloc"))
    known = nodes.select("curie")
    edges = edges.join(known.withColumnRenamed("curie", "src"), "src", "left_semi").select("src", F.lit("isa").alias("type"), "dst").distinct()
    return nodes, edges


def outbreaks(rows: DataFrame, *order: Column | str, prefix: str = "outbreak:", alert_prefix: str = "alert:") -> tuple[DataFrame, DataFrame]:
    """Nodes (the first name of each ID) and edges alert -has_outbreak-> outbreak of rows (ID, outbreakName, archiveNumber)."""
    nodes = first_per(rows, "ID", *order).select(F.concat(F.lit(prefix), F.col("ID").cast("string")).alias("curie"), F.col("outbreakName").alias("name"), F.array(F.lit("outbreak")).alias("labels"))
    edges = rows.select(F.concat(F.lit(alert_prefix), "archiveNumber").alias("src"), F.lit("has_outbreak").alias("type"), F.concat(F.lit(prefix), F.col("ID").cast("string")).alias("dst"))
    return nodes, edges.where("src IS NOT NULL").distinct()


def alert_relations(mentions: DataFrame, dates: DataFrame, flags: DataFrame, *order: Column | str, db: str = "MESH", prefix: str = "alert:", alerts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of all alerts with the date of their first row in dates (archiveNumber, datePublished), and edges to what they mention.

    mentions has alert, db, id, name; alerts (alert) has those that mention
    nothing too, and without it only alerts with a mention are known. An alert
    is kept whatever it mentions; an edge needs the ontology's namespace, a
    type and a name off the stop list.
    """
    first = first_per(dates, "archiveNumber", *order).select(F.col("archiveNumber").alias("alert"), F.col("datePublished").alias("timestamp"))
    every = mentions.select("alert") if alerts is None else mentions.select("alert").unionByName(alerts.select("alert"))
    alerts = every.distinct().join(first, "alert", "left")
    nodes = alerts.select(F.concat(F.lit(prefix), "alert").alias("curie"), F.col("alert").alias("name"), F.array(F.lit("alert")).alias("labels"), "timestamp")
    typed = flags.where("is_disease OR is_pathogen OR is_geoloc").select(F.col("curie").alias("dst"))
    good = mentions.where((F.col("db") == db) & ~F.col("name").isin(*GENERAL_NAMES))
    edges = good.select(F.concat(F.lit(prefix), "alert").alias("src"), F.lit("mentions").alias("type"), F.concat_ws(":", "db", "id").alias("dst")).distinct()
    return nodes, edges.join(typed, "dst", "left_semi").select("src", "type", "dst")


def pathogen_edges(relations: DataFrame, xref: DataFrame, unwanted: str = "umls") -> DataFrame:
    """Edges disease -has_pathogen-> pathogen of relations (pathogen, disease), both mapped by xref (ns, id, target); pairs with an unwanted or unmapped side go."""
    good = relations.where(~F.col("pathogen").startswith(unwanted) & ~F.col("disease").startswith(unwanted))
    part = lambda c, i: F.split_part(c, F.lit(":"), F.lit(i))
    one = lambda side, out: xref.select(F.col("ns").alias(f"{side}_ns"), F.col("id").alias(f"{side}_id"), F.col("target").alias(out))
    rows = good.select(part("pathogen", 1).alias("p_ns"), part("pathogen", 2).alias("p_id"), part("disease", 1).alias("d_ns"), part("disease", 2).alias("d_id"))
    rows = rows.join(one("p", "dst"), ["p_ns", "p_id"]).join(one("d", "src"), ["d_ns", "d_id"])
    return rows.select("src", F.lit("has_pathogen").alias("type"), "dst").distinct()


def symptom_edges(relations: DataFrame, prefix: str = "mesh") -> DataFrame:
    """Edges -has_phenotype-> of relations (src, dst) whose ends both have the prefix, in upper case."""
    good = relations.where(F.col("src").startswith(prefix) & F.col("dst").startswith(prefix))
    return good.select(F.upper("src").alias("src"), F.lit("has_phenotype").alias("type"), F.upper("dst").alias("dst")).distinct()


def renamed(column: Column, aliases: dict[str, str]) -> Column:
    """A name's alias, else the name."""
    if not aliases:
        return column
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), column), column)


def grounded_places(places: DataFrame, dictionary: DataFrame, namespaces: list[str], aliases: dict[str, str] = PLACE_ALIASES) -> DataFrame:
    """name, curie of each different name of places: its alias, else itself, normalised and looked up in the dictionary by namespaces in their order; null if it is unknown."""
    names = places.select("name").distinct().withColumn("plain", T.normalised(renamed(F.col("name"), aliases)))
    found = ground(names.select(F.col("plain").alias("name")).distinct(), dictionary, namespaces)
    return names.join(found.withColumnRenamed("name", "plain"), "plain", "left").select("name", "curie")


def without_series(rows: DataFrame, others: DataFrame, code: str) -> DataFrame:
    """rows whose series code others doesn't have."""
    return rows.join(others.select(code).distinct(), code, "left_anti").select(*rows.columns)


def first_curies(nodes: DataFrame) -> DataFrame:
    """name, curie: the smallest curie of each name, whatever its label."""
    return nodes.groupBy("name").agg(F.min("curie").alias("curie"))


def indicator_graph(wide: DataFrame, nodes: DataFrame, aliases: dict[str, str], prefix: str = "wdi:") -> tuple[DataFrame, DataFrame]:
    """Indicator nodes and edges place -has_indicator-> indicator of a wide table (country, code, series, then columns named by years).

    Countries are places by alias or name; others are left out. Of nodes with
    one name the smallest curie stands for it, whatever its label.
    """
    named = wide.withColumn("country", renamed(F.col("country"), aliases))
    places = nodes.where(F.array_contains("labels", "geoloc")).select(F.col("name").alias("country")).distinct()
    known = named.join(places, "country", "left_semi")
    found = known.select(F.concat(F.lit(prefix), "code").alias("curie"), F.col("series").alias("name"), F.array(F.lit("indicator")).alias("labels")).distinct()
    curies = first_curies(nodes).select(F.col("name").alias("country"), F.col("curie").alias("src"))
    folded = year_values(known, ["country", "code"])
    edges = folded.join(curies, "country").select("src", F.lit("has_indicator").alias("type"), F.concat(F.lit(prefix), "code").alias("dst"), "years_data")
    return found, edges


def place_graph(places: DataFrame, part_of: DataFrame, grounded: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places outside the ontology as nodes, and edges child -isa-> parent with parents under their ontology curie where there is one.

    places has curie, name; part_of child, parent; grounded name, curie (null
    if unknown); known the curies of the ontology's nodes. A place counts as
    grounded if its curie is among them.
    """
    mapped = places.join(grounded.where("curie IS NOT NULL").select("name", F.col("curie").alias("mapped")), "name").join(known.select(F.col("curie").alias("mapped")).distinct(), "mapped", "left_semi").select("curie", "mapped")
    nodes = places.join(mapped, "curie", "left_anti").select("curie", "name", F.array(F.lit("geoloc")).alias("labels")).distinct()
    own = part_of.join(nodes.select(F.col("curie").alias("child")), "child", "left_semi")
    edges = own.join(mapped.select(F.col("curie").alias("parent"), "mapped"), "parent", "left").select(F.col("child").alias("src"), F.lit("isa").alias("type"), F.coalesce("mapped", "parent").alias("dst")).distinct()
    return nodes, edges


def load_files(node_files: list[DataFrame], edge_files: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """load() of files in their order: of nodes with one curie that of the first file stays, in a file the smallest row; edges of all files follow."""
    tagged = [f.withColumn("_file", F.lit(i)) for i, f in enumerate(node_files)]
    nodes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    edges = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), edge_files)
    kept, good = load(nodes, edges, "_file", F.struct(*[c for c in nodes.columns if c not in ("_file", "curie")]))
    return kept.drop("_file"), good


# -- contexts


def geo_counts(sentences: DataFrame) -> DataFrame:
    """text, geoid, count of the places in sentences (geolocs array<struct<text, geoID>>), the most frequent first; a missing id is a group."""
    rows = sentences.select(F.explode("geolocs").alias("g")).select("g.text", F.col("g.geoID").alias("geoid"))
    return rows.groupBy("text", "geoid").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "text", "geoid")


def time_counts(sentences: DataFrame) -> DataFrame:
    """text, intervals, count of the time expressions in sentences (timexes array<struct<text, intervals array<map>>>), the most frequent first; start and end of each interval joined, none is an empty string."""
    rows = sentences.select(F.explode("timexes").alias("t")).select("t.text", F.coalesce("t.intervals", F.array().cast("array<map<string,string>>")).alias("i"))
    text = F.array_join(F.transform("i", lambda x: F.concat_ws("/", F.try_element_at(x, F.lit("start")), F.try_element_at(x, F.lit("end")))), ",")
    return rows.groupBy("text", text.alias("intervals")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "text", "intervals")


def bare_times(timexes: Column, *names: str) -> Column:
    """Time expressions whose intervals lack the named bookkeeping keys."""
    return F.transform(timexes, lambda t: F.struct(t["text"].alias("text"), F.transform(t["intervals"], lambda x: F.map_filter(x, lambda k, v: ~k.isin(*names))).alias("intervals")))
