"""The registered queries and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.functions.fixed_values import GENERAL_NAMES, GENERAL_TERMS, PLACE_ALIASES
from fathom.functions.tables import materialised, shared_folder
from fathom.operators import answers, assemble, literature, services
from fathom.operators import graph as G
from fathom.operators import pattern_query
from fathom.operators.traverse import closure, paths, stored_ancestors, write_ancestors
from fathom.sources import files
from fathom.sources import testgraph as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Registers a function under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PLACES = """SELECT 'CUST:' || c_custkey AS src, 'NATION:' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 'NATION:' || n_nationkey, 'REGION:' || n_regionkey FROM nation
  UNION ALL SELECT 'REGION:' || r_regionkey, 'GEO:world' FROM region"""
DISEASES = """SELECT 'PART:' || p_partkey AS src, 'BRAND:' || p_brand AS dst FROM part
  UNION ALL SELECT 'PART:' || p_partkey, 'TYPE:' || p_type FROM part
  UNION ALL SELECT DISTINCT 'BRAND:' || p_brand, 'DIS:root' FROM part
  UNION ALL SELECT DISTINCT 'TYPE:' || p_type, 'DIS:root' FROM part"""
PATHOGENS = "SELECT 'SUPP:' || s_suppkey AS src, 'PGRP:' || s_nationkey AS dst FROM supplier"
ISA = f"{PLACES}\n  UNION ALL {DISEASES}\n  UNION ALL {PATHOGENS}"
MENTIONS = """SELECT DISTINCT 'ORD:' || l_orderkey AS alert, 'PART:' || l_partkey AS node FROM lineitem
  UNION ALL SELECT DISTINCT 'ORD:' || l_orderkey, 'SUPP:' || l_suppkey FROM lineitem
  UNION ALL SELECT 'ORD:' || o_orderkey, 'CUST:' || o_custkey FROM orders"""
ALERTS = "SELECT 'ORD:' || o_orderkey AS alert, strftime(o_orderdate, '%Y-%m-%d') AS timestamp FROM orders"


def reach_sql(name: str, target: str, edges: str = ISA) -> str:
    return f"{name} AS (SELECT '{target}' AS curie UNION SELECT e.src FROM {name} c JOIN ({edges}) e ON e.dst = c.curie)"


def alerts_sql(filters: list[tuple[str, str, str]], where: str = "true", tail: str = "") -> str:
    """SQL of find_alerts: (column, target, edges) each."""
    ctes = ", ".join(reach_sql(f"r_{c}", target, edges) for c, target, edges in filters)
    joins = " ".join(f"JOIN m m_{c} ON m_{c}.alert = a.alert JOIN r_{c} ON r_{c}.curie = m_{c}.node" for c, _, _ in filters)
    columns = "".join(f", m_{c}.node AS {c}, '{target}' AS {c}_isa" for c, target, _ in filters)
    return f"WITH RECURSIVE a AS ({ALERTS}), m AS ({MENTIONS}){', ' + ctes if ctes else ''} SELECT DISTINCT a.alert, a.timestamp{columns} FROM a {joins} WHERE {where} AND a.alert IN (SELECT alert FROM m) {tail}"


# -- scans and filters


@query("SELECT DISTINCT 'wdi:' || p_type AS curie, 'revenue of ' || p_type AS name FROM part")
def scan_by_label(spark, d):
    return S.graph(spark, d).labelled("indicator").select("curie", "name")


@query("SELECT DISTINCT 'BRAND:' || p_brand AS curie, p_brand AS name FROM part WHERE contains(p_brand, '#1')")
def filter_contains(spark, d):
    return S.graph(spark, d).labelled("disease").where(F.col("curie").startswith("BRAND:") & F.col("name").contains("#1")).select("curie", "name")


@query("SELECT 'PART:' || p_partkey AS curie, p_name AS name FROM part WHERE ('PART:' || p_partkey) IN ('PART:1', 'PART:7', 'PART:11', 'PART:999999')")
def filter_prefix_in(spark, d):
    return S.graph(spark, d).nodes.where(F.col("curie").startswith("PART:") & F.col("curie").isin("PART:1", "PART:7", "PART:11", "PART:999999", "SUPP:1")).select("curie", "name")


@query(f"SELECT alert AS curie, timestamp FROM ({ALERTS}) WHERE alert = 'ORD:7'")
def point_lookup(spark, d):
    return S.graph(spark, d).labelled("alert").where(F.col("curie") == "ORD:7").select("curie", "timestamp")


# -- traversal


@query(f"WITH RECURSIVE {reach_sql('r', 'REGION:2')} SELECT curie FROM r")
def isa_closure_region(spark, d):
    return S.graph(spark, d).reach("REGION:2", "isa")


PHENOTYPES = f"{ISA} UNION ALL SELECT 'PART:' || p_partkey, 'SIZE:' || p_size FROM part"


@query(f"WITH RECURSIVE {reach_sql('r', 'SIZE:10', PHENOTYPES)} SELECT curie FROM r")
def closure_alternated_types(spark, d):
    return S.graph(spark, d).reach("SIZE:10", "has_phenotype", "isa")


ROOTS = {"disease": "DIS:root", "geoloc": "GEO:world", "pathogen": "PGRP:3"}


def flagged(spark: SparkSession, d: str) -> DataFrame:
    """curie and is_disease, is_geoloc, is_pathogen by the hierarchy's roots."""
    return assemble.type_flags(S.graph(spark, d).typed("isa"), {k: [v] for k, v in ROOTS.items()})


FLAGS_SQL = ", ".join(reach_sql(f"u_{k}", v) for k, v in ROOTS.items()) + f", ends AS (SELECT src AS curie FROM ({ISA}) UNION SELECT dst FROM ({ISA})), flags AS (SELECT curie, " + ", ".join(f"curie IN (SELECT curie FROM u_{k}) AS is_{k}" for k in ROOTS) + " FROM ends)"


@query(f"""WITH RECURSIVE {FLAGS_SQL} SELECT curie,
  CASE WHEN is_disease THEN 'disease' WHEN is_pathogen THEN 'pathogen' WHEN is_geoloc THEN 'geoloc' END AS by_hierarchy,
  CASE WHEN is_disease THEN 'disease' WHEN is_geoloc THEN 'geoloc' WHEN is_pathogen THEN 'pathogen' ELSE 'other' END AS by_helper,
  CASE WHEN is_pathogen THEN 'pathogen' WHEN is_geoloc THEN 'geoloc' WHEN is_disease THEN 'disease' END AS by_cooccurrence FROM flags""")
def subtree_types(spark, d):
    flags = (F.col("is_disease"), F.col("is_pathogen"), F.col("is_geoloc"))
    return flagged(spark, d).select("curie", assemble.type_by_hierarchy(*flags).alias("by_hierarchy"), assemble.type_by_helper(*flags).alias("by_helper"), assemble.type_by_cooccurrence(*flags).alias("by_cooccurrence"))


# -- alerts


@query(alerts_sql([("geoloc", "REGION:2", PLACES)]))
def alerts_by_geo(spark, d):
    return G.find_alerts(S.graph(spark, d), geolocation="REGION:2")


@query(ORACLES["alerts_by_geo"])
def alerts_by_geo_index(spark, d):
    """The same by a stored table of what lies under what."""
    graph = S.graph(spark, d)
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    write_ancestors(graph.typed("isa"), path)
    return G.find_alerts(G.Graph(graph.nodes, graph.edges, {("isa",): stored_ancestors(spark, path)}), geolocation="REGION:2")


@query(alerts_sql([("disease", "BRAND:Brand#11", DISEASES)]))
def alerts_by_disease(spark, d):
    return G.find_alerts(S.graph(spark, d), disease="BRAND:Brand#11")


@query(alerts_sql([("pathogen", "PGRP:3", PATHOGENS)]))
def alerts_by_pathogen(spark, d):
    return G.find_alerts(S.graph(spark, d), pathogen="PGRP:3")


@query(alerts_sql([("symptom", "SIZE:10", PHENOTYPES)]))
def alerts_by_symptom(spark, d):
    return G.find_alerts(S.graph(spark, d), symptom="SIZE:10")


@query(alerts_sql([("disease", "DIS:root", DISEASES), ("geoloc", "REGION:1", PLACES), ("pathogen", "PGRP:3", PATHOGENS)]))
def alerts_multi_filter(spark, d):
    return G.find_alerts(S.graph(spark, d), disease="DIS:root", geolocation="REGION:1", pathogen="PGRP:3")


@query(alerts_sql([("geoloc", "GEO:world", PLACES)], "a.timestamp = '1996-03-01'"))
def alerts_by_timestamp(spark, d):
    return G.find_alerts(S.graph(spark, d), geolocation="GEO:world", timestamp="1996-03-01")


@query(alerts_sql([], tail="ORDER BY 1, 2 LIMIT 25"))
def alerts_base_pattern(spark, d):
    return G.find_alerts(S.graph(spark, d), limit=25)


@query(f"""WITH RECURSIVE m AS ({MENTIONS}), {reach_sql('r', 'REGION:2', PLACES)}
SELECT DISTINCT m.alert, p.node AS part, 'SUPP:' || l_suppkey AS supplier FROM m JOIN r ON m.node = r.curie JOIN m p ON p.alert = m.alert
JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) l ON p.node = 'PART:' || l.l_partkey WHERE l_suppkey = 3""")
def match_chain(spark, d):
    found = G.Match(S.graph(spark, d)).edge("alert", "mentions", "place").reaches("place", "isa", "REGION:2").edge("alert", "mentions", "part").edge("part", "has_pathogen", "supplier").node("supplier", "pathogen", F.col("curie") == "SUPP:3")
    return found.returns("alert", "part", "supplier", distinct=True)


# -- indicators


@query("""WITH RECURSIVE e AS (""" + ISA + """), p AS (SELECT 'NATION:' || n_nationkey AS start, 'NATION:' || n_nationkey AS node, '' AS path FROM nation
UNION ALL SELECT p.start, e.dst, CASE WHEN p.path = '' THEN e.dst ELSE p.path || ',' || e.dst END FROM p JOIN e ON e.src = p.node) SELECT start, path FROM p WHERE node = 'GEO:world'""")
def indicator_paths_down(spark, d):
    g = S.graph(spark, d)
    places = g.nodes.where(F.col("curie").startswith("NATION:")).select("curie")
    return paths(g.typed("isa"), places, 3).where("node = 'GEO:world'").select("start", F.array_join("path", ",").alias("path"))


@query("""WITH RECURSIVE e AS (""" + DISEASES + """), p AS (SELECT 'PART:' || p_partkey AS start, 'PART:' || p_partkey AS node, '' AS path FROM part
UNION ALL SELECT p.start, e.dst, CASE WHEN p.path = '' THEN e.dst ELSE p.path || ',' || e.dst END FROM p JOIN e ON e.src = p.node) SELECT start, path FROM p WHERE node = 'DIS:root'""")
def indicator_paths_up(spark, d):
    g = S.graph(spark, d)
    parts = g.nodes.where(F.col("curie").startswith("PART:")).select("curie")
    return paths(g.typed("isa"), parts, 3).where("node = 'DIS:root'").select("start", F.array_join("path", ",").alias("path"))


REVENUE = """SELECT c_nationkey AS nation, p_type, CAST(year(l_shipdate) AS VARCHAR) AS year, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,4))), 3) AS DOUBLE) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3"""


@query(f"SELECT DISTINCT 'NATION:' || nation AS place, 'wdi:' || p_type AS indicator, 'NATION:' || nation AS path FROM ({REVENUE}) JOIN nation ON n_nationkey = nation WHERE n_regionkey = 2 AND contains('revenue of ' || p_type, 'A') UNION SELECT DISTINCT 'NATION:' || nation, 'wdi:' || p_type, 'NATION:' || nation || ',REGION:2' FROM ({REVENUE}) JOIN nation ON n_nationkey = nation WHERE n_regionkey = 2 AND contains('revenue of ' || p_type, 'A')")
def indicator_union(spark, d):
    """Indicators whose name contains a string, of places under a region and of the places they lie in: two branches, each with the path."""
    g = S.graph(spark, d)
    indicators = g.labelled("indicator").where(F.col("name").contains("A")).select(F.col("curie").alias("indicator"))
    has = g.typed("has_indicator").select(F.col("src").alias("place"), F.col("dst").alias("indicator")).join(indicators, "indicator", "left_semi")
    region = g.nodes.where("curie = 'REGION:2'").select("curie")
    down = paths(g.typed("isa"), region, 2, backwards=True).join(has, F.col("node") == F.col("place")).select("place", "indicator", F.array_join("path", ",").alias("path"))
    up = paths(g.typed("isa"), has.select(F.col("place").alias("curie")).distinct(), 1).where("node = 'REGION:2'").join(has, F.col("start") == F.col("place")).select("place", "indicator", F.concat_ws(",", "start", "path").alias("path"))
    return down.unionByName(up).distinct()


@query(f"SELECT nation, p_type, year, value FROM ({REVENUE})")
def indicator_unpivot_map(spark, d):
    """Wide yearly columns and back: pivot, fold into maps, explode."""
    revenue = S.revenue(spark, d)
    years = sorted(r[0] for r in S.table(spark, d, "lineitem").select(F.year("l_shipdate").cast("string")).distinct().collect() if r[0] is not None)
    wide = revenue.groupBy("nation", "p_type").pivot("year", years).agg(F.first(F.col("value").cast("string")))
    folded = assemble.year_values(wide, ["nation", "p_type"])
    return folded.select("nation", "p_type", F.explode("years_data").alias("year", "value"))


@query("SELECT 'REGION:' || r_regionkey AS curie, c.label FROM (VALUES ('Asia', 'ASIA'), ('EUROPE', 'EUROPE'), ('Nowhere', 'Nowhere'), ('Gambia, The', 'Gambia')) c(label, name) JOIN region ON r_name = c.name")
def indicator_alias_join(spark, d):
    """Places of an indicator table by their aliases, or else by name, joined with places of the graph."""
    rows = spark.createDataFrame([("Asia",), ("EUROPE",), ("Nowhere",), ("Gambia, The",)], "label string").withColumn("name", assemble.renamed(F.col("label"), {**PLACE_ALIASES, "Asia": "ASIA"}))
    return rows.join(S.graph(spark, d).labelled("geoloc").where(F.col("curie").startswith("REGION:")), "name").select("curie", "label")


@query("SELECT p_brand AS code, count(*) AS n FROM part WHERE p_size > 25 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1) GROUP BY 1")
def series_anti_join(spark, d):
    """Series of a second table whose codes the first one hasn't."""
    part = S.table(spark, d, "part")
    return assemble.without_series(part.where("p_size > 25"), part.where("p_size = 1"), "p_brand").groupBy(F.col("p_brand").alias("code")).agg(F.count("*").alias("n"))


@query("SELECT p_name AS name, min('PART:' || p_partkey) AS curie FROM part GROUP BY 1")
def name_first_match(spark, d):
    return assemble.first_curies(S.graph(spark, d).nodes.where(F.col("curie").startswith("PART:")))


# -- co-occurrence

BRANDS = "SELECT DISTINCT l_orderkey AS doc, p_brand AS term FROM lineitem JOIN part ON l_partkey = p_partkey"
PAIRS = f"t AS ({BRANDS}), c AS (SELECT a.term AS a, b.term AS b, count(*) AS count FROM t a JOIN t b ON a.doc = b.doc AND a.term < b.term GROUP BY 1, 2), s AS (SELECT a, b, count, ln(count) - ln((SELECT count(DISTINCT doc) FROM t)) AS score FROM c)"


@query(f"WITH {PAIRS} SELECT a, b, count FROM c")
def pair_cooccurrence(spark, d):
    return assemble.cooccurrence(S.doc_term(spark, d)).select("a", "b", "count")


@query(f"WITH {PAIRS} SELECT a, b, round(score, 6) AS score FROM s")
def pair_log_score(spark, d):
    return assemble.cooccurrence(S.doc_term(spark, d)).select("a", "b", F.round("score", 6).alias("score"))


NUMBER = "CAST(regexp_extract({}, '([0-9]+)$', 1) AS BIGINT) % 4"


@query(f"""WITH {PAIRS} SELECT a, b, count *
  ((CASE WHEN {NUMBER.format('a')} = 1 AND {NUMBER.format('b')} = 2 OR {NUMBER.format('a')} = 0 AND {NUMBER.format('b')} = 2 OR {NUMBER.format('a')} = 1 AND {NUMBER.format('b')} = 0 THEN 1 ELSE 0 END) +
   (CASE WHEN {NUMBER.format('b')} = 1 AND {NUMBER.format('a')} = 2 OR {NUMBER.format('b')} = 0 AND {NUMBER.format('a')} = 2 OR {NUMBER.format('b')} = 1 AND {NUMBER.format('a')} = 0 THEN 1 ELSE 0 END)) AS count
FROM c WHERE {NUMBER.format('a')} < 3 AND {NUMBER.format('b')} < 3 AND {NUMBER.format('a')} <> {NUMBER.format('b')}""")
def typed_pair_counts(spark, d):
    """Pairs of a place and a pathogen, a disease and a pathogen, or a place and a disease, counted for each orientation that fits."""
    kinds = lambda side: F.element_at(F.array(F.lit("disease"), F.lit("geoloc"), F.lit("pathogen"), F.lit("other")), (F.regexp_extract(side, r"(\d+)$", 1).cast("long") % 4 + 1).cast("int"))
    rows = assemble.cooccurrence(S.doc_term(spark, d).where(~F.col("term").isin(*GENERAL_NAMES)))
    return rows.withColumn("times", assemble.pair_orientations(kinds("a"), kinds("b"))).where("times > 0").select("a", "b", (F.col("count") * F.col("times")).alias("count"))


QUERY_TERMS = ["Brand#1", "Brand#2", "Brand#3"]
IN_QUERY = "('Brand#1', 'Brand#2', 'Brand#3')"


@query(f"WITH {PAIRS} SELECT round(ln(sum(exp(score))), 6) AS score FROM s WHERE a IN {IN_QUERY} AND b IN {IN_QUERY}")
def realism_score(spark, d):
    terms = S.doc_term(spark, d).where(~F.col("term").isin(*GENERAL_TERMS))
    return assemble.plausibility(assemble.cooccurrence(terms), QUERY_TERMS).select(F.round("score", 6).alias("score"))


@query(f"WITH {PAIRS} SELECT term, CASE WHEN max(CASE WHEN s.a IS NULL THEN NULL ELSE score END) > -4.5 THEN 'high' WHEN max(score) > -7 THEN 'medium' ELSE 'low' END AS class FROM (SELECT DISTINCT term FROM t) x LEFT JOIN s ON s.a = 'Brand#1' AND s.b = x.term GROUP BY term")
def realism_class(spark, d):
    """The class of each term's pair with one term."""
    scores = assemble.cooccurrence(S.doc_term(spark, d)).where("a = 'Brand#1'")
    terms = S.doc_term(spark, d).select("term").distinct()
    rows = terms.join(scores, F.col("term") == F.col("b"), "left")
    return rows.select("term", assemble.score_class(F.col("score")).alias("class"))


# -- text relations

CURIES = [f"PART:{i}" for i in range(1, 120)] + [f"SUPP:{i}" for i in range(1, 9)] + ["BRAND:Brand#1", "SIZE:3"]
LIST = ", ".join(f"'{c}'" for c in CURIES)
LINKS = f"SELECT src, 'isa' AS type, dst FROM ({ISA}) UNION ALL SELECT DISTINCT 'PART:' || l_partkey, 'has_pathogen', 'SUPP:' || l_suppkey FROM lineitem UNION ALL SELECT 'PART:' || p_partkey, 'has_phenotype', 'SIZE:' || p_size FROM part"
COMENTION = f"m AS ({MENTIONS}), pairs AS (SELECT a.alert, a.node AS a, b.node AS b FROM m a JOIN m b ON a.alert = b.alert AND a.node <> b.node WHERE a.node IN ({LIST}) AND b.node IN ({LIST}))"


@query(f"SELECT src, type, dst FROM ({LINKS}) WHERE src IN ({LIST}) AND dst IN ({LIST})")
def direct_relations(spark, d):
    return G.text_relations(S.graph(spark, d), CURIES)[0]


@query(f"WITH {COMENTION} SELECT alert, a, b FROM pairs")
def comention_pairs(spark, d):
    return G.text_relations(S.graph(spark, d), CURIES)[1]


@query(f"WITH {COMENTION} SELECT alert, string_agg(DISTINCT a, ',' ORDER BY a) AS entities, count(DISTINCT a) AS n_entities FROM pairs GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 500")
def top_alerts_by_entities(spark, d):
    return G.text_relations(S.graph(spark, d), CURIES)[2]


# -- literature

MATRIX = "w AS (SELECT l_orderkey AS doc, p_brand AS term, CAST(sum(1 + (l_linestatus = 'O')::INT) AS BIGINT) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def choose(n: str, k: str) -> str:
    return f"CASE WHEN {k} < 0 OR {k} > {n} THEN 0 ELSE exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)) END"


def fisher_sql(terms: list[str], threshold: int) -> str:
    inside = "term IN (" + ", ".join(f"'{t}'" for t in terms) + ")"
    kind = "['disease', 'geoloc', 'pathogen', 'other'][" + NUMBER.format("term") + " + 1]"
    k = len(terms)
    passed = f"SELECT doc FROM w WHERE {inside} GROUP BY 1 HAVING sum(weight) >= {threshold}" if threshold else "SELECT DISTINCT doc FROM w"
    return f"""WITH {MATRIX}, n AS (SELECT count(DISTINCT term) AS n FROM w), p AS ({passed}),
e AS (SELECT doc, count(*) AS size, count(*) FILTER (WHERE {inside}) AS overlap,
  count(DISTINCT {kind}) FILTER (WHERE {inside} AND {kind} <> 'other') AS relevant_coverage, count(DISTINCT {kind}) FILTER (WHERE {inside}) AS coverage
  FROM w WHERE doc IN (SELECT doc FROM p) GROUP BY 1),
f AS (SELECT e.*, n.n, CASE WHEN overlap = 0 THEN 1.0 ELSE (SELECT sum(({choose('size', 'i')}) * ({choose('(n.n - size)', f'({k} - i)')})) FROM (SELECT unnest(range(overlap, least({k}, size) + 1)) AS i)) / ({choose('n.n', str(k))}) END AS pval FROM e, n)
SELECT doc, overlap, relevant_coverage, coverage, round(pval, 6) AS pval FROM f ORDER BY relevant_coverage DESC, coverage DESC, round(f.pval, 9), doc LIMIT 20"""


def rank(spark: SparkSession, d: str, terms: list[str]) -> DataFrame:
    return literature.ranked(S.doc_term(spark, d), terms, S.brand_type()).withColumn("pval", F.round("pval", 6))


@query(fisher_sql(QUERY_TERMS, 2))
def fisher_rank(spark, d):
    return rank(spark, d, QUERY_TERMS)


@query(fisher_sql(["Brand#2"], 0))
def fisher_single_term(spark, d):
    return rank(spark, d, ["Brand#2"])


def stored_postings(spark: SparkSession, rows: DataFrame) -> literature.Postings:
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    files.write_postings(rows, path)
    return files.postings(spark, path)


def by_postings(spark: SparkSession, d: str, terms: list[str]) -> DataFrame:
    return literature.ranked_by_postings(stored_postings(spark, S.doc_term(spark, d)), terms, S.brand_type()).withColumn("pval", F.round("pval", 6))


@query(ORACLES["fisher_rank"])
def fisher_rank_postings(spark, d):
    """The best documents from a matrix stored by terms."""
    return by_postings(spark, d, QUERY_TERMS).drop("overlap_ids", "overlap_counts")


@query(ORACLES["fisher_single_term"])
def fisher_single_postings(spark, d):
    return by_postings(spark, d, ["Brand#2"]).drop("overlap_ids", "overlap_counts")


@query(f"WITH {MATRIX}, f AS ({fisher_sql(QUERY_TERMS, 2)}) SELECT f.doc, string_agg(term, ',' ORDER BY term) AS overlap_ids FROM f JOIN w ON w.doc = f.doc WHERE term IN {IN_QUERY} GROUP BY 1")
def fisher_overlap_ids(spark, d):
    """The query's terms that each of the best documents has."""
    return by_postings(spark, d, QUERY_TERMS).select("doc", F.array_join("overlap_ids", ",").alias("overlap_ids"))


#: Terms of a query whose binomials are beyond doubles.
MANY = 150


@query(f"""WITH w AS (SELECT l_orderkey AS doc, l_partkey AS term, count(*) AS weight FROM lineitem GROUP BY 1, 2), n AS (SELECT count(DISTINCT term) AS n FROM w),
e AS (SELECT doc, count(*) AS size, count(*) FILTER (WHERE term <= {MANY}) AS overlap, count(DISTINCT term % 4) FILTER (WHERE term <= {MANY} AND term % 4 <> 3) AS relevant_coverage, count(DISTINCT term % 4) FILTER (WHERE term <= {MANY}) AS coverage,
  sum(weight) FILTER (WHERE term <= {MANY}) AS weight FROM w GROUP BY 1),
f AS (SELECT e.*, least(1.0, (SELECT sum(exp(lgamma(size + 1) - lgamma(i + 1) - lgamma(size - i + 1) + lgamma(n - size + 1) - lgamma({MANY} - i + 1) - lgamma(n - size - {MANY} + i + 1) - lgamma(n + 1) + lgamma({MANY} + 1) + lgamma(n - {MANY} + 1)))
  FROM (SELECT unnest(range(overlap, least({MANY}, size) + 1)) AS i) WHERE n - size - {MANY} + i >= 0)) AS pval FROM e, n WHERE weight >= 3)
SELECT doc, overlap, relevant_coverage, coverage, round(pval, 6) AS pval FROM f ORDER BY relevant_coverage DESC, coverage DESC, round(f.pval, 9), doc LIMIT 20""")
def fisher_many_terms(spark, d):
    """A query of many terms, orders and their parts as the matrix."""
    rows = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("term"), F.lit(1).cast("long").alias("weight"))
    kind = F.element_at(F.array(*map(F.lit, ("disease", "geoloc", "pathogen", "other"))), (F.col("term").cast("int") % 4 + 1))
    found = literature.ranked_by_postings(stored_postings(spark, rows), [f"{i:09}" for i in range(1, MANY + 1)], kind)
    return found.select("doc", "overlap", "relevant_coverage", "coverage", F.round("pval", 6).alias("pval"))


@query(f"WITH {MATRIX} SELECT doc, CAST(sum(weight) AS BIGINT) AS weight FROM w WHERE term IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') GROUP BY 1 HAVING sum(weight) >= 3")
def weighted_prefilter(spark, d):
    return literature.prefiltered(S.doc_term(spark, d), [*QUERY_TERMS, "Brand#4", "Brand#5"])


@query(f"WITH {MATRIX} SELECT doc, term, weight FROM w")
def matrix_dup_sum(spark, d):
    return literature.summed(S.doc_term(spark, d))


# -- assembly and loading


@query("SELECT 'N:' || p_size AS curie, min_by(p_name, p_partkey) AS name FROM part GROUP BY 1")
def load_skip_duplicate_nodes(spark, d):
    nodes = S.table(spark, d, "part").select(S.key("N:", "p_size").alias("curie"), F.col("p_name").alias("name"), "p_partkey")
    edges = spark.createDataFrame([], "src string, type string, dst string")
    return assemble.load(nodes, edges, "p_partkey")[0].select("curie", "name")


@query("SELECT 'PART:' || l_partkey AS src, 'has_pathogen' AS type, 'SUPP:' || l_suppkey AS dst FROM lineitem WHERE l_suppkey % 3 <> 0 AND l_partkey % 5 <> 0")
def load_skip_bad_edges(spark, d):
    """Edges whose ends were left out of the nodes go; repeated edges stay."""
    g = S.graph(spark, d)
    number = F.split_part("curie", F.lit(":"), F.lit(2)).cast("long")
    nodes = g.nodes.where(F.col("curie").startswith("PART:") & (number % 5 != 0) | F.col("curie").startswith("SUPP:") & (number % 3 != 0))
    edges = S.table(spark, d, "lineitem").select(S.key("PART:", "l_partkey").alias("src"), F.lit("has_pathogen").alias("type"), S.key("SUPP:", "l_suppkey").alias("dst"))
    return assemble.load(nodes, edges, "name")[1]


@query(f"""WITH RECURSIVE {FLAGS_SQL} SELECT e.src, e.dst FROM ({ISA}) e JOIN flags c ON c.curie = e.src JOIN flags p ON p.curie = e.dst
WHERE (NOT c.is_disease OR p.is_disease) AND (NOT c.is_geoloc OR p.is_geoloc) AND (NOT c.is_pathogen OR p.is_pathogen)""")
def edge_type_consistency(spark, d):
    flags = flagged(spark, d)
    return assemble.consistent(S.graph(spark, d).typed("isa").select("src", "dst"), flags, ("is_disease", "is_geoloc", "is_pathogen"))


@query("SELECT 'outbreak:' || o_custkey AS curie, min_by(o_orderpriority, o_orderkey) AS name FROM orders GROUP BY o_custkey")
def outbreak_nodes_first_wins(spark, d):
    return assemble.outbreaks(outbreak_rows(spark, d), "archiveNumber_n")[0].select("curie", "name")


def outbreak_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rows of an outbreak table: the customer's outbreak, named by the order's priority."""
    return S.table(spark, d, "orders").select(F.col("o_custkey").alias("ID"), F.col("o_orderpriority").alias("outbreakName"), F.col("o_orderkey").cast("string").alias("archiveNumber"), F.col("o_orderkey").alias("archiveNumber_n"))


@query("SELECT DISTINCT 'alert:' || o_orderkey AS src, 'has_outbreak' AS type, 'outbreak:' || o_custkey AS dst FROM orders")
def outbreak_edges(spark, d):
    return assemble.outbreaks(outbreak_rows(spark, d), "archiveNumber_n")[1]


@query("SELECT 'alert:' || c_custkey AS curie, d AS timestamp FROM customer LEFT JOIN (SELECT o_custkey, strftime(min_by(o_orderdate, o_orderkey), '%Y-%m-%d') AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def alert_nodes_left_join(spark, d):
    """Alerts with the date of their first row in another table, null without one."""
    first = assemble.first_per(S.table(spark, d, "orders"), "o_custkey", "o_orderkey").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"))
    return S.table(spark, d, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select(S.key("alert:", "c_custkey").alias("curie"), "timestamp")


@query("""SELECT DISTINCT 'MESH:S' || s_nationkey AS dst, 'has_pathogen' AS type, 'MESH:B' || p_brand AS src FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
WHERE p_size % 2 = 0 AND s_suppkey % 3 <> 0 AND l_linenumber <> 2 AND l_linenumber <> 3""")
def xref_map_edges(spark, d):
    """Pairs mapped to another namespace: pairs with an unmapped side go, and so do those of an unwanted vocabulary, although it is mapped too."""
    number = F.col("l_linenumber")
    rows = S.table(spark, d, "lineitem").select(F.concat(F.when(number == 2, "umls:").otherwise("s:"), F.col("l_suppkey").cast("string")).alias("pathogen"), F.concat(F.when(number == 3, "umls:").otherwise("p:"), F.col("l_partkey").cast("string")).alias("disease"))
    parts = S.table(spark, d, "part").where("p_size % 2 = 0").select(F.explode(F.array(F.lit("p"), F.lit("umls"))).alias("ns"), F.col("p_partkey").cast("string").alias("id"), S.key("MESH:B", "p_brand").alias("target"))
    suppliers = S.table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.explode(F.array(F.lit("s"), F.lit("umls"))).alias("ns"), F.col("s_suppkey").cast("string").alias("id"), S.key("MESH:S", "s_nationkey").alias("target"))
    return assemble.pathogen_edges(rows, parts.unionByName(suppliers))


@query("SELECT DISTINCT upper('mesh:' || p_type) AS src, 'has_phenotype' AS type, upper('mesh:d' || p_size) AS dst FROM part WHERE p_partkey % 2 = 0")
def prefix_upper_edges(spark, d):
    prefix = F.when(F.col("p_partkey") % 2 == 0, "mesh:").otherwise("umls:")
    return assemble.symptom_edges(S.table(spark, d, "part").select(F.concat(prefix, "p_type").alias("src"), F.concat(prefix, F.lit("d"), F.col("p_size").cast("string")).alias("dst")))


def gazetteer(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a gazetteer of nations and customers; even nations can be grounded, but only every fourth is a node of the ontology."""
    nation, customer = S.table(spark, d, "nation"), S.table(spark, d, "customer")
    places = nation.select(S.key("geonames:N", "n_nationkey").alias("curie"), F.col("n_name").alias("name")).unionByName(customer.select(S.key("geonames:C", "c_custkey").alias("curie"), F.col("c_name").alias("name")))
    part_of = customer.select(S.key("geonames:C", "c_custkey").alias("child"), S.key("geonames:N", "c_nationkey").alias("parent")).unionByName(nation.select(S.key("geonames:N", "n_nationkey").alias("child"), S.key("geonames:R", "n_regionkey").alias("parent")))
    dictionary = answers.grounding_dictionary(nation.where("n_nationkey % 2 = 0").select(S.key("MESH:", "n_nationkey").alias("curie"), F.col("n_name").alias("name")))
    named = assemble.grounded_places(places, dictionary, ["MESH"])
    return assemble.place_graph(places, part_of, named, nation.where("n_nationkey % 4 = 0").select(S.key("MESH:", "n_nationkey").alias("curie")))


@query("SELECT n_name AS name, 'MESH:' || (n_nationkey - n_nationkey % 2) AS curie FROM nation UNION ALL SELECT r_name, NULL FROM region WHERE r_regionkey > 0 UNION ALL SELECT r_name, 'MESH:0' FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'Czechia', 'geonames:cz'")
def place_grounding(spark, d):
    """Places by their alias or name; every odd nation is known by the name of the one before, and one region by a nation's."""
    nation, region = S.table(spark, d, "nation"), S.table(spark, d, "region")
    names = {r.n_nationkey: r.n_name for r in nation.collect()}  # a nation is a constant of the aliases
    first = region.where("r_regionkey = 0").first()["r_name"]
    aliases = PLACE_ALIASES | {name: names[k - 1] for k, name in names.items() if k % 2} | {first: names[0]}
    places = nation.select(F.col("n_name").alias("name")).unionByName(region.select(F.col("r_name").alias("name"))).unionByName(spark.createDataFrame([("Czechia",)], "name string"))
    even = nation.where("n_nationkey % 2 = 0")
    other = spark.createDataFrame([("geonames:cz", "Czech  Republic")], "curie string, name string").unionByName(even.select(S.key("geonames:", "n_nationkey").alias("curie"), F.col("n_name").alias("name")))
    dictionary = answers.grounding_dictionary(even.select(S.key("MESH:", "n_nationkey").alias("curie"), F.col("n_name").alias("name")), other)
    return assemble.grounded_places(places, dictionary, ["MESH", "geonames"], aliases)


@query("SELECT 'geonames:N' || n_nationkey AS curie, n_name AS name FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT 'geonames:C' || c_custkey, c_name FROM customer")
def geoname_anti_join(spark, d):
    """Places that the ontology hasn't."""
    return gazetteer(spark, d)[0].select("curie", "name")


@query("""SELECT 'geonames:C' || c_custkey AS src, 'isa' AS type, CASE WHEN c_nationkey % 4 = 0 THEN 'MESH:' || c_nationkey ELSE 'geonames:N' || c_nationkey END AS dst FROM customer
UNION ALL SELECT 'geonames:N' || n_nationkey, 'isa', 'geonames:R' || n_regionkey FROM nation WHERE n_nationkey % 4 <> 0""")
def geoname_parent_rewrite(spark, d):
    """Their parents, under their ontology curie where there is one."""
    return gazetteer(spark, d)[1]


def alert_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as alerts that mention brands: every third part in another namespace, every fifth under a general name; brands of even number have a type."""
    rows = S.table(spark, d, "lineitem").join(S.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    mentions = rows.select(F.col("l_orderkey").cast("string").alias("alert"), F.when(F.col("p_partkey") % 3 == 0, "geonames").otherwise("MESH").alias("db"), F.col("p_brand").alias("id"), F.when(F.col("p_partkey") % 5 == 0, GENERAL_NAMES[0]).otherwise(F.col("p_name")).alias("name"))
    dates = S.table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("archiveNumber"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("datePublished"))
    even = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long") % 2 == 0
    flags = S.table(spark, d, "part").select(S.key("MESH:", "p_brand").alias("curie"), even.alias("is_disease"), F.lit(False).alias("is_geoloc"), F.lit(False).alias("is_pathogen")).distinct()
    return assemble.alert_relations(mentions, dates, flags, "datePublished")


@query("SELECT DISTINCT 'alert:' || o_orderkey AS curie, strftime(o_orderdate, '%Y-%m-%d') AS timestamp FROM orders UNION ALL SELECT 'alert:c' || c_custkey, NULL FROM customer")
def alert_nodes_without_mentions(spark, d):
    """Nodes of alerts of which only those of dear parts mention something, and customers' alerts nothing."""
    rows = S.table(spark, d, "lineitem").where("l_extendedprice > 50000").select(F.col("l_orderkey").cast("string").alias("alert"), F.lit("MESH").alias("db"), F.col("l_partkey").cast("string").alias("id"), F.lit("x").alias("name"))
    orders = S.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("archiveNumber"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("datePublished"))
    alerts = orders.select(F.col("archiveNumber").alias("alert")).unionByName(S.table(spark, d, "customer").select(S.key("c", "c_custkey").alias("alert")))
    flags = spark.createDataFrame([], "curie string, is_disease boolean, is_geoloc boolean, is_pathogen boolean")
    return assemble.alert_relations(rows, orders, flags, "datePublished", alerts=alerts)[0].select("curie", "timestamp")


@query("SELECT o_orderkey AS doc, coalesce(string_agg(DISTINCT CASE WHEN l_extendedprice > 50000 THEN 'MESH:' || l_partkey END, ',' ORDER BY CASE WHEN l_extendedprice > 50000 THEN 'MESH:' || l_partkey END), '') AS terms FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def terms_per_alert(spark, d):
    """Each alert's terms, none of some."""
    rows = S.table(spark, d, "lineitem").where("l_extendedprice > 50000").select(F.col("l_orderkey").alias("doc"), F.lit("MESH").alias("db"), F.col("l_partkey").cast("string").alias("id"), F.lit("x").alias("name"))
    found = services.terms_by_alert(rows, S.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc")))
    return found.select("doc", F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["db"], t["id"])), ",").alias("terms"))


@query("SELECT DISTINCT 'alert:' || l_orderkey AS curie, CAST(l_orderkey AS VARCHAR) AS name, CASE WHEN l_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS timestamp FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def alert_mention_nodes(spark, d):
    """Alerts stay whatever they mention, with a date where there is one."""
    return alert_parts(spark, d)[0].select("curie", "name", "timestamp")


@query("""SELECT DISTINCT 'alert:' || l_orderkey AS src, 'mentions' AS type, 'MESH:' || p_brand AS dst FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) % 2 = 0""")
def alert_mention_edges(spark, d):
    """Mentions stay if they are in the ontology, typed and off the stop list."""
    return alert_parts(spark, d)[1]


TERMS_SQL = "SELECT 'NATION:' || n_nationkey AS curie, n_name AS name FROM nation UNION ALL SELECT 'REGION:' || r_regionkey, r_name FROM region UNION ALL SELECT DISTINCT 'BRAND:' || p_brand, p_brand FROM part UNION ALL SELECT 'SUPP:' || s_suppkey, s_name FROM supplier"
HIERARCHY_SQL = f"{FLAGS_SQL}, terms AS ({TERMS_SQL}), nodes AS (SELECT f.curie, t.name, CASE WHEN is_disease THEN 'disease' WHEN is_pathogen THEN 'pathogen' ELSE 'geoloc' END AS kind FROM flags f JOIN terms t ON f.curie = t.curie WHERE is_disease OR is_pathogen OR is_geoloc)"


def hierarchy(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = S.graph(spark, d)
    terms = g.nodes.where(F.split_part("curie", F.lit(":"), F.lit(1)).isin("NATION", "REGION", "BRAND", "SUPP")).select("curie", "name")
    return assemble.hierarchy(terms, g.typed("isa"), materialised(flagged(spark, d)))


@query(f"WITH RECURSIVE {HIERARCHY_SQL} SELECT curie, name, kind || ';entity' AS labels FROM nodes")
def hierarchy_nodes(spark, d):
    return hierarchy(spark, d)[0].withColumn("labels", F.array_join("labels", ";"))


@query(f"""WITH RECURSIVE {HIERARCHY_SQL} SELECT DISTINCT e.src, 'isa' AS type, e.dst FROM ({ISA}) e JOIN flags c ON c.curie = e.src JOIN flags p ON p.curie = e.dst
WHERE (NOT c.is_disease OR p.is_disease) AND (NOT c.is_geoloc OR p.is_geoloc) AND (NOT c.is_pathogen OR p.is_pathogen) AND e.src IN (SELECT curie FROM nodes)""")
def hierarchy_edges(spark, d):
    return hierarchy(spark, d)[1]


WIDE_NAMES = "CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'The ' || n_name ELSE 'no place' END"


def wide_indicators(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The yearly revenue as a wide table by names of nations, of which a third are aliases and a third unknown."""
    lineitem = S.table(spark, d, "lineitem")
    years = sorted(r[0] for r in lineitem.select(F.year("l_shipdate").cast("string")).distinct().collect() if r[0] is not None)
    wide = S.revenue(spark, d).groupBy("nation", F.col("p_type").alias("code")).pivot("year", years).agg(F.first(F.col("value").cast("string")))
    nation = S.table(spark, d, "nation").withColumn("country", F.expr(WIDE_NAMES))
    wide = wide.join(F.broadcast(nation.select(F.col("n_nationkey").alias("nation"), "country")), "nation").drop("nation").withColumn("series", F.concat(F.lit("revenue of "), "code"))
    aliases = {r["country"]: r["n_name"] for r in nation.where("n_nationkey % 3 = 1").collect()}  # 25 nations at most
    return assemble.indicator_graph(wide, S.graph(spark, d).nodes.where(F.col("curie").startswith("NATION:")), aliases)


@query(f"SELECT DISTINCT 'wdi:' || p_type AS curie, 'revenue of ' || p_type AS name FROM ({REVENUE}) WHERE nation % 3 < 2")
def indicator_nodes(spark, d):
    return wide_indicators(spark, d)[0].select("curie", "name")


@query(f"SELECT 'NATION:' || nation AS src, 'wdi:' || p_type AS dst, year, value FROM ({REVENUE}) WHERE nation % 3 < 2")
def indicator_edges(spark, d):
    """Edges with their yearly values written as JSON text and read again."""
    rows = wide_indicators(spark, d)[1].withColumn("text", answers.years_as_text(F.col("years_data")))
    return rows.select("src", "dst", F.explode(answers.years_from_text(F.col("text"))).alias("year", "value"))


@query("SELECT 'N:' || s_nationkey AS curie, min(s_name) AS name FROM supplier GROUP BY 1 UNION ALL SELECT 'N:' || n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def load_in_file_order(spark, d):
    """Of two files of nodes the first one's row stays; in a file the smallest."""
    first = S.table(spark, d, "supplier").select(S.key("N:", "s_nationkey").alias("curie"), F.col("s_name").alias("name"))
    second = S.table(spark, d, "nation").select(S.key("N:", "n_nationkey").alias("curie"), F.col("n_name").alias("name"))
    return assemble.load_files([first, second], [spark.createDataFrame([], "src string, type string, dst string")])[0]


# -- autocomplete

KEYED = "SELECT lower(name) AS key, max_by(name, curie) AS name, max(curie) AS curie FROM ({}) WHERE starts_with(lower(name), '{}') GROUP BY 1 ORDER BY 1 LIMIT {}"


@query(KEYED.format("SELECT 'PART:' || p_partkey AS curie, p_name AS name FROM part UNION ALL SELECT DISTINCT 'BRAND:' || p_brand, p_brand FROM part UNION ALL SELECT DISTINCT 'TYPE:' || p_type, p_type FROM part UNION ALL SELECT DISTINCT 'SIZE:' || p_size, 'size ' || p_size FROM part", "b", 30))
def autocomplete_prefix(spark, d):
    return G.autocomplete(S.graph(spark, d).labelled("disease"), "B", 30)


@query(ORACLES["autocomplete_prefix"])
def autocomplete_index(spark, d):
    """The same from a stored table in the order of keys."""
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    G.write_completions(S.graph(spark, d).labelled("disease"), path)
    return G.first_completions(G.stored_completions(spark, path), "B", 30)


@query(KEYED.format("SELECT 'CUST:' || c_custkey AS curie, c_name AS name FROM customer", "cust", 100))
def autocomplete_collision(spark, d):
    return G.autocomplete(S.graph(spark, d).nodes.where(F.col("curie").startswith("CUST:")), "CUST", 500)


@query(KEYED.format("SELECT 'NATION:' || n_nationkey AS curie, n_name AS name FROM nation", "", 20))
def autocomplete_mesh_only(spark, d):
    return G.complete(S.graph(spark, d), "alert geolocations", "", 20, ontology="NATION:").select(F.col("match").alias("key"), "name", "curie")


@query("SELECT * FROM (SELECT lower(n_name) AS match, n_name AS name, 'NATION:' || n_nationkey AS curie, CASE WHEN n_nationkey % 2 = 0 THEN 'in region ' || n_regionkey ELSE '' END AS definition FROM nation WHERE starts_with(lower(n_name), 'nation_1') ORDER BY 1 LIMIT 7)")
def autocomplete_definitions(spark, d):
    """Names of ontology places with definitions, empty where there is none."""
    definitions = S.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(S.key("NATION:", "n_nationkey").alias("curie"), S.key("in region ", "n_regionkey").alias("definition"))
    return G.complete(S.graph(spark, d), "alert geolocations", "Nation_1", 7, "NATION:", definitions)


# -- extraction

RAW = """SELECT doc_id AS id, 'Published Date: ' || strftime(DATE '2016-01-01' + CAST(doc_id % 1000 AS INT), '%Y-%m-%d') || ' 07:03:21 CET' AS line, source, text, strftime(DATE '2016-01-01' + CAST(doc_id % 1000 AS INT), '%Y%m%d') || '.' || doc_id AS number FROM documents"""


@query(f"SELECT id, CASE WHEN id % 7 <> 0 THEN number END AS archive_number, 'PRO/' || source || ' news' AS subject FROM ({RAW})")
def header_regex(spark, d):
    return S.alert_raw(spark, d).select("id", T.parsed_header(F.col("header")).alias("h")).select("id", "h.archive_number", "h.subject")


@query("SELECT doc_id AS id, strftime(DATE '2016-01-01' + CAST(doc_id % 1000 AS INT), '%Y-%m-%d') || ' 07:03:21' AS date FROM documents")
def header_timestamp(spark, d):
    return S.alert_raw(spark, d).select("id", F.date_format(T.parsed_header(F.col("header"))["date"], "yyyy-MM-dd HH:mm:ss").alias("date"))


JOINED = r"regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), ' '), '^$', '')"


@query(f"SELECT doc_id AS id, 0 AS pos, 'Title ' || source AS title, {JOINED} AS content FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 1, 'Second', 'end of it' FROM documents WHERE doc_id % 3 <> 0")
def section_parse(spark, d):
    rows = S.alert_raw(spark, d).select("id", F.posexplode(T.sections(F.col("body"))).alias("pos", "s"))
    return rows.select("id", "pos", "s.title", "s.content")


@query(f"SELECT doc_id AS id, 'PRO/' || source || ' news' || chr(10) || chr(10) || CASE WHEN doc_id % 3 <> 0 THEN 'Title ' || source || chr(10) || chr(10) || {JOINED} || chr(10) || chr(10) || 'Second' || chr(10) || chr(10) || 'end of it' || chr(10) || chr(10) ELSE '' END AS full_text FROM documents")
def alert_full_text(spark, d):
    rows = S.alert_raw(spark, d).select("id", T.parsed_header(F.col("header")).alias("h"), T.sections(F.col("body")).alias("s"))
    return rows.select("id", T.full_text(F.col("h.subject"), F.col("s")).alias("full_text"))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def key_drop_json(spark, d):
    """Properties without bookkeeping keys."""
    rows = S.table(spark, d, "events").select("event_id", F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("@id"), F.lit("x"), F.lit("@type"), F.lit("y"))).alias("p"))
    return rows.select("event_id", F.explode(T.without_keys(F.col("p"), "@id", "@type")).alias("key", "value"))


DICT = "dict(entry, db, id, name) AS (VALUES " + ", ".join(str(x) for x in S.DICTIONARY) + ")"
SPANS = r"""w AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc, ws, unnest(range(1, len(ws) + 1)) AS start FROM w),
y AS (SELECT doc, start, n, array_to_string(ws[start:start + n - 1], ' ') AS surface FROM (SELECT *, unnest(range(1, least(2, len(ws) - start + 1) + 1)) AS n FROM x)),
f AS (SELECT y.doc, y.start, y.n, y.surface, db, id, name FROM y JOIN dict ON surface = entry),
k AS (SELECT * FROM f a WHERE n = (SELECT max(n) FROM f b WHERE b.doc = a.doc AND b.start = a.start) AND NOT EXISTS (SELECT 1 FROM f b WHERE b.doc = a.doc AND b.start < a.start AND b.start + b.n >= a.start + a.n))"""


def found(spark: SparkSession, d: str) -> DataFrame:
    return T.mentions(S.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), S.dictionary(spark))


@query(f"WITH {DICT}, {SPANS} SELECT doc, surface, start, db, id, name FROM k")
def ner_mentions(spark, d):
    return found(spark, d)


@query(f"WITH {DICT}, {SPANS} SELECT surface, db, id, name, count(*) AS count FROM k WHERE name NOT IN ({', '.join(repr(n) for n in GENERAL_NAMES)}) GROUP BY ALL")
def ner_stats(spark, d):
    stats = services.mention_stats(found(spark, d).where(~F.col("name").isin(*GENERAL_NAMES)))
    return stats.select(F.col("text").alias("surface"), F.col("term_db").alias("db"), F.col("term_id").alias("id"), F.col("term_name").alias("name"), "count")


@query(f"WITH {DICT}, {SPANS} SELECT doc, start, min_by(db, CASE db WHEN 'MESH' THEN 1 ELSE 2 END) AS db, min_by(id, CASE db WHEN 'MESH' THEN 1 ELSE 2 END) AS id FROM k WHERE db IN ('MESH', 'geonames') GROUP BY 1, 2")
def ns_priority(spark, d):
    """Of a place's entries the one in the first allowed namespace."""
    documents = S.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    types = spark.createDataFrame([], "curie string, type string")
    rows = answers.annotate(documents, S.dictionary(spark), types, ["MESH", "geonames"])
    return rows.select("doc", "start", F.split_part("curie", F.lit(":"), F.lit(1)).alias("db"), F.split_part("curie", F.lit(":"), F.lit(2)).alias("id"))


@query(f"WITH {DICT}, {SPANS} SELECT doc, start, surface AS text, min_by(db, CASE db WHEN 'geonames' THEN 1 WHEN 'other' THEN 2 ELSE 3 END) AS db, min_by(id, CASE db WHEN 'geonames' THEN 1 WHEN 'other' THEN 2 ELSE 3 END) AS id FROM k GROUP BY 1, 2, 3 HAVING bool_or(db = 'MESH')")
def ner_top_terms(spark, d):
    """The first term of each mention with an entry of one namespace, be the term of it or not."""
    documents = S.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return answers.top_terms(documents, S.dictionary(spark), ["MESH"], ["geonames", "other", "MESH"]).drop("name")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'MESH:' ELSE 'geonames:' END || n_nationkey AS curie, CAST(CASE WHEN n_nationkey % 2 = 0 OR n_nationkey % 3 <> 0 THEN 1 ELSE 0.75 END AS DOUBLE) AS score FROM nation UNION ALL SELECT 'x:1', 'x:1', 1.0 UNION ALL SELECT 'Atlantis', NULL, NULL")
def ground_by_score(spark, d):
    """Names by the entry that fits best; only of equally good ones the namespace decides."""
    nation = S.table(spark, d, "nation")
    n = F.col("n_nationkey")
    mesh = nation.select(S.key("MESH:", "n_nationkey").alias("curie"), F.when(n % 2 == 0, F.col("n_name")).otherwise(F.upper(F.replace("n_name", F.lit("_"), F.lit(" ")))).alias("name"))
    places = nation.select(S.key("geonames:", "n_nationkey").alias("curie"), F.when(n % 3 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"))
    names = nation.select(F.col("n_name").alias("name")).unionByName(spark.createDataFrame([("x:1",), ("Atlantis",)], "name string"))
    return G.ground_scored(names, answers.grounding_dictionary(mesh, places), ["MESH", "geonames"])


SYNDROME = ("severe", "acute", "respiratory", "distress", "syndrome", "of", "late", "onset", "in", "adult", "patients")
SYNDROME_SQL = "['" + "', '".join(SYNDROME) + "']"
LONG_NAME = f"array_to_string(list_concat(['fever'], {SYNDROME_SQL}[1:n_nationkey % 12]), ' ')"


@query(f"""SELECT 'CUST:' || c_custkey AS doc, 3 AS start, {LONG_NAME} || CASE n_nationkey % 3 WHEN 0 THEN ' beta' WHEN 1 THEN ' 4' ELSE ' ' || n_nationkey END || ' n' || n_nationkey AS text,
  'MESH:' || n_nationkey AS curie, CASE WHEN n_nationkey % 2 = 0 THEN 'disease' ELSE 'other' END AS type FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'CUST:' || c_custkey, 12 + n_nationkey % 12, 'iv fluids', 'MESH:iv', 'other' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 2 = 0""")
def ner_long_names(spark, d):
    """Names of one word to fourteen, in which Greek letters and Roman numbers are spelled otherwise than in the texts."""
    nation = S.table(spark, d, "nation")
    n = F.col("n_nationkey")
    long = F.array_join(F.concat(F.array(F.lit("Fever")), F.slice(F.array(*map(F.lit, SYNDROME)), F.lit(1), n % 12)), " ")
    last = lambda greek, roman: F.when(n % 3 == 0, greek).when(n % 3 == 1, roman).otherwise(n.cast("string"))
    key = F.concat(F.lit(" n"), n.cast("string"))
    names = nation.select(S.key("MESH:", "n_nationkey").alias("curie"), F.concat(long, F.lit("-"), last(F.lit("\u0392"), F.lit("4")), key).alias("name"))
    names = names.unionByName(spark.createDataFrame([("MESH:iv", "IV fluids"), ("MESH:none", "of late onset in no patient")], "curie string, name string"))
    said = F.concat(F.lit("Cases of "), F.upper(long), F.lit(", "), last(F.lit("beta"), F.lit("IV")), key, F.lit("; given with some of the usual "), F.when(F.col("c_custkey") % 2 == 0, "IV fluids").otherwise("fluids"))
    documents = S.table(spark, d, "customer").join(nation, F.col("c_nationkey") == n).select(S.key("CUST:", "c_custkey").alias("doc"), said.alias("text"))
    types = nation.where("n_nationkey % 2 = 0").select(S.key("MESH:", "n_nationkey").alias("curie"), F.lit("disease").alias("type"))
    return answers.annotate(documents, answers.grounding_dictionary(names), types, ["MESH"]).select("doc", "start", "text", "curie", "type")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'MESH:' || n_nationkey WHEN n_nationkey % 3 = 0 THEN 'geonames:' || n_nationkey END AS curie FROM nation UNION ALL SELECT 'MESH:7', 'MESH:7'")
def ground_name(spark, d):
    nation = S.table(spark, d, "nation")
    entries = nation.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("entry"), F.lit("MESH").alias("db"), S.key("MESH:", "n_nationkey").alias("curie"))
    entries = entries.unionByName(nation.where("n_nationkey % 3 = 0").select(F.lower("n_name").alias("entry"), F.lit("geonames").alias("db"), S.key("geonames:", "n_nationkey").alias("curie")))
    names = nation.select(F.col("n_name").alias("name")).unionByName(spark.createDataFrame([("MESH:7",)], "name string"))
    return G.ground(names, entries, ["MESH", "geonames"])


@query("SELECT event_type AS text, CASE WHEN user_id % 2 = 0 THEN CAST(user_id % 5 AS VARCHAR) END AS geoid, count(*) AS count FROM events GROUP BY 1, 2")
def geo_stats(spark, d):
    """Places by text and id; a missing id is a group."""
    place = F.struct(F.col("event_type").alias("text"), F.when(F.col("user_id") % 2 == 0, (F.col("user_id") % 5).cast("string")).alias("geoID"))
    return assemble.geo_counts(S.table(spark, d, "events").select(F.array(place).alias("geolocs")))


@query("SELECT event_type AS text, CASE WHEN user_id % 3 = 0 THEN '' ELSE strftime(date_trunc('month', ts), '%Y-%m') END AS intervals, count(*) AS count FROM events GROUP BY 1, 2")
def timex_stats(spark, d):
    """Times by text and their intervals joined; none is an empty string."""
    month = F.create_map(F.lit("start"), F.date_format("ts", "yyyy-MM"), F.lit("@id"), F.lit("x"))
    intervals = F.when(F.col("user_id") % 3 != 0, F.array(month))
    rows = S.table(spark, d, "events").select(F.array(F.struct(F.col("event_type").alias("text"), intervals.alias("intervals"))).alias("timexes"))
    return assemble.time_counts(rows.select(assemble.bare_times(F.col("timexes"), "@id", "@type").alias("timexes")))


@query("SELECT event_id, 'start' AS key, strftime(ts, '%Y-%m') AS value FROM events WHERE user_id % 3 <> 0")
def interval_key_drop(spark, d):
    """Keys of nested intervals without the bookkeeping ones."""
    month = F.create_map(F.lit("start"), F.date_format("ts", "yyyy-MM"), F.lit("@id"), F.lit("x"))
    rows = S.table(spark, d, "events").where("user_id % 3 <> 0").select("event_id", F.array(F.struct(F.col("event_type").alias("text"), F.array(month).alias("intervals"))).alias("timexes"))
    return rows.select("event_id", F.explode(assemble.bare_times(F.col("timexes"), "@id")[0]["intervals"][0]).alias("key", "value"))


# -- from text to answer

TEXT = "Cases of small ring, RED widget and blue bolt near Supplier#000000003 and supplier 000000005; small ring again."
SPACES = ["PART", "SUPP"]
ANNOTATED = """dict AS (SELECT p_name AS entry, p_name AS name, 'PART:' || min(p_partkey) AS curie, 'disease' AS type FROM part GROUP BY p_name
  UNION ALL SELECT replace(lower(s_name), '#', ' '), s_name, 'SUPP:' || s_suppkey, CASE WHEN s_nationkey = 3 THEN 'pathogen' ELSE 'other' END FROM supplier),
ann AS (SELECT w.i AS start, dict.entry AS text, dict.name, dict.curie, dict.type FROM (SELECT unnest(range(1, 18)) AS i,
  ['cases', 'of', 'small', 'ring', 'red', 'widget', 'and', 'blue', 'bolt', 'near', 'supplier', '000000003', 'and', 'supplier', '000000005', 'small', 'ring', 'again'] AS w) w JOIN dict ON w.w[w.i] || ' ' || w.w[w.i + 1] = dict.entry)"""


def vocabulary(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A dictionary of part names, each for its first part, and suppliers; and types by the hierarchy."""
    part = S.table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k")).select(S.key("PART:", "k").alias("curie"), "name")
    supplier = S.table(spark, d, "supplier").select(S.key("SUPP:", "s_suppkey").alias("curie"), F.col("s_name").alias("name"))
    kinds = assemble.type_by_helper(F.col("is_disease"), F.col("is_pathogen"), F.col("is_geoloc"))
    return answers.grounding_dictionary(part, supplier), flagged(spark, d).select("curie", kinds.alias("type"))


def part_scores(spark: SparkSession, d: str) -> DataFrame:
    return assemble.cooccurrence(S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").cast("string").alias("term")))


def text_answer(spark: SparkSession, d: str) -> answers.Answer:
    return answers.answer(S.graph(spark, d), TEXT, *vocabulary(spark, d), part_scores(spark, d), SPACES, "PART:")


PART_PAIRS = """t AS (SELECT DISTINCT l_orderkey AS doc, CAST(l_partkey AS VARCHAR) AS term FROM lineitem), q AS (SELECT DISTINCT replace(curie, 'PART:', '') AS term FROM ann WHERE starts_with(curie, 'PART:')),
s AS (SELECT x.term AS a, y.term AS b, (SELECT count(*) FROM t i JOIN t j ON i.doc = j.doc WHERE i.term = x.term AND j.term = y.term) AS n FROM q x JOIN q y ON x.term < y.term)"""


@query(f"WITH {ANNOTATED} SELECT start, text, name, curie, type FROM ann")
def text_annotations(spark, d):
    return text_answer(spark, d).annotations


@query(f"WITH {ANNOTATED} SELECT 0 AS doc, array_to_string(list_sort(list(DISTINCT curie)), ',') AS curies FROM ann")
def text_curies(spark, d):
    documents = spark.createDataFrame([(0, TEXT)], "doc int, text string")
    return answers.curies_of(answers.annotate(documents, *vocabulary(spark, d), SPACES)).withColumn("curies", F.array_join("curies", ","))


@query(f"WITH {ANNOTATED} SELECT src, l.type, dst FROM ({LINKS}) l WHERE src IN (SELECT curie FROM ann) AND dst IN (SELECT curie FROM ann)")
def text_direct(spark, d):
    return text_answer(spark, d).direct


@query(f"""WITH {ANNOTATED}, m AS ({MENTIONS}), pairs AS (SELECT a.alert, a.node AS a FROM m a JOIN m b ON a.alert = b.alert AND a.node <> b.node WHERE a.node IN (SELECT curie FROM ann) AND b.node IN (SELECT curie FROM ann))
SELECT alert, string_agg(DISTINCT a, ',' ORDER BY a) AS entities, count(DISTINCT a) AS n_entities FROM pairs GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 500""")
def text_alerts(spark, d):
    return text_answer(spark, d).alerts


@query(f"WITH {ANNOTATED}, {PART_PAIRS} SELECT a, b, CASE WHEN n = 0 THEN 'none' ELSE CAST(CAST(round(1000 * (ln(n) - ln((SELECT count(DISTINCT doc) FROM t)))) AS BIGINT) AS VARCHAR) END AS score FROM s")
def text_pair_scores(spark, d):
    """Scores of the text's pairs in thousandths; `none` stands for minus infinity."""
    score = F.when(F.col("score") == float("-inf"), "none").otherwise(F.when(F.col("score") > float("-inf"), F.round(F.col("score") * 1000)).otherwise(0).cast("long").cast("string"))
    return text_answer(spark, d).scores.select("a", "b", score.alias("score"))


@query(f"WITH {ANNOTATED}, {PART_PAIRS}, x AS (SELECT CAST(sum(n) AS DOUBLE) / (SELECT count(DISTINCT doc) FROM t) AS share FROM s) SELECT CASE WHEN coalesce(share, 0) = 0 THEN 'low' WHEN ln(share) > -4.5 THEN 'high' WHEN ln(share) > -7 THEN 'medium' ELSE 'low' END AS classification, round(coalesce(share, 0), 9) AS share FROM x")
def text_score(spark, d):
    """The class and score of a text by the terms of one namespace."""
    dictionary, types = vocabulary(spark, d)
    return answers.score_text(TEXT, dictionary, types, part_scores(spark, d), "PART").select("classification", F.round(F.exp("score_sum"), 9).alias("share"))


GENERAL_SQL = "(" + ", ".join(f"'{t}'" for t in GENERAL_TERMS) + ")"


def general_terms(spark: SparkSession, d: str) -> DataFrame:
    """Orders and the brands of their parts as term ids: a fifth of the brands are ids on the stop list."""
    n = F.regexp_extract("term", r"(\d+)$", 1).cast("int")
    ids = F.array(*[F.lit(t) for t in GENERAL_TERMS])
    return S.doc_term(spark, d).select("doc", F.when(n % 5 == 0, F.element_at(ids, (n / 5).cast("int") % len(GENERAL_TERMS) + 1)).otherwise(F.concat(F.lit("T"), n.cast("string"))).alias("term"))


@query(f"WITH {PAIRS} SELECT count(*) AS n_pairs, round(sum(exp(score)), 6) AS share FROM s WHERE {NUMBER.format('a').replace('% 4', '% 5')} <> 0 AND {NUMBER.format('b').replace('% 4', '% 5')} <> 0 AND {NUMBER.format('a').replace('% 4', '')} <> 7 AND {NUMBER.format('b').replace('% 4', '')} <> 7")
def score_without_general_terms(spark, d):
    """All pairs of terms but those on the stop list and one without a type."""
    rows = materialised(general_terms(spark, d))
    terms = rows.select("term").distinct()
    names = [r[0] for r in terms.collect()]  # the query's terms
    pairs = answers.pair_scores(assemble.cooccurrence(rows), names, terms.where("term <> 'T7'"))
    return pairs.agg(F.count(F.when(F.col("score") > float("-inf"), 1)).alias("n_pairs"), F.round(F.sum(F.exp("score")), 6).alias("share"))


NAMES_SQL = "(" + ", ".join(repr(n) for n in GENERAL_NAMES) + ")"
KIND = "['disease', 'geoloc', 'pathogen', 'other'][CAST(regexp_extract({}, '([0-9]+)$', 1) AS BIGINT) % 4 + 1]"


@query(f"""WITH m AS (SELECT DISTINCT l_orderkey AS doc, 'B:' || p_brand AS curie, CASE WHEN p_brand = 'Brand#6' THEN 'Health' ELSE substr(p_brand, 7) || 'x' END AS name, {KIND.format('p_brand')} AS kind FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.curie AS a, b.curie AS b, a.name AS name_a, b.name AS name_b, count(*) AS count FROM m a JOIN m b ON a.doc = b.doc AND (a.name, a.curie) < (b.name, b.curie)
WHERE a.kind <> b.kind AND a.kind <> 'other' AND b.kind <> 'other' AND a.name NOT IN {NAMES_SQL} AND b.name NOT IN {NAMES_SQL} GROUP BY ALL""")
def typed_pairs_by_name(spark, d):
    """Pairs of typed entities in the order of their names, one name of which is on the stop list."""
    rows = S.doc_term(spark, d)
    name = F.when(F.col("term") == "Brand#6", "Health").otherwise(F.concat(F.substring("term", 7, 10), F.lit("x")))
    mentions = rows.select("doc", S.key("B:", "term").alias("curie"), name.alias("name"))
    kinds = rows.select(S.key("B:", "term").alias("curie"), S.brand_type().alias("kind")).distinct()
    return assemble.typed_pairs(mentions, kinds.select("curie", *(F.col("kind").eqNullSafe(k).alias(f"is_{k}") for k in ROOTS)))


def region_names(spark: SparkSession, d: str) -> DataFrame:
    return answers.grounding_dictionary(S.graph(spark, d).labelled("geoloc").where(F.split_part("curie", F.lit(":"), F.lit(1)).isin("REGION", "NATION")))


@query(ORACLES["alerts_by_geo"])
def alerts_by_name(spark, d):
    """Alert search by a place's name."""
    return answers.alerts_by_name(S.graph(spark, d), region_names(spark, d), ["REGION", "NATION"], geolocation="Asia", timestamp="")


@query(f"SELECT DISTINCT 'wdi:' || p_type AS indicator, 'NATION:' || nation AS place, 'REGION:2' AS path FROM ({REVENUE}) JOIN nation ON n_nationkey = nation WHERE n_regionkey = 2 AND contains('revenue of ' || p_type, 'A')")
def indicators_by_name(spark, d):
    """Indicators of places under or above a place given by its name."""
    rows = services.indicators_by_name(S.graph(spark, d), region_names(spark, d), ["REGION", "NATION"], "asia", "A")
    return rows.select("indicator.curie", F.col("place.curie").alias("place"), F.array_join("path", ",").alias("path")).withColumnRenamed("curie", "indicator")


@query("SELECT '' AS alert, '' AS timestamp, '' AS geoloc, '' AS geoloc_isa WHERE false")
def alerts_unknown_name(spark, d):
    return answers.alerts_by_name(S.graph(spark, d), region_names(spark, d), ["REGION", "NATION"], geolocation="Atlantis")


@query("SELECT n_nationkey AS key, CASE n_nationkey % 4 WHEN 0 THEN 'nation ' || n_nationkey || ' 2' WHEN 1 THEN 'nation ' || n_nationkey || ' alpha virus' WHEN 2 THEN 'nation ' || n_nationkey || ' hepatitis sigma 14' ELSE 'iv nation ' || n_nationkey END AS name FROM nation")
def names_normalised(spark, d):
    """Dashes, Greek letters and Roman numbers in names."""
    more = F.element_at(F.array(F.concat("n_name", F.lit("\u2013II")), F.concat("n_name", F.lit(" \u0391-Virus")), F.concat("n_name", F.lit(" hepatitis-\u03c2  xiv ")), F.concat(F.lit("IV "), "n_name")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return S.table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), T.normalised(more).alias("name"))


@query("SELECT s_suppkey AS key, ltrim('MESH:' || CASE WHEN s_suppkey % 2 = 0 THEN 'D' ELSE 'HS' END || s_suppkey, 'MESH:') AS id FROM supplier")
def trimmed_characters(spark, d):
    """Leading characters of a set are cut off, not a prefix."""
    curie = F.concat(F.lit("MESH:"), F.when(F.col("s_suppkey") % 2 == 0, "D").otherwise("HS"), F.col("s_suppkey").cast("string"))
    return S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), T.trimmed_front(curie, "MESH:").alias("id"))


@query("""SELECT '{"curie":"NATION:' || n_nationkey || '","name":"' || n_name || '","labels":["geoloc","entity"]}' AS json FROM nation""")
def json_rows(spark, d):
    """Nodes as JSON texts; what is null is left out."""
    return answers.as_json(S.graph(spark, d).nodes.where(F.col("curie").startswith("NATION:")))


@query(f"WITH {MATRIX}, c AS (SELECT doc, {KIND.format('term')} AS type, count(*) AS n FROM w WHERE term IN {IN_QUERY} AND doc IN (SELECT doc FROM ({fisher_sql(QUERY_TERMS, 2)})) GROUP BY 1, 2) SELECT doc, string_agg(type || '=' || n, ',' ORDER BY type) AS overlap_counts FROM c GROUP BY 1")
def fisher_type_counts(spark, d):
    """How many of the query's terms the best documents have of each type; terms come as a comma list of curies."""
    rows = literature.find_literature(S.doc_term(spark, d), "x:Brand#1,x:Brand#2, x:Brand#3", S.brand_type(), prefix="x:")
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("overlap_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rows.select("doc", counts.alias("overlap_counts"))


@query(f"WITH {MATRIX} SELECT count(DISTINCT doc) AS n_docs, count(DISTINCT term) AS n_terms FROM w")
def matrix_totals(spark, d):
    return literature.totals(S.doc_term(spark, d))


@query(f"WITH t AS ({BRANDS}), q AS (SELECT doc, list_sort(list(term)) AS own FROM t GROUP BY 1) SELECT doc, array_to_string(list_sort(list_intersect(own, ['Brand#1', 'Brand#2', 'Brand#3'])), ',') AS common, CAST(3 - len(list_intersect(own, ['Brand#1', 'Brand#2', 'Brand#3'])) AS INT) AS n_missing, CAST(len(list_distinct(list_concat(own, ['Brand#1', 'Brand#2', 'Brand#3']))) AS INT) AS n_union FROM q")
def term_set_operations(spark, d):
    """Each document's terms against a query's: intersection, difference, union."""
    asked = F.array(*map(F.lit, QUERY_TERMS))
    rows = S.doc_term(spark, d).groupBy("doc").agg(F.collect_set("term").alias("own"))
    return rows.select("doc", F.array_join(F.array_sort(F.array_intersect("own", asked)), ",").alias("common"), F.size(F.array_except(asked, "own")).alias("n_missing"), F.size(F.array_union("own", asked)).alias("n_union"))


# -- patterns as text


@query(ORACLES["match_chain"])
def pattern_text_chain(spark, d):
    """The pattern of match_chain as text."""
    text = """
        MATCH (alert:alert)-[:mentions]->(place)-[:isa*0..]->(region:geoloc {curie: $region})
        MATCH (alert)-[:mentions]->(part)-[:has_pathogen]->(supplier:pathogen {curie: 'SUPP:3'})
        RETURN DISTINCT alert.curie AS alert, part.curie AS part, supplier.curie AS supplier"""
    return pattern_query.run(S.graph(spark, d), text, region="REGION:2")


@query(f"SELECT DISTINCT 'NATION:' || nation AS land, 'revenue of ' || p_type AS series, 'REGION:' || n_regionkey || ',GEO:world' AS via FROM ({REVENUE}) JOIN nation ON n_nationkey = nation WHERE contains('revenue of ' || p_type, 'A') UNION SELECT DISTINCT 'NATION:' || nation, 'revenue of ' || p_type, '' FROM ({REVENUE}) WHERE nation = 7 AND starts_with(p_type, 'E')")
def pattern_text_indicators(spark, d):
    """Series of all lands with their way to the top, and of one land those whose key begins so, with the way from it to itself."""
    text = """
        MATCH trail = (land:geoloc)-[:isa*0..]->(top:geoloc {curie: $top}), (land)-[:has_indicator]->(series)
        WHERE series.name CONTAINS 'A'
        RETURN DISTINCT land.curie AS land, series.name AS series, nodes(trail)[1..] AS via
        UNION
        MATCH (land:geoloc {curie: $one})-[:has_indicator]->(series), trail = (self {curie: $one})-[:isa*0..]->(land)
        WHERE series.curie STARTS WITH 'wdi:E'
        RETURN DISTINCT land.curie AS land, series.name AS series, nodes(trail)[1..] AS via"""
    return pattern_query.run(S.graph(spark, d), text, top="GEO:world", one="NATION:7").withColumn("via", F.array_join("via", ","))


@query(f"SELECT DISTINCT n_name AS land, 'revenue of ' || p_type AS series, 'has_indicator' AS how FROM ({REVENUE}) JOIN nation ON n_nationkey = nation WHERE n_regionkey = 2 AND starts_with(p_type, 'E')")
def pattern_text_region_series(spark, d):
    """Series of the lands of one region whose key begins so."""
    text = """
        MATCH (land:geoloc)-[:isa]->(region:geoloc {curie: $region}) MATCH (land)-[has:has_indicator]->(series:indicator)
        WHERE series.curie STARTS WITH 'wdi:E'
        RETURN DISTINCT land.name AS land, series.name AS series, has.type AS how"""
    return pattern_query.run(S.graph(spark, d), text, region="REGION:2")


@query("""SELECT p_name AS thing, 'BRAND:' || p_brand || ',DIS:root' AS trail FROM part WHERE p_partkey IN (1, 7, 11) UNION SELECT p_name, 'TYPE:' || p_type || ',DIS:root' FROM part WHERE p_partkey IN (1, 7, 11)
UNION SELECT p_name, 'SIZE:10' FROM part WHERE p_size = 10 UNION SELECT 'size 10', ''""")
def pattern_text_trails(spark, d):
    """Ways of some parts to the root, and of all things to a size, over edges of two types."""
    text = """
        MATCH trail = (thing:disease)-[:has_phenotype|isa*0..]->(top:disease)
        WHERE thing.curie IN $parts AND top.curie = $root
        RETURN thing.name AS thing, nodes(trail)[1..] AS trail
        UNION
        MATCH trail = (thing:disease)-[:has_phenotype|isa*0..]->(top:disease {curie: $size})
        RETURN thing.name AS thing, nodes(trail)[1..] AS trail"""
    rows = pattern_query.run(S.graph(spark, d), text, parts=["PART:1", "PART:7", "PART:11"], root="DIS:root", size="SIZE:10")
    return rows.withColumn("trail", F.array_join("trail", ","))


@query("SELECT DISTINCT 'PART:' || l_partkey AS part, 'has_pathogen' AS how, 'SUPP:' || l_suppkey AS supplier, s_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey IN (1, 7, 11)")
def pattern_text_edges(spark, d):
    """Typed edges from listed nodes, backwards, with a property of the other end."""
    text = "MATCH (supplier:pathogen)<-[link:has_pathogen]-(part:disease) WHERE part.curie IN $parts RETURN part.curie AS part, link.type AS how, supplier.curie AS supplier, supplier.name AS name"
    return pattern_query.run(S.graph(spark, d), text, parts=["PART:1", "PART:7", "PART:11", "SUPP:1"])


@query("SELECT DISTINCT 'ORD:' || o_orderkey AS report, 'CUST:' || o_custkey AS buyer FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey = 4 AND strftime(o_orderdate, '%Y-%m-%d') <> '1996-03-01'")
def pattern_text_shared_report(spark, d):
    """Two mentions of one report, the second fixed by its key."""
    text = """
        MATCH (report:alert)-[:mentions]->(buyer:geoloc) MATCH (report)-[:mentions]->(maker:pathogen)
        WHERE maker.curie = 'SUPP:4' AND report.timestamp <> '1996-03-01'
        RETURN DISTINCT report.curie AS report, buyer.curie AS buyer"""
    return pattern_query.run(S.graph(spark, d), text)


@query("""SELECT one.curie AS land, other.curie AS other FROM (SELECT 'NATION:' || n_nationkey AS curie FROM nation WHERE n_regionkey = 2) one
JOIN (SELECT 'REGION:2' AS curie, '' AS over UNION ALL SELECT 'NATION:' || n_nationkey, 'NATION:' || n_nationkey FROM nation WHERE n_regionkey = 2
UNION ALL SELECT 'CUST:' || c_custkey, 'NATION:' || c_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2) other ON other.over <> one.curie""")
def pattern_text_used_once(spark, d):
    """One edge and a way of any length over edges of its type in one MATCH: the way can't lead over that edge."""
    text = "MATCH (land:geoloc)-[:isa]->(region:geoloc {curie: $region})<-[:isa*0..]-(other:geoloc) RETURN DISTINCT land.curie AS land, other.curie AS other"
    return pattern_query.run(S.graph(spark, d), text, region="REGION:2")


def supply_ring(spark, d) -> G.Graph:
    """Numbers up to 25 as nodes; each supplier is an edge from its key's remainder to its nation's."""
    s = S.table(spark, d, "supplier")
    number = lambda c: F.concat(F.lit("N:"), (F.col(c) % 25).cast("string"))
    edges = s.select(number("s_suppkey").alias("src"), F.lit("next").alias("type"), number("s_nationkey").alias("dst"), F.lit(None).cast("map<string,double>").alias("years_data")).dropDuplicates(["src", "dst"])
    nodes = s.select(F.explode(F.array(number("s_suppkey"), number("s_nationkey"))).alias("curie")).distinct()
    return G.Graph(nodes.select("curie", F.col("curie").alias("name"), F.array(F.lit("number")).alias("labels"), F.lit(None).cast("string").alias("timestamp")), edges)


@query("SELECT DISTINCT 'N:' || s_nationkey % 25 AS node FROM supplier WHERE s_suppkey % 25 = s_nationkey % 25")
def pattern_text_loops(spark, d):
    """Nodes with an edge to themselves."""
    return pattern_query.run(supply_ring(spark, d), "MATCH (n:number)-[:next]->(n) RETURN n.curie AS node")


@query("SELECT 'CUST:' || c_custkey AS start, 'NATION:' || n_nationkey || ',REGION:2' AS path FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 'PART:' || p_partkey, 'BRAND:' || p_brand || ',DIS:root' FROM part UNION ALL SELECT 'PART:' || p_partkey, 'TYPE:' || p_type || ',DIS:root' FROM part")
def paths_to_ends(spark, d):
    """Ways from all customers and parts to two ends: edges that lead to neither are taken out before paths are walked."""
    g = S.graph(spark, d)
    starts = g.nodes.where(F.col("curie").startswith("CUST:") | F.col("curie").startswith("PART:"))
    found = paths(g.typed("isa"), starts, None, ends=g.nodes.where(F.col("curie").isin("REGION:2", "DIS:root")))
    return found.select("start", F.array_join("path", ",").alias("path"))


# -- files written and read back


def folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query(f"SELECT number AS archive_number, 'PRO/' || source || ' news' AS subject, 'PRO/' || source || ' news' || chr(10) || chr(10) || CASE WHEN id % 3 <> 0 THEN 'Title ' || source || chr(10) || chr(10) || {JOINED} || chr(10) || chr(10) || 'Second' || chr(10) || chr(10) || 'end of it' || chr(10) || chr(10) ELSE '' END AS text FROM ({RAW}) WHERE id % 7 <> 0")
def alerts_from_dumps(spark, d):
    """All documents as alerts in JSON dumps, read by byte ranges; those without an archive number drop out."""
    path = folder(spark)
    S.alert_raw(spark, d).select(F.array("header").alias("header"), F.array("body").alias("body")).write.json(path, lineSep=",\n")
    return files.alerts(files.raw_alerts(spark, path)).select("archive_number", "subject", "text")


def customer_alerts(spark, d):
    """One alert for each order, its customer's key as archive number."""
    orders = S.table(spark, d, "orders")
    return orders.select(F.col("o_custkey").cast("string").alias("archive_number"), F.concat("o_orderpriority", F.lit("\n\u00e9 "), "o_orderkey").alias("text"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("file"))


LAST = "SELECT CAST(o_custkey AS VARCHAR) AS name, max_by(o_orderpriority || chr(10) || '\u00e9 ' || o_orderkey, o_orderkey) AS text, lpad(CAST(max(o_orderkey) AS VARCHAR), 12, '0') AS file FROM orders GROUP BY o_custkey"


@query(f"SELECT name, text FROM ({LAST})")
def alert_text_files(spark, d):
    """A text file for each archive number, of its last alert, written by the data source and read back."""
    path = folder(spark)
    files.write_texts(customer_alerts(spark, d), path)
    return files.named_texts(spark, path)


@query(LAST)
def alert_json_files(spark, d):
    """The same as JSON files."""
    path = folder(spark)
    files.write_alert_files(customer_alerts(spark, d), path)
    return files.named_texts(spark, path).select("name", F.from_json("text", "archive_number string, text string, file string").alias("alert")).select("name", "alert.text", "alert.file")


@query("SELECT CAST(o_custkey AS VARCHAR) AS archive_number, string_agg(DISTINCT lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), ',' ORDER BY lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS files FROM orders GROUP BY 1")
def alert_file_index(spark, d):
    rows = files.file_index(customer_alerts(spark, d).withColumn("file", F.concat(F.lit("dumps/"), "file")))
    return rows.select("archive_number", F.array_join("files", ",").alias("files"))


@query("""SELECT DISTINCT p_brand || chr(9) || '"' || p_size || '"' AS name, p_type AS label, p_size AS size FROM part""")
def tsv_round_trip(spark, d):
    """Sorted rows of a TSV file with tabs and quotes in strings."""
    path = folder(spark)
    part = S.table(spark, d, "part")
    files.write_tsv(part.select(F.concat("p_brand", F.lit('\t"'), "p_size", F.lit('"')).alias("name"), F.col("p_type").alias("label"), F.col("p_size").alias("size")), path)
    return files.tsv(spark, path, "name string, label string, size int")


@query("SELECT l_orderkey AS doc, 'D' || l_partkey AS term, CAST(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS BIGINT) AS weight FROM lineitem")
def doc_terms_round_trip(spark, d):
    """Documents' terms from a CSV file, major ones weighing 2."""
    path = folder(spark)
    S.table(spark, d, "lineitem").select(F.concat(F.lit("D"), "l_partkey").alias("mesh_id"), (F.col("l_returnflag") == "R").cast("int").alias("major"), F.col("l_orderkey").alias("pmid")).write.csv(path, header=True)
    return files.doc_terms(spark, path)


@query("SELECT l_orderkey AS doc, 'D' || l_partkey AS term, CAST(sum(l_linenumber) AS BIGINT) AS weight, min(p_brand) AS type FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def matrix_round_trip(spark, d):
    """A stored matrix and its terms' types."""
    path, term = folder(spark), lambda c: F.concat(F.lit("D"), c)
    entries = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), term("l_partkey").alias("term"), F.col("l_linenumber").cast("long").alias("weight"))
    files.write_matrix(entries, S.table(spark, d, "part").select(term("p_partkey").alias("term"), F.col("p_brand").alias("type")), path)
    rows, types = files.matrix(spark, path)
    return rows.join(types, "term").select("doc", "term", "weight", "type")


ORDER_TERMS = "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS doc, p_type AS surface, CASE WHEN p_size > 25 THEN 'A' ELSE 'B' END AS db, CAST(l_partkey AS VARCHAR) AS id, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey"


def order_mentions(spark, d):
    rows = S.table(spark, d, "lineitem").join(S.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").cast("string").alias("doc"), F.col("p_type").alias("surface"), F.lit(1).alias("start"), F.when(F.col("p_size") > 25, "A").otherwise("B").alias("db"), F.col("l_partkey").cast("string").alias("id"), F.col("p_name").alias("name")).distinct()


@query(f"SELECT doc, string_agg(db || ':' || id || ':' || name, ',' ORDER BY db, id, name) AS terms FROM (SELECT DISTINCT doc, db, id, name FROM ({ORDER_TERMS})) GROUP BY doc")
def terms_round_trip(spark, d):
    """Annotations stored and read, each document's terms of them written as JSON and read."""
    path = folder(spark)
    files.write_annotations(order_mentions(spark, d), f"{path}/mentions")
    files.write_terms(services.terms_by_alert(files.annotations(spark, f"{path}/mentions")), f"{path}/terms")
    return files.terms(spark, f"{path}/terms").select("doc", F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["db"], t["id"], t["name"])), ",").alias("terms"))


@query(f"SELECT surface AS text, db AS term_db, id AS term_id, name AS term_name, count(*) AS count FROM ({ORDER_TERMS}) GROUP BY ALL")
def stats_round_trip(spark, d):
    """Statistics of mentions as a TSV file."""
    path = folder(spark)
    files.write_stats(services.mention_stats(order_mentions(spark, d)), path)
    return files.tsv(spark, path, "text string, term_db string, term_id string, term_name string, count long")


@query("SELECT CASE WHEN n > 0 THEN key || '_' || n ELSE key END AS key, match, curie FROM (SELECT lower(p_type) AS key, p_type AS match, 'PART:' || p_partkey AS curie, row_number() OVER (PARTITION BY lower(p_type) ORDER BY 'PART:' || p_partkey) - 1 AS n FROM part)")
def synonym_key_suffixes(spark, d):
    """A key for each part's type; those after the first get a number."""
    rows = S.table(spark, d, "part").select(F.col("p_type").alias("match"), F.col("p_name").alias("name"), F.concat(F.lit("PART:"), "p_partkey").alias("curie"))
    return services.synonym_keys(rows).select("key", "match", "curie")


@query("SELECT DISTINCT n_name AS name FROM nation WHERE starts_with(n_name, 'NATION_1') ORDER BY 1 LIMIT 7")
def names_in_this_case(spark, d):
    """Names by a prefix whose case counts, beside the same names in another case."""
    nodes = S.table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return services.names_from(nodes.unionByName(nodes.select(F.lower("name").alias("name"))), "NATION_1", 7)
