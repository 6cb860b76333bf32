"""Operators on small hand-made inputs, and registered queries against their SQL."""

import math
import random
from collections import Counter
from fractions import Fraction
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fathom.functions import tables
from fathom.functions import text as T
from fathom.functions.statistics import fisher_greater
from fathom.operators import assemble, literature, pattern_query
from fathom.operators import graph as G
from fathom.operators.graph import Graph, autocomplete, first_completions, stored_completions, write_completions
from fathom.operators.traverse import closure, edges_at, paths, stored_ancestors, useful_edges, write_ancestors
from fathom.plans import catalog
from fathom.sources import files
from fathom.sources import testgraph as S

SMALL = "/root/testdata/sf0.001"


def edges(spark, *pairs):
    return spark.createDataFrame([(a, "isa", b) for a, b in pairs], "src string, type string, dst string")


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "curie string")


def test_closure_of_diamond_and_cycle(spark):
    diamond = edges(spark, "ab", "ad", "bc", "dc", "ce")
    assert {r.curie for r in closure(diamond, seeds(spark, "c")).collect()} == set("abcd")
    assert {r.curie for r in closure(edges(spark, "ab", "ba"), seeds(spark, "a")).collect()} == set("ab")


def test_paths_of_diamond(spark):
    found = paths(edges(spark, "ab", "ad", "bc", "dc", "ce"), seeds(spark, "a"), 4)
    assert sorted(r.path for r in found.where("node = 'e'").collect()) == [["b", "c", "e"], ["d", "c", "e"]]
    assert found.where("node = 'a'").first().path == []


def test_load_keeps_first_node_and_repeated_edges(spark):
    nodes = spark.createDataFrame([("n1", "first", 1), ("n1", "second", 2), ("n2", "x", 3)], "curie string, name string, ord int")
    kept, good = assemble.load(nodes, edges(spark, ("n1", "n9"), ("n1", "n2"), ("n1", "n2")), "ord")
    assert {(r.curie, r.name) for r in kept.collect()} == {("n1", "first"), ("n2", "x")}
    assert good.count() == 2


def test_consistent_edges(spark):
    flags = spark.createDataFrame([("c", True, False), ("p1", True, False), ("p2", False, True)], "curie string, is_disease boolean, is_geoloc boolean")
    assert [r.dst for r in assemble.consistent(edges(spark, ("c", "p1"), ("c", "p2")), flags, ("is_disease", "is_geoloc")).collect()] == ["p1"]


@pytest.mark.parametrize(
    ("lines", "wanted"),
    [
        (["T", "-----", "x", "y", "--"], [("T", "x y")]),
        (["T", "---", "x", "--", "tail"], [("T", "x")]),
        (["T", "---", "x"], []),
        (["--", "T", "---", "x", "--"], []),
        (["A", "---", "x", "B", "---", "y", "--"], [("B", "y")]),
        (["T", "---", "x", "--", "--"], [("T", "x"), ("T", "x")]),
        (["---", "x", "--"], [("--", "x")]),
    ],
)
def test_sections(spark, lines, wanted):
    rows = spark.createDataFrame([("\n".join(lines),)], "body string").select(T.sections(F.col("body")).alias("s")).first().s
    assert [(r.title, r.content) for r in rows] == wanted


def test_header_without_archive_or_subject(spark):
    h = spark.createDataFrame([("Published Date: 2019-11-05 07:03:21 CET\n",)], "h string").select(T.parsed_header(F.col("h")).alias("p")).first().p
    assert (str(h.date), h.subject, h.archive_number) == ("2019-11-05 07:03:21", None, None)


def test_fisher_against_exact_fractions(spark):
    cases = [(a, k, t, n) for n, k, t in product((5, 12, 25), (1, 2, 3), (1, 3, 4)) for a in range(min(k, t) + 1)]
    rows = spark.createDataFrame(cases, "a long, k long, t long, n long").select("*", fisher_greater(F.col("a"), F.col("k"), F.col("t"), F.col("n")).alias("p")).collect()
    for r in rows:
        exact = sum(Fraction(math.comb(r.t, i) * math.comb(r.n - r.t, r.k - i), math.comb(r.n, r.k)) for i in range(r.a, min(r.k, r.t) + 1))
        assert r.p == pytest.approx(float(exact), abs=1e-12)


def test_stored_ancestors_are_the_closure(spark, tmp_path):
    r = random.Random(4)
    tree = [(f"n{i}", f"n{r.randrange(i)}") for i in range(1, 60)] + [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(8)]
    line = [(f"l{i}", f"l{i + 1}") for i in range(37)] + [("x", "x"), ("n3", "l30")]
    found = edges(spark, *tree, *line)
    write_ancestors(found, str(tmp_path / "up"))
    stored = stored_ancestors(spark, str(tmp_path / "up"))
    names = sorted({x for pair in tree + line for x in pair})
    wanted = closure(found, spark.createDataFrame([(n,) for n in names], "curie string"))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, wanted.collect()))
    nodes = spark.createDataFrame([(n, n, ["geoloc"], None) for n in [*names, "alone"]], "curie string, name string, labels array<string>, timestamp string")
    graph = Graph(nodes, found, {("isa",): stored})
    for name in ("n0", "l37", "x", "alone", "unknown"):
        assert sorted(r.curie for r in graph.reach(name, "isa", label="geoloc").collect()) == sorted(r.curie for r in Graph(nodes, found).reach(name, "isa").collect())
    assert "EqualTo(root,n0)" in stored.where("root = 'n0'")._jdf.queryExecution().toString()


def test_wide_documents_count_each_pair_once(spark):
    r = random.Random(6)
    rows = [(d, f"t{t}") for d in range(12) for t in range(60) if r.random() < (0.9 if d < 3 else 0.05)] + [(0, "t1"), (0, "t1")]
    terms = spark.createDataFrame(rows, "doc int, term string")
    pick = lambda x: sorted((r.a, r.b, r["count"]) for r in x.collect())
    wanted = Counter((a, b) for d in range(12) for a in {t for x, t in rows if x == d} for b in {t for x, t in rows if x == d} if a < b)
    assert pick(assemble.cooccurrence(terms, width=7)) == pick(assemble.cooccurrence(terms)) == sorted((*k, n) for k, n in wanted.items())
    mentions = terms.select("doc", F.col("term").alias("curie"), F.concat(F.lit("name "), "term").alias("name"))
    n = F.substring("term", 2, 9).cast("int")
    flags = terms.select(F.col("term").alias("curie"), (n % 3 == 0).alias("is_disease"), (n % 3 == 1).alias("is_geoloc"), (n % 3 == 2).alias("is_pathogen")).distinct()
    narrow, wide = (sorted(map(tuple, assemble.typed_pairs(mentions, flags, width=w).collect())) for w in (5, 1000))
    assert narrow == wide and len(narrow) > 500


def test_fisher_with_many_terms(spark):
    """Binomials beyond doubles, overlaps on either side of the mean."""
    cases = [(a, k, t, 30_000) for k in (1, 20, 108, 150, 400, 1000) for t in (1, 20, 50, 300) for a in (0, 1, 2, 3, 5, 10, 19) if a <= min(k, t)]
    cases += [(a, 700, 600, 1000) for a in (300, 301, 380, 419, 420, 421, 450, 600)] + [(4, 3, 9, 20)]
    rows = spark.createDataFrame(cases, "a long, k long, t long, n long").select("*", fisher_greater(F.col("a"), F.col("k"), F.col("t"), F.col("n")).alias("p")).collect()
    for r in rows:
        exact = sum(Fraction(math.comb(r.t, i) * math.comb(r.n - r.t, r.k - i), math.comb(r.n, r.k)) for i in range(r.a, min(r.k, r.t) + 1))
        assert r.p == pytest.approx(float(exact), rel=1e-8, abs=1e-12), r


def test_postings_answer_like_the_matrix(spark, tmp_path):
    rows = [(d, f"t{t}", 1 + (d + t) % 2) for d in range(60) for t in range(8) if (d * 7 + t * 3) % 5 < 2] + [(3, "t1", 1)]
    matrix = spark.createDataFrame(rows, "doc long, term string, weight long")
    files.write_postings(matrix, str(tmp_path))
    stored = files.postings(spark, str(tmp_path))
    kind = F.when(F.col("term") < "t3", "disease").when(F.col("term") < "t6", "geoloc").otherwise("other")
    for query in (["t1"], ["t0", "t4"], ["t0", "t1", "t2", "t5", "t7"]):
        wanted = literature.with_type_counts(literature.ranked(matrix, query, kind, 50), matrix, query, kind)
        pick = lambda x: [(r.doc, r.overlap, r.relevant_coverage, r.coverage, round(r.pval, 9), r.overlap_ids, r.overlap_counts) for r in x.collect()]
        assert pick(literature.ranked_by_postings(stored, query, kind, 50)) == pick(wanted)
    with pytest.raises(KeyError):
        literature.ranked_by_postings(stored, ["t1", "none"], kind)
    plan = stored.rows.where(F.col("term").isin("t1", "t2"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan


def test_completions_by_ranges_of_keys(spark, tmp_path):
    names = ["Abc", "abd", "ABD", "ab", "a\U0010ffff", "b", "é", "\ud7ffx", "\ue000y", None]
    nodes = spark.createDataFrame([(f"c{i}", n) for i, n in enumerate(names)], "curie string, name string")
    write_completions(nodes, str(tmp_path / "keys"))
    stored = stored_completions(spark, str(tmp_path / "keys"))
    for prefix in ("", "a", "AB", "abd", "b", "\ud7ff", "a\U0010ffff", "z", "a:b"):
        wanted = sorted({n.lower() for n in names if n and n.lower().startswith(prefix.lower())} if ":" not in prefix else [])
        assert [r.key for r in first_completions(stored, prefix).collect()] == [r.key for r in autocomplete(nodes, prefix).collect()] == wanted
    assert {r.key: r.curie for r in stored.collect()}["abd"] == "c2"
    assert "GreaterThanOrEqual(key,ab), LessThan(key,ac)" in first_completions(stored, "ab")._jdf.queryExecution().toString()


def test_cooccurrence_and_plausibility(spark):
    terms = spark.createDataFrame([("A", "1"), ("A", "2"), ("A", "3"), ("B", "1"), ("B", "2"), ("C", "4"), ("C", "4")], "doc string, term string")
    scores = assemble.cooccurrence(terms)
    assert {(r.a, r.b): round(math.exp(r.score) * 3) for r in scores.collect()} == {("1", "2"): 2, ("1", "3"): 1, ("2", "3"): 1}
    high = assemble.plausibility(scores, ["1", "2", "3"]).first()
    assert high["class"] == "high" and high.score == pytest.approx(math.log(4 / 3))
    assert assemble.plausibility(scores, ["1", "4"]).first() == (float("-inf"), "low")


def test_year_values_skip_what_is_no_number(spark):
    wide = spark.createDataFrame([("Aland", "1.23456", "..", "5d")], "place string, `2000` string, `2001` string, `2002` string")
    assert assemble.year_values(wide, ["place"]).first().years_data == {"2000": 1.235}


def test_autocomplete(spark):
    nodes = spark.createDataFrame([("a", "Flu"), ("b", "flu"), ("c", "Fluke")], "curie string, name string")
    assert [(r.key, r.curie) for r in autocomplete(nodes, "FL", 500).collect()] == [("flu", "b"), ("fluke", "c")]
    assert autocomplete(nodes, "a:b").count() == 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_unpivot_map_covers_every_year(spark, tmp_path):
    db = duckdb.connect()
    for t in ("customer", "orders", "part"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    kind = lines.schema["l_shipdate"].dataType
    lines.withColumn("l_shipdate", F.add_months("l_shipdate", F.when(F.col("l_orderkey") % 3 == 0, 120).when(F.col("l_orderkey") % 3 == 1, -120).otherwise(0)).cast(kind)).write.parquet(f"{tmp_path}/lineitem.parquet")
    for t in ("customer", "orders", "part", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    wanted = db.execute(catalog.ORACLES["indicator_unpivot_map"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["indicator_unpivot_map"](spark, str(tmp_path)).collect())) == sorted(wanted)
    assert {"1985", "2011"} <= {r[2] for r in wanted}


@pytest.mark.parametrize("name", ["alerts_multi_filter", "indicator_paths_up", "typed_pair_counts", "fisher_rank", "section_parse", "ner_mentions"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    rows = db.execute(catalog.ORACLES[name]).df()[columns]
    assert ours == sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in rows.itertuples(index=False, name=None))


def equal_to_sql(spark, name, tables=("region", "nation", "customer", "supplier", "part", "orders", "lineitem")):
    """The rows of a query, which must be those of its SQL."""
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert rows == sorted(db.sql(catalog.ORACLES[name]).select(*columns).fetchall())
    return rows


def test_series_of_all_lands_come_with_their_ways(spark):
    rows = equal_to_sql(spark, "pattern_text_indicators")
    ways = {via for _, _, via in rows}
    assert "" in ways and len(ways) > 4 and all(w == "" or w.endswith(",GEO:world") for w in ways)


def test_a_matrix_is_dealt_to_as_many_tasks_as_its_entries_need(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    matrix = spark.range(1000).select((F.col("id") % 300).alias("doc"), (F.col("id") % 7).cast("string").alias("term"), F.lit(1).cast("long").alias("weight"))
    rows = literature.postings_of(matrix)
    assert rows.count() == 1000 and rows.rdd.getNumPartitions() == 10
    files.write_postings(matrix, str(tmp_path))
    assert len(list((tmp_path / "postings").glob("*.parquet"))) == 10
    assert files.postings(spark, str(tmp_path)).rows.count() == 1000


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_mentions_across_chunks_equal_brute_force(spark, monkeypatch, chunk):
    """A chunk tells by itself which entries stand inside others, also in those that begin before it."""
    monkeypatch.setattr(T, "CHUNK_WORDS", chunk)
    rng = random.Random(chunk)
    for longest in (1, 3, 11):
        entries = sorted({" ".join(rng.choice("abc") for _ in range(rng.randint(1, longest))) for _ in range(12)})
        texts = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))) for i in range(20)] + [(20, None), (21, "...")]
        wanted = []
        for doc, words in ((i, (t or "").replace(".", "").split()) for i, t in texts):
            found = [(s, s + n) for s in range(len(words)) for n in range(1, longest + 1) if s + n <= len(words) and " ".join(words[s : s + n]) in entries]
            wanted += [(doc, " ".join(words[a:b]), a + 1) for a, b in found if not any((c < a and d >= b) or (c == a and d > b) for c, d in found)]
        dictionary = spark.createDataFrame([(e, "M", e, e) for e in [*entries, None]], "entry string, db string, id string, name string")
        rows = T.mentions(spark.createDataFrame(texts, "doc long, text string"), dictionary)
        assert sorted((r.doc, r.surface, r.start) for r in rows.collect()) == sorted(wanted)


@pytest.mark.parametrize("name", ["ner_stats", "ner_mentions", "ner_top_terms", "ns_priority"])
def test_mentions_are_dealt_to_as_many_tasks_as_their_count_needs(spark, monkeypatch, name):
    """Texts stay where they are read; only the short rows of what is found are dealt, by chunk, and no task gets more as texts become more."""
    dealt = []
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    monkeypatch.setattr(T, "tasks_for", lambda rows: dealt.append((rows.columns, rows.count(), tables.tasks_for(rows))) or dealt[-1][2], raising=False)
    equal_to_sql(spark, name, ("documents",))
    assert dealt and all(set(columns) == {"doc", "at", "start", "n", "surface"} and n > 1000 and tasks == -(-n // 100) for columns, n, tasks in dealt)


def test_edges_of_few_nodes_are_not_brought_together_by_node(spark):
    """Nine in ten edges end at one node: those it has are sent to the edges, not the edges to its task."""
    spark.range(20000).select(F.concat(F.lit("n"), "id").alias("src"), F.lit("e").alias("type"), F.when(F.col("id") % 10 > 0, "hub").otherwise(F.concat(F.lit("m"), F.col("id") % 50)).alias("dst")).createOrReplaceTempView("hub_edges")
    edges, wide = spark.table("hub_edges"), spark.range(500_000).select(F.concat(F.lit("x"), F.sha2(F.col("id").cast("string"), 256)).alias("curie"))
    kept = edges_at(edges, "dst", wide.unionByName(spark.createDataFrame([("hub",), ("m10",)], "curie string")))
    assert kept.count() == 18000 + 400
    assert "BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString() and "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()


def test_edges_of_a_text_are_filtered_before_they_are_joined(spark):
    """All filters on the curies stand right above the tables' scans."""
    for name in ("direct_relations", "comention_pairs"):
        equal_to_sql(spark, name)
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        read = [line for line in plan.splitlines() if "Filter" in line and "l_suppkey" in line]
        assert read and all("SUPP:" in line for line in read)


@pytest.mark.parametrize("name", ["pattern_text_shared_report", "pattern_text_chain", "pattern_text_edges"])
def test_hops_of_a_given_node_narrow_the_others(spark, name):
    equal_to_sql(spark, name)
    plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    # Nothing is made distinct before what is given has cut the rows down.
    for tree in plan.split("Aggregate")[1:]:
        below = tree.split("Relation")[0]
        assert "l_orderkey" not in below or "LeftSemi" in below or "Filter (" in below


def test_a_given_node_narrows_hops_away_from_it(spark):
    """Of mentions only those of reports that can match are stored, although neither of their ends is given."""
    text = """
        MATCH (alert:alert)-[one:mentions]->(place)-[way:isa*0..]->(region:geoloc {curie: 'REGION:2'})
        MATCH (alert)-[two:mentions]->(part)-[of:has_pathogen]->(supplier:pathogen {curie: 'SUPP:3'})
        RETURN DISTINCT alert.curie AS alert, part.curie AS part, supplier.curie AS supplier"""
    graph = S.graph(spark, SMALL)
    (branch,) = pattern_query.Reader(text, {}).branches()
    few = pattern_query.Planner(graph, branch, True).narrowed()
    assert set(few) == {"one", "way", "two", "of"}
    have = lambda hop, column: {r[0] for r in few[hop].select(f"{column}__curie").collect()}
    assert have("one", "place") and have("one", "place") <= have("way", "place") and have("two", "part") <= have("of", "part")
    # The hop that came second has only alerts of the first.
    assert have("one", "alert") <= have("two", "alert") or have("two", "alert") <= have("one", "alert")


@pytest.mark.parametrize("most", [0, 2_000_000])
@pytest.mark.parametrize("name", ["alerts_multi_filter", "alerts_by_symptom"])
def test_each_filter_reads_mentions_of_the_alerts_that_are_left(spark, monkeypatch, name, most):
    """The filter with the fewest nodes comes first; the alerts that it leaves cut down what the next ones store, whether they are sent or shuffled."""
    stored, plain = [], G.materialised
    monkeypatch.setattr(tables, "ROWS_TO_SEND", most, raising=False)
    monkeypatch.setattr(G, "materialised", lambda rows: stored.append(plain(rows)) or stored[-1])
    rows = equal_to_sql(spark, name)
    alerts = [{r.alert for r in t.select("alert").collect()} for t in stored if "alert" in t.columns]
    assert rows and alerts and all(later <= earlier for earlier, later in zip(alerts, alerts[1:], strict=False))
    assert alerts[-1] == {r[0] for r in rows}
    if name == "alerts_multi_filter":
        # What the widest filter, the last, stores are the mentions that the result has, and no others.
        read = [t for t in stored if set(t.columns) == {"alert", "node"}]
        assert len(read) == 3 and {tuple(r) for r in read[-1].select("alert", "node").collect()} == {r[:2] for r in rows}


def test_nodes_of_a_label_are_not_sent_whole(spark, monkeypatch):
    plans, plain = [], G.materialised
    monkeypatch.setattr(G, "materialised", lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or plain(rows))
    G.find_alerts(S.graph(spark, SMALL), geolocation="REGION:2")
    assert plans[0].count("SortMergeJoin") == 1


def test_filters_on_repeated_and_odd_mentions(spark):
    """Mentions, nodes and alerts that come twice, one node for two filters, a filter without nodes."""
    nodes = spark.createDataFrame([("a1", "1", ["alert"], "d1"), ("a1", "1", ["alert"], "d1"), ("a2", "2", ["alert"], "d1"), ("a3", "3", ["alert"], None), ("n", "n", ["disease", "geoloc"], None), ("n", "n", ["disease", "geoloc"], None), ("m", "m", ["disease"], None), ("p", "p", ["geoloc"], None)], "curie string, name string, labels array<string>, timestamp string")
    links = [("a1", "mentions", "m"), ("a1", "mentions", "m"), ("a1", "mentions", "n"), ("a2", "mentions", "m"), ("a3", "mentions", "p"), ("a3", "mentions", "m"), ("absent", "mentions", "m"), ("absent", "mentions", "p"), ("m", "isa", "n"), ("p", "isa", "n"), ("n", "isa", "n")]
    graph = Graph(nodes, spark.createDataFrame(links, "src string, type string, dst string"))
    found = lambda **k: sorted(map(tuple, G.find_alerts(graph, **k).collect()), key=repr)
    assert found(disease="n", geolocation="n") == [("a1", "d1", "m", "n", "n", "n"), ("a1", "d1", "n", "n", "n", "n"), ("a3", None, "m", "n", "p", "n")]
    assert found(disease="n", geolocation="n", timestamp="d1") == [("a1", "d1", "m", "n", "n", "n"), ("a1", "d1", "n", "n", "n", "n")]
    assert found(disease="n") == [("a1", "d1", "m", "n"), ("a1", "d1", "n", "n"), ("a2", "d1", "m", "n"), ("a3", None, "m", "n")]
    assert found(disease="n", pathogen="n") == found(disease="n", timestamp="d9") == []


def test_paths_to_ends_equal_all_paths_that_end_there(spark):
    """On random graphs with cycles, in both directions; dead ends aren't walked."""
    rng = random.Random(5)
    for _ in range(3):
        edges = spark.createDataFrame([(f"n{rng.randrange(7)}", "e", f"n{rng.randrange(7)}") for _ in range(9)], "src string, type string, dst string").distinct()
        seeds, ends = (spark.createDataFrame([(n,) for n in names], "curie string") for names in (["n0", "n1"], ["n3", "n4", "absent"]))
        for backwards in (False, True):
            plain = sorted(map(tuple, paths(edges, seeds, None, backwards=backwards).where("node in ('n3', 'n4')").collect()))
            assert sorted(map(tuple, paths(edges, seeds, None, backwards=backwards, ends=ends).collect())) == plain
    tree = spark.createDataFrame([("r", "e", "a"), ("a", "e", "goal")] + [("r", "e", f"x{i}") for i in range(5)] + [(f"x{i}", "e", "dead") for i in range(5)], "src string, type string, dst string")
    one = lambda n: spark.createDataFrame([(n,)], "curie string")
    assert sorted((r.src, r.dst) for r in useful_edges(tree, one("r"), one("goal")).collect()) == [("a", "goal"), ("r", "a")]
    assert paths(tree, one("goal"), None, ends=one("r")).count() == 0
