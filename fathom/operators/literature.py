"""Documents ranked by the terms they share with a query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.statistics import fisher_greater
from fathom.functions.tables import tasks_for

#: Types that count as relevant coverage.
RELEVANT = ("geoloc", "disease", "pathogen")


def summed(doc_term: DataFrame) -> DataFrame:
    return doc_term.groupBy("doc", "term").agg(F.sum("weight").alias("weight"))


def threshold(k: int) -> int:
    """Least weight of a document for a query of k terms: one less than their number up to 4, else 3."""
    return k - 1 if k <= 4 else 3


def prefiltered(doc_term: DataFrame, query: list[str]) -> DataFrame:
    """doc, weight of documents whose weights on the query's terms sum to the threshold(). At 0 every document passes."""
    least = threshold(len(query))
    hits = doc_term.where(F.col("term").isin(query)).groupBy("doc").agg(F.sum("weight").alias("weight"))
    if least > 0:
        return hits.where(F.col("weight") >= least)
    return doc_term.select("doc").distinct().join(hits, "doc", "left").select("doc", F.coalesce("weight", F.lit(0)).alias("weight"))


def ranked(doc_term: DataFrame, query: list[str], type_of: Column, limit: int = 20) -> DataFrame:
    """doc, overlap, relevant_coverage, coverage, pval, the best first; type_of is a term's type."""
    known = doc_term.where(F.col("term").isin(query)).select("term").distinct().collect()  # as many rows as the query has terms
    if unknown := set(query) - {r[0] for r in known}:
        raise KeyError(sorted(unknown)[0])
    sums = summed(doc_term)
    passed = prefiltered(sums, query)
    terms = sums.agg(F.countDistinct("term").alias("n"))
    inside = F.col("term").isin(query)
    each = sums.join(passed.select("doc"), "doc", "left_semi").groupBy("doc").agg(
        F.count("*").alias("size"),
        F.count(F.when(inside, 1)).alias("overlap"),
        F.countDistinct(F.when(inside & type_of.isin(*RELEVANT), type_of)).alias("relevant_coverage"),
        F.countDistinct(F.when(inside, type_of)).alias("coverage"),
    )
    tested = each.join(F.broadcast(terms)).withColumn("pval", fisher_greater(F.col("overlap"), F.lit(len(query)), F.col("size"), F.col("n")))
    return tested.orderBy(F.desc("relevant_coverage"), F.desc("coverage"), F.round("pval", 9), "doc").limit(limit).select("doc", "overlap", "relevant_coverage", "coverage", "pval")


@dataclass(frozen=True)
class Postings:
    """A stored matrix in the order of its terms: rows (term, doc, weight, size), size being the document's number of terms; documents (doc, size); and both totals."""

    rows: DataFrame
    documents: DataFrame
    n_docs: int
    n_terms: int


def postings_of(doc_term: DataFrame) -> DataFrame:
    """term, doc, weight, size of doc, term, weight with repeated entries; one shuffle, by document, into as many tasks as the entries need."""
    sums = doc_term.repartition(tasks_for(doc_term), "doc").groupBy("doc", "term").agg(F.sum("weight").alias("weight"))
    return sums.select("term", "doc", "weight", F.count("*").over(Window.partitionBy("doc")).alias("size"))


def ranked_by_postings(postings: Postings, query: list[str], type_of: Column, limit: int = 20) -> DataFrame:
    """ranked() from a stored matrix, with overlap_ids (sorted) and overlap_counts (a map by type) of each document.

    Only the query's terms are read, since the file's order lets the filter
    skip all others, and each posting brings its document's size; nothing is
    joined with the matrix. Documents without any of the terms, which a query
    of one term lets pass, come last, so only the first of them are looked for.
    """
    query = sorted(set(query))
    hits = postings.rows.where(F.col("term").isin(query))
    if unknown := set(query) - {r[0] for r in hits.select("term").distinct().collect()}:  # as many rows as the query has terms
        raise KeyError(sorted(unknown)[0])
    least = threshold(len(query))
    kind = F.struct(type_of.alias("type"), "term")
    each = hits.groupBy("doc").agg(F.sum("weight").alias("weight"), F.max("size").alias("size"), F.count("*").alias("overlap"), F.array_sort(F.collect_list(kind)).alias("found")).where(F.col("weight") >= least)
    types = F.array_distinct(F.array_compact(F.transform("found", lambda x: x["type"])))
    each = each.select("doc", "size", "overlap", "found", F.size(F.array_intersect(types, F.array(*map(F.lit, RELEVANT)))).cast("long").alias("relevant_coverage"), F.size(types).cast("long").alias("coverage"))
    tested = each.withColumn("pval", fisher_greater(F.col("overlap"), F.lit(len(query)), F.col("size"), F.lit(postings.n_terms)))
    order = [F.desc("relevant_coverage"), F.desc("coverage"), F.round("pval", 9), F.col("doc")]
    best = tested.orderBy(*order).limit(limit)
    if least <= 0:
        none = F.array().cast(tested.schema["found"].dataType)
        others = postings.documents.join(hits.select("doc").distinct(), "doc", "left_anti").orderBy("doc").limit(limit)
        zero = F.lit(0).cast("long")
        best = best.unionByName(others.select("doc", "size", zero.alias("overlap"), none.alias("found"), zero.alias("relevant_coverage"), zero.alias("coverage"), F.lit(1.0).alias("pval"))).orderBy(*order).limit(limit)
    counts = F.transform(F.array_distinct(F.array_compact(F.transform("found", lambda x: x["type"]))), lambda t: F.struct(t, F.size(F.filter("found", lambda x: x["type"] == t)).cast("long")))
    ids = F.array_sort(F.transform("found", lambda x: x["term"]))
    return best.select("doc", "overlap", "relevant_coverage", "coverage", "pval", ids.alias("overlap_ids"), F.map_from_entries(counts).alias("overlap_counts"))


def totals(doc_term: DataFrame) -> DataFrame:
    """n_docs, n_terms: different documents and terms."""
    return doc_term.agg(F.countDistinct("doc").alias("n_docs"), F.countDistinct("term").alias("n_terms"))


def with_type_counts(ranked_rows: DataFrame, doc_term: DataFrame, query: list[str], type_of: Column) -> DataFrame:
    """ranked rows with overlap_ids, the query's terms that a document has, sorted, and overlap_counts, how many there are of each type, as a map."""
    chosen = doc_term.where(F.col("term").isin(query)).join(F.broadcast(ranked_rows.select("doc")), "doc", "left_semi").select("doc", "term").distinct()
    each = chosen.groupBy("doc", type_of.alias("type")).agg(F.count("*").alias("n"), F.collect_list("term").alias("ids"))
    counts = each.groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("overlap_counts"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("overlap_ids"))
    rows = ranked_rows.join(counts, "doc", "left").withColumn("overlap_ids", F.coalesce("overlap_ids", F.array().cast("array<string>")))
    return rows.withColumn("overlap_counts", F.coalesce("overlap_counts", F.create_map().cast("map<string,bigint>"))).orderBy(F.desc("relevant_coverage"), F.desc("coverage"), F.round("pval", 9), "doc")


def find_literature(doc_term: DataFrame, terms: str, type_of: Column, prefix: str = "", limit: int = 20) -> DataFrame:
    """ranked() for a comma list of term ids or curies, whose leading characters in prefix are cut off; an unknown id raises KeyError."""
    names = [t.strip().lstrip(prefix) for t in terms.split(",") if t.strip()]
    return with_type_counts(ranked(doc_term, names, type_of, limit), doc_term, names, type_of)
