"""Readers and writers of alerts, contexts and graph files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom import schema
from fathom.functions.tables import tasks_for
from fathom.functions.text import full_text, parsed_header, sections
from fathom.operators.literature import Postings, postings_of, totals
from fathom.operators.services import last_alerts
from fathom.sources.json_dump import objects
from fathom.sources.text_files import read_files, write_files


def raw_alerts(spark: SparkSession, path: str) -> DataFrame:
    """file, header, body of JSON lists of alerts; one file is read by as many tasks as it has byte ranges."""
    rows = objects(spark, path).select("file", F.from_json("json", schema.RAW_ALERTS).alias("alert"))
    return rows.select("file", F.get("alert.header", F.lit(0)).alias("header"), F.get("alert.body", F.lit(0)).alias("body"))


def alerts(raw: DataFrame) -> DataFrame:
    """archive_number, date, subject, sections, text, file of alerts with an archive number and a date."""
    rows = raw.select("*", parsed_header(F.col("header")).alias("h"), sections(F.col("body")).alias("sections"))
    rows = rows.where(F.col("h.archive_number").isNotNull() & F.col("h.date").isNotNull())
    return rows.select("h.archive_number", "h.date", "h.subject", "sections", full_text(F.col("h.subject"), F.col("sections")).alias("text"), "file")


def contexts(spark: SparkSession, path: str) -> DataFrame:
    """id, sentences of context files; the id is the file's name without its endings."""
    rows = spark.read.schema(schema.CONTEXTS).json(path, multiLine=True)
    name = F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1), r"(\.txt)?\.jsonld$", "")
    return rows.select(name.alias("id"), F.get("documents", F.lit(0))["sentences"].alias("sentences"))


def tsv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.schema(columns).csv(path, sep="\t", header=True, quote='"', escape='"')


def csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Strings lose their quotes."""
    rows = spark.read.schema(columns).csv(path, header=True, quote='"', escape='"')
    return rows.select(*[F.replace(F.col(f"`{f.name}`"), F.lit('"'), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in rows.schema])


def write_tsv(rows: DataFrame, path: str) -> None:
    """Distinct rows in the order of all columns, with a header."""
    names = [f"`{c}`" for c in rows.columns]
    rows.distinct().orderBy(*names).write.mode("overwrite").csv(path, sep="\t", header=True, quote='"', escape='"')


def write_alerts(alerts: DataFrame, path: str) -> None:
    """JSON lines, one per archive number; of a repeated number the last file's alert."""
    last_alerts(alerts).write.mode("overwrite").json(path)


def doc_terms(spark: SparkSession, path: str) -> DataFrame:
    """doc, term, weight of a table of documents' terms: 2 for a major term, else 1."""
    rows = spark.read.schema(schema.DOC_TERMS).csv(path, header=True)
    return rows.select(F.col("pmid").alias("doc"), F.col("mesh_id").alias("term"), (F.col("major") + 1).cast("long").alias("weight"))


def write_matrix(doc_term: DataFrame, types: DataFrame, path: str) -> None:
    """The matrix without repeated entries, dealt by document, and its terms' types."""
    doc_term.groupBy("doc", "term").agg(F.sum("weight").alias("weight")).write.mode("overwrite").parquet(f"{path}/matrix")
    types.select("term", "type").distinct().write.mode("overwrite").parquet(f"{path}/types")


def matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What write_matrix() wrote: doc, term, weight; and term, type."""
    return spark.read.schema("doc long, term string, weight long").parquet(f"{path}/matrix"), spark.read.schema("term string, type string").parquet(f"{path}/types")


def write_postings(doc_term: DataFrame, path: str) -> None:
    """The matrix in the order of terms, then documents, dealt by ranges, so that a reader of few terms skips other files and row groups; with its documents and totals."""
    postings_of(doc_term).write.mode("overwrite").parquet(f"{path}/unordered")
    rows = doc_term.sparkSession.read.schema(schema.POSTINGS).parquet(f"{path}/unordered")
    rows.repartitionByRange(tasks_for(rows), "term", "doc").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/postings")
    rows.select("doc", "size").distinct().repartitionByRange("doc").sortWithinPartitions("doc").write.mode("overwrite").parquet(f"{path}/documents")
    totals(rows).write.mode("overwrite").parquet(f"{path}/totals")


def postings(spark: SparkSession, path: str) -> Postings:
    """What write_postings() wrote."""
    n_docs, n_terms = spark.read.schema("n_docs long, n_terms long").parquet(f"{path}/totals").first()
    return Postings(spark.read.schema(schema.POSTINGS).parquet(f"{path}/postings"), spark.read.schema("doc long, size long").parquet(f"{path}/documents"), n_docs, n_terms)


def write_annotations(mentions: DataFrame, path: str) -> None:
    mentions.write.mode("overwrite").parquet(path)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.MENTIONS).parquet(path)


def write_terms(terms: DataFrame, path: str) -> None:
    """JSON lines of doc and terms; terms_by_alert() makes them."""
    terms.write.mode("overwrite").json(path)


def terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.TERMS).json(path)


def write_stats(counts: DataFrame, path: str) -> None:
    """A TSV file with a header, in the order of the rows: the most frequent first, then by the other columns."""
    names = [f"`{c}`" for c in counts.columns if c != "count"]
    counts.orderBy(F.desc("count"), *names).write.mode("overwrite").csv(path, sep="\t", header=True, quote='"', escape='"', nullValue="")


def write_contexts(contexts: DataFrame, path: str) -> None:
    """JSON lines of id and its sentences."""
    contexts.write.mode("overwrite").json(path)


def write_texts(alerts: DataFrame, path: str) -> None:
    """A text file for each archive number, named by it; of a repeated number the last file's alert."""
    write_files(last_alerts(alerts).select(F.concat("archive_number", F.lit(".txt")).alias("name"), "text"), path)


def write_alert_files(alerts: DataFrame, path: str) -> None:
    """A JSON file for each archive number, named by it; of a repeated number the last file's alert. Dates are text."""
    last = last_alerts(alerts)
    columns = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(f"`{c}`") for c, t in last.dtypes]
    write_files(last.select(F.concat("archive_number", F.lit(".json")).alias("name"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("text")), path)


def named_texts(spark: SparkSession, path: str) -> DataFrame:
    """name, text of a folder's files, each a row; the name is without its ending, and files whose name begins with `_` or `.` are left out."""
    return read_files(spark, path).select(F.regexp_extract("name", r"^(.*?)(\.\w+)?$", 1).alias("name"), "text")


def file_index(alerts: DataFrame) -> DataFrame:
    """archive_number, files: the names of the files that hold an alert, sorted."""
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    return alerts.groupBy("archive_number").agg(F.array_sort(F.collect_set(name)).alias("files"))
