"""The test tables as a property graph: places, diseases, pathogens, alerts, outbreaks and indicators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom import schema
from fathom.operators.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = spark.read.schema(schema.TABLES[name]) if name in schema.TABLES else spark.read
    return read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Unions by label and type; a filter on either leaves only the tables that it needs."""
    t = lambda name: table(spark, sf_dir, name)

    def node(rows: DataFrame, curie: Column, name: Column, labels: str, timestamp: Column | None = None) -> DataFrame:
        return rows.select(curie.alias("curie"), name.cast("string").alias("name"), F.split(F.lit(labels), ";").alias("labels"), (F.lit(None) if timestamp is None else timestamp).cast("string").alias("timestamp"))

    def edge(rows: DataFrame, src: Column, kind: str, dst: Column) -> DataFrame:
        return rows.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"), F.lit(None).cast("map<string,double>").alias("years_data"))

    one = spark.range(1)
    part, supplier, customer, orders, lineitem = (t(n) for n in ("part", "supplier", "customer", "orders", "lineitem"))
    disease, pathogen, place = "disease;entity", "pathogen;entity", "geoloc;entity"
    nodes = [
        node(one, F.lit("GEO:world"), F.lit("world"), place),
        node(t("region"), key("REGION:", "r_regionkey"), F.col("r_name"), place),
        node(t("nation"), key("NATION:", "n_nationkey"), F.col("n_name"), place),
        node(customer, key("CUST:", "c_custkey"), F.col("c_name"), "geoloc"),
        node(one, F.lit("DIS:root"), F.lit("root"), disease),
        node(part.select("p_brand").distinct(), key("BRAND:", "p_brand"), F.col("p_brand"), disease),
        node(part.select("p_type").distinct(), key("TYPE:", "p_type"), F.col("p_type"), disease),
        node(part, key("PART:", "p_partkey"), F.col("p_name"), disease),
        node(part.select("p_size").distinct(), key("SIZE:", "p_size"), key("size ", "p_size"), disease),
        node(supplier.select("s_nationkey").distinct(), key("PGRP:", "s_nationkey"), key("group ", "s_nationkey"), pathogen),
        node(supplier, key("SUPP:", "s_suppkey"), F.col("s_name"), pathogen),
        node(orders, key("ORD:", "o_orderkey"), F.col("o_orderkey"), "alert", F.date_format("o_orderdate", "yyyy-MM-dd")),
        node(customer, key("OUT:", "c_custkey"), F.col("c_name"), "outbreak"),
        node(part.select("p_type").distinct(), key("wdi:", "p_type"), F.concat(F.lit("revenue of "), F.col("p_type")), "indicator"),
    ]
    edges = [
        edge(customer, key("CUST:", "c_custkey"), "isa", key("NATION:", "c_nationkey")),
        edge(t("nation"), key("NATION:", "n_nationkey"), "isa", key("REGION:", "n_regionkey")),
        edge(t("region"), key("REGION:", "r_regionkey"), "isa", F.lit("GEO:world")),
        edge(part, key("PART:", "p_partkey"), "isa", key("BRAND:", "p_brand")),
        edge(part, key("PART:", "p_partkey"), "isa", key("TYPE:", "p_type")),
        edge(part.select("p_brand").distinct(), key("BRAND:", "p_brand"), "isa", F.lit("DIS:root")),
        edge(part.select("p_type").distinct(), key("TYPE:", "p_type"), "isa", F.lit("DIS:root")),
        edge(supplier, key("SUPP:", "s_suppkey"), "isa", key("PGRP:", "s_nationkey")),
        edge(lineitem.select("l_orderkey", "l_partkey").distinct(), key("ORD:", "l_orderkey"), "mentions", key("PART:", "l_partkey")),
        edge(lineitem.select("l_orderkey", "l_suppkey").distinct(), key("ORD:", "l_orderkey"), "mentions", key("SUPP:", "l_suppkey")),
        edge(orders, key("ORD:", "o_orderkey"), "mentions", key("CUST:", "o_custkey")),
        edge(lineitem.select("l_partkey", "l_suppkey").distinct(), key("PART:", "l_partkey"), "has_pathogen", key("SUPP:", "l_suppkey")),
        edge(part, key("PART:", "p_partkey"), "has_phenotype", key("SIZE:", "p_size")),
        edge(orders, key("ORD:", "o_orderkey"), "has_outbreak", key("OUT:", "o_custkey")),
        indicators(spark, sf_dir).select("src", F.lit("has_indicator").alias("type"), "dst", "years_data"),
    ]
    return Graph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges))


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation, p_type, year, value: extended price by nation of the customer, part type and year of shipping."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("c_nationkey").alias("nation"), "p_type", F.year("l_shipdate").cast("string").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")), 3).cast("double").alias("value"))


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = revenue(spark, sf_dir).groupBy("nation", "p_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "value")))).alias("years_data"))
    return folded.select(key("NATION:", "nation").alias("src"), key("wdi:", "p_type").alias("dst"), "years_data")


def doc_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, term, weight with repeated rows: orders and the brands of their parts."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("doc"), F.col("p_brand").alias("term"), (1 + (F.col("l_linestatus") == "O").cast("long")).alias("weight"))


def brand_type() -> Column:
    """The type of a brand by its number."""
    number = F.regexp_extract("term", r"(\d+)$", 1).cast("long")
    return F.element_at(F.array(F.lit("disease"), F.lit("geoloc"), F.lit("pathogen"), F.lit("other")), (number % 4 + 1).cast("int"))


#: A small dictionary: entry, db, id, name.
DICTIONARY = [
    ("the", "MESH", "D01", "The"), ("the", "geonames", "g1", "The Place"), ("of the", "MESH", "D02", "Of the"), ("and", "geonames", "g2", "And"),
    ("der", "MESH", "D03", "Der"), ("de la", "MESH", "D04", "De la"), ("la", "geonames", "g3", "La"), ("que", "other", "o1", "Que"), ("apache license", "MESH", "D05", "Disease"),
]


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DICTIONARY, "entry string, db string, id string, name string")


def alert_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, header, body: alerts written around the documents' texts; every third lacks its end, every seventh its archive number."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    date = F.date_format(F.date_add(F.lit("2016-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")), "yyyy-MM-dd")
    number = F.concat(F.replace(date, F.lit("-"), F.lit("")), F.lit("."), F.col("doc_id").cast("string"))
    header = F.concat(F.lit("Published Date: "), date, F.lit(" 07:03:21 CET\nSubject: PRO/"), F.col("source"), F.lit(" news\nArchive Number: "), F.when(F.col("doc_id") % 7 != 0, number).otherwise(""))
    body = F.concat(F.lit("intro\nTitle "), F.col("source"), F.lit("\n------\n"), F.col("text"), F.lit("\n"), F.when(F.col("doc_id") % 3 != 0, "--\nSecond\n******\nend of it\n--").otherwise("never closed"))
    return rows.select(F.col("doc_id").alias("id"), header.alias("header"), body.alias("body"))
