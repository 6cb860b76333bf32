"""Schemas of nodes, edges and inputs; declared, so that ids such as archive numbers stay strings."""

from __future__ import annotations

NODES = "curie string, name string, labels array<string>, timestamp string"
EDGES = "src string, type string, dst string, years_data map<string,double>"
RAW_ALERTS = "header array<string>, body array<string>"
OUTBREAKS = "ID string, outbreakName string, archiveNumber string, datePublished string"
DOC_TERMS = "mesh_id string, major int, pmid long"
POSTINGS = "term string, doc long, weight long, size long"
CONTEXTS = "documents array<struct<sentences:array<struct<timexes:array<struct<text:string,intervals:array<map<string,string>>>>,geolocs:array<struct<text:string,geoID:string>>>>>>"
EDGE_TSV = "`:START_ID` string, `:TYPE` string, `:END_ID` string"
NODE_TSV = "`curie:ID` string, `name:string` string, `:LABEL` string"
MENTIONS = "doc string, surface string, start int, db string, id string, name string"
TERMS = "doc string, terms array<struct<db:string,id:string,name:string>>"

#: The test tables that the graph is made of: with a declared schema a plan needs no look into files.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}
