"""Large JSON dumps read by many tasks: the objects of a list, found by running counts of quotes and braces.

A JSON list is one value, which Spark's own reader takes in one task. Here a
file is cut at every `}` instead, by Spark's text reader, whose tasks take byte
ranges of one file. A piece says how many quotes it has, and how many braces it
opens if it begins outside a string, or inside of one. Sums of quotes over the
pieces before tell which of the two holds; sums of braces tell the depth; an
object ends where the depth comes back to nothing, and pieces between two ends
are one object. Sums are taken within a byte range first and shifted by those of
the ranges before it, so that no task needs more than one range, and only
numbers are sorted; the pieces themselves are shuffled once, by object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.tables import materialised

RANGE = ("file", "block")


def _before(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with name: the sum of a column over all earlier pieces of the file."""
    sums = rows.groupBy(*RANGE).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(*RANGE, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*RANGE).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(shifts, list(RANGE)).withColumn(name, F.col(name) + F.col("_shift")).drop("_shift")


def _opened(text: Column) -> Column:
    """Braces that a text opens outside its strings, of which the last may be open."""
    return F.regexp_count(F.regexp_replace(text, '"[^"]*+"?', ""), F.lit(r"\{"))


def objects(spark: SparkSession, path: str) -> DataFrame:
    """file, place, json: each outermost object of JSON files, as text, numbered in its file from 0.

    A file may be a list of objects, one object, or objects one after the
    other, with or without commas and line ends between them; what else stands
    there is left out, and so is an object that has no end. Objects of any
    depth, and braces and escaped quotes in strings, are read as JSON reads
    them. Objects must fit an executor, files needn't.
    """
    read = spark.read.text(path, lineSep="}")
    # A backslash never escapes a brace, so a piece begins outside of escapes.
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("piece"),
        "value",
        (F.octet_length("value") + 1).cast("long").alias("bytes"),
        F.col("_metadata.file_size").alias("size"),
        F.regexp_count(bare, F.lit('"')).alias("quotes"),
        _opened(bare).alias("outside"),
        _opened(F.concat(F.lit('"'), bare)).alias("inside"),
    )
    pieces = materialised(pieces)
    # A file's last piece has no brace behind it if all pieces with their braces are a byte more than the file, of which a mark of three bytes at the start isn't read.
    last = pieces.groupBy("file").agg(F.max(F.struct("block", "piece")).alias("last"), (F.sum("bytes") - F.max("size")).alias("more")).where("more IN (1, -2)")
    last = last.select("file", "last.*", F.lit(True).alias("bare"))
    known = pieces.select(*RANGE, "piece", "quotes", "outside", "inside").join(last, [*RANGE, "piece"], "left")
    known = _before(known, "quotes", "quotes_before")
    within = F.col("quotes_before") % 2 == 1
    closes = ((F.col("quotes_before") + F.col("quotes")) % 2 == 0) & F.col("bare").isNull()
    known = known.select(*RANGE, "piece", F.when(within, F.col("inside")).otherwise(F.col("outside")).alias("opens"), closes.alias("closes"))
    known = _before(known.withColumn("net", F.col("opens") - F.col("closes").cast("int")), "net", "depth")
    known = known.withColumn("ends", (F.col("closes") & (F.col("depth") + F.col("net") == 0)).cast("int"))
    known = _before(known, "ends", "place").select(*RANGE, "piece", "place", "ends")
    whole = pieces.select(*RANGE, "piece", "value").join(known, [*RANGE, "piece"]).groupBy("file", "place")
    whole = whole.agg(F.array_sort(F.collect_list(F.struct("block", "piece", "value"))).alias("parts"), F.max("ends").alias("ended")).where("ended = 1")
    text = F.concat(F.array_join(F.col("parts.value"), "}"), F.lit("}"))
    return whole.select("file", "place", F.regexp_replace(text, r"^[^{]*+", "").alias("json"))
