"""What the training-data operators share: reading, scratch tables, word counting."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.tables import shared_folder as scratch_dir

#: ASCII white space, the only separators of words here.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Java regex of a word; possessive, so that long words need no backtracking.
WORD = r"[^\x20\x09-\x0D]++"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, *columns: str) -> DataFrame:
    """df written to a table in the shared folder and read again.

    Cuts the lineage: what follows survives lost executors without
    recomputing what came before. drop_stored() deletes such a table early.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/fathom-{uuid.uuid4().hex}"
    (df.select(*columns) if columns else df).write.parquet(path)
    out = spark.read.schema(df.select(*columns).schema if columns else df.schema).parquet(path)
    out._fathom_path = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._fathom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def n_words(text: Column) -> Column:
    """Number of words (runs without ASCII white space); null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: the optimizer would put a column's expression into each lambda that names it, to be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def batches(spark: SparkSession) -> None:
    """Rows of an Arrow batch at most; bytes are bounded too, so that long texts don't pile up.

    All operators set the same values: a lazy plan takes those that hold when it runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


@contextmanager
def held(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings, with `_` for `.`, for what is run inside; for jobs that end inside only. Those before come back."""
    names = {k: k.replace("_", ".") for k in settings}
    before = {k: spark.conf.get(name) for k, name in names.items()}
    try:
        for k, name in names.items():
            spark.conf.set(name, settings[k])
        yield
    finally:
        for k, name in names.items():
            spark.conf.set(name, before[k])


#: Rows of an Arrow batch of a job whose rows are short and of fixed width.
SHORT_ROWS = "8192"


#: A key with more than this share of all rows is hot: there are at most as many hot keys as its inverse.
HOT_SHARE = 1 / 1000


def spread_join(rows: DataFrame, right: DataFrame, key: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with right (one row per key, with the key's number of rows as _n) so that no key fills a task.

    Hot keys, 1000 at most whatever the data, are broadcast; the others meet
    in an ordinary join. how is inner, left or left_semi; keys aren't null, _n
    goes. right is a stored table, since it is read several times.
    """
    limit = max(1.0, total * HOT_SHARE)
    hot = right.where(F.col("_n") > limit)
    if hot.isEmpty():
        return rows.join(right.drop("_n"), key, how)
    keys = F.broadcast(hot.select(*key))
    few = rows.join(keys, key, "left_anti").join(right.where(F.col("_n") <= limit).drop("_n"), key, how)
    many = rows.join(keys, key, "left_semi") if how == "left_semi" else rows.join(F.broadcast(hot.drop("_n")), key, "inner")
    return few.unionByName(many.select(*few.columns))


def running(rows: DataFrame, order: list, *, total: str, name: str) -> DataFrame:
    """rows with name: the sum of the column total over all rows before, in the order of unique keys.

    Rows are dealt by ranges of the order and stored; each range is summed on
    its own and shifted by the sums of the ranges before it, of which there
    are as many as partitions. drop_stored() takes what is returned.
    """
    dealt = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ranges = dealt.groupBy("_range").agg(F.sum(total).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranges.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn(name, F.coalesce(F.sum(total).over(within), F.lit(0))).join(F.broadcast(shifts), "_range")
    out = out.withColumn(name, F.col(name) + F.col("_shift")).drop("_range", "_shift")
    out._fathom_path = dealt._fathom_path
    return out
