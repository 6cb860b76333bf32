"""Mixing sources to target weights by entropy balancing.

Of all document rates r whose tokens meet each source's target, the ones
nearest to 1 in relative entropy are r = exp(lambda * size), cut off at
MOST copies. The dual in one lambda per source is convex; safeguarded Newton
steps solve it on a table of the counts of documents by source and size, which
grows with the number of different sizes and not with the documents. Rates
are then rounded into whole copies so that each source's sum stays near its
target: systematically in the order of size, then by correcting the remainder
with ever smaller documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm._common import drop_stored, n_words, running, stored, table

#: Copies of a document at most; a source's target is bounded by as many times its size.
MOST = 3
#: Weights of the sources in order, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: Parts into which the documents of a source and size are dealt, so that a common size isn't ranked in one task.
PARTS = 1024
#: Newton steps at most; a step outside the bracket becomes a bisection, so that they converge long before. A mix that doesn't raises.
STEPS = 200
#: Tokens by which the fractional mix may miss a target, as a share of it; and rounds that correct the rounding.
NEAR, CORRECTIONS = 1e-6, 4


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """_source, _source_size, _target from _source, _source_size: one row per source.

    Sources in the order of their code points, null last, take the weights in
    turn. All tokens are shared by weight; what goes beyond MOST times a
    source's size is shared among the others by weight, until none is above.
    Sources without tokens get 0. Sources may be as many as documents: they
    are numbered by ranges, and the level that a unit of weight gets is found
    by sums over all sources, one for each round of resharing.
    """
    numbered = running(totals.select("_source", "_source_size", F.lit(1).alias("_one")), [F.col("_source").asc_nulls_last()], total="_one", name="_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_place"), F.lit(len(weights))) + 1).cast("int"))
    rows = stored(numbered.select("_source", "_source_size", weight.alias("_weight"), (F.lit(MOST) * F.col("_source_size")).alias("_cap")))
    drop_stored(numbered)
    level, n_full = 0.0, -1
    while True:
        full = F.col("_cap") < F.lit(level) * F.col("_weight")
        # Sums of whole numbers and decimals don't depend on their order.
        caps, open_, n, size = rows.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_weight").cast("decimal(28,9)"))), F.count(F.when(full, 1)), F.sum("_source_size")).first()
        if n == n_full or not open_:
            break
        level, n_full = ((size or 0) - (caps or 0)) / float(open_), n
    share = F.lit(level) * F.col("_weight") if open_ else F.col("_cap")
    return rows.select("_source", "_source_size", F.least(F.col("_cap").cast("double"), share.cast("double")).alias("_target"))


def _rate() -> Column:
    """A cell's rate under its source's _lambda; null stands for an unbounded one."""
    tilt = F.least(F.col("_lambda") * F.col("_size") / F.col("_scale"), F.lit(math.log(MOST)))
    return F.when(F.col("_lambda").isNull(), F.lit(float(MOST))).otherwise(F.exp(tilt))


def _solved(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """_source, _lambda, _scale: the dual solution. Each Newton step is one aggregate over the cells; sums are of decimals, which come out alike in any order, so that reruns take the same steps."""
    exact = lambda x: F.sum(x.cast("decimal(38,6)")).cast("double")
    scale = cells.groupBy(F.col("_source").alias("_key")).agg((exact(F.col("_n") * F.col("_size") * F.col("_size").cast("double")) / F.greatest(F.sum(F.col("_n") * F.col("_size")), F.lit(1))).alias("_scale"))
    full = F.col("_target") >= MOST * F.col("_source_size") * (1 - 1e-12)
    state = wanted.join(scale, F.col("_source").eqNullSafe(F.col("_key")))
    state = state.select("_source", "_target", F.greatest("_scale", F.lit(1.0)).alias("_scale"), F.when(~full, F.lit(0.0)).alias("_lambda"), F.lit(None).cast("double").alias("_low"), F.lit(None).cast("double").alias("_high"), full.alias("_done"))
    state = stored(state)
    for _ in range(STEPS):
        if state.where(~F.col("_done")).isEmpty():
            return state
        s = state.where(~F.col("_done")).select(F.col("_source").alias("_key"), "_lambda", "_scale")
        rated = cells.join(s, F.col("_source").eqNullSafe(F.col("_key"))).withColumn("_r", _rate())
        tokens = F.col("_n") * F.col("_size")
        free = F.col("_lambda") * F.col("_size") / F.col("_scale") < math.log(MOST)
        sums = rated.groupBy("_key").agg(exact(tokens * F.col("_r")).alias("_got"), exact(F.when(free, tokens * F.col("_size") / F.col("_scale") * F.col("_r")).otherwise(0.0)).alias("_slope"))
        off = F.col("_got") - F.col("_target")
        met = F.abs(off) <= F.lit(NEAR) * F.col("_target")
        low = F.when(off < 0, F.col("_lambda")).otherwise(F.col("_low"))
        high = F.when(off > 0, F.col("_lambda")).otherwise(F.col("_high"))
        step = state.join(sums, F.col("_source").eqNullSafe(F.col("_key")), "left").withColumn("_new_low", low).withColumn("_new_high", high)
        newton = F.col("_lambda") - F.when(F.col("_slope") > 0, off / F.col("_slope"))
        inside = newton.isNotNull() & ((newton > F.col("_new_low")) | F.col("_new_low").isNull()) & ((newton < F.col("_new_high")) | F.col("_new_high").isNull())
        reach = F.when(F.col("_new_high").isNull(), F.col("_new_low") + F.greatest(F.lit(1.0), F.abs("_new_low"))).when(F.col("_new_low").isNull(), F.col("_new_high") - F.greatest(F.lit(1.0), F.abs("_new_high"))).otherwise((F.col("_new_low") + F.col("_new_high")) / 2)
        done = F.col("_done") | met
        following = F.when(done, F.col("_lambda")).when(inside, newton).otherwise(reach)
        new = stored(step.select("_source", "_target", "_scale", following.alias("_lambda"), F.col("_new_low").alias("_low"), F.col("_new_high").alias("_high"), done.alias("_done")))
        drop_stored(state)
        state = new
    raise ArithmeticError(f"no mix within {NEAR} of the targets after {STEPS} steps")


def _rounded(cells: DataFrame) -> DataFrame:
    """cells with _copies, the copies of all documents of a cell together, for _n documents of _rate each.

    Extra copies are given out systematically in the order of size, so that
    the tokens given differ from the fractional ones by about half the largest
    document of the source; then what is missing or too much is given or
    taken, the largest size that fits it first, and last one document that
    goes past the target if that leaves less.
    """
    whole = F.floor("_rate")
    extra = F.col("_n") * (F.col("_rate") - whole)
    order = Window.partitionBy("_source").orderBy(F.desc("_size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum(extra).over(order)
    given = F.floor(upto + 0.5) - F.floor(upto - extra + 0.5)
    current = stored(cells.withColumn("_copies", F.least(F.col("_n") * MOST, F.col("_n") * whole + F.greatest(given, F.lit(0)))))
    for past in (*[False] * CORRECTIONS, True):
        left = current.groupBy("_source").agg((F.first("_target") - F.sum(F.col("_copies") * F.col("_size"))).alias("_left")).select(F.col("_source").alias("_key"), "_left")
        open_ = current.join(left, F.col("_source").eqNullSafe(F.col("_key")))
        room = F.when(F.col("_left") > 0, F.col("_n") * MOST - F.col("_copies")).otherwise(F.col("_copies"))
        times = F.least(room, F.floor(F.abs("_left") / F.greatest("_size", F.lit(1)))).cast("long")
        if past:  # one more document, if it goes past the target by less than what is off now
            times = F.when((room > 0) & (F.col("_size") < 2 * F.abs("_left")), F.lit(1)).otherwise(F.lit(0)).cast("long")
        usable = F.when((F.col("_size") > 0) & (times > 0), F.col("_size"))
        # What is off then is below the sizes that can be moved, save after many rounds, so the smallest comes nearest.
        best = open_.groupBy("_key").agg((F.min if past else F.max)(usable).alias("_best"), F.first("_left").alias("_left"))
        moved = current.join(best, F.col("_source").eqNullSafe(F.col("_key")), "left").withColumn("_copies", F.col("_copies") + F.when(F.col("_size") == F.col("_best"), F.signum("_left").cast("long") * times).otherwise(F.lit(0)))
        new = stored(moved.select(*current.columns))
        drop_stored(current)
        current = new
    return current


def copies(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """rows with _source_size, _target and _copies (0 to MOST) added.

    rows have _id, _source and _size and whatever else. The same rows give the
    same copies in any order; among documents of a source and size those with
    the smallest hashes of _id get the extra copies, and rows that agree in
    these three are alike. Documents without words keep one copy.
    """
    # A source's name that is never null, so that the join deals rows out as the rank needs them and they move once.
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(PARTS))).withColumn("_name", F.coalesce(F.concat(F.lit("="), "_source"), F.lit("")))
    parts = stored(dealt.groupBy("_source", "_size", "_part").agg(F.count("*").alias("_n")))
    cells = stored(parts.groupBy("_source", "_size").agg(F.sum("_n").alias("_n")))
    wanted = stored(targets(cells.groupBy("_source").agg(F.sum(F.col("_n") * F.col("_size")).alias("_source_size")), weights))
    dual = _solved(cells, wanted)
    # Rounded, since sums of doubles in another order differ in their last digits.
    s = dual.join(wanted.select(F.col("_source").alias("_key"), "_source_size"), F.col("_source").eqNullSafe(F.col("_key"))).select(F.col("_source").alias("_key"), F.round("_lambda", 9).alias("_lambda"), "_scale", "_target", "_source_size")
    rated = cells.join(s, F.col("_source").eqNullSafe(F.col("_key"))).select("_source", "_size", "_n", "_target", "_source_size", F.when(F.col("_size") == 0, 1.0).otherwise(_rate()).alias("_rate"))
    settled = _rounded(rated)
    # A cell's copies go to its parts in proportion, then to the documents of a part.
    each = F.floor(F.col("_copies") / F.col("_cell"))
    over = F.col("_copies") - each * F.col("_cell")
    order = Window.partitionBy("_source", "_size").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cell = settled.select(F.col("_source").alias("_key"), F.col("_size").alias("_key_size"), F.col("_n").alias("_cell"), "_copies", "_target", "_source_size")
    shared = parts.join(cell, F.col("_source").eqNullSafe(F.col("_key")) & (F.col("_size") == F.col("_key_size"))).withColumn("_upto", F.sum("_n").over(order))
    share = (F.floor(over * F.col("_upto") / F.col("_cell")) - F.floor(over * (F.col("_upto") - F.col("_n")) / F.col("_cell"))).alias("_extra")
    plan = stored(shared.select(F.coalesce(F.concat(F.lit("="), "_key"), F.lit("")).alias("_name"), "_size", "_part", each.alias("_each"), share, "_target", "_source_size"))
    drop_stored(parts, cells, wanted, dual, settled)
    joined = dealt.join(plan.hint("merge"), ["_name", "_size", "_part"])
    rank = F.row_number().over(Window.partitionBy("_name", "_size", "_part").orderBy(F.xxhash64("_id", F.lit(1)), "_id"))
    return joined.withColumn("_copies", (F.col("_each") + (rank <= F.col("_extra")).cast("long"))).drop("_name", "_each", "_extra", "_part")


def mixed(documents: DataFrame) -> DataFrame:
    """documents with each row repeated by its copies, none if it has no copy. Its columns, of any name, stay.

    Null and empty texts have no words and keep one copy; null sources are one
    source; repeated rows take part each on their own.
    """
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), n_words(F.col("text")).alias("_size"))
    repeated = copies(rows).where(F.col("_copies") > 0).select(F.explode(F.array_repeat("_row", F.col("_copies").cast("int"))).alias("_row"))
    return repeated.select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: what the mix takes of every document; null sources and texts and repeated rows take part like others."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), n_words(F.col("text")).alias("_size"))
    rows = stored(rows)
    taken = copies(rows)
    return taken.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def shared_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL expresses too, and whether what the mix takes is a number of copies and near its source's target."""
    rows = query(spark, sf_dir)
    near = rows.groupBy(F.col("source_size").alias("_s"), F.col("target").alias("_t")).agg((F.abs(F.sum("taken") - F.first("target")) <= F.greatest(F.lit(0.05) * F.first("target"), F.lit(50.0))).alias("near"))
    rows = rows.join(near, (F.col("source_size") == F.col("_s")) & (F.col("target") == F.col("_t")))
    copies = (F.col("taken") <= MOST * F.col("size")) & ((F.col("size") == 0) | (F.col("taken") % F.greatest("size", F.lit(1)) == 0))
    return rows.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), copies.alias("copies"), "near")


SHARED_ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS MATERIALIZED (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source
), r AS (
  SELECT 0 AS round, (SELECT CAST(sum(source_size) AS DOUBLE) / sum(weight) FROM s) AS level
  UNION ALL
  SELECT round + 1, (SELECT (sum(source_size) - coalesce(sum(3 * source_size) FILTER (WHERE 3 * source_size < level * weight), 0)) / sum(weight) FILTER (WHERE 3 * source_size >= level * weight) FROM s) FROM r WHERE round < 40
), l AS (
  SELECT max(level) AS level FROM r
)
SELECT d.doc_id, d.size, s.source_size, round(least(3.0 * s.source_size, l.level * s.weight), 3) AS target, true AS copies, true AS near
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, l
"""
