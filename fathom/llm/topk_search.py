"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets, and large buckets are dealt by a
hash of the id into blocks of bounded size. A first pass over the blocks of
the longest vectors gives every query a k-th best product. A second pass turns
that product, divided by the query's length and the block's greatest length,
into a local cosine threshold per query and block:

* above 1 no vector of the block can enter the result: the block is skipped.
  Queries are grouped by that product over their length, and a group meets
  only the blocks whose lengths reach it, so that skipped pairs are never sent;
* from COORDINATE_FROM on, vectors whose largest query coordinates lie outside
  the interval that the threshold allows are dropped (coordinate pruning);
* below it, vectors too short to reach the k-th best are dropped (length
  pruning).

Whatever is left is verified by its integer product, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm._common import batches, stored, table

#: Local cosine threshold from which coordinates prune better than lengths.
COORDINATE_FROM = 0.7
#: Coordinates that a query checks in coordinate pruning.
FOCUS = 4
#: Guards pruning, done in floating point, against rounding.
SLACK = 1e-9
#: Products below this are exact in double precision.
EXACT = 2.0**53


#: Components of all vectors of a block, and of all queries that meet it together.
BLOCK_SIZE, QUERY_SIZE = 2**18, 2**20


def quantized(x: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, computed in double precision. A component beyond 64 bits raises when the row is read: its products couldn't be told."""

    def one(v: Column) -> Column:
        x = v.cast("double")
        y = F.lit(float(scale)) * x
        # What isn't finite gives null here, wherever the optimizer puts the filter that drops it.
        return F.when(F.abs(y) < 2.0**63, F.floor(y).cast("long")).when(F.abs(x) < float("inf"), F.raise_error(F.lit("a component doesn't fit 64 bits")).cast("long"))

    return F.transform(x, one)


def usable(x: Column) -> Column:
    """True for vectors without nulls, NaN and infinities."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & ~bad, F.lit(False))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """The vectors as rows, shorter ones filled up with 0."""
    if (column.str.len() == width).all():
        return np.array(column.tolist(), dtype=np.int64).reshape(len(column), width)
    out = np.zeros((len(column), width), dtype=np.int64)
    for row, v in zip(out, column, strict=True):
        row[: len(v)] = v
    return out


def _greatest(a: np.ndarray) -> float:
    return max(float(a.max(initial=0)), -float(a.min(initial=0)))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of all rows of a and b: by doubles or 64-bit integers where these are exact, else by whole numbers of any size."""
    bound = _greatest(a) * _greatest(b) * max(1, a.shape[1])
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return a @ b.T
    return a.astype(object) @ b.T.astype(object)


def search_block(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, vector ids, products) of each query's best in one block; floors holds what a product must reach (NaN: nothing is known)."""
    q_len, c_len = np.sqrt((q.astype(np.float64) ** 2).sum(1)), np.sqrt((c.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-c_len, kind="stable")
    c_ids, c, c_len = c_ids[order], c[order], c_len[order]
    longest = c_len[0] if len(c_len) else 0.0
    reach = q_len * longest
    known = ~np.isnan(floors)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(reach > 0, floors / reach, np.where(floors > 0, np.inf, -np.inf))
    local = np.where(known, local, -np.inf)
    live = local <= 1 + SLACK
    by_coordinate = live & (local >= COORDINATE_FROM)
    unit = c / np.maximum(c_len, 1e-300)[:, None] if by_coordinate.any() else None
    for i in np.flatnonzero(by_coordinate):
        direction = q[i] / q_len[i]
        t = min(1.0, float(local[i]))
        keep = np.ones(len(c), dtype=bool)
        for f in np.argsort(-np.abs(direction), kind="stable")[:FOCUS]:
            x = direction[f]
            spread = np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - x * x))
            low = -1.0 if x < -t else t * x - spread
            high = 1.0 if x > t else t * x + spread
            keep &= (unit[:, f] >= low - 1e-7) & (unit[:, f] <= high + 1e-7)
        near = np.flatnonzero(keep & (c_ids != q_ids[i]))
        if len(near):
            yield from _take(q_ids[i], c_ids[near], _products(q[i : i + 1], c[near])[0], floors[i], k)
    by_length = np.flatnonzero(live & ~by_coordinate)
    if len(by_length):
        with np.errstate(divide="ignore", invalid="ignore"):
            shortest = np.where(known & (floors > 0), floors / q_len * (1 - SLACK), 0.0)[by_length]
        upto = np.searchsorted(-c_len, -shortest, side="right")
        for at in range(0, len(by_length), 256):  # memory: 256 queries times one block
            group, ends = by_length[at : at + 256], upto[at : at + 256]
            scores = _products(q[group], c[: ends.max(initial=0)])
            for row, i, end in zip(scores, group, ends, strict=True):
                own = c_ids[:end] != q_ids[i]
                yield from _take(q_ids[i], c_ids[:end][own], row[:end][own], floors[i], k)


def _take(query: int, ids: np.ndarray, scores: np.ndarray, floor: float, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    if scores.dtype == object:
        if any(not -(2**63) <= x < 2**63 for x in scores):
            raise OverflowError("a product doesn't fit 64 bits")
        scores = scores.astype(np.int64)
    if not np.isnan(floor):
        good = scores >= floor
        ids, scores = ids[good], scores[good]
    if len(ids):
        best = _best(ids, scores, k)
        yield query, ids[best], scores[best]


def _searcher(k: int):
    def of_pair(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(block):
            width = int(max(queries["q"].str.len().max(), block["v"].str.len().max()))
            q, v = _matrix(queries["q"], width), _matrix(block["v"], width)
            for query, ids, scores in search_block(queries["query"].to_numpy(), q, queries["floor"].to_numpy(dtype=float), block["id"].to_numpy(), v, k):
                found.append(pd.DataFrame({"query_id": query, "vec_id": ids, "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})

    return of_pair


def _kept(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; Spark limits each group before the shuffle already."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk(vectors: DataFrame, queries: DataFrame, k: int, *, block_rows: int | None = None, query_rows: int | None = None, lengths_per_doubling: int = 4) -> DataFrame:
    """Each query's k highest inner products: query_id, rank (from 1), vec_id, score.

    vectors and queries have id long and v array<long>; other columns are
    ignored. Rows without an id or with a null v take no part, nor does a
    query's own id. Where dimensions differ, missing components count as 0.
    Of queries with the same id the one with the smallest array counts.
    Repeated vectors are all returned, ties to smaller ids. Empty tables give
    an empty result. A score beyond 64 bits raises.

    Each vector is sent to the query parts that it may matter to. Parts hold
    query_rows queries, blocks block_rows vectors; by default as many as make
    QUERY_SIZE and BLOCK_SIZE components.
    """
    spark = vectors.sparkSession
    batches(spark)
    lengths = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    none = -(2**20)
    squared = lengths("v")
    bucket = F.when(squared > 0, F.floor(F.log2(squared) / 2 * lengths_per_doubling)).otherwise(F.lit(none)).cast("long")
    rows = vectors.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", "v", F.size("v").alias("dim"), bucket.alias("bucket"))
    # One row per dimension and length bucket reaches the driver: doubles have at most 2,100 doublings.
    sizes = sorted(((r["dim"], r["bucket"], r["n"]) for r in rows.groupBy("dim", "bucket").agg(F.count("*").alias("n")).collect()), key=lambda r: (-r[1], r[0]))
    layout, upto, first_of, n_blocks = {}, {}, 0, 0
    leading: list[int] = []
    for dim, b, n in sizes:
        parts = -(-n // (block_rows or max(1, BLOCK_SIZE // max(1, dim))))
        layout[dim, b] = (n_blocks, parts)
        if first_of < k + 1:  # blocks that hold more than k vectors, the longest first
            leading.append(n_blocks)
            first_of += n // parts
        n_blocks += parts
        upto[b] = n_blocks
    asked = queries.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select(F.col("id").alias("query"), F.col("v").alias("q")).groupBy("query").agg(F.min("q").alias("q"))
    n_queries = asked.count() if n_blocks else 0
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    at_once = query_rows or max(1, QUERY_SIZE // max(1, *(dim for dim, _, _ in sizes)))
    table_of = lambda entries: F.create_map(*[F.lit(x) if i == 0 else F.struct(F.lit(x[0]).alias("a"), F.lit(x[1]).alias("b")) for e in entries for i, x in enumerate(e)])
    place = F.element_at(table_of([(f"{dim}/{b}", at) for (dim, b), at in layout.items()]), F.concat_ws("/", "dim", "bucket"))
    dealt = lambda place, *key: (place["a"] + F.pmod(F.xxhash64(*key), place["b"])).cast("long")
    blocks = rows.select("id", "v", "bucket", dealt(place, "id").alias("block"))
    per_pair = _searcher(k)

    def searched(left: DataFrame, right: DataFrame) -> DataFrame:
        """Queries against vectors that have part and block: each pair of a part and a block meets once, as one bounded group."""
        return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(per_pair, "query_id long, vec_id long, score long")

    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    lead = F.array(*[F.lit(x).cast("long") for x in leading])
    parts = max(1, -(-n_queries // at_once))
    left = asked.select("query", "q", F.lit(None).cast("double").alias("floor"), F.pmod(F.xxhash64("query", F.lit(1)), F.lit(parts)).alias("part"), F.explode(lead).alias("block"))
    right = blocks.where(F.col("block").isin(leading)).select("id", "v", "block", F.explode(numbers(F.lit(parts))).alias("part"))
    first = stored(_kept(searched(left, right), k).drop("rank"))
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("worst"))
    # A little less than the k-th best, since a double can't hold every long.
    floors = floors.select(F.col("query_id").alias("query"), F.when(F.col("n") >= k, F.col("worst") - F.abs("worst") * 4e-16).alias("floor"))
    reach = F.col("floor") / F.greatest(F.sqrt(lengths("q")), F.lit(1e-300))
    level = F.when(reach > 0, F.floor(F.log2(reach) * lengths_per_doubling) - 1).otherwise(F.lit(none)).cast("long")
    wanted = stored(asked.join(floors, "query", "left").select("query", "q", "floor", F.coalesce(level, F.lit(none)).alias("level")))
    # Levels ascend as parts are numbered and buckets descend as blocks are: what can meet are the first parts and the first blocks.
    groups = sorted((r["level"], r["n"]) for r in wanted.groupBy("level").agg(F.count("*").alias("n")).collect())
    n_parts, of_level, meets = 0, [], []
    for lv, n in groups:
        own = -(-n // at_once)
        live = max((end for b, end in upto.items() if b >= lv), default=0)
        of_level.append((lv, (n_parts, own)))
        meets.append((lv, (live, 0)))
        n_parts += own
    live_parts = [(b, (sum(own for lv, (_, own) in of_level if lv <= b), 0)) for b in upto]
    home, seen = F.element_at(table_of(of_level), F.col("level")), F.element_at(table_of(meets), F.col("level"))["a"]
    left = wanted.where(seen > 0).select("query", "q", "floor", dealt(home, "query", F.lit(1)).alias("part"), F.explode(F.array_except(numbers(seen), lead)).alias("block"))
    n_live = F.element_at(table_of(live_parts), F.col("bucket"))["a"]
    right = blocks.where(~F.col("block").isin(leading) & (n_live > 0)).select("id", "v", "block", F.explode(numbers(n_live)).alias("part"))
    return _kept(first.unionByName(searched(left, right)), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the 20 best of every 20th vector among all of `embeddings`, components as floor(64 * x)."""
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), quantized(F.col("embedding")).alias("v"))
    return topk(rows, rows.where(F.col("id") % 20 == 0), 20)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
